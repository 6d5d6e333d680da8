import pyarrow as pa

from postings_engine.llm import common, pretokens
from postings_engine.llm.queries import tokenizer_path


def test_table_of_pieces_is_bounded():
    own = pretokens.PieceTokenizer(tokenizer_path())
    import numpy as np
    for step in range(3):
        data = np.frombuffer(" ".join(f"q{i:x}" for i in range(step * 90_000, (step + 1) * 90_000)).encode(), np.uint8)
        own.encode(data, np.array([0, len(data)]), 0)
    held = sum(x.nbytes for x in (own.keys, own.first, own.at, own.size))
    # 21 bytes a slot, and 0.7 of the slots may be full
    assert held == 21 * len(own.keys) and held < 21 * 2 * own.count / 0.7
    assert 21 * pretokens.MOST_PIECES / 0.7 <= 22 << 20


def test_memory_is_given_back_when_a_task_ends(monkeypatch):
    pool, calls = pa.default_memory_pool(), []
    class Pool:
        def release_unused(self):
            calls.append(1)
            pool.release_unused()
    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    rows = common.given_back(lambda batches: (b for b in batches))(iter([1, 2]))
    assert next(rows) == 1 and not calls
    assert list(rows) == [2] and calls == [1]
