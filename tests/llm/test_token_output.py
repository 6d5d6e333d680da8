import random
import struct
import zlib

import numpy as np
import xxhash

from postings_engine.llm.common import Scratch
from postings_engine.llm import pretokens
from postings_engine.llm.queries import QUERIES, tokenizer_path
from postings_engine.llm.token_output import read_tokens, token_output, write_tokens


def expected(rows):
    from tokenizers import Tokenizer
    own, out, start = Tokenizer.from_file(tokenizer_path()), [], 0
    def place(row):
        hashed = xxhash.xxh64_intdigest((row[1] or "").encode(), 42) if row[1] is not None else 42
        return row[0] is not None, row[0] or 0, hashed - (hashed >> 63 << 64)
    for doc_id, text in sorted(rows, key=place):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_query_equals_plain_encoding(spark, sf, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = QUERIES["op2_token_output"](spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == sorted(expected(rows))


def test_pieces_equal_whole_texts(monkeypatch):
    own, rng = pretokens.PieceTokenizer(tokenizer_path()), random.Random(5)
    signs = [" ", "  ", "\n", "\n\n ", "\t", "\r\n", "a", "Ab", "'s", "'", "'re", "'ll", "'d", "s", "ve", "1", "23", ".", "é", "ñ", "²", "×", "«", "ª", "\x00", "_", "ɏ"]
    rare = ["東", "\xa0", "\u2003", "\u3000", "\x85", "\x1c", "\u200b", "<|endoftext|>", "🙂", "x" * 80, "ɐ", "\u0300"]
    for step in range(400):
        if step == 200:
            own.forget()
            monkeypatch.setattr(pretokens, "MOST_PIECES", 50)
        texts = ["".join(rng.choice(signs if rng.random() < 0.98 or step % 4 else rare) for _ in range(rng.randint(0, 14))) for _ in range(12)]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        ids, at = own.encode(data, np.cumsum([0, *(len(t.encode()) for t in texts)]), 0)
        got = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
        assert got == [[*own.whole(t).tolist(), 0] for t in texts], texts


def test_odd_rows(spark, odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    got = [tuple(r) for r in token_output(odd_documents, tokenizer_path()).collect()]
    assert sorted(got, key=str) == sorted(expected(rows), key=str)
    assert token_output(odd_documents.limit(0), tokenizer_path()).count() == 0


def test_files_hold_ranges_in_order_and_filters(spark, documents):
    from pyarrow import orc
    path = Scratch(spark, "test").new_path("ids")
    write_tokens(documents, path, tokenizer_path(), parts=4)
    rows = read_tokens(spark, path).orderBy("part", "place").collect()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows) and len({r.part for r in rows}) > 1
    assert [r.start for r in rows] == [sum(len(x.ids) for x in rows[:i]) for i in range(len(rows))]
    import glob
    file = orc.ORCFile(sorted(glob.glob(path.removeprefix("file:") + "/*.orc"))[0])
    assert file.compression.lower().startswith("zstd") and file.row_index_stride > 0
