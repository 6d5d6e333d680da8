import numpy as np
import pytest

from postings_engine.llm import setjoin

from . import brute


@pytest.mark.parametrize("held,nodes", [(5, 4), (5, 5), (5, 6), (5, 61), (6, 60), (1, 7), (20_000, 60)])
def test_key_of_more_nodes_than_are_held_keeps_every_link(spark, held, nodes):
    """Sets that share one key only: each pair (i, nodes - 1 - i) links, so the two sides of most pairs
    are far apart in the key's order, and nothing else chains them."""
    rng = np.random.default_rng(nodes)
    base = [rng.integers(0, 2**64, 200, dtype=np.uint64) for _ in range((nodes + 1) // 2)]
    sets = {}
    for i in range(nodes):
        own = base[min(i, nodes - 1 - i)].copy()
        if 2 * i > nodes - 1:
            own[:5] = rng.integers(0, 2**64, 5, dtype=np.uint64)
        sets[i] = np.unique(own)
    flat, at = np.concatenate(list(sets.values())), np.concatenate([[0], np.cumsum([len(v) for v in sets.values()])])
    signs = spark.createDataFrame([(i, len(sets[i]), bytearray(m)) for i, m in enumerate(setjoin.marks(flat, at, 1))], "node long, n long, mark binary")
    entries = spark.createDataFrame([(7, i) for i in range(nodes)] + [(7, 0), (8, 1)], "key long, node long")
    shared = setjoin.shared_keys(entries, held)
    assert sorted((r.key, r.node) for r in shared.collect()) == [(7, i) for i in range(nodes)]
    links = [(r.a, r.b) for r in setjoin.likely_links(shared, signs, 4, 5).collect()]
    of = brute.components(sets, links)
    wanted = brute.jaccard_links({i: frozenset(v.tolist()) for i, v in sets.items()}, 4, 5)
    assert len(wanted) == nodes // 2 and all(of[a] == of[b] for a, b in wanted)
    assert len(links) < nodes  # bitmaps keep unlike sets apart, so that clusters stay small


def test_join_over_a_large_key_equals_brute_force(spark, monkeypatch):
    """Short texts share the keys of their empty segments; these have more nodes than are held."""
    from postings_engine.llm import ngram_join
    monkeypatch.setattr(ngram_join, "shared_keys", lambda e: setjoin.shared_keys(e, 5))
    rng, rows = np.random.default_rng(4), []
    for i in range(80):
        own = [f"w{x}" for x in rng.integers(0, 10_000, 14)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[:-1]))]
    sets = {i: brute.word_shingles(t, 4) for i, t in rows}
    of = brute.components(sets, brute.jaccard_links(sets, 85, 100))
    found = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100)
    assert {tuple(r) for r in found.collect()} == {(i, len(s), of[i]) for i, s in sets.items()}
    assert len(set(of.values())) < len(rows)
