import numpy as np
import pytest

from postings_engine.llm.ngram_join import SizeClasses, jaccard_components, segment_keys
from postings_engine.llm.queries import QUERIES

from . import brute


def expected(rows, width, num, den):
    sets = {i: brute.word_shingles(t, width) for i, t in rows}
    of = brute.components(sets, brute.jaccard_links(sets, num, den))
    return {(i, len(s), of[i]) for i, s in sets.items()}


def test_query_equals_brute_force(spark, sf, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert {tuple(r) for r in QUERIES["op1_ngram_join"](spark, sf).select("doc_id", "n_shingles", "component_id").collect()} == expected(rows, 4, 85, 100)


@pytest.mark.parametrize("width,num,den", [(5, 4, 5), (4, 85, 100), (2, 9, 10)])
def test_edited_copies_of_all_sizes(spark, width, num, den):
    rng, texts = np.random.default_rng(width), []
    for size in (3, 5, 8, 12, 20, 33, 60, 110, 250, 600):
        base = [f"w{x}" for x in rng.integers(0, 5000, size)]
        for edits in (0, 0, 1, 1, 2, size // 40, size // 25, size // 12):
            own = list(base)
            for e in range(edits):
                own[int(rng.integers(0, size))] = f"e{e}"
            texts.append(" ".join(own[: size - int(rng.integers(0, 1 + size // 20))]))
    common = " ".join(f"p{i}" for i in range(40))  # a passage that many texts share
    texts += [" ".join(f"q{k}x{i}" for i in range(30)) + " " + common for k in range(40)]
    rows = list(enumerate(texts))
    found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width, num, den)
    assert {tuple(r) for r in found.collect()} == expected(rows, width, num, den)


def test_large_group_is_cut_into_tiles(spark, monkeypatch):
    from postings_engine.llm import ngram_join, setjoin
    monkeypatch.setattr(ngram_join, "tiles", lambda m, t, s: setjoin.tiles(m, t, s, tile=600))
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[: 3 * (i % 20)] + [f"x{i}"] + base[3 * (i % 20) + 1: 190 + i % 10])) for i in range(60)]
    found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100)
    assert {tuple(r) for r in found.collect()} == expected(rows, 4, 85, 100)


def test_odd_rows(spark, odd_documents):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(odd_documents, 4, 85, 100).collect()}
    rows = [(r.doc_id, r.text) for r in odd_documents.collect() if r.doc_id is not None]
    assert got == expected(rows, 4, 85, 100) | {(None, 5, None)}
    assert jaccard_components(odd_documents.limit(0)).count() == 0


def test_linked_sets_share_a_key():
    rng, classes = np.random.default_rng(1), SizeClasses(85, 100)
    for n in [7, 8, 12, 13, 19, 40, 64, 90, 200, 1000]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            gone = int(0.15 / 1.85 * n * 2 * rng.random())
            b = np.sort(np.concatenate([a[gone // 2:], rng.integers(0, 2**64, gone - gone // 2, dtype=np.uint64)]))
            overlap = len(np.intersect1d(a, b))
            if 100 * overlap < 85 * (len(a) + len(b) - overlap) or np.array_equal(a, b):
                continue
            k1, _ = segment_keys(a, np.array([0, len(a)]), classes)
            k2, _ = segment_keys(b, np.array([0, len(b)]), classes)
            assert np.intersect1d(k1, k2).size
