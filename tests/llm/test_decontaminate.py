import hashlib

import numpy as np
import pytest

from postings_engine.llm import decontaminate as D
from postings_engine.llm.queries import QUERIES

from . import brute


def test_query_equals_brute_force(spark, sf, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = set()
    for r in documents.collect():
        words, hit, found = brute.hit_words(r.text, items, 10)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        want.add((r.doc_id, len(words), len(hit), len(found), digest, bool(hit)))
    got = {tuple(r) for r in QUERIES["op9_decontaminate"](spark, sf).collect()}
    assert got == want and any(w[5] for w in want)


@pytest.mark.parametrize("window,shard", [(3, 100_000), (4, 10), (1, 100_000), (10, 100_000)])
def test_random_words_against_brute_force(spark, monkeypatch, window, shard):
    monkeypatch.setattr(D, "SHARD_WORDS", shard)
    rng = np.random.default_rng(window)
    text = lambda n: " ".join(rng.choice(list("abcDé"), n))
    items = [(i, text(int(rng.integers(0, 14)))) for i in range(12)] + [(90, None), (91, ""), (3, "a b")]
    docs = [(i, text(int(rng.integers(0, 40)))) for i in range(60)] + [(100, None), (101, "...")]
    found = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window)
    for r in found.collect():
        words, hit, of = brute.hit_words(dict(docs)[r.doc_id], items, window)
        assert (r.n_words, r.n_hit, r["items"]) == (len(words), len(hit), sorted({str(x) for x in of})), r
        assert {i for s in r.spans for i in range(s.first, s.end)} == hit


def test_spans_are_cut_and_covered_rows_go(spark, odd_documents):
    items = spark.createDataFrame([(1, "Alpha beta gamma delta"), (None, "e f g h")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Before: ALPHA, beta gamma-delta. After the rest é of it."), (2, "alpha beta gamma delta"), (3, "clean"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in D.decontaminate(docs, items, 4, 0.5).collect()}
    assert got == {1: "Before: . After the rest é of it.", 3: "clean", 4: None}
    odd = D.decontaminate(odd_documents, items, 4, 0.5)
    assert odd.columns == odd_documents.columns
    assert {(r.doc_id, r.text) for r in odd.collect()} >= {(6, "a b c d "), (0, None), (1, "")}
    assert D.decontaminate(odd_documents.limit(0), items).count() == 0
    assert D.decontaminate(odd_documents, items.limit(0)).count() == odd_documents.count()


def test_too_many_items_are_refused(spark, monkeypatch):
    monkeypatch.setattr(D, "MOST_BENCHMARK_BYTES", 3)
    with pytest.raises(ValueError):
        D.build(spark.createDataFrame([(1, "four")], "item_id long, text string"), 10)
