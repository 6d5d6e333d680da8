import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postings_engine.llm import language_id as L
from postings_engine.llm.queries import QUERIES


class PlainPpm:
    """The same model, one byte at a time over dictionaries."""

    def __init__(self, texts, order):
        self.order, self.counts = order, [defaultdict(lambda: defaultdict(int)) for _ in range(order + 1)]
        for t in texts:
            data = b"\n" * order + t.encode()
            for i in range(order, len(data)):
                for k in range(order + 1):
                    self.counts[k][data[i - k: i]][data[i]] += 1

    def length(self, data, i):
        total = 0
        for k in range(self.order, -1, -1):
            seen = self.counts[k].get(data[i - k: i])
            if seen:
                whole = sum(seen.values()) + len(seen)
                if data[i] in seen:
                    return total + round(-math.log2(seen[data[i]] / whole) * L.UNIT)
                total += round(-math.log2(len(seen) / whole) * L.UNIT)
        return total + 8 * L.UNIT

    def text_length(self, t):
        data = b"\n" * self.order + t.encode()
        return sum(self.length(data, i) for i in range(self.order, len(data)))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_code_lengths_equal_a_plain_model(spark, documents, order):
    rows = [(r.lang, r.text) for r in documents.limit(60).collect()]
    labelled = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "lang string, text string, pick long")
    model = L.fit(labelled, order, 10**9)
    plain = {lang: PlainPpm([t for a, t in rows if a == lang], order) for lang in model.languages}
    texts = ["", "entirely new: ñandú 東京 \x00", rows[0][1][:300], rows[5][1][:50], "x" * 1000]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    for piece in (1 << 18, 7):
        got = L.code_lengths(model, data, offsets, piece)
        assert got.tolist() == [[plain[lang].text_length(t) for t in texts] for lang in model.languages]


def test_held_out_accuracy(spark, sf, documents):
    found = QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    rows = found.join(truth, "doc_id").where("held_out AND lang IS NOT NULL AND length(text) >= 40").collect()
    assert len(rows) > 100
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_rows_are_not_learned_from(spark, documents):
    from postings_engine.llm.queries import held_out, labelled_documents
    kept = {r.pick for r in labelled_documents(documents).collect()}
    out = {r[0] for r in documents.where(held_out(F.col("doc_id"))).select(F.xxhash64("doc_id")).collect()}
    assert out and not kept & out


def test_odd_rows(spark, odd_documents):
    labelled = odd_documents.select("lang", "text", F.xxhash64("doc_id").alias("pick"))
    got = [(r.doc_id, r.lang_pred, r.score) for r in L.language_id(odd_documents, labelled).collect()]
    assert len(got) == odd_documents.count()
    of = {i: (lang, score) for i, lang, score in got}
    assert all(of[i] == ("und", 0.0) for i in (0, 1, 2, 9, 13))
    assert of[6][0] in ("en", "fr") and of[None][0] == of[6][0]
    assert {r.lang_pred for r in L.language_id(odd_documents, labelled.limit(0)).collect()} == {"und"}
    assert L.language_id(odd_documents.limit(0), labelled).count() == 0
    kept = L.keep_recognised(odd_documents, labelled)
    assert kept.columns == odd_documents.columns and {r.doc_id for r in kept.collect()} >= {3, 6, 11}
    assert not {r.doc_id for r in kept.collect()} & {0, 1, 2, 9, 13}
    assert L.keep_recognised(odd_documents, labelled.limit(0)).count() == odd_documents.count()


def test_ties_go_to_the_first_name(spark):
    labelled = spark.createDataFrame([("b", "same text", 1), ("a", "same text", 2), (None, "zzz", 3)], "lang string, text string, pick long")
    docs = spark.createDataFrame([(1, "same text")], "doc_id long, text string")
    r = L.language_id(docs, labelled).first()
    assert (r.lang_pred, r.score) == ("a", 0.5)
