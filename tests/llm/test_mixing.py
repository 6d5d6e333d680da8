import collections
import math

from pyspark.sql import functions as F

from postings_engine.llm.mixing import cumulative, mix_sources, poisson_copies, source_rates


def test_cumulative_probabilities(spark):
    for mean in (0.0, 0.01, 1.0, 7.5, 16.0):
        got = spark.range(1).select(cumulative(F.lit(mean)).alias("c")).first().c
        want = [sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(n + 1)) for n in range(len(got))]
        assert all(abs(a - b) < 1e-12 for a, b in zip(got, want)) and got[-1] > 1 - 1e-12


def test_rates_give_the_target_shares(spark):
    docs = spark.createDataFrame([(i, "a" if i < 90 else "b" if i < 99 else None, "x" * 10) for i in range(100)], "doc_id long, source string, text string")
    weights = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 1.0), (None, 1.0), ("zero", 5.0)], "source string, weight double")
    rates = {r.source: r.rate for r in source_rates(docs, weights).collect()}
    assert {s: round(rates[s] * n * 10, 6) for s, n in (("a", 90), ("b", 9), (None, 1))} == {"a": 200.0, "b": 600.0, None: 200.0}


def test_large_and_small_means_are_poisson(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("t").alias("text"))
    for mean in (0.4, 3.0, 70.0):
        rates = spark.createDataFrame([("s", mean)], "source string, rate double")
        n = collections.Counter(r.doc_id for r in poisson_copies(docs, rates, 3).select("doc_id").collect())
        counts = [n[i] for i in range(4000)]
        average = sum(counts) / 4000
        spread = sum((c - average) ** 2 for c in counts) / 4000
        assert abs(average - mean) < 5 * math.sqrt(mean / 4000) and abs(spread / mean - 1) < 0.15
        if mean < 1:
            assert abs(counts.count(0) / 4000 - math.exp(-mean)) < 0.04


def test_copies_are_whole_shuffled_and_native(spark, documents):
    mixed = mix_sources(documents)
    assert not [w for w in ("Python", "Pandas", "Arrow") if w in mixed._jdf.queryExecution().toString()]
    rows = mixed.collect()
    of = collections.defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r.copy)
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in of.values())
    assert [r.shuffle_key for r in rows] == sorted(r.shuffle_key for r in rows) and len({r.shuffle_key for r in rows}) == len(rows)
    assert [r.doc_id for r in rows] != sorted(r.doc_id for r in rows)
    again = mix_sources(documents.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows)) and sorted(map(str, mix_sources(documents, seed=1).collect())) != sorted(map(str, rows))


def test_odd_rows(spark, odd_documents):
    got = mix_sources(odd_documents)
    assert [c for c in odd_documents.columns if c not in ("copy", "rate")] == got.columns[:-4]
    assert mix_sources(odd_documents.limit(0)).count() == 0
    assert mix_sources(odd_documents, spark.createDataFrame([("none", 1.0)], "source string, weight double")).count() == 0
    twice = [r.n_copies for r in got.where("doc_id = 6").collect()]
    assert len(set(twice)) <= 1 and len(twice) == 2 * (twice[0] if twice else 0)
