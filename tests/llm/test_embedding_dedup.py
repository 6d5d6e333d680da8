import numpy as np
import pytest

from postings_engine.llm import embedding_dedup as E
from postings_engine.llm.queries import QUERIES

from . import brute


def expected(rows, cosine=0.9):
    usable = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {}
    for a, (i, x) in enumerate(usable):
        for j, y in usable[a + 1:]:
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                links.setdefault(i, []).append(j)
                links.setdefault(j, []).append(i)
    of = brute.components({i for i, _ in rows if i is not None}, [(a, b) for a, bs in links.items() for b in bs])
    return sorted(((i, len(links.get(i, [])), of.get(i), i is None or of[i] == i) for i, _ in rows), key=str)


def got(frame):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in frame.collect()), key=str)


def test_query_equals_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(QUERIES["op8_embedding_dedup"](spark, sf)) == expected(rows)


@pytest.mark.parametrize("width,small", [(8, False), (7, True)])
def test_clusters_of_all_densities(spark, monkeypatch, width, small):
    if small:
        monkeypatch.setattr(E, "LIST_SIZE", 40)
        monkeypatch.setattr(E, "CHUNK", 20)
        monkeypatch.setattr(E, "QUERIES", 30)
        monkeypatch.setattr(E, "BLOCK", 7)
    rng = np.random.default_rng(width)
    base = rng.normal(size=(12, width))
    rows = [(i, [float(x) for x in (base[i % 12] * rng.uniform(0.1, 9) + rng.normal(size=width) * 0.12 * (i % 5))]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(50)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, want = got(E.near_duplicates(frame, 0.9)), expected(rows)
    if not small:
        assert found == want
        return
    have, wanted = {r[0]: r for r in found}, {r[0]: r for r in want}
    assert all(have[i][1] <= wanted[i][1] and have[i][2] >= wanted[i][2] for i in wanted)
    assert sum(r[1] for r in found) >= 0.99 * sum(r[1] for r in want)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (9, [-1.0, 0.0]), (10, [1.0, 0.0, 0.0]),
            (11, [1e-300, 0.0]), (12, [1e300, 1e290]), (2, [2.0, 0.0]), (13, [-0.0, 1.0]), (14, [0.0, 1.0])]
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "vec_id long, embedding array<double>, list string, id string, key string")
    found = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(frame).collect()}
    assert found == {(1, 4, 1, True), (2, 4, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (None, 0, None, True),
                     (9, 0, 9, True), (10, 0, 10, True), (11, 4, 1, False), (12, 4, 1, False), (13, 1, 13, True), (14, 1, 13, False)}
    assert E.near_duplicates(frame.limit(0)).count() == 0
    assert E.near_duplicates(frame.where("vec_id = 3")).count() == 1


def test_recall_of_the_index(spark, monkeypatch):
    monkeypatch.setattr(E, "LIST_SIZE", 64)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.array([i for i, _ in rows])
    found = {r.vec_id: r.n_links for r in E.near_duplicates(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).collect()}
    queries = np.flatnonzero(ids % 50 == 0)
    want = (x[queries] @ x.T >= 0.9).sum(axis=1) - 1
    have = np.array([found[ids[q]] for q in queries])
    assert (have <= want).all() and have.sum() >= 0.99 * want.sum()
