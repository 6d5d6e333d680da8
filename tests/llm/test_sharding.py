import collections
import random
import zlib

from postings_engine.llm.queries import QUERIES
from postings_engine.llm.sharding import RoomTree, level, pack, shard


def check(rows, got, most_apart=None):
    """Sizes, digests, whole groups and gapless slots."""
    assert sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows) == sorted((r.doc_id, r.size, r.text_crc32) for r in got)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts, where = dict(rows), collections.defaultdict(set)
    for r in got:
        where[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_query(spark, sf, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = QUERIES["op4_sharding"](spark, sf).collect()
    check(rows, got)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None} and {r.shard for r in got} <= set(range(40))


def test_sizes_come_out_near_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = shard(docs, 8).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.005 * max(sizes)


def test_a_group_above_a_share_fills_a_shard(spark):
    rows = [(i, "hot " * 100) for i in range(300)] + [(300 + i, f"text {i} " * (1 + i % 9)) for i in range(400)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    check(rows, got)
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += r.size
    hot = max(sizes.values())
    assert hot == 300 * 416 and max(s for s in sizes.values() if s != hot) < 1.02 * min(sizes.values())


def test_capacity_mode_uses_few_shards(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    total = sum(len(t.encode()) + 16 for _, t in rows)
    got = shard(documents, capacity=total // 6).collect()
    check(rows, got)
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert max(sizes.values()) <= total // 6 and len(sizes) <= 8


def test_odd_rows(spark, odd_documents):
    got = shard(odd_documents, 3).collect()
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert sorted(((i, len((t or "").encode()) + 16) for i, t in rows), key=str) == sorted(((r.doc_id, r.size) for r in got), key=str)
    assert len({r.shard for r in got if r.size == 31}) == 1
    assert shard(odd_documents.limit(0), 3).count() == 0


def test_tree_gives_the_tightest_bin():
    rng, tree, plain = random.Random(1), RoomTree(), []
    RoomTree.LEAF = 4
    for step in range(3000):
        if rng.random() < 0.55 or not plain:
            entry = (rng.randint(0, 500), step)
            tree.add(entry)
            plain.append(entry)
        elif rng.random() < 0.2:
            assert tree.roomiest() == max(plain)
            plain.remove(max(plain))
        else:
            size = rng.randint(0, 520)
            want = min((e for e in plain if e[0] >= size), default=None)
            assert tree.tightest(size) == want
            if want:
                plain.remove(want)


def test_pack_is_best_fit_decreasing():
    rng = random.Random(2)
    for bins in (None, 7):
        sizes = [(i, rng.randint(1, 60)) for i in range(200)]
        capacity = level([s for _, s in sizes], 7)
        room, out = [capacity] * (bins or 0), {}
        for unit, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
            fits = [(r, b) for b, r in enumerate(room) if r >= size]
            if fits:
                b = min(fits)[1]
            elif bins:
                b = max((r, b) for b, r in enumerate(room))[1]
            else:
                b = len(room)
                room.append(capacity)
            room[b] -= size
            out[unit] = b
        assert pack(sizes, capacity, bins) == out
    assert level([100, 1, 1, 1, 1], 3) == 2 and level([5, 5], 1) == 10 and level([], 4) == 0
