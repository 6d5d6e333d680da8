import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from postings_engine.llm import merkle
from postings_engine.llm.merkle import fold, hexed, manifest, proof_digest, verified_manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(r, text):
    return H(*(field(v) for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def tree(leaves, arity):
    """(last node, for each leaf its siblings left and right, level by level)."""
    ways, below, nodes = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(nodes) > 1:
        runs = [range(a, min(a + arity, len(nodes))) for a in range(0, len(nodes), arity)]
        for run in runs:
            for k in run:
                for i in below[k]:
                    ways[i].append((nodes[run[0]:k], nodes[k + 1:run[-1] + 1]))
        below, nodes = [[i for k in run for i in below[k]] for run in runs], [H(*(nodes[k] for k in run)) for run in runs]
    return nodes[0], ways


def plain(rows, arity=3):
    groups = {}
    for r in rows:
        groups.setdefault(r.source, []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for rs in groups.values():
        rs.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    trees = {s: tree([leaf(r, r.text) for r in groups[s]], arity) for s in names}
    root, upper = tree([trees[s][0] for s in names], arity) if names else (None, [])
    out = []
    for s, onward in zip(names, upper):
        for r, way in zip(groups[s], trees[s][1]):
            steps = way + onward
            text = r.text
            if r.doc_id is not None and text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(r, text)
            for left, right in steps:
                folded = H(*left, folded, *right)
            out.append((r.doc_id, leaf(r, r.text), trees[s][0], root, H(*(x for a, b in steps for x in a + b)), folded, folded == root))
    return out


def run(docs, arity=3):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return [tuple(r) for r in verified_manifest(docs, F.replace(F.col("text"), F.lit("\n"), F.lit("")), tampered, arity).collect()]


def same(got, want):
    return sorted(got, key=str) == sorted(want, key=str)


def test_odd_rows(spark, odd_documents):
    assert same(run(odd_documents), plain(odd_documents.collect()))
    assert run(odd_documents.limit(0)) == []
    assert same(run(odd_documents.limit(1)), plain(odd_documents.limit(1).collect()))


@pytest.mark.parametrize("levels, arity", [(1, 3), (2, 2)])
def test_blocks_smaller_than_trees(spark, monkeypatch, levels, arity):
    """A hot group, groups of one leaf, and ancestors that go to several blocks."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    rows = [(i, f"text\n{i}", "en", "hot" if i % 3 else f"s{i % 40}", i) for i in range(150)] + [(150, None, None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert same(run(docs, arity), plain(docs.collect(), arity))


def test_a_way_proves_its_leaf_alone(spark):
    rows = spark.createDataFrame([("a", i, bytearray(hashlib.sha256(str(i).encode()).digest())) for i in range(10)], "grp string, id long, digest binary")
    got = manifest(rows).select(fold(F.col("digest"), F.col("steps")) == F.col("root"), fold(F.unhex(F.sha2(F.lit("x"), 256)), F.col("steps")) == F.col("root"), hexed(proof_digest(F.col("steps")))).collect()
    assert all(r[0] and not r[1] for r in got) and len({r[2] for r in got}) == 10
