import collections
import hashlib
import math

import corpus_pipeline
from postings_engine.llm import language_id
from postings_engine.llm.queries import labelled_documents, tokenizer_path

from . import brute
from .test_token_output import expected as tokens_of


def test_stages_against_brute_force(spark, sf, documents):
    """Each stage on all that the one before it kept."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "token output"]
    stage = dict(corpus_pipeline.STAGES)
    docs, columns = documents, documents.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    kept = stage["language ID"](spark, docs, sf)
    model = language_id.fit(labelled_documents(docs))
    import pyarrow as pa
    rows = docs.collect()
    lang, score, bits = language_id.judge(model, pa.array([r.text for r in rows]))
    want = {r.doc_id for r, a, b, c in zip(rows, lang, score, bits) if a != "und" and b >= 0.5 and c <= 8}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == want

    before = {r.doc_id: r for r in kept.collect()}
    kept = stage["n-gram Jaccard join"](spark, kept, sf)
    sets = {i: brute.word_shingles(r.text, 5) for i, r in before.items()}
    of = brute.components(sets, brute.jaccard_links(sets, 4, 5))
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {i for i in of if of[i] == i}
    assert all(r == before[r.doc_id] for r in kept.collect())

    before = kept.collect()
    kept = stage["benchmark decontamination"](spark, kept, sf)
    after = {r.doc_id: r for r in kept.collect()}
    cut = 0
    for r in before:
        words, hit, _ = brute.hit_words(r.text, items, 10)
        assert (r.doc_id in after) == (2 * len(hit) <= len(words))
        if r.doc_id in after:
            own = after[r.doc_id]
            assert own.n_chars == len(own.text) and (own.text == r.text) == (not hit)
            assert len(brute.hit_words(own.text, items, 10)[0]) <= len(words) - len(hit) + 1 or not hit
            cut += bool(hit)
    assert cut

    mixed = stage["mixing sources"](spark, kept, sf)
    assert mixed.columns == columns
    rows = [(r.doc_id, r.text) for r in mixed.collect()]
    assert set(rows) <= {(r.doc_id, r.text) for r in after.values()}

    out = stage["token output"](spark, mixed, sf).collect()
    assert sorted(map(tuple, out)) == sorted(tokens_of(rows))


def test_run_chains_the_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 50
    assert corpus_pipeline.ORACLE_SQL is None and tokenizer_path().endswith("byte_bpe_50k.json")


def test_odd_and_empty_tables(spark, sf, odd_documents):
    docs = odd_documents
    counts = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        counts.append(docs.count())
    assert 10 <= counts[0] <= 12 and counts[1] <= counts[0] - 3  # five have no letters; an unlearned one may need over 8 bits
    docs = odd_documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def copies_of(rows):
    """{(doc_id, text): copies} of rows(doc_id, text, source), drawn at the rates of the square root of sizes."""
    size = collections.Counter()
    for r in rows:
        size[r.source] += max(1, len((r.text or "").encode()))
    weight = {s: math.sqrt(n) for s, n in size.items()}
    want = collections.Counter()
    for r in rows:
        rate = weight[r.source] / sum(weight.values()) * sum(size.values()) / size[r.source]
        parts = max(1, math.ceil(rate / 16))
        for j in range(1, parts + 1):
            draw = int(hashlib.md5(f"0|{r.doc_id}|{j}".encode()).hexdigest()[:8], 16) / 2**32
            term = total = math.exp(-rate / parts)
            k = 0
            while total <= draw:
                k += 1
                term *= rate / parts / k
                total += term
            want[r.doc_id, r.text] += k
    return +want


def test_mixing_stage_makes_each_copy(spark, sf, documents):
    mixed = dict(corpus_pipeline.STAGES)["mixing sources"](spark, documents, sf)
    want = copies_of(documents.collect())
    assert collections.Counter((r.doc_id, r.text) for r in mixed.collect()) == want
    assert max(want.values()) > 1 and len(want) < documents.count()
