import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from postings_engine.llm.queries import QUERIES
from postings_engine.llm.skip_chain import KIND_OF, KINDS, LABELS, Field, Graph, added_spans, base_spans, fit, labels_of, listed, personal_data, tokens_of, train, with_added

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, found):
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    return [[m.span() for m in re.finditer(p, text) if passes(kind, m.group())] for kind, p in PATTERNS.items()]


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    pieces = ["4465758382889437", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (743) 555-3824", "10.2.3.4", "256.1.1.1", "a.b@c.de", "a@b", "@", "@@", ".", "-", " ", "+", "é", "_", "%", "1", "007.0.0.255", "x", "..", "b@c.d.e@f.g", "1.2.3.4.5.6.7.8.9", "\n", "(", ")"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        assert base_spans(text) == plain(text), text
    for _ in range(4000):
        text = "".join(rng.choice("0149.@-+ a%(") for _ in range(rng.randint(1, 60)))
        assert base_spans(text) == plain(text), text


@pytest.mark.parametrize("piece", ["a", "1", "1.", "a@", "@", "+1", "1 ", "+", "a-", "(1", "..", "4111 1111 1111 1111 "])
def test_time_grows_with_the_text(piece):
    text = piece * (400_000 // len(piece))
    began = time.process_time()
    base_spans(text)
    tokens_of(text)
    assert time.process_time() - began < 3


def odds_by_hand(field, features, pairs, alike):
    """Marginals by adding up all labellings."""
    own, out = field.own(features, pairs), np.zeros((len(features), LABELS))
    for labels in itertools.product(range(LABELS), repeat=len(features)):
        score = sum(own[i, y] for i, y in enumerate(labels)) + sum(field.adjacent[labels[a], labels[b]] for a, b in pairs) + sum(field.skip[KIND_OF[labels[a]], KIND_OF[labels[b]]] for a, b in alike)
        for i, y in enumerate(labels):
            out[i, y] += np.exp(score)
    return out / out.sum(axis=1, keepdims=True)


def field_of(seed):
    rng = np.random.default_rng(seed)
    skip = rng.normal(size=(len(KINDS) + 1,) * 2)
    from postings_engine.llm.skip_chain import FEATURES
    return Field(rng.normal(size=(FEATURES, LABELS)) / 2, rng.normal(size=(LABELS, LABELS)), skip + skip.T)


def test_messages_are_exact_on_trees_and_near_on_loops():
    graph = Graph()
    graph.add(0, "77 88 and 5551234567 so x@y.zz and x@y.zz")  # a pair of adjacent tokens, one alone, a skip edge
    features, pairs, alike = graph.arrays()
    assert (len(pairs), len(alike)) == (1, 1)
    assert np.allclose(field_of(1).marginals(features, pairs, alike), odds_by_hand(field_of(1), features, pairs, alike), atol=1e-4)
    graph = Graph()
    graph.add(0, "5551234567 12 5551234567 12")
    features, pairs, alike = graph.arrays()
    weak = field_of(2)
    weak.adjacent, weak.skip = weak.adjacent / 3, weak.skip / 3
    assert len(pairs) == 3 and len(alike) == 1 and np.abs(weak.marginals(features, pairs, alike) - odds_by_hand(weak, features, pairs, alike)).max() < 0.05


def test_skip_edges_carry_a_label_to_a_distant_token():
    texts = [f"call +1 (74{i}) 555-38{i}4 now, or +1 (74{i}) 555-38{i}4 and not {i}777{i} {1000 + i}" for i in range(9)] * 5
    graph, labels = Graph(), []
    for i, t in enumerate(texts):
        a = len(graph)
        graph.add(i, t)
        labels += labels_of(graph.spans[a:], base_spans(t))
    field = fit(*graph.arrays(), np.array(labels))

    def odds(text, tied):
        graph = Graph()
        graph.add(0, text)
        features, pairs, alike = graph.arrays()
        return 1 - field.marginals(features, pairs, alike if tied else alike[:0])[-1, 0]
    text = "call +1 (743) 555-3824 at once. " + "Words stand between them. " * 50 + "Remember 7435553824"
    assert odds(text, True) > 10 * odds(text, False)
    graph = Graph()
    graph.add(0, "ab 4465758382889437 4465758382889437 ab")
    assert labels_of(graph.spans, base_spans("ab 4465758382889437 4465758382889437 ab")) == [0, 0]


def test_added_spans_touch_no_base_span():
    found = [[(10, 20)], [], [(0, 5)], []]
    assert with_added(found, [(0, 20, 25), (1, 19, 22), (2, 5, 10), (3, 4, 6), (3, 30, 31)]) == [[(10, 20), (20, 25)], [], [(0, 5), (5, 10)], [(30, 31)]]


def check(docs, got, field, certain=0.95):
    want = []
    for r in docs.collect():
        found, graph = plain(r.text or ""), Graph()
        graph.add(0, r.text or "")
        spans = with_added(found, added_spans(graph, field, certain).get(0, []) if len(graph) else [])
        assert all(set(own) <= set(spans[k]) for k, own in enumerate(found))
        want.append((r.doc_id, *map(len, found), hashlib.sha256(listed(found).encode()).hexdigest(), listed(spans), sum(map(len, spans)) - sum(map(len, found))))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_query_equals_plain_patterns_and_adds_repeated_cards(spark, sf, documents):
    field = train(documents.select("doc_id", "text"))
    check(documents, QUERIES["op12_personal_data"](spark, sf).collect(), field)
    doubled = spark.createDataFrame([(1, "xx 4465758382889437 4465758382889437 yy"), (2, "the year 2019 and 17 things, 1234567"), (3, "see 4465758382889438 4465758382889438")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in personal_data(doubled, train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))).collect()}
    assert got == {1: "card:3:19,card:20:36", 2: "", 3: ""}


def test_odd_rows(spark, odd_documents):
    texts = ["1" * 500, "a@b.cd " * 300, "+1 (743) 555-3824 +1 (743) 555-3824", "😀 a@b.cd", "12 " * 2_000]
    more = spark.createDataFrame([(900 + i, t) for i, t in enumerate(texts)] + [(900, texts[0]), (None, texts[3])], "doc_id long, text string")
    docs = odd_documents.select("doc_id", "text").unionByName(more)
    field = train(docs)
    check(docs, personal_data(docs, field).collect(), field)
    assert personal_data(odd_documents.limit(0)).count() == 0
