"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the base spans. The field reads the tokens that hold a digit or an @ (any other token
can be nothing but outside, so it takes part as a fixed neighbour) and labels each as outside or as
the begin or inside of a kind. Potentials: a token's form and the word before it, the labels of
adjacent tokens, and skip edges: each token is tied to the next one in its document, however far, that
is the same or ends in the same seven digits, by a potential of their two kinds. Loopy message passing
in rounds of fixed number gives every token's probabilities, so a token that is unclear where it stands takes on
what its like is elsewhere. Tokens that are of a kind with `certain` probability and touch no base
span add spans; base spans always stay.

The weights are fitted here, by pseudo-likelihood, to the base spans of SAMPLE documents of at most
SAMPLE_BYTES and SAMPLE_TOKENS together, those with the smallest hashes of id and text: each token's label given its neighbours'. A token
with a skip edge is seen a second time with its form and neighbours hidden, so that the edge's weight
is learned although the form alone would do. The statistics are frozen; every whole text is read.

Defined cases. Null and empty texts have no spans. Rows with equal or no ids, and repeated rows, are
rows like others. A sample without spans, or an empty table, gives a field that adds nothing. Long
texts and long runs of one kind of character take time in proportion to their length. Only doc_id
and text are read."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")
#: Outside, then begin and inside of each kind.
LABELS = 1 + 2 * len(KINDS)
KIND_OF = np.array([0, *(k + 1 for k in range(len(KINDS)) for _ in "bi")])
SAMPLE, SAMPLE_BYTES = 1_000, 65_536
#: The fit takes documents of the sample, in order of their hashes, as long as their tokens come to no more.
SAMPLE_TOKENS = 8_000
PASSES = 20
#: Below twice the inverse of the squared size of a token's features, so that the fit comes to rest.
STEP = 0.1
#: Tokens that are inferred at once.
TOKENS_AT_ONCE = 20_000

HINT = re.compile(r"[0-9@]")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A run of token characters with a digit or an @ in it; tried at the start of a run only.
TOKEN = re.compile(r"(?<![\w@.+()%-])(?:[^\W0-9]|[.+()%-])*+[0-9@][\w@.+()%-]*+")
WORD_BEFORE = re.compile(r"(\w+)\W*\Z")
NOT_DIGIT = re.compile(r"[^0-9]+")
LETTER = re.compile(r"[^\W\d_]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the whole pattern from left to right, but going from one @ to the next, so that a long run
    without one is read once."""
    free, at = 0, text.find("@")
    while at >= 0:
        if at >= free:
            # characters of a name right before the @, not before what is already matched
            own = LOCAL_END.match(text[free:at][::-1]).end() if at - free < 64 else _name_length(text, free, at)
            found = DOMAIN.match(text, at + 1) if own else None
            if found:
                yield at - own, found.end()
                free = found.end()
            else:
                free = at + 1
        at = text.find("@", at + 1)


def _name_length(text: str, free: int, at: int) -> int:
    own, step = 0, 64
    while True:
        a = max(free, at - own - step)
        part = LOCAL_END.match(text[a:at - own][::-1]).end()
        own += part
        if part < at - own + part - a or a == free:
            return own
        step *= 2


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for run in NUMBERS.finditer(text):
        parts = run.group().split(".")
        start = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield start, end
            start = end + 1


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """(start, end) in code points of what each kind's pattern finds and its test accepts."""
    cards, phones = [], []
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37 and 16 <= len(digits := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            cards.append(m.span())
    if "+" in text:
        phones = [m.span() for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return [list(_emails(text)), list(_ips(text)) if "." in text else [], cards, phones]


def tokens_of(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens with a digit or an @, without punctuation at their ends."""
    out = []
    for m in TOKEN.finditer(text):
        token = m.group()
        start = m.start() + len(token) - len(token.lstrip(".)%-_"))
        end = m.end() - (len(token) - len(token.rstrip(".,(%+-_")))
        out.append((start, end))
    return out


#: Features by name; the word before a token is hashed to WORDS of them.
FORMS = ("any", "letters", "mail", "odd mail", "plus", "brackets", "dash", "four parts", "four large parts", "dots", "checked", "unchecked", "percent",
         *(f"digits {n}" for n in ("0", "1", "2", "3", "4", "5", "7", "8", "12", "16", "20")), *(f"before {n}" for n in range(9)), *(f"after {n}" for n in range(9)))
FORM = {name: i for i, name in enumerate(FORMS)}
WORDS = 128
FEATURES = len(FORMS) + WORDS
#: Features a token has at most; the rest of its row holds FEATURES, whose weight is 0.
WIDTH = 14
DIGIT_STEPS = ((20, "20"), (16, "16"), (12, "12"), (8, "8"), (7, "7"), (5, "5"), (4, "4"), (3, "3"), (2, "2"), (1, "1"), (0, "0"))
#: What stays of a token whose form is hidden.
HIDDEN = np.array([FORM["any"]] + [FEATURES] * (WIDTH - 1))


def form(token: str) -> tuple[list[int], int, str | None]:
    """(features, coarse class for its neighbours, what its like share)."""
    digits = NOT_DIGIT.sub("", token)
    n, out = len(digits), [FORM["any"]]
    out.append(FORM["digits " + next(name for least, name in DIGIT_STEPS if n >= least)])
    lettered = LETTER.search(token) is not None
    if lettered:
        out.append(FORM["letters"])
    if "@" in token:
        name, _, domain = token.partition("@")
        out.append(FORM["mail" if name and DOMAIN.fullmatch(domain) else "odd mail"])
    for mark, feature in (("+", "plus"), ("(", "brackets"), ("-", "dash"), ("%", "percent")):
        if mark in token:
            out.append(FORM[feature])
    parts = token.split(".") if "." in token and not lettered else ()
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        out.append(FORM["four parts" if all(len(p) <= 3 and int(p) <= 255 for p in parts) else "four large parts"])
    elif parts:
        out.append(FORM["dots"])
    if 16 <= n <= 19 and not lettered:
        out.append(FORM["checked" if luhn(digits) else "unchecked"])
    coarse = 1 if "@" in token else 2 if lettered else 3 if token.startswith("+") else 4 if "(" in token else 5 if parts else 6 if n >= 16 else 7 if n >= 7 else 8
    key = token.lower() if "@" in token else digits[-7:] if n >= 7 else None
    return out, coarse, key


class Graph:
    """Tokens of some documents with their features, the edges between adjacent ones and skip edges."""

    def __init__(self):
        self.features, self.adjacent, self.alike, self.spans, self.docs = [], [], [], [], []

    def __len__(self):
        return len(self.spans)

    def add(self, doc: int, text: str) -> None:
        spans, last, first = tokens_of(text), {}, len(self.spans)
        forms = [form(text[a:b]) for a, b in spans]
        for i, ((start, end), (features, _, key)) in enumerate(zip(spans, forms)):
            near = i > 0 and start - spans[i - 1][1] <= 4 and not any(c.isalnum() for c in text[spans[i - 1][1]:start])
            word = WORD_BEFORE.search(text[max(0, start - 24):start])
            own = [*features, FORM[f"before {forms[i - 1][1] if near else 0}"]]
            own.append(len(FORMS) + zlib.crc32((word.group(1).lower() if word else "").encode()) % WORDS)
            if near:
                self.adjacent.append(first + i - 1)
                self.features[-1].append(FORM[f"after {forms[i][1]}"])
            elif i:
                self.features[-1].append(FORM["after 0"])
            self.features.append(own)
            self.spans.append((start, end))
            self.docs.append(doc)
            if key is not None:
                if key in last:
                    self.alike.append((last[key], first + i))
                last[key] = first + i
        if spans:
            self.features[-1].append(FORM["after 0"])

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features, (left, right) of adjacent tokens, (earlier, later) of skip edges)."""
        features = np.full((len(self), WIDTH), FEATURES, np.int32)
        for row, own in zip(features, self.features):
            row[:len(own)] = own
        left = np.array(self.adjacent, np.int64)
        return features, np.stack([left, left + 1], axis=1), np.array(self.alike, np.int64).reshape(-1, 2)


@dataclass
class Field:
    """Weights: forms (feature, label), adjacent (left label, right label) and skip (kind, kind). A
    token whose neighbour is fixed as outside has that neighbour's share in its own potential."""
    forms: np.ndarray
    adjacent: np.ndarray
    skip: np.ndarray

    def own(self, features: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        potential = np.concatenate([self.forms, np.zeros((1, LABELS))])[features].sum(axis=1)
        left_open, right_open = np.ones(len(features), bool), np.ones(len(features), bool)
        left_open[pairs[:, 1]] = False
        right_open[pairs[:, 0]] = False
        return potential + left_open[:, None] * self.adjacent[0] + right_open[:, None] * self.adjacent[:, 0]

    def marginals(self, features: np.ndarray, pairs: np.ndarray, alike: np.ndarray) -> np.ndarray:
        """Probabilities (token, label) by PASSES rounds of sum-product messages along all edges at once."""
        own = self.own(features, pairs)
        skip = self.skip[np.ix_(KIND_OF, KIND_OF)]
        edges = [(pairs[:, 0], pairs[:, 1], self.adjacent), (pairs[:, 1], pairs[:, 0], self.adjacent.T), (alike[:, 0], alike[:, 1], skip), (alike[:, 1], alike[:, 0], skip)]
        factors = [np.exp(w - w.max()) for _, _, w in edges]
        messages = [np.zeros((len(a), LABELS)) for a, _, _ in edges]
        back = (1, 0, 3, 2)

        def beliefs():
            total = own.copy()
            for (_, to, _), message in zip(edges, messages):
                total[to] += message  # a token has one edge of each sort at most
            return total
        for _ in range(PASSES if len(pairs) or len(alike) else 0):
            total, new = beliefs(), []
            for k, (source, _, _) in enumerate(edges):
                known = total[source] - messages[back[k]]
                known = np.log(np.maximum(np.exp(known - known.max(axis=1, keepdims=True)) @ factors[k], 1e-300)) if len(source) else known
                new.append(known - known.max(axis=1, keepdims=True) if len(source) else known)
            messages = [(m + n) / 2 for m, n in zip(messages, new)]  # damped, as loops could swing
        total = beliefs()
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)


def labels_of(spans: list[tuple[int, int]], found: list[list[tuple[int, int]]]) -> list[int]:
    """Each token's label by the base spans that it overlaps; the first kind wins."""
    out = [0] * len(spans)
    for kind in reversed(range(len(KINDS))):
        i = 0
        for start, end in found[kind]:
            while i < len(spans) and spans[i][1] <= start:
                i += 1
            k = i
            while k < len(spans) and spans[k][0] < end:
                out[k] = 1 + 2 * kind + (k > i)
                k += 1
    return out


def fit(features: np.ndarray, pairs: np.ndarray, alike: np.ndarray, labels: np.ndarray, steps: int = 400, penalty: float = 1e-4) -> Field:
    """Weights of the greatest penalised pseudo-likelihood, by accelerated gradient steps."""
    n, kinds = len(labels), len(KINDS) + 1
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)  # labels of the neighbours; outside where they are fixed
    left[pairs[:, 1]], right[pairs[:, 0]] = labels[pairs[:, 0]], labels[pairs[:, 1]]
    near = np.zeros((n, kinds))  # how many tokens of each kind a token is tied to
    np.add.at(near, alike[:, 0], np.eye(kinds)[KIND_OF[labels[alike[:, 1]]]])
    np.add.at(near, alike[:, 1], np.eye(kinds)[KIND_OF[labels[alike[:, 0]]]])
    tied = np.flatnonzero(near.any(axis=1))
    rows = np.concatenate([features, np.tile(HIDDEN, (len(tied), 1))])
    near, wanted = np.concatenate([near, near[tied]]), np.concatenate([labels, labels[tied]])
    target, of_kind = np.eye(LABELS)[wanted], np.eye(kinds)[KIND_OF]
    total = len(rows)
    flat, one = rows.ravel(), np.repeat(np.arange(total), WIDTH)
    shapes = ((FEATURES + 1, LABELS), (LABELS, LABELS), (kinds, kinds))
    weights, ahead = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    for step in range(steps if total else 0):
        forms, adjacent, skip = ahead
        scores = forms[rows].sum(axis=1) + near @ ((skip + skip.T) / 2) @ of_kind.T
        scores[:n] += adjacent[left] + adjacent[:, right].T
        odds = np.exp(scores - scores.max(axis=1, keepdims=True))
        off = (odds / odds.sum(axis=1, keepdims=True) - target) / total
        by_form = np.stack([np.bincount(flat, off[one, y], FEATURES + 1) for y in range(LABELS)], axis=1)
        by_form[FEATURES] = 0
        by_pair = np.zeros((LABELS, LABELS))
        np.add.at(by_pair, left, off[:n])
        np.add.at(by_pair.T, right, off[:n])
        by_skip = near.T @ (off @ of_kind)
        for k, slope in enumerate((by_form, by_pair, (by_skip + by_skip.T) / 2)):
            moved = ahead[k] - STEP * (slope + penalty * ahead[k])
            ahead[k] = moved + step / (step + 3) * (moved - weights[k])
            weights[k] = moved
    return Field(weights[0][:FEATURES], weights[1], (weights[2] + weights[2].T) / 2)


def train(docs: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES, most_tokens: int = SAMPLE_TOKENS) -> Field:
    """The field fitted to the base spans of a bounded sample of docs(doc_id, text)."""
    small_batches(docs.sparkSession, 200)
    able = docs.where((F.octet_length("text") <= most_bytes) & F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("doc_id", "text").alias("pick"))
    picks = able.select("pick").distinct().orderBy("pick").limit(sample).collect()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                graph = Graph()
                graph.add(0, text)
                features, pairs, alike = graph.arrays()
                labels = labels_of(graph.spans, base_spans(text))
                found.append([x.astype("<i4").tobytes() for x in (features, pairs, alike, np.array(labels))])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in zip(*found))] if found else [batch.column(0), *(pa.array([], pa.binary()) for _ in range(4))], names=["pick", "features", "pairs", "alike", "labels"])
    rows = []
    if picks:
        chosen = able.where(F.col("pick") <= picks[-1]["pick"]).select("pick", "text").mapInArrow(run, "pick long, features binary, pairs binary, alike binary, labels binary")
        rows = sorted(chosen.dropDuplicates(["pick"]).collect())  # at most `sample` rows
    small_batches(docs.sparkSession)
    parts, first = ([], [], [], []), 0
    for r in rows:
        labels = np.frombuffer(r["labels"], "<i4")
        if first + len(labels) > most_tokens:
            continue
        for part, name, width in zip(parts, ("features", "pairs", "alike"), (WIDTH, 2, 2)):
            part.append(np.frombuffer(r[name], "<i4").reshape(-1, width).astype(np.int64) + (first if name != "features" else 0))
        parts[3].append(labels)
        first += len(labels)
    joined = [np.concatenate([np.zeros((0, w), np.int64), *part]) for part, w in zip(parts, (WIDTH, 2, 2))]
    return fit(*joined, np.concatenate([np.zeros(0, np.int64), *parts[3]]).astype(np.int64))


def added_spans(graph: Graph, field: Field, certain: float) -> dict[int, list[tuple[int, int, int]]]:
    """(kind, start, end) by document of the runs of tokens that the field is certain of."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    features, pairs, alike = graph.arrays()
    odds = field.marginals(features, pairs, alike)
    sums = odds[:, 1::2] + odds[:, 2::2]
    kinds, joined = sums.argmax(axis=1), set(pairs[:, 1].tolist())
    begins = odds[:, 1::2][np.arange(len(kinds)), kinds] >= odds[:, 2::2][np.arange(len(kinds)), kinds]
    last = -2
    for i in np.flatnonzero(sums.max(axis=1) >= certain).tolist():
        kind, (start, end), own = int(kinds[i]), graph.spans[i], out.setdefault(graph.docs[i], [])
        if last == i - 1 and i in joined and own and own[-1][0] == kind and not begins[i]:
            own[-1] = (kind, own[-1][1], end)
        else:
            own.append((kind, start, end))
        last = i
    return out


def with_added(found: list[list[tuple[int, int]]], added: list[tuple[int, int, int]]) -> list[list[tuple[int, int]]]:
    """Base spans and those of the added ones that touch none of them."""
    taken = sorted(span for spans in found for span in spans)
    starts, reach = np.array([a for a, _ in taken], np.int64), np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else np.array([], np.int64)
    out = [list(spans) for spans in found]
    for kind, start, end in added:
        before = int(np.searchsorted(starts, end)) - 1  # the last base span that starts before the end
        if before < 0 or reach[before] <= start:
            out[kind].append((start, end))
    return [sorted(spans) for spans in out]


def listed(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, own in zip(KINDS, spans) for a, b in own)


def personal_data(docs: DataFrame, field: Field | None = None, certain: float = 0.95) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): the
    numbers and the digest of the base spans, and all spans, with those that the field adds."""
    field = field or train(docs)
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    nothing = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held, graph = [nothing] * batch.num_rows, {}, Graph()

            def settle():
                added = added_spans(graph, field, certain) if len(graph) else {}
                for i, found in held.items():
                    spans = with_added(found, added.get(i, ()))
                    n = [len(own) for own in found]
                    rows[i] = (*n, hashlib.sha256(listed(found).encode()).hexdigest(), listed(spans), sum(map(len, spans)) - sum(n))
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                if text and HINT.search(text):
                    held[i] = base_spans(text)
                    graph.add(i, text)
                    if len(graph) >= TOKENS_AT_ONCE:
                        settle()
                        held, graph = {}, Graph()
            settle()
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()])] if rows else []
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])
    ddl = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)
