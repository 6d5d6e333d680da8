"""Benchmark decontamination by a generalised suffix automaton of the test items' words.

All items go into one automaton. A document's words are streamed through it: the state and the
longest matching length say, at each word, which item passages end there. A window is `window`
consecutive words of an item, or a whole shorter item. Words of occurring windows are hits; spans
of hits are removed, and documents with too large a share of hits go altogether.

Words are maximal runs of bytes that are ASCII letters or digits or not ASCII, A-Z read as a-z. Runs
of words whose neighbouring pairs occur in no item are skipped by their hashes; only what is left is
streamed, by its exact words.

Defined cases. Null and empty texts have no words and no hits. Items without words or with a null
text have no window. An item with a null id can be hit but isn't counted. Repeated items and rows
are each judged alike. Columns of documents other than doc_id and text keep their values."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_back
from .hashing import ALNUM_OR_HIGH, U, mix, text_pieces, words

#: Words of one automaton. More items are cut into several, used one after the other.
SHARD_WORDS = 100_000
#: Items are collected and sent to all tasks; more text than this is refused.
MOST_BENCHMARK_BYTES = 64 << 20


ALNUM_OR_HIGH_RE = re.compile(rb"[0-9a-z\x80-\xff]+")


def word_list(text: str | None) -> list[bytes]:
    return ALNUM_OR_HIGH_RE.findall((text or "").encode().lower())


class Automaton:
    """Generalised suffix automaton over word numbers."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocabulary: dict[bytes, int] = {}
        numbered = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for item, ws in items if ws]
        for _, seq in numbered:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        #: state of a window-long passage -> ids of the items it is in
        self.windows: dict[int, set] = {}
        ends: dict[int, list] = {}
        for item, seq in numbered:
            state = length = 0
            for i, w in enumerate(seq):
                state, length = self.step(state, length, w)
                if i + 1 >= window:
                    self.windows.setdefault(self.cut(state), set()).add(item)
            if len(seq) < window:
                ends.setdefault(state, []).append((len(seq), item))
        #: state -> whole shorter items that are suffixes of what leads there
        self.short: dict[int, list] = {}
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__) if ends else ():
            own = ends.get(state, []) + self.short.get(self.link[state], [])
            if own:
                self.short[state] = own
        self.least = min([min(len(s), window) for _, s in numbered], default=0)

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            there = self.next[last][w]
            return there if self.length[there] == self.length[last] + 1 else self._split(last, w, there)
        own = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and w not in self.next[last]:
            self.next[last][w] = own
            last = self.link[last]
        if last >= 0:
            there = self.next[last][w]
            self.link[own] = there if self.length[there] == self.length[last] + 1 else self._split(last, w, there)
        return own

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, at: int, w: int, there: int) -> int:
        """A state of its own for the shorter passages of `there`, which end in w after `at`."""
        own = self._state(self.length[at] + 1, dict(self.next[there]), self.link[there])
        self.link[there] = own
        while at >= 0 and self.next[at].get(w) == there:
            self.next[at][w] = own
            at = self.link[at]
        return own

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """The state and length of the longest item passage that ends with w."""
        while state and w not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        there = self.next[state].get(w)
        return (0, 0) if there is None else (there, length + 1)

    def cut(self, state: int) -> int:
        """The state that holds the last `window` words of what leads to `state`."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """(first word, end word) of the occurring windows, by rising end, and the items they are of."""
        spans, items, state, length = [], set(), 0, 0
        for i, w in enumerate(found):
            state, length = self.step(state, length, self.vocabulary.get(w, -1))
            if length >= self.window:
                spans.append((i + 1 - self.window, i + 1))
                items |= self.windows[self.cut(state)]
            for k, item in self.short.get(state, ()):
                if k <= length:
                    spans.append((i + 1 - k, i + 1))
                    items.add(item)
        return spans, items


class Screen:
    """Hashes of the neighbouring word pairs of the items (of the words, if an item has one word)."""

    def __init__(self, items: list[tuple[object, list[bytes]]], least: int):
        self.least, parts = least, []
        for _, ws in items:
            if ws:
                data = np.frombuffer(b" ".join(ws), np.uint8)
                hashes = words(data, np.array([0, len(data)]), ALNUM_OR_HIGH)[0]
                parts.append(self.grams(hashes))
        self.known = np.unique(np.concatenate(parts)) if parts else np.zeros(0, U)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.known & U(0xFFFFF)).astype(np.int64)] = True

    def grams(self, hashes: np.ndarray) -> np.ndarray:
        return hashes if self.least < 2 else mix(hashes[:-1] + mix(hashes[1:]))

    def runs(self, hashes: np.ndarray, per_row: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, first word, end word) of the runs that can hold a window."""
        grams = self.grams(hashes)
        maybe = self.bits[(grams & U(0xFFFFF)).astype(np.int64)]
        at = np.flatnonzero(maybe)
        maybe[at] = self.known[np.minimum(np.searchsorted(self.known, grams[at]), len(self.known) - 1)] == grams[at]
        wide = 1 if self.least < 2 else 2
        if wide == 2:
            over = per_row[1:-1] - 1  # pairs across two rows
            maybe[over[(over >= 0) & (over < len(maybe))]] = False
        edge = np.flatnonzero(np.diff(np.concatenate([[0], maybe.view(np.int8), [0]])))
        first, end = edge[::2], edge[1::2] + wide - 1
        if wide == 1:  # a run ends with its row
            cuts = [(a, b) for x, y in zip(first, end) for a, b in _cut(x, y, per_row)]
            first, end = np.array([a for a, _ in cuts], np.int64), np.array([b for _, b in cuts], np.int64)
        ok = end - first >= self.least
        row = np.searchsorted(per_row, first[ok], side="right") - 1
        return list(zip(row.tolist(), first[ok].tolist(), end[ok].tolist()))


def _cut(first: int, end: int, per_row: np.ndarray) -> list[tuple[int, int]]:
    inner = per_row[(per_row > first) & (per_row < end)]
    edges = [first, *np.unique(inner).tolist(), end]
    return list(zip(edges[:-1], edges[1:]))


def build(benchmark: DataFrame, window: int) -> list[bytes]:
    """Pickled (automaton, screen) pairs of benchmark(item_id, text), each of about SHARD_WORDS words."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_BENCHMARK_BYTES:
        raise ValueError(f"the test items have {size} bytes, more than {MOST_BENCHMARK_BYTES}; check them in parts")
    shards, shard, held = [], [], 0
    rows = ((r[0], word_list(r[1])) for r in benchmark.select("item_id", "text").toLocalIterator())
    for item in sorted(rows, key=lambda r: str(r[0])):
        shard.append(item)
        held += len(item[1])
        if held >= SHARD_WORDS:
            shards.append(shard)
            shard, held = [], 0
    out = []
    for items in [*shards, shard]:
        automaton = Automaton(items, window)
        if automaton.least:
            out.append(pickle.dumps((automaton, Screen(items, automaton.least)), protocol=5))
    return out


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def find_windows(column: pa.Array, blobs: list[bytes]) -> Iterator[tuple[int, np.ndarray, dict]]:
    """By piece of the column: (first row, words by row, {row: (merged word spans, item ids, byte spans)})."""
    loaded = pickle.loads(blobs[0]) if len(blobs) == 1 else None
    for lo, _, data, offsets in text_pieces(column):
        hashes, starts, ends, per_row = words(data, offsets, ALNUM_OR_HIGH)
        found: dict[int, tuple[list, set]] = {}
        for blob in blobs if len(hashes) else ():
            automaton, screen = loaded or pickle.loads(blob)
            for row, first, end in screen.runs(hashes, per_row):
                text = data[starts[first]: ends[end - 1]].tobytes().lower()
                spans, items = automaton.scan(ALNUM_OR_HIGH_RE.findall(text))
                if spans:
                    own = found.setdefault(row, ([], set()))
                    own[0].extend((a + first - per_row[row], b + first - per_row[row]) for a, b in spans)
                    own[1].update(items)
        hits = {}
        for row, (spans, items) in found.items():
            joined = merged(spans)
            base = per_row[row]
            hits[row] = joined, items - {None}, [(int(starts[base + a] - offsets[row]), int(ends[base + b - 1] - offsets[row])) for a, b in joined]
        yield lo, np.diff(per_row), hits


FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<first:long,end:long>>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, passed: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs(text, *passed) -> (*passed, n_words, n_hit, items, spans): the words that test items'
    windows hit, the items' ids as strings, sorted, and the spans of hit words, by word number."""
    shared = docs.sparkSession.sparkContext.broadcast(build(benchmark, window))
    kinds = {f.name: f.dataType.simpleString() for f in docs.select(*passed).schema}
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for lo, n_words, hits in find_windows(rows.column(len(passed)), shared.value):
                n = len(n_words)
                empty = ([], set(), [])
                of = [hits.get(r, empty) for r in range(n)]
                yield pa.RecordBatch.from_arrays([
                    *(rows.column(i).slice(lo, n) for i in range(len(passed))), pa.array(n_words),
                    pa.array([sum(b - a for a, b in x[0]) for x in of], pa.int64()), pa.array([sorted(map(str, x[1])) for x in of], pa.list_(pa.string())),
                    pa.array([[{"first": int(a), "end": int(b)} for a, b in x[0]] for x in of], span)], names=[*passed, "n_words", "n_hit", "items", "spans"])

    schema = ", ".join([*(f"`{k}` {v}" for k, v in kinds.items()), FOUND])
    return docs.select(*passed, "text").mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, most_coverage: float = 0.5) -> DataFrame:
    """docs with the hit spans cut out of `text`, from the first word's start to the last word's end,
    and without the rows of whose words more than `most_coverage` are hit. Other rows stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(build(benchmark, window))
    place = docs.columns.index("text")

    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts, keep, changed = rows.column(place), np.ones(rows.num_rows, bool), {}
            for lo, n_words, hits in find_windows(texts, shared.value):
                for r, (joined, _, cuts) in hits.items():
                    keep[lo + r] = sum(b - a for a, b in joined) <= most_coverage * n_words[r]
                    own = texts[lo + r].as_py().encode()
                    changed[lo + r] = b"".join(own[a:b] for a, b in zip([0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(own)])).decode()
            if changed:
                texts = pa.array([changed.get(i, t) for i, t in enumerate(texts.to_pylist())], rows.schema.field(place).type)
            yield rows.set_column(place, rows.schema.field(place), texts).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)

