"""Language ID by prediction by partial matching over bytes.

Every language has a context tree of its training bytes, from contexts of `order` bytes down to
none. A byte's probability in the longest context that has seen it is its count over the context's
total plus distinct bytes; a context that has not seen it pays its escape (distinct over the same
sum) and the next shorter one is asked, down to a uniform byte. The trees' statistics are frozen
into tables of code lengths; a text's code length under a language is the sum over all its bytes,
and the shortest wins. Code lengths are counted in 1/UNIT bits as whole numbers, so that sums do not
depend on how rows are batched.

Defined cases. Null, empty and letterless texts are `und` with score 0. If equal code lengths tie,
the language first by name wins. Rows without a language are not learned from; without any labelled
row everything is `und`. The prediction reads the text column alone."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_back
from .hashing import text_pieces

UNIT = 1024
ORDER = 3
#: Bytes that stand before a text, so that its first bytes have contexts.
START = np.frombuffer(b"\n" * 8, np.uint8)
#: The fit reads about this many documents of each language, picked by a hash; the model's size
#: then does not grow with the table.
SAMPLE_PER_LANGUAGE = 4_000
GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("times", pa.int64())])
EMPTY = np.int64(-1)


class Lookup:
    """Open-addressing hash table from codes to row numbers, probed for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.mask = (1 << max(4, int(len(keys) * 4 - 1).bit_length())) - 1
        self.slots = np.full(self.mask + 1, EMPTY, np.int64)
        self.rows = np.zeros(self.mask + 1, np.int32)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.slots[at] == EMPTY
            self.slots[at[free]] = keys[todo[free]]  # of several keys for a slot, the last one stays
            placed = free & (self.slots[at] == keys[todo])
            self.rows[at[placed]] = todo[placed]
            todo, at = todo[~placed], (at[~placed] + 1) & self.mask

    def _home(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers; -1 for codes that are not there."""
        at = self._home(keys)
        there = self.slots[at]
        out = np.where(there == keys, self.rows[at], -1)
        todo = np.flatnonzero((there != keys) & (there != EMPTY))
        at = (at[todo] + 1) & self.mask
        while len(todo):
            there = self.slots[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.rows[at[hit]]
            more = ~hit & (there != EMPTY)
            todo, at = todo[more], (at[more] + 1) & self.mask
        return out


def codes(padded: np.ndarray, order: int) -> np.ndarray:
    """For each byte after the first `order` ones: it and the `order` bytes before it, as a number."""
    n = len(padded) - order
    out = np.zeros(n, np.int64)
    for k in range(order + 1):
        out = (out << 8) | padded[k: k + n]
    return out


@dataclass
class Model:
    """Frozen code lengths. levels[k]: (codes with k bytes of context, their lengths by language);
    escapes[k]: (contexts of k bytes, what their escape costs by language)."""
    languages: list[str]
    order: int
    levels: list[tuple[Lookup, np.ndarray]]
    escapes: list[tuple[Lookup, np.ndarray]]

    def lengths(self, padded: np.ndarray) -> np.ndarray:
        """Code lengths, languages by bytes, of all bytes after the first `order` ones."""
        own = codes(padded, self.order)
        return self._level(own, self.order)

    def _level(self, own: np.ndarray, k: int) -> np.ndarray:
        if k < 0:
            return np.full((len(self.languages), len(own)), 8 * UNIT, np.int32)
        lookup, table = self.levels[k]
        row = lookup.find(own & ((1 << 8 * (k + 1)) - 1))
        out = table[:, row]
        miss = np.flatnonzero(row < 0)
        if len(miss):
            contexts, cost = self.escapes[k]
            left = own[miss]
            at = contexts.find((left >> 8) & ((1 << 8 * k) - 1))
            out[:, miss] = np.where(at >= 0, cost[:, at], 0) + self._level(left, k - 1)
        return out


def build_model(grams: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Model:
    """grams: for each language, codes of order + 1 bytes and how often they occur."""
    languages = sorted(grams)
    counts = []  # by level and language: code -> times
    for k in range(order + 1):
        level = []
        for lang in languages:
            code, times = grams[lang]
            short, where = np.unique(code & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            level.append((short, np.bincount(where, weights=times, minlength=len(short)).astype(np.int64)))
        counts.append(level)
    model = Model(languages, order, [], [])
    for k in range(order + 1):
        keys = np.unique(np.concatenate([c for c, _ in counts[k]]))
        contexts = np.unique(keys >> 8)
        table, escape = np.empty((len(languages), len(keys)), np.int32), np.zeros((len(languages), len(contexts)), np.int32)
        lower = model._level(keys, k - 1)
        for i, (code, times) in enumerate(counts[k]):
            own, where = np.unique(code >> 8, return_inverse=True)
            total, kinds = np.bincount(where, weights=times, minlength=len(own)), np.bincount(where, minlength=len(own))
            cost = np.rint(-np.log2(kinds / (total + kinds)) * UNIT).astype(np.int32)
            escape[i, np.searchsorted(contexts, own)] = cost
            table[i] = escape[i, np.searchsorted(contexts, keys >> 8)] + lower[i]
            table[i, np.searchsorted(keys, code)] = np.rint(-np.log2(times / (total + kinds)[where]) * UNIT)
        model.levels.append((Lookup(keys), table))
        model.escapes.append((Lookup(contexts), escape))
    return model


def count_grams(labelled: DataFrame, order: int) -> DataFrame:
    """labelled(lang, text) -> (lang, gram, times) over whole texts."""
    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            langs = rows.column(0).to_pylist()
            for lo, _, data, offsets in text_pieces(rows.column(1)):
                parts: dict[str, list[np.ndarray]] = {}
                for r in range(len(offsets) - 1):
                    own = data[offsets[r]: offsets[r + 1]]
                    if len(own):
                        parts.setdefault(langs[lo + r], []).append(codes(np.concatenate([START[:order], own]), order))
                for lang, found in parts.items():
                    gram, times = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(times)], schema=GRAMS)
    return labelled.select("lang", "text").mapInArrow(run, "lang string, gram long, times long").groupBy("lang", "gram").agg(F.sum("times").alias("times"))


def fit(labelled: DataFrame, order: int = ORDER, per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """labelled(lang, text, pick): pick is a long that spreads rows evenly, such as a hash of the id.
    Of each language about `per_language` rows are read, or all if it has fewer. The counts that
    reach the driver are bounded by that sample. None if there is no labelled row."""
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    # a row for each language, of which the model holds a whole tree
    rates = labelled.groupBy("lang").agg((F.least(F.lit(1.0), F.lit(float(per_language)) / F.count("*")) * 2**31).cast("long").alias("below"))
    picked = labelled.join(F.broadcast(rates), "lang").where(F.pmod("pick", F.lit(2**31)) < F.col("below"))
    counts = count_grams(picked, order).toPandas()
    grams = {lang: (g.gram.to_numpy(np.int64), g.times.to_numpy(np.int64)) for lang, g in counts.groupby("lang")}
    return build_model(grams, order) if grams else None


def has_letter(texts: list[str | None]) -> np.ndarray:
    return np.array([t is not None and (any(map(str.isalpha, t[:64])) or any(map(str.isalpha, t))) for t in texts], bool)


def predict(docs: DataFrame, model: Model | None, passed: tuple[str, ...] = ()) -> DataFrame:
    """docs(text, *passed) -> (*passed, lang_pred, score, bits_per_byte). score: the winner's share of
    the posterior under equal priors, 2^-length over the sum of 2^-length."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.select(*passed).schema}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            own = [rows.column(i) for i in range(len(passed))]
            lang, score, bits = judge(shared.value, rows.column(len(passed)))
            yield pa.RecordBatch.from_arrays([*own, pa.array(lang, pa.string()), pa.array(score), pa.array(bits)], names=[*passed, "lang_pred", "score", "bits_per_byte"])

    schema = ", ".join([*(f"`{k}` {v}" for k, v in kinds.items()), "lang_pred string, score double, bits_per_byte double"])
    return docs.select(*passed, "text").mapInArrow(run, schema)


def judge(model: Model | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, bits per byte) of each text."""
    n = len(texts)
    lang, score, bits = np.full(n, "und", object), np.zeros(n), np.zeros(n)
    for lo, hi, data, offsets in text_pieces(texts) if model else ():
        sums, sizes = code_lengths(model, data, offsets), np.diff(offsets)
        best, low = sums.argmin(axis=0), sums.min(axis=0)
        share = 1 / np.exp2(-np.minimum((sums - low) / UNIT, 1000)).sum(axis=0)
        ok = np.flatnonzero((sizes > 0) & has_letter(texts.slice(lo, hi - lo).to_pylist()))
        lang[lo + ok] = np.array(model.languages, object)[best[ok]]
        score[lo + ok], bits[lo + ok] = share[ok], low[ok] / UNIT / sizes[ok]
    return lang, score, bits


def keep_recognised(docs: DataFrame, labelled: DataFrame, least_score: float = 0.5, most_bits: float = 8.0, order: int = ORDER, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """docs without the rows that are `und`, whose best language has a score below `least_score`, or
    whose code is longer than `most_bits` for a byte, which is what a model without knowledge needs.
    Without any labelled row nothing can be judged, and all rows stay."""
    model = fit(labelled, order, per_language)
    if model is None:
        return docs
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lang, score, bits = judge(shared.value, rows.column(place))
            yield rows.filter(pa.array((lang != "und") & (score >= least_score) & (bits <= most_bits)))

    return docs.mapInArrow(run, docs.schema)


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray, piece: int = 1 << 18) -> np.ndarray:
    """Whole code lengths, languages by rows. Each row starts in the start context."""
    k, rows = model.order, len(offsets) - 1
    sums = np.zeros((len(model.languages), rows), np.int64)
    gap = np.arange(rows) * k
    padded = np.full(len(data) + k * rows, START[0], np.uint8)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    place = np.arange(len(data)) + gap[row] + k
    padded[place] = data
    for lo in range(0, len(data), piece):
        at = place[lo: lo + piece]
        cost = model.lengths(padded[at[0] - k: at[-1] + 1])[:, at - at[0]]
        of = row[lo: lo + piece]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        np.add.at(sums, (slice(None), of[first]), np.add.reduceat(cost, first, axis=1, dtype=np.int64))
    return sums


def language_id(docs: DataFrame, labelled: DataFrame, passed: tuple[str, ...] = ("doc_id",), order: int = ORDER, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Fits on labelled(lang, text, pick) and predicts every row of docs by its text alone."""
    return predict(docs, fit(labelled, order, per_language), passed)
