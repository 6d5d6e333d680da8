"""A bitmap of bounded size that lets a scan pass over rows whose key is surely not wanted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U, mix

#: 16 MB; with more keys than that has room for, more rows pass, and the join behind still decides.
MOST_BITS = 1 << 27
WORDS = pa.schema([("word", pa.int64()), ("bits", pa.int64())])


class Prefilter:
    def __init__(self, words: np.ndarray):
        self.words = words

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        at = _places(keys, len(self.words) * 64)
        return (self.words[at >> 6] >> (at & 63).astype(U)) & U(1) == 1


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys.view(U)) & U(bits - 1)).astype(np.int64)


def prefilter(keys: DataFrame) -> Prefilter:
    """keys: one long column. At most MOST_BITS / 64 words reach the driver, however many keys."""
    bits = min(MOST_BITS, max(1 << 12, 1 << int(keys.count() * 16).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            at = _places(rows.column(0).to_numpy(zero_copy_only=False), bits)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((U(1) << (at & 63).astype(U)).view(np.int64))], schema=WORDS)

    found = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, U)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(U)
    return Prefilter(words)


def narrowed(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """rows whose long `key` is among wanted(key), and perhaps some more."""
    shared = rows.sparkSession.sparkContext.broadcast(prefilter(wanted.select(key)))
    place = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.may_have(batch.column(place).to_numpy(zero_copy_only=False))))

    return rows.where(F.col(key).isNotNull()).mapInArrow(run, rows.schema)
