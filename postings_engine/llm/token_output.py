"""Token-ID output: documents as runs of token ids in ORC files, in ascending order of doc_id.

Rows are range-partitioned and sorted by doc_id, so that each file holds a range of ids and reads
that name an id are pruned by file and stripe statistics, row indexes and Bloom filters. Integers
are run-length encoded by ORC; stripes are independent, so readers share out the stripes of a file.
A row carries the number of its part, its first token's place in that part and its length; the place in the
whole corpus is that plus the totals of the parts before it.

Defined cases. A null text is empty: its run is the end id alone. Rows with equal doc_id stand in
order of a hash of their text; rows with a null doc_id stand first. An empty table gives no rows. Only doc_id
and text are written."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import Scratch, given_back
from .hashing import text_pieces
from .pretokens import shared_tokenizer

#: Bytes of text whose pieces are looked up at once.
PIECE = 1 << 18
FORMAT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()),
                       T.StructField("first", T.LongType()), T.StructField("n_ids", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, parts: int | None = None, bloom_fpp: float = 0.01) -> None:
    """Writes docs(doc_id, text) in the format above to `path`. tokenizer: path of the file, the same
    on every executor."""
    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, place, first = shared_tokenizer(tokenizer), 0, 0
        for rows in batches:
            for lo, hi, data, offsets in text_pieces(rows.column(1), PIECE):
                ids, at = encoder.encode(data, offsets, end_id)
                n = hi - lo
                runs = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([rows.column(0).slice(lo, n), rows.column(2).slice(lo, n), pa.array(place + np.arange(n)), pa.array(first + at[:-1]), pa.array(np.diff(at), pa.int32()), runs], names=FORMAT.names)
                place, first = place + n, first + int(at[-1])

    # a digest stands for the text, as samples of the keys go to the driver
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = docs.select("doc_id", "text")
    ranged = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    ordered = ranged.sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    (ordered.mapInArrow(run, FORMAT).write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", str(bloom_fpp))
     .option("orc.create.index", "true").option("compression", "zstd").orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, place, first, start, ids): the documents' ids from the files, with `start`, the
    number of ids of all documents before."""
    rows = spark.read.schema(FORMAT).orc(path)
    totals = rows.groupBy("part").agg(F.max(F.col("first") + F.col("n_ids")).alias("total"))
    # a row per file, and so a few bytes per GB of ids
    before = totals.select("part", F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", "part", "place", "first", (F.col("before") + F.col("first")).alias("start"), "ids")


def crc32_of_ids(rows: DataFrame, passed: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """(*passed, n_tokens, ids_crc32) of rows(ids, *passed)."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.select(*passed).schema}

    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids = rows.column(len(passed))
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(passed))), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], names=[*passed, "n_tokens", "ids_crc32"])

    schema = ", ".join([*(f"`{k}` {v}" for k, v in kinds.items()), "n_tokens long, ids_crc32 long"])
    return rows.select(*passed, "ids").mapInArrow(run, schema)


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes the files to the shared folder and reads them back: (doc_id, start, n_tokens, ids_crc32)."""
    scratch = Scratch(docs.sparkSession, "tokens")
    path = scratch.new_path("ids")
    write_tokens(docs, path, tokenizer, end_id)
    return crc32_of_ids(read_tokens(docs.sparkSession, path))
