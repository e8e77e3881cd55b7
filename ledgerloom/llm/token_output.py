"""Token ids as Parquet list columns, in ascending document order.

``write_tokens`` tokenizes, range-partitions by document id, sorts, and writes one file for each
partition.  The ids column is dictionary-encoded (a vocabulary of 2^16 fits one dictionary page);
the integer metadata columns are written in format v2, where values that make no good dictionary
take delta encoding.  Row groups and pages are bounded by bytes and rows, and the writer adds column
and offset indexes for each page, so that ``read_tokens`` with a range of ids or only metadata
columns reads just those pages.

Nulls: a null text is empty and gets the end id alone; rows with a null id sort first.  Repeated ids
are kept, each with its own row (order between them is by text).  Empty tables give no row.  Columns
besides id and text are ignored.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytelevel import encoder
from .common import id_and_text

STARTS = "part int, part_start long"
STORED = "doc_id long, part int, local_start long, n_tokens int, ids array<int>"
#: Texts tokenized before a batch of ids is handed on; bounds a worker's memory.
ROWS_A_BATCH = 256


def _tokenize(path: str, end_id: int):
    def run(batches):
        enc, part, start = encoder(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_A_BATCH):
                batch = whole.slice(at, ROWS_A_BATCH)
                chunks, sizes = [], []
                for ids in enc.encode(batch.column(1).to_pylist()):
                    own = np.empty(len(ids) + 1, np.int32)
                    own[:-1], own[-1] = ids, end_id
                    chunks.append(own)
                    sizes.append(len(own))
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.concatenate(chunks))
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.full(len(sizes), part, np.int32)),
                        pa.array(start + ends - sizes),
                        pa.array(np.array(sizes, np.int32)),
                        lists,
                    ],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    return run


def write_tokens(
    docs: DataFrame,
    out: str,
    tokenizer: str,
    end_id: int = 0,
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 1 << 20,
    page_rows: int = 4096,
    compression: str = "zstd",
    zstd_level: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write the ids of all documents to folder ``out``, file order and row order ascending by id, and
    beside them (folder ``_starts``, which a reader of the ids does not see) where each file begins."""
    ordered = id_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(_tokenize(tokenizer, end_id), STORED)
        .write.option("compression", compression)
        .option("parquet.compression.codec.zstd.level", zstd_level)
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.dictionary.page.size", 1 << 20)
        .parquet(out)
    )
    spark = docs.sparkSession
    # a row for each file, from the counts' own pages: as many as the writing job had tasks
    totals = sorted((r.part, r.n) for r in spark.read.schema(STORED).parquet(out).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts = accumulate([0, *(n for _, n in totals)])
    spark.createDataFrame([(p, s) for (p, _), s in zip(totals, starts)], STARTS).coalesce(1).write.parquet(f"{out}/_starts")


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """The stored columns (``columns`` alone, if given) of documents low <= doc_id <= high, with
    ``start``, the number of ids of all documents before.  Row groups and pages outside the range
    are skipped, columns not asked for are not read."""
    stored = spark.read.schema(STORED).parquet(path)
    before = spark.read.schema(STARTS).parquet(f"{path}/_starts")
    rows = stored
    if low is not None:
        rows = rows.filter(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.filter(F.col("doc_id") <= high)
    columns = columns or ["doc_id", "start", "n_tokens", "ids"]
    rows = rows.select(*{c: 0 for c in [*columns, "part", "local_start"] if c != "start"})
    return rows.join(before, "part").withColumn("start", F.col("part_start") + F.col("local_start")).select(*columns)


def with_crc(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows of ``read_tokens``."""

    def run(batches):
        for b in batches:
            ids = b.column(3)
            flat = np.asarray(ids.flatten()).astype("<u4", copy=False)
            at = np.asarray(ids.offsets) - ids.offsets[0].as_py()
            crc = [zlib.crc32(flat[x:y]) for x, y in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    rows = rows.select("doc_id", F.col("start").cast("long"), F.col("n_tokens").cast("long"), "ids")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
