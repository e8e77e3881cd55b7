"""Where lineage ends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """End the lineage in the cluster's shared checkpoint folder (a local one only if none is named): rows are
    computed once and written by columns, where a checkpoint computes them twice and writes whole rows.  Their
    size is known from then on, so joins with few rows are broadcast."""
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table that may be broadcast, where the number of rows grows with the input.
FEW_ROWS = 100_000


def sized(rows: DataFrame, n_rows: int | None = None) -> DataFrame:
    """rows as one side of a join, the other side of which is as large: a table of more than FEW_ROWS (``n_rows``; if not
    given, rows is a written table and its files' footers say) is joined by a shuffle.  Spark knows the size of the files
    alone, and ids and names take up to thirty times as much in the driver's memory as in them."""
    return rows.hint("merge") if (rows.count() if n_rows is None else n_rows) > FEW_ROWS else rows


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or "/tmp/ledgerloom-checkpoints").rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/{what}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"
