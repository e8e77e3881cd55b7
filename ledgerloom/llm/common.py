"""What the training-data operators share: table reading, scratch space, text helpers."""

from __future__ import annotations

import pickle
import re
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local session (tests) may do without a named one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "/tmp/ledgerloom-shared"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read back, and the folder, for ``dropped``."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends, lost executors lose nothing."""
    return written(df, what)[0]


@contextmanager
def temporary(df: DataFrame, what: str):
    """df staged as long as the block runs; nothing lazy may outlive it."""
    held, path = written(df, what)
    try:
        yield held
    finally:
        dropped(df.sparkSession, path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that no later read needs."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def bounded_sample(rows: DataFrame, max_docs: int, max_chars: int, ids: DataFrame | None = None) -> DataFrame:
    """Different rows (doc_id, text, ...) to fit a classifier on: of the ``max_docs`` ids of the smallest
    hashes, in that order, as many as hold ``max_chars`` characters together; rows longer than a
    twentieth of that take no part.  ``ids``: those to choose from, already ``max_docs`` at most.
    Staged, so it is read once however often it is used."""
    if ids is None:
        ids = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    short = rows.filter(F.char_length("text") <= max_chars // 20)
    own = short.join(F.broadcast(ids), "doc_id", "left_semi").distinct().withColumn("row_hash", F.xxhash64(*rows.columns))
    own = staged(own, "sample")
    sizes = own.select(F.xxhash64("doc_id").alias("o"), "doc_id", "row_hash", F.char_length("text").alias("n"))
    sizes = sizes.orderBy("o", "doc_id", "row_hash").limit(max_docs)  # so many rows in the one task below
    before = F.sum("n").over(Window.orderBy("o", "doc_id", "row_hash").rowsBetween(Window.unboundedPreceding, 0))
    kept = sizes.select("doc_id", "row_hash", before.alias("c")).filter(F.col("c") <= max_chars).drop("c")
    return own.join(F.broadcast(kept), ["doc_id", "row_hash"], "left_semi").select(*rows.columns)


def fitted(sample: DataFrame, fit):
    """fit(rows as tuples, sorted) of a bounded sample, run in one task; the driver gets the result alone."""

    def run(batches):
        import pyarrow as pa

        rows = [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))]
        rows.sort()
        made = pickle.dumps(fit(rows), protocol=5)
        for at in range(0, len(made), 1 << 22):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([made[at : at + (1 << 22)]], pa.binary())], names=["at", "part"])

    parts = sample.repartition(1).mapInArrow(run, "at long, part binary").collect()
    return pickle.loads(b"".join(bytes(r.part) for r in sorted(parts, key=lambda r: r.at))) if parts else fit([])


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads; null text is empty text."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


#: Characters on which Python's tables and the tokenizer library's agree in any version
#: (Latin, no C0/C1 separators); other texts take the library's own splitting.
PLAIN = re.compile(r"[\x00-\x1b\x20-\x84\x86-į]*").fullmatch


def hash_mod(col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % modulus


def rows_where(docs: DataFrame, decide, text_col: str = "text") -> DataFrame:
    """The rows of docs, every column as it is, for which ``decide()(list of texts or None)``
    gives true; ``decide`` is called once in each task."""

    def run(batches):
        import pyarrow as pa

        own = decide()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                keep = own(b.column(b.schema.get_field_index(text_col)).to_pylist())
                yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
