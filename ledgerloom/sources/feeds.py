"""Label files, sanction lists, tag packs and recorded traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_META = "map<string,struct<entity:string,type:string,source:string,chain:string>>"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object keyed by address or chain:address.  Keys that begin with _ and values that are no
    objects go; the value's own chain wins over the key's, the default is ethereum."""
    raw = spark.read.text(path, wholetext=True)
    items = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "json"))
    rows = items.filter(~F.col("key").startswith("_") & F.col("json").startswith("{"))
    rows = rows.withColumn("m", F.from_json("json", "struct<entity:string,type:string,source:string,chain:string>"))
    at = F.instr("key", ":")
    chain = F.coalesce(F.col("m.chain"), F.when(at > 0, F.substring_index("key", ":", 1)), F.lit("ethereum"))
    return rows.select(F.lower(chain).alias("chain"), F.lower(F.trim(F.substring_index("key", ":", -1))).alias("address"), "m.entity", "m.type", "m.source")


def read_sanctions(spark: SparkSession, path: str) -> DataFrame:
    """CSV of address and name, as a label feed."""
    rows = spark.read.csv(path, header=True, schema="address string, name string")
    return rows.select(F.monotonically_increasing_id().alias("pos"), F.lit("ETH").alias("currency"), "address", F.col("name").alias("label"), F.lit("sanctioned").alias("category"))


def tag_pack(spark: SparkSession, pack: dict) -> DataFrame:
    """A parsed tag pack: header fields hold for tags that don't set them."""
    tags = [{k: str(v) for k, v in t.items() if v is not None} for t in pack.get("tags", []) if isinstance(t, dict)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "pos long, tag map<string,string>")
    of = lambda c: F.coalesce(F.col("tag")[c], F.lit(pack.get(c)).cast("string"))
    return rows.select("pos", of("currency").alias("currency"), F.col("tag")["address"].alias("address"), F.coalesce(of("label"), F.lit(pack.get("title"))).alias("label"), of("category").alias("category"))


class TagPacks(DataSource):
    """A folder (or file) of tag packs in YAML as rows of tags: a partition for each file, header fields
    holding for the tags that don't set them.  A file that can't be read is one row that says so.

    ``spark.dataSource.register(TagPacks)``, then ``spark.read.format("tagpacks").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "tagpacks"

    def schema(self) -> str:
        return "file string, pos long, currency string, address string, label string, category string, error string"

    def reader(self, schema):
        return _TagPackReader(self.options["path"])


class _TagPackReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        # the driver lists names alone; a folder that only Spark reads is listed through pyarrow's file systems
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        info = system.get_file_info(path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path))
        names = sorted(f.path for f in found if f.is_file and f.path.endswith((".yaml", ".yml")))
        return [InputPartition(n) for n in names]

    def read(self, partition):
        import yaml
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        file = partition.value.rsplit("/", 1)[-1]
        try:
            with system.open_input_stream(partition.value) as f:
                pack = yaml.safe_load(f.read().decode("utf-8", "replace")) or {}
            tags = pack.get("tags") or []
            head = {c: _text(pack.get(c)) for c in ("currency", "label", "title", "category")}
            rows = []
            for pos, tag in enumerate(tags):
                if isinstance(tag, dict):
                    own = {c: _text(tag.get(c)) for c in ("currency", "address", "label", "category")}
                    rows.append((file, pos, own["currency"] or head["currency"], own["address"], own["label"] or head["label"] or head["title"], own["category"] or head["category"], None))
        except Exception as broken:  # whatever is wrong with one pack, the others are read
            rows = [(file, None, None, None, None, None, f"{type(broken).__name__}: {broken}"[:200])]
        yield from rows


def _text(value) -> str | None:
    return None if value is None else str(value)


def read_tag_packs(spark: SparkSession, path: str) -> DataFrame:
    """Tags of all packs in a folder; rows with ``error`` are files that can't be read."""
    spark.dataSource.register(TagPacks)
    return spark.read.format("tagpacks").load(path)


# ------------------------------------------------------------------------- recorded traces

_RECORDED = "address string, payload string, recorded_at timestamp, source string, gone boolean, chain string, broken string"


def _logged(rows: DataFrame, path: str, chain: str) -> None:
    stamped = rows.select(F.lower("address").alias("address"), "payload", F.current_timestamp().alias("recorded_at"), F.lit("recording").alias("source"), "gone", F.lit(chain.lower()).alias("chain"))
    stamped.write.mode("append").partitionBy("chain").json(path)


def record(payload: DataFrame, path: str, chain: str = "ethereum") -> None:
    """Add a trace's JSON payload (start_address, payload) to the recordings, a log partitioned by chain."""
    own = payload.filter("start_address is not null and start_address <> ''")
    _logged(own.select(F.col("start_address").alias("address"), "payload", F.lit(False).alias("gone")), path, chain)


def delete_recordings(addresses: DataFrame, path: str, chain: str = "ethereum") -> None:
    """Forget the recordings of addresses (column address): the log gets a row that says so."""
    _logged(addresses.select("address", F.lit(None).cast("string").alias("payload"), F.lit(True).alias("gone")), path, chain)


def recordings(spark: SparkSession, path: str, chain: str | None = None, address: str | None = None) -> DataFrame:
    """The latest recording of each address that isn't deleted, of one chain or address if given.  Lines and
    payloads that are no JSON are left out, so a broken file fails no read."""
    rows = spark.read.schema(_RECORDED).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    rows = rows.filter("broken is null and address is not null and recorded_at is not null")
    rows = rows.filter(F.coalesce("gone", F.lit(False)) | (F.try_parse_json("payload").isNotNull()))
    if chain:
        rows = rows.filter(F.col("chain") == chain.lower())
    if address:
        rows = rows.filter(F.col("address") == address.lower())
    # of rows of one instant a deletion is the last
    last = rows.groupBy("chain", "address").agg(F.max_by(F.struct("payload", "recorded_at", "source", "gone"), F.struct("recorded_at", F.coalesce("gone", F.lit(False)))).alias("r"))
    return last.filter(~F.coalesce("r.gone", F.lit(False))).select("chain", "address", "r.payload", "r.recorded_at", "r.source")


def has_recording(spark: SparkSession, path: str, address: str, chain: str = "ethereum") -> bool:
    return not recordings(spark, path, chain, address).isEmpty()


def compacted(spark: SparkSession, path: str, out: str) -> None:
    """The log's present state as a log of its own: deleted and older recordings are gone from it."""
    recordings(spark, path).withColumn("gone", F.lit(False)).write.partitionBy("chain").json(out)


def listed(spark: SparkSession, path: str, chain: str | None = None) -> DataFrame:
    """What is recorded, a row each, with the summary's headline and outcome."""
    head = F.from_json("payload", "headline string, exchange_found boolean, termination string")
    return recordings(spark, path, chain).select("chain", "address", "recorded_at", head.alias("s")).select("chain", "address", "recorded_at", "s.*").orderBy("chain", "address")
