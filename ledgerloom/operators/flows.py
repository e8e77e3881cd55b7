"""Flows: transfers added up by sender, recipient and asset, and what is read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..sources.ledger import ORDER
from .ordering import Ranges, hot, split

QUEUE = ["wallet", "asset"]


def dust_limit(asset: Column, cfg: EngineConfig, native_override: bool = True) -> Column:
    """Literal CASE, so that the filter reaches the scan."""
    up = F.upper(asset)
    rules = [(up.isin(*cfg.native), cfg.dust_native)] if native_override else []
    out = F
    for when, v in [*rules, *((up == symbol, v) for symbol, v in cfg.dust.items())]:
        out = out.when(when, v)
    return F.lit(cfg.dust_default) if out is F else out.otherwise(cfg.dust_default)


def not_dust(transfers: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Per transaction and asset, before any adding up."""
    return transfers.filter(F.col("value") >= dust_limit(F.col("asset"), cfg))


def flow_assets(transfers: DataFrame) -> DataFrame:
    """One row for each sender, recipient and asset; ``tx_hash`` is that of the largest transfer, the
    first of equals."""
    first = F.struct(*[F.col(c) for c in ORDER[:4]])
    return transfers.groupBy("from_addr", "to_addr", "asset").agg(
        F.sum("value").alias("value"),
        F.count("*").alias("tx_count"),
        F.max("ts").alias("ts"),
        F.min_by("tx_hash", F.struct(-F.col("value"), first)).alias("tx_hash"),
        F.min_by("contract", first).alias("contract"),
        F.min(first).alias("first_seen"),
    )


def edges(flows: DataFrame, cfg: EngineConfig) -> DataFrame:
    """One row for each sender and recipient, amounts as a map by asset (never added across assets);
    the primary asset is the largest native one, if any, else the largest."""
    native = F.col("asset").isin(*cfg.native)
    return flows.groupBy("from_addr", "to_addr").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("asset", "value")))).alias("assets"),
        F.max_by("asset", F.struct(native, "value", "asset")).alias("asset"),
        F.max_by("value", F.struct(native, "value", "asset")).alias("value"),
        F.max_by("tx_hash", F.struct(native, "value", "asset")).alias("tx_hash"),
        F.sum("tx_count").alias("tx_count"),
        F.max("ts").alias("ts"),
        F.coalesce(F.max(F.when(native, F.col("value"))), F.lit(0)).alias("native_max"),
        F.max("value").alias("any_max"),
        F.min("first_seen").alias("first_seen"),
    )


def ranked(edge_rows: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Each sender's best branches: native amount, then any amount, then the earliest."""
    w = Window.partitionBy("from_addr").orderBy(F.desc("native_max"), F.desc("any_max"), "first_seen", "to_addr")
    return edge_rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cfg.max_edges)


def large_queues(transfers: DataFrame) -> list[int]:
    """Which queues (wallet and asset) may be more than a task's work."""
    ends = transfers.select(F.col("from_addr").alias("wallet"), "asset").unionByName(transfers.select(F.col("to_addr").alias("wallet"), "asset"))
    return hot(ends, QUEUE)


def sides(transfers: DataFrame) -> DataFrame:
    """wallet, asset, other, value, out: each transfer at its sender (out 1) and at its recipient (out 0)."""
    out = transfers.select(F.col("from_addr").alias("wallet"), "asset", F.col("to_addr").alias("other"), "value", F.lit(1).alias("out"))
    inn = transfers.select(F.col("to_addr").alias("wallet"), "asset", F.col("from_addr").alias("other"), "value", F.lit(0).alias("out"))
    return out.unionByName(inn)


def totals(transfers: DataFrame, large: list[int] | None = None) -> DataFrame:
    """Per wallet and asset: sent, received, numbers of both and of different counterparties."""
    of = lambda c, side: F.coalesce(F.sum(F.when(F.col("out") == side, F.col(c))), F.lit(0))
    count = lambda side: F.count(F.when(F.col("out") == side, 1))

    def added(rows):
        both = rows.groupBy(*QUEUE, "other", "out").agg(F.sum("value").alias("v"), F.count("*").alias("n"))
        return both.groupBy(*QUEUE).agg(
            of("v", 1).alias("sent"), of("v", 0).alias("received"), of("n", 1).alias("n_sent"), of("n", 0).alias("n_received"),
            count(1).alias("recipients"), count(0).alias("senders"),
        )

    own, few = split(sides(transfers), QUEUE, large_queues(transfers) if large is None else large)
    return added(own) if few is None else added(own).unionByName(added(few))


def fan_in(edge_rows: DataFrame, wallets: DataFrame) -> DataFrame:
    """Different third-party senders of each wallet (column address), zero kept."""
    n = edge_rows.filter("from_addr <> to_addr").groupBy(F.col("to_addr").alias("address")).agg(F.countDistinct("from_addr").alias("fan_in"))
    return wallets.select("address").join(n, "address", "left").select("address", F.coalesce("fan_in", F.lit(0)).alias("fan_in"))


def adaptive_floor(fan: DataFrame, cfg: EngineConfig) -> int:
    """The in-degree at index floor(q * (n - 1)) of the sorted list, from a count of each degree:
    different degrees are few, so the running sum is over a short table."""
    by = fan.groupBy("fan_in").count()
    n = fan.count()
    if not n:
        return 0
    index = int(cfg.fan_in_quantile * (n - 1))
    run = by.withColumn("upto", F.sum("count").over(Window.orderBy("fan_in")))
    return run.filter(F.col("upto") > index).agg(F.min("fan_in")).first()[0]


def native_total(totals: Column, native: str) -> Column:
    """The native part of amounts by asset: the chain's own, else ETH, else 0."""
    return F.coalesce(totals[native], totals["ETH"], F.lit(0).cast("double"))


def consolidation_score(n: Column, cfg: EngineConfig) -> Column:
    span = float(cfg.fan_in_strong - cfg.fan_in_min)
    return F.when(n < cfg.fan_in_min, 0.0).when(n >= cfg.fan_in_strong, 1.0).otherwise((n - cfg.fan_in_min) / span)


def arrivals(transfers: DataFrame, large: list[int] | None = None) -> DataFrame:
    """wallet, asset, out, ts, value, tx_hash, dwell: each transfer at its sender (out 1) and at its recipient (out 0); as-of: a
    departure's time since the wallet's last arrival of that asset at or before it, null for others.  The running maximum
    goes over ranges of a wallet's time."""
    ins = transfers.select(F.col("to_addr").alias("wallet"), "asset", "ts", F.lit(0).alias("out"), "value", F.lit(None).cast("string").alias("tx_hash"))
    outs = transfers.select(F.col("from_addr").alias("wallet"), "asset", "ts", F.lit(1).alias("out"), "value", "tx_hash")

    def local(rows, run, place):
        return rows.withColumn("arrived", F.max(F.when(F.col("out") == 0, F.col("ts"))).over(run))

    def carry(table, before, whole):
        return table.withColumn("before_", F.max("last").over(before))

    seen = Ranges(ins.unionByName(outs), ["wallet", "asset"], ["ts", "out"], local, large=large).carried([F.max("arrived").alias("last")], carry)
    dwell = F.when(F.col("out") == 1, F.col("ts") - F.coalesce("arrived", "before_"))
    return seen.select("wallet", "asset", "out", "ts", "value", "tx_hash", dwell.alias("dwell"))


def dwell(transfers: DataFrame, large: list[int] | None = None) -> DataFrame:
    """Each departure that follows an arrival, with the time since the last one."""
    return arrivals(transfers, large).filter("out = 1 and dwell is not null").select("wallet", "asset", "tx_hash", "ts", "dwell")


def ambiguous(transfers: DataFrame) -> DataFrame:
    """Value per asset of events that share wallet, asset, time, block and index with another."""
    ends = transfers.select("*", F.explode(F.array("from_addr", "to_addr")).alias("wallet"))
    n = F.count("*").over(Window.partitionBy("ts", "block", "tx_index", "wallet", "asset"))
    tied = ends.withColumn("n", n).filter("n > 1").dropDuplicates(ORDER)
    return tied.groupBy("asset").agg(F.sum("value").alias("value"), F.count("*").alias("events"))
