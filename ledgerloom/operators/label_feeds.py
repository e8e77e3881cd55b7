"""Label feeds merged into the label table: what is there stays, feeds are checked and deduplicated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean_entity, token_like
from ..sources.ledger import normal_address, valid_address

LABEL = ["chain", "address", "entity", "type", "source"]


def judged_feed(feed: DataFrame) -> DataFrame:
    """feed: pos, currency, address, label, category; adds the first reason to reject, or null."""
    rows = feed.withColumn("address", normal_address(F.col("address"))).withColumn("entity", clean_entity(F.col("label")))
    reason = (
        F.when(F.coalesce(F.upper("currency"), F.lit("")) != "ETH", "not_eth")
        .when(~valid_address(F.col("address")), "bad_address")
        .when(F.coalesce(F.col("entity"), F.lit("")) == "", "no_label")
        .when(token_like(F.col("label")), "token_like")
    )
    return rows.withColumn("reason", reason)


def rejects(judged: DataFrame) -> DataFrame:
    return judged.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def accepted(judged: DataFrame, source: str) -> DataFrame:
    """First row of each address, in feed order."""
    w = Window.partitionBy("address").orderBy("pos")
    rows = judged.filter("reason is null").withColumn("r", F.row_number().over(w)).filter("r = 1")
    return rows.select(F.lit("ethereum").alias("chain"), "address", "entity", F.coalesce("category", F.lit("unknown")).alias("type"), F.lit(source).alias("source"))


def live_only(rows: DataFrame, state: DataFrame, least_nonce: int = 25) -> DataFrame:
    """Exchange rows must look alive on chain: no contract that never sent, and some history; where the
    look-up failed (no row or no nonce) they go too."""
    s = state.select("address", "is_contract", "nonce")
    j = rows.join(s, "address", "left")
    # a contract that never sent has nonce 0, which is below any least one
    return j.filter((F.col("type") != "exchange") | (F.coalesce("nonce", F.lit(-1)) >= F.greatest(F.lit(least_nonce), F.when(F.col("is_contract"), 1).otherwise(0)))).select(*LABEL)


def merge(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing labels win."""
    return existing.select(*LABEL).unionByName(new.select(*LABEL).join(existing.select("chain", "address"), ["chain", "address"], "left_anti"))


def merge_counts(existing: DataFrame, judged: DataFrame, new: DataFrame) -> DataFrame:
    old = new.join(existing.select("chain", "address"), ["chain", "address"], "left_semi")
    return (
        new.agg(F.count("*").alias("n")).withColumn("what", F.lit("accepted"))
        .unionByName(old.agg(F.count("*").alias("n")).withColumn("what", F.lit("already")))
        .unionByName(judged.filter("reason is not null").agg(F.count("*").alias("n")).withColumn("what", F.lit("rejected")))
    )
