"""The graph as two tables, wallets (trace_id, address, props) and transfers (trace_id, src, dst, props),
and how writes are merged into them.

Writes carry ``seq``, their order; props are maps of strings.  A wallet's write adds to its properties:
the last write of each name stands, and one of null takes the name away.  A transfer's write replaces
what the pair had.  Both ends of a transfer exist as wallets.  Rows with a null key take no part;
equal ``seq`` are told apart by the value itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WALLET, TRANSFER = ["trace_id", "address"], ["trace_id", "src", "dst"]
_NONE = "map<string,string>"


def merged_wallets(writes: DataFrame) -> DataFrame:
    """trace_id, address, seq, props of all writes, old ones included, to a row for each wallet."""
    each = writes.dropna(subset=WALLET).select(*WALLET, "seq", F.explode_outer("props").alias("name", "value"))
    last = each.groupBy(*WALLET, "name").agg(F.max(F.struct("seq", "value")).alias("w"))
    set_ = F.collect_list(F.when(F.col("name").isNotNull() & F.col("w.value").isNotNull(), F.struct("name", F.col("w.value").alias("value"))))
    return last.groupBy(*WALLET).agg(F.max("w.seq").alias("seq"), F.map_from_entries(F.sort_array(set_)).alias("props"))


def merged_transfers(writes: DataFrame) -> DataFrame:
    """trace_id, src, dst, seq, props of all writes to a row for each pair, the last one's."""
    entries = F.sort_array(F.map_entries("props"))
    last = writes.dropna(subset=TRANSFER).groupBy(*TRANSFER).agg(F.max(F.struct("seq", entries.alias("props"))).alias("w"))
    return last.select(*TRANSFER, "w.seq", F.map_from_entries("w.props").alias("props"))


def merge(wallets: DataFrame, transfers: DataFrame, new_wallets: DataFrame, new_transfers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after the new writes."""
    ends = [new_transfers.select("trace_id", F.col(c).alias("address"), "seq", F.create_map().cast(_NONE).alias("props")) for c in ("src", "dst")]
    pair = merged_transfers(transfers.unionByName(new_transfers))
    return merged_wallets(wallets.unionByName(new_wallets).unionByName(ends[0]).unionByName(ends[1])), pair
