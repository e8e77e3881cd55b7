"""Who wallets are: labels, consolidation, clusters, scores, risk, the outcome in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SEVERITY, EngineConfig
from .checkpoints import cut
from .flows import adaptive_floor, consolidation_score, fan_in


def known(wallets: DataFrame, labels: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Label lookup by the traced chain and address; a wallet's first label, if it has several."""
    one = labels.filter(F.col("chain") == cfg.chain).groupBy("address").agg(F.min(F.struct("entity", "type", "source")).alias("l"))
    rows = wallets.join(one, "address")
    return rows.select("address", F.lit("known_label").alias("method"), F.coalesce("l.entity", F.lit("Unknown entity")).alias("entity"), F.coalesce("l.type", F.lit("unknown")).alias("type"), F.lit(cfg.label_confidence).alias("confidence"))


def consolidation(edge_rows: DataFrame, wallets: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Suspected exchanges: fan-in at the flag and at the graph's own floor."""
    fan = fan_in(edge_rows, wallets)
    floor = max(cfg.fan_in_flag, adaptive_floor(fan, cfg))
    score = consolidation_score(F.col("fan_in"), cfg)
    hit = fan.filter(F.col("fan_in") >= floor)
    return hit.select("address", F.lit("consolidation").alias("method"), F.lit("Unknown exchange (consolidation pattern)").alias("entity"), F.lit("suspected_exchange").alias("type"), (cfg.consolidation_max * F.greatest(score, F.lit(0.5))).alias("confidence"))


def flagged(found: DataFrame) -> DataFrame:
    """Identified wallets with what they are marked as."""
    kind = F.col("type")
    return found.withColumns({"is_vasp": kind.isin("exchange", "suspected_exchange"), "is_mixer": kind == "mixer", "is_bridge": kind == "bridge"})


def identify(edge_rows: DataFrame, wallets: DataFrame, labels: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Labels first, consolidation for the rest."""
    sure = known(wallets, labels, cfg)
    rest = consolidation(edge_rows, wallets, cfg).join(sure.select("address"), "address", "left_anti")
    return sure.unionByName(rest)


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(s, "^-+|-+$", ""), F.lit("")), F.lit("unknown"))


def hop_points(hops: Column, cfg: EngineConfig) -> Column:
    return F.when(hops <= 0, cfg.points_hop).otherwise(F.greatest(F.lit(0), cfg.points_hop - cfg.points_per_hop * (hops - 1)))


def scored(found: DataFrame, cfg: EngineConfig) -> DataFrame:
    """found: method, hops, crossed (types met on the way); adds components and the clamped score."""
    m = F.when(F.col("method") == "known_label", cfg.points_label).when(F.col("method") == "consolidation", cfg.points_consolidation).otherwise(cfg.points_other)
    mixer, bridge = F.array_contains("crossed", "mixer"), F.array_contains("crossed", "bridge")
    part = lambda name, points: F.struct(F.lit(name).alias("label"), points.cast("int").alias("points"))
    parts = F.array(
        part("method", m),
        part("hops", hop_points(F.col("hops"), cfg)),
        part("mixer", F.when(mixer, cfg.points_mixer).otherwise(0)),
        part("bridge", F.when(bridge, cfg.points_bridge).otherwise(0)),
        part("clean path", F.when(mixer | bridge, 0).otherwise(cfg.points_clean)),
    )
    raw = F.aggregate("components", F.lit(0), lambda s, x: s + x["points"])
    rows = found.withColumn("components", F.filter(parts, lambda x: x["points"] != 0)).withColumn("raw", raw)
    return rows.withColumn("score", F.greatest(F.lit(cfg.score_low), F.least(F.lit(cfg.score_high), F.col("raw")))).withColumn("capped", F.col("raw") > cfg.score_high)


def breakdown(components: Column) -> Column:
    shown = F.transform(components, lambda x: F.concat(x["label"], F.lit(" ("), F.when(x["points"] > 0, "+").otherwise(""), x["points"], F.lit(")")))
    return F.array_join(shown, ", ")


def severity(kind: Column) -> Column:
    out = None
    for k, v in SEVERITY.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out


def crossed(paths: DataFrame, typed: DataFrame) -> DataFrame:
    """paths (address, path) with the types of wallets on the way, the end left out."""
    inner = paths.select("address", F.explode(F.expr("slice(path, 1, size(path) - 1)")).alias("on"))
    met = inner.join(typed.select(F.col("address").alias("on"), "type").distinct(), "on").filter(F.col("type").isin(*SEVERITY))
    types = met.groupBy("address").agg(F.sort_array(F.collect_set("type")).alias("crossed"))
    return paths.join(types, "address", "left").withColumn("crossed", F.coalesce("crossed", F.array().cast("array<string>")))


def risk_flags(wallets: DataFrame, typed: DataFrame, primary: list[str]) -> DataFrame:
    """Risky wallets, most severe first, those on the primary path first among equals."""
    rows = wallets.join(typed.select("address", "type", "entity"), "address").withColumn("severity", severity(F.col("type"))).filter("severity is not null")
    on = F.col("address").isin(*primary) if primary else F.lit(False)
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).otherwise(2)
    return rows.select("address", "type", "entity", "severity", "depth", on.alias("on_primary_path"), rank.alias("rank"))


def cluster_members(wallets: DataFrame, typed: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """cluster_id, entity, address, confidence, depth: named clusters by label name, suspected ones by hub with its
    senders.  A row a member, so that no cluster is one task's."""
    at = wallets.select("address", "depth")
    named = typed.filter("method = 'known_label'").select(F.concat(F.lit("label:"), slug(F.col("entity"))).alias("cluster_id"), "entity", "address", "confidence")
    hubs = typed.filter("method = 'consolidation'").select("address", "confidence")
    pred = edge_rows.filter("from_addr <> to_addr").select(F.col("to_addr").alias("hub"), F.col("from_addr").alias("member")).distinct()
    senders = pred.join(hubs.withColumnRenamed("address", "hub"), "hub").select("hub", "member", "confidence")
    both = senders.unionByName(hubs.select(F.col("address").alias("hub"), F.col("address").alias("member"), "confidence")).distinct()
    hub_rows = both.select(F.concat(F.lit("hub:"), "hub").alias("cluster_id"), F.lit(None).cast("string").alias("entity"), F.col("member").alias("address"), "confidence")
    return named.unionByName(hub_rows).join(at, "address")


def clusters(wallets: DataFrame, typed: DataFrame, edge_rows: DataFrame, received: DataFrame) -> DataFrame:
    """One row a cluster: members with their hops, least hop, greatest confidence, amounts received by asset."""
    rows = cluster_members(wallets, typed, edge_rows)
    amount = rows.join(received, "address").groupBy("cluster_id", "asset").agg(F.sum("received").alias("v"))
    amounts = amount.groupBy("cluster_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("asset", "v")))).alias("received"))
    most = amount.groupBy("cluster_id").agg(F.max("v").alias("most"))
    amounts = amounts.join(most, "cluster_id")
    out = rows.groupBy("cluster_id").agg(
        F.min("entity").alias("entity"),
        F.sort_array(F.collect_set("address")).alias("members"),
        F.map_from_entries(F.sort_array(F.collect_set(F.struct("address", "depth")))).alias("member_hops"),
        F.min("depth").alias("hop"),
        F.max("confidence").alias("confidence"),
    )
    return out.join(amounts, "cluster_id", "left")


def termination(w: dict) -> str:
    """Why a walk ended, first reason that holds."""
    for reason in ("no_outgoing", "dust_only", "exchange", "mixer", "bridge", "truncated", "depth_cap"):
        if w.get(reason):
            return reason
    return "no_label"


def primary(found: DataFrame) -> DataFrame:
    """First exchange, else first suspected one, else the first finding; hop 0 (the start) never."""
    rank = F.when(F.col("type") == "exchange", 0).when(F.col("type") == "suspected_exchange", 1).otherwise(2)
    return found.filter("hops > 0").orderBy(rank, "hops", F.desc("confidence"), "address").limit(1)


def first_clusters(members: DataFrame) -> DataFrame:
    """address, cluster_id: named beats suspected, then the cluster's order.  ``members`` are rows of ``cluster_members``."""
    members = cut(members.select("cluster_id", "address", "depth"))
    hops = members.groupBy("cluster_id").agg(F.min("depth").alias("hop"))
    named = F.when(F.col("cluster_id").startswith("label:"), 0).otherwise(1)
    rows = members.join(hops, "cluster_id").select("cluster_id", "hop", named.alias("named"), "address")
    return rows.groupBy("address").agg(F.min(F.struct("named", "hop", "cluster_id")).alias("b")).select("address", "b.cluster_id")


#: What a finding's wording must not claim, by what the replay says of it.
CAVEATS = {
    "fifo": "The suspect's part is counted first in, first out. Another rule (last in, first out; in proportion) gives other amounts for the same transfers.",
    "none_arrived": "Transfers lead here, but counted first in, first out none of what arrived is the suspect's: other money left the wallets on the way first. Another rule may say otherwise.",
    "path_only": "A path of transfers leads here; that is no proof that these funds took it.",
}

#: What to bear in mind about a wallet of each kind on the way.
NOTES = {
    "sanctioned": "On a sanctions list; dealings with it may have to be reported.",
    "scam": "Reported in connection with fraud.",
    "mixer": "Mixes the money of many; what leaves it can't be tied to what entered.",
    "bridge": "Moves value to another chain; the trail goes on there.",
}


def caveat(tainted: Column, computed: Column | bool = True) -> Column:
    """Which caveat a finding carries: ``tainted`` is whether any of the suspect's money arrived."""
    c = computed if isinstance(computed, Column) else F.lit(computed)
    return F.when(~c, "path_only").when(F.coalesce(tainted, F.lit(False)), "fifo").otherwise("none_arrived")


def worded(key: Column, texts: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for e in texts.items() for x in e))[key]
