"""One trace from start to end: walk, taint, entities, patterns, the outcome, one nested result row,
and report tables.  Each result is a DataFrame; a trace's own results are bounded by its limits."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as X
from ..config import EngineConfig
from ..operators import entities, flows, graph, ordering, taint, typologies
from ..sources.ledger import normal_address, observed, valid_address


@dataclass
class Trace:
    transfers: DataFrame
    labels: DataFrame
    start: str
    cfg: EngineConfig

    @cached_property
    def walk(self) -> graph.Walk:
        return graph.walk(self.transfers, self.labels, self.start, self.cfg)

    @cached_property
    def seen(self) -> DataFrame:
        """Transfers of expanded wallets: what the replay and the patterns look at."""
        expanded = graph.cut(self.walk.wallets.filter("expanded").select("address"))  # its size is known then: the ledger isn't shuffled where it is small
        return graph.cut(observed(self.transfers, expanded))

    @cached_property
    def typed(self) -> DataFrame:
        w = self.walk
        return graph.cut(entities.identify(w.edges, w.wallets.select("address"), self.labels, self.cfg))

    @cached_property
    def _replay(self):
        ev = taint.kept(self.seen)
        pos = graph.cut(taint.positions(ev, self.start, named=False))
        return ev, pos, graph.cut(taint.taint(ev, taint.draws(pos.repartition(*taint.QUEUE)), self.start))

    @cached_property
    def edge_taint(self) -> DataFrame:
        return graph.cut(taint.edge_taint(*self._replay))

    @cached_property
    def node_taint(self) -> DataFrame:
        return taint.node_taint(self.edge_taint)

    @cached_property
    def accounting(self) -> DataFrame:
        ev, pos, _ = self._replay
        return taint.accounting(ev, pos, flows.ambiguous(ev))

    @cached_property
    def hops(self) -> DataFrame:
        return taint.cap_hops(self.walk.hops, self.edge_taint)

    @cached_property
    def scores(self) -> DataFrame:
        """Identified wallets with path and score: what is known of them without the replay."""
        paths = entities.crossed(graph.shortest_paths(self.walk, self.start, self.cfg.max_depth), self.typed)
        rows = self.typed.join(paths, "address").withColumn("hops", F.size("path") - 1)
        return graph.cut(entities.scored(rows, self.cfg))

    @cached_property
    def attributions(self) -> DataFrame:
        """Identified wallets with path, score, amounts received by asset and the tainted part of them,
        and what their path's hops assume was there before."""
        rows = self.scores
        amounts = lambda c, name: F.map_from_entries(F.sort_array(F.collect_list(F.struct("asset", c)))).alias(name)
        got = self.hops.groupBy(F.col("to_addr").alias("address"), "asset").agg(F.sum("value").cast("double").alias("v"), F.sum("tainted").alias("t"))
        got = got.groupBy("address").agg(amounts("v", "received"), amounts("t", "tainted"), F.max(F.col("t") > 0).alias("any_taint"))
        legs = rows.select("address", F.explode(F.expr("transform(sequence(1, greatest(size(path) - 1, 1)), i -> struct(path[i - 1] as from_addr, path[i] as to_addr))")).alias("leg"))
        doubt = legs.select("address", "leg.*").join(self.edge_taint.select("from_addr", "to_addr", "asset", "assumed"), ["from_addr", "to_addr"]).groupBy("address", "asset").agg(F.sum("assumed").alias("a"))
        doubt = doubt.groupBy("address").agg(amounts("a", "path_assumed"))
        return graph.cut(rows.join(got, "address", "left").join(doubt, "address", "left"))

    @cached_property
    def primary(self):
        return entities.primary(self.scores).first()

    @cached_property
    def risk(self) -> DataFrame:
        return entities.risk_flags(self.walk.wallets, self.typed, list(self.primary.path) if self.primary else [])

    @cached_property
    def clusters(self) -> DataFrame:
        got = self.walk.hops.groupBy(F.col("to_addr").alias("address"), "asset").agg(F.sum("value").alias("received"))
        return entities.clusters(self.walk.wallets, self.typed, self.walk.edges, got)

    @cached_property
    def findings(self) -> typologies.Found:
        exempt = self.typed.filter(F.col("type").isin(*self.cfg.terminal))
        own = self.node_taint.filter("tainted > 0").select("address").union(self.walk.wallets.filter("depth = 0").select("address"))
        return typologies.findings(self.seen, exempt, self.cfg, own)

    @property
    def detections(self) -> DataFrame:
        """All detections, their members apart (``findings.members``)."""
        return self.findings.rows

    @cached_property
    def reported(self) -> DataFrame:
        """The strongest detections, with their members."""
        return graph.cut(self.findings.with_wallets(typologies.reported(self.detections, self.cfg)))

    @cached_property
    def termination(self) -> str:
        sent = self.transfers.filter(F.col("from_addr") == self.start)
        types = {r.type for r in self.scores.filter("hops > 0").select("type").distinct().collect()}
        at_cap = self.walk.wallets.filter((F.col("depth") == self.cfg.max_depth) & ~F.col("expanded"))
        return entities.termination({
            "no_outgoing": sent.isEmpty(),
            "dust_only": flows.not_dust(sent, self.cfg).isEmpty(),
            "exchange": bool(types & {"exchange", "suspected_exchange"}),
            "mixer": "mixer" in types,
            "bridge": "bridge" in types,
            "truncated": self.walk.truncated,
            "depth_cap": not at_cap.isEmpty(),
        })

    @classmethod
    def of_address(cls, transfers: DataFrame, labels: DataFrame, address: str, cfg: EngineConfig) -> Trace:
        """A trace from a chain address, normalised; an error if it is none."""
        own = transfers.sparkSession.range(1).select(normal_address(F.lit(address)).alias("a"), valid_address(F.lit(address)).alias("ok")).first()
        if not own.ok:
            raise ValueError(f"no address: {address!r}; wanted 0x and 40 hexadecimal digits")
        return cls(transfers, labels, own.a, cfg)

    @cached_property
    def findings_blocks(self) -> DataFrame:
        """address, asset, received, tainted, share, path_assumed, caveat: what each finding rests on."""
        keys = self.attributions.select("address", "any_taint", F.map_keys("received").alias("k"), "received", "tainted", "path_assumed").withColumn("asset", F.explode_outer("k"))
        got, own = F.col("received")[F.col("asset")], F.col("tainted")[F.col("asset")]
        kind = entities.caveat(F.col("any_taint"))
        return keys.select("address", "asset", got.alias("received"), own.alias("tainted"), F.when(got > 0, own / got).otherwise(0.0).alias("share"), F.coalesce(F.col("path_assumed")[F.col("asset")], F.lit(0.0)).alias("path_assumed"), kind.alias("caveat"))

    def _nearest(self, scored: DataFrame, *more: str) -> DataFrame:
        """One row: the nearest exchange of ``scored``, else the nearest collection point, with columns ``more``, and what else was met."""
        found = scored.filter("hops > 0 and type in ('exchange', 'suspected_exchange')")
        first = found.orderBy(F.when(F.col("type") == "exchange", 0).otherwise(1), "hops", F.desc("raw"), "address").limit(1)
        one = lambda df, **cols: df.agg(*(c.alias(n) for n, c in cols.items())).withColumn("k", F.lit(1))
        top = one(first, **{c: F.first(c) for c in ("type", "entity", "address", "hops", "score", *more)})
        # of a trace's findings: how many more exchanges, which collection points, which kinds were crossed
        rest = one(found, exchanges=F.count(F.when(F.col("type") == "exchange", 1)), collection_points=F.count(F.when(F.col("type") == "suspected_exchange", 1)))
        met = one(self.risk.filter("type in ('mixer', 'bridge')"), flags=F.count("*"))
        rows = top.join(rest, "k").join(met, "k")
        is_type = lambda t: F.coalesce(F.col("type") == t, F.lit(False))
        return rows.withColumns({"exchange_found": is_type("exchange"), "lead": is_type("suspected_exchange"), "other_exchanges": F.greatest(F.col("exchanges") - 1, F.lit(0))})

    def outcome(self) -> DataFrame:
        """The summary's finding without its words and amounts: needs no replay."""
        return self._nearest(self.scores).select("exchange_found", "lead", "entity", "address", "hops", "score", "other_exchanges", "collection_points", "flags")

    def summary(self) -> DataFrame:
        """One row: the nearest named exchange; else the nearest collection point as a lead to be confirmed;
        else that none was found.  With the caveat that the finding calls for, and what else was met."""
        rows = self._nearest(self.attributions, "any_taint", "tainted", "received")
        named, lead = F.col("exchange_found"), F.col("lead")
        hops = F.concat(F.col("hops").cast("string"), F.when(F.col("hops") == 1, " hop").otherwise(" hops"))
        sure = F.concat(F.col("score").cast("string"), F.lit("% confidence"))
        own = X.asset_list(F.map_filter("tainted", lambda k, v: v > 0))
        headline = (
            F.when(named & F.col("any_taint"), F.concat(own, F.lit(" of the suspect's funds reached "), "entity", F.lit(", "), hops, F.lit(", "), sure))
            .when(named, F.concat(F.lit("Transaction path connects to "), "entity", F.lit(", "), hops, F.lit("; counted first in, first out none of the suspect's funds arrived")))
            .when(lead, F.concat(F.lit("No named exchange reached. Unconfirmed: a collection point "), hops, F.lit(" away, "), sure))
            .otherwise(f"No exchange reached within {self.cfg.max_depth} hops")
        )
        kind = F.when(named | lead, entities.caveat(F.col("any_taint")))
        action = F.when(named, F.concat(F.lit("Ask "), "entity", F.lit(" for the records of deposits to "), "address")).when(lead, F.concat(F.lit("Confirm what "), "address", F.lit(" is before anything is asked of anyone: re-pooled funds look the same"))).otherwise("Trace deeper, or add labels: the funds may rest in unknown wallets")
        return rows.select(
            headline.alias("headline"), "exchange_found", "lead", F.lit(self.termination).alias("termination"), "entity", "address", "hops", "score",
            F.when(named | lead, X.asset_list(F.col("received"))).alias("received"), kind.alias("caveat"), entities.worded(kind, entities.CAVEATS).alias("caveat_text"), action.alias("action"),
            "other_exchanges", "collection_points", "flags",
        )

    # ------------------------------------------------------------------- the result as shards

    def sections(self) -> dict[str, tuple[DataFrame, list]]:
        """The parts of the result with the order of each."""
        nodes = self.walk.wallets.join(self.typed.select("address", "method", "entity", "type", "confidence"), "address", "left")
        edges = self.walk.edges.select("from_addr", "to_addr", "depth", "assets", "asset", "value", "tx_count", "ts", "tx_hash")
        return {
            "summary": (self.summary().withColumn("start_address", F.lit(self.start)), ["start_address"]),
            "nodes": (nodes, ["depth", "address"]),
            "edges": (edges, ["depth", F.desc("value"), "from_addr", "to_addr"]),
            "attributions": (self.attributions.drop("any_taint"), ["hops", F.desc("raw"), "address"]),
            "risk_flags": (self.risk, ["rank", F.desc("on_primary_path"), "depth", "address"]),
            "clusters": (self.clusters, ["hop", F.desc("confidence"), F.desc("most"), "cluster_id"]),
            "typologies": (self.reported, [F.desc("strength"), "typology", "wallet", "asset"]),
            "accounting": (self.accounting, ["rule"]),
        }

    def write_payload(self, path: str, shard_rows: int = 100_000) -> None:
        """The whole result in folder ``path``: JSON lines by section and shard, each of ``shard_rows`` lines in the
        section's order, and in ``_manifest`` (which a reader of the lines doesn't see) each shard's first place
        and number of lines.  No part of it passes one task or the driver whole."""
        lines = None
        for name, (rows, order) in self.sections().items():
            placed = ordering.numbered(rows.withColumn("line", F.to_json(F.struct(*rows.columns))), [], order, "place").select(F.lit(name).alias("section"), "place", "line")
            lines = placed if lines is None else lines.unionByName(placed)
        lines = graph.cut(lines.withColumn("shard", F.expr(f"place div {shard_rows}")))
        lines.repartition("section", "shard").sortWithinPartitions("section", "shard", "place").write.partitionBy("section", "shard").json(path)
        lines.groupBy("section", "shard").agg(F.min("place").alias("first"), F.count("*").alias("rows")).write.json(f"{path}/_manifest")

    def payload(self) -> DataFrame:
        """The whole result as one nested row: nodes and edges in order, findings, flags, patterns.  For walks with
        a wallet limit; ``write_payload`` is for any."""
        one = lambda df, name, order: df.select(F.lit(1).alias("k"), F.struct(F.struct(*order).alias("o"), F.to_json(F.struct(*df.columns)).alias("row")).alias("s")).groupBy("k").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: F.from_json(s["row"], df.schema)).alias(name))
        nodes = self.walk.wallets.join(self.typed.select("address", "method", "entity", "type", "confidence"), "address", "left")
        edges = self.walk.edges.select("from_addr", "to_addr", "depth", "assets", "asset", "value", "tx_count", "ts", "tx_hash")
        parts = [
            one(nodes, "nodes", ["depth", "address"]),
            one(edges, "edges", ["depth", (-F.col("value")).alias("v"), "from_addr", "to_addr"]),
            one(self.attributions.drop("any_taint"), "attributions", ["hops", (-F.col("raw")).alias("v"), "address"]),
            one(self.risk, "risk_flags", ["rank", (~F.col("on_primary_path")).alias("p"), "depth", "address"]),
            one(self.clusters, "clusters", ["hop", (-F.col("confidence")).alias("c"), (-F.coalesce("most", F.lit(0))).alias("v"), "cluster_id"]),
            one(self.reported, "typologies", [(-F.col("strength")).alias("v"), "typology", "wallet", "asset"]),
            one(self.accounting, "accounting", ["rule"]),
        ]
        out = self.summary().withColumn("k", F.lit(1))
        for p in parts:
            out = out.join(p, "k", "left")
        return out.drop("k").withColumn("start_address", F.lit(self.start))

    def payload_json(self) -> DataFrame:
        p = self.payload()
        return p.select("start_address", F.to_json(F.struct(*p.columns)).alias("payload"))

    # -------------------------------------------------------------------------- report tables

    def path_places(self) -> DataFrame:
        """The primary path, a row for each place: hop, role, address; needs no replay."""
        path = list(self.primary.path) if self.primary else [self.start]
        places = self.transfers.sparkSession.createDataFrame(list(enumerate(path)), "hop int, address string")
        role = F.when(F.col("hop") == 0, "suspect").otherwise(F.coalesce("type", F.lit("intermediary")))
        return places.join(self.typed.select("address", "type"), "address", "left").select("hop", role.alias("role"), "address")

    def path_rows(self) -> DataFrame:
        """The primary path's places with what moved there and the tainted part."""
        places = self.path_places()
        prev = places.select((F.col("hop") + 1).alias("hop"), F.col("address").alias("previous"))
        moved = self.hops.groupBy("from_addr", "to_addr").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("asset", "value")))).alias("assets"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("asset", "tainted")))).alias("tainted"), F.max_by("tx_hash", F.struct("value", "asset")).alias("tx_hash"))
        rows = places.join(prev, "hop", "left").join(moved, (F.col("previous") == moved.from_addr) & (F.col("address") == moved.to_addr), "left")
        return rows.select("hop", "role", "address", F.when(F.col("hop") > 0, X.asset_list(F.col("assets"))).alias("moved"), "tainted", "tx_hash")

    def flag_rows(self) -> DataFrame:
        """Risky wallets met, with what to bear in mind about each."""
        return self.risk.select("address", "type", "entity", "severity", "depth", "on_primary_path", entities.worded(F.col("type"), entities.NOTES).alias("note"))

    def member_rows(self) -> DataFrame:
        """Members of clusters, a row each."""
        return entities.cluster_members(self.walk.wallets, self.typed, self.walk.edges).select("cluster_id", "address", F.col("depth").alias("hop"))

    def confidence_rows(self) -> DataFrame:
        return self.attributions.select("address", "entity", "score", "capped", F.inline("components"))

    def cluster_rows(self) -> DataFrame:
        return self.clusters.select("cluster_id", "entity", "hop", "confidence", F.size("members").alias("n_members"), X.asset_list(F.col("received")).alias("received"))

    def disclaimer(self) -> str:
        """What the report rests on, for the chain and the assets at hand (few symbols)."""
        assets = ", ".join(sorted(r.asset for r in self.walk.hops.select("asset").distinct().collect())) or "no asset"
        return (
            f"Attribution on {self.cfg.chain} follows first-in-first-out accounting over the transfers of {assets} observed from {self.start}. Other assets "
            "are not followed, and assets are never added together. Balances that existed before are assumed and shown as such. "
            "Labels and consolidation findings are leads to be confirmed, not proof of ownership."
        )


def read_payload(spark: SparkSession, path: str, section: str | None = None) -> DataFrame:
    """section, shard, place, line of a written result; of one section only its files are read."""
    rows = spark.read.schema("place long, line string, section string, shard long").json(path)
    return rows if section is None else rows.filter(F.col("section") == section)


def payload_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("section string, shard long, first long, rows long").json(f"{path}/_manifest")
