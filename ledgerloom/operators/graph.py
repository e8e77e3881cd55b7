"""Walks over flows: level by level, each level a few joins, cut by checkpoints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..sources.ledger import last_rows
from .chains import Chains
from .checkpoints import cut
from .flows import edges as edges_of
from .flows import adaptive_floor, fan_in, flow_assets, not_dust, ranked


@dataclass
class Walk:
    wallets: DataFrame  # address, depth, expanded
    edges: DataFrame  # from_addr, to_addr, depth of the recipient's level, amounts
    hops: DataFrame  # one row for each asset of an edge
    truncated: bool


class Turns:
    """The queue of a walk with a wallet limit, one turn after another."""

    def __init__(self, cfg: EngineConfig, start: str):
        self.cfg, self.known, self.senders, self.full = cfg, {start}, {start: set()}, False
        self.start = start

    def suspected(self, wallet: str) -> bool:
        n = len(self.senders.get(wallet, ()))
        if n < self.cfg.fan_in_flag:
            return False
        degrees = sorted(map(len, self.senders.values()))
        return n >= degrees[int(self.cfg.fan_in_quantile * (len(degrees) - 1))]

    def level(self, queue: list[tuple[str, int]], branches: dict[str, list[str]], labelled: set[str]) -> list[tuple[str, int]]:
        """Those of the queue that are expanded."""
        out = []
        for wallet, pos in queue:
            if len(self.known) >= self.cfg.max_wallets:
                self.full = True
                break
            if wallet != self.start and wallet not in labelled and self.suspected(wallet):
                continue
            out.append((wallet, pos))
            for to in branches.get(wallet, ()):
                self.known.add(to)
                self.senders.setdefault(to, set())
                if to != wallet:
                    self.senders[to].add(wallet)
        return out


def recent(transfers: DataFrame, wallets: DataFrame, cfg: EngineConfig) -> DataFrame:
    """What these wallets (column address) sent within their most recent rows of either kind, dust left out."""
    sent = transfers.join(wallets.select(F.col("address").alias("wallet")), transfers.from_addr == F.col("wallet"))
    got = transfers.join(wallets.select(F.col("address").alias("wallet")), transfers.to_addr == F.col("wallet"))
    own = last_rows(sent.unionByName(got), cfg)
    return not_dust(own.filter("from_addr = wallet").drop("wallet", "kind", "rn"), cfg)


def walk(transfers: DataFrame, labels: DataFrame, start: str, cfg: EngineConfig) -> Walk:
    """Forward, breadth first, from ``start``: dust goes, each wallet keeps its best branches, terminal
    entities are recorded and not expanded, the walk ends at the depth or wallet limit.

    Only the frontier's transfers are read and added up in a level.  With a wallet limit the frontier
    is at most that many wallets' branches, a proven bound, and is broadcast; without one it is joined.
    Wallets are expanded in queue order while fewer wallets than the limit are known, and a wallet that
    the graph so far makes a suspected exchange (fan-in at the flag and at the graph's own floor) is not
    expanded.  With a limit, "so far" is the wallet's own turn, decided on the driver from at most
    limit x branches edges; without one it is the end of the level before.
    """
    spark = transfers.sparkSession
    terminal = labels.filter((F.col("chain") == cfg.chain) & F.col("type").isin(*cfg.terminal)).select("address").distinct()
    labelled = labels.filter(F.col("chain") == cfg.chain).select("address").distinct()
    turns = Turns(cfg, start)
    # written, so that its size is known: otherwise the first level shuffles the whole ledger to find one wallet's transfers
    frontier = cut(spark.createDataFrame([(start, 0)], "address string, pos int"))
    known = frontier.select("address", F.lit(0).alias("depth"))
    expanded = None
    kept_edges, kept_flows, truncated = [], [], False
    clean = not_dust(transfers, cfg)
    for depth in range(cfg.max_depth):
        small = F.broadcast(frontier) if cfg.max_wallets is not None else frontier
        own = clean.join(small, clean.from_addr == small.address, "left_semi") if cfg.history_rows is None else recent(transfers, small, cfg)
        flows = cut(flow_assets(own))
        best = edges_of(flows, cfg)
        level = ranked(best, cfg).join(frontier.select(F.col("address").alias("from_addr"), "pos"), "from_addr")
        level = cut(level.withColumn("depth", F.lit(depth + 1)))
        if cfg.max_wallets is not None:
            sure = {r.address for r in frontier.join(labelled, "address", "left_semi").collect()}
            queue_now = [(r.address, r.pos) for r in frontier.orderBy("pos").collect()]
            branches: dict[str, list[str]] = {}
            for r in level.select("from_addr", "to_addr").orderBy("pos", "rank").collect():
                branches.setdefault(r.from_addr, []).append(r.to_addr)
            allowed = turns.level(queue_now, branches, sure)
            truncated |= turns.full
            frontier = spark.createDataFrame(allowed, "address string, pos int")
            level = level.join(frontier.select(F.col("address").alias("from_addr")), "from_addr", "left_semi")
        truncated |= not best.groupBy("from_addr").count().filter(F.col("count") > cfg.max_edges).isEmpty()
        expanded = frontier.select("address") if expanded is None else expanded.unionByName(frontier.select("address"))
        kept_edges.append(level)
        kept_flows.append(flows.join(level.select("from_addr", "to_addr", "depth"), ["from_addr", "to_addr"]))
        fresh = level.join(known, level.to_addr == known.address, "left_anti").groupBy(F.col("to_addr").alias("address")).agg(F.min(F.struct("pos", "rank")).alias("at"))
        fresh = cut(fresh)
        known = cut(known.unionByName(fresh.select("address", F.lit(depth + 1).alias("depth"))))
        queue = fresh.join(terminal, "address", "left_anti")
        if cfg.max_wallets is not None:
            # positions in queue order; the frontier is bounded by the limit, so one task orders it
            queue = queue.select("address", F.row_number().over(Window.orderBy("at", "address")).alias("pos"))
        else:
            so_far = kept_edges[0].select("from_addr", "to_addr")
            for e in kept_edges[1:]:
                so_far = so_far.unionByName(e.select("from_addr", "to_addr"))
            fan = cut(fan_in(so_far, known))
            floor = max(cfg.fan_in_flag, adaptive_floor(fan, cfg))
            suspected = fan.filter(F.col("fan_in") >= floor).join(labelled, "address", "left_anti")
            queue = queue.join(suspected, "address", "left_anti").select("address", F.lit(0).alias("pos"))
        frontier = cut(queue)
        if frontier.isEmpty():
            break
    both = kept_edges[0]
    for e in kept_edges[1:]:
        both = both.unionByName(e)
    hops = kept_flows[0]
    for f in kept_flows[1:]:
        hops = hops.unionByName(f)
    done = expanded.withColumn("expanded", F.lit(True)).dropDuplicates(["address"])
    wallets = known.join(done, "address", "left").withColumn("expanded", F.coalesce("expanded", F.lit(False)))
    return Walk(wallets, both, hops, truncated)


def shortest_paths(w: Walk, start: str, max_depth: int) -> DataFrame:
    """address, path: of the shortest paths from start the lexicographically least.  Paths to a level
    have equal length, so the least path to a wallet extends the least path to a predecessor."""
    spark = w.wallets.sparkSession
    best = spark.createDataFrame([(start, [start])], "address string, path array<string>")
    out = best
    for depth in range(1, max_depth + 1):
        at = w.wallets.filter(F.col("depth") == depth).select("address")
        step = w.edges.select("from_addr", "to_addr").join(best.withColumnRenamed("address", "from_addr"), "from_addr").join(at.withColumnRenamed("address", "to_addr"), "to_addr", "left_semi")
        best = cut(step.select(F.col("to_addr").alias("address"), F.concat("path", F.array("to_addr")).alias("path")).groupBy("address").agg(F.min("path").alias("path")))
        out = out.unionByName(best)
        if best.isEmpty():
            break
    return out


def focus(edge_rows: DataFrame, wallets: DataFrame, path: DataFrame, start: str) -> tuple[DataFrame, DataFrame]:
    """The part of a walk around a path (column address): the edges that touch it, and the wallets that have
    such an edge, and the start.  Without a path, the walk as it is."""
    on = path.select("address").distinct()
    if on.isEmpty():
        return edge_rows, wallets
    sent = edge_rows.join(on.withColumnRenamed("address", "from_addr"), "from_addr", "left_semi")
    rest = edge_rows.join(on.withColumnRenamed("address", "from_addr"), "from_addr", "left_anti")
    near = sent.unionByName(rest.join(on.withColumnRenamed("address", "to_addr"), "to_addr", "left_semi").select(*edge_rows.columns))
    ends = near.select(F.explode(F.array("from_addr", "to_addr")).alias("address")).distinct()
    return near, wallets.join(ends, "address", "left_semi").unionByName(wallets.join(ends, "address", "left_anti").filter(F.col("address") == start))


def chains(links: DataFrame, grows: float | None) -> DataFrame:
    """wallet, asset, path, amounts of the walk from every link of (wallet, asset, next, amount), laid out whole:
    rows as long as the walks.  ``Chains`` has their lengths, ends and extremes in rows of bounded size."""
    own = Chains(links, grows)
    by = own.places(own.walks).groupBy("wallet", "asset").agg(F.sort_array(F.collect_list(F.struct("place", "member", "amount"))).alias("p"))
    return by.select("wallet", "asset", F.transform("p", lambda x: x["member"]).alias("path"), F.transform(F.expr("slice(p, 1, size(p) - 1)"), lambda x: x["amount"]).alias("amounts"))
