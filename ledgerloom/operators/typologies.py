"""Laundering patterns.  Each detector takes a ledger and gives ``Found``: rows of bounded size (typology,
wallet, asset, strength, measure: a map of named numbers), one for each typology, wallet and asset, and
apart from them who the members of each are, in order, a row for each (typology, wallet, asset, place, member).
Arrays of members are made for reports alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..config import EngineConfig
from ..sources.ledger import ORDER
from .flows import QUEUE, arrivals, dust_limit, large_queues, sides
from .chains import Chains
from .checkpoints import cut, sized
from .ordering import hot, medians, numbered, parted, split

KEY = ["typology", "wallet", "asset"]
COLUMNS = [*KEY, "wallets", "strength", "measure"]


@dataclass
class Found:
    rows: DataFrame  # typology, wallet, asset, strength, measure
    members: Callable[[DataFrame], DataFrame]  # of rows: typology, wallet, asset, place, member
    involved: Callable[[], DataFrame]  # wallet: all members of all rows

    def with_wallets(self, rows: DataFrame | None = None) -> DataFrame:
        """rows (all, if none are given) with their members as arrays.  Given ones are worked out once."""
        rows = self.rows if rows is None else cut(rows)
        by = self.members(rows).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("place", "member"))).alias("m"))
        return rows.join(by.select(*KEY, F.transform("m", lambda x: x["member"]).alias("wallets")), KEY, "left").select(*COLUMNS)


def alone(rows: DataFrame, typology: str) -> Found:
    """Findings of one wallet each."""
    own = lambda r: r.select(*KEY, F.lit(0).cast("long").alias("place"), F.col("wallet").alias("member"))
    return Found(rows, lambda r: own(r.filter(F.col("typology") == typology)), lambda: rows.select("wallet").distinct())


def strength(ratio: Column, floor: int, cfg: EngineConfig) -> Column:
    """min(cap, round half to even of floor + (cap - floor) * ratio within 0..1)."""
    r = F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))
    return F.least(F.lit(cfg.strength_cap), F.bround(F.lit(float(floor)) + (cfg.strength_cap - floor) * r).cast("int"))


def material(amount: Column, cfg: EngineConfig) -> Column:
    return amount.cast("double") >= dust_limit(F.col("asset"), cfg, native_override=False) * cfg.material_factor


def considered(rows: DataFrame, exempt: DataFrame, tainted: DataFrame | None = None) -> DataFrame:
    """Rows of wallets that are no exempt entity and, if ``tainted`` is given, hold tainted value."""
    rows = rows.join(exempt.select(F.col("address").alias("wallet")).distinct(), "wallet", "left_anti")
    if tainted is not None:
        rows = rows.join(tainted.select(F.col("address").alias("wallet")).distinct(), "wallet", "left_semi")
    return rows


def measured(**cols: Column) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, cols)), F.array(*(c.cast("double") for c in cols.values())))


def outs(transfers: DataFrame, large: list[int] | None = None) -> DataFrame:
    """Per wallet, asset, recipient: amount, and when it was first paid."""
    rows = transfers.select(F.col("from_addr").alias("wallet"), "asset", F.col("to_addr").alias("other"), "value", "ts", "block", "tx_index", "tx_hash")
    added = lambda r: r.groupBy(*QUEUE, "other").agg(F.sum("value").alias("v"), F.min(F.struct("ts", "block", "tx_index", "tx_hash")).alias("first"))
    own, few = split(rows, QUEUE, large_queues(transfers) if large is None else large)
    return added(own) if few is None else added(own).unionByName(added(few))


def leading(transfers: DataFrame, large: list[int] | None = None, cfg: EngineConfig | None = None) -> DataFrame:
    """Per wallet and asset: how many recipients, the one that got most with its amount and share, the next one's share; with
    ``cfg`` also how many transfers were sent and how many of them of round amounts.
    Of recipients that got the same, the one paid first leads: when they were paid is looked up where that decides."""
    large = large_queues(transfers) if large is None else large
    paid = transfers.select(F.col("from_addr").alias("wallet"), "asset", F.col("to_addr").alias("other"), "value")
    counts = {} if cfg is None else {"sent": F.count("*"), "round": F.count(F.when(few_digits(transfers, cfg), 1))}
    added = lambda r: r.groupBy(*QUEUE, "other").agg(F.sum("value").alias("v"), *(c.alias(k) for k, c in counts.items()))
    own, few = split(paid, QUEUE, large)
    rows = added(own) if few is None else added(own).unionByName(added(few))
    place = Window.partitionBy(*QUEUE).orderBy(F.desc("v"), "other")
    whole = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("total", F.sum("v").over(whole)).withColumn("n", F.count("*").over(whole)).withColumn("rank", F.row_number().over(place))
    for c in counts:
        rows = rows.withColumn(c, F.sum(c).over(whole))
    at = lambda rank, c: F.max(F.when(F.col("rank") == rank, F.col(c)))
    by = rows.filter("rank <= 2").groupBy(*QUEUE).agg(F.max("n").alias("recipients"), at(1, "other").alias("next"), at(1, "v").alias("amount"), F.max("total").alias("total"), at(2, "v").alias("second"), *(F.max(c).alias(c) for c in counts))
    by = cut(by)
    tied = cut(by.filter("amount = second").select(*QUEUE))
    earliest = outs(transfers.join(sized(tied.withColumnRenamed("wallet", "from_addr")), ["from_addr", "asset"], "left_semi"), large)
    earliest = cut(earliest.groupBy(*QUEUE).agg(F.min_by("other", F.struct(-F.col("v"), "first", "other")).alias("earliest")))
    share = lambda c: F.col(c).cast("double") / F.col("total").cast("double")
    return by.join(sized(earliest), QUEUE, "left").select(*QUEUE, "recipients", F.coalesce("earliest", "next").alias("next"), "amount", share("amount").alias("share"), share("second").alias("side_share"), *counts)


def peel_links(transfers: DataFrame, cfg: EngineConfig, lead: DataFrame | None = None) -> DataFrame:
    """Wallets that send most on to one recipient and only slices to the others.  ``lead`` is what ``leading``
    finds, if that is at hand."""
    by = leading(transfers) if lead is None else lead
    return by.filter((F.col("recipients") >= 2) & (F.col("share") >= cfg.peel_dominant) & (F.col("side_share") <= cfg.peel_side) & material(F.col("amount"), cfg))


def chained(chains: Chains, typology: str, least: int, ratio: Column, floor: int, measure: Column, cfg: EngineConfig) -> Found:
    """Walks of at least so many links as findings."""
    starts = chains.walks.filter(F.col("links") >= least)
    rows = starts.select(F.lit(typology).alias("typology"), "wallet", "asset", strength(ratio, floor, cfg).alias("strength"), measure.alias("measure"))

    def members(some: DataFrame) -> DataFrame:
        asked = some.filter(F.col("typology") == typology).select("wallet", "asset")
        return chains.places(starts.join(asked, ["wallet", "asset"], "left_semi")).select(F.lit(typology).alias("typology"), "wallet", "asset", "place", "member")

    return Found(rows, members, lambda: chains.covered(starts))


def peel_chains(transfers: DataFrame, exempt: DataFrame, cfg: EngineConfig, tainted: DataFrame | None = None, lead: DataFrame | None = None) -> Found:
    links = considered(peel_links(transfers, cfg, lead), exempt, tainted)
    chains = Chains(links.select("wallet", "asset", "next", "amount", "share"), cfg.peel_growth, least=("share",))
    ratio = 0.55 + 0.25 * (F.col("links") - 3) / 3 + 0.20 * (F.col("share") - 0.8) / 0.2
    return chained(chains, "peel_chain", cfg.peel_links, ratio, 40, measured(links=F.col("links"), least_share=F.col("share")), cfg)


def flow_through(transfers: DataFrame, large: list[int] | None = None) -> DataFrame:
    """Per wallet and asset: sent and received, ratio passed on, median dwell; behind one shuffle but for large queues."""
    large = large_queues(transfers) if large is None else large
    rows = arrivals(transfers, large)
    sums = [F.sum(F.when(F.col("out") == side, F.col("value"))).alias(c) for side, c in ((1, "sent"), (0, "received"))]
    own, few = parted(rows, QUEUE, large)
    place = Window.partitionBy(*QUEUE).orderBy(F.col("dwell").asc_nulls_last())
    whole = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = own.withColumn("pairs", F.count("dwell").over(whole)).withColumn("at", F.row_number().over(place))
    picked = lambda at: F.max(F.when(F.col("at") == F.expr(at), F.col("dwell"))).cast("double")
    middle = ((picked("(pairs - 1) div 2 + 1") + picked("pairs div 2 + 1")) / 2).alias("dwell")
    by = own.groupBy(*QUEUE).agg(*sums, middle, F.max("pairs").alias("pairs"))
    if few is not None:
        by = by.unionByName(few.groupBy(*QUEUE).agg(*sums).join(medians(few, QUEUE, "dwell", "dwell", "pairs", large), QUEUE))
    by = by.filter("sent > 0 and received > 0 and pairs > 0 and wallet is not null and asset is not null")
    return by.withColumn("ratio", F.col("sent").cast("double") / F.col("received").cast("double"))


def layering_links(transfers: DataFrame, cfg: EngineConfig, through: DataFrame | None = None, lead: DataFrame | None = None) -> DataFrame:
    """``through`` and ``lead`` are what ``flow_through`` and ``leading`` find, if that is at hand."""
    large = large_queues(transfers) if through is None or lead is None else None
    best = leading(transfers, large) if lead is None else lead
    rows = flow_through(transfers, large) if through is None else through
    rows = rows.filter(F.col("ratio").between(*cfg.layer_ratio) & F.col("dwell").between(cfg.dwell_low, cfg.dwell_high) & material(F.col("received"), cfg))
    best = best.select("wallet", "asset", "next", "amount")
    return rows.join(best if lead is None else sized(best), ["wallet", "asset"])


def layering(transfers: DataFrame, exempt: DataFrame, cfg: EngineConfig, tainted: DataFrame | None = None, through: DataFrame | None = None, lead: DataFrame | None = None) -> Found:
    links = considered(layering_links(transfers, cfg, through, lead), exempt, tainted)
    chains = Chains(links.select("wallet", "asset", "next", "amount", "dwell"), None, most=("dwell",))
    ratio = 0.5 + 0.5 * (1 - F.col("dwell") / cfg.dwell_high)
    return chained(chains, "layering", cfg.layer_links, ratio, 35, measured(links=F.col("links"), longest_dwell=F.col("dwell")), cfg)


def judged(v, limit: float, mid: float, state: tuple, taken, same) -> tuple:
    """The fold over a group's amounts v in their order, from ``state``: how many are taken, their sum and sum of squares
    (both less the median, so that nothing cancels), their plain sum, the last amount and whether its first was taken."""
    from math import sqrt

    n, s, q, total, last, ok_first = state
    for i, value in enumerate(v):
        x = value - mid
        m, t, u = n + 1, s + x, q + x * x
        mean = mid + t / m
        ok = m < 2 or (mean > 0 and sqrt(max(u / m - (t / m) * (t / m), 0.0)) / mean <= limit)
        if ok:
            n, s, q, total = m, t, u, total + value
        if value != last:  # equal amounts follow each other, and if the first isn't taken none is
            last, ok_first = value, ok
        taken[i], same[i] = ok, ok_first
    return n, s, q, total, last, ok_first


def folded(v, new, limit: float, least: int, together: int = 16):
    """Of amounts v by group (``new``: a group's first), ascending within each: group of each row, which rows are kept, and
    of each group how many rows are kept and taken, the taken ones' mean and standard deviation.  All groups go on
    by one amount at a time, side by side; when fewer than ``together`` have more, each goes on alone."""
    import numpy as np

    starts = np.flatnonzero(new)
    group, size = np.cumsum(new) - 1, np.diff(np.append(starts, len(v)))
    mid = (v[starts + (size - 1) // 2] + v[starts + size // 2]) / 2
    order = np.lexsort((v, np.abs(v - mid[group]), group))
    by_far, few = v[order], (size < max(least, 2)) | ~(mid > 0)
    taken, same = np.zeros(len(v), bool), np.zeros(len(v), bool)
    at = np.argsort(np.where(few, 0, -size), kind="stable")
    length, begin, middle = np.where(few, 0, size)[at], starts[at], mid[at]
    n, s, q, total = np.zeros(len(at), np.int64), np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at))
    last, first_ok = np.full(len(at), np.nan), np.zeros(len(at), bool)
    j = 0
    while (a := int(np.searchsorted(-length, -j))) >= together:  # as many groups have more than j amounts
        value = by_far[begin[:a] + j]
        x = value - middle[:a]
        m, t, u = n[:a] + 1, s[:a] + x, q[:a] + x * x
        mean = middle[:a] + t / m
        with np.errstate(all="ignore"):
            ok = (m < 2) | ((mean > 0) & (np.sqrt(np.maximum(u / m - (t / m) * (t / m), 0.0)) / mean <= limit))
        n[:a], s[:a], q[:a], total[:a] = np.where(ok, m, n[:a]), np.where(ok, t, s[:a]), np.where(ok, u, q[:a]), np.where(ok, total[:a] + value, total[:a])
        first_ok[:a] = np.where(value != last[:a], ok, first_ok[:a])
        last[:a] = value
        taken[begin[:a] + j], same[begin[:a] + j] = ok, first_ok[:a]
        j += 1
    for i in range(a):
        rest = slice(begin[i] + j, begin[i] + length[i])
        state = (int(n[i]), float(s[i]), float(q[i]), float(total[i]), float(last[i]), bool(first_ok[i]))
        n[i], _, _, total[i], _, _ = judged(by_far[rest].tolist(), limit, float(middle[i]), state, taken[rest], same[rest])
    count, mean = np.zeros(len(at), np.int64), np.zeros(len(at))
    count[at] = n
    mean[at] = total / np.maximum(n, 1)
    kept = np.zeros(len(v), bool)
    kept[order] = same
    spread = np.add.reduceat(np.where(taken, (by_far - mean[group]) ** 2, 0.0), starts)
    return group, kept & (count >= least)[group], np.add.reduceat(kept.astype(np.int64), starts), count, mean, np.sqrt(spread / np.maximum(count, 1))


LIKE = "wallet string, asset string, out int, other string, v double, same long, n long, mean double, sd double, head boolean"


def similar(paid: DataFrame, limit: float, least: int, chunk: int = 100_000) -> DataFrame:
    """Of paid (wallet, asset, out, other, v; one row for each counterparty, a group's rows all in one task) those whose
    amounts are alike: nearest the group's median first, each is taken while the spread of those taken stays within the
    limit.  Rows that aren't taken are kept where an equal amount is.  Beside each row: how many of its group are kept (same)
    and taken (n), the taken ones' mean and spread, and whether it is the group's first (head).  Groups of fewer taken than
    ``least`` go.

    Whether a row is taken depends on all taken before, so a group's rows are folded in order."""
    rows = paid.filter("v is not null").select("wallet", "asset", "out", "other", "v").sortWithinPartitions("wallet", "asset", "out", "v")

    def alike(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def differ(a, b):
            either = pc.fill_null(pc.not_equal(a, b), True)
            return pc.and_not(either, pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)

        def first_rows(b, before):
            """Which rows of b begin a group, ``before`` being the row before it."""
            keys = [pa.concat_arrays([before.column(i) if before is not None else b.column(i).slice(0, 1), b.column(i)]) for i in range(3)]
            new = np.zeros(b.num_rows, bool)
            for k in keys:
                new |= differ(k.slice(1), k.slice(0, b.num_rows))
            new[0] |= before is None
            return new

        def done(held):
            rows = pa.Table.from_batches([b for b, _ in held]).combine_chunks()
            group, kept, same, n, mean, sd = folded(rows.column("v").to_numpy(), np.concatenate([x for _, x in held]), limit, least)
            g = group[kept]
            head = np.append(True, g[1:] != g[:-1])[: len(g)]
            rows = rows.filter(pa.array(kept))
            for name, column in (("same", same[g]), ("n", n[g]), ("mean", mean[g]), ("sd", sd[g]), ("head", head)):
                rows = rows.append_column(name, pa.array(column))
            return rows.to_batches()

        held, size, before = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            new = first_rows(b, before)
            before = b.slice(b.num_rows - 1)
            cut_at = int(np.flatnonzero(new)[-1]) if size >= chunk and new.any() else None
            if cut_at is None:
                held.append((b, new))
                size += b.num_rows
                continue
            yield from done([*held, (b.slice(0, cut_at), new[:cut_at])])
            held, size = [(b.slice(cut_at), new[cut_at:])], b.num_rows - cut_at
        if held:
            yield from done(held)

    return rows.mapInArrow(alike, LIKE)


def similar_in_order(paid: DataFrame, limit: float, least: int) -> DataFrame:
    """``similar`` for groups that no task should hold: sorted by distance from the median, a group's rows go by."""
    side = ["wallet", "asset", "out"]
    paid = paid.filter("v is not null")
    mids = medians(paid, side, "v", "mid", "parties").filter((F.col("parties") >= max(least, 2)) & (F.col("mid") > 0))
    rows = paid.join(mids, side).repartition(*side).withColumn("far", F.abs(F.col("v") - F.col("mid")))
    rows = rows.select(*side, "other", "v", "mid", "far").sortWithinPartitions(*side, "far", "v", "other")

    def fold(batches):
        import pyarrow as pa

        at, state = None, None
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in range(3))))
            v, mid = b.column(4).to_pylist(), b.column(5).to_pylist()
            taken, keep, i = [False] * len(v), [False] * len(v), 0
            while i < len(v):
                j = i + 1
                while j < len(v) and keys[j] == keys[i]:
                    j += 1
                if keys[i] != at:
                    at, state = keys[i], (0, 0.0, 0.0, 0.0, None, False)
                some, same = taken[i:j], keep[i:j]
                state = judged(v[i:j], limit, mid[i], state, some, same)
                taken[i:j], keep[i:j], i = some, same, j
            yield b.select([*side, "other", "v"]).append_column("taken", pa.array(taken, pa.bool_())).filter(pa.array(keep, pa.bool_()))

    like = cut(rows.mapInArrow(fold, "wallet string, asset string, out int, other string, v double, taken boolean"))
    own = lambda f: f(F.when(F.col("taken"), F.col("v")))
    by = like.groupBy(*side).agg(F.count("*").alias("same"), own(F.count).alias("n"), own(F.avg).alias("mean"), own(F.stddev_pop).alias("sd"), F.min("other").alias("top"))
    return like.drop("taken").join(by.filter(F.col("n") >= least), side).withColumn("head", F.col("other") == F.col("top")).drop("top")


def structuring(transfers: DataFrame, exempt: DataFrame, cfg: EngineConfig, tainted: DataFrame | None = None, large: list[int] | None = None) -> Found:
    """Many counterparties, like amounts; out and in.  Both directions are shuffled once, and a group's numbers stand beside
    its rows, so that they need no other shuffle."""
    large = large_queues(transfers) if large is None else large
    added = lambda r: r.groupBy(*QUEUE, "other", "out").agg(F.sum("value").cast("double").alias("v"))
    own, few = split(considered(sides(transfers), exempt, tainted), QUEUE, large)
    like = similar(added(own), cfg.structure_cv, cfg.structure_parties)
    if few is not None:
        like = like.unionByName(similar_in_order(cut(added(few)), cfg.structure_cv, cfg.structure_parties))
    like = cut(like)
    kind = F.when(F.col("out") == 1, "structuring_fan_out").otherwise("structuring_fan_in")
    like = like.filter(material(F.col("mean"), cfg)).select(kind.alias("typology"), *QUEUE, "other", "v", "same", "n", "mean", "sd", "head")
    by = like.filter("head").withColumn("cv", F.col("sd") / F.col("mean"))
    ratio = 0.45 + 0.35 * F.least(F.lit(1.0), (F.col("n") - cfg.structure_parties) / 6) + 0.20 * (1 - F.col("cv") / cfg.structure_cv)
    rows = by.select(*KEY, strength(ratio, 35, cfg).alias("strength"), measured(parties=F.col("n"), cv=F.col("cv"), mean=F.col("mean")).alias("measure"))

    def members(some: DataFrame) -> DataFrame:
        """The wallet, then the counterparties whose amounts are in the group, largest first, as many as it has."""
        asked = cut(by.join(some.select(*KEY), KEY, "left_semi").select(*KEY, "same"))
        placed = numbered(like.drop("same").join(sized(asked), KEY), KEY, [F.desc("v"), F.col("other")], "place", large=hot(asked, KEY, count="same"), dealt=True).filter("place < n")
        at = lambda place, member: F.struct(place.cast("long").alias("place"), F.col(member).alias("member"))
        other = at(F.col("place") + 1, "other")
        return placed.select(*KEY, F.inline(F.when(F.col("place") == 0, F.array(at(F.lit(0), "wallet"), other)).otherwise(F.array(other))))

    def involved() -> DataFrame:
        """Places count only where more counterparties have an amount of the group than it has."""
        all_ = like.filter("same = n").select(F.col("other").alias("wallet")).unionByName(by.select("wallet"))
        more = cut(by.filter("same > n").select(*KEY))
        return (all_ if more.isEmpty() else all_.unionByName(members(more).select(F.col("member").alias("wallet")))).distinct()

    return Found(rows, members, involved)


def pass_through(transfers: DataFrame, exempt: DataFrame, cfg: EngineConfig, tainted: DataFrame | None = None, through: DataFrame | None = None) -> Found:
    rows = considered(flow_through(transfers) if through is None else through, exempt, tainted)
    rows = rows.filter(F.col("ratio").between(*cfg.pass_ratio) & F.col("dwell").between(cfg.dwell_low, cfg.dwell_high) & material(F.col("received"), cfg))
    ratio = 0.45 + 0.35 * (1 - F.col("dwell") / cfg.dwell_high) + 0.20 * F.least(F.lit(1.0), F.col("ratio"))
    return alone(rows.select(F.lit("rapid_pass_through").alias("typology"), "wallet", "asset", strength(ratio, 30, cfg).alias("strength"), measured(dwell=F.col("dwell"), ratio=F.col("ratio")).alias("measure")), "rapid_pass_through")


def significant_digits(v: Column, exact: bool = False) -> Column:
    """Digits of the number to 8 places between its first and last that aren't 0; 99 if not positive.  ``exact`` says that
    v is a decimal of at most 8 places: up to 10,000,000 its own digits are those of its double, and cheaper."""
    digits = lambda shown: F.length(F.trim(F.replace(shown, F.lit("."), F.lit("")), F.lit("0")))
    n = digits(F.format_string("%.8f", v.cast("double")))
    if exact:
        n = F.when((v >= 0.001) & (v < 10_000_000), digits(v.cast("string"))).otherwise(n)
    return F.when(v <= 0, 99).otherwise(F.greatest(n, F.lit(1)))


def few_digits(transfers: DataFrame, cfg: EngineConfig) -> Column:
    kind = transfers.schema["value"].dataType
    return significant_digits(F.col("value"), isinstance(kind, DecimalType) and kind.scale <= 8) <= cfg.round_digits


def round_amounts(transfers: DataFrame, exempt: DataFrame, cfg: EngineConfig, tainted: DataFrame | None = None, lead: DataFrame | None = None) -> Found:
    """``lead`` is what ``leading`` finds with ``cfg``, if that is at hand."""
    if lead is None:
        rows = considered(transfers.select(F.col("from_addr").alias("wallet"), "asset", "value"), exempt, tainted)
        by = rows.groupBy("wallet", "asset").agg(F.count("*").alias("n"), F.count(F.when(few_digits(transfers, cfg), 1)).alias("round"))
    else:
        by = considered(lead.select("wallet", "asset", F.col("sent").alias("n"), "round"), exempt, tainted)
    by = by.withColumn("share", F.col("round") / F.col("n")).filter((F.col("n") >= 3) & (F.col("round") >= cfg.round_count) & (F.col("share") >= cfg.round_share))
    return alone(by.select(F.lit("round_amounts").alias("typology"), "wallet", "asset", strength(0.25 + 0.35 * F.col("share"), 15, cfg).alias("strength"), measured(round=F.col("round"), share=F.col("share")).alias("measure")), "round_amounts")


def evidence(transfers: DataFrame, found: DataFrame, cfg: EngineConfig, each: int = 3, rounds: int = 8) -> DataFrame:
    """wallet, asset, typology, side, place and the transfer of what supports a finding: a pass-through's first
    ``each`` incoming and outgoing transfers, the first ``rounds`` round amounts sent."""
    keys, parts = found.select("typology", "wallet", "asset").distinct(), []
    for typology, side, own, shown in (("rapid_pass_through", "in", "to_addr", each), ("rapid_pass_through", "out", "from_addr", each), ("round_amounts", "out", "from_addr", rounds)):
        rows = transfers.withColumn("wallet", F.col(own))
        if typology == "round_amounts":
            rows = rows.filter(significant_digits(F.col("value")) <= cfg.round_digits)
        rows = rows.join(keys.filter(F.col("typology") == typology), ["wallet", "asset"])
        first = Window.partitionBy("wallet", "asset").orderBy(*ORDER)
        rows = rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= shown)
        parts.append(rows.select("typology", "wallet", "asset", F.lit(side).alias("side"), "place", "tx_hash", "from_addr", "to_addr", F.round(F.col("value").cast("double"), 8).alias("value"), "ts"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


DETECTORS = [peel_chains, layering, structuring, pass_through, round_amounts]


def findings(transfers: DataFrame, exempt: DataFrame, cfg: EngineConfig, tainted: DataFrame | None = None) -> Found:
    """All detections; round amounts only where another detection shares a wallet."""
    large = large_queues(transfers)
    through, lead = cut(flow_through(transfers, large)), cut(leading(transfers, large, cfg))
    more = {peel_chains: {"lead": lead}, layering: {"through": through, "lead": lead}, structuring: {"large": large}, pass_through: {"through": through}, round_amounts: {"lead": lead}}
    found = [d(transfers, exempt, cfg, tainted, **more.get(d, {})) for d in DETECTORS]
    others, rounds = found[:-1], found[-1]
    rows, shared = others[0].rows, others[0].involved()
    for f in others[1:]:
        rows, shared = rows.unionByName(f.rows), shared.unionByName(f.involved())
    shared = cut(shared.distinct())
    rows = cut(rows.unionByName(rounds.rows.join(sized(shared), "wallet", "left_semi").select(*rows.columns)))

    def members(some: DataFrame) -> DataFrame:
        out = found[0].members(some)
        for f in found[1:]:
            out = out.unionByName(f.members(some))
        return out

    return Found(rows, members, lambda: shared)


def detect(transfers: DataFrame, exempt: DataFrame, cfg: EngineConfig, tainted: DataFrame | None = None) -> DataFrame:
    """All detections with their members as arrays."""
    return findings(transfers, exempt, cfg, tainted).with_wallets()


def reported(found: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The strongest detections, every typology represented; a report, so one ordered short list."""
    key = [F.desc("strength"), "typology", "wallet", "asset"]
    own = found.withColumn("r", F.row_number().over(Window.partitionBy("typology").orderBy(*key))).filter(F.col("r") <= cfg.reported)
    top = own.orderBy(F.when(F.col("r") == 1, 0).otherwise(1), *key).limit(cfg.reported)
    return top.drop("r")


def summary(found: DataFrame, cfg: EngineConfig) -> DataFrame:
    return found.agg(
        F.count("*").alias("detections"),
        F.greatest(F.count("*") - cfg.reported, F.lit(0)).alias("suppressed"),
        F.sort_array(F.collect_set("typology")).alias("typologies"),
        F.max("strength").alias("strongest"),
    )
