"""First-in-first-out attribution in windows.

Per wallet and asset, with running debits O and credits I in event order, what was never seen coming in
is S = max(0, running max of O - I).  A debit eats the queue's stretch [O' - S', O - S) (primes: before
it), a credit fills [I', I).  Cutting both into common stretches gives the draws.  A lot's taint is
spread evenly, so a debit's taint is the sum over its draws of amount / credit * the credit's taint: a
linear system that ends in as many rounds as the longest chain of draws.  What is left after a number of
rounds is solved by doubling the draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ledger import ORDER
from .checkpoints import cut
from .flows import QUEUE, large_queues
from .ordering import Ranges, hot

MONEY = "decimal(38,8)"


def _named(*more: str | Column) -> Column:
    return F.concat_ws("|", "ts", "block", "tx_index", "tx_hash", "asset", "from_addr", "to_addr", F.col("value").cast("string"), *more)


def events(transfers: DataFrame, number: str | None = None) -> DataFrame:
    """Transfers with an id of their own: equal rows are numbered, in the order of the column ``number`` if there is one."""
    fields = [c for c in ORDER if c != "tx_hash"]
    w = Window.partitionBy("tx_hash").orderBy(*fields)
    of = w if number is None else Window.partitionBy("tx_hash").orderBy(*fields, number)
    rows = transfers.withColumn("copy", F.row_number().over(of) - F.rank().over(w) + 1)
    return rows.withColumn("event", _named("copy"))


def kept(transfers: DataFrame) -> DataFrame:
    """Transfers written once, with a number each as their id: eight bytes where ``events`` has all fields."""
    return cut(transfers.select(*ORDER).withColumn("event", F.monotonically_increasing_id()))


def positions(ev: DataFrame, start: str, named: bool = True, large: list[int] | None = None) -> DataFrame:
    """Each event at its wallets: the stretch of the queue it eats or fills, and its shortfall.  Running
    sums and the running maximum go over ranges of a hot wallet's time, so it is many tasks' work.  What is
    shuffled is the order's fields once; an event's name (unless ``named`` is false: its number, of ``kept``) is
    made of them behind that."""
    own = "copy" if "copy" in ev.columns else "event"
    cols = ["asset", "ts", "block", "tx_index", "tx_hash", "value", own]
    debit = ev.filter(F.col("from_addr") != start).select(F.col("from_addr").alias("wallet"), F.col("to_addr").alias("other"), *cols, F.lit(1).alias("out"))
    credit = ev.select(F.col("to_addr").alias("wallet"), F.col("from_addr").alias("other"), *cols, F.lit(0).alias("out"))
    value, zero = F.col("value").cast(MONEY), F.lit(0).cast(MONEY)
    is_out = F.col("out") == 1
    ends = {"from_addr": F.when(is_out, F.col("wallet")).otherwise(F.col("other")), "to_addr": F.when(is_out, F.col("other")).otherwise(F.col("wallet"))}
    keys = [c for c in ORDER if c != "asset"]
    number = named and own == "event"  # copies of an event are numbered here

    def local(rows, run, place):
        rows = rows.withColumn("o", F.sum(F.when(is_out, value).otherwise(zero)).over(run)).withColumn("i", F.sum(F.when(is_out, zero).otherwise(value)).over(run))
        rows = rows.withColumn("d", F.max(F.col("o") - F.col("i")).over(run))
        rows = rows.withColumn("d0", F.lag("d").over(place))
        within = [c for c in rows.columns if c == "range_"] + QUEUE
        if number:
            rows = rows.withColumn("copy", F.dense_rank().over(Window.partitionBy(*within, *keys).orderBy("event")))
        if named:
            rows = rows.withColumn("event", _named("copy"))
        return rows.select(*within, "other", "event", "value", "out", "o", "i", "d", "d0")

    def carry(table, before, whole):
        table = table.withColumn("o_", F.coalesce(F.sum("o").over(before), zero)).withColumn("i_", F.coalesce(F.sum("i").over(before), zero))
        return table.withColumn("d_", F.max(F.col("o_") - F.col("i_") + F.col("d")).over(before))

    most = [F.max(c).alias(c) for c in ("o", "i", "d")]  # sums never fall, so the last is the largest
    large = large_queues(ev) if large is None else large
    border = len(keys) if number else None
    rows = Ranges(debit.unionByName(credit), QUEUE, [*keys, own, "out"], local, large=large, wider=lambda r: r.withColumns(ends), border=border).carried(most, carry)
    o_, i_, d_ = (F.coalesce(c, zero) for c in ("o_", "i_", "d_"))
    s = F.greatest(zero, d_, o_ - i_ + F.col("d"))
    s0 = F.greatest(zero, d_, o_ - i_ + F.col("d0"))  # greatest leaves out the null of a range's first row
    rows = rows.select(*QUEUE, "other", "event", "value", "out", (o_ + F.col("o")).alias("o"), (i_ + F.col("i")).alias("i"), s.alias("s"), s0.alias("s0"))
    return rows.select(
        *QUEUE, "other", "event", "value", "out",
        F.when(is_out, F.col("o") - value - F.col("s0")).otherwise(F.col("i") - value).alias("lo"),
        F.when(is_out, F.col("o") - F.col("s")).otherwise(F.col("i")).alias("hi"),
        F.when(is_out, F.col("s") - F.col("s0")).otherwise(zero).alias("shortfall"),
    )


def draws(pos: DataFrame, large: list[int] | None = None, short: bool = False) -> DataFrame:
    """debit, credit, amount, credit_value: common stretches, by one sweep over ranges of the queue (no pair
    of debit and credit is made but those that overlap).  With ``short`` the same pass also gives what
    ``shortfalls`` does, added up by recipient: rows of their own, with columns to and shortfall and no debit."""
    is_out = F.col("out") == 1
    debit = F.when(is_out, F.struct(F.col("event").alias("id"), "hi"))
    credit = F.when(~is_out, F.struct(F.col("event").alias("id"), "hi", "value"))
    large = hot(pos, QUEUE) if large is None else large

    def local(rows, run, place):
        last = lambda c: F.last(c, ignorenulls=True).over(run)
        return rows.withColumn("next", F.lead("lo").over(place)).withColumn("d", last("d")).withColumn("c", last("c"))

    def carry(table, before, whole):
        table = table.withColumn("d_", F.last("d", ignorenulls=True).over(before)).withColumn("c_", F.last("c", ignorenulls=True).over(before))
        return table.withColumn("next_", F.lead("first").over(whole.orderBy("range_")))

    if short:  # they stand before all places of their queue, so the sweep doesn't see them
        p = pos.select(*QUEUE, F.inline(_points(debit, credit)))
        points = p.groupBy(*QUEUE, "lo", "to").agg(F.max("debit").alias("d"), F.max("credit").alias("c"), F.sum("shortfall").alias("shortfall"))
    else:
        points = pos.filter("hi > lo").groupBy(*QUEUE, "lo").agg(F.max(debit).alias("d"), F.max(credit).alias("c"))
    more = ["to", "shortfall"] if short else []
    own = [F.max_by("d", "lo").alias("d"), F.max_by("c", "lo").alias("c"), F.min("lo").alias("first")]
    # positions are distributed by queue, unless they are read from files: then the window's own shuffle does it
    now = Ranges(points, QUEUE, ["lo", *more[:1]], local, large=large, dealt=True).carried(own, carry)
    now = now.select(*QUEUE, "lo", F.coalesce("next", "next_").alias("next"), F.coalesce("d", "d_").alias("d"), F.coalesce("c", "c_").alias("c"), *more)
    hi = F.least("next", "d.hi", "c.hi")  # the last point has no next
    now = now.withColumn("amount", hi - F.col("lo"))
    now = now.filter("(lo is not null and d is not null and c is not null and amount > 0)" + (" or shortfall is not null" if short else ""))
    return now.select(*QUEUE, F.col("d.id").alias("debit"), F.col("c.id").alias("credit"), "amount", F.col("c.value").alias("credit_value"), *more)


def _points(debit: Column, credit: Column) -> Column:
    """A position's rows for the sweep: its place, where it eats or fills anything, and its shortfall, where there is one."""
    no = lambda c: F.when(F.lit(False), c)
    place = F.struct("lo", no(F.col("other")).alias("to"), debit.alias("debit"), credit.alias("credit"), no(F.col("shortfall")).alias("shortfall"))
    own = F.struct(no(F.col("lo")).alias("lo"), F.col("other").alias("to"), no(debit).alias("debit"), no(credit).alias("credit"), F.col("shortfall").alias("shortfall"))
    moves, lacks = F.col("hi") > F.col("lo"), (F.col("out") == 1) & (F.col("shortfall") > 0)
    return F.when(moves & lacks, F.array(place, own)).when(moves, F.array(place)).when(lacks, F.array(own))


def doubled(weight: DataFrame, seeds: DataFrame, fill: int = 8) -> DataFrame:
    """event, t: the seeds (event, t) and all that follows from them along the draws weight (debit, credit, w).

    Chains of draws may be of any length, so draws are composed: after k rounds a table holds the draws over
    2^k steps and the sum the first 2^k steps' taint.  Where queues mix, composed draws grow in number; once
    they are more than ``fill`` times the first ones, or none are left, the rest goes on in strides of that
    length.  Joins and sums alone; the draws of one asset are all tasks' work."""
    own = lambda v: v.groupBy("event").agg(F.sum("t").alias("t"))
    step = lambda m, v: m.join(v, m.credit == v.event).groupBy(F.col("debit").alias("event")).agg(F.sum(F.col("w") * F.col("t")).alias("t"))
    jump, first, total = weight, weight.count(), seeds
    while True:
        more = cut(step(jump, total))
        if more.isEmpty():
            return total
        total = cut(own(total.unionByName(more)))
        far = jump.alias("x").join(jump.alias("y"), F.col("x.credit") == F.col("y.debit"))
        far = cut(far.groupBy("x.debit", "y.credit").agg(F.sum(F.col("x.w") * F.col("y.w")).alias("w")))
        n = far.count()
        if not n:
            return total
        jump = far
        if n > fill * first:
            break
    parts, now = [total], total
    while True:
        now = cut(step(jump, now))
        if now.isEmpty():
            break
        parts.append(now)
        if len(parts) > 32:
            parts = [cut(own(_union(parts)))]
    return own(_union(parts))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def taint(ev: DataFrame, drawn: DataFrame, start: str, max_rounds: int = 16, fill: int = 8) -> DataFrame:
    """event, tainted: everything the start sends is its own; the rest follows the draws.  Chains of draws
    longer than ``max_rounds`` are followed to their end by ``doubled``."""
    weight = drawn.select("debit", "credit", (F.col("amount").cast("double") / F.col("credit_value").cast("double")).alias("w"))
    weight = cut(weight)
    now = cut(ev.filter(F.col("from_addr") == start).select("event", F.col("value").cast("double").alias("t")))
    parts = [now]
    for _ in range(max_rounds):
        now = cut(weight.join(now, weight.credit == now.event).groupBy(F.col("debit").alias("event")).agg(F.sum(F.col("w") * F.col("t")).alias("t")))
        if now.isEmpty():
            break
        parts.append(now)
    else:
        parts[-1] = doubled(weight, now, fill)
    return _union(parts).groupBy("event").agg(F.sum("t").alias("tainted"))


def shortfalls(pos: DataFrame) -> DataFrame:
    """from_addr, to_addr, asset, shortfall of the debits that have one."""
    return pos.filter("out = 1 and shortfall > 0").select(F.col("wallet").alias("from_addr"), F.col("other").alias("to_addr"), "asset", "shortfall")


def edge_taint(ev: DataFrame, pos: DataFrame, tainted: DataFrame, short: DataFrame | None = None) -> DataFrame:
    """Per sender, recipient, asset: value, tainted value, value assumed to have been there before (of pos, unless
    ``shortfalls`` are at hand).  Both are added up together, so no event is joined with its position."""
    key = ["from_addr", "to_addr", "asset"]
    short = shortfalls(pos) if short is None else short
    rows = ev.join(tainted, "event", "left").select(*key, "value", "tainted", F.lit(None).cast(MONEY).alias("shortfall"), F.lit(1).alias("n"))
    rows = rows.unionByName(short.select(*key, F.lit(None).cast(ev.schema["value"].dataType).alias("value"), F.lit(None).cast("double").alias("tainted"), F.col("shortfall").cast(MONEY).alias("shortfall"), F.lit(0).alias("n")))
    return rows.groupBy(*key).agg(
        F.sum("value").cast("double").alias("value"),
        F.coalesce(F.sum("tainted"), F.lit(0.0)).alias("tainted"),
        F.coalesce(F.sum("shortfall"), F.lit(0)).cast("double").alias("assumed"),
        F.sum("n").alias("events"),
    )


def node_taint(rows: DataFrame) -> DataFrame:
    """Per recipient and asset: received, of it tainted, the share; rows are those of edges or of events."""
    n = rows.groupBy(F.col("to_addr").alias("address"), "asset").agg(F.sum("value").cast("double").alias("received"), F.sum("tainted").alias("tainted"))
    return n.withColumn("fraction", F.when(F.col("received") > 0, F.col("tainted") / F.col("received")).otherwise(0.0))


def cap_hops(hops: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """A hop's taint: the replay counts dust, the hop doesn't, so no more than the hop's value."""
    t = edge_rows.select("from_addr", "to_addr", "asset", F.col("tainted").alias("t"))
    return hops.join(t, ["from_addr", "to_addr", "asset"], "left").withColumn("tainted", F.least(F.coalesce("t", F.lit(0.0)), F.col("value").cast("double"))).drop("t")


def accounting(ev: DataFrame, pos: DataFrame, tied: DataFrame | None) -> DataFrame:
    """One row: how the replay was done and how much rests on assumptions; of ties only if they are given."""
    a = ev.agg(F.count("*").alias("events_replayed"))
    b = pos.agg(F.countDistinct("wallet").alias("wallets"), F.sum("shortfall").cast("double").alias("assumed_pre_existing"))
    one = lambda d: d.withColumn("k", F.lit(1))
    rows = one(a).join(one(b), "k")
    if tied is not None:
        rows = rows.join(one(tied.agg(F.coalesce(F.sum("value"), F.lit(0)).cast("double").alias("tie_broken"))), "k")
    return rows.drop("k").withColumn("rule", F.lit("fifo"))
