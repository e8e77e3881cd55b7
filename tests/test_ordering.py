"""Running values over ranges against single windows, with a wallet that holds most rows."""

import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import flows, ordering, taint
from tests.books import book
from tests.test_taint import sequential


def hot_book(spark, n=3000):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        other = f"w{rng.randrange(40)}"
        a, b = ("HOT", other) if rng.random() < 0.5 else (other, "HOT")
        if rng.random() < 0.1:
            a, b = rng.sample(["S", "w1", "w2", "w3"], 2)
        rows.append((a, b, rng.randint(1, 50), i // 3))
    return book(spark, rows).repartition(8).cache(), rows


def plain_positions(ev, start):
    """The same by one window for each wallet and asset."""
    at = F.struct(*map(F.col, ("ts", "block", "tx_index", "tx_hash", "asset", "from_addr", "to_addr", "value", "copy")))
    both = ev.filter(F.col("from_addr") != start).select(F.col("from_addr").alias("wallet"), "asset", "event", "value", at.alias("at"), F.lit(1).alias("out"))
    both = both.unionByName(ev.select(F.col("to_addr").alias("wallet"), "asset", "event", "value", at.alias("at"), F.lit(0).alias("out")))
    place = Window.partitionBy("wallet", "asset").orderBy("at", "out")
    run = place.rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("o", F.sum(F.when(F.col("out") == 1, F.col("value")).otherwise(0)).over(run)).withColumn("i", F.sum(F.when(F.col("out") == 0, F.col("value")).otherwise(0)).over(run))
    rows = rows.withColumn("s", F.greatest(F.max(F.col("o") - F.col("i")).over(run), F.lit(0))).withColumn("s0", F.coalesce(F.lag("s").over(place), F.lit(0)))
    out = F.col("out") == 1
    return rows.select(
        "wallet", "event", "out", F.when(out, F.col("o") - F.col("value") - F.col("s0")).otherwise(F.col("i") - F.col("value")).cast("double").alias("lo"),
        F.when(out, F.col("o") - F.col("s")).otherwise(F.col("i")).cast("double").alias("hi"), F.when(out, F.col("s") - F.col("s0")).otherwise(0).cast("double").alias("short"),
    )


def test_positions_of_a_hot_wallet_are_many_tasks_work(spark):
    t, _ = hot_book(spark)
    ev = taint.events(t)
    got = taint.positions(ev, "S")
    shown = got.select("wallet", "event", "out", *(F.col(c).cast("double").alias(n) for c, n in (("lo", "lo"), ("hi", "hi"), ("shortfall", "short"))))
    assert sorted(map(tuple, shown.collect())) == sorted(map(tuple, plain_positions(ev, "S").collect()))
    keys = ["at", "out"]
    both = ev.select(F.col("to_addr").alias("wallet"), "asset", F.col("ts").alias("at"), F.lit(0).alias("out"))
    dealt = ordering.Ranges(both, ["wallet", "asset"], keys, lambda rows, run, place: rows).rows
    assert dealt.filter("wallet = 'HOT'").select("range_").distinct().count() >= 2


def test_draws_of_a_hot_wallet_equal_the_queue(spark):
    rng = random.Random(12)
    rows = [(*(("HOT", f"w{rng.randrange(5)}") if i % 2 else (rng.choice(["S", "w1", "w2"]), "HOT")), rng.randint(1, 50), i) for i in range(400)]
    ev = taint.events(book(spark, rows))
    pos = taint.positions(ev, "S")
    t = taint.taint(ev, taint.draws(pos), "S")
    got = {(r.from_addr, r.to_addr): (r.tainted, r.assumed) for r in taint.edge_taint(ev, pos, t).collect()}
    for (a, b), (tainted, short) in sequential(rows, "S").items():
        assert got[a, b] == pytest.approx((float(tainted), float(short)), abs=1e-6)


def test_dwell_and_median_of_a_hot_wallet(spark):
    t, rows = hot_book(spark)
    arrived, gaps = {}, []
    by_time = sorted([(ts, 0, b) for _, b, _, ts in rows] + [(ts, 1, a) for a, _, _, ts in rows])
    for ts, out, w in by_time:
        if not out:
            arrived[w] = ts
        elif w in arrived:
            gaps.append((w, ts - arrived[w]))
    d = flows.dwell(t)
    assert sorted((r.wallet, r.dwell) for r in d.collect()) == sorted(gaps)
    got = {r.wallet: (r.dwell, r.pairs) for r in ordering.medians(d, ["wallet", "asset"], "dwell", "dwell", "pairs").collect()}
    for w in {w for w, _ in gaps}:
        own = [g for x, g in gaps if x == w]
        assert got[w] == (statistics.median(own), len(own))


def test_median_plan_holds_no_whole_group(spark):
    t, _ = hot_book(spark, 100)
    plan = ordering.medians(flows.dwell(t), ["wallet", "asset"], "dwell", "dwell", "pairs")._jdf.queryExecution().toString().lower()
    assert "median(" not in plan and "percentile" not in plan and "collect_list" not in plan


@pytest.mark.parametrize("group", [[], ["g"]])
def test_numbers_equal_one_window(spark, group):
    rng = random.Random(13)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(500)]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(6)
    got = ordering.numbered(df, group, ["v", F.desc("i")], "place", "n")
    w = Window.partitionBy(*group).orderBy("v", F.desc("i"))
    want = df.withColumn("place", F.row_number().over(w).cast("long") - 1).withColumn("n", F.count("*").over(Window.partitionBy(*group)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_numbers_of_an_empty_table(spark):
    assert ordering.numbered(spark.createDataFrame([], "g string, v int"), ["g"], ["v"], size="n").count() == 0
