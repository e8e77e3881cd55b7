"""Chains of draws and of links longer than any number of rounds, against walks one step at a time."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import graph, taint
from tests.books import book
from tests.test_taint import run, sequential

SF = "/root/testdata/sf0.001"


def test_taint_passed_back_and_forth_is_followed_to_its_end(spark):
    rows = [("S", "A", 100, 0)] + [("AB"[i % 2], "BA"[i % 2], 100 - i, i + 1) for i in range(80)] + [("A", "X", 20, 100)]
    got = run(spark, rows)
    assert got["A", "X", "ETH"] == pytest.approx((20, 20, 0))
    for (a, b), (t, short) in sequential(rows, "S").items():
        assert got[a, b, "ETH"][1:] == pytest.approx((float(t), float(short)), abs=1e-6)


def test_ten_thousand_draws_in_a_row(spark):
    """A chain of 10,000 draws of one asset: few rounds, no task that takes the asset whole."""
    n = 10_000
    weight = spark.range(1, n + 1).select(F.concat(F.lit("e"), F.col("id")).alias("debit"), F.concat(F.lit("e"), F.col("id") - 1).alias("credit"), F.lit(1.0).alias("w"))
    got = taint.doubled(weight.repartition(4), spark.createDataFrame([("e0", 7.0)], "event string, t double"))
    assert got.count() == n + 1 and got.filter("abs(t - 7) < 1e-9").count() == n + 1


def test_mixed_queues_go_on_in_strides(spark):
    rows = [("S", "A", 100, 0), ("S", "B", 70, 0)] + [("AB"[i % 2], "BA"[i % 2], 30 + 7 * i % 41, i + 1) for i in range(400)]
    ev = taint.events(book(spark, rows))
    pos = taint.positions(ev, "S")
    t = taint.taint(ev, taint.draws(pos), "S", max_rounds=4, fill=2)
    got = {(r.from_addr, r.to_addr): r.tainted for r in taint.edge_taint(ev, pos, t).collect()}
    for k, (want, _) in sequential(rows, "S").items():
        assert got[k] == pytest.approx(float(want), abs=1e-6)


def test_rest_by_doubling_equals_the_queue(spark):
    rng = random.Random(5)
    rows = [(a, b, rng.randint(1, 50), i) for i in range(200) for a, b in [rng.sample(["S", "A", "B", "C", "D"], 2)]]
    ev = taint.events(book(spark, rows))
    pos = taint.positions(ev, "S")
    t = taint.taint(ev, taint.draws(pos), "S", max_rounds=2)
    got = {(r.from_addr, r.to_addr): r.tainted for r in taint.edge_taint(ev, pos, t).collect()}
    for k, (want, _) in sequential(rows, "S").items():
        assert got[k] == pytest.approx(float(want), abs=1e-6)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_taint_query_equals_the_queue(spark):
    from ledgerloom.plans import queries as q

    ev = taint.events(q.ledger(spark, SF)).cache()
    place = lambda r: (r.ts, r.block, r.tx_index, r.tx_hash, r.asset, r.from_addr, r.to_addr, r.value, r.copy)
    rows = ev.collect()
    order = {e: i for i, e in enumerate(sorted(map(place, rows)))}
    want = {}
    for asset in {r.asset for r in rows}:
        want |= by_event([(r.event, r.from_addr, r.to_addr, r.value, order[place(r)]) for r in rows if r.asset == asset], q.START)
    got = {r.event: r.tainted for r in q.QUERIES["T4_fifo_taint"](spark, SF).collect()}
    assert set(got) == {e for e, t in want.items() if t}
    assert all(got[e] == pytest.approx(float(want[e]), abs=0.006) for e in got)


def by_event(rows, start):
    from collections import defaultdict, deque
    from fractions import Fraction

    lots, out = defaultdict(deque), {}
    for event, a, b, v, _ in sorted(rows, key=lambda r: r[4]):
        v = need = Fraction(v)
        t = v if a == start else Fraction(0)
        while a != start and need and lots[a]:
            n, tn = lots[a].popleft()
            k = min(n, need)
            t += tn * k / n
            need -= k
            if n > k:
                lots[a].appendleft((n - k, tn * (n - k) / n))
        lots[b].append((v, t))
        out[event] = t
    return out


def plain(links, grows):
    out = {}
    for (w, a), (n, m) in links.items():
        path, amounts = [w, n], [m]
        while (path[-1], a) in links:
            n, m = links[path[-1], a]
            if n in path or (grows is not None and m > amounts[-1] * grows):
                break
            path.append(n)
            amounts.append(m)
        out[w, a] = (path, amounts)
    return out


@pytest.mark.parametrize("grows", [None, 1.5])
def test_chains_are_walked_to_their_end(spark, grows):
    rng = random.Random(9)
    links = {(f"L{i}", "ETH"): (f"L{i + 1}", 1000.0 - i) for i in range(150)}
    links |= {(f"C{i}", "ETH"): (f"C{(i + 1) % 90}", 5.0) for i in range(90)}
    links |= {(f"R{i}", a): (f"R{rng.randrange(60)}", float(rng.randint(1, 9))) for i in range(60) for a in ("ETH", "DAI")}
    rows = spark.createDataFrame([(w, a, n, m) for (w, a), (n, m) in links.items()], "wallet string, asset string, next string, amount double")
    got = {(r.wallet, r.asset): (r.path, r.amounts) for r in graph.chains(rows, grows).collect()}
    assert got == plain(links, grows)
    assert len(got["L0", "ETH"][0]) == 151


def test_one_chain_of_a_hundred_thousand_links(spark):
    from ledgerloom.operators.chains import Chains

    n = 100_000
    k = F.col("id")
    links = spark.range(n).select(F.concat(F.lit("c"), k).alias("wallet"), F.lit("ETH").alias("asset"), F.concat(F.lit("c"), k + 1).alias("next"), F.lit(1.0).alias("amount"), (1 - k / (2 * n)).alias("share"))
    own = Chains(links.repartition(4), 1.05, least=("share",))
    w = own.walks
    assert w.count() == w.filter(f"links = {n} - int(substr(wallet, 2)) and last = 'c{n}'").count() == n
    assert w.agg(F.max(F.abs(F.col("share") - (1 - (n - 1) / (2 * n))))).first()[0] < 1e-12
    path = own.places(w.filter("wallet = 'c0'"))
    assert path.count() == path.filter("member = concat('c', place)").count() == n + 1
    assert own.covered(w.filter(f"links > {n} - 3")).count() == n + 1


def test_a_break_at_the_end_of_a_circle(spark):
    """Three in a circle whose closing link grows too much: it isn't followed, and it leads back, so it isn't walked."""
    links = {("a", "ETH"): ("b", 10.0), ("b", "ETH"): ("c", 9.0), ("c", "ETH"): ("a", 1.0), ("z", "ETH"): ("b", 9.0)}
    rows = spark.createDataFrame([(w, a, x, m) for (w, a), (x, m) in links.items()], "wallet string, asset string, next string, amount double")
    got = {(r.wallet, r.asset): (r.path, r.amounts) for r in graph.chains(rows, 1.5).collect()}
    want = {}
    for w, a in links:
        path, amounts, at = [w], [], w
        while (at, a) in links:
            x, m = links[at, a]
            if x in path or (amounts and m > amounts[-1] * 1.5):
                break
            path.append(x)
            amounts.append(m)
            at = x
        want[w, a] = (path, amounts)
    assert got == want
