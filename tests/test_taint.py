import random
from collections import defaultdict, deque
from fractions import Fraction

import pytest

from ledgerloom.operators import taint
from tests.books import book


def run(spark, rows, start="S"):
    ev = taint.events(book(spark, rows))
    pos = taint.positions(ev, start)
    t = taint.taint(ev, taint.draws(pos), start)
    return {(r.from_addr, r.to_addr, r.asset): (r.value, r.tainted, r.assumed) for r in taint.edge_taint(ev, pos, t).collect()}


def test_first_in_first_out(spark):
    got = run(spark, [("S", "M", 10, 1000), ("C", "M", 90, 2000), ("M", "X", 50, 3000), ("M", "O", 40, 4000)])
    assert got["M", "X", "ETH"] == pytest.approx((50, 10, 0))
    assert got["M", "O", "ETH"] == pytest.approx((40, 0, 0))


def test_unobserved_balance(spark):
    assert run(spark, [("M", "X", 50, 1000)])["M", "X", "ETH"] == pytest.approx((50, 0, 50))
    assert run(spark, [("S", "M", 10, 1000), ("M", "X", 30, 2000)])["M", "X", "ETH"] == pytest.approx((30, 10, 20))


def test_ties_follow_index_and_assets_never_mix(spark):
    tied = [("S", "M", 10, 1000, {"tx_index": 0}), ("C", "M", 90, 1000, {"tx_index": 1}), ("M", "X", 50, 2000)]
    assert run(spark, tied)["M", "X", "ETH"][1] == pytest.approx(10)
    tied = [("S", "M", 10, 1000, {"tx_index": 1}), ("C", "M", 90, 1000, {"tx_index": 0}), ("M", "X", 50, 2000)]
    assert run(spark, tied)["M", "X", "ETH"][1] == pytest.approx(0)
    got = run(spark, [("S", "M", 10, 1000, {"asset": "USDT"}), ("M", "X", 5, 2000)])
    assert got["M", "X", "ETH"] == pytest.approx((5, 0, 5))


def test_partial_lots_and_dilution(spark):
    got = run(spark, [("S", "M", 100, 1000), ("M", "X", 25, 2000), ("M", "O", 25, 3000)])
    assert got["M", "X", "ETH"][1] == got["M", "O", "ETH"][1] == pytest.approx(25)
    got = run(spark, [("S", "M", 198, 1000), ("C", "M", 17771, 2000), ("M", "B", 17969, 3000)])
    assert got["M", "B", "ETH"] == pytest.approx((17969, 198, 0))


def sequential(rows, start):
    """The rule as a queue, in exact numbers."""
    lots, out = defaultdict(deque), defaultdict(lambda: [Fraction(0), Fraction(0)])
    for a, b, v, _ in sorted(rows, key=lambda r: r[3]):
        v, need, t = Fraction(str(v)), Fraction(str(v)), Fraction(0)
        if a == start:
            t, need = v, Fraction(0)
        while need and lots[a]:
            n, tn = lots[a].popleft()
            k = min(n, need)
            t += tn * k / n
            need -= k
            if n > k:
                lots[a].appendleft((n - k, tn * (n - k) / n))
        lots[b].append((v, t))
        out[a, b][0] += t
        out[a, b][1] += need
    return out


def test_windows_equal_the_queue_on_random_ledgers(spark):
    rng = random.Random(3)
    rows = [(a, b, rng.randint(1, 50), i) for i in range(150) for a, b in [rng.sample(["S", "A", "B", "C", "D"], 2)]]
    got = run(spark, rows)
    want = sequential(rows, "S")
    for (a, b), (t, short) in want.items():
        assert got[a, b, "ETH"][1:] == pytest.approx((float(t), float(short)), abs=1e-6)
