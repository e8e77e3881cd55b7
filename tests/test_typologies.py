from ledgerloom.config import EngineConfig
from ledgerloom.operators import typologies as T
from tests.books import book, labels

CFG = EngineConfig()


def found(spark, rows, tags=(), tainted=None):
    no = labels(spark, list(tags))
    return {(r.typology, tuple(r.wallets)) for r in T.detect(book(spark, rows), no, CFG, tainted).collect()}


def peel(dominant=0.9, hops=4):
    rows, v = [], 100.0
    for i in range(hops):
        rows += [(f"P{i}", f"P{i + 1}", round(v * dominant, 6), 10**6 * i), (f"P{i}", f"side{i}", round(v * (1 - dominant), 6), 10**6 * i + 5)]
        v *= dominant
    return rows


def test_peel_chain_and_near_misses(spark):
    assert any(t == "peel_chain" and len(w) == 5 for t, w in found(spark, peel()))
    assert not any(t == "peel_chain" for t, _ in found(spark, peel(0.7)))
    assert not any(t == "peel_chain" for t, _ in found(spark, peel(hops=2)))


def test_layering_needs_quick_hops(spark):
    quick = [(f"A{i}", f"A{i + 1}", 50, 300 * i) for i in range(5)]
    assert any(t == "layering" for t, _ in found(spark, quick))
    assert not any(t == "layering" for t, _ in found(spark, [(a, b, v, ts * 2016) for a, b, v, ts in quick]))


def test_structuring(spark):
    out = [("A", f"R{i}", 500 + i % 3, i) for i in range(8)]
    # the hub, then the like counterparties, largest first
    assert ("structuring_fan_out", ("A", "R2", "R5", "R1", "R4", "R7", "R0", "R3", "R6")) in found(spark, out)
    inn = [(f"R{i}", "A", 250, i) for i in range(7)]
    assert ("structuring_fan_in", ("A", *(f"R{i}" for i in range(7)))) in found(spark, inn)
    assert not any(t.startswith("structuring") for t, _ in found(spark, [("A", f"R{i}", 100 + 12 * i, i) for i in range(8)]))
    assert not any(t.startswith("structuring") for t, _ in found(spark, out, [("A", "X", "exchange")]))


def test_pass_through(spark):
    assert ("rapid_pass_through", ("A1",)) in found(spark, [("A0", "A1", 40, 0), ("A1", "A2", 39, 120)])
    assert not found(spark, [("A0", "A1", 100, 0), ("A1", "A2", 10, 120)])
    assert not found(spark, [("A0", "A1", 40, 0), ("A1", "A2", 39, 0)])


def test_round_amounts_only_with_another_pattern(spark):
    assert not found(spark, [("A", "B", 10, 0), ("A", "C", 20, 1), ("A", "D", 50, 2)])
    got = found(spark, [("A", f"R{i}", 500, i) for i in range(8)])
    assert ("round_amounts", ("A",)) in got and ("structuring_fan_out", ("A", *(f"R{i}" for i in range(8)))) in got


def test_tainted_only(spark):
    rows = [("A", f"R{i}", 500, i) for i in range(8)]
    other = spark.createDataFrame([("Z",)], "address string")
    assert found(spark, rows, tainted=other) == set()
