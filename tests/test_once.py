"""What is written and shuffled once."""

import random
import statistics
from collections import Counter

from ledgerloom.config import EngineConfig
from ledgerloom.operators import entities, flows, graph, ordering, taint, typologies
from ledgerloom.operators.checkpoints import cut
from ledgerloom.plans import trace
from tests.books import book, labels


def moves(n=600):
    rng = random.Random(5)
    rows = [(*(("HOT", f"w{rng.randrange(9)}") if i % 2 else (rng.choice(["S", "w1", "w2"]), "HOT")), rng.randint(1, 50), i // 4) for i in range(n)]
    return rows + [(a, b, v, t, {"hash": f"same{i % 8}"}) for i, (a, b, v, t) in enumerate(rows[:40] * 2)]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_cut_computes_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    assert cut(spark.range(100).mapInArrow(count, "id long")).count() == 100
    assert seen.value == 100


def test_events_by_number_have_the_same_names_positions_and_draws(spark):
    t = book(spark, moves()).repartition(4)
    ev, kept = taint.events(t), taint.kept(t)
    assert ordering.hot(kept.selectExpr("to_addr as wallet", "asset"), taint.QUEUE)
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    want = taint.positions(ev, "S")
    for large in (None, []):
        got = taint.positions(kept, "S", large=large)
        assert rows(got) == rows(want)
        assert rows(taint.draws(got, large)) == rows(taint.draws(want))
    numbers = taint.positions(kept, "S", named=False)
    assert rows(numbers.drop("event")) == rows(want.drop("event"))
    named = taint.events(kept.withColumnRenamed("event", "id"), "id").select("id", "event")
    again = numbers.withColumnRenamed("event", "id").join(named, "id").drop("id")
    assert rows(again) == rows(want)


def test_positions_and_draws_are_one_shuffle(spark):
    kept = taint.kept(book(spark, moves(40)))
    pos = taint.positions(kept, "S", large=[])
    assert exchanges(pos) == 1
    assert exchanges(taint.draws(pos, [])) == 1


def test_taint_by_number_equals_taint_by_name(spark):
    t = book(spark, moves(200))
    ev, kept = taint.events(t), taint.kept(t)
    by = lambda e, pos: taint.edge_taint(e, pos, taint.taint(e, taint.draws(pos), "S"))
    rows = lambda df: sorted((r.from_addr, r.to_addr, r.asset, r.value, round(r.tainted, 6), r.assumed, r.events) for r in df.collect())
    assert rows(by(ev, taint.positions(ev, "S"))) == rows(by(kept, taint.positions(kept, "S", named=False)))


def test_totals_dwell_and_recipients_are_one_shuffle_each(spark):
    t = cut(book(spark, moves(40)))
    assert exchanges(flows.totals(t, [])) == 1
    assert exchanges(typologies.outs(t, [])) == 1
    assert exchanges(ordering.medians(flows.dwell(t, []), taint.QUEUE, "dwell", "dwell", "pairs", [], dealt=True)) == 1


def test_totals_of_hot_queues_are_the_same(spark):
    t = book(spark, moves()).repartition(4)
    assert flows.large_queues(t)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(flows.totals(t)) == rows(flows.totals(t, []))
    assert rows(typologies.outs(t)) == rows(typologies.outs(t, []))


def test_structuring_shuffles_both_directions_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(typologies, "cut", lambda df: seen.append(exchanges(df)) or cut(df))
    t = cut(book(spark, moves(40)))
    typologies.structuring(t, labels(spark, [("X", "X", "exchange")]), EngineConfig(), large=[])
    assert sum(seen) <= 6, seen  # of them one of the sides; the rest is exempt wallets and a row for each group


def test_leading_recipients_are_looked_for_once(spark, monkeypatch):
    seen, outs = [], typologies.outs
    monkeypatch.setattr(typologies, "outs", lambda *a: seen.append(1) or outs(*a))
    typologies.findings(cut(book(spark, moves(40))), labels(spark, []), EngineConfig())
    assert len(seen) == 1


def alike(rows, cfg):
    """Groups and members by plain loops; rows: sender, recipient, amount."""
    paid = Counter()
    for a, b, v, *_ in rows:
        paid["structuring_fan_out", a, b] += v
        paid["structuring_fan_in", b, a] += v
    out = {}
    for kind, wallet in {k[:2] for k in paid}:
        own = [(float(v), other) for (k, w, other), v in paid.items() if (k, w) == (kind, wallet)]
        mid, taken = statistics.median(v for v, _ in own), []
        for v, _ in sorted(own, key=lambda x: (abs(x[0] - mid), x)):
            with_ = [*taken, v]
            if len(with_) < 2 or statistics.pstdev(with_) / statistics.mean(with_) <= cfg.structure_cv:
                taken = with_
        if len(taken) >= cfg.structure_parties and len(own) >= 2:
            out[kind, wallet] = [wallet] + [o for v, o in sorted(own, key=lambda x: (-x[0], x[1])) if v in taken][: len(taken)]
    return out


def test_like_amounts_with_equal_ones_left_out_and_hot_queues(spark):
    cfg = EngineConfig(structure_parties=3, structure_cv=0.13, material_factor=1.0)
    rng = random.Random(9)
    rows = [("HOT", f"w{i}", rng.choice([70, 100, 100, 130]), i) for i in range(120)]
    rows += [(f"w{rng.randrange(12)}", f"v{rng.randrange(30)}", rng.choice([60, 90, 100, 140]), i) for i in range(200)]
    t = cut(book(spark, rows).repartition(4))
    want, n = alike(rows, cfg), ordering.parts_of(t)
    for large in ([], list(range(64 * n)), list(range(0, 64 * n, 2))):  # none, all and half of the queues large
        found = typologies.structuring(t, labels(spark, []), cfg, large=large)
        assert {(r.typology, r.wallet): r.wallets for r in found.with_wallets().collect()} == want
        assert {r.wallet for r in found.involved().collect()} == {m for w in want.values() for m in w}


def test_draws_and_shortfalls_are_one_pass(spark):
    rows = lambda df: sorted(map(str, df.collect()))
    kept = taint.kept(book(spark, moves()).repartition(4))
    n = ordering.parts_of(kept)
    for large in ([], list(range(64 * n)), list(range(0, 64 * n, 2))):  # none, all and half of the queues large
        pos = taint.positions(kept, "S", named=False, large=large)
        both = taint.draws(pos, large, short=True)
        if not large:
            assert exchanges(both) == 1
        both = cut(both)
        drawn = both.filter("debit is not null").drop("to", "shortfall")
        assert rows(drawn) == rows(taint.draws(pos, large)) and not drawn.isEmpty()
        lacking = both.filter("shortfall is not null").selectExpr("wallet as from_addr", "to as to_addr", "asset", "shortfall")
        want = taint.shortfalls(pos).groupBy("from_addr", "to_addr", "asset").agg({"shortfall": "sum"})
        assert rows(lacking.selectExpr("from_addr", "to_addr", "asset", "double(shortfall) as s")) == rows(want.selectExpr("from_addr", "to_addr", "asset", "double(`sum(shortfall)`) as s"))
        assert not lacking.isEmpty() and both.filter("debit is not null and shortfall is not null").isEmpty()


def test_no_level_of_a_walk_shuffles_the_ledger(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(graph, "cut", lambda df: seen.append((df.columns, df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))) or cut(df))
    t = cut(book(spark, moves(40)))
    graph.walk(t, labels(spark, []), "S", EngineConfig(max_wallets=None, history_rows=None))
    levels = [n for columns, n in seen if "first_seen" in columns and "rank" not in columns]
    assert levels and max(levels) == 1, levels  # the adding up, behind the frontier's join


def test_first_clusters_gather_no_cluster_in_one_row(spark):
    wallets = spark.createDataFrame([("a", 2), ("b", 1), ("c", 3), ("h", 2)], "address string, depth int")
    typed = spark.createDataFrame([("a", "known_label", "E", "exchange", 0.95), ("h", "consolidation", "Unknown", "suspected_exchange", 0.7)], "address string, method string, entity string, type string, confidence double")
    edges = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "h"), ("h", "h")], "from_addr string, to_addr string")
    first = entities.first_clusters(entities.cluster_members(wallets, typed, edges))
    assert {(r.address, r.cluster_id) for r in first.collect()} == {("a", "label:e"), ("b", "hub:h"), ("c", "hub:h"), ("h", "hub:h")}
    assert "collect" not in first._jdf.queryExecution().optimizedPlan().toString()


def test_a_replay_finds_its_transfers_without_a_shuffle_of_the_ledger(spark, monkeypatch):
    t = trace.Trace(cut(book(spark, moves(40))), labels(spark, []), "S", EngineConfig(max_wallets=None, history_rows=None))
    assert t.walk
    seen = []
    monkeypatch.setattr(graph, "cut", lambda df: seen.append((df.columns, df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin"))) or cut(df))
    rows = t.seen
    assert [n for columns, n in seen if columns == rows.columns] == [0], seen
