"""What grows with the input is not broadcast."""

from ledgerloom.config import EngineConfig
from ledgerloom.operators import chains, checkpoints, typologies
from ledgerloom.operators.checkpoints import cut
from tests.books import book, labels

ROWS = "wallet string, asset string, next string, amount double, share double"


def links(spark):
    """A straight walk, a circle with a way to it, and a walk whose end would lead back but for its amount."""
    rows = [(f"a{i}", "ETH", f"a{i + 1}", 100.0 - i, 0.9 - i / 100) for i in range(9)]
    rows += [(f"c{i}", "ETH", f"c{(i + 1) % 5}", 50.0, 0.8 + i / 100) for i in range(5)] + [("x0", "ETH", "x1", 50.0, 0.9), ("x1", "ETH", "c2", 50.0, 0.7)]
    return spark.createDataFrame(rows + [(f"r{i}", "ETH", f"r{(i + 1) % 4}", 90.0 / 3**i, 0.9) for i in range(4)], ROWS)


def test_chains_broadcast_no_table_of_many_rows(spark, monkeypatch):
    def results():
        c = chains.Chains(links(spark), 1.05, least=("share",))
        walks = sorted((r.wallet, r.links, r.last, r.share) for r in c.walks.collect())
        some = c.walks.filter("links >= 2")
        return walks, sorted(map(str, c.places(some).drop("id").collect())), sorted(map(str, c.covered(some).collect()))

    want, seen = results(), []
    monkeypatch.setattr(checkpoints, "FEW_ROWS", 0, raising=False)
    monkeypatch.setattr(chains, "FEW_STEPS", 0, raising=False)  # few walks are followed link by link, and those few rows are broadcast
    monkeypatch.setattr(chains, "cut", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")) or cut(df))
    assert results() == want
    assert len(want[0]) == 9 + 7 + 4 and seen and sum(seen) == 0, seen


def test_findings_broadcast_no_wallets_of_findings(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(checkpoints, "FEW_ROWS", 0, raising=False)
    monkeypatch.setattr(typologies, "cut", lambda df: seen.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString())) or cut(df))
    rows = [(f"A{i}", f"A{i + 1}", 50, 300 * i) for i in range(5)]
    typologies.findings(cut(book(spark, rows)), labels(spark, [("X", "X", "exchange")]), EngineConfig())
    last = [plan for columns, plan in seen if "strength" in columns][-1]
    assert "Join LeftSemi, (wallet" in last and "rightHint=(strategy=merge)" in last, last


def test_amounts_folded_side_by_side_are_those_folded_alone():
    import random

    import numpy as np

    rng = random.Random(3)
    groups = [sorted(rng.choice([60.0, 90.0, 100.0, 100.5, 140.0, 1e6 * rng.random()]) for _ in range(rng.choice([1, 2, 3, 7, 40, 400]))) for _ in range(60)]
    v = np.array([x for g in groups for x in g])
    new = np.array([i == 0 for g in groups for i in range(len(g))])
    for together in (1, 16, 10_000):  # all side by side, mixed, each alone
        group, kept, same, n, mean, sd = typologies.folded(v, new, 0.3, 3, together)
        at = 0
        for k, g in enumerate(groups):
            mid, taken = float(np.median(g)), []
            for x in sorted(g, key=lambda x: (abs(x - mid), x)):
                some = np.array([*taken, x]) - mid
                if len(some) < 2 or np.sqrt(max((some**2).mean() - some.mean() ** 2, 0)) / (mid + some.mean()) <= 0.3:
                    taken.append(x)
            ok = len(g) >= 3 and len(taken) >= 3
            assert list(kept[at : at + len(g)]) == [ok and x in taken for x in g]
            if ok:
                assert n[k] == len(taken) and same[k] == sum(x in taken for x in g) and abs(mean[k] - np.mean(taken)) < 1e-6 and abs(sd[k] - np.std(taken)) < 1e-6
            at += len(g)


def test_reported_findings_read_no_table_again(spark, monkeypatch):
    """Members of a few findings are looked up without another pass over the ledger or a shuffle of all like amounts."""
    seen = []
    rows = [(f"A{i}", f"A{i + 1}", 50, 300 * i) for i in range(5)] + [("H", f"R{i}", 500 + i % 3, i) for i in range(8)]
    t = cut(book(spark, rows))
    cfg = EngineConfig()
    found = typologies.findings(t, labels(spark, [("X", "X", "exchange")]), cfg)
    some = found.with_wallets(typologies.reported(found.rows, cfg))
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert "from_addr" not in plan and "value" not in plan, plan
    assert {r.typology for r in some.collect()} >= {"layering", "structuring_fan_out"}


def test_totals_and_dwell_are_one_shuffle(spark):
    t = cut(book(spark, [("A", "B", 5, 1), ("B", "C", 4, 3), ("B", "D", 1, 9), ("C", "B", 2, 9)]))
    through = typologies.flow_through(t, [])
    assert through._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert {(r.wallet, float(r.sent), float(r.received), r.dwell, r.pairs) for r in through.collect()} == {("B", 5, 7, 1, 2), ("C", 2, 4, 6, 1)}


def test_equal_recipients_the_first_paid_leads(spark):
    rows = [("A", "Z", 5, 1), ("A", "B", 2, 2), ("A", "B", 3, 3), ("A", "C", 4, 0), ("H", "Q", 9, 2), ("H", "P", 9, 2)]
    for large in ([], list(range(64 * 4))):
        got = {r.wallet: (r.next, r.recipients, float(r.amount), round(r.side_share, 6)) for r in typologies.leading(cut(book(spark, rows)), large).collect()}
        assert got == {"A": ("Z", 3, 5, round(5 / 14, 6)), "H": ("Q", 2, 9, 0.5)}
