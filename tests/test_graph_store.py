from ledgerloom.config import EngineConfig
from ledgerloom.operators import graph_store, typologies
from ledgerloom.sources import ledger as src

from .books import book

W = "trace_id string, address string, seq long, props map<string,string>"
T = "trace_id string, src string, dst string, seq long, props map<string,string>"


def test_merge(spark):
    old = spark.createDataFrame([("t", "a", 1, {"label": "x", "type": "mixer"}), ("u", "a", 1, {"label": "other"})], W)
    new = spark.createDataFrame([("t", "a", 2, {"label": "y", "type": None}), ("t", "b", 2, None), ("t", None, 3, {"label": "z"}), ("t", "a", 2, {"label": "y"})], W)
    sent = spark.createDataFrame([("t", "a", "b", 1, {"asset": "ETH", "depth": "1"})], T)
    more = spark.createDataFrame([("t", "a", "b", 2, {"asset": "DAI"}), ("t", "b", "c", 2, None), ("t", None, "d", 2, {"asset": "ETH"})], T)
    wallets, pairs = graph_store.merge(old, sent, new, more)
    got = {(r.trace_id, r.address): r.props for r in wallets.collect()}
    # the last write of each name stands, null takes it away, ends of transfers exist
    assert got == {("t", "a"): {"label": "y"}, ("t", "b"): {}, ("t", "c"): {}, ("t", "d"): {}, ("u", "a"): {"label": "other"}}
    assert {(r.src, r.dst): r.props for r in pairs.collect()} == {("a", "b"): {"asset": "DAI"}, ("b", "c"): None}


def test_merge_of_nothing(spark):
    w, t = spark.createDataFrame([], W), spark.createDataFrame([], T)
    wallets, pairs = graph_store.merge(w, t, w, t)
    assert wallets.isEmpty() and pairs.isEmpty()


def test_token_note(spark):
    skipped = spark.createDataFrame([(1, f"T{i}", 10 - i) for i in range(9)] + [(1, "usdt", 50), (137, "T0", 7)], "chain_id int, claimed string, n long")
    note = src.token_note(skipped, src.tokens(spark), 1).first()
    assert (note.skipped_transfers, note.distinct_tokens, note.followed_assets) == (104, 10, ["DAI", "USDT"])
    assert [x.asset for x in note.top_skipped] == ["usdt", *(f"T{i}" for i in range(7))]
    assert [x.asset for x in note.top_skipped if x.impersonating] == note.impersonated_symbols == ["usdt"]
    assert src.token_note(skipped, src.tokens(spark), 137).first().impersonation_note is None
    assert src.token_note(skipped.limit(0), src.tokens(spark), 1).isEmpty()


def test_evidence(spark):
    t = book(spark, [("s", "a", 10 + i, i) for i in range(5)] + [("a", "z", 11, 10 + i) for i in range(10)] + [("a", "z", "11.2345", 5)])
    found = spark.createDataFrame([("rapid_pass_through", "a", "ETH"), ("round_amounts", "a", "ETH")], "typology string, wallet string, asset string")
    rows = typologies.evidence(t, found, EngineConfig()).collect()
    of = lambda kind, side: [r.ts for r in sorted(rows, key=lambda r: r.place) if (r.typology, r.side) == (kind, side)]
    assert of("rapid_pass_through", "in") == [0, 1, 2] and of("rapid_pass_through", "out") == [5, 10, 11]
    assert of("round_amounts", "out") == list(range(10, 18))
