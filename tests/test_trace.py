import json

import pytest

from ledgerloom.config import EngineConfig
from ledgerloom.plans.trace import Trace, payload_manifest, read_payload
from ledgerloom.sources import feeds
from ledgerloom.sources import ledger as src
from tests.books import book, labels


def test_trace_payload_and_recordings(spark, tmp_path):
    rows = [("A0", "A1", 10, 1000), ("A1", "A2", 9, 2000), ("A2", "X", 8, 3000), ("X", "A50", 7, 4000)]
    t = Trace(book(spark, rows), labels(spark, [("X", "Binance", "exchange")]), "A0", EngineConfig(dust_native=0.001))
    head = t.summary().first()
    assert head.headline == "8.00 ETH of the suspect's funds reached Binance, 3 hops, 81% confidence"
    assert head.exchange_found and head.termination == "exchange"
    p = json.loads(t.payload_json().first().payload)
    assert [n["address"] for n in p["nodes"]] == ["A0", "A1", "A2", "X"] and p["attributions"][0]["path"] == ["A0", "A1", "A2", "X"]
    assert p["accounting"][0]["rule"] == "fifo" and len(p["edges"]) == 3
    assert [(r.hop, r.role) for r in t.path_rows().orderBy("hop").collect()] == [(0, "suspect"), (1, "intermediary"), (2, "intermediary"), (3, "exchange")]
    assert head.caveat == "fifo" and head.entity == "Binance" and head.received == "8.00 ETH" and not head.lead
    t.write_payload(str(tmp_path / "out"), 2)
    lines = read_payload(spark, str(tmp_path / "out"))
    edges = [json.loads(r.line) for r in lines.filter("section = 'edges'").orderBy("place").collect()]
    assert [(e["from_addr"], e["to_addr"]) for e in edges] == [("A0", "A1"), ("A1", "A2"), ("A2", "X")]
    told = {(r.section, r.shard): (r.first, r.rows) for r in payload_manifest(spark, str(tmp_path / "out")).collect()}
    assert told["edges", 0] == (0, 2) and told["edges", 1] == (2, 1) and sum(n for _, n in told.values()) == lines.count()
    block = t.findings_blocks.first()
    assert (block.asset, block.received, block.tainted, block.caveat) == ("ETH", 8.0, 8.0, "fifo")
    assert "ETH" in t.disclaimer() and t.path_rows().filter("hop = 1").first().tx_hash == "0x0000"
    feeds.record(t.payload_json(), str(tmp_path / "rec"))
    assert json.loads(feeds.recordings(spark, str(tmp_path / "rec"), "ethereum", "a0").first().payload)["start_address"] == "A0"


def test_label_sources(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"_note": {"entity": "x"}, "0xAB": {"entity": "E", "type": "mixer"}, "polygon:0xcd": {"entity": "F", "type": "bridge"}, "0xef": "bad", "0x01": {"entity": "G", "type": "scam", "chain": "bsc"}}))
    got = {(r.chain, r.address, r.type) for r in feeds.read_labels(spark, str(tmp_path / "l.json")).collect()}
    assert got == {("ethereum", "0xab", "mixer"), ("polygon", "0xcd", "bridge"), ("bsc", "0x01", "scam")}
    pack = {"currency": "ETH", "title": "Pack", "category": "exchange", "tags": [{"address": "0x1"}, {"address": "0x2", "label": "Own", "currency": "BTC"}]}
    got = [(r.currency, r.address, r.label, r.category) for r in feeds.tag_pack(spark, pack).orderBy("pos").collect()]
    assert got == [("ETH", "0x1", "Pack", "exchange"), ("BTC", "0x2", "Own", "exchange")]


def test_token_rows_follow_the_table_not_the_row(spark):
    rows = [("0xusdt", "100000000", "USDT", "18"), ("0xdai", "5000000000000000000", "DAI", "6"), ("0xfake", "1", "USDT", "6"), ("0xnone", "1", None, "6")]
    raw = spark.createDataFrame([(1, f"h{i}", "0xa", "0xb", c, s, v, "1", d) for i, (c, v, s, d) in enumerate(rows)], "chain_id int, hash string, `from` string, `to` string, contractAddress string, tokenSymbol string, value string, timeStamp string, tokenDecimal string")
    got = src.parse_tokens(raw, src.tokens(spark))
    assert {r.symbol: r.value for r in got.filter("symbol is not null").collect()} == {"USDT": 100.0, "DAI": 5.0}
    assert src.skipped_tokens(got, spark.createDataFrame([("0xb",)], "address string")).count() == 0  # what it received
    skipped = src.skipped_tokens(got, spark.createDataFrame([("0xa",), ("0xa",)], "address string"))
    assert {r.claimed: r.n for r in skipped.collect()} == {"USDT": 1, "(unnamed token)": 1}
    assert [r.claimed for r in src.impersonated(skipped, src.tokens(spark)).collect()] == ["USDT"]


def test_stream_drops_copies(spark, tmp_path):
    from ledgerloom.streaming import ingest

    one = spark.range(2).selectExpr("1 as chain_id", "'h' as tx_hash", "0 as log_index", "'a' as from_addr", "'b' as to_addr", "cast(2 as decimal(28,8)) as value", "86400L as ts", "1L as block", "0 as tx_index", "'ETH' as asset", "cast(null as string) as contract", "18 as decimals")
    one.write.parquet(str(tmp_path / "in"))
    q = ingest.transfers(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("moves").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("moves").count() == 1


def test_summary_without_a_named_exchange(spark):
    cfg = EngineConfig(dust_native=0.001)
    none = Trace(book(spark, [("A0", "A1", 10, 1000)]), labels(spark, [("Z", "Other", "exchange")]), "A0", cfg).summary().first()
    assert none.headline == "No exchange reached within 4 hops" and not none.exchange_found and not none.lead and none.caveat is None
    # money that was there before goes on first: none of the suspect's arrives
    rows = [("B", "A1", 50, 500), ("A0", "A1", 10, 1000), ("A1", "X", 40, 2000)]
    no = Trace(book(spark, rows), labels(spark, [("X", "Kraken", "exchange")]), "A0", cfg).summary().first()
    assert no.exchange_found and no.caveat == "none_arrived" and "none of the suspect's funds arrived" in no.headline


def test_a_collection_point_is_a_lead(spark):
    rows = [("A0", f"M{i}", 10 + i, i) for i in range(12)] + [(f"M{i}", "HUB", 9, 100 + i) for i in range(12)]
    head = Trace(book(spark, rows), labels(spark, [("Z", "Other", "exchange")]), "A0", EngineConfig(dust_native=0.001)).summary().first()
    assert head.lead and not head.exchange_found and head.address == "HUB" and head.headline.startswith("No named exchange reached. Unconfirmed")


def test_start_address_is_checked(spark):
    t = book(spark, [("A0", "A1", 10, 1000)])
    with pytest.raises(ValueError, match="no address"):
        Trace.of_address(t, labels(spark, []), "0x12", EngineConfig())
    assert Trace.of_address(t, labels(spark, []), " 0X" + "A" * 40, EngineConfig()).start == "0x" + "a" * 40


def test_tag_packs_as_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("currency: ETH\ntitle: Pack\ncategory: exchange\ntags:\n  - address: '0x1'\n  - address: '0x2'\n    label: Own\n    currency: BTC\n  - no tag\n")
    (tmp_path / "b.yml").write_text("label: B\ntags:\n  - {address: 0x3, currency: ETH, category: mixer}\n")
    (tmp_path / "broken.yaml").write_text("tags: [unclosed\n  - x: {")
    (tmp_path / "empty.yaml").write_text("")
    (tmp_path / "notes.txt").write_text("not a pack")
    rows = feeds.read_tag_packs(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 4
    got = {(r.file, r.pos, r.currency, r.address, r.label, r.category) for r in rows.filter("error is null").collect()}
    assert got == {("a.yaml", 0, "ETH", "0x1", "Pack", "exchange"), ("a.yaml", 1, "BTC", "0x2", "Own", "exchange"), ("b.yml", 0, "ETH", "3", "B", "mixer")}
    assert [r.file for r in rows.filter("error is not null").collect()] == ["broken.yaml"]
    pack = {"currency": "ETH", "title": "Pack", "category": "exchange", "tags": [{"address": "0x1"}, {"address": "0x2", "label": "Own", "currency": "BTC"}]}
    one = {(r.currency, r.address, r.label, r.category) for r in feeds.tag_pack(spark, pack).collect()}
    assert one == {x[2:] for x in got if x[0] == "a.yaml"}


def test_recordings_are_a_log(spark, tmp_path):
    path = str(tmp_path / "rec")
    made = lambda a, h: spark.createDataFrame([(a, json.dumps({"headline": h, "exchange_found": True, "termination": "exchange"}))], "start_address string, payload string")
    feeds.record(made("0xA", "first"), path)
    feeds.record(made("0xA", "second"), path)
    feeds.record(made("0xB", "other"), path, "polygon")
    feeds.record(made("", "no address"), path)
    (tmp_path / "rec" / "chain=ethereum" / "broken.json").write_text('{"address": "0xc", "payl')
    (tmp_path / "rec" / "chain=ethereum" / "bad.json").write_text('{"address": "0xd", "payload": "{no json", "recorded_at": "2026-01-01T00:00:00.000Z", "gone": false}\n')
    assert {(r.chain, r.address, r.headline) for r in feeds.listed(spark, path).collect()} == {("ethereum", "0xa", "second"), ("polygon", "0xb", "other")}
    assert feeds.has_recording(spark, path, "0xA") and not feeds.has_recording(spark, path, "0xB")
    feeds.delete_recordings(spark.createDataFrame([("0xA",)], "address string"), path)
    assert not feeds.has_recording(spark, path, "0xa") and feeds.listed(spark, path, "ethereum").count() == 0
    feeds.record(made("0xA", "third"), path)
    assert feeds.listed(spark, path, "ethereum").first().headline == "third"
    feeds.compacted(spark, path, str(tmp_path / "small"))
    assert feeds.listed(spark, str(tmp_path / "small")).count() == 2 and spark.read.text(str(tmp_path / "small")).count() == 2


def test_owner_rule_keeps_repeats_and_drops_mirrors(spark):
    t = book(spark, [("A", "B", 5, 1, {"hash": "h"}), ("A", "B", 5, 1, {"hash": "h"}), ("C", "B", 7, 2), ("B", "D", 1, 3)])
    seen = spark.createDataFrame([("A",), ("B",)], "address string")
    histories = src.mirrored(t, seen)
    assert histories.count() == 6
    got = sorted((r.from_addr, r.to_addr, float(r.value)) for r in src.owned(histories, seen).collect())
    assert got == [("A", "B", 5.0), ("A", "B", 5.0), ("B", "D", 1.0), ("C", "B", 7.0)]


def test_focus_keeps_what_touches_the_path(spark):
    from ledgerloom.operators import graph

    edges = spark.createDataFrame([("S", "A"), ("A", "X"), ("A", "O"), ("O", "P"), ("Q", "R")], "from_addr string, to_addr string")
    wallets = spark.createDataFrame([(w,) for w in "SAXOPQR"], "address string")
    near, kept = graph.focus(edges, wallets, spark.createDataFrame([("S",), ("A",), ("X",)], "address string"), "S")
    assert sorted(map(tuple, near.collect())) == [("A", "O"), ("A", "X"), ("S", "A")] and sorted(r.address for r in kept.collect()) == list("AOSX")
    assert graph.focus(edges, wallets, spark.createDataFrame([], "address string"), "S")[0].count() == 5


def test_outcome_flags_and_path_need_no_replay(spark, monkeypatch):
    rows = [("A0", "A1", 10, 1000), ("A1", "M", 9, 2000), ("A1", "X", 8, 3000), ("A0", "X", 7, 4000), ("A0", "Y", 1, 5000)]
    made = lambda: Trace(book(spark, rows), labels(spark, [("X", "Binance", "exchange"), ("Y", "Kraken", "exchange"), ("M", "Mixer", "mixer")]), "A0", EngineConfig(dust_native=0.001))
    full = made()
    want = full.summary().select(*made().outcome().columns).first()
    places = full.path_rows().orderBy("hop").select("hop", "role", "address").collect()

    def stop(self):
        raise AssertionError("replayed")

    monkeypatch.setattr(Trace, "_replay", property(stop))
    own = made()
    assert own.outcome().first() == want and want.other_exchanges == 1 and want.flags == 1
    assert own.termination == "exchange"
    assert [(r.address, r.severity) for r in own.flag_rows().collect()] == [("M", "high")]
    assert own.path_places().orderBy("hop").collect() == places and len(places) == 2
