from ledgerloom.config import EngineConfig
from ledgerloom.operators import entities, graph
from tests.books import book, labels

CFG = EngineConfig(dust_native=0.001)
BASIC = [("A0", "A1", 10, 1, {"hash": "0xbig"}), ("A0", "A9", 0.0005, 2), ("A0", "A1", 5, 3), ("A1", "A2", 9, 4), ("A2", "A3", 8, 5), ("A2", "A0", 1, 6), ("A3", "A4", 7, 7), ("A4", "A5", 6, 8)]


def test_basic_walk(spark):
    w = graph.walk(book(spark, BASIC), labels(spark, []), "A0", CFG)
    depth = {r.address: (r.depth, r.expanded) for r in w.wallets.collect()}
    assert depth == {"A0": (0, True), "A1": (1, True), "A2": (2, True), "A3": (3, True), "A4": (4, False)}
    edge = {(r.from_addr, r.to_addr): r for r in w.edges.collect()}
    assert float(edge["A0", "A1"].value) == 15.0 and edge["A0", "A1"].tx_count == 2 and edge["A0", "A1"].tx_hash == "0xbig"
    assert ("A2", "A0") in edge and not w.truncated
    shallow = graph.walk(book(spark, BASIC), labels(spark, []), "A0", CFG.with_(max_depth=1, dust_native=0.0001))
    assert {r.address for r in shallow.wallets.collect()} == {"A0", "A1", "A9"}


def test_terminal_entities_stop_and_score(spark):
    rows = [("A0", "A1", 10, 1), ("A1", "A2", 9, 2), ("A2", "X", 8, 3), ("X", "A50", 7, 4)]
    tags = labels(spark, [("X", "Binance", "exchange")])
    w = graph.walk(book(spark, rows), tags, "A0", CFG)
    assert "A50" not in {r.address for r in w.wallets.collect()}
    typed = entities.known(w.wallets.select("address"), tags, CFG)
    paths = entities.crossed(graph.shortest_paths(w, "A0", 4), typed)
    got = entities.scored(typed.join(paths, "address").selectExpr("*", "size(path) - 1 as hops"), CFG).first()
    assert (got.hops, got.score, got.path) == (3, 81, ["A0", "A1", "A2", "X"])


def test_wallet_and_branch_limits(spark):
    rows = [("A0", f"B{i:02d}", 100 - i, i) for i in range(30)] + [(f"B{i:02d}", f"C{i:02d}", 50, 100 + i) for i in range(30)]
    w = graph.walk(book(spark, rows), labels(spark, []), "A0", CFG.with_(max_wallets=28))
    found = {r.address for r in w.wallets.collect()}
    # 25 branches of the start; then 26 wallets are known, so two more are expanded
    assert len(found) == 28 and w.truncated and {"C00", "C01"} <= found


def test_score_table(spark):
    rows = [("known_label", 1, []), ("known_label", 3, []), ("known_label", 5, []), ("consolidation", 2, []), ("known_label", 2, ["mixer"]), ("known_label", 2, ["bridge"]), ("known_label", 2, ["bridge", "mixer"]), ("consolidation", 4, ["mixer"])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, method string, hops int, crossed array<string>")
    assert [r.score for r in entities.scored(df, CFG).orderBy("i").collect()] == [95, 81, 67, 60, 43, 61, 31, 5]


def test_consolidation_and_clusters(spark):
    rows = [("A0", f"A{i}", 10, i) for i in range(10, 17)] + [(f"A{i}", "H", 9, 100 + i) for i in range(10, 17)]
    w = graph.walk(book(spark, rows), labels(spark, []), "A0", CFG)
    typed = entities.identify(w.edges, w.wallets.select("address"), labels(spark, []), CFG)
    assert [(r.address, r.type) for r in typed.collect()] == [("H", "suspected_exchange")]
    got = w.hops.groupBy("to_addr", "asset").sum("value").toDF("address", "asset", "received")
    c = entities.clusters(w.wallets, typed, w.edges, got).first()
    assert c.cluster_id == "hub:H" and len(c.members) == 8 and c.hop == 1


def plain_walk(rows, typed, start, cfg):
    """The walk as a queue in plain Python: returns depths and expanded wallets."""
    queue, depth, done, edges = [start], {start: 0}, [], set()
    while queue:
        w = queue.pop(0)
        if w in done or depth[w] >= cfg.max_depth:
            continue
        if len(depth) >= cfg.max_wallets:
            break
        if depth[w] and w not in typed:
            fan = {x: len({a for a, b in edges if b == x and a != x}) for x in depth}
            if fan[w] >= cfg.fan_in_flag and fan[w] >= sorted(fan.values())[int(cfg.fan_in_quantile * (len(fan) - 1))]:
                continue
        done.append(w)
        out = {}
        for i, (a, b, v, ts) in enumerate(rows):
            if a == w and v >= cfg.dust_native:
                total, first = out.get(b, (0, (ts, i)))
                out[b] = (total + v, min(first, (ts, i)))
        for b in sorted(out, key=lambda b: (-out[b][0], out[b][1], b))[: cfg.max_edges]:
            edges.add((w, b))
            if b not in depth:
                depth[b] = depth[w] + 1
                if typed.get(b) not in cfg.terminal:
                    queue.append(b)
    return depth, set(done)


def test_walk_takes_turns_like_a_queue(spark):
    import random

    from ledgerloom.config import EngineConfig
    from ledgerloom.operators import graph

    from .books import book, labels

    rng = random.Random(5)
    stopped = 0
    for trial in range(4):
        # few middle wallets that many pay into, so some become suspected while their level is walked
        rows = [("s", f"a{i}", 50 + i, i) for i in range(9)]
        rows += [(f"a{i}", rng.choice(["h1", "h2", f"b{i}", f"a{(i + 1) % 9}"]), rng.randint(1, 99), 20 + j) for i in range(9) for j in range(4)]
        rows += [(f"a{i}", "h1", 30, 70 + i) for i in range(9)] + [("h1", f"c{i}", 9, 90 + i) for i in range(3)] + [("h2", "c9", 9, 99)]
        typed = {"b2": "exchange", "c1": "mixer"}
        cfg = EngineConfig(max_depth=4, max_wallets=(400, 12, 16, 400)[trial], max_edges=(25, 25, 3, 3)[trial])
        w = graph.walk(book(spark, rows), labels(spark, [(a, "E", t) for a, t in typed.items()]), "s", cfg)
        got = {r.address: (r.depth, r.expanded) for r in w.wallets.collect()}
        depth, done = plain_walk(rows, typed, "s", cfg)
        assert {a: d for a, (d, _) in got.items()} == depth
        assert {a for a, (_, e) in got.items() if e} == done
        stopped += "h1" in depth and "h1" not in done
    assert stopped


def test_a_label_holds_on_its_own_chain_alone(spark):
    from ledgerloom.config import EngineConfig
    from ledgerloom.operators import entities, graph

    from .books import book

    other = spark.createDataFrame([("polygon", "b", "X", "exchange", "t")], "chain string, address string, entity string, type string, source string")
    t = book(spark, [("a", "b", 5, 1), ("b", "c", 5, 2)])
    w = graph.walk(t, other, "a", EngineConfig())
    assert {r.address for r in w.wallets.collect()} == {"a", "b", "c"}
    assert entities.known(w.wallets.select("address"), other, EngineConfig()).count() == 0
    assert {r.address for r in graph.walk(t, other, "a", EngineConfig(chain="polygon")).wallets.collect()} == {"a", "b"}


def test_history_limit_holds_for_each_wallet_and_kind(spark):
    from ledgerloom.config import EngineConfig
    from ledgerloom.operators import graph

    from .books import book, labels

    rows = [("a", f"b{i}", 5, i) for i in range(6)] + [("x", "a", 5, 10), ("y", "a", 5, 11)]
    w = graph.walk(book(spark, rows), labels(spark, []), "a", EngineConfig(history_rows=4))
    assert {r.address for r in w.wallets.collect()} == {"a", "b4", "b5"}  # two of the last four rows were received
