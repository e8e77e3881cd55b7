"""Approximate nearest neighbours: NN-descent builds a neighbour graph, queries search it greedily.

Equal vectors are one node (its least id); copies come back as members at the end, so a vector that
a third of the rows share is one node too.  The graph begins with exact neighbours inside chunks of
vectors that lie together by a few random projections (cut points from a bounded sample).  Each
NN-descent round then joins every node's list with the vectors of its neighbours and of the nodes
it is a neighbour of, compares neighbours with neighbours where one of the two is new to the list,
and keeps the best ``k``.  Those that list a node meet in groups of about 2k, dealt anew by a hash each round,
each together with the node's own list: two that list a much-listed node meet if dealt to one group, in
this round or a later one, and no task gets more than a group at once.  Rounds stop when few entries
change, or after ``rounds``.

A query starts at its own node and at ``seeds`` nodes that are the same for all.  Each step expands the ``width``
nearest nodes of its beam not yet expanded, along edges of either direction; it ends when every query's
beam is expanded.  The search measures on packed vectors, the last ranking of the beam on original ones.

The graph search may miss neighbours; distances are exact, of the original vectors in double
precision.  Vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part.  Rows with null id take none either; repeated ids stay separate rows.
Empty tables give no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

EDGE = "id long, nbr long, d double"


def packed(nodes: DataFrame) -> DataFrame:
    """nodes (id, v) with x, the vector in a byte for each component and a scale: the graph is built
    on these, results are not.  All vectors are first divided by one power of two, that of the table's largest
    component, so that no square overflows."""
    most = nodes.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 1.0
    unit = 2.0 ** min(max(int(np.floor(np.log2(most))), -1022), 1023)

    def run(batches):
        for b in batches:
            v = np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1) / unit
            # at least the smallest normal number, lest a quotient be none
            scale = np.maximum(np.abs(v).max(1, keepdims=True) / 127, np.finfo(np.float64).tiny)
            q = np.rint(v / scale).astype(np.int8)
            raw = np.hstack([scale.astype("<f8").view(np.uint8), q.view(np.uint8)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in raw], pa.binary())], names=["id", "v", "x"])

    return nodes.select("id", "v").mapInArrow(run, "id long, v array<double>, x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    """Packed vectors as floats; as doubles where some are so small beside others that squares need them."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    scale = raw[:, :8].copy().view("<f8")
    kind = np.float32 if len(scale) and scale.min() > 1e-15 else np.float64
    return raw[:, 8:].view(np.int8).astype(kind) * scale.astype(kind)


def vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>) of the vectors that take part."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (length.n if length else 0))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _nearest_in(ids: np.ndarray, x: np.ndarray, k: int):
    """Edges to the k nearest of each row within a chunk."""
    sq = (x * x).sum(1)
    d = sq[:, None] + sq[None, :] - 2 * (x @ x.T)
    np.fill_diagonal(d, np.inf)
    k = min(k, len(ids) - 1)
    if k <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64)
    best = np.argpartition(d, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[best].ravel(), np.maximum(np.take_along_axis(d, best, 1), 0).ravel().astype(np.float64)


def _edges(i, j, d) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(d, pa.float64())], names=["id", "nbr", "d"])


def start_graph(nodes: DataFrame, k: int, trees: int, chunk: int, sample: int, seed: int) -> DataFrame:
    """Edges among vectors that lie together by random projections, of ``trees`` kinds."""
    count = nodes.count()
    some = nodes.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("x").toPandas()
    if not len(some):
        return nodes.sparkSession.createDataFrame([], EDGE)
    x = _matrix(pa.array([bytes(r) for r in some.x], pa.binary()))
    rng = np.random.default_rng(seed)
    planes = rng.normal(size=(trees, 4, x.shape[1])).astype(np.float32)
    cells = max(1, round((count / chunk) ** (1 / 3)))
    # cut points of three projections; the fourth orders the vectors of a cell
    cuts = [[np.quantile(x @ planes[t, p], np.arange(1, cells) / cells) for p in range(3)] for t in range(trees)]

    def place(batches):
        for b in batches:
            own = _matrix(b.column(1))
            for t in range(trees):
                at = [np.searchsorted(cuts[t][p], own @ planes[t, p]) for p in range(3)]
                # boustrophedon order, so that neighbours in the order are near
                mid = np.where(at[0] % 2, cells - 1 - at[1], at[1])
                low = np.where((at[0] * cells + mid) % 2, cells - 1 - at[2], at[2])
                cell = ((t * cells + at[0]) * cells + mid) * cells + low
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array((own @ planes[t, 3]).astype(np.float64)), b.column(0), b.column(1)], names=["cell", "p", "id", "x"])

    def join(batches):
        ids, xs = np.empty(0, np.int64), None
        for b in batches:
            own = _matrix(b.column(3))
            ids, xs = np.concatenate([ids, np.asarray(b.column(2))]), own if xs is None else np.vstack([xs, own])
            while len(ids) >= 2 * chunk:
                yield _edges(*_nearest_in(ids[:chunk], xs[:chunk], k))
                ids, xs = ids[chunk // 2 :], xs[chunk // 2 :]  # chunks overlap by half
        if len(ids) > 1:
            yield _edges(*_nearest_in(ids, xs, k))

    placed = nodes.select("id", "x").mapInArrow(place, "cell long, p double, id long, x binary")
    return placed.repartitionByRange("cell", "p").sortWithinPartitions("cell", "p", "id").select("cell", "p", "id", "x").mapInArrow(join, EDGE)


def best_edges(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest different neighbours of each node; ``fresh`` where no old entry had it."""
    one = edges.repartition("id").groupBy("id", "nbr").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    w = Window.partitionBy("id").orderBy("d", "nbr")
    return one.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("id", "nbr", "d", "fresh", "r")


def descend(graph: DataFrame, nodes: DataFrame, k: int, deal: int = 0) -> DataFrame:
    """Candidate edges of one round: neighbours of a node compared with each other."""
    worst = graph.groupBy("id").agg(F.max("d").alias("worst"), F.count("*").alias("n"))
    side = nodes.join(worst, "id", "left").select(F.col("id").alias("member"), F.when(F.col("n") >= k, F.col("worst")).otherwise(float("inf")).cast("double").alias("worst"), "x")
    own = graph.select(F.col("id").alias("block"), F.col("nbr").alias("member"), F.col("fresh").cast("int").alias("fresh"))
    back = graph.select(F.col("nbr").alias("block"), F.col("id").alias("member"), F.col("fresh").cast("int").alias("fresh"))
    # nodes whose list and listing have nothing new have nothing to compare
    size = own.select("block", "fresh", F.lit(0).alias("b")).unionByName(back.select("block", "fresh", F.lit(1).alias("b")))
    size = size.groupBy("block").agg(F.max("fresh").alias("f"), F.greatest(F.ceil(F.sum("b") / (2 * k)), F.lit(1)).cast("long").alias("groups")).filter("f = 1").drop("f")
    own = own.join(size, "block").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    back = back.join(size, "block").withColumn("group", F.pmod(F.xxhash64("member", "block", F.lit(deal)), "groups"))
    rows = own.unionByName(back).join(side, "member").select("block", "group", "member", "fresh", "worst", "x")
    rows = rows.repartition("block", "group").sortWithinPartitions("block", "group", "member")

    def pairs(ids, fresh, worst, x):
        """Candidates among a group's members that would enter a member's list."""
        sq = (x * x).sum(1)
        d = np.maximum(sq[:, None] + sq[None, :] - 2 * (x @ x.T), 0)
        ok = (d < worst[:, None]) & (fresh[:, None] | fresh[None, :]) & (ids[:, None] != ids[None, :])
        i, j = np.nonzero(ok)
        return ids[i], ids[j], d[i, j]

    def join(batches):
        held, out = None, [[], [], []]

        def group(part):
            if part[1].any() and len(part[0]) > 1:
                for c, v in zip(out, pairs(*part)):
                    c.append(v)

        for b in batches:
            cols = [np.asarray(b.column(i)) for i in range(5)]
            own = [*cols[:3], cols[3].astype(bool), cols[4], _matrix(b.column(5))]
            if held is not None:
                own = [np.concatenate([h, o]) for h, o in zip(held, own)]
            cuts = np.flatnonzero((np.diff(own[0]) != 0) | (np.diff(own[1]) != 0)) + 1
            for s, e in zip(np.r_[0, cuts][:-1], cuts):
                group([c[s:e] for c in own[2:]])
            held = [c[cuts[-1] if len(cuts) else 0 :] for c in own]
            if sum(map(len, out[0])) > 200_000:
                yield merged(out, k)
                out[:] = [], [], []
        if held is not None and len(held[0]):
            group(held[2:])
        if out[0]:
            yield merged(out, k)

    return rows.mapInArrow(join, EDGE)


def merged(out, k: int) -> pa.RecordBatch:
    """Best k candidates of each node among those of one buffer."""
    i, j, d = (np.concatenate(c) for c in out)
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    new = np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])] if len(i) else np.empty(0, bool)
    i, j, d = i[new], j[new], d[new]
    start = np.r_[True, i[1:] != i[:-1]] if len(i) else np.empty(0, bool)
    rank = np.arange(len(i)) - np.maximum.accumulate(np.where(start, np.arange(len(i)), 0)) if len(i) else np.empty(0, int)
    return _edges(i[rank < k], j[rank < k], d[rank < k].astype(np.float64))


def build(nodes: DataFrame, k: int = 32, trees: int = 4, chunk: int = 128, rounds: int = 7, stop: float = 0.01, sample: int = 4096, seed: int = 5) -> DataFrame:
    """The neighbour graph (id, nbr, d squared) of nodes (id, x of packed())."""
    begun = start_graph(nodes, k, trees, chunk, sample, seed).withColumn("fresh", F.lit(True))
    graph = best_edges(begun, k).checkpoint()
    for deal in range(rounds):
        more = descend(graph, nodes, k, deal).withColumn("fresh", F.lit(True))
        graph = best_edges(graph.withColumn("fresh", F.lit(False)).select("id", "nbr", "d", "fresh").unionByName(more), k).checkpoint()
        n = graph.agg(F.count("*").alias("n"), F.sum(F.col("fresh").cast("long")).alias("new")).first()
        if not n.n or n.new <= stop * n.n:
            break
    return graph.select("id", "nbr", "d")


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, beam: int = 192, width: int = 64, seeds: int = 32) -> DataFrame:
    """q, id: the best ``beam`` nodes found for each query node (queries: q, a node's id)."""
    packs = nodes.select("id", "x")
    asked = queries.select("q").distinct().join(packs.select(F.col("id").alias("q"), F.col("x").alias("qx")), "q")
    links = graph.select("id", "nbr").unionByName(graph.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"))).distinct()
    links = links.repartition("id").checkpoint()

    def measure(batches):
        for b in batches:
            x, y = _matrix(b.column(2)), _matrix(b.column(3))
            d = ((x - y) ** 2).sum(1, dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d)], names=["q", "id", "d"])

    def measured(pairs):
        rows = pairs.join(packs, "id").join(asked, "q").select("q", "id", "x", "qx")
        return rows.mapInArrow(measure, "q long, id long, d double").withColumn("done", F.lit(False))

    first = [r.id for r in packs.select("id").orderBy(F.xxhash64("id"), "id").limit(seeds).collect()]
    begun = asked.select("q", F.explode(F.array_distinct(F.array("q", *map(F.lit, first)))).alias("id"))
    best = Window.partitionBy("q").orderBy("d", "id")
    state = measured(begun).withColumn("open", F.lit(True)).checkpoint()
    while True:
        steps = state.filter("open").select("q", "id").join(links, "id").select("q", F.col("nbr").alias("id")).distinct()
        both = state.select("q", "id", "d", (F.col("done") | F.col("open")).alias("done")).unionByName(measured(steps))
        both = both.groupBy("q", "id").agg(F.min("d").alias("d"), F.max("done").alias("done"))
        both = both.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= beam)
        # the nearest not yet expanded are next
        waiting = F.row_number().over(Window.partitionBy("q").orderBy("done", "d", "id"))
        state = both.withColumn("open", ~F.col("done") & (waiting <= width)).select("q", "id", "d", "done", "open").checkpoint()
        if state.filter("open").isEmpty():
            return state.select("q", "id")


def nearest(table: DataFrame, is_query: Column, top: int = 10, k: int = 32, beam: int = 192, rounds: int = 7, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of each query row among all others."""
    rows = vectors(table, id_col, vec_col)
    # of equal vectors, the first top + 1 ids can be among a query's nearest
    w = Window.partitionBy("v").orderBy("vec_id")
    members = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top + 1)
    members = staged(members.withColumn("id", F.min("vec_id").over(Window.partitionBy("v"))).select("id", "vec_id", "r", "v"), "members")
    nodes = staged(packed(members.filter("r = 1")), "nodes")
    graph = build(nodes, k, rounds=rounds)
    asked = rows.filter(is_query).join(nodes.select("id", "v"), "v").select(F.col("vec_id").alias("query_id"), F.col("id").alias("q"))
    asked = staged(asked, "asked")
    found = search(graph, nodes, asked, max(beam, top + 1))
    originals = nodes.select("id", "v")
    near = found.join(originals, "id").join(originals.select(F.col("id").alias("q"), F.col("v").alias("qv")), "q")
    near = near.select("q", "id", distance(F.col("qv"), F.col("v")).alias("score")).join(members.select("id", "vec_id"), "id").select("q", "vec_id", "score")
    # enough for any query of the node: its own id may be one of the first
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).filter(F.col("r") <= top + 1).drop("r")
    own = asked.join(first, "q").filter("vec_id <> query_id")
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
