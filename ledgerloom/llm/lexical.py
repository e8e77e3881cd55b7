"""Ranked lexical search over a clustered index.

Documents are put in an order in which like ones stand together: recursive graph bisection, fitted on a
bounded sample, halves the documents so that the terms' postings in the halves cost least bits, and every
document of the table is then led down that tree by the same costs.  Runs of that order are shards: each
holds its documents' postings by term (gaps of places within the shard, counts) and each term's greatest impact.

A query's bound for a shard is the sum of its terms' weights times those greatest impacts.  Shards are
visited in order of their bounds, a few, then many times as many, and so on; a query stops exactly when no
shard that is left has a bound that reaches its last place's score.  A bound equal to that score is still
visited, since places within a shard are mapped back to doc_ids and equal scores stand by doc_id.

Scores are 64-bit integers.  Shards hold a bounded number of documents and postings however common a term or
a text is, so that no term's postings meet in one task; queries are taken in groups of ``GROUP``.

Nulls: null text has no term; a null doc_id is listed, before others of its score.  Empty texts match
nothing; long ones are indexed whole.  Repeated rows are documents of their own.  Rows of one item_id are
one item, its terms united; null is an item too.  Empty tables give no row.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .common import bounded_sample, dropped, fitted, staged, written

SHARD_DOCS, SHARD_POSTINGS = 1024, 1 << 18
#: Queries that are scored together in a shard.
GROUP = 256
#: Shards that a query visits first, and by how much the number grows.
FIRST, GROWTH = 16, 64
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The text's terms in UTF-8: runs of letters and digits of ASCII and of all beyond it, A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM).split() if text else []


# ---------------------------------------------------------------------------- order of documents


@dataclass
class Tree:
    """A bisection: for inner node k (children 2k+1, 2k+2) each term's extra cost on the left, less that on
    the right, and the cost up to which a document goes left."""

    terms: dict[bytes, int]
    costs: np.ndarray
    cuts: np.ndarray

    def leaf(self, terms: list[bytes]) -> int:
        own = [t for t in map(self.terms.get, terms) if t is not None]
        node, inner = 0, len(self.cuts)
        while node < inner:
            cost = float(self.costs[node, own].sum(dtype=np.float64)) if own else 0.0
            node = 2 * node + (1 if cost <= self.cuts[node] else 2)
        return node - inner


def _bits(degree: np.ndarray, n: int) -> np.ndarray:
    """Bits of a term's postings among n documents, estimated by their even gaps."""
    return degree * np.log2(max(n, 1) / (degree + 1.0))


def _halves(starts: np.ndarray, flat: np.ndarray, docs: np.ndarray, width: int, rounds: int):
    """docs in two halves of least cost, by swaps of the documents that gain most, and the terms' degrees."""
    lengths = np.diff(starts)[docs]
    own = np.concatenate([flat[starts[d] : starts[d + 1]] for d in docs]) if len(docs) else flat[:0]
    row = np.repeat(np.arange(len(docs)), lengths)
    right = np.arange(len(docs)) >= len(docs) // 2
    for turn in range(rounds + 1):
        n_l, n_r = int((~right).sum()), int(right.sum())
        d_l = np.bincount(own[~right[row]], minlength=width).astype(np.float64)
        d_r = np.bincount(own[right[row]], minlength=width).astype(np.float64)
        if turn == rounds:
            break
        now = _bits(d_l, n_l) + _bits(d_r, n_r)
        to_r = now - _bits(np.maximum(d_l - 1, 0), n_l) - _bits(d_r + 1, n_r)
        to_l = now - _bits(d_l + 1, n_l) - _bits(np.maximum(d_r - 1, 0), n_r)
        gain = np.bincount(row, np.where(right[row], to_l[own], to_r[own]), len(docs))
        l, r = np.flatnonzero(~right), np.flatnonzero(right)
        l, r = l[np.argsort(-gain[l], kind="stable")], r[np.argsort(-gain[r], kind="stable")]
        n = min(len(l), len(r))
        swap = gain[l[:n]] + gain[r[:n]] > 1e-9
        if not swap.any():
            break
        right[l[:n][swap]], right[r[:n][swap]] = True, False
    return docs[~right], docs[right], d_l, d_r


def bisect(texts: list[list[bytes]], depth: int = 6, vocabulary: int = 30_000, rounds: int = 12) -> Tree:
    """The tree of a sample (a list of terms for each document).  Terms of one document alone don't count, of
    the others the ``vocabulary`` most frequent do."""
    df = Counter(t for terms in texts for t in set(terms))
    known = sorted((t for t, n in df.items() if n > 1), key=lambda t: (-df[t], t))[:vocabulary]
    at = {t: i for i, t in enumerate(known)}
    rows = [sorted({at[t] for t in terms if t in at}) for terms in texts]
    starts = np.cumsum([0, *map(len, rows)])
    flat = np.array([t for r in rows for t in r], np.int64)
    costs, cuts = np.zeros((2**depth - 1, max(len(known), 1)), np.float32), np.zeros(2**depth - 1)
    parts = {0: np.arange(len(rows))}
    for node in range(2**depth - 1):
        docs = parts.pop(node)
        left, right, d_l, d_r = _halves(starts, flat, docs, len(known), rounds)
        more = lambda d, n: _bits(d + 1, n) - _bits(d, n)
        if len(known) and len(docs):
            costs[node, : len(known)] = more(d_l, len(left)) - more(d_r, len(right))
            own = np.array([costs[node, flat[starts[d] : starts[d + 1]]].sum(dtype=np.float64) for d in docs])
            cuts[node] = np.median(own)
        parts |= {2 * node + 1: left, 2 * node + 2: right}
    return Tree(at, costs, cuts)


def fit_tree(docs: DataFrame, max_docs: int = 4096, max_chars: int = 20_000_000) -> Tree:
    sample = bounded_sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null"), max_docs, max_chars)
    return fitted(sample, lambda rows: bisect([terms_of(text) for _, text in rows]))


# --------------------------------------------------------------------------------- the index


@dataclass
class Index:
    postings: DataFrame  # shard, term, gaps (of places), tfs (16 bits each), df, top (impact)
    shards: DataFrame  # shard, ids and ms (64 bits each), nulls (a byte each)
    n_docs: int
    n_terms: int


def vectors(docs: DataFrame, tree: Tree) -> DataFrame:
    """leaf, doc_id, n (terms with repeats), terms (joined by a space), tfs (32 bits each)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                leaf, n, terms, tfs = [], [], [], []
                for text in part.column(1).to_pylist():
                    all_ = terms_of(text)
                    tf = Counter(all_)
                    leaf.append(tree.leaf(list(tf)))
                    n.append(len(all_))
                    terms.append(b" ".join(tf))
                    tfs.append(np.fromiter(tf.values(), np.uint32, len(tf)).tobytes())
                cols = [pa.array(leaf, pa.int32()), part.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["leaf", "doc_id", "n", "terms", "tfs"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "leaf int, doc_id long, n long, terms binary, tfs binary")


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a posting adds to a score for each unit of its term's weight."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _invert(ms: np.ndarray, terms: list[bytes], tfs: list[bytes]):
    """Of a shard's documents: distinct terms, and where each begins in the places, counts and impacts."""
    at: dict[bytes, int] = {}
    number = [[at.setdefault(t, len(at)) for t in own.split(b" ")] for own in terms]
    lengths = np.array([len(x) for x in number])
    term = np.concatenate([np.array(x, np.int64) for x in number])
    doc = np.repeat(np.arange(len(ms)), lengths)
    tf = np.concatenate([np.frombuffer(x, np.uint32) for x in tfs]).astype(np.int64)
    order = np.argsort(term, kind="stable")
    cuts = np.searchsorted(term[order], np.arange(len(at) + 1))
    return list(at), cuts, doc[order], tf[order], impact(tf, ms[doc])[order]


def build(docs: DataFrame, tree: Tree | None = None) -> Index:
    """The index of docs (doc_id, text), written to the shared folder."""
    held, folder = written(vectors(docs, tree or fit_tree(docs)), "vectors")
    rows = held.filter("n > 0")
    counted = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    n_docs, n_terms = counted.n, counted.l
    schema = "shard long, term binary, a binary, b binary, c binary, df long, top long"

    def shards(batches):
        base, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []
        size = 0

        def done():
            ids, ns, terms, tfs = map(list, zip(*held))
            ms = np.array([50 + 50 * n * n_docs // n_terms for n in ns], np.int64)
            found, cuts, doc, tf, gain = _invert(ms, terms, tfs)
            own = pa.array([base + made], pa.int64())
            names = ["shard", "term", "a", "b", "c", "df", "top"]
            blobs = [np.array([x or 0 for x in ids], np.int64), ms, np.array([x is None for x in ids], np.uint8)]
            yield pa.RecordBatch.from_arrays([own, pa.array([b""], pa.binary()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs), pa.array([len(ids)], pa.int64()), pa.array([0], pa.int64())], names=names)
            gap = np.diff(doc, prepend=0)
            gap[cuts[:-1]] = doc[cuts[:-1]]
            for at in range(0, len(found), 4096):
                e = min(at + 4096, len(found))
                s, c = slice(int(cuts[at]), int(cuts[e])), cuts[at : e + 1] - cuts[at]
                blob = lambda x: pa.Array.from_buffers(pa.binary(), e - at, [None, pa.py_buffer((c * x.itemsize).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(x[s]).tobytes())])  # noqa: E731, B023
                # a count beyond 16 bits goes as 0 and whole in the third column
                wide = pa.array([tf[x:y].tobytes() if tf[x:y].max() > 65535 else None for x, y in zip(cuts[at:e].tolist(), cuts[at + 1 : e + 1].tolist())], pa.binary())
                top = np.maximum.reduceat(gain[s], c[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(e - at, base + made)), pa.array(found[at:e], pa.binary()), blob(gap.astype(np.uint16)), blob(np.where(tf > 65535, 0, tf).astype(np.uint16)), wide, pa.array(np.diff(c)), pa.array(top)], names=names)

        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                    own = len(row[3]) // 4
                    if held and (len(held) == SHARD_DOCS or size + own > SHARD_POSTINGS):
                        yield from done()
                        made, size, held = made + 1, 0, []
                    held.append(row)
                    size += own
        if held:
            yield from done()

    keys = ["leaf", "doc_id", F.xxhash64("terms")]
    parts = 4 * max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)  # long documents make ranges uneven
    ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    both = staged(ordered.select("doc_id", "n", "terms", "tfs").mapInArrow(shards, schema), "index")
    dropped(docs.sparkSession, folder)
    ids = both.filter(F.octet_length("term") == 0).select("shard", F.col("a").alias("ids"), F.col("b").alias("ms"), F.col("c").alias("nulls"))
    own = both.filter(F.octet_length("term") > 0).select("shard", "term", F.col("a").alias("gaps"), F.col("b").alias("tfs"), F.col("c").alias("wide"), "df", "top")
    return Index(own, ids, n_docs, n_terms)


# --------------------------------------------------------------------------------- the search


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, term: an item's terms once each."""

    def run(batches):
        for b in batches:
            found = [(i, t) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for t in set(terms_of(text))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], b.schema.field(0).type), pa.array([x[1] for x in found], pa.binary())], names=["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"item_id {kind}, term binary").distinct()


def _best(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return rows.select("item", "score", "doc_id", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= k)


def scored(index: Index, visits: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """item, doc_id, score: of each visit (item, shard) the best k documents, with wanted (item, term, weight)."""

    def run(key, table):
        asks, blobs = table.column("asks").to_pylist(), list(zip(*(table.column(c).to_pylist() for c in ("gaps", "tfs", "wide"))))
        head = blobs[asks.index(None)]  # the row of the shard itself
        ids, ms, null = np.frombuffer(head[0], np.int64), np.frombuffer(head[1], np.int64), np.frombuffer(head[2], np.uint8).astype(bool)
        items = sorted({a["item"] for own in asks if own for a in own})
        at = {x: i for i, x in enumerate(items)}
        total = np.zeros((len(items), len(ids)), np.int64)
        for own, (gaps, tfs, wide) in zip(asks, blobs):
            if own is None:
                continue
            places = np.cumsum(np.frombuffer(gaps, np.uint16), dtype=np.int64)
            tf = np.frombuffer(tfs, np.uint16).astype(np.int64) if wide is None else np.frombuffer(wide, np.int64)
            gain = impact(tf, ms[places])
            for a in own:
                total[at[a["item"]], places] += a["weight"] * gain
        out_item, out_doc, out_score = [], [], []
        for i, item in enumerate(items):
            hit = np.flatnonzero(total[i] > 0)
            if len(hit) > k:
                least = np.partition(total[i][hit], len(hit) - k)[len(hit) - k]
                hit = hit[total[i][hit] >= least]
            hit = hit[np.lexsort((ids[hit], ~null[hit], -total[i][hit]))][:k]
            out_item += [item] * len(hit)
            out_doc += [None if null[h] else int(ids[h]) for h in hit]
            out_score += total[i][hit].tolist()
        return pa.table({"item": pa.array(out_item, pa.int64()), "doc_id": pa.array(out_doc, pa.int64()), "score": pa.array(out_score, pa.int64())})

    asks = visits.select("item", "shard").join(wanted, "item").groupBy(F.expr(f"item div {GROUP}").alias("set"), "shard", "term").agg(F.collect_list(F.struct("item", "weight")).alias("asks"))
    rows = asks.join(index.postings.select("shard", "term", "gaps", "tfs", "wide"), ["shard", "term"]).select("set", "shard", "asks", "gaps", "tfs", "wide")
    # a shard's ids go to each of its groups once, in a row without asks
    heads = visits.select(F.expr(f"item div {GROUP}").alias("set"), "shard").distinct().join(index.shards, "shard")
    heads = heads.select("set", "shard", F.lit(None).cast(rows.schema["asks"].dataType).alias("asks"), F.col("ids").alias("gaps"), F.col("ms").alias("tfs"), F.col("nulls").alias("wide"))
    return rows.unionByName(heads).groupBy("set", "shard").applyInArrow(run, "item long, doc_id long, score long")


def search(index: Index, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents, all if fewer have a term of it."""
    terms = staged(query_terms(items), "terms")
    named = staged(numbered(terms.select("item_id").distinct(), [], ["item_id"], "item"), "items")
    df = index.postings.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * index.n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    numbers = terms.join(named, terms.item_id.eqNullSafe(named.item_id)).select("item", "term")
    wanted = staged(numbers.join(df, "term").select("item", "term", weight.alias("weight")), "wanted")
    bound = wanted.join(index.postings.select("shard", "term", "top"), "term").groupBy("item", "shard").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"))
    order = staged(numbered(bound.filter("bound > 0"), ["item"], [F.desc("bound"), F.col("shard")], "place"), "order")
    most = order.agg(F.max("place")).first()[0]
    best, low, high = None, 0, FIRST
    while most is not None and low <= most:
        visits = order.filter((F.col("place") >= low) & (F.col("place") < high))
        if best is not None:
            last = best.filter(F.col("rank") == k).select("item", F.col("score").alias("least"))
            visits = visits.join(last, "item", "left").filter(F.col("bound") >= F.coalesce("least", F.lit(1)))
        visits = staged(visits.select("item", "shard"), "visits")
        if visits.isEmpty():
            break
        found = scored(index, visits, wanted, k)
        before = best.select("item", "doc_id", "score") if best is not None else None
        best = staged(_best(found if before is None else before.unionByName(found), k), "best")
        low, high = high, high * GROWTH
    if best is None:
        best = named.sparkSession.createDataFrame([], "item long, score long, doc_id long, rank int")
    return best.join(named, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
