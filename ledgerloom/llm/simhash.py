"""SimHash near-duplicates through an index of byte positions with count filtering.

Two 64-bit fingerprints at ``radius`` 3 or fewer differing bits differ in at most 3 of their 8
bytes, so they share at least 5 bytes in place.  Of the 70 sets of four byte positions, 14 are
enough that every set of five holds one of them (both halves of the word, and each pair of the left
half with the pairs of the right half of its class in a pairing of four things).  Each different
fingerprint is posted under those 14 keys (set, its four bytes: 32 bits).  Within a posting list,
shared positional bytes are tallied for each pair, pairs with 5 or more are verified bit by bit.

Equal fingerprints are one entry from the start, so copies make no pairs.  A long posting list is
split by a fifth shared byte (5 shared of 8 with 4 given leave one more among the other four), and
where such a part is still long, each entry looks up the words within the radius instead of
meeting all others: work is linear in the list.  A list only hands on the links of a spanning forest,
fewer than its entries, which keeps what is connected.  Components come from iterated
joins of those links, cut by checkpoints.

Nulls: a null or empty text has fingerprint zero, linked like any other.  Rows with a null id take
part, and null is no component's id unless all its ids are null.  Repeated rows stay.  Empty tables
give no row.  Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, staged

SEED = 42
BYTES = 8
#: Posting lists up to here are compared pair by pair; longer ones are split, then looked up.
PAIRWISE = 512
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def key_sets() -> list[tuple[int, ...]]:
    """Sets of four of eight positions such that any five positions hold one."""
    pairings = [((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2))]
    return [(0, 1, 2, 3), (4, 5, 6, 7)] + [(*x, *(y + 4 for y in z)) for p in pairings for x in p for z in p]


def fingerprint(text: str, width: int = 3) -> int:
    """A bit is 1 if set in over half the hashes of the word shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z, splits at ASCII space
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    hashes = [digest(b"%b %b %b" % s, SEED) for s in zip(words, words[1:], words[2:])] if width == 3 else [
        digest(b" ".join(words[i : i + width]), SEED) for i in range(len(words) - width + 1)
    ]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # a bounded piece of the bit matrix at a time
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and, if ``keyed``, text_key, a digest of the text."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64)
            more = [b.column(2)] if keyed else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *more], names=["doc_id", "fp", *(["text_key"] if keyed else [])])

    own = id_and_text(docs, id_col, text_col)
    if keyed:
        own = own.withColumn("text_key", F.md5("text"))
    return own.mapInArrow(run, "doc_id long, fp long" + ", text_key string" * keyed)


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _BITS[(x ^ y).view(np.uint8).reshape(-1, 8)].sum(1)


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph with these links."""
    root, kept = list(range(n)), []
    for a, b in zip(x.tolist(), y.tolist()):
        ra, rb = a, b
        while root[ra] != ra:
            root[ra] = ra = root[root[ra]]
        while root[rb] != rb:
            root[rb] = rb = root[root[rb]]
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept


def _pairs(fp: np.ndarray, radius: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked pairs in a short list: tally shared bytes, then verify."""
    i, j = np.triu_indices(len(fp), 1)
    view = fp.view(np.uint8).reshape(-1, BYTES)
    shared = (view[i] == view[j]).sum(1)
    near = shared >= need
    i, j = i[near], j[near]
    near = _distance(fp[i], fp[j]) <= radius
    return i[near], j[near]


def links(fp: np.ndarray, positions: tuple[int, ...], radius: int = 3) -> list[tuple[int, int]]:
    """Forest of the links among different fingerprints that share the bytes at ``positions``."""
    need = BYTES - radius
    if len(fp) <= PAIRWISE:
        return _forest(len(fp), *_pairs(fp, radius, need))
    view = fp.view(np.uint8).reshape(-1, BYTES)
    found_x, found_y = [], []
    for extra in (p for p in range(BYTES) if p not in positions):
        order = np.argsort(view[:, extra], kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(view[order, extra])) + 1):
            if len(part) < 2:
                continue
            if len(part) <= PAIRWISE:
                i, j = _pairs(fp[part], radius, need)
                found_x.append(part[i])
                found_y.append(part[j])
                continue
            # all words within the radius on the bits that may differ, looked up in sorted order
            rank = part[np.argsort(fp[part])]
            own = fp[rank]
            free = [8 * p + k for p in range(BYTES) if p != extra and p not in positions for k in range(8)]
            for size in range(1, radius + 1):
                for bits in combinations(free, size):
                    other = own ^ np.uint64(sum(1 << b for b in bits))
                    at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    hit = (own[at] == other) & (own < other)
                    if hit.any():
                        found_x.append(rank[hit])
                        found_y.append(rank[at[hit]])
    if not found_x:
        return []
    return _forest(len(fp), np.concatenate(found_x), np.concatenate(found_y))


def near_links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """a, b: links (a spanning forest of each posting list) among different fingerprints (column
    fp).  A list's length is that of different fingerprints with four equal bytes."""
    if radius != 3:
        raise ValueError("the key sets are those of radius 3")
    sets = key_sets()

    def post(batches):
        for b in batches:
            fp = np.asarray(b.column(0)).view(np.uint64)
            view = fp.view(np.uint8).reshape(-1, BYTES)
            for k, s in enumerate(sets):
                key = view[:, s].copy().view(np.uint32).ravel().astype(np.int64) | (k << 32)
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0)], names=["k", "fp"])

    def match(batches):
        held_k, held = np.empty(0, np.int64), np.empty(0, np.int64)

        def done(k, fp):
            out_x, out_y = [], []
            cuts = np.append(np.flatnonzero(np.diff(k)) + 1, len(k))
            starts = np.append(0, cuts[:-1])
            for s, e in zip(starts[cuts - starts > 1].tolist(), cuts[cuts - starts > 1].tolist()):
                own = np.ascontiguousarray(fp[s:e]).view(np.uint64)
                for x, y in links(own, sets[int(k[s]) >> 32], radius):
                    out_x.append(int(fp[s + x]))
                    out_y.append(int(fp[s + y]))
            return pa.RecordBatch.from_arrays([pa.array(out_x, pa.int64()), pa.array(out_y, pa.int64())], names=["a", "b"])

        parts_k, parts = [], []
        for b in batches:
            k, fp = np.asarray(b.column(0)), np.asarray(b.column(1))
            if not len(k):
                continue
            last = int(np.searchsorted(k, k[-1]))  # rows of the last key wait for the next batch
            if last == 0:
                parts_k.append(k)
                parts.append(fp)
                continue
            k0, f0 = np.concatenate([*parts_k, k[:last]]), np.concatenate([*parts, fp[:last]])
            parts_k, parts = [k[last:]], [fp[last:]]
            yield done(k0, f0)
        if parts_k:
            yield done(np.concatenate(parts_k), np.concatenate(parts))

    posted = distinct.select("fp").mapInArrow(post, "k long, fp long")
    return posted.repartition("k").sortWithinPartitions("k", "fp").mapInArrow(match, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id, root (least id reachable) of each id in links (a, b), by alternating large-star and
    small-star steps until a round changes nothing; each round is written to the shared folder."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        # every node with its neighbours; the least of them (and itself) becomes their parent
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if large:
            moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(joined.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return moved.filter("a <> b").distinct()

    now = edges.filter("a <> b").distinct().checkpoint()
    before = None
    while True:
        now = star(star(now, True), False).checkpoint()
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits), component_id (smallest doc_id reachable), root (the component's
    smallest fingerprint) and, if ``keyed``, text_key."""
    fps = staged(fingerprints(docs, width, id_col, text_col, keyed), "fps")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(near_links(distinct.select("fp"), radius))
    member = distinct.join(roots, distinct.fp == roots.id, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = member.join(least, "root").select("fp", "component_id", "root")
    more = ["text_key"] if keyed else []
    return fps.join(by_fp, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", *more)


def keep_one(docs: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, all columns, of each component: of its smallest id (null after all others), of the
    texts under that id the one whose digest is least; of rows that repeat both, any one (by a hash of all
    columns).  Rows are told apart by id and text, so other texts under a null or repeated id stay."""
    found = near_duplicates(docs, width, radius, id_col, text_col, keyed=True)
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    first = found.groupBy("root").agg(F.min(at).alias("at")).select(F.col("at.doc_id").alias("__id"), F.col("at.text_key").alias("__key"))
    key = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    kept = docs.withColumn("__text", key).join(first, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key")), "left_semi")
    one = kept.groupBy(id_col, "__text").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row"))
    return one.select("__row.*")
