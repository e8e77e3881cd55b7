"""Near-duplicates by Jaccard similarity of shingle sets, through SetSketch registers.

A document's set is its distinct word shingles, as 64-bit hashes.  A register holds the least of the set's
exponentially distributed hash values on an exponential scale of base ``BASE``, truncated to 16 bits:
``floor(1 - log_BASE(least / RATE))``.  Registers of a union are the larger of both (``merged``), and two
sets agree in a register about as often as their Jaccard similarity says.

Sets that are equal are one from the start, so copies make no pairs.  ``BANDS`` bands of ``ROWS`` registers
post each different set under 64 keys; of the buckets those with the same members count once.  First each
set meets the least set of the buckets it shares most with.  Then the members of a bucket that are still in
different components are compared by their registers: a joint likelihood of the larger, smaller and equal
registers and the known sizes gives the similarity, and those that could reach the threshold meet again with their
full sets, likeliest first.  Every link is verified on the full sets; two that verified links have joined need no
further one, so a bucket hands on a forest, fewer rows than it has members.  A pair is compared in its lowest
common band alone, and a large bucket is dealt in pairs of blocks.

A pair at the threshold of 0.8 shares no band with a probability of 3e-7 and is estimated more than five
standard deviations too low with about as much; above it both vanish quickly.

Nulls, empty texts: no words, set size zero, linked with nothing.  Null ids take part and are no component's
id unless all its ids are null.  Repeated rows stay.  Empty tables give no row.  Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, id_and_text, staged, written
from .simhash import components

WIDTH = 4
BANDS, ROWS = 64, 7
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65534
#: Sets in a block of a bucket; a task compares two blocks at a time.
BLOCK = 1024
_draw = np.random.Generator(np.random.PCG64(20))
_MUL = (_draw.integers(0, 1 << 32, REGISTERS, np.uint32) | np.uint32(1))[:, None]
_ADD = _draw.integers(0, 1 << 32, REGISTERS, np.uint32)[:, None]


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; with fewer words, of the whole sequence."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z, splits at ASCII space
    if not words:
        return np.empty(0, np.uint64)
    n = max(len(words) - width + 1, 1)
    digest = xxhash.xxh64_intdigest
    if width == 4 and len(words) >= 4:
        return np.unique(np.array([digest(b"%b %b %b %b" % s) for s in zip(words, words[1:], words[2:], words[3:])], np.uint64))
    return np.unique(np.array([digest(b" ".join(words[i : i + width])) for i in range(n)], np.uint64))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The set's registers, 16 bits each."""
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(h), 1024):
        np.minimum(least, (h[None, at : at + 1024] * _MUL + _ADD).min(1), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32)
    return np.clip(np.floor(1 - np.log(exponential / RATE) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def similarity(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard similarity of sets of these sizes whose registers are larger (a over b), smaller and,
    for the rest, equal so many times.  The likelihood has one top; it is found by halving."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    equal = REGISTERS - larger - smaller
    c = (BASE - 1) / BASE
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * c) / math.log(BASE)
    dp = lambda x: c / ((1 - np.clip(x, 1e-12, 1) * c) * math.log(BASE))
    for _ in range(24):
        j = (lo + hi) / 2
        x, y = u - v * j, v - u * j
        slope = -larger * v * dp(x) / p(x) - smaller * u * dp(y) / p(y) + equal * (v * dp(x) + u * dp(y)) / np.maximum(1 - p(x) - p(y), 1e-12)
        lo, hi = np.where(slope > 0, j, lo), np.where(slope > 0, hi, j)
    return (lo + hi) / 2


def slack(threshold: float) -> float:
    """Estimates from here on are verified: five standard deviations below the threshold."""
    return threshold - 5 * math.sqrt(threshold * (1 - threshold) / REGISTERS)


def _sketched(batches):
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            size, key, regs = [], [], []
            for text in part.column(1).to_pylist():
                h = shingles(text)
                size.append(len(h))
                key.append(xxhash.xxh3_128_digest(h.tobytes()))
                regs.append(registers(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "n", "set_key", "regs"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def postings(sets: DataFrame) -> DataFrame:
    """key, sid: a row for each band of each set.  A key's lowest bits are its band's number."""

    def post(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                m = _matrix(part.column(1))
                for band in range(BANDS):
                    rows = np.ascontiguousarray(m[:, band * ROWS : (band + 1) * ROWS])
                    width = rows.itemsize * ROWS
                    raw = rows.tobytes()
                    keys = np.array([xxhash.xxh64_intdigest(raw[i : i + width], band) for i in range(0, len(raw), width)], np.uint64)
                    keys = (keys & np.uint64(2**64 - BANDS)) | np.uint64(band)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), part.column(0)], names=["key", "sid"])

    return sets.select("sid", "regs").mapInArrow(post, "key long, sid long")


def buckets(sets: DataFrame) -> DataFrame:
    """key, sid, first, members, bands: the members of each bucket of two sets or more, its least set, how many
    it has and in how many bands the same members meet; of such buckets the lowest band's stands."""
    posted = postings(sets).repartition("key")  # dealt once, for the sums and for the join
    own = posted.groupBy("key").agg(F.count("*").alias("members"), F.min("sid").alias("first"), *(F.bit_xor(F.xxhash64("sid", F.lit(k))).alias(f"sign{k}") for k in (1, 2))).filter("members > 1")
    band = F.col("key").bitwiseAND(BANDS - 1).alias("band")
    own = own.groupBy("members", "first", "sign1", "sign2").agg(F.min(F.struct(band, "key"))["key"].alias("key"), F.count("*").alias("bands"))
    return posted.join(own.select("key", "first", "members", "bands"), "key")


def _compare(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    return similarity((a > b).sum(1).astype(np.float64), (a < b).sum(1).astype(np.float64), n_a.astype(np.float64), n_b.astype(np.float64))


def likely(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b of sid) whose registers allow the threshold."""
    least = slack(threshold)

    def run(batches):
        for b in batches:
            if b.num_rows:
                n_a, n_b = np.asarray(b.column(2)), np.asarray(b.column(4))
                est = _compare(_matrix(b.column(3)), _matrix(b.column(5)), n_a, n_b)
                keep = (est >= least) & (np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9)
                yield b.select(["a", "b"]).filter(pa.array(keep))

    side = lambda s: sets.select(F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), F.col("regs").alias(f"r_{s}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "r_a", "n_b", "r_b")
    return rows.mapInArrow(run, "a long, b long")


def _near(key: int, t: dict[str, np.ndarray], threshold: float):
    """Pairs (i, j, estimate) of a cell's members of different components whose registers allow the
    threshold; a pair is its lowest common band's matter."""
    least, band = slack(threshold), key & (BANDS - 1)
    comp, n, asked, side, regs = (t[c] for c in ("comp", "n", "asked", "side", "regs"))
    two = side.min() != side.max()
    head = np.ascontiguousarray(regs[:, :128])
    low = math.floor(128 * least - 6 * math.sqrt(128 * least * (1 - least)))
    all_ = np.arange(len(comp))
    queries = all_[asked]
    step = max(1, 4096 // len(comp))
    for at in range(0, len(queries), step):
        q = queries[at : at + step]
        i, j = np.repeat(q, len(comp)), np.tile(all_, len(q))
        ok = (comp[i] != comp[j]) & (~asked[j] | (j > i)) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9)
        if two:
            ok &= side[i] != side[j]
        i, j = i[ok], j[ok]
        ok = (head[i] == head[j]).sum(1) >= low
        i, j = i[ok], j[ok]
        if len(i):
            x, y = regs[i], regs[j]
            ok = (x == y).reshape(len(i), BANDS, ROWS).all(2).argmax(1) == band
            est = np.zeros(len(i))
            if ok.any():
                est[ok] = _compare(x[ok], y[ok], n[i[ok]], n[j[ok]])
            ok &= est >= least
            if ok.any():
                yield i[ok], j[ok], est[ok]


def share(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share ``percent`` of their union or more."""
    p, q = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(p) < percent * len(q):
        return False
    both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
    return 100 * both >= percent * (len(p) + len(q) - both)


def _linked(key: int, t: dict[str, np.ndarray], sets: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Verified links of a cell, likeliest first, that join what no link has joined yet."""
    found = list(_near(key, t, percent / 100))
    if not found:
        return []
    i, j, est = map(np.concatenate, zip(*found))
    root = {c: c for c in t["comp"].tolist()}

    def top(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out, comp, full = [], t["comp"].tolist(), [np.frombuffer(x, np.uint64) for x in sets]
    for k in np.argsort(-est, kind="stable").tolist():
        x, y = int(i[k]), int(j[k])
        a, b = top(comp[x]), top(comp[y])
        if a != b and share(full[x], full[y], percent):
            root[max(a, b)] = min(a, b)
            out.append((x, y))
    return out


def _by_cell(rows: DataFrame, own, schema: str) -> DataFrame:
    """rows (key, cell, side, sid, comp, n, asked, regs and maybe hashes) a cell at a time through
    own(key, cell, columns, hashes), which gives a batch's columns; a task holds one cell and one batch."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def done():
            t = pa.Table.from_batches(held).combine_chunks()
            key, cell = np.asarray(t.column("key")), np.asarray(t.column("cell"))
            cols = {c: np.asarray(t.column(c)) for c in ("sid", "comp", "n", "asked", "side")}
            regs, hashes = _matrix(t.column("regs")), t.column("hashes").to_pylist() if "hashes" in t.column_names else None
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(cell) != 0)) + 1
            out = []
            for s, e in zip(np.append(0, cuts).tolist(), np.append(cuts, len(key)).tolist()):
                out += own(int(key[s]), int(cell[s]), {c: v[s:e] for c, v in cols.items()} | {"regs": regs[s:e]}, hashes and hashes[s:e])
            names = [c.split()[0] for c in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out) if out else [()] * len(names))], names=names)

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                key, cell = np.asarray(b.column(0)), np.asarray(b.column(1))
                ends = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
                last = int(ends[-1]) + 1 if len(ends) else 0  # rows of the last cell wait for the next batch
                if last:
                    held.append(b.slice(0, last))
                elif held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) == (int(key[0]), int(cell[0])):
                    held.append(b)
                    continue
                if held:
                    yield done()
                held = [b.slice(last)]
        if held:
            yield done()

    return rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "sid").mapInArrow(run, schema)


CELL = ["key", "cell", "side", "sid", "comp", "n", "asked", "regs"]


def doubtful(live: DataFrame, threshold: float) -> DataFrame:
    """key, cell, sid: members that could be linked, by their registers, with one of another component.  Members,
    not pairs: as many rows at most as the cells have."""

    def own(key, cell, t, _):
        met = {int(x) for i, j, _ in _near(key, t, threshold) for x in (*i.tolist(), *j.tolist())}
        return [(key, cell, int(t["sid"][x])) for x in sorted(met)]

    return _by_cell(live.select(*CELL), own, "key long, cell long, sid long")


def joined(live: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """a, b: links, verified on the full sets within their cell, that join components of live members."""

    def own(key, cell, t, hashes):
        sid = t["sid"].tolist()
        return [(min(sid[x], sid[y]), max(sid[x], sid[y])) for x, y in _linked(key, t, hashes, percent)]

    return _by_cell(live.join(full, "sid").select(*CELL, "hashes"), own, "a long, b long").distinct()


def in_cells(members: DataFrame) -> DataFrame:
    """Buckets (key, comp, sid) of more than one component dealt for comparison in blocks of ``BLOCK`` members: a
    cell is a pair of blocks, or one with itself.  Asked are members that aren't of the largest component."""
    by = members.groupBy("key", "comp").agg(F.count("*").alias("c"))
    main = by.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.ceil(F.sum("c") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("comps")).filter("comps > 1")
    rows = members.join(main.drop("comps"), "key").withColumn("asked", F.col("comp") != F.col("main")).drop("main")
    rows = rows.withColumn("side", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    many = rows.filter("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.least("side", "other") * F.col("blocks") + F.greatest("side", "other")
    one = rows.filter("blocks = 1").withColumn("cell", F.lit(0).cast("long"))
    return one.unionByName(many.withColumn("cell", cell.cast("long")).drop("other")).drop("blocks")


def verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets (sid, hashes) share ``percent`` of their union or more."""

    def run(batches):
        for b in batches:
            keep = [share(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda s: full.select(F.col("sid").alias(s), F.col("hashes").alias(f"h_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "h_a", "h_b").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid, hashes: the sets of the wanted (sid, first_doc, set_key), made again from their texts."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                made = [shingles(t).tobytes() for t in part.column(2).to_pylist()]
                keep = [xxhash.xxh3_128_digest(h) == k for h, k in zip(made, part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["sid", "hashes"]).filter(pa.array(keep, pa.bool_()))

    rows = docs.join(wanted, docs.doc_id.eqNullSafe(wanted.first_doc)).select("sid", "set_key", "text")
    return rows.mapInArrow(run, "sid long, hashes binary").dropDuplicates(["sid"])


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id)."""
    threshold, spark, folders = percent / 100, docs.sparkSession, []

    def held(df: DataFrame, what: str) -> DataFrame:
        out, path = written(df, what)
        folders.append(path)
        return out

    own = id_and_text(docs, id_col, text_col)
    sketched, first = written(own.mapInArrow(_sketched, "doc_id long, n long, set_key binary, regs binary"), "sketches")
    rows = staged(sketched.select("doc_id", "n", "set_key"), "rows")
    one = sketched.filter("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("first_doc"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    sets = held(one.withColumn("sid", F.monotonically_increasing_id()), "sets")
    dropped(spark, first)
    members = held(buckets(sets), "buckets")
    wanted = sets.join(members.select("sid").distinct(), "sid", "left_semi").select("sid", "first_doc", "set_key")
    full = held(full_sets(own, wanted), "full")

    star = members.filter("sid <> first").groupBy("sid", "first").agg(F.sum("bands").alias("bands"))
    star = star.groupBy("sid").agg(F.max_by("first", F.struct("bands", -F.col("first"))).alias("first")).select(F.col("first").alias("a"), F.col("sid").alias("b"))
    links = held(verified(likely(star, sets, threshold), full, percent), "star")
    # each set has one star pair, so its least set is a label as it is: sets of one label are connected
    labelled = members.join(links.select(F.col("b").alias("sid"), "a"), "sid", "left").select("key", "sid", F.coalesce("a", "sid").alias("comp"))
    live = in_cells(held(labelled, "labelled")).join(sets.select("sid", "n", "regs"), "sid")
    doubt = held(doubtful(live, threshold), "doubtful")
    live = live.join(doubt, ["key", "cell", "sid"], "left_semi")
    links = held(links.unionByName(joined(live, full, percent)), "links")
    roots = staged(components(links), "roots")
    member = sets.join(roots, sets.sid == roots.id, "left").select("set_key", "first_doc", F.coalesce("root", "sid").alias("root"))
    least = member.groupBy("root").agg(F.min("first_doc").alias("component"))
    by_set = staged(member.join(least, "root").select("set_key", "component"), "components")
    for path in folders:
        dropped(spark, path)
    rows = rows.join(by_set, "set_key", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
