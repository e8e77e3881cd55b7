"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs ``linear * n + quadratic * n^2`` (attention is quadratic within a piece).
Documents are cut into pieces of a whole sequence and a rest; rests, longest first, go to the
sequence of the lowest cost so far that has room.  A rest that no open sequence has room for is cut
over those with most room until what is left of it fits in one.  Each group of documents opens as many
sequences as its rests need: padding is below one sequence a group.

A group is what a task reads until it holds ``group_tokens`` tokens, so memory is bounded and no
row is shuffled; ids never leave the task that made them.  sequence_id has the task's number
in its upper bits.

Nulls: a null text is empty and becomes a piece of the end id alone.  Repeated ids or rows are each
packed.  Empty tables give no row.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bytelevel import encoder
from .common import id_and_text

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECE_IDS = PIECE + ", ids array<int>"
NONE = (float("inf"), -1)


def plan(lengths: list[int], capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) for documents of these lengths, and the
    number of sequences used.  Every token is in exactly one piece; offsets have no gap."""
    pieces, rests, used = [], [], 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            pieces.append((doc, start, capacity, used, 0))
            used += 1
        if n % capacity:
            rests.append((n % capacity, doc, n - n % capacity))
    rests.sort(key=lambda r: (-r[0], r[1]))
    bins = -(-sum(r[0] for r in rests) // capacity)
    fill = [0] * bins
    cost = [0.0] * bins
    # open sequences by room: a heap (cost, bin) for each, under a tree of the cheapest at each range of rooms
    room: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    half = 1 << capacity.bit_length()
    tree = [NONE] * (2 * half)

    def renew(r: int) -> None:
        i, best = half + r, room[r][0] if room[r] else NONE
        while i and tree[i] != best:
            tree[i] = best
            i >>= 1
            best = min(tree[2 * i], tree[2 * i + 1]) if i else NONE

    def cheapest(n: int) -> int:
        """The cheapest open sequence with room for n, or -1."""
        i = half + n
        best = tree[i]
        while i > 1:
            if not i & 1:
                best = min(best, tree[i + 1])
            i >>= 1
        return best[1]

    def emptiest() -> int:
        """The cheapest of the open sequences with most room."""
        i = 1
        while i < half:
            i = 2 * i + (tree[2 * i + 1] is not NONE)
        return tree[i][1]

    def put(doc: int, start: int, n: int, b: int) -> None:
        r = capacity - fill[b]
        heapq.heappop(room[r])  # b: it is the cheapest with this room
        renew(r)
        pieces.append((doc, start, n, used + b, fill[b]))
        fill[b] += n
        cost[b] += linear * n + quadratic * n * n
        if n < r:
            heapq.heappush(room[r - n], (cost[b], b))
            renew(r - n)

    room[capacity] = [(0.0, b) for b in range(bins)]
    renew(capacity)
    for n, doc, start in rests:
        found = cheapest(n)
        while found < 0:  # no room for all of it: cut over the sequences with most room
            b = emptiest()
            k = min(n, capacity - fill[b])
            put(doc, start, k, b)
            start, n = start + k, n - k
            found = cheapest(n) if n else 0
        if n:
            put(doc, start, n, found)
    return pieces, used + bins


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 1024,
    end_id: int = 0,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    group_tokens: int = 16_000_000,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each piece; with its ids too, if ``with_ids``."""

    def flush(ids, docids, base):
        pieces, n = plan([len(x) + 1 for x in ids], capacity, linear, quadratic)
        cols: list[list] = [[] for _ in range(8)]
        for d, start, length, seq, offset in pieces:
            own = np.empty(length, "<u4")
            part = ids[d][start : start + length]
            own[: len(part)] = part
            own[len(part) :] = end_id
            for c, v in zip(cols, (docids[d], start, length, zlib.crc32(own), len(ids[d]) + 1, base + seq, offset)):
                c.append(v)
            if with_ids:
                cols[7].append(own.astype(np.int32))
            if len(cols[0]) == 4096:
                yield batch(cols)
                cols = [[] for _ in range(8)]
        if cols[0]:
            yield batch(cols)

    def batch(cols):
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
        if with_ids:
            arrays, names = [*arrays, pa.array(cols[7], pa.list_(pa.int32()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches):
        enc, base = encoder(tokenizer), TaskContext.get().partitionId() << 36
        ids, docids, held = [], [], 0
        for b in batches:
            for doc_id, x in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
                ids.append(x)
                docids.append(doc_id)
                held += len(x) + 1
                if held >= group_tokens:
                    yield from flush(ids, docids, base)
                    base += held  # more than the sequences used
                    ids, docids, held = [], [], 0
        if ids:
            yield from flush(ids, docids, base)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, PIECE_IDS if with_ids else PIECE)
