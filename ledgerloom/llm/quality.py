"""Quality rules and a hashed n-gram likelihood ratio.

Rules count words, symbols, repeated lines and words in repeated 3-word windows.  The ratio compares
two multinomials over hashed 4-byte n-grams: that of a trusted target (documents labelled good) and
that of the raw corpus.  A document's score is the sum of its n-grams' log ratios over their number
plus ``shrink``, so that very short texts stay near 0; it is kept if that reaches ``threshold``, the
same fixed number for every document.

Raw counts are of all documents.  The target is a sample of at most ``max_target`` labelled
documents (those of the smallest id hashes), so the list of their ids may be broadcast.  Counts come
back as ``BUCKETS`` sums whatever the input; tasks add up their own documents first.

Nulls: a null text has no word and fails the rules; null labels are no target.  Empty tables give no
row; without any target the ratio is 0 everywhere.  Repeated rows each count and each get a row.
Columns besides id and text are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

BUCKETS = 1 << 16
NGRAM = 4
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"


def hashed(raw: bytes) -> np.ndarray:
    """Bucket of each n-gram of bytes."""
    b = np.frombuffer(raw, np.uint8)
    if len(b) < NGRAM:
        return np.empty(0, np.int64)
    n = len(b) - NGRAM + 1
    v = b[:n].astype(np.uint32)
    for k in range(1, NGRAM):
        v |= b[k : n + k].astype(np.uint32) << np.uint32(8 * k)
    v *= np.uint32(2654435761)
    return v >> np.uint32(16)


def rules(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    words = raw.split()  # of bytes: at ASCII space only
    n = len(words)
    plain = raw.translate(None, _SPACE)
    chars = len(plain) if plain.isascii() else len(plain.decode("utf-8", "surrogatepass"))
    symbols = len(plain) - len(plain.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
    again = 0
    if n >= 4:
        number: dict[bytes, int] = {}
        w = np.array([number.setdefault(x, len(number)) for x in words], np.int64)
        m = len(number)
        two = w[:-1] * m + w[1:]
        if m >= 1 << 20:  # keep three numbers within 63 bits
            two = np.unique(two, return_inverse=True)[1]
        three = two[:-1] * m + w[2:]
        order = np.argsort(three, kind="stable")
        same = three[order][1:] == three[order][:-1]
        hit = np.zeros(len(three) + 2, bool)
        at = np.concatenate([order[1:][same], order[:-1][same]])
        for k in range(3):
            hit[at + k] = True
        again = int(hit.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), again


def target_ids(labels: DataFrame, max_target: int) -> DataFrame:
    """Ids of at most ``max_target`` documents labelled good."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target)


def log_ratios(docs: DataFrame, labels: DataFrame, max_target: int = 20_000, smoothing: float = 0.5) -> np.ndarray:
    """The log ratio of each bucket."""

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for text, good in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = np.bincount(hashed(text.encode("utf-8", "surrogatepass")), minlength=BUCKETS)
                raw += c
                if good:
                    target += c
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"])

    chosen = F.broadcast(target_ids(labels, max_target).withColumn("good", F.lit(True)))
    counted = id_and_text(docs).join(chosen, "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    sums = counted.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    rows = sums.toPandas()  # BUCKETS rows at most
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[rows.bucket], target[rows.bucket] = rows.raw, rows.target
    if not target.any():
        return np.zeros(BUCKETS)
    of = lambda c: np.log((c + smoothing) / (c.sum() + smoothing * BUCKETS))
    return of(target) - of(raw)


def judge(
    docs: DataFrame,
    ratios: np.ndarray,
    threshold: float = -0.2,
    shrink: float = 50.0,
    min_words: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row for each document: its counts, whether it fails the rules, its score, whether it is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS numbers

    def run(batches):
        weights = shared.value
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                raw = text.encode("utf-8", "surrogatepass")
                counts = rules(raw)
                n, again = counts[0], counts[4]
                failed = n < min_words or 100 * again > 50 * n
                h = hashed(raw)
                score = float(weights[h].sum() / (len(h) + shrink))
                rows.append((*counts, failed, score, not failed and score >= threshold))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds))], names=names)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def filter_quality(docs: DataFrame, labels: DataFrame, max_target: int = 20_000, **limits) -> DataFrame:
    return judge(docs, log_ratios(docs, labels, max_target), **limits)
