"""Language identification, words first, then ever shorter character n-grams.

A known word scores by its log frequency in each language.  An unseen word falls back to its
character n-grams, five long first: the longest length of which any is known gives the word's score,
the mean of those n-grams' log frequencies.  A text's score for each language is the sum over its
words.  The posterior takes the mean word's score times at most ``trust`` words, since words of
one text are not independent.

The model is learned from a bounded sample of each language's documents (``max_docs``, ``max_chars``), so a
rare language is learned as well, and holds every word and n-gram of it, so it may be broadcast.  Words and
n-grams are known by 64-bit hashes in one sorted array; that two of some hundred thousand
share one has a chance below one in ten million.

Nulls: a null text, or one without a letter, is ``und`` with score 0, as is every text if nothing
could be learned; rows with null language teach nothing.  Ties go to the language first in
alphabetical order.  Repeated rows each get a row; empty tables give none; other columns are ignored.
Words of any length are scored whole, in pieces that bound memory.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_where, staged, temporary

LETTERS = regex.compile(r"\p{L}+").findall
LONGEST = 5
#: n-grams are looked up so many at a time.
PIECE = 1 << 18
#: Words a worker remembers the scores of, and how long they may be.
TABLE_LIMIT, WORD_LIMIT = 300_000, 64
#: Marks of a word's begin and end: codes that no character has.
BEGIN, END = 0x110000, 0x110001


def word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n codes in a row."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.full(m, n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(n):
        h ^= codes[j : j + m]
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' characters between marks, one after the other, and where each word begins."""
    sizes = np.array([len(w) for w in words]) + 2
    starts = np.cumsum(sizes) - sizes
    codes = np.empty(int(sizes.sum()), np.uint64)
    inner = np.ones(len(codes), bool)
    inner[starts] = inner[starts + sizes - 1] = False
    codes[inner] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes[starts], codes[starts + sizes - 1] = BEGIN, END
    return codes, starts


def word_grams(words: list[str], n: int):
    """Pieces of (number of the word, hash) of the words' n-grams; single characters are without marks."""
    codes, starts = coded(words)
    owner = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(codes))))
    for s in range(0, len(codes) - n + 1, PIECE):
        part, of = codes[s : s + PIECE + n - 1], owner[s : s + PIECE + n - 1]
        m = len(part) - n + 1
        inside = of[:m] == of[n - 1 :] if n > 1 else part < BEGIN
        yield of[:m][inside], gram_hashes(part, n)[inside]


class Model:
    """Log frequencies by language: a table with a row for each of the sorted hashes."""

    def __init__(self, langs: list[str], keys: np.ndarray, table: np.ndarray):
        self.langs, self.keys, self.table = langs, keys, table

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's row of the table, -1 if unknown."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def scores(self, words: list[str]) -> np.ndarray:
        """Each word's log frequencies; 0 if nothing of it is known."""
        out = np.zeros((len(words), len(self.langs)))
        row = self.rows(word_hashes(words))
        out[row >= 0] = self.table[row[row >= 0]]
        left = np.flatnonzero(row < 0)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            sums, count = np.zeros((len(left), len(self.langs))), np.zeros(len(left))
            for of, hashes in word_grams([words[i] for i in left], n):
                r = self.rows(hashes)
                of, r = of[r >= 0], r[r >= 0]
                count += np.bincount(of, minlength=len(left))
                for x in range(len(self.langs)):
                    sums[:, x] += np.bincount(of, self.table[r, x], len(left))
            some = count > 0
            out[left[some]] = sums[some] / count[some, None]
            left = left[~some]
        return out


class Scorer:
    """A worker's model with the scores of the words it has seen."""

    def __init__(self, model: Model):
        self.model, self.at = model, {}
        self.rows = np.zeros((TABLE_LIMIT, len(model.langs)), np.float32)

    def learn(self, words: list[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        first = len(self.at)
        for s in range(0, len(new), 20_000):
            self.rows[first + s : first + s + len(new[s : s + 20_000])] = self.model.scores(new[s : s + 20_000])
        self.at.update(zip(new, range(first, first + len(new))))

    def sums(self, text: str) -> tuple[np.ndarray, int]:
        words = LETTERS(text.lower())
        total, count = np.zeros(len(self.model.langs)), len(words)
        for s in range(0, len(words), 100_000):
            part = words[s : s + 100_000]
            try:
                at = [self.at[w] for w in part]
            except KeyError:
                for w in [w for w in part if len(w) > WORD_LIMIT]:
                    total += self.model.scores([w])[0]
                part = [w for w in part if len(w) <= WORD_LIMIT]
                if len(self.at) + len(part) > TABLE_LIMIT:
                    self.at.clear()
                self.learn(part)
                at = [self.at[w] for w in part]
            total += self.rows[at].sum(0, dtype=float)
        return total, count


def _counted(batches):
    """(kind, hash, language, count) of words (kind 0) and n-grams (kind n)."""

    def out(found):
        for lang, words in found.items():
            names, n = list(words), np.array(list(words.values()), np.int64)
            for s in range(0, len(names), 20_000):
                part, weight = names[s : s + 20_000], n[s : s + 20_000]
                pieces = [(0, word_hashes(part), weight)]
                for k in range(1, LONGEST + 1):
                    pieces += [(k, h, weight[of]) for of, h in word_grams(part, k)]
                for kind, h, w in pieces:
                    h, at = np.unique(h, return_inverse=True)
                    w = np.bincount(at, w, len(h)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), pa.array([lang] * len(h), pa.string()), pa.array(w)],
                        names=["kind", "h", "lang", "n"],
                    )

    found: dict[str, Counter] = {}
    for b in batches:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found.setdefault(lang, Counter()).update(LETTERS(text.lower()))
            if sum(map(len, found.values())) > 200_000:
                yield from out(found)
                found = {}
    yield from out(found)


def sampled(rows: DataFrame, max_docs: int, max_chars: int) -> DataFrame:
    """text, lang: of each language's different rows (doc_id, text, lang) those of the smallest hashes, at most
    ``max_docs`` with ``max_chars`` characters together; rows longer than a twentieth of that take no part.  A
    language is sampled however rare it is; the bound is on each."""
    keyed = rows.filter(F.char_length("text") <= max_chars // 20).withColumn("row_hash", F.xxhash64("doc_id", "text"))
    keys = keyed.groupBy("lang", "doc_id", "row_hash").agg(F.max(F.char_length("text")).alias("n"))
    own = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "row_hash")
    first = keys.withColumn("r", F.row_number().over(own)).filter(F.col("r") <= max_docs)
    kept = first.withColumn("upto", F.sum("n").over(own)).filter(F.col("upto") <= max_chars).select("lang", "doc_id", "row_hash")
    kept = staged(kept, "language-keys")  # at most max_docs rows for each language
    return staged(keyed.join(F.broadcast(kept), ["lang", "doc_id", "row_hash"], "left_semi").dropDuplicates(["lang", "doc_id", "row_hash"]).select("text", "lang"), "language-sample")


def train(
    docs: DataFrame,
    may_learn: Column | None = None,
    max_docs: int = 2_500,
    max_chars: int = 7_500_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("doc_id is not null and text is not null and lang is not null")
    if may_learn is not None:
        rows = rows.filter(may_learn)
    sample = sampled(rows, max_docs, max_chars)
    counts = sample.mapInArrow(_counted, "kind int, h long, lang string, n long").groupBy("kind", "h", "lang").agg(F.sum("n").alias("n"))
    with temporary(counts, "language-counts") as counts:
        totals = {(r.kind, r.lang): r.n for r in counts.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()}
        langs = sorted({lang for _, lang in totals})
        if not langs:
            return Model([], np.empty(0, np.uint64), np.empty((0, 0), np.float32))
        by = counts.groupBy("kind", "h").agg(*(F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(langs)))
        got = by.toArrow()
    kind, keys = np.asarray(got.column(0)), np.asarray(got.column(1)).view(np.uint64)
    table = np.empty((len(keys), len(langs)), np.float32)
    for k in range(LONGEST + 1):
        on = kind == k
        for i, x in enumerate(langs):
            table[on, i] = np.log((np.asarray(got.column(i + 2))[on] + 0.5) / (totals.get((k, x), 0) + 0.5 * on.sum()))
    order = np.argsort(keys)
    return Model(langs, keys[order], table[order])


def judged(scorer: Scorer, text: str | None, trust: float) -> tuple[str, float]:
    """A text's language and its posterior."""
    langs = scorer.model.langs
    sums, n = scorer.sums(text) if text and langs else (None, 0)
    if not n:
        return "und", 0.0
    z = sums / n * min(n, trust)
    best = int(np.argmax(z))
    return langs[best], float(1 / np.exp(z - z[best]).sum())


def keep_known(docs: DataFrame, model: Model, wanted: list[str] | None = None, least: float = 0.5, trust: float = 20.0, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose texts are in a (wanted) language with at least this
    score; texts without letters are in none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def decide():
        scorer = Scorer(shared.value)
        ok = set(wanted or scorer.model.langs)
        return lambda texts: [lang in ok and s >= least for lang, s in (judged(scorer, t, trust) for t in texts)]

    return rows_where(docs, decide, text_col)


def predict(docs: DataFrame, model: Model, trust: float = 20.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the language's posterior)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            names, scores = [], []
            for text in b.column(1).to_pylist():
                lang, score = judged(scorer, text, trust)
                names.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
