"""Toxicity by a subsequence string kernel and a support vector machine on Nystrom landmarks.

The kernel of two words sums, over the subsequences of 3 characters they share, the products of
DECAY^span; a subsequence may skip characters, up to a span of 5.  So an insult with characters put
in or left out still shares most of its subsequences.  Marks are no characters of a subsequence, only
gaps in it.  A word's vector is divided by the norm it would have if no subsequence came twice.

Sentences are labelled as their documents are; which of its words makes a sentence toxic is not
labelled, and some labels are wrong.  So training is multiple-instance: the first witnesses are words
with a character run whose count in toxic and clean documents differs by more than chance (likelihood
ratio above ``bar``), an SVM is trained on witnesses against words of clean documents, each toxic
document names its highest words as witnesses, and so on; documents without any name none.  Witnesses
also train with characters put in.  The SVM works on Nystrom features of landmark words; since the kernel has explicit
features, its weights on landmarks fold into one weight for each subsequence, and scoring a
word is a sum over its subsequences.  A word's margin gives, through a logistic curve, its chance of
being an insult; a document scores as the chance that at least one of its different words is one
(letters spelled with spaces between are joined).  So one sure insult is enough, and so are a few doubtful ones.

The model is learned from a bounded sample of labelled documents (``common.bounded_sample``: ``max_docs``
of each class, ``max_chars`` characters together), in one task; of the sample's words at most
``max_witnesses``, ``max_clean`` and, in each round, ``max_hard`` of the highest clean ones train the machine,
and ``landmarks`` bounds its features.  So the model is bounded and may be broadcast.  All texts
are scored whole.

Nulls: a null or empty text has no words and scores 0; null labels teach
nothing; without both classes every score is 0.  Repeated rows each get a row; empty tables give
none; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fitted, id_and_text, rows_where

DECAY = 0.6
#: Distances of a subsequence's characters from its first.
PATTERNS = [(0, a, b) for b in range(2, 5) for a in range(1, b)]
#: Longer words are scored in overlapping windows.
WINDOW, STEP = 40, 32
TABLE_LIMIT = 400_000
FOLDS = 4
MARKS = ".,;:!?\"'()[]{}<>*#%$&|_-+=/\\~^@`"
_INNER = regex.compile(r"[\p{L}\p{N}].*[\p{L}\p{N}]", regex.S).search
_RUNS = regex.compile(r"(.)\1{2,}", regex.S).sub


def tokens(text: str) -> set[str]:
    """A text's different words, and single letters in a row as one word."""
    words = text.lower().split()
    out = {w.strip(MARKS) for w in set(words)}
    out.discard("")
    single = [i for i, w in enumerate(words) if len(w) == 1]
    if len(single) >= 3:
        run = [single[0]]
        for i in [*single[1:], -9]:
            if i == run[-1] + 1:
                run.append(i)
                continue
            if len(run) >= 3:
                out.add("".join([words[j] for j in run]))
            run = [i]
    return out


def forms(token: str) -> list[str]:
    """What a token is scored by: without outer marks, drawn-out letters twice, in windows if long."""
    if not token.isalnum():
        m = _INNER(token)
        if not m:
            return []
        token = m[0]
    token = _RUNS(r"\1\1", token)
    return [token] if len(token) <= WINDOW else [token[i : i + WINDOW] for i in range(0, len(token) - WINDOW + STEP, STEP)]


def units(text: str) -> set[str]:
    return {f for t in tokens(text) for f in forms(t)}


class Kernel:
    """Explicit kernel features: codes of subsequences over an alphabet of any size; other characters
    have code 0 and are in no subsequence."""

    def __init__(self, alphabet: list[str]):
        self.alphabet = alphabet
        self.code = np.zeros(0x110000, np.int32)
        for i, c in enumerate(self.alphabet):
            self.code[ord(c)] = i + 1
        self.edge = len(alphabet) + 1  # before a word and after it
        self.bits = self.edge.bit_length()  # 21 at most, so three codes are within 63

    def coded(self, words: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length: indices of words, their codes with edges."""
        by = defaultdict(list)
        for i, w in enumerate(words):
            by[len(w)].append(i)
        out = {}
        for n, at in by.items():
            flat = np.frombuffer("".join([words[i] for i in at]).encode("utf-32-le", "surrogatepass"), np.uint32)
            c = np.full((len(at), n + 2), self.edge, np.int32 if self.bits <= 10 else np.int64)
            c[:, 1:-1] = self.code[flat].reshape(len(at), n)
            out[n] = (np.array(at), c)
        return out

    def parts(self, c: np.ndarray):
        """For each pattern: its places' codes (words x places), decay."""
        n = c.shape[1]
        for _, a, b in PATTERNS:
            m = n - b
            if m > 0:
                yield (c[:, :m] << 2 * self.bits) | (c[:, a : a + m] << self.bits) | c[:, b : b + m], DECAY ** (b + 1)

    def norms(self, c: np.ndarray) -> np.ndarray:
        n = c.shape[1]
        full = sum(max(0, n - p[-1]) * DECAY ** (2 * p[-1] + 2) for p in PATTERNS)
        out = np.full(len(c), full)
        odd = np.flatnonzero((c == 0).any(1))
        if len(odd):
            on = c[odd] > 0
            out[odd] = sum((on[:, : n - b] & on[:, a : n - b + a] & on[:, b:]).sum(1) * DECAY ** (2 * b + 2) for _, a, b in PATTERNS if n > b)
        return np.sqrt(np.maximum(out, DECAY**6))

    def entries(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse features of words: rows, keys, values (a key may come more than once in a row)."""
        rows, keys, values = [], [], []
        for n, (at, c) in self.coded(words).items():
            norm = self.norms(c)
            for key, decay in self.parts(c):
                one = (1 << self.bits) - 1
                ok = ((key & one) > 0) & ((key >> self.bits & one) > 0) & (key >> 2 * self.bits > 0)
                rows.append(np.repeat(at, key.shape[1])[ok.ravel()])
                keys.append(key[ok])
                values.append(np.repeat(decay / norm, key.shape[1])[ok.ravel()])
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, keys, values))

    def matrix(self, words: list[str], keys: np.ndarray) -> np.ndarray:
        """Features of words on these (sorted) keys."""
        r, k, v = self.entries(words)
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        ok = keys[at] == k
        flat = np.bincount(r[ok] * len(keys) + at[ok], v[ok], len(words) * len(keys))
        return flat.reshape(len(words), len(keys)).astype(np.float32)


class Model:
    """Subsequence weights, intercept and the curve; scores words at once."""

    def __init__(self, alphabet: list[str], keys: np.ndarray, weights: np.ndarray, intercept: float, slope: float, middle: float):
        self.alphabet, self.keys, self.weights = alphabet, keys, weights
        self.intercept, self.slope, self.middle = intercept, slope, middle
        self.kernel = None

    def __getstate__(self):
        return self.__dict__ | {"kernel": None, "table": None, "seen": None}

    def ready(self) -> None:
        if self.kernel is None:
            self.kernel, self.seen = Kernel(self.alphabet), {}
            self.table = None
            if self.kernel.bits <= 7:
                self.table = np.zeros(1 << 3 * self.kernel.bits, np.float32)  # codes with a 0 keep weight 0
                self.table[self.keys] = self.weights

    def weigh(self, key: np.ndarray) -> np.ndarray:
        """Weights of subsequences: from a table of all codes, or, if that is too large, by search."""
        if self.table is not None:
            return self.table[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.weights[at], 0.0)

    def margins(self, words: list[str]) -> np.ndarray:
        self.ready()
        out = np.full(len(words), self.intercept)
        for n, (at, c) in self.kernel.coded(words).items():
            total = np.zeros(len(at))
            for key, decay in self.kernel.parts(c):
                total += decay * self.weigh(key).sum(1)
            out[at] += total / self.kernel.norms(c)
        return out

    def by_word(self, words) -> dict[str, float]:
        own = list(words)
        return dict(zip(own, self.margins(own).tolist()))

    def score(self, texts: list[str]) -> np.ndarray:
        """Each text's chance that at least one of its different words is an insult."""
        self.ready()
        found = [tokens(t) for t in texts]
        new = [t for t in set().union(*found) if t not in self.seen] if found else []
        if len(self.seen) + len(new) > TABLE_LIMIT:
            self.seen, new = {}, list(set().union(*found))
        for s in range(0, len(new), 20_000):
            part = [forms(t) for t in new[s : s + 20_000]]
            own = np.append(_log_clean(self.margins([f for x in part for f in x]), self.slope, self.middle), 0.0)
            ends = np.cumsum([len(x) for x in part])
            for t, x, e in zip(new[s : s + 20_000], part, ends.tolist()):
                self.seen[t] = float(own[e - 1] if len(x) == 1 else own[e - len(x) : e].min(initial=0.0))
        return np.array([-np.expm1(sum(map(self.seen.__getitem__, own))) for own in found])


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by Newton steps over the rows within the margin."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        on = y * (z @ w) < 1
        zw = z[on] * weight[on, None]
        new = np.linalg.solve(ridge + c * zw.T @ z[on], c * zw.T @ y[on])
        if np.allclose(new, w, rtol=1e-3, atol=1e-3):
            break
        w = new
    return w[:-1], float(w[-1])


def _spelled(word: str, rng: np.random.Generator) -> list[str]:
    """The word with a mark put in at one place, and between all its characters."""
    if len(word) < 4:
        return []
    mark, at = ".-*_"[rng.integers(4)], int(rng.integers(1, len(word)))
    return [word[:at] + mark + word[at:], mark.join(word)]


def _beyond_chance(t: int, c: int, n1: int, n0: int) -> float:
    """Likelihood ratio statistic of being in t of n1 toxic and c of n0 clean documents; 0 if not the more
    frequent among toxic ones."""
    share = (t + c) / (n1 + n0)
    if t <= share * n1:
        return 0.0
    return 2 * (t * np.log(t / (share * n1)) + (c * np.log(c / (share * n0)) if c else 0.0))


def fit(texts: list[list[str]], labels: list[int], landmarks: int = 400, **bounds) -> Model | None:
    """texts: each document's units.  The curve is fitted to margins of documents that the machine which
    gives them has not seen (``FOLDS`` parts), the machine to all."""
    whole = machine(texts, labels, landmarks, **bounds)
    if whole is None:
        return None
    unseen: list[np.ndarray] = [np.empty(0)] * len(texts)
    order = sorted(range(len(labels)), key=lambda i: (labels[i], i))  # each part has its share of both classes
    for fold in range(FOLDS):
        seen = [i for at, i in enumerate(order) if at % FOLDS != fold]
        own = machine([texts[i] for i in seen], [labels[i] for i in seen], landmarks // 2, **bounds)
        if own is None:
            continue
        left = order[fold::FOLDS]
        margin = own.by_word(set().union(*(texts[i] for i in left)))
        for i in left:
            unseen[i] = np.array([m for w in texts[i] if (m := margin[w]) > -0.5])
    whole.slope, whole.middle = _curve(unseen, np.array(labels))
    return whole


def machine(
    texts: list[list[str]],
    labels: list[int],
    landmarks: int = 400,
    rounds: int = 3,
    bar: float = 12.0,
    max_witnesses: int = 3_000,
    max_clean: int = 8_000,
    max_hard: int = 2_000,
    seed: int = 7,
) -> Model | None:
    rng = np.random.default_rng(seed)
    n = Counter(labels)
    if not n[0] or not n[1]:
        return None
    docs = [sorted(t) for t in texts]
    freq = {0: Counter(), 1: Counter()}
    runs = {0: Counter(), 1: Counter()}
    runs_of = lambda w: {m[i : i + 4] for m in (f"\x02{w}\x03",) for i in range(len(m) - 3)}
    for own, y in zip(docs, labels):
        freq[y].update(own)
        runs[y].update(set().union(*map(runs_of, own)) if own else ())
    tells = {g: s for g, t in runs[1].items() if t >= 2 and (s := _beyond_chance(t, runs[0][g], n[1], n[0])) >= bar}
    strength = {w: max((tells.get(g, 0.0) for g in runs_of(w)), default=0.0) for w in freq[1]}
    toxic = [own for own, y in zip(docs, labels) if y == 1]
    # a word may be a witness if most of the documents that hold it are toxic, both classes weighing the same;
    # a few clean ones don't bar it (labels err, texts quote), and a word that is hardly seen needs a telling run
    telling = {w for w, t in freq[1].items() if not freq[0][w] or (t + 0.5) / (n[1] + 1) > 3 * (freq[0][w] + 0.5) / (n[0] + 1)}
    witness = Counter(w for own in toxic for w in own if strength[w] > 0 and w in telling)
    every = sorted(freq[0], key=lambda w: (-freq[0][w], w))
    common, rare = every[: max_clean // 4], every[max_clean // 4 :]
    clean = common + [rare[i] for i in sorted(rng.permutation(len(rare))[: max_clean - len(common)])]
    # every letter and digit of the training words takes part
    kernel = Kernel(sorted(c for c in set().union(*freq[0], *freq[1]) if c.isalnum()))
    model, hard_set = None, set()
    for _ in range(rounds):
        if not witness:
            return None
        pos = sorted(witness, key=lambda w: (-witness[w], w))[:max_witnesses]
        extra = [v for w in pos[: max_witnesses // 3] for v in _spelled(w, rng)]
        half = landmarks // 2
        first = pos[: half // 2]
        others = pos[half // 2 :]
        lm = first + [others[i] for i in rng.permutation(len(others))[: half - len(first)]]
        hard: list[str] = []
        if model is not None:
            # clean documents' words that the last machine takes for insults train the next one
            order = np.argsort(-model.margins(every), kind="stable")[:max_hard]
            hard = [every[i] for i in order]
            clean = list(dict.fromkeys(clean + hard))
        spread = hard[:landmarks] or clean
        lm += [spread[i] for i in rng.permutation(len(spread))[: half // 2]] + [clean[i] for i in rng.permutation(len(clean))[: half // 2]]
        lm = list(dict.fromkeys(lm))
        hard_set.update(hard)
        # clean documents' copies of a witness don't train against it
        clean = [w for w in clean if w not in witness]
        words = pos + extra + clean
        y = np.array([1.0] * (len(pos) + len(extra)) + [-1.0] * len(clean))
        keys = np.unique(kernel.entries(lm)[1])
        dense = kernel.matrix(lm, keys)
        gram = (dense @ dense.T).astype(float)
        value, vector = np.linalg.eigh(gram)
        ok = value > 1e-4 * value[-1]
        root = vector[:, ok] / np.sqrt(value[ok])
        # k(word, landmarks) for all words, from the explicit features
        cross = np.vstack([kernel.matrix(words[s : s + 500], keys) @ dense.T for s in range(0, len(words), 500)])
        # a witness counts as often as documents name it; both classes weigh the same
        weight = np.array([float(np.sqrt(witness[w])) for w in pos] + [0.3] * len(extra) + [float(np.sqrt(min(freq[0][w], 100))) * (4 if w in hard_set else 1) for w in clean])
        weight *= np.where(y > 0, 0.5 / weight[y > 0].sum(), 1.0 / max(weight[y < 0].sum(), 1e-9)) * 400
        beta, intercept = _svm(cross @ root, y, weight)
        model = Model(kernel.alphabet, keys, (dense.T @ (root @ beta)).astype(np.float64), intercept, 1.0, 0.0)
        # each toxic document names its highest words
        witness = Counter()
        margin = model.by_word(freq[1])
        for own_words in toxic:
            if not own_words:
                continue
            m = np.array([margin[w] for w in own_words])
            for i in np.flatnonzero(m >= max(0.0, m.max() - 0.5)):
                w = own_words[i]
                if w in telling and (strength[w] > 0 or m[i] > 0.5):
                    witness[w] += 1
    return model


def _curve(found: list[np.ndarray], y: np.ndarray) -> tuple[float, float]:
    """Slope and middle of a word's chance of being an insult by its margin: of a grid, those under which
    the documents' labels are likeliest (some labels are wrong, so no document counts as less likely
    than 1 in 50)."""
    owner = np.repeat(np.arange(len(found)), [len(m) for m in found])
    flat = np.concatenate(found) if found else np.empty(0)
    best = (-np.inf, 6.0, 0.6)
    for slope in (4.0, 6.0, 8.0, 12.0):
        for middle in np.arange(0.4, 1.2, 0.05):
            clean = np.exp(np.bincount(owner, _log_clean(flat, slope, middle), len(found)))
            p = np.clip(np.where(y == 1, 1 - clean, clean), 0.02, 1)
            best = max(best, (float(np.log(p).mean()), slope, float(middle)))
    return best[1], best[2]


def _log_clean(margin: np.ndarray, slope: float, middle: float) -> np.ndarray:
    """Log of the chance that a word of this margin is no insult; beyond what the machine asks of an insult
    (a margin of 1) more says nothing more."""
    return -np.logaddexp(0, slope * (np.minimum(margin, 1.0) - middle))


def _fit_rows(landmarks: int):
    return lambda rows: fit([sorted(units(text)) for _, _, text in rows], [y for _, y, _ in rows], landmarks)


def train(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, max_docs: int = 2_500, max_chars: int = 40_000_000, landmarks: int = 400) -> Model | None:
    known = labels.filter("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    if may_learn is not None:
        known = known.filter(may_learn)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda y: known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    chosen = F.broadcast(pick(1).unionByName(pick(0)))
    rows = id_and_text(docs).join(chosen, "doc_id").select("doc_id", "toxic", "text")
    return fitted(bounded_sample(rows, 2 * max_docs, max_chars, ids=chosen), _fit_rows(landmarks))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                s = np.zeros(b.num_rows) if m is None else m.score(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model | None, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose texts score below the threshold (null texts do)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide():
        m = shared.value
        return lambda texts: [True] * len(texts) if m is None else (m.score([t or "" for t in texts]) < threshold).tolist()

    return rows_where(docs, decide, text_col)
