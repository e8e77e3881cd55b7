"""BPE encoding and decoding by a pair occurrence index.

All new words of a batch of documents lie end to end in one symbol array with links to the next and
previous live symbol.  An index maps the rank of each mergeable pair to all positions where it
occurs; a heap holds the active ranks.  The lowest rank is taken, all its positions are merged at
once (from the left where they overlap), and the pairs that this makes are added to the lists of
their ranks.  Where a merge can make a pair of a lower rank than its own, only the first position of
each word is merged at a time, so that the result is what merging each word alone would give.

Words are independent, so a worker keeps those it has seen in a bounded table and a document is its
words' ids in order.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import PLAIN, id_and_text

TABLE_LIMIT = 300_000
#: Symbols indexed at once; new words beyond it wait for the next index.
INDEX_SYMBOLS = 8_000_000
#: The word rule of the vocabulary, a fixed value; applied to lower-cased text.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall

_loaded: dict[str, "PairBpe"] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the rest for characters from U+0100 on, in order."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


def encoder(path: str) -> "PairBpe":
    if path not in _loaded:
        _loaded[path] = PairBpe(path)
    return _loaded[path]


class PairBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        self.normalize = lib.normalizer.normalize_str if lib.normalizer else str
        self.split = lib.pre_tokenizer.pre_tokenize_str
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.text = {i: t for t, i in self.vocab.items()}
        self.size = max(self.vocab.values()) + 1
        end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text |= {i: t for t, i in self.special.items()}
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        letters = byte_letters()
        self.letter_byte = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([self.vocab[c] for c in letters], np.int64)
        self.last = np.array([self.vocab[c + end] for c in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.a = np.array([self.vocab[x] for x, _ in merges], np.int64)
        self.b = np.array([self.vocab[y] for _, y in merges], np.int64)
        self.new = np.array([self.vocab[x + y] for x, y in merges], np.int64)
        keys = self.a * self.size + self.b
        order = np.argsort(keys, kind="stable")
        # of repeated pairs the last rank counts, as in a table filled in order
        last = np.append(keys[order][1:] != keys[order][:-1], True)
        self.keys, self.rank = keys[order][last], order[last]
        # the least rank of a pair that has a given token as a part
        least = np.full(self.size, len(merges))
        np.minimum.at(least, self.a, np.arange(len(merges)))
        np.minimum.at(least, self.b, np.arange(len(merges)))
        self.falls = least[self.new] < np.arange(len(merges))
        self.ids: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if it isn't mergeable."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], -1)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each (non-empty) word."""
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        n = len(sym)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends - 1], prv[ends - sizes] = -1, -1
        word = np.repeat(np.arange(len(words)), sizes)
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            """Enter the pairs that begin at these positions."""
            if not len(at):
                return
            ranks = self.ranks(sym[at], sym[nxt[at]])
            ok = ranks >= 0
            at, ranks = at[ok], ranks[ok]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            for x in np.split(np.arange(len(at)), np.flatnonzero(np.diff(ranks)) + 1) if len(at) else ():
                r = int(ranks[x[0]])
                if r not in index:
                    heapq.heappush(active, r)
                index[r].append(at[x])

        add(np.flatnonzero(nxt >= 0))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = np.unique(np.concatenate(lists))
            a, b, new = self.a[r], self.b[r], self.new[r]
            at = at[sym[at] == a]
            at = at[nxt[at] >= 0]
            at = at[sym[nxt[at]] == b]
            if not len(at):
                continue
            if self.falls[r]:
                first = np.append(True, word[at][1:] != word[at][:-1])
                if not first.all():
                    index[r].append(at[~first])
                    heapq.heappush(active, r)
                    at = at[first]
            elif a == b and len(at) > 1:
                head = np.append(True, nxt[at[:-1]] != at[1:])  # of a run of overlapping pairs
                since = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                at = at[since % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone] = new, -1
            nxt[at] = after
            more = after >= 0
            prv[after[more]] = at[more]
            before = prv[at]
            add(np.concatenate([before[before >= 0], at[more]]))
        alive = sym >= 0
        per_word = np.add.reduceat(alive, ends - sizes) if n else []
        return np.split(sym[alive], np.cumsum(per_word)[:-1])

    def learn(self, words: list[str]) -> None:
        if len(self.ids) > TABLE_LIMIT:
            self.ids.clear()
            self.shown.clear()
        block, held = [], 0
        for w in [*words, None]:
            if block and (w is None or held > INDEX_SYMBOLS):
                for x, ids in zip(block, self.encode_words([x.encode() for x in block])):
                    self.ids[x] = ids.astype("<u4").tobytes()
                    self.shown[x] = self.decode(ids.tolist())
                block, held = [], 0
            if w is not None:
                block.append(w)
                held += len(w)

    def decode(self, ids: list[int]) -> str:
        """Tokens of the ids, joined as this vocabulary's library joins them (no decoder: by spaces)."""
        return " ".join(map(self.text.__getitem__, ids))

    def words_of(self, text: str) -> list[str]:
        """The words of a text; a special token's string is an entry of its own, kept as it is."""
        if PLAIN(text) is not None and not any(t in text for t in self.special):
            return WORDS(text.lower())
        out, at = [], 0
        for m in self.special_at.finditer(text) if self.special_at else ():
            out += self.slow(text[at : m.start()]) + [m[0]]
            at = m.end()
        return out + self.slow(text[at:])

    def slow(self, text: str) -> list[str]:
        return [bytes(map(self.letter_byte.__getitem__, w)).decode() for w, _ in self.split(self.normalize(text))]

    def words_of_all(self, texts: list[str]) -> list[list[str]]:
        """Words of each text; those not seen before are encoded together first."""
        found = [self.words_of(t) for t in texts]
        new = {}
        for words in found:
            for w in words:
                if w not in self.ids:
                    new[w] = None
        if new:
            if len(self.ids) > TABLE_LIMIT:
                new = dict.fromkeys(w for words in found for w in words)
            for w in new.keys() & self.special.keys():
                del new[w]
            self.learn(list(new))
            for s, i in self.special.items():
                self.ids[s], self.shown[s] = np.array([i], "<u4").tobytes(), s
        return found


def _mapped(path: str, per_text, names_types):
    """mapInArrow function: doc_id and what ``per_text(encoder, words)`` gives."""

    def run(batches):
        enc = encoder(path)
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                batch = whole.slice(at, 2048)
                at += 2048
                rows = [per_text(enc, words) for words in enc.words_of_all(batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows), names_types))],
                    names=["doc_id", *(n for n, _ in names_types)],
                )

    return run


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of each whole text.  A null or empty text has no ids; repeated
    rows each give a row; an empty table gives none; other columns are ignored."""
    per_text = lambda enc, words: (np.frombuffer(b"".join(map(enc.ids.__getitem__, words)), "<u4").astype(np.int32),)
    return id_and_text(docs, id_col, text_col).mapInArrow(_mapped(tokenizer, per_text, [("ids", pa.list_(pa.int32()))]), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give an empty text."""

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            texts = [enc.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: both directions in one pass over the texts."""

    def per_text(enc, words):
        ids = b"".join(map(enc.ids.__getitem__, words))
        shown = " ".join(map(enc.shown.__getitem__, words))
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()

    kinds = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return id_and_text(docs, id_col, text_col).mapInArrow(_mapped(tokenizer, per_text, kinds), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
