"""Byte-level BPE ids of whole texts, by the tokenizers library.

Merges of a byte-level vocabulary never cross the pieces its splitting rule makes, so a piece's ids
don't depend on its neighbours: the library encodes each different piece once, a worker remembers
them, and a text's ids are those of its pieces in order.  New pieces that begin with a space go to the
library as one string, which its rule cuts at just those spaces; a byte-level token stands for as many
bytes as it has letters, so the bytes say where a piece's ids end.  Texts holding a special
token's string, or a character outside PLAIN (on which the splitting rule's Unicode tables might
differ from the library's by version), are encoded whole by the library, and so is everything if the
vocabulary splits in another way.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import regex

from .common import PLAIN

#: A worker remembers twice so many pieces at most (those in use move to the younger half), and how long.
PIECES, PIECE_LIMIT = 400_000, 48
#: Characters of texts whose new pieces are learned together, and new pieces in one call of the library.
CHARS_AT_ONCE, NEW_AT_ONCE = 1 << 18, 512


def _listed(kind: str) -> str:
    """PLAIN characters of a Unicode kind."""
    return "".join(re.escape(c) for c in map(chr, range(0x130)) if regex.match(rf"\p{{{kind}}}", c))


_L, _N = _listed("L"), _listed("N")
#: The byte-level splitting rule, a fixed value of the vocabulary, with letters and digits listed, so that
#: Python's own, faster matcher can apply it.
_pieces = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+").findall
_begins_with_space = re.compile(r" \S").match
_loaded: dict[str, "ByteLevel"] = {}


def encoder(path: str) -> "ByteLevel":
    """One encoder for each worker process and vocabulary."""
    if path not in _loaded:
        _loaded[path] = ByteLevel(path)
    return _loaded[path]


class ByteLevel:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.specials = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        self.splits = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"]
        vocab = self.lib.get_vocab(with_added_tokens=False)
        self.widths = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        self.widths[list(vocab.values())] = [len(token) for token in vocab]
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        """Make sure that these are in ``known``."""
        if len(self.known) > PIECES:
            self.old, self.known = self.known, {}
        after_space, others = [], []
        for p in pieces.difference(self.known):
            ids = self.old.get(p)
            if ids is not None:
                self.known[p] = ids
            elif _begins_with_space(p):
                after_space.append(p)
            else:
                others.append(p)
        for s in range(0, len(after_space), NEW_AT_ONCE):
            part = after_space[s : s + NEW_AT_ONCE]
            if not self._learn_joined(part):
                others += part
        for s in range(0, len(others), NEW_AT_ONCE):
            part = others[s : s + NEW_AT_ONCE]
            made = self.lib.encode_batch_fast(part, add_special_tokens=False)
            self.known.update(zip(part, [array("I", e.ids).tobytes() for e in made]))

    def _learn_joined(self, part: list[str]) -> bool:
        """Learn pieces that each begin with a space, encoded as one string; False, and nothing learned, if that
        string holds a special token's or the tokens' bytes don't end where the pieces do."""
        joined = "".join(part)
        if any(s in joined for s in self.specials):
            return False
        ids = np.array(self.lib.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        if ids.size == 0 or int(ids.max()) >= len(self.widths):
            return False
        token_ends, piece_ends = np.cumsum(self.widths[ids]), np.cumsum([len(p.encode()) for p in part])
        at = np.searchsorted(token_ends, piece_ends)
        if token_ends[-1] != piece_ends[-1] or not np.array_equal(token_ends[at], piece_ends):
            return False
        raw, ends = ids.tobytes(), ((at + 1) * 4).tolist()
        self.known.update(zip(part, [raw[a:b] for a, b in zip([0, *ends], ends)]))
        return True

    def encode(self, texts: list[str]):
        """Yields each text's ids as an array of 32-bit integers."""
        held, chars = [], 0
        for text in texts:
            held.append(text)
            chars += len(text)
            if chars >= CHARS_AT_ONCE:
                yield from self._encode(held)
                held, chars = [], 0
        yield from self._encode(held)

    def _encode(self, texts: list[str]):
        cut = [
            None if not self.splits or PLAIN(text) is None or any(s in text for s in self.specials) else _pieces(text)
            for text in texts
        ]
        pieces = set().union(*(own for own in cut if own))
        self._learn(pieces)
        known = self.known.__getitem__
        joined = [None if own is None else b"".join(map(known, own)) for own in cut]
        for p in pieces:
            if len(p) > PIECE_LIMIT:
                self.known.pop(p, None)
        for text, made in zip(texts, joined):
            if made is None:
                yield np.array(self.lib.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                yield np.frombuffer(made, np.uint32)
