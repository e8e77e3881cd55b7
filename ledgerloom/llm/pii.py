"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans.

Base spans are the leftmost non-overlapping matches of four fixed patterns, each written so that it
takes time linear in the text.  The field looks at what they leave: windows around leftover digits,
``@`` and spelled-out addresses.  A window reaches ``MAX_TOKENS`` tokens, however long, to each side of what
calls for it, or to the end of the line; a segment, up to ``MAX_TOKENS`` tokens with a kind, never crosses
a line end, so every segment that holds the call is looked at.  A segment is scored as a whole (digit counts, shape, separators, checksum, parts' range,
neighbours); dynamic programming finds the best segmentation, that is boundaries and kinds jointly.
Weights maximise the likelihood of labelled windows: base spans of a bounded sample of documents
(``common.bounded_sample``: ``max_docs``, ``max_chars``; of their windows the ``max_windows`` of the smallest
hashes), the same kinds written in other ways, and generated windows of numbers that are not personal (dates,
versions, hashes, bad checksums).

Nulls: a null text is empty and has no span.  Repeated rows each get a row; empty tables give none;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fitted, id_and_text

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+").match
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+").finditer
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_DIGIT = re.compile(r"[0-9]").search
_TOKENS = re.compile(r"[^\W\d_]+|[0-9]+|[^0-9]", re.S).finditer
_CALLS = re.compile(r"[0-9][0-9 ().\[\]/_-]{5,}[0-9]|@|[\[({<]\s?(?:at|AT|At)\s?[\])}>]|\b(?:dot|DOT)\b").finditer
#: What a segment of each kind may look like at all; the field decides among these.
_EMAIL_LIKE = re.compile(
    r"[\w.%+-]+(?:@|\s?[\[({<]\s?at\s?[\])}>]\s?|\sat\s)[\w-]+(?:(?:\.|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s)[\w-]+)+", re.I
).fullmatch
_IP_LIKE = re.compile(r"[0-9]{1,3}(?:(?:\.|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s)[0-9]{1,3}){3}", re.I).fullmatch
_CARD_LIKE = re.compile(r"[0-9]+(?:[ ./_-][0-9]+)*").fullmatch
_PHONE_LIKE = re.compile(r"\+?(?:[0-9]+|\([0-9]+\))(?:(?:[ ./-]| - )?(?:[0-9]+|\([0-9]+\)))*").fullmatch
_AT = re.compile(r"@|[\[({<]\s?at\s?[\])}>]|\bat\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def _short(s: str, limit: int) -> str:
    s = s.lstrip("0") or "0"
    return s if len(s) <= limit else "9" * limit


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in order, code points, end exclusive."""
    out = []
    if "@" in text:
        done, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            m = _DOMAIN(text, at + 1) if start < at else None
            if m:
                out.append((start, 0, m.end()))
                done = m.end()
            at = text.find("@", max(at + 1, done))
    if _DIGIT(text):
        for m in _IP(text):
            if all(int(_short(p, 4)) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# ------------------------------------------------------------------------------- the field


def _class(c: str) -> str:
    return "-" if not c else "d" if c.isdigit() else "a" if c.isalpha() else "s" if c.isspace() else c


def features(kind: int, text: str, start: int, end: int) -> list[str]:
    """Whole-span features of text[start:end] as a segment of this kind."""
    own = text[start:end]
    k = KINDS[kind]
    digits = _digits(own)
    n = len(digits)
    left, right = text[max(0, start - 1) : start], text[end : end + 1]
    seps = "".join(sorted({c for c in own if not c.isalnum()}))[:6]
    out = [f"{k}", f"{k} digits {min(n, 20)}", f"{k} left {_class(left)}", f"{k} right {_class(right)}", f"{k} seps {seps}", f"{k} letters {any(c.isalpha() for c in own)}"]
    if kind == 0:
        ats = len(_AT.findall(own))
        tail = own.rsplit(".", 1)[-1] if "." in own else re.split(r"\W", own)[-1]
        dots = len(re.findall(r"\.|\bdot\b|\[\.\]", own, re.I))
        out += [f"{k} ats {min(ats, 2)}", f"{k} tail {2 <= len(tail) <= 6 and tail.isalpha()}", f"{k} dots {min(dots, 3)}", f"{k} words {min(len(own.split()), 6)}"]
    else:
        groups = re.findall(r"[0-9]+", own)
        shape = re.sub(r"[0-9]+", lambda m: str(min(len(m[0]), 9)), own)[:20]
        out += [f"{k} groups {min(len(groups), 6)}", f"{k} first {_class(own[0])}", f"{k} shape {shape}" if not re.search(r"[^\W\d_]", own) else f"{k} shape letters"]
        if kind == 1:
            out.append(f"{k} range {len(groups) == 4 and all(int(_short(g, 4)) <= 255 for g in groups)}")
        if kind == 2:
            out += [f"{k} luhn {12 <= n <= 19 and luhn(digits)}", f"{k} even {len({len(g) for g in groups}) == 1}"]
        if kind == 3:
            out += [f"{k} length {9 <= n <= 15}", f"{k} luhn {12 <= n <= 19 and luhn(digits)}"]
    return out


def _possible(kind: int, own: str, left: str) -> bool:
    """Whether a segment can be of this kind at all; an address cut in its middle can't."""
    if kind == 0 and left in _LOCAL:
        return False
    if not (own[-1].isalnum() and (own[0].isalnum() or kind == 3 and own[0] in "+(")):
        return False
    if kind == 0:
        return len(own) >= 6 and _EMAIL_LIKE(own) is not None
    if kind == 1:
        return len(own) >= 7 and _IP_LIKE(own) is not None
    n = sum("0" <= c <= "9" for c in own)
    if kind == 2:
        return 12 <= n <= 19 and _CARD_LIKE(own) is not None
    return 7 <= n <= 15 and _PHONE_LIKE(own) is not None


def segments(text: str) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Token boundaries of a window, and its candidate segments (first token, end token, kind)."""
    at = [m.start() for m in _TOKENS(text)] + [len(text)]
    found = []
    for i in range(len(at) - 1):
        c = text[at[i]]
        if not (c.isalnum() or c in "+("):
            continue
        left = text[at[i] - 1] if i else ""
        for j in range(i + 1, min(i + MAX_TOKENS, len(at) - 1) + 1):
            last = text[at[j] - 1]
            if last == "\n":
                break
            if not last.isalnum():
                continue
            own = text[at[i] : at[j]]
            found += [(i, j, k) for k in range(4) if _possible(k, own, left)]
    return at, found


class Field:
    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def scored(self, text: str):
        at, found = segments(text)
        w = self.weights
        return at, [(i, j, k, sum(w.get(f, 0.0) for f in features(k, text, at[i], at[j]))) for i, j, k in found]

    def decode(self, text: str) -> list[tuple[int, int, int]]:
        """Best segmentation: (start, kind, end) of its entities.  A token outside scores 0."""
        at, found = self.scored(text)
        if not found:
            return []
        ending = defaultdict(list)
        for s in found:
            ending[s[1]].append(s)
        best, back = [0.0] * len(at), [None] * len(at)
        for t in range(1, len(at)):
            best[t] = best[t - 1]
            for s in ending[t]:
                if best[s[0]] + s[3] > best[t]:
                    best[t], back[t] = best[s[0]] + s[3], s
        out, t = [], len(at) - 1
        while t > 0:
            s = back[t]
            if s is None:
                t -= 1
            else:
                out.append((at[s[0]], s[2], at[s[1]]))
                t = s[0]
        return out[::-1]


def fit(windows: list[tuple[str, list[tuple[int, int, int]]]], steps: int = 40, ridge: float = 0.02) -> Field:
    """Weights of the greatest penalised likelihood, by gradient ascent (Adagrad) with
    forward-backward sums over all segmentations."""
    made, index = [], {}
    for text, gold in windows:
        at, found = segments(text)
        segs = [(i, j, [index.setdefault(f, len(index)) for f in features(k, text, at[i], at[j])]) for i, j, k in found]
        wanted = {(s, k, e) for s, k, e in gold}
        right = [x for x, (i, j, k) in enumerate(found) if (at[i], k, at[j]) in wanted]
        if segs:
            made.append((len(at), segs, right))
    w, seen = np.zeros(len(index)), np.full(len(index), 1e-8)
    for _ in range(steps):
        grad = -ridge * w
        for n, segs, right in made:
            score = [float(w[f].sum()) for _, _, f in segs]
            fwd, bwd = np.full(n, -np.inf), np.full(n, -np.inf)
            fwd[0] = bwd[n - 1] = 0.0
            by_end, by_start = defaultdict(list), defaultdict(list)
            for x, (i, j, _) in enumerate(segs):
                by_end[j].append((i, score[x]))
                by_start[i].append((j, score[x]))
            for t in range(1, n):
                fwd[t] = np.logaddexp.reduce([fwd[t - 1], *(fwd[i] + s for i, s in by_end[t])])
            for t in range(n - 2, -1, -1):
                bwd[t] = np.logaddexp.reduce([bwd[t + 1], *(bwd[j] + s for j, s in by_start[t])])
            for x, (i, j, f) in enumerate(segs):
                p = math.exp(min(0.0, fwd[i] + score[x] + bwd[j] - fwd[n - 1]))
                if p > 1e-6:
                    np.subtract.at(grad, f, p)
            for x in right:
                np.add.at(grad, segs[x][2], 1.0)
        seen += grad**2
        w += 0.5 * grad / np.sqrt(seen)
    return Field({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-6})


def _card(rng) -> str:
    d = "4" + "".join(str(rng.integers(10)) for _ in range(14))
    return next(d + str(c) for c in range(10) if luhn(d + str(c)))


def examples(seed: int = 11, n: int = 60) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated windows: each kind written plainly and in other ways, and numbers that are none."""
    rng = np.random.default_rng(seed)
    r = lambda a, b: int(rng.integers(a, b))
    num = lambda k: "".join(str(r(0, 10)) for _ in range(k))
    word = lambda: "".join("aeioustrnldmk"[r(0, 13)] for _ in range(r(3, 9)))
    pick = lambda xs: xs[r(0, len(xs))]
    out = []

    def add(kind: int | None, own: str) -> None:
        left = " ".join(word() for _ in range(r(1, 4))) + pick([" ", " ", ": ", ", "])
        gold = [] if kind is None else [(len(left), kind, len(left) + len(own))]
        out.append((left + own + pick([" ", " ", ". ", ", "]) + " ".join(word() for _ in range(r(1, 4))), gold))

    for _ in range(n):
        user, host, top = word() + pick(["", "." + num(2), "_" + word()]), word() + pick(["", num(1)]), pick(["com", "org", "net", "de"])
        at = pick(["@", " at ", " [at] ", "(at)", " (at) ", "[at]"])
        dot = " dot " if at == " at " else pick([".", " [dot] ", " (dot) ", "[.]"]) if at != "@" else "."
        add(0, f"{user}{at}{host}{dot}{top}")
        add(1, pick([".", ".", "[.]"]).join(str(r(0, 256)) for _ in range(4)))
        c = _card(rng)
        add(2, pick(["", " ", "-", ".", "/"]).join(c[i : i + 4] for i in range(0, 16, 4)))
        a, b, e = num(3), num(3), num(4)
        add(3, pick([f"+1 ({a}) {b}-{e}", f"({a}) {b}-{e}", f"{a}-{b}-{e}", f"+1-{a}-{b}-{e}", f"{a}.{b}.{e}", f"1-{a}-{b}-{e}", f"+{r(20, 99)} {a} {num(7)}", f"00{r(20, 99)} {a} {num(7)}"]))
        bad = next(x for x in iter(lambda: num(16), None) if not luhn(x))
        add(None, bad)
        add(None, pick([f"{r(1900, 2100)}-{r(10, 13)}-{r(10, 29)}", f"{r(10, 29)}.{r(10, 13)}.{r(1900, 2100)}", f"{r(10, 24)}:{num(2)}:{num(2)}", f"{r(1, 20)}.{r(0, 20)}.{r(0, 20)}", f"{num(3)},{num(3)},{num(3)}.{num(2)}", f"{r(1900, 2100)}-{r(1900, 2100)}"]))
        add(None, pick([num(8), num(10), num(11), num(9), num(13), f"{num(2)} {num(2)} {num(2)} {num(2)}"]))
        add(None, "".join("0123456789abcdef"[r(0, 16)] for _ in range(pick([18, 32, 40]))))
        add(None, f"{r(256, 999)}.{r(256, 999)}.{r(0, 999)}.{r(0, 999)}")
        add(None, f"{word()} at {word()} {num(2)}")
        add(None, pick([f"{r(1900, 2100)}-{r(10, 13)}-{r(10, 29)} {r(10, 24)}:{num(2)}:{num(2)}", f"{r(1, 20)}.{r(0, 20)} {r(1900, 2100)}-{r(1900, 2100)}", f"{num(4)} {num(4)} {num(4)}", f"{num(3)} {num(2)} {num(4)} {num(2)}", f"{r(1900, 2100)} {r(1900, 2100)} {r(1900, 2100)}"]))
    return out


def _reach_left(text: str, at: int) -> int:
    """Where the MAX_TOKENS-th token before ``at`` begins, or its line."""
    size = 128
    while True:
        low = max(0, at - size)
        line = text.rfind("\n", low, at) + 1
        starts = [m.start() + (line or low) for m in _TOKENS(text[line or low : at])]
        if len(starts) > MAX_TOKENS:  # the first one may be cut
            return starts[-MAX_TOKENS]
        if line or low == 0:
            return line or low
        size *= 4


def _reach_right(text: str, at: int) -> int:
    """Where the MAX_TOKENS-th token after ``at`` ends, or its line."""
    size = 128
    while True:
        high = min(len(text), at + size)
        line = text.find("\n", at, high)
        ends = [m.end() + at for m in _TOKENS(text[at : line if line >= 0 else high])]
        if len(ends) > MAX_TOKENS:  # the last one may be cut
            return ends[MAX_TOKENS - 1]
        if line >= 0 or high == len(text):
            return line if line >= 0 else high
        size *= 4


def windows(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Stretches the field looks at: around calls that no base span covers, without base spans."""
    taken = sorted((s, e) for s, _, e in base)
    free, x = [], 0
    out: list[tuple[int, int]] = []
    for m in _CALLS(text):
        s, e = m.span()
        while x < len(taken) and taken[x][1] <= s:
            x += 1
        if x < len(taken) and taken[x][0] < e:
            # partly covered: what is left must call by itself
            rest = text[s : taken[x][0]] + " " + (text[taken[x][1] : e] if e > taken[x][1] else "")
            if sum("0" <= c <= "9" for c in rest) < 7:
                continue
        free.append((s, e))
    for s, e in free:
        a, b = _reach_left(text, s), _reach_right(text, e)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    # cut base spans out
    cut, first = [], 0
    for a, b in out:
        while first < len(taken) and taken[first][1] <= a:
            first += 1
        for x in range(first, len(taken)):
            s, e = taken[x]
            if s >= b:
                break
            if e <= a:
                continue
            if s > a:
                cut.append((a, s))
            a = max(a, e)
        if a < b:
            cut.append((a, b))
    return cut


def find(text: str, field: Field | None, base: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int]]:
    """Base spans and those the field adds, in order."""
    base = base_spans(text) if base is None else base
    if field is None:
        return base
    added = []
    for a, b in windows(text, base):
        if b - a >= 6:
            added += [(a + s, k, a + e) for s, k, e in field.decode(text[a:b])]
    return sorted(base + added)


def labelled(text: str) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows of 24 characters to each side of base spans that no other span is in."""
    found, out = base_spans(text), []
    for x, (s, k, e) in enumerate(found):
        a, z = max(0, s - 24), min(len(text), e + 24)
        if not any(y[0] < z and y[2] > a for y in (*found[max(0, x - 4) : x], *found[x + 1 : x + 5])):
            out.append((text[a:z], [(s - a, k, e - a)]))
    return out


def _fit_rows(max_windows: int):
    def run(rows):
        own = {w[0]: w for _, text in rows for w in labelled(text)}
        order = sorted(own, key=lambda t: (hashlib.md5(t.encode("utf-8", "surrogatepass")).digest(), t))
        return fit(examples() + [own[t] for t in order[:max_windows]])

    return run


def train(docs: DataFrame, max_docs: int = 300, max_chars: int = 3_000_000, max_windows: int = 600, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """The field of generated windows and of those of a bounded sample, fitted in one task."""
    rows = id_and_text(docs, id_col, text_col).filter(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9]{4}|@"))
    return fitted(bounded_sample(rows, max_docs, max_chars), _fit_rows(max_windows))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def spans(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of (kind, start, end)) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        rows = lambda found: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found]
        for b in batches:
            base = [base_spans(t) for t in b.column(1).to_pylist()]
            full = [find(t, shared.value, x) for t, x in zip(b.column(1).to_pylist(), base)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(rows, base), kind), pa.array(map(rows, full), kind)], names=["doc_id", "base", "spans"])

    one = "array<struct<kind:string,start:int,end:int>>"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, base {one}, spans {one}")


def digests(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the digest of their list, and the list of all spans."""
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(shown("base").cast("binary"), 256).alias("base_sha256"), shown("spans").alias("spans"))


def masked(docs: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; every column stays, null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for s, k, e in find(text, shared.value):
            if s >= at:
                out += [text[at:s], f"<{KINDS[k].upper()}>"]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def run(batches):
        for b in batches:
            i = b.schema.get_field_index(text_col)
            texts = pa.array([one(t) for t in b.column(i).to_pylist()], pa.string())
            yield b.set_column(i, text_col, texts)

    return docs.mapInArrow(run, docs.schema)
