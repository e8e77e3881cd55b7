"""Tokenizer, quality, language, toxicity and PII operators against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import bpe, language, packing, pii, quality, token_output, toxicity
from ledgerloom.llm.queries import BYTE_BPE, WORD_BPE

LONG = "word " * 3000 + "x" * 20000
TEXTS = ["", None, "Hello, it's 3 o'clock!  ", "ananananan hehehehehe aaaa", "naïve ÉCOLE — 東京 🙂 ÿ", "a<|endoftext|>b <|startoftext|>", "tabs\t\nand\r\n\x1c\x85 spaces", LONG, "same", "same", "ﬁ ﬀ İstanbul Å"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "kept", float(i)) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, score double").repartition(3).cache()


def lib(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_pair_index_bpe_equals_library(docs):
    t = lib(WORD_BPE)
    got = bpe.round_trip_digests(docs, WORD_BPE).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        ids = t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_pair_index_bpe_on_random_words():
    rng, e, t = np.random.default_rng(1), bpe.PairBpe(WORD_BPE), lib(WORD_BPE)
    words = list({"".join(rng.choice(list("aehinorst"), rng.integers(1, 25))) for _ in range(800)})
    for w, ids in zip(words, e.encode_words([x.encode() for x in words])):
        assert ids.tolist() == t.encode(w, add_special_tokens=False).ids


def test_encode_and_decode_frames(docs):
    enc = bpe.encode(docs.filter("doc_id in (2, 4)"), WORD_BPE)
    t = lib(WORD_BPE)
    for r in bpe.decode(enc, WORD_BPE).collect():
        assert r.text == t.decode(t.encode(TEXTS[r.doc_id], add_special_tokens=False).ids, skip_special_tokens=False)


def byte_ids():
    t = lib(BYTE_BPE)
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in enumerate(TEXTS)}


def test_token_files(spark, docs, tmp_path):
    out, want, start = str(tmp_path / "tokens"), byte_ids(), 0
    token_output.write_tokens(docs.dropDuplicates(["doc_id"]), out, BYTE_BPE)
    rows = {r.doc_id: r for r in token_output.with_crc(token_output.read_tokens(spark, out)).collect()}
    for i in sorted(want):
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(want[i]), zlib.crc32(np.array(want[i], "<u4").tobytes()))
        start += len(want[i])
    part = token_output.read_tokens(spark, out, ["doc_id", "start"], 3, 5).collect()
    assert sorted(r.doc_id for r in part) == [3, 4, 5] and all(r.start == rows[r.doc_id].start for r in part)
    import glob

    import pyarrow.parquet as pq

    column = [pq.ParquetFile(f).metadata.row_group(0).column(4) for f in glob.glob(out + "/*.parquet") if pq.ParquetFile(f).metadata.num_row_groups]
    assert column and all(c.has_offset_index and any("DICTIONARY" in e for e in c.encodings) for c in column)


def test_packing_is_whole_and_gapless(docs):
    want = byte_ids()
    rows = packing.pack(docs.dropDuplicates(["doc_id"]), BYTE_BPE, capacity=64).collect()
    seqs, seen = {}, {}
    for r in rows:
        own = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id])
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
    gapless = lambda spans: all(a + n == b for (a, n), (b, _) in zip(sorted(spans), sorted(spans)[1:])) and min(spans)[0] == 0
    assert all(gapless(s) and sum(n for _, n in s) <= 64 for s in seqs.values())
    assert set(seen) == set(want) and all(gapless(s) and sum(n for _, n in s) == len(want[i]) for i, s in seen.items())


def test_packing_plan_balances_cost_and_fills():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 3000, 500).tolist()
    pieces, used = packing.plan(lengths, 1024, 1.0, 1 / 1024)
    fill = Counter()
    for d, s, n, q, o in pieces:
        fill[q] += n
    assert sum(fill.values()) == sum(lengths) and max(fill.values()) <= 1024
    assert used * 1024 - sum(lengths) < 1024


def brute_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c, hit = Counter(zip(w, w[1:], w[2:])), set()
    for k in range(len(w) - 2):
        if c[tuple(w[k : k + 3])] > 1:
            hit |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_rules_equal_plain_counts():
    for t in [*filter(None, TEXTS), "", "a b c a b c a b\nx\nx\n \n", "a a a a a", "é # é # é"]:
        assert quality.rules(t.encode()) == brute_rules(t)


def test_quality_ratio_equals_plain_sum(spark):
    good, bad = "the cat sat on the mat and more " * 8, "$$## %%& QQ " * 30
    docs = spark.createDataFrame([(1, good, 0), (2, good + "so", 0), (3, bad, 0), (4, None, 0)], "doc_id long, text string, llr int")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.filter_quality(docs, labels).collect()}
    raw, target = Counter(), Counter()
    for i, t in ((1, good), (2, good + "so"), (3, bad)):
        raw.update(quality.hashed(t.encode()).tolist())
        if i < 3:
            target.update(quality.hashed(t.encode()).tolist())
    p = lambda c, b: np.log((c[b] + 0.5) / (sum(c.values()) + 0.5 * quality.BUCKETS))
    h = quality.hashed(bad.encode()).tolist()
    assert got[3].llr == pytest.approx(sum(p(target, b) - p(raw, b) for b in h) / (len(h) + 50))
    assert got[3].llr < -0.2 < got[1].llr and not got[3].kept and got[4].base_failed and not got[4].kept
    assert quality.filter_quality(docs.limit(0), labels).count() == 0


def plain_language(rows, words):
    """Log frequencies of words by the rule in words: whole word, else mean of the longest known n-grams."""
    grams = lambda w, n: list(w) if n == 1 else [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)]
    langs = sorted({lang for _, lang in rows})
    counts = [{lang: Counter() for lang in langs} for _ in range(6)]
    for text, lang in rows:
        for w in language.LETTERS(text.lower()):
            counts[0][lang][w] += 1
            for n in range(1, 6):
                counts[n][lang].update(grams(w, n))
    known = [set().union(*c.values()) for c in counts]
    one = lambda n, g: np.array([np.log((counts[n][x][g] + 0.5) / (sum(counts[n][x].values()) + 0.5 * len(known[n]))) for x in langs])

    def score(w):
        if w in known[0]:
            return one(0, w)
        for n in range(5, 0, -1):
            if own := [one(n, g) for g in grams(w, n) if g in known[n]]:
                return np.mean(own, axis=0)
        return np.zeros(len(langs))

    return [score(w) for w in words]


def test_language_words_then_shorter_grams(spark):
    rows = [(i, "der hund und die katze spielen im garten", "de") for i in range(6)] + [(10 + i, "the dog and the cat play in the garden", "en") for i in range(6)]
    docs = spark.createDataFrame([*rows, (90, "x", None), (91, None, "en")], "doc_id long, text string, lang string")
    m = language.train(docs)
    assert m.langs == ["de", "en"]
    asked = ["katzen", "hund", "qqq", "gartenhund", "dogs", "t", "über", "q" * 3000 + "katz", "gard" * 900]
    assert np.allclose(m.scores(asked), plain_language([r[1:] for r in rows], asked), atol=1e-5)
    ask = spark.createDataFrame([(1, "die katze", 1), (2, "The DOG!", 1), (3, "123 .", 1), (4, None, 1), (5, "", 1), (2, "The DOG!", 1), (6, "katze dog " * 90_000, 1)], "doc_id long, text string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(ask, m).collect()}
    assert got[1][0] == "de" and got[2][0] == "en" and [got[i] for i in (3, 4, 5)] == [("und", 0.0)] * 3 and 6 in got
    assert language.predict(ask, m).count() == 7 and language.predict(ask.limit(0), m).count() == 0
    assert {r.doc_id for r in language.keep_known(ask.filter("doc_id < 6"), m).collect()} == {1, 2}
    nothing = language.train(docs.filter("lang is null"))
    assert language.predict(ask, nothing).filter("lang_pred <> 'und'").count() == 0


def test_language_score_of_a_text_equals_plain_sum(spark):
    rng = np.random.default_rng(2)
    word = lambda abc: "".join(rng.choice(list(abc), rng.integers(1, 7)))
    rows = [(i, " ".join(word("abcé" if i % 2 else "acdñ") for _ in range(30)), "uv"[i % 2]) for i in range(30)]
    m = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    ask = [(i, " ".join(word("abcdéñx") for _ in range(rng.integers(1, 60)))) for i in range(40)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(spark.createDataFrame(ask, "doc_id long, text string"), m).collect()}
    for i, text in ask:
        words = text.split()
        z = np.sum(plain_language([r[1:] for r in rows], words), axis=0) / len(words) * min(len(words), 20)
        assert got[i][0] == "uv"[int(np.argmax(z))] and got[i][1] == pytest.approx(1 / np.exp(z - z.max()).sum(), rel=1e-3)


def toxic_corpus(n=160):
    rng = np.random.default_rng(4)
    syl = ["an", "er", "on", "ti", "the", "re", "nd", "ha", "es", "ou"]
    word = lambda: "".join(rng.choice(syl, rng.integers(1, 4)))
    texts, labels = [], []
    for i in range(n):
        w = [word() for _ in range(40)]
        y = int(i % 3 == 0)
        if y:
            w[int(rng.integers(40))] = ["blockhead", "wretch", "vermin"][int(rng.integers(3))]
        texts.append(" ".join(w))
        labels.append(y)
    return texts, labels


def test_toxicity_held_out_and_spellings():
    texts, labels = toxic_corpus()
    m = toxicity.fit([sorted(toxicity.units(t)) for t in texts[:110]], labels[:110], landmarks=120)
    s = m.score(texts[110:]) >= 0.7
    assert (s == np.array(labels[110:], bool)).mean() >= 0.95
    plain, gapped, other = m.margins(["blockhead", "block-head", "anerontihe"])
    assert plain > gapped > other


def test_toxicity_kernel_equals_plain_kernel():
    k = toxicity.Kernel(list("abcdefghijklmnopqrstuvwxyz"))

    def plain(w):
        c, out = "^" + w + "^", Counter()
        for i in range(len(c)):
            for j in range(i + 1, min(i + 5, len(c))):
                for l in range(j + 1, min(i + 5, len(c))):
                    if all(x.isalpha() or x == "^" for x in (c[i], c[j], c[l])):
                        out[c[i], c[j], c[l]] += toxicity.DECAY ** (l - i + 1)
        return out

    a, b = "idiot", "id.iot"
    pa_, pb = plain(a), plain(b)
    norm = lambda w: np.sqrt(max(sum(toxicity.DECAY ** (2 * (l - i + 1)) for i in range(len(w) + 2) for j in range(i + 1, min(i + 5, len(w) + 2)) for l in range(j + 1, min(i + 5, len(w) + 2)) if all(x != "." for x in (("^" + w + "^")[i], ("^" + w + "^")[j], ("^" + w + "^")[l]))), toxicity.DECAY**6))
    keys = np.unique(k.entries([a, b])[1])
    m = k.matrix([a, b], keys)
    assert float(m[0] @ m[1]) == pytest.approx(sum(pa_[x] * pb[x] for x in pa_) / norm(a) / norm(b), rel=1e-5)


def test_toxicity_frames_take_nulls(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "fine words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels) is None
    assert [r.score for r in toxicity.score(docs, None).collect()] == [0.0] * 3
    assert toxicity.keep_clean(docs, None).count() == 3


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_spans_equal_plain_patterns():
    rng = np.random.default_rng(8)
    made = ["".join(rng.choice(list("01234@@..+- ()ab4"), 60)) for _ in range(600)]
    fixed = ["a.b@c.d.e x@y @ a@@b.c", "1.2.3.4.5 999.1.1.1 01.002.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (744) 555-2801 4795326016703902", "é +49 30 1234567"]
    for t in made + fixed:
        assert pii.base_spans(t) == brute_spans(t), t


def test_pii_window_holds_whole_words_of_any_length():
    f = pii.fit(pii.examples())
    for own in ("q" * 70 + " [at] host.org", "ab" * 33 + ".bcd(at)mail.com", "x" * 3000 + " [at] host.org"):
        assert pii.find(f"mail {own} now", f) == [(5, 0, 5 + len(own))]
    # an address of more tokens than a segment may have is left whole, not cut in its middle
    assert pii.find("mail " + "a." * 40 + "b [at] host.org now", f) == []
    text = "é 1, a_b; " * 40 + "[at]" + " ü-9: z" * 40
    at, tokens = text.index("[at]"), [m.span() for m in pii._TOKENS(text)]
    before, after = [t for t in tokens if t[1] <= at], [t for t in tokens if t[0] >= at + 4]
    assert pii._reach_left(text, at) == before[-pii.MAX_TOKENS][0] and pii._reach_right(text, at + 4) == after[pii.MAX_TOKENS - 1][1]


def test_pii_field_decodes_as_enumeration_and_adds(spark):
    f = pii.fit(pii.examples(n=25), steps=25)
    text = "ring (744) 555-2801 or so"
    at, segs = f.scored(text)

    def best(t):
        return max([best(t - 1) if t else (0.0, ())] + [(best(i)[0] + s, (*best(i)[1], (at[i], k, at[j]))) for i, j, k, s in segs if j == t])

    assert f.decode(text) == list(best(len(at) - 1)[1]) == [(5, 3, 19)]
    docs = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "mail a.b@mail.org now", 0), (4, "plain 2024-05-13", 0)], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in pii.digests(pii.spans(docs, f)).collect()}
    assert (got[1].n_phone, got[1].spans) == (0, "phone:5:19") and got[3].n_email == 1
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[4].spans == ""
    masked = {r.doc_id: r.text for r in pii.masked(docs, f).collect()}
    assert masked == {1: "ring <PHONE> or so", 2: None, 3: "mail <EMAIL> now", 4: "plain 2024-05-13"}


def test_language_scores_the_whole_of_a_long_run(spark):
    rows = [("alpha beta gamma", "a"), ("delta omega kappa", "b")] * 3
    m = language.train(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string"))
    for size in (150, language.PIECE - 2, language.PIECE + 1):
        asked = ["q" * size + "gamma", "gamma" + "q" * size, "q" * size + "kappa", "q" * size]
        assert np.allclose(m.scores(asked), plain_language(rows, asked), atol=1e-5)


def plain_plan(lengths, capacity, linear, quadratic):
    rests = sorted(((n % capacity, d) for d, n in enumerate(lengths) if n % capacity), key=lambda r: (-r[0], r[1]))
    bins = -(-sum(n for n, _ in rests) // capacity)
    fill, cost = [0] * bins, [0.0] * bins

    def put(n, b):
        fill[b] += n
        cost[b] += linear * n + quadratic * n * n

    for n, _ in rests:
        while n:
            fits = [b for b in range(bins) if fill[b] + n <= capacity]
            b = min(fits, key=lambda b: (cost[b], b)) if fits else min(range(bins), key=lambda b: (fill[b], cost[b], b))
            k = min(n, capacity - fill[b])
            put(k, b)
            n -= k
    return fill, cost


@pytest.mark.parametrize("top", [60, 400, 1500])
def test_packing_finds_the_cheapest_sequence_with_room(top):
    lengths = np.random.default_rng(top).integers(1, top, 900).tolist() + [650] * 70 + [342] * 300
    pieces, used = packing.plan(lengths, 1024, 1.0, 1 / 1024)
    fill, cost = Counter(), Counter()
    for d, s, n, q, o in pieces:
        assert o == fill[q]
        fill[q] += n
        cost[q] += n + n * n / 1024
    want_fill, want_cost = plain_plan(lengths, 1024, 1.0, 1 / 1024)
    whole = sum(n // 1024 for n in lengths)
    assert [fill[whole + b] for b in range(used - whole)] == want_fill
    assert [cost[whole + b] for b in range(used - whole)] == pytest.approx(want_cost)


def test_toxicity_takes_every_script():
    texts, labels = toxic_corpus(240)
    rng = np.random.default_rng(6)
    many = [chr(c) for c in (*range(0x30, 0x3A), *range(0xE0, 0x180), *range(0x3B1, 0x3CA), *range(0x4E00, 0x4F00)) if chr(c).isalnum() and chr(c) == chr(c).lower()]
    insults = {"blockhead": "придурок", "wretch": "негодяй", "vermin": "мерзавец"}
    for i, t in enumerate(texts):
        for a, b in insults.items():
            t = t.replace(a, b)
        texts[i] = t + " " + " ".join("".join(rng.choice(many, 5)) for _ in range(12))
    m = toxicity.fit([sorted(toxicity.units(t)) for t in texts[:170]], labels[:170], landmarks=120)
    assert m is not None and len(m.kernel.alphabet) > 300 and set("придурок") <= set(m.kernel.alphabet)
    s = m.score(texts[170:]) >= 0.7
    assert (s == np.array(labels[170:], bool)).mean() >= 0.95
    assert m.margins(["придурок"])[0] > m.margins(["при-дурок"])[0] > m.margins(["anerontihe"])[0]


def test_toxicity_table_and_search_weigh_alike():
    texts, labels = toxic_corpus()
    m = toxicity.fit([sorted(toxicity.units(t)) for t in texts], labels, landmarks=120)
    words = ["blockhead", "block-head", "anerontihe", "x"]
    by_table, m.table = m.margins(words), None
    assert np.allclose(by_table, m.margins(words), atol=1e-5)


def test_toxicity_learns_a_rare_insult_in_spite_of_a_wrong_label():
    texts, labels = toxic_corpus()
    own = [i for i in range(110) if "vermin" in texts[i]]
    assert len(own) < 50
    labels[own[0]] = 0
    m = toxicity.fit([sorted(toxicity.units(t)) for t in texts[:110]], labels[:110], landmarks=120)
    s = m.score(texts[110:]) >= 0.7
    assert all(s[i] for i, t in enumerate(texts[110:]) if "vermin" in t)
    assert (s == np.array(labels[110:], bool)).mean() >= 0.95


def test_byte_level_pieces_learned_together_are_the_librarys():
    from ledgerloom.llm import bytelevel

    rng, letters = random.Random(4), " \t\n\r'abdefstlvé1290.,<|>endoftext½²ªĀ \u0085\x1c你"
    texts = ["", "   a  b", " \n x", "<|endoftext|> x", " " * 700, "x" * 5000, " <|endof text|>", "a" * 3 + " " + "b" * 4000]
    texts += ["".join(rng.choice(letters if rng.random() < 0.1 else letters[:-4]) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    enc = bytelevel.ByteLevel(BYTE_BPE)
    for round_ in range(2):  # the second from memory
        for text, ids in zip(texts, enc.encode(texts)):
            assert ids.tolist() == enc.lib.encode(text, add_special_tokens=False).ids, (round_, text)
    assert all(len(p) <= bytelevel.PIECE_LIMIT for p in enc.known)
    # joined pieces that would make a special token are left to the call for each piece
    assert not enc._learn_joined([" <|endof", "text|>"])
