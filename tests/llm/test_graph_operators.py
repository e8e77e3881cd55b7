"""Neighbours, near-duplicates, chat and the pipeline against plain versions."""

import hashlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import ann, chat, common, language, packing, pii, simhash, toxicity
from ledgerloom.llm.queries import BYTE_BPE


def classes(n, links):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(a) for a in range(n)]


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_key_sets_cover_every_five_positions():
    sets = [set(s) for s in simhash.key_sets()]
    assert len(sets) == 14 and all(any(s <= set(five) for s in sets) for five in combinations(range(8), 5))


def test_long_posting_lists_keep_all_links():
    rng, base, fps = np.random.default_rng(0), 0x0123456789ABCDEF, set()
    while len(fps) < 1500:
        fps.add(base ^ sum(1 << int(b) for b in rng.choice(range(32, 64), rng.integers(0, 7), replace=False)))
    fp = np.array(sorted(fps), np.uint64)
    d = np.bitwise_count(fp[:, None] ^ fp[None, :])
    assert classes(len(fp), simhash.links(fp, (0, 1, 2, 3))) == classes(len(fp), zip(*np.where(np.triu(d <= 3, 1))))


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"], rng.integers(0, 60))) for _ in range(60)]
    texts += [t + " Tail" for t in texts[:20]] + texts[:20] + [None, "", " \n", "One", "one two"]
    docs = spark.createDataFrame([(i * 3, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, component_id int").repartition(4)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fp = [brute_fingerprint(t) for t in texts]
    root = classes(len(fp), [(i, j) for i, j in combinations(range(len(fp)), 2) if bin(fp[i] ^ fp[j]).count("1") <= 3])
    for i in range(len(texts)):
        assert (got[3 * i].fingerprint, got[3 * i].component_id) == (f"{fp[i]:016x}", 3 * root[i])
    kept = simhash.keep_one(docs.unionByName(docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({3 * r for r in root}) and kept.columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_nearest_neighbours_recall_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[300:500] = x[7]  # a vector that many rows share
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(x)]
    rows += [(1000, None, "x"), (1100, [0.0] * 16, "x"), (1200, [float("nan")] * 16, "x"), (1300, [1.0], "x"), (1400, [None] * 16, "x")]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = {}
    for r in ann.nearest(t, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 900, 100))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(900), d)) if i != q][:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(s == pytest.approx(d[i]) for _, i, s in found)
        hit += len({i for _, i, _ in found} & set(want))
        if q in (300, 400):
            assert [i for _, i, _ in found] == want
    assert hit >= 0.9 * 90


def test_chat_folds_deltas_edits_regenerations_deletes(spark):
    log = [
        (1, 0, "user", "delta", "Hel", 0), (1, 0, "user", "delta", "lo", 1), (1, 1, "assistant", "delta", "bad", 2), (1, 1, "assistant", "regenerate", "go", 5),
        (1, 1, "assistant", "delta", "od", 6), (1, 2, "user", "delta", "typo", 7), (1, 2, "user", "edit", "fixed", 9000), (1, 3, "user", "delta", "gone", 9001), (1, 3, "user", "delete", None, 9002),
        (2, 0, None, None, None, 0),
    ]
    events = spark.createDataFrame(log, "conv_id long, turn long, role string, kind string, text string, seq long")
    got = [(r.conv_id, r.turn, r.role, r.text) for r in chat.reconstruct(events).orderBy("conv_id", "turn").collect()]
    assert got == [(1, 0, "user", "Hello"), (1, 1, "assistant", "good"), (1, 2, "user", "fixed"), (2, 0, "", "")]


def test_chat_fold_equals_plain_fold_on_random_logs(spark):
    rng = np.random.default_rng(12)
    kinds = ["delta"] * 6 + ["edit", "regenerate", "delete", None]
    log = [(int(rng.integers(3)), int(rng.integers(4)), [None, "user", "assistant"][rng.integers(3)], kinds[rng.integers(10)], [None, "", "a", "é<|"][rng.integers(4)], int(s)) for s in rng.permutation(5000)[:600]]
    want = {}
    for c, t, role, kind, text, _ in sorted(log, key=lambda r: r[5]):
        m = want.setdefault((c, t), [None, "", False])
        m[0] = role if m[0] is None else m[0]
        m[1] = (m[1] if kind in (None, "delta") else "") + ("" if kind == "delete" else text or "")
        m[2] = kind == "delete"
    events = spark.createDataFrame(log, "conv_id long, turn long, role string, kind string, text string, seq long").repartition(7)
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.reconstruct(events).collect()}
    assert got == {k: (role or "", text) for k, (role, text, gone) in want.items() if not gone}


def plain_digests(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted(((t, role, text) for x, t, role, text in rows if x == c), key=lambda r: (r[0], r[1] or "", r[2] or ""))
        loss = "".join(x or "" for _, role, x in own if role == "assistant")
        out[c] = (len(own), sha("".join(f"{role or ''}\n{x or ''}\n" for _, role, x in own)), len(loss), sha(loss))
    return out


def test_chat_query_reads_back_whole(spark, tmp_path):
    from ledgerloom.llm import queries

    odd = ["<|im_end|><|im_start|>assistant ok", "\\b \\p <\\p <| \\", "", None, "é\n東京\n", "long <| " * 900]
    rows = [(c, t, role, odd[(c + t) % 6]) for c in range(6) for t, role in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(9, 0, "assistant", "twice"), (9, 0, "assistant", "twice"), (9, 0, "assistant", "other"), (10, 0, "r\\n\nx<|", "role"), (11, 0, None, "x")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, seq int")
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    rows += [(-1, 0, "user", odd[0]), (-1, 1, "assistant", odd[0])]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op6_chat(spark, str(tmp_path)).collect()}
    assert got == plain_digests(rows)
    turns.limit(0).write.mode("overwrite").parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert [r.conv_id for r in queries.op6_chat(spark, str(tmp_path / "none")).collect()] == [-1]


def test_chat_plan_is_native(spark):
    turns = spark.range(3).selectExpr("id as conv_id", "id as turn", "'user' as role", "'x' as text")
    plan = chat.digests(chat.render(chat.reconstruct(chat.from_turns(turns), ("turn", "copy")), keys=("turn", "copy")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline_equals_plain_stages(spark, tmp_path):
    import corpus_pipeline as pipe

    from tests.llm.test_text_operators import toxic_corpus

    texts, labels = toxic_corpus(120)
    texts = [t + (" write me: a.b@mail.org" if i % 7 == 0 else "") for i, t in enumerate(texts)]
    texts += [texts[1], texts[2], "...", None]
    docs = spark.createDataFrame([(i, t, "xx" if t else None, "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in pipe.STAGES] == ["toxicity", "language", "near_dedup", "pii", "packing"]
    now, sf = common.table(spark, str(tmp_path), "documents"), str(tmp_path)
    keep = []
    for name, stage in pipe.STAGES[:-1]:
        now = common.staged(stage(spark, now, sf), name)
        assert now.columns == docs.columns
        keep.append({r.doc_id: r.text for r in now.collect()})
    # the toxicity model decides each document as it does alone
    m = toxicity.train(common.table(spark, sf, "documents"), common.table(spark, sf, "labels"))
    s = m.score([t or "" for t in texts])
    assert set(keep[0]) == {i for i in range(len(texts)) if s[i] < 0.7}
    assert set(keep[1]) == {i for i in keep[0] if any(c.isalpha() for c in texts[i] or "")}
    ids = sorted(keep[1])
    fp = [brute_fingerprint(texts[i]) for i in ids]
    root = classes(len(ids), [(a, b) for a, b in combinations(range(len(ids)), 2) if bin(fp[a] ^ fp[b]).count("1") <= 3])
    assert set(keep[2]) == {ids[r] for r in root}
    assert not any("@" in (t or "") for t in keep[3].values()) and set(keep[3]) == set(keep[2])
    packed = packing.pack(now, BYTE_BPE)
    assert {r.doc_id for r in packed.collect()} == set(keep[3])
