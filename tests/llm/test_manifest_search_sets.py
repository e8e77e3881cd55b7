"""The Merkle manifest, lexical search and set sketches against plain versions, with nulls, empty and long
texts, ties, repeated rows, empty tables and columns with clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import lexical, merkle, queries, setsketch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def folder(tmp_path, **tables):
    """A folder of tables, as the registered queries read them."""
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def documents(spark, rows, extra=""):
    return spark.createDataFrame(rows, DOCS + extra)


def words(rng, n, of=400):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(of)}" for _ in range(n))


# -------------------------------------------------------------------------------------- op11


def hash_of(*values):
    shown = "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)
    return hashlib.sha256(shown.encode()).hexdigest()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """The root of a list of digests and each place's steps (before, after) up to it."""
    steps, at, now = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(now) > 1:
        runs = [now[i : i + 3] for i in range(0, len(now), 3)]
        for i, k in enumerate(at):
            run = runs[k // 3]
            steps[i].append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
            at[i] = k // 3
        now = [sha("".join(r)) for r in runs]
    return now[0], steps


def plain_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        d, t, lang, source, n = r[:5]
        odd = d is not None and zlib.crc32(str(d).encode()) % 2 == 0
        changed = t.replace("\n", "") if t is not None and odd else t
        by["" if source is None else "=" + source].append((d is not None, d, hash_of(d, source, lang, n, t), hash_of(d, source, lang, n, changed)))
    groups = sorted(by, key=lambda s: s.encode())
    trees = {}
    for g in groups:
        by[g].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        trees[g] = plain_tree([x[2] for x in by[g]])
    root, tops = plain_tree([trees[g][0] for g in groups])
    out = []
    for g, up in zip(groups, tops):
        for (_, d, own, checked), steps in zip(by[g], trees[g][1]):
            path, acc = steps + up, checked
            for b, a in path:
                acc = sha(b + acc + a)
            out.append((d, own, trees[g][0], root, sha("".join(b + a for b, a in path)), acc, acc == root))
    return sorted(map(str, out))


def test_manifest_equals_a_plain_tree(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, "\n".join(words(rng, 5) for _ in range(rng.randrange(4))), rng.choice(["en", None]), rng.choice(["hot", "hot", "hot", "b", "c", None]), i) for i in range(150)]
    rows += [(200, "one", None, "alone", None), (201, None, "de", "é", 3), (202, "", "de", "z", 0), (203, "y" * 300_000 + "\n", "de", "z", 9)]
    rows += [(None, "no\nid", "en", "b", 5), (None, "no\nid", "en", "b", 5), (7, "again", "en", "hot", 1), (7, "again", "en", "hot", 1)]
    rows = [(*r, "x", 1) for r in rows]
    d = folder(tmp_path, documents=documents(spark, rows, ", idx string, g int"))
    got = queries.op11_merkle(spark, d).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_manifest(rows)
    assert 0 < sum(r.verified for r in got) < len(got)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 28])
def test_manifest_of_few_documents(spark, tmp_path, n):
    rows = [(i, f"t\n{i}", "en", "s", i) for i in range(n)]
    d = folder(tmp_path, documents=documents(spark, rows))
    assert sorted(str(tuple(r)) for r in queries.op11_merkle(spark, d).collect()) == (plain_manifest(rows) if rows else [])


@pytest.mark.parametrize("n, passes", [(9, 1), (10, 2), (82, 3)])
def test_manifest_folds_two_levels_at_a_time(spark, tmp_path, monkeypatch, n, passes):
    rows = [(i, f"t\n{i}", "en", "s", i) for i in range(n)]
    d, made, real = folder(tmp_path, documents=documents(spark, rows)), [], merkle.staged
    monkeypatch.setattr(merkle, "staged", lambda df, what: made.append(what) or real(df, what))
    assert sorted(str(tuple(r)) for r in queries.op11_merkle(spark, d).collect()) == plain_manifest(rows)
    assert sum(w.startswith("level") for w in made) == passes


# -------------------------------------------------------------------------------------- op12


def plain_search(docs, items, k=50):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(d, Counter(cut(t))) for d, t in docs]
    own = [(d, c) for d, c in own if c]
    n_docs, n_all = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, terms in items.items():
        scores = []
        for d, c in own:
            m = 50 + 50 * sum(c.values()) * n_docs // n_all
            s = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, d is not None, d or 0))
        out += [(item, r + 1, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(scores)[:k])]
    return sorted(map(str, out))


def item_terms(items):
    by = defaultdict(set)
    for i, t in items:
        by[i] |= set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    return by


def test_search_equals_all_scores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_DOCS", 16)
    monkeypatch.setattr(lexical, "FIRST", 2)
    monkeypatch.setattr(lexical, "GROWTH", 2)
    rng = random.Random(2)
    docs = [(i, words(rng, rng.randrange(1, 60), 60)) for i in range(700)]
    docs += [(1000 + i, "same A1 text, b2_C3!") for i in range(90)]  # ties over the last place
    docs += [(None, "a1 b2"), (None, "a1 b2"), (5, "a1 b2"), (5, "a1 b2"), (2000, None), (2001, ""), (2002, " -- "), (2003, "Ünïcode ÀB a1"), (2004, "long a1 " * 40_000)]
    items = [(1, "A1 b2 c3"), (2, words(rng, 40, 60)), (3, "ünïcode àb ÀB"), (4, None), (5, "?"), (6, "nowhere"), (None, "h7 g5"), (8, "a1"), (8, "b2 a1"), *((20 + i, words(rng, 8, 60)) for i in range(20))]
    d = folder(tmp_path, documents=documents(spark, [(i, t, "en", "s", 1, "x") for i, t in docs], ", term string"), benchmark=spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, score int"))
    got = queries.op12_lexical(spark, d)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_search(docs, item_terms(items))


def test_search_of_empty_tables(spark, tmp_path):
    none = documents(spark, [])
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert queries.op12_lexical(spark, folder(tmp_path / "a", documents=none, benchmark=some)).count() == 0
    assert queries.op12_lexical(spark, folder(tmp_path / "b", documents=documents(spark, [(1, "a", "en", "s", 1)]), benchmark=some.limit(0))).count() == 0


def test_stop_is_exact_and_early(spark, monkeypatch):
    """Where one shard holds the best, the others are not visited; with a smaller first visit nothing changes."""
    monkeypatch.setattr(lexical, "SHARD_DOCS", 8)
    monkeypatch.setattr(lexical, "FIRST", 1)
    seen = []
    real = lexical.scored
    monkeypatch.setattr(lexical, "scored", lambda index, visits, *a: (seen.append(visits.count()), real(index, visits, *a))[1])
    docs = documents(spark, [(i, "rare rare rare needle" if i < 8 else f"other thing {i % 50} needle " + "pad " * 30, "en", "s", 1) for i in range(400)])
    index = lexical.build(docs)
    best = lexical.search(index, spark.createDataFrame([(1, "rare needle")], "item_id long, text string"), k=5).collect()
    assert [r.doc_id for r in sorted(best, key=lambda r: r.rank)] == [0, 1, 2, 3, 4]
    assert sum(seen) < index.shards.count() / 4


def test_bisection_puts_like_documents_together():
    rng = random.Random(4)
    topics = [[f"t{k}w{i}".encode() for i in range(60)] for k in range(4)]
    texts = [rng.sample(topics[i % 4], 25) for i in range(400)]
    tree = lexical.bisect(texts, depth=2)
    fresh = [(k, tree.leaf(rng.sample(topics[k], 25))) for k in range(4) for _ in range(50)]
    main = {k: Counter(leaf for x, leaf in fresh if x == k).most_common(1)[0] for k in range(4)}
    assert len({leaf for leaf, _ in main.values()}) == 4 and all(n >= 45 for _, n in main.values())


# -------------------------------------------------------------------------------------- op13


def plain_sets(rows, percent=80):
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((d, frozenset([tuple(w)] if 0 < len(w) < 4 else zip(w, w[1:], w[2:], w[3:]))))
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, (d, s) in enumerate(sets):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    out = []
    for i, (d, s) in enumerate(sets):
        c = least.get(top(i)) if s else d
        out.append((d, len(s), c, d == c))
    return sorted(map(str, out))


def changed(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def test_sets_equal_all_pairs(spark, tmp_path):
    rng = random.Random(3)
    base = [words(rng, rng.choice([30, 120, 300])) for _ in range(25)]
    rows = [(i, changed(rng, b, rng.randrange(0, 9))) for i, b in enumerate(base * 8)]
    family = words(rng, 100)
    rows += [(1000 + i, changed(rng, family, rng.randrange(1, 5))) for i in range(150)]  # pairs below and above the bar
    rows += [(2000 + i, "one two" if i % 2 else "ONE\ttwo") for i in range(6)] + [(2010, "one two three"), (2011, "solo")]
    rows += [(None, family), (None, None), (3000, None), (3001, ""), (3002, " \n"), (3, base[3]), (3, base[4]), (3, base[4])]
    rows += [(4000, words(rng, 30_000)), (4001, words(rng, 30_000))]
    rows.append((4002, changed(rng, rows[-2][1], 600)))
    d = folder(tmp_path, documents=documents(spark, [(i, t, "en", "s", 1, 0) for i, t in rows], ", sid int"))
    assert sorted(str(tuple(r)) for r in queries.op13_setsketch(spark, d).collect()) == plain_sets(rows)


def test_sets_of_an_empty_table(spark, tmp_path):
    assert queries.op13_setsketch(spark, folder(tmp_path, documents=documents(spark, []))).count() == 0


def test_blocks_of_a_large_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 16)
    rng = random.Random(8)
    family = words(rng, 80)
    rows = [(i, changed(rng, family, rng.randrange(1, 5))) for i in range(120)]
    d = folder(tmp_path, documents=documents(spark, [(i, t, "en", "s", 1) for i, t in rows]))
    assert sorted(str(tuple(r)) for r in queries.op13_setsketch(spark, d).collect()) == plain_sets(rows)


def test_registers_are_mergeable_and_estimate_the_similarity():
    rng = np.random.default_rng(5)
    for n, shared, extra in ((200, 150, 40), (2000, 1800, 100), (50, 45, 0), (5000, 500, 3000)):
        both, a, b = (rng.integers(0, 1 << 63, k, np.uint64) for k in (shared, n - shared, extra))
        x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
        p, q = setsketch.registers(x), setsketch.registers(y)
        assert (setsketch.merged(p, q) == setsketch.registers(np.unique(np.concatenate([x, y])))).all()
        got = setsketch.similarity(np.array([float((p > q).sum())]), np.array([float((p < q).sum())]), np.array([float(len(x))]), np.array([float(len(y))]))[0]
        true = shared / (len(x) + len(y) - shared)
        assert abs(got - true) < 5 * math.sqrt(true * (1 - true) / setsketch.REGISTERS) + 0.005


def test_queries_equal_their_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name in ("op11_merkle", "op12_lexical", "op13_setsketch"):
        df = queries.QUERIES[name](spark, sf)
        want = db.execute(queries.ORACLE_SQL[name])
        at = {c[0]: i for i, c in enumerate(want.description)}
        assert set(at) == set(df.columns)
        assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str(tuple(r[at[c]] for c in df.columns)) for r in want.fetchall())
