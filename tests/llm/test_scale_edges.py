"""Scale of vectors, long texts, many spans, rare languages, rows under null and repeated ids."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ann, chat, language, pii, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_dedup_keeps_other_texts_under_null_and_repeated_ids(spark):
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(80)) for _ in range(5)]
    rows = [(None, texts[0]), (None, texts[1]), (1, texts[2]), (2, texts[3]), (2, texts[2]), (3, texts[4]), (3, texts[4]), (4, texts[4])]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], DOCS)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted((str(i), t) for i, t in [(None, texts[0]), (None, texts[1]), (1, texts[2]), (2, texts[3]), (3, texts[4])])


def test_a_text_of_four_million_characters_is_cut_in_linear_time(spark):
    took = []
    for n in (1_000_000, 4_000_000):
        turns = spark.createDataFrame([(1, 0, "user", "aé😀 " * (n // 4))], "conv_id long, turn long, role string, text string")
        began = time.time()
        log = chat.from_turns(turns)
        got = chat.reconstruct(log, ("turn", "copy")).select("text").first().text
        took.append(time.time() - began)
        assert got == "aé😀 " * (n // 4)
    assert took[1] < 20 * max(took[0], 0.5)


def test_many_base_spans_in_linear_time():
    def run(n):
        text = "\n".join(f"name{i} a{i}@b.org or call 555 0{i:07d} now" for i in range(n))
        base = [(m, m + 8, 0) for m in range(0)] or [(s, k, e) for s, k, e in pii.base_spans(text)]
        began = time.process_time()
        found = pii.windows(text, base)
        return time.process_time() - began, len(found)

    few, n = run(4000)
    many, m = run(32000)
    assert m > 4 * n and many < 40 * max(few, 0.02)


@pytest.mark.parametrize("scale", [1e19, 1e-30, 1e150, 1e-150, 1.0])
def test_vectors_of_any_scale_are_found(spark, scale):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 8)) * scale
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = ann.nearest(table, F.col("vec_id") % 20 == 0)
    hits = 0
    rows = found.select("query_id", "vec_id").collect()
    unit = v / scale
    for q in range(0, 400, 20):
        d = ((unit - unit[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len({r.vec_id for r in rows if r.query_id == q} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits >= 0.9 * 200


def test_vectors_of_scales_far_apart(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8)) * np.where(np.arange(300) % 2, 1e19, 1e12)[:, None]
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    rows = ann.nearest(table, F.col("vec_id") % 20 == 1).select("query_id", "vec_id").collect()
    hits = 0
    for q in range(1, 300, 20):
        d = ((v - v[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len({r.vec_id for r in rows if r.query_id == q} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits >= 0.9 * 150


def test_a_rare_language_is_learned(spark):
    """Three documents of a language among many of another, with samples far smaller than the table."""
    rng = random.Random(4)
    common = [f"{rng.choice(['the', 'and', 'with', 'from'])}{rng.choice(['ing', 'ed', 'er', 's'])}" for _ in range(200)]
    rows = [(i, " ".join(rng.choices(common, k=30)), "en", "s", 1) for i in range(6000)]
    rows += [(10_000 + i, "žluťoučký kůň pěl ďábelské ódy příšerně", "cs", "s", 1) for i in range(3)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language.train(docs, max_docs=50)
    assert model.langs == ["cs", "en"]
    got = language.predict(spark.createDataFrame([(1, "příšerně žluťoučký kůň", None, "s", 1), (2, "theing fromed", None, "s", 1)], DOCS), model)
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "cs", 2: "en"}
