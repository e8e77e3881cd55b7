"""A Merkle manifest of a dataset: one digest for each document, group and dataset, and for each document
the proof that it belongs there.

A document's leaf is the digest of its columns, each as its length in bytes and its value.  Per source the
leaves ascend by doc_id; two levels at a time, a window by (group, grandparent's place) with an ordered full-frame
``collect_list`` gives the parents' and the grandparent's preimages and the siblings of each child and of its parent,
and of each window the first row alone goes on as the grandparent.  Source roots, in order, are one more tree.  What
goes on is a ninth of the nodes below and is written to the shared folder; proofs then go from the root down, each
node handing its path to its grandchildren, so that all levels together cost an eighth more than the leaves alone,
and the driver holds half as many plans and stages.

Places come from ranges of (source, doc_id), not from a window over a source: a source that holds a third of
all documents is dealt over all tasks.  A window has nine nodes at most, so no window or join has a hot key.

Nulls: a null column is ``-`` in its leaf; null source is a group of its own, the first; null doc_ids come
first in their source and their texts are never tampered with.  Equal doc_ids of a source stand in order of
their leaves; repeated rows are leaves of their own.  Empty and very long texts are hashed whole.  An empty
table gives no row.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .common import staged

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<before:string,after:string>>"


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def leaf(**values: Column) -> Column:
    """Digest of the values in order: ``-`` for null, else the number of bytes, a colon and the value."""
    shown = [v.cast("string") for v in values.values()]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in shown)))


def levels(nodes: DataFrame, depth: int, keep: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """From nodes (g, idx, n: how many the group has here, h, and ``keep``): for each two levels that have something to
    fold the nodes with their grandparent's place and digest (on its first grandchild) and their steps, the siblings'
    digests before and after them and then their parent's, and the groups' last nodes (g, level, h).  Where one level is
    left (three nodes or fewer) the parent is the last."""
    out, now, last = [], nodes, nodes.filter("n = 1").select("g", F.lit(0).alias("level"), "h")
    step = lambda hashes, first, at: F.struct(F.array_join(F.slice(hashes, first + 1, at), "").alias("before"), F.array_join(F.slice(hashes, first + at + 2, 2 - at), "").alias("after"))
    for k in range(depth):
        of = Window.partitionBy("g", F.expr("idx div 9")).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = now.filter("n > 1").withColumn("run", F.collect_list("h").over(of))
        rows = rows.withColumn("ups", F.transform(F.sequence(F.lit(1), F.size("run"), F.lit(3)), lambda i: digest(F.array_join(F.slice("run", i, 3), ""))))
        at, up_at = (F.col("idx") % 3).cast("int"), F.expr("cast(idx % 9 div 3 as int)")
        steps, up_steps = step("run", up_at * 3, at), step("ups", F.lit(0), up_at)
        up = F.when(F.col("n") > 3, digest(F.array_join("ups", ""))).otherwise(F.col("ups")[0])
        rows = rows.select(
            "g", "idx", "n", *(keep if k == 0 else []), F.expr("idx div 9").alias("parent"), F.when(F.expr("idx % 9 = 0"), up).alias("up"),
            F.when(F.col("n") > 3, F.array(steps, up_steps)).otherwise(F.array(steps)).alias("steps"),
        )
        out.append(staged(rows, f"level{k}"))
        now = out[-1].filter("idx % 9 = 0").select("g", F.col("parent").alias("idx"), F.expr("(n + 8) div 9").alias("n"), F.col("up").alias("h"))
        last = last.unionByName(now.filter("n = 1").select("g", F.lit(k + 1).alias("level"), "h"))
    return out, last


def depth_of(nodes: DataFrame) -> int:
    """Pairs of levels above the largest group's nodes."""
    most, depth = nodes.agg(F.max("n")).first()[0] or 0, 0
    while most > 1:
        most, depth = -(-most // 9), depth + 1
    return depth


def paths(tree: list[DataFrame], nodes: DataFrame, keep: list[str], tops: DataFrame, at: set[int]) -> DataFrame:
    """The bottom level's nodes (``keep``) with their steps up to the root and what their group's top (g, level, path and
    more) brings; a group with one node is its own top.  Tops stand at the levels ``at`` alone."""
    more = [c for c in tops.columns if c not in ("g", "level", "path")]
    own = lambda k: tops.filter(F.col("level") == k).select("g", F.lit(0).cast("long").alias("idx"), "path", *more)
    alone = lambda: nodes.filter("n = 1").select("g", *keep).join(own(0), "g").select("g", "idx", "path", *more, *keep)
    if not tree:
        return alone()
    above = own(len(tree))
    for k in range(len(tree) - 1, -1, -1):
        up = above.select(F.col("g").alias("g_"), F.col("idx").alias("parent_"), F.col("path").alias("path_"), *more)
        rows = tree[k].join(up, (F.col("g") == F.col("g_")) & (F.col("parent") == F.col("parent_")))
        above = rows.select("g", "idx", F.concat("steps", "path_").alias("path"), *more, *(keep if k == 0 else []))
        if k in at:
            above = above.unionByName(own(k) if k else alone())
    return above


def manifest(docs: DataFrame, tamper: Callable[[Column, Column], Column] | None = None, group: str = "source", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, text: str = "text") -> DataFrame:
    """doc_id, leaf, subroot, root, path (siblings before and after, level by level), folded_root, verified.

    ``tamper`` makes, of a document's id and text, the text that is checked against the manifest; without
    it every document is checked as it is.  folded_root is the root that the checked leaf and the original
    siblings give; verified says whether that is the manifest's."""
    cols = {c: F.col(c) for c in fields}
    own = leaf(**cols)
    checked = leaf(**(cols | {text: tamper(F.col(order), F.col(text))})) if tamper else own
    g = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group)))
    leaves = staged(docs.select(g.alias("g"), F.col(order).alias("doc_id"), own.alias("h"), checked.alias("checked")), "leaves")
    nodes = staged(numbered(leaves, ["g"], ["doc_id", "h"], "idx", "n"), "nodes")
    bottom = ["doc_id", "h", "checked"]
    tree, tops = levels(nodes, depth_of(nodes), bottom)
    tops = staged(tops, "subroots")
    at = {r.level for r in tops.select("level").distinct().collect()}
    firsts = staged(numbered(tops.select(F.col("g").alias("of"), F.col("level").alias("of_level"), "h"), [], ["of"], "idx", "n").withColumn("g", F.lit("")), "tops")
    group = ["of", "of_level", "h"]
    crown, top = levels(firsts, depth_of(firsts), group)
    end = top.first()
    root = F.lit(end.h if end else None).cast("string")
    done = paths(crown, firsts, group, top.select("g", "level", F.array().cast(STEP).alias("path")), {end.level} if end else set())
    steps = done.select(F.col("of").alias("g"), F.col("of_level").alias("level"), "path", F.col("h").alias("subroot"))
    rows = paths(tree, nodes, bottom, steps, at)
    folded = F.aggregate("path", F.col("checked"), lambda acc, s: digest(F.concat(s["before"], acc, s["after"])))
    return rows.select("doc_id", F.col("h").alias("leaf"), "subroot", root.alias("root"), "path", folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, from the leaf's to the root's."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def newlines_gone(doc_id: Column, text: Column) -> Column:
    """A text without its newlines, for documents whose id's crc32 is even; others as they are."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
