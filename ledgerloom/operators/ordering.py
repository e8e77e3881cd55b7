"""Exact places and running values in a total order, with no large group's rows in one task.

A window over a whole table, or over a group that holds a third of it, runs in one task.  Here groups that
may hold more than a task's fair share are told apart by counts of hashed groups; their rows alone are
dealt into ranges of (group, order), a window runs within each range and group, and what stands in a group's
ranges before is carried over.  Only groups that reach over a range's border need that: a border is
within one group, so they have at most twice as many (group, range) pairs as there are ranges, and that table
may be broadcast whatever the data.  All other groups are one window's each, behind a single shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import cut


def parts_of(rows: DataFrame) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


#: Rows of a task where rows are dealt by ``shares``; tables of fewer than FEW of those are left to Spark.
TASK_ROWS, FEW = 250_000, 16


def shares(rows: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """rows (``n_rows`` at most) distributed by ``keys`` over tasks of about TASK_ROWS, however large the table is: left to
    itself, a shuffle has a fixed number of parts, or parts of so many compressed bytes, and a task's memory grows with them."""
    n = -(-n_rows // TASK_ROWS)
    return rows if n < FEW else rows.repartition(n, *map(F.col, keys))


def _bucket(group: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*map(F.col, group)), F.lit(64 * n))


def hot(rows: DataFrame, group: list[str], parts: int | None = None, count: str | None = None) -> list[int]:
    """Hashes of groups that together hold more than a task's fair share of rows: fewer than there are parts.
    Every group that alone holds more is among them, others may be: results are the same either way.  The column
    ``count`` says how many rows a row stands for."""
    n = parts or parts_of(rows)
    if not group:
        return []
    by = rows.groupBy(_bucket(group, n).alias("b")).agg((F.count("*") if count is None else F.sum(count)).alias("count"))
    fair = F.sum("count").over(Window.partitionBy()) / n  # of at most 64 n rows
    return [r.b for r in by.withColumn("fair", fair).filter(F.col("count") > F.col("fair")).select("b").collect()]


def parted(rows: DataFrame, group: list[str], large: list[int]) -> tuple[DataFrame, DataFrame | None]:
    """rows of all but hot groups, and those of hot groups if there are any."""
    few = _bucket(group, parts_of(rows)).isin(large)
    return (rows.filter(~few), rows.filter(few)) if large else (rows, None)


def split(rows: DataFrame, group: list[str], large: list[int]) -> tuple[DataFrame, DataFrame | None]:
    """rows distributed by group, all work on a group then being one task's without another shuffle; and those of
    hot groups apart, as they are."""
    own, few = parted(rows, group, large)
    return own.repartition(*map(F.col, group)), few


class Ranges:
    """rows in ranges of ``group`` (columns) and ``order``, with what ``local(rows, run, place)`` adds by the
    windows ``run`` (all rows of the range and group up to this one) and ``place`` (the order alone).
    Rows equal in ``order`` share a range and come in any order; the dealt ones are cut, so they stay in it.
    A group that is not hot is one range of its own, -1, and ``local`` sees no column range_.  ``large`` is what ``hot``
    finds, if that is known; ``dealt`` says that rows are distributed by their group already; ``wider`` adds the columns of
    ``order`` that need not be shuffled; borders fall between rows that differ in the first ``border`` columns of it."""

    def __init__(self, rows: DataFrame, group: list[str], order: list[str | Column], local: Callable[..., DataFrame], parts: int | None = None, large: list[int] | None = None, dealt: bool = False, wider: Callable[[DataFrame], DataFrame] = lambda rows: rows, border: int | None = None):
        keys = [F.col(c) if isinstance(c, str) else c for c in order]
        n = parts or parts_of(rows)
        self.group, self.cold, self.dealt = group, None, None
        if group:
            large = hot(rows, group, n) if large is None else large
            few = _bucket(group, n).isin(large) if large else F.lit(False)
            own = rows.filter(~few) if large else rows
            own = own if dealt else own.repartition(*map(F.col, group))
            place = Window.partitionBy(*group).orderBy(*keys)
            self.cold = local(wider(own), place.rowsBetween(Window.unboundedPreceding, 0), place).withColumn("range_", F.lit(-1))
        if large or not group:
            own = rows.filter(few) if group else rows
            own = wider(own).repartitionByRange(n, *map(F.col, group), *keys[:border]).withColumn("range_", F.spark_partition_id())
            place = Window.partitionBy("range_", *group).orderBy(*keys)
            self.dealt = cut(local(own, place.rowsBetween(Window.unboundedPreceding, 0), place))

    @property
    def rows(self) -> DataFrame:
        both = [d for d in (self.cold, self.dealt) if d is not None]
        return both[0] if len(both) == 1 else both[0].unionByName(both[1])

    def carried(self, own: list[Column], carry: Callable[..., DataFrame]) -> DataFrame:
        """rows, and beside them the columns that ``carry(table, before, whole)`` makes of a table of the
        aggregates ``own`` of each range and group; null for a group that stands in one range.  Windows:
        ``before`` has the group's ranges before this one, ``whole`` all of them."""
        many = Window.partitionBy(*self.group)
        at = many.orderBy("range_")
        source = self.cold if self.dealt is None else self.dealt
        by = source.groupBy("range_", *self.group).agg(*own)
        spans = by.withColumn("spans_", F.count("*").over(many)).filter("spans_ > 1").drop("spans_")
        table = carry(spans, at.rowsBetween(Window.unboundedPreceding, -1), many)
        new = [c for c in table.columns if c not in ("range_", *self.group) and c not in by.columns]
        names = [c for c in source.columns if c != "range_"]
        alone = None if self.cold is None else self.cold.select(*(F.col(f"`{c}`") for c in names), *(F.lit(None).cast(table.schema[c].dataType).alias(c) for c in new))
        if self.dealt is None:
            return alone
        same = F.col("a.range_") == F.col("b.range_")
        for c in self.group:
            same &= F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
        out = self.dealt.alias("a").join(F.broadcast(table.select("range_", *self.group, *new)).alias("b"), same, "left")
        out = out.select(*(F.col(f"a.`{c}`") for c in names), *(F.col(f"b.{c}") for c in new))
        return out if alone is None else alone.unionByName(out)


def _whole(at):
    return at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def numbered(rows: DataFrame, group: list[str], order: list[str | Column], place: str = "place", size: str | None = None, parts: int | None = None, large: list[int] | None = None, dealt: bool = False) -> DataFrame:
    """rows with their ``place`` (from 0) in ``order`` within ``group`` (none: the whole table) and, if named,
    their group's ``size``.  Rows equal in ``order`` are numbered in any order.  Null is a group, and sorts first.
    ``large`` and ``dealt`` are as in ``Ranges``."""

    def local(dealt, run, at):
        return dealt.withColumn("row_", F.row_number().over(at)).withColumn("own_", F.count("*").over(_whole(at)))

    def carry(table, before, all_):
        return table.withColumn("before_", F.sum("n_").over(before)).withColumn("size_", F.sum("n_").over(all_))

    out = Ranges(rows, group, order, local, parts, large=large, dealt=dealt).carried([F.count("*").alias("n_")], carry)
    more = [] if size is None else [F.coalesce("size_", "own_").alias(size)]
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("row_") - 1 + F.coalesce("before_", F.lit(0))).cast("long").alias(place), *more)


def medians(rows: DataFrame, group: list[str], value: str, median: str, count: str, large: list[int] | None = None, dealt: bool = False) -> DataFrame:
    """Exact median of ``value`` and number of rows of each group: rows are counted by value, the counts
    summed up in order of value, and the middle ones picked.  ``large`` and ``dealt`` are as in ``Ranges``."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n_"))

    def local(dealt, run, at):
        return dealt.withColumn("upto_", F.sum("n_").over(run)).withColumn("all_", F.sum("n_").over(_whole(at)))

    def carry(table, before, all_):
        return table.withColumn("before_", F.sum("sum_").over(before)).withColumn("total_", F.sum("sum_").over(all_))

    out = Ranges(counts, group, [value], local, large=hot(rows, group) if large is None else large, dealt=dealt).carried([F.sum("n_").alias("sum_")], carry)
    out = out.withColumn("upto_", F.col("upto_") + F.coalesce("before_", F.lit(0))).withColumn("total_", F.coalesce("total_", "all_"))
    holds = lambda at: (F.col("upto_") - F.col("n_") <= at) & (at < F.col("upto_"))
    low, high = holds(F.expr("(total_ - 1) div 2")), holds(F.expr("total_ div 2"))
    picked = out.filter(low | high).groupBy(*group).agg(F.max(F.when(low, F.col(value))).alias("a_"), F.max(F.when(high, F.col(value))).alias("b_"), F.max("total_").alias(count))
    return picked.select(*group, ((F.col("a_").cast("double") + F.col("b_").cast("double")) / 2).alias(median), count)
