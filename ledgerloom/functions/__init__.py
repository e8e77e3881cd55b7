"""Scalar functions, each a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_address(c: Column) -> Column:
    return F.when(F.length(c) > 20, F.concat(F.substring(c, 1, 10), F.lit("…"), F.right(c, F.lit(6)))).otherwise(c)


def clean_entity(c: Column) -> Column:
    """Outer quotes off, colons spaced, a trailing index gone; the label itself if nothing is left."""
    own = F.regexp_replace(c, r"^\s+|\s+$", "")
    s = F.regexp_replace(F.regexp_replace(own, "^[\"']+|[\"']+$", ""), r"\s*:\s*", ": ")
    s = F.regexp_replace(F.regexp_replace(s, r"[\s_-]+\d+$", ""), r"^\s+|\s+$", "")
    return F.when(s == "", own).otherwise(s)


def token_like(c: Column) -> Column:
    return c.rlike(r"\(\s*[\p{L}\p{N}_]{2,10}\s*\)\s*$") | F.lower(c).contains("token") | F.lower(c).contains("voucher")


def duration(seconds: Column) -> Column:
    s = seconds.cast("long")
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(s < 90, text(s, " sec")).when(s < 5400, text(F.floor(s / 60), " min")).when(s < 172800, text(F.floor(s / 3600), " h")).otherwise(text(F.floor(s / 86400), " days"))


def amount(v: Column, symbol: Column) -> Column:
    x = v.cast("double")
    n = F.when(x >= 1000, F.format_number(x, 0)).when(x >= 1, F.format_number(x, 2)).otherwise(F.format_number(x, 4))
    return F.concat_ws(" ", n, symbol)


def asset_list(assets: Column, shown: int = 3) -> Column:
    """The largest amounts of a map by asset, then how many more; "0" if none."""
    rows = F.transform(F.map_entries(assets), lambda e: F.struct((-e["value"].cast("double")).alias("v"), e["key"].alias("k")))
    best = F.slice(F.array_sort(rows), 1, shown)
    text = F.array_join(F.transform(best, lambda e: amount(-e["v"], e["k"])), " + ")
    more = F.when(F.size(rows) > shown, F.concat(F.lit(" +"), (F.size(rows) - shown).cast("string"), F.lit(" more"))).otherwise("")
    return F.when(F.size(rows) == 0, "0").otherwise(F.concat(text, more))
