"""Chat formatting by event-sourced reconstruction, DataFrame functions only.

The log has one row for each event: conv_id, seq (long), turn, role, kind, text.  Kinds:

- ``delta``       text is added to the turn's message;
- ``edit``        the message's text is replaced by this text, later deltas are added to it;
- ``regenerate``  the message is begun anew (text, if any, is its first part);
- ``delete``      the turn has no message unless later events write one.

Folding is associative: an event's effect on a message is (resets?, text), and of a run of events in
sequence only the last reset and what follows it count.  So each turn's events are folded in blocks
of ``BLOCK`` sequence places first and block results afterwards: no task holds more than a
block's events or one conversation's messages.

Rendering marks turns with control strings; inside roles and texts a backslash becomes ``\\b``,
``<|`` becomes ``<\\p``, and in roles a newline becomes ``\\n``, which ``unescape`` undoes.  So
control strings in the result are marks only, and the result can be read back.

A message's role is the first one that its events name.

Nulls: a null text is empty, a null role none (empty if no event names one), a null kind a delta; events with null conv_id form a
conversation of their own, null turn and null seq sort first.  Ties in seq are taken in order of
kind and text, so the result is defined; repeated events count each.  Empty tables give no row.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"
BLOCK = 1024


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\p"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\n"), F.lit("\n")))


def _fold(parts: Column) -> Column:
    """Of parts in order, struct(resets, gone, text): the last that resets and those after it."""
    resets = F.transform(parts, lambda p, i: F.when(p["resets"], i + 1).otherwise(0))
    last = F.array_max(resets)
    kept = F.slice(parts, F.greatest(last, F.lit(1)), F.size(parts))
    return F.struct(
        (last > 0).alias("resets"),
        # a deleted message is gone unless something is written after
        F.element_at(kept, -1)["gone"].alias("gone"),
        F.array_join(F.transform(kept, lambda p: p["text"]), "").alias("text"),
        F.get(F.filter(F.transform(parts, lambda p: p["role"]), lambda r: r.isNotNull()), F.lit(0)).alias("role"),
    )


def reconstruct(events: DataFrame, keys: tuple[str, ...] = ("turn",)) -> DataFrame:
    """conv_id, keys (which turn a message is), role, text of the final messages."""
    kind = F.coalesce("kind", F.lit("delta"))
    text = F.when(kind == "delete", "").otherwise(F.coalesce("text", F.lit("")))
    part = F.struct(
        "seq",
        kind.alias("kind"),
        text.alias("text"),
        kind.isin("edit", "regenerate", "delete").alias("resets"),
        (kind == "delete").alias("gone"),
        "role",
    )
    blocks = (
        events.select("conv_id", *keys, F.expr(f"seq div {BLOCK}").alias("block"), part.alias("e"))
        .groupBy("conv_id", *keys, "block")
        .agg(F.sort_array(F.collect_list("e")).alias("parts"))
        .select("conv_id", *keys, F.struct("block", _fold(F.col("parts")).alias("f")).alias("b"))
    )
    whole = blocks.groupBy("conv_id", *keys).agg(F.sort_array(F.collect_list("b")).alias("parts"))
    folded = whole.select("conv_id", *keys, _fold(F.transform("parts", lambda b: b["f"])).alias("m"))
    return folded.filter(~F.col("m.gone")).select("conv_id", *keys, F.coalesce("m.role", F.lit("")).alias("role"), "m.text")


def from_turns(turns: DataFrame, delta: int = 256) -> DataFrame:
    """The event log of conversations stored as finished turns, as a stream would have written it: each
    row begins its message with its role, then its text follows in deltas of ``delta`` characters.
    Rows that repeat a turn number are messages of their own (column copy), in order of role and text.
    For ``reconstruct`` and ``render`` by the keys turn, copy."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = rows.withColumn("copy", F.row_number().over(w))
    # cut once, from the start to the end: the begin mark, then the pieces
    pieces = F.concat(F.array(F.lit("")), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta}}}"), F.lit(0)))
    events = rows.select("conv_id", "turn", "copy", "role", F.posexplode(pieces).alias("seq", "piece"))
    begun = F.col("seq") == 0
    return events.select(
        "conv_id",
        "turn",
        "copy",
        F.col("seq").cast("long").alias("seq"),
        F.when(begun, F.col("role")).alias("role"),
        F.when(begun, "regenerate").otherwise("delta").alias("kind"),
        F.col("piece").alias("text"),
    )


def render(messages: DataFrame, loss_role: str = "assistant", keys: tuple[str, ...] = ("turn",)) -> DataFrame:
    """conv_id, formatted (the whole conversation), loss: for each turn in order (from, length),
    characters of its rendered segment under the loss mask (length 0: none), and starts, where each
    segment begins.  One row for each conversation; that is the output's own unit."""
    head = F.concat(F.lit(BEGIN), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    shown = F.concat(head, body, F.lit(END + "\n"))
    rows = messages.select(
        "conv_id",
        F.struct(
            *keys,
            shown.alias("shown"),
            F.char_length(head).alias("from"),
            F.when(F.col("role") == loss_role, F.char_length(body)).otherwise(0).alias("length"),
            F.char_length(shown).alias("size"),
        ).alias("s"),
    )
    by = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return by.select(
        "conv_id",
        F.array_join(F.transform("s", lambda x: x["shown"]), "").alias("formatted"),
        F.transform("s", lambda x: F.struct(x["from"].alias("from"), x["length"].alias("length"))).alias("loss"),
        F.transform("s", lambda x: x["size"]).alias("sizes"),
    )


def parse(formatted: Column) -> Column:
    """The rendered segments of a formatted conversation, without their end marks."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    return F.slice(pieces, 1, F.size(pieces) - 1)


def digests(rendered: DataFrame) -> DataFrame:
    """Read a rendered table back: turns and loss text digests of each conversation."""
    n = len(BEGIN)
    segments = rendered.select("conv_id", "formatted", "loss", parse(F.col("formatted")).alias("seg"))
    turn = lambda s: F.concat(
        unescape_role(F.substring_index(F.substr(s, F.lit(n + 1)), "\n", 1)),
        F.lit("\n"),
        unescape(F.substr(s, F.locate("\n", s) + 1)),
        F.lit("\n"),
    )
    # a text's own characters are counted after unescaping
    under = lambda s, m: unescape(F.substr(s, m["from"] + 1, m["length"]))
    return segments.select(
        "conv_id",
        F.size("seg").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("seg", turn), "").cast("binary"), 256).alias("turns_sha256"),
        F.array_join(F.zip_with("seg", "loss", under), "").alias("masked"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    ).select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.char_length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
