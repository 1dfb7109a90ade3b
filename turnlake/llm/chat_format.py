"""Chat formatting with typed content parts and a loss mask, in DataFrame functions only.

The text of a turn is ``### Role: `` + escaped content + ``</turn>`` + line feed.
Control strings need ``#`` or ``<``, which the escaping takes out of texts:

    backslash -> \\b     # -> \\h     < -> \\l

Each backslash is then followed by exactly one of these letters, so plain
replacements in the other order restore the text, and markers are unambiguous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

OPEN, CLOSE = "### ", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
#: Tokens that the placeholder of an attachment stands for when a part names none.
DEFAULT_TOKENS = {"image": 256, "audio": 128, "document": 512}


def escape(text: Column) -> Column:
    for raw, written in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for raw, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(raw))
    return text


def visit_parts(parts: Column) -> Column:
    """Flatten typed parts in order: a visitor of each kind gives its text, and its attachments.

    ``parts`` is ``ARRAY<STRUCT<kind, text, ref, tokens>>``.  Text parts give
    their escaped text; image, audio and document parts give ``<kind k>``,
    ``k`` counting the attachments of the turn from 0.  Unknown kinds count as
    attachments of their own name, a NULL kind as text.  Gives ``STRUCT<content,
    attachments ARRAY<STRUCT<place, kind, ref, tokens>>>``; ``tokens`` falls
    back to the default of the kind, 0 for unknown kinds.
    """
    is_text = lambda p: F.coalesce(p["kind"], F.lit("text")) == "text"
    parts = F.coalesce(parts, F.expr("CAST(array() AS ARRAY<STRUCT<kind: STRING, text: STRING, ref: STRING, tokens: BIGINT>>)"))
    others = F.filter(parts, lambda p: ~is_text(p))
    default = F.create_map(*[F.lit(x) for kv in DEFAULT_TOKENS.items() for x in kv])
    attachments = F.transform(
        others,
        lambda p, k: F.struct(
            k.alias("place"), p["kind"].alias("kind"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.element_at(default, p["kind"]), F.lit(0)).cast("long").alias("tokens")
        ),
    )
    # The number of a placeholder is that of the attachments up to it.
    content = F.transform(
        parts,
        lambda p, i: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(
            F.concat(F.lit("<"), escape(p["kind"]), F.lit(" "), (F.size(F.filter(F.slice(parts, F.lit(1), i + 1), lambda q: ~is_text(q))) - 1).cast("string"), F.lit(">"))
        ),
    )
    return F.struct(F.array_join(content, "").alias("content"), attachments.alias("attachments"))


def text_part(text: Column) -> Column:
    """One text part; a NULL text is empty."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")))


def format_turns(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", parts_column: str | None = None, text_column: str = "text") -> DataFrame:
    """One row per conversation: ``formatted``, ``loss``, ``attachments``.

    Turns ascend by number, NULL first, ties by role then content; repeated
    rows are repeated turns.  NULL roles are empty, NULL texts too.  A NULL id is
    one conversation.  Without ``parts_column`` a turn is one text part.

    ``loss`` has an entry per turn: where the turn starts (``at``) and where
    the masked text ``begin``s and ``end``s, in code points of ``formatted``;
    both are NULL but for assistant turns.  Turns are written before they meet,
    so the task of a conversation only places and joins strings.
    """
    part = F.col(parts_column) if parts_column else text_part(F.col(text_column).cast("string"))
    head = F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit(": "))
    rows = (
        turns.select(F.col(id_column).alias("id"), F.col(turn_column).cast("long").alias("turn"), F.coalesce(F.col(role_column).cast("string"), F.lit("")).alias("role"), visit_parts(part).alias("v"))
        .select("id", "turn", "role", F.concat(head, "v.content", F.lit(CLOSE)).alias("written"), F.char_length(head).alias("head"), F.col("v.attachments").alias("attachments"))
        .withColumn("n", F.char_length("written").cast("long"))
    )
    order = W.partitionBy("id").orderBy("turn", "role", "written")
    stop = F.sum("n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = rows.withColumn("stop", stop).select("id", F.struct("stop", "n", "head", "role", "written", "attachments").alias("t"))
    joined = placed.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    speaks = lambda t, v: F.when(t["role"] == "assistant", v)
    return joined.select(
        F.col("id").alias(id_column),
        F.array_join(F.transform("ts", lambda t: t["written"]), "").alias("formatted"),
        F.transform(
            "ts", lambda t: F.struct((t["stop"] - t["n"]).alias("at"), speaks(t, t["stop"] - t["n"] + t["head"]).alias("begin"), speaks(t, t["stop"] - len(CLOSE)).alias("end"))
        ).alias("loss"),
        F.flatten(
            F.transform("ts", lambda t, i: F.transform(t["attachments"], lambda a: F.struct(i.alias("turn"), a["place"].alias("place"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))
        ).alias("attachments"),
    )


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def read_turns(formatted: Column) -> Column:
    """Roles and texts, unescaped, in order: ``ARRAY<STRUCT<role, text>>``.  Placeholders stay as written."""
    head = len(OPEN)
    role = lambda t: unescape(F.replace(F.substr(t, F.lit(head + 1), F.instr(t, ": ") - 1 - head), F.lit("\\c"), F.lit(":")))
    text = lambda t: unescape(F.substr(t, F.instr(t, ": ") + 2))
    return F.transform(F.filter(F.split(formatted, CLOSE), lambda t: t != ""), lambda t: F.struct(role(t).alias("role"), text(t).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between.

    The string is split after its end marks first, so each span is looked up
    in its own turn and long conversations cost no more per turn.
    """
    both = F.arrays_zip(F.split(formatted, f"(?<={CLOSE})").alias("turn"), loss.alias("loss"))
    masked = F.filter(both, lambda z: z["loss"]["begin"].isNotNull())
    span = lambda z: F.substr(z["turn"], (z["loss"]["begin"] - z["loss"]["at"] + 1).cast("int"), (z["loss"]["end"] - z["loss"]["begin"]).cast("int"))
    return F.array_join(F.transform(masked, lambda z: unescape(span(z))), "")
