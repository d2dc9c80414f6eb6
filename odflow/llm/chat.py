"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and its reply as the only
part that carries loss. Built-in functions only.

Template: ``### role⏎text</turn>⏎`` for each turn. Inside texts and roles a backslash becomes ``\\s``, ``###``
becomes ``\\h`` and ``</turn>`` becomes ``\\t`` (in roles a line feed becomes ``\\n``), so that no text can open or close
a turn, and reading back is exact.

Cases: turns of one number stand in order of role, then text; repeated rows are repeated turns; a null text or role is
empty; a null turn number stands first. Turns after the last reply make one more example without loss, so that a
conversation without any reply is still there. Conversations with a null id form one conversation. Other columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, TAIL = "### ", "</turn>\n"
REPLY = "assistant"
#: Escapes, in the order in which they are applied.
ESCAPES = (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\t"))


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def chat_examples(conversations: DataFrame) -> DataFrame:
    """One row per example: ``conv_id, example`` (its last turn's place, from 1), ``formatted``, ``loss_start, loss_length``.

    Places count code points from 0; the loss span holds the escaped reply alone. The last example of a conversation
    holds all its turns.
    """
    turns = conversations.select(
        F.col("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("row"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    pieces = whole.select(
        "conv_id",
        F.transform(
            "rows",
            lambda t: F.struct(
                F.concat(F.lit(HEAD), _escape_role(t["role"]), F.lit("\n")).alias("head"),
                escape(t["text"]).alias("body"),
                (t["role"] == REPLY).alias("reply"),
            ),
        ).alias("pieces"),
    )
    last = F.size("pieces")
    targets = F.filter(F.sequence(F.lit(1), last), lambda i: F.element_at("pieces", i)["reply"] | (i == last))
    each = pieces.select("conv_id", "pieces", F.explode(targets).alias("example"))
    joined = lambda parts: F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(TAIL))), "")
    target = F.element_at("pieces", F.col("example"))
    before = joined(F.slice("pieces", F.lit(1), F.col("example") - 1))
    return each.select("conv_id", "example", before.alias("before"), target.alias("target")).select(
        "conv_id",
        "example",
        F.concat("before", "target.head", "target.body", F.lit(TAIL)).alias("formatted"),
        (F.length("before") + F.length("target.head")).cast("long").alias("loss_start"),
        F.when(F.col("target.reply"), F.length("target.body")).otherwise(0).cast("long").alias("loss_length"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """The conversations again, from formatted text and masks alone: ``conv_id, turns, replies, formatted_chars``.

    ``turns`` holds ``role, text`` in order and is parsed from the last example; ``replies`` the unescaped masked texts in order.
    ``formatted_chars`` sums the code points of all examples.
    """
    # Places count from 0, as Spark's substring counts from 1.
    masked = examples.withColumn("reply", unescape(F.substring(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), F.col("loss_length").cast("int"))))
    whole = masked.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("formatted"),
        F.array_sort(F.collect_list(F.when(F.col("loss_start").isNotNull(), F.struct("example", "reply")))).alias("replies"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    parts = F.split("formatted", TAIL)  # the tail has no character that a pattern reads otherwise
    parts = F.slice(parts, 1, F.size(parts) - 1)
    turn = lambda p: F.struct(
        _unescape_role(F.substring_index(F.substr(p, F.lit(len(HEAD) + 1)), "\n", 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text"),
    )
    return whole.select(
        "conv_id",
        F.transform(parts, turn).alias("turns"),
        F.transform("replies", lambda r: r["reply"]).alias("replies"),
        "formatted_chars",
    )
