"""Chat formatting with prefix-target expansion, in DataFrame operations only.

A conversation is written once, as a stream of pieces, one for each turn. Every
assistant turn is an example of its own: its context is the stream from the start to
where the reply begins, and its loss mask is the reply alone. Examples hold positions
in the stream, so a conversation of n turns takes memory in proportion to n, though
its examples' contexts add up to n squared; ``rendered`` writes them out in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, text_or_empty

# Fixed values of the template: its control strings and what stands around a text.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
ESCAPABLE = r"([<\[])(?=/?(?:s>|INST\]))"
PIECE = r"(?s)^<s>(.*?)(?:<s>|\[INST\])(.*)(?:</s>|\[/INST\])\z"


def escaped(text: Column) -> Column:
    """The text without any control string: backslashes are doubled, and one goes after the first sign of a control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), ESCAPABLE, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The stream: (conv_id, seq, piece, start, loss_start, loss_end), a row for each turn, positions in code points.

    A piece is <s>user[INST]text[/INST] for a user's turn and <s>role<s>text</s> for any other. seq counts from 1 by turn
    (nulls first), then role and text, so rows that tie or repeat have one order and all stay. Null texts and roles are
    empty; rows with a null conversation id are one conversation. The loss span is null but for assistant turns.
    """
    inner, name = escaped(text_or_empty(text)), escaped(text_or_empty(role))
    is_user, is_reply = text_or_empty(role) == "user", text_or_empty(role) == "assistant"
    head = F.concat(F.lit("<s>"), name, F.when(is_user, "[INST]").otherwise("<s>"))
    tail = F.when(is_user, "[/INST]").otherwise("</s>")
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("_turn"), F.col(role).alias("_role"), F.col(text).alias("_text"), F.concat(head, inner, tail).alias("piece"), F.length(head).alias("_head"), F.length(inner).alias("_inner"), is_reply.alias("_reply"))
    order = W.partitionBy("conv_id").orderBy("_turn", "_role", "_text")
    start = F.coalesce(F.sum(F.length("piece").cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select("*", F.row_number().over(order).alias("seq"), start.alias("start"))
    loss = F.when(F.col("_reply"), F.col("start") + F.col("_head"))
    return rows.select("conv_id", "seq", "piece", "start", loss.alias("loss_start"), (loss + F.col("_inner")).alias("loss_end"))


def examples(stream: DataFrame) -> DataFrame:
    """(conv_id, example, context_end, loss_start, loss_end): an example for each assistant turn; its text is the
    stream's first context_end code points and the reply's piece, of which only the loss span is trained on."""
    return stream.where("loss_start is not null").select("conv_id", F.col("seq").alias("example"), F.col("start").alias("context_end"), "loss_start", "loss_end")


def rendered(stream: DataFrame) -> DataFrame:
    """(conv_id, example, prompt, target) in full text; as large as the contexts are long together."""
    parts = stream.alias("a").join(stream.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("b.seq") < F.col("a.seq")), "left").where("a.loss_start is not null")
    pieces = F.array_sort(F.collect_list(F.when(F.col("b.seq").isNotNull(), F.struct(F.col("b.seq").alias("seq"), F.col("b.piece").alias("piece")))))
    whole = parts.groupBy(F.col("a.conv_id").alias("conv_id"), F.col("a.seq").alias("example"), F.col("a.piece").alias("own"), (F.col("a.loss_start") - F.col("a.start")).cast("int").alias("skip"), (F.col("a.loss_end") - F.col("a.loss_start")).cast("int").alias("n")).agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("context"))
    return whole.select("conv_id", "example", F.concat("context", F.expr("substring(own, 1, skip)")).alias("prompt"), F.expr("substring(own, skip + 1, n)").alias("target"))


def parsed(stream: DataFrame) -> DataFrame:
    """Adds role and text as they are read from the pieces alone."""
    role, text = (unescaped(F.regexp_extract("piece", PIECE, group)) for group in (1, 2))
    return stream.withColumn("role", role).withColumn("text", text)


def read_back(stream: DataFrame, dealt: DataFrame | None = None) -> DataFrame:
    """Per conversation, all from the written output: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    dealt: the examples, as ``examples`` makes them of the stream. What is trained on is read by them alone: each one's
    loss span, from the piece that begins where its context ends.
    """
    dealt = (examples(stream) if dealt is None else dealt).select(F.col("conv_id").alias("_conv"), F.col("context_end").alias("_end"), F.col("loss_start").alias("_from"), F.col("loss_end").alias("_to"))
    rows = parsed(stream.drop("loss_start", "loss_end")).join(dealt, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("start") == F.col("_end")), "left")
    rows = rows.withColumn("loss", F.expr("substring(piece, cast(_from - _end + 1 as int), cast(_to - _from as int))"))
    all_turns = F.array_sort(F.collect_list(F.struct("seq", "role", "text", "loss")))
    whole = rows.groupBy("conv_id").agg(all_turns.alias("turns"), F.sum(F.length("piece")).cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("turns", lambda t: unescaped(F.coalesce(t["loss"], F.lit("")))), "")
    return whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def format_and_read_back(turns: DataFrame) -> DataFrame:
    """Writes the stream and its examples' positions to the shared folder and digests what can be read from them."""
    stream = stored(format_turns(turns), "chat")
    return read_back(stream, stored(examples(stream), "chat-examples"))
