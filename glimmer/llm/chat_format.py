"""Chat formatting with one example for each reply.

Every assistant turn becomes an example: all turns before it as context, and that reply alone trainable. Turns after a
conversation's last reply, or all of one without any, stand in a last example without a target, so that nothing is
lost. An example is a text in which each turn reads `<|im_start|>role`, a line break, the text, `<|im_end|>`, a line
break; `loss_start` and `loss_end` are code points of the trainable part, the reply's own text (null: no target).

Control strings inside texts are escaped reversibly: a backslash is doubled, then `<|` becomes `<\\|`, so `<|` occurs in
an example only where the template puts it. In roles a line break becomes `<\\:` as well.

Turns are ordered by turn, then role and text; null turn first. Null texts and roles are empty; rows with a null
conv_id form one conversation. Repeated rows are turns of their own. Other columns are ignored. An empty table gives
no examples. A conversation is the unit of work, as its examples repeat its turns: its rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def _replace(c: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape(c: Column) -> Column:
    return _replace(c, ("\\", "\\\\"), ("<|", "<\\|"))


def unescape(c: Column) -> Column:
    return _replace(c, ("<\\|", "<|"), ("\\\\", "\\"))


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (its turns' number), text, loss_start, loss_end."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    talks = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    body = lambda t: F.concat(F.lit(START), _replace(escape(t["role"]), ("\n", "<\\:")), F.lit("\n"), escape(t["text"]), F.lit(f"{END}\n"))
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (F.element_at("turns", i)["role"] == TRAINED) | (i == F.size("turns")))
    each = talks.select("conv_id", "turns", F.transform("turns", body).alias("bodies"), F.explode(ends).alias("example"))
    last = F.element_at("turns", F.col("example"))
    shaped = each.select("conv_id", "example", F.array_join(F.slice("bodies", 1, F.col("example")), "").alias("text"), F.when(last["role"] == TRAINED, F.length(escape(last["text"]))).alias("n"))
    end = F.when(F.col("n").isNotNull(), F.length("text") - len(END) - 1)
    return shaped.select("conv_id", F.col("example").cast("long").alias("example"), "text", (end - F.col("n")).alias("loss_start"), end.alias("loss_end"))


def read_back(formatted: DataFrame) -> DataFrame:
    """From examples: conv_id, turns (role, text), replies (the texts under the loss mask in order), formatted_chars."""
    target = F.when(F.col("loss_start").isNotNull(), unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))
    talks = formatted.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("longest"),
        F.sort_array(F.collect_list(F.when(target.isNotNull(), F.struct(F.col("example"), target.alias("reply"))))).alias("targets"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    parts = F.filter(F.split("longest", r"<\|im_start\|>"), lambda p: p != "")
    head = lambda p: F.substring_index(p, "\n", 1)
    turn = lambda p: F.struct(
        _replace(head(p), ("<\\:", "\n"), ("<\\|", "<|"), ("\\\\", "\\")).alias("role"),
        unescape(F.substring(p, F.length(head(p)) + 2, F.length(p) - F.length(head(p)) - len(END) - 2)).alias("text"),
    )
    return talks.select("conv_id", F.transform(parts, turn).alias("turns"), F.transform("targets", lambda x: x["reply"]).alias("replies"), "formatted_chars")


def digest(formatted: DataFrame) -> DataFrame:
    replies = F.array_join("replies", "")
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(replies).cast("long").alias("loss_chars"),
        F.sha2(replies, 256).alias("loss_sha256"),
        "formatted_chars",
    )
