"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own: all turns before it are context, and only the
reply is trainable. A conversation that does not end with an assistant turn gets one more example
without any trainable part, so that no turn is lost. Each turn is written as

    <|turn|>role\\ntext<|end|>

Control strings inside roles and texts are escaped: ``&`` becomes ``&amp;``, and the first character
of every control string an entity, so unescaping gives back the very text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|turn|>", "<|end|>"
#: Strings with a meaning in this template or in those that models commonly use.
CONTROLS = (OPEN, CLOSE, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ENTITIES = {"<": "&lt;", "[": "&#91;", "\n": "&#10;"}


def escaped(text: Column, line_breaks: bool = False) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(ENTITIES[control[0]] + control[1:]))
    return F.replace(out, F.lit("\n"), F.lit(ENTITIES["\n"])) if line_breaks else out


def unescaped(text: Column) -> Column:
    for plain, entity in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns (turns in the example), text, loss_start and loss_end (code points, end
    excluded; both the text's length where nothing is trainable).

    Turns are ordered by turn, then role and text; a null turn comes first. Null roles and texts are
    empty strings; null conv_ids form one conversation; repeated rows are turns of their own; an
    empty table gives no rows; other columns are ignored. An example is one string, so the turns
    of one conversation, and nothing beyond them, meet in one row.
    """
    plain = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(OPEN), escaped(F.col("role"), line_breaks=True), F.lit("\n"))
    rows = plain.select("conv_id", F.struct("turn", "role", "text", head.alias("head"), escaped(F.col("text")).alias("body")).alias("row"))
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    ends = F.filter(F.sequence(F.lit(1), F.size("rows")), lambda k: (F.get("rows", k - 1)["role"] == "assistant") | (k == F.size("rows")))
    each = talks.select("conv_id", "rows", F.explode(ends).alias("n_turns"))
    context = F.array_join(F.transform(F.slice("rows", F.lit(1), F.col("n_turns") - 1), lambda r: F.concat(r["head"], r["body"], F.lit(CLOSE))), "")
    last = F.get("rows", F.col("n_turns") - 1)
    parts = each.select("conv_id", "n_turns", F.concat(context, last["head"]).alias("before"), last["body"].alias("reply"), (last["role"] == "assistant").alias("trained"))
    text = F.concat("before", "reply", F.lit(CLOSE))
    start = F.when(F.col("trained"), F.length("before")).otherwise(F.length(text))
    return parts.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), text.alias("text"), start.cast("long").alias("loss_start"), F.when(F.col("trained"), start + F.length("reply")).otherwise(start).cast("long").alias("loss_end"))


def read_back(formatted: DataFrame) -> DataFrame:
    """For each conversation, from its examples alone: conv_id, turns (role, text), loss (the
    trainable text, unescaped) and formatted_chars."""
    span = F.substring(F.col("text"), F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))
    marked = formatted.select("conv_id", "n_turns", "text", unescaped(span).alias("reply"))
    whole = marked.groupBy("conv_id").agg(
        F.max_by("text", "n_turns").alias("text"), F.array_sort(F.collect_list(F.struct("n_turns", "reply"))).alias("replies"), F.sum(F.length("text")).alias("formatted_chars")
    )
    pieces = F.filter(F.split("text", r"<\|end\|>"), lambda x: x != "")
    turn = lambda x: F.struct(unescaped(F.substring_index(F.substring(x, F.lit(len(OPEN) + 1), F.length(x)), "\n", 1)).alias("role"), unescaped(F.substring(x, F.locate("\n", x) + 1, F.length(x))).alias("text"))
    return whole.select("conv_id", F.transform(pieces, turn).alias("turns"), F.array_join(F.transform("replies", lambda r: r["reply"]), "").alias("loss"), "formatted_chars")


def digests(talks: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return talks.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(said, "utf-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "utf-8"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
