"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example: all turns before it as context, its own text as the only
trainable span. The template writes a user turn as ``[INST] text [/INST]``, a system turn as
``[SYS] text [/SYS]``, an assistant turn as ``[OUT] text </s>`` and any other as
``[TURN] role [AS] text [/TURN]``, each example opened by ``<s>``.

Inside texts and roles a backslash is put before every backslash and after the first character of
every control string, so no control string is left in them; dropping one backslash before
each character that follows one restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings. Fixed values.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[OUT]", "[TURN]", "[AS]", "[/TURN]")
_INSIDE = r"([\[<])(/?(?:INST|SYS|TURN)\]|OUT\]|AS\]|/?s>)"
_TURNS = r"(?s)\[INST\] .*? \[/INST\]|\[SYS\] .*? \[/SYS\]|\[OUT\] .*? </s>|\[TURN\] .*? \[/TURN\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _INSIDE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _block(role: Column, text: Column) -> Column:
    return (
        F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
        .when(role == "system", F.concat(F.lit("[SYS] "), text, F.lit(" [/SYS]")))
        .when(role == "assistant", F.concat(F.lit("[OUT] "), text, F.lit(" </s>")))
        .otherwise(F.concat(F.lit("[TURN] "), role, F.lit(" [AS] "), text, F.lit(" [/TURN]")))
    )


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, target, text, loss_start, loss_length) of ``turns`` (conv_id, turn, role, text).

    One row per assistant turn; ``target`` is the turn's place in its conversation, from 0. ``text`` is
    the formatted example, and the code points loss_start (from 0) to loss_start + loss_length are
    the trainable reply, without the template's own marks. A conversation whose last turn is not the
    assistant's gets one row more with target null and no trainable span, so that no turn is lost;
    in training it is skipped. Turns come by ``turn`` (null first), ties by role and text. Null roles
    and texts are empty, null conv_ids form one conversation, repeated rows are turns of their own.
    Other columns are ignored, whatever their names; texts of any length are formatted whole.
    An empty table gives no rows. The examples of a conversation lie in the rows of its own size
    squared: that is what the expansion asks for; they are made from one array, row by row.
    """
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    safe = clean.select("conv_id", F.struct("turn", "role", "text", (F.col("role") == "assistant").alias("reply"), _block(escape(F.col("role")), escape(F.col("text"))).alias("block"), F.length(escape(F.col("text"))).alias("n")).alias("t"))
    whole = safe.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    whole = whole.select("conv_id", F.col("t.reply").alias("reply"), F.col("t.block").alias("block"), F.col("t.n").alias("n"))
    places = F.expr("filter(sequence(0, size(reply) - 1), i -> reply[i] or i = size(reply) - 1)")
    rows = whole.select("conv_id", "reply", "block", "n", F.explode(places).alias("at"))
    hit = F.expr("reply[at]")
    text = F.concat(F.lit("<s>"), F.array_join(F.slice("block", 1, F.col("at") + 1), ""))
    return rows.select(
        "conv_id",
        F.when(hit, F.col("at")).alias("target"),
        text.alias("text"),
        F.when(hit, F.length(text) - F.expr("n[at]") - len(" </s>")).otherwise(0).cast("long").alias("loss_start"),
        F.when(hit, F.expr("n[at]")).otherwise(0).cast("long").alias("loss_length"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss array<string>, formatted_chars) from the examples' texts and masks alone."""
    span = unescape(F.col("text").substr(F.col("loss_start").cast("int") + 1, F.col("loss_length").cast("int")))
    own = formatted.select("conv_id", F.when(F.col("target").isNotNull(), F.struct("target", span.alias("reply"))).alias("reply"), F.length("text").cast("long").alias("chars"), "text")
    whole = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("reply")).alias("reply"), F.sum("chars").alias("formatted_chars"), F.max_by("text", "chars").alias("text"))
    blocks = F.regexp_extract_all("text", F.lit(_TURNS), 0)
    return whole.select("conv_id", F.transform(blocks, _turn).alias("turns"), F.col("reply.reply").alias("loss"), "formatted_chars")


def _turn(block: Column) -> Column:
    def between(start: str, end: str) -> Column:
        return unescape(block.substr(F.lit(len(start) + 1), F.length(block) - len(start) - len(end)))

    other = F.instr(block, " [AS] ")
    return (
        F.when(block.startswith("[INST]"), F.struct(F.lit("user").alias("role"), between("[INST] ", " [/INST]").alias("text")))
        .when(block.startswith("[SYS]"), F.struct(F.lit("system").alias("role"), between("[SYS] ", " [/SYS]").alias("text")))
        .when(block.startswith("[OUT]"), F.struct(F.lit("assistant").alias("role"), between("[OUT] ", " </s>").alias("text")))
        .otherwise(F.struct(unescape(block.substr(F.lit(8), other - 8)).alias("role"), unescape(block.substr(other + 6, F.length(block) - other - 5 - len(" [/TURN]"))).alias("text")))
    )


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from ``examples``' output."""
    back = read_back(formatted)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
