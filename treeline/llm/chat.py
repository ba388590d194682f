"""Chat formatting by prefix-target expansion, in DataFrame functions only.

``expand_chat`` turns every assistant turn into one example: all preceding turns as context, the
reply as the only trainable text.  Template, for each turn in order::

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Control strings inside texts are escaped reversibly: in every ``<``, backslashes, ``|`` the run of
backslashes grows by one, so ``<|`` itself never occurs inside a text; unescaping takes one away.
Roles are URL-encoded (plain words stay as they are).  A conversation that doesn't end with an
assistant turn also gets one example without a target, so that no turn is lost.

Null text counts as empty, null role as the empty role.  Turns are ordered by turn (nulls first);
ties and repeated rows are all kept, ordered by role, then text.  An empty table gives no examples.
Extra columns are not read.  All turns of one conversation meet in one row: its examples hold its
whole text, which is the size of the output itself; conversations are dealt by their id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(col: Column) -> Column:
    return F.regexp_replace(col, r"<(\\*)\|", r"<\\$1|")


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, r"<\\(\\*)\|", r"<$1|")


def _turn(x: Column) -> Column:
    return F.concat(F.lit(START), F.url_encode(x["role"]), F.lit("\n"), escape(x["text"]), F.lit(f"{END}\n"))


def conversations(df: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and its turns in order, as array of (role, text)."""
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return df.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def expand_chat(df: DataFrame) -> DataFrame:
    """Rows (conv_id, example, n_turns, formatted, loss_start, loss_length): one per assistant turn,
    and one with loss_length null for what follows the last of them.

    loss_start and loss_length count code points of ``formatted``; loss_start is from 0."""
    formed = conversations(df).select(
        "conv_id",
        F.transform(
            "turns",
            lambda x: F.struct(_turn(x).alias("out"), (x["role"] == "assistant").alias("target"), F.length(escape(x["text"])).alias("n")),
        ).alias("t"),
    )
    last = F.size("t") - 1
    examples = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("t", i)["target"] | (i == last))
    each = formed.select("conv_id", "t", F.posexplode(examples).alias("example", "at"))
    target = F.get("t", F.col("at"))
    text = F.array_join(F.transform(F.slice("t", 1, F.col("at") + 1), lambda x: x["out"]), "")
    return each.select(
        "conv_id",
        F.col("example").cast("bigint").alias("example"),
        (F.col("at") + 1).cast("bigint").alias("n_turns"),
        text.alias("formatted"),
        target["target"].alias("_target"),
        target["n"].cast("bigint").alias("_n"),
    ).select(
        "conv_id",
        "example",
        "n_turns",
        "formatted",
        F.when(F.col("_target"), F.length("formatted") - F.col("_n") - len(END) - 1).cast("bigint").alias("loss_start"),
        F.when(F.col("_target"), F.col("_n")).alias("loss_length"),
    )


def loss_text(formatted: Column, start: Column, length: Column) -> Column:
    """The trainable text of an example, unescaped; empty where it has none."""
    return F.coalesce(unescape(F.substring(formatted, start.cast("int") + 1, length.cast("int"))), F.lit(""))


def read_turns(formatted: Column) -> Column:
    """The turns of an example, read back: array of (role, text)."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        head = F.instr(p, "\n")
        body = F.substring(p, head + 1, F.length(p) - head - len(END) - 1)
        return F.struct(F.url_decode(F.substring(p, F.lit(1), head - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)
