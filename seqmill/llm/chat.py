"""Chat formatting by prefix-target expansion, with DataFrame functions alone.

Each assistant turn becomes an example: all turns before it as context, then that reply,
which alone is trainable. A conversation that does not end with an assistant turn gets one
more example, with nothing trainable, so that every turn is found in the output.

Template: `<|im_start|>` role, newline, text, `<|im_end|>`, newline. Inside texts and roles a
backslash is put after the < of every `<|`, `<\\|`, `<\\\\|` and so on, and taken out again when
read; % and newlines in roles become %25 and %0A.

Cases: a null text or role is empty; rows without a conv_id form one conversation; turns are
in ascending order (null first), ties by role, then text, and repeated rows are turns of
their own; an empty table gives an empty result; other columns are ignored. A conversation is one
group and its longest example one string, so one of more than about 2 GB of text, Spark's bound of a
value, is an error; the examples of n assistant turns are n prefixes, which is what the method makes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>"
TRAINABLE = "assistant"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def _escaped_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _read_role(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def expand(conversations: DataFrame) -> DataFrame:
    """conv_id, example, formatted, loss_start, loss_length, ends: one row for each example.

    loss_start (from 0) and loss_length are code points of formatted; ends is true for the
    conversation's last example, which holds all its turns. Where each turn ends is a running
    sum over rows; the examples of a conversation are prefixes of one transcript.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    head, body = F.concat(F.lit(START), _escaped_role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    laid = turns.withColumn("head", head).withColumn("body", body).withColumn("segment", F.concat("head", "body", F.lit(END + "\n")))
    laid = laid.withColumn("at", F.row_number().over(order)).withColumn("stop", F.sum(F.length("segment")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("at", "segment", "stop", F.length("head").alias("head"), F.length("body").alias("body"), (F.col("role") == TRAINABLE).alias("trainable"))))
    whole = laid.groupBy("conv_id").agg(parts.alias("parts"))
    n = F.size("parts")
    wanted = F.filter("parts", lambda p: p["trainable"] | (p["at"] == F.size("parts")))
    whole = whole.select("conv_id", F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("transcript"), n.alias("n"), F.transform(wanted, lambda p: F.struct(p["at"].alias("at"), p["stop"].alias("stop"), (p["stop"] - p["body"] - len(END) - 1).alias("from"), p["body"].alias("body"), p["trainable"].alias("trainable"))).alias("wanted"))
    rows = whole.select("conv_id", "transcript", "n", F.posexplode("wanted").alias("example", "w"))
    return rows.select(
        "conv_id",
        "example",
        F.substring("transcript", F.lit(1), F.col("w.stop").cast("int")).alias("formatted"),
        F.col("w.from").alias("loss_start"),
        F.when(F.col("w.trainable"), F.col("w.body").cast("long")).otherwise(F.lit(0).cast("long")).alias("loss_length"),
        (F.col("w.at") == F.col("n")).alias("ends"),
    )


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted text, read back: an array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda _, i: i > 0)

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        size = F.length(role)
        return F.struct(_read_role(role).alias("role"), unescape(F.substring(p, size + 2, F.length(p) - size - len(END) - 2)).alias("text"))

    return F.transform(pieces, turn)


def trained_text(formatted: Column, loss_start: Column, loss_length: Column) -> Column:
    """The text under the loss mask of an example, unescaped."""
    return unescape(F.substring(formatted, (loss_start + 1).cast("int"), loss_length.cast("int")))


def read_back(examples: DataFrame) -> DataFrame:
    """What each conversation's examples hold: turns, trained text and formatted length."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("example", "trained"))), lambda x: x["trained"])
    rows = examples.select("conv_id", "example", trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("trained"), F.when(F.col("ends"), F.col("formatted")).alias("whole"), F.length("formatted").alias("size"))
    per = rows.groupBy("conv_id").agg(F.array_join(texts, "").alias("trained"), F.collect_list("whole")[0].alias("whole"), F.sum("size").alias("formatted_chars"))
    return per.select("conv_id", parse_turns(F.col("whole")).alias("turns"), "trained", "formatted_chars")
