"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only its
text trainable. Turns after the last assistant turn (or all, where there is none) go into one more
example without a trainable part, so that the output holds every turn.

The template writes a turn as <|im_start|>ROLE newline TEXT<|im_end|> newline. Inside texts and
roles, "<", any number of backslashes and "|" get one backslash more, so that no control string
can come from a text, and taking one away gives the text back. A line feed in a role is written
<|nl|>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def format_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trainable: str = "assistant") -> DataFrame:
    """Examples (conv_id, example, formatted, loss_start, loss_end, last) of all conversations.

    example counts from 0 in each conversation; formatted[loss_start:loss_end], in code points, is the
    trainable text, and both are null in an example without one; last marks the example that holds all
    turns. Rows are ordered by turn (null first), ties by role and text; repeated rows are turns of
    their own; null roles and texts are empty, and rows of null conv_id are one conversation. Columns
    beside the four are dropped. The examples of a conversation of n turns hold O(n * n) text: that is
    the method. A conversation is put together in one row, as its examples have to be.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    head = F.concat(F.lit(START), F.replace(escaped(role), F.lit("\n"), F.lit(LINE)), F.lit("\n"))
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), head.alias("head"), escaped(text).alias("body"))
    convs = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    convs = convs.withColumn("parts", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(f"{END}\n"))))
    # the places of trainable turns, and the place after the last turn where turns follow the last of these
    ends = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == trainable, i)), lambda i: i.isNotNull())
    convs = convs.withColumn("ends", ends).withColumn("n", F.size("turns"))
    tail = F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(-1)) < F.col("n") - 1
    convs = convs.withColumn("ends", F.concat("ends", F.when(tail, F.array("n")).otherwise(F.array().cast("array<int>"))))
    rows = convs.select("conv_id", "turns", "parts", "n", F.size("ends").alias("n_examples"), F.posexplode("ends").alias("example", "at"))
    before = F.array_join(F.slice("parts", F.lit(1), F.col("at")), "")
    rows = rows.withColumn("before", before).withColumn("own", F.get("turns", F.col("at")))
    start = F.length("before") + F.length(F.col("own.head"))
    return rows.select(
        "conv_id", "example", F.concat("before", F.coalesce(F.get("parts", F.col("at")), F.lit(""))).alias("formatted"),
        start.alias("loss_start"), (start + F.length(F.col("own.body"))).alias("loss_end"),
        (F.col("example") == F.col("n_examples") - 1).alias("last"),
    )


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 2_000_000_000)

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.instr(piece, "\n") + 1)
        body = F.substr(body, F.lit(1), F.length(body) - len(END) - 1)
        return F.struct(unescaped(F.replace(F.substring_index(piece, "\n", 1), F.lit(LINE), F.lit("\n"))).alias("role"), unescaped(body).alias("text"))

    return F.transform(pieces, turn)


def digests(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation say, read back from them."""
    loss = F.substr("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    read = examples.select(
        "conv_id", "example", unescaped(loss).alias("loss"), F.length("formatted").alias("chars"),
        F.when(F.col("last"), parsed(F.col("formatted"))).alias("turns"),
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    by_conv = read.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("example", F.coalesce("loss", F.lit("")).alias("loss")))).alias("losses"),
        F.sum("chars").alias("formatted_chars"), F.first("turns", ignorenulls=True).alias("turns"),
    )
    by_conv = by_conv.withColumn("loss", F.array_join(F.transform("losses", lambda x: x["loss"]), ""))
    return by_conv.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
