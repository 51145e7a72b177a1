r"""Chat formatting into budgeted windows (DataFrame only).

A turn is written ``<|turn|>role<|text|>text<|end|>``.  Inside role and text a
backslash is doubled, and every control string (the template's and those of
other common templates) gets a backslash after its first character, so none is
left; dropping each backslash, or the first of two, gives the text back.

Windows are turn-aligned.  Prefix sums of the turns' tokens (an estimate of
``chars_per_token``) are cut at multiples of half of what the budget leaves
beside the system turn and the history; a turn longer than such a cell is a
span of its own.  A span so has at most the budget's tokens, or is one long
turn (``over_budget``).  Every window of a conversation begins with its system
turn, if its first turn is one, then repeats up to ``history`` turns from
before its span, within ``history_tokens``.  The loss mask, spans of code
points of the formatted text, covers the texts of assistant turns of the span
itself; those repeated are masked out.

Rows are ordered by turn, then role and text.  Nulls: a null text or role is
empty; null turns come first; a null id is a conversation.  Repeated rows are
turns each.  A conversation always has a window; an empty table gives none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of the template and of common others.
CONTROL = (TURN, TEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|begin_of_text|>", "<|end_of_text|>",
           "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def control_regex() -> str:
    rest = "|".join(c[1:].replace("|", r"\|").replace("[", r"\[").replace("]", r"\]") for c in CONTROL)
    return rf"([<\[])(?=(?:{rest}))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), control_regex(), r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def windows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            budget: int = 2048, system_tokens: int = 256, history: int = 2, history_tokens: int = 256,
            chars_per_token: int = 4, target: str = "assistant") -> DataFrame:
    """(conv, window, formatted, loss, context, tokens, over_budget): loss is
    an array of (start, length) in code points from 0, context the number of
    leading turns that are repeated from earlier windows."""
    cell = (budget - system_tokens - history_tokens) // 2
    t = turns.select(F.col(conv).alias("c"), F.col(turn).alias("o"), F.coalesce(role, F.lit("")).alias("r"),
                     F.coalesce(text, F.lit("")).alias("x"))
    head = F.concat(F.lit(TURN), escape(F.col("r")), F.lit(TEXT))
    body = escape(F.col("x"))
    t = t.select("c", "o", "r", "x", head.alias("head"), body.alias("body"))
    w = Window.partitionBy("c").orderBy(F.col("o").asc_nulls_first(), "r", "x")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("i", F.row_number().over(w))
    t = t.withColumn("sys", (F.col("i") == 1) & (F.col("r") == "system"))
    t = t.withColumn("n", F.ceil((F.length("head") + F.length("body") + len(END)) / chars_per_token))
    counted = F.when(F.col("sys"), 0).otherwise(F.col("n"))
    t = t.withColumn("p", F.sum(counted).over(upto) - counted)
    t = t.withColumn("big", ~F.col("sys") & (F.col("n") > cell)).withColumn("cell", F.floor(F.col("p") / cell))
    # a span begins with the first turn after the system turn, at a new cell, and around long turns
    before = F.lag("sys").over(w)
    begins = F.when(F.col("sys"), F.lit(0)).when(before.isNull() | before, F.lit(1)).otherwise(
        (F.col("big") | F.lag("big").over(w) | (F.col("cell") != F.lag("cell").over(w))).cast("int"))
    t = t.withColumn("begins", begins)
    t = t.withColumn("span", F.greatest(F.sum("begins").over(upto), F.lit(1)))
    # the window where this turn is new; those whose history it is; of a system turn, all
    later = [F.when((F.lead("begins", j).over(w) == 1) & ~F.col("sys")
                    & (F.lead("p", j).over(w) - F.col("p") <= history_tokens), F.lead("span", j).over(w))
             for j in range(1, history + 1)]
    spans = F.max("span").over(Window.partitionBy("c"))
    placed = (t.withColumn("spans", spans)
              .withColumn("at", F.when(F.col("sys"), F.sequence(F.lit(1).cast("long"), F.col("spans")))
                          .otherwise(F.array_compact(F.array(F.col("span"), *later))))
              .withColumn("window", F.explode("at"))
              .withColumn("again", F.col("window") != F.col("span"))
              .select("c", "window", "i", "again", "n", "head", "body", (F.col("r") == target).alias("goal"), "big"))
    piece = F.concat("head", "body", F.lit(END))
    inside = Window.partitionBy("c", "window").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("begin", F.sum(F.length(piece)).over(inside) - F.length(piece) + F.length("head"))
    got = placed.groupBy("c", "window").agg(
        F.sort_array(F.collect_list(F.struct("i", piece.alias("s")))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(F.col("goal") & ~F.col("again"), F.struct(
            F.col("begin").cast("int").alias("start"), F.length("body").alias("length"))))).alias("loss"),
        F.sum(F.col("again").cast("int")).alias("context"), F.sum("n").alias("tokens"))
    return got.select(F.col("c").alias(conv), "window", F.array_join(F.transform("pieces", lambda s: s["s"]), "").alias("formatted"),
                      "loss", F.col("context").cast("int").alias("context"), "tokens", (F.col("tokens") > budget).alias("over_budget"))


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, n_turns, turns, loss_text, formatted_chars) of windows: all turns
    as ``role \\n text \\n``, and the text under the loss mask, in order, each
    from the formatted text alone, its mask and number of repeated turns.  The
    system turn stands first in each window, so the repeated ones lead."""
    pieces = F.split("formatted", r"<\|end\|>")
    new = F.slice(pieces, F.col("context") + 1, F.size(pieces) - 1 - F.col("context"))

    def turn(piece: Column) -> Column:
        halves = F.split(F.substring(piece, len(TURN) + 1, 2**31 - 1), r"<\|text\|>")
        return F.concat(unescape(halves[0]), F.lit("\n"), unescape(halves[1]), F.lit("\n"))

    one = formatted.select(
        F.col(conv).alias("c"), "window", F.size(new).alias("n"), F.array_join(F.transform(new, turn), "").alias("turns"),
        F.array_join(F.transform("loss", lambda m: unescape(F.substr(F.col("formatted"), m["start"] + 1, m["length"]))), "").alias("goal"),
        F.length("formatted").alias("chars"))
    both = one.groupBy("c").agg(F.sum("n").cast("long").alias("n_turns"),
                                F.sort_array(F.collect_list(F.struct("window", "turns", "goal"))).alias("w"),
                                F.sum("chars").cast("long").alias("formatted_chars"))
    return both.select(F.col("c").alias(conv), "n_turns", F.array_join(F.transform("w", lambda x: x["turns"]), "").alias("turns"),
                       F.array_join(F.transform("w", lambda x: x["goal"]), "").alias("loss_text"), "formatted_chars")
