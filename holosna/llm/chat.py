"""Chat formatting into budgeted windows. DataFrame functions only.

Prefix sums of turn tokens place every turn: the token line of a conversation is cut at multiples of its body budget,
turns inside one piece share a window, and a turn that crosses a cut has a window of its own. So a window's own turns
keep to the budget unless one turn alone exceeds it. Each window begins with the conversation's system turn and, after
that, up to ``history_turns`` turns of the history that fit ``history_tokens``. These repeats are context: the loss
mask covers an assistant text only where it stands for the first time.

A turn reads ``<|role|>text<|end|>``. Inside roles and texts a backslash is doubled, ``<|`` becomes ``<\\|`` and ``|>``
becomes ``|\\>``, so that no text can look like a mark; unescaped() takes that back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY_TOKENS, HISTORY_TURNS, LEAST_BODY, TURN_TOKENS = 512, 128, 2, 64, 4
_END = "<|end|>"


def tokens_of(text: Column) -> Column:
    """Estimated tokens of a turn: a quarter of its UTF-8 bytes, rounded up, and the marks around it."""
    return F.floor((F.octet_length(text) + 3) / 4) + TURN_TOKENS


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("|\\>"), F.lit("|>")), F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _piece(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>"), turn["text"], F.lit(_END))


def windows(turns: DataFrame, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS, tokens=tokens_of) -> DataFrame:
    """conv_id, window, n_context, n_turns, n_tokens, formatted, loss (array of start and length in code points).

    turns: conv_id, turn, role, text; null role or text: empty; ties of turn are ordered by role, then text; repeated
    rows are turns of their own; null conv_id: one conversation. Other columns are ignored. No turns: no rows.
    The turns of a conversation pass one sort that spills; only windows, whose turns the budget bounds, are gathered.
    """
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("cost", tokens(F.col("text")).cast("long")).withColumn("rn", F.row_number().over(own))
    t = t.withColumn("is_system", (F.col("rn") == 1) & (F.col("role") == "system"))
    t = t.select("conv_id", "turn", "rn", "is_system", "cost", "role", "text", F.struct(F.col("rn"), escaped(F.col("role")).alias("role"), escaped(F.col("text")).alias("text"), "cost", "is_system").alias("it"))
    body_cost = F.when(F.col("is_system"), F.lit(0)).otherwise(F.col("cost"))
    t = t.withColumn("upto", F.sum(body_cost).over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("upto") - body_cost)
    t = t.withColumn("system", F.first(F.when(F.col("is_system"), F.col("it"))).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.greatest(F.lit(budget - history_tokens) - F.coalesce(F.col("system.cost"), F.lit(0)), F.lit(LEAST_BODY))
    piece = F.floor(F.col("before") / body)
    t = t.withColumn("window", F.when(F.col("is_system"), F.lit(None)).otherwise(2 * piece + F.when(F.floor((F.col("upto") - 1) / body) > piece, 1).otherwise(0)).cast("long"))
    t = t.withColumn("window", F.coalesce("window", F.lead("window").over(own), F.lit(0).cast("long")))
    past = F.collect_list(F.struct("before", "it")).over(own.rowsBetween(-history_turns, -1)) if history_turns else F.array()
    begins = F.coalesce(F.lag("window").over(own) != F.col("window"), F.lit(True))
    t = t.withColumn("begins", begins).withColumn("past", past)
    recent = F.transform(F.filter("past", lambda p: ~p["it"]["is_system"] & (F.col("before") - p["before"] <= history_tokens)), lambda p: p["it"]) if history_turns else F.array().cast(f"array<{t.schema['it'].dataType.simpleString()}>")
    context = F.when(F.col("is_system"), F.slice(recent, 1, 0)).when(F.col("system").isNull(), recent).otherwise(F.concat(F.array("system"), recent))
    t = t.withColumn("context", F.when(F.col("begins"), context))
    w = t.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("it")).alias("own"), F.first("context", ignorenulls=True).alias("context"))
    w = w.withColumn("context", F.coalesce("context", F.slice("own", 1, 0)))
    w = w.withColumn("turns", F.concat("context", "own")).withColumn("n_context", F.size("context"))
    at = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"), F.lit(0).alias("i"))

    def step(acc: Column, turn: Column, n_context: Column) -> Column:
        head = 4 + F.length(turn["role"])
        target = (acc["i"] >= n_context) & (turn["role"] == "assistant")
        span = F.struct((acc["at"] + head).alias("start"), F.length(turn["text"]).alias("length"))
        return F.struct((acc["at"] + head + F.length(turn["text"]) + len(_END)).alias("at"), F.when(target, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"), (acc["i"] + 1).alias("i"))

    return w.select(
        "conv_id",
        "window",
        "n_context",
        F.size("turns").alias("n_turns"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda s, x: s + x["cost"]).alias("n_tokens"),
        F.array_join(F.transform("turns", _piece), "").alias("formatted"),
        F.aggregate("turns", at, lambda a, x: step(a, x, F.col("n_context")), lambda a: a["spans"]).alias("loss"),
    )


def own_turns(formatted: Column, n_context: Column) -> Column:
    """Role and text of a window's own turns, read back from its text."""
    pieces = F.split(formatted, r"<\|end\|>", -1)

    def read(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(3), F.length(piece))  # behind the opening <|
        mark = F.instr(inner, F.lit("|>"))
        return F.struct(unescaped(F.substring(inner, F.lit(1), mark - 1)).alias("role"), unescaped(F.substring(inner, mark + 2, F.length(inner))).alias("text"))

    return F.transform(F.slice(pieces, n_context + 1, F.size(pieces) - 1 - n_context), read)


def loss_text(formatted: Column, loss: Column) -> Column:
    """What the mask covers, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    read = formatted.select("conv_id", "window", own_turns(F.col("formatted"), F.col("n_context")).alias("own"), loss_text(F.col("formatted"), F.col("loss")).alias("loss"), F.length("formatted").alias("chars"))
    whole = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "own", "loss"))).alias("w"), F.sum("chars").cast("long").alias("formatted_chars"))
    turns = F.flatten(F.transform("w", lambda x: x["own"]))
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return whole.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length(masked).cast("long").alias("loss_chars"), F.sha2(masked, 256).alias("loss_sha256"), "formatted_chars"
    )
