"""Preference formatting of chosen and rejected conversations; DataFrame operations only.

The longest common prefix of turns (role and text) is rendered once as the prompt; what follows on either side is its completion,
with the character spans that a trainer should learn from: the assistant's texts with their end marks. Marks within roles and texts
are escaped, so a rendered text tells its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered: start mark, role, newline, text, end mark.
START, END = "<|turn|>", "<|end|>\n"
TURNS = "array<struct<role:string,text:string>>"
RESULT = ("prompt_turns", "prompt", "chosen_text", "chosen_spans", "rejected_text", "rejected_spans")


def conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id_col, turns): each conversation's turns in order; null turn numbers first, ties by role and text, repeated rows kept.

    Each row with a null id is a conversation of one turn. Null roles and texts are empty. Other columns are left out. An empty table gives no rows.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    held = rows.select(F.col(id_col).alias("id"), turn.alias("t"))
    known = held.where("id IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    found = known.union(held.where("id IS NULL").select("id", F.array("t")))
    return found.select(F.col("id").alias(id_col), F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def _escaped(turns: Column) -> Column:
    """Turns in which no role or text holds a mark: a backslash more stands within each ``<|``, ``<\\|`` and so on."""
    safe = lambda x: F.regexp_replace(x, r"<(\\*)\|", r"<\\$1|")
    return F.transform(turns, lambda x: F.struct(safe(x["role"]).alias("role"), safe(x["text"]).alias("text")))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit(START), x["role"], F.lit("\n"), x["text"], F.lit(END))), "")


def _spans(turns: Column) -> Column:
    """[start, end) of the assistant's texts with end marks within the rendered turns."""
    size = lambda x: F.length(x["role"]) + F.length(x["text"]) + len(START) + 1 + len(END)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + size(x)
        span = F.struct((end - F.length(x["text"]) - len(END)).alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["role"] == "assistant", F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, empty, step)["spans"]


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs with prompt_turns, prompt, chosen_text, chosen_spans, rejected_text, rejected_spans instead of the two arrays of turns.

    Null arrays count as empty, so nothing is common then; empty ones have an empty prompt. Equal conversations give empty completions.
    Repeated pairs stay. Texts may have any length. Other columns are kept; one with a name of the result raises ValueError. An empty table
    gives no rows.
    """
    rest = [c for c in pairs.columns if c not in (chosen, rejected)]
    if {c.lower() for c in rest} & set(RESULT):
        raise ValueError("pairs hold a column with a name of the result")
    a, b = (F.coalesce(F.col(c).cast(TURNS), F.array().cast(TURNS)) for c in (chosen, rejected))
    held = pairs.select(F.struct(*rest).alias("_rest") if rest else F.lit(None).alias("_rest"), a.alias("_a"), b.alias("_b"))
    least = F.least(F.size("_a"), F.size("_b"))
    equal = F.zip_with(F.slice("_a", F.lit(1), least), F.slice("_b", F.lit(1), least), lambda x, y: x == y)
    split = F.array_position(equal, False).cast("int")
    held = held.select("_rest", F.when(split == 0, least).otherwise(split - 1).alias("_n"), _escaped(F.col("_a")).alias("_a"), _escaped(F.col("_b")).alias("_b"))
    tail = lambda c: F.slice(c, F.col("_n") + 1, F.greatest(F.size(c) - F.col("_n"), F.lit(0)))
    return held.select(
        *[F.col("_rest")[c].alias(c) for c in rest],
        F.col("_n").alias("prompt_turns"),
        _render(F.slice("_a", F.lit(1), F.col("_n"))).alias("prompt"),
        _render(tail("_a")).alias("chosen_text"),
        _spans(tail("_a")).alias("chosen_spans"),
        _render(tail("_b")).alias("rejected_text"),
        _spans(tail("_b")).alias("rejected_spans"),
    )


def contrast_pairs(convs: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id_col, chosen, rejected) of each conversation (id_col, turns): chosen is the conversation; rejected has another answer in place of one.

    Of n assistant turns the one numbered id modulo n (from 0) is answered by the turn of that number, modulo their count, of the conversation
    whose id differs in the lowest bit; where that has none or doesn't exist, rejected leaves the turn out. So the common prefix ends
    anywhere in a conversation. Without an assistant turn both are the same. A null id counts as 0 and has no other conversation.
    """
    answers = F.filter("turns", lambda t: t["role"] == "assistant")
    numbered = convs.select(id_col, "turns", answers.alias("_answers"))
    number = F.when(F.size("_answers") > 0, F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.size("_answers")).cast("int"))
    other = numbered.select(F.col(id_col).bitwiseXOR(F.lit(1).cast("long")).alias(id_col), F.col("_answers").alias("_other"))
    pairs = numbered.withColumn("_k", number).join(other, id_col, "left")
    # the place of the answer numbered k among all turns
    places = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())
    at = F.get(places, F.col("_k"))
    mine = F.when(F.size("_other") > 0, F.array(F.get("_other", F.pmod(F.col("_k"), F.size("_other"))))).otherwise(F.array().cast(TURNS))
    swapped = F.concat(F.slice("turns", F.lit(1), at), mine, F.slice("turns", at + 2, F.greatest(F.size("turns") - at - 1, F.lit(0))))
    return pairs.select(id_col, F.col("turns").alias("chosen"), F.when(F.col("_k").isNull(), F.col("turns")).otherwise(swapped).alias("rejected"))
