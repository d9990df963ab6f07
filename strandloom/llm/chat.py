"""Preference formatting, in DataFrame functions alone.

A chosen and a rejected conversation are compared turn by turn (role and text; a null equals a null);
their longest common prefix of turns is rendered once as the prompt, and what follows in either is its
completion, with a mask of runs `bit x characters`: 1 for an assistant's text and end mark, 0 for role
marks and other speakers. All of the prompt is masked.

op9 makes one pair of each conversation: the chosen one is the conversation, the rejected one has its
last assistant turn's text replaced by the last assistant text of its neighbour, whose id differs in
the lowest bit. Without a neighbour's or an own assistant turn there is nothing to reject: prompt,
rejected and masks are null, and chosen holds the whole conversation. If both texts are equal, all is
prompt and the completions are empty.

Turns are ordered by turn (null last), then role and text; repeated rows are repeated turns. Null
roles and texts render as empty. Rows of null conv_id are one conversation without a neighbour. Empty
tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LEARNED_ROLE = "assistant"
_LAST = 9223372036854775807


def gather(turns: DataFrame, key: str) -> DataFrame:
    """(key, turns): each conversation's turns in order."""
    turn = F.struct(F.coalesce("turn", F.lit(_LAST)).cast("long").alias("t"), F.col("role").alias("r"), F.col("text").alias("x"))
    return turns.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    same = F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull() & x["r"].eqNullSafe(y["r"]) & x["x"].eqNullSafe(y["x"]))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(t["r"], F.lit("")), F.lit("|>\n"))


def _body(t: Column) -> Column:
    return F.concat(F.coalesce(t["x"], F.lit("")), F.lit("<|end|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def mask(turns: Column) -> Column:
    bit = lambda t: F.when(t["r"] == LEARNED_ROLE, F.lit("1x")).otherwise(F.lit("0x"))
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("0x"), F.length(_head(t)), F.lit(" "), bit(t), F.length(_body(t)))), " ")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pairs(.., chosen_turns, rejected_turns) with n_prompt_turns, prompt, chosen, rejected and both masks; all null but chosen if there is no rejected."""
    pairs = pairs.withColumn("n_prompt_turns", F.when(F.col("rejected_turns").isNotNull(), common_turns(F.col("chosen_turns"), F.col("rejected_turns"))))
    n = F.coalesce("n_prompt_turns", F.lit(0))
    rest = lambda c: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    some = F.col("n_prompt_turns").isNotNull()
    return pairs.select(
        *[c for c in pairs.columns if c not in ("chosen_turns", "rejected_turns", "n_prompt_turns")],
        "n_prompt_turns",
        F.when(some, render(F.slice("chosen_turns", F.lit(1), n))).alias("prompt"),
        render(rest(F.col("chosen_turns"))).alias("chosen"),
        F.when(some, render(rest(F.col("rejected_turns")))).alias("rejected"),
        F.when(some, mask(rest(F.col("chosen_turns")))).alias("chosen_mask"),
        F.when(some, mask(rest(F.col("rejected_turns")))).alias("rejected_mask"),
    )


def swapped_replies(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) to (conv_id, chosen_turns, rejected_turns), as op9 pairs them."""
    whole = gather(turns.select("conv_id", "turn", "role", "text"), "conv_id")
    # the neighbour's last assistant turn, found by an aggregate: its other turns aren't moved again
    order = F.struct(F.coalesce("turn", F.lit(_LAST)).cast("long"), "text")
    reply = turns.where((F.col("role") == LEARNED_ROLE) & F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.max(F.struct(order.alias("o"), "text")).alias("m"))
    reply = reply.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("n"), F.struct(F.col("m.text").alias("x")).alias("reply"))
    both = whole.join(reply, F.col("conv_id") == F.col("n"), "left").drop("n")
    flags = F.transform("turns", lambda t: F.coalesce(t["r"] == LEARNED_ROLE, F.lit(False)))
    last = F.when(F.array_contains(flags, True), F.size("turns") - F.array_position(F.reverse(flags), True)).cast("int")  # from 0
    rejected = F.transform("turns", lambda t, i: F.struct(t["t"].alias("t"), t["r"].alias("r"), F.when(i == F.col("last"), F.col("reply.x")).otherwise(t["x"]).alias("x")))
    both = both.withColumn("last", last)
    return both.select("conv_id", F.col("turns").alias("chosen_turns"), F.when(F.col("last").isNotNull() & F.col("reply").isNotNull(), rejected).alias("rejected_turns"))


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_preferences(swapped_replies(table(spark, sf_dir, "conversations")))


ORACLE_SQL = """
WITH g AS (SELECT conv_id, list({'r': role, 'x': text} ORDER BY coalesce(turn, 9223372036854775807), role NULLS FIRST, text NULLS FIRST) AS ts FROM conversations GROUP BY conv_id),
l AS (SELECT *, list_max(list_filter(range(1, len(ts) + 1), lambda i: ts[i].r = 'assistant')) AS k FROM g),
p AS (SELECT a.conv_id, a.ts, a.k, b.ts[b.k].x AS reply, a.k IS NOT NULL AND b.k IS NOT NULL AS paired FROM l a LEFT JOIN l b ON b.conv_id = xor(a.conv_id, 1)),
q AS (SELECT *, list_transform(range(1, len(ts) + 1), lambda i: {'r': ts[i].r, 'x': CASE WHEN i = k THEN reply ELSE ts[i].x END}) AS rs FROM p),
m AS (SELECT *, CASE WHEN paired THEN coalesce(list_min(list_filter(range(1, len(ts) + 1), lambda i: ts[i].x IS DISTINCT FROM rs[i].x)) - 1, len(ts)) END AS n FROM q),
c AS (SELECT conv_id, paired, n, ts[1:coalesce(n, 0)] AS pt, ts[coalesce(n, 0) + 1:] AS ct, rs[coalesce(n, 0) + 1:] AS rt FROM m)
SELECT conv_id, CAST(n AS INTEGER) AS n_prompt_turns,
  CASE WHEN paired THEN coalesce(array_to_string(list_transform(pt, lambda t: '<|' || coalesce(t.r, '') || '|>' || chr(10) || coalesce(t.x, '') || '<|end|>' || chr(10)), ''), '') END AS prompt,
  coalesce(array_to_string(list_transform(ct, lambda t: '<|' || coalesce(t.r, '') || '|>' || chr(10) || coalesce(t.x, '') || '<|end|>' || chr(10)), ''), '') AS chosen,
  CASE WHEN paired THEN coalesce(array_to_string(list_transform(rt, lambda t: '<|' || coalesce(t.r, '') || '|>' || chr(10) || coalesce(t.x, '') || '<|end|>' || chr(10)), ''), '') END AS rejected,
  CASE WHEN paired THEN coalesce(array_to_string(list_transform(ct, lambda t: '0x' || (5 + length(coalesce(t.r, ''))) || ' ' || CASE WHEN t.r = 'assistant' THEN '1x' ELSE '0x' END || (8 + length(coalesce(t.x, '')))), ' '), '') END AS chosen_mask,
  CASE WHEN paired THEN coalesce(array_to_string(list_transform(rt, lambda t: '0x' || (5 + length(coalesce(t.r, ''))) || ' ' || CASE WHEN t.r = 'assistant' THEN '1x' ELSE '0x' END || (8 + length(coalesce(t.x, '')))), ' '), '') END AS rejected_mask
FROM c
"""
