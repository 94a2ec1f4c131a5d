"""Preference pairs: one shared prompt, two completions with masks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import table

# The template of a turn.
TURN = ("<|", "|>\n", "<|end|>\n")
TRAINED = "assistant"


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): turns in order as (turn, role, text). Null roles and texts count as empty, null numbers come first;
    turns that share a number are ordered by role and text, repeated rows stay. A turn without conv_id is a conversation by itself, so such turns
    are no group, however many there are. Other columns are not read; an empty table gives no rows."""
    alone = F.when(F.col(conv_id).isNull(), F.monotonically_increasing_id())
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = turns.select(F.col(conv_id).alias("conv_id"), alone.alias("alone"), one.alias("one"))
    return rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("one")).alias("turns")).drop("alone")


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN[0]), t["role"], F.lit(TURN[1]), t["text"], F.lit(TURN[2]))), "")


def _length(turns: Column) -> Column:
    return F.aggregate(turns, F.lit(0), lambda n, t: n + F.length(t["role"]) + F.length(t["text"]) + sum(map(len, TURN)))


@F.pandas_udf(ArrayType(LongType()))
def _running(lengths: pd.Series) -> pd.Series:
    """Running sums of every list."""
    return lengths.map(np.cumsum)


def _spans(turns: Column, shift: Column) -> Column:
    """Characters to train on: text and end mark of the assistant's turns. ``shift`` is where the turns start."""
    ends = _running(F.transform(turns, lambda t: (F.length(t["role"]) + F.length(t["text"]) + sum(map(len, TURN))).cast("long")))
    placed = F.zip_with(turns, ends, lambda t, end: F.struct(t["role"].alias("role"), F.length(t["text"]).alias("size"), (shift + end).cast("int").alias("end")))
    own = F.filter(placed, lambda s: s["role"] == TRAINED)
    return F.transform(own, lambda s: F.struct((s["end"] - s["size"] - len(TURN[2])).alias("start"), s["end"].alias("end")))


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Pairs of (conv_id, turns) tables that share a conv_id.

    The longest common prefix of turns (equal role and text, position by position) is rendered once as prompt; what is left of
    each side is its completion, with the spans (start, end) of prompt + completion to train on: text and end mark of
    assistant turns after the prefix, nothing of the prompt. status: ``pair``; ``same`` if both sides are equal, so both
    completions are empty; ``chosen_only`` or ``rejected_only`` if the other side has no such conversation - its turns are then
    an empty list. A null conv_id has no partner. An empty table leaves the other side's rows."""
    c, r = chosen.select("conv_id", F.col("turns").alias("c")), rejected.select("conv_id", F.col("turns").alias("r"))
    both = c.join(r, "conv_id", "full")
    status = F.when(F.col("r").isNull(), "chosen_only").when(F.col("c").isNull(), "rejected_only")
    both = both.withColumn("one_sided", status)
    none = F.array().cast(dict(both.dtypes)["c"])
    both = both.withColumn("c", F.coalesce("c", none)).withColumn("r", F.coalesce("r", none))
    short = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", F.lit(1), short), F.slice("r", F.lit(1), short), lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"]))
    differs = F.array_position(same, False)
    both = both.withColumn("prefix_turns", F.when(differs > 0, differs - 1).otherwise(short).cast("int"))
    rest = lambda side: F.slice(side, F.col("prefix_turns") + 1, F.size(side))
    both = both.select("conv_id", "one_sided", "prefix_turns", F.slice("c", F.lit(1), F.col("prefix_turns")).alias("p"),
                       F.when(F.size("c") > 0, rest("c")).otherwise(none).alias("c"), F.when(F.size("r") > 0, rest("r")).otherwise(none).alias("r"))
    shift = _length(F.col("p"))
    status = F.coalesce("one_sided", F.when((F.size("c") == 0) & (F.size("r") == 0), "same").otherwise("pair"))
    return both.select("conv_id", status.alias("status"), "prefix_turns", _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen"),
                       _render(F.col("r")).alias("rejected"), _spans(F.col("c"), shift).alias("chosen_spans"), _spans(F.col("r"), shift).alias("rejected_spans"))


def swapped_answers(convs: DataFrame) -> DataFrame:
    """Rejected side made of unpaired conversations: up to its last assistant turn the conversation itself, then the last answer of
    the conversation whose id differs in the last bit. Without such an answer the conversation ends before its own;
    without an assistant turn it stays as it is."""
    last = F.size("turns") - F.coalesce(F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), TRAINED), F.lit(0)).cast("int")
    own = convs.select("conv_id", "turns", last.alias("last"))
    answered = own.filter(F.col("last") < F.size("turns")).select(
        (F.col("conv_id").bitwiseXOR(F.lit(1).cast("long"))).alias("conv_id"), F.element_at("turns", F.col("last") + 1)["text"].alias("answer"))
    joined = own.join(answered, "conv_id", "left")
    turn = F.element_at("turns", F.greatest(F.col("last"), F.lit(0)) + 1)
    before = F.slice("turns", F.lit(1), F.col("last"))
    given = F.when(F.col("answer").isNull(), before).otherwise(F.concat(before, F.array(F.struct(turn["turn"].alias("turn"), turn["role"].alias("role"), F.col("answer").alias("text")))))
    return joined.select("conv_id", F.when(F.col("last") < F.size("turns"), given).otherwise(F.col("turns")).alias("turns"))


def op7(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    convs = conversations(turns)
    pairs = preference_pairs(convs, swapped_answers(convs))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return pairs.select("conv_id", "status", "prefix_turns", "prompt", "chosen", "rejected", spans("chosen_spans").alias("chosen_mask"), spans("rejected_spans").alias("rejected_mask"))


OP7_SQL = f"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k,
         count(*) over (partition by conv_id) as n
  from conversations),
cut as (select conv_id, max(k) filter (role = '{TRAINED}') as last from t group by conv_id),
answers as (select xor(t.conv_id, 1) as conv_id, t.text from t join cut on t.conv_id = cut.conv_id and t.k = cut.last),
rejected as (
  select t.conv_id, t.k, t.role, case when t.k = c.last then a.text else t.text end as text
  from t join cut c on t.conv_id = c.conv_id left join answers a on a.conv_id = t.conv_id
  where c.last is null or t.k < c.last or (t.k = c.last and a.text is not null)),
lens as (select conv_id, max(k) as n from t group by conv_id),
rlens as (select conv_id, max(k) as n from rejected group by conv_id),
prefix as (
  select l.conv_id, r.n is null as alone, least(
    coalesce((select min(t.k) - 1 from t join rejected r2 on t.conv_id = r2.conv_id and t.k = r2.k
              where t.conv_id = l.conv_id and (t.role <> r2.role or t.text <> r2.text)), least(l.n, coalesce(r.n, 0)))) as p, l.n as n, coalesce(r.n, 0) as rn
  from lens l left join rlens r on l.conv_id = r.conv_id),
sides as (select conv_id, 'c' as side, k, role, text from t union all select conv_id, 'r', k, role, text from rejected),
laid as (
  select s.*, p.p, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as piece,
         sum(length(role) + length(text) + {sum(map(len, TURN))}) over (partition by s.conv_id, side order by k) as stop
  from sides s join prefix p on s.conv_id = p.conv_id)
select p.conv_id, case when p.alone then 'chosen_only' when p.p = p.n and p.p = p.rn then 'same' else 'pair' end as status, p.p::int as prefix_turns,
  coalesce(string_agg(piece, '' order by k) filter (side = 'c' and k <= p.p), '') as prompt,
  coalesce(string_agg(piece, '' order by k) filter (side = 'c' and k > p.p), '') as chosen,
  coalesce(string_agg(piece, '' order by k) filter (side = 'r' and k > p.p), '') as rejected,
  coalesce(string_agg((stop - length(text) - {len(TURN[2])})::bigint || '-' || stop::bigint, ',' order by k) filter (side = 'c' and k > p.p and role = '{TRAINED}'), '') as chosen_mask,
  coalesce(string_agg((stop - length(text) - {len(TURN[2])})::bigint || '-' || stop::bigint, ',' order by k) filter (side = 'r' and k > p.p and role = '{TRAINED}'), '') as rejected_mask
from laid join prefix p on laid.conv_id = p.conv_id
group by p.conv_id, p.alone, p.p, p.n, p.rn
"""
