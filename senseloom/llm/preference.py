"""Preference pairs: the common turns once as the prompt, then two masked completions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _turns(df: DataFrame, name: str) -> DataFrame:
    turn = "struct(turn, coalesce(role, '') as role, coalesce(text, '') as text)"
    return df.where("pair_id is not null").groupBy("pair_id").agg(F.expr(f"array_sort(collect_list({turn}))").alias(name))


def _render(turns: str) -> str:
    return f"array_join(transform({turns}, t -> concat('<|', t.role, '|>\\n', t.text, '\\n')), '')"


def _mask(turns: str) -> str:
    """start:end in code points of the completion for each text that the loss counts: those of the assistant."""
    step = "(a, t) -> struct(a.at + length(t.role) + length(t.text) + 6 as at, if(t.role = 'assistant', array_append(a.m, concat(a.at + length(t.role) + 5, ':', a.at + length(t.role) + 5 + length(t.text))), a.m) as m)"
    return f"aggregate({turns}, struct(0 as at, cast(array() as array<string>) as m), {step}, a -> array_join(a.m, ','))"


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row for each pair_id of both chosen and rejected(pair_id, turn, role, text, ...).

    Turns stand in order of turn, role and text. n_prompt_turns: length of the
    longest common prefix of turns by role and text; prompt: these turns, rendered once;
    chosen, rejected: the turns after it; chosen_mask, rejected_mask: the places of the assistant's texts in them, which
    the loss counts.

    Null roles and texts are empty, a null turn comes first, repeated rows are turns of their own. A null
    pair_id, or one that stands on one side only, has no row. Equal conversations have empty completions. Other columns
    aren't looked at. A conversation is one row of the result, so its turns, and no more, meet in one place.
    """
    both = _turns(chosen, "c").join(_turns(rejected, "r"), "pair_id")
    same = "filter(sequence(1, least(size(c), size(r))), i -> get(c, i - 1).role <> get(r, i - 1).role or get(c, i - 1).text <> get(r, i - 1).text)"
    n = both.withColumn("n_prompt_turns", F.expr(f"coalesce(array_min({same}) - 1, least(size(c), size(r)))"))
    cut = n.selectExpr("pair_id", "n_prompt_turns", "slice(c, 1, n_prompt_turns) p", "slice(c, n_prompt_turns + 1, size(c)) c", "slice(r, n_prompt_turns + 1, size(r)) r")
    return cut.selectExpr("pair_id", "n_prompt_turns", f"{_render('p')} prompt", f"{_render('c')} chosen", f"{_render('r')} rejected", f"{_mask('c')} chosen_mask", f"{_mask('r')} rejected_mask")


def conversation_pairs(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs from a table of conversations: each as it is, and with the text of its last assistant turn from the conversation next to it (numbers 2k and 2k+1), empty where there is none."""
    t = turns.where("conv_id is not null").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = t.where("role = 'assistant'").groupBy("pair_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("l"))
    other = last.select(F.expr("pair_id ^ 1L").alias("pair_id"), F.col("l.text").alias("other"))
    own = last.select("pair_id", F.col("l.turn").alias("at"))
    worse = t.join(own, "pair_id", "left").join(other, "pair_id", "left")
    text = F.when((F.col("role") == "assistant") & (F.col("turn") == F.col("at")), F.coalesce("other", F.lit(""))).otherwise(F.col("text"))
    return t, worse.select("pair_id", "turn", "role", text.alias("text"))


ORACLE = r"""
with t as (select conv_id pair_id, turn, role, text from conversations where conv_id is not null),
latest as (select pair_id, max(turn) last_turn, arg_max(coalesce(text, ''), turn) txt from t where role = 'assistant' group by pair_id),
worse as (select t.pair_id, turn, role, case when role = 'assistant' and turn = own.last_turn then coalesce(o.txt, '') else text end text
          from t left join latest own on own.pair_id = t.pair_id left join latest o on o.pair_id = xor(t.pair_id, 1)),
c as (select pair_id, coalesce(role, '') role, coalesce(text, '') text, row_number() over (partition by pair_id order by turn, role, text) i from t),
r as (select pair_id, coalesce(role, '') role, coalesce(text, '') text, row_number() over (partition by pair_id order by turn, role, text) i from worse),
n as (select pair_id, coalesce(min(case when c.role <> r.role or c.text <> r.text then i - 1 end), count(*)) n from c join r using (pair_id, i) group by pair_id),
cc as (select pair_id, i, role, '<|' || role || '|>' || chr(10) || text || chr(10) s, length(text) l, n from c join n using (pair_id)),
rr as (select pair_id, i, role, '<|' || role || '|>' || chr(10) || text || chr(10) s, length(text) l, n from r join n using (pair_id)),
cm as (select *, sum(case when i > n then length(s) else 0 end) over (partition by pair_id order by i) - 1 e from cc),
rm as (select *, sum(case when i > n then length(s) else 0 end) over (partition by pair_id order by i) - 1 e from rr),
cs as (select pair_id, max(n) n, coalesce(string_agg(s, '' order by i) filter (i <= n), '') prompt, coalesce(string_agg(s, '' order by i) filter (i > n), '') chosen,
       coalesce(string_agg((e - l)::bigint || ':' || e::bigint, ',' order by i) filter (i > n and role = 'assistant'), '') chosen_mask from cm group by pair_id),
rs as (select pair_id, coalesce(string_agg(s, '' order by i) filter (i > n), '') rejected,
       coalesce(string_agg((e - l)::bigint || ':' || e::bigint, ',' order by i) filter (i > n and role = 'assistant'), '') rejected_mask from rm group by pair_id)
select pair_id, n::int n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask from cs join rs using (pair_id)
"""
