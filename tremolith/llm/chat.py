"""Preference formatting: the common turn prefix of two conversations once as prompt, two masked completions.

A conversation is its distinct rows in order of turn (null first), role and text; a null role is "unknown", a null text
empty.  The longest common prefix counts turns whose role and text are equal.  Every turn is rendered as
``<|role|>\\ntext<|end|>\\n``.  A completion's mask lists ``start:end`` code points (end exclusive) of what is trained on:
the text and end mark of each assistant turn.

Defined cases: rows without a conversation id belong to none and are left out.  A pair with only one side has an empty
prompt, an empty other completion, and is not usable; so is a pair whose one side is a prefix of the other, or equal.
Repeated rows count once.  A conversation becomes one row of output, so it has to fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

END = "<|end|>"


def rendered(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["r"], F.lit("|>\n"), t["t"], F.lit(END + "\n"))


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): the ordered turns of each conversation as structs r, t."""
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).alias("conv"), F.col(turn).alias("n"), F.coalesce(role, F.lit("unknown")).alias("r"), F.coalesce(text, F.lit("")).alias("t")).distinct()
    return rows.groupBy("conv").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "r", "t"))), lambda x: F.struct(x["r"].alias("r"), x["t"].alias("t"))).alias("turns"))


def _mask(turns: Column) -> Column:
    step = lambda acc, t: F.struct((acc["at"] + F.char_length(rendered(t))).alias("at"), F.when(t["r"] == "assistant", F.concat(acc["m"], F.array(F.concat_ws(
        ":", (acc["at"] + len("<|assistant|>\n")).cast("string"), (acc["at"] + len("<|assistant|>\n") + F.char_length(t["t"]) + len(END)).cast("string"))))).otherwise(acc["m"]).alias("m"))
    return F.array_join(F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("m")), step)["m"], ",")


def preference_pairs(convs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``convs`` from ``conversations``; ``pairs`` has pair_id, chosen_id, rejected_id (either may be null)."""
    none = F.array().cast("array<struct<r:string,t:string>>")
    both = (pairs.join(convs.select(F.col("conv").alias("chosen_id"), F.col("turns").alias("c")), "chosen_id", "left")
            .join(convs.select(F.col("conv").alias("rejected_id"), F.col("turns").alias("d")), "rejected_id", "left")
            .select("pair_id", "chosen_id", "rejected_id", F.coalesce("c", none).alias("c"), F.coalesce("d", none).alias("d")))
    shorter = F.least(F.size("c"), F.size("d"))
    differ = F.filter(F.transform(F.arrays_zip("c", "d"), lambda z, i: F.when((i >= shorter) | (z["c"] != z["d"]), i)), lambda i: i.isNotNull())
    cut = both.withColumn("n", F.coalesce(F.get(differ, F.lit(0)), F.size("c")))
    rest = lambda x: F.slice(x, F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0)))
    show = lambda x: F.array_join(F.transform(x, rendered), "")
    cut = cut.select("pair_id", "chosen_id", "rejected_id", F.col("n").cast("long").alias("n_prefix"), show(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"), rest("c").alias("c"), rest("d").alias("d"))
    return cut.select("pair_id", "chosen_id", "rejected_id", "n_prefix", "prompt", show("c").alias("chosen"), show("d").alias("rejected"), _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("d")).alias("rejected_mask"),
                      ((F.size("c") > 0) & (F.size("d") > 0)).alias("usable"))


def neighbours(convs: DataFrame) -> DataFrame:
    """Pairs of conversations 2k (chosen) and 2k + 1 (rejected), also where one of the two is missing."""
    k, even = F.floor(F.col("conv") / 2).cast("long"), F.pmod("conv", F.lit(2)) == 0
    return convs.groupBy(k.alias("pair_id")).agg(F.max(F.when(even, F.col("conv"))).alias("chosen_id"), F.max(F.when(~even, F.col("conv"))).alias("rejected_id"))


SQL = """
with t as (select distinct conv_id, turn, coalesce(role, 'unknown') as r, coalesce(text, '') as x from conversations where conv_id is not null),
n as (select conv_id, conv_id // 2 as pair_id, conv_id % 2 = 0 as even, r, x,
             row_number() over (partition by conv_id order by turn nulls first, r, x) as i from t),
p as (select pair_id, max(conv_id) filter (even) as chosen_id, max(conv_id) filter (not even) as rejected_id,
             max(i) filter (even) as nc, max(i) filter (not even) as nr from n group by pair_id),
d as (select coalesce(a.pair_id, b.pair_id) as pair_id, min(coalesce(a.i, b.i)) as first
      from (select * from n where even) a full join (select * from n where not even) b
        on a.pair_id = b.pair_id and a.i = b.i
      where a.r is distinct from b.r or a.x is distinct from b.x group by 1),
q as (select p.*, coalesce(d.first - 1, p.nc) as k from p left join d using (pair_id)),
m as (select n.*, q.k, '<|' || r || '|>' || chr(10) || x || '<|end|>' || chr(10) as shown from n join q using (pair_id)),
o as (select *, coalesce(sum(length(shown)) over (partition by pair_id, even order by i rows between unbounded preceding and 1 preceding), 0) as off from m where i > k),
s as (select pair_id,
             coalesce(string_agg(shown, '' order by i) filter (even), '') as chosen, coalesce(string_agg(shown, '' order by i) filter (not even), '') as rejected,
             coalesce(string_agg(cast(off + 14 as bigint) || ':' || cast(off + 14 + length(x) + 7 as bigint), ',' order by i) filter (even and r = 'assistant'), '') as chosen_mask,
             coalesce(string_agg(cast(off + 14 as bigint) || ':' || cast(off + 14 + length(x) + 7 as bigint), ',' order by i) filter (not even and r = 'assistant'), '') as rejected_mask,
             coalesce(bool_or(even), false) and coalesce(bool_or(not even), false) as usable from o group by pair_id),
h as (select pair_id, string_agg(shown, '' order by i) as prompt from m where even and i <= k group by pair_id)
select q.pair_id, chosen_id, rejected_id, cast(k as bigint) as n_prefix, coalesce(prompt, '') as prompt, coalesce(chosen, '') as chosen, coalesce(rejected, '') as rejected,
       coalesce(chosen_mask, '') as chosen_mask, coalesce(rejected_mask, '') as rejected_mask, coalesce(usable, false) as usable
from q left join s using (pair_id) left join h using (pair_id)"""
