"""Chat formatting by perspective rotation.

A conversation is rendered once for every participant: their turns are the assistant's and are learned from, everybody else's
are named users' turns, and system turns stay system turns.  The rendering is a row per turn with its place in the whole
string, so a conversation is never put together in one task, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factline.session import cut_lineage

SYSTEM = "system"
UNNAMED = "unknown"
#: What may stand for the start of a control mark in a text or a name: a backslash more takes its meaning away and can be taken back.
MARK_START = r"<(\\*)\|"
#: Turns whose lengths are added up in one window; sums of such blocks are added up in a second one.
BLOCK = 1000


def rotate(conversations: DataFrame) -> DataFrame:
    r"""Rows (conv_id, perspective, turn, ordinal, speaker, rendered, start, learn_from, learn_to), one for each turn and participant.

    The rendering of (conv_id, perspective) is its ``rendered`` by ``start``, without gaps; characters ``learn_from`` to
    ``learn_to`` are the ones to learn, an empty range (both at ``start``) in turns of others.  Speakers are the roles as they stand,
    null or blank being "unknown"; those other than "system" are participants, so a conversation of system turns alone has no
    rows.  Control marks are only this operator's: ``<|`` in a text or a role is rendered ``<\|`` (and one backslash more where there are
    some), so no text can forge a turn.  In a role backslashes are doubled and line breaks are written ``\n`` and ``\r``.  A null text is empty.  A null conv_id is a conversation of its own.  Turns with equal numbers are ordered by speaker and
    text, null numbers come first; equal rows are turns of their own.
    """
    role = F.col("role").cast("string")
    speaker = F.when(F.coalesce(role, F.lit("")).rlike(r"^[ \t\n\f\r]*$"), F.lit(UNNAMED)).otherwise(role)
    turns = conversations.select("conv_id", "turn", speaker.alias("speaker"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("said"))
    turns = cut_lineage(_placed(turns))
    people = turns.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    name = unmarked(F.replace(F.replace(F.replace(F.col("speaker"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")))
    head = F.when(F.col("speaker") == SYSTEM, F.lit("<|im_start|>system\n")).when(own, F.lit("<|im_start|>assistant\n")).otherwise(F.concat(F.lit("<|im_start|>user name="), name, F.lit("\n")))
    tail = F.lit("<|im_end|>\n")
    rendered = (
        turns.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
        .withColumn("_head", F.length(head)).withColumn("rendered", F.concat(head, unmarked(F.col("said")), tail)).withColumn("_own", own)
    )
    placed = _starts(rendered)
    begin = F.col("start") + F.when(F.col("_own"), F.col("_head")).otherwise(0)
    # the end mark is learned with the text
    end = F.col("start") + F.when(F.col("_own"), F.length("rendered") - 1).otherwise(0)
    return placed.select("conv_id", "perspective", "turn", "ordinal", "speaker", "rendered", "start", begin.cast("long").alias("learn_from"), end.cast("long").alias("learn_to"))


def unmarked(text: Column) -> Column:
    """``text`` without control marks: a backslash goes between the characters that start one."""
    return F.regexp_replace(text, MARK_START, r"<\\$1|")


def _placed(turns: DataFrame) -> DataFrame:
    """``turns`` with ``ordinal``, the place in the conversation from 0 on.

    Turns are counted by bands of their number first; within a band of BLOCK numbers a window gives the place.
    """
    banded = turns.withColumn("_band", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))))
    within = Window.partitionBy("conv_id", "_band").orderBy(F.col("turn").asc_nulls_first(), "speaker", "said")
    before = Window.partitionBy("conv_id").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    bands = banded.groupBy("conv_id", "_band").count().select(F.col("conv_id").alias("c"), F.col("_band").alias("b"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_ahead"))
    numbered = banded.withColumn("_at", F.row_number().over(within))
    joined = numbered.join(bands, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("_band") == F.col("b")))
    return joined.select("conv_id", "turn", "speaker", "said", (F.col("_ahead") + F.col("_at") - 1).alias("ordinal"))


def _starts(rendered: DataFrame) -> DataFrame:
    """``rendered`` with ``start``: the length of all before, added up in blocks of BLOCK turns and over blocks."""
    keys = ["conv_id", "perspective"]
    blocked = rendered.withColumn("_block", F.floor(F.col("ordinal") / BLOCK))
    size = F.length("rendered").cast("long")
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy(*keys, "_block").agg(F.sum(size).alias("n")).select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("_block").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy(*keys, "_block").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    inner = blocked.withColumn("_inner", F.coalesce(F.sum(size).over(within), F.lit(0)))
    joined = inner.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("_block") == F.col("b")))
    return joined.withColumn("start", (F.col("_ahead") + F.col("_inner")).cast("long")).drop("c", "p", "b", "_ahead", "_inner", "_block")


#: The same rows on DuckDB with one window a conversation.
ROTATE_SQL = r"""
with t as (
  select conv_id, turn, case when regexp_full_match(coalesce(role, ''), '[ \t\n\f\r]*') then 'unknown' else role end as speaker, coalesce(text, '') as said from conversations),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, speaker, said) - 1 as ordinal from t),
p as (select distinct conv_id as c, speaker as perspective from o where speaker <> 'system'),
r as (select o.*, p.perspective, speaker = perspective and speaker <> 'system' as own,
             case when speaker = 'system' then '<|im_start|>system' when speaker = perspective then '<|im_start|>assistant' else '<|im_start|>user name=' || regexp_replace(replace(replace(replace(speaker, '\', '\\'), chr(10), '\n'), chr(13), '\r'), '<(\\*)\|', '<\\\1|', 'g') end || chr(10) as head
      from o join p on o.conv_id is not distinct from p.c),
s as (select *, head || regexp_replace(said, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10) as rendered from r),
w as (select *, coalesce(sum(len(rendered)) over (partition by conv_id, perspective order by ordinal rows between unbounded preceding and 1 preceding), 0)::bigint as start from s)
select conv_id, perspective, turn, ordinal, speaker, rendered, start,
       (start + case when own then len(head) else 0 end)::bigint as learn_from, (start + case when own then len(rendered) - 1 else 0 end)::bigint as learn_to from w
"""
