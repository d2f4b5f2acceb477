"""Chat formatting by multi-party perspective rotation, in DataFrame functions only.

For each participant of a conversation the dialogue is rendered with that speaker as assistant and the others as named users; system turns
stay system turns and are nobody's perspective. Output is a row per perspective and turn, with the rendered segment, its character
span in the whole rendering and the training mask (1 for the assistant's own turns), so that no conversation, however long, has to fit in one
row or one task's memory: offsets are running sums over a sorted stream.

Template of a segment: `<|assistant|>\\n` or `<|system|>\\n` or `<|user name=NAME|>\\n`, the text, `<|end|>\\n`.

Edge cases: turns are ordered by (turn, role, text), which also orders ties and repeated rows, each rendered; a null role is the participant
`unknown`, a null text is empty, a null conversation id is a conversation of its own; conversations of system turns only give no rows;
an empty table gives no rows; columns other than the four are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

END = "<|end|>\n"


def rotate(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, perspective, position, segment, mask, start, end)."""
    base = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    # participants per conversation: distinct names, combined before the shuffle
    cast = base.filter("role <> 'system'").select("conv_id", F.col("role").alias("perspective")).distinct()
    own = F.col("role") == F.col("perspective")
    head = F.when(F.col("role") == "system", F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), F.col("role"), F.lit("|>\n")))
    rows = base.join(cast.withColumnRenamed("conv_id", "__conv"), F.col("conv_id").eqNullSafe(F.col("__conv")))
    rows = rows.select("conv_id", "perspective", "turn", "role", "text", F.concat(head, F.col("text"), F.lit(END)).alias("segment"), own.cast("int").alias("mask"))
    order = W.partitionBy("conv_id", "perspective").orderBy("turn", "role", "text")
    end = F.sum(F.char_length("segment").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumns({"position": F.row_number().over(order), "end": end})
    return rows.select("conv_id", "perspective", "position", "segment", "mask", (F.col("end") - F.char_length("segment")).alias("start"), "end")


def oracle(table: str = "conversations") -> str:
    return f"""
with base as (
  select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from {table}),
roles as (select distinct conv_id, role as perspective from base where role <> 'system'),
rendered as (
  select b.conv_id, perspective, turn, role, text, cast(role = perspective as integer) as mask,
         case when role = 'system' then '<|system|>' when role = perspective then '<|assistant|>'
              else '<|user name=' || role || '|>' end || chr(10) || text || '<|end|>' || chr(10) as segment
  from base b join roles r on b.conv_id is not distinct from r.conv_id),
placed as (
  select *, cast(row_number() over w as integer) as position,
         cast(sum(length(segment)) over (partition by conv_id, perspective order by turn, role, text
              rows between unbounded preceding and current row) as bigint) as "end"
  from rendered window w as (partition by conv_id, perspective order by turn, role, text))
select conv_id, perspective, position, segment, mask, "end" - length(segment) as start, "end" from placed"""
