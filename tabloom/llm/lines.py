"""Substring dedup by line or paragraph hashing.

Units (lines, or blocks between blank lines) are normalised (lower case, runs of white space as one space, outer ones dropped) and
hashed; every unit counts that is not blank. Digests are grouped over all documents, the earliest by (id, unit number) is kept and every
other occurrence is removed; all occurrences of a repeated unit, the kept one too, carry their original offsets in code points.

Only (digest, id, number, offsets) is shuffled, never text. The group keeps a minimum and a count (map-side combine). A digest with over
1 / (4 x shuffle partitions) of the repeated units is hot; there are fewer than 4 x shuffle partitions of these, so their list is broadcast,
and their occurrences are dealt over SALTS keys, each with a copy of the digest's one row of the group.

Edge cases: null and empty texts have no units; a repeated unit within one document counts; with repeated ids the rows'
units share their ranks, and all units of the earliest rank are kept; null ids rank last; an empty table gives no rows; columns
beyond the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import cut, sliced, width

BREAKS = {"line": "\n", "paragraph": "\n\n"}
#: Keys that the occurrences of a hot digest are dealt over.
SALTS = 64
SPACES = re.compile(r"[ \t\n\r\f\v]+")


def repeated_units(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", least_chars: int = 1) -> DataFrame:
    """Rows (doc_id, unit, start, end, digest, kept_doc_id, kept_unit, removed): every occurrence of a repeated unit, end exclusive.

    least_chars: units of fewer normalised characters are left alone; by default only blank ones are."""
    gap = BREAKS[unit]

    def parse(batches):
        for batch in sliced(batches, 1):
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = 0
                for number, body in enumerate(text.decode().split(gap)):
                    plain = SPACES.sub(" ", body.lower()).strip(" ")
                    if len(plain) >= least_chars:
                        for column, value in zip(out, (hashlib.md5(plain.encode()).hexdigest(), doc, number, start, start + len(body))):
                            column.append(value)
                    start += len(body) + len(gap)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32()))], ["digest", "doc_id", "unit", "start", "end"])

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).filter("text is not null")
    units = base.mapInArrow(parse, f"digest string, doc_id {docs.schema[id_col].dataType.simpleString()}, unit int, start int, end int")
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("unit"))
    groups = units.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = cut(groups.select("digest", "n", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.unit").alias("kept_unit")))
    most = (groups.agg(F.sum("n")).first()[0] or 0) / (4 * width(docs))
    hot = groups.filter(F.col("n") > most).select("digest", F.lit(SALTS).alias("salts"))
    # fewer than 4 x shuffle partitions rows, as each has more than that share of the whole
    dealt = units.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "unit"), F.coalesce("salts", F.lit(1)))).drop("salts")
    kept = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > most, SALTS - 1).otherwise(0)))).drop("n")
    removed = ~(F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("unit") == F.col("kept_unit")))
    return dealt.join(kept, ["digest", "salt"]).select("doc_id", "unit", "start", "end", "digest", "kept_doc_id", "kept_unit", removed.alias("removed"))


def oracle(table: str = "documents", least_chars: int = 1) -> str:
    return f"""
with parts as (
  select doc_id, string_split(text, chr(10)) as u from {table} where text is not null),
lines as (
  select doc_id, cast(i - 1 as integer) as unit, u[i] as body,
         cast(coalesce(list_sum(list_transform(u[1:i - 1], lambda x : length(x) + 1)), 0) as integer) as start
  from (select doc_id, u, unnest(range(1, len(u) + 1)) as i from parts)),
units as (
  select doc_id, unit, start, cast(start + length(body) as integer) as "end", trim(regexp_replace(lower(body), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) as n from lines),
kept as (select *, md5(n) as digest from units where length(n) >= {least_chars}),
ranked as (
  select *, first_value(doc_id) over w as kept_doc_id, first_value(unit) over w as kept_unit, count(*) over (partition by digest) as copies
  from kept window w as (partition by digest order by doc_id, unit))
select doc_id, unit, start, "end", digest, kept_doc_id, kept_unit, not (doc_id = kept_doc_id and unit = kept_unit) as removed from ranked
where copies > 1"""
