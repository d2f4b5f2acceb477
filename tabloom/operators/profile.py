"""Column profiles: one job over the whole table gives counts, type votes and what the rules' gates need."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.dataset import ROW, Dataset
from tabloom.functions import domain as D
from tabloom.functions.text import clean_space, display_number, is_empty, is_missing, is_sentinel, plain_number, strip

#: Share of the votes that makes a type.
MAJORITY = 0.6


@dataclass(frozen=True)
class ColumnProfile:
    name: str
    index: int
    type: str
    confidence: float
    non_empty: int
    empty: int
    sentinels: int
    distinct: int
    samples: tuple[str, ...]
    facts: dict = field(default_factory=dict, compare=False)


@dataclass(frozen=True)
class Profile:
    rows: int
    columns: tuple[ColumnProfile, ...]
    blank_rows: int = 0


def values_of(data: Dataset) -> DataFrame:
    """(at, text, n, first): each column's distinct texts, how often and where first; column -1 has "" for each row without any text.

    Long form, so that the plan is as small for a hundred columns as for one, and so that patterns run once a distinct text."""
    blank = F.lit(True)
    for i in range(len(data)):
        blank = blank & is_empty(data.text(i))
    cells = [F.struct(F.lit(-1).alias("at"), F.when(blank, "").otherwise("x").alias("text"))]
    cells += [F.struct(F.lit(i).alias("at"), data.text(i).alias("text")) for i in range(len(data))]
    return data.df.select(ROW, F.inline(F.array(*cells))).groupBy("at", "text").agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first"))


def _measured(data: Dataset, values: DataFrame) -> dict[int, dict]:
    """Of each column, what the profile and the rules' gates need, by name."""
    string = F.col("at").isin([i for i in range(len(data)) if data.is_string(i)])
    sentinel = is_sentinel(F.col("text")) & string
    # counted apart: a distinct beside the sums would carry all of these through its shuffle, once a word
    words = values.select("at", F.when(~sentinel, F.lower(strip(F.col("text")))).alias("word")).filter("word <> ''").distinct()
    distinct = {r["at"]: r["n"] for r in words.groupBy("at").agg(F.count(F.lit(1)).alias("n")).collect()}
    values = values.withColumns({"x": strip(F.col("text")), "sentinel": sentinel})
    values = values.withColumns({"tidy": clean_space(F.col("x")), "present": F.col("x") != "", "filled": (F.col("x") != "") & ~F.col("sentinel"), "word": F.lower("x")})
    x, word, present, filled = F.col("x"), F.col("word"), F.col("present"), F.col("filled")
    num = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.]\d{2,4}$"
    values = values.withColumns({"vote": F.when(filled, D.vote(x)), "a": F.when(x.rlike(num), F.regexp_extract(x, num, 1).cast("int")), "b": F.when(x.rlike(num), F.regexp_extract(x, num, 2).cast("int")), "bools": word.isin(D.TRUE_WORDS + D.FALSE_WORDS)})
    first, last = F.col("a"), F.col("b")
    kinds = {
        "rows": F.lit(True),
        "filled": filled,
        "present": present,
        "sentinels": F.col("sentinel"),
        **{f"vote_{t}": F.col("vote") == t for t in D.TYPES},
        "numeric": present & (x.rlike(r"^-?\d+(\.\d+)?$") | plain_number(F.col("tidy")).isNotNull()),
        "numbers": filled & display_number(x).isNotNull(),
        "bool_words": F.col("bools"),
        "bool_all": F.col("bools") | word.isin(["1", "0"]),
        "dmy": (first > 12) & (last <= 12),
        "mdy": (last > 12) & (first <= 12),
        "dates": filled & D.looks_like_date(x),
        "digits": filled & x.rlike(r"^\d+$"),
        "excel_date": filled & x.rlike(D.EXCEL_DATE),
        "excel_power": filled & x.rlike(D.EXCEL_POWER),
        "insurance": filled & x.rlike(D.NATIONAL_INSURANCE),
        "card_shape": filled & x.rlike(D.CARD_SHAPE),
    }
    out = [F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in kinds.items()]
    out.append(F.min_by(F.char_length(x), F.when(filled & x.rlike(r"^0\d+$"), F.col("first"))).alias("zero_len"))
    return {r["at"]: r.asDict() | {"distinct": distinct.get(r["at"], 0)} for r in values.groupBy("at").agg(*out).collect()}


def profile(data: Dataset, samples: bool = True, values: DataFrame | None = None) -> Profile:
    """Votes of all values that are neither blank nor sentinels; the type with 60 % of them wins, else `mixed`.

    values: values_of(data), where the caller keeps it for more than this."""
    width, kept = len(data), values_of(data).persist() if values is None else values
    got = _measured(data, kept)
    if values is None:
        kept.unpersist()
    shown: dict[int, list[str]] = {i: [] for i in range(width)}
    if samples:
        for i in range(width):
            few = data.df.filter(~is_missing(data.text(i), data.is_string(i))).select(ROW, data.text(i).alias("v")).orderBy(ROW).limit(5)
            shown[i] = [r.v for r in few.collect()]
    out = []
    rows = got[-1]["rows"] if got else 0
    for i, name in enumerate(data.headers):
        facts = got.get(i) or dict.fromkeys([*(f"vote_{t}" for t in D.TYPES), "filled", "sentinels", "distinct", "present", "numeric", "numbers", "bool_words", "bool_all", "dmy", "mdy", "dates", "digits", "excel_date", "excel_power", "insurance", "card_shape"], 0) | {"zero_len": None}
        votes = {t: facts[f"vote_{t}"] for t in D.TYPES}
        n = facts["filled"]
        best = max(D.TYPES, key=lambda t: votes[t])
        kind = "empty" if not n else best if votes[best] >= MAJORITY * n else "mixed"
        out.append(ColumnProfile(name, i, kind, int(votes[best] / n * 1000 + 0.5) / 1000 if n else 0.0, n, rows - n, facts["sentinels"], facts["distinct"], tuple(shown[i]), facts))
    return Profile(rows, tuple(out), got[-1]["rows"] - got[-1]["present"] if got else 0)


def profile_frame(data: Dataset) -> DataFrame:
    """The profile as rows (column, rows, non_empty, empty, sentinels, distinct, votes of each type)."""
    p = profile(data, samples=False)
    rows = [(c.name, p.rows, c.non_empty, c.empty, c.sentinels, c.distinct, c.type, *[c.facts[f"vote_{t}"] for t in D.TYPES]) for c in p.columns]
    schema = "column string, rows long, non_empty long, empty long, sentinels long, distinct long, type string, " + ", ".join(f"vote_{t} long" for t in D.TYPES)
    return data.df.sparkSession.createDataFrame(rows, schema)


def top_values(data: Dataset, k: int = 3) -> DataFrame:
    """(column, value, n, rank): the k commonest values of each column, in one long-form aggregate; ties by text."""
    from pyspark.sql import Window as W

    cells = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(h).alias("column"), strip(data.text(i)).alias("value")) for i, h in enumerate(data.headers)])
    counts = data.df.select(F.inline(cells)).filter("value <> ''").groupBy("at", "column", "value").agg(F.count(F.lit(1)).alias("n"))
    # the first window keeps k per column and slice, so that no task ranks all values of a column
    part = W.partitionBy("at", "slice").orderBy(F.desc("n"), "value")
    some = counts.withColumn("slice", F.pmod(F.xxhash64("value"), F.lit(64))).withColumn("r", F.row_number().over(part)).filter(F.col("r") <= k)
    w = W.partitionBy("at").orderBy(F.desc("n"), "value")
    return some.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("column", "value", "n", "rank")
