"""Row and cell diff of two versions of a table, by key where there is one and by position else."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.dataset import ROW, Dataset, dense
from tabloom.functions.text import is_empty, strip
from tabloom.operators.join import ID_WORDS


@dataclass(frozen=True)
class Diff:
    rows: DataFrame  # status, key, before_row, after_row, changes array<struct<column, before, after>>
    key: str | None
    added_columns: tuple[str, ...]
    removed_columns: tuple[str, ...]
    shared: tuple[str, ...]

    def counts(self) -> dict:
        got = {r.status: r["count"] for r in self.rows.groupBy("status").count().collect()}
        return {s: got.get(s, 0) for s in ("added", "removed", "changed", "unchanged")}


def infer_key(before: Dataset, after: Dataset) -> str | None:
    """A shared column that is distinct in both and never blank in the first; identifier-like names first. One pass a side."""
    shared = [h for h in dict.fromkeys(before.headers) if h in after.headers]
    if not shared:
        return None

    def facts(d: Dataset):
        cols = [F.count(F.lit(1)).alias("n")]
        for k, h in enumerate(shared):
            x = F.lower(strip(d.text(d.index(h))))
            cols += [F.count_if(x == "").alias(f"blank{k}"), F.count_distinct(F.when(x != "", x)).alias(f"distinct{k}")]
        return d.df.agg(*cols).first()

    b, a = facts(before), facts(after)
    order = sorted(range(len(shared)), key=lambda k: 0 if re.search(ID_WORDS, shared[k]) else 1)
    for k in order:
        if b["n"] and not b[f"blank{k}"] and b[f"distinct{k}"] == b["n"] and a[f"distinct{k}"] == a["n"] - a[f"blank{k}"]:
            return shared[k]
    return None


def diff_tables(before: Dataset, after: Dataset, key: str | None = None) -> Diff:
    """Compares shared columns as text. With a repeated key the last row of the first table counts, for each row of the second."""
    shared = [h for h in dict.fromkeys(before.headers) if h in after.headers]
    key = key if key in shared else infer_key(before, after)

    def side(d: Dataset, name: str) -> DataFrame:
        cols = [d.text(d.index(h)).alias(f"{name}{k}") for k, h in enumerate(shared)]
        out = d.df.select(F.col(ROW).alias(f"{name}_row"), *cols)
        if key:
            x = F.lower(strip(F.col(f"{name}{shared.index(key)}")))
            return out.withColumn(f"{name}_key", F.when(x != "", x))
        return out.withColumn(f"{name}_key", F.col(f"{name}_row"))

    def placed(d: Dataset) -> Dataset:
        """Rows numbered from 0 without gaps: by position, the n-th row of one table is held against the n-th of the other."""
        low, high, n = d.df.agg(F.min(ROW), F.max(ROW), F.count(F.lit(1))).first()
        if not n or (low == 0 and high == n - 1):
            return d
        return d.with_(d.df.withColumn(ROW, F.col(ROW) - low) if high - low == n - 1 else dense(d.df, ROW))

    if not key:
        before, after = placed(before), placed(after)
    b, a = side(before, "b"), side(after, "a")
    if key:
        packed = F.struct(*[c for c in b.columns if c != "b_key"])
        keyed = b.filter("b_key is not null").groupBy("b_key").agg(F.max_by(packed, "b_row").alias("x")).select("b_key", "x.*")
        b = keyed.unionByName(b.filter("b_key is null"))
    both = b.join(a, F.col("b_key") == F.col("a_key"), "full_outer")
    cells = F.array_compact(F.array(*[F.when(F.col(f"b{k}") != F.col(f"a{k}"), F.struct(F.lit(h).alias("column"), F.col(f"b{k}").alias("before"), F.col(f"a{k}").alias("after"))) for k, h in enumerate(shared)])) if shared else None
    status = F.when(F.col("b_row").isNull(), "added").when(F.col("a_row").isNull(), "removed")
    status = status.when(F.size(cells) > 0, "changed").otherwise("unchanged") if shared else status.otherwise("unchanged")
    shown = F.coalesce(F.coalesce(F.col("a_key"), F.col("b_key")).cast("string"), F.lit("(no key)"))
    matched = F.col("b_row").isNotNull() & F.col("a_row").isNotNull()
    rows = both.select(status.alias("status"), shown.alias("key"), F.col("b_row").alias("before_row"), F.col("a_row").alias("after_row"), F.when(matched, cells).alias("changes"))
    return Diff(rows, key, tuple(h for h in after.headers if h not in before.headers), tuple(h for h in before.headers if h not in after.headers), tuple(shared))
