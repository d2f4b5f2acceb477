"""Group-by with honest diagnostics: decorated numbers count, blanks share one group, nothing summed is blank and not 0."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.dataset import ROW, Dataset
from tabloom.functions.text import is_missing, numeric_value, strip

KINDS = ("count", "count-distinct", "sum", "mean", "median", "min", "max")
LABELS = {"count-distinct": "Distinct", "sum": "Sum of", "mean": "Average of", "median": "Median of", "min": "Min of", "max": "Max of"}


@dataclass(frozen=True)
class Aggregation:
    kind: str
    column: str | None = None
    name: str | None = None

    @property
    def label(self) -> str:
        if self.name and self.name.strip():
            return self.name.strip()
        return "Rows" if self.kind == "count" else f"{LABELS[self.kind]} {self.column}"


@dataclass(frozen=True)
class Grouped:
    """table: groups in order of first appearance. diagnostics: one row; see diagnostics()."""

    table: Dataset
    source: DataFrame
    labels: tuple[str, ...]
    error: str | None = None

    def diagnostics(self) -> dict:
        """blank_key_rows, groups, and for each numeric aggregation the ignored values and the groups without a result."""
        sums = [F.coalesce(F.sum("_blank"), F.lit(0)).alias("blank_key_rows"), F.count(F.lit(1)).alias("groups")]
        for i, _ in enumerate(self.labels):
            sums += [F.coalesce(F.sum(f"_ignored{i}"), F.lit(0)).alias(f"ignored{i}"), F.count_if(F.col(f"_value{i}").isNull()).alias(f"empty{i}")]
        r = self.source.agg(*sums).first()
        return {
            "blank_key_rows": r.blank_key_rows,
            "groups": r.groups,
            "ignored": {n: r[f"ignored{i}"] for i, n in enumerate(self.labels)},
            "empty_groups": {n: r[f"empty{i}"] for i, n in enumerate(self.labels)},
        }

    def findings(self) -> list[dict]:
        if self.error:
            return [{"rule": "group-no-aggregation", "severity": "error", "count": 0, "title": self.error}]
        d, out = self.diagnostics(), []
        for n, k in d["ignored"].items():
            if k:
                out.append({"rule": "group-ignored-values", "severity": "warning", "count": k, "title": f"{k} value(s) that are no number were left out of {n}"})
        for n, k in d["empty_groups"].items():
            if k:
                out.append({"rule": "group-empty-result", "severity": "warning", "count": k, "title": f"{k} group(s) have no result for {n}"})
        if d["blank_key_rows"]:
            out.append({"rule": "group-blank-key", "severity": "info", "count": d["blank_key_rows"], "title": f"{d['blank_key_rows']} row(s) without a key share one group"})
        return out


def group_by(data: Dataset, by: list[str], aggregations: list[Aggregation]) -> Grouped:
    """Groups by trimmed lower-case keys; unknown names are left out. One shuffle with map-side combine."""
    keys = [i for i in (data.index(n) for n in by) if i is not None]
    wanted = [a for a in aggregations if a.kind in KINDS and (a.kind == "count" or (a.column is not None and data.index(a.column) is not None))]
    if not wanted:
        return Grouped(data.with_(data.df.limit(0)), data.df.limit(0), (), "No usable aggregation")

    def usable(i: int) -> Column:
        return ~is_missing(data.text(i), data.is_string(i))

    rows = data.df
    for k, i in enumerate(keys):
        rows = rows.withColumn(f"_key{k}", F.when(usable(i), F.lower(strip(data.text(i)))))
        rows = rows.withColumn(f"_shown{k}", F.when(usable(i), data.text(i)))
    exprs = [F.min(ROW).alias("_first"), F.count(F.lit(1)).alias("_rows")]
    for k in range(len(keys)):
        exprs.append(F.min_by(f"_shown{k}", ROW).alias(f"_show{k}"))
    for n, a in enumerate(wanted):
        ignored = F.lit(0).cast("long")
        if a.kind == "count":
            value = F.count(F.lit(1))
        else:
            i = data.index(a.column)
            x = numeric_value(data.col(i), data.kinds[i])
            if a.kind == "count-distinct":
                value = F.count_distinct(F.when(usable(i), F.lower(strip(data.text(i)))))
            else:
                value = {"sum": F.sum, "mean": F.avg, "median": F.median, "min": F.min, "max": F.max}[a.kind](x)
                ignored = F.count_if(usable(i) & x.isNull())
        exprs += [value.alias(f"_value{n}"), ignored.alias(f"_ignored{n}")]
    grouped = rows.groupBy(*[f"_key{k}" for k in range(len(keys))]).agg(*exprs)
    if not keys:
        grouped = grouped.filter("_rows > 0")  # no rows, no group
    blank = F.lit(False)
    for k in range(len(keys)):
        blank = blank | F.col(f"_key{k}").isNull()
    source = grouped.withColumn("_blank", F.when(blank, F.col("_rows")).otherwise(F.lit(0)))
    cols = [F.col(f"_show{k}").alias(f"c{k}") for k in range(len(keys))]
    cols += [F.col(f"_value{n}").alias(f"c{len(keys) + n}") for n in range(len(wanted))]
    table = source.select(*cols, F.col("_first").alias(ROW))
    return Grouped(Dataset(table, (*[data.headers[i] for i in keys], *[a.label for a in wanted])), source, tuple(a.label for a in wanted))


def suggest(data: Dataset, sample: int = 500) -> tuple[str | None, str | None]:
    """A group column (2 or more values, at most 60 % of rows) and a numeric column, from the first rows."""
    rows = data.df.orderBy(ROW).limit(sample).collect()
    group = value = None
    for i, h in enumerate(data.headers):
        texts = ["" if r[f"c{i}"] is None else str(r[f"c{i}"]).strip() for r in rows]
        seen = [t for t in texts if t]
        identity = h.lower().strip() in ("id", "ref", "code", "key", "account no", "number", "phone", "postcode", "year") or h.lower().endswith((" id", "_id", "key"))
        plain = [t.replace(",", "").lstrip("£$€") for t in seen[:20]]
        numeric = sum(t.replace(".", "", 1).lstrip("-").isdigit() for t in plain) >= 0.8 * max(len(plain), 1) and bool(plain)
        distinct = len({t.lower() for t in seen})
        if not numeric and group is None and not identity and 2 <= distinct <= 0.6 * max(len(rows), 1):
            group = h
        if numeric and value is None and not identity:
            value = h
    return group, value
