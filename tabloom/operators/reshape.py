"""Shape transforms: split, merge, unpivot, delete columns and rows, find and replace, filters. All are narrow but for the split's width."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.dataset import ROW, Dataset
from tabloom.functions.text import strip

MOST_PARTS = 8


def split_column(data: Dataset, column: int, separator: str = " ", names: list[str] | None = None) -> Dataset:
    """Splits on literal text into up to 8 parts; the widest row decides; what is beyond stays in the last part."""
    separator = separator or " "
    parts = F.split(data.text(column), "\\Q" + separator + "\\E", MOST_PARTS)
    wide = data.df.agg(F.max(F.size(parts))).first()[0] or 1
    if wide < 2:
        return data
    cells = [F.nullif(strip(F.get(parts, F.lit(k))), F.lit("")) for k in range(wide)]
    heads = [(names[k].strip() if names and k < len(names) and names[k].strip() else f"{data.headers[column]} {k + 1}") for k in range(wide)]
    return _with_columns(data, [*[(data.headers[i], data.col(i)) for i in range(column)], *zip(heads, cells), *[(data.headers[i], data.col(i)) for i in range(column + 1, len(data))]])


def merge_columns(data: Dataset, columns: list[int], separator: str = " ", name: str | None = None) -> Dataset:
    """Joins the texts of two or more columns, in the order given, at the place of the first; empty ones are left out."""
    if len(set(columns)) < 2:
        return data
    merged = F.nullif(F.concat_ws(separator, *[F.nullif(data.text(i), F.lit("")) for i in columns]), F.lit(""))
    head = name.strip() if name and name.strip() else " ".join(data.headers[i] for i in columns)
    out = []
    for i in range(len(data)):
        if i == columns[0]:
            out.append((head, merged))
        elif i not in columns:
            out.append((data.headers[i], data.col(i)))
    return _with_columns(data, out)


def unpivot(data: Dataset, columns: list[int], field: str = "Field", value: str = "Value") -> Dataset:
    """Folds two or more, but not all, columns into (field, value) rows, in row order then column order; nulls stay."""
    folded = sorted(set(columns))
    if not 2 <= len(folded) < len(data):
        return data
    kept = [i for i in range(len(data)) if i not in folded]
    same = len({data.kinds[i].simpleString() for i in folded}) == 1
    cell = (lambda i: data.col(i)) if same else (lambda i: F.when(data.col(i).isNotNull(), data.text(i)))
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(data.headers[i]).alias("f"), cell(i).alias("v")) for p, i in enumerate(folded)])
    rows = data.df.select(*[data.col(i).alias(f"c{k}") for k, i in enumerate(kept)], F.col(ROW), F.explode(pairs).alias("x"))
    rows = rows.select(*[f"c{k}" for k in range(len(kept))], F.col("x.f").alias(f"c{len(kept)}"), F.col("x.v").alias(f"c{len(kept) + 1}"), (F.col(ROW) * len(folded) + F.col("x.p")).alias(ROW))
    return Dataset(rows, (*[data.headers[i] for i in kept], field, value))


def delete_column(data: Dataset, column: int) -> Dataset:
    if len(data) < 2 or not 0 <= column < len(data):
        return data
    return _with_columns(data, [(h, data.col(i)) for i, h in enumerate(data.headers) if i != column])


def delete_rows(data: Dataset, rows: list[int] | DataFrame) -> Dataset:
    """Drops rows by number; a DataFrame of (_row) for many, which is anti-joined."""
    if isinstance(rows, DataFrame):
        return data.with_(data.df.join(rows.select(ROW), ROW, "left_anti"))
    return data.with_(data.df.filter(~F.col(ROW).isin(list(rows)))) if rows else data


@dataclass(frozen=True)
class Search:
    find: str
    replace: str = ""
    match_case: bool = False
    whole_cell: bool = False
    column: int | None = None


def _columns(data: Dataset, s: Search) -> list[int]:
    return [i for i in range(len(data)) if s.column is None or s.column == i] if s.find else []


def replaced(data: Dataset, s: Search, i: int):
    flags = "" if s.match_case else "(?iu)"
    pattern = flags + ("^" if s.whole_cell else "") + "\\Q" + s.find + "\\E" + ("$" if s.whole_cell else "")
    return F.regexp_replace(data.text(i), pattern, s.replace.replace("\\", "\\\\").replace("$", "\\$"))


def find_replace(data: Dataset, s: Search) -> DataFrame:
    """Replacements as rows (_row, column, before, after) in the text of all cells, numbers too; literal and by default without regard to case."""
    cells = [F.when(data.col(i).isNotNull(), F.struct(F.lit(i).alias("column"), data.text(i).alias("before"), replaced(data, s, i).alias("after"))) for i in _columns(data, s)]
    if not cells:
        return data.df.select(ROW, F.lit(0).alias("column"), F.lit("").alias("before"), F.lit("").alias("after")).limit(0)
    rows = data.df.select(ROW, F.inline(F.filter(F.array(*cells), lambda x: x.isNotNull() & (x["before"] != x["after"]))))
    return rows.select(ROW, "column", "before", "after")


def apply_replace(data: Dataset, s: Search) -> Dataset:
    at = set(_columns(data, s))

    def cell(i: int):
        # a column that is not text becomes text, as a replacement may be any
        return F.when(data.col(i).isNotNull(), replaced(data, s, i)) if i in at else data.col(i)

    return _with_columns(data, [(h, cell(i)) for i, h in enumerate(data.headers)])


def apply_edits(data: Dataset, edits: DataFrame) -> Dataset:
    """Overlays cell edits (_row, column, value): one row per edited row, joined once."""
    last = edits.groupBy(ROW).agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("_edits"))
    joined = data.df.join(last, ROW, "left")
    cols = [F.when(F.array_contains(F.map_keys("_edits"), i), F.element_at("_edits", F.lit(i))).otherwise(data.text(i)).alias(f"c{i}") for i in range(len(data))]
    return Dataset(joined.select(*cols, ROW), data.headers)


def grid_filter(data: Dataset, query: str) -> Dataset:
    """Rows with a cell that contains the query, without regard to case."""
    hit = F.lit(False)
    for i in range(len(data)):
        hit = hit | F.contains(F.lower(data.text(i)), F.lit(query.lower()))
    return data.with_(data.df.filter(hit)) if query else data


def sort_view(data: Dataset, column: int, descending: bool = False) -> DataFrame:
    """Numbers first by value, then text in lower case; rows that tie keep their order."""
    from tabloom.functions.text import display_number

    x = display_number(data.text(column))
    keys = [x.isNull(), x, F.lower(data.text(column))]
    keys = [k.desc() for k in keys] if descending else [k.asc() for k in keys]
    return data.df.orderBy(*keys, ROW)


def _with_columns(data: Dataset, cols: list) -> Dataset:
    return Dataset(data.df.select(*[c.alias(f"c{k}") for k, (_, c) in enumerate(cols)], ROW), tuple(h for h, _ in cols))
