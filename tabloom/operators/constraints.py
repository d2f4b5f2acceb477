"""User constraints: not-null, unique, regex, range and allowed values, counted in one aggregate; and suggestions from a profile."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.dataset import ROW, Dataset
from tabloom.functions.text import SPACE, is_empty, is_missing, number, strip
from tabloom.operators.profile import Profile
from tabloom.plans.score import Finding


@dataclass(frozen=True)
class Constraint:
    kind: str  # not-null, unique, regex, range, allowed-values
    column: str
    pattern: str | None = None
    least: float | None = None
    most: float | None = None
    values: tuple[str, ...] = ()


def _last(data: Dataset, name: str) -> int | None:
    found = [i for i, h in enumerate(data.headers) if h == name]
    return found[-1] if found else None


def _broken(data: Dataset, c: Constraint, i: int) -> Column | None:
    text = data.text(i)
    filled = ~is_empty(text)
    if c.kind == "not-null":
        return is_empty(text)
    if c.kind == "regex":
        try:
            re.compile(c.pattern or "")
        except re.error:
            return None
        return filled & ~text.rlike(c.pattern or "")
    if c.kind == "range":
        x = number(F.regexp_replace(text, rf"[£$€,%]|{SPACE}", ""))
        bad = x.isNull()
        if c.least is not None:
            bad = bad | (x < c.least)
        if c.most is not None:
            bad = bad | (x > c.most)
        return filled & bad
    if c.kind == "allowed-values":
        return filled & ~F.lower(strip(text)).isin([v.strip().lower() for v in c.values])
    return None


def violations(data: Dataset, c: Constraint) -> DataFrame:
    """(_row) of the rows that break a constraint; for unique, second and later rows of a value, by grouped minimum and join."""
    i = _last(data, c.column)
    if c.kind == "unique":
        rows = data.df.select(ROW, F.lower(strip(data.text(i))).alias("k")).filter("k <> ''")
        first = rows.groupBy("k").agg(F.min(ROW).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        return rows.join(first, "k").filter(F.col(ROW) > F.col("f")).select(ROW)
    return data.df.filter(_broken(data, c, i)).select(ROW)


def check(data: Dataset, constraints: tuple[Constraint, ...] | list[Constraint]) -> list[Finding]:
    out: dict[int, Finding] = {}
    counts = []
    for k, c in enumerate(constraints):
        i = _last(data, c.column)
        rule = f"constraint-{c.kind}"
        if i is None:
            out[k] = Finding(rule, "warning", 0, f"No column {c.column}", column=c.column)
        elif c.kind == "unique":
            v = F.lower(strip(data.text(i)))
            counts.append((F.count_if(v != "") - F.count_distinct(F.when(v != "", v))).alias(f"n{k}"))
        elif (broken := _broken(data, c, i)) is None:
            out[k] = Finding(rule, "warning", 0, f"The rule for {c.column} can't be read", column=c.column)
        else:
            counts.append(F.count_if(broken).alias(f"n{k}"))
    got = data.df.agg(*counts).first().asDict() if counts else {}
    for name, n in got.items():
        k = int(name[1:])
        if n:
            out[k] = Finding(f"constraint-{constraints[k].kind}", "error", n, f"{n} value(s) of {constraints[k].column} break a rule", column=constraints[k].column)
    return [out[k] for k in sorted(out)]


# Fixed value: words in headers that tell identifiers.
ID_WORDS = r"(?i)(^|[^a-z])(id|ids|ref|reference|code|sku|key|account|acct|no|number)([^a-z]|$)"


def suggest(data: Dataset, prof: Profile, known: tuple[Constraint, ...] = (), most: int = 5) -> list[Constraint]:
    """Constraints that the data already keep, up to `most`; a column may give several.

    unique: an identifier or e-mail column with 10 values or more, all distinct, 90 % filled. allowed-values: 2 to 6 values of text or
    booleans, without regard to case, three rows a value. not-null: an identifier or e-mail column without gaps."""
    have = {(c.kind, c.column) for c in known}
    if prof.rows < 10:
        return []
    out: list[Constraint] = []
    small = [c for c in prof.columns if c.type in ("string", "boolean") and 2 <= c.distinct <= 6 and c.non_empty >= 3 * c.distinct]
    shown = _first_spellings(data, [c.index for c in small])
    for c in prof.columns:
        keyish = c.type == "email" or re.search(ID_WORDS, c.name)
        found = []
        if keyish and c.non_empty >= 10 and c.distinct == c.non_empty >= 0.9 * prof.rows:
            found.append(Constraint("unique", c.name))
        if c in small:
            found.append(Constraint("allowed-values", c.name, values=shown.get(c.index, ())))
        if keyish and c.empty == 0 and c.non_empty >= 10:
            found.append(Constraint("not-null", c.name))
        for x in found:
            if (x.kind, x.column) not in have:
                have.add((x.kind, x.column))
                out.append(x)
    return out[:most]


def _first_spellings(data: Dataset, columns: list[int]) -> dict[int, tuple[str, ...]]:
    """For columns of a few values, each value as first written, in order of first sight. One job."""
    if not columns:
        return {}
    cells = F.array(*[F.when(~is_missing(data.text(i)), F.struct(F.lit(i).alias("at"), strip(data.text(i)).alias("v"))) for i in columns])
    long = data.df.select(ROW, F.inline(F.filter(cells, lambda x: x.isNotNull())))
    first = long.groupBy("at", F.lower("v").alias("k")).agg(F.min_by("v", ROW).alias("v"), F.min(ROW).alias("first"))
    # six rows a column at most, as their profiles say
    out: dict[int, tuple[str, ...]] = {}
    for r in sorted(first.collect(), key=lambda r: (r["at"], r["first"])):
        out[r["at"]] = (*out.get(r["at"], ()), r["v"])
    return out
