"""Cell rules: for each column, what a rule would write (a fix) or what it only reports (a flag), as Column expressions.

All rules read the original table. A Fix has a hit and a new value; fixes are ordered, and the last one that hits a cell wins.
Rules that need a vote of the column (casing, spellings, yes/no words) first find winners in one long-form aggregate.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tabloom.dataset import ROW, Dataset, cut, dense
from tabloom.functions import domain as D
from tabloom.functions import text as X
from tabloom.operators.components import components, contracted
from tabloom.operators.profile import Profile, values_of

#: Distinct values from which on a column is free text for the spelling rule.
MOST_DISTINCT = 1000
ORDER = ["header-hygiene", "fix-encoding", "trim-whitespace", "remove-duplicate-rows", "normalize-missing", "consistent-casing", "standardise-values", "normalize-date", "normalize-number", "normalize-boolean", "normalize-email", "normalize-phone", "normalize-postcode", "normalize-vat", "normalize-sort-code", "normalize-company-number"]


@dataclass(frozen=True)
class Fix:
    rule: str
    column: int
    hit: Column
    after: Column  # text, or null to blank the cell
    confidence: Column
    severity: str = "warning"
    reason: str = ""


@dataclass(frozen=True)
class Flag:
    rule: str
    column: int
    hit: Column
    severity: str


def order_of(rule: str) -> int:
    return ORDER.index(rule)


def headers(names: tuple[str, ...]) -> list[str]:
    """Cleaned header names; later repeats, whatever their case, get a running number."""
    seen: dict[str, int] = {}
    out = []
    for i, h in enumerate(names):
        x = re.sub(r"\s+", " ", re.sub("[​‌‍﻿]", "", h)).strip() or f"Column {i + 1}"
        k = seen[x.lower()] = seen.get(x.lower(), 0) + 1
        out.append(x if k == 1 else f"{x} ({k})")
    return out


def _spellings(values: DataFrame, families: list[tuple[str, list[int], object]]) -> DataFrame:
    """(name, text, key, variant, n, first) of the distinct texts that vote; families: (name, columns, key of a text)."""
    used = sorted({i for _, columns, _ in families for i in columns})
    # cleaned once a distinct text; a key reads the cleaned text, which cleaning leaves as it is
    texts = values.filter(F.col("at").isin(used) & ~X.is_missing(F.col("text"))).withColumn("variant", X.clean_space(F.col("text")))
    votes = [texts.filter(F.col("at").isin(columns)).select(F.concat(F.lit(family), "at").alias("name"), "at", "text", key(F.col("variant")).alias("key"), "variant", "n", "first") for family, columns, key in families if columns]
    return reduce(DataFrame.unionByName, votes)


def _cells(data: Dataset, columns: list[int]) -> DataFrame:
    """(_row, at, text) of all cells of the columns."""
    return data.df.select(ROW, F.inline(F.array(*[F.struct(F.lit(i).alias("at"), data.text(i).alias("text")) for i in columns])))


def case_quality(x: Column) -> Column:
    upper, lower = x.rlike(r"\p{Lu}"), x.rlike(r"\p{Ll}")
    return F.when(upper & lower, 2).when(upper, 1).otherwise(0)


def winners(values: DataFrame, case: list[int], value: list[int]) -> DataFrame | None:
    """(at, text, w) of the distinct texts that should be spelled otherwise; w: pairs of "case" or "value" with the column's number, and the spelling.

    Of each key (case: the text in lower case; value: its fingerprint) the commonest variant wins; ties by casing, then by first row. Long
    form for all columns: one aggregate with map-side combine and one join on keys that have several variants."""
    families = [("case", case, lambda t: F.lower(X.clean_space(t))), ("value", value, X.fingerprint)]
    if not case and not value:
        return None
    votes = cut(_spellings(values, families).filter("key <> ''"))
    counts = votes.groupBy("name", "key", "variant").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    quality = F.when(F.col("name").startswith("case"), case_quality(F.col("variant"))).otherwise(0)
    best = F.max_by("variant", F.struct("n", quality.alias("q"), (-F.col("first")).alias("f")))
    won = counts.groupBy("name", "key").agg(best.alias("winner"), F.count(F.lit(1)).alias("variants"), F.min(F.lower("variant")).alias("lo"), F.max(F.lower("variant")).alias("hi"))
    # variants that differ in case alone are no matter for the value family
    won = won.filter((F.col("name").startswith("case") & (F.col("variants") > 1)) | (F.col("name").startswith("value") & (F.col("lo") < F.col("hi")))).select("name", "key", "winner")
    return cut(votes.join(won, ["name", "key"]).filter("variant <> winner").groupBy("at", "text").agg(F.collect_list(F.struct("name", "winner")).alias("w")))


def with_winners(data: Dataset, other: DataFrame | None, columns: list[int]) -> DataFrame:
    """The table with _win, a map from "case" or "value" and a column's number to the spelling that this row's cell should have."""
    if other is None:
        return data.df
    cells = _cells(data, columns).join(other, ["at", "text"])
    return data.df.join(cells.groupBy(ROW).agg(F.map_from_entries(F.flatten(F.collect_list("w"))).alias("_win")), ROW, "left")


def boolean_winners(values: DataFrame, columns: list[int]) -> dict[int, tuple[str, str]]:
    """The spelling of true and of false that each column uses most; words before digits on equal counts."""
    if not columns:
        return {}
    long = values.filter(F.col("at").isin(columns)).select("at", X.clean_space(F.col("text")).alias("v"), "n", "first")
    kind = F.when(F.lower("v").isin([*D.TRUE_WORDS, "1"]), "true").when(F.lower("v").isin([*D.FALSE_WORDS, "0"]), "false")
    counts = long.withColumn("kind", kind).filter("kind is not null").groupBy("at", "kind", "v").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    best = counts.groupBy("at", "kind").agg(F.max_by("v", F.struct("n", F.col("v").rlike("[A-Za-z]"), -F.col("first"))).alias("v"))
    got = {(r["at"], r["kind"]): r["v"] for r in best.collect()}  # two rows a column
    return {i: (got.get((i, "true"), "Yes"), got.get((i, "false"), "No")) for i in columns}


def named(name: str, pattern: str) -> bool:
    return bool(re.search(pattern, name, re.I))


@dataclass(frozen=True)
class Rules:
    """Every fix and flag that the columns' gates let through, and what these read."""

    data: Dataset
    fixes: list[Fix]
    flags: list[Flag]
    held: list[dict[str, tuple[int, Column]]]  # working columns, and whose they are, in the order of what reads what
    wordy: list[int]  # columns that winners() read
    other: DataFrame | None  # of winners()

    def wide(self) -> Dataset:
        """The table with the working columns."""
        df = with_winners(self.data, self.other, self.wordy)
        for level in self.held:
            df = df.withColumns({k: c for k, (_, c) in level.items()}) if level else df
        return Dataset(df, self.data.headers, self.data.ragged_rows, self.data.kinds, self.data.plain)

    def counts(self, values: DataFrame) -> tuple[list[int], list[int]]:
        """How many cells each fix and each flag hits: a cell's text tells, so each distinct text of values_of() is looked at once, a job a column.

        Columns of kinds whose text is not read back as itself (doubles, times, nested) are counted by their rows."""
        hits = [(f.column, f.hit, f"f{k}") for k, f in enumerate(self.fixes)] + [(g.column, g.hit, f"g{k}") for k, g in enumerate(self.flags)]
        got: dict[str, int] = {}
        for i in sorted({i for i, _, _ in hits}):
            if isinstance(self.data.kinds[i], (T.StringType, T.IntegralType, T.BooleanType, T.DecimalType)):
                df = values.filter(F.col("at") == i).select("text", "n")
                if self.other is not None and i in self.wordy:
                    df = df.join(self.other.filter(F.col("at") == i).select("text", F.map_from_entries("w").alias("_win")), "text", "left")
                df = df.withColumnRenamed("text", f"c{i}")
                for level in self.held:
                    mine = {k: c for k, (at, c) in level.items() if at == i}
                    df = df.withColumns(mine) if mine else df
            else:
                df = self.wide().df.withColumn("n", F.lit(1))
            row = df.agg(*[F.sum(F.when(hit, F.col("n")).otherwise(0)).alias(name) for at, hit, name in hits if at == i]).first()
            got |= {k: v or 0 for k, v in row.asDict().items()}
        return [got[f"f{k}"] for k in range(len(self.fixes))], [got[f"g{k}"] for k in range(len(self.flags))]


def build(data: Dataset, prof: Profile, disabled: frozenset[str] = frozenset(), date_order: str = "auto", date_style: str = "iso") -> tuple[Dataset, list[Fix], list[Flag]]:
    """The table with the winners it needs, and every fix and flag that its columns' gates let through."""
    rules = rules_of(data, prof, values_of(data), disabled, date_order, date_style)
    return rules.wide(), rules.fixes, rules.flags


def rules_of(data: Dataset, prof: Profile, values: DataFrame, disabled: frozenset[str] = frozenset(), date_order: str = "auto", date_style: str = "iso") -> Rules:
    """values: values_of(data)."""
    fixes: list[Fix] = []
    flags: list[Flag] = []
    one = F.lit
    strings = [c for c in prof.columns if data.is_string(c.index)]
    wordy = [c.index for c in strings if c.type in ("string", "mixed")]

    def on(rule: str) -> bool:
        return rule not in disabled

    case_at = wordy if on("consistent-casing") else []
    value_at = [i for i in wordy if prof.columns[i].distinct <= MOST_DISTINCT] if on("standardise-values") else []
    won = winners(values, case_at, value_at)
    case_win = {i: F.element_at("_win", F.lit(f"case{i}")) for i in case_at}
    value_win = {i: F.element_at("_win", F.lit(f"value{i}")) for i in value_at}
    bool_at = [c.index for c in prof.columns if c.facts["bool_words"] and c.facts["present"] >= 3 and c.facts["bool_all"] >= 0.8 * c.facts["present"]] if on("normalize-boolean") else []
    spelled = boolean_winners(values, bool_at)

    # what several expressions read becomes a column of its own, so that it is worked out, and compiled, once
    held: list[dict[str, tuple[int, Column]]] = [{}, {}, {}]

    def hold(expr: Column, tag: str, i: int, level: int = 0) -> Column:
        """level: one more than that of what expr reads."""
        held[level][f"_h_{tag}_{i}"] = i, expr
        return F.col(f"_h_{tag}_{i}")

    for c in prof.columns:
        i, text, name = c.index, data.text(c.index), c.name
        string = data.is_string(i)
        present = hold(~X.is_empty(text), "present", i)
        tidy = hold(X.clean_space(text), "tidy", i)
        broken = F.lit(False)
        if string and on("fix-encoding"):
            fixed = hold(X.demojibake(text), "fixed", i)
            broken = present & (fixed != text)
            fixes.append(Fix("fix-encoding", i, broken, X.clean_space(fixed), one(0.95)))
        if string and on("trim-whitespace"):
            fixes.append(Fix("trim-whitespace", i, present & ~broken & (tidy != text), tidy, one(1.0)))
        if string and on("remove-blank-rows"):
            fixes.append(Fix("normalize-missing", i, X.is_sentinel(text), F.lit(None).cast("string"), one(0.9), "info"))
        usable = hold(~X.is_missing(text), "usable", i)
        if i in case_win:
            fixes.append(Fix("consistent-casing", i, F.coalesce(usable & (tidy != case_win[i]), one(False)), case_win[i], one(0.9)))
        if i in value_win:
            other = F.lower(tidy) != F.lower(value_win[i])
            fixes.append(Fix("standardise-values", i, F.coalesce(usable & other, one(False)), value_win[i], one(0.85)))
        if string and on("normalize-date") and (c.type == "date" or (named(name, "date|dob|created|updated|joined") and c.facts["dates"])):
            dmy, mdy = c.facts["dmy"], c.facts["mdy"]
            mixed = date_order == "auto" and dmy > 0 and mdy > 0
            order = date_order if date_order != "auto" else "MDY" if mdy > dmy else "DMY"
            got = hold(D.parse_parts(hold(D.date_parts(text), "parts", i), order), "date", i, 1)
            ok = got["date"].isNotNull()
            unsure = got["ambiguous"] if mixed else one(False)
            after = hold(D.show_date(got["date"], date_style), "shown", i, 2)
            sure = F.when(got["swapped"], 0.7).when(got["converted"], 0.9).when(got["ambiguous"], 0.75).otherwise(0.98)
            fixes.append(Fix("normalize-date", i, F.coalesce(present & ok & ~unsure & (after != text), one(False)), after, sure))
            flags.append(Flag("impossible-date", i, present & ~ok, "error"))
            if mixed:
                flags.append(Flag("ambiguous-date", i, F.coalesce(present & ok & unsure, one(False)), "warning"))
        if string and on("normalize-number") and c.facts["present"] >= 3 and c.facts["numeric"] >= 0.7 * c.facts["present"]:
            digits = hold(X.plain_number(tidy), "plain", i, 1)
            fixes.append(Fix("normalize-number", i, digits.isNotNull(), digits, one(0.92)))
        if i in spelled:
            word = F.lower(tidy)
            target = F.when(word.isin([*D.TRUE_WORDS, "1"]), spelled[i][0]).when(word.isin([*D.FALSE_WORDS, "0"]), spelled[i][1])
            if string:
                fixes.append(Fix("normalize-boolean", i, F.coalesce(target != tidy, one(False)), target, one(0.9)))

        def pair(rule: str, gate: bool, normal, confidence: float) -> None:
            if gate and on(f"normalize-{rule}"):
                value = hold(normal(text), rule.replace("-", "_"), i)
                extra = text.rlike(r"\d") if rule == "phone" else one(True)
                fixes.append(Fix(f"normalize-{rule}", i, F.coalesce(present & extra & (value != text), one(False)), value, one(confidence)))
                flags.append(Flag(f"invalid-{rule}", i, present & extra & value.isNull(), "error"))

        pair("email", string and (c.type == "email" or named(name, "e-?mail")), D.normal_email, 0.95)
        pair("phone", c.type == "phone" or named(name, "phone|mobile|tel|contact no"), D.normal_phone, 0.9)
        pair("postcode", string and (c.type == "postcode" or named(name, r"post\s*code|postal")), D.normal_postcode, 1.0)
        pair("vat", named(name, r"\bvat\b|vat"), D.normal_vat, 1.0)
        pair("sort-code", named(name, r"sort[\s_-]*code"), D.normal_sort_code, 1.0)
        pair("company-number", named(name, r"company[\s_-]*(no|number|reg)|\bcrn\b"), D.normal_company, 1.0)
    return Rules(data, fixes, flags, held, sorted({*case_at, *value_at}), won)


def patches(data: Dataset, fixes: list[Fix]) -> DataFrame:
    """(rule, rule_order, _row, column, before, after, confidence): one row per fix that hits a cell."""
    cells = [
        F.when(f.hit, F.struct(F.lit(f.rule).alias("rule"), F.lit(order_of(f.rule)).alias("rule_order"), F.lit(f.column).alias("column"), data.text(f.column).alias("before"), f.after.alias("after"), f.confidence.cast("double").alias("confidence")))
        for f in fixes
    ]
    if not cells:
        return data.df.sparkSession.createDataFrame([], f"{ROW} long, rule string, rule_order int, column int, before string, after string, confidence double")
    return data.df.select(ROW, F.inline(F.filter(F.array(*cells), lambda x: x.isNotNull())))


def apply(data: Dataset, fixes: list[Fix], skip: frozenset[str] = frozenset()) -> Dataset:
    """All accepted fixes in one projection; of several that hit a cell the last in rule order wins."""
    cols = []
    for i in range(len(data)):
        mine = sorted((f for f in fixes if f.column == i and f.rule not in skip), key=lambda f: -order_of(f.rule))
        out = None
        for f in mine:
            out = F.when(f.hit, f.after) if out is None else out.when(f.hit, f.after)
        kept = F.when(data.col(i).isNotNull(), data.text(i))
        cols.append((data.col(i) if out is None else out.otherwise(kept)).alias(f"c{i}"))
    return Dataset(data.df.select(*cols, ROW), data.headers, data.ragged_rows)


def apply_patches(data: Dataset, accepted: DataFrame) -> Dataset:
    """A chosen subset of patches: per cell the last in rule order, joined to the rows once."""
    last = accepted.groupBy(ROW, "column").agg(F.max_by(F.struct("after"), "rule_order").alias("x"))
    packed = last.groupBy(ROW).agg(F.map_from_entries(F.collect_list(F.struct("column", F.col("x.after").alias("after")))).alias("_p"))
    joined = data.df.join(packed, ROW, "left")
    cols = []
    for i in range(len(data)):
        kept = F.when(data.col(i).isNotNull(), data.text(i))
        cols.append(F.when(F.coalesce(F.map_contains_key("_p", F.lit(i)), F.lit(False)), F.element_at("_p", F.lit(i))).otherwise(kept).alias(f"c{i}"))
    return Dataset(joined.select(*cols, ROW), data.headers, data.ragged_rows)


def duplicates(data: Dataset, key: list[str] | None = None) -> DataFrame:
    """(_row, duplicate_of): rows whose cleaned, lower-case key cells equal an earlier row's; all-blank keys never count.

    Grouped minimum and join back, so that a row repeated a million times is no hot window."""
    at = [i for i in (data.index(k) for k in key or data.headers) if i is not None] or list(range(len(data)))
    cells = [F.lower(X.clean_space(data.text(i))) for i in at]
    k = F.sha2(F.encode(F.to_json(F.array(*cells)), "UTF-8"), 256)
    # written once, since grouping and join back would each clean all cells
    rows = cut(data.df.select(ROW, k.alias("k"), (F.concat(*cells) == "").alias("blank")))
    first = rows.groupBy("k").agg(F.min(ROW).alias("duplicate_of"), F.count(F.lit(1)).alias("n"), F.max("blank").alias("blank"))
    first = first.filter("n > 1 and not blank").select("k", "duplicate_of")
    return rows.select(ROW, "k").join(first, "k").filter(F.col(ROW) > F.col("duplicate_of")).select(ROW, "duplicate_of")


def blank_rows(data: Dataset) -> DataFrame:
    return data.df.filter(_all_blank(data, range(len(data)))).select(ROW)


def _all_blank(data: Dataset, columns) -> Column:
    blank = F.lit(True)
    for i in columns:
        blank = blank & X.is_empty(data.text(i))
    return blank


def outliers(data: Dataset, i: int) -> dict | None:
    """outliers_of() of one column."""
    return outliers_of(data, [i])[i]


def outliers_of(data: Dataset, columns: list[int]) -> dict[int, dict | None]:
    """Of each column, values outside the fence of three interquartile ranges, quartiles as elements of the sorted values at floor((n-1)p).

    On a log10 scale where all are positive and the mean is over 1.5 times the lower median. Long form, for all columns in a few jobs."""
    placeholders = [9999, 99999, 999999, 9999999, 99999999, -1, -99, -999, -9999]  # fixed values
    out: dict[int, dict | None] = dict.fromkeys(columns)
    if not columns:
        return out
    at, x = F.col("at"), F.col("x")
    numbers = [F.struct(F.lit(i).alias("at"), (X.display_number(data.text(i)) if data.is_string(i) else data.col(i).cast("double")).alias("x")) for i in columns]
    # written once; a filter before that would reach the scan with x spelled out again
    counts = cut(data.df.select(F.inline(F.array(*numbers))).groupBy("at", "x").agg(F.count(F.lit(1)).alias("n"))).filter("x is not null")
    sums = counts.groupBy("at").agg(F.sum("n").alias("n"), F.min("x").alias("low"), (F.sum(x * F.col("n")) / F.sum("n")).alias("mean"), F.percentile_approx("x", [k / 32 for k in range(1, 32)], 1000).alias("edges"))
    facts = {r["at"]: r for r in sums.collect() if r["n"] >= 8}
    if not facts:
        return out
    counts = counts.filter(at.isin(list(facts)))

    def each(of) -> Column:
        """of(column's number) where a row is of that column."""
        value = None
        for k in facts:
            value = F.when(at == k, of(k)) if value is None else value.when(at == k, of(k))
        return value

    # ranks of values: within ranges of values first, then shifted by the counts before, so that no task sorts all values
    upto = F.sum("n").over(W.partitionBy("at", "s").orderBy("x").rowsBetween(W.unboundedPreceding, 0))
    edges = each(lambda k: F.array(*[F.lit(float(e)) for e in sorted(set(facts[k]["edges"]))]))
    local = cut(counts.withColumn("s", F.size(F.filter(edges, lambda e: e < x))).withColumn("upto", upto))
    before: dict[int, dict[int, int]] = {k: {} for k in facts}
    total = dict.fromkeys(facts, 0)
    for r in sorted(local.groupBy("at", "s").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["s"]):
        before[r["at"]][r["s"]] = total[r["at"]]
        total[r["at"]] += r["n"]

    def reached(k: int, p: float) -> Column:
        rank = int((facts[k]["n"] - 1) * p)
        s = max((s for s in before[k] if before[k][s] <= rank), default=0)
        return (F.col("s") == s) & (F.col("upto") + before[k][s] > rank)

    elements = {p: F.min(F.when(each(lambda k, p=p: reached(k, p)), x)) for p in (0.25, 0.5, 0.75)}
    quartiles = {r["at"]: tuple(r)[1:] for r in local.groupBy("at").agg(*elements.values()).collect()}
    fences = {}
    for k, (q1, mid, q3) in quartiles.items():
        log = facts[k]["low"] > 0 and mid > 0 and facts[k]["mean"] > 1.5 * mid
        a, b = (math.log10(q1), math.log10(q3)) if log else (q1, q3)
        if b > a:
            fences[k] = log, a - 3 * (b - a), b + 3 * (b - a)
    if not fences:
        return out
    y = F.when(at.isin([k for k in fences if fences[k][0]]), F.log10("x")).otherwise(x)
    facts = {k: facts[k] for k in fences}
    outside = counts.filter(at.isin(list(fences))).filter((y < each(lambda k: F.lit(fences[k][1]))) | (y > each(lambda k: F.lit(fences[k][2]))))
    fake = F.abs("x").isin([float(p) for p in placeholders if p > 0]) & (x > 0) | x.isin([float(p) for p in placeholders if p < 0])
    found = {r["at"]: r for r in outside.groupBy("at").agg(F.sum(F.when(fake, F.col("n")).otherwise(0)).alias("placeholder"), F.sum(F.when(~fake, F.col("n")).otherwise(0)).alias("genuine")).collect()}
    for k, (log, _, _) in fences.items():
        n, (q1, mid, q3) = facts[k]["n"], quartiles[k]
        placeholder, genuine = (found[k]["placeholder"], found[k]["genuine"]) if k in found else (0, 0)
        out[k] = {"n": n, "q1": q1, "median": mid, "q3": q3, "placeholder": placeholder, "genuine": genuine if genuine <= max(2, 0.1 * n) else 0, "log": log}
    return out


def dependencies(data: Dataset, prof: Profile) -> DataFrame:
    """(a, b, supported, paired, violations) of ordered column pairs where a nearly determines b. One long-form job.

    Candidates: up to 12 columns with 2 to 500 distinct values, half filled, two filled rows a value. Of 20 or more rows with both values,
    half must be in groups of 3 or more; in a group where 80 % agree the rest are violations, at most 5 % of all."""
    good = [c for c in prof.columns if 2 <= c.distinct <= 500 and c.non_empty >= 0.5 * prof.rows and c.non_empty >= 2 * c.distinct][:12]
    pairs = [(p, q) for p in good for q in good if p.index != q.index and (p.distinct > q.distinct or (p.distinct == q.distinct and p.index < q.index))]
    schema = "a string, b string, supported long, paired long, violations long"
    if prof.rows < 20 or not pairs:
        return data.df.sparkSession.createDataFrame([], schema)
    norm = {c.index: F.when(~X.is_empty(data.text(c.index)), F.lower(X.clean_space(data.text(c.index)))) for c in good}
    df = data.df.select(*[norm[i].alias(f"v{i}") for i in norm])
    cells = F.array(*[F.when(F.col(f"v{p.index}").isNotNull() & F.col(f"v{q.index}").isNotNull(), F.struct(F.lit(k).alias("pair"), F.col(f"v{p.index}").alias("x"), F.col(f"v{q.index}").alias("y"))) for k, (p, q) in enumerate(pairs)])
    counts = df.select(F.inline(F.filter(cells, lambda x: x.isNotNull()))).groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy("pair", "x").agg(F.sum("n").alias("total"), F.max("n").alias("top"))
    large = F.col("total") >= 3
    holds = large & (F.col("top") >= 0.8 * F.col("total"))
    sums = groups.groupBy("pair").agg(F.sum(F.when(large, F.col("total")).otherwise(0)).alias("supported"), F.sum("total").alias("paired"), F.sum(F.when(holds, F.col("total") - F.col("top")).otherwise(0)).alias("violations"))
    sums = sums.filter("paired >= 20 and supported >= 0.5 * paired and violations > 0 and violations <= 0.05 * paired")
    names = F.array(*[F.struct(F.lit(p.name).alias("a"), F.lit(q.name).alias("b")) for p, q in pairs])
    return sums.select(F.get(names, "pair").alias("p"), "supported", "paired", "violations").select("p.a", "p.b", "supported", "paired", "violations")


# Fixed value: words in headers that tell identifiers.
ID_WORDS = r"(?i)(^|[^a-z])(id|ids|uid|ref|reference|code|sku|key|account|acct|no|number)([^a-z]|$)"
#: Rows of a sorted order that one task holds against their neighbours.
STRETCH = 100_000


def identifiers(data: Dataset, prof: Profile | None = None) -> list[int]:
    """Columns that tell rows apart: nearly distinct ones with 10 values or more, and distinct ones that are named so.

    Of filled values, as the profile counts them; without one, in one long-form job."""
    if prof is not None:
        sizes = [(c.index, c.distinct, c.non_empty) for c in prof.columns if c.non_empty]
    else:
        string = F.col("at").isin([i for i in range(len(data)) if data.is_string(i)])
        cells = _cells(data, list(range(len(data)))).select("at", F.lower(X.strip(F.col("text"))).alias("v"))
        counts = cells.groupBy("at", "v").agg(F.count(F.lit(1)).alias("n")).filter((F.col("v") != "") & ~(string & F.col("v").isin(X.SENTINELS)))
        sizes = counts.groupBy("at").agg(F.count(F.lit(1)), F.sum("n")).collect()
    return [i for i, distinct, filled in sizes if (filled >= 10 and distinct >= 0.9 * filled) or (distinct == filled and re.search(ID_WORDS, data.headers[i]))]


def near_duplicates(data: Dataset, key: list[str] | None = None, window: int = 8, most: int | None = None, all_pairs: int = 500, gone: DataFrame | None = None, prof: Profile | None = None) -> DataFrame:
    """(_row, cluster): clusters of rows that are no exact duplicates, with equal fingerprints or, but for identifiers and numbers, within the
    edit budget: among all pairs up to 500 distinct fingerprints, and among 8 neighbours in two sort orders beyond.

    most: distinct fingerprints from which on only equality counts; by default typos count at any size.
    gone, prof: duplicates(data, key) and the profile, where the caller has them."""
    gone = duplicates(data, key) if gone is None else gone
    rows = data.df.join(gone.select(ROW), ROW, "left_anti")
    named_key = [i for i in (data.index(k) for k in key or []) if i is not None]
    if named_key:
        rows = rows.filter(~_all_blank(data, named_key))
    told = set(identifiers(data, prof))

    def cells(columns) -> Column:
        return F.concat_ws(" ", *[F.when(~X.is_sentinel(data.text(i)), data.text(i)) if data.is_string(i) else data.text(i) for i in columns])

    # each cell is read once, for its own part; in sorted order the parts give the fingerprint of the whole
    parts = rows.select(ROW, X.tokens(cells(sorted(told))).alias("ids"), X.tokens(cells(i for i in range(len(data)) if i not in told)).alias("rest"))
    full, context = X.in_order(F.concat_ws(" ", "ids", "rest")), X.in_order(X.lettered(F.col("rest")))
    # written once: the patterns run in no further job, and no condition on f reaches the scan
    marked = cut(parts.select(ROW, full.alias("f"), context.alias("ctx"))).filter("f <> ''")
    prints = cut(marked.groupBy("f").agg(F.min(ROW).alias("id"), F.min_by("ctx", ROW).alias("ctx")))
    distinct = prints.count()
    members = marked.select(ROW, "f").join(prints.select("f", "id"), "f").select(ROW, "id")
    # without 6 letters there is nothing to call a typo, and equal contexts differ in identifiers alone
    able = prints.select("id", "ctx").filter(F.char_length("ctx") >= 6)
    if most is not None and distinct > most:
        near = able.select("id", F.struct("id", "ctx").alias("o"), "ctx").limit(0)
    elif distinct <= all_pairs:
        other = able.select(F.struct("id", "ctx").alias("o"))
        near = able.join(F.broadcast(other), F.col("id") < F.col("o.id"))
    else:
        # neighbours are those among all fingerprints, the short ones too
        every = prints.select("id", "ctx")
        near = _neighbours(every, F.col("ctx"), window).unionByName(_neighbours(every, F.reverse("ctx"), window))
    short = F.least(F.char_length("ctx"), F.char_length("o.ctx"))
    # -1, for more than 3, becomes 99, so that the distance is worked out once
    typo = (short >= 6) & (F.col("ctx") != F.col("o.ctx")) & (F.pmod(F.levenshtein("ctx", "o.ctx", 3), F.lit(100)) <= X.edit_budget(short))
    # neighbours link in long chains: each task hands on a star for each of its own, so that components settles in few rounds
    links = contracted(near.filter(typo).select(F.col("id").alias("a"), F.col("o.id").alias("b")))
    joined = members.join(components(links).select(F.col("node").alias("id"), "root"), "id", "left").select(ROW, F.coalesce("root", "id").alias("cluster"))
    big = joined.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cluster")
    return joined.join(big, "cluster").select(ROW, "cluster")


def _neighbours(prints: DataFrame, order: Column, window: int) -> DataFrame:
    """(id, ctx, o): each row with each of the `window` rows that follow it in the order.

    Rows get their dense place; a task holds a stretch of places and the first rows of the next."""
    placed = dense(prints.select("id", "ctx", order.alias("_k")), "_k", "id").select("id", "ctx", F.col(ROW).alias("p"))
    own = F.floor(F.col("p") / STRETCH)
    # the first rows of a stretch are also guests at the end of the one before
    homes = F.when((F.col("p") % STRETCH < window) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = placed.select("id", "ctx", "p", own.alias("own"), F.explode(homes).alias("stretch"))
    w = W.partitionBy("stretch").orderBy("p").rowsBetween(1, window)
    follow = dealt.withColumn("next", F.collect_list(F.struct("id", "ctx")).over(w)).filter("own = stretch")
    return follow.select("id", "ctx", F.explode("next").alias("o"))
