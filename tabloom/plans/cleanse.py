"""The whole analysis: profile, findings, patches, score, cleaned table, and the score that the cleaned table would have."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.dataset import ROW, Dataset, cut, spread
from tabloom.functions import domain as D
from tabloom.functions import text as X
from tabloom.operators import rules as R
from tabloom.operators.constraints import Constraint, check
from tabloom.operators.personal import personal_columns
from tabloom.operators.profile import Profile, profile, values_of
from tabloom.plans.score import Finding, Score, score_table


@dataclass(frozen=True)
class Options:
    date_order: str = "auto"
    date_style: str = "iso"
    disabled: frozenset[str] = frozenset()
    constraints: tuple[Constraint, ...] = ()
    dedupe_key: tuple[str, ...] = ()
    projection: bool = True


@dataclass(frozen=True)
class Result:
    data: Dataset
    profile: Profile
    findings: tuple[Finding, ...]
    fixes: tuple[R.Fix, ...]
    score: Score
    projected: Score | None
    options: Options = field(default_factory=Options)

    def patches(self) -> DataFrame:
        """Cell patches in long form."""
        return R.patches(self.data, list(self.fixes))

    def removals(self) -> DataFrame:
        """(_row, rule, duplicate_of) of rows to remove."""
        return _removals(self.data, self.options)

    def cleaned(self, skip: frozenset[str] = frozenset()) -> Dataset:
        return cleaned(self.data, list(self.fixes), self.options, skip)


def _removals(data: Dataset, options: Options) -> DataFrame:
    data = data.plain
    none = data.df.select(ROW, F.lit("").alias("rule"), F.lit(None).cast("long").alias("duplicate_of")).limit(0)
    out = none
    if "remove-duplicate-rows" not in options.disabled:
        dup = R.duplicates(data, list(options.dedupe_key) or None)
        out = out.unionByName(dup.select(ROW, F.lit("remove-duplicate-rows").alias("rule"), "duplicate_of"))
    if "remove-blank-rows" not in options.disabled:
        out = out.unionByName(R.blank_rows(data).select(ROW, F.lit("remove-blank-rows").alias("rule"), F.lit(None).cast("long").alias("duplicate_of")))
    return out


def cleaned(data: Dataset, fixes: list[R.Fix], options: Options, skip: frozenset[str] = frozenset()) -> Dataset:
    out = R.apply(data, fixes, skip)
    gone = _removals(data, options).filter(~F.col("rule").isin(list(skip))) if skip else _removals(data, options)
    out = Dataset(out.df.join(gone.select(ROW).distinct(), ROW, "left_anti"), out.headers, 0, out.kinds)
    names = R.headers(data.headers) if "header-hygiene" not in options.disabled | skip else list(data.headers)
    return Dataset(out.df, tuple(names), 0, out.kinds)


def analyse(data: Dataset, options: Options) -> tuple[Dataset, Profile, list[R.Fix], list[Finding]]:
    """All findings: the profile, the counts of fixes and flags, the counts of removals, and the advisories.

    The table is written once, and so are its distinct texts, a column each: profile, votes and counts read these alone."""
    data = Dataset(spread(data.plain.df), data.headers, data.ragged_rows, data.kinds)
    values = values_of(data).persist()
    prof = profile(data, samples=False, values=values)
    found: list[Finding] = []
    if data.ragged_rows:
        found.append(Finding("ragged-rows", "warning", data.ragged_rows, "Rows with another number of fields than the header"))
    tidy = R.headers(data.headers)
    if "header-hygiene" not in options.disabled and (n := sum(a != b for a, b in zip(tidy, data.headers))):
        found.append(Finding("header-hygiene", "warning", n, "Headers with stray space or repeats", fixable=True))
    rules = R.rules_of(data, prof, values, options.disabled, options.date_order, options.date_style)
    fixed, flagged = rules.counts(values)
    values.unpersist()
    by_rule: dict[tuple[str, str, bool], int] = {}
    for f, n in zip(rules.fixes, fixed):
        by_rule[f.rule, f.severity, True] = by_rule.get((f.rule, f.severity, True), 0) + n
    for g, n in zip(rules.flags, flagged):
        by_rule[g.rule, g.severity, False] = by_rule.get((g.rule, g.severity, False), 0) + n
    repeats = None
    if "remove-duplicate-rows" not in options.disabled:
        repeats = cut(R.duplicates(data, list(options.dedupe_key) or None))
        by_rule["remove-duplicate-rows", "error", True] = repeats.count()
    if "remove-blank-rows" not in options.disabled:
        by_rule["remove-blank-rows", "warning", True] = prof.blank_rows
    found += [Finding(rule, severity, n, rule.replace("-", " "), fixable=fix) for (rule, severity, fix), n in by_rule.items() if n]
    found += _advisories(data, prof, options, repeats)
    found += check(data, options.constraints)
    return rules.wide(), prof, rules.fixes, found


def _advisories(data: Dataset, prof: Profile, options: Options, repeats: DataFrame | None) -> list[Finding]:
    """repeats: the exact duplicates, where that rule is on."""
    out: list[Finding] = []
    rows = prof.rows - prof.blank_rows
    numeric = [c.index for c in prof.columns if c.type in ("number", "mixed") and c.facts["numbers"] >= max(8, 0.9 * c.non_empty)]
    fences = R.outliers_of(data, numeric) if "suspect-leading-zeros" not in options.disabled else {}
    for c in prof.columns:
        gaps = c.empty - prof.blank_rows
        if "remove-blank-rows" not in options.disabled and c.non_empty and rows and gaps >= 0.05 * rows:
            pct = int(100 * gaps / rows + 0.5)
            out.append(Finding("missing-values", "error" if pct >= 25 else "warning", gaps, f"{c.name}: {pct} % missing", column=c.name))
        idish = R.named(c.name, r"(^|[^a-z])(id|ids|ref|reference|code|sku|account|acct|no|number|barcode|ean|upc)([^a-z]|$)")
        if "suspect-leading-zeros" not in options.disabled:
            if idish and c.non_empty >= 4 and c.facts["digits"] >= 0.6 * c.non_empty and c.facts["zero_len"]:
                short = data.df.agg(F.count_if(X.strip(data.text(c.index)).rlike(r"^\d+$") & (F.char_length(X.strip(data.text(c.index))) < c.facts["zero_len"]))).first()[0]
                if short:
                    out.append(Finding("suspect-leading-zeros", "warning", short, f"{c.name}: lost zeros", column=c.name))
            if got := fences.get(c.index):
                if got["placeholder"]:
                    out.append(Finding("numeric-outliers", "warning", got["placeholder"], f"{c.name}: placeholder numbers", column=c.name))
                if got["genuine"]:
                    out.append(Finding("numeric-outliers", "info", got["genuine"], f"{c.name}: outliers", column=c.name))
            if c.type in ("string", "mixed") and c.non_empty >= 4 and 1 <= c.facts["excel_date"] <= 0.2 * c.non_empty:
                out.append(Finding("excel-date-artifact", "warning", c.facts["excel_date"], f"{c.name}: turned into dates", column=c.name))
            if c.type in ("string", "mixed", "number") and idish and c.non_empty >= 4 and c.facts["excel_power"]:
                out.append(Finding("excel-scientific-notation", "warning", c.facts["excel_power"], f"{c.name}: scientific notation", column=c.name))
    if "pii-present" not in options.disabled and (held := personal_columns(data, prof)):
        said = "; ".join(f"{label} ({', '.join(n for n in held if held[n] == label)})" for label in dict.fromkeys(held.values()))
        out.append(Finding("pii-present", "info", len(held), f"Personal data in {len(held)} column(s): {said}"))
    if "inconsistent-mapping" not in options.disabled:
        n = sum(r.violations for r in R.dependencies(data, prof).collect())
        if n:
            out.append(Finding("inconsistent-mapping", "warning", n, "Values that break a mapping between columns"))
    if "remove-duplicate-rows" not in options.disabled:
        near = R.near_duplicates(data, list(options.dedupe_key) or None, gone=repeats, prof=prof)
        n = near.agg(F.count(F.lit(1)) - F.count_distinct("cluster")).first()[0]
        if n:
            out.append(Finding("near-duplicate-rows", "warning", n, "Rows that nearly repeat another"))
    return out


def cleanse(data: Dataset, options: Options = Options()) -> Result:
    wide, prof, fixes, found = analyse(data, options)
    cells, rows = max(1, prof.rows * len(data)), max(1, prof.rows)
    score = score_table(found, cells, rows)
    projected = None
    if options.projection:
        after = cleaned(wide, fixes, options)
        again = Dataset(after.df.persist(), after.headers, 0, after.kinds)
        _, _, _, left = analyse(again, replace(options, projection=False))
        left += [f for f in found if f.rule == "ragged-rows"]
        projected = score_table(left, cells, rows)
        again.df.unpersist()
    return Result(wide, prof, tuple(found), tuple(fixes), score, projected, options)
