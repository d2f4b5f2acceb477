"""Replayable recipes, plain-language instructions, and the audit report."""

from __future__ import annotations

import html
import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import functions as F

from tabloom.dataset import ROW, Dataset
from tabloom.operators.constraints import Constraint
from tabloom.operators.join import join_tables
from tabloom.plans.cleanse import Options, Result, cleanse

VERSION = 3


@dataclass(frozen=True)
class Recipe:
    options: Options = field(default_factory=Options)
    skip: tuple[str, ...] = ()
    join: dict | None = None  # {"type", "keys": [[left, right], ...]}
    name: str = ""
    version: int = VERSION

    def dumps(self) -> str:
        body = asdict(self)
        body["options"]["disabled"] = sorted(self.options.disabled)
        return json.dumps(body, indent=2)


def parse(text: str) -> Recipe:
    try:
        body = json.loads(text)
    except ValueError as e:
        raise ValueError("Not a recipe: no JSON") from e
    if not isinstance(body, dict) or not isinstance(body.get("version"), int):
        raise ValueError("Not a recipe")
    if body["version"] > VERSION:
        raise ValueError(f"The recipe has version {body['version']}; this reads up to {VERSION}")
    join = body.get("join")
    if join is not None and not (isinstance(join, dict) and join.get("type") in ("inner", "left", "full") and all(len(k) == 2 for k in join.get("keys") or [])):
        raise ValueError("The recipe's join can't be read")
    o = body.get("options") or {}
    rules = tuple(Constraint(**{**c, "values": tuple(c.get("values") or ())}) for c in o.get("constraints") or ())
    options = Options(o.get("date_order", "auto"), o.get("date_style", "iso"), frozenset(o.get("disabled") or ()), rules, tuple(o.get("dedupe_key") or ()), o.get("projection", True))
    return Recipe(options, tuple(body.get("skip") or ()), join, body.get("name", ""), body["version"])


def run(data: Dataset, recipe: Recipe, other: Dataset | None = None) -> tuple[Result, Dataset]:
    """Join, cleanse, accept all fixes whose rule isn't skipped, apply."""
    if recipe.join:
        if other is None:
            raise ValueError("The recipe joins a second table, and none was given")
        keys = [tuple(k) for k in recipe.join.get("keys") or []] or None
        data = join_tables(data, other, recipe.join["type"], keys).numbered()
    result = cleanse(data, recipe.options)
    return result, result.cleaned(frozenset(recipe.skip))


def report(result: Result, skip: frozenset[str] = frozenset()) -> dict:
    """Distinct cells and rows touched, counts per rule, and what is only reported."""
    p = result.patches().filter(~F.col("rule").isin(list(skip)))
    cells, rows = p.agg(F.count_distinct(ROW, "column"), F.count_distinct(ROW)).first()
    lines = [{"rule": r.rule, "count": r["count"]} for r in p.groupBy("rule").count().orderBy(F.desc("count"), "rule").collect()]
    removed = {r.rule: r["count"] for r in result.removals().filter(~F.col("rule").isin(list(skip))).groupBy("rule").count().collect()}
    lines += [{"rule": k, "count": v} for k, v in sorted(removed.items())]
    notes = [{"rule": f.rule, "severity": f.severity, "title": f.title, "count": f.count} for f in result.findings if not f.fixable and f.count]
    return {"cells_changed": cells, "rows_changed": rows, "rows_removed": sum(removed.values()), "lines": sorted(lines, key=lambda x: -x["count"]), "advisories": notes, "score": asdict(result.score), "projected": asdict(result.projected) if result.projected else None}


def markdown(rep: dict, title: str = "Data quality report") -> str:
    out = [f"# {title}", "", f"Score {rep['score']['composite']}" + (f" -> {rep['projected']['composite']}" if rep["projected"] else ""), "", f"{rep['cells_changed']} cells changed, {rep['rows_removed']} rows removed", "", "| Rule | Count |", "| --- | --- |"]
    out += [f"| {x['rule']} | {x['count']} |" for x in rep["lines"]]
    out += ["", "## To look at", ""] + [f"- {x['severity']}: {x['title']} ({x['count']})" for x in rep["advisories"]]
    return "\n".join(out) + "\n"


def to_html(rep: dict, title: str = "Data quality report") -> str:
    rows = "".join(f"<tr><td>{html.escape(x['rule'])}</td><td>{x['count']}</td></tr>" for x in rep["lines"])
    notes = "".join(f"<li>{html.escape(x['title'])} ({x['count']})</li>" for x in rep["advisories"])
    return f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><p>Score {rep['score']['composite']}</p><table>{rows}</table><ul>{notes}</ul>"


# Rules that words can switch off and the words that name them; words that negate; date styles and reading orders.
TOPICS = {
    "remove-duplicate-rows": r"\bduplicate|\bdupe|\bdedup",
    "consistent-casing": r"\bcas(e|ing)|capitali[sz]",
    "trim-whitespace": r"\bwhitespace|\bspaces?\b|\btrim",
    "remove-blank-rows": r"\bblank|\bempty rows?",
    "normalize-date": r"\bdates?\b",
    "normalize-number": r"\bnumbers?\b|\bnumeric",
    "normalize-email": r"\bemails?\b",
    "normalize-phone": r"\bphones?\b|\bmobiles?\b",
    "normalize-postcode": r"\bpost\s?codes?\b",
}
NEGATION = r"\b(don'?t|do not|never|no|without|keep|leave|ignore|skip|exclude|preserve|retain)\b"
STYLES = {"iso": r"\biso\b|yyyy-mm-dd|year first", "uk": r"\buk\b|dd/mm|british", "us": r"\bus\b|mm/dd|american"}
ORDERS = {"DMY": r"day[\s-]?first|dd/mm|d/m", "MDY": r"month[\s-]?first|mm/dd|m/d"}


def instruction(text: str) -> tuple[Options, list[str], list[str]]:
    """Options that a few plain words ask for, the clauses understood, and those that were not.

    "only" or "just" with a topic switches all other topics off. A clause that negates a topic switches it off. A date style needs "date" or
    "format" beside it (but for ISO), and a reading order a word like "read" or "treat": "US dates" is how dates are written, not read."""

    def said(pattern: str, where: str) -> bool:
        return bool(re.search(pattern, where, re.I))

    clauses = [c.strip() for c in re.split(r"[,;.\n]|\b(?:and|also|but)\b", text, flags=re.I) if c.strip()]
    wanted = {rule for rule, words in TOPICS.items() if said(words, text)}
    if wanted and said(r"\b(only|just)\b", text):
        return Options(disabled=frozenset(TOPICS.keys() - wanted)), clauses, []
    asked: dict[str, str] = {}
    disabled: set[str] = set()
    matched, rest = [], []
    for clause in clauses:
        styles = [k for k, words in STYLES.items() if said(words, clause) and (k == "iso" or said(r"\bdates?\b|format", clause))][:1]
        orders = [k for k, words in ORDERS.items() if said(words, clause) and said(r"\btreat|read|interpret|assume", clause)][:1]
        off = {rule for rule, words in TOPICS.items() if said(words, clause)} if said(NEGATION, clause) else set()
        asked |= {"date_style": k for k in styles} | {"date_order": k for k in orders}
        (matched if styles or orders or off - disabled else rest).append(clause)
        disabled |= off
    return Options(disabled=frozenset(disabled), **asked), matched, rest
