"""Command line: `clean FILE` repairs a table, `diff BEFORE AFTER` compares two.

    python -m tabloom clean data.csv --recipe r.json --join-with other.csv --out fixed.csv --report audit.md --min-score 90
    python -m tabloom diff before.csv after.csv --key id --fail-on-change

Exit code 0, or 1 for an empty table, a bad recipe, a score under --min-score, or a change under --fail-on-change."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict, replace

from pyspark.sql import SparkSession

from tabloom.dataset import Dataset
from tabloom.operators.diff import diff_tables
from tabloom.plans import recipe as P
from tabloom.plans.cleanse import Options, cleanse
from tabloom.sources import files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tabloom")
    commands = top.add_subparsers(dest="command", required=True)
    c = commands.add_parser("clean")
    c.add_argument("file")
    c.add_argument("--recipe")
    c.add_argument("--join-with")
    c.add_argument("--out", help="folder of CSV parts, TSV for .tsv and JSON lines for .json; in the shared store on a cluster")
    c.add_argument("--report", help="Markdown, or HTML for .html")
    c.add_argument("--min-score", type=int)
    c.add_argument("--json", action="store_true")
    c.add_argument("--limit", type=int)
    d = commands.add_parser("diff")
    d.add_argument("before")
    d.add_argument("after")
    d.add_argument("--key")
    d.add_argument("--json", action="store_true")
    d.add_argument("--fail-on-change", action="store_true")
    return top


def _save(data: Dataset, path: str) -> None:
    {"tsv": files.write_tsv, "json": files.write_json}.get(path.rsplit(".", 1)[-1].lower(), files.write_csv)(data, path)


def clean(spark: SparkSession, a: argparse.Namespace) -> int:
    data = files.load(spark, a.file, a.limit)
    if not len(data) or data.df.isEmpty():
        print("The table is empty", file=sys.stderr)
        return 1
    other = files.load(spark, a.join_with) if a.join_with else None
    # the residual score below stands in for a projection, which a recipe may still ask for
    plan = P.Recipe(Options(projection=False))
    if a.recipe:
        with open(a.recipe, encoding="utf-8") as f:
            plan = P.parse(f.read())
    elif other is not None:
        plan = replace(plan, join={"type": "left", "keys": None})
    result, done = P.run(data, plan, other)
    rep = P.report(result, frozenset(plan.skip))
    # read by many jobs from here on; kept on disk where memory ends, and worked out again where an executor is lost
    done = replace(done, df=done.df.persist())
    # the gate judges what is left in the result, by default options
    left = cleanse(done, Options(projection=False)).score
    rep["residual"] = asdict(left)
    print(f"Score {result.score.composite} -> {left.composite}; {rep['cells_changed']} cells changed, {rep['rows_removed']} rows removed", file=sys.stderr)
    if a.report:
        with open(a.report, "w", encoding="utf-8") as f:
            f.write(P.to_html(rep) if a.report.endswith(".html") else P.markdown(rep))
    if a.out:
        _save(done, a.out)
    done.df.unpersist()
    if a.json:
        print(json.dumps(rep))
    return int(a.min_score is not None and left.composite < a.min_score)


def diff(spark: SparkSession, a: argparse.Namespace) -> int:
    d = diff_tables(files.load(spark, a.before), files.load(spark, a.after), a.key)
    counts = d.counts()
    print(json.dumps({"key": d.key, **counts}) if a.json else ", ".join(f"{v} {k}" for k, v in counts.items()))
    return int(a.fail_on_change and any(v for k, v in counts.items() if k != "unchanged"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tabloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return {"clean": clean, "diff": diff}[a.command](spark, a)
    except (ValueError, OSError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
