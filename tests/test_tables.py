import pytest
from pyspark.sql import functions as F

from tabloom.dataset import ROW, Dataset
from tabloom.functions import domain as D
from tabloom.functions import text as X
from tabloom.operators import reshape as S
from tabloom.operators.aggregate import Aggregation, group_by
from tabloom.operators.diff import diff_tables
from tabloom.operators.join import join_tables
from tabloom.operators.personal import personal_columns
from tabloom.operators.profile import profile
from tabloom.operators.rules import headers, near_duplicates
from tabloom.plans.cleanse import Options, cleanse
from tabloom.plans.recipe import Recipe, instruction, parse, report, run
from tabloom.plans.score import Finding, score_table
from tabloom.sources.files import from_text, load, sniff, write_csv


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_scalars(spark):
    lit = F.lit
    assert value(spark, X.clean_space(lit("  a b\t c​ "))) == "a b c"
    assert value(spark, X.demojibake(lit("CafÃ©"))) == "Café"
    assert value(spark, X.demojibake(lit("Café"))) == "Café"
    assert value(spark, X.undecorated(lit("(£1,200.50)"))) == "-1200.50"
    assert value(spark, X.undecorated(lit("12"))) is None
    assert value(spark, X.luhn(lit("4111 1111 1111 1111"))) is True
    assert value(spark, X.luhn(lit("4111 1111 1111 1112"))) is False
    assert value(spark, D.normal_phone(lit("07700 900123"))) == "+44 7700 900123"
    assert value(spark, D.normal_phone(lit("020 7946 0958"))) == "+44 20 7946 0958"
    assert value(spark, D.normal_phone(lit("12"))) is None
    assert value(spark, D.normal_postcode(lit("sw1a1aa"))) == "SW1A 1AA"
    assert value(spark, D.normal_company(lit("123"))) == "00000123"
    assert value(spark, D.value_type(lit("192.168.0.1"))) == "string"
    for text, want in (("31/12/2024", "2024-12-31"), ("12/31/2024", "2024-12-31"), ("3 Sept 99", "1999-09-03"), ("March 4, 2020", "2020-03-04"), ("2024-01-01T01:00:00+05:00", "2023-12-31"), ("31/02/2024", None)):
        got = value(spark, D.parse_date(lit(text)))
        assert (str(got.date) if got.date else None) == want, text


def test_group_by(spark):
    data = from_text(spark, "region,amount\nNorth,£1,200\n".replace("£1,200", '"£1,200"') + "north ,10\nSouth,pending\n,5\nN/A,2\n")
    g = group_by(data, ["region"], [Aggregation("count"), Aggregation("sum", "amount")])
    rows = [tuple(r)[:3] for r in g.table.df.orderBy(ROW).collect()]
    assert rows == [("North", 2, 1210.0), ("South", 1, None), (None, 2, 7.0)]
    d = g.diagnostics()
    assert d["blank_key_rows"] == 2 and d["ignored"]["Sum of amount"] == 1 and d["empty_groups"]["Sum of amount"] == 1


def test_join(spark):
    left = from_text(spark, "id,v\nA1,1\n a1,2\n0007,3\nzz,4\n,5\n")
    right = from_text(spark, "id,w\na1,x\na1,y\n7,z\nq,k\n")
    j = join_tables(left, right, "left", [("id", "id")])
    assert j.table.headers == ("id", "v", "w") and j.table.df.count() == 7
    assert {(r.key, r.reason, r.would_match) for r in j.unmatched_left().collect()} == {("0007", "zero-padding", "7"), ("zz", "absent", None), ("(blank)", "empty-key", None)}
    assert [(r[ROW], r.matches) for r in j.fan_out().collect()] == [(0, 2), (1, 2)]
    assert join_tables(left, right, "full", [("id", "id")]).table.df.count() == 9
    assert join_tables(left, from_text(spark, "other\n1\n")).error


def test_reshape_and_diff(spark):
    data = from_text(spark, "name,city\nAda Love,Rome\nBob,\n")
    assert [tuple(r)[:2] for r in S.split_column(data, 0).df.orderBy(ROW).collect()] == [("Ada", "Love"), ("Bob", None)]
    assert [r.c0 for r in S.merge_columns(data, [0, 1], "/").df.orderBy(ROW).collect()] == ["Ada Love/Rome", "Bob"]
    assert S.split_column(data, 1, "#") is data
    edits = S.find_replace(data, S.Search("o", "$")).collect()
    assert {(r[ROW], r.after) for r in edits} == {(0, "Ada L$ve"), (0, "R$me"), (1, "B$b")}
    a, b = from_text(spark, "id,x\n1,a\n2,b\n3,c\n"), from_text(spark, "id,x\n1,a\n2,B\n4,d\n")
    d = diff_tables(a, b)
    assert d.key == "id" and d.counts() == {"added": 1, "removed": 1, "changed": 1, "unchanged": 1}


CRM = """Name,Email,Phone,Joined,Active
 Sarah Connor ,SARAH@X.COM,07700 900123,31/01/2024,Yes
SARAH CONNOR,sarah@x.com,07700900123,31/01/2024,yes
Sarah Connor,nobody,12,31/02/2024,Yes
N/A,a@b.co,+44 7700 900123,1 March 2024,no
,,,,
Sarah Connor,nobody,12,31/02/2024,Yes
"""


def test_cleanse(spark):
    r = cleanse(from_text(spark, CRM))
    rows = [tuple(x) for x in r.cleaned().named().collect()]
    assert ("Sarah Connor", "sarah@x.com", "+44 7700 900123", "2024-01-31", "Yes") in rows
    assert len(rows) < 5 and r.projected.composite >= r.score.composite
    rules = {f.rule for f in r.findings}
    assert {"remove-duplicate-rows", "remove-blank-rows", "normalize-missing", "consistent-casing", "impossible-date", "invalid-email", "normalize-boolean"} <= rules
    done = r.cleaned()
    again = cleanse(Dataset(spark.createDataFrame(done.df.collect(), done.df.schema), done.headers), Options(projection=False))
    # rows that only cleaning made equal are a finding of the next run
    assert {f.rule for f in again.findings if f.fixable} <= {"remove-duplicate-rows"}
    assert report(r)["cells_changed"] > 5


def test_near_duplicates(spark):
    data = from_text(spark, "Name,Company\nJohn Smithson,Acme Limited\nSmithson John,Acme Limited\nJohn Smithsen,Acme Limited\nOther Person,Globex\n")
    got = {r[ROW]: r.cluster for r in near_duplicates(data).collect()}
    assert got == {0: 0, 1: 0, 2: 0}


def test_score_of_duplicates():
    assert score_table([Finding("remove-duplicate-rows", "error", 89, "")], 200, 100).composite == 40


def test_personal_columns(spark):
    data = from_text(spark, "First Name,Company Name,x,y,z,w\n" + "Ann,Acme,4111111111111111,AB123456C,4111111111111112,a@b.com\n" * 4)
    found = personal_columns(data, profile(data, samples=False))
    assert found == {"First Name": "names", "x": "payment card numbers", "y": "National Insurance numbers", "w": "email addresses"}
    few = from_text(spark, "x\n4111111111111111\n4111111111111111\n")
    assert personal_columns(few, profile(few, samples=False)) == {}
    none = from_text(spark, "x,name\n")
    assert personal_columns(none, profile(none, samples=False)) == {"name": "names"}


def test_headers():
    assert headers((" Email ", "email", "")) == ["Email", "email (2)", "Column 3"]


def test_recipe_and_instructions(spark):
    o, matched, rest = instruction("use US dates, don't touch emails and frobnicate")
    # how dates are to be written says nothing of how they are to be read
    assert (o.date_style, o.date_order) == ("us", "auto") and "normalize-email" in o.disabled and rest == ["frobnicate"]
    assert instruction("Treat dates as month first")[0].date_order == "MDY"
    o, matched, _ = instruction("Clean it up but keep duplicates, keep blank rows and don't change the casing")
    assert o.disabled == {"remove-duplicate-rows", "remove-blank-rows", "consistent-casing"} and len(matched) >= 2
    o = instruction("only fix whitespace")[0]
    assert "remove-duplicate-rows" in o.disabled and "trim-whitespace" not in o.disabled
    assert instruction("format dates as ISO")[0].date_style == "iso" and instruction("translate it into French")[2]
    again = parse(Recipe(o, ("trim-whitespace",)).dumps())
    assert again.options == o and again.skip == ("trim-whitespace",)
    with pytest.raises(ValueError):
        parse('{"version": 99}')
    with pytest.raises(ValueError):
        run(from_text(spark, CRM), Recipe(join={"type": "left", "keys": []}))


def test_files(spark, tmp_path):
    assert sniff("a;b\n1;2\n") == ";" and sniff("a\tb,c\n1\t2,3\n") == "\t"
    (tmp_path / "t.csv").write_text('a,,b\r\n"x ""q""\ny",1\r\n\r\n2,3,4,5\r\n')
    data = load(spark, str(tmp_path / "t.csv"))
    assert data.headers == ("a", "Column 2", "b", "Column 4") and data.ragged_rows == 2
    assert [tuple(r)[:4] for r in data.df.orderBy(ROW).collect()] == [('x "q"\ny', "1", None, None), (None, None, None, None), ("2", "3", "4", "5")]
    (tmp_path / "t.json").write_text('{"data": [{"z": 1, "b": null}, {"a": {"k": 2}, "z": "s"}]}')
    data = load(spark, str(tmp_path / "t.json"))
    assert data.headers == ("z", "b", "a") and [tuple(r)[:3] for r in data.df.orderBy(ROW).collect()] == [("1", None, None), ("s", None, '{"k":2}')]
    write_csv(data, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True, escape='"').count() == 2
    spark.range(5).write.parquet(str(tmp_path / "p.parquet"))
    assert load(spark, str(tmp_path / "p.parquet"), 3).df.count() == 3


def test_entry_without_the_corpus_package(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "tabloom.llm", None)
    import __spark_entry__ as entry

    importlib.reload(entry)
    assert entry.queries() and not [q for q in entry.queries() if q.startswith("op") or q == "pipeline"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
