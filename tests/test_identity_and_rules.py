from pyspark.sql import functions as F

from tabloom.dataset import ROW, Dataset
from tabloom.functions import text as X
from tabloom.operators import reshape as S
from tabloom.operators.components import components
from tabloom.operators.constraints import Constraint, suggest
from tabloom.operators.diff import diff_tables
from tabloom.operators.join import join_tables
from tabloom.operators.profile import profile
from tabloom.operators.rules import _neighbours, dependencies, near_duplicates
from tabloom.plans.recipe import Recipe, run
from tabloom.sources.files import from_text, parse_fields


def test_rows_keep_their_identity_after_joins(spark):
    left = from_text(spark, "id,v\nA,1\nB,2\n")
    right = from_text(spark, "id,w\nA,x\nA,y\nC,p\nD,q\n,\n")
    sizes = {"inner": 2, "left": 3, "full": 6}
    for kind, n in sizes.items():
        data = join_tables(left, right, kind, [("id", "id")]).numbered()
        assert sorted(r[ROW] for r in data.df.collect()) == list(range(n))
    # a blank row of the right alone is the only one that goes
    result, done = run(left, Recipe(join={"type": "full", "keys": [["id", "id"]]}), right)
    assert [tuple(r) for r in done.df.orderBy(ROW).select("c0", "c1", "c2").collect()] == [("A", "1", "x"), ("A", "1", "y"), ("B", "2", None), ("C", None, "p"), ("D", None, "q")]
    wide = S.unpivot(join_tables(left, right, "full", [("id", "id")]).numbered(), [1, 2])
    assert wide.df.count() == wide.df.select(ROW).distinct().count() == 12


def test_numbers_without_and_with_an_order(spark):
    frame = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("c", 4)], "k string, v int").repartition(3)
    assert [tuple(r) for r in Dataset.of(frame, "k").df.orderBy(ROW).select("c1", ROW).collect()] == [(3, 0), (2, 1), (1, 2), (4, 3)]
    plain = Dataset.of(frame).df
    assert plain.select(ROW).distinct().count() == 4


def test_positions_count_without_gaps(spark):
    before = from_text(spark, "a,b\n1,x\n1,x\n2,y\n2,y\n")
    after = S.delete_rows(from_text(spark, "a,b\n9,z\n1,x\n1,x\n2,Y\n2,y\n"), [0])
    d = diff_tables(before, after)
    assert d.key is None and d.counts() == {"added": 0, "removed": 0, "changed": 1, "unchanged": 3}


def test_replace_in_numbers(spark):
    data = Dataset.of(spark.createDataFrame([(1, 210, "x2")], "id long, n int, s string"), "id")
    assert {(r.column, r.after) for r in S.find_replace(data, S.Search("2", "7")).collect()} == {(1, "710"), (2, "x7")}


def test_number_texts(spark):
    def value(column):
        return spark.range(1).select(column.alias("v")).first().v

    undecorated = {"(-5)": "5", "-(5)": None, "1 200": None, "(£1,200.50)": "-1200.50", "- 5": "-5", "5£": "5", "-42": None, "££5": None, "£ 5": "5"}
    assert {k: value(X.undecorated(F.lit(k))) for k in undecorated} == undecorated
    shown = {"5%3": None, "5%": 5.0, "£1,000": 1000.0, "$ 5": 5.0, "1 200": None, "-2.5": -2.5, "(5)": None}
    assert {k: value(X.display_number(F.lit(k))) for k in shown} == shown
    forms = {k: value(X.relaxed_keys(F.lit(k))["numeric-format"]) for k in ("007.0", "+7", "7", "7e0", "1e3", "1,000", ".50", "0.5", "a1")}
    assert forms["007.0"] == forms["+7"] == forms["7"] == forms["7e0"] and forms["1e3"] == forms["1,000"] and forms[".50"] == forms["0.5"] and forms["a1"] == "a1"
    assert value(X.loose_key(F.lit("ÀB-0é"))) == "b0"


def test_fields():
    assert parse_fields('a,"b,""c""\nd"e,f\n"",x"y"z\n"open, end', ",") == [["a", 'b,"c"\nde', "f"], ["", 'x"y"z'], ["open, end"]]
    assert parse_fields("", ",") == [[""]] and parse_fields("a||b", "|") == [["a", "", "b"]]


def clusters(spark, text, **options):
    got = near_duplicates(from_text(spark, text), **options).collect()
    return sorted(sorted(r[ROW] for r in got if r.cluster == c) for c in {r.cluster for r in got})


def test_near_duplicates_by_words_and_typos(spark):
    assert clusters(spark, 'Name,Company\nJohn Smith,Acme Ltd\n"Smith, John",Acme Ltd.\nJane Doe,Beta Co\n') == [[0, 1]]
    assert clusters(spark, "Company\nAcme Trading Limited\nBcme Trading Limited\nDelta Freight Services\nEcho Consulting Group\n") == [[0, 1]]
    assert clusters(spark, "Name\nAlice\nBob\nCarol\nDave\n") == []
    assert clusters(spark, "Name,City\nJohn Smith,Leeds\nJon Smith,Leeds\nJane Doe,York\nBob Jones,Hull\n") == [[0, 1]]
    # words left apart by invisible characters are one, sentinels none, and rows of punctuation alone are like no other
    assert clusters(spark, "Name\nAc​me Trading\nTrading Acme\n...\n---!\n") == [[0, 1]]
    assert clusters(spark, "a,b\nAcme,N/A\nAcme,Acme\n") == []


def test_identifiers_and_numbers_are_no_typos(spark):
    assert clusters(spark, "Id,Company,City,Plan\n" + "".join(f"C{i:03},Acme Ltd,Leeds,Pro\n" for i in range(1, 24))) == []
    rows = "".join(f"T{1000 + i},cust-42,2024-0{i % 9 + 1}-1{i % 3},{i * 7.5 + 10:.2f}\n" for i in range(30))
    assert clusters(spark, "TxnId,Customer,Date,Amount\n" + rows) == []
    # nearly distinct columns tell rows apart whatever their names
    assert clusters(spark, "Label,Firm\n" + "".join(f"item{'abcdefghijkl'[i]}xyz,Acme Trading Limited\n" for i in range(12))) == []


def test_neighbours_reach_across_stretches(spark, monkeypatch):
    import tabloom.operators.rules as rules

    monkeypatch.setattr(rules, "STRETCH", 7)
    frame = spark.createDataFrame([(i, f"{i:04}") for i in range(60)], "id long, ctx string").repartition(5)
    got = {(r.id, r.o.id) for r in _neighbours(frame, F.col("ctx"), 4).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, min(60, i + 5))}


def test_typos_among_neighbours(spark):
    import random

    rnd = random.Random(4)
    names = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24)) for _ in range(600)]
    names += ["q" + names[5][1:], names[9][:-1] + "q"]
    # each name twice, so that names are no identifiers; equal ones differ in their codes alone and are no typos
    text = "Code,Name\n" + "".join(f"{2 * k + c}-7,{n}\n" for k, n in enumerate(names) for c in (0, 1))
    found = clusters(spark, text)
    assert len(found) == 2 and {x // 2 for x in found[0]} == {5, 600} and {x // 2 for x in found[1]} == {9, 601}
    assert clusters(spark, text, most=1000) == []


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i != 20], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {i: (0 if i <= 20 else 21) for i in range(41) if i not in (0, 21)}


def test_suggestions(spark):
    rows = "".join(f"C{i:03},{'Open' if i % 2 else 'closed'},note {i}\n" for i in range(12))
    data = from_text(spark, "Customer ID,Status,Notes\n" + rows)
    got = suggest(data, profile(data, samples=False))
    assert [(c.kind, c.column) for c in got] == [("unique", "Customer ID"), ("not-null", "Customer ID"), ("allowed-values", "Status")]
    assert got[2].values == ("closed", "Open")
    assert suggest(data, profile(data, samples=False), (Constraint("unique", "Customer ID"),))[0].kind == "not-null"


def test_dependencies(spark):
    rows = [f"P{i % 4},City{i % 4}\n" for i in range(24)]
    rows[8] = "P0,Citty0\n"
    data = from_text(spark, "Postcode,City\n" + "".join(rows))
    got = [tuple(r) for r in dependencies(data, profile(data, samples=False)).collect()]
    assert ("City", "Postcode", 23, 24, 0) not in got
    assert [r for r in got if r[:2] == ("Postcode", "City")] == []  # the more specific column decides: City has five values
    few = from_text(spark, "Postcode,City\n" + "".join(rows[:16]))
    assert dependencies(few, profile(few, samples=False)).count() == 0
