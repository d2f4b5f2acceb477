import math
import random

from pyspark.sql import functions as F

from tabloom.dataset import Dataset
from tabloom.operators import components as C
from tabloom.operators import rules as R
from tabloom.operators.profile import profile, values_of


def test_chains_of_neighbours_settle_in_few_rounds(spark, monkeypatch):
    # each context is a typo of the next: one chain of 1,200 rows
    rows = [(i, "abcdefghijklmnop" + chr(97 + i // 60) + chr(97 + i // 6 % 10) + "q" * (i % 6), "x") for i in range(1200)]
    data = Dataset.of(spark.createDataFrame([(2 * i + k, *r[1:]) for i, r in enumerate(rows) for k in (0, 1)], "n long, name string, kind string"), "n")
    rounds, real = [], C.cut
    monkeypatch.setattr(C, "cut", lambda df: rounds.append(1) or real(df))
    found = R.near_duplicates(data).collect()
    assert len(found) == 2400 and {r.cluster for r in found} == {0} and len(rounds) <= 3


def test_contracted_edges_reach_the_same_nodes(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)]
    frame = spark.createDataFrame(edges, "a long, b long")
    want = sorted(map(tuple, C.components(frame).collect()))
    for most in (2, 200_000):
        assert sorted(map(tuple, C.components(C.contracted(frame, most)).collect())) == want
    one = C.contracted(frame.coalesce(1)).collect()
    assert len({r.a for r in one}) == len(one) == len(want)


def test_counts_by_texts_are_counts_by_rows(spark):
    rnd = random.Random(7)
    words = ["Acme Ltd", "ACME ltd", "acme  Ltd", "Ltd, Acme", " n/a", "-", "", None, "CafÃ©"]
    rows = [(i, rnd.choice(words), rnd.choice(["yes", "YES", "no", " no"]), rnd.choice(["£1,000", "(5)", "7", None]), rnd.choice(["31/01/2024", "02/13/2024", "x"]), rnd.choice([1.5, 1e-7, None]), rnd.random() < 0.5) for i in range(200)]
    data = Dataset.of(spark.createDataFrame(rows, "id long, name string, active string, spend string, joined_date string, `vat` double, flag boolean"), "id")
    values = values_of(data)
    rules = R.rules_of(data, profile(data, samples=False), values)
    hits = [f.hit for f in rules.fixes] + [g.hit for g in rules.flags]
    want = list(rules.wide().df.agg(*[F.count_if(h).alias(f"h{k}") for k, h in enumerate(hits)]).first())
    fixes, flags = rules.counts(values)
    assert fixes + flags == want and sum(n > 0 for n in want) >= 5
    assert any(f.column == 5 for f in rules.flags)


def test_outliers_of_several_columns_at_once(spark):
    rnd = random.Random(9)
    columns = {0: [rnd.randint(1, 60) for _ in range(400)] + [99999, 5000, -999], 1: [rnd.choice([1, 10, 100, 10**9]) for _ in range(403)], 2: [7] * 403, 3: [None] * 400 + [1, 2, 3]}
    data = Dataset.of(spark.createDataFrame([(*v, i) for i, v in enumerate(zip(*columns.values()))], "a long, b long, c long, d long, n long"), "n")
    got = R.outliers_of(data, list(columns))
    assert got[2] is None and got[3] is None
    for i in (0, 1):
        xs = sorted(columns[i])
        q1, mid, q3 = (xs[int((len(xs) - 1) * p)] for p in (0.25, 0.5, 0.75))
        assert (got[i]["n"], got[i]["q1"], got[i]["median"], got[i]["q3"]) == (len(xs), q1, mid, q3)
        log = xs[0] > 0 and sum(xs) / len(xs) > 1.5 * mid
        f = math.log10 if log else float
        far = [x for x in xs if f(x) < f(q1) - 3 * (f(q3) - f(q1)) or f(x) > f(q3) + 3 * (f(q3) - f(q1))]
        assert got[i]["log"] == log and got[i]["placeholder"] == sum(x in (99999, -999) for x in far)
        genuine = sum(x not in (99999, -999) for x in far)
        assert got[i]["genuine"] == (genuine if genuine <= max(2, 0.1 * len(xs)) else 0)
