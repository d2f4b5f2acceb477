import duckdb

from tabloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_line_counts_however_short(spark, tmp_path):
    rows = [(1, "Short.\n\nRun on"), (2, "short. \n \nrun  on\nx"), (3, "x"), (4, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.unit, r.start, r.end, r.kept_doc_id, r.kept_unit) for r in QUERIES["op8_lines"](spark, str(tmp_path)).filter("removed").collect()}
    assert got == {(2, 0, 0, 7, 1, 0), (2, 2, 10, 17, 1, 2), (3, 0, 0, 1, 2, 3)}


def test_every_line_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = con.execute(ORACLES["op8_lines"]).fetchall()
    got = [tuple(r) for r in QUERIES["op8_lines"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and any(not r[-1] for r in got)
