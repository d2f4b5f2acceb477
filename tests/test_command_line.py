import json

from tabloom.__main__ import main


def test_clean_and_gate(spark, tmp_path, capsys):
    source = tmp_path / "in.csv"
    source.write_text("Name,Email\n Ada  Love ,ADA@Mail.com\nBob,bob@mail.com\nBob,bob@mail.com\n")
    out, audit = str(tmp_path / "out.csv"), tmp_path / "audit.md"
    assert main(["clean", str(source), "--out", out, "--report", str(audit), "--json", "--min-score", "101"], spark) == 1
    rep = json.loads(capsys.readouterr().out)
    assert rep["rows_removed"] == 1 and rep["cells_changed"] == 2
    got = sorted(tuple(r) for r in spark.read.option("header", True).csv(out).collect())
    assert got == [("Ada Love", "ada@mail.com"), ("Bob", "bob@mail.com")]
    assert "trim-whitespace" in audit.read_text()


def test_refusals(spark, tmp_path):
    empty, bad = tmp_path / "empty.csv", tmp_path / "r.json"
    empty.write_text("a,b\n")
    bad.write_text("[]")
    assert main(["clean", str(empty)], spark) == 1
    source = tmp_path / "in.csv"
    source.write_text("a,b\n1,2\n")
    assert main(["clean", str(source), "--recipe", str(bad)], spark) == 1


def test_diff(spark, tmp_path, capsys):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("id,x\n1,a\n2,b\n3,c\n")
    b.write_text("id,x\n1,a\n2,B\n4,d\n")
    assert main(["diff", str(a), str(b), "--key", "id", "--json", "--fail-on-change"], spark) == 1
    assert json.loads(capsys.readouterr().out) == {"key": "id", "added": 1, "removed": 1, "changed": 1, "unchanged": 1}
    assert main(["diff", str(a), str(a), "--key", "id", "--fail-on-change"], spark) == 0
