import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"
#: Names that the operators use inside.
EXTRA = ["score", "__text", "predicted", "held_out", "kept", "n_bytes", "n_removed", "uid", "row_id", "body", "root", "removed", "group", "w", "fp", "cid"]
SCHEMA = "doc_id long, text string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def prose(k, n=40):
    return " ".join(f"word{(k * 7919 + i * 104729) % 9973}" for i in range(n))


def rows():
    texts = [(1, prose(1)), (1, prose(1)), (2, prose(2)), (2, prose(3)), (None, prose(4)), (None, None), (5, None), (6, ""), (7, " \t"), (8, "one"), (9, "one"), (10, prose(5, 30_000)), (11, "é" * 500)]
    return [(i, t, None if t is None else len(t), *[f"{c}{k}" for c in EXTRA]) for k, (i, t) in enumerate(texts)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows_and_names(spark, name, stage):
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = stage(spark, docs, SF)
    got = out.collect()
    if name == "packing":
        assert {r.doc_id for r in got} == {r[0] for r in rows()}
        return
    assert out.columns == docs.columns
    # what stays keeps its other columns
    by = {r[3]: r for r in rows()}
    for r in got:
        assert (r.doc_id, *r[3:]) == (by[r.score][0], *by[r.score][3:])
        if name != "suffix_array":
            assert r.text == by[r.score][1] and r.n_chars == by[r.score][2]
    if name == "suffix_array":
        texts = {r.score: r.text for r in got}
        # equal texts of 200 bytes lose all, nulls stay nulls, short texts stay
        assert len(got) == len(rows()) and texts["score0"] == texts["score1"] == texts["score12"] == "" and texts["score5"] is None and texts["score8"] == " \t" and texts["score9"] == "one"
        assert [r.n_chars for r in sorted(got, key=lambda r: int(r.score[5:]))][:2] == [0, 0]
    if name == "simhash":
        # one of each group: the equal rows, the blank ones, the equal words
        stays = {int(r.score[5:]) for r in got}
        assert len(stays & {0, 1}) == 1 and len(stays & {5, 6, 7, 8}) == 1 and len(stays & {9, 10}) == 1 and {2, 3, 4, 11, 12} <= stays
        assert 6 in stays  # the smallest id of the blank ones, a missing id comes last


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_an_empty_table(spark, name, stage):
    out = stage(spark, spark.createDataFrame([], "doc_id long, text string"), SF)
    assert out.count() == 0
