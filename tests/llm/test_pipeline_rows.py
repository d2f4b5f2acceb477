import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, n_chars long"


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def kept(stage, spark, rows, sf=""):
    frame = spark.createDataFrame([(i, t, len(t)) for i, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.text) for r in stage(spark, frame, sf).collect()), key=str)


def test_stages_drop_rows_not_ids(spark, tmp_path):
    a, b, c = (prose(k, 60) for k in range(3))
    # identical rows; an id with two texts; missing ids
    rows = [(5, a), (5, a), (2, a), (5, b), (None, a), (None, c), (None, c)]
    assert kept(corpus_pipeline.simhash, spark, rows) == sorted([(2, a), (5, b), (None, c)], key=str)
    spark.createDataFrame([(1, a)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert kept(corpus_pipeline.decontamination, spark, rows, str(tmp_path)) == sorted([(5, b), (None, c), (None, c)], key=str)


def test_only_the_cut_characters_go(spark):
    shared = "é" + "x" * 220
    texts = [f"one \ufffd\ufdd0b {shared} \ufdd0 end", f"two {shared} three", "\ufffd whole"]
    texts.append("four è" + shared[1:])
    got = dict(kept(corpus_pipeline.suffix_array, spark, list(enumerate(texts))))
    assert got[0].startswith("one \ufffd\ufdd0b") and got[0].endswith("\ufdd0 end") and "x" not in got[0]
    assert got[2] == "\ufffd whole" and "\ufffd" not in got[1] + got[3]
