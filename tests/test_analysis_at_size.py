import random
import re

from pyspark.sql import functions as F

from tabloom.dataset import Dataset
from tabloom.functions.text import fingerprint
from tabloom.plans.cleanse import Options, analyse


def test_an_analysis_deals_a_table_of_one_file_over_all_cores(spark, tmp_path):
    spark.range(40).select("id", F.concat(F.lit("a"), "id").alias("v")).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    data = Dataset.of(spark.read.parquet(f"{tmp_path}/t.parquet"), "id")
    wide, prof, _, _ = analyse(data, Options(projection=False))
    assert data.df.rdd.getNumPartitions() == 1 and wide.df.rdd.getNumPartitions() >= 4 and prof.rows == wide.df.count() == 40


def test_fingerprints_without_lambda_functions(spark):
    rnd = random.Random(3)
    texts = ["", " - ", "7", "7a b7 77 @ a@7 É9 9É", *("".join(rnd.choice("aB1 2@-É9.\t") for _ in range(rnd.randint(1, 25))) for _ in range(500))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fingerprint(F.col("t")).alias("f"), fingerprint(F.col("t"), letters_only=True).alias("g"))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    for t, f, g in df.collect():
        tokens = sorted(x for x in re.split(r"[^a-zé0-9@]+", t.lower()) if x)
        assert f == " ".join(tokens) and g == " ".join(x for x in tokens if re.search("[a-zé]", x)), t
