"""A corpus pipeline of five stages; each works on all that its predecessor kept.

Quality classifier: rows scored under the threshold go. Near-duplicates: of each component of texts with five-word Jaccard similarity of
0.8 or more, linked by SimHash and completed by the shingles, the row with the smallest id stays. Suffix-array dedup: repeated strings of 200 bytes are cut out of the texts. Decontamination: documents that hold a benchmark item go. Packing: what
is left becomes sequences of 1024 tokens.

Rows go, not ids: with repeated or missing ids each row is judged by its own text, and of a component the row with the smallest (id, row
number) stays, missing ids last. All stages but the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import cut, numbered, table
from tabloom.llm.copies import copies
from tabloom.llm.decontaminate import leaks
from tabloom.llm.packing import pack
from tabloom.llm.quality import score_quality
from tabloom.llm.suffixes import remove_repeats


#: U+FFFD that the texts have is set aside while a cut's own are dropped.
ESCAPES = [("\ufdd0", "\ufdd0a"), ("\ufffd", "\ufdd0b")]


def apart(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _rest): the other columns as one, so that no name of theirs meets one that an operator uses."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(rest or [F.lit(0).alias("none")])).alias("_rest"))


def together(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(c if c in ("doc_id", "text") else f"_rest.`{c}`") for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score under the threshold go; null and empty texts are scored like any other, each repeated row by itself."""
    scored = score_quality(apart(docs), table(spark, sf_dir, "labels"), keep=("text", "_rest"))
    return together(scored.filter("predicted = 1"), docs.columns)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: SimHash links, verified and completed by the shingles themselves.

    Null and blank texts are copies of each other; texts of five words or fewer are like equal ones only; an empty table stays empty."""
    rows = numbered(apart(docs))
    roots = copies(rows.select("row_id", F.col("text").cast("binary").alias("body")))
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_id"))
    marked = cut(rows.select("doc_id", "row_id").join(roots, "row_id").select("root", "row_id", place.alias("place")))
    least = marked.groupBy("root").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("root", "least")
    drop = marked.join(least, "root").filter("place <> least").select("row_id")
    return together(rows.join(drop, "row_id", "left_anti"), docs.columns)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings are cut out of the texts, rows all stay; a cut may split a character, and what is left of that goes too.

    Null texts stay null; equal texts of 200 bytes or more, repeated rows too, are left empty."""
    rows = apart(docs).withColumn("_null", F.col("text").isNull())
    kept = remove_repeats(rows, carry=("_rest", "_null"))
    text = F.col("kept").cast("string")
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.decode(F.call_function("make_valid_utf8", text).cast("binary"), "UTF-8")
    text = F.replace(text, F.lit("\ufffd"), F.lit(""))
    for a, b in reversed(ESCAPES):
        text = F.replace(text, F.lit(b), F.lit(a))
    cut_ = F.col("n_removed") > 0
    text = F.when(cut_, text).when(~F.col("_null"), F.col("kept").cast("string"))
    out = kept.withColumn("text", text)
    if "n_chars" in docs.columns:
        chars = F.when(cut_, F.char_length("text")).otherwise(F.col("_rest.n_chars")).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("_rest", F.col("_rest").withField("n_chars", chars))
    return together(out, docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go; null and empty texts hold none, and of repeated ids only the rows that do go."""
    rows = numbered(apart(docs))
    found = leaks(rows, table(spark, sf_dir, "benchmark"), id_col="row_id")
    return together(rows.join(found.select(F.col("doc_id").alias("row_id")).distinct(), "row_id", "left_anti"), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row becomes pieces of sequences; null and empty texts give the end id alone."""
    return pack(docs)


STAGES = [("quality", quality), ("simhash", simhash), ("suffix_array", suffix_array), ("decontamination", decontamination), ("packing", packing)]

#: The stages learn a model, follow links and sort suffixes, which SQL can't express; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
