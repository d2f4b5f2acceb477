"""The registered queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import chat, licenses, lines
from tabloom.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.fingerprints import fingerprint

    return fingerprint(table(spark, sf_dir, "documents"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.lines import repeated_units

    return repeated_units(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.chat import rotate

    return rotate(table(spark, sf_dir, "conversations"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabloom.llm.suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept", "removed")


QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_quality, op3_licenses, op4_simhash, op5_decontamination, op6_language, op7_fingerprints, op8_lines, op9_chat, op10_suffix_dedup)
}
ORACLES: dict[str, str] = {"op3_licenses": licenses.oracle(), "op8_lines": lines.oracle(), "op9_chat": chat.oracle()}
