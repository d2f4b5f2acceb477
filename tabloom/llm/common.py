"""Helpers shared by the corpus operators: table reads, row identity and Arrow batches; cut and components are those of the table operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.dataset import cut  # noqa: F401
from tabloom.operators.components import components  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def identified(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame | None]:
    """(uid, body binary), a key for each row and its text, null as empty; and (uid, doc_id, carry), or None where the key is the id
    and nothing is carried.

    Repeated or missing ids make rows hard to tell apart in joins, so such tables are numbered and checkpointed."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"), *carry)
    ids = base.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.filter("n > 1 or doc_id is null").limit(1).count():
        base = cut(base.withColumn("uid", F.monotonically_increasing_id()))
        return base.select("uid", "body"), base.select("uid", "doc_id", *carry)
    # the filter holds for every row; spelling it out makes all joins on uid share one exchange of the texts
    base = base.withColumn("uid", F.col("doc_id").cast("long")).filter("uid is not null")
    return base.select("uid", "body"), base.select("uid", "doc_id", *carry) if carry else None


def numbered(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with row_id long, which tells its rows apart: the id where no id is repeated or missing, and else a checkpointed number."""
    ids = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    if ids.filter(F.col(id_col).isNull() | (F.col("n") > 1)).limit(1).count():
        return cut(docs.withColumn("row_id", F.monotonically_increasing_id()))
    return docs.withColumn("row_id", F.col(id_col).cast("long"))


def binary_parts(array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow binary array in one buffer, and the offsets of its values in it."""
    array = array.combine_chunks() if hasattr(array, "combine_chunks") else array
    wide = "large" in str(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if not len(at):
        at = np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, at - at[0]


def sliced(batches, column: int | str, most: int = 2 << 20):
    """The same rows in batches of at most `most` bytes of one column, or of a single row; so a task's memory stays level."""
    for batch in batches:
        _, at = binary_parts(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
        del batch, at
        pa.default_memory_pool().release_unused()
