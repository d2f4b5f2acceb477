"""The table abstraction: a DataFrame with physical columns c0..cn, the display headers, and a dense row number."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.text import cell_text

ROW = "_row"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the checkpoint folder that the session names (spark.checkpoint.dir) and reads it from there.

    A session on one machine without that setting, as in tests, gets a folder of its own; a cluster must name a shared one."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tabloom-ck-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over at least as many tasks as the session's cores and shuffles have, and written once.

    For plans that read a table many times: they start from plain columns, and a small file with many rows is no single task."""
    session = df.sparkSession
    return cut(df.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)))


def dense(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with _row, its place from 0 in the given order.

    A range-partitioned sort, written once so that numbers can't change; only one count per partition reaches the driver."""
    done = cut(df.orderBy(*order))
    sizes = {r.p: r.n for r in done.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = [0, *accumulate(sizes.get(p, 0) for p in range(max(sizes, default=0)))]
    start = F.get(F.array(*[F.lit(x).cast("long") for x in starts]), F.spark_partition_id())
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return done.withColumn(ROW, start + within)


@dataclass(frozen=True)
class Dataset:
    df: DataFrame
    headers: tuple[str, ...]
    ragged_rows: int = 0
    kinds: tuple[T.DataType, ...] = field(default=())
    base: Dataset | None = None  # the table without the working columns that rules added to df

    def __post_init__(self):
        if not self.kinds:
            schema = self.df.schema
            object.__setattr__(self, "kinds", tuple(schema[f"c{i}"].dataType for i in range(len(self.headers))))

    @staticmethod
    def of(df: DataFrame, order: str | list[str] | None = None, headers: list[str] | None = None) -> Dataset:
        """Wraps a DataFrame. order: columns that number the rows; without it they are numbered in file order, which takes a df that reads files
        (or a checkpoint) without a shuffle, as each evaluation must give the same numbers.

        A single integral order column is used as it is: only the order of row numbers matters to the operators."""
        names = list(headers or df.columns)
        cols = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]
        if isinstance(order, str) and isinstance(df.schema[order].dataType, (T.LongType, T.IntegerType)):
            return Dataset(df.select(*cols, F.col(f"`{order}`").cast("long").alias(ROW)), tuple(names))
        keys = [order] if isinstance(order, str) else order
        if keys:
            return Dataset(dense(df, *keys).select(*cols, ROW), tuple(names))
        # unique and in the order of files and their rows; gaps between partitions do no harm
        return Dataset(df.select(*cols, F.monotonically_increasing_id().alias(ROW)), tuple(names))

    @property
    def plain(self) -> Dataset:
        """The table that plans should start from which need no working columns: the optimizer's work grows with those."""
        return self.base or self

    def __len__(self) -> int:
        return len(self.headers)

    def index(self, name: str) -> int | None:
        """Place of the first header with just this name."""
        return self.headers.index(name) if name in self.headers else None

    def col(self, i: int) -> Column:
        return F.col(f"c{i}")

    def text(self, i: int) -> Column:
        return cell_text(self.col(i), self.kinds[i])

    def is_string(self, i: int) -> bool:
        """Whether cells of the column count as text: strings, and timestamps, which read as ISO text."""
        return isinstance(self.kinds[i], (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType))

    def with_(self, df: DataFrame, headers: list[str] | tuple[str, ...] | None = None) -> Dataset:
        return Dataset(df, tuple(headers if headers is not None else self.headers), self.ragged_rows)

    def named(self) -> DataFrame:
        """The rows under their headers; repeated names get a running suffix, since Spark resolves names."""
        seen: dict[str, int] = {}
        names = []
        for h in self.headers:
            k = seen[h.lower()] = seen.get(h.lower(), 0) + 1
            names.append(h if k == 1 else f"{h} ({k})")
        return self.df.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
