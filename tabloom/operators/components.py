"""Connected components of links, for groups of any size."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.dataset import cut


def contracted(edges: DataFrame, most: int = 200_000) -> DataFrame:
    """Edges (a long, b long) with the same components: of the edges in a task, one from each node to the smallest that it reaches.

    A task that has seen `most` nodes hands its edges on and starts anew, so that its memory is bounded."""

    def run(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        def found():
            pairs = [(x, root(x)) for x in list(parent)]
            pairs = [p for p in pairs if p[0] != p[1]]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > most:
                yield found()
        yield found()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list (a long, b long): rows (node, root), root the smallest node.

    Alternates large-star and small-star steps, each a grouped minimum joined back to the edges, until the edges no
    longer change. No node's neighbours are ever gathered into one row, so a node with very many links is no problem;
    the checkpoint of every round keeps the lineage short and survives lost executors."""

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 20)))).first())

    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = mark(e)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        e = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
