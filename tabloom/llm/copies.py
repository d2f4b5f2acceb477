"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and what such links join.

SimHash proposes and the shingles decide. Fingerprints of five-word shingles link by the operator's pigeonhole index, and each link between
two classes of texts is verified by their whole sets. At 0.8, though, two fingerprints differ in about 10 of 64 bits, at times in 18,
where the pigeonhole rules out next to nothing; so what SimHash has not joined is completed by prefix filtering, which loses no pair:

1. A text is its class, the hash of its words; each class sends its shingles' hashes, and those of one class alone stop there.
2. Two sets of n and m shingles at 0.8 share 4(n + m) / 9 or more, so a class with under four fifths of its shingles shared has no near
   copy. Of the others, rare shingles first, two near copies meet in the first n - ceil(0.8 n) + 1 places.
3. In a bucket of what meets, each class is compared first with a leader, the class with the least shingles of its own: of edited copies
   of one text that is the text itself, with which they all link. Only classes that the links found so far do not join are
   then compared pair by pair, so a family of copies costs its size, not its square. Each pair is decided by the whole sets.
4. Connected components of the links.

Words are those of op4 (ASCII lower case, split at ASCII white space); a text of five words or fewer is one shingle, and blank or null
texts are copies of each other. Classes are told apart by 64-bit hashes, shingles by at least 40 bits of one and their part.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import components, cut, sliced, width
from tabloom.llm.simhash import fingerprints_of
from tabloom.llm.simhash import links as simhash_links

SHINGLE = 5
#: Leaders that a class is compared with before the comparison pair by pair; steers cost, never results.
LEADERS = 4
#: Shingles that a task packs at once.
PACK = 500_000


def joined(text: bytes | None) -> tuple[list[bytes], bytes]:
    words = (text or b"").lower().split()
    return words, b" ".join(words)


def name(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, 7) - (1 << 63)


def shingles_of(words: list[bytes], text: bytes) -> np.ndarray:
    """Distinct hashes of the shingles."""
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        found = [digest(text)] if words else []
    else:
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        found = [digest(text[s : e - 1]) for s, e in zip([0, *ends[:-SHINGLE]], ends[SHINGLE - 1 :])]
    return np.unique(np.array(found, np.uint64)).view(np.int64)


def classes(rows: DataFrame) -> DataFrame:
    """(row_id, cid, fp) of rows (row_id, body): class and SimHash."""

    def run(batches):
        for batch in sliced(batches, 1):
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            got = pa.array([name(joined(t)[1]) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), got, pa.array(fingerprints_of(texts, SHINGLE))], ["row_id", "cid", "fp"])

    return rows.mapInArrow(run, "row_id long, cid long, fp long")


def proposed(marked: DataFrame) -> DataFrame:
    """(a, b): pairs of classes, a > b, that SimHash links; classes of one fingerprint as a star around the smallest."""
    owners = cut(marked.select("fp", "cid").distinct())
    leads = owners.groupBy("fp").agg(F.min("cid").alias("lead"))
    same = owners.join(leads, "fp").filter("cid <> lead").select(F.col("cid").alias("x"), F.col("lead").alias("y"))
    near = simhash_links(leads.select("fp"))
    ends = [leads.select(F.col("fp").alias(c), F.col("lead").alias(n)) for c, n in (("a", "x"), ("b", "y"))]
    return same.unionByName(near.join(ends[0], "a").join(ends[1], "b").select("x", "y")).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))


def shared_shingles(rows: DataFrame) -> DataFrame:
    """(cid, n, h, df): shingles that more than one class has; n is the class's number of shingles, df the classes with h.

    Shingles travel packed, 40 bits of the hash and 24 of the class's place in its pack, in one binary for each part of the hashes."""
    parts = min(4 * width(rows), 1 << 14)

    def send(batches):
        seen: set[int] = set()
        cids: list[int] = []
        held: list[np.ndarray] = []

        def pack():
            sizes = np.array([len(x) for x in held], np.int32)
            h = np.concatenate(held).view(np.uint64)
            at = np.repeat(np.arange(len(held), dtype=np.uint32), sizes)
            part = (h & np.uint64(0xFFFFFF)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            h, at, ends = h[order], at[order], np.cumsum(np.bincount(part.astype(np.int64), minlength=parts))
            names, out = np.array(cids, np.int64), ([], [], [], [])
            for p, (lo, hi) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
                if lo < hi:
                    here = np.zeros(len(held), bool)
                    here[at[lo:hi]] = True
                    local = (np.cumsum(here) - 1)[at[lo:hi]].astype(np.uint64)
                    packed = h[lo:hi] >> np.uint64(24) << np.uint64(24) | local
                    for column, value in zip(out, (p, packed.tobytes(), names[here].tobytes(), sizes[here].tobytes())):
                        column.append(value)
            cids.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], ["part", "packed", "cids", "sizes"])

        total = 0
        for batch in sliced(batches, 1):
            for text in batch.column(1).to_pylist():
                words, whole = joined(text)
                cid = name(whole)
                if cid in seen or not words:
                    continue
                seen.add(cid)
                cids.append(cid)
                held.append(shingles_of(words, whole))
                total += len(held[-1])
                if total > PACK:
                    total = 0
                    yield pack()
        if held:
            yield pack()

    def count(batches):
        packs: dict[int, list] = {}
        for batch in batches:
            for p, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                packs.setdefault(p, []).append(rest)
        while packs:
            p, got = packs.popitem()
            h, cid, n = [], [], []
            for packed, cids, sizes in got:
                x = np.frombuffer(packed, np.uint64)
                local = (x & np.uint64(0xFFFFFF)).astype(np.int64)
                h.append((x >> np.uint64(24)).astype(np.int64))
                cid.append(np.frombuffer(cids, np.int64)[local])
                n.append(np.frombuffer(sizes, np.int32)[local])
            h, cid, n = np.concatenate(h), np.concatenate(cid), np.concatenate(n)
            order = np.lexsort((cid, h))
            h, cid, n = h[order], cid[order], n[order]
            # a class that several tasks sent counts once
            first = np.r_[True, (h[1:] != h[:-1]) | (cid[1:] != cid[:-1])]
            h, cid, n = h[first], cid[first], n[first]
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            df = np.diff(np.r_[starts, len(h)])
            df = np.repeat(df, df)
            at = np.flatnonzero(df > 1)
            for lo in range(0, len(at), 100_000):
                k = at[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(cid[k]), pa.array(n[k]), pa.array(h[k] << 16 | p), pa.array(df[k].astype(np.int32))], ["cid", "n", "h", "df"])

    sent = rows.mapInArrow(send, "part int, packed binary, cids binary, sizes binary")
    return sent.repartition(width(rows), "part").mapInArrow(count, "cid long, n int, h long, df int")


def enough(shared: Column, n: Column, m: Column) -> Column:
    """Jaccard similarity of 0.8 or more of sets of n and m that share so many; in whole numbers."""
    return 9 * shared >= 4 * (n + m)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(link) of those distinct pairs (a, b) of classes at 0.8 or more; checkpointed."""
    left = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("hs").alias("ha"))
    right = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("hs").alias("hb"))
    both = pairs.join(left, "a").join(right, "b")
    return cut(both.filter(enough(F.size(F.array_intersect("ha", "hb")), F.col("na"), F.col("nb"))).select(F.struct("a", "b").alias("link")))


def similar(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """(node, root) of each class of rows (row_id, body) that has a near copy; root is the smallest class that links reach. marked: their classes()."""
    ranked = shared_shingles(rows).groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("x"))
    # h is shared by two classes or more wherever near copies share it, so these sets decide similarity
    sets = cut(ranked.filter(5 * F.size("x") >= 4 * F.col("n")).select("cid", "n", F.col("x.h").alias("hs")))
    lone = F.col("n") - F.size("hs")
    reach = F.col("n") - F.ceil(F.col("n") * 4 / 5).cast("int") + 1 - lone
    index = sets.select("cid", "n", F.size("hs").alias("m"), F.posexplode(F.slice("hs", 1, reach)).alias("pos", "h"))
    # the leader has the least of its own: of edited copies of one text, that text
    own = F.struct((1 - F.col("m") / F.col("n")).alias("own"), F.xxhash64("cid").alias("draw"), "cid")
    met = index.groupBy("h").agg(F.count(F.lit(1)).alias("met"), F.min(own).alias("leader")).filter("met > 1").select("h", "leader")
    index = cut(index.join(met, "h"))
    leaders = index.filter("cid <> leader.cid").groupBy("cid").agg(F.slice(F.array_sort(F.collect_set("leader")), 1, LEADERS).alias("x"))
    first = leaders.select(F.col("cid").alias("x"), F.explode("x.cid").alias("y")).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    links = verified(first.unionByName(proposed(marked)).distinct(), sets)
    roots = components(links.select("link.*"))
    placed = index.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    apart = placed.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("h")
    placed = cut(placed.join(apart, "h", "left_semi").select("h", "cid", "n", "m", "pos", "root"))
    other = placed.select("h", *[F.col(c).alias(f"{c}_b") for c in ("cid", "n", "m", "pos", "root")])
    # what can still be shared from this place on
    most = F.least(F.col("m") - F.col("pos"), F.col("m_b") - F.col("pos_b"))
    ahead = (F.col("cid") > F.col("cid_b")) & (F.col("root") != F.col("root_b"))
    # of a pair's common shingles the first in the order has no other before it, so the bound holds there
    second = placed.join(other, "h").filter(ahead & enough(most, F.col("n"), F.col("n_b"))).select(F.col("cid").alias("a"), F.col("cid_b").alias("b")).distinct()
    return components(links.unionByName(verified(second, sets)).select("link.*"))


def copies(rows: DataFrame) -> DataFrame:
    """(row_id, root) of each of rows (row_id, body): rows with one root are copies, or joined by links of near copies."""
    marked = cut(classes(rows))
    stars = similar(rows, marked)
    return marked.join(stars.withColumnRenamed("node", "cid"), "cid", "left").select("row_id", F.coalesce("root", "cid").alias("root"))
