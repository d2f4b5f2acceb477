"""SimHash near-duplicates by the generalised pigeonhole principle.

1. Every whole text gets a 64-bit SimHash of its word shingles; equal fingerprints are one class from then on.
2. The bits are grouped so that correlated ones share a partition (correlations from a bounded sample). With m
   partitions and radius r, thresholds t_i >= -1 that sum to r - m + 1 keep every pair within r: some partition then
   differs in at most t_i bits. A dynamic program picks the thresholds, and so m, of least estimated work. The estimates
   steer cost only; the result is exact for any choice.
3. Each class is indexed under its own value of a partition and probes all values within t_i of it. What meets under one
   value is verified on all 64 bits, and only links that join two parts not yet joined in that bucket leave the task: a
   family of n copies yields n - 1 links, not n(n-1)/2. Where over about 50,000 rows would meet, the pigeonhole is applied
   again: the other partitions' bits are cut in radius + 1 blocks, on one of which two classes within the radius agree, so
   each row goes to radius + 1 buckets of those that share a block with it, and never to all. What a block leaves together is
   compared in linear memory, breadth first, as in any bucket.
4. Connected components of the links give the classes' representative.

Edge cases: null or blank text has fingerprint zero and links like any other; repeated rows and ids each get a row; an
empty table gives no rows; columns beyond the id and the text are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import components, cut, sliced, width

#: Classes sampled for bit correlations and candidate estimates.
SAMPLE = 20_000
#: A value where more rows than this can meet is dealt out by blocks of the other bits.
SHARE = 50_000


def fingerprints_of(texts: list[bytes], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Signed 64-bit SimHashes: a bit is set if it is set in over half of the shingles' XXH64."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    out = np.zeros(len(texts), np.uint64)

    def flush(lo: int, hi: int) -> None:
        n = counts[lo:hi]
        full = np.flatnonzero(n)
        if len(full):
            bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1)
            starts = (np.cumsum(n) - n)[full]
            ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            out[lo + full] = np.packbits(2 * ones > n[full, None], axis=1).reshape(-1).view(np.uint64)
        hashes.clear()

    done = 0
    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            hashes.append(digest(joined, seed))
            counts[i] = 1
        else:
            ends = list(itertools.accumulate(len(w) + 1 for w in words))
            starts = [0, *ends[:-shingle]]
            hashes.extend([digest(joined[s : e - 1], seed) for s, e in zip(starts, ends[shingle - 1 :])])
            counts[i] = len(ends) - shingle + 1
        if len(hashes) > 50_000:
            flush(done, i + 1)
            done = i + 1
    flush(done, len(texts))
    return out.view(np.int64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row."""

    def run(batches):
        for batch in sliced(batches, 1):
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints_of(texts, shingle))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def bit_groups(sample: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal size; each grows by the free bit that correlates most with it."""
    if not len(sample):
        sample = np.zeros(1, np.int64)
    bits = (sample.view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    x = bits.astype(np.float64) - bits.mean(axis=0)
    scale = np.sqrt((x * x).mean(axis=0)) + 1e-9
    corr = np.abs(x.T @ x / max(len(x), 1)) / np.outer(scale, scale)
    free, groups = list(range(64)), []
    for k in range(m):
        group = [free.pop(0)]
        while len(group) < 64 // m + (k < 64 % m):
            best = max(free, key=lambda b: (round(float(corr[b, group].sum()), 9), -b))
            free.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def allocate(sample: np.ndarray, groups: list[list[int]], radius: int, rows: int) -> tuple[float, list[int]]:
    """Thresholds of least estimated work and that work: probes, plus pairs that meet, for each class."""
    u, m = sample.view(np.uint64), len(groups)
    half = len(u) // 2
    a, b = u[:half], u[half : 2 * half]
    cost = np.full((m, radius + 2), np.inf)
    for i, group in enumerate(groups):
        mask = np.uint64(sum(1 << g for g in group))
        near = np.concatenate([np.bitwise_count((a ^ np.roll(b, s)) & mask) for s in range(16)]) if half else np.zeros(0)
        for t in range(-1, radius + 1):
            probes = sum(math.comb(len(group), e) for e in range(t + 1))
            floor = probes / 2.0 ** len(group)  # what evenly spread values would give
            share = max(floor, float((near <= t).mean()) if len(near) else 0.0) if t >= 0 else 0.0
            cost[i, t + 1] = 10 * probes + rows * share
    best = {0: (0.0, [])}
    for i in range(m):  # the sum so far (thresholds shifted by one) -> least cost, thresholds
        nxt: dict[int, tuple[float, list[int]]] = {}
        for total, (c, ts) in best.items():
            for t in range(-1, radius + 1):
                got = (c + cost[i, t + 1], [*ts, t])
                if total + t + 1 <= radius + 1 and got < nxt.get(total + t + 1, (np.inf, [])):
                    nxt[total + t + 1] = got
        best = nxt
    return best[radius + 1]


def masks(group: list[int], t: int) -> list[int]:
    """XOR masks of up to t of the group's bits, as signed longs."""
    found = [sum(1 << b for b in c) for e in range(t + 1) for c in itertools.combinations(group, e)]
    return [x - (1 << 64) if x >> 63 else x for x in found]


def span(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within radius among distinct fingerprints of one bucket.

    Breadth first; what is found leaves the open set, so a tight family costs one pass. Memory is linear."""
    links, todo = [], fps
    while len(todo) > 1:
        front, todo = todo[:1], todo[1:]
        while len(front) and len(todo):
            step = max(1, 4_000_000 // len(todo))
            near = np.bitwise_count(front[:step, None] ^ todo[None, :]) <= radius
            hit = near.any(axis=0)
            links += zip(front[:step][near[:, hit].argmax(axis=0)].tolist(), todo[hit].tolist())
            front, todo = np.concatenate([front[step:], todo[hit]]), todo[~hit]
    return links


def bucket_links(keys: np.ndarray, fps: np.ndarray, radius: int, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Links within radius inside runs of equal keys: small runs all at once by shifted comparison, large ones by span()."""
    order = np.lexsort((fps, keys))
    keys, u = keys[order], fps[order].view(np.uint64)
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (u[1:] != u[:-1])
    keys, u = keys[first], u[first]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(keys)])
    a, b = [], []
    left = np.repeat(np.where(sizes <= small, starts + sizes, 0), sizes)
    at = np.flatnonzero(left)
    for shift in range(1, small):
        at = at[at + shift < left[at]]
        if not len(at):
            break
        hit = at[np.bitwise_count(u[at] ^ u[at + shift]) <= radius]
        a.append(u[hit])
        b.append(u[hit + shift])
    for s, n in zip(starts[sizes > small], sizes[sizes > small]):
        pairs = np.array(span(u[s : s + n], radius), np.uint64).reshape(-1, 2)
        a.append(pairs[:, 0])
        b.append(pairs[:, 1])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]).view(np.int64), np.concatenate([none, *b]).view(np.int64)


def signed(bits: list[int]) -> int:
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def dealt(classes: DataFrame, radius: int = 3) -> tuple[DataFrame, int]:
    """(key long, fp long) such that classes (fp long, distinct) within radius meet under a key; and the number of classes."""
    rows = classes.count()
    sample = np.array(sorted(r[0] for r in classes.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()), np.int64)
    np.random.default_rng(5).shuffle(sample)
    plans = [(*allocate(sample, g, radius, rows), g) for g in (bit_groups(sample, m) for m in (2, 3))]
    _, thresholds, groups = min(plans, key=lambda p: p[0])
    used = [(i, g, masks(g, t)) for i, (g, t) in enumerate(zip(groups, thresholds)) if t >= 0]

    def value(group: list[int]):
        return F.col("fp").bitwiseAND(F.lit(signed(group)))

    def near(i: int, own, flips: list[int]):
        return F.transform(F.array(*[F.lit(x) for x in flips]), lambda x: F.struct(F.lit(i).alias("part"), own.bitwiseXOR(x).alias("value")))

    # rows that can meet under a value: those of the values around it; leaving out values of few classes errs by SHARE at most
    index = classes.select("fp", F.inline(F.array(*[F.struct(F.lit(i).alias("part"), value(g).alias("value")) for i, g, _ in used])))
    most = max((len(m) for _, _, m in used), default=1)
    warm = index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SHARE / most)
    around = F.lit(None)
    for i, _, m in used:
        around = F.when(F.col("part") == i, near(i, F.col("value"), m)).otherwise(around)
    hot = warm.select("n", F.explode(around).alias("x")).groupBy("x.part", "x.value").agg(F.sum("n").alias("n")).filter(F.col("n") > SHARE)
    hot = cut(hot.select("part", "value", F.lit(True).alias("hot")))
    probes = classes.select("fp", F.inline(F.concat(*[near(i, value(g), m) for i, g, m in used])))
    probes = probes.join(F.broadcast(hot) if hot.limit(10_001).count() <= 10_000 else hot, ["part", "value"], "left")
    # the key's hash only gathers candidates; two keys that collide cost a comparison and lose nothing
    blocks = F.lit(None)
    ones = ((sample.view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).mean(axis=0) if len(sample) else np.zeros(64)
    for i, g, _ in used:
        # the bits that tell most are shared out evenly
        rest = sorted((b for b in range(64) if b not in g), key=lambda b: (abs(ones[b] - 0.5), b))
        cuts = [rest[k :: radius + 1] for k in range(radius + 1)]
        blocks = F.when(F.col("part") == i, F.array(*[F.xxhash64("part", "value", F.lit(k), value(c)) for k, c in enumerate(cuts)])).otherwise(blocks)
    keys = F.when(F.col("hot"), blocks).otherwise(F.array(F.xxhash64("part", "value")))
    return probes.select(F.explode(keys).alias("key"), "fp"), rows


def links(classes: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links that span, bucket by bucket, all classes (fp long, distinct) within radius of one another."""
    keyed, rows = dealt(classes, radius)

    def verify(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got)
            a, b = bucket_links(t.column("key").to_numpy(), t.column("fp").to_numpy(), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    n = max(width(classes), math.ceil(rows * 24 / 400_000))
    return keyed.repartition(n, "key").mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of docs; component_id is the smallest id reachable."""
    marked = cut(fingerprints(docs, id_col, text_col, shingle))
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    stars = components(links(classes.select("fp"), radius))
    rooted = classes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(lows, "root").select("fp", "component_id")
    return marked.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
