"""Exact removal of repeated byte strings by a sampled, distributed suffix array.

Every window of `least` bytes (200) names an anchor: the start of the smallest hashed k-gram among its first HEAD bytes,
the leftmost on ties. Equal windows name the same anchor at the same distance, so the suffixes that begin at anchors, with
the bytes before them as far as HEAD reaches, decide every window; there is one such suffix for about 70 bytes.

1. One narrow pass finds anchors and hashes the TAIL = least - HEAD + k bytes that follow; these lie in every window that
   names the anchor. A count with map-side combine keeps the hashes seen twice, and a join keeps their anchors.
2. For these the texts give the suffix of `least` bytes and the bytes before it. Sampled splitters range-partition the
   suffixes by their leading bytes, so that all with one lead meet; identical suffixes of one batch travel once, with a
   list of their places. Each bucket is sorted by multikey quicksort, eight bytes a round, on unresolved runs alone;
   runs that share the lead are compared window by window, and each anchor's first and last repeated windows make
   one interval (all its windows hold the anchor, so the interval is gapless).
   A lead with more than HOT suffixes is not gathered: its windows are counted by hash, with map-side combine.
3. Intervals are grouped by document, merged and cut out of the text.

Matches never cross documents and are judged on the input. Edge cases: a null text counts as empty; documents
under `least` bytes lose nothing; repeated rows and repeated or missing ids are documents of their own; an empty table gives
no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import binary_parts, cut, identified, sliced, width

K = 8
#: Texts whose suffixes give the splitters.
SPLIT_SAMPLE = 2_000
#: A lead with more suffixes than this is counted by window hash instead of gathered; so many, all different, take about 170 MB.
HOT = 500_000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3 * 0x10001 | 1)
_BYTE = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)


def words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    n = len(buf) - K + 1
    out = np.empty(max(n, 0), np.uint64)
    for r in range(min(K, max(n, 0))):
        part = np.frombuffer(buf.data, "<u8", (len(buf) - r) // 8, r)
        out[r::8] = part
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = x * _MULT
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def anchors(buf: np.ndarray, offsets: np.ndarray, least: int, head: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of all windows of the texts in buf: each one's text and its place in buf."""
    starts, ends = offsets[:-1], offsets[1:]
    span, found = head - K + 1, []
    block = 1 << 17
    for lo in range(0, max(len(buf) - least + 1, 0), block):
        hi = min(lo + block, len(buf) - least + 1)
        part = np.ascontiguousarray(buf[lo : hi + head])
        low = (mix(words(part)) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(part) - K + 1, dtype=np.uint64)
        reach = 1
        while 2 * reach <= span:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < span:
            low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
        at = (low[: hi - lo] & np.uint64(0xFFFFFFFF)).astype(np.int64) + lo
        p = np.arange(lo, hi)
        doc = np.searchsorted(ends, p, "right")
        ok = p + least <= ends[doc]
        at, doc = at[ok], doc[ok]
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        found.append((doc[new], at[new]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc, at = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    return doc[new], at[new]


def lead_hash(buf: np.ndarray, at: np.ndarray, tail: int) -> np.ndarray:
    w = words(buf)
    h = np.zeros(len(at), np.uint64)
    for step in [*range(0, tail - K, K), tail - K]:
        h = mix((h ^ w[at + step]) + np.uint64(step + 1))
    return h.view(np.int64)


def multikey_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of byte rows of equal width, and for each sorted row the bytes it shares with the one before.

    A round sorts by the next eight bytes, but only rows that are still tied with a neighbour."""
    n, length = rows.shape
    padded = np.zeros((n, -(-length // 8) * 8), np.uint8)
    padded[:, :length] = rows
    keys = np.ascontiguousarray(padded).view(">u8").astype(np.uint64)
    order, run = np.arange(n), np.zeros(n, np.int64)
    shared = np.zeros(n, np.int64)
    open_ = np.arange(n)
    for r in range(keys.shape[1]):
        if len(open_) < 2:
            break
        k = keys[order[open_], r]
        by = np.lexsort((k, run[open_]))
        order[open_], k = order[open_][by], k[by]
        g = run[open_]
        same_run = np.r_[False, g[1:] == g[:-1]]
        split = same_run & np.r_[False, k[1:] != k[:-1]]
        if split.any():
            diff = k[split] ^ k[np.flatnonzero(split) - 1]
            lead = np.zeros(len(diff), np.int64)
            for b in range(7, 0, -1):
                lead += (diff >> np.uint64(8 * (8 - (8 - b)))) == 0
            shared[open_[split]] = np.minimum(8 * r + lead, length)
        tied = same_run & ~split
        shared[open_[tied]] = min(8 * (r + 1), length)
        run[open_] = np.maximum.accumulate(np.where(~tied, open_, 0))
        keep = tied | np.r_[tied[1:], False]
        open_ = open_[keep]
    return order, shared


def repeated(ctx: np.ndarray, left: np.ndarray, right: np.ndarray, many: np.ndarray, least: int, back: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest and smallest distance d before the anchor at which the window of each context repeats; -1 where none does.

    A context holds `back` bytes before the anchor (the last `left` are real) and `least` from it (the first `right`)."""
    n = len(ctx)
    most, fewest = np.where(many, left, -1), np.where(many, least - right, least)
    cols = np.ascontiguousarray(ctx.T)
    top = np.uint64(pow(int(_BASE), least - 1, 1 << 64))
    h = np.zeros(n, np.uint64)
    for c in range(back + least - 1, back - 1, -1):
        h = h * _BASE + _BYTE[cols[c]]
    for d in range(back + 1):
        if d:
            h = _BYTE[cols[back - d]] + _BASE * (h - _BYTE[cols[back - d + least]] * top)
        ok = np.flatnonzero((d <= left) & (least - d <= right))
        if len(ok) < 2:
            continue
        s = np.sort(h[ok])
        twice = s[1:][s[1:] == s[:-1]]
        if not len(twice):
            continue
        twice = twice[np.r_[True, twice[1:] != twice[:-1]]]
        hit = ok[twice[np.minimum(np.searchsorted(twice, h[ok]), len(twice) - 1)] == h[ok]]
        most[hit] = np.maximum(most[hit], d)
        fewest[hit] = np.minimum(fewest[hit], d)
    return most, fewest


def spans(docs: DataFrame, least: int, head: int) -> DataFrame:
    """Intervals (uid, s, e) of repeated bytes of docs (uid, body binary); they may overlap."""
    spark, tail, back = docs.sparkSession, least - head + K, head - K
    parts = width(docs)

    def find(batches):
        for batch in sliced(batches, 1):
            buf, offsets = binary_parts(batch.column(1))
            doc, at = anchors(buf, offsets, least, head)
            lead = lead_hash(buf, at, tail) if len(at) else np.zeros(0, np.int64)
            uid = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(lead), pa.array(uid[doc].astype(np.int64)), pa.array((at - offsets[doc]).astype(np.int32))], ["lead", "uid", "at"])

    found = docs.mapInArrow(find, "lead long, uid long, at int")
    seen = cut(found.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("hot", F.col("n") > HOT).drop("n"))
    places = found.join(seen.hint("shuffle_hash"), "lead").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("at", "hot"))).alias("places"))

    def sample_leads(batches):
        for batch in sliced(batches, 0):
            buf, offsets = binary_parts(batch.column(0))
            _, at = anchors(buf, offsets, least, head)
            yield pa.RecordBatch.from_arrays([pa.array([buf[a : a + tail].tobytes() for a in at[::4]], pa.binary())], ["lead"])

    rows = max(docs.count(), 1)
    some = docs.filter(F.pmod(F.xxhash64("uid", F.lit(7)), F.lit(max(1, rows // SPLIT_SAMPLE))) == 0).select("body")
    leads = np.array(sorted(r[0] for r in some.mapInArrow(sample_leads, "lead binary").orderBy(F.xxhash64("lead")).limit(50 * SPLIT_SAMPLE).collect()), f"S{tail}")
    buckets = max(parts, min(4 * parts, math.ceil(rows / 1500)))
    splitters = np.unique(leads[:: max(1, len(leads) // buckets)]) if len(leads) else leads

    def contexts(batches):
        for batch in sliced(batches, "body"):
            buf, offsets = binary_parts(batch.column("body"))
            uids = batch.column("uid").to_numpy(zero_copy_only=False)
            lists = batch.column("places")
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            at = flat.field("at").to_numpy(zero_copy_only=False).astype(np.int64)
            hot = flat.field("hot").to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(uids)), lengths)
            pad = np.concatenate([np.zeros(back, np.uint8), buf, np.zeros(least, np.uint8)])
            around = np.lib.stride_tricks.sliding_window_view(pad, back + least)
            for lo in range(0, len(at), 8_000):
                d, a, w = doc[lo : lo + 8_000], at[lo : lo + 8_000], hot[lo : lo + 8_000]
                left = np.minimum(a, back)
                right = np.minimum(offsets[d + 1] - offsets[d] - a, least)
                ctx = around[offsets[d] + a]
                for i in np.flatnonzero((left < back) | (right < least)):  # bytes of the neighbouring texts
                    ctx[i, : back - left[i]] = 0
                    ctx[i, back + right[i] :] = 0
                whole = ctx.view(f"S{back + least}").reshape(-1)
                to = np.searchsorted(splitters, ctx[:, back : back + tail].copy().view(f"S{tail}").reshape(-1), "right") if len(splitters) else np.zeros(len(a), np.int64)
                order = np.lexsort((right, left, whole))
                keys = [x[order] for x in (whole, left, right)]
                new = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)] if len(order) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                cuts = pa.array(np.r_[first, len(order)].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(to[order][first].astype(np.int32)),
                        pa.array(w[order][first]),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(back + least), len(first), [None, pa.py_buffer(np.ascontiguousarray(ctx[order][first]))]).cast(pa.binary()),
                        pa.array(left[order][first].astype(np.int32)),
                        pa.array(right[order][first].astype(np.int32)),
                        pa.ListArray.from_arrays(cuts, pa.array(uids[d[order]].astype(np.int64))),
                        pa.ListArray.from_arrays(cuts, pa.array(a[order].astype(np.int32))),
                    ],
                    ["bucket", "hot", "ctx", "left", "right", "uids", "ats"],
                )

    ctx = docs.join(places.hint("shuffle_hash"), "uid").mapInArrow(contexts, "bucket int, hot boolean, ctx binary, left int, right int, uids array<long>, ats array<int>")

    def unpack(t: pa.Table) -> tuple:
        raw, at = binary_parts(t.column("ctx"))
        return raw.reshape(-1, back + least), t.column("left").to_numpy().astype(np.int64), t.column("right").to_numpy().astype(np.int64)

    def emit(t: pa.Table, most: np.ndarray, fewest: np.ndarray):
        uids, ats = t.column("uids").combine_chunks(), t.column("ats").combine_chunks()
        n = uids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        keep = np.repeat(most >= 0, n)
        at = ats.flatten().to_numpy().astype(np.int64)[keep]
        s, e = at - np.repeat(most, n)[keep], at + least - np.repeat(fewest, n)[keep]
        return pa.RecordBatch.from_arrays([pa.array(uids.flatten().to_numpy()[keep]), pa.array(s), pa.array(e)], ["uid", "s", "e"])

    def bucket(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        del got
        rows_, left, right = unpack(t)
        order, shared = multikey_order(rows_[:, back:])
        inner = np.r_[False, shared[1:] >= tail]
        run = np.cumsum(~inner) - 1
        # whole runs of one lead, about 8000 suffixes at a time
        sizes = np.bincount(run)
        stop = np.cumsum(sizes)
        lo = 0
        while lo < len(order):
            hi = int(stop[min(np.searchsorted(stop, lo + 8_000), len(stop) - 1)])
            part = order[lo:hi]
            lo = hi
            sub = t.take(pa.array(part))
            many = sub.column("uids").combine_chunks().value_lengths().to_numpy(zero_copy_only=False) > 1
            c, l, r = rows_[part], left[part], right[part]
            yield emit(sub, *repeated(c, l, r, many, least, back))

    cold = ctx.filter(~F.col("hot")).repartition(max(parts, buckets), "bucket").mapInArrow(bucket, "uid long, s long, e long")

    def window_hashes(batches):
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            rows_, left, right = unpack(t)
            uids, ats = t.column("uids").combine_chunks(), t.column("ats").combine_chunks()
            n = uids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(n) - n
            uid, at = uids.flatten().to_numpy()[first], ats.flatten().to_numpy()[first]
            for d in range(back + 1):
                ok = (d <= left) & (least - d <= right)
                h = np.zeros(len(rows_), np.uint64)
                for c in range(back - d + least - 1, back - d - 1, -1):
                    h = h * _BASE + _BYTE[rows_[:, c]]
                h = mix(h ^ np.uint64(d)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[ok]), pa.array(n[ok]), pa.array(uid[ok]), pa.array(at[ok]), pa.array(np.full(int(ok.sum()), d, np.int32))], ["h", "n", "uid", "at", "d"])

    if seen.filter("hot").limit(1).count():
        # a context and its places are told by the first of these
        many = cut(ctx.filter("hot"))
        windows = many.mapInArrow(window_hashes, "h long, n long, uid long, at int, d int")
        twice = windows.groupBy("h").agg(F.sum("n").alias("total")).filter("total > 1").select("h")
        ends = windows.join(twice, "h").groupBy("uid", "at").agg(F.max("d").alias("most"), F.min("d").alias("fewest"))
        lists = many.select(F.get("uids", F.lit(0)).alias("uid"), F.get("ats", F.lit(0)).alias("at"), F.arrays_zip("uids", "ats").alias("places"))
        ends = lists.join(ends, ["uid", "at"]).select("most", "fewest", F.explode("places").alias("x"))
        cold = cold.unionByName(ends.select(F.col("x.uids").alias("uid"), (F.col("x.ats") - F.col("most")).cast("long").alias("s"), (F.col("x.ats") + least - F.col("fewest")).cast("long").alias("e")))
    return cold


def merged(s: np.ndarray, e: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(s.tolist(), e.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 200, head: int = 150, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary, removed array of [start, end)) and docs' columns of carry."""
    base, ids = identified(docs, id_col, text_col, carry)
    found = spans(base.select("uid", "body"), least, head)
    found = found.groupBy("uid").agg(F.collect_set(F.struct("s", "e")).alias("cuts"))

    def take_out(batches):
        for batch in sliced(batches, "body"):
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed")}
            for body, cuts in zip(batch.column("body"), batch.column("cuts").to_pylist()):
                body = body.as_py()
                gone = merged(np.array([c["s"] for c in cuts]), np.array([c["e"] for c in cuts])) if cuts else []
                kept, at = [], 0
                for s, e in gone:
                    kept.append(body[at:s])
                    at = e
                kept = b"".join([*kept, body[at:]])
                for k, v in zip(out, (len(body), len(body) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept, [{"start": s, "end": e} for s, e in gone])):
                    out[k].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("uid"), *(pa.array(v, t) for v, t in zip(out.values(), kinds))], ["uid", *out])

    schema = "uid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, removed array<struct<start: long, end: long>>"
    out = base.select("uid", "body").join(found.hint("shuffle_hash"), "uid", "left").select("uid", "body", "cuts").mapInArrow(take_out, schema)
    if ids is not None:
        return out.join(ids.hint("shuffle_hash"), "uid").drop("uid").select("doc_id", *out.columns[1:], *carry)
    return out.select(F.col("uid").cast(docs.schema[id_col].dataType).alias("doc_id"), *out.columns[1:])
