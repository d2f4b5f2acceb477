"""Benchmark decontamination in DataFrame functions only: SimHash of item-sized windows, a multi-index over Hamming blocks,
and an exact weighted-shingle similarity.

Words are runs of letters and digits in lower case. An item is its words; a window is as many words of a document.

1. Windows: each five-word shingle of a document that an item also has proposes every window of the item's size around it, and those are built
   whose shared shingles weigh 0.8 of the item or more, as they must in a window of that similarity; so none is missed here.
   Items' shingles are few; documents' are hashed in place and only those found leave the row, with the words around them. Found
   shingles are gathered by document, item and stretch of two item sizes, so a document that repeats an item is no large group.
2. SimHash: the window's words vote, each with its weight (its length in letters, up to 8), on 64 bits.
3. Multi-index: fingerprints are cut in RADIUS + 1 = 21 blocks; two within 20 bits agree on a block. A window meets just the items with
   which it agrees on one, and is kept within 20 bits, once, at the first block of those. Two texts at the similarity differ in 5 to 12 bits, short ones in a few more.
4. Verification: weighted Jaccard similarity of five-word shingles (of all words, where there are fewer), the weight of a shingle
   being the letters in it; 0.8 or more makes a leak.

Each part of the items' side is broadcast only when its counted rows and words are bounded by BROADCAST_ROWS, and joined by shuffle beyond.

Edge cases: null and empty texts and items match nothing; items of fewer than five words count as one shingle of all their words;
repeated documents each give their rows, repeated item texts each their items, and repeated rows of one id one row with the
largest similarity; empty tables give no rows; columns beyond ids and texts are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import cut, width

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 20, 21
BROADCAST_ROWS = 50_000
#: First bits of the blocks, and the end.
EDGES = [64 * i // BLOCKS for i in range(BLOCKS + 1)]


def words(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: what a lambda mentions from outside is otherwise computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def phrase_hashes(w: Column, n: int) -> Column:
    """Hash of the n words from each place on."""

    def hashes(v: Column) -> Column:
        every = F.transform(v, lambda x, i: F.xxhash64(x, *[F.get(v, i + k) for k in range(1, n)]))
        return F.slice(every, 1, F.greatest(F.size(v) - (n - 1), F.lit(0)))

    return let(w, hashes)


def shingle_hashes(w: Column) -> Column:
    return phrase_hashes(w, SHINGLE)


def places(base: DataFrame, n: int, known: DataFrame, small: bool) -> DataFrame:
    """(doc_id, w, h, pos): where a document has n words whose hash is one of known (h); small: known is of a counted, bounded size."""
    if not small:
        return base.select("doc_id", "w", F.posexplode(phrase_hashes(F.col("w"), n)).alias("pos", "h"))
    # rows without one of them end at the scan
    table, test = among([r[0] for r in known.select("h").distinct().collect()])
    some = base.filter(let(table, lambda t: F.exists(phrase_hashes(F.col("w"), n), lambda h: test(t, h))))
    marks = let(table, lambda t: F.transform(phrase_hashes(F.col("w"), n), lambda h, i: F.when(test(t, h), F.struct(h.alias("h"), i.alias("pos")))))
    return some.select("doc_id", "w", F.explode(F.filter(marks, lambda x: x.isNotNull())).alias("x")).select("doc_id", "w", "x.h", "x.pos")


def simhash(w: Column) -> Column:
    """64 weighted votes, as a long."""
    bits = F.sequence(F.lit(0), F.lit(63))

    def vote(sums: Column, x: Column) -> Column:
        weight = F.least(F.char_length(x), F.lit(8))
        return F.zip_with(sums, bits, lambda s, i: s + F.when(F.getbit(F.xxhash64(x), i) == 1, weight).otherwise(-weight))

    sums = F.aggregate(w, F.array_repeat(F.lit(0), 64), vote)
    set_bits = F.transform(sums, lambda s, i: F.when(s > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(set_bits, F.lit(0).cast("long"), lambda t, x: t.bitwiseOR(x))


def among(known: list[int]):
    """A test whether a hash is one of a few known ones, and the array literal that it reads: an open-addressing table of the hashes' upper
    halves. What passes is joined on the whole hash afterwards, so a false hit costs a row and no more."""
    size = 8
    while size < 3 * len(known):
        size *= 2
    slots, reach = [0] * size, 1  # 0 marks a free slot
    for h in sorted(set(known)):
        at, step = h & (size - 1), 0
        while slots[(at + step) % size]:
            step += 1
        slots[(at + step) % size] = (h >> 32) or 1
        reach = max(reach, step + 1)
    table = F.split(F.lit(",".join(map(str, slots + slots[:reach]))), ",", -1).cast("array<int>")  # folded to a literal by the optimizer

    def test(t: Column, h: Column) -> Column:
        at, top = h.bitwiseAND(F.lit(size - 1)).cast("int"), F.shiftright(h, 32).cast("int")
        top = F.when(top == 0, F.lit(1)).otherwise(top)
        out = F.lit(False)
        for step in reversed(range(reach)):
            got = F.get(t, at + step)
            out = (got == top) | ((got != 0) & out)
        return out

    return table, test


def block_keys(h: Column) -> Column:
    """One key for each block of bits."""
    keys = [F.shiftrightunsigned(h, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) + F.lit(i << 8) for i, (a, b) in enumerate(zip(EDGES, EDGES[1:]))]
    return F.array(*keys)


def shingles(w: Column) -> Column:
    def texts(v: Column) -> Column:
        n = F.greatest(F.size(v) - (SHINGLE - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(v, i, SHINGLE), " "))

    return let(w, texts)


def similarity(wa: Column, wb: Column) -> Column:
    """Weighted Jaccard of two texts' shingles; a shingle's weight is its letters, times its count on each side."""

    def weight(s: Column) -> Column:
        return F.char_length(F.translate(s, " ", ""))

    def count(x: Column, s: Column) -> Column:
        return F.size(F.filter(x, lambda y: y == s))

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda t, s: t + weight(s))

    def jaccard(a: Column, b: Column) -> Column:
        # where either side has no shingle twice, each shared one counts once
        once = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
        plain = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda t, s: t + weight(s))
        counted = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda t, s: t + weight(s) * F.least(count(a, s), count(b, s)))
        low = F.when(once, plain).otherwise(counted)
        return let(low, lambda x: x / F.greatest(total(a) + total(b) - x, F.lit(1)))

    return let(shingles(wa), lambda a: let(shingles(wb), lambda b: jaccard(a, b)))


def windows_of(hits: DataFrame, least: float) -> DataFrame:
    """(doc_id, start_word, n, win, aligned): of shared shingles (doc_id, w, pos, n, item, places, wt, total) all windows that can reach the
    similarity; aligned is the item where a shared shingle has the same place in both."""
    size, n, pos = F.size("w"), F.col("n"), F.col("pos")
    low = F.greatest(pos - (n - SHINGLE), F.lit(0))
    high = F.greatest(F.least(pos, size - n), F.lit(0))
    near = F.struct("pos", "wt", low.alias("low"), high.alias("high"), F.slice("w", low + 1, 2 * n).alias("near"), F.transform("places", lambda p: F.greatest(F.least(pos - p, size - n), F.lit(0))).alias("aligned"))
    # a window starts in one stretch, and ends in it or the next
    stretch = F.explode(F.array_distinct(F.array(F.floor(pos / (2 * n)), F.floor(low / (2 * n)))))
    hits = hits.select("doc_id", F.xxhash64("w").alias("text"), "item", "n", "total", near.alias("x"), stretch.alias("stretch"))
    # letters are whole numbers; half of one is room for rounding
    need = F.col("total") * least - 0.5

    def weight(inside) -> Column:
        return F.aggregate("xs", F.lit(0), lambda t, x: t + F.when(inside(x), x["wt"]).otherwise(0))

    def within(s: Column):
        return lambda x: (x["pos"] >= s) & (x["pos"] <= s + n - SHINGLE)

    groups = hits.groupBy("doc_id", "text", "item", "n", "total", "stretch").agg(F.collect_list("x").alias("xs"))
    groups = groups.filter(weight(lambda x: F.lit(True)) >= need)
    starts = F.array_distinct(F.flatten(F.transform("xs", lambda x: F.sequence(x["low"], x["high"]))))
    starts = F.filter(starts, lambda s: (F.floor(s / (2 * n)) == F.col("stretch")) & (weight(within(s)) >= need))
    found = groups.select("doc_id", "item", "n", "xs", F.explode(starts).alias("start_word"))
    at = F.get(F.filter("xs", within(F.col("start_word"))), F.lit(0))
    aligned = F.when(F.exists("xs", lambda x: F.array_contains(x["aligned"], F.col("start_word"))), F.col("item"))
    return found.select("doc_id", "start_word", "n", F.slice(at["near"], F.col("start_word") - at["low"] + 1, n).alias("win"), aligned.alias("aligned"))


def leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """Rows (doc_id, item_id, similarity, start_word): each document and item that it holds, with the best aligned window of that
    similarity, or the best of all where no aligned one has it."""
    bench = items.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("iw")).filter(F.size("iw") > 0)
    bench = cut(bench.select("item_id", "iw", F.size("iw").alias("n"), simhash(F.col("iw")).alias("ih")))
    size = bench.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    # the index has a row for each block of an item
    few = size.items * BLOCKS <= BROADCAST_ROWS and size.words <= 20 * BROADCAST_ROWS
    short = bench.filter(F.col("n") < SHINGLE).select("n", F.col("iw")).distinct()
    shorts = {r.n: r["count"] for r in short.groupBy("n").count().collect()}
    seeds = bench.filter(F.col("n") >= SHINGLE).select("iw", "n", F.posexplode(shingle_hashes(F.col("iw"))).alias("ipos", "h"))
    # a shingle that an item repeats weighs as often as the item has it
    wt = F.char_length(F.array_join(F.slice("iw", F.col("ipos") + 1, SHINGLE), ""))
    whole = F.aggregate(shingles(F.col("iw")), F.lit(0), lambda t, s: t + F.char_length(F.translate(s, " ", "")))
    seeds = seeds.select(F.xxhash64("iw").alias("item"), "n", "ipos", "h", wt.alias("wt"), whole.alias("total")).distinct()
    seeds = cut(seeds.groupBy("item", "n", "h", "total").agg(F.sum("wt").cast("int").alias("wt"), F.collect_set("ipos").alias("places")))
    small = seeds.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda x: x)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = docs.select("doc_id", words(F.col("text")).alias("w"))
    hits = places(base, SHINGLE, seeds, small).join(hint(seeds), "h")
    windows = windows_of(hits, least)
    for n, count in shorts.items():
        # an item of under five words is one shingle, so a window like it is that phrase itself
        phrases = short.filter(F.col("n") == n).select(F.get(phrase_hashes(F.col("iw"), n), F.lit(0)).alias("h")).distinct()
        bounded = count <= BROADCAST_ROWS
        spots = places(base, n, phrases, bounded).join(F.broadcast(phrases) if bounded else phrases, "h")
        windows = windows.unionByName(spots.select("doc_id", F.col("pos").alias("start_word"), F.lit(n).alias("n"), F.slice("w", F.col("pos") + 1, n).alias("win"), F.lit(None).cast("long").alias("aligned")))
    windows = windows.groupBy("doc_id", "start_word", "n", "win").agg(F.collect_set("aligned").alias("aligned"))
    # dealt out anew, as the windows lie in few partitions and verifying them is the work
    marked = cut(windows.withColumn("h", simhash(F.col("win")))).repartition(max(width(docs), 64)).withColumn("wkey", F.explode(block_keys(F.col("h"))))
    index = bench.select("item_id", "iw", "ih", F.col("n").alias("n_item"), F.explode(block_keys(F.col("ih"))).alias("key"))
    differ = F.col("h").bitwiseXOR(F.col("ih"))
    # a pair that agrees on several blocks is verified at the first of them alone
    before = F.lit(False)
    for i, (lo, hi) in enumerate(zip(EDGES, EDGES[1:-1])):
        mask = ((1 << (hi - lo)) - 1) << lo
        before = before | ((F.col("wkey") >= F.lit((i + 1) << 8)) & (differ.bitwiseAND(F.lit(mask)) == 0))
    met = marked.join(F.broadcast(index) if few else index, (F.col("wkey") == F.col("key")) & (F.col("n") == F.col("n_item")) & (F.bit_count(differ) <= RADIUS) & ~before)
    scored = met.select("doc_id", "item_id", "start_word", F.array_contains("aligned", F.xxhash64("iw")).alias("aligned"), similarity(F.col("win"), F.col("iw")).alias("similarity"))
    # the threshold stands inside the aggregate: as a filter it would be pushed below, and the similarity worked out twice
    best = F.max(F.when(F.col("similarity") >= least, F.struct("aligned", "similarity", (-F.col("start_word")).alias("s")))).alias("best")
    return scored.groupBy("doc_id", "item_id").agg(best).filter("best is not null").select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.s")).alias("start_word"))
