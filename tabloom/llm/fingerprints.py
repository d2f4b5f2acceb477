"""Document fingerprints: a Merkle tree over sections, paragraphs and leaves of a few words, in DataFrame functions only.

A text is cut without loss: sections end after blank lines, paragraphs after a line's end, leaves after up to two words, each with the white
space beside it. A leaf's digest is the XXH64 of its text; a paragraph's the MD5 of its leaves' digests in order, a section's that of its
paragraphs' and the root the SHA-256 of the sections'. So roots are equal just where texts are.

The fingerprint is the tree itself, as text (see `tree`), and all else is read from it: roots test equality; where they differ, the first
section that differs, and in it the first paragraph, locate the edit (`first_edited_paragraph`); and likeness is the share of the
distinct leaves that both have (Dice). It has about four characters for five of the text.

The next document in id order comes without a global sort: splitters are ids taken from the table, a row goes to the bucket between
two of them, and a splitter's own row also goes to the bucket before, where it closes the order. Texts are shuffled once.

Edge cases: a null text counts as empty; repeated ids are ordered by text; null ids come first; the last row's next is the first
row, which for a single row is itself; an empty table gives no rows; columns beyond the id and the text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Pieces that a text is cut in; each pattern covers every character.
SECTION = r"(?s).+?(?:\n[ \t\r]*+\n\s*+|\z)"
PARAGRAPH = r"[^\n]*+\n|[^\n]++"
LEAF = r"\s*+\S++(?:[ \t]++\S++)?+\s*+|\s++"
#: So many opening words of a text are leaves of their own too, so that texts of a few words can be likened.
OPENING = 8
#: Hex digits that a leaf and an inner node have in a fingerprint.
LEAF_DIGITS, NODE_DIGITS = 6, 16
#: Bytes of text that a bucket of neighbouring ids holds, about; and the most buckets, whose splitters are in the plan.
BUCKET_BYTES, MOST_BUCKETS = 4 << 20, 100_000


def short(digest: Column) -> Column:
    return F.substring(digest, 1, NODE_DIGITS)


def leaves(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(LEAF), 0), lambda x: F.lpad(F.hex(F.xxhash64(x)), 16, "0"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def paragraph(text: Column) -> Column:
    """Digest, ":" and the leaves of a paragraph."""
    return let(leaves(text), lambda x: F.concat(short(F.md5(F.array_join(x, "").cast("binary"))), F.lit(":"), F.array_join(F.transform(x, lambda d: F.substring(d, 1, LEAF_DIGITS)), "")))


def section(text: Column) -> Column:
    """Digest and, each after a "/", the paragraphs of a section."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), 0), paragraph)
    tops = lambda x: F.array_join(F.transform(x, lambda p: F.substring(p, 1, NODE_DIGITS)), "")
    return let(parts, lambda x: F.concat(short(F.md5(tops(x).cast("binary"))), F.lit("/"), F.array_join(x, "/")))


def tree(text: Column) -> Column:
    """A text's fingerprint: root, then each after a ";" the sections, then after a "#" the leaves of the opening words."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(SECTION), 0), section)
    tops = lambda x: F.array_join(F.transform(x, lambda p: F.substring(p, 1, NODE_DIGITS)), "")
    words = F.filter(F.slice(F.split(F.trim(F.substring_index(text, "\n", 1)), r"\s+", OPENING + 1), 1, OPENING), lambda x: x != "")
    opening = F.array_join(F.transform(words, lambda x: F.substring(F.lpad(F.hex(F.xxhash64(F.lit("word"), x)), 16, "0"), 1, LEAF_DIGITS)), "")
    return F.lower(let(parts, lambda x: F.concat(F.sha2(tops(x).cast("binary"), 256), F.array_join(F.transform(x, lambda p: F.concat(F.lit(";"), p)), ""), F.lit("#"), opening)))


def leaf_set(fingerprint: Column) -> Column:
    """Distinct leaves of a fingerprint; the opening words' are marked."""
    one = F.lit(f".{{{LEAF_DIGITS}}}")
    inner = F.transform(F.regexp_extract_all(fingerprint, F.lit(":([0-9a-f]*)"), 1), lambda x: F.regexp_extract_all(x, one, 0))
    opening = F.transform(F.regexp_extract_all(F.substring_index(fingerprint, "#", -1), one, 0), lambda d: F.concat(F.lit("w"), d))
    return F.array_distinct(F.concat(F.flatten(inner), opening))


def likeness(a: Column, b: Column, leaves_a: Column, leaves_b: Column) -> Column:
    """Of two fingerprints and their leaf_set()s."""
    both = F.size(F.array_intersect(leaves_a, leaves_b))
    total = F.size(leaves_a) + F.size(leaves_b)
    return F.when(a == b, F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(2.0 * both / total)


def first_difference(a: Column, b: Column) -> Column:
    """The place from 1 of the first paragraph of fingerprint a that b has not there, 0 where the roots are equal.

    From the top: sections before the first that differs are told by their digests alone."""

    def children(x: Column, gap: str) -> Column:
        return F.slice(F.split(x, gap, -1), 2, 1 << 30)

    def first(x: Column, y: Column) -> Column:
        """Place from 1 of the first node that differs; one more than the shorter list has where it opens the longer one."""
        differs = F.zip_with(x, y, lambda p, q: ~F.substring(p, 1, NODE_DIGITS).eqNullSafe(F.substring(q, 1, NODE_DIGITS)))
        return F.array_position(differs, True).cast("int")

    def below(x: Column, y: Column) -> Column:
        def at(s: Column) -> Column:
            before = F.aggregate(F.slice(x, 1, s - 1), F.lit(0), lambda t, z: t + F.size(F.split(z, "/", -1)) - 1)
            return before + first(children(F.coalesce(F.get(x, s - 1), F.lit("")), "/"), children(F.coalesce(F.get(y, s - 1), F.lit("")), "/"))

        return let(first(x, y), at)

    def nodes(x: Column) -> Column:
        return children(F.substring_index(x, "#", 1), ";")

    return F.when(a == b, F.lit(0)).otherwise(let(nodes(a), lambda x: let(nodes(b), lambda y: below(x, y))))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, next): each row with the text that follows it in id order, the first after the last."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size, least = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.min("doc_id")).first()
    count = min(max(1, math.ceil(size / BUCKET_BYTES)), MOST_BUCKETS)
    if least is None:
        cuts: list[int] = []
    else:
        # a quantile sketch returns ids of the table itself; its size follows the number of cuts, not the rows
        found = base.agg(F.percentile_approx("doc_id", [i / count for i in range(1, count)] or [0.5], max(10_000, 4 * count))).first()[0]
        cuts = sorted({int(x) for x in found} - {least})
    # [first id of each bucket], a literal once optimised; null ids are in the first bucket
    firsts = F.split(F.lit(",".join(map(str, cuts))), ",", -1).cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, len(cuts).bit_length())))])

    def bisect(id_: Column) -> Column:
        """How many of the first ids are no greater."""
        return F.aggregate(halves, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.get(firsts, at + step - 1) <= id_), at + step).otherwise(at))

    placed = base.withColumn("bucket", F.coalesce(bisect(F.col("doc_id")), F.lit(0)))
    opens = F.coalesce(F.get(firsts, F.col("bucket") - 1) == F.col("doc_id"), F.lit(False)) if cuts else F.lit(False)
    placed = placed.withColumn("opens", opens)
    head = base.agg(F.min_by(F.struct("doc_id", "text"), F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"), F.xxhash64("text"))).alias("x")).select("x.*")
    ghosts = placed.filter("opens").groupBy("bucket").agg(F.min_by("text", F.struct("doc_id", F.xxhash64("text"))).alias("text"))
    ghosts = ghosts.select(F.lit(None).cast("long").alias("doc_id"), "text", (F.col("bucket") - 1).alias("bucket"), F.lit(True).alias("ghost"))
    last = head.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(len(cuts)).alias("bucket"), F.lit(True).alias("ghost"))
    rows = placed.select("doc_id", "text", "bucket", F.lit(False).alias("ghost")).unionByName(ghosts).unionByName(last)
    w = W.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return rows.withColumn("next", F.lead("text").over(w)).filter(~F.col("ghost")).select("doc_id", "text", "next")


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_sections,
    first_edited_paragraph); the edited text's last half is replaced by the first code points of the next document."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next"), F.lit(1), half)))
    for name in ("text", "edited", "next"):
        rows = rows.withColumn(f"tree_{name}", tree(F.col(name)))
    for name in ("text", "edited", "next"):
        rows = rows.withColumn(f"leaf_{name}", leaf_set(F.col(f"tree_{name}")))
    mine, edited, following = F.col("tree_text"), F.col("tree_edited"), F.col("tree_next")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        mine.alias("fingerprint"),
        edited.alias("edited_fingerprint"),
        likeness(mine, edited, F.col("leaf_text"), F.col("leaf_edited")).alias("near_edited"),
        likeness(mine, following, F.col("leaf_text"), F.col("leaf_next")).alias("near_next"),
        F.greatest(F.size(F.split(mine, ";", -1)) - 1, F.lit(0)).alias("n_sections"),
        first_difference(mine, edited).alias("first_edited_paragraph"),
    )
