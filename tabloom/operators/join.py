"""Diagnosed equi-join: normalised keys, provenance of matches, reasons for misses, fan-out and key inference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.dataset import ROW, Dataset, dense
from tabloom.functions.text import is_missing, join_key, loose_key, relaxed_keys, strip

TYPES = {"inner": "inner", "left": "left", "full": "full"}
#: Rows of either side that key inference looks at; share of overlap under which there is no key; head start of identifier names.
SAMPLE, LEAST_OVERLAP, MARGIN = 2000, 0.2, 0.01
# Words in headers that tell identifiers.
ID_WORDS = r"(?i)(^|[^a-z])(id|ids|uid|ref|reference|code|sku|key|account|acct|no|number|email)([^a-z]|$)"


@dataclass(frozen=True)
class Joined:
    """table: the joined rows with _lrow and _rrow, which order them, and without row numbers; numbered() gives it those."""

    table: Dataset
    left: DataFrame  # _row, key columns, usable
    right: DataFrame
    keys: tuple[tuple[str, str], ...]
    kind: str
    error: str | None = None

    def numbered(self) -> Dataset:
        """The table with dense row numbers in the order of (left row, right row), rows of the right alone last.

        Every operator that tells rows apart needs these; the joined rows are sorted and written once for them."""
        if self.error:
            return self.table
        rows = dense(self.table.df, F.col("_lrow").asc_nulls_last(), F.col("_rrow").asc_nulls_first())
        return self.table.with_(rows.drop("_lrow", "_rrow"))

    def provenance(self) -> dict:
        """Matched left rows by how they match: exactly, but for white space, or but for case."""
        hits = self._hits().agg(F.max("exact").alias("e"), F.max("spaced").alias("s"))
        r = hits.agg(F.count_if("e").alias("exact"), F.count_if(~F.col("e") & F.col("s")).alias("space"), F.count_if(~F.col("e") & ~F.col("s")).alias("case")).first()
        return {"exact": r["exact"], "whitespace_only": r["space"], "case_only": r["case"]}

    def _hits(self):
        n = range(len(self.keys))
        r = self.right.select(*[F.col(f"k{i}").alias(f"rk{i}") for i in n], *[F.col(f"b{i}").alias(f"rb{i}") for i in n])
        on = [F.col(f"k{i}") == F.col(f"rk{i}") for i in n]
        both = self.left.join(r, on)
        exact, spaced = F.lit(True), F.lit(True)
        for i in n:
            exact = exact & (F.col(f"b{i}") == F.col(f"rb{i}"))
            spaced = spaced & (F.regexp_replace(strip(F.col(f"b{i}")), r"\s+", " ") == F.regexp_replace(strip(F.col(f"rb{i}")), r"\s+", " "))
        return both.select(ROW, exact.alias("exact"), spaced.alias("spaced")).groupBy(ROW)

    def unmatched_left(self) -> DataFrame:
        """(_row, key, reason, would_match): empty-key, zero-padding, numeric-format, punctuation or absent, in this order of repair."""
        n = range(len(self.keys))
        r = self.right.select(*[F.col(f"k{i}").alias(f"rk{i}") for i in n]).filter(_all_usable("rk", n)).distinct()
        miss = self.left.join(r, [F.col(f"k{i}") == F.col(f"rk{i}") for i in n], "left_anti").withColumn("key", _label("b", n))
        miss = miss.withColumn("_usable", _all_usable("k", n))
        names = list(relaxed_keys(F.lit("")))
        for name in names:
            mine, theirs = [relaxed_keys(F.col(f"k{i}"))[name] for i in n], [relaxed_keys(F.col(f"k{i}"))[name] for i in n]
            joined = F.when(F.col("_usable"), F.concat_ws("\u0000", *mine))
            miss = miss.withColumn("_relaxed", joined)
            near = self.right.filter(_all_usable("k", n)).withColumn("_relaxed", F.concat_ws("\u0000", *theirs))
            near = near.groupBy("_relaxed").agg(F.min_by(_label("b", n), ROW).alias(f"_{name}"))
            miss = miss.join(near, "_relaxed", "left").drop("_relaxed")
        reason, would = F.lit("absent"), F.lit(None).cast("string")
        for name in reversed(names):
            hit = F.col(f"_{name}").isNotNull()
            reason, would = F.when(hit, F.lit(name)).otherwise(reason), F.when(hit, F.col(f"_{name}")).otherwise(would)
        return miss.select(ROW, "key", F.when(~F.col("_usable"), F.lit("empty-key")).otherwise(reason).alias("reason"), F.when(F.col("_usable"), would).alias("would_match"))

    def unmatched_right(self) -> DataFrame:
        """(_row, key, reason): absent or empty-key."""
        n = range(len(self.keys))
        l = self.left.select(*[F.col(f"k{i}").alias(f"lk{i}") for i in n]).filter(_all_usable("lk", n)).distinct()
        miss = self.right.join(l, [F.col(f"k{i}") == F.col(f"lk{i}") for i in n], "left_anti")
        return miss.select(ROW, _label("b", n).alias("key"), F.when(_all_usable("k", n), F.lit("absent")).otherwise("empty-key").alias("reason"))

    def fan_out(self) -> DataFrame:
        """(_row, matches) of left rows with several partners; counted per key on the right before the join."""
        n = range(len(self.keys))
        r = self.right.groupBy(*[F.col(f"k{i}").alias(f"rk{i}") for i in n]).agg(F.count(F.lit(1)).alias("matches")).filter("matches > 1")
        hit = self.left.join(r, [F.col(f"k{i}") == F.col(f"rk{i}") for i in n])
        return hit.select(ROW, "matches").orderBy(F.desc("matches"), ROW)

    def expansion(self) -> float:
        left = self.left.count()
        return self.table.df.count() / left if left else 1.0

    def findings(self) -> list[dict]:
        if self.error:
            return [{"rule": "join-no-key", "severity": "error", "count": 0, "title": self.error}]
        out = []
        reasons = {r.reason: r["count"] for r in self.unmatched_left().groupBy("reason").count().collect()}
        missed = sum(v for k, v in reasons.items() if k != "empty-key")
        repairable = {k: v for k, v in reasons.items() if k in ("zero-padding", "numeric-format", "punctuation")}
        if missed:
            out.append({"rule": "join-unmatched", "severity": "warning", "count": missed, "title": f"{missed} left row(s) found no partner"})
        for k, v in repairable.items():
            out.append({"rule": "join-key-format", "severity": "warning", "count": v, "title": f"{v} row(s) would match but for {k}"})
        if reasons.get("empty-key"):
            out.append({"rule": "join-empty-key", "severity": "warning", "count": reasons["empty-key"], "title": f"{reasons['empty-key']} left row(s) have no key"})
        fan = self.fan_out().count()
        if fan:
            out.append({"rule": "join-fan-out", "severity": "warning", "count": fan, "title": f"{fan} left row(s) match several right rows"})
        p = self.provenance()
        odd = p["whitespace_only"] + p["case_only"]
        if odd:
            out.append({"rule": "join-key-inconsistent", "severity": "info", "count": odd, "title": f"{odd} match(es) differ in white space or case"})
        dropped = self.unmatched_right().count()
        if dropped and self.kind != "full":
            out.append({"rule": "join-dropped-right", "severity": "info", "count": dropped, "title": f"{dropped} right row(s) are not in the result"})
        if reasons.get("absent") and repairable:
            out.append({"rule": "join-absent", "severity": "info", "count": reasons["absent"], "title": f"{reasons['absent']} left key(s) are nowhere on the right"})
        return out


def _all_usable(prefix: str, n) -> Column:
    out = F.lit(True)
    for i in n:
        out = out & F.col(f"{prefix}{i}").isNotNull()
    return out


def _label(prefix: str, n) -> Column:
    return F.coalesce(F.nullif(F.concat_ws(" · ", *[F.nullif(strip(F.col(f"{prefix}{i}")), F.lit("")) for i in n]), F.lit("")), F.lit("(blank)"))


def _keyed(data: Dataset, at: list[int]) -> DataFrame:
    """Rows with, for each key column, its text b and its normal form k, null where unusable, so that it never matches."""
    out = data.df
    for n, i in enumerate(at):
        out = out.withColumn(f"b{n}", data.text(i))
        out = out.withColumn(f"k{n}", F.when(~is_missing(data.text(i), data.is_string(i)), join_key(data.text(i))))
    return out


def key_rates(left: Dataset, right: Dataset) -> list[tuple[str, float]]:
    """Shared headers and the overlap of their loose keys, on the first rows of both; best first."""
    out = []
    for h in dict.fromkeys(left.headers):
        i, j = left.index(h), right.index(h)
        if j is None:
            continue

        def sampled(d: Dataset, c: int, name: str) -> DataFrame:
            rows = d.df.orderBy(ROW).limit(SAMPLE).select(F.when(~is_missing(d.text(c), d.is_string(c)), loose_key(d.text(c))).alias(name))
            return rows.filter(F.col(name).isNotNull() & (F.col(name) != ""))

        l, r = sampled(left, i, "a"), sampled(right, j, "b").distinct()
        got = l.join(r, F.col("a") == F.col("b"), "left").agg(F.count(F.lit(1)).alias("n"), F.count("b").alias("m")).first()
        out.append((h, got.m / got.n if got.n else 0.0))
    return out


def infer_key(left: Dataset, right: Dataset) -> str | None:
    import re

    best, rate = None, -1.0
    for h, r in key_rates(left, right):
        ahead = r > rate + MARGIN or (abs(r - rate) <= MARGIN and re.search(ID_WORDS, h) and not (best and re.search(ID_WORDS, best)))
        if best is None or ahead:
            best, rate = h, r
    return best if rate >= LEAST_OVERLAP else None


def join_tables(left: Dataset, right: Dataset, kind: str = "left", keys: list[tuple[str, str]] | None = None, suffixes: tuple[str, str] = (" (left)", " (right)")) -> Joined:
    """Joins on normalised keys. Without keys, infers one; without a usable one, returns the left table and an error finding."""
    if keys is None:
        name = infer_key(left, right)
        keys = [(name, name)] if name else []
    at = [(left.index(a), right.index(b)) for a, b in keys]
    if not at or any(a is None or b is None for a, b in at):
        return Joined(left, left.df, right.df, (), kind, "No column of both tables can serve as key")
    lk, rk = [a for a, _ in at], [b for _, b in at]
    l, r = _keyed(left, lk), _keyed(right, rk)
    rest = [j for j in range(len(right)) if j not in rk]
    taken, other = set(left.headers), {right.headers[j] for j in rest}
    headers = [h + suffixes[0] if h in other else h for h in left.headers] + [right.headers[j] + (suffixes[1] if right.headers[j] in taken else "") for j in rest]
    n = range(len(at))
    rr = r.select(*[F.col(f"c{j}").alias(f"r{j}") for j in range(len(right))], F.col(ROW).alias("_rrow"), *[F.col(f"k{i}").alias(f"rk{i}") for i in n])
    ll = l

    def lone(key: Column, side: str, row: str) -> Column:
        # a row without a key stays in an outer join; a key of its own keeps all such rows out of one task, and matches nothing
        return F.coalesce(key, F.concat(F.lit("\u0000" + side), F.col(row).cast("string")))

    if kind != "inner":
        ll = ll.withColumns({f"k{i}": lone(F.col(f"k{i}"), "l", ROW) for i in n})
    if kind == "full":
        rr = rr.withColumns({f"rk{i}": lone(F.col(f"rk{i}"), "r", "_rrow") for i in n})
    both = ll.join(rr, [F.col(f"k{i}") == F.col(f"rk{i}") for i in n], TYPES[kind])
    cols = []
    for i in range(len(left)):
        if kind == "full" and i in lk:
            j = rk[lk.index(i)]
            mine, theirs = F.col(f"c{i}"), F.col(f"r{j}")
            if left.kinds[i] != right.kinds[j]:
                mine, theirs = mine.cast("string"), theirs.cast("string")
            cols.append(F.when(F.col(ROW).isNull(), theirs).otherwise(mine).alias(f"c{i}"))
        else:
            cols.append(F.col(f"c{i}"))
    cols += [F.col(f"r{j}").alias(f"c{len(left) + p}") for p, j in enumerate(rest)]
    out = both.select(*cols, F.col(ROW).alias("_lrow"), "_rrow")
    return Joined(Dataset(out, tuple(headers)), l, r, tuple(keys), kind)
