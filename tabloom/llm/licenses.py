"""License scans by canonical digest: a text is normalised as a whole, and the SHA-256 of the result is joined to known ones.

Normal form, in this order: lower case; copyright notices dropped; equivalent spellings made one; all that is no letter or digit
becomes one space; outer spaces dropped. The table of known licences is a parameter (name, text); the default holds LICENSES and the
files of license_texts. Its normal forms are made by the same expressions, so a text matches whatever its layout, punctuation and copyright holder.

Nothing but the digests is compared; the known side is broadcast when counted under BROADCAST_ROWS.

Edge cases: null, empty and notice-only texts have the digest of the empty string and no licence; two names with one normal form
give the alphabetically first; repeated rows each get a row; an empty table gives no rows; columns beyond the id and the text are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000

# Equivalent spellings, from left to right.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("non-infringement", "noninfringement"), ("sub-license", "sublicense"), ("https:", "http:"), ("&", " and ")]

# Texts of short public licences and notices.
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY '
    "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
LICENSES = {
    "MIT": "MIT License\n\nCopyright (c) <year> <holder>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": f"ISC License\n\nCopyright (c) <year> <holder>\n\n{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_REST}",
    "0BSD": f"BSD Zero Clause License\n\nCopyright (c) <year> <holder>\n\n{_GRANT}.\n\n{_ISC_REST}",
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nCopyright (C) 2004 Sam Hocevar <sam@hocevar.net>\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
}


#: What follows a copyright notice in a text without its line ends.
STARTS = r"permission\s+(is|to)\b|redistribution\s+and\s+use|this\s+(software|program|library|work|file|is\s+free)\b|everyone\s+is\s+permitted|licensed\s+under|released\s+under|all\s+rights\s+reserved|do\s+what\s+the|[0-9]+\s+franklin\s+st|gnomovision\s+comes"
#: A notice: copyright with a mark, a year or a placeholder anywhere; with a plain name at the start of a line or sentence or after a title.
#: It ends with its line or sentence, or where the licence starts.
NOTICE = (
    r"(?:copyright\s+(?=\(c\)|©|<|\[|[0-9])|©|(?=copyright)(?:(?<=^|\n|\n[ \t]{1,20}|[.;]\s{1,4}|license\s{1,4}))copyright[ \t]+(?=[\p{L}])"
    r"(?!(?:notices?|holders?|owners?|laws?|licenses?|statements?|interests?|disclaimers?|permissions?|treaty|and|or|in|to|of|by|as|is|for|on|on-line|the\s+(?:software|library|program))\b))"
    r"(?:(?!\s(?:" + STARTS + r"))(?!(?<!\b(?:inc|ltd|co|corp|llc|\p{L}))\.(?:\s|$))[^\n])*\.?"
)


def known_licenses() -> dict[str, str]:
    """LICENSES and the texts in license_texts, by name."""
    return LICENSES | {p.stem: p.read_text("utf-8") for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))}


def normal(text: Column) -> Column:
    x = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    x = F.regexp_replace(F.regexp_replace(x, NOTICE, "\n"), r"all\s+rights\s+reserved", " ")
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(F.encode(normal(text), "UTF-8"), 256)


def scan(docs: DataFrame, known: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, digest, license), license null where the text is no known licence."""
    if known is None:
        known = docs.sparkSession.createDataFrame(list(known_licenses().items()), "name string, text string")
    table = known.select(F.col("name"), digest(F.col("text")).alias("digest")).filter(F.col("digest") != F.sha2(F.lit(b""), 256))
    table = table.groupBy("digest").agg(F.min("name").alias("license"))
    if table.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    rows = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest"))
    return rows.join(table, "digest", "left").select("doc_id", "digest", "license")


def oracle(id_col: str = "doc_id", text_col: str = "text", table: str = "documents") -> str:
    def normal_sql(text: str) -> str:
        x = f"regexp_replace(lower(coalesce({text}, '')), '(^|\\n)[^\\n]*(copyright +(\\(c\\)|©|<|[0-9])|©|all rights reserved)[^\\n]*', chr(10), 'g')"
        for a, b in SPELLINGS:
            x = f"replace({x}, '{a}', '{b}')"
        return f"trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in LICENSES.items())
    return f"""
with known as (select sha256({normal_sql("t")}) as digest, min(n) as license from (values {rows}) v(n, t) group by 1)
select d.doc_id, d.digest, k.license
from (select {id_col} as doc_id, sha256({normal_sql(text_col)}) as digest from {table}) d left join known k on k.digest = d.digest"""
