"""Text views, white space, missing markers, numbers and the other scalar helpers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as white space, invisible or an odd space, and the words that mean "missing".
SPACE = r"[\s\x0B   -     　﻿]"
INVISIBLE = r"[​‌‍﻿]"
ODD_SPACE = r"[   -   　]"
SENTINELS = ["na", "n/a", "n.a.", "#n/a", "#na", "null", "none", "nan", "nil", "-", "--"]
# Bytes 0x80 to 0x9F of code page 1252 and the characters that they stand for.
CP1252 = {
    0x80: "€",
    0x82: "‚",
    0x83: "ƒ",
    0x84: "„",
    0x85: "…",
    0x86: "†",
    0x87: "‡",
    0x88: "ˆ",
    0x89: "‰",
    0x8A: "Š",
    0x8B: "‹",
    0x8C: "Œ",
    0x8E: "Ž",
    0x91: "‘",
    0x92: "’",
    0x93: "“",
    0x94: "”",
    0x95: "•",
    0x96: "–",
    0x97: "—",
    0x98: "˜",
    0x99: "™",
    0x9A: "š",
    0x9B: "›",
    0x9C: "œ",
    0x9E: "ž",
    0x9F: "Ÿ",
}


#: The characters of SPACE, for trimming, which needs no pattern.
SPACES = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Texts without these have nothing to squeeze; nearly all cells end at this plain test.
ODD_OR_DOUBLE = "[^!-~ ]|  "


def strip(c: Column) -> Column:
    """Trims every kind of white space."""
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Runs of white space of every kind as one space."""
    return F.when(c.rlike(ODD_OR_DOUBLE), F.regexp_replace(c, rf"{SPACE}+", " ")).otherwise(c)


def cell_text(c: Column, kind: T.DataType) -> Column:
    """Text of a cell: null as empty, whole doubles without a fraction, timestamps as ISO 8601 in UTC, nested values as JSON."""
    if isinstance(kind, T.StringType):
        out = c
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        x = c.cast("double")
        whole = (x == F.floor(x)) & (F.abs(x) < 1e18)
        small = (F.abs(x) >= 1e-6) & (F.abs(x) < 1e18)
        plain = F.regexp_replace(x.cast("string").cast("decimal(38,18)").cast("string"), r"0+$", "")
        out = F.when(F.isnan(x), "NaN").when(whole, x.cast("decimal(38,0)").cast("string")).when(small, F.regexp_replace(plain, r"\.$", "")).otherwise(F.lower(x.cast("string")))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    elif isinstance(kind, T.DateType):
        out = F.concat(F.date_format(c, "yyyy-MM-dd"), F.lit("T00:00:00.000Z"))
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        out = F.to_json(c)
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(""))


def is_empty(text: Column) -> Column:
    return strip(text) == ""


def is_sentinel(text: Column) -> Column:
    return F.lower(strip(text)).isin(SENTINELS)


def is_missing(text: Column, string: bool = True) -> Column:
    return is_empty(text) | is_sentinel(text) if string else is_empty(text)


def clean_space(text: Column) -> Column:
    """Invisible characters out, odd spaces plain, runs of space as one, outer ones off."""
    full = F.regexp_replace(F.regexp_replace(text, INVISIBLE, ""), rf"{SPACE}+", " ")
    return strip(F.when(text.rlike(ODD_OR_DOUBLE), full).otherwise(text))


def has_invisible(text: Column) -> Column:
    return text.rlike(INVISIBLE) | text.rlike(ODD_SPACE)


def demojibake(text: Column) -> Column:
    """Text whose UTF-8 bytes were read as code page 1252, read again; the text itself where that does not hold."""
    raw = F.translate(text, "".join(CP1252.values()), "".join(map(chr, CP1252)))
    latin = raw.rlike(r"^[\u0000-ÿ]*$") & text.rlike(r"[ÂÃà-ï]")
    data = F.encode(F.when(latin, raw), "ISO-8859-1")
    again = data.cast("string")
    good = F.is_valid_utf8(again) & (F.char_length(again) < F.char_length(text)) & ~again.rlike(r"[\u0000-\u0008\u000B\u000C\u000E-\u001F\u007F-\u009F]")
    return F.when(good, again).otherwise(text)


def number(text: Column) -> Column:
    """A plain decimal literal as a double, null for all else; blank is 0, as for a number parser that trims."""
    x = strip(text)
    ok = x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(x == "", F.lit(0.0)).when(ok, x.try_cast("double"))


def undecorated(text: Column) -> Column:
    """A number written with a currency sign, thousands commas or parentheses, as plain digits; null where that changes nothing."""
    return plain_number(clean_space(text))


def plain_number(x: Column) -> Column:
    """undecorated() of a text whose white space is clean.

    Parentheses and a minus sign each turn the sign, so (-5) is 5; a space between digits makes no number."""
    inner = F.trim(F.regexp_replace(x, r"^\((.*)\)$", "$1"))
    body = F.regexp_replace(F.trim(F.regexp_replace(inner, "^-", "")), r"^([^£$€¥]*)[£$€¥]", "$1")
    digits = F.trim(F.replace(body, F.lit(","), F.lit("")))
    negative = x.rlike(r"^\(.*\)$") != x.rlike(r"^-|^\(\s?-.*\)$")
    out = F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), digits)
    return F.when(digits.rlike(r"^\d+(\.\d+)?$") & (out != x), out)


def numeric_value(c: Column, kind: T.DataType) -> Column:
    """The number of a cell for aggregation; booleans, blanks and words give null."""
    if isinstance(kind, T.BooleanType):
        return F.lit(None).cast("double")
    if isinstance(kind, T.NumericType):
        x = c.cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    text = cell_text(c, kind)
    return F.when(~is_empty(text), F.coalesce(number(F.coalesce(undecorated(text), text)), F.lit(None).cast("double")))


def display_number(text: Column) -> Column:
    """A number that may have a currency sign before it, commas in it and a percent sign after it."""
    x = F.replace(F.regexp_replace(strip(text), r"^[£$€]\s?", ""), F.lit(","), F.lit(""))
    x = F.regexp_replace(x, "%$", "")
    return F.when(x.rlike(r"^-?\d+(\.\d+)?$"), x.try_cast("double"))


def fingerprint(text: Column, letters_only: bool = False) -> Column:
    """Lower-case tokens of a cleaned text in sorted order; letters_only leaves out tokens without a letter."""
    x = tokens(text)
    return in_order(lettered(x) if letters_only else x)


def tokens(text: Column) -> Column:
    """Lower-case tokens in their own order, a space between any two; invisible characters vanish, all else that is no letter, digit or @ parts."""
    for c in "\u200b\u200c\u200d\ufeff":
        text = F.replace(text, F.lit(c), F.lit(""))
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}@]+", " ")


def lettered(x: Column) -> Column:
    """tokens() without those that have no letter."""
    return F.regexp_replace(x, r"(?:^| )[\p{N}@]++(?= |\z)", "")


def in_order(x: Column) -> Column:
    """tokens() in sorted order; without lambda functions, as Spark interprets these with all that they read."""
    return F.array_join(F.sort_array(F.array_remove(F.split(x, " "), "")), " ")


def join_key(text: Column) -> Column:
    """Trimmed, inner white space as one space, lower case."""
    return F.lower(squeeze(strip(text)))


def loose_key(text: Column) -> Column:
    """ASCII letters and digits only, without leading zeros."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]", ""), r"^0+(?=\d)", "")


def relaxed_keys(key: Column) -> dict[str, Column]:
    """Repairs of a join key, by name, in the order in which they are tried."""
    value = number(F.replace(key, F.lit(","), F.lit("")))
    value = F.when(strip(key) != "", F.when(value == 0, F.lit(0.0)).otherwise(value))
    return {
        "zero-padding": F.regexp_replace(key, r"\b0+(?=\d)", ""),
        "numeric-format": F.coalesce(value.cast("string"), key),
        "punctuation": F.regexp_replace(key, r"[^a-zA-Z0-9]", ""),
    }


def luhn(text: Column) -> Column:
    """Whether 13 to 19 digits, spaces and hyphens aside, pass the Luhn check."""
    digits = F.regexp_replace(text, r"[\s-]", "")
    size = F.char_length(digits)
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])

    def add(total: Column, i: Column) -> Column:
        d = digit(digits, i)
        return total + F.when((size - i) % 2 == 1, F.get(doubled, d)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add)
    return F.when(digits.rlike(r"^\d{13,19}$"), total % 10 == 0).otherwise(F.lit(False))


def digit(text: Column, place: Column | int) -> Column:
    """The digit at a place from 1, of a text that has one there; a cast of what is none would throw and catch inside."""
    return F.ascii(F.substring(text, place, F.lit(1) if isinstance(place, Column) else 1)) - 48


def edit_budget(shorter: Column) -> Column:
    return F.least(F.lit(3), F.greatest(F.lit(1), F.floor(shorter * 0.12))).cast("int")
