"""Expressions for dates, contact details, business identifiers and the type of a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions.text import SPACE, clean_space, digit, strip

# Patterns of values.
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"
POSTCODE = r"^([A-Za-z]{1,2}\d[A-Za-z\d]?)\s*(\d[A-Za-z]{2})$"
PHONE = r"^\+?[\d\s\-().]{7,20}$"
URL = r"(?i)^https?://\S+$"
DATE_ISO = r"^\d{4}-\d{1,2}-\d{1,2}([T ].*)?$"
DATE_NUM = r"^\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}$"
DATE_DAY_MONTH = r"^\d{1,2}\s+[A-Za-z]{3,9}\.?,?\s+\d{2,4}$"
DATE_MONTH_DAY = r"^[A-Za-z]{3,9}\.?\s+\d{1,2},?\s+\d{2,4}$"
OFFSET = r"(?i)(z|[+-]\d{2}:?\d{2})\s*$"
NUMBER = r"^-?[\d,]+(\.\d+)?%?$"
MONEY = r"^[£$€]\s?-?[\d,]+(\.\d+)?$"
IPV4 = r"^\d{1,3}(\.\d{1,3}){3}$"
BOOLEAN_VOTES = ["true", "false", "yes", "no", "y", "n", "1", "0"]
TRUE_WORDS, FALSE_WORDS = ["true", "yes", "y", "t"], ["false", "no", "n", "f"]
NATIONAL_INSURANCE = r"(?i)^[A-CEGHJ-PR-TW-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]$"
CARD_SHAPE = r"^\d(?:[\s-]*\d){12,18}$"
EXCEL_DATE = r"(?i)^(\d{1,2}-(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)|(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)-\d{2})$"
EXCEL_POWER = r"(?i)^\d(\.\d+)?E\+\d{1,3}$"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
TYPES = ["email", "url", "postcode", "date", "number", "boolean", "phone", "string"]


def looks_like_date(x: Column) -> Column:
    return x.rlike(DATE_ISO) | x.rlike(DATE_NUM) | x.rlike(DATE_DAY_MONTH) | x.rlike(DATE_MONTH_DAY)


def value_type(text: Column) -> Column:
    """The type that a value votes for; empty text for blanks."""
    return vote(strip(text))


def vote(x: Column) -> Column:
    """value_type() of a trimmed text."""
    return (
        F.when(x == "", "empty")
        .when(x.rlike(EMAIL), "email")
        .when(x.rlike(URL), "url")
        .when(x.rlike(POSTCODE), "postcode")
        .when(looks_like_date(x), "date")
        .when(x.rlike(NUMBER) | x.rlike(MONEY), "number")
        .when(F.lower(x).isin(BOOLEAN_VOTES), "boolean")
        .when(x.rlike(IPV4), "string")
        .when(x.rlike(PHONE) & (F.char_length(F.regexp_replace(x, r"\D", "")) >= 7), "phone")
        .otherwise("string")
    )


def whole_year(y: Column) -> Column:
    return y + F.when(y >= 100, 0).when(y >= 70, 1900).otherwise(2000)


def month_of(word: Column) -> Column:
    """1 to 12 for an English month's name, its first three letters or `sept`."""
    names = {n: i + 1 for i, pair in enumerate(zip(MONTHS, MONTH_NAMES)) for n in pair} | {"sept": 9}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.lower(word))


def valid_date(y: Column, m: Column, d: Column) -> Column:
    """The date, or null where there is no such day or a part is null."""
    return F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-"), F.lpad(d.cast("string"), 2, "0")).try_cast("date")


def date_parts(text: Column) -> Column:
    """Struct of what a text in one of the four shapes of dates holds; a column of its own where parse_parts() reads it."""
    x = strip(text)

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(x, pattern, group)

    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ].*)?$"
    num = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})$"
    words = r"^(?:(\d{1,2})\s+)?([A-Za-z]{3,9})\.?(?:(?<=[A-Za-z.])\s+(\d{1,2}))?,?\s+(\d{2,4})$"
    is_dm, is_md = x.rlike(DATE_DAY_MONTH), x.rlike(DATE_MONTH_DAY)
    number = lambda c: c.try_cast("int")
    return F.struct(
        F.when(x.rlike(DATE_ISO), "iso").when(x.rlike(DATE_NUM), "num").when(is_dm | is_md, "words").alias("shape"),
        F.when(x.rlike(DATE_ISO), F.array(*[number(part(iso, k)) for k in (1, 2, 3)])).alias("iso"),
        F.when(x.rlike(DATE_ISO) & F.regexp_extract(x, r"[T ](.*)$", 1).rlike(OFFSET), F.to_date(F.to_utc_timestamp(F.try_to_timestamp(x), "UTC"))).alias("shifted"),
        F.when(x.rlike(DATE_NUM), F.array(*[number(part(num, k)) for k in (1, 2)], whole_year(number(part(num, 3))))).alias("num"),
        F.when(is_dm | is_md, F.array(whole_year(number(part(words, 4))), month_of(part(words, 2)), number(F.when(is_dm, part(words, 1)).otherwise(part(words, 3))))).alias("words"),
    )


def parse_parts(p: Column, order: str = "DMY") -> Column:
    """Struct (date, ambiguous, swapped, converted) of date_parts(); date is null where there is none.

    order is the order asked of numeric dates; the other one is tried where it gives no day."""
    iso, num, words = ([F.get(p[k], F.lit(i)) for i in range(3)] for k in ("iso", "num", "words"))
    dmy, mdy = valid_date(num[2], num[1], num[0]), valid_date(num[2], num[0], num[1])
    asked, other = (mdy, dmy) if order == "MDY" else (dmy, mdy)
    is_num, no = p["shape"] == "num", F.lit(False)
    date = F.when(p["shape"] == "iso", F.coalesce(p["shifted"], valid_date(*iso))).when(is_num, F.coalesce(asked, other)).when(p["shape"] == "words", valid_date(*words))
    return F.struct(
        date.alias("date"),
        F.coalesce(is_num & (num[0] <= 12) & (num[1] <= 12) & (num[0] != num[1]), no).alias("ambiguous"),
        F.coalesce(is_num & asked.isNull() & other.isNotNull(), no).alias("swapped"),
        p["shifted"].isNotNull().alias("converted"),
    )


def parse_date(text: Column, order: str = "DMY") -> Column:
    """Struct (date, ambiguous, swapped, converted) of a text in one of four shapes."""
    return parse_parts(date_parts(text), order)


def show_date(date: Column, style: str = "iso") -> Column:
    """iso 2024-01-31, uk 31/01/2024, us 01/31/2024."""
    return F.date_format(date, {"iso": "yyyy-MM-dd", "uk": "dd/MM/yyyy", "us": "MM/dd/yyyy"}[style])


def normal_email(text: Column) -> Column:
    """Lower case without white space or a mailto: prefix; null where that is no address."""
    x = F.regexp_replace(F.lower(F.regexp_replace(text, rf"{SPACE}+", "")), r"^mailto:", "")
    return F.when(x.rlike(EMAIL), x)


def group_uk(n: Column) -> Column:
    """Ten national digits in the usual groups, with the country code."""

    def cut(*sizes: int) -> Column:
        at, parts = 1, [F.lit("+44")]
        for s in sizes:
            parts.append(F.substring(n, at, s))
            at += s
        return F.concat_ws(" ", *parts)

    return F.when(n.startswith("7"), cut(4, 6)).when(n.startswith("2"), cut(2, 4, 4)).otherwise(cut(3, 3, 4))


def normal_phone(text: Column) -> Column:
    """The canonical phone number; the text itself for 7 to 15 bare digits; null for what is no number."""
    d = F.regexp_replace(text, r"[^\d+]", "")
    d = F.concat(F.when(d.startswith("+"), F.lit("+")).otherwise(F.lit("")), F.regexp_replace(d, r"\+", ""))
    return (
        F.when(d.rlike(r"^\+44\d{10}$"), group_uk(F.substring(d, 4, 10)))
        .when(d.rlike(r"^44\d{10}$"), group_uk(F.substring(d, 3, 10)))
        .when(d.rlike(r"^0\d{10}$"), group_uk(F.substring(d, 2, 10)))
        .when(d.rlike(r"^\+\d{7,15}$"), d)
        .when(d.rlike(r"^\d{7,15}$"), text)
    )


def normal_postcode(text: Column) -> Column:
    x = F.upper(clean_space(text))
    return F.when(x.rlike(POSTCODE), F.regexp_replace(x, POSTCODE, "$1 $2"))


def normal_vat(text: Column) -> Column:
    """GB and 9 or 12 digits whose weighted sum passes either modulus rule; null else."""
    d = F.regexp_replace(F.regexp_replace(F.upper(text), r"[\s-]", ""), r"^GB", "")
    total = sum((digit(d, i + 1) * (8 - i) for i in range(7)), F.lit(0)) + digit(d, 8) * 10 + digit(d, 9)
    valid = F.when(d.rlike(r"^(\d{9}|\d{12})$"), (total % 97).isin(0, 42))  # 55 more would be divisible too
    return F.when(valid, F.concat(F.lit("GB"), d))


def normal_sort_code(text: Column) -> Column:
    d = F.regexp_replace(text, r"\D", "")
    return F.when(d.rlike(r"^\d{6}$"), F.regexp_replace(d, r"^(..)(..)(..)$", "$1-$2-$3"))


def normal_company(text: Column) -> Column:
    """8 digits, padded on the left, or two letters and 6 digits."""
    x = F.upper(F.regexp_replace(text, rf"{SPACE}+", ""))
    return F.when(x.rlike(r"^\d{1,8}$"), F.lpad(x, 8, "0")).when(x.rlike(r"^[A-Z]{2}\d{6}$"), x)
