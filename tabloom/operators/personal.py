"""Columns that hold personal data: by type, else by header, else by content.

The content test looks at every filled value, in the profile's own aggregate; the check digits of card numbers are worked out, in one
further job, only for columns most of whose values have a card number's shape. An empty table has no such columns."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tabloom.dataset import Dataset
from tabloom.functions.text import luhn
from tabloom.operators.profile import Profile

# Labels of types, header patterns in the order of testing, and headers whose "name" is not a person's.
TYPE_LABELS = {"email": "email addresses", "phone": "phone numbers", "postcode": "postcodes"}
HEADER_LABELS = [
    (r"(^|[^a-z])(dob|date of birth|birth ?date)([^a-z]|$)", "dates of birth"),
    (r"(^|[^a-z])(ni|nino|national insurance)([^a-z]|$)", "National Insurance numbers"),
    (r"(^|[^a-z])(address|addr|street|city|town)([^a-z]|$)", "addresses"),
    (r"(^|[^a-z])(salary|pay|wage)([^a-z]|$)", "salary details"),
    (r"(^|[^a-z])(phone|mobile|tel|telephone)([^a-z]|$)", "phone numbers"),
    (r"(^|[^a-z])(card ?(no|num|number)?|pan)([^a-z]|$)", "payment card numbers"),
    (r"(^|[^a-z])(name|forename|surname|first ?name|last ?name|full ?name)([^a-z]|$)", "names"),
]
NOT_A_PERSON = r"compan|business|organis|organiz|product|brand|item|file|sheet|host|domain|user ?name"
LEAST_VALUES, LEAST_SHARE = 4, 0.6


def header_label(name: str) -> str | None:
    label = next((label for pattern, label in HEADER_LABELS if re.search(pattern, name, re.I)), None)
    return None if label == "names" and re.search(NOT_A_PERSON, name, re.I) else label


def personal_columns(data: Dataset, prof: Profile) -> dict[str, str]:
    """Label of each column with personal data, in the order of the columns."""
    out: dict[str, str] = {}
    cards = []
    for c in prof.columns:
        label = TYPE_LABELS.get(c.type) or header_label(c.name)
        seen = c.facts["present"]
        if not label and seen >= LEAST_VALUES and c.type in ("string", "mixed", "number"):
            if c.facts["insurance"] >= LEAST_SHARE * seen:
                label = "National Insurance numbers"
            elif c.facts["card_shape"] >= LEAST_SHARE * seen:
                cards.append(c)
        if label:
            out[c.name] = label
    if cards:
        valid = data.df.agg(*[F.count_if(luhn(F.trim(data.text(c.index)))).alias(f"n{c.index}") for c in cards]).first()
        out |= {c.name: "payment card numbers" for c in cards if valid[f"n{c.index}"] >= LEAST_SHARE * c.facts["present"]}
    return {c.name: out[c.name] for c in prof.columns if c.name in out}
