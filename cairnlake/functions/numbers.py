"""Numbers as reports write them: separators, scale words, parentheses for negatives, dashes for nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scale words and their factors (fixed values).
SCALES = {"thousand": 1e3, "million": 1e6, "mn": 1e6, "billion": 1e9, "bn": 1e9, "lakh": 1e5, "lakhs": 1e5, "crore": 1e7, "crores": 1e7}
#: Cells that hold no number (fixed values).
NOTHING = ["", "-", "–", "—", "n/a", "N/A", "na", "NA", "nd", "n.d."]
#: Groups of three behind commas, no-break, narrow or thin spaces, or plain digits; decimals after a point.
DIGITS = r"[0-9]{1,3}(?:[,   ][0-9]{3})++(?:\.[0-9]++)?|[0-9]++(?:\.[0-9]++)?"
#: A number: 1 sign, 2 digits in parentheses (which negate), 3 bare digits, 4 scale word. It starts no word or longer number.
NUMBER = rf"(?i)(?<![\p{{L}}\p{{N}}_.,])([-−–])?(?:\(({DIGITS})\)|({DIGITS}))(?:\s*({'|'.join(sorted(SCALES, key=len, reverse=True))})(?![\p{{L}}\p{{N}}_]))?"
_SPACED = r"^[-(]?[0-9]{1,3}( [0-9]{3})+(\.[0-9]+)?\)?$"


def value_of(sign: Column, inner: Column, bare: Column, scale: Column) -> Column:
    """The value of one match of NUMBER, of its groups; null if it has no digits."""
    digits = F.regexp_replace(F.concat(inner, bare), r"[,   ]", "")
    factor = F.coalesce(F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])[F.lower(scale)], F.lit(1.0))
    value = digits.try_cast("double") * factor
    return F.when((sign != "") | (inner != ""), -value).otherwise(value)


def parse_number(raw: Column) -> Column:
    """The first number of a cell as double; null for dashes, n/a, empty cells and text without a number."""
    text = F.replace(F.trim(F.regexp_replace(raw, r"^\s+|\s+$", "")), F.lit("−"), F.lit("-"))
    text = F.when(text.rlike(_SPACED), F.replace(text, F.lit(" "), F.lit(""))).otherwise(text)
    return F.when(~text.isin(NOTHING), value_of(*[F.regexp_extract(text, NUMBER, k) for k in (1, 2, 3, 4)]))


def number_values(text: Column) -> Column:
    """All numbers of a text in order, as an array of doubles."""
    groups = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(NUMBER), F.lit(k)).alias(f"g{k}") for k in (1, 2, 3, 4)])
    return F.transform(groups, lambda g: value_of(g["g1"], g["g2"], g["g3"], g["g4"]))


def looks_like_year(token: Column) -> Column:
    return F.trim(token).rlike(r"^(19|20)[0-9]{2}$")
