"""Units of one family and their conversion. Rates and currencies keep their own unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

#: symbol, family, factor to the family's base, base (fixed values: 1 MWh = 3.6 GJ and decimal prefixes)
UNITS = [
    ("MtCO2e", "emissions", 1e6, "tCO2e"),
    ("ktCO2e", "emissions", 1e3, "tCO2e"),
    ("tCO2e", "emissions", 1.0, "tCO2e"),
    ("kgCO2e", "emissions", 1e-3, "tCO2e"),
    ("TWh", "energy", 1e6, "MWh"),
    ("GWh", "energy", 1e3, "MWh"),
    ("MWh", "energy", 1.0, "MWh"),
    ("kWh", "energy", 1e-3, "MWh"),
    ("PJ", "energy", 1e6 / 3.6, "MWh"),
    ("TJ", "energy", 1e3 / 3.6, "MWh"),
    ("GJ", "energy", 1 / 3.6, "MWh"),
    ("MJ", "energy", 1e-3 / 3.6, "MWh"),
    ("million m3", "volume", 1e6, "m3"),
    ("thousand m3", "volume", 1e3, "m3"),
    ("ML", "volume", 1e3, "m3"),
    ("m3", "volume", 1.0, "m3"),
    ("kt", "mass", 1e3, "t"),
    ("t", "mass", 1.0, "t"),
    ("%", "percent", 1.0, "%"),
]


def _look_up(unit: Column, column: int) -> Column:
    pairs = [F.lit(x) for u in UNITS for x in (u[0], u[column])]
    return F.create_map(*pairs)[unit]


def factor(unit: Column) -> Column:
    return _look_up(unit, 2)


def family(unit: Column) -> Column:
    return _look_up(unit, 1)


def normalized_value(value: Column, unit: Column) -> Column:
    """Value in its family's base unit; units of no family (rates, currencies) stay as they are."""
    return F.coalesce(value * factor(unit), value)


def normalized_unit(unit: Column) -> Column:
    return F.coalesce(_look_up(unit, 3), unit)


def convert(value: Column, unit: Column, to: Column) -> Column:
    """Null between units of different families."""
    return F.when(family(unit) == family(to), value * factor(unit) / factor(to))


#: Number words and signs for a factor before a unit, and what symbols have instead.
_MANY = {"million": r"million\s+", "thousand": r"(?:thousand\s+|['’]000\s*)"}
_PREFIXES = {"k": "kilo", "M": "mega", "G": "giga", "T": "tera", "P": "peta"}
_GAS = r"(?:CO\s?2(?:[\s‑-]*e(?:q(?:uivalents?)?)?)?|carbon\s+dioxide(?:\s+equivalents?)?)\.?"
_TONNES = r"(?:metric\s+)?ton(?:ne)?s"
_CUBIC = r"(?:m3|cubic\s+met(?:re|er)s)"


def _spellings() -> list[tuple[str, str]]:
    """(symbol, pattern) of all units: a counted noun or a prefixed symbol, with what is longer before what it starts with."""

    def weight(symbol: str, many: str) -> str:
        return rf"{many}(?:{_TONNES}|t)(?:\s+of)?\s*{_GAS}|{symbol}\s?{_GAS}"

    found = [("MtCO2e", weight("Mt", _MANY["million"])), ("ktCO2e", weight("kt", _MANY["thousand"])), ("kgCO2e", rf"kg(?:\s+of)?\s?{_GAS}")]
    found.append(("tCO2e", rf"{_TONNES}(?:\s+of)?\s+{_GAS}|t\s?{_GAS}"))
    for symbol, noun, prefixes in (("Wh", r"watt[\s-]hours?", "TGMk"), ("J", "joules?", "PTGM")):
        found += [(f"{p}{symbol}", rf"{p}{symbol}|{_PREFIXES[p]}{noun}") for p in prefixes]
    found += [(f"{name} m3", many + _CUBIC) for name, many in _MANY.items()]
    found += [("ML", rf"ML|{_PREFIXES['M']}lit(?:re|er)s?"), ("m3", _CUBIC)]
    found += [("kt", rf"thousand\s+{_TONNES}|kt"), ("t", rf"{_TONNES}|t"), ("%", r"%|per\s?cent")]
    return [(unit, pattern if unit == "%" else rf"(?:{pattern})(?![A-Za-z0-9])") for unit, pattern in found]


#: Spellings in the order they are tried.
SPELLINGS = _spellings()


def plain(text: Column) -> Column:
    """Subscript and superscript digits made plain, as unit spellings are matched."""
    return F.translate(text, "₀₁₂₃₄²³", "0123423")


def unit_at_start(text: Column) -> Column:
    """The unit that the text starts with, spellings tried in order; null if none."""
    return let(plain(text), lambda t: F.coalesce(*[F.when(t.rlike(rf"(?i)^\s*(?:{p})"), F.lit(u)) for u, p in SPELLINGS]))


#: Any unit at the start of a text.
UNIT_START = r"(?i)^\s*(?:" + "|".join(p for _, p in SPELLINGS) + ")"


def after_unit(text: Column) -> Column:
    """The text behind the unit that it starts with; it has no signs that `plain` would change in length."""
    return F.regexp_replace(plain(text), UNIT_START, "")


def unit_from_symbol(symbol: Column) -> Column:
    """The unit that the whole text spells; null if none."""
    return let(plain(F.trim(symbol)), lambda s: F.coalesce(*[F.when(s.rlike(rf"(?i)^(?:{p})$"), F.lit(u)) for u, p in SPELLINGS]))


def first_unit(text: Column) -> Column:
    """The unit with the smallest start anywhere in the text; equal starts go to the earlier spelling."""

    def places(label: Column) -> Column:
        at = [F.regexp_instr(label, F.lit(rf"(?i)(?<![A-Za-z])(?:{p})")) for _, p in SPELLINGS]
        found = F.array(*[F.struct(a.alias("at"), F.lit(k).alias("k"), F.lit(u).alias("unit")) for k, (a, (u, _)) in enumerate(zip(at, SPELLINGS, strict=True))])
        return F.array_min(F.filter(found, lambda x: x["at"] > 0))["unit"]

    return let(plain(text), places)
