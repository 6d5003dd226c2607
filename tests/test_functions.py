"""Scalar functions on single values."""

import collections
import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnlake.functions import numbers, periods, scoring, text, units
from cairnlake.functions.text import in_parts


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], f"{schema}, k int").select(column.alias("out"), "k").orderBy("k").select("out").collect()]


@pytest.mark.parametrize(
    ("raw", "value"),
    [
        ("1,234", 1234.0), ("(1,234.5)", -1234.5), ("-12", -12.0), ("−7", -7.0), ("–310", -310.0), ("2.5 million", 2.5e6), ("3 bn", 3e9), ("12 lakh", 1.2e6), ("2.5 crore", 2.5e7), ("12 345", 12345.0),
        ("$ 99", 99.0), ("–", None), ("n/a", None), ("", None), (None, None), ("none", None), ("abc", None), ("0.5", 0.5), ("40k", 40.0), ("5 m", 5.0), ("a (7) b", -7.0), ("v1.5 12", 12.0),
    ],
)
def test_parse_number(spark, raw, value):
    assert values(spark, [(raw,)], "raw string", numbers.parse_number(F.col("raw"))) == [value]


@pytest.mark.parametrize(
    ("label", "unit"),
    [("Energy (MWh)", "MWh"), ("tonnes of CO2e", "tCO2e"), ("million tonnes CO2e", "MtCO2e"), ("kt CO₂e", "ktCO2e"), ("thousand m³ of water", "thousand m3"), ("megalitres", "ML"), ("waste, tonnes", "t"), ("share in %", "%"), ("headcount", None), ("GWh then kWh", "GWh"), ("gigajoules", "GJ")],
)
def test_first_unit(spark, label, unit):
    assert values(spark, [(label,)], "label string", units.first_unit(F.col("label"))) == [unit]


def test_unit_conversion(spark):
    rows = [(3.6, "GJ", "MWh"), (1.0, "TJ", "GJ"), (5.0, "t", "MWh"), (2.0, "EUR", "EUR"), (None, "MWh", "GJ")]
    assert values(spark, rows, "v double, a string, b string", F.round(units.convert(F.col("v"), F.col("a"), F.col("b")), 9)) == [1.0, 1000.0, None, None, None]
    assert values(spark, rows, "v double, a string, b string", F.round(units.normalized_value(F.col("v"), F.col("a")), 9)) == [1.0, 277.777777778, 5.0, 2.0, None]
    # two sources that state the same energy in two units disagree only beyond 1 %
    assert values(spark, [(1_500_000.0, "GJ", "MWh")], "v double, a string, b string", F.round(units.convert(F.col("v"), F.col("a"), F.col("b")), 0)) == [416667.0]


def test_fiscal_years(spark):
    days = [(dt.date(2024, 3, 31), "03-31"), (dt.date(2024, 4, 1), "03-31"), (dt.date(2024, 2, 29), "02-29"), (dt.date(2023, 12, 31), "12-31"), (dt.date(2023, 5, 5), "bad"), (dt.date(2023, 5, 5), None)]
    year = periods.fiscal_year_of(F.col("d"), F.col("f"))
    assert values(spark, days, "d date, f string", year) == [2024, 2025, 2024, 2023, 2023, 2023]
    ends = values(spark, [(2025, "02-29"), (2024, "02-29"), (2024, "06-31")], "y int, f string", periods.year_end_day(F.col("y"), F.col("f")))
    assert ends == [dt.date(2025, 2, 28), dt.date(2024, 2, 29), dt.date(2024, 6, 30)]
    starts = values(spark, [(d,) for d in ends], "d date", periods.start_for_end(F.col("d")))
    assert starts == [dt.date(2024, 2, 29), dt.date(2023, 3, 1), dt.date(2023, 7, 1)]


def test_period_match_tolerance(spark):
    year = (dt.date(2024, 1, 1), dt.date(2024, 12, 31))
    rows = [(*year, *year), (dt.date(2024, 2, 1), dt.date(2025, 1, 31), *year), (dt.date(2024, 3, 1), dt.date(2025, 2, 28), *year), (dt.date(2023, 1, 1), dt.date(2025, 12, 31), *year), (None, year[1], *year)]
    match = periods.period_matches(F.col("s"), F.col("e"), F.col("ps"), F.col("pe"))
    assert values(spark, rows, "s date, e date, ps date, pe date", match) == [True, True, False, False, False]


@pytest.mark.parametrize(("label", "year"), [("FY2025", 2025), ("CY2024", 2024), ("FY24", 2024), ("FY2024/25", 2025), ("2023/24", 2024), ("FY1999/00", 2000), ("2023/25", None), ("in 2021", 2021), ("2020 and 2021", None), ("the year ended 31 March 2022", 2022), ("nothing", None)])
def test_label_year(spark, label, year):
    assert values(spark, [(label,)], "label string", periods.label_year(F.col("label"))) == [year]


def test_text_functions(spark):
    rows = [("The companies' policies, classes and CO2 was reused",), ("",)]
    assert values(spark, rows, "t string", text.tokens(F.col("t"))) == [["company", "policy", "class", "co2", "reused"], []]
    assert values(spark, [("boxes, pies and CO₂ ﬁnance gas",)], "t string", text.tokens(F.col("t"))) == [["box", "pie", "co2", "finance", "gas"]]
    assert values(spark, [("Page 12 – Annual Report 2024!",)], "t string", text.running_key(F.col("t"))) == ["page # annual report #"]
    assert values(spark, [("One ends. Two (ends)! (three) go; and on",)], "t string", text.sentences(F.col("t"))) == [["One ends.", "Two (ends)!", "(three) go; and on"]]
    assert values(spark, [(1234.5,), (12.3456,), (100.0,), (2.0,)], "v double", text.format_value(F.col("v"))) == ["1,234", "12.346", "100", "2"]
    assert values(spark, [("ﬁne­ tuning",), ("plain",), (None,)], "t string", text.normalized(F.col("t"))) == ["fine tuning", "plain", None]
    assert values(spark, [("xx secret yy",)], "t string", text.snippet(F.col("t"), "secret", 2)) == ["x secret y"]
    first, again, other = values(spark, [(1, "a"), (1, "a"), (2, "a")], "n int, t string", text.evidence_id(F.col("n"), F.col("t")))
    assert first == again != other and first.startswith("ev_") and len(first) == 23


def test_all_numbers_of_a_text(spark):
    assert values(spark, [("12,345.5 of -(3) and v2.0, 1.2 million",), ("none",), (None,)], "t string", numbers.number_values(F.col("t"))) == [[12345.5, -3.0, 1.2e6], [], None]


def test_periods_are_found_with_their_places(spark):
    rows = [("from 1 April 2024 to 31 March 2025 (FY2025)",), ("30 Feb 2024",), ("FY2024/25, CY2023 and 2020/21, 2021/24",), (None,)]
    found = values(spark, rows, "t string", F.transform(periods.find_periods(F.col("t"), F.lit("03-31")), lambda m: F.concat_ws("|", m["from"].cast("string"), m["label"], m["start"].cast("string"), m["explicit"].cast("string"))))
    assert found == [["0|FY2025|2024-04-01|true", "36|FY2025|2024-04-01|false"], [], ["0|FY2025|2024-04-01|false", "11|CY2023|2023-01-01|false", "22|FY2021|2020-04-01|false"], None]


def test_priority(spark):
    rows = [(3, "not_found", 0.0, 10), (1, "partially_supported", 0.75, None), (2, "conflicting", 1.0, 100), (2, "supported", 1.0, 5), (3, "partially_supported", 0.99, 400)]
    assert values(spark, rows, "i int, s string, c double, d int", scoring.priority(F.col("i"), F.col("s"), F.col("c"), F.col("d"))) == [1.0, 0.05, 0.336, 0.0, 0.04]


@pytest.mark.parametrize(
    "text, fye, want",
    [
        ("12 months ending on December 31, 2023", "12-31", [("FY2023", "2023-01-01", "2023-12-31", True)]),
        ("from 1 April 2023 to 31 March 2024 and FY2024", "03-31", [("FY2024", "2023-04-01", "2024-03-31", True), ("FY2024", "2023-04-01", "2024-03-31", False)]),
        ("31 March 2024 to 1 April 2023", "03-31", [("FY2024", "2023-04-01", "2024-03-31", False), ("FY2023", "2022-04-01", "2023-03-31", False)]),
        ("the year ended 29 February 2024", "12-31", [("FY2024", "2023-03-01", "2024-02-29", True)]),
        ("30 February 2024", "12-31", [("FY2024", "2024-01-01", "2024-12-31", False)]),
        ("FY1999/00, 1999/2000 and 12,2001", "12-31", [("FY2000", "2000-01-01", "2000-12-31", False)]),
        ("in 2024", "not a day", [("FY2024", "2024-01-01", "2024-12-31", False)]),
        (None, "12-31", None),
        ("", None, []),
    ],
)
def test_period_mentions(spark, text, fye, want):
    found = values(spark, [(text, fye)], "t string, f string", periods.period_mentions(F.col("t"), F.col("f")))[0]
    assert (found and [(m["label"], str(m["start"]), str(m["end"]), m["explicit"]) for m in found]) == (want or found)
    assert (found is None) == (want is None)


def test_labels_in_arrays(spark):
    found = values(spark, [(["FY2024", None, "2023 and 2022", "2021"],), (None,), ([],)], "t array<string>", periods.periods_of_labels(F.col("t"), F.lit("12-31")))
    assert [[p and p["label"] for p in ps] if ps is not None else None for ps in found] == [["FY2024", None, None, "FY2021"], None, []]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 200])
def test_texts_are_changed_in_parts(n):
    texts = [None if k % 7 == 3 else f"é{k}" for k in range(n)]
    whole = pa.array([None, *texts], pa.string()).slice(1)  # a batch may be a slice
    found = in_parts(whole, str.upper)
    assert found.type == pa.string() and found.to_pylist() == [t and t.upper() for t in texts]


def test_known_terms_are_counted_as_tokens_finds_them(spark, monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choice("aeisxyzb1") for _ in range(rng.randint(1, 9))) + rng.choice(["", "s", "es", "ies", "ss", "sses"]) for _ in range(300)] + text.STOP_WORDS
    texts = [None, "", "H\u0331 \u1e96 \u0130 \u212a so\u00adft \ufb01ve \u3386", "boxes" * 50 + " boxes"]
    texts += ["".join(rng.choice([w, w.upper()]) + rng.choice([" ", ", ", "-", "\u00e9 ", "\n", "\u00ad"]) for w in rng.choices(words, k=rng.randint(0, 30))) for _ in range(300)]
    want = [collections.Counter(r["x"] or ()) for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", text.tokens(F.col("t")).alias("x")).orderBy("k").collect()]
    terms = sorted({t for held in want for t in held})[::2] + ["unseen"]
    for piece in (text.PIECE, 40):
        monkeypatch.setattr(text, "PIECE", piece)
        sizes, *found = text.KnownTerms(terms).count(pa.array(["before", *texts], pa.string()).slice(1))
        assert sizes.tolist() == [sum(held.values()) for held in want]
        assert list(zip(*(x.tolist() for x in found), strict=True)) == [(k, j, held[t]) for k, held in enumerate(want) for j, t in enumerate(terms) if held[t]]
