"""Queries that write sentences and table rows about orders and suppliers, and read the values back out of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.periods import find_periods, period_of_label
from ..operators.extraction import first_of_equal_metrics, passage_metrics, rate_metrics, sentence_metrics, table_row_metrics
from ..sources.tables import dealt, table
from ..streaming.rate_limit import limited_batch


def _amount(column: str) -> F.Column:
    return F.format_number(F.floor(F.col(column)), 0)


def _written(choice: F.Column, *ways: F.Column) -> F.Column:
    return F.element_at(F.array(*ways), (choice % len(ways) + 1).cast("int"))


def metric_extraction_text(spark, sf_dir):
    """SCL-19..23, WIN-11, WIN-12: sentences of ten wordings, read back into typed values with period and qualifiers."""
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").cast("string").alias("y")), "o_orderkey")
    n, y = _amount("o_totalprice"), F.col("y")
    text = _written(
        F.col("o_orderkey"),
        F.concat(F.lit("Scope 1 emissions were "), n, F.lit(" tCO2e in FY"), y, F.lit(". Nothing else changed.")),
        F.concat(F.lit("Total energy use fell to "), n, F.lit(" MWh, of which "), n, F.lit(" GJ came from gas in FY"), y, F.lit(".")),
        F.concat(F.lit("Sites generated "), n, F.lit(" tonnes of waste in FY"), y, F.lit("; total waste was "), n, F.lit(" t.")),
        F.concat(F.lit("We drew "), n, F.lit(" visitors in FY"), y, F.lit(".")),
        F.concat(F.lit("Water withdrawal was "), n, F.lit(" m3.")),
        F.concat(F.lit("Scope 1 and 2 emissions came to "), n, F.lit(" ktCO2e in FY"), y, F.lit(".")),
        F.concat(F.lit("Scope 2 emissions (location-based) were "), n, F.lit(" tCO2e in 2024, compared with "), n, F.lit(" tCO2e in 2023.")),
        F.concat(F.lit("In the 2019 base year, Scope 1 emissions were "), n, F.lit(" tCO2e.")),
        F.concat(F.lit("We reduced emissions by an estimated "), n, F.lit(" tonnes of CO₂e in FY"), y, F.lit(" against the prior year.")),
        F.concat(F.lit("Emissions intensity was "), n, F.lit(" kgCO2e per tonne (restated) in FY"), y, F.lit(".")),
    )
    found = sentence_metrics(orders.select(F.col("o_orderkey").alias("id"), text.alias("text")))
    return found.select("id", "metric_key", "value", "unit", "normalized_value", "year", "confidence", "base_year", "method", "restated", "estimated")


def rate_extraction(spark, sf_dir):
    """SCL-24: rates without units, and the year nearest to them."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").cast("string").alias("n"))
    text = _written(
        F.col("id"),
        F.concat(F.lit("Safety matters. The LTIFR was "), F.col("n"), F.lit(".5 in 2024, from 9.1 in 2019.")),
        F.concat(F.lit("Our total recordable incident rate stood at "), F.col("n"), F.lit(".25 hours.")),
        F.lit("TRIR 2023 is given elsewhere: 1.5"),
    )
    return rate_metrics(suppliers.select("id", text.alias("text"))).select("id", "metric_key", "value", "period_label", "period_inferred", "confidence")


def period_finder(spark, sf_dir):
    """SCL-12..16: periods in the six wordings, with a March year end; a label's own period."""
    orders = dealt(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("y")), "id")
    y, before, short = F.col("y").cast("string"), (F.col("y") - 1).cast("string"), F.substring(F.col("y").cast("string"), 3, 2)
    text = _written(
        F.col("id"),
        F.concat(F.lit("from 1st April "), before, F.lit(" to March 31, "), y, F.lit(", that is FY"), y),
        F.concat(F.lit("the financial year ended 30 June "), y),
        F.concat(F.lit("FY"), before, F.lit("/"), short, F.lit(" and CY"), before),
        F.concat(F.lit("fiscal year "), y, F.lit(", "), before, F.lit("/"), short),
        F.concat(F.lit("the 31 June "), y),
        y,
    )
    found = orders.select("id", text.alias("text")).withColumn("found", find_periods(F.col("text"), F.lit("03-31")))
    named = period_of_label(F.col("text"), F.lit("03-31"))
    labels = F.array_join(F.transform("found", lambda m: F.concat_ws(":", m["from"].cast("string"), m["label"])), " ")
    return found.select("id", labels.alias("labels"), named["start"].cast("string").alias("start"), named["end"].cast("string").alias("end"), named["explicit"].alias("explicit"))


def table_row_extraction(spark, sf_dir):
    """SCL-25: rows of a two-year table, read back into typed values."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    n = F.format_number(F.floor(F.abs("s_acctbal")), 0)
    label = _written(
        F.col("s_suppkey"), F.lit("Electricity consumption (MWh)"), F.lit("Scope 2 emissions, tCO2e"), F.lit("Waste generated (thousand tonnes)"), F.lit("Headcount"),
        F.lit("Natural gas"), F.lit("GHG intensity (kgCO2e per unit)"), F.lit("LTIFR"),
    )
    context = F.when(F.col("s_suppkey") % 7 == 4, "Energy use in GJ").otherwise("")
    values = F.array(n, F.when(F.col("s_suppkey") % 5 == 0, "–").otherwise(F.concat(F.lit("("), n, F.lit(")"))))
    rows = suppliers.select(F.col("s_suppkey").alias("id"), label.alias("label"), context.alias("context"), F.array(F.lit("FY2024"), F.lit("earlier")).alias("headers"), values.alias("values"))
    return table_row_metrics(rows).select("id", "metric_key", "unit", "year", "value", "normalized_value", "confidence")


def passage_extraction(spark, sf_dir):
    """SCL-25, SCL-26, SEG-19: passages of each kind read by what they are, with sections, captions, default periods and a March year end;
    one of equal values of a passage."""
    n = F.format_number(F.floor(F.abs("s_acctbal")), 0)
    way = F.col("s_suppkey") % 6
    period = F.struct(F.lit("FY2021").alias("label"), F.lit("2020-04-01").cast("date").alias("start"), F.lit("2021-03-31").cast("date").alias("end"))
    cells = F.struct(
        F.lit("Waste generated").alias("label"), F.array(n, F.lit("–"), F.lit("5"), F.lit("7")).alias("values"), F.array(F.lit("FY2024"), F.lit("FY2023"), F.lit("note")).alias("headers"),
        F.lit("restated, in thousand tonnes").alias("caption"),
    )
    text = _written(
        F.col("s_suppkey"),
        F.concat(F.lit("Energy consumption was "), n, F.lit(" MWh in FY2024. Energy consumption was "), n, F.lit(" MWh in FY2024.")),
        F.concat(n, F.lit("\u00a0tCO2e, biogenic")),
        F.concat(F.lit("Sites took "), n, F.lit(" m3 in 2022.")),
        F.concat(F.lit("Energy consumption "), n, F.lit(" MWh")),
        F.lit("Waste generated"),
        F.concat(F.lit("Energy consumers bought "), n, F.lit(" MWh in FY2024. LTIFR was 1.5 in FY2024.")),
    )
    passages = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("passage_id"), text.alias("text"), F.when(way == 2, "Water withdrawal").alias("section"),
        _written(F.col("s_suppkey"), *[F.lit(k) for k in ("paragraph", "list_item", "paragraph", "heading", "table_row", "paragraph")]).alias("kind"),
        F.when(way == 4, cells).alias("cells"), F.when(way == 1, 0.9).otherwise(1.0).alias("confidence"), F.lit("03-31").alias("fiscal_year_end"), period.alias("default_period"),
    )
    found = first_of_equal_metrics(passage_metrics(passages), passage="passage_id", order="place")
    return found.select(
        "passage_id", "metric_key", "value", "unit", "normalized_value", "period_label", F.col("period_end").cast("string").alias("period_end"), "period_inferred", "restated", "confidence", "source",
    )


def rate_limit_replay(spark, sf_dir):
    """STR-1: verdicts of a limiter of two an hour, where only accepted events count."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return limited_batch(events, limit=2, seconds=3600).select("event_id", "accepted")


QUERIES = {f.__name__: f for f in (metric_extraction_text, rate_extraction, period_finder, table_row_extraction, passage_extraction, rate_limit_replay)}

ORACLES = {
    "metric_extraction_text": """WITH o AS (SELECT o_orderkey AS id, floor(o_totalprice) AS n, year(o_orderdate)::INT AS y, o_orderkey % 10 AS way FROM orders),
m(way, metric_key, unit, factor, named, confidence, base_year, method, restated, estimated) AS (VALUES
  (0, 'ghg_scope1', 'tCO2e', 1e0, -1, 85e-2, false, NULL, false, false), (1, 'energy_total', 'MWh', 1e0, -1, 85e-2, false, NULL, false, false),
  (1, 'energy_total', 'GJ', 1e0 / 36e-1, -1, 7e-1, false, NULL, false, false), (2, 'waste_generated', 't', 1e0, -1, 78e-2, false, NULL, false, false),
  (2, 'waste_generated', 't', 1e0, -1, 85e-2, false, NULL, false, false), (4, 'water_withdrawal', 'm3', 1e0, NULL, 75e-2, false, NULL, false, false),
  (5, 'ghg_scope1_2', 'ktCO2e', 1e3, -1, 85e-2, false, NULL, false, false), (6, 'ghg_scope2_location', 'tCO2e', 1e0, 2024, 85e-2, false, 'location-based', false, false),
  (6, 'ghg_scope2_location', 'tCO2e', 1e0, 2023, 7e-1, false, 'location-based', false, false), (7, 'ghg_scope1', 'tCO2e', 1e0, 2019, 85e-2, true, NULL, false, false),
  (8, 'ghg_reduction', 'tCO2e', 1e0, -1, 85e-2, false, NULL, false, true), (9, 'ghg_intensity', 'kgCO2e/tonne', 1e0, -1, 85e-2, false, NULL, true, false))
SELECT id, metric_key, n AS value, unit, round(n * factor, 6) AS normalized_value, CASE WHEN named = -1 THEN y ELSE named END::INT AS year, confidence, base_year, method, restated, estimated FROM o JOIN m USING (way)""",
    "rate_extraction": """SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'ltifr' ELSE 'trir' END AS metric_key, s_suppkey + CASE s_suppkey % 3 WHEN 0 THEN 5e-1 ELSE 25e-2 END AS value,
  CASE s_suppkey % 3 WHEN 0 THEN 'FY2024' END AS period_label, s_suppkey % 3 <> 0 AS period_inferred, CASE s_suppkey % 3 WHEN 0 THEN 75e-2 ELSE 65e-2 END AS confidence
FROM supplier WHERE s_suppkey % 3 <> 2""",
    "period_finder": """WITH o AS (SELECT o_orderkey AS id, year(o_orderdate) AS y, o_orderkey % 6 AS way FROM orders)
SELECT id, CASE way WHEN 0 THEN '0:FY' || y || ' 47:FY' || y WHEN 1 THEN '4:FY' || y WHEN 2 THEN '0:FY' || y || ' 14:CY' || (y - 1) WHEN 3 THEN '0:FY' || y || ' 18:FY' || y ELSE '' END AS labels,
  CASE way WHEN 0 THEN (y - 1) || '-04-01' WHEN 1 THEN (y - 1) || '-07-01' ELSE (y - 1) || '-04-01' END AS "start",
  CASE way WHEN 1 THEN y || '-06-30' ELSE y || '-03-31' END AS "end", way <= 1 AS explicit FROM o""",
    "table_row_extraction": """WITH s AS (SELECT s_suppkey AS id, floor(abs(s_acctbal)) AS n, s_suppkey % 7 AS way, s_suppkey % 5 = 0 AS dash FROM supplier),
m(way, metric_key, unit, factor, confidence) AS (VALUES (0, 'energy_electricity', 'MWh', 1e0, 92e-2), (1, 'ghg_scope2', 'tCO2e', 1e0, 92e-2), (2, 'waste_generated', 'kt', 1e3, 92e-2),
  (5, 'ghg_intensity', 'kgCO2e/unit', 1e0, 92e-2), (6, 'ltifr', 'rate', 1e0, 9e-1)),
c AS (SELECT id, metric_key, unit, factor, 2024 AS year, n AS value, confidence FROM s JOIN m USING (way) UNION ALL
  SELECT id, metric_key, unit, factor, NULL, -n, round(confidence - 2e-1, 2) FROM s JOIN m USING (way) WHERE NOT dash)
SELECT id, metric_key, unit, year, value, round(value * factor, 6) AS normalized_value, confidence FROM c""",
    "passage_extraction": """WITH s AS (SELECT s_suppkey AS passage_id, floor(abs(s_acctbal)) AS n, s_suppkey % 6 AS way FROM supplier),
m(way, metric_key, given, unit, factor, period_label, period_end, period_inferred, restated, confidence, source) AS (VALUES
  (0, 'energy_total', NULL, 'MWh', 1e0, 'FY2024', '2024-03-31', false, false, 85e-2, 'text'), (1, 'ghg_biogenic', NULL, 'tCO2e', 1e0, 'FY2021', '2021-03-31', true, false, 612e-3, 'text'),
  (2, 'water_withdrawal', NULL, 'm3', 1e0, 'FY2022', '2022-03-31', false, false, 6e-1, 'text'), (4, 'waste_generated', NULL, 'kt', 1e3, 'FY2024', '2024-03-31', false, true, 92e-2, 'table'),
  (4, 'waste_generated', 5, 'kt', 1e3, 'FY2021', '2021-03-31', true, true, 72e-2, 'table'), (5, 'ltifr', 15e-1, 'rate', 1e0, 'FY2024', '2024-03-31', false, false, 75e-2, 'text'))
SELECT passage_id, metric_key, coalesce(given, n) AS value, unit, round(coalesce(given, n) * factor, 6) AS normalized_value, period_label, period_end, period_inferred, restated, confidence, source
FROM s JOIN m USING (way)""",
}
