"""Typed metric facts on the driver's tables: line items stand for values that suppliers disclose about brands."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods, units
from ..functions.text import evidence_id
from .tables import table

#: Ends of the fiscal years of companies with even and with odd ids.
EVEN_END, ODD_END = "12-31", "03-31"


def days_of(*periods: str) -> Column:
    """Whether a fact's day is one that the periods `FY<year>` can hold, whenever the company's year ends: it is known at the scan."""
    years = [int(p.removeprefix("FY")) for p in periods]
    return F.col("day").between(F.lit(date(min(years) - 1, 4, 1)), F.lit(date(max(years), 12, 31)))


def period_facts(spark: SparkSession, sf_dir: str, *periods: str) -> DataFrame:
    """`metric_facts` of some periods; labels are only made for lines of their days."""
    return metric_facts(spark, sf_dir).filter(days_of(*periods) & F.col("period_label").isin(*periods))


def metric_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """org, company, document, passage, metric, value in three units, fiscal period, method, confidence.

    Two equi-joins on dimension keys; everything else is a projection, so that callers' filters reach the scans.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).join(suppliers, lines["l_suppkey"] == suppliers["s_suppkey"])
    quantity, day = F.col("l_quantity").cast("long"), F.col("l_shipdate").cast("date")
    even = F.col("l_suppkey") % 2 == 0
    unit = F.when(quantity % 3 == 0, "MWh").when(quantity % 3 == 1, "GJ").otherwise("kWh")
    staged = joined.select(
        F.col("s_nationkey").cast("long").alias("org_id"),
        F.col("l_suppkey").alias("company_id"),
        F.col("l_orderkey").alias("document_id"),
        evidence_id(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), quantity, F.date_format(day, "yyyy-MM-dd")).alias("passage_id"),
        F.col("p_brand").alias("metric_key"),
        F.col("p_type").alias("topic"),
        unit.alias("unit"),
        (F.lit(1000.0) * (F.lit(1.0) + F.lit(0.004) * (F.col("l_linenumber") % 4)) / units.factor(unit)).alias("value"),
        F.when(even, EVEN_END).otherwise(ODD_END).alias("fye"),
        day.alias("day"),
        F.when(F.col("l_returnflag") == "N", "text").otherwise("table").alias("method"),
        (F.lit(95) - F.round(F.col("l_tax") * 100)).cast("long").alias("confidence_pct"),
        (F.col("l_linestatus") == "F").alias("inferred"),
        (F.round(F.col("l_discount") * 100) == 10).alias("base_year"),
        # of a fixed end, whose month and day aren't read again in each row
        F.when(even, periods.fiscal_year_of(day, F.lit(EVEN_END))).otherwise(periods.fiscal_year_of(day, F.lit(ODD_END))).alias("fiscal_year"),
    )
    ends = staged.withColumn("period_end", periods.year_end_day(F.col("fiscal_year"), F.col("fye")))
    return ends.select(
        "*",
        F.concat(F.lit("FY"), F.col("fiscal_year").cast("string")).alias("period_label"),
        periods.start_for_end(F.col("period_end")).alias("period_start"),
        units.normalized_unit(F.col("unit")).alias("normalized_unit"),
        F.round(units.normalized_value(F.col("value"), F.col("unit")), 6).alias("normalized_value"),
    )


#: The same facts in SQL.
FACTS_SQL = """
lines AS (
  SELECT s_nationkey::BIGINT AS org_id, l_suppkey AS company_id, l_orderkey AS document_id,
    'ev_' || substr(sha256(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT, strftime(l_shipdate, '%Y-%m-%d'))), 1, 20) AS passage_id,
    p_brand AS metric_key, p_type AS topic,
    CASE l_quantity::BIGINT % 3 WHEN 0 THEN 'MWh' WHEN 1 THEN 'GJ' ELSE 'kWh' END AS unit,
    CASE l_quantity::BIGINT % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 1e0 / 36e-1 ELSE 1e-3 END AS factor,
    1e3 * (1e0 + 4e-3 * (l_linenumber % 4)) AS base_value,
    CASE WHEN l_suppkey % 2 = 0 THEN '12-31' ELSE '03-31' END AS fye,
    l_shipdate::DATE AS day,
    CASE WHEN l_returnflag = 'N' THEN 'text' ELSE 'table' END AS method,
    95 - round(l_tax * 100)::BIGINT AS confidence_pct,
    l_linestatus = 'F' AS inferred,
    round(l_discount * 100) = 10 AS base_year,
    CASE WHEN l_suppkey % 2 = 0 OR month(l_shipdate) <= 3 THEN year(l_shipdate) ELSE year(l_shipdate) + 1 END AS fiscal_year
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
), facts AS (
  SELECT *, base_value / factor AS value, 'FY' || fiscal_year AS period_label,
    CASE WHEN fye = '12-31' THEN make_date(fiscal_year, 12, 31) ELSE make_date(fiscal_year, 3, 31) END AS period_end,
    CASE WHEN fye = '12-31' THEN make_date(fiscal_year, 1, 1) ELSE make_date(fiscal_year - 1, 4, 1) END AS period_start,
    'MWh' AS normalized_unit, round(base_value / factor * factor, 6) AS normalized_value
  FROM lines
)"""
