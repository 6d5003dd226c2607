"""Queries over metric facts: units, periods, conflicts, best values, series, peers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import periods, units
from ..operators import disclosures as D
from ..sources.facts import FACTS_SQL, metric_facts
from ..sources.tables import table


def iso(df, *columns):
    """The named dates as ISO text, which every engine writes alike."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


GROUP = ["company_id", "metric_key", "period_label"]
METRICS = [f"Brand#{k}" for k in range(1, 11)]
FALLBACK = {"Brand#1": "Brand#11", "Brand#2": "Brand#12"}
PERIOD = "FY1998"


def conflict_detection(spark, sf_dir):
    """AGG-8: sources of one company, metric and fiscal year that disagree by more than 1 %."""
    return D.conflicts(metric_facts(spark, sf_dir), by=GROUP)


def unit_normalization(spark, sf_dir):
    """SCL-8, SCL-9: values in base units and in GJ, per unit and value."""
    facts = metric_facts(spark, sf_dir).select("unit", "value", "normalized_value", "normalized_unit")
    in_gj = F.round(units.convert(F.col("value"), F.col("unit"), F.lit("GJ")), 3)
    return facts.groupBy("unit", "normalized_unit", "normalized_value", in_gj.alias("in_gj")).agg(F.count("*").alias("n"))


def fiscal_year_alignment(spark, sf_dir):
    """SCL-11: fiscal periods of both year ends."""
    facts = metric_facts(spark, sf_dir)
    found = facts.groupBy("fye", "period_label", "period_start", "period_end").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return iso(found, "period_start", "period_end", "first_day", "last_day")


def _targets(spark):
    rows = [(f"{y}{n}", f"{y}-{a}", f"{y + plus}-{b}") for y in range(1995, 2002) for n, a, b, plus in (("c", "01-01", "12-31", 0), ("m", "02-01", "01-31", 1), ("h", "01-01", "06-30", 0))]
    return spark.createDataFrame(rows, "target string, s string, e string").select("target", F.to_date("s").alias("target_start"), F.to_date("e").alias("target_end"))


def period_match_join(spark, sf_dir):
    """JN-14, FIL-3: metric periods that match an assessment period."""
    facts = metric_facts(spark, sf_dir).groupBy("company_id", "period_start", "period_end").agg(F.count("*").alias("n"))
    return iso(D.match_periods(facts, _targets(spark)).select("company_id", "target", "period_start", "period_end", "n"), "period_start", "period_end")


def metric_best_value(spark, sf_dir):
    """AGG-15, AGG-16, FIL-4: best source per company, metric and period."""
    facts = metric_facts(spark, sf_dir).filter(~F.col("base_year"))
    return D.best_values(facts, by=GROUP).select(*GROUP, "value", "passage_id", "alternatives", "sources_differ")


def metric_time_series(spark, sf_dir):
    """WIN-5, WIN-6: series of best values and the change since the first period."""
    return D.time_series(metric_facts(spark, sf_dir), by=["company_id", "metric_key"])


def key_disclosures_change(spark, sf_dir):
    """AGG-14: latest and prior value of each metric."""
    return iso(D.key_disclosures(metric_facts(spark, sf_dir), by=["company_id", "metric_key"]), "latest_end")


def _grid(spark, sf_dir):
    companies = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("org_id"), F.col("s_suppkey").alias("company_id"))
    return D.peer_grid(companies, metric_facts(spark, sf_dir), METRICS, FALLBACK, PERIOD)


def peer_benchmark_grid(spark, sf_dir):
    """JN-24, JN-25: every company and metric has a cell."""
    return _grid(spark, sf_dir).select("org_id", "company_id", "metric_key", "used_key", "value", "unit")


def benchmark_coverage(spark, sf_dir):
    """AGG-17: disclosed cells and comparability of each row."""
    return D.coverage(_grid(spark, sf_dir), by=["org_id", "metric_key"])


def benchmark_comparability(spark, sf_dir):
    """DOM-15: why a cell may not be comparable with the first company of its organisation."""
    noted = _grid(spark, sf_dir)
    focal = noted.groupBy("org_id").agg(F.min("company_id").alias("focal"))
    other_end = F.col("company_id") % 2 != F.col("focal") % 2
    return noted.join(focal, "org_id").select("org_id", "company_id", "metric_key", D.cell_notes(other_end).alias("notes"))


def _noted(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("org_id"), F.col("s_suppkey").alias("company_id"))
    focal = suppliers.groupBy("org_id").agg(F.min("company_id").alias("focal"))
    year = F.lit(int(PERIOD[2:]))
    end = periods.year_end_day(year, F.when(F.col("company_id") % 2 == 0, "12-31").otherwise("03-31"))
    companies = suppliers.join(focal, "org_id").withColumn("period_end", end).withColumn("period_start", periods.start_for_end(F.col("period_end")))
    facts = metric_facts(spark, sf_dir)
    read = facts.groupBy("passage_id").agg(F.min("confidence_pct").alias("c"), F.min("unit").alias("u")).select(
        "passage_id", F.when(F.col("c") < 90, "ocr").otherwise("text").alias("extraction_method"), (F.col("c") / 100).alias("page_confidence"), F.when(F.col("u") == "kWh", "Electricity bought").otherwise("Energy used").alias("text"))
    way = F.col("company_id") % 5
    said = F.when(way == 0, "Our report follows operational control.").when(way == 1, "GHG figures by Financial-Control").when(way == 2, "Equity share is held by a fund.").otherwise("Emissions by equity share, then operational control")
    passages = suppliers.select("company_id", F.lit("a").alias("passage_id"), F.lit(1).alias("ordinal"), F.lit("A report").alias("text")).unionByName(suppliers.select("company_id", F.lit("b").alias("passage_id"), F.lit(2).alias("ordinal"), said.alias("text")))
    return D.noted_grid(companies, facts, read, D.boundaries(passages), METRICS, FALLBACK, PERIOD, emissions=tuple(METRICS[:4]), ratios=(METRICS[4],), shares=(METRICS[5],))


def benchmark_notes(spark, sf_dir):
    """DOM-15: cells with notes of nine kinds on what limits a comparison."""
    found = _noted(spark, sf_dir)
    notes = F.array_join(F.transform("notes", lambda n: F.concat_ws(": ", n["kind"], n["text"])), "; ")
    return found.select("org_id", "company_id", "metric_key", "value", "passage_id", "alternatives", notes.alias("notes"))


def benchmark_comparable(spark, sf_dir):
    """DOM-15, AGG-17: which rows of the noted grid can be compared."""
    return D.comparability(_noted(spark, sf_dir), by=["org_id", "metric_key"])


def gold_value_tolerance(spark, sf_dir):
    """JN-23: gold values found among the extracted ones within 0.5 %."""
    facts = metric_facts(spark, sf_dir)
    gold = table(spark, sf_dir, "part").select(F.col("p_brand").alias("metric_key")).distinct().withColumn("period_label", F.explode(F.array(*[F.lit(f"FY{y}") for y in range(1995, 2002)])))
    gold = gold.withColumn("gold", F.lit(1000.0) + F.substring("metric_key", 7, 3).cast("int"))
    near = facts.select("metric_key", "period_label", "normalized_value").distinct()
    joined = gold.join(near, ["metric_key", "period_label"], "left")
    hit = F.abs(F.col("normalized_value") - F.col("gold")) <= 0.005 * F.abs("gold")
    return joined.groupBy("metric_key", "period_label", "gold").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("found"))


def metrics_any_period(spark, sf_dir):
    """FIL-5, AGG-27: for each company the other periods that hold a metric which its period lacks."""
    facts = metric_facts(spark, sf_dir).filter(F.col("metric_key").isin(METRICS))
    here = F.max(F.when(F.col("period_label") == PERIOD, 1).otherwise(0))
    labels = F.array_join(F.array_sort(F.collect_set(F.when(F.col("period_label") != PERIOD, F.col("period_label")))), ",")
    return facts.groupBy("company_id", "metric_key").agg(here.alias("here"), labels.alias("other_periods")).filter("here = 0").drop("here")


def period_descriptions(spark, sf_dir):
    """SCL-15, SCL-17, SCL-38: labels read back into years and described."""
    facts = metric_facts(spark, sf_dir).select("period_label", "period_start", "period_end").distinct()
    slashed = F.concat(F.lit("FY"), (periods.label_year(F.col("period_label")) - 1).cast("string"), F.lit("/"), F.substring("period_label", 5, 2))
    return facts.select("period_label", F.col("period_start").cast("string"), F.col("period_end").cast("string"), periods.label_year(F.col("period_label")).alias("label_year"), periods.label_year(slashed).alias("slashed_year"), periods.describe(F.col("period_start"), F.col("period_end")).alias("described"))


BEST_SQL = """best AS (
  SELECT {by}, first(value ORDER BY not_table, doubt, passage_id, value) AS value, first(passage_id ORDER BY not_table, doubt, passage_id, value) AS passage_id,
    count(*) - 1 AS alternatives, coalesce((max(value) - min(value)) / nullif(abs(min(value)), 0) > 0.01, false) AS sources_differ, bool_or(inferred) AS any_inferred
  FROM (SELECT *, method <> 'table' AS not_table, -confidence_pct AS doubt FROM (SELECT * EXCLUDE (value), normalized_value AS value FROM facts)) WHERE {where} GROUP BY {by}
)"""
_METRICS_SQL = ", ".join(f"'{m}'" for m in METRICS)
_GRID_SQL = (
    f"WITH {FACTS_SQL}, "
    + BEST_SQL.format(by="company_id, metric_key", where=f"period_label = '{PERIOD}' AND NOT base_year")
    + f""", cells AS (
  SELECT s_nationkey::BIGINT AS org_id, s_suppkey AS company_id, unnest([{_METRICS_SQL}]) AS metric_key FROM supplier
), loose AS (SELECT *, CASE metric_key WHEN 'Brand#1' THEN 'Brand#11' WHEN 'Brand#2' THEN 'Brand#12' END AS loose_key FROM cells),
grid AS (
  SELECT l.org_id, l.company_id, l.metric_key, CASE WHEN a.value IS NULL AND b.value IS NOT NULL THEN loose_key ELSE l.metric_key END AS used_key,
    coalesce(a.value, b.value) AS value, CASE WHEN coalesce(a.value, b.value) IS NOT NULL THEN 'MWh' END AS unit,
    CASE WHEN a.value IS NOT NULL THEN a.sources_differ ELSE b.sources_differ END AS sources_differ,
    CASE WHEN a.value IS NOT NULL THEN a.any_inferred ELSE b.any_inferred END AS any_inferred
  FROM loose l LEFT JOIN best a ON a.company_id = l.company_id AND a.metric_key = l.metric_key
  LEFT JOIN best b ON b.company_id = l.company_id AND b.metric_key = l.loose_key
)
"""
)

_NOTED_SQL = f"""WITH {FACTS_SQL}, per AS (
  SELECT company_id, metric_key, count(*) AS n, list_sort(list(DISTINCT round(normalized_value, 6))) AS vs,
    first({{'v': normalized_value, 'p': passage_id, 'u': unit, 'i': inferred}} ORDER BY method <> 'table', -confidence_pct, passage_id, normalized_value) AS b
  FROM facts WHERE period_label = '{PERIOD}' AND NOT base_year GROUP BY ALL
), read AS (SELECT passage_id, min(confidence_pct) AS c, min(unit) AS u FROM facts GROUP BY passage_id),
companies AS (SELECT s_nationkey::BIGINT AS org_id, s_suppkey AS company_id, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS focal, CASE s_suppkey % 5 WHEN 0 THEN 'operational control' WHEN 1 THEN 'financial control' WHEN 2 THEN NULL ELSE 'equity share' END AS approach FROM supplier),
cells AS (SELECT c.*, f.approach AS f_approach, k AS metric_key, CASE k WHEN 'Brand#1' THEN 'Brand#11' WHEN 'Brand#2' THEN 'Brand#12' END AS loose_key FROM companies c JOIN companies f ON f.company_id = c.focal, (SELECT unnest([{_METRICS_SQL}]) AS k)),
x AS (SELECT c.*, a.n IS NULL AS looser, coalesce(a.n, l.n) AS n, coalesce(a.vs, l.vs) AS vs, coalesce(a.b, l.b) AS b FROM cells c
  LEFT JOIN per a ON a.company_id = c.company_id AND a.metric_key = c.metric_key LEFT JOIN per l ON l.company_id = c.company_id AND l.metric_key = c.loose_key),
noted AS (SELECT x.*, CASE WHEN n IS NULL THEN ['missing: not disclosed'] ELSE [y FOR y IN [
  CASE WHEN looser THEN 'method: shown for ' || loose_key END, CASE WHEN len(vs) > 1 AND vs[1] <> 0 AND (vs[-1] - vs[1]) / abs(vs[1]) > 1e-2 THEN 'conflict: ' || len(vs) || ' different values; the surest is shown' END,
  CASE WHEN b.u <> 'MWh' AND metric_key <> 'Brand#5' THEN 'converted: from ' || b.u END, CASE WHEN c < 90 THEN 'ocr: read from a scan, 0.' || c END, CASE WHEN b.i THEN 'period: inferred from the document' END,
  CASE WHEN company_id % 2 <> focal % 2 THEN 'period: ' || CASE company_id % 2 WHEN 0 THEN '01 Jan {PERIOD[2:]} – 31 Dec {PERIOD[2:]}' ELSE '01 Apr {int(PERIOD[2:]) - 1} – 31 Mar {PERIOD[2:]}' END END,
  CASE WHEN metric_key IN ({", ".join(f"'{m}'" for m in METRICS[:4])}) AND company_id <> focal AND approach IS NULL THEN 'boundary: not stated' END,
  CASE WHEN metric_key IN ({", ".join(f"'{m}'" for m in METRICS[:4])}) AND company_id <> focal AND approach <> f_approach THEN 'boundary: ' || approach || ', the focal company by ' || f_approach END,
  CASE WHEN metric_key = 'Brand#5' THEN 'denominator: ' || b.u END, CASE WHEN metric_key = 'Brand#6' THEN 'scope: ' || CASE WHEN r.u = 'kWh' THEN 'electricity' ELSE 'energy' END END] IF y IS NOT NULL] END AS notes
  FROM x LEFT JOIN read r ON r.passage_id = x.b.p)
"""
QUERIES = {
    f.__name__: f
    for f in (
        conflict_detection, unit_normalization, fiscal_year_alignment, period_match_join, metric_best_value, metric_time_series, key_disclosures_change,
        peer_benchmark_grid, benchmark_coverage, benchmark_comparability, benchmark_notes, benchmark_comparable, gold_value_tolerance, metrics_any_period, period_descriptions,
    )
}

ORACLES = {
    "conflict_detection": f"""WITH {FACTS_SQL}, ends AS (
  SELECT company_id, metric_key, period_label, normalized_unit, min(normalized_value) AS low_value, max(normalized_value) AS high_value, count(*) AS n,
    first(passage_id ORDER BY normalized_value, passage_id) AS low_passage, first(passage_id ORDER BY normalized_value DESC, passage_id DESC) AS high_passage
  FROM facts GROUP BY ALL)
SELECT company_id, metric_key, period_label, normalized_unit, low_value, high_value, low_passage, high_passage, round((high_value - low_value) / abs(low_value), 4) AS spread
FROM ends WHERE n >= 2 AND low_passage <> high_passage AND low_value <> 0 AND (high_value - low_value) / abs(low_value) > 0.01""",
    "unit_normalization": f"WITH {FACTS_SQL} SELECT unit, normalized_unit, normalized_value, round(value * factor / (1e0 / 36e-1), 3) AS in_gj, count(*) AS n FROM facts GROUP BY ALL",
    "fiscal_year_alignment": f"WITH {FACTS_SQL} SELECT fye, period_label, period_start::VARCHAR AS period_start, period_end::VARCHAR AS period_end, count(*) AS n, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day FROM facts GROUP BY ALL",
    "period_match_join": f"""WITH {FACTS_SQL}, own AS (SELECT company_id, period_start, period_end, count(*) AS n FROM facts GROUP BY ALL),
targets AS (SELECT y || k AS target, make_date(y, sm, 1) AS s, make_date(y + p, em, ed) AS e FROM range(1995, 2002) t(y), (VALUES ('c', 1, 12, 31, 0), ('m', 2, 1, 31, 1), ('h', 1, 6, 30, 0)) v(k, sm, em, ed, p))
SELECT company_id, target, period_start::VARCHAR AS period_start, period_end::VARCHAR AS period_end, n FROM own, targets
WHERE date_diff('day', greatest(period_start, s), least(period_end, e)) + 1 >= 9e-1 * (date_diff('day', s, e) + 1)
  AND date_diff('day', period_start, period_end) + 1 <= (date_diff('day', s, e) + 1) / 9e-1""",
    "metric_best_value": f"WITH {FACTS_SQL}, " + BEST_SQL.format(by="company_id, metric_key, period_label", where="NOT base_year") + " SELECT company_id, metric_key, period_label, value, passage_id, alternatives, sources_differ FROM best",
    "metric_time_series": f"WITH {FACTS_SQL}, " + BEST_SQL.format(by="company_id, metric_key, period_label, period_end", where="true") + """
SELECT company_id, metric_key, n_points, labels, first_value, last_value, round((last_value - first_value) / abs(first_value), 4) AS change FROM (
  SELECT company_id, metric_key, count(*) AS n_points, string_agg(period_label, ',' ORDER BY period_end) AS labels,
    first(value ORDER BY period_end) AS first_value, first(value ORDER BY period_end DESC) AS last_value FROM best GROUP BY ALL)""",
    "key_disclosures_change": f"""WITH {FACTS_SQL}, per AS (
  SELECT company_id, metric_key, period_end, count(*) AS sources, first(normalized_value ORDER BY confidence_pct DESC, passage_id DESC) AS v FROM facts GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY company_id, metric_key ORDER BY period_end DESC) AS r FROM per),
wide AS (SELECT company_id, metric_key, max(period_end) FILTER (r = 1) AS latest_end, max(v) FILTER (r = 1) AS latest, max(v) FILTER (r = 2) AS prior, max(sources) FILTER (r = 1) AS sources FROM ranked WHERE r <= 2 GROUP BY ALL)
SELECT company_id, metric_key, latest_end::VARCHAR AS latest_end, latest, prior, CASE WHEN prior <> 0 THEN round((latest - prior) / abs(prior), 4) END AS change, sources FROM wide""",
    "peer_benchmark_grid": _GRID_SQL + "SELECT org_id, company_id, metric_key, used_key, value, unit FROM grid",
    "benchmark_coverage": _GRID_SQL + """, rows AS (
  SELECT org_id, metric_key, count(value) AS d, count(*) AS n, count(DISTINCT unit) = 1 AND NOT coalesce(bool_or(sources_differ), false) AND count(value) >= 2 AS comparable FROM grid GROUP BY ALL)
SELECT org_id, metric_key, d || '/' || n AS coverage, comparable, CASE WHEN d = 0 THEN 'none' WHEN comparable THEN 'comparable' ELSE 'limited' END AS label FROM rows""",
    "benchmark_comparability": _GRID_SQL + """, focal AS (SELECT org_id, min(company_id) AS focal FROM grid GROUP BY org_id)
SELECT org_id, company_id, metric_key, concat_ws('; ', CASE WHEN value IS NULL THEN 'not disclosed' END, CASE WHEN used_key <> metric_key THEN 'looser key' END,
  CASE WHEN sources_differ THEN 'sources differ' END, CASE WHEN any_inferred THEN 'period inferred' END, CASE WHEN company_id % 2 <> focal % 2 THEN 'other fiscal year end' END) AS notes
FROM grid JOIN focal USING (org_id)""",
    "benchmark_notes": _NOTED_SQL + "SELECT org_id, company_id, metric_key, b.v AS value, b.p AS passage_id, n - 1 AS alternatives, array_to_string(notes, '; ') AS notes FROM noted",
    "benchmark_comparable": _NOTED_SQL + """, g AS (SELECT org_id, metric_key, count(n) AS k, count(*) AS m, coalesce(bool_or(len([y FOR y IN notes IF regexp_matches(y, '^(period|boundary|method|conflict|denominator):')]) > 0) FILTER (n IS NOT NULL), false) AS h FROM noted GROUP BY ALL)
SELECT org_id, metric_key, k || '/' || m AS coverage, k >= 2 AND NOT h AS comparable, CASE WHEN k >= 2 AND NOT h THEN 'directly comparable' WHEN k >= 2 THEN 'limited, see notes' ELSE 'too few values' END AS label FROM g""",
    "gold_value_tolerance": f"""WITH {FACTS_SQL}, gold AS (
  SELECT metric_key, 'FY' || y AS period_label, 1e3 + substr(metric_key, 7, 3)::INT AS gold FROM (SELECT DISTINCT p_brand AS metric_key FROM part), range(1995, 2002) t(y))
SELECT g.metric_key, g.period_label, g.gold, coalesce(bool_or(abs(f.normalized_value - gold) <= 5e-3 * abs(gold)), false) AS found
FROM gold g LEFT JOIN (SELECT DISTINCT metric_key, period_label, normalized_value FROM facts) f USING (metric_key, period_label) GROUP BY ALL""",
    "metrics_any_period": f"""WITH {FACTS_SQL} SELECT company_id, metric_key, string_agg(DISTINCT period_label, ',' ORDER BY period_label) AS other_periods
FROM facts WHERE metric_key IN ({_METRICS_SQL}) GROUP BY ALL HAVING NOT bool_or(period_label = '{PERIOD}')""",
    "period_descriptions": f"""WITH {FACTS_SQL} SELECT DISTINCT period_label, period_start::VARCHAR AS period_start, period_end::VARCHAR AS period_end, fiscal_year::INT AS label_year, fiscal_year::INT AS slashed_year,
  strftime(period_start, '%d %b %Y') || ' – ' || strftime(period_end, '%d %b %Y') AS described FROM facts""",
}
