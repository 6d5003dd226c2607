"""Conflicts, best values, series and peer grids over typed metric facts.

A facts frame has org_id, company_id, document_id, passage_id, metric_key, unit, normalized_value, normalized_unit,
period_label, period_start, period_end, method, confidence_pct, inferred and base_year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import TOLERANCE, period_matches

#: Relative spread above which two sources of one value disagree.
SPREAD = 0.01


def conflicts(facts: DataFrame, *, by: list[str]) -> DataFrame:
    """Per group and unit the lowest and highest value, where they differ by more than SPREAD.

    Only the two ends are compared; groups whose ends come from one passage, or whose low end is 0, are no conflict.
    Ties at either end go to the first and last passage. One partial aggregation, one shuffle.
    """
    point = F.struct(F.col("normalized_value").alias("value"), F.col("passage_id").alias("passage"))
    ends = facts.groupBy(*by, "normalized_unit").agg(F.min(point).alias("low"), F.max(point).alias("high"), F.count("*").alias("n"))
    spread = (F.col("high.value") - F.col("low.value")) / F.abs(F.col("low.value"))
    differ = (F.col("n") >= 2) & (F.col("low.passage") != F.col("high.passage")) & (F.col("low.value") != 0)
    return ends.filter(differ).filter(spread > SPREAD).select(
        *by,
        "normalized_unit",
        F.col("low.value").alias("low_value"),
        F.col("high.value").alias("high_value"),
        F.col("low.passage").alias("low_passage"),
        F.col("high.passage").alias("high_passage"),
        F.round(spread, 4).alias("spread"),
    )


def preference() -> Column:
    """Tables before text, then confidence, then passage id: the smallest is the best source."""
    return F.struct((F.col("method") != "table").alias("not_table"), (-F.col("confidence_pct")).alias("doubt"), F.col("passage_id").alias("passage"), F.col("normalized_value").alias("value"), F.col("normalized_unit").alias("unit"))


def best_values(facts: DataFrame, *, by: list[str]) -> DataFrame:
    """The best source's value per group, how many others there are and whether they disagree."""
    value = F.col("normalized_value")
    grouped = facts.groupBy(*by).agg(F.min(preference()).alias("best"), F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.max("inferred").alias("any_inferred"))
    apart = F.coalesce((F.col("high") - F.col("low")) / F.nullif(F.abs(F.col("low")), F.lit(0.0)) > SPREAD, F.lit(False))
    return grouped.select(*by, F.col("best.value").alias("value"), F.col("best.unit").alias("unit"), F.col("best.passage").alias("passage_id"), (F.col("n") - 1).alias("alternatives"), apart.alias("sources_differ"), "any_inferred")


def time_series(facts: DataFrame, *, by: list[str]) -> DataFrame:
    """Points ordered by period end, each the best of its period, and the change since the first."""
    points = best_values(facts, by=[*by, "period_label", "period_end"])
    point = F.struct("period_end", "period_label", "value")
    series = points.groupBy(*by).agg(F.array_sort(F.collect_list(point)).alias("points"))
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    return series.select(
        *by,
        F.size("points").cast("long").alias("n_points"),
        F.array_join(F.transform("points", lambda p: p["period_label"]), ",").alias("labels"),
        first["value"].alias("first_value"),
        last["value"].alias("last_value"),
        F.round((last["value"] - first["value"]) / F.abs(first["value"]), 4).alias("change"),
    )


def key_disclosures(facts: DataFrame, *, by: list[str]) -> DataFrame:
    """Latest and prior period's most confident values and their change, where units agree and the prior isn't 0."""
    best = F.max(F.struct("confidence_pct", "passage_id", "normalized_value", "normalized_unit"))
    per_period = facts.groupBy(*by, "period_end").agg(best.alias("best"), F.count("*").alias("sources"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("period_end")))
    two = per_period.withColumn("rank", rank).filter("rank <= 2")

    def of(k: int, column: str) -> Column:
        return F.max(F.when(F.col("rank") == k, F.col(column)))

    wide = two.groupBy(*by).agg(
        of(1, "period_end").alias("latest_end"), of(1, "best.normalized_value").alias("latest"), of(1, "best.normalized_unit").alias("unit"),
        of(2, "best.normalized_value").alias("prior"), of(2, "best.normalized_unit").alias("prior_unit"), of(1, "sources").alias("sources"),
    )
    change = F.when((F.col("unit") == F.col("prior_unit")) & (F.col("prior") != 0), F.round((F.col("latest") - F.col("prior")) / F.abs("prior"), 4))
    return wide.select(*by, "latest_end", "latest", "prior", change.alias("change"), "sources")


def match_periods(metric_periods: DataFrame, targets: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Interval join of metric periods with assessment periods (target_start, target_end) under FIL-3's tolerance.

    The ends of a match are no further apart than (1 / tolerance - tolerance) of the target's span, so the years that lie
    so near to its end are the equi-key of a hash join; the tolerance is its residual. A target of a year is spread over two
    or three years, metric periods over none.
    """
    span = F.datediff("target_end", "target_start") + 1
    apart = F.ceil(span * (1 / tolerance - tolerance)).cast("int") + 1
    years = F.sequence(F.year(F.date_sub("target_end", apart)), F.year(F.date_add("target_end", apart)))
    keyed = targets.withColumn("__year", F.explode(years))
    joined = metric_periods.withColumn("__year", F.year("period_end")).join(keyed, "__year")
    fits = period_matches(F.col("period_start"), F.col("period_end"), F.col("target_start"), F.col("target_end"), tolerance)
    return joined.filter(fits).drop("__year")


def peer_grid(companies: DataFrame, facts: DataFrame, metrics: list[str], fallback: dict[str, str], period_label: str) -> DataFrame:
    """A cell per company and metric, disclosed or not; a metric without a value falls back to its looser key.

    The grid is an explode of the few metrics, and both look-ups are joins on (company, key).
    """
    best = best_values(facts.filter((F.col("period_label") == period_label) & ~F.col("base_year")), by=["company_id", "metric_key"])
    looser = F.create_map(*[F.lit(x) for kv in fallback.items() for x in kv]) if fallback else F.create_map(F.lit(""), F.lit(""))
    cells = companies.select("org_id", "company_id", F.explode(F.array(*map(F.lit, metrics))).alias("metric_key")).withColumn("loose_key", looser[F.col("metric_key")])
    strict = best.select("company_id", "metric_key", F.struct("value", "unit", "sources_differ", "any_inferred").alias("own"))
    loose = best.select("company_id", F.col("metric_key").alias("loose_key"), F.struct("value", "unit", "sources_differ", "any_inferred").alias("other"))
    joined = cells.join(strict, ["company_id", "metric_key"], "left").join(loose, ["company_id", "loose_key"], "left")
    cell = F.coalesce("own", "other")
    return joined.select(
        "org_id", "company_id", "metric_key",
        F.when(F.col("own").isNull() & F.col("other").isNotNull(), F.col("loose_key")).otherwise(F.col("metric_key")).alias("used_key"),
        cell["value"].alias("value"), cell["unit"].alias("unit"), cell["sources_differ"].alias("sources_differ"), cell["any_inferred"].alias("any_inferred"),
    )


def coverage(grid: DataFrame, *, by: list[str]) -> DataFrame:
    """Disclosed cells of each row as d/n, and whether its values can be compared."""
    disclosed = F.count("value")
    comparable = (F.countDistinct("unit") == 1) & ~F.coalesce(F.bool_or("sources_differ"), F.lit(False)) & (disclosed >= 2)
    grouped = grid.groupBy(*by).agg(disclosed.alias("disclosed"), F.count("*").alias("companies"), F.coalesce(comparable, F.lit(False)).alias("comparable"))
    label = F.when(F.col("disclosed") == 0, "none").when(F.col("comparable"), "comparable").otherwise("limited")
    return grouped.select(*by, F.concat_ws("/", F.col("disclosed").cast("string"), F.col("companies").cast("string")).alias("coverage"), "comparable", label.alias("label"))


def cell_notes(cell_end: Column) -> Column:
    """Why a cell may not be comparable, in a fixed order."""
    notes = [
        F.when(F.col("value").isNull(), "not disclosed"),
        F.when(F.col("used_key") != F.col("metric_key"), "looser key"),
        F.when(F.col("sources_differ"), "sources differ"),
        F.when(F.col("any_inferred"), "period inferred"),
        F.when(cell_end, "other fiscal year end"),
    ]
    return F.array_join(F.array_compact(F.array(*notes)), "; ")


#: How a company says what it consolidates, and what a passage must be about for it to count (fixed values).
BOUNDARY, ABOUT = r"(?i)((?:operational|financial)[\s-]control|equity[\s-]share)", r"(?i)emission|ghg|greenhouse|scope|report"
#: Share of a period that a peer's must have in common with the focal company's, and the notes that forbid a comparison (fixed values).
SAME_PERIOD, HINDERING = 0.98, ("period", "boundary", "method", "conflict", "denominator")


def boundaries(passages: DataFrame) -> DataFrame:
    """company_id, approach and passage_id: how each company consolidates, by its first passage (ordinal) that says so and is about reporting."""
    hits = passages.filter(F.col("text").rlike(BOUNDARY) & F.col("text").rlike(ABOUT))
    named = F.replace(F.lower(F.regexp_extract("text", BOUNDARY, 1)), F.lit("-"), F.lit(" "))
    return hits.groupBy("company_id").agg(F.min_by(F.struct(named.alias("approach"), "passage_id"), "ordinal").alias("first")).select("company_id", "first.*")


def noted_grid(
    companies: DataFrame, facts: DataFrame, passages: DataFrame, stated: DataFrame, metrics: list[str], fallback: dict[str, str], period_label: str,
    *, emissions: tuple[str, ...] = (), ratios: tuple[str, ...] = (), shares: tuple[str, ...] = (),
) -> DataFrame:
    """A cell per company and metric with its best value and notes of nine kinds on what limits a comparison with the focal company.

    `companies` has org_id, company_id, focal (its organisation's), period_start and period_end; `passages` passage_id, extraction_method,
    page_confidence and text; `stated` what `boundaries` gives. Kinds: missing, method (a looser key stands in), conflict (values further
    apart than SPREAD), converted, ocr, period (inferred, or another one than the focal company's), boundary (of `emissions`: another or
    none), denominator (of `ratios`) and scope (of `shares`: electricity or energy, by the passage). Look-ups are joins by company and key.
    """
    value = F.col("normalized_value")
    best = F.min(F.struct((F.col("method") != "table").alias("t"), (-F.col("confidence_pct")).alias("c"), F.col("passage_id").alias("p"), value.alias("value"), F.col("normalized_unit").alias("normal"), F.col("unit").alias("unit"), F.col("inferred").alias("inferred")))
    used = facts.filter((F.col("period_label") == period_label) & ~F.col("base_year") & F.col("metric_key").isin([*metrics, *fallback.values()]))
    per = used.groupBy("company_id", "metric_key").agg(best.alias("b"), F.count("*").alias("n"), F.array_sort(F.collect_set(F.round(value, 6))).alias("values"))
    looser = F.create_map(*[F.lit(x) for kv in (fallback or {"": ""}).items() for x in kv])
    cells = companies.select("*", F.explode(F.array(*map(F.lit, metrics))).alias("metric_key")).withColumn("loose_key", looser[F.col("metric_key")])
    own = per.select("company_id", "metric_key", F.struct("b", "n", "values").alias("own"))
    loose = per.select("company_id", F.col("metric_key").alias("loose_key"), F.struct("b", "n", "values").alias("loose"))
    joined = cells.join(own, ["company_id", "metric_key"], "left").join(loose, ["company_id", "loose_key"], "left").withColumn("x", F.coalesce("own", "loose"))
    read = passages.select(F.col("passage_id").alias("__p"), "extraction_method", "page_confidence", F.col("text").alias("__t"))
    joined = joined.withColumn("__p", F.col("x.b.p")).join(read, "__p", "left").join(stated.select("company_id", "approach"), "company_id", "left")
    focal = companies.filter(F.col("company_id") == F.col("focal")).join(stated.select("company_id", "approach"), "company_id", "left")
    joined = joined.join(focal.select("focal", F.col("approach").alias("f_approach"), F.col("period_start").alias("f_start"), F.col("period_end").alias("f_end")), "focal", "left")
    low, high = F.element_at("x.values", 1), F.element_at("x.values", -1)
    apart = (F.size("x.values") > 1) & (low != 0) & ((high - low) / F.abs(low) > SPREAD)
    peer, key = F.col("company_id") != F.col("focal"), F.col("metric_key")
    described = F.concat_ws(" – ", F.date_format("period_start", "dd MMM yyyy"), F.date_format("period_end", "dd MMM yyyy"))
    unlike = ~period_matches(F.col("period_start"), F.col("period_end"), F.col("f_start"), F.col("f_end"), SAME_PERIOD)
    pairs = [
        ("method", F.col("own").isNull(), F.concat(F.lit("shown for "), F.col("loose_key"))),
        ("conflict", apart, F.concat(F.size("x.values").cast("string"), F.lit(" different values; the surest is shown"))),
        ("converted", (F.col("x.b.unit") != F.col("x.b.normal")) & ~key.isin(*ratios, ""), F.concat(F.lit("from "), F.col("x.b.unit"))),
        ("ocr", F.col("extraction_method") == "ocr", F.concat(F.lit("read from a scan, "), F.format_string("%.2f", "page_confidence"))),
        ("period", F.col("x.b.inferred"), F.lit("inferred from the document")),
        ("period", peer & unlike, described),
        ("boundary", key.isin(*emissions, "") & peer & F.col("approach").isNull(), F.lit("not stated")),
        ("boundary", key.isin(*emissions, "") & peer & (F.col("approach") != F.col("f_approach")), F.concat(F.col("approach"), F.lit(", the focal company by "), F.col("f_approach"))),
        ("denominator", key.isin(*ratios, ""), F.coalesce("x.b.unit", F.lit("not stated"))),
        ("scope", key.isin(*shares, ""), F.when(F.contains(F.lower("__t"), F.lit("electric")), "electricity").otherwise("energy")),
    ]
    notes = F.array_compact(F.array(*[F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(kind).alias("kind"), text.alias("text"))) for kind, holds, text in pairs]))
    missing = F.array(F.struct(F.lit("missing").alias("kind"), F.lit("not disclosed").alias("text")))
    return joined.select(
        "org_id", "company_id", "metric_key", F.col("x").isNotNull().alias("disclosed"), F.col("x.b.value").alias("value"), F.col("x.b.normal").alias("unit"), F.col("x.b.p").alias("passage_id"),
        (F.col("x.n") - 1).alias("alternatives"), F.when(F.col("x").isNull(), missing).otherwise(notes).alias("notes"),
    )


def comparability(grid: DataFrame, *, by: list[str]) -> DataFrame:
    """Of each row of a noted grid: coverage, and whether its values can be compared: two or more of one unit, and no note that forbids it."""
    hinders = F.exists("notes", lambda n: n["kind"].isin(*HINDERING))
    shown = F.col("disclosed")
    grouped = grid.groupBy(*by).agg(F.count_if(shown).alias("n"), F.count("*").alias("of"), F.countDistinct(F.when(shown, F.coalesce("unit", F.lit("")))).alias("units"), F.coalesce(F.bool_or(F.when(shown, hinders)), F.lit(False)).alias("hindered"))
    fine = (F.col("n") >= 2) & (F.col("units") == 1) & ~F.col("hindered")
    label = F.when(fine, "directly comparable").when(F.col("n") >= 2, "limited, see notes").otherwise("too few values")
    return grouped.select(*by, F.concat_ws("/", F.col("n").cast("string"), F.col("of").cast("string")).alias("coverage"), fine.alias("comparable"), label.alias("label"))
