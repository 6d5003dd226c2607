"""Evaluation over generated cases: a counter-based generator, one assessment of all cases as one plan, and its figures.

A case is a short text about one company and what is true of it. Each draw is a hash of seed, case and name, so that a case is the
same whatever others there are, in any order and partitioning. Elements are written in standard wording, paraphrased (true, but
not in words that the rules know), left out, or replaced by a trap (words that look alike, but say something else).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences
from ..sources.catalogue import flatten
from ..sources.scratch import materialise
from ..sources.tables import dealt
from . import disclosures as D
from .assessment import status_of
from .checks import evaluate
from .extraction import sentence_metrics
from .quantiles import exact_quantile

SEED, YEAR = 7, "FY2025"
KINDS = ("standard", "paraphrase", "absent", "trap")
#: Shares up to which a draw means each kind, in the order of KINDS.
SHARES = (0.5, 0.65, 0.85, 1.0)
CONFLICT_SHARE = 0.2
#: Element: its wordings by kind, with {v} for the value.
WORDING = {
    "value": {"standard": "Scope 1 emissions were {v} tCO2e in FY2025.", "paraphrase": "Our chimneys and vehicles released {v} tCO2e in FY2025.", "trap": "The Scope 1 team has {v} members in FY2025."},
    "boundary": {"standard": "Consolidation follows operational control.", "paraphrase": "Sites that we run are counted in full.", "trap": "We left financial control to the bank."},
    "method": {"standard": "Figures follow the GHG Protocol.", "paraphrase": "A protocol that many use guided us.", "trap": "A standard for management covers the sites."},
}
CONFLICT = "Another report gives Scope 1 emissions of {w} tCO2e for FY2025."
CATALOGUE = {
    "key": "evaluation", "version": "1",
    "requirements": [{
        "code": "E1", "title": "Scope 1", "elements": [
            {"key": "value", "label": "Value", "weight": 2.0, "check": {"type": "metric", "metric_keys": ["ghg_scope1"]}},
            {"key": "period", "label": "Period", "weight": 1.0, "check": {"type": "metric_period", "metric_keys": ["ghg_scope1"]}},
            {"key": "boundary", "label": "Boundary", "weight": 1.0, "check": {"type": "pattern", "patterns": [r"(operational|financial)[\s-]control|equity[\s-]share"]}},
            {"key": "method", "label": "Method", "weight": 1.0, "check": {"type": "pattern", "patterns": [r"ghg\s+protocol", r"iso\s*14064"]}},
        ],
    }],
}


def draw(seed: int, case: Column, name: str) -> Column:
    """A number in [0, 1) that depends on seed, case and name alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), case.cast("string"), F.lit(name))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def generated_cases(rows: DataFrame, *, seed: int = SEED) -> DataFrame:
    """A case for each row (case_id, value): text, gold elements (a map), gold conflict and status."""
    case, value = F.col("case_id"), F.col("value").cast("long")
    kinds = {}
    for element in WORDING:
        u = draw(seed, case, element)
        kind = F.lit(KINDS[-1])
        for name, share in reversed(list(zip(KINDS[:-1], SHARES[:-1], strict=True))):
            kind = F.when(u < share, name).otherwise(kind)
        kinds[f"k_{element}"] = kind
    staged = rows.select("case_id", value.alias("value"), *[k.alias(c) for c, k in kinds.items()])
    conflict = (F.col("k_value") == "standard") & (draw(seed, case, "conflict") < CONFLICT_SHARE)

    def said(element: str) -> Column:
        text = F.lit(None).cast("string")
        for kind, wording in WORDING[element].items():
            text = F.when(F.col(f"k_{element}") == kind, F.replace(F.lit(wording), F.lit("{v}"), F.format_number("value", 0))).otherwise(text)
        return text

    other = F.when(F.col("conflict"), F.replace(F.lit(CONFLICT), F.lit("{w}"), F.format_number(F.col("value") + F.floor(F.col("value") / 20), 0)))
    staged = staged.withColumn("conflict", conflict)
    parts = F.array_compact(F.array(*[F.when(said(e).isNotNull(), F.struct(draw(seed, case, f"place {e}").alias("u"), said(e).alias("text"))) for e in WORDING], F.when(other.isNotNull(), F.struct(draw(seed, case, "place other").alias("u"), other.alias("text")))))
    text = F.array_join(F.transform(F.array_sort(parts), lambda p: p["text"]), " ")
    true = {e: F.col(f"k_{e}").isin("standard", "paraphrase") for e in WORDING}
    gold = F.create_map(*[x for e, v in {**true, "period": true["value"]}.items() for x in (F.lit(e), v)])
    weights = {e["key"]: e["weight"] for e in CATALOGUE["requirements"][0]["elements"]}
    share = sum(F.when({**true, "period": true["value"]}[e], w).otherwise(0.0) for e, w in weights.items()) / sum(weights.values())
    return staged.select("case_id", "value", text.alias("text"), gold.alias("gold_elements"), "conflict", status_of(F.round(share, 4), F.col("conflict")).alias("gold"), true["value"].alias("has_value"))


def run_cases(cases: DataFrame) -> DataFrame:
    """One row a case: gold and predicted status, elements, conflict and value, citations, and its size, from one assessment of all.

    A sentence is a passage. Its values and their conflicts, the checks of the catalogue and their completeness are computed for all
    cases together, keyed by case.
    """
    cases = materialise(dealt(cases, "case_id"), "eval-cases")
    split = cases.select(F.col("case_id").alias("company_id"), F.posexplode(sentences(F.col("text"))).alias("ordinal", "text")).filter("text <> ''")
    passages = split.select("*", F.concat_ws(":", F.col("company_id").cast("string"), F.col("ordinal").cast("string")).alias("passage_id"), F.lit("paragraph").alias("kind"), F.lit(None).cast("string").alias("section"))
    found = sentence_metrics(passages.select("passage_id", "text"), by="passage_id")
    facts = found.select(
        F.split("passage_id", ":")[0].cast(cases.schema["case_id"].dataType).alias("company_id"), "passage_id", F.concat_ws("#", "passage_id", F.col("place.from").cast("string")).alias("metric_id"), "metric_key", "value", "unit",
        "normalized_value", "normalized_unit", "period_label", F.col("period_inferred").alias("inferred"), "base_year", F.lit("text").alias("method"), F.round(F.col("confidence") * 100).cast("long").alias("confidence_pct"),
    )
    facts = materialise(facts, "eval-facts")
    companies = cases.select(F.col("case_id").alias("company_id"))
    elements = evaluate(companies, flatten([CATALOGUE]), period=YEAR, facts=facts, passages=passages)
    disagree = D.conflicts(facts.filter(F.col("period_label") == YEAR), by=["company_id", "metric_key"]).groupBy("company_id").agg(F.lit(True).alias("disagree"))
    weight = F.when(F.col("status") != "not_applicable", F.col("weight")).otherwise(0.0)
    per = elements.groupBy("company_id").agg(
        F.map_from_entries(F.collect_list(F.struct("element", F.col("status") == "satisfied"))).alias("predicted_elements"), F.round(F.sum(F.when(F.col("status") == "satisfied", F.col("weight")).otherwise(0.0)) / F.sum(weight), 4).alias("share"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("status") == "satisfied", F.col("passages")).otherwise(F.array().cast("array<string>")))))).alias("citations"),
    )
    near = facts.filter((F.col("metric_key") == "ghg_scope1") & (F.col("period_label") == YEAR)).join(cases.select(F.col("case_id").alias("company_id"), F.col("value").alias("wanted")), "company_id")
    hit = near.filter(F.abs(F.col("normalized_value") - F.col("wanted")) <= 0.005 * F.abs("wanted")).groupBy("company_id").agg(F.lit(True).alias("value_found"))
    joined = cases.withColumnRenamed("case_id", "company_id").join(per, "company_id")
    for part in (disagree, hit):
        joined = joined.join(part, "company_id", "left")
    clash = F.coalesce("disagree", F.lit(False))
    return joined.select(
        F.col("company_id").alias("case_id"), "gold", status_of(F.col("share"), clash).alias("predicted"), "gold_elements", "predicted_elements", F.col("conflict").alias("gold_conflict"), clash.alias("predicted_conflict"),
        F.when(F.col("has_value"), F.coalesce("value_found", F.lit(False))).alias("value_found"), "citations", F.lit(0).alias("invalid_citations"), clash.alias("requires_review"), F.length("text").alias("cost"),
    )


def _prf(gold: Column, said: Column, name: str) -> list[Column]:
    tp, fp, fn = F.sum((gold & said).cast("long")), F.sum((~gold & said).cast("long")), F.sum((gold & ~said).cast("long"))
    share = lambda a, b: F.round(F.coalesce(a / F.nullif(a + b, F.lit(0)), F.lit(0.0)), 6)
    return [share(tp, fp).alias(f"{name}_precision"), share(tp, fn).alias(f"{name}_recall")]


def summary(results: DataFrame) -> DataFrame:
    """The figures of a run of cases as one row; the median of `cost` is exact and no task's alone."""
    results = materialise(results, "eval-results")
    gap, said = F.col("gold") != "supported", F.col("predicted") != "supported"
    keys = F.array(*[F.lit(e["key"]) for e in CATALOGUE["requirements"][0]["elements"]])
    count = lambda want, have: F.size(F.filter(keys, lambda k: (F.element_at("gold_elements", k) == want) & (F.element_at("predicted_elements", k) == have)))
    tp, fp, fn = F.sum(count(True, True)), F.sum(count(False, True)), F.sum(count(True, False))
    share = lambda a, b: F.round(F.coalesce(a / F.nullif(a + b, F.lit(0)), F.lit(0.0)), 6)
    cited = F.sum("citations")
    row = results.agg(
        F.count("*").alias("cases"), F.round(F.avg((F.col("gold") == F.col("predicted")).cast("double")), 6).alias("status_accuracy"), *_prf(gap, said, "gap"), share(tp, fp).alias("element_precision"), share(tp, fn).alias("element_recall"),
        *_prf(F.col("gold_conflict"), F.col("predicted_conflict"), "conflict"), F.round(F.avg(F.col("value_found").cast("double")), 6).alias("numeric_accuracy"), F.count("value_found").alias("numeric_cases"),
        F.round(F.coalesce(1 - F.sum("invalid_citations") / F.nullif(cited, F.lit(0)), F.lit(1.0)), 6).alias("citation_validity"), F.coalesce(cited, F.lit(0)).alias("citations"),
        F.round(F.avg(F.col("requires_review").cast("double")), 6).alias("review_rate"),
    )
    return row.withColumn("median_cost", F.lit(exact_quantile(results, "cost")).cast("double"))


def report(summaries: DataFrame) -> DataFrame:
    """Markdown of summaries (mode and the columns of `summary`): a line a figure, a column a mode in order of their names."""
    percent = lambda c: F.coalesce(F.format_string("%.1f%%", F.col(c) * 100), F.lit("—"))
    lines = [
        ("Cases", F.col("cases").cast("string")), ("Status accuracy", percent("status_accuracy")), ("Gap detection, precision", percent("gap_precision")), ("Gap detection, recall", percent("gap_recall")),
        ("Element detection, precision", percent("element_precision")), ("Element detection, recall", percent("element_recall")), ("Contradictions, precision", percent("conflict_precision")), ("Contradictions, recall", percent("conflict_recall")),
        ("Values found", F.concat(percent("numeric_accuracy"), F.lit(" ("), F.col("numeric_cases").cast("string"), F.lit(" values)"))), ("Citation validity", percent("citation_validity")), ("Review rate", percent("review_rate")),
        ("Median cost", F.format_string("%.1f", "median_cost")),
    ]
    each = summaries.select("mode", F.posexplode(F.array(*[F.struct(F.lit(name).alias("name"), shown.alias("shown")) for name, shown in lines])).alias("at", "line")).select("mode", "at", "line.*")
    cells = F.transform(F.array_sort(F.collect_list(F.struct("mode", "shown"))), lambda x: x["shown"])
    rows = each.groupBy("at", "name").agg(F.concat(F.lit("| "), F.col("name"), F.lit(" | "), F.array_join(cells, " | "), F.lit(" |")).alias("line"))
    body = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("body"))
    modes = summaries.agg(F.array_sort(F.collect_list("mode")).alias("modes"))
    head = F.concat(F.lit("| Figure | "), F.array_join("modes", " | "), F.lit(" |\n|---|"), F.repeat(F.lit("---|"), F.size("modes")), F.lit("\n"))
    return modes.crossJoin(body).select(F.concat(head, "body").alias("report"))  # one row each
