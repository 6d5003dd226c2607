"""Nested checks over facts and passages, evaluated for all companies at once: leaves first, then level by level to the roots.

An outcome has satisfied (null: not applicable), weak, up to three passages, up to five metrics, the passages that made a
condition hold, and a note. any_of takes the first satisfied check that isn't weak, else the first satisfied one; conditional is its
`then` where `when` is satisfied and not applicable elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import format_value
from ..sources.catalogue import LEAVES, Node
from ..sources.scratch import materialise
from .patterns import check_matches

PASSAGES, METRICS, CONTEXT, OTHERS = 3, 5, 2, 2
_OUTCOME = ["satisfied", "weak", "passages", "context", "metrics", "note"]
_NONE = "array<string>"


def _empty() -> Column:
    return F.array().cast(_NONE)


def _frame(spark, nodes: list[Node]) -> DataFrame:
    """The nodes as a table; a catalogue is written by hand, so it is broadcast."""
    rows = [(n.set_id, n.code, n.element, n.weight, n.node, n.parent, n.role, n.ordinal, n.depth, n.type, list(n.metric_keys), list(n.weak_metric_keys), list(n.patterns), list(n.context)) for n in nodes]
    schema = "set_id string, code string, element string, weight double, node int, parent int, role string, ordinal int, depth int, type string, metric_keys array<string>, weak_metric_keys array<string>, patterns array<string>, context_patterns array<string>"
    return F.broadcast(spark.createDataFrame(rows, schema))


def metric_outcomes(facts: DataFrame, nodes: DataFrame, period: str) -> DataFrame:
    """(company_id, node, outcome) of metric and metric_period leaves that have any value.

    `facts` has company_id, metric_key, metric_id, passage_id, value, unit, period_label, inferred, base_year, method and confidence_pct.
    Values of the period count, strong keys before weak ones, tables before text, then by confidence. Where only other periods have
    values, the note names them. Each role's rows are cut to what an outcome shows before they are collected.
    """
    leaves = nodes.filter(F.col("type").isin("metric", "metric_period")).select("node", "type", "metric_keys", "weak_metric_keys")
    strong = leaves.select("node", "type", F.explode("metric_keys").alias("metric_key"), F.lit("strong").alias("key_role"))
    weak = leaves.filter("type = 'metric'").select("node", "type", F.explode("weak_metric_keys").alias("metric_key"), F.lit("weak").alias("key_role"))
    used = facts.filter(~F.col("base_year")).join(F.broadcast(strong.unionByName(weak)), "metric_key")
    here = F.coalesce(F.col("period_label") == period, F.lit(False))
    own = F.when(~here, F.array(F.lit("other"))).when((F.col("type") == "metric_period") & ~F.col("inferred"), F.array("key_role", F.lit("explicit"))).otherwise(F.array("key_role"))
    order = F.struct((F.col("method") != "table").alias("t"), (-F.col("confidence_pct")).alias("c"), F.col("passage_id").alias("p"), F.col("metric_id").alias("m"))
    each = used.select("company_id", "node", "type", F.explode(own).alias("role"), order.alias("o"), "value", "unit", "period_label")
    group = Window.partitionBy("company_id", "node", "role").orderBy("o")
    new = F.row_number().over(Window.partitionBy("company_id", "node", "role", "o.p").orderBy("o")) == 1
    cut = each.withColumn("new", new).withColumns({"n": F.row_number().over(group), "place": F.sum(F.col("new").cast("int")).over(group.rowsBetween(Window.unboundedPreceding, 0))})
    cut = cut.filter((F.col("n") <= METRICS) | (F.col("new") & (F.col("place") <= PASSAGES)))
    row = F.struct("role", "o", "n", "new", "place", "value", "unit")
    first = cut.groupBy("company_id", "node", "type").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    periods = each.filter("role = 'other'").groupBy("company_id", "node").agg(F.sort_array(F.collect_set(F.coalesce("period_label", F.lit("unknown period")))).alias("periods"))

    def of(role: str) -> Column:
        return F.filter("rows", lambda r: r["role"] == role)

    def passages(rows: Column, most: int) -> Column:
        return F.transform(F.filter(rows, lambda r: r["new"] & (r["place"] <= most)), lambda r: r["o"]["p"])

    parted = first.join(periods, ["company_id", "node"], "left").select("company_id", "node", "type", "periods", *[of(r).alias(r) for r in ("strong", "weak", "explicit", "other")])
    by_period = F.col("type") == "metric_period"
    found = F.when(by_period & (F.size("explicit") > 0), F.slice("explicit", 1, 1)).when(by_period, F.slice("strong", 1, 1)).when(F.size("strong") > 0, F.col("strong")).otherwise(F.col("weak"))
    parted = parted.withColumn("found", found).withColumn("satisfied", F.size("found") > 0)
    is_weak = F.when(by_period, F.size("explicit") == 0).otherwise(F.size("strong") == 0)
    best = F.get("found", F.lit(0))
    told = F.concat(format_value(best["value"]), F.coalesce(F.concat(F.lit(" "), best["unit"]), F.lit("")), F.lit(f" for {period} ("), best["o"]["p"], F.lit(")"))
    note = (
        F.when(F.col("satisfied") & by_period, F.concat(F.when(F.size("explicit") > 0, f"{period} is stated with the value (").otherwise(f"{period} is the document's own period ("), best["o"]["p"], F.lit(")")))
        .when(F.col("satisfied"), F.concat(told, F.when(is_weak, "; a weaker match").otherwise("")))
        .when(by_period, F.lit(f"no value for {period}"))
        .otherwise(F.concat(F.lit("values for other periods only: "), F.array_join("periods", ", ")))
    )
    shown = F.when(F.col("satisfied"), passages(F.col("found"), PASSAGES)).when(by_period, _empty()).otherwise(passages(F.col("other"), OTHERS))
    metrics = F.transform(F.filter("found", lambda r: r["n"] <= METRICS), lambda r: r["o"]["m"].cast("string"))
    return parted.select("company_id", "node", "satisfied", (F.col("satisfied") & is_weak).alias("weak"), shown.alias("passages"), _empty().alias("context"), metrics.alias("metrics"), note.alias("note"))


def pattern_outcomes(passages: DataFrame, nodes: DataFrame, relevance: DataFrame | None) -> DataFrame:
    """(company_id, node, outcome) of pattern leaves that match: the first three passages by relevance, then by place.

    `passages` has company_id, passage_id, ordinal, text, kind and section; `relevance` company_id, code, passage_id and score.
    """
    leaves = nodes.filter("type = 'pattern'")
    checks = leaves.select(F.col("node").alias("check_id"), "patterns", F.col("context_patterns").alias("context"))
    hits = check_matches(passages, checks, keep=["company_id", "passage_id", "ordinal"]).withColumnRenamed("check_id", "node")
    if relevance is not None:
        hits = hits.join(F.broadcast(leaves.select("node", "code")), "node").join(relevance, ["company_id", "code", "passage_id"], "left")
    score = F.coalesce("score", F.lit(0.0)) if relevance is not None else F.lit(0.0)
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("company_id", "node").orderBy(F.desc(score), "ordinal", "passage_id"))).filter(F.col("rank") <= PASSAGES)
    rows = F.sort_array(F.collect_list(F.struct("rank", "passage_id", "snippet")))
    best = F.get("rows", F.lit(0))
    note = F.concat(F.lit("“"), best["snippet"], F.lit("” ("), best["passage_id"], F.lit(")"))
    return ranked.groupBy("company_id", "node").agg(rows.alias("rows")).select(
        "company_id", "node", F.lit(True).alias("satisfied"), F.lit(False).alias("weak"), F.transform("rows", lambda r: r["passage_id"].cast("string")).alias("passages"),
        _empty().alias("context"), _empty().alias("metrics"), note.alias("note"),
    )


def evaluate(companies: DataFrame, nodes: list[Node], *, period: str = "", facts: DataFrame | None = None, passages: DataFrame | None = None, relevance: DataFrame | None = None) -> DataFrame:
    """One row per company (company_id) and element: status (satisfied, missing, not_applicable), weak, passages, context, metrics and note.

    Leaf outcomes are a table, and each level above is one aggregation by company and parent over rows that are already together.
    """
    spark = companies.sparkSession
    table = _frame(spark, nodes)
    leaves = [n for n in nodes if n.type in LEAVES]
    unmet = {"metric": "no value in the documents", "metric_period": f"no value for {period}", "pattern": "no passage matches"}
    cells = F.array(*[F.struct(F.lit(n.node).alias("node"), F.lit(unmet[n.type]).alias("unmet")) for n in leaves])
    grid = companies.select("company_id", F.explode(cells).alias("cell")).select("company_id", "cell.*")
    found = [metric_outcomes(facts, table, period)] if facts is not None else []
    if passages is not None:
        found.append(pattern_outcomes(passages, table, relevance))
    joined = grid
    if found:
        joined = grid.join(found[0] if len(found) == 1 else found[0].unionByName(found[1]), ["company_id", "node"], "left")
    else:
        joined = grid.selectExpr("*", *[f"CAST(NULL AS {'boolean' if c in ('satisfied', 'weak') else 'string' if c == 'note' else _NONE}) AS {c}" for c in _OUTCOME])
    known = joined.select(
        "company_id", "node", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("satisfied", "weak")], *[F.coalesce(c, _empty()).alias(c) for c in ("passages", "context", "metrics")],
        F.coalesce("note", "unmet").alias("note"),
    )
    known = materialise(known.repartition("company_id"), "check-leaves")  # each level reads it again
    place = table.select("node", "parent", "role", "ordinal", "depth")
    for depth in range(max(n.depth for n in nodes), 0, -1):
        below = known.join(place.filter(F.col("depth") == depth), "node")
        kids = below.groupBy("company_id", "parent").agg(F.sort_array(F.collect_list(F.struct("ordinal", "role", F.struct(*_OUTCOME).alias("of")))).alias("kids"))
        above = kids.join(table.select(F.col("node").alias("parent"), "type"), "parent")
        held = F.transform("kids", lambda k: k["of"])
        sound = F.filter(held, lambda o: F.coalesce(o["satisfied"], F.lit(False)))
        chosen = F.coalesce(F.get(F.filter(sound, lambda o: ~o["weak"]), F.lit(0)), F.get(sound, F.lit(0)))
        unmet_any = F.struct(F.lit(False).alias("satisfied"), F.lit(False).alias("weak"), _empty().alias("passages"), _empty().alias("context"), _empty().alias("metrics"), F.get(held, F.lit(0))["note"].alias("note"))
        either = F.when(F.size(sound) > 0, F.struct(*[(_empty() if c == "context" else chosen[c]).alias(c) for c in _OUTCOME])).otherwise(unmet_any)
        when, then = F.get(held, F.lit(0)), F.get(held, F.lit(1))
        reason = F.concat(then["note"], F.lit("; it applies as the documents say: "), F.substring_index(when["note"], " (", 1))
        applies = F.struct(then["satisfied"].alias("satisfied"), then["weak"].alias("weak"), then["passages"].alias("passages"), F.slice(when["passages"], 1, CONTEXT).alias("context"), then["metrics"].alias("metrics"), reason.alias("note"))
        moot = F.struct(F.lit(None).cast("boolean").alias("satisfied"), F.lit(False).alias("weak"), _empty().alias("passages"), _empty().alias("context"), _empty().alias("metrics"), F.lit("not applicable: what it depends on wasn't found").alias("note"))
        outcome = F.when(F.col("type") == "any_of", either).when(F.coalesce(when["satisfied"], F.lit(False)), applies).otherwise(moot)
        known = known.unionByName(above.select("company_id", F.col("parent").alias("node"), outcome.alias("of")).select("company_id", "node", "of.*"))
    roots = table.filter("parent IS NULL").select("node", "set_id", "code", "element", "weight")
    status = F.when(F.col("satisfied").isNull(), "not_applicable").when(F.col("satisfied"), "satisfied").otherwise("missing")
    return known.join(roots, "node").select("company_id", "set_id", "code", "element", "weight", status.alias("status"), "weak", "passages", "context", "metrics", "note")
