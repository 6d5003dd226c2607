"""A declarative catalogue of requirement checks over metric facts: elements, completeness, status, confidence, gaps.

The catalogue is a few dozen rows; it is flattened to (element, key, strength) rows that join the facts by key, so that
one plan evaluates every company and requirement, with no loop over either.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .disclosures import conflicts


@dataclass(frozen=True)
class Element:
    """One element of a requirement.

    kind: metric (strong keys, else weak ones), metric_period (explicit period strong, inferred weak), any_of (strong
    preferred, any key does), conditional (only where `when` is disclosed; not applicable otherwise).
    """

    code: str
    element: str
    weight: float
    kind: str
    strong: tuple[str, ...]
    weak: tuple[str, ...] = ()
    when: str | None = None


CATALOGUE = [
    Element("R1", "total", 2.0, "metric", ("Brand#1",), ("Brand#11",)),
    Element("R1", "period", 1.0, "metric_period", ("Brand#1",)),
    Element("R2", "energy", 1.0, "metric", ("Brand#2", "Brand#3")),
    Element("R2", "detail", 1.0, "conditional", ("Brand#4",), (), "Brand#2"),
    Element("R3", "either", 1.0, "any_of", ("Brand#5",), ("Brand#6",)),
    Element("R3", "period", 0.5, "metric_period", ("Brand#5",)),
    Element("R4", "water", 1.0, "metric", ("Brand#7",), ("Brand#8",)),
]
IMPORTANCE = {"R1": 3, "R2": 2, "R3": 2, "R4": 1}
STRUCTURED = ("metric", "metric_period")
#: Text sources below this confidence don't stand alone.
DOUBTFUL_PCT = 93


def catalogue_frame(spark: SparkSession, catalogue: list[Element]) -> DataFrame:
    rows = [(e.code, e.element, k, e.weight, e.kind, list(e.strong), list(e.weak), e.when) for k, e in enumerate(catalogue)]
    return spark.createDataFrame(rows, "code string, element string, ordinal int, weight double, kind string, strong array<string>, weak array<string>, when_key string")


def element_results(companies: DataFrame, facts: DataFrame, catalogue: list[Element], period_label: str) -> DataFrame:
    """`element_results_of` for one period."""
    return element_results_of(companies, facts, catalogue, [period_label]).drop("period_label")


def catalogue_keys(catalogue: list[Element]) -> list[str]:
    """The metric keys that any element looks at."""
    return sorted({k for e in catalogue for k in (*e.strong, *e.weak, *((e.when,) if e.when else ()))})


def element_results_of(companies: DataFrame, facts: DataFrame, catalogue: list[Element], periods: list[str]) -> DataFrame:
    """period_label, company, code, element with status (satisfied, missing, not_applicable), weak, confidence and its passages, for all
    periods from one aggregation.

    Up to three passages by (table first, confidence, id) stand for an element. Facts are reduced to the catalogue's
    keys, and per role to the first three before anything is collected: Spark cuts each task's rows to them before the
    shuffle. The catalogue is broadcast, being the driver's own list.
    """
    spark = facts.sparkSession
    elements = catalogue_frame(spark, catalogue)
    keys = elements.select("code", "element", F.explode("strong").alias("metric_key"), F.lit("strong").alias("role")).unionByName(
        elements.select("code", "element", F.explode("weak").alias("metric_key"), F.lit("weak").alias("role"))
    )
    keys = keys.unionByName(elements.filter("when_key IS NOT NULL").select("code", "element", F.col("when_key").alias("metric_key"), F.lit("when").alias("role")))
    used = facts.filter(F.col("period_label").isin(periods) & ~F.col("base_year")).join(F.broadcast(keys), "metric_key")
    # a strong fact of a stated period counts once more, as explicit
    roles = F.when((F.col("role") == "strong") & ~F.col("inferred"), F.array(F.lit("strong"), F.lit("explicit"))).otherwise(F.array("role"))
    order = F.struct((F.col("method") != "table").alias("t"), (-F.col("confidence_pct")).alias("c"), F.col("passage_id").alias("p"), F.col("method").alias("m"))
    each = used.select("period_label", "company_id", "code", "element", F.explode(roles).alias("role"), order.alias("o"))
    rank = F.row_number().over(Window.partitionBy("period_label", "company_id", "code", "element", "role").orderBy("o"))
    three = each.withColumn("rank", rank).filter("rank <= 3")

    def best(role: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("role") == role, F.col("o"))))

    grouped = three.groupBy("period_label", "company_id", "code", "element").agg(
        best("strong").alias("strong_best"), best("weak").alias("weak_best"),
        F.count_if(F.col("role") == "when").alias("n_when"),
        F.count_if(F.col("role") == "explicit").alias("n_explicit"),
    )
    cells = [F.struct(F.lit(e.code).alias("code"), F.lit(e.element).alias("element"), F.lit(k).alias("ordinal"), F.lit(e.weight).alias("weight"), F.lit(e.kind).alias("kind")) for k, e in enumerate(catalogue)]
    grid = companies.select("company_id", F.explode(F.array(*cells)).alias("cell")).select("company_id", "cell.*", F.explode(F.array(*map(F.lit, periods))).alias("period_label"))
    joined = grid.join(grouped, ["period_label", "company_id", "code", "element"], "left")
    n_strong, n_weak = (F.coalesce(F.size(c), F.lit(0)) for c in ("strong_best", "weak_best"))
    chosen = F.when(n_strong > 0, F.col("strong_best")).when(n_weak > 0, F.col("weak_best"))
    applicable = (F.col("kind") != "conditional") | (F.coalesce("n_when", F.lit(0)) > 0)
    status = F.when(~applicable, "not_applicable").when(n_strong + n_weak > 0, "satisfied").otherwise("missing")
    weak = F.when(F.col("kind") == "metric_period", F.coalesce("n_explicit", F.lit(0)) == 0).otherwise(n_strong == 0)
    staged = joined.withColumn("status", status).withColumn("chosen", F.when(F.col("status") == "satisfied", chosen))
    return staged.select(
        "period_label", "company_id", "code", "element", "ordinal", "weight", "kind", "status",
        ((F.col("status") == "satisfied") & weak).alias("weak"),
        F.coalesce(F.transform("chosen", lambda s: s["p"]), F.array().cast("array<string>")).alias("passages"),
        F.array_max(F.transform("chosen", lambda s: -s["c"])).alias("confidence_pct"),
        F.coalesce(F.forall("chosen", lambda s: s["m"] == "text") & (F.array_min(F.transform("chosen", lambda s: -s["c"])) < DOUBTFUL_PCT), F.lit(False)).alias("doubtful"),
    )


def requirement_conflicts(facts: DataFrame, catalogue: list[Element], period_label: str) -> DataFrame:
    """`requirement_conflicts_of` for one period."""
    return requirement_conflicts_of(facts, catalogue, [period_label]).drop("period_label")


def requirement_conflicts_of(facts: DataFrame, catalogue: list[Element], periods: list[str]) -> DataFrame:
    """period_label, company, code and the metric keys of the requirement on which its sources disagree."""
    keys = facts.sparkSession.createDataFrame(sorted({(e.code, k) for e in catalogue for k in e.strong + e.weak}), "code string, metric_key string")
    found = conflicts(facts.filter(F.col("period_label").isin(periods) & ~F.col("base_year")), by=["period_label", "company_id", "metric_key"])
    return found.join(F.broadcast(keys), "metric_key").select("period_label", "company_id", "code", "metric_key", "low_passage", "high_passage")


def completeness() -> Column:
    """Weight of satisfied elements over that of applicable ones, 4 decimals; 0 without any."""
    applicable = F.sum(F.when(F.col("status") != "not_applicable", F.col("weight")).otherwise(0.0))
    return F.when(applicable > 0, F.round(F.sum(F.when(F.col("status") == "satisfied", F.col("weight")).otherwise(0.0)) / applicable, 4)).otherwise(0.0)


def status_of(share: Column, conflicting: Column) -> Column:
    return F.when(conflicting, "conflicting").when(share >= 0.9999, "supported").when(share > 0, "partially_supported").otherwise("not_found")


def confidence(conflicting: Column) -> Column:
    """Mean over applicable elements: 0.75 for a missing one, else its best source's, x 0.8 if weak; x 0.85 under conflict, at most 0.95."""
    each = F.when(F.col("status") == "missing", 0.75).when(F.col("status") == "satisfied", F.coalesce(F.col("confidence_pct") / 100, F.lit(0.8)) * F.when(F.col("weak"), 0.8).otherwise(1.0))
    mean = F.avg(each)
    return F.when(mean.isNull(), 0.3).otherwise(F.round(F.least(F.lit(0.95), mean * F.when(conflicting, 0.85).otherwise(1.0)), 6))


def findings(elements: DataFrame, disagreements: DataFrame, *more: str) -> DataFrame:
    """One row per company and requirement (and per what `more` columns of both say): completeness, status, confidence and why a human should look."""
    keys = [*more, "company_id", "code"]
    per = disagreements.groupBy(*keys).agg(F.count("*").alias("n_conflicts"))
    joined = elements.join(per, keys, "left")
    conflicting = F.coalesce(F.max("n_conflicts"), F.lit(0)) > 0
    grouped = joined.groupBy(*keys).agg(
        completeness().alias("completeness"), confidence(conflicting).alias("confidence"), conflicting.alias("conflicting"), F.bool_or("doubtful").alias("doubtful"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "missing", F.col("element")))), "; ").alias("missing"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("passages")))).alias("evidence"),
    )
    plain = status_of(F.col("completeness"), F.col("conflicting"))
    status = F.when(F.col("doubtful") & ~F.col("conflicting"), "human_review").otherwise(plain)
    return grouped.select(*keys, "completeness", "confidence", status.alias("status"), (F.col("doubtful") | F.col("conflicting")).alias("requires_review"), "missing", "evidence")


def merge_verdicts(elements: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Model verdicts (company, code, element, verdict, valid, confident) under the fixed policy, per element.

    Structured elements are never overturned; an upgrade needs a valid citation; unclear verdicts only leave a note
    on structured elements where the model is confident, else a reason to review.
    """
    joined = elements.join(verdicts, ["company_id", "code", "element"], "left")
    structured = F.col("kind").isin(*STRUCTURED)
    own, said = F.col("status"), F.coalesce("verdict", F.lit("none"))
    valid = F.coalesce("valid", F.lit(False))
    downgrade = (own == "satisfied") & (said == "no") & ~structured
    upgrade = (own == "missing") & (said == "yes") & valid
    reason = (
        F.when((own == "not_applicable") | (said == "none"), F.lit(None))
        .when((own == "satisfied") & (said == "no") & structured, "model disagrees with a structured element")
        .when(upgrade & structured, "model adds a structured element")
        .when((own == "missing") & (said == "yes") & ~valid, "citation not valid")
        .when((said == "unclear") & ~(structured & F.coalesce("confident", F.lit(False))), "model is unclear")
    )
    return joined.select(
        "company_id", "code", "element", "weight", "kind",
        F.when(own == "not_applicable", own).when(downgrade, "missing").when(upgrade, "satisfied").otherwise(own).alias("status"),
        F.when(downgrade, F.lit(False)).when(upgrade, F.lit(True)).otherwise(F.col("weak")).alias("weak"),
        F.when((own != "not_applicable") & (downgrade | upgrade), "model").otherwise("rules").alias("source"),
        "confidence_pct", reason.alias("reason"),
    )


def gaps(found: DataFrame, elements: DataFrame, disagreements: DataFrame) -> DataFrame:
    """A row per conflict, per missing element of findings without conflict, and per review without either."""
    conflict = disagreements.select("company_id", "code", F.concat(F.lit("conflict:"), F.col("metric_key")).alias("gap_key")).distinct()
    open_ = found.filter(F.col("status") != "conflicting").select("company_id", "code")
    missing = elements.filter("status = 'missing'").join(open_, ["company_id", "code"], "left_semi").select("company_id", "code", F.concat(F.lit("missing:"), F.col("element")).alias("gap_key"))
    both = conflict.unionByName(missing)
    review = found.filter("status = 'human_review'").join(both, ["company_id", "code"], "left_anti").select("company_id", "code", F.lit("review").alias("gap_key"))
    return both.unionByName(review)


def sync_actions(current: DataFrame, existing: DataFrame, assessed: DataFrame) -> DataFrame:
    """Gaps against the last snapshot (company, code, gap_key, action_status, closed): what each action becomes.

    New keys open; existing ones are refreshed and reopen if done; keys gone from an assessed requirement close unless
    done, dismissed or closed already. A full outer join of two snapshots, then one semi-join.
    """
    now = current.select("company_id", "code", "gap_key", F.lit(True).alias("now"))
    both = now.join(existing, ["company_id", "code", "gap_key"], "full_outer").join(assessed.select("company_id", "code").distinct().withColumn("seen", F.lit(True)), ["company_id", "code"], "left")
    here, old = F.col("now").isNotNull(), F.col("action_status")
    closes = ~here & F.col("seen").isNotNull() & ~old.isin("done", "dismissed") & ~F.col("closed")
    change = F.when(here & old.isNull(), "created").when(here & (old == "done"), "reopened").when(here, "updated").when(closes, "closed").otherwise("untouched")
    status = F.when(here & old.isNull(), "open").when(here & (old == "done"), "open").otherwise(old)
    return both.select("company_id", "code", "gap_key", status.alias("action_status"), change.alias("change"), F.when(here, False).when(closes, True).otherwise(F.col("closed")).alias("closed"))


def evidence_links(elements: DataFrame, disagreements: DataFrame) -> DataFrame:
    """A row per finding and passage: role, the elements it supports and its rank.

    Supporting passages come in element then passage order; a conflict's ends turn them conflicting or follow.
    """
    support = elements.filter("status = 'satisfied'").select("company_id", "code", "ordinal", "element", F.posexplode("passages").alias("at", "passage_id"))
    ends = disagreements.select("company_id", "code", F.explode(F.array("low_passage", "high_passage")).alias("passage_id")).distinct()
    first = support.groupBy("company_id", "code", "passage_id").agg(F.min(F.struct("ordinal", "at")).alias("seen"), F.array_sort(F.collect_list(F.struct("ordinal", "element"))).alias("supports"))
    both = first.join(ends.withColumn("conflict", F.lit(True)), ["company_id", "code", "passage_id"], "full_outer")
    rank = F.row_number().over(Window.partitionBy("company_id", "code").orderBy(F.col("seen").isNull(), "seen", "passage_id"))
    names = F.array_join(F.transform(F.coalesce("supports", F.array().cast("array<struct<ordinal:int,element:string>>")), lambda s: s["element"]), ",")
    return both.select("company_id", "code", "passage_id", F.when(F.col("conflict"), "conflicting").otherwise("supporting").alias("role"), names.alias("elements"), rank.cast("long").alias("rank"))


def with_related(links: DataFrame, related: DataFrame) -> DataFrame:
    """Links and, behind each finding's last rank, its related passages (company_id, code, passage_id, place), which support nothing."""
    last = links.groupBy("company_id", "code").agg(F.max("rank").alias("last"))
    more = related.join(last, ["company_id", "code"], "left").withColumn("rank", F.coalesce("last", F.lit(0)) + F.col("place"))
    return links.unionByName(more.select("company_id", "code", "passage_id", F.lit("related").alias("role"), F.lit("").alias("elements"), F.col("rank").cast("long").alias("rank")))


#: Statuses a verdict can be far from (fixed values).
RANKS = {"not_found": 0, "partially_supported": 1, "supported": 2}


def merged_findings(found: DataFrame, merged: DataFrame, models: DataFrame) -> DataFrame:
    """Findings after the verdicts are merged: completeness and status of the merged elements, confidence, reasons to review.

    `models` has company_id, code, model_status, model_confidence, wants_review and n_evidence of each answer. A model that sees
    evidence lifts "not found" to "partially supported" if it says so too; two ranks apart, or an unsure model that asks for it,
    makes a human review; conflicts stay. Confidence is the mean of both, at 0.85 of it where they disagree, at most 0.95.
    """
    per = merged.groupBy("company_id", "code").agg(completeness().alias("completeness"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    both = found.select("company_id", "code", (F.col("status") == "conflicting").alias("conflicting"), F.col("confidence").alias("rules_confidence"), F.col("requires_review").alias("had")).join(per, ["company_id", "code"])
    joined = both.join(models, ["company_id", "code"], "left").withColumn("s0", status_of(F.col("completeness"), F.col("conflicting")))
    lifted = (F.col("s0") == "not_found") & (F.col("model_status") == "partially_supported") & (F.col("n_evidence") > 0)
    joined = joined.withColumn("s1", F.when(lifted, "partially_supported").otherwise(F.col("s0")))
    ranks = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])
    far = F.coalesce(F.abs(ranks[F.col("model_status")] - ranks[F.col("s1")]) == 2, F.lit(False))
    joined = joined.withColumns({"far": far, "s2": F.when(far, "human_review").otherwise(F.col("s1"))})
    unsure = F.coalesce(F.col("wants_review") & (F.col("model_confidence") < 0.5), F.lit(False)) & (F.col("s2") != "conflicting")
    doubted = F.coalesce(F.col("model_status") == "conflicting", F.lit(False)) & (F.col("s2") != "conflicting")
    joined = joined.withColumns({"unsure": unsure, "doubted": doubted, "status": F.when(unsure, "human_review").otherwise(F.col("s2"))})
    agree = F.when(F.col("model_status") == F.col("status"), 1.0).otherwise(0.85)
    mean = (F.col("rules_confidence") + F.col("model_confidence")) / 2 * agree
    more = F.array_compact(F.array(F.when(F.col("far"), "views differ by two ranks"), F.when(F.col("doubted"), "contradiction not confirmed by values"), F.when(F.col("unsure"), "model could not resolve it")))
    reasons = F.concat("reasons", more)
    return joined.select(
        "company_id", "code", "completeness", "status", F.when(F.col("model_status").isNull(), F.col("rules_confidence")).otherwise(F.round(F.round(F.least(F.lit(0.95), mean), 6), 2)).alias("confidence"),
        (F.col("had") | (F.size(reasons) > 0) | F.col("status").isin("conflicting", "human_review")).alias("requires_review"), F.array_join(reasons, "; ").alias("reasons"),
    )


#: Versions of a run's method (fixed values).
VERSION_FIELDS = ("pipeline_version", "extraction_version", "rules_version", "prompt_version", "llm_model", "mode")


def manifest_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What differs between two runs of a company, by their manifests: company_id, the requirements of both, whether documents changed, and
    the version fields that did.

    A manifest has company_id, requirements (code to content hash), documents (structs of lineage_id, id and sha256) and versions (a struct
    of VERSION_FIELDS). Documents are compared by lineage: added, removed, or of another id or hash. A run that isn't there has none.
    """
    sides = [m.select("company_id", *[F.col(c).alias(f"{c}_{end}") for c in ("requirements", "documents", "versions")]) for m, end in ((before, "before"), (after, "after"))]
    both = sides[0].join(sides[1], "company_id", "full_outer")
    listed = [F.array_distinct(F.coalesce(f"documents_{end}", F.array())) for end in ("before", "after")]
    moved = F.size(F.array_except(*listed)) + F.size(F.array_except(*reversed(listed))) > 0
    fields = F.array_compact(F.array(*[F.when(~F.col(f"versions_before.{f}").eqNullSafe(F.col(f"versions_after.{f}")), f) for f in VERSION_FIELDS]))
    return both.select("company_id", "requirements_before", "requirements_after", moved.alias("documents_changed"), fields.alias("fields"))


def diff_runs(before: DataFrame, after: DataFrame, manifest_before: DataFrame, manifest_after: DataFrame) -> DataFrame:
    """Findings of two runs that differ in status, completeness (3 places) or evidence, with evidence added and removed and every cause.

    Causes come from the runs' manifests (see `manifest_changes`): a requirement that only one of them has, or whose content hash
    differs; documents, where they changed and the evidence differs too; the method, where a version field differs. Where
    nothing else explains a difference, the selection of evidence does.
    """
    a = before.select("company_id", "code", F.col("status").alias("status_before"), F.col("completeness").alias("share_before"), F.col("evidence").alias("evidence_before"))
    b = after.select("company_id", "code", F.col("status").alias("status_after"), F.col("completeness").alias("share_after"), F.col("evidence").alias("evidence_after"))
    both = a.join(b, ["company_id", "code"], "full_outer").join(manifest_changes(manifest_before, manifest_after), "company_id", "left")
    none = F.array().cast("array<string>")
    here, there = F.coalesce("evidence_after", none), F.coalesce("evidence_before", none)
    staged = both.withColumns({
        "added": F.array_sort(F.array_except(here, there)), "removed": F.array_sort(F.array_except(there, here)), "fields": F.coalesce("fields", none),
        "hash_before": F.try_element_at("requirements_before", F.col("code")), "hash_after": F.try_element_at("requirements_after", F.col("code")),
    })
    moved = ~F.col("status_before").eqNullSafe(F.col("status_after")) | (F.round(F.coalesce("share_before", F.lit(0.0)), 3) != F.round(F.coalesce("share_after", F.lit(0.0)), 3))
    other = F.size("added") + F.size("removed") > 0
    listed = F.when(F.col("hash_before").isNull(), "requirement added").when(F.col("hash_after").isNull(), "requirement removed").when(F.col("hash_before") != F.col("hash_after"), "requirement revised")
    causes = F.array_compact(F.array(listed, F.when(F.coalesce("documents_changed", F.lit(False)) & other, "documents changed"), F.when(F.size("fields") > 0, "method changed")))
    cause = F.when(F.size(causes) > 0, F.array_join(causes, "; ")).otherwise("evidence selection changed")
    return staged.filter(moved | other).select("company_id", "code", "status_before", "status_after", "added", "removed", "fields", cause.alias("cause"))


def element_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Elements whose status differs between two runs, those of one run only included."""
    keys = ["company_id", "code", "element"]
    both = before.select(*keys, F.col("status").alias("status_before")).join(after.select(*keys, F.col("status").alias("status_after")), keys, "full_outer")
    return both.filter(~F.col("status_before").eqNullSafe(F.col("status_after")))


def document_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents (company_id, lineage_id, document_id, version, sha256) added, replaced or removed between two manifests."""
    keys = ["company_id", "lineage_id"]

    def named(rows: DataFrame, end: str) -> DataFrame:
        return rows.select(*keys, *[F.col(c).alias(f"{c}_{end}") for c in ("document_id", "version", "sha256")])

    both = named(before, "before").join(named(after, "after"), keys, "full_outer")
    replaced = (F.col("sha256_before") != F.col("sha256_after")) | (F.col("document_id_before") != F.col("document_id_after"))
    change = F.when(F.col("document_id_before").isNull(), "added").when(F.col("document_id_after").isNull(), "removed").when(replaced, "replaced")
    found = both.withColumn("change", change).filter("change IS NOT NULL")
    versions = [F.when(F.col("change") == "replaced", F.col(f"version_{end}")).alias(f"{end}_version") for end in ("before", "after")]
    return found.select(*keys, "change", F.coalesce("document_id_after", "document_id_before").alias("document_id"), *versions)


def related_passages(hits: DataFrame, links: DataFrame, *, limit: int = 3) -> DataFrame:
    """The first hits (company_id, code, passage_id, rank) that are no evidence of their finding yet, in their order."""
    free = hits.join(links.select("company_id", "code", "passage_id"), ["company_id", "code", "passage_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("company_id", "code").orderBy("rank", "passage_id"))
    return free.withColumn("place", place.cast("long")).filter(F.col("place") <= limit).drop("rank")


def candidate_passages(elements: DataFrame, disagreements: DataFrame, hits: DataFrame, *, each: int = 2, limit: int = 12) -> DataFrame:
    """Passages shown to a model: two of each element, both ends of conflicts, then hits; each once, where it comes first, 12 at most."""
    own = elements.select("company_id", "code", F.posexplode(F.slice("passages", 1, each)).alias("k", "passage_id"), F.lit(1).alias("stage"), F.col("ordinal").cast("long").alias("at"), F.lit("").alias("name"))
    ends = disagreements.select("company_id", "code", F.posexplode(F.array("low_passage", "high_passage")).alias("k", "passage_id"), F.lit(2).alias("stage"), F.lit(0).cast("long").alias("at"), F.col("metric_key").alias("name"))
    more = hits.select("company_id", "code", F.lit(0).alias("k"), "passage_id", F.lit(3).alias("stage"), F.col("rank").cast("long").alias("at"), F.lit("").alias("name"))
    first = own.unionByName(ends).unionByName(more).groupBy("company_id", "code", "passage_id").agg(F.min(F.struct("stage", "at", "name", "k")).alias("first"))
    place = F.row_number().over(Window.partitionBy("company_id", "code").orderBy("first", "passage_id"))
    return first.withColumn("place", place.cast("long")).filter(F.col("place") <= limit).select("company_id", "code", "passage_id", "place")


def resolved_dependencies(actions: DataFrame) -> DataFrame:
    """Each action's dependencies `<code>:<gap>` as ids of the same company's actions, in order; unknown ones are dropped.

    `actions` has company_id, code, gap_key, action_id and depends_on.
    """
    wanted = actions.select("company_id", "action_id", F.posexplode("depends_on").alias("at", "key"))
    known = actions.select("company_id", F.concat_ws(":", "code", "gap_key").alias("key"), F.col("action_id").alias("needs"))
    found = wanted.join(known, ["company_id", "key"]).groupBy("action_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "needs"))), lambda x: x["needs"]).alias("needs"))
    return actions.select("company_id", "action_id").join(found, "action_id", "left").withColumn("needs", F.coalesce("needs", F.array().cast("array<string>")))
