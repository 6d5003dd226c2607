"""Queries over whole runs: findings with their surroundings, exports, history, filters, catalogue, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import format_value
from ..operators import assessment as A
from ..operators import disclosures as D
from ..operators import evaluation as E
from ..operators import narrative as N
from ..operators import reporting as R
from ..operators import retrieval
from ..operators import workflow as W
from ..operators.ranking import evenly_spaced
from ..sources.facts import FACTS_SQL, days_of, metric_facts, period_facts
from ..sources.scratch import materialise
from ..sources.tables import table
from .assessment_queries import _BOTH, _F, _PRIORITY, AFTER, BEFORE, Run, _companies, findings_sql
from .text_queries import LINES_SQL, POSTINGS_SQL, _passages, tokens_sql

#: code, ordinal, title, topic, summary, search terms
REQUIREMENTS = [
    ("R1", 1, "Total output", "output", "The total and its period", ["total", "version"]),
    ("R2", 2, "Energy detail", "energy", "Energy and where it comes from", ["license", "token"]),
    ("R3", 3, "Either of two", "choice", "One of two values", ["password", "secret key"]),
    ("R4", 4, "Water", "water", "Water in any unit", ["under the", "de"]),
]
SET_ID, RUN_ID = "core@2.1", "run-98"


def _requirements(spark):
    return spark.createDataFrame(REQUIREMENTS, "code string, ordinal int, title string, topic string, summary string, search_terms array<string>")


def _reviews(spark, sf_dir):
    """Turns of conversations stand for reviews of findings."""
    decision = F.when(F.col("role") == "assistant", "accept").when(F.col("role") == "system", "override").otherwise("comment")
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") % 50 + 1).alias("company_id"), F.concat(F.lit("R"), (F.col("conv_id") % 4 + 1).cast("string")).alias("code"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
        decision.alias("decision"), F.when(F.col("turn") % 2 == 0, "supported").otherwise("not_found").alias("new_status"),
    )


def _sources(spark, sf_dir, cited=None):
    """Passages of facts; the page is that of the document's line. Of those that `cited` (passage_id) names, if it is given: facts of AFTER
    have named them, and a passage's id is made of its day too, so that facts of other days, and then all that aren't cited, are left out
    before the passages are put together."""
    facts = metric_facts(spark, sf_dir)
    if cited is not None:
        facts = facts.filter(days_of(AFTER)).join(cited.select("passage_id"), "passage_id", "left_semi")
    return facts.groupBy("passage_id").agg(F.min("document_id").alias("document_id"), F.min(F.col("confidence_pct") - 80).alias("page"), F.min(F.concat_ws(" ", "metric_key", "unit")).alias("text"))


def _rows(run, sources):
    requirements = _requirements(run.spark).select("code", "ordinal", "title")
    return R.run_findings(run.findings(), requirements, _reviews(run.spark, run.sf_dir), run.links(), sources)


def _simple_rows(spark, sf_dir):
    return _rows(*_with_sources(spark, sf_dir))


def _with_sources(spark, sf_dir, *periods, more=None):
    """A run and the passages that its links and `more` (passage_id) cite, made once."""
    run = Run(spark, sf_dir, *periods)
    cited = run.links().select("passage_id")
    return run, materialise(_sources(spark, sf_dir, cited.unionByName(more) if more else cited), "run-sources")


def run_findings(spark, sf_dir):
    """JN-9, PRJ-1, WIN-3, SRT-7: findings with requirement, review state and primary evidence."""
    return _simple_rows(spark, sf_dir).select("company_id", "code", "title", "status", "effective_status", "review_state", "reviews", "n_evidence", "passage_id", "primary_role", "document_id", "page", "primary_text")


def findings_to_review(spark, sf_dir):
    """FIL-7: findings that want a review and have none, and those overridden."""
    rows = _simple_rows(spark, sf_dir)
    both = R.filtered_findings(rows, review="needed").unionByName(R.filtered_findings(rows, status="not_found", review="override"))
    return both.select("company_id", "code", "status", "review_state")


def explorer_gaps(spark, sf_dir):
    """FIL-9: findings whose effective status isn't supported and whose wording contains "en"."""
    rows = _simple_rows(spark, sf_dir).join(_requirements(spark).select("code", "topic"), "code")
    return R.explorer_filter(rows, view="gaps", text="EN").select("company_id", "code", "effective_status")


def status_shares(spark, sf_dir):
    """AGG-20: the share of each status of its organisation's findings."""
    counts = Run(spark, sf_dir).findings().join(_companies(spark, sf_dir), "company_id").groupBy("org_id", "status").agg(F.count("*").alias("n"))
    total = counts.groupBy("org_id").agg(F.sum("n").alias("total"))
    return counts.join(total, "org_id").select("org_id", "status", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def _actions(run):
    state = F.element_at(F.array(*map(F.lit, ["open", "in_progress", "done", "dismissed", "blocked"])), (F.col("company_id") % 5 + 1).cast("int"))
    joined = run.gaps().join(run.priorities().select("company_id", "code", "priority"), ["company_id", "code"])
    return joined.select("company_id", "code", "gap_key", "priority", state.alias("action_status"), F.concat_ws("/", F.col("company_id").cast("string"), "code", "gap_key").alias("created_at"))


def open_actions(spark, sf_dir):
    """FIL-8, FIL-10, SRT-6: the 100 most pressing open actions."""
    return R.filtered_actions(_actions(Run(spark, sf_dir)), "open").limit(100).drop("created_at")


def action_dependencies(spark, sf_dir):
    """JN-19: what each action waits for, of its own company."""
    actions = _actions(Run(spark, sf_dir)).select("company_id", "code", "gap_key", F.col("created_at").alias("action_id"), F.array(F.lit("R2:missing:energy"), F.lit("R4:missing:water"), F.lit("R9:none")).alias("depends_on"))
    return A.resolved_dependencies(actions).select("action_id", F.array_join("needs", ",").alias("needs"))


def csv_export_rows(spark, sf_dir):
    """SNK-3, SCL-36: the findings export with its fourteen columns."""
    run, sources = _with_sources(spark, sf_dir)
    rows = _rows(run, sources).join(run.priorities().select("company_id", "code", "priority"), ["company_id", "code"], "left").withColumn("priority", F.coalesce("priority", F.lit(0.0)))
    return R.export_rows(rows, requirement_set=SET_ID, run_id=F.lit(RUN_ID))


RUN = {"id": RUN_ID, "set": SET_ID, "period": AFTER, "mode": "rules", "title": "evidence assessment"}


def evidence_package(spark, sf_dir):
    """SNK-4, SNK-6: run, documents, findings with rationale, elements, quoted evidence and reviews, and actions as one JSON document per company."""
    documents = period_facts(spark, sf_dir, AFTER).select("company_id", "document_id")
    run, sources = _with_sources(spark, sf_dir)
    return R.evidence_package(_rows(run, sources), run.elements(), run.links(), _reviews(spark, sf_dir), sources, documents, _actions(run), run=RUN)


def markdown_report(spark, sf_dir):
    """SNK-5: a report per company: title, summary, findings with rationale and quoted passages, actions, limitations."""
    run, sources = _with_sources(spark, sf_dir)
    rows = _rows(run, sources).join(run.priorities().select("company_id", "code", "priority"), ["company_id", "code"], "left").withColumn("priority", F.coalesce("priority", F.lit(0.0)))
    return R.markdown_report(rows, run.links(), _actions(run), sources, run=RUN)


def finding_trails(spark, sf_dir):
    """JN-10: each finding's trail as JSON: elements, evidence with texts, what elements cite without a link, reviews, actions, two runs' history."""
    first = materialise(period_facts(spark, sf_dir, AFTER).groupBy("company_id").agg(F.min("passage_id").alias("first_passage")), "run-firsts")
    context = F.when((F.col("element") == "period") & F.col("first_passage").isNotNull(), F.array("first_passage")).otherwise(F.array().cast("array<string>"))
    run, sources = _with_sources(spark, sf_dir, BEFORE, AFTER, more=first.select(F.col("first_passage").alias("passage_id")))
    elements = run.elements().join(first, "company_id", "left").withColumn("context", context)
    runs = [run.findings(period).select("company_id", "code", F.lit(f"run-{period[4:]}").alias("run_id"), "status", "completeness", F.lit(period).alias("created_at")) for period in (BEFORE, AFTER)]
    return R.finding_trails(_rows(run, sources), elements, run.links(), sources, _reviews(spark, sf_dir), _actions(run), runs[0].unionByName(runs[1]))


def finding_history(spark, sf_dir):
    """JN-8, SRT-4: the last twelve runs of each company, newest first."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("run_id"), "o_orderdate", "o_orderstatus").filter("o_orderstatus <> 'P'")
    return R.last_of_each(orders, by="company_id", order=[F.desc("o_orderdate"), F.desc("run_id")], limit=12).select("company_id", "run_id", "place")


def company_metrics(spark, sf_dir):
    """JN-2, DOM-16, SRT-3: metrics of documents that nothing supersedes, with label, page, source and place in the company's list."""
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("document_id"), F.concat(F.lit("Order of "), "o_orderpriority").alias("title"))
    return R.company_metrics(metric_facts(spark, sf_dir), orders, _sources(spark, sf_dir), {"Brand#1": "First brand", "Brand#2": "Second brand"})


def passage_neighbours(spark, sf_dir):
    """JN-13, FIL-11, SRT-2: the passages before and after each passage of its document."""
    return R.neighbours(_passages(spark, sf_dir), document="doc_id", order="ordinal")


def passage_usage(spark, sf_dir):
    """JN-6, JN-7: the first twenty findings that cite each passage, and how often its document is cited."""
    links = Run(spark, sf_dir).links()
    links = links.join(_sources(spark, sf_dir, links), "passage_id")
    first = R.last_of_each(links, by="passage_id", order=[F.desc("company_id"), F.col("code")], limit=20)
    used = links.groupBy("document_id").agg(F.count("*").alias("document_links"))
    return first.join(used, "document_id").select("passage_id", "company_id", "code", "place", "document_links")


def passage_metric_keys(spark, sf_dir):
    """JN-11, JN-12: metric keys of each cited passage."""
    keys = metric_facts(spark, sf_dir).groupBy("passage_id").agg(F.array_join(F.array_sort(F.collect_set("metric_key")), ",").alias("keys"), F.count("*").alias("n"))
    return Run(spark, sf_dir).links().select("passage_id").distinct().join(keys, "passage_id", "left")


def peers_by_name(spark, sf_dir):
    """JN-1: peers of each company by name; suppliers of one nation are peers of its first."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    focal = suppliers.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("company_id"))
    bridge = suppliers.join(focal, "s_nationkey").filter("s_suppkey <> company_id").select("company_id", F.col("s_suppkey").alias("peer_id"))
    return bridge.join(suppliers, F.col("peer_id") == F.col("s_suppkey")).select("company_id", "peer_id", F.col("s_name").alias("peer"))


def job_targets(spark, sf_dir):
    """JN-21: jobs joined with what their payload names."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return events.join(customers, "k", "left").select("event_id", "event_type", "k", "c_name")


def document_changes(spark, sf_dir):
    """SET-7: documents added, replaced or removed between two manifests; years of a customer's orders stand for lineages."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id"), F.year("o_orderdate").cast("long").alias("lineage_id"), "o_orderkey", "o_orderstatus")

    def manifest(statuses):
        kept = orders.filter(F.col("o_orderstatus").isin(statuses)).groupBy("company_id", "lineage_id")
        return kept.agg(F.max("o_orderkey").alias("document_id"), F.count("*").alias("version"), F.sha2(F.max("o_orderkey").cast("string"), 256).alias("sha256"))

    return A.document_changes(manifest(["F", "O"]), manifest(["F", "P"]))


def element_changes(spark, sf_dir):
    """SET-3: elements whose status differs between two runs."""
    run = Run(spark, sf_dir, BEFORE, AFTER)
    return A.element_changes(run.elements(BEFORE), run.elements(AFTER))


def merged_findings(spark, sf_dir):
    """DOM-11: findings after verdicts are merged, with status, confidence and reasons made anew."""
    run = Run(spark, sf_dir)
    elements = run.elements()
    way = (F.col("company_id") + F.length("element")) % 4
    verdicts = elements.select("company_id", "code", "element", F.when(way == 0, "yes").when(way == 1, "no").when(way == 2, "unclear").alias("verdict"), (F.col("company_id") % 3 != 0).alias("valid"), (F.col("company_id") % 2 == 0).alias("confident"))
    found = run.findings()
    id_ = F.col("company_id")
    said = F.element_at(F.array(*map(F.lit, ["supported", "partially_supported", "not_found", "conflicting"])), (id_ % 4 + 1).cast("int"))
    models = found.filter(id_ % 7 != 0).select("company_id", "code", said.alias("model_status"), ((id_ % 10) / 10).alias("model_confidence"), (id_ % 3 == 0).alias("wants_review"), (id_ % 2).alias("n_evidence"))
    return A.merged_findings(found, A.merge_verdicts(elements, verdicts), models)


def _hits(spark, sf_dir):
    """Facts of a company stand for search hits of its requirements, the surest first."""
    facts = period_facts(spark, sf_dir, AFTER).filter(F.col("metric_key") == "Brand#1").select("company_id", "passage_id", "confidence_pct")
    ranked = R.last_of_each(facts.withColumn("code", F.lit("R1")), by="company_id", order=[F.desc("confidence_pct"), F.col("passage_id")], limit=8)
    return ranked.select("company_id", "code", "passage_id", F.col("place").alias("rank"))


def related_evidence(spark, sf_dir):
    """SET-6: the first three hits that are no evidence yet."""
    return A.related_passages(_hits(spark, sf_dir), Run(spark, sf_dir).links())


def finding_evidence(spark, sf_dir):
    """WIN-7: supporting and conflicting passages of each finding, then related ones."""
    links = Run(spark, sf_dir).links()
    return A.with_related(links, A.related_passages(_hits(spark, sf_dir), links))


def candidate_passages(spark, sf_dir):
    """SRT-12: passages shown to a model, each once, twelve at most."""
    run = Run(spark, sf_dir)
    return A.candidate_passages(run.elements(), run.conflicts(), _hits(spark, sf_dir))


def _differences(run):
    """Conflicts of a run with both values: the requirement's keys on which sources disagree."""
    found = D.conflicts(run.facts.filter(F.col("period_label") == AFTER), by=["company_id", "metric_key"])
    return run.conflicts().join(found.select("company_id", "metric_key", "low_value", "high_value", "spread", F.col("normalized_unit").alias("unit")), ["company_id", "metric_key"])


def _labelled(run):
    return run.elements().withColumn("label", F.concat(F.initcap("element"), F.lit(" of "), F.col("code")))


def finding_rationales(spark, sf_dir):
    """SCL-36: each finding in words: values that differ, what is evidenced, missing, weak or not applicable."""
    run = Run(spark, sf_dir)
    related = A.related_passages(_hits(spark, sf_dir), run.links())
    return N.rationales(run.findings(), _labelled(run), _differences(run), related)


def model_prompts(spark, sf_dir):
    """DOM-9: the prompt of each finding, with twelve passages at most."""
    run = Run(spark, sf_dir)
    candidates = materialise(A.candidate_passages(run.elements(), run.conflicts(), _hits(spark, sf_dir)), "run-candidates")
    return N.prompts(_requirements(spark), _labelled(run), _differences(run), candidates, _sources(spark, sf_dir, candidates), AFTER)


def company_coverage(spark, sf_dir):
    """AGG-12, AGG-13, DOM-17, FIL-2: what the ready and other documents of each company cover."""
    facts = metric_facts(spark, sf_dir).select("company_id", "document_id", (F.col("confidence_pct") - 80).alias("page"), (F.col("confidence_pct") < 90).alias("scanned"), "period_label")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("processing").alias("status"), F.col("o_orderpriority").alias("type"))
    found = R.coverage_blocks(facts, orders)
    return found.select("company_id", "documents", "ready", "pages", "scanned_pages", "metrics", F.array_join("periods", ",").alias("periods"), F.array_join("types", ",").alias("types"))


def unresolved_findings(spark, sf_dir):
    """FIL-14: findings that want a human, with three reasons at most: keys on which sources differ, elements that are missing or doubtful."""
    run = Run(spark, sf_dir)
    elements = run.elements()
    reasons = run.conflicts().select("company_id", "code", F.concat(F.lit("sources differ on "), "metric_key").alias("reason"))
    reasons = reasons.unionByName(elements.filter("status = 'missing'").select("company_id", "code", F.concat(F.lit("no evidence for "), "element").alias("reason")))
    reasons = reasons.unionByName(elements.filter("doubtful").select("company_id", "code", F.concat(F.lit("only doubtful text for "), "element").alias("reason")))
    return R.unresolved(run.findings(), reasons).select("company_id", "code", "status", F.array_join("reasons", "; ").alias("reasons"))


def action_views(spark, sf_dir):
    """FIL-10: how many actions each view of a company shows."""
    return R.action_views(_actions(Run(spark, sf_dir)))


def requirement_search(spark, sf_dir):
    """DOM-2: the eight best passages for each requirement's wording."""
    return retrieval.bm25(_passages(spark, sf_dir), retrieval.requirement_queries(_requirements(spark).withColumn("metric_keys", F.array().cast("array<string>"))))


def catalogue_status(spark, sf_dir):
    """FIL-12, SRT-11, AGG-1: parts' sizes stand for versions of catalogues: status on a day, order, requirements per set."""
    part = table(spark, sf_dir, "part").select("p_brand", "p_size", "p_retailprice")
    sets = part.groupBy("p_brand", "p_size").agg(F.count("*").alias("requirements"))
    start, end = F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size") * 20), F.when(F.col("p_size") % 3 == 0, F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size") * 20 + 100))
    staged = sets.select("p_brand", "requirements", F.concat_ws(".", (F.col("p_size") / 10).cast("int").cast("string"), (F.col("p_size") % 10).cast("string")).alias("version"), R.set_status(F.lit("2024-12-31").cast("date"), start, end).alias("status"))
    order = F.struct(F.when(F.col("status") == "in_force", 0).when(F.col("status") == "upcoming", 1).otherwise(2), F.transform(R.version_key(F.col("version")), lambda x: -x))
    return R.last_of_each(staged.withColumn("o", order), by="p_brand", order=[F.col("o")], limit=3).drop("o")


def catalogue_load(spark, sf_dir):
    """SRC-8: what loading each part's description does to catalogues known by an older one."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("set_id"), F.concat_ws("|", "p_name", "p_brand", "p_type").alias("body"), "p_partkey")
    known = part.filter("p_partkey % 3 <> 0").select("set_id", F.sha2(F.when(F.col("p_partkey") % 3 == 1, F.col("body")).otherwise("older"), 256).alias("content_hash"))
    used = part.filter("p_partkey % 2 = 0").select("set_id")
    return R.load_catalogue(part, known, used)


def run_manifest(spark, sf_dir):
    """PRJ-4: what each run was given: its documents in order and a hash of its requirements."""
    facts = period_facts(spark, sf_dir, AFTER).select("company_id", "document_id").distinct()
    codes = F.sha2(F.lit("|".join(f"{r[0]}:{r[2]}" for r in REQUIREMENTS)), 256)
    listed = facts.groupBy("company_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("document_id")), lambda d: d.cast("string")), ",").alias("documents"), F.count("*").alias("n"))
    return listed.select("company_id", "documents", "n", codes.alias("requirements_hash"))


def first_boundary(spark, sf_dir):
    """AGG-28: the first passage of each document that matches both of two patterns."""
    hits = _passages(spark, sf_dir).filter(F.col("line").rlike("(?i)the") & F.col("line").rlike("(?i)license|token|under"))
    return hits.groupBy("doc_id").agg(F.min_by("passage_id", "ordinal").alias("passage_id"), F.min("ordinal").alias("ordinal"))


def _evaluated(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.floor("o_totalprice").alias("value"))
    return E.run_cases(E.generated_cases(orders))


def evaluation_cases(spark, sf_dir):
    """DOM-21, DOM-22: a generated case for each order, assessed all at once: gold and predicted status, conflict, value and citations."""
    found = _evaluated(spark, sf_dir)
    return found.select("case_id", "gold", "predicted", "gold_conflict", "predicted_conflict", "value_found", "citations", "cost")


def evaluation_summary(spark, sf_dir):
    """AGG-21, AGG-22, SET-5: the figures of that run."""
    return E.summary(_evaluated(spark, sf_dir))


def evaluation_report(spark, sf_dir):
    """SNK-8: the figures as a report."""
    return E.report(evaluation_summary(spark, sf_dir).withColumn("mode", F.lit("rules")))


def sampled_cases(spark, sf_dir):
    """WIN-13: a hundred order lines at equal distances in the order of their price."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return evenly_spaced(lines, 100, F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"))


def call_statistics(spark, sf_dir):
    """AGG-11: calls, cached answers, tokens and failures of each account; events stand for calls."""
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id").agg(
        F.count("*").alias("calls"), F.count_if(F.col("event_type") == "view").alias("cached"), F.sum(F.when(F.col("event_type") != "view", F.floor("value"))).alias("tokens"), F.count_if(F.col("event_type") == "error").alias("failures"),
    )


def dashboard_counts(spark, sf_dir):
    """AGG-18, JN-4, SRT-10: companies, findings, open gaps and reviews of each organisation, and its first three companies."""
    companies = _companies(spark, sf_dir)
    found = Run(spark, sf_dir).findings().join(companies, "company_id")
    counts = found.groupBy("org_id").agg(F.countDistinct("company_id").alias("companies"), F.count("*").alias("findings"), F.count_if(F.col("status") != "supported").alias("gaps"), F.count_if("requires_review").alias("reviews"))
    first = R.last_of_each(companies, by="org_id", order=[F.col("company_id")], limit=3).groupBy("org_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("company_id")), lambda c: c.cast("string")), ",").alias("first_companies"))
    return counts.join(first, "org_id")


def display_formats(spark, sf_dir):
    """SCL-28, SCL-33, SCL-35: values, slugs, file names, changes and sizes as they are shown."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_retailprice", "p_size")
    return part.select(
        "p_partkey", R.slug(F.concat_ws("  ", "p_name", "p_type")).alias("slug"), R.safe_file_name(F.concat(F.lit("C:\\tmp/"), "p_name", F.lit("*?.pdf"))).alias("file"),
        format_value(F.round(F.col("p_retailprice"), 0)).alias("value"), R.signed_percent((F.col("p_size") - 25) / 40).alias("change"), R.byte_size(F.col("p_partkey") * F.col("p_partkey")).alias("bytes"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        run_findings, findings_to_review, explorer_gaps, status_shares, open_actions, action_dependencies, csv_export_rows, evidence_package, markdown_report, finding_trails, finding_history, company_metrics, passage_neighbours,
        passage_usage, passage_metric_keys, peers_by_name, job_targets, document_changes, element_changes, merged_findings, related_evidence, finding_evidence, candidate_passages, finding_rationales, model_prompts, company_coverage, unresolved_findings, action_views, requirement_search, catalogue_status, catalogue_load,
        run_manifest, first_boundary, evaluation_cases, evaluation_summary, evaluation_report, sampled_cases, call_statistics, dashboard_counts, display_formats,
    )
}

_VALUES = ", ".join(f"('{c}', {o}, '{t}', '{topic}')" for c, o, t, topic, *_ in REQUIREMENTS)
_LABEL = "CASE {0} WHEN 'supported' THEN 'Supported' WHEN 'partially_supported' THEN 'Partially supported' WHEN 'not_found' THEN 'Not found' WHEN 'conflicting' THEN 'Conflicting' WHEN 'human_review' THEN 'Needs review' ELSE {0} END"
_LINKS_SQL = """support AS (SELECT company_id, code, ordinal, element, unnest(passages) AS passage_id, generate_subscripts(passages, 1) AS pos FROM elements WHERE status = 'satisfied'),
firsts AS (SELECT company_id, code, passage_id, min(ordinal * 100 + pos) AS seen, string_agg(element, ',' ORDER BY ordinal) AS names FROM support GROUP BY ALL),
ends AS (SELECT DISTINCT company_id, code, unnest([low_passage, high_passage]) AS passage_id FROM conflicts),
links AS (SELECT coalesce(f.company_id, e.company_id) AS company_id, coalesce(f.code, e.code) AS code, coalesce(f.passage_id, e.passage_id) AS passage_id, CASE WHEN e.passage_id IS NOT NULL THEN 'conflicting' ELSE 'supporting' END AS role, coalesce(names, '') AS names,
  row_number() OVER (PARTITION BY coalesce(f.company_id, e.company_id), coalesce(f.code, e.code) ORDER BY seen IS NULL, seen, coalesce(f.passage_id, e.passage_id)) AS rank
  FROM firsts f FULL OUTER JOIN ends e ON e.company_id = f.company_id AND e.code = f.code AND e.passage_id = f.passage_id),
sources AS (SELECT passage_id, min(document_id) AS document_id, min(confidence_pct - 80) AS page, min(metric_key || ' ' || unit) AS text FROM facts GROUP BY passage_id)"""
_ROWS_SQL = f"""{_F}, {_LINKS_SQL}, {_PRIORITY}, requirements(code, ordinal, title, topic) AS (VALUES {_VALUES}),
reviews AS (SELECT conv_id % 50 + 1 AS company_id, 'R' || (conv_id % 4 + 1) AS code, conv_id * 1000 + turn AS seq, CASE role WHEN 'assistant' THEN 'accept' WHEN 'system' THEN 'override' ELSE 'comment' END AS decision,
  CASE WHEN turn % 2 = 0 THEN 'supported' ELSE 'not_found' END AS new_status FROM conversations),
states AS (SELECT company_id, code, count(*) AS n, arg_max(decision, seq) FILTER (decision <> 'comment') AS d, arg_max(new_status, seq) FILTER (decision <> 'comment') AS s FROM reviews GROUP BY ALL),
rows_ AS (SELECT f.company_id, f.code, q.ordinal, title, topic, status, coalesce(CASE WHEN d = 'override' THEN s END, status) AS effective_status, coalesce(d, 'unreviewed') AS review_state, coalesce(t.n, 0) AS reviews, completeness, confidence, requires_review, missing,
  (SELECT count(*) FROM links l WHERE l.company_id = f.company_id AND l.code = f.code) AS n_evidence, l.passage_id, l.role AS primary_role, document_id, page, substr(text, 1, 240) AS primary_text
  FROM findings f JOIN requirements q ON q.code = f.code LEFT JOIN states t ON t.company_id = f.company_id AND t.code = f.code LEFT JOIN links l ON l.company_id = f.company_id AND l.code = f.code AND l.rank = 1 LEFT JOIN sources USING (passage_id)),
actions AS (SELECT g.company_id, g.code, gap_key, priority, ['open', 'in_progress', 'done', 'dismissed', 'blocked'][g.company_id % 5 + 1] AS action_status, g.company_id || '/' || g.code || '/' || gap_key AS created_at FROM all_gaps g JOIN priorities p ON p.company_id = g.company_id AND p.code = g.code),
hits AS (SELECT company_id, 'R1' AS code, passage_id, row_number() OVER (PARTITION BY company_id ORDER BY confidence_pct DESC, passage_id) AS rank FROM facts WHERE period_label = '{AFTER}' AND metric_key = 'Brand#1' QUALIFY rank <= 8)"""
_FIXED2 = "({0}::DECIMAL(18, 6))::DECIMAL(18, {1})::VARCHAR"
_MERGED = f"""{_F}, v AS (
  SELECT *, CASE (company_id + length(element)) % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'unclear' ELSE 'none' END AS said, company_id % 3 <> 0 AS valid, company_id % 2 = 0 AS confident, kind IN ('metric', 'metric_period') AS structured FROM elements
), w AS (SELECT *, status = 'satisfied' AND said = 'no' AND NOT structured AS down, status = 'missing' AND said = 'yes' AND valid AS up FROM v),
m AS (SELECT company_id, code, weight, CASE WHEN status = 'not_applicable' THEN status WHEN down THEN 'missing' WHEN up THEN 'satisfied' ELSE status END AS st,
  CASE WHEN status = 'not_applicable' OR said = 'none' THEN NULL WHEN status = 'satisfied' AND said = 'no' AND structured THEN 'model disagrees with a structured element' WHEN up AND structured THEN 'model adds a structured element'
    WHEN status = 'missing' AND said = 'yes' AND NOT valid THEN 'citation not valid' WHEN said = 'unclear' AND NOT (structured AND confident) THEN 'model is unclear' END AS reason FROM w),
p AS (SELECT company_id, code, CASE WHEN sum(CASE WHEN st <> 'not_applicable' THEN weight ELSE 0e0 END) > 0 THEN round(sum(CASE WHEN st = 'satisfied' THEN weight ELSE 0e0 END) / sum(CASE WHEN st <> 'not_applicable' THEN weight ELSE 0e0 END), 4) ELSE 0e0 END AS c,
  coalesce(list_sort(list(DISTINCT reason) FILTER (reason IS NOT NULL)), []) AS reasons FROM m GROUP BY ALL),
j AS (SELECT p.*, f.status = 'conflicting' AS conflicting, f.confidence AS rc, f.requires_review AS had, CASE WHEN p.company_id % 7 <> 0 THEN ['supported', 'partially_supported', 'not_found', 'conflicting'][p.company_id % 4 + 1] END AS ms, (p.company_id % 10) / 1e1 AS mc,
  p.company_id % 7 <> 0 AND p.company_id % 3 = 0 AS wr, p.company_id % 2 AS ne FROM p JOIN findings f ON f.company_id = p.company_id AND f.code = p.code),
s0 AS (SELECT *, CASE WHEN conflicting THEN 'conflicting' WHEN c >= 0.9999 THEN 'supported' WHEN c > 0 THEN 'partially_supported' ELSE 'not_found' END AS a FROM j),
s1 AS (SELECT *, CASE WHEN a = 'not_found' AND ms = 'partially_supported' AND ne > 0 THEN 'partially_supported' ELSE a END AS b FROM s0),
s2 AS (SELECT *, coalesce(abs(CASE ms WHEN 'not_found' THEN 0 WHEN 'partially_supported' THEN 1 WHEN 'supported' THEN 2 END - CASE b WHEN 'not_found' THEN 0 WHEN 'partially_supported' THEN 1 WHEN 'supported' THEN 2 END) = 2, false) AS far FROM s1),
s3 AS (SELECT *, CASE WHEN far THEN 'human_review' ELSE b END AS d FROM s2),
s4 AS (SELECT *, wr AND mc < 5e-1 AND d <> 'conflicting' AS unsure, coalesce(ms = 'conflicting', false) AND d <> 'conflicting' AS doubted FROM s3),
s5 AS (SELECT *, CASE WHEN unsure THEN 'human_review' ELSE d END AS status, list_concat(reasons, [x for x in [CASE WHEN far THEN 'views differ by two ranks' END, CASE WHEN doubted THEN 'contradiction not confirmed by values' END, CASE WHEN unsure THEN 'model could not resolve it' END] if x IS NOT NULL]) AS rs FROM s4)
SELECT company_id, code, c AS completeness, status, CASE WHEN ms IS NULL THEN rc ELSE round(round(least(95e-2, (rc + mc) / 2 * CASE WHEN ms = status THEN 1e0 ELSE 85e-2 END), 6)::DECIMAL(18, 6), 2)::DOUBLE END AS confidence,
  had OR len(rs) > 0 OR status IN ('conflicting', 'human_review') AS requires_review, array_to_string(rs, '; ') AS reasons FROM s5"""
_EVIDENCE_SQL = """ev AS (SELECT company_id, code, list({'rank': rank, 'role': role, 'element_keys': names, 'passage_id': passage_id, 'document_id': document_id, 'page': page, 'text': text} ORDER BY rank) AS evidence
  FROM links JOIN sources USING (passage_id) GROUP BY ALL)"""
_TOLD = f"""{_LABEL.format('status')} || ': ' || round(completeness * 100)::BIGINT || ' % of the applicable elements are established by ' || n_evidence || CASE WHEN n_evidence = 1 THEN ' passage.' ELSE ' passages.' END
  || CASE WHEN missing <> '' THEN ' Missing: ' || missing || '.' ELSE '' END"""
_FULL_SQL = "upper(element[1]) || element[2:] || ' of ' || code"
_NAME_SQL = "element || ' of ' || code"
_SHOWN_SQL = "format('{{:,}}', round({0})::BIGINT)"
_DIFFER_SQL = f"""differ AS (SELECT c.*, lo, hi FROM conflicts c JOIN (SELECT company_id, metric_key, min(normalized_value) AS lo, max(normalized_value) AS hi FROM facts WHERE period_label = '{AFTER}' AND NOT base_year GROUP BY ALL) USING (company_id, metric_key))"""


def _draw(name):
    return f"('0x' || substr(md5('{E.SEED}:' || o_orderkey || ':{name}'), 1, 8))::BIGINT / 4294967296e0"


_KIND = "CASE WHEN {0} < 5e-1 THEN 'standard' WHEN {0} < 65e-2 THEN 'paraphrase' WHEN {0} < 85e-2 THEN 'absent' ELSE 'trap' END"
#: Cases as they are generated, and what the rules make of each wording: they miss paraphrases and take one trap for a boundary.
_CASES_SQL = f"""WITH k AS (
  SELECT o_orderkey AS case_id, floor(o_totalprice)::BIGINT AS v, {", ".join(f"{_KIND.format(_draw(e))} AS k_{e}" for e in E.WORDING)}, {_draw("conflict")} < 2e-1 AS c FROM orders
), t AS (
  SELECT case_id, k_value, k_boundary, k_method, k_value = 'standard' AND c AS conflict, k_value IN ('standard', 'paraphrase') AS v1, k_boundary IN ('standard', 'paraphrase') AS b1, k_method IN ('standard', 'paraphrase') AS m1,
    k_value = 'standard' AS v2, k_boundary IN ('standard', 'trap') AS b2, k_method = 'standard' AS m2,
    [x for x in [{", ".join("CASE k_{0} {1} END".format(e, " ".join(f"WHEN '{kind}' THEN replace('{w}', '{{v}}', format('{{:,}}', v))" for kind, w in ways.items())) for e, ways in E.WORDING.items())},
      CASE WHEN k_value = 'standard' AND c THEN replace('{E.CONFLICT}', '{{w}}', format('{{:,}}', v + v // 20)) END] if x IS NOT NULL] AS parts FROM k
), r AS (
  SELECT *, CASE WHEN v1 THEN v2 END AS value_found, ((v2)::INT + (b2)::INT + (m2)::INT + (conflict)::INT)::INT AS citations, length(array_to_string(parts, ' '))::INT AS cost,
    CASE WHEN conflict THEN 'conflicting' WHEN v1 AND b1 AND m1 THEN 'supported' WHEN v1 OR b1 OR m1 THEN 'partially_supported' ELSE 'not_found' END AS gold,
    CASE WHEN conflict THEN 'conflicting' WHEN v2 AND b2 AND m2 THEN 'supported' WHEN v2 OR b2 OR m2 THEN 'partially_supported' ELSE 'not_found' END AS predicted FROM t)"""
_SUMMARY_SQL = """SELECT count(*) AS cases, round(avg((gold = predicted)::INT), 6) AS status_accuracy,
  round(count(*) FILTER (gold <> 'supported' AND predicted <> 'supported') / count(*) FILTER (predicted <> 'supported')::DOUBLE, 6) AS gap_precision, round(count(*) FILTER (gold <> 'supported' AND predicted <> 'supported') / count(*) FILTER (gold <> 'supported')::DOUBLE, 6) AS gap_recall,
  round(sum(2 * (v1 AND v2)::INT + (b1 AND b2)::INT + (m1 AND m2)::INT) / sum(2 * v2::INT + b2::INT + m2::INT)::DOUBLE, 6) AS element_precision,
  round(sum(2 * (v1 AND v2)::INT + (b1 AND b2)::INT + (m1 AND m2)::INT) / sum(2 * v1::INT + b1::INT + m1::INT)::DOUBLE, 6) AS element_recall,
  1e0 AS conflict_precision, 1e0 AS conflict_recall, round(avg(value_found::INT), 6) AS numeric_accuracy, count(value_found) AS numeric_cases, 1e0 AS citation_validity, sum(citations)::BIGINT AS citations,
  round(avg(conflict::INT), 6) AS review_rate, median(cost::DOUBLE) AS median_cost FROM r"""
_HASH = "|".join(f"{r[0]}:{r[2]}" for r in REQUIREMENTS)
_SEARCH = ", ".join("('{0}', '{1}', [{2}], [{3}])".format(c, " ".join([t, s, *terms]), ", ".join(f"'{x}'" for x in terms), ", ".join(f"'{x}'" for x in [topic, *terms[:3]])) for c, _, t, topic, s, terms in REQUIREMENTS)

ORACLES = {
    "run_findings": f"{_ROWS_SQL} SELECT company_id, code, title, status, effective_status, review_state, reviews, n_evidence, passage_id, primary_role, document_id, page, primary_text FROM rows_",
    "findings_to_review": f"{_ROWS_SQL} SELECT company_id, code, status, review_state FROM rows_ WHERE requires_review AND review_state = 'unreviewed' UNION ALL SELECT company_id, code, status, review_state FROM rows_ WHERE status = 'not_found' AND review_state = 'override'",
    "explorer_gaps": f"{_ROWS_SQL} SELECT company_id, code, effective_status FROM rows_ WHERE effective_status <> 'supported' AND contains(lower(concat_ws(' ', code, title, topic)), 'en')",
    "status_shares": f"{_F} , c AS (SELECT s_nationkey::BIGINT AS org_id, status, count(*) AS n FROM findings JOIN supplier ON s_suppkey = company_id GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY org_id), 6) AS share FROM c",
    "open_actions": f"{_ROWS_SQL} SELECT company_id, code, gap_key, priority, action_status FROM actions WHERE action_status IN ('open', 'in_progress', 'blocked') ORDER BY priority DESC, created_at LIMIT 100",
    "action_dependencies": f"{_ROWS_SQL} SELECT a.created_at AS action_id, coalesce(string_agg(b.created_at, ',' ORDER BY b.code), '') AS needs FROM actions a LEFT JOIN actions b ON b.company_id = a.company_id AND b.code || ':' || b.gap_key IN ('R2:missing:energy', 'R4:missing:water') GROUP BY ALL",
    "csv_export_rows": f"""{_ROWS_SQL} SELECT company_id::VARCHAR AS company, code AS requirement, title, {_LABEL.format('status')} AS status, {_LABEL.format('effective_status')} AS effective_status, review_state, {_FIXED2.format('completeness', 2)} AS completeness,
  {_FIXED2.format('confidence', 2)} AS confidence, {_FIXED2.format('coalesce(priority, 0)', 3)} AS priority, missing AS missing_elements, CASE WHEN document_id IS NOT NULL THEN 'Document ' || document_id || ' p.' || page ELSE '' END AS primary_source,
  {_LABEL.format('status')} || ': ' || round(completeness * 100)::BIGINT || ' % of the applicable elements are established by ' || n_evidence || CASE WHEN n_evidence = 1 THEN ' passage.' ELSE ' passages.' END || CASE WHEN missing <> '' THEN ' Missing: ' || missing || '.' ELSE '' END AS rationale,
  'rules' AS method, '{SET_ID}' AS requirement_set, '{RUN_ID}' AS run_id FROM rows_ LEFT JOIN (SELECT company_id, code, priority FROM priorities) USING (company_id, code)""",
    "evidence_package": f"""{_ROWS_SQL}, {_EVIDENCE_SQL}, own AS (SELECT company_id, code, list({{'ordinal': ordinal, 'element': element, 'status': status, 'weak': weak}} ORDER BY ordinal) AS els FROM elements GROUP BY ALL),
said AS (SELECT company_id, code, list({{'seq': seq, 'decision': decision}} ORDER BY seq, decision) AS revs FROM reviews GROUP BY ALL),
f AS (SELECT r.company_id, list({{'ordinal': r.ordinal, 'code': r.code, 'title': title, 'status': r.status, 'effective_status': effective_status, 'review_state': review_state, 'completeness': completeness, 'confidence': confidence, 'missing': missing,
  'rationale': {_TOLD}, 'elements': coalesce(els, []), 'evidence': coalesce(evidence, []), 'reviews': coalesce(revs, [])}} ORDER BY r.ordinal) AS findings
  FROM rows_ r LEFT JOIN own USING (company_id, code) LEFT JOIN ev USING (company_id, code) LEFT JOIN said USING (company_id, code) GROUP BY r.company_id),
docs AS (SELECT company_id, list_sort(list(DISTINCT document_id)) AS documents FROM facts WHERE period_label = '{AFTER}' GROUP BY company_id),
todo AS (SELECT company_id, list({{'code': code, 'gap_key': gap_key, 'action_status': action_status, 'priority': priority}} ORDER BY priority DESC, code, gap_key) AS actions FROM actions GROUP BY company_id)
SELECT company_id, len(findings)::BIGINT AS n_findings, to_json({{'company_id': company_id, 'run': {RUN}, 'documents': coalesce(documents, []), 'findings': findings, 'actions': coalesce(todo.actions, []), 'limitations': {R.LIMITATIONS}}})::VARCHAR AS package
FROM f LEFT JOIN docs USING (company_id) LEFT JOIN todo USING (company_id)""",
    "markdown_report": f"""{_ROWS_SQL}, cited AS (SELECT company_id, code, string_agg('- *' || role || '* — ' || document_id || ', p.' || page || ': “' || substr(text, 1, 220) || '”', chr(10) ORDER BY rank) AS cited
  FROM (SELECT *, row_number() OVER (PARTITION BY company_id, code ORDER BY rank) AS k FROM links JOIN sources USING (passage_id)) WHERE k <= 4 GROUP BY ALL),
f AS (SELECT company_id, ordinal, '| ' || code || ' ' || title || ' | ' || {_LABEL.format('status')} || ' | ' || round(completeness * 100)::BIGINT || '% | ' || {_FIXED2.format('coalesce(priority, 0)', 2)} || ' |' AS line,
  '### ' || code || ' — ' || title || chr(10) || chr(10) || '**' || {_LABEL.format('status')} || '** · completeness ' || round(completeness * 100)::BIGINT || '% · confidence ' || {_FIXED2.format('confidence', 2)} || chr(10) || chr(10) || {_TOLD} || chr(10) || chr(10)
    || coalesce(cited, '') || CASE WHEN missing <> '' THEN chr(10) || chr(10) || 'Missing: ' || missing ELSE '' END || chr(10) AS section
  FROM rows_ LEFT JOIN cited USING (company_id, code) LEFT JOIN (SELECT company_id, code, priority FROM priorities) USING (company_id, code)),
a AS (SELECT company_id, string_agg('1. **' || gap_key || '** (' || code || ', priority ' || {_FIXED2.format('priority', 2)} || ', ' || action_status || ')', chr(10) ORDER BY priority DESC, code, gap_key) AS todo FROM actions GROUP BY company_id)
SELECT company_id, concat_ws(chr(10), '# Company ' || company_id || ' — {RUN['title']}' || chr(10) || chr(10) || '*{SET_ID}* · period {AFTER} · run `{RUN_ID}` (rules)' || chr(10), '## Summary' || chr(10), '| Requirement | Status | Completeness | Priority |', '|---|---|---|---|',
  string_agg(line, chr(10) ORDER BY ordinal), chr(10) || '## Findings' || chr(10), string_agg(section, chr(10) ORDER BY ordinal),
  CASE WHEN any_value(todo) IS NOT NULL THEN '## Recommended actions' || chr(10) END, any_value(todo) || chr(10), '## Limitations' || chr(10), {", ".join(f"'- {x}'" for x in R.LIMITATIONS)}) AS report FROM f LEFT JOIN a USING (company_id) GROUP BY company_id""",
    "finding_trails": f"""{_ROWS_SQL}, {findings_sql(BEFORE, '_b')}, {_EVIDENCE_SQL}, firsts_ AS (SELECT company_id, min(passage_id) AS first_passage FROM facts WHERE period_label = '{AFTER}' GROUP BY company_id),
els AS (SELECT e.*, CASE WHEN element = 'period' AND first_passage IS NOT NULL THEN [first_passage] ELSE [] END AS context FROM elements e LEFT JOIN firsts_ USING (company_id)),
own AS (SELECT company_id, code, list({{'ordinal': ordinal, 'element': element, 'status': status, 'weak': weak, 'passage_ids': passages}} ORDER BY ordinal) AS els FROM els GROUP BY ALL),
more AS (SELECT DISTINCT company_id, code, unnest(list_concat(passages, context)) AS passage_id FROM els),
also AS (SELECT company_id, code, list({{'passage_id': passage_id, 'document_id': document_id, 'page': page, 'text': text}} ORDER BY passage_id) AS also_cited
  FROM more m JOIN sources USING (passage_id) WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.company_id = m.company_id AND l.code = m.code AND l.passage_id = m.passage_id) GROUP BY ALL),
said AS (SELECT company_id, code, list({{'seq': seq, 'decision': decision, 'new_status': new_status}} ORDER BY seq, decision) AS revs FROM reviews GROUP BY ALL),
todo AS (SELECT company_id, code, list({{'gap_key': gap_key, 'status': action_status, 'priority': priority}} ORDER BY priority DESC, gap_key) AS acts FROM actions GROUP BY ALL),
hist AS (SELECT company_id, code, [{{'run_id': 'run-{AFTER[4:]}', 'status': a.status, 'completeness': a.completeness}}, {{'run_id': 'run-{BEFORE[4:]}', 'status': b.status, 'completeness': b.completeness}}] AS history FROM findings a JOIN findings_b b USING (company_id, code))
SELECT r.company_id, r.code, to_json({{'finding': {{'code': r.code, 'title': title, 'status': r.status, 'effective_status': effective_status, 'review_state': review_state, 'completeness': r.completeness, 'confidence': r.confidence, 'missing': r.missing, 'n_evidence': n_evidence}},
  'elements': coalesce(els, []), 'evidence': coalesce(evidence, []), 'also_cited': coalesce(also_cited, []), 'reviews': coalesce(revs, []), 'actions': coalesce(acts, []), 'history': history}})::VARCHAR AS trail
FROM rows_ r LEFT JOIN own USING (company_id, code) LEFT JOIN ev USING (company_id, code) LEFT JOIN also USING (company_id, code) LEFT JOIN said USING (company_id, code) LEFT JOIN todo USING (company_id, code) LEFT JOIN hist USING (company_id, code)""",
    "finding_history": "SELECT o_custkey AS company_id, o_orderkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders WHERE o_orderstatus <> 'P' QUALIFY place <= 12",
    "company_metrics": f"""WITH {FACTS_SQL}, sources AS (SELECT passage_id, min(confidence_pct - 80) AS page FROM facts GROUP BY passage_id)
SELECT company_id, row_number() OVER (PARTITION BY company_id ORDER BY metric_key, period_end, confidence_pct DESC, passage_id) AS place, metric_key,
  CASE metric_key WHEN 'Brand#1' THEN 'First brand' WHEN 'Brand#2' THEN 'Second brand' ELSE metric_key END AS label, normalized_value, normalized_unit, period_label, confidence_pct, method, passage_id, page,
  'Order of ' || o_orderpriority || ', p.' || page AS source FROM facts JOIN orders ON o_orderkey = document_id JOIN sources USING (passage_id) WHERE o_orderstatus = 'F'""",
    "passage_neighbours": f"WITH {LINES_SQL} SELECT doc_id, ordinal, passage_id, lag(passage_id) OVER w AS before, lead(passage_id) OVER w AS after FROM passages WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)",
    "passage_usage": f"""{_ROWS_SQL}, c AS (SELECT l.*, s.document_id FROM links l JOIN sources s USING (passage_id)) SELECT passage_id, company_id, code, row_number() OVER (PARTITION BY passage_id ORDER BY company_id DESC, code) AS place,
  count(*) OVER (PARTITION BY document_id) AS document_links FROM c QUALIFY place <= 20""",
    "passage_metric_keys": f"{_ROWS_SQL} SELECT passage_id, string_agg(DISTINCT metric_key, ',' ORDER BY metric_key) AS keys, count(*) AS n FROM facts WHERE passage_id IN (SELECT passage_id FROM links) GROUP BY passage_id",
    "peers_by_name": "WITH f AS (SELECT s_nationkey, min(s_suppkey) AS company_id FROM supplier GROUP BY s_nationkey) SELECT company_id, s_suppkey AS peer_id, s_name AS peer FROM supplier JOIN f USING (s_nationkey) WHERE s_suppkey <> company_id",
    "job_targets": "SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k, c_name FROM events LEFT JOIN customer ON c_custkey = json_extract_string(props, '$.k')::BIGINT",
    "document_changes": """WITH o AS (SELECT o_custkey AS company_id, year(o_orderdate)::BIGINT AS lineage_id, o_orderkey, o_orderstatus AS s FROM orders),
b AS (SELECT company_id, lineage_id, max(o_orderkey) AS d, count(*) AS v FROM o WHERE s IN ('F', 'O') GROUP BY ALL), a AS (SELECT company_id, lineage_id, max(o_orderkey) AS d, count(*) AS v FROM o WHERE s IN ('F', 'P') GROUP BY ALL)
SELECT company_id, lineage_id, CASE WHEN b.d IS NULL THEN 'added' WHEN a.d IS NULL THEN 'removed' ELSE 'replaced' END AS change, coalesce(a.d, b.d) AS document_id, CASE WHEN a.d <> b.d THEN b.v END AS before_version, CASE WHEN a.d <> b.d THEN a.v END AS after_version
FROM b FULL OUTER JOIN a USING (company_id, lineage_id) WHERE a.d IS DISTINCT FROM b.d""",
    "element_changes": f"{_BOTH} SELECT a.company_id, a.code, a.element, b.status AS status_before, a.status AS status_after FROM elements a JOIN elements_b b ON a.company_id = b.company_id AND a.code = b.code AND a.element = b.element WHERE a.status <> b.status",
    "merged_findings": _MERGED,
    "related_evidence": f"{_ROWS_SQL} SELECT company_id, code, passage_id, row_number() OVER (PARTITION BY company_id ORDER BY rank) AS place FROM hits h WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.company_id = h.company_id AND l.code = h.code AND l.passage_id = h.passage_id) QUALIFY place <= 3",
    "candidate_passages": f"""{_ROWS_SQL}, c AS (SELECT company_id, code, unnest(passages[1:2]) AS passage_id, generate_subscripts(passages[1:2], 1) AS k, 1 AS stage, ordinal AS pos, '' AS name FROM elements
  UNION ALL SELECT company_id, code, unnest([low_passage, high_passage]), unnest([1, 2]), 2, 0, metric_key FROM conflicts UNION ALL SELECT company_id, code, passage_id, 0, 3, rank, '' FROM hits),
d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY company_id, code, passage_id ORDER BY stage, pos, name, k) = 1)
SELECT company_id, code, passage_id, row_number() OVER (PARTITION BY company_id, code ORDER BY stage, pos, name, k, passage_id) AS place FROM d QUALIFY place <= 12""",
    "finding_evidence": f"""{_ROWS_SQL}, rel AS (SELECT company_id, code, passage_id, row_number() OVER (PARTITION BY company_id ORDER BY rank) AS place FROM hits h
  WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.company_id = h.company_id AND l.code = h.code AND l.passage_id = h.passage_id) QUALIFY place <= 3), m AS (SELECT company_id, code, max(rank) AS last FROM links GROUP BY ALL)
SELECT company_id, code, passage_id, role, names AS elements, rank FROM links UNION ALL SELECT company_id, code, passage_id, 'related', '', coalesce(last, 0) + place FROM rel LEFT JOIN m USING (company_id, code)""",
    "finding_rationales": f"""{_ROWS_SQL}, {_DIFFER_SQL}, l AS (SELECT company_id, code, count(*) FILTER (status <> 'not_applicable') AS m, count(*) FILTER (status = 'satisfied') AS k, string_agg({_NAME_SQL}, '; ' ORDER BY ordinal) FILTER (status = 'missing') AS missing_,
  string_agg({_NAME_SQL}, '; ' ORDER BY ordinal) FILTER (status = 'satisfied' AND weak) AS weak_, string_agg({_NAME_SQL}, '; ' ORDER BY ordinal) FILTER (status = 'not_applicable') AS moot_ FROM elements GROUP BY ALL),
dd AS (SELECT company_id, code, string_agg('Sources differ on ' || metric_key || ': ' || {_SHOWN_SQL.format('lo')} || ' MWh and ' || {_SHOWN_SQL.format('hi')} || ' MWh, ' || {_FIXED2.format('round((hi - lo) / abs(lo), 4) * 100', 1)} || ' % apart.', ' ' ORDER BY metric_key) AS d FROM differ GROUP BY ALL),
rel AS (SELECT company_id, 'R1' AS code, least(3, count(*)) AS n FROM hits h WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.company_id = h.company_id AND l.code = h.code AND l.passage_id = h.passage_id) GROUP BY company_id)
SELECT f.company_id, f.code, concat_ws(' ', CASE WHEN status = 'conflicting' THEN d || ' A reviewer has to say which value holds.' WHEN status = 'supported' THEN 'All ' || m || ' applicable elements are evidenced.'
    WHEN k > 0 THEN k || ' of ' || m || ' applicable elements are evidenced (' || round(completeness * 100)::BIGINT || ' % of the weight).'
    WHEN status = 'not_found' THEN 'None of the elements was found, which doesn''t prove that they don''t exist.' || CASE WHEN coalesce(n, 0) > 0 THEN ' Related passages: ' || n || '.' ELSE '' END END,
  CASE WHEN status <> 'not_found' THEN 'Missing: ' || missing_ || '.' END, 'Weaker evidence: ' || weak_ || '.', 'Not applicable: ' || moot_ || '.') AS rationale
FROM findings f JOIN l USING (company_id, code) LEFT JOIN dd USING (company_id, code) LEFT JOIN rel USING (company_id, code)""",
    "model_prompts": f"""{_ROWS_SQL}, {_DIFFER_SQL}, summaries(code, title, summary) AS (VALUES {", ".join(f"('{r[0]}', '{r[2]}', '{r[4]}')" for r in REQUIREMENTS)}),
e AS (SELECT company_id, code, string_agg('- ' || element || ' | ' || {_FULL_SQL} || ' | ' || format('{{:.1f}}', weight) || ' | ' || CASE status WHEN 'missing' THEN 'not found' WHEN 'not_applicable' THEN 'not applicable' ELSE 'satisfied' END || CASE WHEN weak THEN ' (weak)' ELSE '' END, chr(10) ORDER BY ordinal) AS e
  FROM elements GROUP BY ALL),
dd AS (SELECT company_id, code, string_agg('- ' || metric_key || ': ' || {_SHOWN_SQL.format('lo')} || ' [' || low_passage || '] and ' || {_SHOWN_SQL.format('hi')} || ' [' || high_passage || ']', chr(10) ORDER BY metric_key) AS d FROM differ GROUP BY ALL),
c AS (SELECT company_id, code, unnest(passages[1:2]) AS passage_id, 1 AS stage, ordinal AS o, '' AS nm, generate_subscripts(passages[1:2], 1) - 1 AS k FROM elements
  UNION ALL SELECT company_id, code, unnest([low_passage, high_passage]), 2, 0, metric_key, generate_subscripts([low_passage, high_passage], 1) - 1 FROM conflicts UNION ALL SELECT company_id, code, passage_id, 3, rank, '', 0 FROM hits),
g AS (SELECT company_id, code, passage_id, min((stage, o, nm, k)) AS f FROM c GROUP BY ALL), p AS (SELECT company_id, code, passage_id, row_number() OVER (PARTITION BY company_id, code ORDER BY f, passage_id) AS place FROM g QUALIFY place <= 12),
q AS (SELECT company_id, code, count(*) AS n, string_agg('[' || passage_id || '] document ' || document_id || ', p.' || page || chr(10) || '"' || text || '"', chr(10) ORDER BY place) AS p FROM p JOIN sources USING (passage_id) GROUP BY ALL)
SELECT e.company_id, e.code, coalesce(n, 0) AS n_passages, concat_ws(chr(10), 'REQUIREMENT ' || e.code || ': ' || title, 'SUMMARY ' || summary, 'PERIOD {AFTER}', 'ELEMENTS (key | label | weight | result by rule)', e, 'VALUES THAT DIFFER', coalesce(d, '- none'),
  'PASSAGES', coalesce(p, '- none'), 'Answer in JSON and judge every element once.') AS prompt
FROM e JOIN summaries USING (code) LEFT JOIN dd USING (company_id, code) LEFT JOIN q USING (company_id, code)""",
    "company_coverage": f"""WITH {FACTS_SQL}, f AS (SELECT company_id, document_id, confidence_pct - 80 AS page, confidence_pct < 90 AS scanned, period_label, o_orderstatus = 'F' AS ready, o_orderpriority FROM facts JOIN orders ON o_orderkey = document_id)
SELECT company_id, count(DISTINCT document_id) AS documents, count(DISTINCT document_id) FILTER (ready) AS ready, count(DISTINCT (document_id, page)) AS pages, count(DISTINCT (document_id, page)) FILTER (scanned) AS scanned_pages, count(*)::BIGINT AS metrics,
  string_agg(DISTINCT period_label, ',' ORDER BY period_label) AS periods, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS types FROM f GROUP BY company_id""",
    "unresolved_findings": f"""{_F}, why AS (SELECT company_id, code, 'sources differ on ' || metric_key AS reason FROM conflicts UNION SELECT company_id, code, 'no evidence for ' || element FROM elements WHERE status = 'missing'
  UNION SELECT company_id, code, 'only doubtful text for ' || element FROM elements WHERE doubtful), three AS (SELECT company_id, code, array_to_string(list_sort(list(reason))[1:3], '; ') AS reasons FROM why GROUP BY ALL)
SELECT company_id, code, status, coalesce(reasons, '') AS reasons FROM findings LEFT JOIN three USING (company_id, code) WHERE status IN ('conflicting', 'human_review') OR requires_review""",
    "action_views": f"""{_ROWS_SQL} SELECT company_id, count(*) FILTER (action_status IN ('open', 'in_progress', 'blocked')) AS "open", count(*) FILTER (action_status = 'done') AS done, count(*) FILTER (action_status <> 'dismissed') AS "all" FROM actions GROUP BY company_id""",
    "requirement_search": f"""WITH {LINES_SQL}, {POSTINGS_SQL}, q(query_id, query, phrases, section_terms) AS (VALUES {_SEARCH}),
wanted AS (SELECT DISTINCT query_id, unnest({tokens_sql("query")}) AS term FROM q), df AS (SELECT term, count(*) AS df FROM postings GROUP BY term), n AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS mean FROM tokenised),
scored AS (SELECT query_id, passage_id, sum(round(ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * (tf * 24e-1 / (tf + 14e-1 * (1 - 75e-2 + 75e-2 * length / mean))), 9)::DECIMAL(28, 9))::DOUBLE AS raw FROM postings JOIN df USING (term) JOIN wanted USING (term), n GROUP BY ALL),
every AS (SELECT query_id, passage_id, kind, section, section_terms, coalesce(raw, 0) AS raw, len([p for p in phrases if contains(lower(line), p)]) AS k FROM tokenised CROSS JOIN q LEFT JOIN scored USING (query_id, passage_id)),
scored_ AS (SELECT *, raw / max(raw) OVER (PARTITION BY query_id) AS share FROM every WHERE raw > 0 OR k > 0),
final AS (SELECT query_id, passage_id, round((6e-1 * share + least(45e-2, 15e-2 * k) + CASE WHEN len([t for t in section_terms if contains(lower(coalesce(section, '')), t)]) > 0 THEN 1e-1 ELSE 0e0 END) * CASE kind WHEN 'heading' THEN 35e-2 WHEN 'table' THEN 6e-1 ELSE 1e0 END, 6) AS score FROM scored_)
SELECT query_id, passage_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank, score FROM final QUALIFY rank <= 8""",
    "catalogue_status": """WITH s AS (SELECT p_brand, p_size, count(*) AS requirements, DATE '2024-01-01' + p_size * 20 AS a, CASE WHEN p_size % 3 = 0 THEN DATE '2024-01-01' + (p_size * 20 + 100) END AS b FROM part GROUP BY ALL),
t AS (SELECT *, CASE WHEN DATE '2024-12-31' < a THEN 'upcoming' WHEN b IS NOT NULL AND DATE '2024-12-31' > b THEN 'withdrawn' ELSE 'in_force' END AS status FROM s)
SELECT p_brand, requirements, (p_size // 10) || '.' || (p_size % 10) AS version, status, row_number() OVER (PARTITION BY p_brand ORDER BY CASE status WHEN 'in_force' THEN 0 WHEN 'upcoming' THEN 1 ELSE 2 END, p_size DESC) AS place FROM t QUALIFY place <= 3""",
    "catalogue_load": """SELECT p_partkey::VARCHAR AS set_id, sha256(concat_ws('|', p_name, p_brand, p_type)) AS content_hash, CASE p_partkey % 3 WHEN 0 THEN 'loaded' WHEN 1 THEN 'skipped' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'refused' ELSE 'replaced' END END AS outcome FROM part""",
    "run_manifest": f"WITH {FACTS_SQL} SELECT company_id, string_agg(document_id::VARCHAR, ',' ORDER BY document_id) AS documents, count(*) AS n, sha256('{_HASH}') AS requirements_hash FROM (SELECT DISTINCT company_id, document_id FROM facts WHERE period_label = '{AFTER}') GROUP BY company_id",
    "first_boundary": f"WITH {LINES_SQL} SELECT doc_id, arg_min(passage_id, ordinal) AS passage_id, min(ordinal) AS ordinal FROM passages WHERE regexp_matches(line, '(?i)the') AND regexp_matches(line, '(?i)license|token|under') GROUP BY doc_id",
    "evaluation_cases": f"""{_CASES_SQL} SELECT case_id, gold, predicted, conflict AS gold_conflict, conflict AS predicted_conflict, value_found, citations, cost FROM r""",
    "evaluation_summary": f"""{_CASES_SQL} {_SUMMARY_SQL}""",
    "evaluation_report": f"""{_CASES_SQL}, s AS ({_SUMMARY_SQL})
SELECT concat_ws(chr(10), '| Figure | rules |', '|---|---|', '| Cases | ' || cases || ' |', {", ".join(f"'| {n} | ' || format('{{:.1f}}', {c} * 100) || '% |'" for n, c in (
  ("Status accuracy", "status_accuracy"), ("Gap detection, precision", "gap_precision"), ("Gap detection, recall", "gap_recall"), ("Element detection, precision", "element_precision"), ("Element detection, recall", "element_recall"),
  ("Contradictions, precision", "conflict_precision"), ("Contradictions, recall", "conflict_recall")))}, '| Values found | ' || format('{{:.1f}}', numeric_accuracy * 100) || '% (' || numeric_cases || ' values) |',
  '| Citation validity | ' || format('{{:.1f}}', citation_validity * 100) || '% |', '| Review rate | ' || format('{{:.1f}}', review_rate * 100) || '% |', '| Median cost | ' || format('{{:.1f}}', median_cost) || ' |') AS report FROM s""",
    "sampled_cases": """WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) - 1 AS k, count(*) OVER () AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM r WHERE k IN (SELECT i * (SELECT count(*) FROM lineitem) // 100 FROM range(100) t(i))""",
    "call_statistics": "SELECT user_id, count(*) AS calls, count(*) FILTER (event_type = 'view') AS cached, (sum(floor(value)) FILTER (event_type <> 'view'))::BIGINT AS tokens, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY user_id",
    "dashboard_counts": f"""{_F}, c AS (SELECT s_nationkey::BIGINT AS org_id, count(DISTINCT company_id) AS companies, count(*) AS findings, count(*) FILTER (status <> 'supported') AS gaps, count(*) FILTER (requires_review) AS reviews FROM findings JOIN supplier ON s_suppkey = company_id GROUP BY ALL),
f AS (SELECT s_nationkey::BIGINT AS org_id, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier)
SELECT c.*, (SELECT string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) FROM f WHERE f.org_id = c.org_id AND r <= 3) AS first_companies FROM c""",
    "display_formats": r"""SELECT p_partkey, trim(regexp_replace(lower(p_name || '  ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(p_name || '*?.pdf', '[^A-Za-z0-9._ -]+', '_', 'g')[:120] AS file,
  format('{:,}', round(p_retailprice)::BIGINT) AS value, CASE WHEN p_size > 25 THEN '+' WHEN p_size < 25 THEN '−' ELSE '' END || format('{:.1f}', abs(round((p_size - 25) / 4e1 * 100, 1))) || ' %' AS change,
  CASE WHEN p_partkey * p_partkey < 1024 THEN (p_partkey * p_partkey) || ' B' WHEN p_partkey * p_partkey < 1048576 THEN format('{:.1f}', round(p_partkey * p_partkey / 1024e0, 1)) || ' KB' ELSE format('{:.1f}', round(p_partkey * p_partkey / 1048576e0, 1)) || ' MB' END AS bytes FROM part""",
}
