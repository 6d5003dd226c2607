"""Queries over the requirement catalogue: checks, findings, merge, gaps, actions, diffs, evidence."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import assessment as A
from ..operators import checks as C
from ..operators import workflow as W
from ..sources.catalogue import flatten, packaged
from ..sources.facts import FACTS_SQL, metric_facts, period_facts
from ..sources.scratch import materialise
from ..sources.tables import table
from .text_queries import LINES_SQL, _passages

BEFORE, AFTER = "FY1997", "FY1998"
#: What a run looks at of a fact.
_LOOKED_AT = ("company_id", "document_id", "passage_id", "metric_key", "normalized_value", "normalized_unit", "period_label", "method", "confidence_pct", "inferred", "base_year")


def _companies(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company_id"), F.col("s_nationkey").cast("long").alias("org_id"))


class Run:
    """The tables of an assessment, each made once: the facts that the catalogue looks at from one scan, elements, conflicts and findings of
    all periods from one aggregation each, and links. All are rows a company, far fewer than facts; they are written to the shared folder."""

    def __init__(self, spark, sf_dir, *periods):
        self.spark, self.sf_dir, self.periods = spark, sf_dir, list(periods or (AFTER,))

    @cached_property
    def companies(self):
        return _companies(self.spark, self.sf_dir)

    @cached_property
    def facts(self):
        wanted = F.col("metric_key").isin(A.catalogue_keys(A.CATALOGUE)) & ~F.col("base_year")
        return materialise(period_facts(self.spark, self.sf_dir, *self.periods).filter(wanted).select(*_LOOKED_AT), "run-facts")

    @cached_property
    def _elements(self):
        return materialise(A.element_results_of(self.companies, self.facts, A.CATALOGUE, self.periods), "run-elements")

    @cached_property
    def _conflicts(self):
        return materialise(A.requirement_conflicts_of(self.facts, A.CATALOGUE, self.periods), "run-conflicts")

    @cached_property
    def _findings(self):
        return materialise(A.findings(self._elements, self._conflicts, "period_label"), "run-findings")

    @cached_property
    def _links(self):
        return materialise(A.evidence_links(self.elements(), self.conflicts()), "run-links")

    def elements(self, period=AFTER):
        return self._elements.filter(F.col("period_label") == period).drop("period_label")

    def conflicts(self, period=AFTER):
        return self._conflicts.filter(F.col("period_label") == period).drop("period_label")

    def findings(self, period=AFTER):
        return self._findings.filter(F.col("period_label") == period).drop("period_label")

    def gaps(self, period=AFTER):
        return A.gaps(self.findings(period), self.elements(period), self.conflicts(period))

    def links(self):
        return self._links

    def priorities(self):
        """company_id, code, status and priority of findings that aren't supported, by a fixed calendar."""
        importance = F.create_map(*[F.lit(x) for kv in A.IMPORTANCE.items() for x in kv])[F.col("code")]
        days = F.when(F.col("company_id") % 5 != 0, F.col("company_id") * 7 % 250)
        found = self.findings().filter("status <> 'supported'")
        return found.select("company_id", "code", "status", scoring.priority(importance, F.col("status"), F.col("completeness"), days).alias("priority"))


def _check(kind):
    def query(spark, sf_dir):
        rows = Run(spark, sf_dir).elements().filter(F.col("kind") == kind)
        return rows.select("company_id", "code", "element", "status", "weak", F.array_join("passages", ",").alias("passages"))

    return query


def check_pattern_context(spark, sf_dir):
    """DOM-6, FIL-6, WIN-8: up to three passages per document that match a pattern in a context."""
    from pyspark.sql import Window

    hits = _passages(spark, sf_dir).filter((F.col("kind") != "heading") & F.col("line").rlike("(?i)(license|token|password|secret)"))
    context = F.lower(F.concat_ws(" ", "line", "section"))
    relevance = sum(F.when(F.contains(context, F.lit(w)), 1).otherwise(0) for w in ("version", "the", "de", "under"))
    ranked = hits.withColumn("relevance", relevance.cast("long")).filter("relevance > 0")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("relevance"), "ordinal"))
    return ranked.withColumn("rank", rank.cast("long")).filter("rank <= 3").select("doc_id", "rank", "passage_id", "relevance")


def _tree(code):
    return [n for n in flatten(packaged()) if n.code == code]


def check_tree_patterns(spark, sf_dir):
    """DOM-7, DOM-6, SRC-7: a catalogue's nested pattern checks over each document's passages."""
    passages = _passages(spark, sf_dir).select(F.col("doc_id").alias("company_id"), "passage_id", "ordinal", F.col("line").alias("text"), "kind", "section")
    found = C.evaluate(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("company_id")), _tree("D1"), passages=passages)
    return found.select("company_id", "element", "status", F.array_join("passages", ",").alias("passages"), F.array_join("context", ",").alias("context"))


def check_tree_metrics(spark, sf_dir):
    """DOM-7, DOM-4, DOM-5: a catalogue's nested metric checks over each company's facts, with what other periods have."""
    facts = metric_facts(spark, sf_dir).withColumn("metric_id", F.col("passage_id"))
    found = C.evaluate(_companies(spark, sf_dir), _tree("M1"), facts=facts, period=AFTER)
    others = F.when(F.col("status") == "missing", F.regexp_extract("note", "values for other periods only: (.*)", 1)).otherwise("")
    return found.select(
        "company_id", "element", "status", "weak", F.array_join("passages", ",").alias("passages"), F.array_join("context", ",").alias("context"),
        F.size("metrics").cast("long").alias("n_metrics"), others.alias("other_periods"),
    )


def requirement_completeness(spark, sf_dir):
    """AGG-5: weighted share of satisfied elements."""
    return Run(spark, sf_dir).findings().select("company_id", "code", "completeness", "missing")


def requirement_status(spark, sf_dir):
    """AGG-6: status per company and requirement."""
    return Run(spark, sf_dir).findings().select("company_id", "code", "status")


def finding_confidence(spark, sf_dir):
    """AGG-7: confidence per finding."""
    return Run(spark, sf_dir).findings().select("company_id", "code", "confidence")


def review_triggers(spark, sf_dir):
    """AGG-9, FIL-14: findings that a human should see."""
    return Run(spark, sf_dir).findings().filter("requires_review").select("company_id", "code", "status")


def findings_status_counts(spark, sf_dir):
    """AGG-10, AGG-19: findings by status within an organisation."""
    found = Run(spark, sf_dir).findings().join(_companies(spark, sf_dir), "company_id")
    counts = found.groupBy("org_id", "status").agg(F.count("*").alias("n"), F.count_if("requires_review").alias("needs_review"), F.sum(F.round(F.col("completeness") * 10000).cast("long")).alias("completeness_sum"))
    return counts


def remediation_priority(spark, sf_dir):
    """SCL-29: priority of findings that aren't supported, by a fixed calendar."""
    return Run(spark, sf_dir).priorities()


def dashboard_top_gaps(spark, sf_dir):
    """WIN-4: at most three gaps a company, the first eight of all."""
    rows = remediation_priority(spark, sf_dir)
    return W.top_per_group(rows, by="company_id", order=[F.desc("priority"), F.col("company_id"), F.col("code")], each=3, overall=8)


def gap_expansion(spark, sf_dir):
    """DOM-12: what each finding leaves open."""
    return Run(spark, sf_dir).gaps()


def action_sync(spark, sf_dir):
    """DOM-13, JN-18: last period's actions against this period's gaps."""
    run = Run(spark, sf_dir, BEFORE, AFTER)
    state = F.element_at(F.array(*map(F.lit, ["open", "in_progress", "done", "dismissed"])), (F.col("company_id") % 4 + 1).cast("int"))
    existing = run.gaps(BEFORE).select("company_id", "code", "gap_key", state.alias("action_status"), (F.col("company_id") % 7 == 0).alias("closed"))
    assessed = run.findings().filter(F.col("company_id") % 11 != 0)
    return A.sync_actions(run.gaps(AFTER), existing, assessed)


def merge_policy(spark, sf_dir):
    """DOM-11: model verdicts merged into the rules' elements."""
    elements = Run(spark, sf_dir).elements()
    way = (F.col("company_id") + F.length("element")) % 4
    verdict = F.when(way == 0, "yes").when(way == 1, "no").when(way == 2, "unclear")
    verdicts = elements.select("company_id", "code", "element", verdict.alias("verdict"), (F.col("company_id") % 3 != 0).alias("valid"), (F.col("company_id") % 2 == 0).alias("confident"))
    merged = A.merge_verdicts(elements, verdicts)
    return merged.select("company_id", "code", "element", "status", "weak", "source", F.coalesce("reason", F.lit("")).alias("reason"))


def evidence_links(spark, sf_dir):
    """WIN-7: passages linked to findings with role and rank."""
    return Run(spark, sf_dir).links()


def _manifest(run, period):
    """What a run of a period was given: a hash of each requirement, its documents by lineage, and the versions of its method."""
    later = period == AFTER
    # R3 was revised between the runs, R4 wasn't in the first one's catalogue
    hashes = [(c, f"{c}-2" if later and c == "R3" else c) for c in sorted(A.IMPORTANCE) if later or c != "R4"]
    requirements = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.sha2(F.lit(h), 256)) for c, h in hashes]))
    lineage = F.struct((F.col("document_id") % 10).alias("lineage_id"), F.col("document_id").alias("id"), F.sha2(F.col("document_id").cast("string"), 256).alias("sha256"))
    own = run.facts.filter(F.col("period_label") == period).groupBy("company_id").agg(F.array_sort(F.collect_set(lineage)).alias("documents"))
    same = {f: F.lit("1") for f in A.VERSION_FIELDS} | {"rules_version": F.when(F.col("company_id") % 5 == 0, F.lit(period)).otherwise("1"), "llm_model": F.lit(None).cast("string")}
    versions = F.struct(*[v.alias(k) for k, v in same.items()])
    return run.companies.select("company_id").join(own, "company_id", "left").select("company_id", requirements.alias("requirements"), F.coalesce("documents", F.array()).alias("documents"), versions.alias("versions"))


def run_diff(spark, sf_dir):
    """DOM-14, JN-17, SET-1: findings that changed between two runs, and why, by the runs' manifests."""
    run = Run(spark, sf_dir, BEFORE, AFTER)
    before = run.findings(BEFORE).filter("code <> 'R4'")
    found = A.diff_runs(before, run.findings(AFTER), _manifest(run, BEFORE), _manifest(run, AFTER))
    return found.select("company_id", "code", "status_before", "status_after", *[F.array_join(c, ",").alias(c) for c in ("added", "removed", "fields")], "cause")


def stale_findings(spark, sf_dir):
    """JN-3, STR-5: findings whose evidence stands in superseded documents."""
    facts = period_facts(spark, sf_dir, AFTER).select("passage_id", "document_id")
    from .text_queries import document_versions

    superseded = document_versions(spark, sf_dir).filter("superseded_by IS NOT NULL").select(F.col("o_orderkey").alias("document_id"))
    linked = Run(spark, sf_dir).findings().select("company_id", "code", F.explode("evidence").alias("passage_id"))
    stale = linked.join(facts, "passage_id").join(superseded, "document_id", "left_semi")
    return stale.groupBy("company_id", "code").agg(F.countDistinct("document_id").alias("documents"), F.count("*").alias("passages"))


def _values(rows):
    def cell(x):
        return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x:e}" if isinstance(x, float) else str(x)

    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


_ELEMENT_ROWS = _values([(e.code, e.element, k, e.weight, e.kind) for k, e in enumerate(A.CATALOGUE)])
_KEY_ROWS = _values([(e.code, e.element, key, role) for e in A.CATALOGUE for role, keys in (("strong", e.strong), ("weak", e.weak), ("when", (e.when,) if e.when else ())) for key in keys])
_REQUIREMENT_KEYS = _values(sorted({(e.code, k) for e in A.CATALOGUE for k in e.strong + e.weak}))


def findings_sql(period: str, n: str = "") -> str:
    """CTEs elements{n}, conflicts{n} and findings{n} of one period."""
    return f"""
used{n} AS (
  SELECT company_id, code, element, role, method, confidence_pct, passage_id, inferred,
    row_number() OVER (PARTITION BY company_id, code, element, role ORDER BY method <> 'table', -confidence_pct, passage_id) AS r
  FROM facts JOIN (VALUES {_KEY_ROWS}) k(code, element, metric_key, role) USING (metric_key) WHERE period_label = '{period}' AND NOT base_year
), grouped{n} AS (
  SELECT company_id, code, element, count(*) FILTER (role = 'strong') AS n_strong, count(*) FILTER (role = 'weak') AS n_weak, count(*) FILTER (role = 'when') AS n_when,
    count(*) FILTER (role = 'strong' AND NOT inferred) AS n_explicit,
    list({{'p': passage_id, 'c': confidence_pct, 'm': method}} ORDER BY r) FILTER (role = 'strong' AND r <= 3) AS strong_best,
    list({{'p': passage_id, 'c': confidence_pct, 'm': method}} ORDER BY r) FILTER (role = 'weak' AND r <= 3) AS weak_best
  FROM used{n} GROUP BY ALL
), staged{n} AS (
  SELECT s_suppkey AS company_id, e.code, e.element, ordinal, weight, kind, coalesce(n_strong, 0) AS n_strong, coalesce(n_explicit, 0) AS n_explicit,
    CASE WHEN kind = 'conditional' AND coalesce(n_when, 0) = 0 THEN 'not_applicable' WHEN coalesce(n_strong, 0) + coalesce(n_weak, 0) > 0 THEN 'satisfied' ELSE 'missing' END AS status,
    CASE WHEN coalesce(n_strong, 0) > 0 THEN strong_best ELSE weak_best END AS best
  FROM supplier CROSS JOIN (VALUES {_ELEMENT_ROWS}) e(code, element, ordinal, weight, kind)
  LEFT JOIN grouped{n} g ON g.company_id = s_suppkey AND g.code = e.code AND g.element = e.element
), elements{n} AS (
  SELECT company_id, code, element, ordinal, weight, kind, status,
    status = 'satisfied' AND CASE WHEN kind = 'metric_period' THEN n_explicit = 0 ELSE n_strong = 0 END AS weak,
    CASE WHEN status = 'satisfied' THEN [x.p for x in best] ELSE [] END AS passages,
    CASE WHEN status = 'satisfied' THEN list_max([x.c for x in best]) END AS confidence_pct,
    coalesce(status = 'satisfied' AND len([x for x in best if x.m <> 'text']) = 0 AND list_min([x.c for x in best]) < {A.DOUBTFUL_PCT}, false) AS doubtful
  FROM staged{n}
), conflicts{n} AS (
  SELECT company_id, code, metric_key, low_passage, high_passage FROM (
    SELECT company_id, metric_key, min(normalized_value) AS lo, max(normalized_value) AS hi, count(*) AS n,
      first(passage_id ORDER BY normalized_value, passage_id) AS low_passage, first(passage_id ORDER BY normalized_value DESC, passage_id DESC) AS high_passage
    FROM facts WHERE period_label = '{period}' AND NOT base_year GROUP BY ALL
  ) JOIN (VALUES {_REQUIREMENT_KEYS}) k(code, metric_key) USING (metric_key) WHERE n >= 2 AND low_passage <> high_passage AND lo <> 0 AND (hi - lo) / abs(lo) > 0.01
), rated{n} AS (
  SELECT e.company_id, e.code, coalesce(any_value(n), 0) > 0 AS conflicting, bool_or(doubtful) AS doubtful,
    sum(CASE WHEN status <> 'not_applicable' THEN weight ELSE 0e0 END) AS w, sum(CASE WHEN status = 'satisfied' THEN weight ELSE 0e0 END) AS s,
    avg(CASE status WHEN 'missing' THEN 75e-2 WHEN 'satisfied' THEN confidence_pct / 1e2 * CASE WHEN weak THEN 8e-1 ELSE 1e0 END END) AS mean,
    string_agg(element, '; ' ORDER BY element) FILTER (status = 'missing') AS missing, list_sort(list_distinct(flatten(list(passages)))) AS evidence
  FROM elements{n} e LEFT JOIN (SELECT company_id, code, count(*) AS n FROM conflicts{n} GROUP BY ALL) c ON c.company_id = e.company_id AND c.code = e.code GROUP BY e.company_id, e.code
), findings{n} AS (
  SELECT company_id, code, completeness, evidence, coalesce(missing, '') AS missing, doubtful OR conflicting AS requires_review,
    CASE WHEN mean IS NULL THEN 3e-1 ELSE round(least(95e-2, mean * CASE WHEN conflicting THEN 85e-2 ELSE 1e0 END), 6) END AS confidence,
    CASE WHEN doubtful AND NOT conflicting THEN 'human_review' WHEN conflicting THEN 'conflicting' WHEN completeness >= 0.9999 THEN 'supported' WHEN completeness > 0 THEN 'partially_supported' ELSE 'not_found' END AS status
  FROM (SELECT *, CASE WHEN w > 0 THEN round(s / w, 4) ELSE 0e0 END AS completeness FROM rated{n})
), gaps{n} AS (
  SELECT DISTINCT company_id, code, 'conflict:' || metric_key AS gap_key FROM conflicts{n}
  UNION ALL SELECT e.company_id, e.code, 'missing:' || element FROM elements{n} e JOIN findings{n} f ON f.company_id = e.company_id AND f.code = e.code WHERE e.status = 'missing' AND f.status <> 'conflicting'
), all_gaps{n} AS (
  SELECT * FROM gaps{n} UNION ALL
  SELECT company_id, code, 'review' FROM findings{n} f WHERE status = 'human_review' AND NOT EXISTS (SELECT 1 FROM gaps{n} g WHERE g.company_id = f.company_id AND g.code = f.code)
)"""


_F = f"WITH {FACTS_SQL}, {findings_sql(AFTER)}"
_BOTH = f"WITH {FACTS_SQL}, {findings_sql(AFTER)}, {findings_sql(BEFORE, '_b')}"
_IMPORTANCE = " ".join(f"WHEN '{k}' THEN {({1: '4e-1', 2: '7e-1', 3: '1e0'})[v]}" for k, v in A.IMPORTANCE.items())
_PRIORITY = f"""priorities AS (
  SELECT company_id, code, status, round(CASE code {_IMPORTANCE} END
    * CASE status WHEN 'not_found' THEN 1e0 WHEN 'conflicting' THEN 8e-1 WHEN 'human_review' THEN 5e-1 ELSE greatest(1e-1, round(1 - completeness, 3)) END
    * CASE WHEN company_id % 5 = 0 THEN 5e-1 WHEN company_id * 7 % 250 <= 30 THEN 1e0 WHEN company_id * 7 % 250 <= 90 THEN 8e-1 WHEN company_id * 7 % 250 <= 180 THEN 6e-1 ELSE 4e-1 END, 3) AS priority
  FROM findings WHERE status <> 'supported')"""
_CHECKS = {"check_metric": "metric", "check_metric_period": "metric_period", "check_any_of": "any_of", "check_conditional": "conditional"}

QUERIES = {name: _check(kind) for name, kind in _CHECKS.items()} | {
    f.__name__: f
    for f in (
        check_pattern_context, check_tree_patterns, check_tree_metrics, requirement_completeness, requirement_status, finding_confidence, review_triggers, findings_status_counts, remediation_priority, dashboard_top_gaps,
        gap_expansion, action_sync, merge_policy, evidence_links, run_diff, stale_findings,
    )
}

ORACLES = {name: f"{_F} SELECT company_id, code, element, status, weak, array_to_string(passages, ',') AS passages FROM elements WHERE kind = '{kind}'" for name, kind in _CHECKS.items()} | {
    "check_pattern_context": f"""WITH {LINES_SQL}, hits AS (
  SELECT *, lower(concat_ws(' ', line, section)) AS c FROM passages WHERE kind <> 'heading' AND regexp_matches(line, '(?i)(license|token|password|secret)')
), scored AS (SELECT *, contains(c, 'version')::BIGINT + contains(c, 'the')::BIGINT + contains(c, 'de')::BIGINT + contains(c, 'under')::BIGINT AS relevance FROM hits)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY relevance DESC, ordinal) AS rank, passage_id, relevance FROM scored WHERE relevance > 0 QUALIFY rank <= 3""",
    "check_tree_patterns": rf"""WITH {LINES_SQL}, m AS (
  SELECT doc_id, ordinal, passage_id, regexp_matches(line, '(?i)licen[sc]e|copyright') AS w, regexp_matches(line, '(?i)version \d') AND regexp_matches(line || ' ' || coalesce(section, ''), '(?i)public|general') AS a,
    regexp_matches(line, '(?i)password|secret|token') AS b, regexp_matches(line, '(?i)under|with') AS bb, regexp_matches(line, '(?i)mit license|apache') AS c, regexp_matches(line, '(?i)[a-z0-9.]+@[a-z0-9.]+') AS e
  FROM passages WHERE kind <> 'heading'
), l AS (SELECT doc_id, {", ".join(f"list(passage_id ORDER BY ordinal) FILTER ({x}) AS {x}" for x in ("w", "a", "b", "bb", "c", "e"))} FROM m GROUP BY doc_id),
t AS (SELECT d.doc_id, w, e, CASE WHEN a IS NOT NULL THEN a WHEN b IS NOT NULL AND bb IS NOT NULL THEN bb ELSE c END AS x FROM documents d LEFT JOIN l USING (doc_id))
SELECT doc_id AS company_id, 'terms' AS element, CASE WHEN w IS NULL THEN 'not_applicable' WHEN x IS NULL THEN 'missing' ELSE 'satisfied' END AS status,
  CASE WHEN w IS NULL OR x IS NULL THEN '' ELSE array_to_string(x[1:3], ',') END AS passages, CASE WHEN w IS NULL THEN '' ELSE array_to_string(w[1:2], ',') END AS context FROM t
UNION ALL SELECT doc_id, 'contact', CASE WHEN e IS NULL THEN 'missing' ELSE 'satisfied' END, coalesce(array_to_string(e[1:3], ','), ''), '' FROM t""",
    "check_tree_metrics": f"""WITH {FACTS_SQL}, u AS (
  SELECT company_id, metric_key AS k, period_label = '{AFTER}' AS here, inferred, passage_id AS p, period_label, (method <> 'table', -confidence_pct, passage_id) AS o FROM facts WHERE NOT base_year
), l AS (
  SELECT company_id, list(p ORDER BY o) FILTER (here AND k = 'Brand#2') AS w, list(p ORDER BY o) FILTER (here AND k = 'Brand#9') AS a, list(p ORDER BY o) FILTER (here AND k = 'Brand#4') AS b,
    list(p ORDER BY o) FILTER (here AND k IN ('Brand#3', 'Brand#5') AND NOT inferred) AS x, list(p ORDER BY o) FILTER (here AND k IN ('Brand#3', 'Brand#5')) AS y,
    list(p ORDER BY o) FILTER (here AND k = 'Brand#7') AS v, list(p ORDER BY o) FILTER (NOT here AND k = 'Brand#7') AS z, array_to_string(list_sort(list(DISTINCT period_label) FILTER (NOT here AND k = 'Brand#7')), ', ') AS zs
  FROM u GROUP BY company_id
), t AS (SELECT s_suppkey AS company_id, l.* EXCLUDE company_id, CASE WHEN a IS NOT NULL THEN a WHEN x IS NOT NULL THEN x[1:1] WHEN b IS NOT NULL THEN b ELSE y[1:1] END AS d FROM supplier LEFT JOIN l ON company_id = s_suppkey)
SELECT company_id, 'detail' AS element, CASE WHEN w IS NULL THEN 'not_applicable' WHEN d IS NULL THEN 'missing' ELSE 'satisfied' END AS status, coalesce(w IS NOT NULL AND d IS NOT NULL AND a IS NULL AND x IS NULL, false) AS weak,
  CASE WHEN w IS NULL OR d IS NULL THEN '' ELSE array_to_string(d[1:3], ',') END AS passages, coalesce(array_to_string(w[1:2], ','), '') AS context,
  CASE WHEN w IS NULL OR d IS NULL THEN 0 ELSE least(5, len(d)) END::BIGINT AS n_metrics, '' AS other_periods FROM t
UNION ALL SELECT company_id, 'value', CASE WHEN v IS NULL THEN 'missing' ELSE 'satisfied' END, false, coalesce(array_to_string(v[1:3], ','), array_to_string(z[1:2], ','), ''), '', least(5, coalesce(len(v), 0))::BIGINT,
  CASE WHEN v IS NULL THEN coalesce(zs, '') ELSE '' END FROM t""",
    "requirement_completeness": f"{_F} SELECT company_id, code, completeness, missing FROM findings",
    "requirement_status": f"{_F} SELECT company_id, code, status FROM findings",
    "finding_confidence": f"{_F} SELECT company_id, code, confidence FROM findings",
    "review_triggers": f"{_F} SELECT company_id, code, status FROM findings WHERE requires_review",
    "findings_status_counts": f"""{_F} SELECT s_nationkey::BIGINT AS org_id, status, count(*) AS n, count(*) FILTER (requires_review) AS needs_review, sum(round(completeness * 10000)::BIGINT)::BIGINT AS completeness_sum
FROM findings JOIN supplier ON s_suppkey = company_id GROUP BY ALL""",
    "remediation_priority": f"{_F}, {_PRIORITY} SELECT * FROM priorities",
    "dashboard_top_gaps": f"{_F}, {_PRIORITY} SELECT * FROM (SELECT * FROM priorities QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY priority DESC, code) <= 3) ORDER BY priority DESC, company_id, code LIMIT 8",
    "gap_expansion": f"{_F} SELECT * FROM all_gaps",
    "action_sync": f"""{_BOTH}, existing AS (SELECT *, ['open', 'in_progress', 'done', 'dismissed'][company_id % 4 + 1] AS st, company_id % 7 = 0 AS cl FROM all_gaps_b),
both_ AS (SELECT coalesce(n.company_id, o.company_id) AS company_id, coalesce(n.code, o.code) AS code, coalesce(n.gap_key, o.gap_key) AS gap_key, n.gap_key IS NOT NULL AS here, st, cl
  FROM all_gaps n FULL OUTER JOIN existing o ON n.company_id = o.company_id AND n.code = o.code AND n.gap_key = o.gap_key),
t AS (SELECT *, NOT here AND company_id % 11 <> 0 AND st NOT IN ('done', 'dismissed') AND NOT cl AS closes FROM both_)
SELECT company_id, code, gap_key, CASE WHEN here AND (st IS NULL OR st = 'done') THEN 'open' ELSE st END AS action_status,
  CASE WHEN here AND st IS NULL THEN 'created' WHEN here AND st = 'done' THEN 'reopened' WHEN here THEN 'updated' WHEN closes THEN 'closed' ELSE 'untouched' END AS change,
  CASE WHEN here THEN false WHEN closes THEN true ELSE cl END AS closed FROM t""",
    "merge_policy": f"""{_F}, v AS (
  SELECT *, CASE (company_id + length(element)) % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'unclear' ELSE 'none' END AS said, company_id % 3 <> 0 AS valid, company_id % 2 = 0 AS confident,
    kind IN ('metric', 'metric_period') AS structured FROM elements
), w AS (SELECT *, status = 'satisfied' AND said = 'no' AND NOT structured AS down, status = 'missing' AND said = 'yes' AND valid AS up FROM v)
SELECT company_id, code, element, CASE WHEN status = 'not_applicable' THEN status WHEN down THEN 'missing' WHEN up THEN 'satisfied' ELSE status END AS status,
  CASE WHEN down THEN false WHEN up THEN true ELSE weak END AS weak, CASE WHEN down OR up THEN 'model' ELSE 'rules' END AS source,
  CASE WHEN status = 'not_applicable' OR said = 'none' THEN '' WHEN status = 'satisfied' AND said = 'no' AND structured THEN 'model disagrees with a structured element'
    WHEN up AND structured THEN 'model adds a structured element' WHEN status = 'missing' AND said = 'yes' AND NOT valid THEN 'citation not valid'
    WHEN said = 'unclear' AND NOT (structured AND confident) THEN 'model is unclear' ELSE '' END AS reason FROM w""",
    "evidence_links": f"""{_F}, support AS (SELECT company_id, code, ordinal, element, unnest(passages) AS passage_id, generate_subscripts(passages, 1) AS pos FROM elements WHERE status = 'satisfied'),
firsts AS (SELECT company_id, code, passage_id, min(ordinal * 100 + pos) AS seen, string_agg(element, ',' ORDER BY ordinal) AS names FROM support GROUP BY ALL),
ends AS (SELECT DISTINCT company_id, code, unnest([low_passage, high_passage]) AS passage_id FROM conflicts)
SELECT coalesce(f.company_id, e.company_id) AS company_id, coalesce(f.code, e.code) AS code, coalesce(f.passage_id, e.passage_id) AS passage_id,
  CASE WHEN e.passage_id IS NOT NULL THEN 'conflicting' ELSE 'supporting' END AS role, coalesce(names, '') AS elements,
  row_number() OVER (PARTITION BY coalesce(f.company_id, e.company_id), coalesce(f.code, e.code) ORDER BY seen IS NULL, seen, coalesce(f.passage_id, e.passage_id)) AS rank
FROM firsts f FULL OUTER JOIN ends e ON e.company_id = f.company_id AND e.code = f.code AND e.passage_id = f.passage_id""",
    "run_diff": f"""{_BOTH}, keyed AS (SELECT company_id, period_label, document_id FROM facts WHERE NOT base_year AND metric_key IN ({", ".join(f"'{k}'" for k in A.catalogue_keys(A.CATALOGUE))}) AND period_label IN ('{BEFORE}', '{AFTER}')),
docs AS (SELECT company_id, coalesce(list_sort(list(DISTINCT document_id) FILTER (period_label = '{BEFORE}')), []) <> coalesce(list_sort(list(DISTINCT document_id) FILTER (period_label = '{AFTER}')), []) AS moved FROM keyed GROUP BY company_id),
d AS (
  SELECT coalesce(a.company_id, b.company_id) AS company_id, coalesce(a.code, b.code) AS code, b.status AS status_before, a.status AS status_after, coalesce(b.completeness, 0) AS cb, coalesce(a.completeness, 0) AS ca,
    list_sort([x for x in coalesce(a.evidence, []) if not list_contains(coalesce(b.evidence, []), x)]) AS added, list_sort([x for x in coalesce(b.evidence, []) if not list_contains(coalesce(a.evidence, []), x)]) AS removed
  FROM findings a FULL OUTER JOIN (SELECT * FROM findings_b WHERE code <> 'R4') b ON a.company_id = b.company_id AND a.code = b.code)
SELECT company_id, code, status_before, status_after, array_to_string(added, ',') AS added, array_to_string(removed, ',') AS removed, CASE WHEN company_id % 5 = 0 THEN 'rules_version' ELSE '' END AS fields,
  coalesce(nullif(concat_ws('; ', CASE code WHEN 'R4' THEN 'requirement added' WHEN 'R3' THEN 'requirement revised' END, CASE WHEN coalesce(moved, false) AND len(added) + len(removed) > 0 THEN 'documents changed' END,
    CASE WHEN company_id % 5 = 0 THEN 'method changed' END), ''), 'evidence selection changed') AS cause
FROM d LEFT JOIN docs USING (company_id) WHERE status_before IS DISTINCT FROM status_after OR round(cb, 3) <> round(ca, 3) OR len(added) + len(removed) > 0""",
    "stale_findings": f"""{_F}, linked AS (SELECT company_id, code, unnest(evidence) AS passage_id FROM findings),
superseded AS (SELECT o_orderkey FROM orders QUALIFY lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NOT NULL)
SELECT l.company_id, l.code, count(DISTINCT document_id) AS documents, count(*) AS passages FROM linked l JOIN (SELECT passage_id, document_id FROM facts WHERE period_label = '{AFTER}') USING (passage_id)
WHERE document_id IN (SELECT o_orderkey FROM superseded) GROUP BY ALL""",
}
