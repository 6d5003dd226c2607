"""Queries over events, orders, conversations and labels: folds, queues, metering, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import workflow as W
from ..operators.answers import validated_answers
from ..sources.tables import table

KINDS = ["click", "error", "purchase", "signup", "view"]
AS_OF = "2024-01-20 00:00:00"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")


def _runs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return orders.select(F.col("o_custkey").alias("company_id"), F.col("o_orderpriority").alias("set_key"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("run_id"))


def latest_run(spark, sf_dir):
    """WIN-1: the last completed run of each company."""
    return W.latest(_runs(spark, sf_dir), by=["company_id"], order=["created_at", "run_id"], value=["run_id", "set_key"])


def previous_run(spark, sf_dir):
    """WIN-10, JN-5: each completed run and the one before of the same set."""
    return W.previous(_runs(spark, sf_dir), by=["company_id", "set_key"], order=["created_at", "run_id"], value="run_id").drop("created_at")


def applicability_latest(spark, sf_dir):
    """WIN-2, FIL-13: the last decision per account and code, split into assessed and excluded."""
    last = W.latest(_events(spark, sf_dir), by=["user_id", "event_type"], order=["ts", "event_id"], value=["event_id", "value"])
    return last.select("user_id", "event_type", "event_id", F.when(F.col("value") >= 40, "assessed").otherwise("excluded").alias("split"))


def review_state_fold(spark, sf_dir):
    """WIN-3: reviews folded to a state."""
    decision = F.when(F.col("role") == "assistant", "accept").when(F.col("role") == "system", "override").otherwise("comment")
    return W.fold_reviews(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("finding_id"), F.col("turn").alias("seq"), decision.alias("decision")))


def review_queue_anti(spark, sf_dir):
    """JN-20, SRT-5: findings that nobody overrode, longest first."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    decided = turns.filter("role = 'system'").select("conv_id").distinct()
    open_ = turns.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_chars")).join(decided, "conv_id", "left_anti")
    return open_.orderBy(F.desc("n_chars"), "conv_id").limit(10)


def company_card(spark, sf_dir):
    """AGG-12, AGG-13: counts of a customer's documents."""
    orders = table(spark, sf_dir, "orders")
    grouped = orders.groupBy("o_custkey").agg(
        F.count("*").alias("documents"), F.count_if(F.col("o_orderstatus") == "F").alias("ready"),
        F.array_join(F.array_sort(F.collect_set(F.year("o_orderdate").cast("string"))), ",").alias("periods"),
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    joined = customers.join(grouped, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "c_name", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("ready", F.lit(0)).alias("ready"), F.coalesce("periods", F.lit("")).alias("periods"))


def usage_month_to_date(spark, sf_dir):
    """AGG-3, SCL-40, STR-2: usage since the start of the month."""
    return W.usage_month_to_date(_events(spark, sf_dir), AS_OF)


def usage_summary_pivot(spark, sf_dir):
    """AGG-4: one column per kind of usage."""
    return W.usage_pivot(_events(spark, sf_dir), KINDS)


def plan_limit_check(spark, sf_dir):
    """DOM-23, AGG-2: which accounts have reached their plan's limits."""
    plans = spark.createDataFrame(W.PLANS, "plan string, companies int, documents int, pages int, runs int")
    name = F.element_at(F.array(*[F.lit(p[0]) for p in W.PLANS]), (F.col("user_id") % 3 + 1).cast("int"))
    used = _events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("event_type") == "signup").alias("companies_used"), F.count_if(F.col("event_type") == "click").alias("documents_used"), F.count_if(F.col("event_type") == "view").alias("runs_used"))
    joined = used.withColumn("plan", name).join(F.broadcast(plans), "plan")
    over = [F.when(F.coalesce(F.col(f"{c}_used") >= F.col(c), F.lit(False)), F.lit(c)) for c in ("companies", "documents", "runs")]
    return joined.select("user_id", "plan", F.array_join(F.array_compact(F.array(*over)), ",").alias("reached"))


def rate_limit_window(spark, sf_dir):
    """STR-1: events of the same account within the hour before, and whether a limit of three is passed."""
    counted = W.window_counts(_events(spark, sf_dir).select("event_id", "ts", "user_id"), 3600)
    return counted.select("event_id", "user_id", "in_window", (F.col("in_window") > 3).alias("limited"))


def audit_json_fields(spark, sf_dir):
    """SCL-39, JN-22, SRT-9: JSON fields of events beside their account's name, the last 500."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    rows = _events(spark, sf_dir).join(customers, F.col("user_id") == F.col("c_custkey"), "left")
    field = F.get_json_object("props", "$.k").cast("long")
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", "event_type", F.coalesce("c_name", F.lit("unknown")).alias("name"), field.alias("k"))


def _judged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", (F.regexp_count("text", F.lit(r"[#*$%&|<>]")) * 20 > F.length("text")).alias("predicted_bad"))
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("bad"))
    return labels.join(docs, "doc_id")


def answer_validation(spark, sf_dir):
    """DOM-10: turns of conversations stand for model answers of five forms: out of range, cut off, of unknown status, sound, and no JSON at all."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), F.concat(F.lit("R"), (F.col("conv_id") % 4 + 1).cast("string")).alias("code"), "text")
    whole = '{"status":"supported","confidence":1.5,"evidence_ids":["p2","x","p1","p2"],"element_judgements":[{"key":"total","verdict":"yes","evidence_ids":["p2","y"]},{"key":"nope"}]}'
    way = F.col("answer_id") % 5
    raw = F.when(way == 0, whole).when(way == 1, whole[:40]).when(way == 2, '{"status":"odd","confidence":"0.25"}').when(way == 3, '{"confidence":-1,"status":"not_found","evidence_ids":["p2"],"requires_human_review":true}').otherwise(F.col("text"))
    elements = spark.createDataFrame([("R1", "total"), ("R2", "total"), ("R3", "other")], "code string, element string")
    both = F.when(F.col("answer_id") % 2 == 0, F.array(F.lit("p1"), F.lit("p2"))).otherwise(F.array(F.lit("p1")))
    found = validated_answers(turns.select("answer_id", "code", raw.alias("raw")), elements, turns.select("answer_id", F.explode(both).alias("passage_id")))
    told = F.array_join(F.transform("judgements", lambda j: F.concat_ws(":", j["element"], j["verdict"], F.array_join(j["evidence_ids"], "+"))), ",")
    return found.select("answer_id", "parsed", "status", "confidence", "requires_human_review", F.array_join("evidence_ids", ",").alias("evidence_ids"), told.alias("judgements"), *[F.array_join(c, ",").alias(c) for c in ("invalid_ids", "unknown_elements")])


def run_requests(spark, sf_dir):
    """DOM-20: a request of each customer for a run: whether it may start, and what speaks against it."""
    way = F.col("c_custkey") % 7
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    requests = customers.select(
        F.col("c_custkey").alias("request_id"), F.col("c_custkey").alias("company_id"), F.when(way == 0, "none@1").otherwise("core@2.1").alias("set_id"), F.when(way == 1, "guess").when(way == 2, "hybrid").otherwise("rules").alias("mode"),
        F.when(way == 3, "sometime").otherwise("FY1997").alias("period"),
    )
    companies = customers.select(F.col("c_custkey").alias("company_id"), F.when(F.col("c_custkey") % 2 == 0, "12-31").otherwise("03-31").alias("fiscal_year_end"))
    state = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderkey") % 11 == 0, "processing").otherwise("failed")
    documents = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("document_id"), state.alias("status"))
    usage = _events(spark, sf_dir).groupBy(F.col("user_id").alias("company_id")).agg(F.count("*").alias("used")).withColumn("allowed", F.lit(12))
    sets = spark.createDataFrame([("core@2.1",)], "set_id string")
    found = W.requested_runs(requests, companies, documents, sets, usage)
    return found.select("request_id", "accepted", F.coalesce("reason", F.lit("")).alias("reason"), F.col("period_start").cast("string").alias("period_start"), F.col("period_end").cast("string").alias("period_end"))


def eval_prf(spark, sf_dir):
    """AGG-21: precision, recall and F1 of a symbol rule against the quality labels."""
    return _judged(spark, sf_dir).agg(*W.precision_recall(F.col("predicted_bad"), F.col("bad")))


def eval_confusion(spark, sf_dir):
    """AGG-23: gold against predicted."""
    return _judged(spark, sf_dir).groupBy("bad", "predicted_bad").agg(F.count("*").alias("n"))


def eval_accuracy_by_group(spark, sf_dir):
    """AGG-22, AGG-24: accuracy by source and language."""
    right = F.col("bad") == F.col("predicted_bad")
    return _judged(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_if(right).alias("right"), F.round(F.count_if(right) / F.count("*"), 6).alias("accuracy"))


def citation_validation(spark, sf_dir):
    """AGG-25, DOM-10: cited documents of each conversation and those that don't exist in German."""
    turns = table(spark, sf_dir, "conversations")
    cited = turns.groupBy("conv_id").agg(F.collect_set((F.col("conv_id") * 7 + F.col("turn") * 3) % 1000).alias("ids"))
    valid = table(spark, sf_dir, "documents").filter("lang <> 'de'").select(F.col("doc_id").alias("id"))
    return W.citation_check(cited, valid, by="conv_id", ids="ids")


QUERIES = {
    f.__name__: f
    for f in (
        latest_run, previous_run, applicability_latest, review_state_fold, review_queue_anti, company_card, usage_month_to_date, usage_summary_pivot, plan_limit_check,
        rate_limit_window, audit_json_fields, answer_validation, run_requests, eval_prf, eval_confusion, eval_accuracy_by_group, citation_validation,
    )
}

_RUNS = "runs AS (SELECT o_custkey AS company_id, o_orderpriority AS set_key, o_orderdate AS created_at, o_orderkey AS run_id FROM orders WHERE o_orderstatus = 'F')"
_JUDGED = "judged AS (SELECT source, lang, quality = 0 AS bad, len(regexp_extract_all(text, '[#*$%&|<>]')) * 20 > length(text) AS predicted_bad FROM labels JOIN documents USING (doc_id))"
_LAST = "QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY {order}) = 1"
ORACLES = {
    "latest_run": f"WITH {_RUNS} SELECT company_id, run_id, set_key FROM runs " + _LAST.format(by="company_id", order="created_at DESC, run_id DESC"),
    "previous_run": f"WITH {_RUNS} SELECT company_id, set_key, run_id, lag(run_id) OVER (PARTITION BY company_id, set_key ORDER BY created_at, run_id) AS previous_run_id FROM runs",
    "applicability_latest": "SELECT user_id, event_type, event_id, CASE WHEN value >= 40 THEN 'assessed' ELSE 'excluded' END AS split FROM events " + _LAST.format(by="user_id, event_type", order="ts DESC, event_id DESC"),
    "review_state_fold": """SELECT conv_id AS finding_id, coalesce(max_by(CASE role WHEN 'assistant' THEN 'accept' ELSE 'override' END, turn) FILTER (role IN ('assistant', 'system')), 'unreviewed') AS state,
  count(*) FILTER (role NOT IN ('assistant', 'system')) AS comments, count(*) AS reviews FROM conversations GROUP BY conv_id""",
    "review_queue_anti": """SELECT conv_id, sum(length(text))::BIGINT AS n_chars FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')
GROUP BY conv_id ORDER BY n_chars DESC, conv_id LIMIT 10""",
    "company_card": """SELECT c_custkey, c_name, count(o_orderkey) AS documents, count(*) FILTER (o_orderstatus = 'F') AS ready, coalesce(string_agg(DISTINCT year(o_orderdate)::VARCHAR, ',' ORDER BY year(o_orderdate)::VARCHAR), '') AS periods
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL""",
    "usage_month_to_date": f"""SELECT user_id, event_type, sum(round(value * 100)::BIGINT)::BIGINT AS cents, count(*) AS n FROM events
WHERE ts >= date_trunc('month', TIMESTAMP '{AS_OF}') AND ts < TIMESTAMP '{AS_OF}' GROUP BY ALL""",
    "usage_summary_pivot": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in KINDS) + " FROM events GROUP BY user_id",
    "plan_limit_check": """WITH u AS (SELECT user_id, ['explorer', 'professional', 'enterprise'][user_id % 3 + 1] AS plan, count(*) FILTER (event_type = 'signup') AS c, count(*) FILTER (event_type = 'click') AS d, count(*) FILTER (event_type = 'view') AS r FROM events GROUP BY user_id)
SELECT user_id, plan, concat_ws(',', CASE WHEN c >= mc THEN 'companies' END, CASE WHEN d >= md THEN 'documents' END, CASE WHEN r >= mr THEN 'runs' END) AS reached
FROM u JOIN (VALUES ('explorer', 3, 10, 15), ('professional', 50, 500, 300), ('enterprise', NULL, NULL, NULL)) p(plan, mc, md, mr) USING (plan)""",
    "rate_limit_window": """WITH w AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '3599999999 microseconds' PRECEDING AND CURRENT ROW) AS in_window FROM events)
SELECT event_id, user_id, in_window, in_window > 3 AS limited FROM w""",
    "audit_json_fields": """SELECT event_id, event_type, coalesce(c_name, 'unknown') AS name, json_extract_string(props, '$.k')::BIGINT AS k
FROM events LEFT JOIN customer ON user_id = c_custkey ORDER BY ts DESC, event_id DESC LIMIT 500""",
    "eval_prf": f"""WITH {_JUDGED}, c AS (SELECT count(*) FILTER (predicted_bad AND bad) AS tp, count(*) FILTER (predicted_bad AND NOT bad) AS fp, count(*) FILTER (NOT predicted_bad AND bad) AS fn FROM judged),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END AS r FROM c)
SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0e0 END, 6) AS f1 FROM p""",
    "eval_confusion": f"WITH {_JUDGED} SELECT bad, predicted_bad, count(*) AS n FROM judged GROUP BY ALL",
    "run_requests": """WITH d AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS ready, array_to_string(list_sort(list(o_orderkey::VARCHAR) FILTER (o_orderstatus <> 'F' AND o_orderkey % 11 = 0))[1:3], ', ') AS pending FROM orders GROUP BY o_custkey),
u AS (SELECT user_id, count(*) AS used FROM events GROUP BY user_id),
t AS (SELECT c_custkey AS c, CASE c_custkey % 7 WHEN 0 THEN 'unknown requirement set' WHEN 1 THEN 'unknown mode' WHEN 2 THEN 'no model is configured' WHEN 3 THEN 'period not understood: sometime'
    ELSE CASE WHEN n IS NULL THEN 'no documents' WHEN pending IS NOT NULL THEN 'still in progress: ' || pending WHEN ready = 0 THEN 'no document is ready' WHEN used >= 12 THEN 'no runs left' ELSE '' END END AS reason
  FROM customer LEFT JOIN d ON o_custkey = c_custkey LEFT JOIN u ON user_id = c_custkey)
SELECT c AS request_id, reason = '' AS accepted, reason, CASE WHEN reason = '' THEN CASE WHEN c % 2 = 0 THEN '1997-01-01' ELSE '1996-04-01' END END AS period_start, CASE WHEN reason = '' THEN CASE WHEN c % 2 = 0 THEN '1997-12-31' ELSE '1997-03-31' END END AS period_end FROM t""",
    "answer_validation": """WITH t AS (SELECT conv_id * 100 + turn AS answer_id, conv_id % 4 + 1 AS r, (conv_id * 100 + turn) % 2 = 0 AS two FROM conversations)
SELECT answer_id, answer_id % 5 IN (0, 2, 3) AS parsed, CASE answer_id % 5 WHEN 0 THEN 'supported' WHEN 3 THEN 'not_found' ELSE 'human_review' END AS status,
  CASE answer_id % 5 WHEN 0 THEN 1e0 WHEN 2 THEN 25e-2 WHEN 3 THEN 0e0 ELSE 5e-1 END AS confidence, answer_id % 5 = 3 AS requires_human_review,
  CASE answer_id % 5 WHEN 0 THEN CASE WHEN two THEN 'p2,p1' ELSE 'p1' END WHEN 3 THEN CASE WHEN two THEN 'p2' ELSE '' END ELSE '' END AS evidence_ids,
  CASE WHEN answer_id % 5 = 0 AND r <= 2 THEN 'total:yes:' || CASE WHEN two THEN 'p2' ELSE '' END ELSE '' END AS judgements,
  CASE answer_id % 5 WHEN 0 THEN CASE WHEN two THEN '' ELSE 'p2,p2,' || CASE WHEN r <= 2 THEN 'p2,' ELSE '' END END || 'x' || CASE WHEN r <= 2 THEN ',y' ELSE '' END WHEN 3 THEN CASE WHEN two THEN '' ELSE 'p2' END ELSE '' END AS invalid_ids,
  CASE WHEN answer_id % 5 = 0 THEN CASE WHEN r <= 2 THEN 'nope' ELSE 'nope,total' END ELSE '' END AS unknown_elements FROM t""",
    "eval_accuracy_by_group": f"WITH {_JUDGED} SELECT source, lang, count(*) AS n, count(*) FILTER (bad = predicted_bad) AS \"right\", round(count(*) FILTER (bad = predicted_bad) / count(*), 6) AS accuracy FROM judged GROUP BY ALL",
    "citation_validation": """WITH c AS (SELECT DISTINCT conv_id, (conv_id * 7 + turn * 3) % 1000 AS id FROM conversations), f AS (SELECT conv_id, id, id IN (SELECT doc_id FROM documents WHERE lang <> 'de') AS ok FROM c)
SELECT conv_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS cited, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (NOT ok), '') AS invalid, round(1 - count(*) FILTER (NOT ok) / count(*), 3) AS valid_share
FROM f GROUP BY conv_id""",
}
