"""Model answers as JSON text, read without trusting their form: wrong types, missing fields and unknown ids are told apart, never fatal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses that an answer may give, and lengths that texts are cut to (fixed values).
STATUSES = ("supported", "partially_supported", "not_found", "conflicting", "human_review")
NOTE, RATIONALE, MISSING = 400, 1200, 12


def _text(value: Column, path: str) -> Column:
    """A scalar at a path as text; null for anything else, or if it isn't there."""
    return F.try_variant_get(value, path, "string")


def _list(value: Column, path: str) -> Column:
    """An array at a path; empty if there is none."""
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))


def validated_answers(answers: DataFrame, elements: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per answer (answer_id, code, raw) with what of it holds up.

    status: an unknown one is human_review; confidence: a number or text of one, held to [0, 1], else 0.5; evidence_ids: known candidates
    (answer_id, passage_id) in their order, each once; judgements: of known elements (code, element), the last of several, with verdict
    (unclear if there is none), their own known ids and note; unknown_elements and invalid_ids: what was left out, sorted, with
    repeats; parsed: whether the text was a JSON object. An answer of another form has the defaults.
    """
    value = F.try_parse_json("raw")
    read = answers.select("answer_id", "code", F.when(F.schema_of_variant(value).startswith("OBJECT"), value).alias("v"))
    v = F.col("v")
    number = _text(v, "$.confidence").try_cast("double")
    sure = F.when(number.isNotNull() & ~F.isnan(number), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))).otherwise(0.5)
    said = F.when(_text(v, "$.status").isin(*STATUSES), _text(v, "$.status")).otherwise("human_review")
    head = read.select(
        "answer_id", "code", v.isNotNull().alias("parsed"), said.alias("status"), sure.alias("confidence"), F.coalesce(F.try_variant_get(v, "$.requires_human_review", "boolean"), F.lit(False)).alias("requires_human_review"),
        F.substring(F.coalesce(_text(v, "$.rationale"), F.lit("")), 1, RATIONALE).alias("rationale"), F.slice(F.transform(_list(v, "$.missing_elements"), lambda m: _text(m, "$")), 1, MISSING).alias("missing_elements"),
    )
    # ids: those of the answer (place -1) and of each judgement
    judged = read.select("answer_id", "code", F.posexplode(_list(v, "$.element_judgements")).alias("at", "j"))
    judged = judged.select("answer_id", "code", "at", _text(F.col("j"), "$.key").alias("element"), _text(F.col("j"), "$.verdict").alias("verdict"), F.substring(F.coalesce(_text(F.col("j"), "$.note"), F.lit("")), 1, NOTE).alias("note"), _list(F.col("j"), "$.evidence_ids").alias("ids"))
    known = judged.join(elements.select("code", "element").distinct().withColumn("known", F.lit(True)), ["code", "element"], "left")
    last = F.max(F.when(F.col("known"), F.col("at")))
    ids = read.select("answer_id", F.lit(-1).alias("at"), F.posexplode(_list(v, "$.evidence_ids")).alias("k", "id"))
    ids = ids.unionByName(known.filter("known").select("answer_id", "at", F.posexplode("ids").alias("k", "id"))).withColumn("passage_id", _text(F.col("id"), "$")).drop("id")
    checked = ids.join(candidates.select("answer_id", "passage_id").distinct().withColumn("valid", F.lit(True)), ["answer_id", "passage_id"], "left")
    ordered = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("valid"), F.struct("k", "passage_id")))), lambda x: x["passage_id"]))
    sound = checked.groupBy("answer_id", "at").agg(ordered.alias("evidence_ids"))
    bad = checked.filter("valid IS NULL").groupBy("answer_id").agg(F.array_sort(F.collect_list(F.coalesce("passage_id", F.lit("null")))).alias("invalid_ids"))
    none = F.array().cast("array<string>")
    strange = known.filter("known IS NULL").groupBy("answer_id").agg(F.array_sort(F.collect_list(F.coalesce("element", F.lit("null")))).alias("unknown_elements"))
    lasts = known.groupBy("answer_id", "element").agg(last.alias("at")).filter("at IS NOT NULL")
    mine = known.join(lasts, ["answer_id", "element", "at"], "left_semi").join(sound, ["answer_id", "at"], "left")
    one = F.struct("element", F.coalesce("verdict", F.lit("unclear")).alias("verdict"), F.coalesce("evidence_ids", none).alias("evidence_ids"), "note")
    judgements = mine.groupBy("answer_id").agg(F.array_sort(F.collect_list(one)).alias("judgements"))
    whole = head.join(sound.filter("at = -1").drop("at"), "answer_id", "left")
    for part in (judgements, bad, strange):
        whole = whole.join(part, "answer_id", "left")
    empty = F.array().cast(judgements.schema["judgements"].dataType)
    return whole.withColumns({
        "evidence_ids": F.coalesce("evidence_ids", none), "judgements": F.coalesce("judgements", empty), "invalid_ids": F.coalesce("invalid_ids", none), "unknown_elements": F.coalesce("unknown_elements", none),
    })
