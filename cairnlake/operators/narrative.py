"""Findings in words: rationales out of their numbers, and the prompt that a model is given for one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_value

#: Passages of a prompt and characters of each (fixed values).
PASSAGES, CHARACTERS = 12, 600
_KEYS = ["company_id", "code"]


def _ordered(rows: DataFrame, order: list[str], text: Column, name: str) -> DataFrame:
    """One array of texts per finding, in order; a requirement has few."""
    listed = F.array_sort(F.collect_list(F.struct(*order, text.alias("text"))))
    return rows.groupBy(*_KEYS).agg(F.transform(listed, lambda x: x["text"]).alias(name))


def in_sentence(label: Column) -> Column:
    """A label within a sentence: a small first letter, but for acronyms."""
    return F.when(label.rlike("^[A-Z]{2}"), label).otherwise(F.concat(F.lower(F.substring(label, 1, 1)), F.substring(label, 2, 10_000)))


def rationales(found: DataFrame, elements: DataFrame, differences: DataFrame, related: DataFrame) -> DataFrame:
    """company_id, code and rationale of each finding (status, completeness): what differs, how much is evidenced, what is missing, weak or
    not applicable. `elements` has ordinal, label, status and weak; `differences` metric_key, low_value, high_value, unit and spread of
    conflicts; `related` passages that were found beside."""
    label = in_sentence(F.col("label"))
    counts = elements.groupBy(*_KEYS).agg(F.count_if(F.col("status") != "not_applicable").alias("applicable"), F.count_if(F.col("status") == "satisfied").alias("satisfied"))
    lists = [
        _ordered(elements.filter("status = 'missing'"), ["ordinal"], label, "missing_"), _ordered(elements.filter("status = 'satisfied' AND weak"), ["ordinal"], label, "weak_"),
        _ordered(elements.filter("status = 'not_applicable'"), ["ordinal"], label, "moot_"),
    ]
    shown = lambda c: F.concat(format_value(F.col(c)), F.lit(" "), F.col("unit"))
    told = F.concat(F.lit("Sources differ on "), F.col("metric_key"), F.lit(": "), shown("low_value"), F.lit(" and "), shown("high_value"), F.lit(", "), F.format_string("%.1f", F.col("spread") * 100), F.lit(" % apart."))
    lists.append(_ordered(differences, ["metric_key"], told, "differ_"))
    joined = found.join(counts, _KEYS, "left").join(related.groupBy(*_KEYS).agg(F.count("*").alias("related_")), _KEYS, "left")
    for part in lists:
        joined = joined.join(part, _KEYS, "left")
    percent = F.round(F.col("completeness") * 100).cast("long").cast("string")
    n, of = F.col("satisfied").cast("string"), F.col("applicable").cast("string")
    head = (
        F.when(F.col("status") == "conflicting", F.concat_ws(" ", F.array_join(F.coalesce("differ_", F.array().cast("array<string>")), " "), F.lit("A reviewer has to say which value holds.")))
        .when(F.col("status") == "supported", F.concat(F.lit("All "), of, F.lit(" applicable elements are evidenced.")))
        .when(F.col("satisfied") > 0, F.concat(n, F.lit(" of "), of, F.lit(" applicable elements are evidenced ("), percent, F.lit(" % of the weight).")))
        .when(F.col("status") == "not_found", F.concat(F.lit("None of the elements was found, which doesn't prove that they don't exist."), F.when(F.col("related_") > 0, F.concat(F.lit(" Related passages: "), F.col("related_").cast("string"), F.lit("."))).otherwise("")))
    )
    line = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}: "), F.array_join(c, "; "), F.lit(".")))
    missing = F.when(F.col("status") != "not_found", line("Missing", "missing_"))
    return joined.select(*_KEYS, F.concat_ws(" ", head, missing, line("Weaker evidence", "weak_"), line("Not applicable", "moot_")).alias("rationale"))


def prompts(requirements: DataFrame, elements: DataFrame, differences: DataFrame, candidates: DataFrame, passages: DataFrame, period: str) -> DataFrame:
    """company_id, code, n_passages and prompt: the requirement (code, title, summary), its elements with what the rules found, values that
    differ, and up to 12 candidates (passage_id, place) of 600 characters each. Passages without a text are left out."""
    said = F.when(F.col("status") == "missing", "not found").when(F.col("status") == "not_applicable", "not applicable").otherwise("satisfied")
    element = F.concat(F.lit("- "), F.col("element"), F.lit(" | "), F.col("label"), F.lit(" | "), F.format_string("%.1f", "weight"), F.lit(" | "), said, F.when(F.col("weak"), " (weak)").otherwise(""))
    differ = F.concat(F.lit("- "), F.col("metric_key"), F.lit(": "), format_value(F.col("low_value")), F.lit(" ["), F.col("low_passage"), F.lit("] and "), format_value(F.col("high_value")), F.lit(" ["), F.col("high_passage"), F.lit("]"))
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    cut = F.when(F.length(text) > CHARACTERS, F.concat(F.substring(text, 1, CHARACTERS), F.lit("…"))).otherwise(text)
    known = candidates.filter(F.col("place") <= PASSAGES).join(passages.filter("text IS NOT NULL"), "passage_id")
    quoted = F.concat(F.lit("["), F.col("passage_id"), F.lit("] document "), F.col("document_id").cast("string"), F.lit(", p."), F.col("page").cast("string"), F.lit("\n\""), cut, F.lit("\""))
    joined = _ordered(elements, ["ordinal"], element, "e").join(requirements.select("code", "title", "summary"), "code")
    for part in (_ordered(differences, ["metric_key"], differ, "d"), _ordered(known, ["place"], quoted, "p")):
        joined = joined.join(part, _KEYS, "left")
    none = F.array(F.lit("- none"))
    lines = F.concat(
        F.array(F.concat(F.lit("REQUIREMENT "), F.col("code"), F.lit(": "), F.col("title")), F.concat(F.lit("SUMMARY "), F.col("summary")), F.lit(f"PERIOD {period}"), F.lit("ELEMENTS (key | label | weight | result by rule)")), F.col("e"),
        F.array(F.lit("VALUES THAT DIFFER")), F.coalesce("d", none), F.array(F.lit("PASSAGES")), F.coalesce("p", none), F.array(F.lit("Answer in JSON and judge every element once.")),
    )
    return joined.select(*_KEYS, F.coalesce(F.size("p"), F.lit(0)).cast("long").alias("n_passages"), F.array_join(lines, "\n").alias("prompt"))
