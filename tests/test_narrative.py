"""Findings in words, and prompts."""

from cairnlake.operators.narrative import prompts, rationales

ELEMENTS = "company_id long, code string, ordinal int, element string, label string, weight double, status string, weak boolean"
DIFFER = "company_id long, code string, metric_key string, low_value double, high_value double, unit string, spread double, low_passage string, high_passage string"


def test_rationales_and_prompts(spark):
    found = spark.createDataFrame([(1, "A", "conflicting", 0.5), (1, "B", "not_found", 0.0), (1, "C", "supported", 1.0), (1, "D", "human_review", 0.5), (1, "E", "human_review", 0.0)], "company_id long, code string, status string, completeness double")
    elements = spark.createDataFrame([(1, "A", 0, "a", "GHG total", 1.0, "satisfied", True), (1, "A", 1, "b", "Scope", 1.0, "missing", False), (1, "B", 0, "a", "Value", 1.0, "missing", False), (1, "C", 0, "a", "Value", 2.0, "satisfied", False), (1, "C", 1, "b", "Market", 1.0, "not_applicable", False), (1, "D", 0, "a", "Value", 1.0, "satisfied", False), (1, "D", 1, "b", "Other", 1.0, "missing", False), (1, "E", 0, "a", "Value", 1.0, "missing", False)], ELEMENTS)
    differ = spark.createDataFrame([(1, "A", "m", 0.5, 1234.0, "t", 0.0512, "p1", "p2")], DIFFER)
    related = spark.createDataFrame([(1, "B", "x"), (1, "B", "y")], "company_id long, code string, passage_id string")
    told = {r["code"]: r["rationale"] for r in rationales(found, elements, differ, related).collect()}
    assert told == {
        "A": "Sources differ on m: 0.5 t and 1,234 t, 5.1 % apart. A reviewer has to say which value holds. Missing: scope. Weaker evidence: GHG total.",
        "B": "None of the elements was found, which doesn't prove that they don't exist. Related passages: 2.",
        "C": "All 1 applicable elements are evidenced. Not applicable: market.",
        "D": "1 of 2 applicable elements are evidenced (50 % of the weight). Missing: other.",
        "E": "Missing: value.",
    }
    passages = spark.createDataFrame([(f"p{k}", k, 1, f"some\n  text {k} " + "x" * (900 if k == 2 else 0)) for k in range(1, 20)] + [("none", 1, 1, None)], "passage_id string, document_id long, page int, text string")
    candidates = spark.createDataFrame([(1, "A", f"p{k}", k) for k in range(1, 20)] + [(1, "B", "none", 1)], "company_id long, code string, passage_id string, place long")
    requirements = spark.createDataFrame([(c, f"Title {c}", "sum") for c in "ABCDE"], "code string, title string, summary string")
    made = {r["code"]: r for r in prompts(requirements, elements, differ, candidates, passages, "FY1").collect()}
    assert made["A"]["n_passages"] == 12 and "- m: 0.5 [p1] and 1,234 [p2]" in made["A"]["prompt"] and '[p1] document 1, p.1\n"some text 1"' in made["A"]["prompt"]
    assert "x" * 588 + '…"' in made["A"]["prompt"] and "x" * 589 not in made["A"]["prompt"] and "[p13]" not in made["A"]["prompt"]
    assert made["B"]["n_passages"] == 0 and "VALUES THAT DIFFER\n- none\nPASSAGES\n- none" in made["B"]["prompt"] and "- b | Market | 1.0 | not applicable" in made["C"]["prompt"] and "satisfied (weak)" in made["A"]["prompt"]
