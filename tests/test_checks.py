"""Catalogue files and nested checks."""

import json

import pytest

from cairnlake.operators.checks import evaluate
from cairnlake.sources.catalogue import flatten, packaged, parse, read_folder, validate


def catalogue(check, key="k", version="1.0"):
    return {"key": key, "version": version, "requirements": [{"code": "R", "title": "t", "elements": [{"key": "e", "label": "E", "weight": 1.0, "check": check}]}]}


METRIC = {"type": "metric", "metric_keys": ["a"], "weak_metric_keys": ["b"]}
PERIOD = {"type": "metric_period", "metric_keys": ["c"]}
PATTERN = {"type": "pattern", "patterns": ["board", "director"], "context": ["climate"]}
NESTED = {"type": "conditional", "when": {"type": "any_of", "checks": [PATTERN, PERIOD]}, "then": {"type": "any_of", "checks": [METRIC, {"type": "conditional", "when": METRIC, "then": PATTERN}, PERIOD]}}


def test_files_are_read_and_placed(spark, tmp_path):
    for key, version in (("b", "2.0"), ("a", "1.0")):
        (tmp_path / key).mkdir()
        (tmp_path / key / f"{version}.json").write_text(json.dumps(catalogue(NESTED, key, version)))
    found = read_folder(spark, str(tmp_path))
    assert [(c["key"], c["version"]) for c in found] == [("a", "1.0"), ("b", "2.0")] and found[0]["requirements"] == catalogue(NESTED)["requirements"]
    (tmp_path / "a" / "1.1.json").write_text(json.dumps(catalogue(NESTED, "a", "1.0")))
    with pytest.raises(ValueError, match="place must be"):
        read_folder(spark, str(tmp_path))
    assert packaged()[0]["key"] == "sample-set"


@pytest.mark.parametrize(
    "check, text",
    [
        ({"type": "metric"}, "needs metric_keys"), ({"type": "pattern"}, "needs patterns"), ({"type": "any_of", "checks": []}, "needs checks"), ({"type": "conditional", "when": METRIC}, "needs when and then"),
        ({"type": "other"}, "unknown check type"), ({"type": "any_of", "checks": [{"type": "pattern", "patterns": ["("]}]}, "is no regular expression"),
    ],
)
def test_faulty_checks_are_refused(check, text):
    with pytest.raises(ValueError, match=text):
        validate(check, "x")
    twice = catalogue(METRIC)
    twice["requirements"][0]["elements"] *= 2
    with pytest.raises(ValueError, match="repeats an element"):
        parse(json.dumps(twice), "k/1.0.json")


def test_nested_checks(spark):
    """Company 1: strong value; 2: weak value only; 3: condition not met; 4: nothing below the condition; 5: period stated; 6: no rows; 7: other periods."""
    nodes = flatten([catalogue(NESTED)])
    assert [(n.type, n.parent, n.role, n.depth) for n in nodes][:4] == [("conditional", None, "root", 0), ("any_of", 0, "when", 1), ("pattern", 1, "checks", 2), ("metric_period", 1, "checks", 2)]
    passages = [(c, f"p{c}{k}", k, t, kind, "Climate") for c in (1, 2, 4, 7) for k, (t, kind) in enumerate([("The board", "heading"), ("The Board meets", "paragraph"), ("Directors met; the board", "list_item"), ("board", "paragraph")])]
    passages += [(3, "p30", 0, "The board", "paragraph", "Other")]
    facts = [
        (1, "a", "m1", "q1", 5.0, "t", "FY1", False, False, "text", 90), (1, "a", "m2", "q2", 1234.5, "t", "FY1", False, False, "table", 80), (1, "a", "m3", "q2", 6.0, "t", "FY1", True, False, "text", 99),
        (2, "b", "m4", "q3", 0.25, None, "FY1", True, False, "text", 90), (2, "a", "m5", "q4", 1.0, "t", "FY1", True, True, "table", 99), (4, "a", "m6", "q5", 1.0, "t", "FY1", True, True, "table", 99),
        (5, "c", "m7", "q6", 1.0, "t", "FY1", True, False, "table", 99), (5, "c", "m8", "q7", 1.0, "t", "FY1", False, False, "text", 50), (7, "a", "m9", "q8", 1.0, "t", "FY0", False, False, "text", 50), (7, "b", "m10", "q8", 1.0, "t", None, False, False, "text", 50),
    ]
    frames = {
        "facts": spark.createDataFrame(facts, "company_id long, metric_key string, metric_id string, passage_id string, value double, unit string, period_label string, inferred boolean, base_year boolean, method string, confidence_pct long"),
        "passages": spark.createDataFrame(passages, "company_id long, passage_id string, ordinal long, text string, kind string, section string"),
        "relevance": spark.createDataFrame([(1, "R", "p13", 0.5)], "company_id long, code string, passage_id string, score double"),
    }
    companies = spark.createDataFrame([(k,) for k in range(1, 8)], "company_id long")
    found = {r["company_id"]: r for r in evaluate(companies, nodes, period="FY1", **frames).collect()}
    assert {k: (r["status"], r["weak"]) for k, r in found.items()} == {
        1: ("satisfied", False), 2: ("satisfied", False), 3: ("not_applicable", False), 4: ("missing", False), 5: ("satisfied", False), 6: ("not_applicable", False), 7: ("missing", False),
    }
    assert (found[1]["passages"], found[1]["context"], found[1]["metrics"]) == (["q2", "q1"], ["p13", "p11"], ["m2", "m3", "m1"])
    assert found[1]["note"].startswith("1,234 t for FY1 (q2); it applies as the documents say: “board”")
    # the weak value loses against the pattern below it, which is satisfied and not weak
    assert found[2]["passages"] == ["p21", "p22", "p23"] and found[2]["metrics"] == []
    assert found[5]["passages"] == ["q7"] and found[5]["context"] == ["q7"] and "is stated with the value" in found[5]["note"]
    assert found[7]["note"].startswith("values for other periods only: FY0, unknown period") and found[4]["note"].startswith("no value in the documents")
    assert found[3]["note"].startswith("not applicable") and found[7]["passages"] == []


def test_leaves_alone_and_without_sources(spark):
    nodes = flatten([catalogue(METRIC)])
    companies = spark.createDataFrame([(1,)], "company_id long")
    assert [(r["status"], r["note"]) for r in evaluate(companies, nodes).collect()] == [("missing", "no value in the documents")]
    assert evaluate(companies.limit(0), nodes).count() == 0
