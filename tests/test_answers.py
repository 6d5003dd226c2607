"""Validation of model answers, and the sink that replaces documents."""

import json

from cairnlake.operators.answers import validated_answers
from cairnlake.streaming.sink import document_sink, replace_documents, stored


def test_answers_of_any_form(spark):
    good = {
        "status": "supported", "confidence": 1.7, "requires_human_review": True, "rationale": "r" * 2000, "evidence_ids": ["p1", "zz", "p1", 5, None, "p2"], "missing_elements": ["m"] * 20,
        "element_judgements": [
            {"key": "a", "verdict": "no", "evidence_ids": ["p1"]}, {"key": "a", "verdict": "yes", "evidence_ids": ["p2", "p2", "bad"], "note": "n" * 500}, {"key": "q", "verdict": "yes", "evidence_ids": ["nope"]},
            {"key": "b"}, "no object", {"verdict": "yes"},
        ],
    }
    raws = [json.dumps(good), '{"status": "supp', '{"status": "odd", "confidence": "0.25", "evidence_ids": "p1", "element_judgements": {"key": "a"}}', "[1, 2]", None, "", '{"confidence": [], "status": null, "requires_human_review": "yes"}', '{"confidence": -3, "status": "not_found"}', '{"confidence": "NaN"}', "null"]
    answers = spark.createDataFrame([(k, "R", r) for k, r in enumerate(raws)], "answer_id long, code string, raw string")
    elements = spark.createDataFrame([("R", "a"), ("R", "b"), ("S", "q")], "code string, element string")
    candidates = spark.createDataFrame([(0, "p1"), (0, "p2"), (0, "p2"), (2, "p1")], "answer_id long, passage_id string")
    found = {r["answer_id"]: r for r in validated_answers(answers, elements, candidates).collect()}
    assert len(found) == len(raws)
    first = found[0]
    assert (first["status"], first["confidence"], first["requires_human_review"], len(first["rationale"]), len(first["missing_elements"])) == ("supported", 1.0, True, 1200, 12)
    assert first["evidence_ids"] == ["p1", "p2"] and first["invalid_ids"] == ["5", "bad", "null", "zz"] and first["unknown_elements"] == ["null", "null", "q"]
    assert [(j["element"], j["verdict"], j["evidence_ids"], len(j["note"])) for j in first["judgements"]] == [("a", "yes", ["p2"], 400), ("b", "unclear", [], 0)]
    assert (found[2]["status"], found[2]["confidence"], found[2]["evidence_ids"], found[2]["judgements"]) == ("human_review", 0.25, [], [])
    assert [k for k in found if not found[k]["parsed"]] == [k for k in sorted(found) if k in (1, 3, 4, 5, 9)] or {k for k in found if not found[k]["parsed"]} == {1, 3, 4, 5, 9}
    assert all((found[k]["status"], found[k]["confidence"], found[k]["requires_human_review"]) == ("human_review", 0.5, False) for k in (1, 3, 4, 5, 8, 9))
    assert found[6]["confidence"] == 0.5 and (found[7]["status"], found[7]["confidence"]) == ("not_found", 0.0)


SCHEMA = "document_id long, version long, text string"


def rows(spark, path, name):
    return sorted(map(str, stored(spark, path, name).collect()))


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    first = spark.createDataFrame([(1, 1, "Scope 1 emissions were 5 tCO2e in FY2024.\nSame line\nSame line"), (2, 1, "Total energy was 3 MWh and total energy was 3 MWh."), (3, 1, "alone")], SCHEMA)
    replace_documents(first, path)
    before = rows(spark, path, "passages"), rows(spark, path, "metrics")
    assert len(before[0]) == 4 and len(before[1]) == 2
    replace_documents(first, path)
    assert (rows(spark, path, "passages"), rows(spark, path, "metrics")) == before
    replace_documents(spark.createDataFrame([(2, 2, "Water intake was 7 m3."), (2, 1, "old"), (3, 2, ""), (4, 1, None)], SCHEMA), path)
    kept = {(r["document_id"], r["metric_key"]) for r in stored(spark, path, "metrics").collect()}
    assert kept == {(1, "ghg_scope1"), (2, "water_withdrawal")} and {r["document_id"] for r in stored(spark, path, "passages").collect()} == {1, 2}


def test_the_stream_is_replayed_from_its_start(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame([(k, 1, f"Scope 1 emissions were {k} tCO2e in FY2024.") for k in range(1, 6)], SCHEMA).repartition(2).write.parquet(source)
    spark.createDataFrame([(5, 2, "Water intake was 7 m3."), (6, 1, "no value")], SCHEMA).write.mode("append").parquet(source)

    def run(checkpoint):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 10).parquet(source)
        document_sink(stream, path, f"file://{tmp_path}/{checkpoint}").awaitTermination()
        return rows(spark, path, "passages"), rows(spark, path, "metrics")

    once = run("one")
    assert len(once[0]) == 6 and len(once[1]) == 5
    assert run("one") == once  # nothing new
    assert run("two") == once  # all batches again, as after a lost checkpoint
