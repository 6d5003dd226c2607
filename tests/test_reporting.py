"""Composite views of runs, on small tables."""

import json

from pyspark.sql import functions as F

from cairnlake.functions import text
from cairnlake.operators import assessment as A
from cairnlake.operators import passages as P
from cairnlake.operators import reporting as R
from cairnlake.operators.retrieval import bm25, requirement_queries
from cairnlake.plans import report_queries
from cairnlake.sources import facts


def small(spark):
    found = spark.createDataFrame([(1, "B", 0.5, 0.8, "partially_supported", True, "x"), (1, "A", 1.0, 0.9, "supported", False, "")], "company_id long, code string, completeness double, confidence double, status string, requires_review boolean, missing string")
    requirements = spark.createDataFrame([("A", 1, "First"), ("B", 2, "Second")], "code string, ordinal int, title string")
    reviews = spark.createDataFrame([(1, "B", 1, "accept", None), (1, "B", 2, "override", "supported"), (1, "B", 3, "comment", None)], "company_id long, code string, seq int, decision string, new_status string")
    links = spark.createDataFrame([(1, "B", "p2", "related", 1, ""), (1, "B", "p1", "supporting", 2, "e"), (1, "A", "gone", "supporting", 1, "e")], "company_id long, code string, passage_id string, role string, rank long, elements string")
    passages = spark.createDataFrame([("p1", 7, 3, "t" * 300), ("p2", 8, 4, "u")], "passage_id string, document_id long, page int, text string")
    return found, requirements, reviews, links, passages


def test_run_findings_and_exports(spark):
    found, requirements, reviews, links, passages = small(spark)
    rows = R.run_findings(found, requirements, reviews, links, passages)
    a, b = rows.orderBy("ordinal").collect()
    assert (b["effective_status"], b["review_state"], b["reviews"], b["passage_id"], b["document_id"], len(b["primary_text"]), b["n_evidence"]) == ("supported", "override", 3, "p1", 7, 240, 1)
    assert (a["effective_status"], a["review_state"], a["passage_id"], a["document_id"]) == ("supported", "unreviewed", "gone", None)
    assert R.filtered_findings(rows, review="needed").count() == 0 and R.filtered_findings(rows, review="override").count() == 1
    assert R.explorer_filter(rows.withColumn("topic", F.lit("t")), view="gaps").count() == 0
    elements = spark.createDataFrame([(1, "A", 0, "e", "satisfied", False), (1, "B", 1, "f", "missing", False), (1, "B", 0, "e", "satisfied", True)], "company_id long, code string, ordinal int, element string, status string, weak boolean")
    actions = spark.createDataFrame([(1, "B", "missing:x", 0.35, "open"), (1, "B", "review", 0.5, "done")], "company_id long, code string, gap_key string, priority double, action_status string")
    documents = spark.createDataFrame([(1, 8), (1, 7), (1, 7)], "company_id long, document_id long")
    run = {"id": "r1", "title": "assessment", "set": "s@1", "period": "FY1", "mode": "rules"}
    package = json.loads(R.evidence_package(rows, elements, links, reviews, passages, documents, actions, run=run).first()["package"])
    assert [f["code"] for f in package["findings"]] == ["A", "B"] and package["limitations"] == R.LIMITATIONS and package["documents"] == [7, 8] and package["run"] == run
    second = package["findings"][1]
    assert [e["element"] for e in second["elements"]] == ["e", "f"] and [(e["passage_id"], e["page"], e["text"][:1]) for e in second["evidence"]] == [("p2", 4, "u"), ("p1", 3, "t")] and [r["decision"] for r in second["reviews"]] == ["accept", "override", "comment"]
    assert package["findings"][0]["evidence"] == [] and [a["gap_key"] for a in package["actions"]] == ["review", "missing:x"] and second["rationale"].startswith("Partially supported: 50 %")
    report = R.markdown_report(rows.withColumn("priority", F.lit(0.35)), links, actions, passages, run=run).first()["report"]
    assert report.startswith("# Company 1 — assessment\n") and "| B Second | Partially supported | 50% | 0.35 |" in report and f"- *supporting* — 7, p.3: “{'t' * 220}”" in report
    assert "1. **missing:x** (B, priority 0.35, open)" in report and report.endswith(R.LIMITATIONS[-1])
    cited = elements.withColumn("passages", F.when(F.col("element") == "e", F.array(F.lit("p1"))).otherwise(F.array())).withColumn("context", F.array(F.lit("p2"), F.lit("unknown")))
    history = spark.createDataFrame([(1, "A", f"r{k:02}", "supported", 1.0, k) for k in range(15)], "company_id long, code string, run_id string, status string, completeness double, created_at long")
    trails = {r["code"]: json.loads(r["trail"]) for r in R.finding_trails(rows, cited, links, passages, reviews, actions, history).collect()}
    assert [p["passage_id"] for p in trails["A"]["also_cited"]] == ["p1", "p2"] and trails["A"]["evidence"] == [] and [h["run_id"] for h in trails["A"]["history"]] == [f"r{k:02}" for k in range(14, 2, -1)]
    assert trails["B"]["also_cited"] == [] and [a["gap_key"] for a in trails["B"]["actions"]] == ["review", "missing:x"] and trails["B"]["history"] == []
    line = R.export_rows(rows.withColumn("priority", F.lit(0.35)), requirement_set="s@1", run_id=F.lit(5)).filter("requirement = 'B'").first()
    assert len(line) == 15 and line["primary_source"] == "Document 7 p.3" and line["rationale"] == "Partially supported: 50 % of the applicable elements are established by 1 passage. Missing: x."


def test_writing_a_run_twice_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 3)], "run_id int, code string, v int")
    path = f"file://{tmp_path}/findings"
    R.write_run(rows, path)
    R.write_run(rows.filter("run_id = 1 AND code = 'a'"), path)
    again = sorted((r["run_id"], r["code"]) for r in spark.read.parquet(path).collect())
    assert again == [(1, "a"), (2, "a")]
    R.write_run(rows.filter("run_id = 1 AND code = 'a'"), path)
    assert sorted((r["run_id"], r["code"]) for r in spark.read.parquet(path).collect()) == again


def test_merge_makes_status_and_confidence_anew(spark):
    found = spark.createDataFrame([(k, "R", "not_found" if k != 4 else "conflicting", 0.6, False) for k in range(1, 6)], "company_id long, code string, status string, confidence double, requires_review boolean")
    merged = spark.createDataFrame([(k, "R", 1.0, "satisfied" if k == 2 else "missing", None) for k in range(1, 6)], "company_id long, code string, weight double, status string, reason string")
    models = spark.createDataFrame([(1, "R", "partially_supported", 0.8, False, 1), (2, "R", "not_found", 0.7, False, 0), (3, "R", "not_found", 0.3, True, 0), (4, "R", "supported", 0.2, True, 0)], "company_id long, code string, model_status string, model_confidence double, wants_review boolean, n_evidence int")
    rows = {r["company_id"]: (r["status"], r["confidence"], r["requires_review"]) for r in A.merged_findings(found, merged, models).collect()}
    assert rows == {1: ("partially_supported", 0.7, False), 2: ("human_review", 0.55, True), 3: ("human_review", 0.38, True), 4: ("conflicting", 0.34, True), 5: ("not_found", 0.6, False)}


def test_document_changes(spark):
    docs = "company_id long, lineage_id long, document_id long, version long, sha256 string"
    old, new = spark.createDataFrame([(1, 1, 10, 1, "a"), (1, 2, 20, 1, "b"), (1, 3, 30, 1, "c")], docs), spark.createDataFrame([(1, 1, 11, 2, "x"), (1, 3, 30, 1, "c"), (1, 4, 40, 1, "d")], docs)
    assert {r["lineage_id"]: (r["change"], r["before_version"], r["after_version"]) for r in A.document_changes(old, new).collect()} == {1: ("replaced", 1, 2), 2: ("removed", None, None), 4: ("added", None, None)}


def test_related_candidates_and_dependencies(spark):
    links = spark.createDataFrame([(1, "R", "p1")], "company_id long, code string, passage_id string")
    hits = spark.createDataFrame([(1, "R", f"p{k}", k) for k in range(1, 7)], "company_id long, code string, passage_id string, rank long")
    assert [r["passage_id"] for r in A.related_passages(hits, links).orderBy("place").collect()] == ["p2", "p3", "p4"]
    elements = spark.createDataFrame([(1, "R", 0, ["a", "b", "c"]), (1, "R", 1, ["b", "d"])], "company_id long, code string, ordinal int, passages array<string>")
    ends = spark.createDataFrame([(1, "R", "m", "d", "z")], "company_id long, code string, metric_key string, low_passage string, high_passage string")
    assert [r["passage_id"] for r in A.candidate_passages(elements, ends, hits, limit=6).orderBy("place").collect()] == ["a", "b", "d", "z", "p1", "p2"]
    actions = spark.createDataFrame([(1, "R", "x", "i1", ["S:y", "T:no"]), (1, "S", "y", "i2", []), (2, "S", "y", "i3", ["S:y"])], "company_id long, code string, gap_key string, action_id string, depends_on array<string>")
    assert {r["action_id"]: r["needs"] for r in A.resolved_dependencies(actions).collect()} == {"i1": ["i2"], "i2": [], "i3": ["i3"]}



def test_catalogue_load_outcomes(spark):
    files = spark.createDataFrame([(k, "body") for k in "abcd"], "set_id string, body string")
    same = files.select(F.sha2("body", 256)).first()[0]
    loaded = spark.createDataFrame([("b", same), ("c", "other"), ("d", "other")], "set_id string, content_hash string")
    used = spark.createDataFrame([("d",), ("d",), ("b",)], "set_id string")
    assert {r["set_id"]: r["outcome"] for r in R.load_catalogue(files, loaded, used).collect()} == {"a": "loaded", "b": "skipped", "c": "replaced", "d": "refused"}


def test_requirement_search_uses_all_wording(spark):
    requirements = spark.createDataFrame([("R1", "Water use", "How much", "water", ["basin level"], [])], "code string, title string, summary string, topic string, search_terms array<string>, metric_keys array<string>")
    passages = spark.createDataFrame([("p1", "basin level is known", "paragraph", "Water"), ("p2", "nothing", "paragraph", None), ("p3", "much use", "paragraph", None)], "passage_id string, line string, kind string, section string")
    assert [r["passage_id"] for r in bm25(passages, requirement_queries(requirements)).orderBy("rank").collect()] == ["p1", "p3"]


def test_html_blocks_tables_and_margins(spark):
    html = "<head><title>no</title></head><body><!-- <p>no</p> --><script>var t='<p>no</p>'</script><h1 id=a>One</h1><p class='x'><b>Bold</b> &amp; plain<br>after</p><h2>Two</h2><ul><li><a href='/'>Item</a></li></ul>tail<h1>Three</h1><div>last</div></body>"
    rows = [(r["kind"], r["section"], r["body"]) for r in P.html_passages(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("ordinal").collect()]
    assert rows == [("heading", "One", "One"), ("paragraph", "One", "Bold & plain"), ("paragraph", "One", "after"), ("heading", "One › Two", "Two"), ("list_item", "One › Two", "Item"), ("paragraph", "One › Two", "tail"), ("heading", "Three", "Three"), ("paragraph", "Three", "last")]
    table = "<table><tr><th>x</th><th>FY2024</th><th>2023</th></tr><tr><td>Water</td><td>1</td><td></td></tr><tr><td></td><td>5</td></tr><tr><td> </td></tr></table><table><tr><td>lone</td></tr></table>"
    assert [(r["label"], r["headers"], r["text"]) for r in P.html_tables(spark.createDataFrame([(1, table)], "page_id long, html string")).collect()] == [("Water", ["FY2024", "2023"], "Water | FY2024: 1; 2023: ")]
    tails = spark.createDataFrame([("Water use 1,200 (30) –",), ("12 13",), ("no numbers",)], "t string").select(P.numeric_tail(F.col("t")).alias("x")).collect()
    assert [r["x"] and (r["x"]["label"], r["x"]["values"]) for r in tails] == [("Water use", ["1,200", "(30)", "–"]), None, None]
    pages = spark.createDataFrame([(k, "d", "\n".join(["Annual report 2024", *[f"line {k} {j}" for j in "abcdefghij"], str(k)])) for k in range(4)], "page int, doc string, text string")
    kept = P.without_running_lines(pages, group="doc", page="page").collect()
    assert len(kept) == 40 and all(r["line"].startswith("line") for r in kept)


def test_chunks_end_with_sentences(spark):
    lines = ["x" * 500, "y" * 500, "z.", "after"]
    rows = P.passages(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).orderBy("ordinal").collect()
    assert [r["chunk"] for r in rows] == [0, 0, 0, 1]
    joined = spark.createDataFrame([(["location-", "based", "Market-", "Based", "x"],)], "a array<string>").select(P.join_lines(F.col("a"))).first()[0]
    assert joined == "location-based Market- Based x"


def test_display(spark):
    row = spark.createDataFrame([("  Hello, World! ", "..\\a/b*c.pdf", -0.0421, 1536)], "a string, b string, c double, d long").select(R.slug(F.col("a")), R.safe_file_name(F.col("b")), R.signed_percent(F.col("c")), R.byte_size(F.col("d"))).first()
    assert tuple(row) == ("hello-world", "b_c.pdf", "−4.2 %", "1.5 KB")
    assert [r[0] for r in spark.createDataFrame([("1.10",), ("1.9",), ("2.x",)], "v string").select(R.version_key(F.col("v"))).collect()] == [[1, 10], [1, 9], [2, 0]]
    assert text.STOP_WORDS[0] == "a" and len(text.STOP_WORDS) == 43


def test_megabytes_are_the_largest_unit(spark):
    sizes = spark.createDataFrame([(1023,), (1 << 20,), (1 << 30,), (5 << 40,)], "n long").select(R.byte_size(F.col("n")))
    assert [r[0] for r in sizes.collect()] == ["1023 B", "1.0 MB", "1024.0 MB", "5242880.0 MB"]


def test_ranking_reads_no_text_again(spark):
    """What ranks passages for requirements is the table that the one pass over the texts wrote."""
    requirements = spark.createDataFrame([("R1", "Water use", "How much", "water", ["basin level"], [])], "code string, title string, summary string, topic string, search_terms array<string>, metric_keys array<string>")
    passages = spark.createDataFrame([("p1", "basin level is known", "paragraph", "Water")], "passage_id string, line string, kind string, section string")
    plan = bm25(passages, requirement_queries(requirements))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "regexp_extract_all" not in plan


def lines_of(spark, folder, days):
    """Tables of a line each for company 1, whose year ends in March, and company 2, and of a second line 1 of a lower confidence."""
    lines = [(k + 1, 1, 1 + k % 2, 1, 3.0, 0.0, 0.01, "N", "O", day) for k, day in enumerate(days)]
    lines += [(*lines[0][:5], 0.1, 0.05, *lines[0][7:])]
    lines = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, day string")
    tables = {
        "lineitem": lines.withColumn("l_shipdate", F.col("day").cast("timestamp")).drop("day"),
        "part": spark.createDataFrame([(1, "Brand#1", "t")], "p_partkey long, p_brand string, p_type string"),
        "supplier": spark.createDataFrame([(1, 1), (2, 1)], "s_suppkey long, s_nationkey int"),
        "conversations": spark.createDataFrame([(1, 1, "user")], "conv_id long, turn long, role string"),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_facts_of_a_period_are_those_of_its_days(spark, tmp_path):
    """Both ends of both companies' years are in, and no label is made for a line of another year."""
    folder = lines_of(spark, tmp_path, [f"{year}-{day}" for year in range(1996, 2000) for day in ("01-01", "03-31", "04-01", "12-31") for _ in "ab"])
    for labels in (["FY1998"], ["FY1997", "FY1998"]):
        some, all_ = facts.period_facts(spark, folder, *labels), facts.metric_facts(spark, folder).filter(F.col("period_label").isin(labels))
        assert sorted(some.collect(), key=repr) == sorted(all_.collect(), key=repr) and some.count() == 8 * len(labels)
    assert "l_shipdate" in facts.period_facts(spark, folder, "FY1998")._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1].split("]")[0]


def test_a_run_puts_cited_passages_together_once(spark, tmp_path):
    """Passages that nothing cites are left out, those that are cited keep what all of their lines say, and findings and links are tables."""
    folder = lines_of(spark, tmp_path, ["1997-06-01", "1998-06-01", "1995-06-01", "1998-07-01", "1997-07-01", "1997-08-01", "1997-09-01"])
    run, sources = report_queries._with_sources(spark, folder)
    found = {r["document_id"]: r["page"] for r in sources.collect()}
    assert found == {1: 10, 2: 14, 4: 14, 5: 14, 7: 14}
    for table in (run.findings(), run.links()):
        assert "Aggregate" not in table._jdf.queryExecution().executedPlan().toString()
    trail = json.loads(report_queries.finding_trails(spark, folder).filter("company_id = 1 AND code = 'R1'").first()["trail"])
    assert [e["page"] for e in trail["evidence"] if e["document_id"] == 1] == [10] and len(trail["evidence"]) == 3 and trail["history"][0]["run_id"] == "run-98"
