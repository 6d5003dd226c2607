"""Operators on small scenarios with known outcomes."""

import collections
import datetime as dt
import math
import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from cairnlake.functions.text import STOP_WORDS, terms_in, tokens
from cairnlake.operators import assessment as A
from cairnlake.operators import disclosures as D
from cairnlake.operators import passages as P
from cairnlake.operators import patterns, postings
from cairnlake.operators import retrieval as R
from cairnlake.operators import workflow as W
from cairnlake.operators.extraction import passage_metrics, rate_metrics, sentence_metrics, table_row_metrics
from cairnlake.plans import extraction_queries, text_queries
from cairnlake.streaming.ingest import document_stream, on_superseded, passage_stream
from cairnlake.streaming.rate_limit import OUTPUT, fold, limited, limited_batch

FACTS = "company_id long, passage_id string, metric_key string, normalized_value double, normalized_unit string, period_label string, period_end date, method string, confidence_pct long, inferred boolean, base_year boolean"


def fact(company, passage, key, value, period="FY2024", method="table", confidence=95, inferred=False, base=False, unit="MWh"):
    return (company, passage, key, value, unit, period, dt.date(int(period[2:]), 12, 31), method, confidence, inferred, base)


def test_conflicts_need_two_passages_and_more_than_one_percent(spark):
    rows = [fact(1, "a", "e", 100.0), fact(1, "b", "e", 101.5), fact(2, "a", "e", 100.0), fact(2, "b", "e", 100.9), fact(3, "a", "e", 1.0), fact(3, "a", "e", 9.0), fact(4, "a", "e", 0.0), fact(4, "b", "e", 9.0), fact(5, "a", "e", 1.0, unit="t"), fact(5, "b", "e", 9.0)]
    found = D.conflicts(spark.createDataFrame(rows, FACTS), by=["company_id", "metric_key"]).collect()
    assert [(r["company_id"], r["low_passage"], r["high_passage"], r["spread"]) for r in found] == [(1, "a", "b", 0.015)]


def test_best_value_and_series(spark):
    rows = [fact(1, "c", "e", 5.0, method="text", confidence=99), fact(1, "b", "e", 6.0, confidence=90), fact(1, "a", "e", 7.0, confidence=90), fact(1, "z", "e", 8.0, "FY2022"), fact(1, "y", "e", 4.0, "FY2023")]
    frame = spark.createDataFrame(rows, FACTS)
    best = D.best_values(frame.filter("period_label = 'FY2024'"), by=["company_id"]).first()
    assert (best["value"], best["passage_id"], best["alternatives"], best["sources_differ"]) == (7.0, "a", 2, True)
    series = D.time_series(frame, by=["company_id"]).first()
    assert (series["labels"], series["first_value"], series["last_value"], series["change"]) == ("FY2022,FY2023,FY2024", 8.0, 7.0, -0.125)
    key = D.key_disclosures(frame, by=["company_id"]).first()
    assert (key["latest"], key["prior"], key["change"], key["sources"]) == (5.0, 4.0, 0.25, 3)


def test_a_missing_value_is_never_zero(spark):
    companies = spark.createDataFrame([(1, 10), (1, 11), (1, 12)], "org_id long, company_id long")
    facts = spark.createDataFrame([fact(10, "a", "Brand#1", 5.0), fact(11, "b", "Brand#11", 6.0)], FACTS)
    grid = D.peer_grid(companies, facts, ["Brand#1"], {"Brand#1": "Brand#11"}, "FY2024")
    rows = {r["company_id"]: (r["value"], r["used_key"]) for r in grid.collect()}
    assert rows == {10: (5.0, "Brand#1"), 11: (6.0, "Brand#11"), 12: (None, "Brand#1")}
    line = D.coverage(grid, by=["metric_key"]).first()
    assert (line["coverage"], line["comparable"], line["label"]) == ("2/3", True, "comparable")


CATALOGUE = [
    A.Element("R1", "total", 2.0, "metric", ("e",), ("weak_e",)),
    A.Element("R1", "period", 1.0, "metric_period", ("e",)),
    A.Element("R2", "then", 1.0, "conditional", ("f",), (), "g"),
]


def assess(spark, rows, companies=(1,)):
    facts = spark.createDataFrame(rows, FACTS)
    own = spark.createDataFrame([(c,) for c in companies], "company_id long")
    elements = A.element_results(own, facts, CATALOGUE, "FY2024")
    conflicts = A.requirement_conflicts(facts, CATALOGUE, "FY2024")
    return elements, conflicts, A.findings(elements, conflicts)


def test_findings(spark):
    rows = [fact(1, "a", "e", 5.0, inferred=True), fact(2, "b", "weak_e", 5.0), fact(3, "c", "e", 5.0), fact(3, "d", "e", 6.0), fact(4, "t", "e", 5.0, method="text", confidence=80), fact(5, "g", "g", 1.0), fact(6, "x", "e", 5.0, base=True)]
    elements, conflicts, found = assess(spark, rows, range(1, 7))
    by = {(r["company_id"], r["code"]): r for r in found.collect()}
    weak = {(r["company_id"], r["element"]): r["weak"] for r in elements.collect()}
    assert weak[1, "period"] and not weak[1, "total"] and weak[2, "total"]
    assert (by[1, "R1"]["status"], by[1, "R1"]["confidence"]) == ("supported", 0.855)
    assert (by[2, "R1"]["status"], by[2, "R1"]["completeness"], by[2, "R1"]["missing"]) == ("partially_supported", 0.6667, "period")
    assert by[3, "R1"]["status"] == "conflicting" and by[4, "R1"]["status"] == "human_review" and by[6, "R1"]["status"] == "not_found"
    assert (by[1, "R2"]["status"], by[1, "R2"]["confidence"]) == ("not_found", 0.3)  # not applicable: nothing to satisfy
    assert by[5, "R2"]["missing"] == "then"
    gaps = {(r["company_id"], r["gap_key"]) for r in A.gaps(found, elements, conflicts).collect()}
    assert {(3, "conflict:e"), (4, "review"), (5, "missing:then"), (2, "missing:period")} <= gaps and (3, "missing:total") not in gaps
    links = {(r["company_id"], r["passage_id"]): (r["role"], r["elements"], r["rank"]) for r in A.evidence_links(elements, conflicts).collect()}
    assert links[3, "c"] == ("conflicting", "total,period", 1) and links[1, "a"] == ("supporting", "total,period", 1)


def test_merge_truth_table(spark):
    elements = spark.createDataFrame(
        [(1, "R", f"e{k}", 1.0, kind, status, False, 90) for k, (kind, status) in enumerate([("any_of", "satisfied"), ("metric", "satisfied"), ("any_of", "missing"), ("any_of", "missing"), ("metric", "missing"), ("metric", "missing"), ("any_of", "not_applicable"), ("any_of", "missing")])],
        "company_id long, code string, element string, weight double, kind string, status string, weak boolean, confidence_pct long",
    )
    verdicts = spark.createDataFrame(
        [(1, "R", f"e{k}", *v) for k, v in enumerate([("no", True, True), ("no", True, True), ("yes", True, True), ("yes", False, True), ("yes", True, True), ("unclear", True, True), ("yes", True, True), ("unclear", True, True)])],
        "company_id long, code string, element string, verdict string, valid boolean, confident boolean",
    )
    rows = {r["element"]: (r["status"], r["source"], r["reason"] is not None) for r in A.merge_verdicts(elements, verdicts).collect()}
    assert rows == {
        "e0": ("missing", "model", False), "e1": ("satisfied", "rules", True), "e2": ("satisfied", "model", False), "e3": ("missing", "rules", True),
        "e4": ("satisfied", "model", True), "e5": ("missing", "rules", False), "e6": ("not_applicable", "rules", False), "e7": ("missing", "rules", True),
    }


def test_action_lifecycle(spark):
    now = spark.createDataFrame([(1, "R", "new"), (1, "R", "again"), (1, "R", "kept"), (1, "R", "waived")], "company_id long, code string, gap_key string")
    old = spark.createDataFrame(
        [(1, "R", "again", "done", True), (1, "R", "kept", "open", False), (1, "R", "waived", "dismissed", False), (1, "R", "gone", "open", False), (1, "R", "gone_done", "done", False), (2, "R", "unseen", "open", False)],
        "company_id long, code string, gap_key string, action_status string, closed boolean",
    )
    rows = {r["gap_key"]: (r["action_status"], r["change"], r["closed"]) for r in A.sync_actions(now, old, now).collect()}
    assert rows == {
        "new": ("open", "created", False), "again": ("open", "reopened", False), "kept": ("open", "updated", False), "waived": ("dismissed", "updated", False),
        "gone": ("open", "closed", True), "gone_done": ("done", "untouched", False), "unseen": ("open", "untouched", False),
    }
    again = A.sync_actions(now, A.sync_actions(now, old, now).drop("change"), now)
    assert again.filter("change = 'created'").count() == 0  # a second run doubles nothing


def test_run_diff_names_its_cause(spark):
    schema = "company_id long, code string, status string, completeness double, evidence array<string>"
    before = spark.createDataFrame([(1, "A", "supported", 1.0, ["p"]), (1, "B", "not_found", 0.0, []), (1, "C", "supported", 1.0, ["p"]), (1, "D", "supported", 1.0, [])], schema)
    after = spark.createDataFrame([(1, "A", "supported", 1.0, ["q"]), (1, "B", "supported", 1.0, []), (1, "C", "supported", 1.0, ["p"]), (1, "E", "supported", 1.0, [])], schema)
    fields = ", ".join(f"{f} string" for f in A.VERSION_FIELDS).replace(" string", ":string").replace(", ", ",")
    manifests = f"company_id long, requirements map<string,string>, documents array<struct<lineage_id:long,id:long,sha256:string>>, versions struct<{fields}>"
    one = ("1", "1", "1", None, None, "rules")

    def diff(requirements, documents, versions):
        old = spark.createDataFrame([(1, {"A": "x", "B": "x", "C": "x", "D": "x"}, [(1, 10, "h"), (2, 20, "h")], one)], manifests)
        new = spark.createDataFrame([(1, requirements, documents, versions)], manifests)
        return {r["code"]: (r["cause"], r["added"], r["removed"], r["fields"]) for r in A.diff_runs(before, after, old, new).collect()}

    same = [(2, 20, "h"), (1, 10, "h")]
    assert diff({"A": "x", "B": "x", "C": "y", "E": "x"}, same, one) == {
        "A": ("evidence selection changed", ["q"], ["p"], []), "B": ("evidence selection changed", [], [], []), "D": ("requirement removed", [], [], []), "E": ("requirement added", [], [], []),
    }
    moved = diff({"A": "y", "B": "x", "E": "x"}, [(1, 11, "h"), (2, 20, "h")], ("1", "1", "2", None, "m", "rules"))
    assert moved["A"] == ("requirement revised; documents changed; method changed", ["q"], ["p"], ["rules_version", "llm_model"]) and moved["B"][0] == "method changed"
    assert diff({"A": "x", "B": "x", "E": "x"}, same[:1], one)["A"][0] == "documents changed"


def test_passages_and_versions(spark):
    docs = spark.createDataFrame([(1, "TITLE\n- item one\nA paragraph that ends.\n\n" + "x" * 950 + ".\nAfter."), (2, "same"), (3, "same"), (4, None)], "doc_id long, text string")
    rows = P.passages(docs).filter("doc_id = 1").orderBy("ordinal").collect()
    assert [r["kind"] for r in rows] == ["heading", "list_item", "paragraph", "paragraph", "paragraph"]
    assert [r["section"] for r in rows] == ["TITLE"] * 5 and [r["chunk"] for r in rows] == [0, 0, 0, 0, 1]
    assert [(r["doc_id"], r["first_id"]) for r in P.duplicate_documents(docs).collect()] == [(3, 2)]
    mode = P.weighted_mode(spark.createDataFrame([(1, 2020, 1, 5), (1, 2021, 1, 2), (1, 2020, 1, 9), (1, 2021, 1, 7)], "c int, y int, w int, p int"), by="c", value="y", weight="w", position="p").first()
    assert mode["y"] == 2021


def test_bm25_prefers_rare_terms_and_phrases(spark):
    passages = spark.createDataFrame([("p1", "water use in plants", "paragraph", None), ("p2", "energy use in plants", "paragraph", None), ("p3", "water withdrawal by basin", "paragraph", "Water"), ("p4", "water withdrawal by basin", "heading", None)], "passage_id string, line string, kind string, section string")
    queries = spark.createDataFrame([(1, "water withdrawal", ["water withdrawal"], ["water"])], "query_id long, query string, phrases array<string>, section_terms array<string>")
    rows = R.bm25(passages, queries).orderBy("rank").collect()
    assert [r["passage_id"] for r in rows] == ["p3", "p4", "p1"] and rows[0]["score"] == 0.85


def test_bm25_keeps_passages_with_only_a_phrase_or_a_metric(spark):
    passages = spark.createDataFrame([("p1", "water use", "paragraph", None, []), ("p2", "it was that and this", "paragraph", None, None), ("p3", "nothing here", "table", None, ["e", "w"]), ("p4", "water that", "paragraph", None, ["w"]), ("p5", "none", "paragraph", "Water", ["x"])], "passage_id string, line string, kind string, section string, metric_keys array<string>")
    queries = spark.createDataFrame([(1, "That and water", ["That and", ""], ["water"], ["w", "w"]), (2, "that and", ["that and"], [], None)], "query_id long, query string, phrases array<string>, section_terms array<string>, metric_keys array<string>")
    rows = {(r["query_id"], r["passage_id"]): r["score"] for r in R.bm25(passages, queries).collect()}
    # p4 has one token after stop words and so the best raw score; p1's share of it follows from k1 and b
    assert set(rows) == {(1, "p1"), (1, "p2"), (1, "p3"), (1, "p4"), (2, "p2")}
    assert (rows[1, "p2"], rows[1, "p3"], rows[1, "p4"], rows[2, "p2"]) == (0.15, 0.3, 1.1, 0.15) and 0 < rows[1, "p1"] < 0.6
    assert {(r["query_id"], r["passage_id"]) for r in R.bm25(passages.drop("metric_keys"), queries.drop("metric_keys"), terms_only=True).collect()} == {(1, "p1"), (1, "p4")}


def test_bm25_moves_no_pairs_of_passage_and_query(spark, monkeypatch):
    """Sixty queries that meet all of 3,000 passages, which have many ties: the rows that reach a shuffle are the tasks' best ones."""
    passages = spark.range(3000).repartition(3).select("id", F.concat_ws(" ", F.lit("water plant"), F.concat(F.lit("w"), (F.col("id") % 7).cast("string"))).alias("line"), F.lit("paragraph").alias("kind"), F.lit(None).cast("string").alias("section"))
    none = F.array().cast("array<string>")
    queries = spark.range(60).select(F.col("id").alias("query_id"), F.concat(F.lit("water plant w"), (F.col("id") % 7).cast("string")).alias("query"), none.alias("phrases"), none.alias("section_terms"))
    for block in (R.MOST_QUERIES, 25):  # one block, then three
        monkeypatch.setattr(R, "MOST_QUERIES", block)
        found = R.bm25(passages, queries, passage="id")
        assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
        best = {}
        for r in found.collect():
            best.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
        assert {q: sorted(rows) for q, rows in best.items()} == {q: [(k + 1, q % 7 + 7 * k, 0.6) for k in range(8)] for q in range(60)}


def test_search_makes_no_texts_of_tokens(spark, monkeypatch):
    """Terms are counted in the passages' bytes, with no regular expression and no stem for each of their tokens; only passages that may be hits are ranked."""
    rows = [("p1", "The boxes, CO\u2082 and \uff37\uff21\uff34\uff25\uff32"), ("p2", "nothing"), ("p3", None), ("p4", "Waters of water"), ("p5", "passwordless password passwords")]
    passages = spark.createDataFrame(rows, "passage_id string, line string").select("*", F.lit("paragraph").alias("kind"), F.lit(None).cast("string").alias("section"))
    none, plans, keep = F.array().cast("array<string>"), [], R.materialise
    queries = spark.createDataFrame([(1, "water box"), (2, "co2 password")], "query_id long, query string").select("*", none.alias("phrases"), none.alias("section_terms"))
    monkeypatch.setattr(R, "materialise", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, label))
    found = R.bm25(passages, queries)
    assert {(r["query_id"], r["passage_id"]) for r in found.collect()} == {(1, "p1"), (1, "p4"), (2, "p1"), (2, "p5")}
    assert len(plans) == 1 and not any(w in plans[0] for w in ("regexp_extract_all", "transform(", "RLIKE"))
    assert "size(terms" in found._jdf.queryExecution().optimizedPlan().toString()


def test_few_phrases_are_found_in_all_texts_at_once(monkeypatch):
    rng = random.Random(3)
    some = lambda most: "".join(rng.choice("ab\u00e9\n ") for _ in range(rng.randint(0, most)))
    for _ in range(300):
        phrases, texts = [some(4) for _ in range(rng.randint(0, 5))], [None if rng.random() < 0.1 else some(9) for _ in range(rng.randint(0, 12))]
        want = [(row, k) for row, t in enumerate(texts) for k, p in enumerate(phrases) if t is not None and p in t]
        for few in (12, -1):
            monkeypatch.setattr(patterns, "FEW", few)
            rows, numbers = patterns.Phrases(phrases).find_all(pa.array(["a b", *texts], pa.string()).slice(1))
            assert list(zip(rows.tolist(), numbers.tolist(), strict=True)) == want


def test_search_lowers_whole_texts_only_for_phrases_beyond_ascii(spark, monkeypatch):
    passages = spark.createDataFrame([("p1", "\u212aelvin W\u0130DE \u00c9"), ("p2", "nothing"), ("p3", None), ("p4", "KELVIN \u00c9T\u00c9")], "passage_id string, line string").select("*", F.lit("paragraph").alias("kind"), F.lit(None).cast("string").alias("section"))
    plans, keep = [], R.materialise
    monkeypatch.setattr(R, "materialise", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, label))
    for phrase, want in (("Kelvin", {"p1", "p4"}), ("de \u00c9", {"p1"}), ("\u00e9t\u00e9", {"p4"}), ("wi", {"p1"})):
        queries = spark.createDataFrame([(1, "unseen", [phrase], [])], "query_id long, query string, phrases array<string>, section_terms array<string>")
        # a capital I with a dot is two characters in lower case, the second beyond ASCII
        assert {r["passage_id"] for r in R.bm25(passages, queries).collect()} == want
    assert [bool(re.search(r"lower\(line", plan)) for plan in plans] == [False, True, True, False]


def test_phrases_of_any_length_and_inside_tokens(spark, monkeypatch):
    texts = [
        (1, 'He said "that and the other thing\tis here to stay" twice.'), (2, "one two three four five. Six seven eight"), (3, "a three word phrase, once"), (4, None), (5, ""),
        (6, "overrun one two three four five six seven eightfold"), (7, "short"), (None, "one two three four five six seven eight"), (3, "one two three four five"),
    ]
    phrases = [
        (10, "three word phrase"), (11, "that and the other thing is here to stay"), (12, "One two three  four five"), (13, "run one two three four five six seven eight"), (14, "hort"),
        (15, "nowhere at all"), (16, None), (17, "five six"), (18, "one two three four five six seven"), (18, "a three"), (19, "that and the other thing is there"), (20, "two three four five six seven"),
    ]
    plain = lambda x: " ".join(x.lower().split())
    want = {(i, p) for i, t in texts for p, q in phrases if t is not None and q is not None and plain(q) in plain(t)}
    frames = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(phrases, "phrase_id long, phrase string")
    assert {(3, 10), (1, 11), (2, 12), (6, 13), (None, 18)} <= want
    assert sorted(map(tuple, R.phrase_matches(*frames).collect()), key=repr) == sorted(want, key=repr)
    monkeypatch.setattr(patterns, "MOST_CHARS", 60)  # several blocks
    assert sorted(map(tuple, R.phrase_matches(*frames).collect()), key=repr) == sorted(want, key=repr)


def test_no_pair_of_text_and_phrase_is_made(spark):
    frames = spark.createDataFrame([(1, "a b")], "id long, text string"), spark.createDataFrame([(1, "a")], "phrase_id long, phrase string")
    plan = R.phrase_matches(*frames)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize(
    "pattern, want",
    [
        (r"scope\s*2\b[^.]{0,80}location", {"location"}), (r"(?:emissions|ghg)\s+target", {"target"}), (r"ab|cd", None), (r"abc|defg", {"abc", "defg"}), (r"(?:total)?\s+water", {"water"}),
        (r"\d+", None), (r"a(?:bcd)+e", {"bcd"}), (r"(?:bcd)*", None), (r"\bTOKEN\b", {"token"}), (r"é\w+", None), (r"(?=abcd)x", None), (r"colou?rs", {"colo"}),
    ],
)
def test_required_literals(pattern, want):
    assert patterns.required_literals(pattern) == (want and frozenset(want))


def test_patterns_are_found_where_they_match():
    some = [r"scope\s*2\b[^.]{0,20}location", r"abc|defg", r"\bx\d", r"skip", r"in\w+ing", r"^the", r"[ſs]kin"]
    texts = ["Scope 2 is LOCATION", "ABC", "xdefgy", "x1", "the ſKIP", "ın x inkıng", "", "Kskin", "none", "İNKING"]
    index = patterns.Patterns(some)
    for text in texts:
        assert sorted(index.find(text)) == [k for k, p in enumerate(some) if re.search(p, text, re.IGNORECASE)], text


def test_pattern_checks_with_contexts(spark, monkeypatch):
    rows = [
        ("p1", "We set a target of 30 %.", "paragraph", "Climate"), ("p2", "A target here", "paragraph", None), ("p3", "Targets", "heading", "Climate"), ("p4", "a policy, a target", "list_item", "Policy"),
        ("p5", None, "paragraph", "Climate"), ("p6", "target", "table", "Climate"), ("p7", "x" * 200 + " policy " + "y" * 200, "table_row", ""),
    ]
    checks = [("c1", [r"target"], [r"climate"]), ("c2", [r"nowhere", r"polic(?:y|ies)", r"target"], None), ("c3", [r"target"], [])]
    passages = spark.createDataFrame(rows, "passage_id string, text string, kind string, section string")
    frame = spark.createDataFrame(checks, "check_id string, patterns array<string>, context array<string>")
    for most in (patterns.MOST_CHARS, 30):
        monkeypatch.setattr(patterns, "MOST_CHARS", most)
        found = {(r["passage_id"], r["check_id"]): r["snippet"] for r in patterns.check_matches(passages, frame, keep=["passage_id"]).collect()}
        assert set(found) == {("p1", "c1"), ("p1", "c2"), ("p1", "c3"), ("p2", "c2"), ("p2", "c3"), ("p4", "c2"), ("p4", "c3"), ("p7", "c2")}
        assert found["p7", "c2"] == "x" * 59 + " policy " + "y" * 59 and found["p4", "c2"] == "a policy, a target"


def test_the_index_gives_the_same_rows_and_reads_less(spark, tmp_path):
    """200 blocks, of which few hold the rare terms; then an increment, which changes frequencies and the mean length."""
    rows = [(f"p{k:05}", " ".join(["water"] * (1 + k % 3) + ["emission target"] * (k % 1000 == 7) + [f"w{k % 17}"] * (k % 5))) for k in range(20_000)]
    rows += [(f"q{k:05}", "rare water" if k % 50 == 0 else "the of") for k in range(300)]
    passages = spark.createDataFrame(rows, "passage_id string, line string")
    queries = spark.createDataFrame([(1, "Water emission targets"), (2, "rare waters"), (3, "nowhere"), (4, None), (5, "w3 w4 w5")], "query_id long, query string")

    def brute(rows):
        def tokens(x):
            return [w[:-1] if w in ("targets", "waters") else w for w in re.findall("[a-z0-9]+", x.lower()) if w not in STOP_WORDS]

        terms = [(p, collections.Counter(tokens(t)), len(tokens(t)) or 1) for p, t in rows]
        mean, df = sum(sum(c.values()) for _, c, _ in terms) / len(terms), collections.Counter(t for _, c, _ in terms for t in c)
        out = {}
        for q, text in [(1, "Water emission targets"), (2, "rare waters"), (5, "w3 w4 w5")]:
            idf = {t: math.log(1 + (len(terms) - df[t] + 0.5) / (df[t] + 0.5)) for t in set(tokens(text))}
            scores = [(round(sum(round(idf[t] * c[t] * 2.4 / (c[t] + 1.4 * (0.25 + 0.75 * n / mean)), 9) for t in idf if c[t]), 6), p) for p, c, n in terms if idf.keys() & c]
            out[q] = [(s, p) for s, p in sorted(scores, key=lambda x: (-x[0], x[1]))[:8]]
        return out

    path, counts = postings.append(passages.filter("passage_id < 'q'"), f"{tmp_path}/index"), {}
    for part in ("p", "q"):
        if part == "q":
            postings.append(passages.filter("passage_id >= 'q'"), path)
        found = {}
        for r in postings.search(spark, path, queries, counts=counts).orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append((r["score"], r["passage_id"]))
        want = {q: x for q, x in brute([r for r in rows if r[0][0] <= part]).items() if x}
        assert {q: [s for s, _ in x] for q, x in found.items()} == {q: [s for s, _ in x] for q, x in want.items()} and found == want
        assert counts["read"] < counts["all"]


def test_a_search_of_the_index_moves_no_pairs(spark, tmp_path, monkeypatch):
    """Forty queries that want all of 2,000 passages: they are ranked without an aggregation by query and passage, in one block or several."""
    passages = spark.range(2000).select(F.format_string("p%05d", "id").alias("passage_id"), F.concat(F.lit("water plant w"), (F.col("id") % 7).cast("string")).alias("line"))
    queries = spark.range(40).select(F.col("id").alias("query_id"), F.concat(F.lit("plant water w"), (F.col("id") % 7).cast("string")).alias("query"))
    path = postings.append(passages, f"{tmp_path}/index")
    for block in (postings.MOST_QUERIES, 15):
        monkeypatch.setattr(postings, "MOST_QUERIES", block)
        found = postings.search(spark, path, queries)
        assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
        best = {}
        for r in found.collect():
            best.setdefault(r["query_id"], []).append((r["rank"], r["passage_id"]))
        assert {q: sorted(rows) for q, rows in best.items()} == {q: [(k + 1, f"p{q % 7 + 7 * k:05}") for k in range(8)] for q in range(40)}


def test_the_index_is_made_where_the_passages_are(spark, tmp_path, monkeypatch):
    """Neither texts nor postings are shuffled or written twice: the index is one write without a shuffle, and of a search only the tasks' best rows are shuffled."""
    passages = spark.range(3000).repartition(3).select(F.format_string("p%05d", "id").alias("passage_id"), F.concat(F.lit("water plant w"), (F.col("id") % 7).cast("string")).alias("line"))
    passages.write.parquet(f"{tmp_path}/passages")
    plans, write = [], DataFrameWriter.parquet

    def seen(self, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    path = postings.append(spark.read.parquet(f"{tmp_path}/passages"), f"{tmp_path}/index")
    assert len(plans) == 1 and "Exchange" not in plans[0]
    assert postings.search(spark, path, spark.createDataFrame([(1, "water w3")], "query_id long, query string")).count() == 8
    assert len(plans) == 2 and "MapInArrow" in plans[1] and not re.search(r"\bExchange (?!SinglePartition)", plans[1].split("MapInArrow")[1])


def test_blocks_of_odd_passages(spark, tmp_path):
    """Null, blank and very long texts, texts beyond ASCII, words that only stemming joins, ties over blocks and increments."""
    odd = [("a1", None), ("a2", ""), ("a3", "the of, !"), ("a4", "water " * 20_000 + "rare"), ("a5", "Caf\u00e9 \uff37\uff21\uff34\uff25\uff32 \u212aelvins"), ("a6", "boxes box policies policy s ss as"), ("a7", "y" * 70_000 + " box")]
    first = odd + [(f"m{k:04}", "same waters") for k in range(900, 300, -1)]
    later = [(f"m{k:04}", "same water") for k in range(300, 0, -1)]
    queries = [(1, "same water"), (2, "rare boxes"), (3, "kelvin caf policy"), (4, "y" * 70_000), (5, "the"), (6, "s ss")]
    frame = lambda rows: spark.createDataFrame(rows, "passage_id string, line string").coalesce(2)
    path = postings.append(frame(first), f"{tmp_path}/index")
    for rows in (first, first + later):
        if rows is not first:
            postings.append(frame(later), path)
        counted = {p: collections.Counter(row or []) for p, row in frame(rows).select("passage_id", tokens(F.col("line"))).collect()}
        n, mean = len(rows), sum(c.total() for c in counted.values()) / len(rows)
        df, want = collections.Counter(t for c in counted.values() for t in c), {}
        for q, terms in spark.createDataFrame(queries, "q long, x string").select("q", F.array_distinct(tokens(F.col("x")))).collect():
            idf = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in terms}
            scores = [(round(sum(round(idf[t] * c[t] * 2.4 / (c[t] + 1.4 * (0.25 + 0.75 * c.total() / mean)), 9) for t in terms if c[t]), 6), p) for p, c in counted.items() if c.keys() & set(terms)]
            want |= {(q, k + 1): x for k, x in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:8])}
        found = {(r["query_id"], r["rank"]): (r["score"], r["passage_id"]) for r in postings.search(spark, path, spark.createDataFrame(queries, "query_id long, query string")).collect()}
        assert found == want and len({q for q, _ in want}) == 5


def test_an_empty_index_finds_nothing(spark, tmp_path):
    path = postings.append(spark.createDataFrame([], "passage_id long, line string"), f"{tmp_path}/index")
    queries = spark.createDataFrame([(1, "water")], "query_id long, query string")
    assert postings.search(spark, path, queries).collect() == []
    postings.append(spark.createDataFrame([(9, "waters"), (8, "water"), (7, "the")], "passage_id long, line string"), path)
    assert [(r["passage_id"], r["rank"]) for r in postings.search(spark, path, queries).orderBy("rank").collect()] == [(8, 1), (9, 2)]


def test_terms_in_texts_are_those_of_tokens(spark):
    rng = random.Random(5)
    texts = [None, "", *("".join(rng.choice(["a", "s", "es", "ies", "x", "Z", "7", " ", "-", "the", " of ", "\u00e9", "\uff33", "\u0130", "\u212a", "\u00ad", "\n"]) for _ in range(rng.randint(0, 30))) for _ in range(400))]
    rows, numbers, terms = terms_in(pa.array(["gone", *texts], pa.string()).slice(1))
    found = [[] for _ in texts]
    for row, number in zip(rows.tolist(), numbers.tolist(), strict=True):
        found[row].append(terms[number].as_py())
    want = spark.createDataFrame(list(enumerate(texts)), "k int, x string").select("k", tokens(F.col("x")).alias("t")).orderBy("k").collect()
    assert found == [r["t"] or [] for r in want] and len(set(terms.to_pylist())) == len(terms)


def test_whole_items_are_searched(spark, tmp_path):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa. Lambda mu 42 omicron!"
    docs = [(1, "ETA\nTheta iota kappa and more\nplain line here."), (2, "xx delta epsilon zeta eta theta iota\nkappa. lambda mu"), (3, "Lambda mu 42 omicron! it is.\nAlpha beta alone."), (4, None), (5, "tiny onesie"), (6, "epsilon zeta eta theta iota kappa. lambda muon")]
    items = [(7, item), (8, "tiny one"), (9, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    want = set()
    for d, text in docs:
        for i, whole in items:
            words = (whole or "").lower().split()
            windows = {" ".join(words[k : k + 8]) for k in range(max(1, len(words) - 7))} - {""}
            n = sum(w in " ".join((text or "").lower().split()) for w in windows)
            want |= {(d, i, n)} if n else set()
    assert {(2, 7, 2), (5, 8, 1), (6, 7, 1)} <= want
    assert {tuple(r) for r in text_queries.phrase_match_whole(spark, str(tmp_path)).collect()} == want

    def tokens(x):
        return [w for w in re.findall("[a-z0-9]+", x.lower()) if w not in STOP_WORDS]

    rows = [r for r in P.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    n, mean, best = len(rows), sum(len(tokens(r["line"])) for r in rows) / len(rows), {}
    df = collections.Counter(t for r in rows for t in set(tokens(r["line"])))
    for i, whole in items[:2]:
        raw = {}
        for r in rows:
            ts = tokens(r["line"])
            raw[r["passage_id"]] = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * ts.count(t) * 2.4 / (ts.count(t) + 1.4 * (0.25 + 0.75 * len(ts) / mean)) for t in set(tokens(whole)) & set(ts))
        top = max(raw.values()) or 1.0
        for r in rows:
            phrases = sum(s.lower() in r["line"].lower() for s in re.split(r"(?<=[.;!?])\s+(?=[A-Z(])", whole))
            section = 0.1 if any(w.lower() in (r["section"] or "").lower() for w in re.findall("[A-Za-z0-9]+", whole)) else 0.0
            score = (0.6 * raw[r["passage_id"]] / top + min(0.45, 0.15 * phrases) + section) * (0.35 if r["kind"] == "heading" else 1.0)
            if raw[r["passage_id"]] > 0 or phrases:
                best[i, r["passage_id"]] = round(score, 6)
    found = {(r["query_id"], r["passage_id"]): r["score"] for r in text_queries.bm25_search_whole(spark, str(tmp_path)).collect()}
    assert 5 < len(best) <= 16 and found.keys() == best.keys() and all(abs(found[k] - best[k]) < 2e-6 for k in best)


def test_review_fold_and_metrics(spark):
    reviews = spark.createDataFrame([(1, 0, "comment"), (1, 1, "accept"), (1, 2, "override"), (1, 3, "comment"), (2, 0, "comment")], "finding_id long, seq int, decision string")
    assert {r["finding_id"]: (r["state"], r["comments"]) for r in W.fold_reviews(reviews).collect()} == {1: ("override", 2), 2: ("unreviewed", 1)}
    scored = spark.createDataFrame([(True, False)], "p boolean, g boolean").agg(*W.precision_recall(F.col("p"), F.col("g"))).first()
    assert (scored["precision"], scored["recall"], scored["f1"]) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Scope 1 emissions were 12,450\u00a0tCO2e in FY2024.", [("ghg_scope1", 12450.0, "FY2024", 0.85)]),
        ("Scope 1 emissions were 12\u202f450\u202ftCO2e in FY2024.", [("ghg_scope1", 12450.0, "FY2024", 0.85)]),
        ("Energy consumers bought 5 MWh in FY2024.", []),
        ("Total energy was 2024 MWh.", []),
        ("Water withdrawal: 5 ML (2023: 7 ML).", [("water_withdrawal", 5.0, None, 0.75), ("water_withdrawal", 7.0, "FY2023", 0.7)]),
        ("We target a reduction of emissions of 5 tCO2e by 2030.", []),
        ("Scope 1 emissions fell to (310) tCO2e.", [("ghg_scope1", -310.0, None, 0.75)]),
        ("Scope 2 emissions, location-based, and by market-based factors were 3 kt CO2e in 2023.", [("ghg_scope2_location", 3.0, "FY2023", 0.85)]),
        ("Fuel use was 4 GJ of diesel.", [("energy_fuel", 4.0, None, 0.75)]),
        ("", []),
        (None, []),
    ],
)
def test_sentence_probes(spark, text, want):
    rows = sentence_metrics(spark.createDataFrame([(1, text)], "id long, text string")).collect()
    assert sorted((r["metric_key"], r["value"], r["period_label"], r["confidence"]) for r in rows) == sorted(want)


def test_sentences_are_read_by_one_python_worker(spark):
    """One function reads values, mentions and base years: each further one in the plan is another worker beside each task."""
    frame = sentence_metrics(spark.createDataFrame([(1, "In the 2018 base year and the 2019 base year, Scope 1 emissions were 5 tCO2e, and 4 tCO2e later.")], "id long, text string"))
    assert frame._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 2  # the other one folds the text
    assert [(r["value"], r["period_label"], r["base_year"]) for r in frame.orderBy("place").collect()] == [(5.0, "FY2019", True), (4.0, "FY2019", True)]


@pytest.mark.parametrize("name", ["metric_extraction_text", "period_finder"])
def test_orders_are_read_on_all_cores(spark, name):
    frame = extraction_queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert frame.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_a_long_text_takes_linear_time(spark):
    """One sentence of a MB with 40,000 numbers."""
    one = "scope 1 emissions were 5 tCO2e and "
    text = one * 30_000
    began = time.perf_counter()
    assert sentence_metrics(spark.createDataFrame([(1, text[:100_000] + ". " + "A 5 " * 250_000)], "id long, text string")).count() == len(text[:100_000].split("tCO2e")) - 1
    assert rate_metrics(spark.createDataFrame([(1, "TRIR of 2.5 " * 20_000)], "id long, text string")).count() == 20_000
    assert time.perf_counter() - began < 120


def test_passages_of_each_kind(spark):
    cells = {"label": "GHG intensity (kgCO2e per unit)", "values": ["1.5", "n/a", "2"], "headers": ["FY2023", "FY2022"], "caption": None}
    rows = [("p", "paragraph", "TRIR (total recordable injury rate) was 2.5 in FY2023. Water intake was 3 m3.", None, None, 0.5), ("t", "table_row", None, None, cells, 1.0), ("e", "table_row", "x", None, None, 1.0), ("h", "heading", "Water intake 3 m3", None, None, 1.0)]
    frame = spark.createDataFrame(rows, "passage_id string, kind string, text string, section string, cells struct<label:string,values:array<string>,headers:array<string>,caption:string>, confidence double")
    found = sorted((r["passage_id"], r["metric_key"], r["value"], r["unit"], r["period_label"], r["confidence"]) for r in passage_metrics(frame).collect())
    assert found == [("p", "trir", 2.5, "rate", "FY2023", 0.375), ("p", "water_withdrawal", 3.0, "m3", None, 0.375), ("t", "ghg_intensity", 1.5, "kgCO2e/unit", "FY2023", 0.92)]


def test_extraction(spark):
    texts = spark.createDataFrame([(1, "In FY2024 energy use was 1,200 MWh and 300 MWh came later, 9 GJ too."), (2, "Water withdrawal was 5 thousand m3."), (3, "Scope 3 target for 2030.")], "id long, text string")
    rows = {(r["id"], r["value"]): (r["metric_key"], r["unit"], r["year"], r["confidence"]) for r in sentence_metrics(texts).collect()}
    assert rows == {(1, 1200.0): ("energy_total", "MWh", 2024, 0.85), (1, 300.0): ("energy_total", "MWh", 2024, 0.7), (1, 9.0): ("energy_total", "GJ", 2024, 0.7), (2, 5000.0): ("water_withdrawal", "m3", None, 0.75)}
    table = spark.createDataFrame([(1, "Electricity consumption (GWh)", ["FY2024", "2023"], ["1.5", "–"])], "id long, label string, headers array<string>, values array<string>")
    assert [(r["metric_key"], r["year"], r["normalized_value"]) for r in table_row_metrics(table).collect()] == [("energy_electricity", 2024, 1500.0)]


def test_only_accepted_hits_count(spark, tmp_path):
    assert fold([], [(0, 1), (1, 2), (2, 3), (10, 4), (11, 5)], 2, 10) == ([10, 11], [True, True, False, True, True])
    events = spark.createDataFrame([(1, k, dt.datetime(2024, 1, 1, 0, 0, s)) for k, s in enumerate([0, 1, 2, 10, 11])] + [(2, 9, dt.datetime(2024, 1, 1))], "user_id long, event_id long, ts timestamp")
    want = [(0, True), (1, True), (2, False), (3, True), (4, True), (9, True)]
    assert sorted((r["event_id"], r["accepted"]) for r in limited_batch(events, limit=2, seconds=10).collect()) == want
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = limited(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), limit=2, seconds=10)
    run = stream.writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    run.awaitTermination()
    assert sorted((r["event_id"], r["accepted"]) for r in spark.table("limited").collect()) == want and OUTPUT


def test_streaming_ingest(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a\nb", dt.datetime(2024, 1, 1)), (2, "a\nb", dt.datetime(2024, 1, 1)), (3, "c", dt.datetime(2024, 1, 1))], "doc_id long, text string, created_at timestamp")
    docs.write.parquet(f"{tmp_path}/in")
    stream = passage_stream(document_stream(spark, f"{tmp_path}/in", docs.schema.simpleString()[7:-1].replace(":", " ")))
    run = stream.writeStream.format("memory").queryName("lines").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    run.awaitTermination()
    assert sorted(r["line"] for r in spark.table("lines").collect()) == ["a", "b", "c"]
    seen = []
    evidence = spark.createDataFrame([(10, 1), (11, 3)], "finding_id long, document_id long")
    on_superseded(evidence, lambda rows, _: seen.append([r["finding_id"] for r in rows.collect()]))(spark.createDataFrame([(3,)], "document_id long"), 0)
    assert seen == [[11]]
