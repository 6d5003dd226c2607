"""Tables written in lines, and pages laid out by boxes and sizes."""

import random

from cairnlake.functions.periods import _label
from cairnlake.operators.layout import _parted, blocks, document_sizes, layout_passages, outside_tables, text_tables

LINE = "document_id string, page int, line_no int, text string, confidence double"


def brute_tables(lines):
    """Every line as a possible header, the rest of the page behind it: the first of at least two rows wins, then on from its end."""
    out, i, n = [], 0, 0
    while i < len(lines):
        headers = [w for w in lines[i].split() if _label(w, "12-31")]
        rows = []
        for text in lines[i + 1 :]:
            label, values = _parted(text)
            if len(headers) < 2 or not label or not values or len(values) > len(headers):
                break
            rows.append((" ".join(label), [""] * (len(headers) - len(values)) + values))
        if len(rows) >= 2:
            n += 1
            out += [(n, k, *r) for k, r in enumerate(rows)]
            i += 1 + len(rows)
        else:
            i += 1
    return out


def test_text_tables_against_every_start(spark):
    rng = random.Random(4)
    kinds = ["Metric FY2024 FY2023", "Energy 2024 2023", "FY2024 FY2023 FY2022", "Energy 5 6", "Energy | 5", "Water 1,234 (5) 3%", "plain text here", "7 8", "", "Waste n/a –", "In 2024 and 2023 we"]
    pages = {("d", p): [rng.choice(kinds) for _ in range(rng.randint(0, 25))] for p in range(1, 40)}
    rows = [(d, p, k, t or None, 0.9 if k else None) for (d, p), texts in pages.items() for k, t in enumerate(texts)]
    rng.shuffle(rows)
    found = text_tables(spark.createDataFrame(rows, LINE)).collect()
    want = [(p, *r) for (_, p), texts in pages.items() for r in brute_tables(texts)]
    assert sorted((r["page"], r["table_no"], r["row_no"], r["label"], r["values"]) for r in found) == sorted((p, n, k, label, values) for p, n, k, label, values in want)
    assert len(want) > 50 and {r["confidence"] for r in found} == {0.9, 1.0} or {r["confidence"] for r in found} == {0.9}
    assert text_tables(spark.createDataFrame([], LINE)).count() == 0


BOX = "document_id string, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, confidence double, block int"
TABLE = "document_id string, page int, table_no int, x0 double, y0 double, x1 double, y1 double, headers array<string>, rows array<struct<label:string,values:array<string>>>, confidence double"


def test_lines_under_tables_against_all_pairs(spark):
    rng = random.Random(1)
    box = lambda w, h: (lambda x, y: (x, y, x + rng.uniform(0, w), y + rng.uniform(0, h)))(rng.uniform(0, 500), rng.uniform(-50, 700))
    lines = [("d", 1 + k % 3, k, "x", *box(300, 20), 10.0, False, 1.0, 0) for k in range(400)] + [("d", 1, 900, "point", 5.0, 5.0, 5.0, 5.0, 10.0, False, 1.0, 0)]
    tables = [("d", 1 + k % 3, k, *box(400, 300), [], [], 1.0) for k in range(12)]

    def covered(a, b):
        wide, high = min(a[6], b[5]) - max(a[4], b[3]), min(a[7], b[6]) - max(a[5], b[4])
        return wide > 0 and high > 0 and wide * high >= 0.5 * ((a[6] - a[4]) * (a[7] - a[5]) or 1.0)

    want = {a[2] for a in lines if not any(a[1] == b[1] and covered(a, b) for b in tables)}
    frame = outside_tables(spark.createDataFrame(lines, BOX), spark.createDataFrame(tables, TABLE))
    assert {r["line_no"] for r in frame.collect()} == want and 50 < len(want) < 380
    assert "NestedLoop" not in frame._jdf.queryExecution().toString()


def test_passages_of_a_laid_out_document(spark):
    def line(page, no, text, y, size=10.0, bold=False, block=0, height=10.0):
        return ("d", page, no, text, 0.0, float(y), 100.0, y + height, size, bold, 0.9, block)

    lines = [
        line(1, 0, "The Report", 0, 24.0), line(1, 1, "Energy", 40, 14.0), line(1, 2, "We used a sub-", 60), line(1, 3, "stantial part of it and the rest was not used by any of the sites that we own, run or rent in the year", 72),
        line(1, 4, "Another block.", 84, block=1), line(1, 5, "- an item", 120), line(1, 6, "Bold words", 140, bold=True), line(1, 7, "in the table 1 2", 205), line(2, 0, "Water", 0, 14.0), line(2, 1, "Short of it", 30), line(2, 2, "Ends so:", 60, 14.0),
    ]
    tables = [("d", 1, 1, 0.0, 200.0, 200.0, 300.0, ["FY1"], [("Total", ["5"])], 0.7), ("d", 1, 2, 0.0, 320.0, 200.0, 400.0, [], [("None", ["", "6"])], 0.7)]
    rows = layout_passages(spark.createDataFrame(lines, BOX), spark.createDataFrame(tables, TABLE)).orderBy("page", "top", "row_no").collect()
    found = [(r["kind"], r["level"], r["text"]) for r in rows]
    long = "We used a sub-stantial part of it and the rest was not used by any of the sites that we own, run or rent in the year"
    assert found == [
        ("heading", 1, "Energy"), ("paragraph", None, long), ("paragraph", None, "Another block."), ("list_item", None, "- an item"), ("heading", 2, "Bold words"), ("table", None, "Bold words\n | FY1\nTotal | 5"),
        ("table_row", None, "Bold words — Total: FY1: 5"), ("table", None, "Bold words\n\nNone |  | 6"), ("table_row", None, "Bold words — None: : 6"), ("heading", 1, "Water"), ("paragraph", None, "Short of it"), ("paragraph", None, "Ends so:"),
    ]
    assert rows[6]["cells"].asDict(recursive=True) == {"label": "Total", "values": ["5"], "headers": ["FY1"], "caption": "Bold words"}


def test_texts_of_lines_move_once(spark):
    """Lines go by document once; neither windows nor the sizes of the document move them again."""
    lines = spark.createDataFrame([("d", 1, 0, "x", 0.0, 0.0, 9.0, 9.0, 10.0, False, 1.0, 0)], BOX)
    found = blocks(outside_tables(lines, spark.createDataFrame([("d", 1, 1, 0.0, 90.0, 9.0, 99.0, [], [], 1.0)], TABLE))).join(document_sizes(lines).hint("merge"), "document_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "document_id" in line and ", page" not in line and "size" not in line]
    assert sum("REPARTITION" in line for line in moved) == 1 and len(moved) == 2  # lines, and one row a document
