"""Lines with boxes and font sizes to blocks, headings, tables and passages of pages.

`lines` has document_id, page, line_no, text, x0, y0, x1, y1, size, bold, confidence and block (of the source); `tables` document_id,
page, table_no, x0, y0, x1, y1, headers, rows (label and values) and confidence. Work is by page or document: windows over a page's
lines, small tables of sizes a document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.periods import _label
from ..sources.scratch import materialise
from .passages import BULLET, join_lines

#: How much larger than the body a heading is, and the gap (in sizes) and difference in size within a block (fixed values).
HEADING, GAP, SAME_SIZE = 1.15, 0.9, 0.6
#: Share of a line within a table that makes it the table's, and the side of a grid cell in points.
COVERED, CELL = 0.5, 96.0
#: Longest bold text that is a heading, longest heading, longest caption (fixed values).
BOLD, LONGEST, CAPTION = 90, 160, 120
_PAGE = ("document_id", "page")


def document_sizes(lines: DataFrame) -> DataFrame:
    """document_id, body (the font size of most characters, of equal ones that seen first) and heads: sizes of headings with level (from 0,
    the largest first) and cover_only (those of the first page of several alone are the title's)."""
    per = lines.groupBy("document_id", "size").agg(F.sum(F.length("text")).alias("n"), F.min(F.struct("page", "line_no")).alias("first"), F.max("page").alias("last"))
    own = per.groupBy("document_id").agg(F.min_by("size", F.struct(-F.col("n"), "first")).alias("body"), F.max("last").alias("pages"), F.sort_array(F.collect_list(F.struct("size", "last")), asc=False).alias("sizes"))
    large = F.filter("sizes", lambda x: x["size"] >= F.col("body") * HEADING)
    heads = F.transform(large, lambda x, k: F.struct(x["size"].alias("size"), k.alias("level"), ((x["last"] == 1) & (F.col("pages") > 1)).alias("cover_only")))
    return own.select("document_id", "body", heads.alias("heads"))


def outside_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines that no table covers by half or more of their area.

    A rectangle that is covered by half has its middle in the cover, so a line is looked for in the one grid cell of its middle,
    and a table in the cells that it touches: an equi-join, without pairs of all lines and tables of a page.
    """
    cell = lambda x: F.floor(x / CELL).cast("int")
    own = tables.select(*_PAGE, *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    spread = own.withColumn("cx", F.explode(F.sequence(cell(F.col("t_x0")), cell(F.col("t_x1"))))).withColumn("cy", F.explode(F.sequence(cell(F.col("t_y0")), cell(F.col("t_y1")))))
    placed = lines.select(*_PAGE, "line_no", "x0", "y0", "x1", "y1", cell((F.col("x0") + F.col("x1")) / 2).alias("cx"), cell((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    wide, high = F.least("x1", "t_x1") - F.greatest("x0", "t_x0"), F.least("y1", "t_y1") - F.greatest("y0", "t_y0")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    met = placed.join(spread, [*_PAGE, "cx", "cy"]).filter((wide > 0) & (high > 0) & (wide * high >= COVERED * F.when(area > 0, area).otherwise(1.0)))
    # marks of covered lines go with the lines by document, which is how all that follows wants them: texts move once
    marks = met.select(*_PAGE, "line_no").distinct().withColumn("__met", F.lit(True))
    both = lines.withColumn("__met", F.lit(False)).unionByName(marks, allowMissingColumns=True).repartition("document_id")
    covered = F.max("__met").over(Window.partitionBy(*_PAGE, "line_no"))
    return both.withColumn("__covered", covered).filter("NOT __met AND (NOT __covered OR document_id IS NULL OR page IS NULL OR line_no IS NULL)").drop("__met", "__covered")


def blocks(lines: DataFrame) -> DataFrame:
    """Lines grouped where they stand together: of one source block, less than 0.9 of the size apart, of nearly one size.

    document_id, page, block_no, text, x0, y0, x1, y1, size (the largest), bold (all are), confidence (the least) and the lines.
    """
    order = Window.partitionBy(*_PAGE).orderBy("line_no")
    before = {c: F.lag(c).over(order) for c in ("block", "y1", "size")}
    apart = before["block"].isNull() | (F.col("block") != before["block"]) | (F.col("y0") - before["y1"] >= before["size"] * GAP) | (F.abs(F.col("size") - before["size"]) >= SAME_SIZE)
    staged = lines.withColumn("starts", apart.cast("int")).withColumn("block_no", F.sum("starts").over(order))
    listed = F.sort_array(F.collect_list(F.struct("line_no", "text", "size")))
    found = staged.groupBy(*_PAGE, "block_no").agg(
        listed.alias("own"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("size").alias("size"), F.bool_and("bold").alias("bold"),
        F.round(F.min("confidence"), 2).alias("confidence"),
    )
    return found.withColumn("text", join_lines(F.transform("own", lambda x: x["text"])))


def layout_passages(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Passages of pages: headings with their level, paragraphs, list items, tables and their rows, in the order of their tops.

    document_id, page, top, kind, level (of headings), text, table_no, row_no, cells (of rows: label, values, headers, caption) and
    confidence. A table's caption is the block before it on its page, if that is a heading or short; titles (headings of a size that
    is on the cover alone) make no passage.
    """
    grouped = blocks(outside_tables(lines, tables)).filter("text <> ''").join(document_sizes(lines), "document_id")
    head = F.get(F.filter("heads", lambda h: h["size"] == F.col("size")), F.lit(0))
    grouped = grouped.withColumns({"level": head["level"], "cover_only": head["cover_only"], "n_levels": F.size("heads")})
    large = F.col("size") >= F.col("body") * HEADING
    heading = (large | (F.col("bold") & (F.length("text") < BOLD))) & (F.length("text") < LONGEST) & ~F.col("text").rlike("[.:]$")
    told = grouped.withColumn("heading", heading).withColumn("kind", F.when(F.col("heading") & F.coalesce("cover_only", F.lit(False)), "title").when(F.col("heading"), "heading").when(F.col("text").rlike(BULLET), "list_item").otherwise("paragraph"))
    level = F.when(F.col("kind") == "heading", F.coalesce("level", "n_levels", F.lit(0)))
    row = "array<struct<label:string,values:array<string>>>"
    shown = told.select(
        *_PAGE, F.col("y0").alias("top"), F.lit(0).alias("later"), F.col("block_no").cast("long").alias("nth"), "kind", level.cast("long").alias("level"), "text", "confidence",
        F.lit(None).cast("array<string>").alias("headers"), F.lit(None).cast(row).alias("rows"),
    )
    boxed = tables.select(
        *_PAGE, F.col("y0").alias("top"), F.lit(1).alias("later"), F.col("table_no").cast("long").alias("nth"), F.lit("table").alias("kind"), F.lit(None).cast("long").alias("level"), F.lit("").alias("text"), "confidence",
        "headers", F.col("rows").cast(row).alias("rows"),
    )
    shown = materialise(shown, "layout-blocks")  # prose, tables and rows read it
    order = Window.partitionBy(*_PAGE).orderBy("top", "later", "nth")
    short = F.when(F.col("kind").isin("heading", "title") | (F.length("text") < CAPTION), F.col("text")).otherwise("")
    last = F.last(F.when(F.col("kind") != "table", short), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # only blocks that can be captions meet the tables, and only on their pages
    near = shown.withColumn("text", short).join(tables.select(*_PAGE).distinct(), [*_PAGE], "left_semi")
    grid = near.unionByName(boxed).withColumn("caption", F.coalesce(last, F.lit(""))).filter("kind = 'table'")
    plain = shown.filter("kind <> 'title'")
    empty = "struct<label:string,values:array<string>,headers:array<string>,caption:string>"
    kept = [*_PAGE, "top", "kind", "level", "text", "confidence"]
    prose = plain.select(*kept, F.lit(None).cast("long").alias("table_no"), F.lit(None).cast("long").alias("row_no"), F.lit(None).cast(empty).alias("cells"))
    line = F.transform("rows", lambda r: F.concat(r["label"], F.lit(" | "), F.array_join(r["values"], " | ")))
    head = F.when(F.size("headers") > 0, F.concat(F.lit(" | "), F.array_join("headers", " | "))).otherwise("")
    whole = F.trim(F.concat_ws("\n", "caption", head, F.array_join(line, "\n")))
    whole = F.regexp_replace(whole, r"^\s+|\s+$", "")
    table = grid.select(*_PAGE, "top", "kind", "level", whole.alias("text"), "confidence", F.col("nth").alias("table_no"), F.lit(None).cast("long").alias("row_no"), F.lit(None).cast(empty).alias("cells"))
    each = grid.select(*_PAGE, "top", "confidence", "headers", "caption", F.col("nth").alias("table_no"), F.posexplode("rows").alias("row_no", "r"))
    named = F.transform(F.col("r.values"), lambda v, k: F.when(v != "", F.concat(F.coalesce(F.get("headers", k), F.lit("")), F.lit(": "), v)))
    text = F.concat(F.when(F.col("caption") != "", F.concat("caption", F.lit(" — "))).otherwise(""), F.col("r.label"), F.lit(": "), F.array_join(F.array_compact(named), "; "))
    cells = F.struct(F.col("r.label").alias("label"), F.col("r.values").alias("values"), "headers", "caption").cast(empty)
    rows = each.select(*_PAGE, "top", F.lit("table_row").alias("kind"), F.lit(None).cast("long").alias("level"), text.alias("text"), "confidence", "table_no", F.col("row_no").cast("long").alias("row_no"), cells.alias("cells"))
    return prose.unionByName(table).unionByName(rows)


_TAIL = re.compile(r"[-−(]?[\d.,]+%?\)?|[—–-]|n/?a", re.IGNORECASE)
_BARS = {"|", "¦", "I|"}
_ROW = T.StructType([
    T.StructField("document_id", T.StringType()), T.StructField("page", T.LongType()), T.StructField("table_no", T.LongType()), T.StructField("row_no", T.LongType()), T.StructField("line_no", T.LongType()),
    T.StructField("label", T.StringType()), T.StructField("values", T.ArrayType(T.StringType())), T.StructField("headers", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType()),
])


def _parted(text: str) -> tuple[list[str], list[str]]:
    """A line's label words and the numbers that it ends with."""
    words = [w for w in text.split() if w not in _BARS]
    k = len(words)
    while k and _TAIL.fullmatch(words[k - 1].strip("|")):
        k -= 1
    return words[:k], [w.strip("|") for w in words[k:]]


class _Tables:
    """One page's lines, one after the other: a line that names two periods or more opens a table, lines of a label and no more
    numbers than periods are its rows, anything else ends it. A table of fewer than two rows is none; its only row may open another."""

    def __init__(self):
        self.headers: list[str] = []
        self.lines: list[tuple[int, float, list[str], list[str], list[str]]] = []
        self.tables = 0

    def add(self, line_no: int, text: str, confidence: float) -> list[tuple]:
        label, values = _parted(text)
        line = (line_no, confidence, label, values, [w for w in text.split() if _label(w, "12-31")])
        out: list[tuple] = []
        while True:
            if self.headers and label and values and len(values) <= len(self.headers):
                self.lines.append(line)
                return out
            out += self.end()
            if not self.lines:
                break
        self._open(line)
        return out

    def _open(self, line: tuple) -> None:
        self.headers, self.lines = (line[4], [line]) if len(line[4]) >= 2 else ([], [])

    def end(self) -> list[tuple]:
        """The rows of the open table if it is one; what is left is reopened where its only row can be a header."""
        headers, lines = self.headers, self.lines
        self.headers, self.lines = [], []
        if len(lines) >= 3:
            self.tables += 1
            sure = round(min(x[1] for x in lines), 2)
            return [(self.tables, k, x[0], " ".join(x[2]), [""] * (len(headers) - len(x[3])) + x[3], headers, sure) for k, x in enumerate(lines[1:])]
        if len(lines) == 2:
            self._open(lines[1])
        return []


def text_tables(lines: DataFrame) -> DataFrame:
    """Rows of tables that are written in lines (document_id, page, line_no, text, confidence): a header of two or more periods, then at
    least two lines of a label and numbers, which stand under the last periods. Confidence is the least of the table's lines.

    Pages are sorted within partitions and read line by line; a task holds one open table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, work, out = None, _Tables(), []

        def end() -> list[tuple]:
            rows = work.end()
            return [(*place, *r) for r in rows + work.end()] if place else []

        for batch in batches:
            for document, page, line_no, text, confidence in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (document, page) != place:
                    out += end()
                    place, work = (document, page), _Tables()
                out += [(document, page, *r) for r in work.add(line_no, text or "", 1.0 if confidence is None else confidence)]
            if out:
                yield _batch(out)
                out = []
        out += end()
        if out:
            yield _batch(out)

    own = lines.select(F.col("document_id").cast("string"), F.col("page").cast("long"), F.col("line_no").cast("long"), "text", F.col("confidence").cast("double"))
    return own.repartition("document_id", "page").sortWithinPartitions("document_id", "page", "line_no").mapInArrow(run, _ROW)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_ROW.names)
