"""Documents to citable passages: lines, HTML blocks and tables, kinds, sections, chunks, ids, duplicates, running lines.

A document is one row, and what its lines need of each other (section, chunk) is folded within the row: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.numbers import parse_number
from ..functions.periods import periods_of_labels
from ..functions.text import evidence_id, running_key

#: Characters of a document after which a chunk ends, once a line ends a sentence.
CHUNK = 900
BULLET = r"^\s*(?:[-*•–▪◦●]|\(?(?:[0-9]{1,2}|[a-z])[.)])\s+"


def lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Non-empty trimmed lines with their position; an explode, no shuffle."""
    split = docs.select(F.col(doc_id), *keep, F.posexplode(F.split(text, "\n")).alias("ordinal", "raw"))
    return split.withColumn("line", F.trim("raw")).filter("line <> ''").drop("raw")


def kind_of(line: Column) -> Column:
    """heading: short and without an ending mark; list_item: starts with a bullet; paragraph otherwise."""
    short = (F.length(line) < 60) & ~line.rlike(r"[.:;,!?|]$") & line.rlike(r"^[^a-z]")
    return F.when(line.rlike(BULLET), "list_item").when(short, "heading").otherwise("paragraph")


def join_lines(parts: Column) -> Column:
    """Lines of a block as one text, with blanks between; a hyphen before a small letter stays and takes none."""

    def add(text: Column, part: Column) -> Column:
        return F.when(text == "", part).when(text.endswith("-") & part.rlike(r"^\p{Ll}"), F.concat(text, part)).otherwise(F.concat_ws(" ", text, part))

    return F.trim(F.aggregate(parts, F.lit(""), add))


def _chunk_ends(found: Column) -> Column:
    """Ordinals of the lines after which a chunk ends: CHUNK characters are reached and the line ends a sentence."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("ends"))

    def step(acc: Column, x: Column) -> Column:
        def of(n: Column) -> Column:
            over = (n >= CHUNK) & x["line"].rlike("[.;]$")
            return F.struct(F.when(over, 0).otherwise(n).alias("n"), F.when(over, F.concat(acc["ends"], F.array(x["ordinal"]))).otherwise(acc["ends"]).alias("ends"))

        return let(acc["n"] + F.length(x["line"]) + 1, of)

    return F.aggregate(found, start, step, lambda acc: acc["ends"])


def _by_heading(found: Column, path: Column) -> Column:
    """(section, rows): the rows before the first heading, then from each heading to the next. `path` has (at, section), at from 1."""

    def part(k: Column) -> Column:
        first = F.when(k == 0, 1).otherwise(F.get(path, k - 1)["at"])
        after = F.coalesce(F.get(path, k)["at"], F.size(found) + 1)
        return F.struct(F.get(path, k - 1)["section"].alias("section"), F.slice(found, first, after - first).alias("rows"))

    return F.transform(F.sequence(F.lit(0), F.size(path)), part)


def passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A passage per line: deterministic id, kind, the heading it stands under (a heading stands under itself), and its chunk.

    A chunk ends after a line that ends a sentence (a full stop or semicolon), once it has CHUNK characters.
    """
    trimmed = F.transform(F.split(text, "\n"), lambda raw, k: F.struct(k.alias("ordinal"), F.trim(raw).alias("line")))
    kinds = F.transform(F.filter(trimmed, lambda x: x["line"] != ""), lambda x: F.struct(x["ordinal"].alias("ordinal"), x["line"].alias("line"), kind_of(x["line"]).alias("kind")))
    rows = docs.select(F.col(doc_id), kinds.alias("found"))
    numbered = F.transform("found", lambda x, k: F.struct((k + 1).alias("at"), x["line"].alias("section"), x["kind"].alias("kind")))
    staged = rows.select(doc_id, "found", _chunk_ends(F.col("found")).alias("ends"), F.filter(numbered, lambda x: x["kind"] == "heading").alias("path"))
    parts = staged.select(doc_id, "ends", F.explode_outer(_by_heading(F.col("found"), F.col("path"))).alias("part"))
    # the section leaves the part first, or each row would carry all rows of its part
    each = parts.select(doc_id, "ends", "part.section", "part.rows").select(doc_id, "ends", "section", F.explode_outer("rows").alias("x")).filter("x IS NOT NULL")
    return each.select(
        doc_id,
        evidence_id(F.col(doc_id), F.col("x.ordinal"), F.col("x.line")).alias("passage_id"),
        F.col("x.ordinal").cast("long").alias("ordinal"),
        F.col("x.kind").alias("kind"),
        F.col("x.line").alias("line"),
        "section",
        F.size(F.filter("ends", lambda e: e < F.col("x.ordinal"))).cast("long").alias("chunk"),
    )


#: What is no text of a page, tags that start a block of their own, and those that only end one.
NO_TEXT = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>"
BLOCKS = "h[1-6]|p|li|dt|dd|td|th|caption|blockquote|pre"
STARTS = rf"(?i)<({BLOCKS})(?:\s[^>]*)?/?>"
ENDS = rf"(?i)</?(?:{BLOCKS}|div|ul|ol|dl|table|thead|tbody|tfoot|tr|article|section|nav|header|footer|main|aside|form|figure|body|html|br|hr)(?:\s[^>]*)?/?>"
INLINE = r"<[^>]*>"
#: Character references (fixed values), `&amp;` last.
REFERENCES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def plain_html(html: Column) -> Column:
    """Text of some HTML without tags: references read, white space folded."""
    text = F.regexp_replace(html, INLINE, "")
    for reference, sign in REFERENCES.items():
        text = F.replace(text, F.lit(reference), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def html_passages(pages: DataFrame) -> DataFrame:
    """All text blocks of pages in order, with or without attributes and inner tags: kind, section path, length and text.

    A section is the path of headings above, `h1 › h2`; a heading closes those of its level and below.
    """
    bare = F.regexp_replace("html", NO_TEXT, " ")
    marked = F.regexp_replace(F.regexp_replace(bare, STARTS, "\u0001$1\u0002"), ENDS, "\u0001\u0002")

    def block(piece: Column) -> Column:
        tag = F.when(F.contains(piece, F.lit("\u0002")), F.lower(F.substring_index(piece, "\u0002", 1))).otherwise("")
        return F.struct(tag.alias("tag"), plain_html(F.substring_index(piece, "\u0002", -1)).alias("body"))

    blocks = pages.select("page_id", F.filter(F.transform(F.split(marked, "\u0001"), block), lambda b: b["body"] != "").alias("found"))
    level = F.transform("found", lambda b, k: F.struct((k + 1).alias("at"), F.when(b["tag"].rlike("^h[1-6]$"), F.substring(b["tag"], 2, 1).cast("int")).alias("level"), b["body"].alias("body")))
    headings = F.filter(level, lambda h: h["level"].isNotNull())
    start = F.struct(F.array().cast("array<struct<level:int,body:string>>").alias("stack"), F.array().cast("array<struct<at:int,section:string>>").alias("out"))

    def push(acc: Column, h: Column) -> Column:
        above = F.filter(acc["stack"], lambda s: s["level"] < h["level"])

        def of(stack: Column) -> Column:
            path = F.array_join(F.transform(stack, lambda s: s["body"]), " › ")
            return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(F.struct(h["at"].alias("at"), path.alias("section")))).alias("out"))

        return let(F.concat(above, F.array(F.struct(h["level"].alias("level"), h["body"].alias("body")))), of)

    staged = blocks.withColumn("path", F.aggregate(headings, start, push, lambda acc: acc["out"]))
    numbered = F.transform("found", lambda b, k: F.struct(k.cast("long").alias("ordinal"), b["tag"].alias("tag"), b["body"].alias("body")))
    parts = staged.select("page_id", F.explode_outer(_by_heading(numbered, F.col("path"))).alias("part"))
    each = parts.select("page_id", "part.section", "part.rows").select("page_id", "section", F.explode_outer("rows").alias("b")).filter("b IS NOT NULL")
    tag = F.col("b.tag")
    kind = F.when(tag.startswith("h"), "heading").when(tag.isin("li", "dt", "dd"), "list_item").when(tag.isin("td", "th", "caption"), "table").otherwise("paragraph")
    return each.select("page_id", F.col("b.ordinal").alias("ordinal"), kind.alias("kind"), "section", F.length("b.body").cast("long").alias("n_chars"), F.col("b.body").alias("body"))


def is_header_row(cells: Column) -> Column:
    """Whether a row's cells behind the first name periods (at least half of them) or hold no number; false without any."""
    filled = F.filter(F.slice(cells, F.lit(2), F.greatest(F.size(cells), F.lit(1))), lambda c: c != "")
    read = F.arrays_zip(filled.alias("cell"), periods_of_labels(filled, F.lit("12-31")).alias("period"))
    dated = F.size(F.filter(read, lambda c: c["period"].isNotNull()))
    numeric = F.exists(read, lambda c: parse_number(c["cell"]).isNotNull() & c["period"].isNull())
    return (F.size(filled) > 0) & ((dated >= F.greatest(F.lit(1), F.floor(F.size(filled) / 2))) | ~numeric)


def html_tables(pages: DataFrame) -> DataFrame:
    """Rows of tables of at least two rows and columns: label, headers, values and a text `header: value; ...`.

    Empty rows go, the first row may be a header, rows without a label are left out.
    """
    tables = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<table\b[^>]*>(.*?)</table\s*>"), F.lit(1))).alias("table_no", "inner"))
    cell = r"(?is)<t[dh](?:\s[^>]*)?>(.*?)</t[dh]\s*>"
    rows = F.transform(F.regexp_extract_all("inner", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1)), lambda r: F.transform(F.regexp_extract_all(r, F.lit(cell), F.lit(1)), plain_html))
    filled = tables.withColumn("grid", F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))).filter((F.size("grid") >= 2) & (F.array_max(F.transform("grid", F.size)) >= 2))
    headed = filled.withColumn("headed", is_header_row(F.get("grid", F.lit(0))))
    body = F.when(F.col("headed"), F.slice("grid", 2, 1 << 20)).otherwise(F.col("grid"))
    headers = F.when(F.col("headed"), F.slice(F.get("grid", F.lit(0)), 2, 1 << 20)).otherwise(F.array().cast("array<string>"))
    each = headed.select("page_id", "table_no", headers.alias("headers"), F.posexplode(body).alias("row_no", "cells"))
    labelled = each.withColumns({"label": F.get("cells", F.lit(0)), "values": F.slice("cells", 2, 1 << 20)}).filter("label <> ''")
    named = F.transform("values", lambda v, k: F.concat_ws(": ", F.get("headers", k), v))
    return labelled.select("page_id", "table_no", "row_no", "label", "headers", "values", F.concat(F.col("label"), F.lit(" | "), F.array_join(named, "; ")).alias("text"))


def numeric_tail(line: Column) -> Column:
    """A line's label and the numbers it ends with, as struct<label, values>; null if it has no label or no numbers."""
    number = r"(?:[-−(]?[0-9.,]+%?\)?|[—–-]|n/?a)"
    values = F.trim(F.regexp_extract(line, rf"(?i)((?:\s+{number})+)\s*$", 1))
    label = F.trim(F.regexp_replace(line, rf"(?i)(?:\s+{number})+\s*$", ""))
    return F.when((values != "") & (label != "") & ~label.rlike(rf"(?i)^{number}$"), F.struct(label.alias("label"), F.split(values, r"\s+").alias("values")))


def running_lines(docs: DataFrame, *, group: str, page: str, margin: float | None = None) -> DataFrame:
    """Keys of lines with the number of a group's pages that carry them: headers and footers are carried by many.

    With `margin` only lines in that share of a page's lines at its top or bottom count. Pages per key are counted exactly
    with a distinct before the count, both combined on the map side.
    """
    keyed = _keyed_lines(docs, group, page)
    if margin is not None:
        keyed = keyed.filter(_in_margin(margin))
    keys = keyed.select("__group", "__page", "key").filter("key <> ''").distinct()
    return keys.groupBy("__group", "key").agg(F.count("*").alias("pages")).withColumnRenamed("__group", group)


def _keyed_lines(docs: DataFrame, group: str, page: str) -> DataFrame:
    named = docs.select(F.col(page).alias("__page"), F.col(group).alias("__group"), "text", F.size(F.split("text", "\n")).alias("__n"))
    return lines(named, doc_id="__page", keep=("__group", "__n")).withColumn("key", running_key(F.col("line")))


def _in_margin(margin: float) -> Column:
    middle = (F.col("ordinal") + 0.5) / F.col("__n")
    return (middle < margin) | (middle > 1 - margin)


def without_running_lines(docs: DataFrame, *, group: str, page: str, margin: float = 0.09, share: float = 0.5) -> DataFrame:
    """Lines of pages (page, group, ordinal, line) without margin lines that at least max(2, share) of the group's pages carry,
    and without margin lines of one to four digits."""
    total = docs.groupBy(F.col(group).alias("__group")).agg(F.countDistinct(page).alias("__pages"))
    keys = running_lines(docs, group=group, page=page, margin=margin).withColumnRenamed(group, "__group").join(total, "__group")
    gone = keys.filter(F.col("pages") >= F.greatest(F.lit(2), F.floor(share * F.col("__pages")))).select("__group", "key", F.lit(True).alias("__gone"))
    marked = _keyed_lines(docs, group, page).withColumn("__margin", _in_margin(margin)).join(gone, ["__group", "key"], "left")
    kept = marked.filter(~(F.col("__margin") & (F.coalesce("__gone", F.lit(False)) | F.col("line").rlike("^[0-9]{1,4}$"))))
    return kept.select(F.col("__page").alias(page), F.col("__group").alias(group), F.col("ordinal").cast("long").alias("ordinal"), "line")


def duplicate_documents(docs: DataFrame) -> DataFrame:
    """Documents whose text another has with a smaller id; copies meet by hash, minima are combined before the shuffle."""
    hashed = docs.select("doc_id", F.sha2("text", 256).alias("sha256"))
    first = hashed.groupBy("sha256").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")
    return hashed.join(first, "sha256").filter("doc_id <> first_id").select("doc_id", "first_id", "copies", "sha256")


def versions(records: DataFrame, *, lineage: str, order: list[str], record: str) -> DataFrame:
    """Version numbers within a lineage; a record is superseded by the next one."""
    window = Window.partitionBy(lineage).orderBy(*order)
    return records.select(lineage, record, *[c for c in order if c != record], F.row_number().over(window).cast("long").alias("version"), F.lead(record).over(window).alias("superseded_by"))


def weighted_mode(rows: DataFrame, *, by: str, value: str, weight: str, position: str) -> DataFrame:
    """The value with the largest summed weight; ties go to the one seen first."""
    summed = rows.groupBy(by, value).agg(F.sum(weight).alias("weight"), F.min(position).alias("first_seen"))
    best = F.min_by(F.struct(F.col(value), F.col("weight")), F.struct(-F.col("weight"), F.col("first_seen")))
    return summed.groupBy(by).agg(best.alias("best")).select(by, F.col(f"best.{value}").alias(value), F.col("best.weight").alias("weight"))
