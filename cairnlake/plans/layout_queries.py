"""Queries over lines that are laid out on pages: tables written in lines, blocks and passages by boxes and font sizes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import layout as L
from ..operators import passages as P
from ..sources.tables import table
from .text_queries import LINES_SQL


def text_table_rows(spark, sf_dir):
    """SRC-6: tables of each nation's suppliers, written as lines and read back; a line of too many numbers ends a table, and one row is none."""
    order = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    own = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.format_number(F.floor(F.abs("s_acctbal")), 0).alias("n"), (F.row_number().over(order) + 1).alias("line_no"))
    name, way = F.concat(F.lit("Unit s"), F.col("s_suppkey").cast("string")), F.col("s_suppkey") % 5
    text = F.when(way == 0, F.concat(name, F.lit(" "), "n", F.lit(" ("), "n", F.lit(")"))).when(way == 1, F.concat(name, F.lit(" | "), "n")).when(way == 2, F.concat(name, F.lit(" 1 2 3"))).otherwise(F.concat(name, F.lit(" n/a –")))
    rows = own.select("s_nationkey", "line_no", text.alias("text"), (F.lit(0.99) - way * 0.01).alias("confidence"))
    nations = table(spark, sf_dir, "nation")
    heads = [nations.select(F.col("n_nationkey").alias("s_nationkey"), F.lit(k).alias("line_no"), F.lit(t).alias("text"), F.lit(1.0).alias("confidence")) for k, t in enumerate(["Accounts of a nation", "Account FY2024 FY2023"])]
    lines = rows.unionByName(heads[0]).unionByName(heads[1]).select(F.col("s_nationkey").cast("string").alias("document_id"), F.lit(1).alias("page"), "line_no", "text", "confidence")
    found = L.text_tables(lines)
    return found.select("document_id", "table_no", "row_no", "label", F.array_join("values", ";").alias("values"), F.array_join("headers", ";").alias("headers"), "confidence")


def layout_passages(spark, sf_dir):
    """SEG-4..7, SEG-13: documents' lines on pages of fifteen, with written boxes and sizes and a table over part of some first pages."""
    k, size = F.col("ordinal") % 15, F.when(F.col("ordinal") == 0, 16.0).when(F.col("ordinal") % 15 == 7, 13.0).otherwise(10.0)
    top = (k * 20).cast("double")
    lines = P.lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.col("doc_id").alias("document_id"), F.floor(F.col("ordinal") / 15).cast("int").alias("page0"), F.col("ordinal").alias("line_no"), F.col("line").alias("text"), F.lit(50.0).alias("x0"), top.alias("y0"),
        (F.lit(50.0) + F.least(F.lit(400), 4 * F.length("line"))).alias("x1"), (top + F.when(k % 3 == 2, 10).otherwise(12)).alias("y1"), size.alias("size"), ((F.col("doc_id") + k) % 11 == 0).alias("bold"),
        (F.lit(90) + k % 3 * 3).alias("c"), F.floor(k / 6).alias("block"),
    )
    lines = lines.withColumns({"page": F.col("page0") + 1, "confidence": F.col("c") / 100})
    row = lambda label, *values: F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, values)).alias("values"))
    tables = table(spark, sf_dir, "documents").filter("doc_id % 4 = 0").select(
        F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), F.lit(1).alias("table_no"), F.lit(40.0).alias("x0"), F.lit(98.0).alias("y0"), F.lit(500.0).alias("x1"), F.lit(145.0).alias("y1"),
        F.array(F.lit("FY1"), F.lit("FY2")).alias("headers"), F.array(row("Total", "1", "2"), row("Part", "", "3")).alias("rows"), F.lit(0.8).alias("confidence"),
    )
    found = L.layout_passages(lines, tables)
    return found.select("document_id", "page", "top", "kind", "level", F.coalesce("table_no", F.lit(0)).alias("table_no"), F.coalesce("row_no", F.lit(-1)).alias("row_no"), "confidence", F.md5("text").alias("text"))


QUERIES = {f.__name__: f for f in (text_table_rows, layout_passages)}

ORACLES = {
    "text_table_rows": """WITH s AS (SELECT s_nationkey::VARCHAR AS document_id, s_suppkey, format('{:,}', floor(abs(s_acctbal))::BIGINT) AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r, s_suppkey % 5 AS way FROM supplier),
f AS (SELECT *, min(CASE WHEN way = 2 THEN r END) OVER (PARTITION BY document_id) AS stop FROM s),
k AS (SELECT *, count(*) OVER (PARTITION BY document_id) AS c, min(99 - way) OVER (PARTITION BY document_id) AS sure FROM f WHERE stop IS NULL OR r < stop)
SELECT document_id, 1::BIGINT AS table_no, r - 1 AS row_no, 'Unit s' || s_suppkey AS label, CASE way WHEN 0 THEN n || ';(' || n || ')' WHEN 1 THEN ';' || n ELSE 'n/a;–' END AS "values", 'FY2024;FY2023' AS headers, round(sure / 1e2, 2) AS confidence FROM k WHERE c >= 2""",
    "layout_passages": rf"""WITH {LINES_SQL}, l AS (
  SELECT doc_id, ordinal, ordinal // 15 + 1 AS page, ordinal % 15 AS k, line, CASE WHEN ordinal = 0 THEN 16 WHEN ordinal % 15 = 7 THEN 13 ELSE 10 END AS size, (doc_id + ordinal % 15) % 11 = 0 AS bold,
    90 + ordinal % 3 * 3 AS c FROM lines
), per AS (SELECT doc_id, size, sum(length(line)) AS n, min(ordinal) AS first, max(page) AS last FROM l GROUP BY ALL),
bodies AS (SELECT doc_id, arg_min(size, (-n, first)) AS body, max(last) AS pages FROM per GROUP BY doc_id),
heads AS (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC) - 1 AS level, last = 1 AND pages > 1 AS cover FROM per JOIN bodies USING (doc_id) WHERE size >= body * 115e-2),
content AS (SELECT * FROM l WHERE NOT (doc_id % 4 = 0 AND page = 1 AND k IN (5, 6))),
lagged AS (SELECT *, lag(k) OVER w AS pk, lag(size) OVER w AS ps FROM content WINDOW w AS (PARTITION BY doc_id, page ORDER BY ordinal)),
starts AS (SELECT *, CASE WHEN pk IS NULL OR pk // 6 <> k // 6 OR k * 20 - (pk * 20 + CASE WHEN pk % 3 = 2 THEN 10 ELSE 12 END) >= ps * 9e-1 OR abs(size - ps) >= 6e-1 THEN 1 ELSE 0 END AS st FROM lagged),
numbered AS (SELECT *, sum(st) OVER (PARTITION BY doc_id, page ORDER BY ordinal) AS b FROM starts),
blocks AS (SELECT doc_id, page, b, min(k) * 2e1 AS top, max(size) AS size, bool_and(bold) AS bold, min(c) / 1e2 AS confidence,
  list_reduce(list(line ORDER BY ordinal), lambda x, y: CASE WHEN x LIKE '%-' AND regexp_matches(y, '^\p{{Ll}}') THEN x || y ELSE x || ' ' || y END) AS text FROM numbered GROUP BY ALL),
told AS (SELECT b.*, h.level, coalesce(cover, false) AS cover, (SELECT count(*) FROM heads x WHERE x.doc_id = b.doc_id) AS n_levels,
  (b.size >= body * 115e-2 OR (bold AND length(text) < 90)) AND length(text) < 160 AND NOT regexp_matches(text, '[.:]$') AS heading
  FROM blocks b JOIN bodies USING (doc_id) LEFT JOIN heads h ON h.doc_id = b.doc_id AND h.size = b.size),
named AS (SELECT *, CASE WHEN heading AND cover THEN 'title' WHEN heading THEN 'heading' WHEN regexp_matches(text, '{P.BULLET}') THEN 'list_item' ELSE 'paragraph' END AS kind FROM told),
captions AS (SELECT doc_id, CASE WHEN kind IN ('heading', 'title') OR length(text) < 120 THEN text ELSE '' END AS caption FROM named WHERE page = 1 AND top <= 98 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY top DESC, b DESC) = 1),
tables AS (SELECT doc_id, coalesce(caption, '') AS caption FROM documents LEFT JOIN captions USING (doc_id) WHERE doc_id % 4 = 0)
SELECT doc_id AS document_id, page::INT AS page, top, kind, CASE WHEN kind = 'heading' THEN coalesce(level, n_levels) END::BIGINT AS level, 0::BIGINT AS table_no, -1::BIGINT AS row_no, confidence, md5(text) AS text FROM named WHERE kind <> 'title'
UNION ALL SELECT doc_id, 1, 98e0, 'table', NULL, 1, -1, 8e-1, md5(CASE WHEN caption = '' THEN '' ELSE caption || chr(10) || ' ' END || '| FY1 | FY2' || chr(10) || 'Total | 1 | 2' || chr(10) || 'Part |  | 3') FROM tables
UNION ALL SELECT doc_id, 1, 98e0, 'table_row', NULL, 1, 0, 8e-1, md5(CASE WHEN caption = '' THEN '' ELSE caption || ' — ' END || 'Total: FY1: 1; FY2: 2') FROM tables
UNION ALL SELECT doc_id, 1, 98e0, 'table_row', NULL, 1, 1, 8e-1, md5(CASE WHEN caption = '' THEN '' ELSE caption || ' — ' END || 'Part: FY2: 3') FROM tables""",
}
