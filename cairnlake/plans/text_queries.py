"""Queries over texts: segmentation, ids, duplicates, versions, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import parse_number
from ..functions.text import STOP_WORDS, evidence_id, sentences
from ..operators import passages as P
from ..operators import postings as PX
from ..operators import retrieval as R
from ..sources.tables import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def passage_segmentation(spark, sf_dir):
    """SEG-9, SEG-11, SEG-12, SEG-17: passages of documents with kind, section (the last heading) and chunk."""
    found = P.passages(_docs(spark, sf_dir))
    return found.select("doc_id", "passage_id", "ordinal", "kind", "chunk", F.coalesce("section", F.lit("")).alias("section"))


def html_passages(spark, sf_dir):
    """SEG-9..11: all text blocks of pages, each with the path of headings above."""
    found = P.html_passages(table(spark, sf_dir, "pages").select("page_id", "html"))
    return found.withColumn("body", F.sha2("body", 256))


def html_table_rows(spark, sf_dir):
    """SRC-5, SEG-13, SEG-14: tables of suppliers' balances written as HTML and read back row by row."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.floor("s_acctbal").cast("string").alias("n"))
    row = F.concat(F.lit("<tr class='r'><td><b>Supplier "), F.col("s_suppkey").cast("string"), F.lit("</b></td><td>"), F.col("n"), F.lit("</td><td>n/a &amp; -</td></tr>"))
    rows = suppliers.groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("row")))), lambda x: x["row"]), "").alias("rows"))
    head = F.when(F.col("s_nationkey") % 2 == 0, "<tr><th>Name</th><th>FY2024</th><th>FY2023</th></tr>").otherwise("<tr><td> </td></tr><tr><td></td><td>1</td><td>2</td></tr>")
    html = F.concat(F.lit("<p>x</p><TABLE id=t>"), head, F.col("rows"), F.lit("</TABLE>"))
    return P.html_tables(rows.select(F.col("s_nationkey").cast("long").alias("page_id"), html.alias("html"))).select("page_id", "row_no", "label", "text")


def running_line_removal(spark, sf_dir):
    """SEG-2: lines that several documents of a source repeat, and whether half of them do."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    total = docs.groupBy("source").agg(F.countDistinct("doc_id").alias("n"))
    keys = P.running_lines(docs, group="source", page="doc_id").join(total, "source")
    return keys.filter("pages >= 2").select("source", "key", "pages", (F.col("pages") >= F.greatest(F.lit(2), F.floor(0.5 * F.col("n")))).alias("removed"))


def margin_lines_removed(spark, sf_dir):
    """SEG-3: documents' lines without running headers, footers and page numbers, a source's documents being its pages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("Report of "), F.col("source"), F.lit(" 12\n"), F.col("text"), F.lit("\n"), F.col("doc_id").cast("string")).alias("text"))
    left = P.without_running_lines(docs, group="source", page="doc_id")
    return left.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def evidence_ids(spark, sf_dir):
    """SEG-17, SEG-18: deterministic ids; equal passages of a document collapse."""
    lines = P.lines(_docs(spark, sf_dir))
    return lines.select("doc_id", evidence_id(F.col("doc_id"), F.lit(1), F.col("line")).alias("passage_id")).groupBy("doc_id", "passage_id").agg(F.count("*").alias("n"))


def duplicate_documents(spark, sf_dir):
    """SEG-20: documents with the text of an earlier one."""
    return P.duplicate_documents(_docs(spark, sf_dir))


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("o_orderdate"))


def document_versions(spark, sf_dir):
    """SEG-21: versions of each lineage and what supersedes them."""
    return P.versions(_orders(spark, sf_dir), lineage="o_custkey", order=["o_orderdate", "o_orderkey"], record="o_orderkey")


def current_documents(spark, sf_dir):
    """FIL-1: the version that nothing supersedes."""
    return document_versions(spark, sf_dir).filter("superseded_by IS NULL").drop("superseded_by")


def weighted_mode_period(spark, sf_dir):
    """SEG-16: the year most of a customer's orders speak for, urgent ones three times; ties to the first seen."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").cast("long").alias("year"), F.when(F.col("o_orderpriority") == "1-URGENT", 3).otherwise(1).alias("w"))
    return P.weighted_mode(orders, by="o_custkey", value="year", weight="w", position="o_orderkey")


def tokenize_terms(spark, sf_dir):
    """SCL-27, AGG-26: tokens per document, all and distinct."""
    from ..functions.text import tokens

    return _docs(spark, sf_dir).select("doc_id", tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


def _passages(spark, sf_dir):
    return P.passages(_docs(spark, sf_dir))


def term_doc_frequency(spark, sf_dir):
    """AGG-26: document frequency and total frequency of every term over passages."""
    return R.term_statistics(_passages(spark, sf_dir))


def bm25_search(spark, sf_dir):
    """DOM-1, WIN-9, SRT-1: the eight best passages by BM25 for each item's whole text, from a stored index that skips blocks."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return PX.search(spark, PX.indexed(_passages(spark, sf_dir)), items)


def bm25_search_whole(spark, sf_dir):
    """DOM-1..3, WIN-9, SRT-1: the eight best passages for each item's whole text, its sentences being the phrases and its words the section terms."""
    words = F.split(F.trim(F.regexp_replace("text", r"[^A-Za-z0-9]+", " ")), " ")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.array_distinct(sentences(F.trim("text"))).alias("phrases"), F.filter(F.array_distinct(words), lambda w: w != "").alias("section_terms"))
    return R.bm25(_passages(spark, sf_dir), items)


def phrase_match(spark, sf_dir):
    """JN-16: how many of an item's distinct sentences a document contains, white space folded."""
    split = F.array_distinct(F.transform(sentences(F.trim("text")), lambda s: F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))))
    phrases = table(spark, sf_dir, "benchmark").select("item_id", F.explode(split).alias("phrase")).filter("phrase <> ''")
    found = R.phrase_matches(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), phrases.select(F.struct("item_id", "phrase").alias("phrase_id"), "phrase"))
    return found.groupBy(F.col("id").alias("doc_id"), F.col("phrase_id.item_id").alias("item_id")).agg(F.count("*").alias("sentences"))


def phrase_match_whole(spark, sf_dir):
    """JN-16: how many of an item's windows of eight words (the whole item, if it has fewer) a document contains."""
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), " ")
    items = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w"))
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 7, F.lit(1))), lambda k: F.array_join(F.slice("w", k, F.lit(8)), " "))
    phrases = items.filter("w IS NOT NULL").select("item_id", F.explode(F.array_distinct(windows)).alias("phrase")).filter("phrase <> ''")
    found = R.phrase_matches(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), phrases.select(F.struct("item_id", "phrase").alias("phrase_id"), "phrase"))
    return found.groupBy(F.col("id").alias("doc_id"), F.col("phrase_id.item_id").alias("item_id")).agg(F.count("*").alias("windows"))


def sentence_split(spark, sf_dir):
    """SCL-22: sentences per document and the longest of them."""
    split = _docs(spark, sf_dir).select("doc_id", sentences(F.col("text")).alias("s"))
    return split.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"))


def number_parsing(spark, sf_dir):
    """SCL-1, SCL-2: numbers written in eight ways and read back; spaced thousands only count where they are the whole cell."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    whole = F.floor(cents / 100)
    grouped = F.format_number(whole, 0)
    way = F.col("o_orderkey") % 8
    raw = (
        F.when(way == 0, grouped)
        .when(way == 1, F.concat(F.lit("("), grouped, F.lit(")")))
        .when(way == 2, F.concat(F.lit("$"), F.regexp_replace(grouped, ",", " ")))
        .when(way == 3, F.concat((whole % 1000).cast("string"), F.lit(".5 million")))
        .when(way == 4, F.concat(F.lit("–"), whole.cast("string"), F.lit(" thousand")))
        .when(way == 5, F.regexp_replace(grouped, ",", " "))
        .when(way == 6, F.concat(F.lit("about "), whole.cast("string"), F.lit(" lakh, say")))
        .otherwise(F.element_at(F.array(F.lit("–"), F.lit("n/a"), F.lit("")), (F.col("o_orderkey") % 3 + 1).cast("int")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", "raw", parse_number(F.col("raw")).alias("value"))


_BULLET_SQL = P.BULLET
LINES_SQL = f"""lines AS (
  SELECT doc_id, (k - 1)::BIGINT AS ordinal, trim(raw, ' ') AS line FROM (
    SELECT doc_id, unnest(s) AS raw, generate_subscripts(s, 1) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) WHERE trim(raw, ' ') <> ''
), kinds AS (
  SELECT *, CASE WHEN regexp_matches(line, '{_BULLET_SQL}') THEN 'list_item'
    WHEN length(line) < 60 AND NOT regexp_matches(line, '[.:;,!?|]$') AND regexp_matches(line, '^[^a-z]') THEN 'heading' ELSE 'paragraph' END AS kind FROM lines
), folds AS (
  SELECT doc_id, list(ordinal ORDER BY ordinal) AS os, list_reduce(list({{'n': length(line)::BIGINT + 1, 'e': regexp_matches(line, '[.;]$'), 'c': 0::BIGINT, 'h': [0::BIGINT]}} ORDER BY ordinal),
    lambda a, b: {{'n': CASE WHEN a.n >= 900 AND a.e THEN 0 ELSE a.n END + b.n, 'e': b.e, 'c': a.c + (a.n >= 900 AND a.e)::BIGINT, 'h': list_append(a.h, a.c + (a.n >= 900 AND a.e)::BIGINT)}}) AS r
  FROM lines GROUP BY doc_id
), chunks AS (SELECT doc_id, unnest(os) AS ordinal, unnest(r.h) AS chunk FROM folds),
passages AS (
  SELECT doc_id, 'ev_' || substr(sha256(doc_id || '|' || ordinal || '|' || line), 1, 20) AS passage_id, ordinal, kind, line,
    last_value(CASE WHEN kind = 'heading' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS section, chunk
  FROM kinds JOIN chunks USING (doc_id, ordinal)
)"""
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_STEM = """CASE WHEN length(t) > 4 AND t LIKE '%ies' THEN t[:-4] || 'y' WHEN length(t) > 4 AND regexp_matches(t, '[sxz]es$') THEN t[:-3]
  WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN t[:-2] ELSE t END"""


def tokens_sql(column: str) -> str:
    return f"[{_STEM} for t in regexp_extract_all(lower({column}), '[a-z0-9]+') if t not in ({_STOP})]"


POSTINGS_SQL = f"""tokenised AS (SELECT passage_id, kind, section, line, {tokens_sql("line")} AS ts FROM passages),
postings AS (SELECT passage_id, term, count(*) AS tf, max(greatest(len(ts), 1)) AS length FROM (SELECT passage_id, ts, unnest(ts) AS term FROM tokenised) GROUP BY passage_id, term)"""
_SENTENCES_SQL = r"string_split(regexp_replace(trim(text, ' '), '([.;!?])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1))"
_SCORED_SQL = f"""wanted AS (SELECT DISTINCT item_id AS query_id, unnest({tokens_sql("text")}) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
n AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS mean FROM tokenised),
scored AS (
  SELECT query_id, passage_id, sum(round(ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * (tf * 24e-1 / (tf + 14e-1 * (1 - 75e-2 + 75e-2 * length / mean))), 9)::DECIMAL(28, 9))::DOUBLE AS raw
  FROM postings JOIN df USING (term) JOIN wanted USING (term), n GROUP BY ALL
)"""
_VERSIONS_SQL = """SELECT o_custkey, o_orderkey, o_orderdate::DATE::VARCHAR AS o_orderdate, row_number() OVER w AS version, lead(o_orderkey) OVER w AS superseded_by
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""

QUERIES = {
    f.__name__: f
    for f in (
        passage_segmentation, html_passages, html_table_rows, running_line_removal, margin_lines_removed, evidence_ids, duplicate_documents, document_versions, current_documents, weighted_mode_period,
        tokenize_terms, term_doc_frequency, bm25_search, bm25_search_whole, phrase_match, phrase_match_whole, sentence_split, number_parsing,
    )
}

ORACLES = {
    "passage_segmentation": f"WITH {LINES_SQL} SELECT doc_id, passage_id, ordinal, kind, chunk, coalesce(section, '') AS section FROM passages",
    "html_passages": f"""WITH marked AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '{P.NO_TEXT}', ' ', 'g'), '{P.STARTS}', chr(1) || '\\1' || chr(2), 'g'), '{P.ENDS}', chr(1) || chr(2), 'g') AS m FROM pages),
pieces AS (SELECT page_id, unnest(string_split(m, chr(1))) AS piece, generate_subscripts(string_split(m, chr(1)), 1) AS k FROM marked),
texts AS (SELECT page_id, k, CASE WHEN contains(piece, chr(2)) THEN lower(split_part(piece, chr(2), 1)) ELSE '' END AS tag, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(string_split(piece, chr(2))[-1], '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g'), ' ') AS body FROM pieces),
blocks AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS ordinal FROM texts WHERE body <> ''),
heads AS (SELECT page_id, ordinal, body, tag[2:]::INT AS level FROM blocks WHERE regexp_matches(tag, '^h[1-6]$')),
paths AS (SELECT i.page_id, i.ordinal, string_agg(j.body, ' › ' ORDER BY j.ordinal) AS path FROM heads i JOIN heads j ON j.page_id = i.page_id AND j.ordinal <= i.ordinal
  WHERE NOT EXISTS (SELECT 1 FROM heads k WHERE k.page_id = i.page_id AND k.ordinal > j.ordinal AND k.ordinal <= i.ordinal AND k.level <= j.level) GROUP BY ALL)
SELECT b.page_id, b.ordinal, CASE WHEN tag LIKE 'h%' THEN 'heading' WHEN tag IN ('li', 'dt', 'dd') THEN 'list_item' WHEN tag IN ('td', 'th', 'caption') THEN 'table' ELSE 'paragraph' END AS kind,
  last_value(path IGNORE NULLS) OVER (PARTITION BY b.page_id ORDER BY b.ordinal ROWS UNBOUNDED PRECEDING) AS section, length(body)::BIGINT AS n_chars, sha256(body) AS body
FROM blocks b LEFT JOIN paths p ON p.page_id = b.page_id AND p.ordinal = b.ordinal""",
    "html_table_rows": """WITH s AS (SELECT s_nationkey::BIGINT AS page_id, s_suppkey, floor(s_acctbal)::BIGINT::VARCHAR AS n, s_nationkey % 2 = 0 AS headed, count(*) OVER (PARTITION BY s_nationkey) AS c,
  row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier)
SELECT page_id, (r - CASE WHEN headed THEN 1 ELSE 0 END)::INT AS row_no, 'Supplier ' || s_suppkey AS label,
  'Supplier ' || s_suppkey || ' | ' || CASE WHEN headed THEN 'FY2024: ' || n || '; FY2023: n/a & -' ELSE n || '; n/a & -' END AS text FROM s""",
    "running_line_removal": f"""WITH {LINES_SQL}, keyed AS (
  SELECT DISTINCT source, doc_id, trim(regexp_replace(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g'), '[0-9]+', '#', 'g'), ' ') AS key FROM lines JOIN documents USING (doc_id)),
totals AS (SELECT source, count(DISTINCT doc_id) AS n FROM documents GROUP BY source)
SELECT source, key, count(*) AS pages, count(*) >= greatest(2, floor(5e-1 * any_value(n))) AS removed FROM keyed JOIN totals USING (source)
WHERE length(key) > 0 GROUP BY source, key HAVING count(*) >= 2""",
    "margin_lines_removed": """WITH d AS (SELECT doc_id, source, string_split('Report of ' || source || ' 12' || chr(10) || text || chr(10) || doc_id, chr(10)) AS s FROM documents),
l AS (SELECT doc_id, source, len(s) AS n, unnest(s) AS raw, generate_subscripts(s, 1) - 5e-1 AS pos FROM d),
k AS (SELECT doc_id, source, trim(raw, ' ') AS line, pos / n < 9e-2 OR pos / n > 1 - 9e-2 AS margin, trim(regexp_replace(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g'), '[0-9]+', '#', 'g'), ' ') AS key FROM l WHERE trim(raw, ' ') <> ''),
g AS (SELECT source, key FROM k WHERE margin AND key <> '' GROUP BY source, key HAVING count(DISTINCT doc_id) >= greatest(2, floor(5e-1 * (SELECT count(DISTINCT doc_id) FROM documents x WHERE x.source = k.source))))
SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM k LEFT JOIN g USING (source, key) WHERE NOT (margin AND (g.key IS NOT NULL OR regexp_matches(line, '^[0-9]{1,4}$'))) GROUP BY doc_id""",
    "evidence_ids": f"WITH {LINES_SQL} SELECT doc_id, 'ev_' || substr(sha256(doc_id || '|1|' || line), 1, 20) AS passage_id, count(*) AS n FROM lines GROUP BY ALL",
    "duplicate_documents": """WITH h AS (SELECT doc_id, sha256(text) AS sha256 FROM documents), f AS (SELECT sha256, min(doc_id) AS first_id, count(*) AS copies FROM h GROUP BY sha256 HAVING count(*) > 1)
SELECT doc_id, first_id, copies, sha256 FROM h JOIN f USING (sha256) WHERE doc_id <> first_id""",
    "document_versions": _VERSIONS_SQL,
    "current_documents": f"SELECT o_custkey, o_orderkey, o_orderdate, version FROM ({_VERSIONS_SQL}) WHERE superseded_by IS NULL",
    "weighted_mode_period": """WITH s AS (SELECT o_custkey, year(o_orderdate) AS year, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 3 ELSE 1 END)::BIGINT AS weight, min(o_orderkey) AS p FROM orders GROUP BY ALL)
SELECT o_custkey, year::BIGINT AS year, weight FROM s QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY weight DESC, p) = 1""",
    "tokenize_terms": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_terms FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)",
    "term_doc_frequency": f"WITH {LINES_SQL}, {POSTINGS_SQL} SELECT term, count(*) AS df, sum(tf)::BIGINT AS total_tf FROM postings GROUP BY term",
    "bm25_search": f"""WITH {LINES_SQL}, {POSTINGS_SQL}, {_SCORED_SQL}
SELECT query_id, passage_id, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, passage_id) AS rank, round(raw, 6) AS score FROM scored QUALIFY rank <= 8""",
    "bm25_search_whole": f"""WITH {LINES_SQL}, {POSTINGS_SQL}, {_SCORED_SQL},
phrases AS (SELECT DISTINCT item_id AS query_id, unnest({_SENTENCES_SQL}) AS p FROM benchmark),
held AS (SELECT query_id, passage_id, count(*) AS n FROM tokenised JOIN phrases ON contains(lower(line), lower(p)) WHERE trim(p, ' ') <> '' GROUP BY ALL),
words AS (SELECT DISTINCT item_id AS query_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS w FROM benchmark),
named AS (SELECT DISTINCT query_id, section FROM (SELECT DISTINCT section FROM tokenised WHERE section IS NOT NULL) JOIN words ON contains(lower(section), w)),
hits AS (SELECT query_id, passage_id, coalesce(raw, 0) AS raw, coalesce(n, 0) AS n FROM scored FULL JOIN held USING (query_id, passage_id)),
final AS (
  SELECT h.query_id, passage_id, round((coalesce(6e-1 * raw / nullif(max(raw) OVER (PARTITION BY h.query_id), 0), 0) + least(45e-2, 15e-2 * n) + CASE WHEN s.query_id IS NOT NULL THEN 1e-1 ELSE 0e0 END)
    * CASE kind WHEN 'heading' THEN 35e-2 WHEN 'table' THEN 6e-1 ELSE 1e0 END, 6) AS score
  FROM hits h JOIN tokenised USING (passage_id) LEFT JOIN named s ON s.query_id = h.query_id AND s.section = tokenised.section)
SELECT query_id, passage_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank, score FROM final QUALIFY rank <= 8""",
    "phrase_match": rf"""WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ') AS t FROM documents),
p AS (SELECT DISTINCT item_id, trim(regexp_replace(lower(s), '\s+', ' ', 'g'), ' ') AS phrase FROM (SELECT item_id, unnest({_SENTENCES_SQL}) AS s FROM benchmark))
SELECT doc_id, item_id, count(*) AS sentences FROM d JOIN p ON contains(t, phrase) WHERE phrase <> '' GROUP BY ALL""",
    "phrase_match_whole": r"""WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ') AS t FROM documents),
w AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' '), ' ') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 7, 1) + 1), lambda k: array_to_string(w[k : k + 7], ' '))) AS phrase FROM w)
SELECT doc_id, item_id, count(*) AS windows FROM d JOIN p ON contains(t, phrase) WHERE phrase <> '' GROUP BY ALL""",
    "sentence_split": r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.;!?])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM documents)
SELECT doc_id, len(s)::BIGINT AS n_sentences, list_max([length(x) for x in s])::BIGINT AS longest FROM s""",
    "number_parsing": """WITH c AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT // 100 AS whole, o_orderkey % 8 AS way FROM orders),
g AS (SELECT *, format('{:,}', whole) AS grouped FROM c)
SELECT o_orderkey, CASE way WHEN 0 THEN grouped WHEN 1 THEN '(' || grouped || ')' WHEN 2 THEN '$' || replace(grouped, ',', ' ') WHEN 3 THEN (whole % 1000) || '.5 million'
    WHEN 4 THEN '–' || whole || ' thousand' WHEN 5 THEN replace(grouped, ',', ' ') WHEN 6 THEN 'about ' || whole || ' lakh, say' ELSE ['–', 'n/a', ''][o_orderkey % 3 + 1] END AS raw,
  CASE way WHEN 0 THEN whole::DOUBLE WHEN 1 THEN -whole::DOUBLE WHEN 2 THEN split_part(grouped, ',', 1)::DOUBLE WHEN 5 THEN whole::DOUBLE WHEN 6 THEN whole * 1e5 WHEN 3 THEN (whole % 1000 + 5e-1) * 1e6 WHEN 4 THEN -whole * 1e3 END AS value FROM g""",
}
