"""WARC archives: written by Spark's text writer, read back with boundary-chain verification.

Writing: of the pages with equal payloads (of at least `LEAST_REVISIT` bytes) the one with the largest page_id is a
`response`, the others are `revisit` records without a payload. A record is one string, and `CRLF CRLF`, which ends
each record, is the writer's line separator. Only (digest, page_id) of all pages is shuffled; a bitmap of fixed size tells
which pages surely have no copy, and these are written from where they are read. Of the rest, payloads of likely
responses move.

Reading: Spark's text reader takes archives by byte ranges, with the record magic as line separator, so that an archive may
be of any size. Each piece is a candidate record with a successor offset (its start, header and Content-Length). Payloads
may contain the magic, so candidates prove nothing; pointer jumping from each archive's start keeps the reachable ones,
doubling the reach in each round. A record whose payload holds the magic is put together from its pieces in a second scan.
Sizes and digests of responses are computed from the bytes read.

Defined cases: a null html is an empty payload; a null url leaves out the target; a null page_id is written and read
back as null and never referred to; rows with the same largest page_id are all responses; control characters in a url
are percent-encoded; an empty table writes no record; extra columns aren't written; a record without its end mark, or whose
digest isn't that of its payload, is read with `sound` false.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, shared_path

MAGIC = "WARC/1.1\r\n"
#: Where the reader cuts: the part of the magic that all versions share.
CUT = "WARC/1."
END = "\r\n\r\n"
LEAST_REVISIT = 0
#: Records of an archive at most: pointer jumping takes as many rounds as this number has bits, if no payload is an archive.
ARCHIVE_RECORDS = 2_000
DATE = "2024-01-01T00:00:00Z"
#: Bits of the bitmap that tells keys apart which surely aren't there: 2 MB, whatever the data.
BITS = 1 << 24
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: F.Column) -> F.Column:
    """Upper-case base32 of 40 hex digits: each five of them are four letters."""
    letters = []
    for at in range(1, 41, 5):
        bits = F.conv(F.substring(digest, at, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def _maybe_in(rows: DataFrame, key: str, few: DataFrame, name: str) -> DataFrame:
    """`rows` and `name`: false where the key is surely not among those of `few`. The bitmap is BITS long at most."""
    slot = F.pmod(F.xxhash64(key), F.lit(BITS))
    bits = few.select(slot.alias("__slot")).groupBy(F.bitmap_bucket_number("__slot").alias("__bucket"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("__slot")).alias("__bits"))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = rows.withColumn("__bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(bits), "__bucket", "left")
    return joined.withColumn(name, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("__bucket", "__bits")


def records(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """One row a page: page_id, url, payload (string; null in revisits), payload_bytes, payload_digest, record_type, refers_to.

    The largest page_id per digest is aggregated before the shuffle; large groups of copies are an ordinary join's
    skewed side, which Spark splits.
    """
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    own = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload.cast("binary")).alias("__sha1"),
    )
    counted = own.filter(F.col("payload_bytes") >= least).groupBy("__sha1").agg(F.max("page_id").alias("__first"), F.count("*").alias("__n"))
    several = materialise(counted.filter("__n > 1").drop("__n"), "warc-copies")
    marked = _maybe_in(own, "__sha1", several, "__copy")
    likely = _maybe_in(marked.filter("__copy"), "page_id", several.select(F.col("__first").alias("page_id")), "__response")
    moved = likely.withColumn("payload", F.when(F.col("__response") | F.col("page_id").isNull(), F.col("payload")))
    joined = moved.drop("__copy", "__response").join(several, "__sha1", "left")
    alone = marked.filter("NOT __copy").drop("__copy").withColumn("__first", F.lit(None).cast("long"))
    revisit = F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return alone.unionByName(joined).select(
        "page_id",
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_bytes",
        base32_of_hex(F.col("__sha1")).alias("payload_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("__first")).alias("refers_to"),
    )


def _header(record: DataFrame) -> F.Column:
    safe_url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    name = F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))
    refers = F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))
    body = F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("payload_bytes"))
    lines = [
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), F.coalesce(name, F.lit("<urn:page:none>"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), safe_url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("payload_bytes").cast("string")),
        refers,
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), body.cast("string")),
    ]
    return F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *lines), F.lit(END))


def write_archives(pages: DataFrame, path: str, **columns: str) -> None:
    """Write `pages` as uncompressed archives into `path`."""
    made = records(pages, **columns)
    lines = made.select(F.concat(_header(made), F.coalesce("payload", F.lit(""))).alias("value"))
    lines.write.option("lineSep", END).option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The archives under `path`, cut at each magic: archive, block (where its byte range starts), seq (order in it), value, n."""
    rows = spark.read.option("lineSep", CUT).option("pathGlobFilter", "*.txt").text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("archive"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
        F.octet_length("value").cast("long").alias("n"),
    )


def _placed(pieces: DataFrame) -> DataFrame:
    """Adds each piece's offset (that of the magic before it) and its archive's size, as sums within a range and over ranges."""
    width = F.col("n") + len(CUT)
    blocks = pieces.groupBy("archive", "block").agg(F.sum(width).alias("w"))
    whole = Window.partitionBy("archive")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("archive", "block", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("base"), (F.sum("w").over(whole) - len(CUT)).alias("size"))
    within = Window.partitionBy("archive", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.col("base") + F.coalesce(F.sum(width).over(within), F.lit(0)) - len(CUT)
    return pieces.join(blocks, ["archive", "block"]).withColumn("offset", offset).drop("base", "block", "seq")


def candidates(spark: SparkSession, path: str, *, payloads: bool) -> DataFrame:
    """Every well-formed candidate of every archive, real or inside a payload; `whole` if no magic parts its record.

    A row has archive, offset, successor (null at the archive's end), the header's fields, and of whole records the
    payload's SHA-1, that the end mark follows it, and if asked for the payload.
    """
    own = _pieces(spark, path)
    head = F.substring_index("value", END, 1)
    rest = F.replace(head, F.lit("\r\n"), F.lit(""))

    def field(name: str) -> F.Column:
        return F.nullif(F.regexp_extract("head", rf"(?i)\r\n{name}:[ \t]*([^\r\n]+)", 1), F.lit(""))

    fine = F.contains("value", F.lit(END)) & F.substring("value", 1, 3).isin("0\r\n", "1\r\n") & ~F.contains(rest, F.lit("\r")) & ~F.contains(rest, F.lit("\n"))
    parsed = own.withColumn("head", F.when(fine, head)).withColumns({
        "length": field("Content-Length").try_cast("long"),
        "page_id": F.nullif(F.regexp_extract("head", r"(?i)\r\nWARC-Record-ID:[ \t]*<urn:page:(-?[0-9]+)>", 1), F.lit("")).try_cast("long"),
        "url": field("WARC-Target-URI"),
        "record_type": field("WARC-Type"),
        "told_bytes": field("WARC-Payload-Length").try_cast("long"),
        "told_digest": F.regexp_replace(field("WARC-Payload-Digest"), "(?i)^sha1:", ""),
        "refers_to": F.nullif(F.regexp_extract("head", r"(?i)\r\nWARC-Refers-To:[ \t]*<urn:page:(-?[0-9]+)>", 1), F.lit("")).try_cast("long"),
        "header": F.octet_length("head").cast("long") + len(END),
    })
    whole = F.col("header") + F.col("length") + len(END) <= F.col("n")
    start, size = F.col("header").cast("int"), F.col("length").cast("int")
    data = F.col("value").cast("binary")
    body = F.when(whole, F.substring(data, start + 1, size))
    ended = F.when(whole, F.substring(data, start + size + 1, F.lit(len(END))) == F.lit(END).cast("binary"))
    narrow = parsed.select(
        "archive", "block", "seq", "n", "header", "length", "page_id", "url", "record_type", "told_bytes", "told_digest", "refers_to",
        whole.alias("whole"), ended.alias("ended"), F.sha1(body).alias("sha1"), *([body.alias("payload")] if payloads else []),
    )
    cut = materialise(narrow, "warc-pieces")
    after = F.col("offset") + len(CUT) + F.col("header") + F.col("length") + len(END)
    placed = _placed(cut).withColumn("successor", after).filter("offset >= 0 AND length >= 0 AND successor <= size AND coalesce(ended, true)")
    found = materialise(placed.withColumn("successor", F.when(F.col("successor") < F.col("size"), F.col("successor"))).drop("size", "n"), "warc-candidates")
    discard(cut)
    return found


def reachable(links: DataFrame) -> DataFrame:
    """(archive, offset) of the records on the chain from offset 0; `links` has archive, offset and successor.

    Pointer jumping: in round k each known record adds the one 2^k records on, and the jumps double. Rounds are the
    logarithm of the longest chain; every round is a join on (archive, offset), however many archives there are. A round's
    tables go once the next ones are written.
    """
    jumps = links.select("archive", "offset", F.col("successor").alias("to"))
    known = links.filter("offset = 0").select("archive", "offset").distinct()
    while True:
        ahead = known.join(jumps, ["archive", "offset"]).filter("to is not null").select("archive", F.col("to").alias("offset"))
        onto = jumps.select("archive", F.col("offset").alias("to"), F.col("to").alias("next"))
        further = jumps.filter("to is not null").join(onto, ["archive", "to"]).filter("next is not null")
        before = jumps, known
        known = materialise(known.unionByName(ahead), "warc-known")
        jumps = materialise(further.select("archive", "offset", F.col("next").alias("to")), "warc-jumps")
        discard(*before)
        if not jumps.limit(1).count():
            discard(jumps)
            return known


def _put_together(spark: SparkSession, path: str, parted: DataFrame, chain: DataFrame) -> DataFrame:
    """(archive, offset, sha1, ended, payload) of reachable records that a magic parts: their archives are cut once more.

    Each piece belongs to the last reachable record that starts no later; a record's pieces are one record's bytes.
    """
    own = _placed(_pieces(spark, path).join(parted.select("archive").distinct(), "archive", "left_semi")).filter("offset >= 0")
    starts = chain.withColumn("start", F.col("offset"))
    upto = Window.partitionBy("archive").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    owned = own.select("archive", "offset", "n").join(starts, ["archive", "offset"], "left").withColumn("start", F.last("start", ignorenulls=True).over(upto))
    wanted = parted.select("archive", F.col("offset").alias("start"), "header", "length")
    parts = own.select("archive", "offset", "value").join(owned.select("archive", "offset", "start"), ["archive", "offset"]).join(wanted, ["archive", "start"])
    texts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"])
    data = parts.groupBy("archive", "start", "header", "length").agg(F.array_join(texts, CUT).cast("binary").alias("data"))
    at, size = F.col("header").cast("int"), F.col("length").cast("int")
    body, mark = F.substring("data", at + 1, size), F.substring("data", at + size + 1, F.lit(len(END)))
    return data.select("archive", F.col("start").alias("offset"), F.sha1(body).alias("sha1"), (mark == F.lit(END).cast("binary")).alias("ended"), body.alias("payload"))


def read_archives(spark: SparkSession, path: str, *, payloads: bool = False) -> DataFrame:
    """The records that are reachable in the archives under `path`.

    payload_bytes and payload_digest are those of the bytes read, and what the header tells in a revisit; `sound` says
    whether a response's header tells the same and its end mark stands.
    """
    found = candidates(spark, path, payloads=payloads)
    chain = reachable(found)
    real = found.join(chain, ["archive", "offset"], "left_semi")
    parted = real.filter("NOT whole")
    if parted.limit(1).count():
        made = _put_together(spark, path, parted, chain)
        made = made if payloads else made.drop("payload")
        rest = parted.drop(*[c for c in made.columns if c not in ("archive", "offset")]).join(made, ["archive", "offset"])
        real = real.filter("whole").unionByName(rest)
    told = F.col("record_type") == "revisit"
    digest = base32_of_hex(F.col("sha1"))
    return real.select(
        "archive", "offset", "page_id", "url", "record_type",
        F.when(told, F.coalesce("told_bytes", F.lit(0))).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(told, F.col("told_digest")).otherwise(digest).alias("payload_digest"),
        "refers_to",
        (F.col("ended") & (told | (digest == F.col("told_digest")))).alias("sound"),
        *(["payload"] if payloads else []),
    )


def op10_warc(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH digits AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), firsts AS (SELECT h, max(page_id) AS first FROM digits GROUP BY h),
coded AS (
  SELECT h, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 5 * (k // 4)::BIGINT, 5))::BIGINT >> (15 - 5 * (k % 4))::BIGINT) & 31)::BIGINT, 1)), '') AS payload_digest
  FROM (SELECT DISTINCT h FROM digits)
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM digits JOIN firsts USING (h) JOIN coded USING (h)
"""
