"""Operators that move rows: mixing, sharding, near duplicates, archives, and the pipeline of five."""

import base64
import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairnlake.llm import registry
from cairnlake.llm.components import components
from cairnlake.llm.mixing import MOST_REPEATS, _targets, mix, mix_plan
from cairnlake.llm.near_duplicates import REGISTERS, _may_link, classes, keep_one_each, shingles, signatures
from cairnlake.llm.sharding import shard_documents, split
from cairnlake.llm.warc import candidates, read_archives, records, write_archives

from .helpers import DOCS, PROSE, SPACE_WORDS, awkward, clashing, docs_frame, lower


# --- mixing


def targets(sizes, weights, most=MOST_REPEATS):
    """All of the words shared by weight; none above `most` times its size, the excess shared again."""
    out, left, free = np.zeros(len(sizes)), float(sizes.sum()), sizes > 0
    while free.any() and left > 0:
        share = left * weights / weights[free].sum()
        over = free & (share >= most * sizes)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = most * sizes[over]
        left -= out[over].sum()
        free &= ~over
    return out


def test_targets_share_all_words_and_stop_at_the_cap():
    found = targets(np.array([100.0, 1000.0, 10.0, 0.0]), np.array([5.0, 2.0, 1.0, 5.0]))
    assert found[0] == 300 and found[2] == 30 and found[3] == 0 and found.sum() == pytest.approx(1110)


def test_targets_of_tables(spark):
    rng = random.Random(7)
    for n in (1, 2, 5, 60):
        rows = [(rng.choice([0, 1, 10, 1000, 100_000]), rng.choice([5.0, 2.0, 1.0])) for _ in range(n)]
        found = [r["__mix_target"] for r in _targets(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, __mix_words long, __mix_weight double")).orderBy("k").collect()]
        assert found == pytest.approx(targets(np.array([r[0] for r in rows], dtype=float), np.array([r[1] for r in rows])), rel=1e-9)


def test_as_many_sources_as_documents(spark):
    """200,000 sources; each has one document, and all words are shared out."""
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', int(id % 5))").alias("text"), F.format_string("s%06d", "id").alias("source"))
    found = mix_plan(docs).toPandas()
    assert len(found) == 200_000 and (found["copies"] <= 3).all()
    assert found["target"].sum() == pytest.approx(found["size"].sum(), rel=1e-6)
    assert ((found["copies"] * found["size"] - found["target"]).abs() <= found["size"]).all()


def test_mix_query_meets_targets(spark, sf_dir):
    rows = registry.QUERIES["op1_mix_sources"](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    sizes = docs.assign(size=[len(SPACE_WORDS.findall(t or "")) for t in docs["text"]])
    both = rows.merge(sizes[["doc_id", "size", "source"]], on="doc_id", suffixes=("", "_true"))
    assert len(both) == len(docs) and (both["size"] == both["size_true"]).all()
    assert (both["taken"] <= 3 * both["size"]).all()
    order = sorted(both["source"].unique())
    own = both.groupby("source")["size"].sum()
    want = dict(zip(order, targets(own[order].to_numpy(dtype=float), np.array([(5, 2, 1)[k % 3] for k in range(len(order))], dtype=float)), strict=True))
    for source, part in both.groupby("source"):
        assert (part["source_size"] == own[source]).all() and part["target"].iloc[0] == pytest.approx(want[source])
        assert abs(part["taken"].sum() - want[source]) <= part["size"].max()
    again = registry.QUERIES["op1_mix_sources"](spark, sf_dir).toPandas()
    assert rows.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()


def test_mix_rates_solve_the_dual(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(["w"] * int(rng.paretovariate(0.9) * 10)), None, "ab"[k % 2] if k % 11 else None, None) for k in range(400)]
    plan = mix_plan(docs_frame(spark, rows)).toPandas()
    for _, part in plan.groupby("source", dropna=False):
        got = (part["rate"] * part["size"]).sum()
        assert got == pytest.approx(part["target"].iloc[0], rel=1e-4)
        tilt = np.log(part["rate"]) * (part["size"] + part["size"].mean()) / part["size"]
        inner = part["rate"] < MOST_REPEATS
        assert not inner.any() or np.ptp(tilt[inner]) < 1e-6  # a source at the cap has no rate within


def test_mix_cases(spark):
    docs = clashing(docs_frame(spark))
    plan = {r["doc_id"]: r for r in mix_plan(docs).collect()}
    assert plan[3]["size"] == plan[4]["size"] == plan[5]["size"] == 0 and plan[3]["copies"] == 1
    out = mix(docs)
    assert out.columns == docs.columns and out.filter("doc_id = 4").count() == 1
    assert mix(docs_frame(spark, [])).count() == 0 and mix_plan(docs_frame(spark, [])).count() == 0
    wordless = [r for r in awkward() if not (r[1] or "").strip()]
    assert mix(docs_frame(spark, wordless)).count() == len(wordless)


# --- sharding


def check_shards(rows, docs, shards=40):
    assert len(rows) == len(docs)
    for _, part in rows.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    total, most = rows["size"].sum(), rows["size"].max()
    by = rows.groupby("shard")["size"].sum()
    assert by.max() <= total / shards + most + 0.05 * total / shards and by.index.min() >= 0 and by.index.max() < shards


def test_shard_query(spark, sf_dir):
    import zlib

    rows = registry.QUERIES["op8_shards"](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id")
    check_shards(rows, docs)
    for row in rows.itertuples():
        data = (docs.loc[row.doc_id, "text"] or "").encode()
        assert (row.size, row.text_crc32, row.law) == (len(data) + 16, zlib.crc32(data), "bytes")


def test_a_hot_group_of_copies_is_subdivided(spark):
    rows = [(k, "same text " * 20 if k % 3 else f"other {k} " * (k % 50), None, None, None) for k in range(6000)]
    found = shard_documents(docs_frame(spark, rows)).toPandas()
    check_shards(found.assign(size=found["text"].str.len() + 16), rows)
    by = found.assign(size=found["text"].str.len() + 16).groupby("shard")["size"].sum()
    assert by.max() / by.mean() < 1.1 and by.min() / by.mean() > 0.9


def test_shard_cases(spark):
    docs = clashing(docs_frame(spark))
    out = shard_documents(docs)
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == docs.count()
    assert {r["shard"] for r in out.filter("doc_id = 2").collect()} and out.filter("slot is null").count() == 0
    assert shard_documents(docs_frame(spark, [])).count() == 0
    assert split(docs_frame(spark, []).selectExpr("doc_id as __key", "doc_id as __size", "doc_id as __tie")) is None


# --- near duplicates


def brute_classes(rows):
    sets, parent = {}, {}
    for doc_id, text in rows:
        if doc_id is None:
            continue
        words = SPACE_WORDS.findall(lower(text))
        sets[doc_id] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        parent[doc_id] = doc_id

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {k: (len(sets[k]), root(k)) for k in sets}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = []
    for base in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 60, 300]))]
        for _ in range(rng.choice([1, 2, 12])):
            edited = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.01, 0.03]) else w for w in words]
            rows.append((1000 - len(rows), " ".join(edited).upper() if rng.random() < 0.3 else "\n".join(edited), None, None, None))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows += [(5000 + k, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(60)), None, None, None) for k in range(60)]
    found = {r["id"]: (r["n"], r["component"]) for r in classes(docs_frame(spark, rows)).collect()}
    assert found == brute_classes([(r[0], r[1]) for r in rows])


def test_superminhash_estimates_with_less_variance():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(150):
        both = rng.integers(1 << 62, size=60, dtype=np.int64).astype(np.uint64)
        one, two = signatures([np.sort(both[:50]), np.sort(both[10:])])
        errors.append((one == two).mean() - 40 / 60)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < (40 / 60 * 20 / 60 / REGISTERS) ** 0.5
    assert np.isinf(signatures([np.empty(0, dtype=np.uint64)])).all()
    alone = signatures([shingles(PROSE.encode())])
    among = signatures([shingles(b"x y"), shingles(PROSE.encode()), shingles(b"a b c d e f g")])
    assert (alone[0] == among[1]).all()


def test_sketch_bound_keeps_pairs_up_to_forty_bits(spark):
    rows = [(100, 100, 0, 0, 100, 100, (1 << k) - 1, 0) for k in (0, 35, 36, 38, 40, 41)]
    pairs = spark.createDataFrame(rows, ", ".join(f"{c}_{x} long" for x in "ab" for c in ("n", "s", "s1", "s2")))
    assert sorted(r["s1_b"].bit_length() for r in pairs.filter(_may_link("_a", "_b")).collect()) == [0, 35, 36, 38, 40]


def test_near_duplicate_cases(spark):
    docs = clashing(docs_frame(spark))
    found = {r["id"]: (r["n"], r["component"]) for r in classes(docs).collect()}
    assert found == brute_classes([(r[0], r[1]) for r in awkward()])
    kept = keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.select("doc_id").collect()) == [0, *sorted(k for k, (_, c) in found.items() if k == c)]
    assert keep_one_each(docs_frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(0, k) for k in range(1, 90)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    parent = list(range(300))
    for _ in range(300):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: p for k, p in enumerate(parent) if k != p}


# --- archives


def test_archives_round_trip(spark, tmp_path):
    inside = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "http://a/\r\nX: y", f"x{inside}y"), (2, None, inside), (3, "u", inside), (4, "u", None), (5, "u", ""), (None, "u", "é\r\n\r\n"), (6, "u", "é\r\n\r\n"), (8, "u", inside * 50), (8, "u", inside * 50)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    write_archives(frame.repartition(1), f"file://{tmp_path}/a")
    back = read_archives(spark, f"file://{tmp_path}/a", payloads=True).collect()
    assert candidates(spark, f"file://{tmp_path}/a", payloads=False).count() > len(pages) + 100  # the magic inside payloads looks well-formed
    assert sorted((r["page_id"] or 0) for r in back) == [0, 1, 2, 3, 4, 5, 6, 8, 8] and all(r["sound"] for r in back)
    by = {r["page_id"]: r for r in back}
    for page, _, html in pages:
        data = (html or "").encode()
        assert by[page]["payload_bytes"] == len(data) and by[page]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if by[page]["record_type"] == "response":
            assert bytes(by[page]["payload"]) == data
    assert (by[2]["record_type"], by[2]["refers_to"], by[3]["record_type"]) == ("revisit", 3, "response")
    assert (by[None]["refers_to"], by[4]["refers_to"], by[8]["record_type"]) == (6, 5, "response")


def test_archives_cut_at_any_byte(spark, tmp_path):
    """Byte ranges may end anywhere: inside the magic, a header, an end mark or a payload that holds all of them."""
    inside = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.WARC/1.0\r\n\r\n"
    pages = [(k, f"http://a/{k}", "é" * (k % 7) + inside * (k % 3)) for k in range(7)] + [(20, "u", "WARC/1."), (21, "u", "x\r\n\r\n")]
    write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/c")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for width in (61, 1009, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(width))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            back = read_archives(spark, f"file://{tmp_path}/c", payloads=True).collect()
            assert sorted(r["page_id"] for r in back) == sorted(p[0] for p in pages), width
            texts = {p[0]: p[2].encode() for p in pages}
            assert all(r["sound"] and (r["record_type"] == "revisit" or bytes(r["payload"]) == texts[r["page_id"]]) for r in back)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_archive_of_one_very_long_page_and_extra_columns(spark, tmp_path):
    long = spark.range(3).selectExpr("id AS page_id", "'u' AS url", "concat(id, repeat('0123456789', 3000000)) AS html", "1 AS payload", "2 AS __first", "3 AS value")
    write_archives(long.repartition(1), f"file://{tmp_path}/d")
    back = read_archives(spark, f"file://{tmp_path}/d").collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["sound"]) for r in back) == [(k, 30_000_001, True) for k in range(3)]
    assert {r["page_id"]: r["payload_digest"] for r in back}[2] == base64.b32encode(hashlib.sha1(b"2" + b"0123456789" * 3_000_000).digest()).decode()


def test_archives_that_lie_are_found_out(spark, tmp_path):
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{}>\r\nWARC-Payload-Digest: sha1:{}\r\nContent-Length: {}\r\n\r\n{}"
    good, bad = base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), "A" * 32
    lines = [head.format(1, good, 3, "abc"), head.format(2, bad, 3, "abc"), head.format(3, good, 900, "abc")]
    spark.createDataFrame([("\r\n\r\n".join(lines),)], "value string").write.option("lineSep", "\r\n\r\n").text(f"file://{tmp_path}/e")
    assert sorted((r["page_id"], r["sound"]) for r in read_archives(spark, f"file://{tmp_path}/e").collect()) == [(1, True), (2, False)]  # the third ends beyond the archive


def test_archive_cases(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    write_archives(none, f"file://{tmp_path}/b")
    assert read_archives(spark, f"file://{tmp_path}/b").count() == 0
    small = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    assert {r["record_type"] for r in records(small, least=3).collect()} == {"response"}


# --- pipeline


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = {r["doc_id"] for r in registry.QUERIES["op4_quality_rules"](spark, sf_dir).filter("kept").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    one = stage["quality_rules"](spark, docs, sf_dir)
    assert one.schema == docs.schema and {r["doc_id"] for r in one.collect()} == judged
    some = [r for r in one.orderBy("doc_id").collect()]
    two = stage["near_duplicates"](spark, spark.createDataFrame(some, docs.schema), sf_dir)
    classes_ = brute_classes([(r["doc_id"], r["text"]) for r in some])
    heads = {k for k, (_, c) in classes_.items() if k == c}
    assert two.columns == docs.columns and {r["doc_id"] for r in two.collect()} == heads
    three = stage["decontamination"](spark, two, sf_dir)
    hit = {r["doc_id"] for r in registry.QUERIES["op7_decontaminate"](spark, sf_dir).filter("contaminated").collect()}
    assert {r["doc_id"] for r in three.collect()} == heads - hit
    four = stage["mixing"](spark, three, sf_dir)
    assert four.columns == docs.columns
    size = {k: len(SPACE_WORDS.findall(texts[k] or "")) for k in heads - hit}
    assert abs(sum(size[r["doc_id"]] for r in four.collect()) - sum(size.values())) < 0.05 * sum(size.values())
    five = stage["sharding"](spark, four, sf_dir).toPandas()
    check_shards(five.assign(size=[len((t or "").encode()) + 16 for t in five["text"]]), range(four.count()))


def test_pipeline_on_awkward_and_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "nothing that occurs in any of these documents at all, really")], "item_id long, text string")
    for name, rows in (("some", awkward()), ("none", [])):
        path = f"{tmp_path}/{name}"
        docs_frame(spark, rows).write.parquet(f"{path}/documents.parquet")
        labels.write.parquet(f"{path}/labels.parquet")
        items.write.parquet(f"{path}/benchmark.parquet")
        out = corpus_pipeline.run(spark, path)
        assert set(DOCS.names) < set(out.columns)
        assert (out.count() > 0) == bool(rows)
