"""Operators that read each text once: token counts, quality, secrets, licenses, languages, decontamination."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnlake.llm import decontaminate, registry
from cairnlake.llm.automaton import Dfa, Scanner, parse
from cairnlake.llm.decontaminate import contamination, n_hit, remove_documents, remove_spans
from cairnlake.llm import languages
from cairnlake.llm.languages import Filter, grams, identify, learn
from cairnlake.llm.licenses import BASE as LICENSE_BASE
from cairnlake.llm.licenses import license_matches
from cairnlake.llm.quality import fit, judge, keep_good, statistics
from cairnlake.llm.secrets import BASE, Secrets, redact, secret_spans
from cairnlake.llm.token_counts import Counter, count_tokens, load, proven_whole

from .helpers import DOCS, PROSE, SPACE_WORDS, WORDS, awkward, clashing, docs_frame, lower


@pytest.fixture(scope="module")
def definition():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


def texts_of(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


# --- token counts


def test_token_counts_are_the_librarys(spark, sf_dir, definition):
    library, _ = load(definition)
    found = {r["doc_id"]: r for r in registry.QUERIES["op3_token_counts"](spark, sf_dir).collect()}
    for doc_id, text in texts_of(spark, sf_dir):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (found[doc_id]["n_tokens"], found[doc_id]["n_bytes"], found[doc_id]["over_limit"]) == (n, len((text or "").encode()), n > 512)


def test_token_counts_on_awkward_texts(spark, definition):
    library, _ = load(definition)
    more = ["<|endoftext|>a<|endoftext|>", "x՘y ₏1", "it's I'LL  \n\n y\x85z \x1c", " ", "\n", "a　b 12½ ٣"]
    rows = [(k, x, None, None, None) for k, x in enumerate([r[1] for r in awkward()] + more)]
    found = {r["doc_id"]: r["n_tokens"] for r in count_tokens(docs_frame(spark, rows), definition, keep=["doc_id"]).collect()}
    assert found == {k: len(library.encode(x or "", add_special_tokens=False).ids) for k, x, *_ in rows}
    assert count_tokens(docs_frame(spark, []), definition).count() == 0
    assert count_tokens(clashing(docs_frame(spark)), definition).count() == len(awkward())


def test_memory_of_merged_pieces_is_bounded(definition, monkeypatch):
    import cairnlake.llm.token_counts as module

    monkeypatch.setattr(module, "MOST_REMEMBERED", 50)
    counter, (library, _) = Counter(definition, proven_whole(definition)), load(definition)
    rng = random.Random(3)
    for _ in range(30):
        text = " ".join("".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(40))
        assert counter.count([text]) == [len(library.encode(text).ids)]
        assert len(counter.known) <= len(counter.whole) + 50 + 200


# --- quality rules


def brute_statistics(text):
    words = SPACE_WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACE_WORDS.search(x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    repeated = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeated)]


def test_quality_counts_against_brute_force(spark, sf_dir):
    for text in [r[1] for r in awkward() if r[0] != 6] + ["a b c d e a b c d e", "x\nx\n\n \nx", "a a a a a a a", "é|é\né|é"]:
        assert statistics(text.encode() if text is not None else None)[0] == brute_statistics(text)
    for _, text in texts_of(spark, sf_dir)[:150]:
        assert statistics(text.encode())[0] == brute_statistics(text)


def test_quality_keeps_good_and_rejects_bad(spark, sf_dir):
    rows = registry.QUERIES["op4_quality_rules"](spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    both = rows.merge(labels, on="doc_id")
    assert (rows["base_failed"] == ((rows["n_words"] < 10) | (100 * rows["n_repeat_words"] > 20 * rows["n_words"]))).all()
    assert not (rows["kept"] & rows["base_failed"]).any()
    good, bad = both[(both["quality"] == 1) & ~both["base_failed"]], both[both["quality"] == 0]
    assert good["kept"].mean() > 0.99
    assert bad["kept"].mean() < 0.1


def test_quality_on_awkward_tables(spark):
    docs, none = docs_frame(spark), spark.createDataFrame([], "doc_id long, quality int")
    assert fit(docs, none) is None
    verdicts = judge(docs, None, keep=["doc_id"]).collect()
    assert all(r["kept"] != r["base_failed"] for r in verdicts)
    labels = spark.createDataFrame([(1, 1), (1, 1), (6, None), (99, 0), (None, 0)], "doc_id long, quality int")
    assert keep_good(clashing(docs), labels).columns == clashing(docs).columns
    assert keep_good(docs_frame(spark, []), labels).count() == 0


# --- secrets

ASSIGN = re.compile(
    "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def brute_secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(BASE[k].kind, a, b) for a, k, b in sorted(found)]


def test_secret_automaton_against_regular_expressions():
    compiled, rng = Secrets(), random.Random(7)
    parts = ["token", "secret", "passwd", "api_key", "apikey", "TOKEN", "=", ":", " ", "'", '"', "abc123", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "é", "\n", "x", "secretoken", "==", "-"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))
        found = [(s["kind"], s["start"], s["end"]) for s in compiled.spans(text.encode()) if s["kind"] in ("assign", "access", "hex")]
        assert found == brute_secrets(text), text


def test_one_very_long_run_is_one_match_in_little_memory():
    import tracemalloc

    compiled, data = Secrets(), b"x token=" + b"0123456789abcdef" * 60_000 + b" end"
    compiled.spans(b"a")  # its tables are made once
    tracemalloc.start()
    spans = compiled.spans(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(s["kind"], s["start"], s["end"]) for s in spans] == [("assign", 2, 960_008), ("hex", 8, 960_008)]
    assert peak < 8 * len(data)


def test_added_secret_rules():
    web, cloud = "eyJ" + "hbGciOiJ.IUzI1NiJ9_" * 4, "AIza" + "SyA-1234567" * 4
    kinds = [s["kind"] for s in Secrets().spans(f"{web} {cloud} eyJshort AIzashort".encode())]
    assert kinds == ["web", "cloud"]


def test_secret_query(spark, sf_dir):
    found = {r["doc_id"]: r for r in registry.QUERIES["op5_secret_scan"](spark, sf_dir).collect()}
    for doc_id, text in texts_of(spark, sf_dir):
        spans = brute_secrets(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        row = found[doc_id]
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
        assert set(joined.split(",")) <= set(row["spans"].split(","))


def test_secret_operator_cases(spark):
    docs = docs_frame(spark)
    rows = {r["doc_id"]: r["secrets"] for r in secret_spans(docs, keep=["doc_id"]).collect()}
    assert rows[3] == rows[4] == [] and [s["kind"] for s in rows[10]] == ["assign", "hex", "access"]
    assert "24be64" not in redact(docs).filter("doc_id = 10").first()["text"]
    assert redact(clashing(docs)).columns == clashing(docs).columns
    assert secret_spans(docs_frame(spark, [])).count() == 0


def test_automaton_syntax():
    for pattern, text, end in [("a(b|c){2,3}d?", b"abcbd", 5), ("[^x]+", b"abxc", 2), (r"\x41\.", b"A.", 2), ("(ab)*c", b"ababc", 5)]:
        assert Dfa([parse(pattern)], search=False).longest(text, 0) == end
    assert list(Scanner([parse("ab"), parse("b+")]).ends(b"xabb")) == [(3, 3), (4, 2)]
    with pytest.raises(ValueError):
        parse("a$")


# --- licenses


def brute_places(text):
    words = WORDS.findall(lower(text))
    places = []
    for template in LICENSE_BASE:
        phrase = template.text.split()
        places += [(k, template.label) for k in range(len(words)) if words[k : k + len(phrase)] == phrase]
    return len(words), places


def test_license_query_against_brute_force(spark, sf_dir):
    found = {r["doc_id"]: r for r in registry.QUERIES["op2_license_scan"](spark, sf_dir).collect()}
    for doc_id, text in texts_of(spark, sf_dir):
        n, places = brute_places(text)
        row, starts = found[doc_id], [k for k, _ in places]
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"]) == (n, len(places), min(starts, default=None), max(starts, default=None))
        assert row["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert {*row["base_labels"].split(",")} <= {*row["labels"].split(","), ""} and 0 <= row["score"] <= 1


def test_license_notices_and_cases(spark):
    notice = "Redistribution and use in source and binary forms, with or without changes, are permitted provided that the following conditions are met:"
    rows = [*awkward(), (20, notice, None, None, None), (21, "CC BY-SA 4.0 cc by cc\nBY MIT  License", None, None, None), (22, "license mit general public gnu", None, None, None)]
    found = {r["doc_id"]: r["licenses"] for r in license_matches(docs_frame(spark, rows), keep=["doc_id"]).collect()}
    assert [m["label"] for m in found[20]] == ["bsd"] and found[20][0]["agreement"] < 1
    assert sorted(m["start"] for m in found[21] if m["base"]) == [0, 5, 7, 9] and found[22] == [] and found[3] == []
    mit = "Permission is hereby granted, free of charge, to any lucky person obtaining a copy of this (fine) software and associated documentation files"
    changed = [(1, "x " + mit, None, None, None), (2, mit.replace("hereby", ""), None, None, None), (3, "This program is really free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", None, None, None), (4, " ".join(reversed(mit.split())), None, None, None)]
    found = {r["doc_id"]: r["licenses"] for r in license_matches(docs_frame(spark, changed), keep=["doc_id"]).collect()}
    assert ([m["label"] for m in found[1]], found[1][0]["start"], found[2], found[4]) == (["mit"], 1, [], [])
    assert {m["label"] for m in found[3]} == {"gpl-3.0", "gpl"}
    assert license_matches(docs_frame(spark, [])).count() == 0
    assert license_matches(clashing(docs_frame(spark))).count() == len(awkward())


# --- languages


def test_language_held_out_accuracy(spark, sf_dir):
    rows = registry.QUERIES["op6_language_id"](spark, sf_dir).toPandas()
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("c")).toPandas()
    both = rows.merge(truth, on="doc_id")
    assert (both["held_out"] == (both["c"] % 5 == 0)).all() and both["score"].between(0, 1).all()
    assert (both[both["held_out"]]["lang"] == both[both["held_out"]]["lang_pred"]).mean() > 0.98


def brute_language(text, trained):
    """The same decision from plain sets of n-grams, without a filter."""
    hashes = grams(text.encode()) if text else []
    counts = [sum(int(h) in own for h in hashes) for own in trained]
    return counts


def predict(trained, data):
    hashes = grams(data)
    counts = trained.hits(hashes)
    return (trained.languages[int(np.argmax(counts))], 0.0) if len(hashes) else ("und", 0.0)


def test_passes_and_stray_labels(spark, monkeypatch):
    """5,000 labels: the filter holds the most frequent ones, in several passes that give what one gives."""
    words = {k: "".join(chr(97 + (k * 7 + j * j) % 26) for j in range(40)) for k in range(9)}
    rows = [(k, f"{words[k % 9]} {words[k % 9][::-1]}", f"l{k % 9}", "s", 1) for k in range(180)] + [(1000 + k, f"stray {k}", f"x{k}", "s", 1) for k in range(5000)]
    docs = docs_frame(spark, rows)
    monkeypatch.setattr(languages, "MOST_LANGUAGES", 9)
    one = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in identify(docs, learn(docs), keep=["doc_id"]).collect()}
    monkeypatch.setattr(languages, "A_PASS", 2)
    trained = learn(docs)
    assert [len(f.languages) for f in trained] == [2, 2, 2, 2, 1]
    assert {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in identify(docs, trained, keep=["doc_id"]).collect()} == one
    assert all(one[k][0] == f"l{k % 9}" for k in range(180)) and len(one) == 5180
    assert identify(clashing(docs), trained).columns == [*clashing(docs).columns[:5], *[c for c in clashing(docs).columns[5:] if c != "score"], "lang_pred", "score"]


def test_language_query_against_exact_sets(spark, sf_dir):
    """The query with sets of n-grams in place of the filter: the same languages but where hits are nearly equal."""
    docs = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    known = [r for r in docs if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    assert len(known) < languages.FIT_ROWS  # the sample holds every row
    counts = {}
    for r in known:
        counts.setdefault(r["lang"], collections.Counter()).update(grams((r["text"] or "").encode()).tolist())
    top = {lang: {g for g, _ in sorted(c.items(), key=lambda x: (-x[1], np.uint64(x[0]).view(np.int64)))[: languages.GRAMS]} for lang, c in counts.items()}
    found = {r["doc_id"]: r for r in registry.QUERIES["op6_language_id"](spark, sf_dir).collect()}
    differ = 0
    for r in docs:
        own = grams((r["text"] or "").encode()).tolist()
        hits = {lang: sum(g in held for g in own) for lang, held in top.items()}
        want = max(hits.values()) if own else 0
        assert found[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if not own:
            assert found[r["doc_id"]]["lang_pred"] == "und"
        elif hits[found[r["doc_id"]]["lang_pred"]] < want:
            differ += 1
            assert hits[found[r["doc_id"]]["lang_pred"]] >= want - 2 - len(own) // 50
    assert differ <= len(docs) // 100


def test_language_filter_against_sets(spark, sf_dir):
    """Each n-gram's languages by the bit-sliced filter are those of plain sets, but for the false positives it corrects."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null and lang is not null")
    rows = docs.orderBy("doc_id").limit(160).collect()
    names = sorted({r["lang"] for r in rows})
    own = [np.unique(np.concatenate([grams(r["text"].encode()) for r in rows[:80] if r["lang"] == k] or [np.empty(0, dtype=np.uint64)])) for k in names]
    trained, sets = Filter(names, own), [set(map(int, x)) for x in own]
    for r in rows[80:]:
        want, found = brute_language(r["text"], sets), trained.hits(grams(r["text"].encode()))
        assert np.abs(found - want).max() <= 1 + 0.01 * len(grams(r["text"].encode()))
        assert sum(want) == 0 or predict(trained, r["text"].encode())[0] in {names[k] for k, n in enumerate(want) if n >= max(want) - 2}


def test_more_languages_than_bits_of_a_word():
    names = [f"l{k:03}" for k in range(150)]
    words = [f"zz{k:03}qq" for k in range(150)]
    texts = [" ".join([w.translate(str.maketrans("0123456789", "abcdefghij"))] * 3) for w in words]
    trained = Filter(names, [np.unique(grams(t.encode())) for t in texts])
    assert [predict(trained, t.encode())[0] for t in texts] == names


def test_language_cases(spark):
    rows = [*awkward(), (30, "12 34 !?", "en", None, None), (31, "漢字", None, None, None)]
    trained = learn(docs_frame(spark, [r for r in rows if r[0] != 8]))
    found = {r["doc_id"]: r for r in identify(docs_frame(spark, rows), trained, keep=["doc_id"]).collect()}
    assert {k: found[k]["lang_pred"] for k in (3, 4, 5, 11, 30)} == dict.fromkeys((3, 4, 5, 11, 30), "und")
    assert found[31]["lang_pred"] == "en" and found[31]["score"] == 0 and found[1]["lang_pred"] in ("en", "fr")
    nothing = learn(docs_frame(spark, []))
    assert {r["lang_pred"] for r in identify(docs_frame(spark), nothing).collect()} == {"und"}


# --- decontamination


def brute_hits(text, items, n=10):
    words, hit, ids = WORDS.findall(lower(text)), set(), set()
    for item, own in items:
        tokens = WORDS.findall(lower(own))
        size = min(n, len(tokens))
        for k in range(len(tokens) - size + 1 if size else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == tokens[k : k + size]:
                    hit.update(range(at, at + size))
                    ids.add(item)
    return len(words), len(hit), sorted(str(i) for i in ids if i is not None)


ITEMS = [(1, PROSE), (1, PROSE), (2, "Seven wizards"), (3, None), (4, ""), (None, "one two"), (10, "near an open door, the quick")]


def test_contamination_against_brute_force(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = docs_frame(spark, [r for r in awkward() if r[0] != 6])
    found = contamination(docs, items, keep=["doc_id", "text"]).withColumn("h", n_hit()).collect()
    for row in found:
        assert (row["n_words"], row["h"], row["hit_items"]) == brute_hits(row["text"], ITEMS)


def test_contamination_by_join_is_the_same(spark, monkeypatch):
    import cairnlake.llm.decontaminate as module

    items, docs = spark.createDataFrame(ITEMS, "item_id long, text string"), docs_frame(spark)
    want = sorted(map(str, contamination(docs, items, keep=["doc_id"]).collect()))
    cut = sorted(map(str, remove_spans(docs, items).collect()))
    monkeypatch.setattr(module, "MOST_BROADCAST", 100)
    monkeypatch.setattr(module, "BITS", 1 << 16)
    assert sorted(map(str, contamination(docs, items, keep=["doc_id"]).collect())) == want
    assert sorted(map(str, remove_spans(docs, items).collect())) == cut
    assert contamination(clashing(docs), items).count() == docs.count()
    assert contamination(docs_frame(spark, []), items).count() == 0


def test_a_word_that_most_documents_hold(spark, monkeypatch):
    """One-word items, shared by several: each document has a row a window, and both ways give the same."""
    rows = [(k, f"the cat {k} the dog the the " * (1 + k % 3) + "end", "en", "s", 1) for k in range(300)] + [(900 + k, t, None, None, None) for k, t in enumerate(["", None, "  ", "The", "x"] * 20)]
    docs = docs_frame(spark, rows)
    items = spark.createDataFrame([(1, "the"), (2, "The!"), (3, "the cat"), (4, "dog"), (5, None), (6, "nowhere at all")], "item_id long, text string")
    want = sorted(map(str, contamination(docs, items, keep=["doc_id"]).collect()))
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 0)
    found = contamination(docs, items, keep=["doc_id"])
    assert sorted(map(str, found.collect())) == want and found.filter("size(hit_items) = 4").count() == 300


def test_removal(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = clashing(docs_frame(spark))
    kept = remove_documents(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {3, 4, 5, 6, 8, 10, 11}
    cut = remove_spans(docs, items)
    assert cut.columns == docs.columns and contamination(cut, items).filter("size(hit_ranges) > 0").count() == 0
    assert cut.filter("doc_id = 6").first()["text"].startswith("word0 the word1")
    assert remove_documents(docs_frame(spark, []), items).count() == 0
    assert remove_documents(docs, spark.createDataFrame([], "item_id long, text string")).count() == docs.count()
    assert remove_documents(docs_frame(spark), items).schema == DOCS
