"""Manifest, substring dedup and importance resampling against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnlake.llm import repeats
from cairnlake.llm.manifest import Append, documents_manifest, fold, node
from cairnlake.llm.repeats import op12_substring_dedup, without_repeats
from cairnlake.llm.resampling import REACH, drawn, resample, span_crcs

from .helpers import PROSE, SPACE_WORDS, WORDS, awkward, clashing, docs_frame, lower


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def grow(level):
    """All levels from some digests up to the one that is left."""
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 2])) for k in range(0, len(levels[-1]), 2)])
    return levels


def brute_manifest(rows):
    def leaf(values):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    each = [(lang, doc_id, leaf((doc_id, source, lang, n, text)), (doc_id, source, lang, n, text)) for doc_id, text, lang, source, n in rows]
    keys = sorted({lang for lang, *_ in each}, key=lambda x: (x is not None, (x or "").encode()))
    places = {lang: sorted([e for e in each if e[0] == lang], key=lambda e: (e[1] is not None, e[1] or 0, e[2])) for lang in keys}
    levels = {lang: grow([e[2] for e in places[lang]]) for lang in keys}
    top = grow([levels[lang][-1][0] for lang in keys])
    out = []
    for g, lang in enumerate(keys):
        for at, (_, doc_id, digest, values) in enumerate(places[lang]):
            tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and values[3] is not None
            now = leaf((*values[:3], values[3] + 1, values[4])) if tampered else digest
            proof = []
            for tree, k in ((levels[lang], at), (top, g)):
                for level in tree[:-1]:
                    other = level[k ^ 1] if k ^ 1 < len(level) else ""
                    proof.append(other)
                    now = sha(other + now if k & 1 else now + other)
                    k >>= 1
            out.append((doc_id, digest, levels[lang][-1][0], top[-1][0], sha("".join(proof)), now, now == top[-1][0]))
    return out


def columns(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("height", [1, 2, 10])
def test_manifest_equals_brute_force(spark, height):
    """With small blocks there are several rounds of block roots, also over the languages."""
    rows = [*awkward(), *[(k, f"t{k}", f"l{k % 9}" if k % 2 else "en", "s", k) for k in range(100, 200)]]
    found = documents_manifest(clashing(docs_frame(spark, rows)), height=height).collect()
    want = brute_manifest(rows)
    assert columns(found, *MANIFEST) == sorted(want, key=repr)
    assert {w[6] for w in want} == {True, False}


def test_manifest_of_one_and_none(spark):
    assert documents_manifest(docs_frame(spark, [])).columns == list(MANIFEST) and documents_manifest(docs_frame(spark, [])).count() == 0
    rows = [(7, "x", None, "s", 1)]
    found = documents_manifest(docs_frame(spark, rows)).collect()
    assert columns(found, *MANIFEST) == brute_manifest(rows) and found[0]["proof_sha256"] == sha("")


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 70))
def test_append_keeps_witnesses_whole(n):
    digests = [hashlib.sha256(bytes([k])).digest() for k in range(n)]
    work = Append()
    for k, d in enumerate(digests):
        work.add(d)
        assert len(work.open) == bin(k + 1).count("1")  # the open subtrees are those of the count's binary digits
    root = work.end(None)
    assert root.hex() == grow([d.hex() for d in digests])[-1][0]
    assert all(fold(d, bytes(w), k, n) == (root, b"") for k, (d, w) in enumerate(zip(digests, work.witness)))
    assert fold(node(b""), bytes(work.witness[0]), 0, n)[0] != root or n == 0


def brute_repeats(rows, window=50):
    words = [(d, SPACE_WORDS.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for k in range(len(w) - window + 1 if d is not None else 0):
            key = tuple(w[k : k + window])
            first[key] = min(d, first.get(key, d))
    out = []
    for d, w in words:
        gone = set()
        for k in range(len(w) - window + 1 if d is not None else 0):
            if first[tuple(w[k : k + window])] < d:
                gone.update(range(k, k + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=repr)


def repeat_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgé", k=rng.randint(1, 7)))
    text = lambda n: [word() for _ in range(n)]
    passage, base = text(60), text(300)
    rows = [(k, " ".join(text(rng.randint(0, 120)) + passage[k % 5 : 60 - k % 7] + text(rng.randint(0, 40)))) for k in range(40)]
    rows += [(100 + k, " ".join(base[:k * 7] + ["edit"] + base[k * 7 :])) for k in range(20)]
    rows += [(200, "la " * 400), (201, "la " * 220 + "x"), (202, "x " + "la\t" * 60), (203, " ".join(passage * 3)), (204, "la " * 49)]
    rows += [(300 + k % 3, "\n".join(base)) for k in range(9)]  # repeated rows
    rows += [(None, " ".join(base)), (400, None), (401, ""), (402, " ".join(base[:49])), (403, " ".join(base[:50])), (99, " ".join(base).upper()), (300, "other text of a repeated id")]
    return rows


NAMES = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_repeats_equal_brute_force(spark, tmp_path):
    rows = repeat_rows()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = op12_substring_dedup(spark, str(tmp_path)).collect()
    assert columns(found, *NAMES) == brute_repeats(rows)


def test_repeats_with_a_full_or_an_exact_sketch(spark, tmp_path, monkeypatch):
    """The prefilter decides nothing: one that lets all through gives the same rows."""
    rows = repeat_rows()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(repeats.Sketch, "__init__", lambda self, cells, rows: self.__dict__.update(cells=cells, bits=np.full((repeats.ROWS, cells // 8), 255, dtype=np.uint8)))
    assert columns(op12_substring_dedup(spark, str(tmp_path)).collect(), *NAMES) == brute_repeats(rows)


def test_the_sketch_only_overestimates(spark):
    texts = [t for _, t in repeat_rows() if t]
    counts = Counter(a for t in texts for a in {a for _, _, low in repeats.windows(repeats.word_hashes(t.encode())) for a in low.tolist()})
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(6)
    sketch = repeats.Sketch(1 << 20, repeats._merge(repeats._sketch(frame, 1 << 20)).collect())
    every = np.array(sorted(counts), dtype=np.uint64)
    twice = sketch.repeated(every)
    assert all(twice[k] for k, a in enumerate(every.tolist()) if counts[a] > 1)
    assert sum(twice[k] for k, a in enumerate(every.tolist()) if counts[a] == 1) < 3


def test_windows_of_long_texts_and_segments(monkeypatch):
    """Hashes depend on the 50 words alone, also across segments and slices of text."""
    words = [f"w{k % 97}x{k % 89}" for k in range(5000)]
    data = " \n".join(words).encode()
    whole = np.concatenate([w for _, w, _ in repeats.windows(repeats.word_hashes(data))])
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    monkeypatch.setattr(repeats, "_TEXT_SLICE", 1000)
    parts = list(repeats.windows(repeats.word_hashes(data)))
    assert [s for s, _, _ in parts] == list(range(0, 4951, 700)) and (np.concatenate([w for _, w, _ in parts]) == whole).all()
    assert len(set(whole.tolist())) == len({tuple(words[k : k + 50]) for k in range(4951)})


def test_without_repeats_keeps_columns_and_other_texts(spark):
    docs = clashing(docs_frame(spark, [(1, PROSE * 3, "en", "a", 1), (2, "x  y\n" + PROSE * 3 + " z", "en", "a", 2), (3, " spaced  out ", None, None, None), (4, None, None, None, None)]))
    found = {r["doc_id"]: r for r in without_repeats(docs).collect()}
    assert without_repeats(docs).columns == docs.columns and found[2]["text"] == "x y z" and found[2]["n_words"] == 0
    assert (found[1]["text"], found[3]["text"], found[4]["text"]) == (PROSE * 3, " spaced  out ", None)
    assert without_repeats(docs_frame(spark, [])).count() == 0


def brute_resample(docs, target):
    def grams(text):
        w = WORDS.findall(lower(text))
        return [" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)], len(w)

    def buckets(rows):
        return Counter(zlib.crc32(g.encode()) % 10000 for _, t in rows for g in grams(t)[0])

    s, t = buckets(docs), buckets(target)
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000))))
    rows = []
    for d, text in docs:
        found, n = grams(text)
        weight = sum(gain(zlib.crc32(g.encode()) % 10000) for g in found)
        h = None if d is None else int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
        score = None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, len(found), weight, score, n])
    able = sorted([r for r in rows if r[4] >= 20 and r[3] is not None], key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able):
        r.append(k + 1 if k < 5 * len(able) // 100 else None)
    return sorted([(*r[:4], r[5] if len(r) > 5 else None) for r in rows], key=repr)


RESAMPLED = ("doc_id", "n_features", "weight", "score", "rank")


def test_resampling_equals_brute_force(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(PROSE.split()) for _ in range(n))
    rows = [*[(d, t) for d, t, *_ in awkward()], *[(k, prose(rng.randint(15, 40))) for k in range(50, 200)], (201, "a" * 5000 + " b " + "cé" * 3000 + " d"), (202, "One")]
    target = [(1, prose(50)), (2, None), (3, "Quick; BROWN fox!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = resample(clashing(docs), spark.createDataFrame(target, "item_id long, text string")).collect()
    want = brute_resample(rows, target)
    assert columns(found, *RESAMPLED) == want and sum(w[4] is not None for w in want) == 6
    some = spark.createDataFrame([r for r in rows if r[0] is not None and r[0] >= 50], docs.schema)
    taken = drawn(some, docs.filter("doc_id = 1")).collect()
    assert {r["rank"] for r in taken} == set(range(1, 7)) and all(r["text"] for r in taken)


def test_resampling_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resample(empty, empty).count() == 0
    assert [r["weight"] for r in resample(spark.createDataFrame([(1, "a b")], empty.schema), empty).collect()] == [sum([math.floor(1000 * math.log(10003 / 20000))] * 3)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40), min_size=1, max_size=20), st.integers(0, 5 * REACH))
def test_crcs_of_spans(parts, long):
    data = b"".join(parts) + bytes(k * 37 % 251 for k in range(long))
    ends = np.cumsum([len(p) for p in parts])
    start, end = np.concatenate([ends - [len(p) for p in parts], [0]]), np.concatenate([ends, [len(data)]])
    assert span_crcs(np.frombuffer(data, dtype=np.uint8), start, end).tolist() == [zlib.crc32(data[a:b]) for a, b in zip(start, end)]
