"""Token counts under a byte-level BPE vocabulary, by the whole-token shortcut.

Offline proof: a vocabulary string that is one pre-token and that the tokenizer encodes alone as one token
always counts 1, since merges never cross pre-tokens. Texts are split into pre-tokens; proven ones count directly and
only the rest is merged by the tokenizer itself, each distinct one once while it stays in a bounded memory. Code points
whose class the library's Unicode tables see otherwise are found by proof too; a text with one is left to the library.

Counts are those of the library's `encode(text, add_special_tokens=False)`: the strings of added tokens inside a text
count as one token each, as is its default. Defined cases: null and empty texts have no tokens; bytes that aren't UTF-8
count as U+FFFD; repeated rows each get their row; extra columns pass through only if kept.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import scan_texts

#: Pre-token pattern of byte-level BPE vocabularies (fixed value); the library writes it with \s for White_Space.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same over ASCII texts, for the faster engine.
PRE_TOKENS_ASCII = r"""'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
#: Merged pre-tokens remembered by a worker before it forgets them all, and the code points of one at most: some 30 MB.
MOST_REMEMBERED, LONGEST_REMEMBERED = 200_000, 48
LIMIT = 512


def byte_letters() -> dict[str, int]:
    """Letter to byte of byte-level vocabularies: printable bytes stand for themselves, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def load(definition: str):
    """The library's tokenizer and its added strings; definitions whose added strings need more than a split are refused."""
    from tokenizers import Tokenizer

    spec = json.loads(definition)
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        raise ValueError("a byte-level BPE definition without normalizer or prefix space is needed")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("added tokens with strip or word flags are not supported")
    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, [t["content"] for t in spec["added_tokens"]]


def proven_whole(definition: str) -> list[str]:
    """The vocabulary strings that are one pre-token and encode alone as one token."""
    import regex

    tokenizer, added = load(definition)
    letters, one = byte_letters(), regex.compile(PRE_TOKENS)
    texts = []
    for entry in json.loads(definition)["model"]["vocab"]:
        if entry in added or not all(c in letters for c in entry):
            continue
        try:
            text = bytes(letters[c] for c in entry).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if (m := one.match(text)) and m.end() == len(text):
            texts.append(text)
    counts = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    return [text for text, found in zip(texts, counts, strict=True) if len(found.ids) == 1]


class Counter:
    """Counts tokens of texts; proven strings count 1 and stay, others are merged once and remembered for a while."""

    def __init__(self, definition: str, whole: list[str]):
        import regex

        self.tokenizer, added = load(definition)
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.whole = dict.fromkeys(whole, 1)
        self.known = dict(self.whole)
        self.split = regex.compile(PRE_TOKENS).findall
        self.split_ascii = re.compile(PRE_TOKENS_ASCII).findall
        self.agreed, self.odd = set(map(chr, range(128))), set()

    def _prove(self, letters: set[str]) -> None:
        """Split each new code point beside a letter, a digit and a space both ways: Unicode versions may differ."""
        for c in letters:
            text = f"a{c}1{c} {c}"
            theirs = [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
            (self.agreed if self.split(text) == theirs else self.odd).add(c)

    def _whole_text(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _merge(self, rest: list[str]) -> dict[str, int]:
        """Counts of pre-tokens, which are remembered unless they are long."""
        if len(self.known) > len(self.whole) + MOST_REMEMBERED:
            self.known = dict(self.whole)
        counts = {}
        for k in range(0, len(rest), 20_000):
            some = rest[k : k + 20_000]
            for text, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                counts[text] = len(found.ids)
        self.known.update((text, n) for text, n in counts.items() if len(text) <= LONGEST_REMEMBERED)
        return counts

    def count(self, texts: list[str]) -> list[int]:
        counts = []
        for text in texts:
            if not text.isascii() and (beyond := set(text) - self.agreed):
                self._prove(beyond - self.odd)
                if not self.odd.isdisjoint(beyond):  # the library classes one of its code points otherwise: it splits this text
                    counts.append(self._whole_text(text))
                    continue
            n, parts = 0, [text]
            if self.added:
                parts = self.added.split(text)
                n = len(parts) - 1
            for part in parts:
                pieces = self.split_ascii(part) if part.isascii() else self.split(part)
                known = self.known
                try:
                    n += sum(map(known.__getitem__, pieces))
                except KeyError:
                    fresh = self._merge([p for p in dict.fromkeys(pieces) if p not in known])
                    n += sum(fresh[p] if p in fresh else known[p] for p in pieces)
            counts.append(n)
        return counts


_COUNTERS: dict[int, Counter] = {}


def count_tokens(docs: DataFrame, definition: str, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` (default: all columns), n_bytes and n_tokens of each row; `definition` is the tokenizer's JSON.

    What is broadcast is bounded by the vocabulary and doesn't grow with the data. One pass, no shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast((definition, proven_whole(definition)))

    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        key = hash(held.value[0])
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = Counter(*held.value)
        counter = _COUNTERS[key]

        def work(texts):
            data = [x or b"" for x in texts]
            return [[len(x) for x in data], counter.count([x.decode("utf-8", "replace") for x in data])]

        return work

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return scan_texts(docs, text, docs.columns if keep is None else keep, fields, make)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = file.read()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = count_tokens(docs, definition, keep=["doc_id"])
    return found.select("doc_id", "n_bytes", "n_tokens", (found["n_tokens"] > LIMIT).alias("over_limit"))
