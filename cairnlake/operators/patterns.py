"""Many phrases and many regular expressions over many texts: one automaton each, broadcast after a check of its size.

A text is read once, however many phrases there are. A regular expression is only tried where a literal that each of its matches
must hold occurs; those literals are found by the same automaton.
"""

from __future__ import annotations

import bisect
import re
from re import _constants as op
from re import _parser as parser

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import joined, lists, struct_of

#: Characters of phrases or patterns in one automaton (some 50 bytes each in every worker); more go block by block.
MOST_CHARS = 2_000_000
#: Shortest literal that is worth looking for.
LEAST_LITERAL = 3
#: Phrases that are looked for without the automaton.
FEW = 12
#: Letters beyond ASCII that match an ASCII letter in either case.
_FOLD = str.maketrans({"ı": "i", "İ": "i", "ſ": "s", "K": "k"})


class Phrases:
    """Which of some phrases occur in a text, whole words or not."""

    def __init__(self, phrases: list[str]):
        self.phrases = phrases
        self.automaton, self.empty = ahocorasick.Automaton(), [k for k, p in enumerate(phrases) if p == ""]
        same: dict[str, list[int]] = {}
        for k, phrase in enumerate(phrases):
            if phrase:
                same.setdefault(phrase, []).append(k)
        for phrase, numbers in same.items():
            self.automaton.add_word(phrase, numbers)
        if same:
            self.automaton.make_automaton()
        self.any = bool(same)

    def find(self, text: str) -> list[int]:
        found = set(self.empty)
        if self.any:
            for _, numbers in self.automaton.iter(text):
                found.update(numbers)
        return sorted(found)

    def find_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Text and number of the phrases that each of some texts holds, ascending; nulls hold none. A few phrases are looked for one by one
        in all texts at once."""
        if len(self.phrases) > FEW or self.empty:
            held = [self.find(t) if t is not None else [] for t in (x.as_py() for x in texts)]
            return np.repeat(np.arange(len(held)), [len(h) for h in held]), np.array([k for h in held for k in h], np.int64)
        bounds, whole = joined(pc.fill_null(texts.cast(pa.large_string()), ""))
        ends, whole, found = bounds.tolist(), whole.tobytes(), []
        for k, phrase in enumerate(self.phrases):
            sought = phrase.encode()
            at = whole.find(sought)
            while at >= 0:
                row = bisect.bisect_right(ends, at) - 1
                if inside := at + len(sought) < ends[row + 1]:  # not over the end of the text
                    found.append((row, k))
                at = whole.find(sought, ends[row + 1] if inside else at + 1)
        found = np.array(sorted(found), np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]


def required_literals(pattern: str) -> frozenset[str] | None:
    """Lower-case literals of which each match of `pattern`, in any case, holds one; None if none is sure."""

    def best(candidates: list[frozenset[str]]) -> frozenset[str] | None:
        return max(candidates, key=lambda c: (min(map(len, c)), -len(c)), default=None)

    def needs(parts) -> list[frozenset[str]]:
        out, run = [], ""

        def close() -> None:
            if len(run) >= LEAST_LITERAL:
                out.append(frozenset([run.lower()]))

        for kind, value in parts:
            if kind is op.LITERAL and value < 128:
                run += chr(value)
                continue
            if kind is op.AT:  # anchors take no characters
                continue
            close()
            run = ""
            if kind is op.SUBPATTERN:
                out += needs(value[3])
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] >= 1:
                out += needs(value[2])
            elif kind is op.ATOMIC_GROUP:
                out += needs(value)
            elif kind is op.BRANCH:
                each = [best(needs(branch)) for branch in value[1]]
                if all(each):
                    out.append(frozenset().union(*each))
        close()
        return out

    return best(needs(parser.parse(pattern, re.IGNORECASE)))


class Patterns:
    """Which of some regular expressions, in any case, match somewhere in a text, and where first."""

    def __init__(self, patterns: list[str]):
        self.patterns = [re.compile(p, re.IGNORECASE) for p in patterns]
        literals, self.always, self.of = [], [], []
        for k, pattern in enumerate(patterns):
            needed = required_literals(pattern)
            if needed is None:
                self.always.append(k)
            for literal in needed or ():
                literals.append(literal)
                self.of.append(k)
        self.literals = Phrases(literals)

    def find(self, text: str) -> dict[int, re.Match]:
        """Number and first match of each pattern that matches, by number."""
        likely = {self.of[k] for k in self.literals.find(text.translate(_FOLD).lower())}
        return {k: m for k in sorted(likely.union(self.always)) if (m := self.patterns[k].search(text))}


def _numbers(df: DataFrame, text: Column, matcher, name: str) -> DataFrame:
    """`df` with one row for each thing that `matcher` finds in a text, its number in column `name`."""
    held = df.sparkSession.sparkContext.broadcast(matcher)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def found(texts: pa.Array) -> pa.Array:
        work = held.value
        return pa.array([None if t is None else work.find(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return df.withColumn(name, F.explode_outer(found(text))).filter(F.col(name).isNotNull())


def phrases_in(texts: DataFrame, text: str, phrases: DataFrame, *, keep: list[str]) -> DataFrame:
    """`keep` columns of `texts` and phrase_id, a row for each phrase (phrase_id, phrase) that a text contains, as both are written.

    Phrases are dealt into blocks of MOST_CHARS; there is one pass over the texts for each, one at all up to that size.
    """
    spark = texts.sparkSession
    known = phrases.filter("phrase IS NOT NULL").select("phrase_id", "phrase")
    blocks = -(-(known.agg(F.sum(F.length("phrase") + 1)).first()[0] or 0) // MOST_CHARS)
    found = texts.limit(0).select(*keep, F.lit(None).cast(phrases.schema["phrase_id"].dataType).alias("phrase_id"))
    for block in range(blocks):
        held = known.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == block).collect()  # about MOST_CHARS characters
        ids = spark.createDataFrame([(k, r["phrase_id"]) for k, r in enumerate(held)], T.StructType([T.StructField("__k", T.IntegerType()), phrases.schema["phrase_id"]]))
        hits = _numbers(texts.select(*keep, F.col(text).alias("__t")), F.col("__t"), Phrases([r["phrase"] for r in held]), "__k")
        found = found.union(hits.join(F.broadcast(ids), "__k").select(*keep, "phrase_id"))
    return found


class Checks:
    """Pattern checks: of each, the first pattern that matches a text, if one of its contexts (if any) matches text and section."""

    def __init__(self, checks: list[tuple[list[str], list[str]]]):
        self.owner, self.context_of, texts, contexts = [], [], [], []
        self.bound = [bool(c) for _, c in checks]
        for k, (some, around) in enumerate(checks):
            texts += some
            self.owner += [k] * len(some)
            contexts += around
            self.context_of += [k] * len(around)
        self.texts, self.contexts = Patterns(texts), Patterns(contexts)

    def find(self, text: str, section: str | None) -> list[tuple[int, str, bool]]:
        first: dict[int, re.Match] = {}
        for k, m in self.texts.find(text).items():
            first.setdefault(self.owner[k], m)
        if any(self.bound[k] for k in first):
            around = {self.context_of[k] for k in self.contexts.find(f"{text} {section or ''}")}
            first = {k: m for k, m in first.items() if not self.bound[k] or k in around}
        return [(k, text[max(0, m.start() - 60) : m.end() + 60].strip(), m.start() <= 60) for k, m in sorted(first.items())]


_HIT = [("k", pa.int32()), ("snippet", pa.string()), ("at_start", pa.bool_())]
EXCLUDED_KINDS = ("heading", "table")


def _check_hits(checks):
    @F.arrow_udf(T.ArrayType(struct_of(_HIT)))
    def hits(texts: pa.Array, sections: pa.Array) -> pa.Array:
        work = checks.value
        return lists([work.find(t, s) for t, s in zip(texts.to_pylist(), sections.to_pylist(), strict=True)], _HIT)

    return hits


def check_matches(passages: DataFrame, checks: DataFrame, *, text: str = "text", keep: list[str]) -> DataFrame:
    """`keep` columns, check_id and snippet for each passage (text, kind, section) and check (check_id, patterns, context) that it meets.

    Headings and tables aren't looked at. A snippet is the first matching pattern's match with 60 characters on either side.
    Checks are broadcast in blocks of MOST_CHARS, each one pass over the passages.
    """
    spark = passages.sparkSession
    size = F.aggregate(F.concat("patterns", F.coalesce("context", F.array().cast("array<string>"))), F.lit(1), lambda n, p: n + F.length(p))
    blocks = -(-(checks.agg(F.sum(size)).first()[0] or 0) // MOST_CHARS)
    rows = passages.filter(~F.coalesce("kind", F.lit("")).isin(*EXCLUDED_KINDS) & F.col(text).isNotNull()).select(*keep, F.col(text).alias("__t"), F.col("section").cast("string").alias("__s"))
    found = rows.limit(0).select(*keep, F.lit(None).cast(checks.schema["check_id"].dataType).alias("check_id"), F.lit("").alias("snippet"))
    for block in range(blocks):
        held = checks.filter(F.pmod(F.xxhash64("check_id"), F.lit(blocks)) == block).select("check_id", "patterns", "context").collect()  # about MOST_CHARS characters
        hits = _check_hits(spark.sparkContext.broadcast(Checks([(r["patterns"], r["context"] or []) for r in held])))
        ids = spark.createDataFrame([(k, r["check_id"]) for k, r in enumerate(held)], T.StructType([T.StructField("__k", T.IntegerType()), checks.schema["check_id"]]))
        each = rows.withColumn("__h", F.explode_outer(hits(F.col("__t"), F.col("__s")))).filter("__h IS NOT NULL").withColumn("__k", F.col("__h.k"))
        found = found.union(each.join(F.broadcast(ids), "__k").select(*keep, "check_id", F.col("__h.snippet")))
    return found
