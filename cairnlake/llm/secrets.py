"""Secret scan: all rules compiled into one minimal deterministic automaton, one byte pass a text.

Per rule the matches are leftmost, non-overlapping and longest, as a search from each match's end on gives them;
those shorter than the rule's least lengths are dropped after matching. Spans are in code points, end exclusive.

Defined cases: a null or empty text has no spans; bytes that aren't UTF-8 are read as U+FFFD; equal starts are
ordered by the rules' order; repeated rows each get their row; other columns pass through if kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import Dfa, Scanner, parse, reverse
from .common import scan_texts


@dataclass(frozen=True)
class Rule:
    """`head` then `tail`, with least code points of the match and of the tail (the secret itself)."""

    kind: str
    head: str
    tail: str
    least: int = 0
    least_tail: int = 0
    head_either_case: bool = False


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", least_tail=6, head_either_case=True),
    Rule("access", "AKIA", "[A-Z0-9]+", least=20),
    # a run is always taken whole, and most runs in prose are short: 8 in the pattern spares the scan their ends
    Rule("hex", "", "[0-9a-f]{8,}", least=24),
)
MORE = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]+", least=40),
    Rule("slack", "xox[abprs]-", "[0-9A-Za-z-]+", least=20),
    Rule("pem", "-----BEGIN[A-Z\x20]*", "PRIVATE KEY-----"),
    Rule("cloud", "AIza", "[0-9A-Za-z_-]+", least=39),
    # a web token is taken by its alphabet: its two dots in the pattern would make eight times as many states
    Rule("web", "eyJ", "[A-Za-z0-9_.-]+", least=60),
)
RULES = BASE + MORE


class Secrets:
    """The compiled rules; made once on the driver, its arrays are a few hundred KB whatever the data."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        heads = [parse(r.head, r.head_either_case) for r in rules]
        trees = [("seq", [head, parse(r.tail)]) for head, r in zip(heads, rules, strict=True)]
        self.scanner = Scanner(trees)
        self.whole = [Dfa([tree], search=False) for tree in trees]
        self.heads = [Dfa([head], search=False) for head in heads]
        self.back = [Dfa([reverse(tree)], search=False) for tree in trees]

    def find(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start byte, rule, end byte), in that order."""
        found, done = [], [0] * len(self.rules)  # each match is resolved where it first ends
        for end, mask in self.scanner.ends(data):
            for k, after in enumerate(done):
                if end <= after or not mask >> k & 1:
                    continue
                start = self.back[k].farthest_back(data, end, after)
                if start < 0:
                    continue
                start = self._before(k, data, after, start)
                stop = done[k] = self.whole[k].longest(data, start)
                if self._long_enough(k, data, start, stop):
                    found.append((start, k, stop))
        return sorted(found)

    def _before(self, k: int, data: bytes, done: int, start: int) -> int:
        """A match that starts earlier and ends later than the first end seen comes first."""
        at = start
        while at > done and data[at - 1] not in self.scanner.resets:
            at -= 1
        return next((p for p in range(at, start) if self.whole[k].longest(data, p) >= 0), start)

    def _long_enough(self, k: int, data: bytes, start: int, stop: int) -> bool:
        rule = self.rules[k]
        if rule.least and len(data[start:stop].decode("utf-8", "replace")) < rule.least:
            return False
        if rule.least_tail:
            tail = max(self.heads[k].longest(data, start), start)
            return len(data[tail:stop].decode("utf-8", "replace")) >= rule.least_tail
        return True

    def spans(self, data: bytes) -> list[dict]:
        """Spans in code points."""
        try:
            data.decode("utf-8")
        except UnicodeDecodeError:
            data = data.decode("utf-8", "replace").encode()
        found = self.find(data)
        if not found:
            return []
        where = {0: 0}
        at = count = 0
        for edge in sorted({x for start, _, stop in found for x in (start, stop)}):
            count += len(data[at:edge].decode("utf-8"))
            at = edge
            where[edge] = count
        return [{"kind": self.rules[k].kind, "start": where[a], "end": where[b]} for a, k, b in found]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` (default: all columns) and secrets, an array of (kind, start, end). One pass, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(Secrets(rules))

    def make():
        compiled = held.value
        return lambda texts: [[compiled.spans(x) if x else [] for x in texts]]

    return scan_texts(docs, text, docs.columns if keep is None else keep, [T.StructField("secrets", SPANS)], make)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """`docs` with every secret span in `text` replaced by `mark`; overlapping spans become one."""
    held = docs.sparkSession.sparkContext.broadcast(Secrets(rules))

    def make():
        compiled = held.value

        def clean(data):
            if not data:
                return None if data is None else ""
            text, out, at = data.decode("utf-8", "replace"), [], 0
            for span in compiled.spans(data):
                if span["start"] >= at:
                    out += [text[at : span["start"]], mark]
                at = max(at, span["end"])
            return "".join([*out, text[at:]])

        return lambda texts: [[clean(x) for x in texts]]

    return scan_texts(docs, text, docs.columns, [T.StructField(text, T.StringType())], make).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = secret_spans(docs, keep=["doc_id"])
    base = [r.kind for r in BASE]

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(joined(F.filter("secrets", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )
