"""Quality rules: an isolation forest on rule statistics, its threshold calibrated from labelled rows.

Words are `[^\\x20\\x09-\\x0D]+`. Every text gets its statistics whole. A rule is a statistic with a lower and an upper
limit, taken from the labelled good rows; the forest sees by how much each rule is broken. Random axis-parallel splits
isolate unusual documents after few steps; the mean path length over the trees gives the anomaly score. Its threshold
weighs labelled low-quality rows against labelled good ones, of which at most `MOST_CLEAN_LOST` go.

Defined cases: null, empty and wordless texts have zero statistics and fail the base rules; without labelled rows of
both classes nothing but the base rules rejects; a document's repeated labels all count; null labels and labels without
a document count nowhere; repeated rows get equal rows; other columns pass through if kept.
"""

from __future__ import annotations

from collections import Counter
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, scan_texts, unit_interval

#: Labelled rows that the forest and its threshold are fitted on: about this many, chosen by a hash of their id.
FIT_ROWS = 20_000
TREES, SAMPLE, SEED = 128, 128, 20240229
#: Share of the labelled good rows that the threshold may reject, and how many low-quality rows one of them is worth.
MOST_CLEAN_LOST, CLEAN_WORTH = 0.002, 20.0
#: Share of the labelled good rows beyond either limit of a rule.
BEYOND_LIMIT = 0.001
SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "distinct"]


def statistics(data: bytes | None) -> tuple[list[int], list[float]]:
    """The five counts of COUNTS and the numbers of FEATURES for a text's UTF-8 bytes."""
    words = data.split() if data else []
    if not words:
        return [0, 0, len(data or b"") - len((data or b"").translate(None, SYMBOLS)), 0, 0], [0.0] * len(FEATURES)
    n = len(words)
    chars = len(data.translate(None, SPACES + _CONTINUED))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))  # noqa: B905
    if len(set(windows)) < len(windows):
        times, reach = Counter(windows), 0
        for at, window in enumerate(windows):
            if times[window] > 1:
                repeated += at + 5 - max(at, reach)
                reach = at + 5
    upper = len(data) - len(data.translate(None, _UPPER))
    digits = len(data) - len(data.translate(None, _DIGITS))
    marks = data.count(b"!") + data.count(b"?")
    return [n, chars, symbols, dup, repeated], [
        chars / n, symbols / n, dup / len(lines), repeated / n, upper / chars, digits / chars, marks / n, len(set(words)) / n**0.9,
    ]


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points, the usual correction for unsplit leaves."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(big - 1) + 0.5772156649015329) - 2 * (big - 1) / big))


class Forest:
    """Trees in arrays: feature (-1 at a leaf), threshold, children and, at leaves, the path length."""

    def __init__(self, rows: np.ndarray, good: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED):
        sound = rows[good] if good.any() else rows
        self.low, self.high = np.quantile(sound, [BEYOND_LIMIT, 1 - BEYOND_LIMIT], axis=0)
        self.scale = np.maximum(sound.std(axis=0), 1e-3)
        rows = self.broken(rows)
        rng = np.random.default_rng(seed)
        self.sample = min(sample, len(rows))
        self.most_depth = max(1, int(np.ceil(np.log2(max(self.sample, 2))))) + 2
        self.trees = [self._grow(rows[rng.choice(len(rows), self.sample, replace=False)], rng) for _ in range(trees)]
        self.threshold = np.inf

    def broken(self, rows: np.ndarray) -> np.ndarray:
        """By how much each rule is broken, in standard deviations of the good rows."""
        return np.log1p((np.maximum(rows - self.high, 0) + np.maximum(self.low - rows, 0)) / self.scale)

    def _grow(self, rows: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, path = [], [], [], [], []

        def node(part: np.ndarray, depth: int) -> int:
            at = len(feature)
            for x, v in ((feature, -1), (cut, 0.0), (left, at), (right, at), (path, 0.0)):
                x.append(v)
            low, high = part.min(axis=0), part.max(axis=0)
            able = np.flatnonzero(high > low)
            if depth >= self.most_depth or len(part) <= 1 or not len(able):
                path[at] = depth + float(_mean_path(len(part)))
                return at
            k = int(rng.choice(able))
            value = float(rng.uniform(low[k], high[k]))
            goes = part[:, k] < value
            feature[at], cut[at] = k, value
            left[at], right[at] = node(part[goes], depth + 1), node(part[~goes], depth + 1)
            return at

        node(rows, 0)
        return np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(path)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1): 2 to the minus mean path length over its expectation."""
        rows = self.broken(rows)
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, cut, left, right, path in self.trees:
            at = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.most_depth):
                k = feature[at]
                at = np.where((k < 0) | (rows[every, np.maximum(k, 0)] < cut[at]), left[at], right[at])
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(float(_mean_path(self.sample)), 1e-9))

    def calibrate(self, rows: np.ndarray, good: np.ndarray, most_lost: float = MOST_CLEAN_LOST) -> None:
        """The threshold that catches most bad rows less CLEAN_WORTH times the good ones lost, of which it allows `most_lost`.

        None is set without both classes.
        """
        if not len(rows) or good.all() or not good.any():
            return
        scores = self.scores(rows)
        order = np.argsort(-scores, kind="stable")
        scores, kept = scores[order], good[order]
        lost, caught = np.cumsum(kept), np.cumsum(~kept)
        gain = caught / (~good).sum() - CLEAN_WORTH * lost / good.sum()
        gain[(lost > most_lost * good.sum()) | np.append(scores[:-1] == scores[1:], True)] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] > 0:
            self.threshold = float((scores[best] + scores[best + 1]) / 2)


def features_of(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` (default: all columns), the counts and the feature vector `features`."""
    fields = [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("features", T.ArrayType(T.DoubleType()))]

    def make():
        def work(texts):
            found = [statistics(x) for x in texts]
            return [*([c[k] for c, _ in found] for k in range(len(COUNTS))), [f for _, f in found]]

        return work

    return scan_texts(docs, text, docs.columns if keep is None else keep, fields, make)


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", most: int = FIT_ROWS) -> Forest | None:
    """A calibrated forest from about `most` labelled documents, or None without any.

    The labels are counted first; what reaches the driver are the statistics of the chosen rows, never texts.
    """
    known = labels.select(F.col(f"`{doc_id}`").alias("__id"), F.col("quality").cast("int").alias("__good")).dropna()
    total = known.count()
    if not total:
        return None
    chosen = known.filter(unit_interval("__id", seed=SEED) < most / total)
    texts = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__t"))
    both = texts.join(F.broadcast(chosen), "__id")  # about `most` rows of two numbers
    rows = features_of(both, text="__t", keep=["__id", "__good"]).filter(~base_failed()).select("__id", "__good", "features").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values(["__id", "__good"], kind="stable")
    matrix, good = np.array(rows["features"].tolist()), rows["__good"].to_numpy() > 0
    forest = Forest(matrix, good)
    forest.calibrate(matrix, good)
    return forest


def judge(docs: DataFrame, forest: Forest | None, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` (default: all columns), the counts, base_failed, anomaly (score) and kept. One pass, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(forest)
    fields = [T.StructField(c, T.LongType()) for c in COUNTS]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("anomaly", T.DoubleType()), T.StructField("kept", T.BooleanType())]

    def make():
        def work(texts):
            found = [statistics(x) for x in texts]
            counts = np.array([c for c, _ in found], dtype=np.int64).reshape(-1, len(COUNTS))
            failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
            trained = held.value
            if trained is None or not len(found):
                scores, odd = np.zeros(len(found)), np.zeros(len(found), dtype=bool)
            else:
                scores = trained.scores(np.array([f for _, f in found]))
                odd = scores > trained.threshold
            return [*counts.T, failed, scores, ~failed & ~odd]

        return work

    return scan_texts(docs, text, docs.columns if keep is None else keep, fields, make)


def keep_good(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the documents that the base rules or the forest reject; columns as before."""
    forest = fit(docs, labels, doc_id=doc_id, text=text)
    aside = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{text}`").alias("__words_of"))
    return judge(aside, forest, text="__words_of", keep=["__row"]).filter("kept").select("__row.*")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    found = judge(docs, fit(docs, labels), keep=["doc_id"])
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")
