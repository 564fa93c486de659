"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are fitted in numpy on a bounded sample of labelled rows and flattened into
arrays; scoring walks all rows of a batch down a tree at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, strings

#: At most so many labelled rows are learned from, chosen by the hash of their id.
SAMPLE = 20_000
FEATURES = (
    "log_chars", "log_words", "word_length", "longest_word", "different_words", "top_word", "repeated_triples",
    "log_lines", "line_length", "different_lines", "ended_lines", "empty_lines", "upper", "digits", "space", "symbols",
    "sentence_marks", "other_marks", "beyond_ascii", "entropy", "words_without_letters", "upper_words", "pipes", "exclamations",
)


def statistics(text: str | None) -> list[float]:
    """The values of ``FEATURES`` for a whole text; zeros for null and empty texts."""
    text = text or ""
    if not text:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    n = counts.sum()
    words, lines = text.split(), text.split("\n")
    k, m = max(1, len(words)), len(lines)
    of = lambda marks: counts[list(marks)].sum() / n
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    triples = len(words) - 2
    p = counts[counts > 0] / n
    full = [x for x in lines if x and not x.isspace()]
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / k, float(max(map(len, words), default=0)), len(seen) / k, max(seen.values(), default=0) / k,
        1 - len(set(zip(words, words[1:], words[2:]))) / triples if triples > 0 else 0.0,
        np.log1p(m), len(text) / m, len(set(lines)) / m, sum(x.rstrip()[-1] in ".!?:;\"'" for x in full) / max(1, len(full)), 1 - len(full) / m,
        of(range(65, 91)), of(range(48, 58)), of(b" \t\n\r\x0b\x0c"), of(b"#*$%&|<>"), of(b".,;:?"), of(b"()[]{}@/\\_=+-~^`'\""), counts[128:].sum() / n,
        float(-(p * np.log2(p)).sum()), sum(not any(map(str.isalpha, w)) for w in seen) / max(1, len(seen)), sum(v for w, v in seen.items() if w.isupper()) / k,
        of(b"|"), of(b"!"),
    ]


class Trees:
    """Complete binary trees of one depth in flat arrays: node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(np.log2(len(feature) + 1))):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, least: int = 10, ridge: float = 1.0) -> Trees:
    """Boost on the logistic loss; a constant if there are no rows or one label only."""
    inner = 2**depth - 1
    if not len(y) or y.min() == y.max():
        base = 0.0 if not len(y) else float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        return Trees(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    base = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(len(y), base)
    shape = (trees, inner)
    feature, threshold, value = np.zeros(shape, int), np.full(shape, np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            own = node - first
            best, gain = np.full(width, -1), np.full(width, 1e-6)
            at = np.zeros(width, int)
            for j, b in enumerate(binned):
                key = own * bins + b
                sums = [np.bincount(key, w, width * bins).reshape(width, bins).cumsum(axis=1) for w in (g, h, None)]
                (gl, hl, nl), (ga, ha, na) = sums, (s[:, -1:] for s in sums)
                score = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                score = np.where((nl >= least) & (na - nl >= least), score, -np.inf)[:, : len(edges[j])]
                if score.shape[1]:
                    top = score.argmax(axis=1)
                    better = score[np.arange(width), top] > gain
                    gain[better], best[better], at[better] = score[np.arange(width), top][better], j, top[better]
            for k in np.flatnonzero(best >= 0):
                feature[t, first + k], threshold[t, first + k] = best[k], edges[best[k]][at[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        total += value[t, leaf]
    return Trees(base, feature, threshold, value)


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, features)``, one row for each row of ``docs``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            values = [statistics(x) for x in strings(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.list_(pa.float64()))], ["doc_id", "features"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, features array<double>")


def train(found: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fit on ``found`` (doc_id, features) and ``labels`` (doc_id, quality).

    A document that is labelled more than once counts once, with the majority (1 if
    even); null labels count not at all. At most ``sample`` labels are used; of several
    texts that share an id the one of the least statistics is learned from.
    """
    known = labels.dropna(subset=["doc_id", "quality"]).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    # The labels are chosen first: then only their documents' rows meet.
    chosen = staged(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "chosen")
    rows = found.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"), F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    if not rows.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.array(rows["features"].combine_chunks().flatten()).reshape(-1, len(FEATURES))
    return fit(x, np.array(rows["y"], dtype=np.float64))


def scored(found: DataFrame, model: Trees, least: float = 0.3) -> DataFrame:
    """``(doc_id, score, predicted)`` of ``found`` rows; ``predicted`` is 1 from ``least`` on."""
    shared = found.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = np.array(b.column(1).flatten(), dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(x))], ["doc_id", "score"])

    rows = found.select("doc_id", "features").mapInArrow(batches, "doc_id long, score double")
    return rows.withColumn("predicted", (F.col("score") >= least).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, learn=None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)`` of every row of ``docs``, learned from ``labels``.

    ``learn`` is a condition on the labels' rows that may be learned from. Null and
    empty texts are scored like any other, repeated rows each; without usable labels
    the score is 0.5. Columns but id and text are ignored.
    """
    found = staged(features(docs, doc_id, text), "features")
    model = train(found, labels if learn is None else labels.filter(learn))
    return scored(found, model)
