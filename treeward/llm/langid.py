"""Language identification: averaged hashed subword embeddings and a linear softmax.

Each n-gram of a word, with the spaces around it, has an embedding in a bucket of its
hash; a text is the mean over all its n-grams, and a linear layer gives the languages.
Trained by stochastic gradient descent in numpy on a bounded sample; a temperature and
a rejection threshold are fitted on the part of it that the descent has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, strings
from .wordhash import STEP, mixed

BUCKET_BITS = 16
SIZES = (2, 3, 4)
DIM = 16
CHUNK = 1 << 18
#: At most about so many documents of each language are learned from.
SAMPLE_PER_LANGUAGE = 1500


def letters() -> np.ndarray:
    """For each code point of the basic plane whether it is a letter; beyond it each counts as one only by lookup."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


_letters: np.ndarray | None = None


def pieces(text: str) -> Iterator[np.ndarray]:
    """The buckets of the n-grams of a text; long texts a piece at a time, cut where no word is cut."""
    text, at = text.lower(), 0
    while at < len(text):
        to = min(len(text), at + CHUNK)
        if to < len(text):
            cut = text.rfind(" ", at, to)
            to = cut if cut > at else to
        code = np.frombuffer(text[at:to].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        at = to
        code = np.where(letters()[code], code, 32)
        code = np.concatenate([[32], code, [32]])
        code = code[np.append(True, (code[1:] != 32) | (code[:-1] != 32))]
        if len(code) < 3:
            continue
        value = mixed(code.astype(np.uint64))
        space = code == 32
        for n in SIZES:
            if len(code) < n:
                continue
            m = len(code) - n + 1
            h = value[:m].copy()
            for k in range(1, n):
                h = h * STEP + value[k : m + k]
            ok = np.ones(m, dtype=bool)
            for k in range(1, n - 1):
                ok &= ~space[k : m + k]
            yield (mixed(h[ok]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and their counts."""
    counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    for p in pieces(text or ""):
        counts += np.bincount(p, minlength=len(counts))
    at = np.flatnonzero(counts)
    return at, counts[at]


class LanguageModel:
    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, threshold: float):
        #: ``table`` has the logits of each bucket: embeddings times the linear layer.
        self.languages, self.table, self.bias, self.temperature, self.threshold = languages, table, bias, temperature, threshold

    def logits(self, text: str) -> np.ndarray | None:
        total, n = np.zeros(len(self.languages)), 0
        for p in pieces(text):
            total += self.table[p].sum(axis=0, dtype=np.float64)
            n += len(p)
        return total / n + self.bias if n else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether it is high enough to be relied on; ``und`` without letters."""
        z = self.logits(text or "") if self.languages else None
        if z is None:
            return "und", 0.0, False
        p = softmax(z / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] >= self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], epochs: int = 10, rate: float = 0.5, seed: int = 1) -> LanguageModel:
    """Train on bags of buckets. A fifth of them is kept for the temperature and the threshold."""
    languages = sorted(set(langs))
    if not languages:
        return LanguageModel([], np.zeros((1, 0)), np.zeros(0), 1.0, 1.0)
    y = np.array([languages.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bags))
    cut = len(order) - len(order) // 5
    learn, check = order[:cut], order[cut:]
    emb = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIM))
    layer, bias = rng.normal(0, DIM**-0.5, (DIM, len(languages))), np.zeros(len(languages))
    shares = [n / n.sum() if len(n) else n.astype(float) for _, n in bags]
    steps, done = epochs * len(learn), 0
    for _ in range(epochs):
        for i in rng.permutation(learn):
            at, x = bags[i][0], shares[i]
            if len(at):
                lr = rate * (1 - done / steps)
                v = x @ emb[at]
                error = softmax(v @ layer + bias)
                error[y[i]] -= 1
                back = layer @ error
                layer -= lr * np.outer(v, error)
                bias -= 0.1 * lr * error
                # Scaled so that the text's mean moves by lr times the gradient however many n-grams share it.
                emb[at] -= np.outer(lr * x / (x @ x), back)
            done += 1
    table = (emb @ layer).astype(np.float32)
    held = [i for i in (check if len(check) else learn) if len(bags[i][0])]
    z = np.array([shares[i] @ table[bags[i][0]] + bias for i in held]).reshape(-1, len(languages))
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(z)), y[held]] + 1e-12).mean()
    temperature = min(np.geomspace(0.05, 5, 60), key=loss) if len(z) else 1.0
    p = softmax(z / temperature)
    sure, right = p.max(axis=1), p.argmax(axis=1) == y[held]
    falling = np.argsort(-sure)
    good = np.cumsum(right[falling]) >= 0.99 * np.arange(1, len(falling) + 1)
    threshold = float(sure[falling][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return LanguageModel(languages, table, bias, float(temperature), threshold)


def sample(docs: DataFrame, lang: str, per_language: int) -> DataFrame:
    """Rows with a language, thinned by the hash of their id to about ``per_language`` each."""
    known = docs.filter(F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    if not counts:
        return known
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))))
    unit = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    return known.filter(unit < F.element_at(share, F.col(lang)))


def train(docs: DataFrame, lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Fit on a bounded sample of ``docs`` (doc_id, text, ``lang``); what the driver gets of a text is its bag of buckets."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            bags = [bag(x) for x in strings(b.column(0))]
            columns = [pa.array([x[k].astype(np.int32) for x in bags], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(1), *columns], ["lang", "at", "n"])

    rows = sample(docs, lang, per_language).select("text", F.col(lang).alias("lang"))
    rows = staged(rows.mapInArrow(batches, "lang string, at array<int>, n array<int>"), "bags").toArrow()
    bags = [(np.asarray(a.values), np.asarray(n.values)) for a, n in zip(rows["at"], rows["n"], strict=True)]
    keyed = sorted(zip(rows["lang"].to_pylist(), bags, strict=True), key=lambda x: (x[0], len(x[1][0]), x[1][1].sum(), x[1][0].sum()))
    return fit([b for _, b in keyed], [k for k, _ in keyed])


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, accepted)``, one row for each row of ``docs``.

    ``score`` is the calibrated probability, ``accepted`` whether it reaches the
    rejection threshold. Null texts and texts without letters are ``und`` with score 0,
    as is all if the model has no languages. Texts are read whole; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [shared.value.predict(x) for x in strings(b.column(1))]
            columns = list(zip(*found, strict=True)) if found else [[]] * 3
            types = (pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, lang_pred string, score double, accepted boolean")
