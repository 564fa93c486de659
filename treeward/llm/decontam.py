"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The n-grams of a benchmark item are its runs of three words, and those that leave out one
word between: copies with a word changed, lost or put in every third place still have some.
A first scan of the corpus counts them, each item's rarer ones become its seeds, and a
second scan cuts passages only where texts have seeds, and aligns each with its item on
the spot. So a phrase that many items and texts share brings nothing together, and no
rows are shuffled by item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, strings
from .wordhash import STEP, mixed, ngrams, word_hashes

#: How many n-grams of benchmark items are sent to the executors at once (16 bytes
#: each, so 16 MB); with more, the items are dealt into blocks, two scans for each.
BLOCK_GRAMS = 1_000_000
N = 3
#: A seed occurs at most so many times as often as the item's n-grams in the median, plus one.
RARE = 8


def item_words(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item_id, words)``: the word hashes of each benchmark item that has words."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            words = [word_hashes(x).view(np.int64) for x in strings(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.int64()))], ["item_id", "words"])

    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    return rows.filter("item_id IS NOT NULL").mapInArrow(batches, "item_id long, words array<long>").filter("size(words) > 0")


def gapped(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of three words each, side by side or with one left out, and where they begin."""
    parts, at = [], []
    for second, third in ((1, 2), (1, 3), (2, 3)):
        n = max(0, len(words) - third)
        parts.append(mixed((words[:n] * STEP + words[second : second + n]) * STEP + words[third : third + n]))
        at.append(np.arange(n))
    return np.concatenate(parts), np.concatenate(at)


def item_grams(words: DataFrame) -> DataFrame:
    """``(item_id, pos, gram, len, size)``: the n-grams of each item; an item of one or two words is one."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            parts = []
            for item, w in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = np.array(w.as_py(), dtype=np.int64).view(np.uint64)
                size = min(N, len(w))
                g, at = gapped(w) if size == N else (ngrams(w, size), np.arange(1))
                parts.append((np.full(len(g), item), at, g.view(np.int64), np.full(len(g), len(w)), np.full(len(g), size)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts, strict=True)], ["item_id", "pos", "gram", "len", "size"])

    return words.mapInArrow(batches, "item_id long, pos long, gram long, len long, size long")


class Grams:
    """Sorted n-grams, to be looked up in texts."""

    def __init__(self, gram: np.ndarray, sizes: list[int]):
        self.gram, self.sizes = gram, sizes
        # A first look by 22 bits spares most n-grams the search.
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[gram & 0x3FFFFF] = True

    def find(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(size, where, first place, last place) of a text's n-grams that are here."""
        for n in self.sizes:
            own, at = gapped(words) if n == N else (ngrams(words, n), np.arange(max(0, len(words) - n + 1)))
            own = own.view(np.int64)
            hit = np.flatnonzero(self.maybe[own & 0x3FFFFF])
            low, high = np.searchsorted(self.gram, own[hit], "left"), np.searchsorted(self.gram, own[hit], "right")
            real = high > low
            yield n, at[hit[real]], low[real], high[real]


def counts(texts: DataFrame, grams: DataFrame) -> DataFrame:
    """``(gram, times)``: how often the corpus has each of the n-grams; those it does not have are left out."""
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect())
    own = np.sort(grams.select("gram").distinct().toArrow().column(0).to_numpy())
    shared = texts.sparkSession.sparkContext.broadcast(own)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Grams(shared.value, sizes)
        for b in it:
            times = np.zeros(len(known.gram), dtype=np.int64)
            for text in strings(b.column(1)):
                for _, _, low, _ in known.find(word_hashes(text)):
                    np.add.at(times, low, 1)
            seen = np.flatnonzero(times)
            yield pa.RecordBatch.from_arrays([pa.array(known.gram[seen]), pa.array(times[seen])], ["gram", "times"])

    found = texts.mapInArrow(batches, "gram long, times long")
    return found.groupBy("gram").agg(F.sum("times").alias("times"))


def rare(grams: DataFrame, seen: DataFrame) -> DataFrame:
    """The rows of ``grams`` that are seeds: at least the rarer half of each item's, if it is common or copied often as a whole."""
    known = grams.join(seen, "gram", "left").fillna(0, "times")
    middle = known.groupBy("item_id").agg(F.percentile("times", F.lit(0.5)).alias("middle"))
    return known.join(middle, "item_id").filter(F.col("times") <= RARE * (F.col("middle") + 1)).select(*grams.columns)


def aligned(texts: DataFrame, seeds: DataFrame, words: DataFrame, min_score: float) -> DataFrame:
    """``(doc_id, item_id, score, start_word, end_word)``: passages around seeds that align with their item.

    A seed says where the item would begin; beginnings of one item that lie within half
    its length of each other make one passage, which reaches half the item's length (4
    words at least) beyond on either side.
    """
    sizes = sorted(r[0] for r in seeds.select("size").distinct().collect())
    table = {c: v.to_numpy() for c, v in zip(seeds.columns, seeds.toArrow().columns, strict=True)}
    order = np.argsort(table["gram"], kind="stable")
    own = words.toArrow()
    items = {i: np.array(w.as_py(), dtype=np.int64) for i, w in zip(own.column(0).to_pylist(), own.column(1), strict=True)}
    shared = texts.sparkSession.sparkContext.broadcast(({c: v[order] for c, v in table.items()}, items))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, items = shared.value
        known = Grams(seeds["gram"], sizes)
        for b in it:
            rows: set[tuple] = set()
            out = []
            for doc, text in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                rows.clear()
                words = word_hashes(text)
                for n, at, low, high in known.find(words):
                    if len(at):
                        hits = high - low
                        k = np.repeat(low - np.cumsum(hits) + hits, hits) + np.arange(hits.sum())
                        ok = seeds["size"][k] == n
                        for item, start, passage in passages(words, np.repeat(at, hits)[ok], k[ok], seeds):
                            if found := best(passage, items[item], min_score):
                                rows.add((doc, item, found[0], start + found[1], start + found[2]))
                out += sorted(rows, key=lambda r: r[1:])
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "score", "start_word", "end_word"])

    return texts.mapInArrow(batches, "doc_id long, item_id long, score double, start_word long, end_word long")


def passages(words: np.ndarray, at: np.ndarray, k: np.ndarray, seeds: dict[str, np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(item, start, words) of one text's passages, from where (``at``) it has which seeds (``k``)."""
    item, size = seeds["item_id"][k], seeds["len"][k]
    begin = at - seeds["pos"][k]
    order = np.lexsort((begin, item))
    item, size, begin = item[order], size[order], begin[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > np.maximum(4, size[1:] // 2))
    firsts = np.flatnonzero(new)
    for i, j in zip(firsts.tolist(), [*firsts[1:].tolist(), len(k)], strict=True):
        m = int(size[i])
        pad = max(4, m // 2)
        low = max(0, int(begin[i]) - pad)
        yield int(item[i]), low, words[low : int(begin[j - 1]) + m + pad].view(np.int64)


def best(passage: np.ndarray, item: np.ndarray, min_score: float) -> tuple[float, int, int] | None:
    """The score of the best alignment over that of the item with itself, and its place in the passage, if it reaches ``min_score``."""
    # A word matches once at most: with too few of the item's words no alignment can reach it.
    if np.isin(item, passage).sum() < min_score * len(item):
        return None
    score, end = align(passage, item)
    if score < min_score * 2 * len(item):
        return None
    _, back = align(passage[:end][::-1], item[::-1])
    return score / (2 * len(item)), end - back, end


def align(passage: np.ndarray, item: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int]:
    """The best local alignment score of two word sequences and where it ends in ``passage``.

    A row of the table at a time; gaps along the row are a running maximum.
    """
    slope = -gap * np.arange(len(passage) + 1, dtype=np.int64)
    row, best, end = np.zeros(len(passage) + 1, dtype=np.int64), 0, 0
    for w in item:
        new = np.maximum(row + gap, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(passage == w, match, mismatch))
        row = np.maximum.accumulate(new + slope) - slope
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", min_score: float = 0.5, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """``(doc_id, item_id, score, start_word, end_word)``: passages of texts that align with benchmark items.

    ``score`` is the Smith-Waterman score (match 2, mismatch and gap -1, over words)
    over that of the item with itself; passages from ``min_score`` on are returned.
    Word numbers count from 0, the end excluded. A text may hold several passages. Null and empty texts, and
    items without words, match nothing; repeated rows are each matched; null doc_ids are
    passed on; other columns are ignored; without items or documents the result is empty.
    The time of an alignment grows with the square of the item's length.
    """
    words = staged(item_words(items, text=text).dropDuplicates(["item_id"]), "items")
    grams = staged(item_grams(words), "grams")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    blocks = max(1, -(-grams.count() // block_grams))
    out = None
    for k in range(blocks):
        block = lambda df: df if blocks == 1 else df.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)  # noqa: B023, E731
        seeds = staged(rare(block(grams), counts(texts, block(grams))), "seeds")
        found = aligned(texts, seeds, block(words), min_score)
        out = found if out is None else out.unionByName(found)
    return out


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no benchmark item was found, columns and texts unchanged.

    Rows that share a doc_id stay or go together; rows with a null doc_id, null or empty
    texts stay; repeated rows stay; empty in, empty out; columns of any name are passed on.
    """
    bad = contaminated(docs, items).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")
