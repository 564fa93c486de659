"""SimHash near-duplicates: pigeonhole blocks, Hamming verification, groups.

``fingerprints`` hashes every shingle of every whole text; ``near_components``
groups ids whose fingerprints differ in few bits without ever emitting all pairs
of a group. The candidate search is shared by the line operator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, staged

BITS = 64
SEED = 42


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text.

    A-Z are lower-cased, words are runs of anything but ASCII white space, and each
    shingle (repeats count) is its words joined by one space; a shorter text is one
    shingle, a text without words, or null, has fingerprint 0. A bit is 1 if more
    than half the shingle hashes (XXH64, seed 42) have it.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = list(accumulate(map((1).__add__, map(len, words))))
    starts = [0, *ends]
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 65_536):
        to = min(n, at + 65_536)
        hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[at:to], last[at:to], strict=True)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of each row, ``fp`` as a signed long; one row for each input row."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, texts = b.column(0), b.column(1).cast(pa.large_binary())
            fps = np.array([fingerprint(x.as_py(), shingle) for x in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(fps)], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, fp long")


def hamming(a: str | Column, b: str | Column) -> Column:
    """How many bits of two longs differ."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def signed(mask: int, bits: int = BITS) -> int:
    """The same bits as a signed number."""
    return mask - (1 << bits) if mask >> (bits - 1) else mask


def block_masks(blocks: int, differ: int, bits: int = BITS) -> list[int]:
    """Signed masks of every choice of ``blocks - differ`` blocks out of ``blocks``.

    Two fingerprints that differ in at most ``differ`` bits agree under one of them.
    """
    cuts = [bits * i // blocks for i in range(blocks + 1)]
    own = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    chosen = (reduce(int.__or__, c) for c in combinations(own, blocks - differ))
    return [signed(m, bits) for m in chosen]


def block_keys(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """``(key, id)`` rows: one for each node and mask."""
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)))
    return nodes.select(F.explode(keys).alias("key"), "id", "fp")


def near_components(
    nodes: DataFrame,
    differ: int = 3,
    blocks: int = 6,
    verify: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``(id, component)`` of nodes ``(id, fp)`` that have a partner.

    Ids link if their fingerprints differ in at most ``differ`` bits and ``verify``,
    which maps pairs ``(a, b)`` to those that hold, agrees. The groups are exactly
    the transitive closure of all links, found in three steps:

    1. Each block key keeps its smallest and largest id and its count, combined
       map-side. A key with two ids is settled by that one pair.
    2. The ids of fuller keys link to the smallest id of the key: a star, so a
       group of n near copies gives n pairs and not n^2.
    3. Only keys whose ids still belong to several groups are joined with
       themselves, and only across groups: what a star has missed is found here. Of
       the rows of a key only those meet that agree in two of ``differ + 2`` shares of
       all bits as well, so that a key with many unrelated members makes few pairs.

    Nulls among ids or fingerprints take no part. The keys have 64 bits of which at
    least ``(blocks - differ) / blocks`` come from the fingerprint, so chance
    meetings stay rare up to billions of distinct fingerprints.
    """
    nodes = nodes.select("id", "fp").dropna().distinct()
    masks = block_masks(blocks, differ)
    sums = F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n"), F.bit_xor("fp").alias("apart")
    # Of two fingerprints the xor has the bits that differ: most chance meetings end here.
    keys = block_keys(nodes, masks).groupBy("key").agg(*sums).filter((F.col("n") > 2) | ((F.col("n") == 2) & (F.bit_count("apart") <= differ)))
    keys = staged(keys, "keys")
    full = keys.filter("n > 2").select("key", F.col("a").alias("hub"))
    full = full.hint("merge").join(nodes.select(F.col("id").alias("hub"), F.col("fp").alias("hub_fp")), "hub")
    # Spark sizes exploded rows as the table below them, and tables of repeated numbers by their files: both look small
    # enough to be broadcast long after they are too large for the driver, so these joins name another way.
    members = staged(block_keys(nodes, masks).hint("merge").join(full, "key"), "members")

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = pairs.filter("a != b").distinct()
        return staged(verify(pairs) if verify else pairs, "near")

    spokes = members.filter(hamming("hub_fp", "fp") <= differ).select(F.col("hub").alias("a"), F.col("id").alias("b"))
    links = checked(keys.filter("n = 2").select("a", "b").unionByName(spokes))
    groups = components(links)
    if members.isEmpty():
        return groups
    members = members.select("key", "id", "fp").distinct().hint("merge").join(groups, "id", "left")
    members = staged(members.withColumn("component", F.coalesce("component", "id")), "grouped")
    # Members of a key agree in half of their bits. Shares of all bits, one in so many, tell
    # them apart anew: pairs meet only if they agree in some of these as well.
    shares = [sum(1 << b for b in range(k, BITS, differ + 2)) for k in range(differ + 2)]
    shares = [signed(reduce(int.__or__, c)) for c in combinations(shares, 2)]
    open_keys = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    parts = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(shares)))
    rest = staged(members.hint("merge").join(open_keys, "key").withColumn("part", F.explode(parts)), "rest")
    other = rest.toDF(*(f"{c}_b" for c in rest.columns))
    across = rest.hint("merge").join(
        other,
        (rest["key"] == other["key_b"])
        & (rest["part"] == other["part_b"])
        & (rest["component"] < other["component_b"])
        & (hamming(rest["fp"], other["fp_b"]) <= differ),
    ).select(F.col("id").alias("a"), F.col("id_b").alias("b"))
    more = checked(across)
    if more.isEmpty():
        return groups
    return components(links.unionByName(more))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, differ: int = 3, blocks: int = 6
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each row of ``docs``.

    ``fingerprint`` has 16 hexadecimal digits; ``component_id`` is the smallest
    doc_id that links reach, the row's own included. Texts without words and null
    texts have fingerprint zero and link like any other. Rows that repeat a doc_id
    each get a row and share its links; a row whose doc_id is null keeps its links
    but is never a smallest id. Empty in, empty out; other columns are ignored.
    """
    rows = staged(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    # Equal fingerprints are one node, so that exact copies never meet as pairs.
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("id")), "nodes")
    groups = near_components(nodes, differ, blocks)
    named = nodes.join(groups, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return rows.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, differ: int = 3, blocks: int = 6) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the smallest doc_id stays.

    Rows that share a doc_id stay or go together; rows with a null doc_id stay.
    Columns and texts are unchanged.
    """
    found = near_duplicates(docs, differ=differ, blocks=blocks)
    gone = found.filter("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
