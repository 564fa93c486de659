"""Differences between listings and the catalog, and rows that are to go."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeward.functions.columns import clamp
from treeward.sources.schema import KEY
from treeward.sources.staging import cut

EDGE_COLUMNS = ("filesystem_id", "parent_id", "name", "object_id")


#: Ranges of keys that get a digest each.
RANGES = 4096


def digests(rows: DataFrame, keys: list[str], ranges: int) -> DataFrame:
    """``(range, n, total, mix)``: of each range of the keys' hash the number of rows, and two digests of them that no order changes."""
    at = F.pmod(F.xxhash64(*keys), F.lit(ranges)).alias("range")
    other = F.xxhash64(F.lit(7), *keys)
    return rows.groupBy(at).agg(F.count("*").alias("n"), F.sum(F.shiftright(other, 20)).alias("total"), F.bit_xor(other).alias("mix"))


def differing(a: DataFrame, b: DataFrame, keys: list[str], ranges: int = RANGES) -> tuple[DataFrame, DataFrame]:
    """Both sides without the ranges of ``keys`` in which they are equal, row for row.

    Only digests are shuffled for it, ``ranges`` a side at most. Repeated rows on one side
    make a range differ, which costs a comparison and no mistake.
    """
    x, y = (digests(t, keys, ranges) for t in (a, b))
    same = F.expr("x.n <=> y.n AND x.total <=> y.total AND x.mix <=> y.mix")
    found = x.alias("x").join(y.alias("y"), F.col("x.range") == F.col("y.range"), "full").filter(~same).select(F.coalesce("x.range", "y.range").alias("range"))
    numbers = [r.range for r in found.collect()]
    if len(numbers) == ranges:
        return a, b
    # As many numbers as ranges at most; none if the sides are equal, and then nothing is read again.
    within = F.pmod(F.xxhash64(*keys), F.lit(ranges)).isin(numbers) if numbers else F.lit(False)
    return a.filter(within), b.filter(within)


def diff(listing: DataFrame, entries: DataFrame, depth: int = 5, limit: int | None = None) -> DataFrame:
    """``(side, name, size, object_id, total)``: names with sizes that only one side has.

    ``listing`` has ``name, size, depth`` and is cut at ``depth``; ``object_id`` is the
    smallest of the catalog's objects of that name and size. ``limit`` rows a side, by name and
    size; ``total`` counts them all. Ranges of names and sizes that are equal are not shuffled.
    """
    keys = ["name", "size"]
    seen, known = differing(listing.filter(F.col("depth") <= depth).select(*keys), entries.select(*keys, "object_id"), keys)
    seen = seen.distinct().withColumn("_seen", F.lit(True))
    known = known.groupBy(*keys).agg(F.min("object_id").alias("object_id")).withColumn("_known", F.lit(True))
    both = seen.alias("s").join(known.alias("k"), F.expr("s.name <=> k.name AND s.size <=> k.size"), "full").filter("_seen IS NULL OR _known IS NULL")
    side = F.when(F.col("_known").isNull(), "filesystem").otherwise("catalog").alias("side")
    rows = cut(both.select(side, F.coalesce("s.name", "k.name").alias("name"), F.coalesce("s.size", "k.size").alias("size"), "object_id"))
    totals = rows.groupBy("side").agg(F.count("*").alias("total"))
    if limit is not None:
        order = Window.partitionBy("side").orderBy(*keys)
        rows = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit)
    return rows.join(F.broadcast(totals), "side").select("side", *keys, "object_id", "total")


def compare_namespace(mounted: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(side, *edge)``: edges that only one side has; ranges of edges that are equal are not shuffled."""
    keys = list(EDGE_COLUMNS)
    a, b = differing(mounted.select(*keys), catalog.select(*keys), keys)
    sides = a.withColumn("side", F.lit("mounted")).unionByName(b.withColumn("side", F.lit("catalog")))
    one = sides.groupBy(*keys).agg(F.min("side").alias("side"), F.max("side").alias("_other")).filter("side = _other")
    return one.select("side", *keys)


def forget_removed(removed: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(removed rows that stay, report): the report says of each key whether there was such a row."""
    keys = keys.select(*KEY).distinct()
    stay = removed.join(keys, list(KEY), "left_anti")
    had = removed.select(*KEY).distinct().withColumn("existed", F.lit(True))
    return stay, keys.join(had, list(KEY), "left").select(*KEY, F.coalesce("existed", F.lit(False)).alias("existed"))


def orphans(entries: DataFrame, fs: str, before: int, limit: int | None = None) -> DataFrame:
    """Entries that no scan has seen since ``before``, oldest first; never directories."""
    rows = entries.filter((F.col("filesystem_id") == fs) & (F.col("last_seen") < before) & (F.col("kind") != 1))
    return rows.orderBy("last_seen", "object_kind", "object_id").limit(clamp(limit, 5000, 100_000))


def sweep_orphans(entries: DataFrame, edges: DataFrame, removed: DataFrame, fs: str, before: int, now: int, limit: int | None = None):
    """(entries, edges, removed) after the orphans have gone; ``orphans`` alone is the dry run."""
    gone = orphans(entries, fs, before, limit)
    keys = gone.select(*KEY)
    moved = gone.withColumn("rm_time", F.lit(now).cast("long"))
    return entries.join(keys, list(KEY), "left_anti"), edges.join(keys, list(KEY), "left_anti"), removed.unionByName(moved, allowMissingColumns=True)
