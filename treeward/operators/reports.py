"""Counts, usage reports, sorted pages and lookups over catalog entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeward.functions.columns import clamp, kind_label
from treeward.sources.schema import KEY

from .predicate import TRUE, to_column

GROUP_KEYS = ("uid", "gid", "projid", "kind", "pool_name", "parent")
SIZE_BUCKETS = (("0", 1), ("<1K", 1 << 10), ("1K-1M", 1 << 20), ("1M-100M", 100 << 20), ("100M-1G", 1 << 30), (">=1G", None))
RUN_BUCKETS = (0.1, 0.5, 1.0, 5.0, 15.0, 60.0, 300.0, 900.0, 3600.0, float("inf"))


def of_filesystem(entries: DataFrame, fs: str) -> DataFrame:
    return entries.filter(F.col("filesystem_id") == fs)


def count_where(entries: DataFrame, fs: str, pred: dict = TRUE, stripes: DataFrame | None = None) -> DataFrame:
    return of_filesystem(entries, fs).filter(to_column(pred, stripes=stripes)).agg(F.count("*").alias("n"))


def sum_size_where(entries: DataFrame, fs: str, pred: dict = TRUE, stripes: DataFrame | None = None) -> DataFrame:
    return of_filesystem(entries, fs).filter(to_column(pred, stripes=stripes)).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))


def _group_key(key: str) -> Column:
    if key not in GROUP_KEYS:
        raise ValueError(f"cannot group by {key!r}")
    if key == "parent":
        col = F.concat(F.col("object_kind").cast("string"), F.lit(":"), F.lpad(F.hex("parent_id"), 32, "0"))
    else:
        col = F.col(key).cast("string")
    return F.coalesce(col, F.lit("")).alias("key")


def aggregate_by(entries: DataFrame, fs: str, key: str, sort: str = "size", limit: int | None = None) -> DataFrame:
    """``(key, count, total_size)``, largest first; ties by key."""
    order = {"size": "total_size", "count": "count"}[sort]
    sums = of_filesystem(entries, fs).groupBy(_group_key(key)).agg(F.count("*").alias("count"), F.sum("size").alias("total_size"))
    return sums.orderBy(F.desc(order), "key").limit(clamp(limit, 50, 1000))


def named(report: DataFrame, idmap: DataFrame) -> DataFrame:
    """A report by uid or gid with the display names of a user-supplied table; missing ones stay null.

    Reports have at most 1000 rows, the id table is as large as it is: Spark picks the join.
    """
    return report.join(idmap.select(F.col("id").cast("string").alias("key"), "name"), "key", "left")


def top_owners(entries: DataFrame, fs: str, idmap: DataFrame, key: str = "uid", n: int = 20, sort: str = "size") -> DataFrame:
    return named(aggregate_by(entries, fs, key, sort, n), idmap)


def fs_info(entries: DataFrame, fs: str) -> DataFrame:
    by_kind = aggregate_by(entries, fs, "kind", "count")
    return by_kind.select(kind_label(F.col("key").cast("int")).alias("kind"), "count", "total_size")


def size_profile(entries: DataFrame, fs: str) -> DataFrame:
    """``(ord, bucket, count, total_size)`` of files by size, in bucket order; empty buckets are absent."""
    which = F.lit(len(SIZE_BUCKETS) - 1)
    for i in range(len(SIZE_BUCKETS) - 2, -1, -1):
        which = F.when(F.col("size") < SIZE_BUCKETS[i][1], i).otherwise(which)
    files = of_filesystem(entries, fs).filter(F.col("kind") == 0).groupBy(which.alias("ord"))
    sums = files.agg(F.count("*").alias("count"), F.sum("size").alias("total_size"))
    label = F.element_at(F.array(*(F.lit(b) for b, _ in SIZE_BUCKETS)), F.col("ord") + 1)
    return sums.select("ord", label.alias("bucket"), "count", "total_size").orderBy("ord")


def stripes_with_entries(entries: DataFrame, stripes: DataFrame) -> DataFrame:
    slim = entries.select(*KEY, "size", "stripe_count")
    return stripes.join(slim, list(KEY))


def stripe_distribution(entries: DataFrame, stripes: DataFrame, fs: str) -> DataFrame:
    """``(ost_index, files, total_size)``: stripes of each target, sizes shared among an object's stripes.

    Shares have four decimals, their sum is rounded once. Rows of objects without a
    stripe count are counted and have no share.
    """
    rows = stripes_with_entries(of_filesystem(entries, fs), of_filesystem(stripes, fs))
    tenthousandths = F.expr("CASE WHEN stripe_count > 0 THEN (20000 * size + stripe_count) div (2 * stripe_count) END").cast("decimal(28,0)")
    sums = rows.groupBy("ost_index").agg(F.count("*").alias("files"), F.coalesce(F.sum(tenthousandths), F.lit(0)).alias("_sum"))
    sums = sums.select("ost_index", "files", F.expr("(_sum + 5000) div 10000").cast("long").alias("total_size"))
    return sums.orderBy(F.desc("total_size"), "ost_index")


def fs_usage(ost_usage: DataFrame) -> DataFrame:
    """One row: used and total over all targets, and the percentage, 0 if there is no room at all."""
    sums = ost_usage.agg(F.coalesce(F.sum("used"), F.lit(0)).alias("used"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    return sums.withColumn("percent", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(100.0 * F.col("used") / F.nullif(F.col("total"), F.lit(0))))


def event_counts(changes: DataFrame, filesystems: DataFrame) -> DataFrame:
    by = changes.groupBy("filesystem_id", "source", "kind").agg(F.count("*").alias("n"))
    return by.join(filesystems.select("filesystem_id", "backend"), "filesystem_id").select("filesystem_id", "backend", "source", "kind", "n")


def action_rollup(results: DataFrame) -> DataFrame:
    """Of each run its successes, skips and failures, and its outcome, by the last attempt on each object."""
    final = results.groupBy("run", "filesystem_id", "object_kind", "object_id").agg(F.max_by("outcome", "attempt").alias("outcome"))
    done = F.count_if(F.col("outcome").isin("success", "already_missing"))
    sums = final.groupBy("run").agg(done.alias("success"), F.count_if(F.col("outcome") == "skipped").alias("skipped"), F.count_if(F.col("outcome").isin("failed", "retryable")).alias("failed"))
    none = (F.col("failed") == 0) & (F.col("success") == 0) & (F.col("skipped") == 0)
    outcome = F.when(none, "empty").when(F.col("failed") == 0, "success").when(F.col("success") > 0, "partial").otherwise("failed")
    return sums.withColumn("outcome", outcome)


def run_durations(runs: DataFrame, by: str = "policy", seconds: str = "seconds") -> DataFrame:
    """``(policy, le, n)``: how many runs took at most each bucket's bound."""
    bounds = F.explode(F.array(*(F.lit(b) for b in RUN_BUCKETS))).alias("le")
    counts = runs.groupBy(by).agg(*(F.count_if(F.col(seconds) <= b).alias(f"_{i}") for i, b in enumerate(RUN_BUCKETS)))
    pick = F.element_at(F.array(*(F.col(f"_{i}") for i in range(len(RUN_BUCKETS)))), F.array_position(F.array(*(F.lit(b) for b in RUN_BUCKETS)), F.col("le")).cast("int"))
    return counts.select(by, bounds, *(f"_{i}" for i in range(len(RUN_BUCKETS)))).select(by, "le", pick.alias("n"))


#: Sketches of run times: a quantile's rank is off by at most this share (at 99 % confidence for sketches of this size).
SKETCH_K, RANK_ERROR = 800, 0.005


def run_sketches(runs: DataFrame, period: Column, by: str = "policy", seconds: str = "seconds") -> DataFrame:
    """``(policy, period, sketch)``: a small sketch of the run times in each period, to be stored and merged."""
    return runs.groupBy(by, period.alias("period")).agg(F.kll_sketch_agg_double(F.col(seconds).cast("double"), F.lit(SKETCH_K)).alias("sketch"))


def run_percentiles(sketches: DataFrame, by: str = "policy", ranks: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """``(policy, n, p50, p95)`` of merged sketches: any periods, without their runs; ranks within ``RANK_ERROR``, exact up to some ``SKETCH_K`` runs."""
    merged = sketches.groupBy(by).agg(F.kll_merge_agg_double("sketch").alias("s"))
    picks = [F.kll_sketch_get_quantile_double("s", F.lit(r)).alias(f"p{round(100 * r)}") for r in ranks]
    return merged.select(by, F.kll_sketch_get_n_double("s").alias("n"), *picks)


# Pages ---------------------------------------------------------------------------


def ordered(df: DataFrame, order_by: list[tuple[str, bool]]) -> DataFrame:
    """Sorted by (column, descending) pairs, then by the object id."""
    return df.orderBy(*(F.desc(c) if d else F.asc(c) for c, d in order_by), "object_kind", "object_id")


def query(
    entries: DataFrame, fs: str, pred: dict = TRUE, order_by: list[tuple[str, bool]] = (), limit: int | None = None, offset: int = 0,
    stripes: DataFrame | None = None,
) -> DataFrame:
    """A page of matching entries; ``count_where`` with the same predicate gives the total."""
    found = of_filesystem(entries, fs).filter(to_column(pred, stripes=stripes))
    return ordered(found, list(order_by)).offset(offset).limit(clamp(limit, 1000, 10_000))


def top_size(entries: DataFrame, fs: str, n: int | None = None) -> DataFrame:
    return ordered(of_filesystem(entries, fs), [("size", True)]).limit(clamp(n, 20, 1000))


def oldest(entries: DataFrame, fs: str, n: int | None = None) -> DataFrame:
    return ordered(of_filesystem(entries, fs), [("atime", False)]).limit(clamp(n, 20, 1000))


def list_removed(removed: DataFrame, fs: str, since: int | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    rows = of_filesystem(removed, fs)
    if since is not None:
        rows = rows.filter(F.col("rm_time") >= since)
    return ordered(rows, [("rm_time", True)]).offset(offset).limit(clamp(limit, 500, 10_000))


def keyset_page(entries: DataFrame, fs: str, after: int | None, limit: int) -> DataFrame:
    rows = of_filesystem(entries, fs)
    if after is not None:
        rows = rows.filter(F.col("object_id") > after)
    return rows.orderBy("object_id").limit(limit)


def entry_view(entries: DataFrame) -> DataFrame:
    """The public columns of entries, kinds as words."""
    return entries.select(*KEY, "parent_id", "name", kind_label("kind").alias("kind"), "size", "uid", "gid", "mode", "nlink", "atime", "mtime", "ctime", "pool_name", "hsm_state", "depth")


# Lookups -------------------------------------------------------------------------


def lookup_children(edges: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes`` (filesystem_id, parent_id, name) with the object that has that name, null if none."""
    return probes.join(edges.select("filesystem_id", "parent_id", "name", "object_id"), ["filesystem_id", "parent_id", "name"], "left")


def edges_of(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """``(filesystem_id, object_id, names)``: every name of each object, ordered by parent and name."""
    mine = edges.join(objects.select("filesystem_id", "object_id").distinct(), ["filesystem_id", "object_id"], "left_semi")
    names = F.sort_array(F.collect_list(F.struct("object_kind", "parent_id", "name")))
    return mine.groupBy("filesystem_id", "object_id").agg(names.alias("names"))


def get_entries(entries: DataFrame, keys: DataFrame) -> DataFrame:
    return entries.join(keys.select(*KEY).distinct(), list(KEY), "left_semi")


def tag_distribution(entries: DataFrame, fs: str, key: str) -> DataFrame:
    by = of_filesystem(entries, fs).groupBy(F.col("xattr")[key].alias("value"))
    return by.agg(F.count("*").alias("count"), F.sum("size").alias("total_size"))


def fan_out_stripes(stripes: DataFrame, entries: DataFrame, existing: DataFrame) -> DataFrame:
    """Stripes without a filesystem, for every filesystem that holds the object; existing rows win."""
    cols = ["filesystem_id", "object_kind", "object_id", "stripe_index", "ost_index"]
    spread = stripes.select("object_kind", "object_id", "stripe_index", "ost_index").join(entries.select(*KEY), ["object_kind", "object_id"])
    new = spread.join(existing, ["filesystem_id", "object_kind", "object_id", "stripe_index"], "left_anti")
    return existing.select(*cols).unionByName(new.select(*cols))


def namespace_difference(mounted: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: how many edges only the mount has and only the catalog has."""
    cols = ["filesystem_id", "parent_id", "name", "object_id"]
    side = lambda a, b, s: a.select(*cols).distinct().join(b.select(*cols), cols, "left_anti").select(F.lit(s).alias("side"))
    both = side(mounted, catalog, 1).unionByName(side(catalog, mounted, 2))
    return both.agg(F.count_if(F.col("side") == 1).alias("only_mounted"), F.count_if(F.col("side") == 2).alias("only_catalog"))


