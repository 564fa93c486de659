"""What several operators share: staging between jobs, and groups from links."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The session's ``spark.checkpoint.dir`` names it. Only a local session, as in
    tests, may go without: then one temporary folder serves the application.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="treeward-")
    return _own_folder[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor re-reads the files rather than re-running
    what made them.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def strings(column) -> list[str | None]:
    """The texts of an Arrow column; bytes that are not UTF-8, which Spark lets through, become U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast("large_binary").to_pylist()]


def crc32_mod(col: Column | str, n: int) -> Column:
    """crc32 of a value as text, modulo ``n``; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")) % F.lit(n)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dropped(*tables: DataFrame) -> None:
    """Remove tables that ``staged`` wrote and that nothing reads any more."""
    for df in tables:
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """Connected groups of the graph with edges ``links(a, b)``.

    Returns ``(id, component)`` for every id that has a link; ``component`` is the
    smallest id of the group. Rows with nulls and self-links are ignored.

    Alternating star steps: each round hangs every neighbour of a node onto the
    smallest node that it knows of. A group is found in O(log^2 n) rounds whatever
    its diameter, rows never exceed the number of links, and a hub's neighbours are
    never gathered in one place: the minimum is combined map-side and joined back.
    """
    edges = staged(
        links.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        f"{name}-0",
    )
    before = None
    for i in range(1, 200):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: larger neighbours of a node move to its minimum.
        large = (
            both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        )
        # Small star: a node and its smaller neighbours move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .filter("u != v")
            .distinct()
        )
        last, edges = edges, staged(small, f"{name}-{i}")
        dropped(last)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    ids = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def key_components(rows: DataFrame, verify, close, facts_of, sums=(), near: Column | None = None, may=None) -> DataFrame:
    """``(id, component)`` of ids that share a key and that ``verify``, which maps pairs ``(a, b)`` to those that hold, links.

    ``rows`` has ``key, id`` and may repeat them. ``facts_of`` maps ids to what ``close``
    compares, a row each: ``close`` maps two functions from names to columns to a
    condition that every link fulfils, as ``may`` does with two ids. It is first called with all ids that are
    compared at all. ``sums`` are sums over the rows of a key and ``near`` a condition on
    them that every key with a link fulfils. The groups are the exact closure of the links: up to four
    ids of a key, its hubs, are compared with all its ids, and only keys whose other ids are then still in
    several groups are joined with themselves, and only across groups and without the hubs.
    """
    # Sums and join share one shuffle; the keys with several ids are few, and need no sort.
    dealt = rows.repartition("key")
    # A mask for each key makes other ids come first in other keys, so that the hubs of all keys are many.
    masks = [F.xxhash64("key"), F.xxhash64("key", F.lit(1))]
    ends = [f(F.col("id").bitwiseXOR(m)).alias(f"{name}{k}") for k, m in enumerate(masks) for name, f in (("lo", F.min), ("hi", F.max))]
    shared = dealt.groupBy("key").agg(*ends, *sums).filter("lo0 < hi0")
    shared = shared if near is None else shared.filter(near)
    hubs = F.array_distinct(F.array(*(F.col(f"{name}{k}").bitwiseXOR(m) for k, m in enumerate(masks) for name in ("lo", "hi"))))
    shared = shared.select("key", *(F.get(hubs, k).alias(f"hub{k}") for k in range(4)))
    members = staged(dealt.join(shared.hint("shuffle_hash"), "key").distinct(), "members")
    hubs = F.array(*(F.col(f"hub{k}") for k in range(4)))
    is_hub = F.coalesce(F.array_contains(F.array_compact(hubs), F.col("id")), F.lit(False))

    spokes = members.select("id", is_hub.alias("is_hub"), F.explode(hubs).alias("hub")).filter("id < hub OR id > hub AND NOT is_hub")
    spokes = spokes.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    spokes = staged((spokes if may is None else spokes.filter(may(F.col("a"), F.col("b")))).distinct(), "spokes")
    others = staged(members.filter(~is_hub).select("key", "id"), "others")
    dropped(members)
    facts_of(staged(spokes.select(F.explode(F.array("a", "b")).alias("id")).union(others.select("id")).distinct(), "ids"))
    links = staged(verify(spokes), "near")
    groups = staged(components(links), "groups")
    grouped = others.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    grouped = staged(grouped, "grouped")
    dropped(others)
    apart = F.min("component").alias("lo"), F.max("component").alias("hi")
    rest = staged(grouped.join(grouped.groupBy("key").agg(*apart).filter("lo < hi").select("key"), "key"), "open")
    dropped(grouped)
    if rest.isEmpty():
        return groups
    every = rest.groupBy("id").agg(F.collect_set("key").alias("keys"))
    rest = staged(rest.join(every, "id").join(facts_of(every.select("id")), "id"), "rest")
    again = rest.toDF(*(c if c == "key" else f"{c}_b" for c in rest.columns))
    across = rest.join(again, "key").filter("component < component_b").filter(close(F.col, lambda c: F.col(f"{c}_b")))
    # Two ids that share several keys meet once.
    across = across.filter(F.col("key") == F.array_min(F.array_intersect("keys", "keys_b")))
    more = verify(across.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b")).distinct())
    more = staged(more, "near")
    return groups if more.isEmpty() else components(links.unionByName(more))
