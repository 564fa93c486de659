"""Reading, writing and updating catalog tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeward.functions.columns import glob_filter, key_from_text, key_to_text, kind_code
from treeward.sources.schema import BACKEND_KIND, ENTRY, ID_COLUMNS, KEY


def read_catalog(spark: SparkSession, path: str, schema: T.StructType = ENTRY) -> DataFrame:
    """A catalog table with its declared types; no schema is inferred."""
    return spark.read.schema(schema).parquet(path)


def write_catalog(entries: DataFrame, path: str) -> None:
    """Partitioned by filesystem, so that a query of one reads only its files."""
    entries.repartition("filesystem_id", F.pmod(F.xxhash64("object_id"), F.lit(64))).sortWithinPartitions("filesystem_id", "mtime").write.mode("overwrite").partitionBy("filesystem_id").parquet(path)


def project_payload(raw: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``(key, payload)`` rows, the payload JSON, as typed entries; parent and name from edges where there are some.

    Missing numbers are 0, a missing nlink 1; kinds are words in the payload.
    """
    payload = "kind string, size long, blocks long, uid long, gid long, projid long, mode long, nlink long, atime long, mtime long, ctime long, last_seen long, stripe_count int, stripe_size long, pool_name string, depth long, name string, parent_id long"
    rows = raw.select(*KEY, F.from_json("payload", payload).alias("p")).select(*KEY, "p.*")
    zero = {c: F.coalesce(c, F.lit(0)) for c in "size blocks uid gid projid mode atime mtime ctime last_seen depth".split()}
    rows = rows.withColumns({**zero, "nlink": F.coalesce("nlink", F.lit(1)), "kind": F.coalesce(kind_code("kind"), F.lit(0))})
    if edges is None:
        return rows
    first = edges.groupBy(*KEY).agg(F.min(F.struct("parent_id", "name")).alias("e"))
    rows = rows.join(first, list(KEY), "left")
    return rows.withColumns({"parent_id": F.coalesce("e.parent_id", "parent_id"), "name": F.coalesce("e.name", "name")}).drop("e")


def load_ignore(spark: SparkSession, path: str, more: list[str] = ()) -> list[str]:
    """Globs of an ignore file, without blanks and comments, and those of the request."""
    lines = spark.read.text(path).select(F.trim("value").alias("g")).filter("g <> '' AND NOT g LIKE '#%'")
    return [r.g for r in lines.collect()] + list(more)


def ingest_listing(listing: DataFrame, fs: str, ignore: list[str] = (), since_mtime: int | None = None, max_depth: int | None = None, observed_at: int = 0):
    """(entries, edges) of a stat listing ``(path, object_id, kind, size, ...)`` under one root, ``/``.

    Drops names that are ignored and all below them, non-directories older than
    ``since_mtime``, and what is too deep: directories over ``max_depth``, others over
    one more. The root is never ignored. Parents are found by path.
    """
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = listing.withColumns({"_parts": parts, "depth": F.size(parts).cast("long")})
    if ignore:
        rows = rows.filter(~F.exists("_parts", lambda x: glob_filter(x, list(ignore))))
    if since_mtime is not None:
        rows = rows.filter((F.col("kind") == 1) | (F.col("mtime") >= since_mtime))
    if max_depth is not None:
        rows = rows.filter(F.col("depth") <= F.when(F.col("kind") == 1, max_depth).otherwise(max_depth + 1))
    name = F.when(F.col("depth") == 0, "").otherwise(F.element_at("_parts", -1))
    above = F.when(F.col("depth") > 0, F.concat(F.lit("/"), F.array_join(F.slice("_parts", F.lit(1), F.greatest(F.col("depth").cast("int") - 1, F.lit(0))), "/")))
    own = F.concat(F.lit("/"), F.array_join("_parts", "/"))
    rows = rows.withColumns({"name": name, "_above": above, "_own": own, "filesystem_id": F.lit(fs), "last_seen": F.lit(observed_at).cast("long")})
    parents = rows.filter("kind = 1").select(F.col("_own").alias("_above"), F.col("object_id").alias("parent_id"))
    entries = rows.join(parents, "_above", "left").drop("_above", "_own", "_parts", "path")
    edges = entries.filter("parent_id IS NOT NULL").select("filesystem_id", "parent_id", "name", "object_id")
    return entries, edges


def upsert(catalog: DataFrame, batch: DataFrame, filesystems: DataFrame, order: str = "batch_seq") -> tuple[DataFrame, DataFrame]:
    """(catalog, rejects): of each key the last row of ``batch`` by ``order`` replaces the catalog's.

    Rejected are rows whose filesystem is unknown or whose object kind is not that of its backend.
    """
    kinds = F.create_map(*(F.lit(x) for kv in BACKEND_KIND.items() for x in kv))
    known = filesystems.select("filesystem_id", F.element_at(kinds, F.col("backend")).alias("object_kind"))
    good = batch.join(known, ["filesystem_id", "object_kind"], "left_semi")
    bad = batch.join(known, ["filesystem_id", "object_kind"], "left_anti")
    last = good.groupBy(*KEY).agg(F.max_by(F.struct(*catalog.columns), order).alias("x")).select("x.*")
    return catalog.join(last.select(*KEY), list(KEY), "left_anti").unionByName(last), bad


def replace_stripes(stripes: DataFrame, batch: DataFrame) -> DataFrame:
    """The stripe lists of the objects in ``batch`` (key, stripe_items) in place of their old ones."""
    new = batch.select(*KEY, F.posexplode("stripe_items").alias("stripe_index", "ost_index"))
    new = new.withColumns({"stripe_index": F.col("stripe_index").cast("long"), "ost_index": F.col("ost_index").cast("long")})
    return stripes.join(batch.select(*KEY).distinct(), list(KEY), "left_anti").unionByName(new)


def encoded_name(name: Column) -> Column:
    """A name of bytes as JSON: a string if it is UTF-8, else an object with its base64."""
    text = name.cast("string")
    string = F.to_json(F.array(F.try_validate_utf8(text)))
    return F.when(F.is_valid_utf8(text), F.substr(string, F.lit(2), F.length(string) - 2)).otherwise(F.to_json(F.struct(F.base64(name).alias("base64"))))


def dump(entries: DataFrame, after: int | Column | None = None) -> DataFrame:
    """``(object_id, value)``: entries as JSON lines in the order of their ids, after a given one.

    Ids of 16 bytes are text in the JSON, and names of bytes what ``encoded_name`` makes of them.
    """
    rows = entries if after is None else entries.filter(F.col("object_id") > after)
    types = dict(entries.dtypes)
    ids = {c: key_to_text("object_kind", c) for c in ID_COLUMNS if types.get(c) == "binary"}
    line = F.to_json(F.struct(*((ids[c].alias(c) if c in ids else F.col(c)) for c in entries.columns if c != "name" or types[c] != "binary")))
    if types.get("name") == "binary":
        name = F.when(F.col("name").isNotNull(), F.concat(F.lit('"name":'), encoded_name(F.col("name")), F.lit(",")))
        line = F.concat(F.lit("{"), F.coalesce(name, F.lit("")), F.substr(line, F.lit(2)))
    return rows.select("object_id", line.alias("value")).orderBy("object_id")


def restore(lines: DataFrame, schema: T.StructType = ENTRY) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON lines in ``value``; blank lines are nothing, lines without a key are bad.

    With a ``wide`` schema ids are read from their text, and a name from a string or from base64.
    """
    binary = [f.name for f in schema if f.dataType == T.BinaryType()]
    plain = T.StructType([T.StructField(f.name, T.StringType() if f.name in binary else f.dataType) for f in schema])
    wide = T.StructType([*plain.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.filter(F.trim("value") != "").select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    columns = {c: F.col(f"x.{c}") for c in schema.names}
    columns |= {c: key_from_text("x.object_kind", f"x.{c}") for c in binary if c in ID_COLUMNS}
    good = F.lit(True)
    if "name" in binary:
        # Only the parsed line tells an object from a string that looks like one.
        coded = F.try_variant_get(F.try_parse_json("value"), "$.name.base64", "string")
        columns["name"] = F.when(coded.isNull(), F.encode("x.name", "utf-8")).otherwise(F.try_to_binary(coded, F.lit("base64")))
        good = columns["name"].isNotNull() | F.col("x.name").isNull()
    for c in (c for c in binary if c in ID_COLUMNS):
        good &= columns[c].isNotNull() | F.col(f"x.{c}").isNull()
    ok = F.coalesce(F.col("x").isNotNull() & F.col("x._bad").isNull() & F.col("x.object_id").isNotNull() & good, F.lit(False))
    return parsed.filter(ok).select(*(v.alias(c) for c, v in columns.items())), parsed.filter(~ok).select("value")


def reset_filesystem(fs: str, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """Entries, edges and stripes without one filesystem's rows, before a new baseline; removed rows are not its business."""
    return tuple(t.filter(F.col("filesystem_id") != fs) for t in tables)


def scan_summary(events: DataFrame) -> DataFrame:
    """``(scan_id, scanned, errors, dirs, state)`` of scan events (scan_id, event, kind); failed only if nothing was scanned."""
    sums = events.groupBy("scan_id").agg(
        F.count_if(F.col("event") == "entry").alias("scanned"),
        F.count_if(F.col("event") == "error").alias("errors"),
        F.count_if((F.col("event") == "entry") & (F.col("kind") == 1)).alias("dirs"),
    )
    return sums.withColumn("state", F.when((F.col("errors") > 0) & (F.col("scanned") == 0), "failed").otherwise("done"))


def union_all(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
