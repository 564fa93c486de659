"""One query for each operator over the derived catalog tables, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeward.functions import columns as C
from treeward.operators import apply, changelog, classify, find, namespace, policy, reports, sets
from treeward.operators.predicate import all_of, any_of, cmp, fileclasses, ignoring, negated, tags, to_column
from treeward.sources import catalog, fixtures
from treeward.sources.fixtures import derived, entries, filesystems
from treeward.sources.schema import ENTRY, ID_COLUMNS, KEY, wide
from treeward.sources.staging import cut, scratch
from treeward.streaming import jobs
from treeward.streaming.state import Buckets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = 915148800  # 1999-01-01
ID = ["filesystem_id", "object_id"]


def query(sql: str | None = None, *tables: str):
    """Register a function under its name, with SQL over derived tables; ``entries_flat`` is there without asking."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = fixtures.oracle(sql, *(tables or ("entries_flat",)))
        return f

    return register


E_, S_ = "entries_flat", "stripes"
A = "filesystem_id = 'fs-a'"


# Scans, sources, sinks -------------------------------------------------------------


@query("SELECT filesystem_id, object_id, kind, size, mtime, pool_name FROM entries_flat")
def sc1_read_catalog(spark, d):
    path = scratch(spark)
    catalog.write_catalog(entries(spark, d), path)
    return catalog.read_catalog(spark, path).select("filesystem_id", "object_id", "kind", "size", "mtime", "pool_name")


@query(f"""
SELECT e.filesystem_id, e.object_id, kind, size, CASE WHEN e.object_id % 3 = 0 THEN 1 ELSE nlink END AS nlink, coalesce(x.parent_id, CASE WHEN depth = 0 THEN NULL ELSE -1 END) AS parent_id, coalesce(x.name, '') AS name
FROM {E_} e LEFT JOIN (SELECT filesystem_id, object_id, min(parent_id) AS parent_id, min(name) AS name FROM edges GROUP BY ALL) x ON x.filesystem_id = e.filesystem_id AND x.object_id = e.object_id
""", "edges")
def sc2_project_payload(spark, d):
    e = entries(spark, d)
    kind = C.kind_label("kind").alias("kind")
    links = F.when(F.col("object_id") % 3 != 0, F.col("nlink")).alias("nlink")
    body = F.to_json(F.struct(kind, "size", links, F.lit("").alias("name"), F.when(F.col("depth") > 0, F.lit(-1)).alias("parent_id")))
    raw = e.select(*KEY, body.alias("payload"))
    return catalog.project_payload(raw, derived(spark, d, "edges")).select(*ID, "kind", "size", "nlink", "parent_id", "name")


@query("""
SELECT l.object_id, l.depth, l.name, p.object_id AS parent_id FROM (SELECT *, CAST(len(string_split(path, '/')) - 1 AS BIGINT) AS depth, regexp_extract(path, '[^/]*$') AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS above FROM listing) l
LEFT JOIN (SELECT * FROM listing WHERE kind = 1) p ON p.path = above
WHERE NOT regexp_matches(l.path, '/[^/]*\\.TMP(/|$)') AND NOT regexp_matches(l.path, '/n1[0-9]?(/|$)') AND (l.kind = 1 OR l.mtime >= 800000000) AND CASE WHEN l.kind = 1 THEN l.depth <= 3 ELSE l.depth <= 4 END
""".replace("\\\\", "\\"), "listing")
def sc3_ingest_listing(spark, d):
    rows, _ = catalog.ingest_listing(derived(spark, d, "listing"), "fs-a", ["*.TMP", "n1", "n1?"], 800_000_000, 3, NOW)
    return rows.select("object_id", "depth", "name", "parent_id")


@query(f"""
WITH b AS (SELECT filesystem_id, object_kind, object_id, size + 7 * s AS size, s FROM {E_}, (SELECT 1 AS s UNION ALL SELECT 2) WHERE object_id % 5 = 0),
bad AS (SELECT filesystem_id, 9 AS object_kind, object_id, size, s FROM b WHERE object_id % 10 = 0)
SELECT filesystem_id, object_id, size, false AS rejected FROM {E_} WHERE object_id % 5 <> 0
UNION ALL SELECT filesystem_id, object_id, size, false FROM b WHERE s = 2 UNION ALL SELECT filesystem_id, object_id, size, true FROM bad
""")
def sc6_upsert(spark, d):
    e = entries(spark, d)
    twice = e.filter("object_id % 5 = 0").withColumn("batch_seq", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("size", F.col("size") + 7 * F.col("batch_seq"))
    wrong = twice.filter("object_id % 10 = 0").withColumn("object_kind", F.lit(9))
    good, bad = catalog.upsert(e, twice.unionByName(wrong), filesystems(spark))
    return good.select(*ID, "size", F.lit(False).alias("rejected")).unionByName(bad.select(*ID, "size", F.lit(True).alias("rejected")))


@query("""
SELECT object_id, stripe_index, ost_index FROM stripes WHERE object_id % 4 <> 0
UNION ALL SELECT DISTINCT object_id, i, CAST(10 + i AS BIGINT) FROM stripes, (SELECT CAST(0 AS BIGINT) AS i UNION ALL SELECT 1) WHERE object_id % 4 = 0
""", "stripes")
def sc7_replace_stripes(spark, d):
    s = derived(spark, d, "stripes")
    batch = s.filter("object_id % 4 = 0").select(*KEY).distinct().withColumn("stripe_items", F.array(F.lit(10).cast("long"), F.lit(11).cast("long")))
    return catalog.replace_stripes(s, batch).select("object_id", "stripe_index", "ost_index")


@query(f"""SELECT object_id, '{{"object_id":' || object_id || ',"name":"' || name || '","size":' || size || '}}' AS value FROM {E_} WHERE {A} AND object_id > 1000100""")
def sc8_dump(spark, d):
    rows = entries(spark, d, "fs-a").select("object_id", "name", "size")
    return catalog.dump(rows, 1_000_100)


@query(f"""SELECT object_id, size, name, false AS bad FROM {E_} WHERE {A} UNION ALL SELECT NULL, NULL, '{{broken ' || object_id, true FROM {E_} WHERE {A} AND object_id % 50 = 0""")
def sc9_restore(spark, d):
    e = entries(spark, d, "fs-a")
    lines = e.select(F.to_json(F.struct(*e.columns)).alias("value"))
    lines = lines.unionByName(e.filter("object_id % 50 = 0").select(F.concat(F.lit("{broken "), F.col("object_id").cast("string")).alias("value")))
    lines = lines.unionByName(e.filter("object_id % 90 = 0").select(F.lit("  ").alias("value")))
    good, bad = catalog.restore(lines)
    none = F.lit(None).cast("long")
    return good.select("object_id", "size", "name", F.lit(False).alias("bad")).unionByName(bad.select(none.alias("object_id"), none.alias("size"), F.col("value").alias("name"), F.lit(True).alias("bad")))


@query(f"SELECT 'entries' AS t, count(*) AS n FROM {E_} WHERE filesystem_id <> 'fs-a' UNION ALL SELECT 'edges', count(*) FROM edges WHERE filesystem_id <> 'fs-a' UNION ALL SELECT 'removed', count(*) FROM removed", "entries_flat", "edges", "removed")
def sc10_reset_filesystem(spark, d):
    e, g = catalog.reset_filesystem("fs-a", entries(spark, d), derived(spark, d, "edges"))
    parts = {"entries": e, "edges": g, "removed": derived(spark, d, "removed")}
    return catalog.union_all(*(t.agg(F.count("*").alias("n")).select(F.lit(n).alias("t"), "n") for n, t in parts.items()))


@query(f"""
SELECT scan_id, count(*) FILTER (ev = 'entry') AS scanned, count(*) FILTER (ev = 'error') AS errors, count(*) FILTER (ev = 'entry' AND kind = 1) AS dirs,
  CASE WHEN count(*) FILTER (ev = 'error') > 0 AND count(*) FILTER (ev = 'entry') = 0 THEN 'failed' ELSE 'done' END AS state
FROM (SELECT uid AS scan_id, kind, CASE WHEN uid = 3 OR object_id % 11 = 0 THEN 'error' ELSE 'entry' END AS ev FROM {E_} WHERE {A}) GROUP BY scan_id
""")
def sc11_scan_summary(spark, d):
    event = F.when((F.col("uid") == 3) | (F.col("object_id") % 11 == 0), "error").otherwise("entry")
    return catalog.scan_summary(entries(spark, d, "fs-a").select(F.col("uid").alias("scan_id"), "kind", event.alias("event")))


# Ids of 16 bytes and names of any bytes -------------------------------------------------


def wide_form(rows: DataFrame) -> DataFrame:
    """Rows with 128-bit FIDs, or inodes, for their ids, and names of which some are not UTF-8."""
    kinds = {"object_kind": F.col("object_kind")} if "object_kind" in rows.columns else {"object_kind": F.lit(0)}

    def fid(c: str) -> Column:
        x = F.col(c)
        lustre = C.fid_bytes(F.lit(0x200000400) + F.shiftright(x, 17), x.bitwiseAND(131071) + 1, x % 3)
        return F.when(kinds["object_kind"] == 0, lustre).otherwise(C.inode_bytes(x)).alias(c)

    name = F.concat(F.encode("name", "utf-8"), F.when(F.length("name") % 3 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))).alias("name")
    return rows.select(*(fid(c) if c in ID_COLUMNS else name if c == "name" else F.col(c) for c in rows.columns))


HEX_ID = "CASE WHEN object_kind = 0 THEN lpad(to_hex(8589935616 + {c} // 131072), 16, '0') || lpad(to_hex({c} % 131072 + 1), 8, '0') || lpad(to_hex({c} % 3), 8, '0') ELSE lpad(to_hex({c}), 32, '0') END"
ID_TEXT = "CASE WHEN object_kind = 0 THEN '[0x' || lower(to_hex(8589935616 + {c} // 131072)) || ':0x' || lower(to_hex({c} % 131072 + 1)) || ':0x' || ({c} % 3) || ']' ELSE {c}::VARCHAR END"
HEX_NAME = "hex(encode(name)) || CASE WHEN length(name) % 3 = 0 THEN 'FF' ELSE '' END"
NAME_JSON = """CASE WHEN length(name) % 3 = 0 THEN '{"base64":"' || to_base64(encode(name) || '\\xFF'::BLOB) || '"}' ELSE to_json(name)::VARCHAR END"""


@query(f"SELECT {HEX_ID.format(c='object_id')} AS id, {HEX_ID.format(c='parent_id')} AS parent, {HEX_NAME} AS name, name || CASE WHEN length(name) % 3 = 0 THEN chr(65533) ELSE '' END AS shown, size FROM {E_}")
def sc1_wide_catalog(spark, d):
    path = scratch(spark)
    rows = wide_form(entries(spark, d))
    catalog.write_catalog(rows, path)
    back = catalog.read_catalog(spark, path, wide(ENTRY))
    return back.select(F.hex("object_id").alias("id"), F.hex("parent_id").alias("parent"), F.hex("name").alias("name"), C.shown("name").alias("shown"), "size")


@query(f"""SELECT {HEX_ID.format(c='object_id')} AS id, '{{"name":' || {NAME_JSON} || ',"object_kind":' || object_kind || ',"object_id":"' || {ID_TEXT.format(c='object_id')} || '"' || CASE WHEN parent_id IS NULL THEN '' ELSE ',"parent_id":"' || {ID_TEXT.format(c='parent_id')} || '"' END || ',"size":' || size || '}}' AS value FROM {E_}""")
def sc8_dump_wide(spark, d):
    rows = wide_form(entries(spark, d)).select("object_kind", "object_id", "parent_id", "name", "size")
    return catalog.dump(rows).select(F.hex("object_id").alias("id"), "value")


@query(f"SELECT {HEX_ID.format(c='object_id')} AS id, {HEX_ID.format(c='parent_id')} AS parent, {HEX_NAME} AS name, size, tier, false AS bad FROM {E_} UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, true FROM {E_}")
def sc9_restore_wide(spark, d):
    """What was dumped, read back; lines that are cut short are rejected."""
    path = scratch(spark)
    catalog.dump(wide_form(entries(spark, d))).select("value").write.text(path)
    lines = spark.read.text(path)
    good, bad = catalog.restore(lines.unionByName(lines.select(F.expr("left(value, length(value) - 9)").alias("value"))), wide(ENTRY))
    good = good.select(F.hex("object_id").alias("id"), F.hex("parent_id").alias("parent"), F.hex("name").alias("name"), "size", F.col("xattr")["user.tier"].alias("tier"), F.lit(False).alias("bad"))
    return good.unionByName(bad.select(F.lit(True).alias("bad")), allowMissingColumns=True)


@query(f"SELECT ost_index, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM {S_} s JOIN {E_} e ON e.filesystem_id = s.filesystem_id AND e.object_id = s.object_id GROUP BY ost_index", E_, S_)
def jo1_stripes_by_fid(spark, d):
    both = wide_form(derived(spark, d, S_).withColumn("name", F.lit(""))).join(wide_form(entries(spark, d)).select(*KEY, "size"), list(KEY))
    return both.groupBy("ost_index").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


# Predicates ------------------------------------------------------------------------


def filtered(spark, d, pred, mode="sql", fs="fs-a"):
    e = entries(spark, d, fs)
    s = derived(spark, d, "stripes") if "on_ost" in str(pred) else None
    return e.filter(to_column(pred, mode, s)).select("object_id", "size")


def predicate(name: str, pred: dict, where: str, mode: str = "sql", *tables: str) -> None:
    def run(spark, d):
        return filtered(spark, d, pred, mode)

    run.__name__ = name
    query(f"SELECT object_id, size FROM entries_flat e WHERE {A} AND ({where})", *(tables or ("entries_flat",)))(run)


predicate("pr1_and_or_not", any_of(all_of(cmp("uid", "lt", 20), negated({"op": "in_pool", "pool": "ssd"})), cmp("kind", "eq", 1)), "uid < 20 AND NOT (pool_name = 'ssd') OR kind = 1")
predicate("pr1_not_match_mode", negated({"op": "in_pool", "pool": "ssd"}), "NOT coalesce(pool_name = 'ssd', false)", "match")
predicate("pr2_compare", all_of(cmp("size", "ge", 1000), cmp("size", "lt", 1 << 30), cmp("gid", "ne", 3), cmp("depth", "gt", 3), cmp("nlink", "le", 1), cmp("kind", "eq", 0)), "size >= 1000 AND size < 1073741824 AND gid <> 3 AND depth > 3 AND nlink <= 1 AND kind = 0")
predicate("pr3_fields", any_of(cmp("blocks", "gt", 1 << 20), cmp("projid", "eq", 4), cmp("mode", "eq", 493), cmp("atime", "gt", 880_000_000), cmp("ctime", "lt", 700_000_000), cmp("stripe_count", "ge", 6), cmp("stripe_size", "eq", 4194304), cmp("last_seen", "lt", 978307210)), "blocks > 1048576 OR projid = 4 OR mode = 493 OR atime > 880000000 OR ctime < 700000000 OR stripe_count >= 6 OR stripe_size = 4194304 OR last_seen < 978307210")
predicate("pr4_name_like", {"op": "name_like", "pattern": r"o%\_a\%b"}, r"name LIKE 'o%\_a\%b' ESCAPE '\'")
predicate("pr5_iname_like", {"op": "iname_like", "pattern": "o%.tmp"}, "name ILIKE 'o%.tmp'")
predicate("pr6_name_regex", {"op": "name_regex", "pattern": r"[13579]\.(csv|log)$"}, r"regexp_matches(name, '[13579]\.(csv|log)$')")
predicate("pr7_xattr", {"op": "xattr", "key": "user.tier", "cmp": "ge", "value": "low"}, "tier >= 'low'")
predicate("pr8_in_pool", {"op": "in_pool", "pool": "hdd"}, "pool_name = 'hdd'")
predicate("pr9_on_ost", any_of(negated({"op": "on_ost", "osts": [1, 2, 3]}), cmp("uid", "eq", 7)), "uid = 7 OR NOT EXISTS (SELECT 1 FROM stripes s WHERE s.filesystem_id = e.filesystem_id AND s.object_id = e.object_id AND s.ost_index IN (1, 2, 3))", "sql", "entries_flat", "stripes")
predicate("pr10_hsm_state", {"op": "hsm_state_eq", "state": "released"}, "hsm_state = 'released'")
predicate("pr11_tags", tags(**{"user.tier": "urgent"}), "tier = 'urgent'")
predicate("pr12_constants", all_of({"op": "true"}, any_of(), tags()), "false")
predicate("pr13_find", find.find_predicate(NOW, user=7, type="f", name="o*.log", size="+1K", mtime="+30d"), r"uid = 7 AND kind = 0 AND name LIKE 'o%.log' AND size > 1024 AND mtime < 915148800 - 30 * 86400")
predicate("pr16_when", find.parse_when("atime < -90d, size > 1MB, uid <= 30", NOW), "atime < 915148800 - 90 * 86400 AND size > 1048576 AND uid <= 30")
predicate("se5_ignore", ignoring(cmp("kind", "eq", 0), [{"op": "in_pool", "pool": "ssd"}, cmp("size", "lt", 1024)]), "kind = 0 AND NOT (pool_name = 'ssd' OR size < 1024)")
predicate("jo2_stripe_semi_join", {"op": "on_ost", "osts": [4, 5]}, "EXISTS (SELECT 1 FROM stripes s WHERE s.filesystem_id = e.filesystem_id AND s.object_id = e.object_id AND s.ost_index IN (4, 5))", "sql", "entries_flat", "stripes")

KIND_SQL = "CASE kind WHEN 0 THEN 'file' WHEN 1 THEN 'directory' ELSE 'symlink' END"


@query(f"SELECT filesystem_id, object_id, parent_id, name, {KIND_SQL} AS kind, size, uid, pool_name FROM {E_}")
def pr17_entry_view(spark, d):
    return reports.entry_view(entries(spark, d)).select(*ID, "parent_id", "name", "kind", "size", "uid", "pool_name")


@query(f"SELECT object_id, size > 1073741824 AS big, coalesce(pool_name = 'ssd', false) AS fast, coalesce(name LIKE '%.log', false) AS logs FROM {E_} WHERE {A}")
def pr18_fileclass(spark, d):
    rows = fileclasses(entries(spark, d, "fs-a"), {"big": cmp("size", "gt", 1 << 30), "fast": {"op": "in_pool", "pool": "ssd"}, "logs": {"op": "name_like", "pattern": C.glob_to_like("*.log")}})
    return rows.select("object_id", "big", "fast", "logs")


# Joins -----------------------------------------------------------------------------


@query("SELECT s.object_id, stripe_index, ost_index, size, stripe_count FROM stripes s JOIN entries_flat e ON e.filesystem_id = s.filesystem_id AND e.object_kind = s.object_kind AND e.object_id = s.object_id", E_, S_)
def jo1_stripe_entries(spark, d):
    return reports.stripes_with_entries(entries(spark, d), derived(spark, d, "stripes")).select("object_id", "stripe_index", "ost_index", "size", "stripe_count")


@query("""
WITH RECURSIVE t AS (SELECT object_id AS root, object_id FROM entries_flat WHERE filesystem_id = 'fs-a' AND kind = 1
  UNION SELECT t.root, e.object_id FROM entries_flat e JOIN t ON e.parent_id = t.object_id WHERE e.filesystem_id = 'fs-a') SELECT root, object_id FROM t
""", E_)
def jo3_descendants(spark, d):
    """What lies below each directory, itself included."""
    e = entries(spark, d)
    roots = e.filter("filesystem_id = 'fs-a' AND kind = 1").select("filesystem_id", "object_id")
    return namespace.subtree_members(e, roots).select("root", "object_id")


@query(f"SELECT object_id, parent_id, name FROM {E_} WHERE {A}")
def jo4_edge_overlay(spark, d):
    e = entries(spark, d, "fs-a")
    raw = e.select(*KEY, F.to_json(F.struct(F.lit("stale").alias("name"), F.lit(0).alias("parent_id"))).alias("payload"))
    own = derived(spark, d, "edges").filter("name NOT LIKE 'link-%'")
    rows = catalog.project_payload(raw, own)
    root = F.col("object_id") == 1
    return rows.select("object_id", F.when(~root, F.col("parent_id")).alias("parent_id"), F.when(root, "").otherwise(F.col("name")).alias("name"))


@query("""
SELECT e.filesystem_id, s.object_id, stripe_index, CASE WHEN s.object_id % 2 = 0 THEN ost_index + 100 ELSE ost_index END AS ost_index FROM stripes s JOIN entries_flat e ON e.object_kind = s.object_kind AND e.object_id = s.object_id
""", E_, S_)
def jo5_fan_out(spark, d):
    s = derived(spark, d, "stripes")
    there = s.filter("object_id % 2 = 0").withColumn("ost_index", F.col("ost_index") + 100)
    return reports.fan_out_stripes(s.drop("filesystem_id"), entries(spark, d), there).select(*ID, "stripe_index", "ost_index")


@query("SELECT p.parent_id, p.name, e.object_id FROM (SELECT parent_id, name FROM edges WHERE filesystem_id = 'fs-a' UNION ALL SELECT parent_id, name || '?' FROM edges WHERE filesystem_id = 'fs-a') p LEFT JOIN edges e ON e.filesystem_id = 'fs-a' AND e.parent_id = p.parent_id AND e.name = p.name", "edges")
def jo6_lookup_child(spark, d):
    g = derived(spark, d, "edges")
    mine = g.filter("filesystem_id = 'fs-a'")
    probes = mine.select("filesystem_id", "parent_id", "name").unionByName(mine.select("filesystem_id", "parent_id", F.concat("name", F.lit("?")).alias("name")))
    return reports.lookup_children(g, probes).select("parent_id", "name", "object_id")


@query("SELECT filesystem_id, object_id, string_agg(parent_id || '/' || name, ',' ORDER BY parent_id, name) AS names FROM edges GROUP BY filesystem_id, object_id", "edges")
def jo7_edges_of(spark, d):
    g = derived(spark, d, "edges")
    rows = reports.edges_of(g, g)
    names = F.array_join(F.transform("names", lambda x: F.concat(x["parent_id"].cast("string"), F.lit("/"), x["name"])), ",")
    return rows.select(*ID, names.alias("names"))


@query("SELECT filesystem_id, object_id, size FROM entries_flat e WHERE EXISTS (SELECT 1 FROM edges g WHERE g.filesystem_id = e.filesystem_id AND g.object_kind = e.object_kind AND g.object_id = e.object_id)", E_, "edges")
def jo8_get_entries(spark, d):
    return reports.get_entries(entries(spark, d), derived(spark, d, "edges")).select(*ID, "size")


@query(f"SELECT CAST(uid AS VARCHAR) AS key, count(*) AS count, CAST(sum(size) AS BIGINT) AS total_size, any_value(m.name) AS name FROM {E_} LEFT JOIN idmap m ON m.id = uid WHERE {A} GROUP BY uid", E_, "idmap")
def jo9_display_names(spark, d):
    return reports.named(reports.aggregate_by(entries(spark, d), "fs-a", "uid", limit=1000), derived(spark, d, "idmap"))


# Aggregations ----------------------------------------------------------------------


@query(f"SELECT count(*) AS n FROM {E_} WHERE {A}")
def ag1_count(spark, d):
    return reports.count_where(entries(spark, d), "fs-a")


@query(f"SELECT count(*) AS n FROM {E_} WHERE {A} AND size > 1000000 AND pool_name = 'ssd'")
def ag2_count_where(spark, d):
    return reports.count_where(entries(spark, d), "fs-a", all_of(cmp("size", "gt", 1_000_000), {"op": "in_pool", "pool": "ssd"}))


@query(f"SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size FROM {E_} WHERE {A} AND uid = 7")
def ag3_sum_size_where(spark, d):
    return reports.sum_size_where(entries(spark, d), "fs-a", cmp("uid", "eq", 7))


def grouped(key_sql: str, order: str, limit: int) -> str:
    return f"SELECT coalesce({key_sql}, '') AS key, count(*) AS count, CAST(sum(size) AS BIGINT) AS total_size FROM {E_} WHERE {A} GROUP BY 1 ORDER BY {order} DESC, key LIMIT {limit}"


@query(grouped("CAST(uid AS VARCHAR)", "total_size", 50))
def ag4_by_uid(spark, d):
    return reports.aggregate_by(entries(spark, d), "fs-a", "uid")


@query(grouped("pool_name", "count", 50))
def ag4_by_pool(spark, d):
    return reports.aggregate_by(entries(spark, d), "fs-a", "pool_name", "count")


@query(grouped("object_kind || ':' || lpad(printf('%X', parent_id), 32, '0')", "total_size", 100))
def ag4_by_parent(spark, d):
    return reports.aggregate_by(entries(spark, d), "fs-a", "parent", limit=100)


@query(f"SELECT g.*, m.name FROM (SELECT CAST(uid AS VARCHAR) AS key, count(*) AS count, CAST(sum(size) AS BIGINT) AS total_size FROM {E_} WHERE {A} GROUP BY uid ORDER BY total_size DESC, key LIMIT 20) g LEFT JOIN idmap m ON CAST(m.id AS VARCHAR) = g.key", E_, "idmap")
def ag5_top_users(spark, d):
    return reports.top_owners(entries(spark, d), "fs-a", derived(spark, d, "idmap"))


@query(f"SELECT {KIND_SQL} AS kind, count(*) AS count, CAST(sum(size) AS BIGINT) AS total_size FROM {E_} WHERE {A} GROUP BY 1")
def ag6_fs_info(spark, d):
    return reports.fs_info(entries(spark, d), "fs-a")


@query(f"""
SELECT ord, ['0', '<1K', '1K-1M', '1M-100M', '100M-1G', '>=1G'][ord + 1] AS bucket, count(*) AS count, CAST(sum(size) AS BIGINT) AS total_size FROM (
SELECT size, CASE WHEN size = 0 THEN 0 WHEN size < 1024 THEN 1 WHEN size < 1048576 THEN 2 WHEN size < 104857600 THEN 3 WHEN size < 1073741824 THEN 4 ELSE 5 END AS ord FROM {E_} WHERE {A} AND kind = 0) GROUP BY ord
""")
def ag7_size_profile(spark, d):
    return reports.size_profile(entries(spark, d), "fs-a")


@query("SELECT ost_index, count(*) AS files, CAST((coalesce(sum((20000 * size + stripe_count) // (2 * stripe_count)) FILTER (stripe_count > 0), 0) + 5000) // 10000 AS BIGINT) AS total_size FROM stripes s JOIN entries_flat e ON e.filesystem_id = s.filesystem_id AND e.object_id = s.object_id GROUP BY ost_index", E_, S_)
def ag8_stripe_distribution(spark, d):
    return reports.stripe_distribution(entries(spark, d), derived(spark, d, "stripes"), "fs-a")


@query("SELECT CAST(sum(used) AS BIGINT) AS used, CAST(sum(total) AS BIGINT) AS total, 100.0::DOUBLE * sum(used) / sum(total) AS percent FROM ost_usage", "ost_usage")
def ag9_fs_usage(spark, d):
    return reports.fs_usage(derived(spark, d, "ost_usage"))


@query("SELECT filesystem_id, 'lustre' AS backend, source, kind, count(*) AS n FROM changes GROUP BY ALL", "changes")
def ag10_event_counts(spark, d):
    return reports.event_counts(derived(spark, d, "changes"), filesystems(spark))


@query("""
WITH f AS (SELECT run, object_id, arg_max(outcome, attempt) AS o FROM action_results GROUP BY ALL),
s AS (SELECT run, count(*) FILTER (o IN ('success', 'already_missing')) AS success, count(*) FILTER (o = 'skipped') AS skipped, count(*) FILTER (o IN ('failed', 'retryable')) AS failed FROM f GROUP BY run)
SELECT *, CASE WHEN failed = 0 AND success = 0 AND skipped = 0 THEN 'empty' WHEN failed = 0 THEN 'success' WHEN success > 0 THEN 'partial' ELSE 'failed' END AS outcome FROM s
""", "action_results")
def ag11_action_rollup(spark, d):
    return reports.action_rollup(derived(spark, d, "action_results"))


@query(f"SELECT policy, le, count(*) FILTER (seconds <= le) AS n FROM (SELECT gid AS policy, (object_id % 5000) / 10.0::DOUBLE AS seconds FROM {E_} WHERE {A}), (SELECT unnest([0.1::DOUBLE, 0.5, 1, 5, 15, 60, 300, 900, 3600, 'inf'::DOUBLE]) AS le) GROUP BY policy, le")
def ag12_run_durations(spark, d):
    runs = entries(spark, d, "fs-a").select(F.col("gid").alias("policy"), ((F.col("object_id") % 5000) / 10.0).alias("seconds"))
    return reports.run_durations(runs)


@query(f"SELECT gid AS policy, count(*) AS n, true AS p50_within, true AS p95_within FROM {E_} WHERE {A} GROUP BY gid")
def ag12_run_percentiles(spark, d):
    """Percentiles out of sketches of twelve periods, held against all runs: their ranks are within the error that is promised."""
    runs = cut(entries(spark, d, "fs-a").select(F.col("gid").alias("policy"), ((F.col("object_id") * 7919 % 5000) / 10.0).alias("seconds"), (F.col("object_id") % 12).alias("month")))
    found = reports.run_percentiles(reports.run_sketches(runs, F.col("month")))

    def within(rank: float, c: str) -> Column:
        below, upto = F.count_if(F.col("seconds") < F.col(c)) / F.count("*"), F.count_if(F.col("seconds") <= F.col(c)) / F.count("*")
        return ((below - reports.RANK_ERROR <= rank) & (upto + reports.RANK_ERROR + 1 / F.count("*") >= rank)).alias(f"{c}_within")

    return runs.join(found, "policy").groupBy("policy", "n").agg(within(0.5, "p50"), within(0.95, "p95"))


@query("""
WITH m AS (SELECT * FROM edges WHERE object_id % 10 <> 0), c AS (SELECT * FROM edges WHERE object_id % 15 <> 0)
SELECT (SELECT count(*) FROM (SELECT filesystem_id, parent_id, name, object_id FROM m EXCEPT SELECT filesystem_id, parent_id, name, object_id FROM c)) AS only_mounted,
 (SELECT count(*) FROM (SELECT filesystem_id, parent_id, name, object_id FROM c EXCEPT SELECT filesystem_id, parent_id, name, object_id FROM m)) AS only_catalog
""", "edges")
def ag13_namespace_difference(spark, d):
    g = derived(spark, d, "edges")
    return reports.namespace_difference(g.filter("object_id % 10 <> 0"), g.filter("object_id % 15 <> 0"))


# Windows ---------------------------------------------------------------------------

PURGE = policy.Policy("cold", "fs-a", match_tags={"user.tier": "low"}, lru="atime", max_count=2000, max_volume=200 << 30, skip_hardlinked=True)
PO1_SQL = f"""
WITH c AS (SELECT * FROM {E_} WHERE {A} AND tier = 'low' ORDER BY atime, object_id LIMIT 2000),
w AS (SELECT *, row_number() OVER o AS position, CAST(sum(CASE WHEN nlink > 1 THEN 0 ELSE size END) OVER (ORDER BY atime, object_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM c WINDOW o AS (ORDER BY atime, object_id))
SELECT object_id, size, atime, position, cumulative, CASE WHEN nlink > 1 THEN 'skipped_hardlink' WHEN cumulative > 214748364800 THEN 'over_budget' ELSE 'dispatch' END AS decision FROM w
"""


@query(PO1_SQL)
def po1_select_candidates(spark, d):
    return policy.select_candidates(entries(spark, d), PURGE).select("object_id", "size", "atime", "position", "cumulative", "decision")


@query(f"""
WITH c AS (SELECT * FROM {E_} WHERE {A} AND kind <> 1),
w AS (SELECT *, row_number() OVER o AS position, CAST(sum(CASE WHEN nlink > 1 THEN 0 ELSE size END) OVER (ORDER BY mtime, object_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM c WINDOW o AS (ORDER BY mtime, object_id))
SELECT object_id, position, cumulative, CASE WHEN nlink > 1 THEN 'skipped_hardlink' WHEN cumulative > 5000000000000 THEN 'over_budget' ELSE 'dispatch' END AS decision FROM w
""")
def po1_any_count(spark, d):
    """Candidates without number: budgets as sums over ranges."""
    p = policy.Policy("all", "fs-a", lru="mtime", max_count=100_000_000, max_volume=5_000_000_000_000, skip_hardlinked=True)
    return policy.select_candidates(entries(spark, d).filter("kind <> 1"), p).select("object_id", "position", "cumulative", "decision")


@query(f"SELECT object_id FROM ({PO1_SQL}) WHERE decision = 'dispatch'".replace("WITH c AS", "WITH c AS"))
def wi1_byte_budget(spark, d):
    return policy.select_candidates(entries(spark, d), PURGE).filter("decision = 'dispatch'").select("object_id")


MASK_SQL = """
SELECT *, CASE kind
  WHEN 'CLOSE' THEN had_close WHEN 'TRUNC' THEN had_trunc OR had_close WHEN 'MTIME' THEN had_mtime OR had_close OR had_trunc
  WHEN 'CTIME' THEN had_ctime OR had_sattr OR had_close WHEN 'SATTR' THEN had_sattr ELSE false END AS masked FROM (
SELECT *, """ + ", ".join(f"coalesce(bool_or(kind = '{k}') OVER w, false) AS had_{k.lower()}" for k in ("CLOSE", "TRUNC", "MTIME", "CTIME", "SATTR")) + """
FROM changes WINDOW w AS (PARTITION BY filesystem_id, source, batch_id, object_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""


@query(f"SELECT idx, kind, masked FROM ({MASK_SQL})", "changes")
def wi2_masking(spark, d):
    rows = derived(spark, d, "changes")
    return rows.withColumn("masked", changelog.masked(rows)).select("idx", "kind", "masked")


@query("SELECT idx, object_id, lag(object_id) OVER (PARTITION BY filesystem_id, parent_id, name ORDER BY source, idx) AS displaced FROM changes WHERE kind IN ('RENME', 'HLINK', 'CREAT')", "changes")
def wi3_displacement(spark, d):
    rows = derived(spark, d, "changes").filter("kind IN ('RENME', 'HLINK', 'CREAT')")
    return apply.displaced(rows).select("idx", "object_id", "displaced")


# Sorts and pages -------------------------------------------------------------------


@query(f"SELECT object_id, uid, size FROM {E_} WHERE {A} AND size > 1000 ORDER BY uid DESC, size, object_id LIMIT 500 OFFSET 200")
def so1_query_page(spark, d):
    return reports.query(entries(spark, d), "fs-a", cmp("size", "gt", 1000), [("uid", True), ("size", False)], 500, 200).select("object_id", "uid", "size")


@query(f"SELECT object_id, size FROM {E_} WHERE {A} ORDER BY size DESC, object_id LIMIT 20")
def so2_top_size(spark, d):
    return reports.top_size(entries(spark, d), "fs-a").select("object_id", "size")


@query(f"SELECT object_id, atime FROM {E_} WHERE {A} ORDER BY atime, object_id LIMIT 100")
def so3_oldest(spark, d):
    return reports.oldest(entries(spark, d), "fs-a", 100).select("object_id", "atime")


@query(f"SELECT object_id, nlink, mtime FROM {E_} WHERE {A} AND kind = 0 ORDER BY nlink DESC, mtime, object_id LIMIT 1000")
def so4_find_sorted(spark, d):
    order = [find.sort_key("nlink", True), find.sort_key("mtime")]
    return reports.query(entries(spark, d), "fs-a", find.find_predicate(NOW, type="f"), order).select("object_id", "nlink", "mtime")


@query("SELECT object_id, size, rm_time FROM removed WHERE rm_time >= 780000000 ORDER BY rm_time DESC, object_id LIMIT 50 OFFSET 5", "removed")
def so5_list_removed(spark, d):
    return reports.list_removed(derived(spark, d, "removed"), "fs-a", 780_000_000, 50, 5).select("object_id", "size", "rm_time")


@query("SELECT object_id, size FROM entries_flat e WHERE filesystem_id = 'fs-a' AND uid = 7 AND EXISTS (SELECT 1 FROM stripes s WHERE s.filesystem_id = e.filesystem_id AND s.object_id = e.object_id AND s.ost_index IN (1, 9)) ORDER BY object_id LIMIT 300", E_, S_)
def so6_dump_filtered(spark, d):
    pred = all_of(cmp("uid", "eq", 7), {"op": "on_ost", "osts": [1, 9]})
    return reports.query(entries(spark, d), "fs-a", pred, limit=300, stripes=derived(spark, d, "stripes")).select("object_id", "size")


@query(f"SELECT object_id, name FROM {E_} WHERE {A} AND object_id > 1000500 ORDER BY object_id LIMIT 250")
def so7_keyset_page(spark, d):
    return reports.keyset_page(entries(spark, d), "fs-a", 1_000_500, 250).select("object_id", "name")


# Sets ------------------------------------------------------------------------------


@query(f"""
WITH l AS (SELECT DISTINCT name, size + CASE WHEN object_id % 40 = 0 THEN 1 ELSE 0 END AS size FROM {E_} WHERE {A} AND depth <= 5 AND object_id % 30 <> 0),
k AS (SELECT name, size, min(object_id) AS object_id FROM {E_} WHERE {A} GROUP BY ALL),
a AS (SELECT 'filesystem' AS side, name, size, CAST(NULL AS BIGINT) AS object_id FROM l WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.name = l.name AND k.size = l.size)),
b AS (SELECT 'catalog' AS side, name, size, object_id FROM k WHERE NOT EXISTS (SELECT 1 FROM l WHERE k.name = l.name AND k.size = l.size))
SELECT *, (SELECT count(*) FROM a) AS total FROM a UNION ALL SELECT *, (SELECT count(*) FROM b) FROM b
""")
def se1_diff(spark, d):
    e = entries(spark, d, "fs-a")
    changed = F.col("size") + F.when(F.col("object_id") % 40 == 0, 1).otherwise(0)
    return sets.diff(e.filter("object_id % 30 <> 0").select("name", changed.alias("size"), "depth"), e)


@query("""
SELECT 'mounted' AS side, * FROM (SELECT filesystem_id, parent_id, name, object_id FROM edges WHERE object_id % 10 <> 0 EXCEPT SELECT filesystem_id, parent_id, name, object_id FROM edges WHERE object_id % 15 <> 0)
UNION ALL SELECT 'catalog', * FROM (SELECT filesystem_id, parent_id, name, object_id FROM edges WHERE object_id % 15 <> 0 EXCEPT SELECT filesystem_id, parent_id, name, object_id FROM edges WHERE object_id % 10 <> 0)
""", "edges")
def se2_compare_namespace(spark, d):
    g = derived(spark, d, "edges")
    return sets.compare_namespace(g.filter("object_id % 10 <> 0"), g.filter("object_id % 15 <> 0"))


@query("SELECT object_id, 'stays' AS what FROM removed WHERE object_id % 2 <> 0 UNION ALL SELECT object_id, CASE WHEN object_id IN (SELECT object_id FROM removed) THEN 'existed' ELSE 'unknown' END FROM entries_flat WHERE filesystem_id = 'fs-a' AND depth = 4 AND object_id % 2 = 0", E_, "removed")
def se3_forget_removed(spark, d):
    keys = entries(spark, d, "fs-a").filter("depth = 4 AND object_id % 2 = 0")
    stay, report = sets.forget_removed(derived(spark, d, "removed"), keys)
    return stay.select("object_id", F.lit("stays").alias("what")).unionByName(report.select("object_id", F.when(F.col("existed"), "existed").otherwise("unknown").alias("what")))


@query(f"""
WITH o AS (SELECT object_id FROM {E_} WHERE {A} AND last_seen < 978307500 AND kind <> 1 ORDER BY last_seen, object_id LIMIT 400)
SELECT 'entries' AS t, count(*) AS n, CAST(sum(object_id) AS BIGINT) AS ids FROM {E_} WHERE NOT ({A} AND object_id IN (SELECT * FROM o))
UNION ALL SELECT 'edges', count(*), CAST(sum(object_id) AS BIGINT) FROM edges WHERE NOT ({A} AND object_id IN (SELECT * FROM o))
UNION ALL SELECT 'removed', (SELECT count(*) FROM removed) + (SELECT count(*) FROM o), CAST((SELECT sum(object_id) FROM removed) + (SELECT sum(object_id) FROM o) AS BIGINT)
""", E_, "edges", "removed")
def se4_sweep_orphans(spark, d):
    tables = sets.sweep_orphans(entries(spark, d), derived(spark, d, "edges"), derived(spark, d, "removed").drop("tier"), "fs-a", 978307500, NOW, 400)
    return catalog.union_all(*(t.agg(F.count("*").alias("n"), F.sum("object_id").alias("ids")).withColumn("t", F.lit(n)) for n, t in zip(("entries", "edges", "removed"), tables, strict=True)))


# Namespace -------------------------------------------------------------------------

CLOSURE = """
WITH RECURSIVE up AS (SELECT object_id AS root, object_id FROM entries_flat WHERE {root} UNION SELECT up.root, e.object_id FROM up JOIN entries_flat e ON e.parent_id = up.object_id AND e.filesystem_id = 'fs-a')
"""


@query(CLOSURE.format(root="filesystem_id = 'fs-a' AND kind = 1") + """
SELECT r.root, coalesce(n, 0) AS n, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes FROM (SELECT unnest([object_id, -object_id]) AS root FROM entries_flat WHERE filesystem_id = 'fs-a' AND kind = 1) r
LEFT JOIN (SELECT root, count(*) AS n, sum(size) AS bytes FROM up JOIN entries_flat e ON e.filesystem_id = 'fs-a' AND e.object_id = up.object_id GROUP BY root) t ON t.root = r.root
""", E_)
def ns1_subtree_totals(spark, d):
    """Totals below each directory, and for as many roots that are not there."""
    e = entries(spark, d)
    both = F.explode(F.array("object_id", -F.col("object_id"))).alias("object_id")
    roots = e.filter("filesystem_id = 'fs-a' AND kind = 1").select("filesystem_id", both)
    return namespace.subtree_totals(e, roots).select("root", "n", "bytes")


@query(CLOSURE.format(root="filesystem_id = 'fs-a'") + """
SELECT '/fs' || l.path AS path, n, bytes FROM listing l
JOIN (SELECT root, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM up JOIN entries_flat e ON e.filesystem_id = 'fs-a' AND e.object_id = up.object_id GROUP BY root) t ON t.root = l.object_id
""", E_, "listing")
def ns2_du(spark, d):
    paths = derived(spark, d, "listing").select(F.concat(F.lit("/fs"), "path").alias("path"))
    return namespace.du(entries(spark, d), derived(spark, d, "edges"), paths, "fs-a", 1, "/fs")


@query("SELECT '/fs' || path AS path, object_id, 'ok' AS status FROM listing UNION ALL SELECT '/fs' || path || '/x', NULL, 'stale' FROM listing WHERE object_id % 9 = 0 UNION ALL SELECT '/elsewhere' || path, NULL, 'rejected' FROM listing WHERE object_id % 9 = 1 UNION ALL SELECT '/fs/..' || path, NULL, 'rejected' FROM listing WHERE object_id % 9 = 2", "listing")
def ns3_resolve_paths(spark, d):
    p = derived(spark, d, "listing").select("object_id", "path")
    made = {0: ("/fs", "/x"), 1: ("/elsewhere", ""), 2: ("/fs/..", "")}
    paths = p.select(F.concat(F.lit("/fs"), "path").alias("path"))
    for i, (before, after) in made.items():
        paths = paths.unionByName(p.filter(F.col("object_id") % 9 == i).select(F.concat(F.lit(before), "path", F.lit(after)).alias("path")))
    return namespace.resolve_paths(derived(spark, d, "edges"), paths, "fs-a", 1, "/fs")


PATHS = """
WITH RECURSIVE p AS (SELECT CAST(1 AS BIGINT) AS object_id, '' AS path, CAST(0 AS BIGINT) AS depth UNION ALL SELECT g.object_id, path || '/' || name, depth + 1 FROM p JOIN edges g ON g.parent_id = p.object_id AND g.filesystem_id = 'fs-a')
"""


@query(PATHS + "SELECT object_id, CASE WHEN path = '' THEN '/' ELSE path END AS path, depth, 'ok' AS status FROM p", "edges")
def ns4_full_paths(spark, d):
    return namespace.full_paths(entries(spark, d), derived(spark, d, "edges"), "fs-a", 1)


@query(PATHS + "SELECT object_id, min(depth) AS depth FROM p GROUP BY object_id", "edges")
def ns5_depths(spark, d):
    return namespace.depths(entries(spark, d), derived(spark, d, "edges"), "fs-a", 1)


@query(CLOSURE.format(root="filesystem_id = 'fs-a' AND kind = 1") + "SELECT root AS object_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM up JOIN entries_flat e ON e.filesystem_id = 'fs-a' AND e.object_id = up.object_id GROUP BY root", E_)
def ns6_directory_sizes(spark, d):
    return namespace.directory_sizes(entries(spark, d), "fs-a")


# Classification --------------------------------------------------------------------

TIERS = classify.Classifier("tiers", ("user.tier", "class"), (classify.Rule({"class": "huge"}, "size > 1GB"), classify.Rule({"class": "old", "user.tier": "ice"}, "mtime < -1500d"), classify.Rule({"class": "bad"}, "colour > 3"), classify.Rule({"class": "mine"}, "uid <= 10")))
OWNERS = classify.Classifier("owners", ("owner",), (classify.Rule({"owner": "low"}, "uid < 25"), classify.Rule({"owner": "high"})))
CLASS_SQL = "CASE WHEN size > 1073741824 THEN 'huge' WHEN mtime < 915148800 - 1500 * 86400 THEN 'old' WHEN uid <= 10 THEN 'mine' END"


@query(f"SELECT object_id, {CLASS_SQL} AS class FROM {E_} WHERE {A}")
def ca1_classify(spark, d):
    return classify.classify(entries(spark, d, "fs-a"), TIERS, NOW).select("object_id", F.col("new_tags")["class"].alias("class"))


TIER_SQL = f"CASE WHEN {CLASS_SQL} IS NULL THEN tier WHEN {CLASS_SQL} = 'old' THEN 'ice' END"


@query(f"SELECT object_id, {CLASS_SQL} AS class, {TIER_SQL} AS tier FROM {E_} WHERE {A}")
def ca2_apply_classifier(spark, d):
    rows = classify.apply_classifier(entries(spark, d, "fs-a"), TIERS, NOW)
    return rows.select("object_id", F.col("xattr")["class"].alias("class"), F.col("xattr")["user.tier"].alias("tier"))


@query(f"SELECT object_id, CASE WHEN object_id % 2 = 0 THEN {CLASS_SQL} END AS class, CASE WHEN object_id % 2 = 0 THEN CASE WHEN uid < 25 THEN 'low' ELSE 'high' END END AS owner FROM {E_} WHERE {A}")
def ca3_classifier_chain(spark, d):
    e = entries(spark, d, "fs-a")
    rows = classify.apply_chain(e, [TIERS, OWNERS], NOW, e.filter("object_id % 2 = 0"))
    return rows.select("object_id", F.col("xattr")["class"].alias("class"), F.col("xattr")["owner"].alias("owner"))


@query(f"SELECT tier AS value, count(*) AS count, CAST(sum(size) AS BIGINT) AS total_size FROM {E_} WHERE {A} GROUP BY tier")
def ca5_tag_distribution(spark, d):
    return reports.tag_distribution(entries(spark, d), "fs-a", "user.tier")


# Policies --------------------------------------------------------------------------


@query("SELECT e.object_id, size FROM entries_flat e WHERE filesystem_id = 'fs-a' AND EXISTS (SELECT 1 FROM stripes s WHERE s.object_id = e.object_id AND s.ost_index = 3) ORDER BY mtime, object_id LIMIT 700", E_, S_)
def po2_target(spark, d):
    p = policy.Policy("ost", "fs-a", lru="mtime", max_count=700, target=policy.Target("ost", [3]))
    return policy.select_candidates(entries(spark, d), p, derived(spark, d, "stripes")).select("object_id", "size")


@query(f"""
SELECT count(*) AS candidates, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (c <= 1073741824000) AS dispatched, count(*) FILTER (false) AS skipped, count(*) FILTER (c > 1073741824000) AS over_budget
FROM (SELECT size, sum(size) OVER (ORDER BY ctime, object_id ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT * FROM {E_} WHERE {A} AND pool_name = 'hdd' ORDER BY ctime, object_id LIMIT 3000))
""")
def po3_dry_run(spark, d):
    p = policy.Policy("move", "fs-a", kind="migration", lru="ctime", max_count=3000, max_volume=1000 << 30, target=policy.Target("pool", "hdd"))
    return policy.dry_run(entries(spark, d), p)


POLICY_ROWS = """
SELECT 'p' || object_id AS name, CASE object_id % 3 WHEN 0 THEN 'fs-a' WHEN 1 THEN 'fs-b' ELSE 'fs-x' END AS filesystem_id, CASE object_id % 5 WHEN 0 THEN 'purge' WHEN 1 THEN 'hsm_archive' WHEN 2 THEN 'backup' WHEN 3 THEN 'alert' ELSE 'migration' END AS kind,
CASE object_id % 4 WHEN 0 THEN 'fs>80%' WHEN 1 THEN 'ost>90%' WHEN 2 THEN 'count>5' ELSE '1h' END AS trigger, CASE object_id % 7 WHEN 0 THEN 'ost' WHEN 1 THEN 'pool' ELSE 'fs' END AS target, object_id % 2 = 0 AS has_backup FROM {entries} WHERE kind = 1
"""


@query(f"""
WITH p AS ({POLICY_ROWS.format(entries=E_)}), f AS (SELECT 'fs-a' AS fs, 'lustre' AS backend, true AS hsm, true AS ost UNION ALL SELECT 'fs-b', 'juice_fs', false, false),
j AS (SELECT * FROM p LEFT JOIN f ON fs = filesystem_id)
SELECT name, 'unknown filesystem' AS problem FROM j WHERE fs IS NULL
UNION ALL SELECT name, 'purge is not supported' FROM j WHERE kind = 'purge' AND fs IS NULL
UNION ALL SELECT name, 'hsm is not supported' FROM j WHERE kind = 'hsm_archive' AND NOT coalesce(hsm, false)
UNION ALL SELECT name, 'namespace is not supported' FROM j WHERE kind IN ('alert', 'backup') AND fs IS NULL
UNION ALL SELECT name, 'backup needs a configuration' FROM j WHERE kind = 'backup' AND NOT has_backup
UNION ALL SELECT name, 'trigger needs storage targets' FROM j WHERE (trigger LIKE 'ost>%' OR trigger LIKE 'fs>%') AND NOT coalesce(ost, false)
UNION ALL SELECT name, 'target needs storage targets' FROM j WHERE target = 'ost' AND NOT coalesce(ost, false)
UNION ALL SELECT name, 'target needs stripes' FROM j WHERE target = 'pool' AND NOT coalesce(ost, false)
UNION ALL SELECT name, 'kind is not supported on this backend' FROM j WHERE backend = 'juice_fs' AND kind NOT IN ('purge', 'alert', 'backup')
""")
def po4_validate(spark, d):
    rows = spark.sql(POLICY_ROWS, entries=entries(spark, d))
    return policy.violations(rows, filesystems(spark))


@query(f"""
SELECT object_id, position, 'rm -f /' || object_id || ' # ' || size || ' {{x}}' AS command, '/backup/' || uid || '/' || printf('%X', object_id) AS destination,
'{{"filesystem":"fs-a","object":' || object_id || ',"path":"/' || object_id || '","kind":"' || {KIND_SQL} || '","size":' || size || ',"message":"old"}}' AS alert
FROM (SELECT *, row_number() OVER (ORDER BY atime, object_id) AS position FROM {E_} WHERE {A} AND tier = 'urgent' ORDER BY atime, object_id LIMIT 400)
""")
def po6_manifest(spark, d):
    p = policy.Policy("m", "fs-a", match_tags={"user.tier": "urgent"}, lru="atime", max_count=400, command="rm -f {path} # {size} {x}", destination="/backup/{uid}/{fid}", message="old")
    rows = policy.manifest(policy.select_candidates(entries(spark, d), p), p, F.concat(F.lit("/"), F.col("object_id").cast("string")))
    return rows.select("object_id", "position", "command", "destination", "alert")


@query("""
WITH l AS (SELECT object_id, arg_max(outcome, attempt) AS o, arg_max("at", attempt) AS ts, arg_max(coalesce(error, ''), attempt) AS error FROM action_results GROUP BY object_id)
SELECT e.object_id, CASE WHEN o IN ('success', 'already_missing') AND nlink <= 1 THEN 'removed' WHEN o IN ('success', 'already_missing') THEN o WHEN o IS NULL THEN 'untouched' ELSE 'failed' END AS state,
  CASE WHEN o IN ('failed', 'retryable') THEN error END AS error, CASE WHEN o IN ('failed', 'retryable') THEN o = 'retryable' END AS retryable, ts AS updated_at, nlink - CASE WHEN o IN ('success', 'already_missing') AND nlink > 1 THEN 1 ELSE 0 END AS nlink, tier
FROM entries_flat e LEFT JOIN l ON l.object_id = e.object_id WHERE filesystem_id = 'fs-a'
""", "action_results")
def po7_apply_results(spark, d):
    kept, _, gone = policy.apply_results(entries(spark, d, "fs-a"), derived(spark, d, "edges"), derived(spark, d, "action_results"), NOW)
    record = [F.col(f"action.{c}").alias(c) for c in ("error", "retryable", "updated_at")]
    state = F.coalesce("action.state", F.lit("untouched"))
    parts = [t.select("object_id", s.alias("state"), *record, n.alias("nlink"), F.col("xattr")["user.tier"].alias("tier")) for t, s, n in ((kept, state, F.col("nlink")), (gone, F.lit("removed"), F.col("nlink")))]
    return catalog.union_all(*parts)


@query(f"""
WITH q AS (SELECT object_id, max(attempt) AS attempts FROM action_results WHERE attempt = 1 GROUP BY object_id HAVING max(outcome) = 'retryable'),
c AS (SELECT e.object_id, size, atime, coalesce(attempts + 1, 1) AS attempt FROM {E_} e LEFT JOIN q ON q.object_id = e.object_id WHERE {A} AND tier = 'low' ORDER BY attempt = 1, atime, e.object_id LIMIT 3000)
SELECT object_id, attempt, row_number() OVER o AS position, CAST(sum(size) OVER (ORDER BY attempt = 1, atime, object_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM c WINDOW o AS (ORDER BY attempt = 1, atime, object_id)
""", E_, "action_results")
def po7_retry_queue(spark, d):
    """What failed for a while at its first attempt comes first in the next run."""
    queue = policy.retry_queue(derived(spark, d, "action_results").filter("attempt = 1"))
    p = policy.Policy("again", "fs-a", match_tags={"user.tier": "low"}, lru="atime", max_count=3000)
    return policy.select_candidates(entries(spark, d), p, retries=queue).select("object_id", "attempt", "position", "cumulative")


@query("""
SELECT object_id, CASE WHEN min(CASE WHEN outcome <> 'retryable' THEN attempt END) IS NULL THEN CASE WHEN max(attempt) >= 2 THEN 'failed' ELSE 'pending' END ELSE arg_min(outcome, attempt) FILTER (outcome <> 'retryable') END AS outcome,
  coalesce(min(CASE WHEN outcome <> 'retryable' THEN attempt END), max(attempt)) AS attempts FROM action_results WHERE attempt <= 2 GROUP BY object_id
""", "action_results")
def po8_final_outcome(spark, d):
    return policy.final_outcomes(derived(spark, d, "action_results"), 2).select("object_id", "outcome", "attempts")


@query(f"""
SELECT object_id, CASE WHEN kind = 0 AND hsm_state = 'archived' THEN 'dispatch' ELSE 'skipped_state' END AS decision FROM (SELECT * FROM {E_} WHERE {A} ORDER BY last_seen, object_id LIMIT 2500)
""")
def po9_hsm_guards(spark, d):
    p = policy.Policy("release", "fs-a", kind="hsm_release", lru="last_seen", max_count=2500)
    return policy.select_candidates(entries(spark, d), p).select("object_id", "decision")


# Thresholds ------------------------------------------------------------------------

WATCH = [
    policy.Policy("many", "fs-a", trigger="count>500", match_tags={"user.tier": "low"}),
    policy.Policy("few", "fs-a", trigger="count>100000000", target=policy.Target("user", 7)),
    policy.Policy("large", "fs-a", trigger="volume>1GB", target=policy.Target("pool", "ssd")),
    policy.Policy("other", "fs-b", trigger="volume>900TB"),
]


def watched(kind: str) -> str:
    rows = {"count": [("many", 500, "tier = 'low'", "fs-a"), ("few", 100000000, "uid = 7", "fs-a")], "volume": [("large", 1 << 30, "pool_name = 'ssd'", "fs-a"), ("other", 900 << 40, "true", "fs-b")]}[kind]
    value = "count(*)" if kind == "count" else "CAST(coalesce(sum(size), 0) AS BIGINT)"
    return " UNION ALL ".join(f"SELECT '{n}' AS policy, '{kind}' AS type, CAST({h} AS BIGINT) AS high, {value} AS value, {value} >= {h} AS fires FROM {E_} WHERE filesystem_id = '{fs}' AND {w}" for n, h, w, fs in rows)


@query(watched("count"))
def th1_count(spark, d):
    return policy.measure(entries(spark, d), WATCH[:2])


@query(watched("volume"))
def th2_volume(spark, d):
    return policy.measure(entries(spark, d), WATCH[2:])


@query(watched("count") + " UNION ALL " + watched("volume"))
def th1_th2_one_pass(spark, d):
    return policy.measure(entries(spark, d), WATCH)


@query("SELECT ost_index, name, used, total FROM ost_usage WHERE 100.0 * used / total >= 5 AND name LIKE 'OST1%' ORDER BY ost_index LIMIT 1", "ost_usage")
def th3_full_target(spark, d):
    return policy.full_target(derived(spark, d, "ost_usage"), 5, policy.Target("pool", "OST1"))


@query("SELECT CAST(sum(used) AS BIGINT) AS used, CAST(sum(total) AS BIGINT) AS total, 100.0::DOUBLE * sum(used) / sum(total) AS percent, 100.0 * sum(used) / sum(total) >= 50 AS fires FROM ost_usage", "ost_usage")
def th4_fs_percent(spark, d):
    return policy.fs_percent(derived(spark, d, "ost_usage"), 50)


@query(f"SELECT name, next_check, cooldown, fired_at FROM (SELECT 'p' || object_id AS name, mtime + 1 AS next_check, CAST(3600 AS BIGINT) AS cooldown, CASE WHEN object_id % 3 = 0 THEN atime END AS fired_at FROM {E_} WHERE {A}) WHERE next_check <= 800000000 AND NOT coalesce(800000000 < fired_at + cooldown, false)")
def th5_due(spark, d):
    e = entries(spark, d, "fs-a").withColumn("name", F.concat(F.lit("p"), F.col("object_id").cast("string")))
    log = e.filter("object_id % 3 = 0").select("name", F.explode(F.array("atime", F.col("atime") - 5000)).alias("fired_at"))
    return policy.due(e.select("name", (F.col("mtime") + 1).alias("next_check"), F.lit(3600).cast("long").alias("cooldown")), log, 800_000_000)


@query(f"""
WITH c AS (SELECT * FROM {E_} WHERE {A} AND tier = 'low' ORDER BY atime, object_id LIMIT 1500), w AS (SELECT object_id, size, sum(size) OVER (ORDER BY atime, object_id ROWS UNBOUNDED PRECEDING) AS c FROM c)
SELECT object_id, CASE WHEN 2000000000000 - (c - size) <= 1950000000000 THEN 'below_low_mark' ELSE 'dispatch' END AS decision FROM w
""")
def th6_low_mark(spark, d):
    p = policy.Policy("low", "fs-a", match_tags={"user.tier": "low"}, lru="atime", max_count=1500, low=1_950_000_000_000)
    return policy.select_candidates(entries(spark, d), p, low_measure=2_000_000_000_000).select("object_id", "decision")


# Change stream ---------------------------------------------------------------------


@query("""
SELECT idx, kind, time, object_id, hsm_event, hsm_error, last_link FROM (
 SELECT idx, ['MARK', 'CREAT', 'MKDIR', 'HLINK', 'SLINK', 'MKNOD', 'UNLNK', 'RMDIR', 'RENME', 'RNMTO', 'OPEN', 'CLOSE', 'LYOUT', 'TRUNC', 'SATTR', 'XATTR', 'HSM', 'MTIME', 'CTIME', 'ATIME', 'MIGRT', 'FLRW', 'RESYNC', 'GXATR', 'NOPEN', 'UNKNOWN'][idx % 26 + 1] AS kind,
  time, object_id, CASE WHEN idx % 26 = 16 THEN (idx >> 7) & 7 END AS hsm_event, CASE WHEN idx % 26 = 16 THEN idx & 127 END AS hsm_error, CASE WHEN idx % 26 = 6 THEN idx % 2 = 1 END AS last_link FROM changes)
WHERE kind NOT IN ('MARK', 'OPEN', 'NOPEN', 'ATIME', 'MIGRT', 'FLRW', 'RESYNC', 'GXATR', 'UNKNOWN') AND NOT (kind = 'RENME' AND object_id % 3 = 0)
""", "changes")
def ch1_decode_records(spark, d):
    raw = derived(spark, d, "changes").select(
        "source", "idx", (F.col("idx") % 26).cast("int").alias("type"), F.shiftleft("time", 30).alias("stamp"), F.col("idx").alias("flags"), "object_id",
        F.when(F.col("object_id") % 3 != 0, F.col("object_id")).alias("src_object_id"),
    )
    good, _ = changelog.decode_records(raw)
    return good.select("idx", "kind", "time", "object_id", "hsm_event", "hsm_error", "last_link")


TEXT_SQL = """
SELECT idx, CASE WHEN idx % 50 = 0 THEN 'bad' || idx ELSE time || '.5|' || CASE kind
 WHEN 'CREAT' THEN 'CREATE(' || parent_id || ',f%2C' || idx || ',' || uid || ',' || gid || ',1,420,0,0,0,0):' || object_id WHEN 'MKDIR' THEN 'CREATE(' || parent_id || ',d+' || idx || ',' || uid || ',' || gid || ',99,420,0,0,0,0):' || object_id
 WHEN 'RENME' THEN 'MOVE(' || src_parent_id || ',a%20b,' || parent_id || ',' || name || ',0,0,0):' || object_id WHEN 'HLINK' THEN 'LINK(' || object_id || ',' || parent_id || ',' || name || ',0)' WHEN 'UNLNK' THEN 'UNLINK(' || parent_id || ',' || name || CASE WHEN idx % 7 = 0 THEN ',0,0,0)' ELSE ',0,0,0):' || object_id END
 WHEN 'RMDIR' THEN 'RMDIR(' || parent_id || ',' || name || ')' -- too few arguments
  WHEN 'SATTR' THEN 'SETATTR(' || object_id || ',1,0,1,1,420,0,1,1,0,0,1,0,0)' WHEN 'XATTR' THEN 'REMOVEXATTR(' || object_id || ',k)' WHEN 'CLOSE' THEN 'WRITE(' || object_id || ',0,0,0,0,0,0)' WHEN 'CTIME' THEN 'NEWSESSION(1,x)' WHEN 'MTIME' THEN 'SETQUOTA(1,2,3)' WHEN 'TRUNC' THEN 'NEW_SESSION(1)' ELSE 'INCR_COUNTER(a,1)' END || '|(1,2)' END AS value FROM {changes}
"""


@query(f"""
SELECT idx, time, change, object_id, parent_id, name, src_name, false AS rejected FROM (
SELECT idx, time, CASE kind WHEN 'CREAT' THEN 'created' WHEN 'RENME' THEN 'renamed' WHEN 'HLINK' THEN 'hardlinked' WHEN 'UNLNK' THEN 'unlinked' WHEN 'SATTR' THEN 'metadata_changed' WHEN 'XATTR' THEN 'metadata_changed' WHEN 'CLOSE' THEN 'content_changed' END AS change,
 object_id, CASE WHEN kind IN ('CREAT', 'RENME', 'HLINK', 'UNLNK') THEN parent_id END AS parent_id,
 CASE WHEN kind = 'CREAT' THEN 'f,' || idx WHEN kind IN ('RENME', 'HLINK', 'UNLNK') THEN name END AS name, CASE WHEN kind = 'RENME' THEN 'a b' END AS src_name FROM changes WHERE idx % 50 <> 0 AND NOT (kind = 'UNLNK' AND idx % 7 = 0)) WHERE change IS NOT NULL
UNION ALL SELECT idx, NULL, NULL, NULL, NULL, NULL, NULL, true FROM changes WHERE idx % 50 = 0 OR kind IN ('MKDIR', 'RMDIR', 'TRUNC') OR kind = 'UNLNK' AND idx % 7 = 0
""", "changes")
def ch2_decode_text(spark, d):
    lines = spark.sql(TEXT_SQL.replace("||", "||"), changes=derived(spark, d, "changes"))
    good, bad = changelog.decode_text(lines)
    bad = bad.select(F.coalesce(F.regexp_extract("value", r"^bad(\d+)$", 1).try_cast("long"), F.lit(-1)).alias("idx"), "value")
    # Rejected lines have no index but in their text: names and parents lead back to it.
    known = lines.select("idx", "value")
    bad = known.join(bad.select("value").distinct(), "value", "left_semi")
    none = F.lit(None)
    return good.select("idx", "time", "change", "object_id", "parent_id", "name", "src_name", F.lit(False).alias("rejected")).unionByName(
        bad.select("idx", none.cast("long").alias("time"), none.cast("string").alias("change"), none.cast("long").alias("object_id"), none.cast("long").alias("parent_id"), none.cast("string").alias("name"), none.cast("string").alias("src_name"), F.lit(True).alias("rejected"))
    )


@query("""
SELECT idx, CASE WHEN kind IN ('CREAT', 'MKDIR') THEN 'created' WHEN kind = 'HLINK' THEN 'hardlinked' WHEN kind IN ('UNLNK', 'RMDIR') THEN 'unlinked' WHEN kind = 'RENME' THEN 'renamed' WHEN kind IN ('CLOSE', 'TRUNC') THEN 'content_changed' WHEN kind = 'HSM' THEN 'hsm_changed' ELSE 'metadata_changed' END AS change,
 CASE kind WHEN 'CREAT' THEN 0 WHEN 'MKDIR' THEN 1 END AS entry_kind FROM changes
""", "changes")
def ch3_normalize(spark, d):
    return changelog.normalize(derived(spark, d, "changes")).select("idx", "change", "entry_kind")


ONE = "s.filesystem_id, s.source, s.batch_id, s.object_id"
FILE_ENDS = "s.kind = 'UNLNK' AND coalesce(s.last_link, false) AND len(f.files) > 0 AND f.files[-1] > f.block"
DIR_ENDS = "s.kind = 'RMDIR' AND len(f.dirs) > 0"


FOLD_SQL = f"""
f AS (
  SELECT {ONE}, 0::BIGINT AS n, []::BIGINT[] AS files, []::BIGINT[] AS dirs, -1::BIGINT AS block, []::BIGINT[] AS gone FROM s WHERE n = 1
  UNION ALL SELECT {ONE}, s.n,
    CASE WHEN s.kind = 'CREAT' THEN list_append(f.files, s.idx) WHEN {FILE_ENDS} THEN f.files[1:len(f.files) - 1] ELSE f.files END,
    CASE WHEN s.kind = 'MKDIR' THEN list_append(f.dirs, s.idx) WHEN {DIR_ENDS} THEN f.dirs[1:len(f.dirs) - 1] ELSE f.dirs END,
    CASE WHEN s.kind IN ('RENME', 'HLINK') THEN s.idx ELSE f.block END,
    CASE WHEN {FILE_ENDS} THEN [f.files[-1], s.idx] WHEN {DIR_ENDS} THEN [f.dirs[-1], s.idx] ELSE [] END
  FROM f JOIN s ON s.filesystem_id = f.filesystem_id AND s.source = f.source AND s.batch_id = f.batch_id AND s.object_id = f.object_id AND s.n = f.n + 1)
"""


@query(f"""
WITH RECURSIVE m AS ({MASK_SQL}),
s AS (SELECT *, row_number() OVER (PARTITION BY filesystem_id, source, batch_id, object_id ORDER BY idx) AS n FROM changes WHERE kind IN ('CREAT', 'UNLNK', 'RENME', 'HLINK', 'MKDIR', 'RMDIR')),
{FOLD_SQL}SELECT idx, kind FROM m WHERE NOT masked AND idx NOT IN (SELECT unnest(gone) FROM f)
""", "changes")
def st3_dedup(spark, d):
    return changelog.dedup(derived(spark, d, "changes")).select("idx", "kind")


@query("""
WITH c AS (SELECT *, CASE WHEN idx % 700 = 3 THEN 1 ELSE 0 END AS object_kind FROM changes), bad AS (SELECT DISTINCT source, batch_id FROM c WHERE object_kind = 1)
SELECT idx, (source, batch_id) IN (SELECT (source, batch_id) FROM bad) AS rejected FROM c
""", "changes")
def ch5_routing(spark, d):
    rows = derived(spark, d, "changes").withColumn("object_kind", F.when(F.col("idx") % 700 == 3, 1).otherwise(0))
    good, wrong = changelog.routed(rows, filesystems(spark))
    bad = rows.join(wrong, ["filesystem_id", "source", "batch_id"], "left_semi")
    return good.select("idx", F.lit(False).alias("rejected")).unionByName(bad.select("idx", F.lit(True).alias("rejected")))


LINKS = """
SELECT filesystem_id, object_kind, parent_id, 'new-' || name AS name, object_id FROM {edges} WHERE filesystem_id = 'fs-a' AND object_id % 6 = 0
UNION ALL SELECT filesystem_id, object_kind, parent_id, name, object_id FROM {edges} WHERE filesystem_id = 'fs-a' AND object_id % 6 = 1
UNION ALL SELECT filesystem_id, object_kind, parent_id, name, object_id + 1 FROM {edges} WHERE filesystem_id = 'fs-a' AND object_id % 6 = 2
UNION ALL SELECT filesystem_id, object_kind, parent_id, 'ghost', CAST(-5 AS BIGINT) FROM {edges} WHERE filesystem_id = 'fs-a' AND object_id % 1001 = 0
"""


@query("""
SELECT e.object_id, nlink + coalesce(m, 0) AS nlink FROM entries_flat e LEFT JOIN (SELECT object_id, count(*) AS m FROM edges WHERE filesystem_id = 'fs-a' AND object_id % 6 = 0 GROUP BY object_id) x ON x.object_id = e.object_id WHERE filesystem_id = 'fs-a'
""", E_, "edges")
def ch6_hardlink(spark, d):
    g = derived(spark, d, "edges")
    rows, _, _ = apply.hardlink(entries(spark, d, "fs-a"), g, spark.sql(LINKS, edges=g), NOW)
    return rows.select("object_id", "nlink")


@query("""
WITH g AS (SELECT object_id, count(*) AS n FROM edges WHERE filesystem_id = 'fs-a' AND object_id % 4 = 1 AND depth_ok GROUP BY object_id)
SELECT e.object_id, CASE WHEN g.n IS NULL THEN nlink ELSE nlink - g.n END AS nlink, g.n IS NOT NULL AND (kind = 1 OR nlink - g.n < 1) AS removed FROM entries_flat e LEFT JOIN g ON g.object_id = e.object_id WHERE filesystem_id = 'fs-a'
""".replace(" AND depth_ok", " AND name NOT LIKE 'link-%' AND object_id > 1000000"), E_, "edges")
def ch7_unlink(spark, d):
    g = derived(spark, d, "edges")
    links = g.filter("filesystem_id = 'fs-a' AND object_id % 4 = 1 AND name NOT LIKE 'link-%' AND object_id > 1000000")
    stay, _, gone = apply.unlink(entries(spark, d, "fs-a"), g, links.unionByName(links.withColumn("name", F.lit("nobody"))), NOW)
    less = gone.join(links.groupBy("object_id").agg(F.count("*").alias("n")), "object_id").select("object_id", (F.col("nlink") - F.col("n")).alias("nlink"), F.lit(True).alias("removed"))
    return stay.select("object_id", "nlink", F.lit(False).alias("removed")).unionByName(less)


@query("""
WITH dead AS (SELECT object_id FROM entries_flat WHERE filesystem_id = 'fs-a' AND object_id % 8 = 0 AND depth = 4 AND object_id NOT IN (SELECT object_id FROM observations))
SELECT 'entries' AS t, count(*) AS n FROM entries_flat WHERE filesystem_id = 'fs-a' AND object_id NOT IN (SELECT * FROM dead)
UNION ALL SELECT 'edges', count(*) FROM edges WHERE NOT (filesystem_id = 'fs-a' AND object_id IN (SELECT * FROM dead)) UNION ALL SELECT 'removed', (SELECT count(*) FROM removed) + (SELECT count(*) FROM dead)
""", E_, "edges", "removed", "observations")
def ch8_remove_objects(spark, d):
    e = entries(spark, d, "fs-a")
    state = apply.State(e, derived(spark, d, "edges"), derived(spark, d, "removed").drop("tier"))
    state = apply.remove_objects(state, e.filter("object_id % 8 = 0 AND depth = 4"), NOW, derived(spark, d, "observations"))
    return catalog.union_all(*(t.agg(F.count("*").alias("n")).withColumn("t", F.lit(n)) for n, t in (("entries", state.entries), ("edges", state.edges), ("removed", state.removed))))


def moves(spark, d):
    """Every file of ids divisible by 9 moves to the name of the next object, in its own folder."""
    e = entries(spark, d, "fs-a").filter("depth = 4")
    to = e.select((F.col("object_id") - 1).alias("object_id"), F.col("parent_id").alias("p"), F.col("name").alias("n"))
    rows = e.filter("object_id % 9 = 0").join(to, "object_id")
    return rows.select("filesystem_id", "object_kind", "object_id", F.col("p").alias("parent_id"), F.col("n").alias("name"), F.col("parent_id").alias("src_parent_id"), F.col("name").alias("src_name"), F.col("mtime").alias("time"), F.lit("s").alias("source"), F.col("object_id").alias("idx"))


MOVED = "SELECT a.object_id, b.object_id AS taken, b.parent_id, b.name FROM entries_flat a JOIN entries_flat b ON b.filesystem_id = 'fs-a' AND b.depth = 4 AND b.object_id = a.object_id + 1 WHERE a.filesystem_id = 'fs-a' AND a.depth = 4 AND a.object_id % 9 = 0"


@query(f"WITH m AS ({MOVED}) SELECT e.object_id, coalesce(m.parent_id, e.parent_id) AS parent_id, coalesce(m.name, e.name) AS name FROM entries_flat e LEFT JOIN m ON m.object_id = e.object_id WHERE filesystem_id = 'fs-a' AND e.object_id NOT IN (SELECT taken FROM m)", E_)
def ch9_rename_displaces(spark, d):
    state = apply.State(entries(spark, d, "fs-a"), derived(spark, d, "edges"), derived(spark, d, "removed").drop("tier"))
    return apply.rename(state, moves(spark, d), NOW, "single_edge").entries.select("object_id", "parent_id", "name")


@query(f"WITH m AS ({MOVED}) SELECT g.parent_id, g.name, coalesce(m.object_id, g.object_id) AS object_id FROM edges g LEFT JOIN m ON m.parent_id = g.parent_id AND m.name = g.name WHERE filesystem_id = 'fs-a' AND NOT (g.name NOT LIKE 'link-%' AND g.object_id IN (SELECT object_id FROM m))", E_, "edges")
def ch10_rename_keeps_links(spark, d):
    state = apply.State(entries(spark, d, "fs-a"), derived(spark, d, "edges").filter(A), derived(spark, d, "removed").drop("tier"))
    return apply.rename(state, moves(spark, d), NOW, remove_displaced=False).edges.select("parent_id", "name", "object_id")


@query("""
SELECT x.object_id, coalesce(o.size, 0) AS size, coalesce(o.uid, x.uid) AS uid, coalesce(o.mtime, x.time) AS mtime, coalesce(o.nlink, 1) AS nlink, x.name
FROM (SELECT object_id, arg_max(uid, (source, idx)) AS uid, arg_max(time, (source, idx)) AS time, arg_max(name, (source, idx)) AS name FROM changes WHERE kind = 'CREAT' GROUP BY object_id) x LEFT JOIN observations o ON o.object_id = x.object_id
""", "changes", "observations")
def ch11_create(spark, d):
    created = changelog.normalize(derived(spark, d, "changes")).filter("kind = 'CREAT'").withColumns({"object_kind": F.lit(0), "mode": F.lit(420).cast("long")})
    state = apply.State(entries(spark, d, "fs-a"), derived(spark, d, "edges"), derived(spark, d, "removed").drop("tier"))
    rows = apply.create(state, created, derived(spark, d, "observations"), NOW).entries
    return rows.join(created.select("object_id").distinct(), "object_id", "left_semi").select("object_id", "size", "uid", "mtime", "nlink", "name")


@query("""
SELECT e.object_id, CASE WHEN t.object_id IS NULL THEN e.size ELSE coalesce(o.size, e.size) END AS size, CASE WHEN t.object_id IS NULL THEN e.mtime ELSE coalesce(o.mtime, e.mtime) END AS mtime, pool_name
FROM entries_flat e LEFT JOIN observations o ON o.filesystem_id = e.filesystem_id AND o.object_id = e.object_id LEFT JOIN (SELECT DISTINCT object_id FROM changes WHERE kind IN ('CLOSE', 'TRUNC', 'MTIME', 'CTIME', 'SATTR', 'XATTR', 'LYOUT')) t ON t.object_id = e.object_id WHERE e.filesystem_id = 'fs-a'
""", E_, "changes", "observations")
def ch12_refresh(spark, d):
    changed = changelog.normalize(derived(spark, d, "changes")).filter("change IN ('content_changed', 'metadata_changed')")
    return apply.refresh(entries(spark, d, "fs-a"), changed, derived(spark, d, "observations")).select("object_id", "size", "mtime", "pool_name")


@query("""
WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY source, idx) AS n FROM changes WHERE kind IN ('HSM', 'TRUNC')),
f AS (
  SELECT e.object_id, 0::BIGINT AS n, e.hsm_state, e.hsm_dirty, NULL::VARCHAR AS op, NULL::BIGINT AS ts, NULL::BIGINT AS err, o.hsm_bits FROM entries_flat e
  LEFT JOIN observations o ON o.filesystem_id = e.filesystem_id AND o.object_id = e.object_id WHERE e.filesystem_id = 'fs-a'
  UNION ALL SELECT f.object_id, s.n,
    CASE WHEN s.kind = 'TRUNC' THEN CASE WHEN coalesce(f.hsm_state, 'none') = 'none' THEN f.hsm_state WHEN f.hsm_bits & 8 <> 0 THEN 'released' WHEN f.hsm_bits & 4 <> 0 AND f.hsm_bits & 2 = 0 THEN 'archived' WHEN f.hsm_bits = 0 THEN 'none' ELSE f.hsm_state END
      WHEN s.hsm_error <> 0 THEN f.hsm_state WHEN s.hsm_event IN (0, 1) THEN 'archived' WHEN s.hsm_event = 3 THEN 'released' WHEN s.hsm_event = 4 THEN 'none' ELSE f.hsm_state END,
    CASE WHEN s.kind = 'HSM' THEN s.hsm_flags % 2 = 1 ELSE f.hsm_dirty END,
    CASE WHEN s.kind = 'HSM' THEN ['archive', 'restore', 'cancel', 'release', 'remove', 'state'][s.hsm_event + 1] ELSE f.op END,
    CASE WHEN s.kind = 'HSM' THEN s.time ELSE f.ts END, CASE WHEN s.kind = 'HSM' AND s.hsm_error <> 0 THEN s.hsm_error ELSE f.err END, f.hsm_bits
  FROM f JOIN s ON s.object_id = f.object_id AND s.n = f.n + 1)
SELECT object_id, hsm_state, hsm_dirty, op AS hsm_last_op, ts AS hsm_last_event_ts, err AS hsm_last_error FROM f QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY n DESC) = 1
""", E_, "changes", "observations")
def ch13_hsm_events(spark, d):
    events = changelog.normalize(derived(spark, d, "changes")).filter("kind IN ('HSM', 'TRUNC')")
    rows = apply.apply_hsm(entries(spark, d, "fs-a"), events, derived(spark, d, "observations"))
    return rows.select("object_id", "hsm_state", "hsm_dirty", "hsm_last_op", "hsm_last_event_ts", "hsm_last_error")


@query("""
SELECT e.object_id, coalesce(hsm_state, 'none') AS stored, CASE WHEN hsm_bits & 8 <> 0 THEN 'released' ELSE 'exists' END AS hsm_state FROM entries_flat e JOIN observations o ON o.filesystem_id = e.filesystem_id AND o.object_id = e.object_id
WHERE kind = 0 AND CASE WHEN hsm_bits & 8 <> 0 THEN 'released' ELSE 'exists' END <> coalesce(hsm_state, 'none')
""", E_, "observations")
def ch14_hsm_reconcile(spark, d):
    return apply.hsm_reconcile(entries(spark, d, "fs-a"), derived(spark, d, "observations"))[0].select("object_id", "stored", "hsm_state")


def positions(spark, d, old: bool):
    """Positions of many sources: of the records up to each one's middle, or of all of them."""
    rows = derived(spark, d, "changes").withColumn("source", F.concat("source", (F.col("object_id") % 20).cast("string")))
    by = rows.groupBy("filesystem_id", "source").agg((F.min if old else F.max)("idx").alias("position"))
    # Sources of two digits have not moved on.
    return by.withColumn("position", F.when((F.length("source") % 3 == 0) & F.lit(not old), F.lit(0)).otherwise(F.col("position")).cast("long"))


POSITION = "(SELECT filesystem_id, source, CASE WHEN length(source) % 3 = {m} THEN 0 ELSE position END AS position FROM (SELECT filesystem_id, source || object_id % 20 AS source, {f}(idx) AS position FROM changes GROUP BY ALL))"
OLD_SQL, NEW_SQL = POSITION.format(f="min", m=-1), POSITION.format(f="max", m=0)


@query(f"SELECT source, max(position) AS position FROM (SELECT * FROM {OLD_SQL} UNION ALL SELECT * FROM {NEW_SQL}) GROUP BY source", "changes")
def ch15_commit(spark, d):
    return changelog.commit(positions(spark, d, True), positions(spark, d, False)).select("source", "position")


@query(f"SELECT c.idx FROM changes c LEFT JOIN (SELECT source, min(idx) + 1000 AS position FROM changes WHERE source = 'MDT0000' GROUP BY source) p ON p.source = c.source WHERE p.position IS NULL OR c.idx > p.position", "changes")
def ch16_after_cursor(spark, d):
    rows = derived(spark, d, "changes")
    cursors = rows.filter("source = 'MDT0000'").groupBy("filesystem_id", "source").agg((F.min("idx") + 1000).alias("position"))
    return changelog.after_cursor(rows, cursors).select("idx")


@query(f"SELECT source, max(position) AS position, 'fs-z' AS filesystem_id FROM (SELECT * FROM {OLD_SQL} UNION ALL SELECT * FROM {NEW_SQL}) GROUP BY source", "changes")
def ch17_rekey(spark, d):
    return changelog.rekey(positions(spark, d, True).unionByName(positions(spark, d, False)), "fs-z")


@query()
def ch19_apply_batch(spark, d):
    events = changelog.normalize(changelog.dedup(derived(spark, d, "changes"))).withColumns({"object_kind": F.lit(0), "mode": F.lit(420).cast("long")})
    state = apply.State(cut(entries(spark, d, "fs-a")), cut(derived(spark, d, "edges").filter(A)), derived(spark, d, "removed").drop("tier"))
    state = apply.apply_batch(state, cut(events), derived(spark, d, "observations"), NOW)
    return state.entries.select("object_id", "parent_id", "name", "size", "nlink", "hsm_state")


# Streaming -------------------------------------------------------------------------


@query("SELECT to_timestamp(time - time % 60)::TIMESTAMP AS start, source, kind, count(*) AS n FROM changes GROUP BY ALL", "changes")
def ss4_event_rates(spark, d):
    rows = derived(spark, d, "changes").withColumn("ts", F.timestamp_seconds("time"))
    return jobs.event_rates(rows).withColumn("start", F.col("start").cast("timestamp_ntz"))


REFRESHING = ("CLOSE", "TRUNC", "MTIME", "CTIME", "SATTR", "XATTR", "LYOUT")


def stream_of(spark, rows, path: str, files: int = 1):
    """Records in files, in the order of their index, as a stream."""
    rows.repartitionByRange(files, "idx").sortWithinPartitions("idx").write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def change_records(spark, d):
    return derived(spark, d, "changes").withColumns({"object_kind": F.lit(0), "mode": F.lit(420).cast("long")})


def kept_state(spark, d, path: str) -> Buckets:
    """The derived catalog as the first commit of a state."""
    tables = {"entries": entries(spark, d, "fs-a"), "edges": derived(spark, d, "edges").filter(A), "removed": derived(spark, d, "removed").drop("tier")}
    schemas = {t: df.schema for t, df in tables.items()}
    schemas |= {"links": schemas["edges"], "removed": T.StructType([*schemas["entries"], T.StructField("rm_time", T.LongType())])}
    state = Buckets(spark, path, schemas, n=16)
    state.begin(tables["entries"], tables["edges"], catalog.union_all(spark.createDataFrame([], schemas["removed"])).unionByName(tables["removed"], allowMissingColumns=True))
    return state


@query()
def ss1_ingest(spark, d):
    """The change stream in files, run through the ingest job until none is left; the catalog it leaves."""
    base = scratch(spark)
    state = kept_state(spark, d, f"{base}/state")
    job = jobs.Ingest(state, jobs.observing(cut(derived(spark, d, "observations"))), lambda: NOW, [TIERS])
    job.start(stream_of(spark, change_records(spark, d), f"{base}/in", 3), f"{base}/checkpoint", None).awaitTermination()
    return state.read("entries").select("object_id", "parent_id", "name", "size", "nlink", "hsm_state")


@query("SELECT source, (row_number() OVER (PARTITION BY source ORDER BY idx) - 1) // 300 AS flush, idx FROM changes", "changes")
def ss2_flushes(spark, d):
    return jobs.flushes(derived(spark, d, "changes"), 300).select("source", "flush", "idx")


@query(f"""
SELECT s.source, e.object_id, CASE WHEN t.object_id IS NULL THEN e.size ELSE coalesce(o.size, e.size) END AS size, CASE WHEN t.object_id IS NULL THEN e.mtime ELSE coalesce(o.mtime, e.mtime) END AS mtime
FROM entries_flat e CROSS JOIN (SELECT DISTINCT source FROM changes UNION ALL SELECT 'poisoned') s LEFT JOIN observations o ON o.filesystem_id = e.filesystem_id AND o.object_id = e.object_id
LEFT JOIN (SELECT DISTINCT source, object_id FROM changes WHERE kind IN {REFRESHING}) t ON t.object_id = e.object_id AND t.source = s.source WHERE e.filesystem_id = 'fs-a'
""", E_, "changes", "observations")
def ss3_sources(spark, d):
    """Three sources side by side, one of which fails: the others' states, and that one's as it was."""
    base, observed = scratch(spark), cut(derived(spark, d, "observations"))
    rows = cut(change_records(spark, d).filter(F.col("kind").isin(*REFRESHING)))
    names = [r.source for r in rows.select("source").distinct().orderBy("source").collect()]
    streams = {n: stream_of(spark, rows.filter(F.col("source") == n), f"{base}/in/{n}") for n in names}
    bad = F.when(F.col("idx") >= 0, F.raise_error(F.lit("poisoned"))).otherwise(F.col("idx")).cast("long")
    streams["poisoned"] = stream_of(spark, rows, f"{base}/in/poisoned").withColumn("idx", bad)
    states = {n: kept_state(spark, d, f"{base}/state/{n}") for n in streams}
    running = jobs.ingest_all(streams, {n: jobs.Ingest(states[n], jobs.observing(observed), lambda: NOW, stream=n) for n in streams}, f"{base}/checkpoints")
    failed = [n for n, error in jobs.supervised(running).items() if error]
    if failed != ["poisoned"]:
        raise RuntimeError(f"these sources failed: {failed}")
    return catalog.union_all(*(s.read("entries").select(F.lit(n).alias("source"), "object_id", "size", "mtime") for n, s in states.items()))


FRESH = "coalesce(o.size, e.size) AS size, coalesce(o.mtime, e.mtime) AS mtime, coalesce(o.uid, e.uid) AS uid"


@query(f"""
SELECT f.flush + 1 AS version, f.object_id, {CLASS_SQL} AS class
FROM (SELECT object_id, min(flush) AS flush FROM (SELECT object_id, (row_number() OVER (PARTITION BY source ORDER BY idx) - 1) // 2000 AS flush FROM changes WHERE kind IN {REFRESHING}) GROUP BY object_id) f
JOIN (SELECT e.object_id, {FRESH} FROM entries_flat e LEFT JOIN observations o ON o.filesystem_id = e.filesystem_id AND o.object_id = e.object_id WHERE e.filesystem_id = 'fs-a') x ON x.object_id = f.object_id
WHERE {CLASS_SQL} IS NOT NULL
""", E_, "changes", "observations")
def ss5_reclassified(spark, d):
    """The rows that each flush of the stream gave other tags."""
    base = scratch(spark)
    state = kept_state(spark, d, f"{base}/state")
    job = jobs.Ingest(state, jobs.observing(cut(derived(spark, d, "observations"))), lambda: NOW, [TIERS], feed=f"{base}/feed", most=2000)
    rows = change_records(spark, d).filter(F.col("kind").isin(*REFRESHING))
    job.start(stream_of(spark, rows, f"{base}/in"), f"{base}/checkpoint", None).awaitTermination()
    return jobs.reclassified(spark, f"{base}/feed", state).select(F.col("version").cast("long").alias("version"), "object_id", F.col("xattr")["class"].alias("class"))


HOLD = 86400


@query(f"""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY source, object_id ORDER BY idx) AS k FROM changes),
g AS (
  SELECT source, object_id, k, idx, time AS since FROM o WHERE k = 1
  UNION ALL SELECT o.source, o.object_id, o.k, o.idx, CASE WHEN o.time >= g.since + {HOLD} THEN o.time ELSE g.since END FROM g JOIN o ON o.source = g.source AND o.object_id = g.object_id AND o.k = g.k + 1),
w AS (SELECT c.* REPLACE (g.since AS batch_id) FROM changes c JOIN g ON g.source = c.source AND g.idx = c.idx),
m AS ({MASK_SQL.replace("FROM changes", "FROM w")}),
s AS (SELECT *, row_number() OVER (PARTITION BY filesystem_id, source, batch_id, object_id ORDER BY idx) AS n FROM w WHERE kind IN ('CREAT', 'UNLNK', 'RENME', 'HLINK', 'MKDIR', 'RMDIR')),
{FOLD_SQL}
SELECT idx, kind FROM m WHERE NOT masked AND idx NOT IN (SELECT unnest(gone) FROM f)
""", "changes")
def ss6_continuous_dedup(spark, d):
    """Records of an object wait a day together, whatever the batches; a mark from long after lets the last ones go."""
    base = scratch(spark)
    rows = derived(spark, d, "changes").withColumn("ts", F.timestamp_seconds("time")).select("filesystem_id", "source", "object_id", "idx", "kind", "last_link", "ts")
    rows.repartitionByRange(2, "idx").sortWithinPartitions("idx").write.parquet(f"{base}/in/part=0")
    end = rows.agg(F.max("idx").alias("idx"), F.max("ts").alias("ts"), F.first("filesystem_id").alias("filesystem_id"))
    mark = end.select("filesystem_id", F.lit("mark").alias("source"), F.lit(0).cast("long").alias("object_id"), F.col("idx") + 1, F.lit("MARK").alias("kind"), F.lit(False).alias("last_link"), F.expr(f"ts + make_dt_interval(0, 1, 0, {HOLD})"))
    mark.toDF(*rows.columns).write.parquet(f"{base}/in/part=1")
    stream = spark.readStream.schema(T.StructType([*rows.schema, T.StructField("part", T.IntegerType())])).option("maxFilesPerTrigger", 2).parquet(f"{base}/in").drop("part")
    store, name = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    old = spark.conf.get(store)
    spark.conf.set(store, name)
    try:
        out = jobs.dedup_stream(stream, HOLD, late="1 minute")
        out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, old)
    return spark.read.schema(out.schema).parquet(f"{base}/out").select("idx", "kind")
