"""Catalog tables derived from the star-schema tables, in SQL text that Spark and DuckDB share.

Spark runs a text over the Parquet tables; a query's SQL twin gets the same text as a
common table expression, so that both sides start from equal rows and only the
operator under test differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeward.sources.schema import ACTION

#: Names of a text: what it derives, from which tables.
TEXTS = {
    "entries_flat": (
        ("region", "nation", "customer", "orders", "lineitem", "part"),
        """
SELECT 'fs-a' AS filesystem_id, 0 AS object_kind, CAST(1 AS BIGINT) AS object_id, CAST(NULL AS BIGINT) AS parent_id, '' AS name, 1 AS kind,
  CAST(4096 AS BIGINT) AS size, CAST(8 AS BIGINT) AS blocks, CAST(0 AS BIGINT) AS uid, CAST(0 AS BIGINT) AS gid, CAST(0 AS BIGINT) AS projid, CAST(493 AS BIGINT) AS mode,
  CAST(2 AS BIGINT) AS nlink, CAST(0 AS BIGINT) AS atime, CAST(0 AS BIGINT) AS mtime, CAST(0 AS BIGINT) AS ctime, CAST(978307200 AS BIGINT) AS last_seen,
  CAST(NULL AS INT) AS stripe_count, CAST(NULL AS BIGINT) AS stripe_size, CAST(NULL AS VARCHAR(20)) AS pool_name, CAST(0 AS BIGINT) AS depth,
  CAST(NULL AS VARCHAR(20)) AS hsm_state, CAST(NULL AS BOOLEAN) AS hsm_dirty, CAST(NULL AS VARCHAR(20)) AS tier
UNION ALL SELECT 'fs-a', 0, 10 + r_regionkey, 1, 'r' || CAST(r_regionkey AS VARCHAR(20)), 1, 4096, 8, 0, 0, 0, 493, 2, 0, 0, 0, 978307200, NULL, NULL, NULL, 1, NULL, NULL, NULL FROM region
UNION ALL SELECT 'fs-a', 0, 100 + n_nationkey, 10 + n_regionkey, 'n' || CAST(n_nationkey AS VARCHAR(20)), 1, 4096, 8, 0, 0, 0, 493, 2, 0, 0, 0, 978307200, NULL, NULL, NULL, 2, NULL, NULL, NULL FROM nation
UNION ALL SELECT 'fs-a', 0, 1000 + c_custkey, 100 + c_nationkey, 'c' || CAST(c_custkey AS VARCHAR(20)), 1, 4096, 8, c_custkey % 50, c_custkey % 7, 0, 493, 2, 0, 0, 0,
  978307200 + c_custkey % 1000, NULL, NULL, NULL, 3, NULL, NULL, NULL FROM customer
UNION ALL SELECT 'fs-a', 0, 1000000 + k, 1000 + o_custkey, 'o' || CAST(k AS VARCHAR(20)) || CASE k % 5 WHEN 0 THEN '.csv' WHEN 1 THEN '.TMP' WHEN 2 THEN '.log' WHEN 3 THEN '_a%b' ELSE '' END,
  CASE WHEN k % 53 = 0 THEN 2 ELSE 0 END, size, size {div} 512, o_custkey % 50, o_custkey % 7, k % 5, 420, CASE WHEN k % 17 = 0 THEN 2 ELSE 1 END,
  t + (k % 400) * 86400, t, t + 3600, 978307200 + k % 1000, lines, CASE WHEN lines IS NULL THEN NULL ELSE 1048576 * (1 + k % 4) END,
  CASE o_orderstatus WHEN 'F' THEN 'ssd' WHEN 'O' THEN 'hdd' ELSE NULL END, 4,
  CASE k % 4 WHEN 0 THEN 'archived' WHEN 1 THEN 'released' WHEN 2 THEN 'none' ELSE NULL END, CASE WHEN k % 4 = 3 THEN NULL ELSE k % 6 = 0 END, lower(substring(o_orderpriority, 3))
FROM (SELECT o_orderkey AS k, o_custkey, o_orderstatus, o_orderpriority, t, CAST(lines AS INT) AS lines,
    CASE WHEN o_orderkey % 31 = 0 THEN 0 WHEN o_orderkey % 7 = 0 THEN v % 1024 WHEN o_orderkey % 7 = 1 THEN v % 1048576 WHEN o_orderkey % 7 = 2 THEN v * 16 WHEN o_orderkey % 7 = 3 THEN v * 256 ELSE v END AS size
  FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS v, {epoch:o_orderdate} AS t FROM orders) o
  LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS lines FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey) f
UNION ALL SELECT 'fs-b', 1, CAST(1 AS BIGINT), CAST(NULL AS BIGINT), '', 1, 4096, 8, 0, 0, 0, 493, 2, 0, 0, 0, 978307200, NULL, NULL, NULL, 0, NULL, NULL, NULL
UNION ALL SELECT 'fs-b', 1, 1000000 + p_partkey, 1, p_name, 0, p_size * 1000, (p_size * 1000) {div} 512, p_size % 50, 0, 0, 420, 1, 0, 0, 0, 978307200, 1, 1048576, 'ssd', 1, NULL, NULL, 'hot' FROM part
""",
    ),
    "stripes": (
        ("lineitem",),
        """
SELECT 'fs-a' AS filesystem_id, 0 AS object_kind, 1000000 + l_orderkey AS object_id, CAST(l_linenumber - 1 AS BIGINT) AS stripe_index, CAST(min(l_suppkey) % 16 AS BIGINT) AS ost_index
FROM lineitem WHERE l_orderkey % 53 <> 0 GROUP BY l_orderkey, l_linenumber
""",
    ),
    "changes": (
        ("events",),
        """
SELECT 'fs-a' AS filesystem_id, 'MDT000' || CAST(user_id % 2 AS VARCHAR(20)) AS source, CAST(event_id AS BIGINT) AS idx, CAST(event_id {div} 500 AS BIGINT) AS batch_id, {epoch:ts} AS time,
  CAST(1000000 + user_id AS BIGINT) AS object_id,
  CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 4 = 0 THEN 'MKDIR' ELSE 'CREAT' END
    WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'RMDIR' WHEN 1 THEN 'RENME' WHEN 2 THEN 'HLINK' ELSE 'UNLNK' END
    WHEN 'view' THEN CASE event_id % 3 WHEN 0 THEN 'CTIME' WHEN 1 THEN 'MTIME' ELSE 'SATTR' END
    WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'CLOSE' ELSE 'TRUNC' END
    ELSE CASE event_id % 3 WHEN 0 THEN 'HSM' WHEN 1 THEN 'XATTR' ELSE 'LYOUT' END END AS kind,
  event_id % 3 <> 0 AS last_link, CAST(event_id % 6 AS BIGINT) AS hsm_event, CAST(event_id % 2 AS BIGINT) AS hsm_flags, CAST(CASE WHEN event_id % 10 = 0 THEN 5 ELSE 0 END AS BIGINT) AS hsm_error,
  CAST(1000 + user_id % 100 AS BIGINT) AS parent_id, 'f' || CAST(event_id % 200 AS VARCHAR(20)) AS name,
  CAST(1000 + user_id % 100 AS BIGINT) AS src_parent_id, 'f' || CAST((event_id + 199) % 200 AS VARCHAR(20)) AS src_name,
  CAST(user_id % 50 AS BIGINT) AS uid, CAST(user_id % 7 AS BIGINT) AS gid
FROM events
""",
    ),
    "removed": (
        ("entries_flat",),
        "SELECT *, mtime + 86400 AS rm_time FROM entries_flat WHERE filesystem_id = 'fs-a' AND depth = 4 AND (object_id - 1000000) % 97 = 0",
    ),
    "observations": (
        ("entries_flat",),
        """
SELECT filesystem_id, object_kind, object_id, CASE WHEN (object_id - 1000000) % 3 = 0 THEN size + 1 ELSE size END AS size, blocks, uid, gid, mode, nlink, atime,
  CASE WHEN (object_id - 1000000) % 3 = 0 THEN mtime + 60 ELSE mtime END AS mtime, ctime, CASE WHEN (object_id - 1000000) % 5 = 0 THEN 9 ELSE 1 END AS hsm_bits
FROM entries_flat WHERE filesystem_id = 'fs-a' AND depth = 4 AND (object_id - 1000000) % 101 <> 0
""",
    ),
    "edges": (
        ("entries_flat",),
        """
SELECT filesystem_id, object_kind, parent_id, name, object_id FROM entries_flat WHERE parent_id IS NOT NULL
UNION ALL SELECT filesystem_id, object_kind, parent_id, 'link-' || name, object_id FROM entries_flat WHERE nlink = 2 AND kind <> 1
""",
    ),
    "ost_usage": (
        ("entries_flat", "stripes"),
        """
SELECT ost_index, 'OST' || CAST(ost_index AS VARCHAR(20)) AS name, CASE ost_index % 2 WHEN 0 THEN 'ssd' ELSE 'hdd' END AS pool, CAST(sum(size {div} stripe_count) AS BIGINT) AS used, CAST(20000000000 AS BIGINT) AS total
FROM stripes s JOIN entries_flat e ON e.filesystem_id = s.filesystem_id AND e.object_id = s.object_id GROUP BY ost_index
""",
    ),
    "idmap": (
        ("customer",),
        "SELECT DISTINCT CAST(c_custkey % 50 AS BIGINT) AS id, 'user' || CAST(c_custkey % 50 AS VARCHAR(20)) AS name FROM customer WHERE c_custkey % 50 < 40",
    ),
    "listing": (
        ("entries_flat",),
        """
SELECT f.object_id, '/' || coalesce(a.name || '/', '') || coalesce(b.name || '/', '') || coalesce(c.name || '/', '') || f.name AS path, f.kind, f.size, f.uid, f.gid, f.mode, f.nlink, f.atime, f.mtime, f.ctime
FROM (SELECT * FROM entries_flat WHERE filesystem_id = 'fs-a' AND depth > 0) f
LEFT JOIN (SELECT * FROM entries_flat WHERE filesystem_id = 'fs-a' AND depth > 0) c ON c.object_id = f.parent_id
LEFT JOIN (SELECT * FROM entries_flat WHERE filesystem_id = 'fs-a' AND depth > 0) b ON b.object_id = c.parent_id
LEFT JOIN (SELECT * FROM entries_flat WHERE filesystem_id = 'fs-a' AND depth > 0) a ON a.object_id = b.parent_id
""",
    ),
    "action_results": (
        ("entries_flat",),
        """
SELECT filesystem_id, object_kind, object_id, 'run' || CAST(object_id % 4 AS VARCHAR(20)) AS run, 'purge' AS kind, a.attempt,
  CASE WHEN object_id % 10 < 5 THEN 'success' WHEN object_id % 10 < 6 THEN 'already_missing' WHEN object_id % 10 < 8 THEN CASE WHEN a.attempt = 2 THEN 'success' ELSE 'retryable' END ELSE 'failed' END AS outcome,
  mtime + a.attempt AS at, CASE WHEN object_id % 10 BETWEEN 6 AND 9 AND NOT (object_id % 10 < 8 AND a.attempt = 2) THEN 'error ' || CAST(object_id % 7 AS VARCHAR(20)) END AS error
FROM entries_flat e JOIN (SELECT 1 AS attempt UNION ALL SELECT 2) a ON a.attempt = 1 OR object_id % 10 IN (6, 7)
WHERE filesystem_id = 'fs-a' AND depth = 4 AND object_id % 20 < 12
""",
    ),
}
SOURCES = ("region", "nation", "customer", "orders", "lineitem", "part", "events")


def _text(name: str, dialect: str) -> str:
    sql = TEXTS[name][1]
    epoch = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {})" if dialect == "spark" else "CAST(floor(epoch({})) AS BIGINT)"
    for column in ("o_orderdate", "ts"):
        sql = sql.replace("{epoch:" + column + "}", epoch.format(column))
    return sql.replace("{div}", "div" if dialect == "spark" else "//").replace("VARCHAR(20)", "STRING" if dialect == "spark" else "VARCHAR")


def needed(*names: str) -> list[str]:
    """The derived tables that some need, in an order in which each comes after what it needs."""
    out: list[str] = []
    for name in names:
        for below in (*needed(*(x for x in TEXTS[name][0] if x in TEXTS)), name):
            if below not in out:
                out.append(below)
    return out


def oracle(sql: str, *names: str) -> str:
    """DuckDB SQL with the derived tables as common table expressions before it."""
    ctes = [f"{n} AS ({_text(n, 'duckdb')})" for n in needed(*names)]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + body[len("WITH RECURSIVE ") :]
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + ", " + body[5:]
    return "WITH " + ", ".join(ctes) + " " + body


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table in Spark."""
    parts = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") if t in SOURCES else derived(spark, sf_dir, t) for t in TEXTS[name][0]}
    return spark.sql(_named(_text(name, "spark"), parts), **parts)


def _named(sql: str, parts: dict[str, DataFrame]) -> str:
    """The text with each table's name as a placeholder of ``spark.sql``."""
    for t in parts:
        for word in ("FROM", "JOIN"):
            for end in (" ", "\n", ")"):
                sql = (sql + "\n").replace(f"{word} {t}{end}", f"{word} {{{t}}}{end}").removesuffix("\n")
    return sql


def entries(spark: SparkSession, sf_dir: str, filesystem: str | None = None) -> DataFrame:
    """Catalog entries; the tag ``user.tier`` as the extended attributes."""
    df = derived(spark, sf_dir, "entries_flat")
    if filesystem:
        df = df.filter(F.col("filesystem_id") == filesystem)
    tags = F.when(F.col("tier").isNotNull(), F.create_map(F.lit("user.tier"), F.col("tier")))
    none = {"hsm_last_op": F.lit(None).cast("string"), "hsm_last_event_ts": F.lit(None).cast("long"), "hsm_last_error": F.lit(None).cast("long"), "action": F.lit(None).cast(ACTION)}
    return df.withColumns({**none, "xattr": F.coalesce(tags, F.expr("map()").cast("map<string,string>"))}).drop("tier")


def filesystems(spark: SparkSession) -> DataFrame:
    from .schema import FILESYSTEM

    return spark.createDataFrame([("fs-a", "lustre", True, True, True, True, True), ("fs-b", "juice_fs", False, True, True, False, False)], FILESYSTEM)
