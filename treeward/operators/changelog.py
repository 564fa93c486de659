"""Change records: decoding, normalising, de-duplication, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeward.functions.columns import TEXT_KINDS, bit, coded, hsm_fields, percent_decoded, record_name, record_seconds

#: Record types that say nothing about the catalog.
DROPPED = ("MARK", "OPEN", "NOPEN", "ATIME", "MIGRT", "FLRW", "RESYNC", "GXATR", "UNKNOWN")
#: Kinds of records as kinds of changes.
CHANGES = {
    **dict.fromkeys(("CREAT", "MKDIR", "SLINK", "MKNOD"), "created"),
    "HLINK": "hardlinked",
    **dict.fromkeys(("UNLNK", "RMDIR"), "unlinked"),
    "RENME": "renamed",
    **dict.fromkeys(("CLOSE", "TRUNC"), "content_changed"),
    **dict.fromkeys(("SATTR", "XATTR", "LYOUT", "MTIME", "CTIME"), "metadata_changed"),
    "HSM": "hsm_changed",
}
DETAILS = {"MTIME": "attributes", "CTIME": "attributes", "SATTR": "attributes", "XATTR": "xattr", "LYOUT": "layout", "CLOSE": "close", "TRUNC": "truncate"}
CREATED_KINDS = {"CREAT": 0, "MKDIR": 1, "SLINK": 2, "MKNOD": 0}
#: An earlier record of these kinds makes a later one redundant.
MASKS = {
    "CLOSE": ("CLOSE",),
    "TRUNC": ("TRUNC", "CLOSE"),
    "MTIME": ("MTIME", "CLOSE", "TRUNC"),
    "CTIME": ("CTIME", "SATTR", "CLOSE"),
    "SATTR": ("SATTR",),
}
#: Text operations with their number of arguments, and what they are as changes.
TEXT_OPS = {"CREATE": 10, "SETATTR": 14, "SETXATTR": 4, "REMOVEXATTR": 2, "WRITE": 7, "MOVE": 7, "LINK": 4, "UNLINK": 5, "RMDIR": 3}
TEXT_CHANGES = {
    "CREATE": "created", "SETATTR": "metadata_changed", "SETXATTR": "metadata_changed", "REMOVEXATTR": "metadata_changed", "WRITE": "content_changed",
    "MOVE": "renamed", "LINK": "hardlinked", "UNLINK": "unlinked", "RMDIR": "unlinked",
}
#: The operations that a JuiceFS log names and that concern the store itself and not its entries.
TEXT_IGNORED = (
    "ACCESS",
    "ATTACH",
    "CLEANSESSION",
    "CLEANUP",
    "CLEANUP_DELAYED_SLICES",
    "CLEANUP_TRASH_SLICES",
    "DELCHUNK",
    "DELETESLICE",
    "DELETETOKENS",
    "DELQUOTA",
    "DELSUSTAINED",
    "DIRSTAT",
    "INCR_COUNTER",
    "INIT_ENABLE_DIRSTATS",
    "INIT_ENABLE_USERGROUPQUOTA",
    "LOADDUMPEDACLS",
    "NEWSESSION",
    "SET",
    "SETQUOTA",
    "STORETOKEN",
    "UPDATETOKEN",
)


def decode_records(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of raw records ``(source, idx, type, stamp, flags, object_id, parent_id, name, src_object_id, ...)``.

    Types that don't matter are dropped; a rename's object is its source, and one without is rejected.
    """
    rows = raw.withColumns({"kind": record_name("type"), "time": record_seconds("stamp")}).filter(~F.col("kind").isin(*DROPPED))
    hsm, renamed, unlink = F.col("kind") == "HSM", F.col("kind") == "RENME", F.col("kind") == "UNLNK"
    fields = {k: F.when(hsm, v) for k, v in hsm_fields("flags").items()}
    fields |= {"last_link": F.when(unlink, bit("flags", 0)), "hsm_exists": F.when(unlink, bit("flags", 1))}
    rows = rows.withColumns({**fields, "object_id": F.when(renamed, F.col("src_object_id")).otherwise(F.col("object_id"))})
    bad = renamed & F.col("object_id").isNull()
    return rows.filter(~bad).drop("type", "stamp", "flags", "src_object_id"), rows.filter(bad).select("source", "idx", "kind")


def decode_text(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(changes, rejects) of text records ``sec.frac|OP(a,b,..):result|rest``.

    Names are percent-decoded. Wrong numbers of arguments, unknown operations and entry
    types, what is no number where one must be, and what has no result where that is the
    object are rejected; internal operations vanish.
    """
    value = F.col(col)
    pattern = r"^(-?\d+)(?:\.[^|]*)?\|([A-Za-z_]+)\(([^|]*)\)(?::([^|]*))?(?:\|.*)?$"
    part = lambda i: F.regexp_extract(value, pattern, i)
    # The explodes of one row each keep the optimizer from copying the parsing into every use of its parts.
    once = lambda df, **cols: df.select(*df.columns, F.explode(F.array(F.struct(*(c.alias(n) for n, c in cols.items())))).alias("_x")).select(*df.columns, "_x.*")
    rows = lines.select(*(c for c in lines.columns if c != col), value.alias("_raw"))
    value = F.col("_raw")
    rows = once(rows, _ok=value.rlike(pattern), time=part(1).try_cast("long"), op=part(2), a=F.split(part(3), ","), result=part(4).try_cast("long"))
    rows = rows.filter(~F.col("op").isin(*TEXT_IGNORED))
    arg = lambda i: F.get("a", F.lit(i))
    num = lambda i: arg(i).try_cast("long")
    op = F.col("op")
    by = lambda **kw: F.coalesce(*(F.when(op.isin(*k.split("_")), v) for k, v in kw.items()))
    rows = once(
        rows,
        **{
            "change": coded("op", TEXT_CHANGES),
            "object_id": by(CREATE_MOVE=F.col("result"), SETATTR_SETXATTR_REMOVEXATTR_WRITE_LINK=num(0), UNLINK_RMDIR=F.col("result")),
            "parent_id": by(CREATE_UNLINK_RMDIR=num(0), MOVE=num(2), LINK=num(1)),
            "name": by(CREATE_UNLINK_RMDIR=percent_decoded(arg(1)), MOVE=percent_decoded(arg(3)), LINK=percent_decoded(arg(2))),
            "src_parent_id": by(MOVE=num(0)),
            "src_name": by(MOVE=percent_decoded(arg(1))),
            "kind": F.when(op == "CREATE", coded(num(4).cast("int"), TEXT_KINDS)),
            "uid": by(CREATE=num(2)),
            "gid": by(CREATE=num(3)),
            "mode": by(CREATE=num(5)),
            "detail": by(SETATTR=F.lit("attributes"), SETXATTR_REMOVEXATTR=F.lit("xattr"), WRITE=F.lit("data")),
        },
    )
    need = F.col("time").isNotNull() & F.col("change").isNotNull() & (F.size("a") == coded("op", TEXT_OPS))
    need &= F.col("object_id").isNotNull()
    named = op.isin("CREATE", "MOVE", "LINK", "UNLINK", "RMDIR")
    need &= ~named | (F.col("parent_id").isNotNull() & F.col("name").isNotNull())
    need &= (op != "CREATE") | (F.col("kind").isNotNull() & F.col("uid").isNotNull() & F.col("gid").isNotNull() & F.col("mode").isNotNull())
    need &= (op != "MOVE") | (F.col("src_parent_id").isNotNull() & F.col("src_name").isNotNull())
    good = F.col("_ok") & F.coalesce(need, F.lit(False))
    return rows.filter(good).drop("_raw", "_ok", "a", "result", "op"), rows.filter(~good).select(F.col("_raw").alias(col))


def normalize(events: DataFrame) -> DataFrame:
    """Events with the ``change`` they are, its detail and the kind of a created entry; a close's parent 0 is none."""
    kind = F.col("kind")
    return events.withColumns(
        {
            "change": coded("kind", CHANGES),
            "detail": coded("kind", DETAILS),
            "entry_kind": coded("kind", CREATED_KINDS),
            "parent_id": F.when((kind == "CLOSE") & (F.col("parent_id") == 0), F.lit(None)).otherwise(F.col("parent_id")),
        }
    )


OBJECT = ("filesystem_id", "source", "batch_id", "object_id")


def masked(events: DataFrame) -> Column:
    """Whether an earlier record of the same object and batch makes this one redundant."""
    before = Window.partitionBy(*OBJECT).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    had = lambda k: F.coalesce(F.max(F.col("kind") == k).over(before), F.lit(False))
    out = F.lit(False)
    for kind, by in MASKS.items():
        hit = F.lit(False)
        for k in by:
            hit = hit | had(k)
        out = F.when(F.col("kind") == kind, hit).otherwise(out)
    return out


def cancelled(events: DataFrame) -> DataFrame:
    """``(*OBJECT, idx)`` of creations and removals of an object that cancel each other in a batch.

    A last-link unlink takes back the newest creation that no rename or hard link
    followed; a directory's removal its newest making. A fold over the few structural
    records of an object, which the batch bounds.
    """
    kinds = ("CREAT", "UNLNK", "RENME", "HLINK", "MKDIR", "RMDIR")
    few = events.filter(F.col("kind").isin(*kinds)).groupBy(*OBJECT)
    rows = few.agg(F.sort_array(F.collect_list(F.struct("idx", "kind", F.coalesce("last_link", F.lit(False)).alias("last")))).alias("e"))
    empty = F.expr("cast(array() as array<bigint>)")
    start = F.struct(empty.alias("files"), empty.alias("dirs"), F.lit(-1).cast("long").alias("block"), empty.alias("out"))

    def step(acc: Column, e: Column) -> Column:
        push = lambda c: F.concat(c, F.array(e["idx"]))
        pop = lambda c: F.slice(c, F.lit(1), F.size(c) - 1)
        file_ends = (e["kind"] == "UNLNK") & e["last"] & (F.size(acc["files"]) > 0) & (F.element_at(acc["files"], -1) > acc["block"])
        dir_ends = (e["kind"] == "RMDIR") & (F.size(acc["dirs"]) > 0)
        return F.struct(
            F.when(e["kind"] == "CREAT", push(acc["files"])).when(file_ends, pop(acc["files"])).otherwise(acc["files"]).alias("files"),
            F.when(e["kind"] == "MKDIR", push(acc["dirs"])).when(dir_ends, pop(acc["dirs"])).otherwise(acc["dirs"]).alias("dirs"),
            F.when(e["kind"].isin("RENME", "HLINK"), e["idx"]).otherwise(acc["block"]).alias("block"),
            F.when(file_ends, F.concat(acc["out"], F.array(F.element_at(acc["files"], -1), e["idx"])))
            .when(dir_ends, F.concat(acc["out"], F.array(F.element_at(acc["dirs"], -1), e["idx"])))
            .otherwise(acc["out"])
            .alias("out"),
        )

    return rows.select(*OBJECT, F.explode(F.aggregate("e", start, step, lambda acc: acc["out"])).alias("idx"))


def dedup(events: DataFrame) -> DataFrame:
    """Events without redundant ones, per source, batch and object. Masking and cancelling touch different kinds."""
    rows = events.withColumn("_masked", masked(events)).filter(~F.col("_masked")).drop("_masked")
    return rows.join(cancelled(events), [*OBJECT, "idx"], "left_anti")


def push(pending: list[tuple], record: tuple) -> None:
    """Put ``record`` (idx, kind, last link) to an object's ``pending`` ones by the rules of ``dedup``, one at a time."""
    _, kind, last = record
    kinds = [r[1] for r in pending]
    begun = {"UNLNK": "CREAT", "RMDIR": "MKDIR"}.get(kind)
    if begun in kinds and (kind != "UNLNK" or last):
        at = len(kinds) - 1 - kinds[::-1].index(begun)
        if kind == "RMDIR" or not {"RENME", "HLINK"} & {*kinds[at + 1 :]}:
            del pending[at]
            return
    if kind not in DROPPED and not {*MASKS.get(kind, ())} & {*kinds}:
        pending.append(record)


# Positions -----------------------------------------------------------------------


def commit(cursors: DataFrame, new: DataFrame, strict: bool = False) -> DataFrame:
    """Positions after a commit: the greater of stored and new; ``strict`` fails on a step back."""
    keys = ["filesystem_id", "source"]
    sums = new.groupBy(*keys).agg(F.max("position").alias("new"))
    both = cursors.select(*keys, F.col("position").alias("old")).join(sums, keys, "full")
    position = F.greatest("old", "new")
    if strict:
        message = F.concat(F.lit("position of "), F.col("source"), F.lit(" would go back"))
        position = F.when(F.col("new") < F.col("old"), F.raise_error(message).cast("long")).otherwise(position)
    return both.select(*keys, position.alias("position"))


def after_cursor(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events strictly after their source's stored position; all if there is none."""
    keys = ["filesystem_id", "source"]
    rows = events.join(cursors.select(*keys, "position"), keys, "left")
    return rows.filter(F.col("position").isNull() | (F.col("idx") > F.col("position"))).drop("position")


def rekey(cursors: DataFrame, fs: str) -> DataFrame:
    """Positions without a filesystem as those of one, the greatest of each source."""
    return cursors.groupBy("source").agg(F.max("position").alias("position")).select(F.lit(fs).alias("filesystem_id"), "source", "position")


def routed(events: DataFrame, filesystems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejected batches): a batch with an object of the wrong kind or filesystem is rejected whole."""
    from treeward.sources.schema import BACKEND_KIND

    kinds = F.create_map(*(F.lit(x) for kv in BACKEND_KIND.items() for x in kv))
    known = filesystems.select("filesystem_id", F.element_at(kinds, F.col("backend")).alias("object_kind"))
    keys = ["filesystem_id", "source", "batch_id"]
    wrong = events.join(known, ["filesystem_id", "object_kind"], "left_anti").select(*keys).distinct()
    return events.join(wrong, keys, "left_anti"), wrong


BASELINE_STATES = ("scanning", "catching_up", "ready", "invalid")


def next_baseline(state: str, quiet_polls: int, edges_equal: bool | None, gap: bool = False) -> str:
    """The state of a filesystem's baseline after a poll: two quiet ones and equal edges make it ready; a gap or a difference invalid."""
    if gap or edges_equal is False:
        return "invalid"
    if state == "scanning":
        return "catching_up"
    if state == "catching_up" and quiet_polls >= 2 and edges_equal:
        return "ready"
    return "scanning" if state == "invalid" else state
