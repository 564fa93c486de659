"""The tables of the catalog, their columns and types."""

from pyspark.sql import types as T

L, S, B = T.LongType(), T.StringType(), T.BooleanType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


KEY = ("filesystem_id", "object_kind", "object_id")

#: What the last action on an entry came to; ``path`` is where an alert or a backup found it.
ACTION = _table(kind=S, state=S, error=S, retryable=B, path=S, updated_at=L)
ENTRY = _table(
    filesystem_id=S, object_kind=T.IntegerType(), object_id=L, parent_id=L, name=S, kind=T.IntegerType(), size=L, blocks=L,
    uid=L, gid=L, projid=L, mode=L, nlink=L, atime=L, mtime=L, ctime=L, last_seen=L, stripe_count=T.IntegerType(), stripe_size=L,
    pool_name=S, depth=L, hsm_state=S, hsm_dirty=B, hsm_last_op=S, hsm_last_event_ts=L, hsm_last_error=L, action=ACTION, xattr=T.MapType(S, S),
)
EDGE = _table(filesystem_id=S, object_kind=T.IntegerType(), parent_id=L, name=S, object_id=L)
STRIPE = _table(filesystem_id=S, object_kind=T.IntegerType(), object_id=L, stripe_index=L, ost_index=L)
FILESYSTEM = _table(filesystem_id=S, backend=S, hsm=B, purge=B, namespace=B, ost=B, stripe=B)
CURSOR = _table(filesystem_id=S, source=S, position=L)
BASELINE = _table(filesystem_id=S, state=S, epoch=L)
OBSERVATION = _table(filesystem_id=S, object_id=L, size=L, blocks=L, uid=L, gid=L, mode=L, nlink=L, atime=L, mtime=L, ctime=L)


def wide(table: T.StructType) -> T.StructType:
    """A table whose ids are 16 bytes, which hold any FID or inode, and whose names are the bytes that the filesystem has.

    All operators that compare ids and names take either form; text patterns see a name's bytes as UTF-8.
    """
    return T.StructType([T.StructField(f.name, T.BinaryType() if f.name in (*ID_COLUMNS, "name") else f.dataType) for f in table])


ID_COLUMNS = ("object_id", "parent_id", "src_parent_id")

#: The fixed codes of entry kinds.
KINDS = {0: "file", 1: "directory", 2: "symlink", 3: "chardev", 4: "blockdev", 5: "fifo", 6: "socket"}
#: The object kind that each backend's ids have.
BACKEND_KIND = {"lustre": 0, "juice_fs": 1}
