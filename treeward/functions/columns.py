"""Column functions: ids, code maps, bit fields, strings, maps and state labels."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeward.sources.schema import KINDS

#: The fixed names of change record types, by code.
RECORDS = (
    "MARK CREAT MKDIR HLINK SLINK MKNOD UNLNK RMDIR RENME RNMTO OPEN CLOSE LYOUT TRUNC SATTR XATTR HSM MTIME CTIME ATIME MIGRT FLRW RESYNC GXATR NOPEN"
).split()
#: The fixed entry types of text change records, as kinds of entries.
TEXT_KINDS = {1: 0, 2: 1, 3: 2, 4: 5, 5: 4, 6: 3, 7: 6}
#: find(1) type letters, as kinds.
TYPE_LETTERS = {"f": 0, "d": 1, "l": 2, "c": 3, "b": 4, "p": 5, "s": 6}
HSM_OPS = {0: "archive", 1: "restore", 2: "cancel", 3: "release", 4: "remove", 5: "state"}


def coded(col: Column | str, codes: dict) -> Column:
    """Look a value up in a fixed table; null if it is not there."""
    col = F.col(col) if isinstance(col, str) else col
    return F.element_at(F.create_map(*(F.lit(x) for kv in codes.items() for x in kv)), col)


def kind_label(col: Column | str) -> Column:
    return coded(col, KINDS)


def kind_code(label: Column | str) -> Column:
    return coded(label, {v: k for k, v in KINDS.items()})


def record_name(code: Column | str) -> Column:
    """The short name of a change record type, UNKNOWN if there is none."""
    return F.coalesce(coded(code, dict(enumerate(RECORDS))), F.lit("UNKNOWN"))


def human_bytes(n: Column | str) -> Column:
    """Bytes as text: whole below 1 KiB, then two decimals of KiB, MiB, GiB, TiB."""
    n = F.col(n) if isinstance(n, str) else n
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1024**power, F.format_string(f"%.2f {unit}", n.cast("double") / 1024**power)).otherwise(out)
    return out


# Object ids --------------------------------------------------------------------


def fid_bytes(seq: Column, oid: Column, ver: Column) -> Column:
    """A FID as 16 bytes whose order is the order of (seq, oid, ver)."""
    part = lambda c, w: F.lpad(F.hex(c), w, "0")
    return F.unhex(F.concat(part(seq, 16), F.substring(part(oid, 16), 9, 8), F.substring(part(ver, 16), 9, 8)))


def fid_from_text(text: Column | str) -> Column:
    """``[0xSEQ:0xOID:0xVER]``, brackets and 0x optional, as 16 bytes; null if malformed."""
    text = F.lower(F.trim(F.col(text) if isinstance(text, str) else text))
    pattern = r"^\[?(?:0x)?([0-9a-f]{1,16}):(?:0x)?([0-9a-f]{1,8}):(?:0x)?([0-9a-f]{1,8})\]?$"
    parts = [F.lpad(F.regexp_extract(text, pattern, i), w, "0") for i, w in ((1, 16), (2, 8), (3, 8))]
    return F.when(text.rlike(pattern), F.unhex(F.concat(*parts)))


def fid_to_text(fid: Column | str) -> Column:
    """16 bytes as ``[0xseq:0xoid:0xver]`` without leading zeros."""
    h = F.lower(F.hex(fid))
    part = lambda a, n: F.concat(F.lit("0x"), F.regexp_replace(F.substring(h, a, n), "^0+(?=.)", ""))
    return F.concat(F.lit("["), part(1, 16), F.lit(":"), part(17, 8), F.lit(":"), part(25, 8), F.lit("]"))


def inode_bytes(inode: Column | str) -> Column:
    """An inode number as 16 bytes, the first eight zero."""
    return F.unhex(F.lpad(F.hex(inode), 32, "0"))


def inode_from_bytes(raw: Column | str) -> Column:
    return F.conv(F.substring(F.hex(raw), 17, 16), 16, 10).cast("decimal(20,0)").cast("long")


def key_to_text(kind: Column | str, raw: Column | str) -> Column:
    """An id of 16 bytes as text: a FID's form for object kind 0, an inode's number for 1."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    return F.when(kind == 0, fid_to_text(raw)).otherwise(F.conv(F.substring(F.hex(raw), 17, 16), 16, 10))


def key_from_text(kind: Column | str, text: Column | str) -> Column:
    """The inverse: 16 bytes, null if malformed; inodes go up to 2^64."""
    kind, text = (F.col(c) if isinstance(c, str) else c for c in (kind, text))
    inode = F.when(text.rlike("^[0-9]{1,20}$") & (F.expr("try_cast('18446744073709551615' AS decimal(20,0))") >= text.try_cast("decimal(20,0)")), F.unhex(F.lpad(F.conv(text, 10, 16), 32, "0")))
    return F.when(kind == 0, fid_from_text(text)).when(kind == 1, inode)


def shown(name: Column | str) -> Column:
    """A name for people: bytes that are not UTF-8 become U+FFFD."""
    return F.make_valid_utf8((F.col(name) if isinstance(name, str) else name).cast("string"))


# Bit fields of change records ----------------------------------------------------


def record_seconds(stamp: Column | str) -> Column:
    """Unix seconds of a packed record time."""
    return F.shiftright(stamp, 30)


def bit(flags: Column | str, n: int) -> Column:
    flags = F.col(flags) if isinstance(flags, str) else flags
    return F.shiftright(flags, n).bitwiseAND(F.lit(1)) == 1


def bits(flags: Column | str, low: int, count: int) -> Column:
    flags = F.col(flags) if isinstance(flags, str) else flags
    return F.shiftright(flags, low).bitwiseAND(F.lit((1 << count) - 1))


def hsm_fields(flags: Column | str) -> dict[str, Column]:
    """Error (bits 0-6), event (7-9) and flags (10-11) of an HSM record."""
    return {"hsm_error": bits(flags, 0, 7), "hsm_event": bits(flags, 7, 3), "hsm_flags": bits(flags, 10, 2)}


# Strings -------------------------------------------------------------------------


def percent_decoded(text: Column | str) -> Column:
    """``%XX`` decoded and nothing else; null if malformed."""
    text = F.col(text) if isinstance(text, str) else text
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def rendered(template: str | Column, values: dict[str, Column | str]) -> Column:
    """A template with each ``{name}`` replaced; names without a value stay, null values are empty.

    Values are put in once: a ``{name}`` within a value stays as it is.
    """
    out = F.lit(template) if isinstance(template, str) else template
    column = lambda v: F.coalesce((F.lit(v) if isinstance(v, str) else v).cast("string"), F.lit(""))
    known = F.create_map(*(x for name, value in values.items() for x in (F.lit("{" + name + "}"), column(value))))
    # Pieces are what lies between the names, and the names themselves.
    pieces = F.regexp_extract_all(out, F.lit(r"(?s)\{[a-z_]+\}|\{|[^{]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.element_at(known, p), p)), "")


def glob_to_like(glob: str) -> str:
    """A shell glob of ``*`` and ``?`` as a LIKE pattern."""
    return "".join({"*": "%", "?": "_", "%": r"\%", "_": r"\_", "\\": "\\\\"}.get(c, c) for c in glob)


def glob_to_regex(glob: str) -> str:
    """A shell glob of ``*``, ``?`` and ``[set]`` as an anchored regular expression."""
    out, i = "", 0
    while i < len(glob):
        c, end = glob[i], glob.find("]", i + 1)
        if c == "[" and end > i + 1:
            out += "[" + "".join(re.escape(x) if x in r"\^-[]&" else x for x in glob[i + 1 : end]) + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        i += 1
    return f"^(?s:{out})$"


def glob_filter(col: Column | str, globs: list[str]) -> Column:
    """Whether a name matches one of the globs, whole."""
    col = F.col(col) if isinstance(col, str) else col
    return reduce(Column.__or__, (col.rlike(glob_to_regex(g)) for g in globs), F.lit(False))


# Maps and states -----------------------------------------------------------------


def merged(old: Column | str, new: Column | str) -> Column:
    """A shallow merge of two maps: keys of ``new`` win."""
    new = F.col(new) if isinstance(new, str) else new
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def retagged(tags: Column | str, clear: list[str], new: Column) -> Column:
    """Tags without the keys in ``clear``, then with ``new``."""
    kept = F.map_filter(F.coalesce(F.col(tags) if isinstance(tags, str) else tags, F.expr("map()").cast("map<string,string>")), lambda k, v: ~k.isin(clear) if clear else F.lit(True))
    return merged(kept, new)


def hsm_label(mask: Column | str) -> Column:
    """The state that HSM bits say: released (8) over archived (4) or exists (1)."""
    m = F.col(mask) if isinstance(mask, str) else mask
    has = lambda n: m.bitwiseAND(F.lit(n)) != 0
    return F.when(has(8), "released").when(has(4), "archived").when(has(1), "exists").otherwise("none")


def hsm_patch(event: Column | str, flags: Column | str, error: Column | str, state: Column | str) -> dict[str, Column]:
    """The state columns after an HSM record: an error keeps the state and is recorded."""
    event, flags, error, state = (F.col(x) if isinstance(x, str) else x for x in (event, flags, error, state))
    moved = F.when(event.isin(0, 1), "archived").when(event == 3, "released").when(event == 4, "none").otherwise(state)
    return {
        "hsm_state": F.when(error != 0, state).otherwise(moved),
        "hsm_last_op": coded(event.cast("int"), HSM_OPS),
        "hsm_dirty": flags.bitwiseAND(F.lit(1)) != 0,
        "hsm_last_error": F.when(error != 0, error),
    }


def truncated_state(mask: Column, state: Column) -> Column:
    """The HSM state after a truncation: what the bits say, if the state is one of HSM and they say something."""
    has = lambda n: mask.bitwiseAND(F.lit(n)) != 0
    seen = F.when(has(8), "released").when(has(4) & ~has(2), "archived").when(mask == 0, "none")
    return F.when(F.coalesce(state, F.lit("none")) != "none", F.coalesce(seen, state)).otherwise(state)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null if b is 0."""
    return a / F.nullif(b, F.lit(0))


def clamp(n: int | None, default: int, most: int, least: int = 1) -> int:
    return max(least, min(most, default if n is None else n))
