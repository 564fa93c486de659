"""find(1)-style arguments and short rule texts as predicates."""

from __future__ import annotations

import re

from treeward.functions.columns import TYPE_LETTERS, clamp, glob_to_like

from .predicate import all_of, cmp

SORT_FIELDS = ("size", "mtime", "atime", "ctime", "uid", "gid", "nlink")
SIZE_UNITS = {"": 1, "B": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}
TIME_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "": 86400, "y": 365 * 86400}
WHEN_FIELDS = ("atime", "mtime", "ctime", "size", "uid", "gid", "depth", "nlink")
WHEN_SIGNS = {"<=": "le", ">=": "ge", "!=": "ne", "==": "eq", "=": "eq", "<": "lt", ">": "gt"}


def size_predicate(text: str) -> dict:
    """``[+-]N[BKMGT]``: larger, smaller, equal."""
    m = re.fullmatch(r"([+-]?)(\d+)([BKMGT]?)", text.strip(), re.I)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return cmp("size", {"+": "gt", "-": "lt", "": "eq"}[m[1]], int(m[2]) * SIZE_UNITS[m[3].upper()])


def time_predicate(field: str, text: str, now: int) -> dict:
    """``[+-]N[smhdy]``, days by default: older, newer, at least as old."""
    m = re.fullmatch(r"([+-]?)(\d+)([smhdy]?)", text.strip(), re.I)
    if not m:
        raise ValueError(f"not a time: {text!r}")
    return cmp(field, {"+": "lt", "-": "gt", "": "le"}[m[1]], now - int(m[2]) * TIME_UNITS[m[3].lower()])


def find_predicate(now: int, **args) -> dict:
    """All given arguments at once: user, group, projid, pool, type, name, size, hsm_state, mtime, atime, ctime."""
    out = []
    for key, value in args.items():
        if value is None:
            continue
        if key in ("user", "group", "projid"):
            out.append(cmp({"user": "uid", "group": "gid"}.get(key, key), "eq", int(value)))
        elif key == "pool":
            out.append({"op": "in_pool", "pool": value})
        elif key == "type":
            out.append(cmp("kind", "eq", TYPE_LETTERS[value]))
        elif key == "name":
            out.append({"op": "name_like", "pattern": glob_to_like(value)})
        elif key == "size":
            out.append(size_predicate(value))
        elif key == "hsm_state":
            out.append({"op": "hsm_state_eq", "state": value})
        elif key in ("mtime", "atime", "ctime"):
            out.append(time_predicate(key, value, now))
        else:
            raise ValueError(f"unknown argument {key!r}")
    return all_of(*out)


def parse_when(text: str, now: int) -> dict:
    """``atime < -90d, size > 1GB``: comma means and; ``-N`` d, h or m is relative to ``now``; KB to TB are powers of 1024."""
    out = []
    for part in text.split(","):
        m = re.fullmatch(r"\s*(\w+)\s*(<=|>=|!=|==|=|<|>)\s*(\S+)\s*", part)
        if not m or m[1] not in WHEN_FIELDS:
            raise ValueError(f"not a condition: {part!r}")
        field, sign, value = m[1], WHEN_SIGNS[m[2]], m[3]
        if field.endswith("time") and (t := re.fullmatch(r"-(\d+)([dhm])", value)):
            number = now - int(t[1]) * TIME_UNITS[t[2]]
        elif field == "size" and (t := re.fullmatch(r"(\d+)(?:([KMGT])?B)?", value, re.I)):
            number = int(t[1]) * SIZE_UNITS[(t[2] or "").upper()]
        elif re.fullmatch(r"\d+", value):
            number = int(value)
        else:
            raise ValueError(f"not a value for {field}: {value!r}")
        out.append(cmp(field, sign, number))
    return all_of(*out)


def sort_key(field: str, desc: bool = False) -> tuple[str, bool]:
    if field not in SORT_FIELDS:
        raise ValueError(f"cannot sort by {field!r}")
    return field, desc


__all__ = ["clamp", "find_predicate", "parse_when", "size_predicate", "sort_key", "time_predicate"]
