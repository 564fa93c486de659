"""The JSON predicate tree as one Catalyst expression.

``mode="sql"`` has SQL's three-valued logic; in ``mode="match"`` each leaf that is null
is false, so that ``not`` keeps it, and missing stripe figures count as 0.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = frozenset("size blocks uid gid projid mode nlink mtime atime ctime kind stripe_count stripe_size last_seen depth".split())
COMPARE = {
    "eq": Column.__eq__, "ne": Column.__ne__, "lt": Column.__lt__, "le": Column.__le__, "gt": Column.__gt__, "ge": Column.__ge__,
}

#: Builders of the nodes, as a client writes them in JSON.
TRUE, FALSE = {"op": "true"}, {"op": "false"}


def all_of(*children: dict) -> dict:
    return {"op": "and", "children": list(children)}


def any_of(*children: dict) -> dict:
    return {"op": "or", "children": list(children)}


def negated(inner: dict) -> dict:
    return {"op": "not", "inner": inner}


def cmp(field: str, how: str, value: int) -> dict:
    return {"op": "cmp", "field": field, "cmp": how, "value": value}


def tags(**pairs: str) -> dict:
    return {"op": "tags", "match_tags": pairs}


def ignoring(scope: dict, ignored: list[dict]) -> dict:
    """The scope without what any of the ignored classes takes."""
    return all_of(scope, negated(any_of(*ignored)))


def to_column(pred: dict, mode: str = "sql", stripes: DataFrame | None = None) -> Column:
    """The condition of a predicate on catalog entries. ``stripes`` is needed for ``on_ost`` in sql mode."""
    if mode not in ("sql", "match"):
        raise ValueError(f"unknown mode {mode!r}")

    def leaf(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)) if mode == "match" else c

    def node(p: dict) -> Column:
        op = p["op"]
        if op == "and":
            return reduce(Column.__and__, map(node, p["children"])) if p["children"] else F.lit(True)
        if op == "or":
            return reduce(Column.__or__, map(node, p["children"])) if p["children"] else F.lit(False)
        if op == "not":
            return ~node(p["inner"])
        if op in ("true", "false"):
            return F.lit(op == "true")
        if op == "cmp":
            if p["field"] not in FIELDS:
                raise ValueError(f"unknown field {p['field']!r}")
            if isinstance(p["value"], bool) or not isinstance(p["value"], int):
                raise ValueError(f"{p['field']} is compared with numbers only")
            col = F.col(p["field"])
            if mode == "match" and p["field"] in ("stripe_count", "stripe_size"):
                col = F.coalesce(col, F.lit(0))
            return leaf(COMPARE[p["cmp"]](col, F.lit(p["value"])))
        if op == "name_like":
            return leaf(F.col("name").cast("string").like(p["pattern"]))
        if op == "iname_like":
            return leaf(F.col("name").cast("string").ilike(p["pattern"]))
        if op == "name_regex":
            try:
                re.compile(p["pattern"])
            except re.error:
                return F.lit(False)
            return leaf(F.col("name").cast("string").rlike(p["pattern"]))
        if op == "xattr":
            col, value = F.col("xattr")[p["key"]], p["value"]
            return leaf(COMPARE[p["cmp"]](col.try_cast("long") if isinstance(value, int) else col, F.lit(value)))
        if op == "in_pool":
            return leaf(F.col("pool_name") == p["pool"])
        if op == "hsm_state_eq":
            return leaf(F.col("hsm_state") == p["state"])
        if op == "tags":
            return node(all_of(*({"op": "xattr", "key": k, "cmp": "eq", "value": v} for k, v in sorted(p["match_tags"].items()))))
        if op == "on_ost":
            if not p["osts"] or mode == "match":
                return F.lit(False)
            if stripes is None:
                raise ValueError("on_ost needs the stripe table")
            keys = ("filesystem_id", "object_kind", "object_id")
            # The alias keeps the analyzer from finding the outer names below the select.
            own = stripes.filter(F.col("ost_index").isin(p["osts"])).select(*(F.col(k).alias(f"_stripe_{k}") for k in keys)).alias("_stripes")
            return own.where(reduce(Column.__and__, (F.col(f"_stripe_{k}") == F.col(k).outer() for k in keys))).exists()
        raise ValueError(f"unknown predicate {op!r}")

    return node(pred)


def fileclasses(entries: DataFrame, classes: dict[str, dict], mode: str = "match") -> DataFrame:
    """``entries`` with one boolean column for each named predicate."""
    return entries.withColumns({name: to_column(p, mode) for name, p in classes.items()})
