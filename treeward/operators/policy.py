"""Policies: choosing candidates, validating, manifests, outcomes and thresholds."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeward.functions.columns import kind_label, rendered
from treeward.sources.schema import KEY
from treeward.sources.staging import cut

from .prefix import running
from .apply import unlink
from .predicate import all_of, cmp, tags, to_column

#: Candidates that one task orders and sums.
FEW = 50_000
LRU = ("atime", "mtime", "ctime", "last_seen")
HSM_KINDS = ("hsm_archive", "hsm_release", "hsm_restore", "hsm_remove")


@dataclass(frozen=True)
class Target:
    """What a run is narrowed to: all of the filesystem, or storage targets, a pool, an owner."""

    kind: str = "fs"
    value: object = None

    def predicate(self) -> dict:
        if self.kind == "fs":
            return {"op": "true"}
        if self.kind == "ost":
            return {"op": "on_ost", "osts": list(self.value)}
        if self.kind == "pool":
            return {"op": "in_pool", "pool": self.value}
        column = {"user": "uid", "group": "gid", "projid": "projid"}[self.kind]
        return cmp(column, "eq", int(self.value))


@dataclass(frozen=True)
class Policy:
    name: str
    filesystem: str
    kind: str = "purge"
    match_tags: dict = field(default_factory=dict)
    trigger: str = "1h"
    target: Target = Target()
    max_count: int | None = None
    max_volume: int | None = None
    lru: str | None = None
    skip_hardlinked: bool = False
    low: int | None = None
    command: str | None = None
    destination: str | None = None
    message: str = ""
    has_backup: bool = False

    def scope(self) -> dict:
        return all_of(tags(**self.match_tags), self.target.predicate())


def eligible(kind: str) -> Column:
    """Whether an entry's catalog state allows an HSM action."""
    file, archived, released = F.col("kind") == 0, F.col("hsm_state").isin("archived", "released"), F.col("hsm_state") == "released"
    dirty = F.coalesce("hsm_dirty", F.lit(False))
    rule = {
        "hsm_archive": ~(F.coalesce(archived, F.lit(False)) & ~dirty),
        "hsm_release": archived & ~released,
        "hsm_restore": released,
        "hsm_remove": archived & ~dirty,
    }[kind]
    return file & F.coalesce(rule, F.lit(False))


def select_candidates(entries: DataFrame, policy: Policy, stripes: DataFrame | None = None, low_measure: int | None = None, retries: DataFrame | None = None) -> DataFrame:
    """The policy's candidates in order, each with its ``position`` and ``decision``.

    Matching entries are ordered by the LRU attribute, cut to ``max_count``; then hard
    links are skipped if asked, ineligible HSM entries too, and what is left is
    dispatched until the next one would exceed ``max_volume``: a prefix, not a best
    fit. With ``low_measure``, the measure before the run, dispatch stops once the
    policy's low mark is reached. Skipped rows use no budget. Up to ``FEW`` candidates the
    count limit leaves rows enough for one task; beyond it sums run over ranges. ``retries``, a
    ``retry_queue``, comes first whatever its age, each with the ``attempt`` that it is due; others have their first.
    """
    if policy.lru is not None and policy.lru not in LRU:
        raise ValueError(f"cannot order by {policy.lru!r}")
    rows = entries.filter((F.col("filesystem_id") == policy.filesystem) & to_column(policy.scope(), stripes=stripes))
    keys = ([policy.lru] if policy.lru else []) + ["object_kind", "object_id"]
    if retries is not None:
        rows = rows.join(retries.select(*KEY, (F.col("attempts") + 1).alias("attempt")), list(KEY), "left").withColumn("attempt", F.coalesce("attempt", F.lit(1)))
        rows, keys = rows.withColumn("_first", F.col("attempt") == 1), ["_first", *keys]
    most = policy.max_count or 10_000
    rows = rows.orderBy(*keys).limit(most) if most <= FEW else rows
    hard = (F.col("nlink") > 1) if policy.skip_hardlinked else F.lit(False)
    barred = ~eligible(policy.kind) if policy.kind in HSM_KINDS else F.lit(False)
    rows = rows.withColumn("_skip", F.when(hard, "skipped_hardlink").when(barred, "skipped_state"))
    uses = F.when(F.col("_skip").isNull(), F.col("size")).otherwise(0)
    if most <= FEW:
        order = Window.orderBy(*keys)
        before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumns({"position": F.row_number().over(order).cast("long"), "cumulative": F.sum(uses).over(before)})
    else:
        rows = running(rows, keys, uses).filter(F.col("position") <= most)
    decision = F.when(F.col("_skip").isNotNull(), F.col("_skip"))
    if policy.max_volume is not None:
        decision = decision.when(F.col("cumulative") > policy.max_volume, "over_budget")
    if policy.low is not None and low_measure is not None:
        decision = decision.when(F.lit(low_measure) - (F.col("cumulative") - F.col("size")) <= policy.low, "below_low_mark")
    return rows.withColumn("decision", decision.otherwise("dispatch")).drop("_skip", "_first")


def dry_run(entries: DataFrame, policy: Policy, stripes: DataFrame | None = None) -> DataFrame:
    """One row: candidates, bytes, and how many would be dispatched, skipped and left over."""
    rows = select_candidates(entries, policy, stripes)
    if policy.kind in ("purge", "alert", "backup"):
        rows = rows.withColumn("decision", F.lit("skipped"))
    return rows.agg(
        F.count("*").alias("candidates"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.count_if(F.col("decision") == "dispatch").alias("dispatched"),
        F.count_if(F.col("decision").like("skipped%")).alias("skipped"),
        F.count_if(F.col("decision") == "over_budget").alias("over_budget"),
    )


def violations(policies: DataFrame, filesystems: DataFrame) -> DataFrame:
    """``(name, problem)``: what of each policy its filesystem does not allow.

    ``policies`` has ``name, filesystem_id, kind, trigger, target, has_backup``.
    """
    fs = filesystems.withColumnRenamed("filesystem_id", "fs")
    rows = policies.join(fs, policies["filesystem_id"] == fs["fs"], "left")
    kind, lacks = F.col("kind"), lambda c: ~F.coalesce(F.col(c), F.lit(False))
    checks = {
        "unknown filesystem": F.col("fs").isNull(),
        "purge is not supported": (kind == "purge") & lacks("purge"),
        "hsm is not supported": kind.isin(*HSM_KINDS) & lacks("hsm"),
        "namespace is not supported": kind.isin("alert", "backup") & lacks("namespace"),
        "backup needs a configuration": (kind == "backup") & ~F.col("has_backup"),
        "trigger needs storage targets": (F.col("trigger").like("ost>%") | F.col("trigger").like("fs>%")) & lacks("ost"),
        "target needs storage targets": (F.col("target") == "ost") & lacks("ost"),
        "target needs stripes": (F.col("target") == "pool") & lacks("stripe"),
        "kind is not supported on this backend": (F.col("backend") == "juice_fs") & ~kind.isin("purge", "alert", "backup"),
    }
    found = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(text)) for text, c in checks.items()))
    return rows.select("name", F.explode(F.array_compact(found)).alias("problem"))


def parse_trigger(text: str) -> dict:
    """``Nh``/``Nm``/``Ns``, ``cron:`` and five or six fields, ``fs>P%``, ``ost>P%``, ``count>N``, ``volume>N[KMGT]B``."""
    text = text.strip()
    base = {"check_interval": 300, "low": 0, "cooldown": 0}
    if m := re.fullmatch(r"(\d+)([hms])", text):
        return {"type": "interval", "seconds": int(m[1]) * {"h": 3600, "m": 60, "s": 1}[m[2]]}
    if text.startswith("cron:"):
        fields = text[5:].split()
        if len(fields) not in (5, 6):
            raise ValueError(f"not a schedule: {text!r}")
        return {"type": "cron", "cron": " ".join(["0", *fields] if len(fields) == 5 else fields)}
    if (m := re.fullmatch(r"(fs|ost)>(\d+)%", text)) and 1 <= int(m[2]) <= 100:
        return {"type": f"{m[1]}_percent", "high": int(m[2]), **base}
    if m := re.fullmatch(r"count>(\d+)", text):
        return {"type": "count", "high": int(m[1]), **base}
    if m := re.fullmatch(r"volume>(\d+)([KMGT]?)B", text, re.I):
        return {"type": "volume", "high": int(m[1]) * 1024 ** " KMGT".index(m[2].upper() or " "), **base}
    raise ValueError(f"not a trigger: {text!r}")


def manifest(candidates: DataFrame, policy: Policy, path: Column) -> DataFrame:
    """One row for each dispatched candidate: the command, the destination and the alert to run elsewhere."""
    values = {"fid": F.hex("object_id"), "path": path, "fullpath": path, **{c: F.col(c) for c in ("size", "uid", "gid", "mtime", "ctime", "atime")}}
    alert = F.to_json(
        F.struct(
            F.col("filesystem_id").alias("filesystem"), F.col("object_id").alias("object"), path.alias("path"), kind_label("kind").alias("kind"), "size", F.lit(policy.message).alias("message")
        )
    )
    return candidates.filter("decision = 'dispatch'").select(
        *KEY,
        "position",
        F.lit(policy.kind).alias("action"),
        (rendered(policy.command, values) if policy.command else F.lit(None).cast("string")).alias("command"),
        (rendered(policy.destination, values) if policy.destination else F.lit(None).cast("string")).alias("destination"),
        alert.alias("alert"),
    )


def final_outcomes(attempts: DataFrame, max_attempts: int = 3) -> DataFrame:
    """``(key, outcome, attempts)`` of each object: the first end of its attempts.

    A success or a missing object ends it, so does a failure that can't be retried;
    else it failed with the last attempt, or is pending if attempts are left.
    """
    over = F.col("outcome").isin("success", "already_missing", "failed")
    rows = attempts.filter(F.col("attempt") <= max_attempts).groupBy(*KEY)
    sums = rows.agg(
        F.min_by(F.when(over, F.col("outcome")), F.when(over, F.col("attempt"))).alias("ended"),
        F.min(F.when(over, F.col("attempt"))).alias("at"),
        F.max("attempt").alias("last"),
    )
    left = F.when(F.col("last") >= max_attempts, "failed").otherwise("pending")
    return sums.select(*KEY, F.coalesce("ended", left).alias("outcome"), F.coalesce("at", "last").alias("attempts"))


def apply_results(entries: DataFrame, edges: DataFrame, results: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, edges, removed) after actions ended: the last result of each object is its ``action``.

    ``results`` has the key, ``kind, outcome, at, attempt`` and, if there are some, ``error`` and ``path``. The
    record is ``success`` or ``already_missing``, else ``failed`` with its error and whether it may be
    tried again; it takes the place of the one before, and tags stay as they are. Of what a purge ended
    or found missing the entry's own name goes: it loses a link, or is removed with its last one.
    """
    text = lambda c: F.col(c) if c in results.columns else F.lit(None).cast("string")
    last = results.groupBy(*KEY).agg(F.max_by(F.struct("kind", "outcome", "at", text("error").alias("error"), text("path").alias("path")), "attempt").alias("_r"))
    ok = F.col("_r.outcome").isin("success", "already_missing")
    failed = ~ok
    record = F.struct(
        F.col("_r.kind").alias("kind"), F.when(ok, F.col("_r.outcome")).otherwise("failed").alias("state"), F.when(failed, F.col("_r.error")).alias("error"),
        F.when(failed, F.col("_r.outcome") == "retryable").alias("retryable"), F.col("_r.path").alias("path"), F.col("_r.at").alias("updated_at"),
    )
    noted = entries.join(last, list(KEY), "left")
    hit = F.col("_r").isNotNull()
    done = cut(noted.filter((F.col("_r.kind") == "purge") & ok).select("filesystem_id", "parent_id", "name", "object_id"))
    noted = noted.withColumns({"action": F.when(hit, record).otherwise(F.col("action")), "last_seen": F.when(hit, F.lit(now)).otherwise(F.col("last_seen"))})
    return unlink(noted.select(*entries.columns), edges, done, now)


def retry_queue(results: DataFrame, max_attempts: int = 3) -> DataFrame:
    """``(key, kind, attempts, error)`` of objects whose last attempt may be repeated, and that have attempts left."""
    error = F.col("error") if "error" in results.columns else F.lit(None).cast("string")
    last = results.groupBy(*KEY).agg(F.max_by(F.struct("kind", "outcome", error.alias("error")), "attempt").alias("r"), F.max("attempt").alias("attempts"))
    return last.filter((F.col("r.outcome") == "retryable") & (F.col("attempts") < max_attempts)).select(*KEY, "r.kind", "attempts", "r.error")


# Thresholds ----------------------------------------------------------------------


def measure(entries: DataFrame, policies: list[Policy], stripes: DataFrame | None = None) -> DataFrame:
    """``(policy, type, high, value, fires)`` of all count and volume policies, in one pass over the catalog."""
    parsed = [(p, parse_trigger(p.trigger)) for p in policies]
    parsed = [(p, t) for p, t in parsed if t["type"] in ("count", "volume")]
    flags, sums = {}, []
    for i, (p, t) in enumerate(parsed):
        flags[f"_p{i}"] = (F.col("filesystem_id") == p.filesystem) & to_column(p.scope(), stripes=stripes)
        value = F.lit(1) if t["type"] == "count" else F.col("size")
        sums.append(F.coalesce(F.sum(F.when(F.col(f"_p{i}"), value)), F.lit(0)).cast("long").alias(f"v{i}"))
    needed = reduce(Column.__or__, flags.values(), F.lit(False)) if stripes is None else F.lit(True)
    # A filter below the flags lets what all policies share reach the scan.
    rows = entries.filter(needed).withColumns(flags).agg(*sums)
    out = F.array(
        *(
            F.struct(F.lit(p.name).alias("policy"), F.lit(t["type"]).alias("type"), F.lit(t["high"]).cast("long").alias("high"), F.col(f"v{i}").alias("value"))
            for i, (p, t) in enumerate(parsed)
        )
    )
    return rows.select(F.explode(out).alias("x")).select("x.*").withColumn("fires", F.col("value") >= F.col("high"))


def full_target(ost_usage: DataFrame, high: int, target: Target = Target()) -> DataFrame:
    """The first storage target in table order that is ``high`` percent full or more; no row if none is."""
    rows = ost_usage
    if target.kind == "ost":
        rows = rows.filter(F.col("ost_index").isin(list(target.value)))
    elif target.kind == "pool":
        rows = rows.filter(F.col("name").startswith(target.value))
    elif target.kind in ("user", "group", "projid"):
        rows = rows.filter(F.lit(False))
    rows = rows.filter((F.col("total") > 0) & (100.0 * F.col("used") / F.col("total") >= high))
    return rows.agg(F.min_by(F.struct("ost_index", "name", "used", "total"), "ost_index").alias("x")).filter("x IS NOT NULL").select("x.*")


def fs_percent(ost_usage: DataFrame, high: int) -> DataFrame:
    from .reports import fs_usage

    return fs_usage(ost_usage).withColumn("fires", F.col("percent") >= high)


def due(policies: DataFrame, fire_log: DataFrame, now: int) -> DataFrame:
    """Policies (name, next_check, cooldown) that may be checked now: their time has come and no cooldown runs."""
    last = fire_log.groupBy("name").agg(F.max("fired_at").alias("fired_at"))
    waits = F.coalesce(F.lit(now) < F.col("fired_at") + F.col("cooldown"), F.lit(False))
    return policies.join(last, "name", "left").filter((F.col("next_check") <= now) & ~waits)
