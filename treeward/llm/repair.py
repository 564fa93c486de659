"""Repair of conversations' structure by the lightest derivation.

A conversation is well formed if the initials of its roles are ``(s?(ua)+)?``. Whatever
turns it has, edits make it so: each turn is kept, gets another role or is deleted, and
empty turns may be put in. Repairs are deductions in a weighted hypergraph. An item says
that a span of turns leads from one state of that pattern to another; its weight is a
cost and an audit, the edits' initials, least first. Joining an item with the edit of
the next turn, or with the item of the next span, adds costs and appends audits, which
is monotone and never lighter than what was joined, so Knuth's agenda pops each item
once, with its lightest weight, until the goal is popped.

All turns are put in one order and cut into blocks of 256, whatever the conversations'
lengths. Each block derives its own spans; conversations that reach over blocks join
their spans, 64 at a time, in as many rounds as it takes. So a conversation with a third
of all rows is never in one task, but for its own audit, which is one value.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import staged

#: States of the pattern: nothing yet, after the system turn, after a user's, after an assistant's.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
#: The role that a turn gets or that is put in, by state, and the state after it.
ROLE = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL = ("su", "ua", "au")
BLOCK, SPANS = 8, 6  # bits: 256 turns a block, 64 spans a round
SPACE = r"\x20\x09-\x0D"

Edits = dict[int, list[tuple[int, int, str]]]


def edits(initial: str, delete: bool, truncated: bool) -> Edits:
    """By state, the ``(state after it, cost, audit)`` of all that may become of a turn."""
    out: Edits = {}
    more = TRUNCATED if truncated else 0
    for state, follow in NEXT.items():
        out[state] = [(state, DELETE, "D")]
        if not delete:
            out[state].append((ROLE[state][1], RENAME + more, "R"))
            if initial in follow:
                out[state].append((follow[initial], more, "K"))
    return out


def agenda(start: int, parts: list[Edits], insert: bool, close: bool) -> dict[int, tuple[int, str, list[int]]]:
    """By last state, the lightest ``(cost, audit, states before each part)`` from ``start`` over all parts.

    With ``insert``, empty turns may come before a part. With ``close``, also after the last,
    and the only result is the lightest one that ends the pattern.
    """
    heap: list[tuple] = [(0, "", 0, start, None)]
    done: dict[tuple[int, int], tuple] = {}
    out = {}
    while heap:
        cost, audit, at, state, before = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done[at, state] = before
        if at == len(parts):
            if not close or state in (0, 3):
                out[state] = (cost, audit, trace(done, at, state))
                if close:
                    break
            if not close:
                continue
        if insert:
            new = ROLE[state][1]
            if (at, new) not in done:
                heapq.heappush(heap, (cost + INSERT, audit + "I", at, new, (at, state)))
        if at < len(parts):
            for new, weight, letters in parts[at].get(state, ()):
                if (at + 1, new) not in done:
                    heapq.heappush(heap, (cost + weight, audit + letters, at + 1, new, (at, state)))
    return out


def trace(done: dict, at: int, state: int) -> list[int]:
    """The states in which the derivation of an item enters each part."""
    out = []
    while (before := done[at, state]) is not None:
        if before[0] < at:
            out.append(before[1])
        at, state = before
    return out[::-1]


def prepared(turns: DataFrame) -> DataFrame:
    """Turns in their order: ``(conv_id, turn, role, text, pos, block)``, ``pos`` counting all from 0, written down."""
    rows = turns.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    order = ["conv_id", "turn", "role", "text", "rid"]
    rows = rows.withColumn("rid", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = staged(rows.drop("rid").withColumn("at", F.monotonically_increasing_id()), "turns")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    # One number for each partition of the sort.
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, offsets = 0, []
    for r in counts:
        offsets.append((r.part, before))
        before += r.n
    known = turns.sparkSession.createDataFrame(offsets, "part long, before long")
    rows = rows.withColumn("part", part).join(F.broadcast(known), "part").withColumn("pos", F.col("before") + row)
    return rows.select("conv_id", "turn", "role", "text", "pos", F.shiftright("pos", BLOCK).alias("block"))


def faults(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, initial, fault, pos, block)``: each turn's first fault of ``blank``, ``duplicate``, ``truncated``."""
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    first = rows.groupBy("conv_id", same.alias("same")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    ended = F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    slim = rows.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), ended.alias("ended"), "pos", "block")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("ended"), "truncated")
    return slim.join(first, "pos", "left").select("conv_id", "turn", "initial", fault.alias("fault"), "pos", "block")


ITEM = "array<struct<start:int,end:int,cost:bigint,audit:string,cuts:array<struct<block:bigint,state:int,letters:int>>>>"
FACTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, low bigint, high bigint, first string, last string"


def span_schema(conv: T.DataType) -> T.StructType:
    known = T.StructType.fromDDL(f"block bigint, whole boolean, items {ITEM}, {FACTS}")
    return T.StructType([T.StructField("conv_id", conv), *known.fields])


def item(start: int, end: int, cost: int, audit: str, cuts: list[dict]) -> dict:
    return {"start": start, "end": end, "cost": cost, "audit": audit, "cuts": cuts}


def block_spans(arrow: pa.Schema):
    """What each conversation's turns in a block come to: its items and facts."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos").to_pylist()
        out, s = [], 0
        while s < len(rows):
            e = s
            while e < len(rows) and rows[e]["conv_id"] == rows[s]["conv_id"]:
                e += 1
            part, block = rows[s:e], rows[s]["block"]
            # Neighbours in the block show that the conversation begins, or ends, here.
            whole = s > 0 and e < len(rows)
            options = [edits(r["initial"], r["fault"] in ("blank", "duplicate"), r["fault"] == "truncated") for r in part]
            items = []
            for start in (0,) if s > 0 else NEXT:
                for end, (cost, audit, _) in sorted(agenda(start, options, True, whole).items()):
                    items.append(item(start, end, cost, audit, [{"block": block, "state": start, "letters": len(audit)}]))
            known = [r["turn"] for r in part if r["turn"] is not None]
            pairs = [a["initial"] + b["initial"] for a, b in zip(part, part[1:], strict=False)]
            count = {f: sum(r["fault"] == f for r in part) for f in ("blank", "duplicate", "truncated")}
            out.append(
                {"conv_id": part[0]["conv_id"], "block": block, "whole": whole, "items": items, **count, "illegal": sum(p not in LEGAL for p in pairs), "turns": len(set(known)),
                 "low": min(known, default=None), "high": max(known, default=None), "first": part[0]["initial"], "last": part[-1]["initial"]}
            )
            s = e
        return pa.Table.from_pylist(out, schema=arrow)

    return run


def join_spans(rows: list[dict], close: bool) -> dict:
    """Neighbouring spans of one conversation as one."""
    parts: list[Edits] = []
    cuts = []
    for r in rows:
        part: Edits = {}
        for x in r["items"]:
            part.setdefault(x["start"], []).append((x["end"], x["cost"], x["audit"]))
            cuts.append(((len(parts), x["start"], x["end"]), x["cuts"]))
        parts.append(part)
    cuts = dict(cuts)
    items = []
    for start in (0,) if close else NEXT:
        for end, (cost, audit, states) in sorted(agenda(start, parts, False, False).items()):
            way = [*states, end]
            own = [c for i in range(len(parts)) for c in cuts[i, way[i], way[i + 1]]]
            items.append(item(start, end, cost, audit, own))
    out = dict(rows[0])
    for r in rows[1:]:
        for c in ("blank", "duplicate", "truncated"):
            out[c] += r[c]
        out["illegal"] += r["illegal"] + (out["last"] + r["first"] not in LEGAL)
        out["turns"] += r["turns"] - (out["high"] is not None and out["high"] == r["low"])
        out["low"] = r["low"] if out["low"] is None else out["low"]
        out["high"] = out["high"] if r["high"] is None else r["high"]
        out["last"] = r["last"]
    return out | {"items": closed(items) if close else items, "whole": close}


def closed(items: list[dict]) -> list[dict]:
    """The lightest item from the start that the turns put in at its end complete."""
    ways = []
    for x in items:
        state, cost, audit = x["end"], x["cost"], x["audit"]
        while state not in (0, 3):
            state, cost, audit = ROLE[state][1], cost + INSERT, audit + "I"
        ways.append(x | {"end": state, "cost": cost, "audit": audit})
    best = min(ways, key=lambda x: (x["cost"], x["audit"]))
    last = best["cuts"][-1]
    return [best | {"cuts": [*best["cuts"][:-1], last | {"letters": last["letters"] + len(best["audit"]) - sum(c["letters"] for c in best["cuts"])}]}]


def spans_joined(arrow: pa.Schema, close: bool, bits: int):
    """``join_spans`` for a group of a round."""

    def run(table: pa.Table) -> pa.Table:
        joined = join_spans(table.sort_by("block").to_pylist(), close)
        return pa.Table.from_pylist([joined | {"block": joined["block"] >> bits}], schema=arrow)

    return run


def spans(rows: DataFrame) -> DataFrame:
    """Each conversation's lightest derivation and facts, a row each."""
    conv = rows.schema["conv_id"].dataType
    schema = span_schema(conv)
    arrow = to_arrow_schema(schema)
    found = staged(rows.groupBy("block").applyInArrow(block_spans(arrow), schema), "spans")
    parts = found.filter("NOT whole")
    first = parts.groupBy("conv_id").agg(F.min("block").alias("begin"))
    parts = parts.withColumnRenamed("conv_id", "own").join(first, F.col("own").eqNullSafe(F.col("conv_id"))).drop("own")
    parts = parts.withColumn("block", F.col("block") - F.col("begin")).select(*schema.names)
    most = parts.agg(F.max("block")).first()[0]
    while most is not None:
        close = most >> SPANS == 0
        # Items of a group keep the cuts of all blocks below it, whose numbers stay.
        parts = parts.groupBy("conv_id", F.shiftright("block", SPANS).alias("span")).applyInArrow(spans_joined(arrow, close, SPANS), schema)
        if close:
            break
        parts, most = staged(parts, "spans"), most >> SPANS
    return found.filter("whole").unionByName(parts)


def report(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, cuts)`` of conversations that have turns."""
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    best = F.col("items")[0]
    return rows.select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", best["cost"].alias("cost"), best["audit"].alias("audit"), best["cuts"].alias("cuts"))


def edited(arrow: pa.Schema):
    """The turns of a block after its part of the audits."""

    def run(rows: pa.Table, audits: pa.Table) -> pa.Table:
        ways = {a["conv_id"]: (a["state"], a["audit"]) for a in audits.to_pylist()}
        out, at = [], {}
        for r in rows.sort_by("pos").to_pylist():
            conv = r["conv_id"]
            state, audit = ways[conv]
            i = at.get(conv, 0)
            new = []
            while audit[i] == "I":
                new.append(("I", None, *ROLE[state][:1], ""))
                state, i = ROLE[state][1], i + 1
            if audit[i] == "R":
                new.append(("R", r["turn"], ROLE[state][0], r["text"]))
                state = ROLE[state][1]
            elif audit[i] == "K":
                new.append(("K", r["turn"], r["role"], r["text"]))
                state = NEXT[state][r["role"][:1]]
            i += 1
            if audit[i:].strip("I") == "":  # what is put in after the last turn
                while i < len(audit):
                    new.append(("I", None, *ROLE[state][:1], ""))
                    state, i = ROLE[state][1], i + 1
            ways[conv], at[conv] = (state, audit), i
            out += [{"conv_id": conv, "pos": r["pos"], "sub": n, "edit": e, "turn": t, "role": role, "text": text} for n, (e, t, role, text) in enumerate(new)]
        return pa.Table.from_pylist(out, schema=arrow)

    return run


def cut_audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits as a row for each block that they reach over."""
    for b in batches:
        for r in b.to_pylist():
            at, out = 0, []
            for c in r["cuts"]:
                out.append({"conv_id": r["conv_id"], "block": c["block"], "state": c["state"], "audit": r["audit"][at : at + c["letters"]]})
                at += c["letters"]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([b.schema.field("conv_id"), ("block", pa.int64()), ("state", pa.int32()), ("audit", pa.string())]))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, repaired) of ``turns(conv_id, turn, role, text)``.

    ``report`` has what ``report`` gives, for conversations with a turn; ``repaired`` the turns
    that are left and those put in, ``(conv_id, pos, sub, edit, turn, role, text)``, in the order of
    ``pos, sub``. A conversation's turns go by turn, nulls first, then role and text. Null roles
    and texts count as one space, a null conversation is one like others. Of turns with equal
    role and text the first stays. Empty tables give empty ones; long texts are only hashed and
    searched; columns of other names are not looked at.
    """
    rows = prepared(turns)
    done = staged(report(spans(faults(rows))), "report")
    conv = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    cuts = done.select("conv_id", "audit", "cuts").mapInArrow(cut_audits, T.StructType([conv, *T.StructType.fromDDL("block bigint, state int, audit string").fields]))
    turn = T.StructField("turn", rows.schema["turn"].dataType)
    schema = T.StructType([conv, *T.StructType.fromDDL("pos bigint, sub int, edit string").fields, turn, *T.StructType.fromDDL("role string, text string").fields])
    out = rows.groupBy("block").cogroup(cuts.groupBy("block")).applyInArrow(edited(to_arrow_schema(schema)), schema)
    return done, out


def digests(repaired: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of the repaired ``role:text``, newline-joined; a digest runs over one conversation's rows in order, a batch at a time."""
    rows = repaired.select("conv_id", "pos", "sub", F.concat("role", F.lit(":"), "text").alias("line"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "sub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out = None, None, []
        field = None
        for b in batches:
            field = b.schema.field("conv_id")
            for conv, line in zip(b["conv_id"].to_pylist(), b["line"].to_pylist(), strict=True):
                if digest is not None and conv == now:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        out.append({"conv_id": now, "repaired_sha256": digest.hexdigest()})
                    now, digest = conv, hashlib.sha256()
                digest.update(line.encode())
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([field, ("repaired_sha256", pa.string())]))
            out = []
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": now, "repaired_sha256": digest.hexdigest()}], schema=pa.schema([field, ("repaired_sha256", pa.string())]))

    conv = T.StructField("conv_id", repaired.schema["conv_id"].dataType)
    return rows.mapInArrow(run, T.StructType([conv, T.StructField("repaired_sha256", T.StringType())]))


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults by the checksum of ``conv_id:turn``, modulo 20: 0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it a user's. Nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("n")).drop("n")


def repaired_conversations(original: DataFrame, turns: DataFrame) -> DataFrame:
    """``report`` without cuts and the digest, for every conversation of ``original``; those without turns have zeros and empty values."""
    done, rows = repair(turns)
    every = original.select(F.col("conv_id").alias("_own")).distinct()
    other = digests(rows).withColumnRenamed("conv_id", "_its")
    out = every.join(done, F.col("_own").eqNullSafe(F.col("conv_id")), "left").join(other, F.col("_own").eqNullSafe(F.col("_its")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("_own").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
