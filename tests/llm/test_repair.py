"""Conversation repair against exhaustive search, over blocks of any size, and on odd input."""

import functools
import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F
from treeward.llm import queries, repair

from ..oracle import duck

TURNS = "conv_id long, turn long, role string, text string"


def fault_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(rows):
    """(cost, audit, repaired) by trying every edit, up to two insertions at a place."""
    kinds = fault_of(rows)
    fits = lambda roles: re.fullmatch("(s?(ua)+)?", roles) is not None
    prefix = {re.fullmatch("(s?(ua)*u?)?", "s" * s + ("ua" * 9)[:n]) and "s" * s + ("ua" * 9)[:n] for s in (0, 1) for n in range(19)}

    @functools.cache
    def go(i, roles):
        """All (cost, audit, lines) from row i on, least first by cost and audit."""
        best = None
        for new in ("", "u", "a", "ua", "au"):
            at = roles + new
            if at not in prefix or len(at) > 16:
                continue
            put = tuple({"u": "user:", "a": "assistant:"}[c] for c in new)
            if i == len(rows):
                ways = [(0, "", ())] if fits(at) else []
            else:
                _, role, text = rows[i]
                more = 3 if kinds[i] == "truncated" else 0
                ways = [(4, "D", (), at)]
                if kinds[i] not in ("blank", "duplicate"):
                    ways += [(more, "K", (f"{role}:{text}",), at + role[:1])] if role else []
                    ways += [(3 + more, "R", (f"{r}:{text}",), at + r[0]) for r in ("user", "assistant")]
                ways = [(c + x[0], a + x[1], ln + x[2]) for c, a, ln, to in ways if to in prefix and (x := go(i + 1, to))]
            for c, a, ln in ways:
                found = (c + 3 * len(new), "I" * len(new) + a, put + ln)
                if best is None or found[:2] < best[:2]:
                    best = found
        return best

    return go(0, "")


def facts(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    known = [r[0] for r in rows if r[0] is not None]
    kinds = fault_of(rows)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    cost, audit, lines = cheapest(tuple(rows))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


ROLES = ["system", "user", "assistant", "user", "assistant", "tool", "", " ", "sage"]
TEXTS = ["One.", "Two!", "Three?", "open", "", " \t", "Four. \n", "ünï 漢", "One."]


def mixed(rng, n):
    rows = []
    for conv in range(n):
        for _ in range(rng.randrange(1, 7)):
            rows.append((conv if conv else None, rng.choice([None, *range(5)]), rng.choice(ROLES), rng.choice(TEXTS)))
    return rows


def check(spark, rows):
    df = spark.createDataFrame(rows, TURNS).withColumns({"pos": F.lit("x"), "block": F.lit(None), "text2": F.lit(1)})
    got = {r.conv_id: tuple(r)[1:] for r in repair.repaired_conversations(df, df).collect()}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert got == {conv: facts(turns) for conv, turns in by.items()}


def test_repairs_are_the_cheapest(spark):
    rng = random.Random(4)
    check(spark, [*mixed(rng, 80), (500, None, None, None), (500, 1, "user", None), (501, 1, "user", "x" * 200_000 + "."), (501, 2, "assistant", "y" * 200_000)])


def test_repairs_over_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 1)  # two turns a block, two spans a round
    monkeypatch.setattr(repair, "SPANS", 1)
    check(spark, mixed(random.Random(5), 40))


def test_one_long_conversation_equals_its_sql(spark, tmp_path):
    rng = random.Random(6)
    rows = [(7, i, rng.choice(["user", "assistant"]), f"text {i}{rng.choice(['.', '!', '', '.'])}") for i in range(700)]
    rows += [(8, i, ["user", "assistant"][i % 2], f"t{i % 40}.") for i in range(60)] + [(9, 0, "system", "a.")]
    spark.createDataFrame(rows, TURNS).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    ours = sorted(map(str, queries.op13_conversation_repair(spark, str(tmp_path)).collect()))
    db = duck("/root/testdata/sf0.001")
    db.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = db.execute(queries.SQL["op13_conversation_repair"])
    names = [d[0] for d in found.description]
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    got = [r.asDict() for r in queries.op13_conversation_repair(spark, str(tmp_path)).collect()]
    assert len(ours) == 3
    assert sorted(got, key=lambda r: r["conv_id"]) == sorted(want, key=lambda r: r["conv_id"])


def test_damage(spark):
    rows = [(c, t, "assistant", "Is it? Yes!") for c in (None, *range(30)) for t in (None, 0, 1)]
    got = sorted(map(tuple, repair.damaged(spark.createDataFrame(rows, TURNS)).collect()), key=str)
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else "Is it Yes" if kind == 2 else text)
        want += [] if kind == 0 else [row] * (2 if kind == 3 else 1)
    assert got == sorted(want, key=str)


def test_no_turns(spark):
    none = spark.createDataFrame([], TURNS)
    assert repair.repaired_conversations(none, none).collect() == []
    some = spark.createDataFrame([(1, 1, "user", "a.")], TURNS)
    assert tuple(repair.repaired_conversations(some, none).first()) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
