"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from treeward.llm import bpe, chat, common, copies, decontam, html, langid, licenses, lines, quality, queries, rules, simhash, wordhash

from ..conftest import SMALL
from ..oracle import same

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def docs(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


ODD = [None, "", " \n\t ", "one", "one two", "a b c", "a b c", "x " * 5000, "ÄÖ ß 漢字 🙂\n\n", "\x00"]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.SQL[name], SMALL)


def test_null_conversation_is_formatted_like_others(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b#"), (1, 0, "user", "c"), (1, None, "system", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.tree: [tuple(t) for t in r.turns] for r in chat.read_back(chat.formatted(chat.linear(df))).collect()}
    assert out == {None: [("user", "a"), ("assistant", "b#")], 1: [("system", ""), ("user", "c")]}


# Components ----------------------------------------------------------------------


def find_groups(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, 500 + i) for i in range(1, 200)]
    pairs = chain + star + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(150)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = find_groups([p for p in pairs if p[0] != p[1]])
    assert got == want
    assert common.components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


# SimHash -------------------------------------------------------------------------


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts():
    rng = random.Random(5)
    base = prose(rng, 400).split(" ")
    texts = []
    for _ in range(60):  # a large group of near copies
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice(WORDS)
        texts.append(" ".join(t))
    return texts + [prose(rng, 300) for _ in range(30)] + ODD + texts[:5]


def test_simhash_equals_brute_force(spark):
    texts = near_texts()
    got = simhash.near_duplicates(docs(spark, texts, fp=1, id=2, component=3)).collect()
    fps = [slow_fingerprint(t) for t in texts]
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in enumerate(fps)}
    groups = find_groups([(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert {r.doc_id: r.component_id for r in got} == {i: groups.get(i, i) for i in range(len(texts))}
    kept = simhash.keep_one(docs(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({groups.get(i, i) for i in range(len(texts))})


def test_blocks_cover_all_near_pairs():
    rng = random.Random(2)
    for blocks in (5, 6):
        masks = simhash.block_masks(blocks, 3)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for _ in range(3):
                b ^= 1 << rng.randrange(64)
            assert any((a ^ b) & m & (2**64 - 1) == 0 for m in masks)


def test_near_components_of_dense_fingerprints(spark):
    rng = random.Random(7)
    fps = list({rng.getrandbits(12) << rng.choice((0, 20, 40)) for _ in range(300)})
    nodes = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "id long, fp long")
    got = {r.id: r.component for r in simhash.near_components(nodes).collect()}
    want = find_groups([(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert got == want


def test_unrelated_fingerprints_of_one_block(spark):
    """Thousands agree in half of their bits and are no nearer, but for a few."""
    rng = random.Random(22)
    half = sum(1 << b for b in range(32))
    fps = [rng.getrandbits(32) << 32 | 0x5A5A5A5A for _ in range(3000)]
    fps += [f ^ (1 << rng.randrange(32, 64)) ^ (1 << rng.randrange(64)) for f in fps[:20]]
    assert all(f & half for f in fps)
    nodes = spark.createDataFrame([(i, f - (1 << 64) * (f >> 63)) for i, f in enumerate(fps)], "id long, fp long")
    got = {r.id: r.component for r in simhash.near_components(nodes).collect()}
    a = np.array(fps, dtype=np.uint64)
    near = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3) + i + 1]
    assert len(near) >= 20 and got == find_groups(near)


def test_no_blocks_through_the_driver(spark, monkeypatch):
    """Twenty rows come of a fingerprint, and Spark sizes them as one: they are not broadcast, nor rows that meet each other."""
    plans = {}

    def planned(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return common.staged(df, name)

    monkeypatch.setattr(simhash, "staged", planned)
    rng = random.Random(3)
    fps = list({rng.getrandbits(12) << rng.choice((0, 20, 40)) for _ in range(300)})
    nodes = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "id long, fp long").localCheckpoint()
    simhash.near_components(nodes)
    assert {"members", "grouped", "rest"} <= plans.keys()
    assert not [name for name, plan in plans.items() if "Broadcast" in plan]


def test_simhash_empty_and_repeated(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    twice = docs(spark, ["a b c d", "e f g h"]).unionByName(docs(spark, ["a b c d"]))
    nulls = twice.withColumn("doc_id", F.when(F.col("doc_id") == 1, None).otherwise(F.col("doc_id")))
    assert sorted((r.doc_id is None, r.component_id) for r in simhash.near_duplicates(nulls).collect()) == [(False, 0), (False, 0), (True, None)]


def test_near_copies_equal_brute_force(spark):
    import corpus_pipeline

    rng = random.Random(17)
    texts = [*ODD]
    for n in (8, 40, 150, 400):
        for _ in range(4):
            base = prose(rng, n).split()
            for _ in range(8):
                t = list(base)
                for _ in range(rng.randrange(1 + n // 25)):
                    t[rng.randrange(n)] = rng.choice(WORDS)
                texts.append(" ".join(t))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert any(len(sets[i] & sets[j]) < 0.9 * len(sets[i] | sets[j]) for i, j in pairs)
    groups = find_groups(pairs)
    got = {r.doc_id: r.component_id for r in copies.near_copies(docs(spark, texts)).collect()}
    assert got == {i: groups.get(i, i) for i in range(len(texts))}
    kept = corpus_pipeline.near_dedup(spark, docs(spark, texts), SMALL)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))
    assert copies.near_copies(docs(spark, [])).count() == 0


def test_blocks_of_fingerprints_find_near_sets():
    """SimHashes, bit by bit, and their blocks at a Jaccard similarity of 0.8."""
    rng = np.random.default_rng(5)
    own = np.unique(rng.integers(0, 1 << 63, 37, dtype=np.uint64))
    mask, want = (1 << 64) - 1, []
    for part in range(1, copies.PARTS + 1):
        mixed = []
        for x in map(int, own):
            z = (x + part * 0x9E3779B97F4A7C15) & mask
            z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
            mixed.append(z ^ (z >> 31))
        want.append(sum(1 << b for b in range(64) if 2 * sum(z >> b & 1 for z in mixed) > len(mixed)))
    # The bytes keep their places; the bits of a byte may be turned round.
    turned = [sum((x >> (8 * (b // 8) + 7 - b % 8) & 1) << b for b in range(64)) for x in want]
    assert copies.fingerprint(own).tolist() in (want, turned)
    places, found, far = copies.choices(200_000), 0, 0
    for k in range(600):
        n = int(rng.integers(20, 400))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[n // 9 :], rng.integers(0, 1 << 63, n // 9, dtype=np.uint64)])
        c = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        prints = np.stack([copies.fingerprint(x) for x in (a, b, c)])
        keys = copies.blocks(prints, places)
        differ = int(prints[0, 0] ^ prints[1, 0]).bit_count()
        found += bool((keys[0] == keys[1]).any()) and differ <= copies.DIFFER
        far += bool((keys[0] == keys[2]).any()) and int(prints[0, 0] ^ prints[2, 0]).bit_count() <= copies.DIFFER
    assert found >= 0.985 * 600 and far <= 1, (found, far)


# Lines ---------------------------------------------------------------------------


def test_lines(spark):
    rng = random.Random(3)
    a, b = prose(rng, 60), prose(rng, 60)
    near = a.replace(a.split()[30], "changed", 1)
    texts = [f"{a}\nshort line\n{b}", f"{near}\n{a.upper()}!\nshort line", f"{b}\nown {prose(rng, 20)}", None, "", f"{b}\n{b}"]
    rows = docs(spark, texts, line=1, key=2, rid=3)
    got = {r.doc_id: r.text for r in lines.dedup_lines(rows).collect()}
    assert got[0] == texts[0]
    assert got[1] == ""
    assert got[2] == texts[2].split("\n")[1] and got[3] is None and got[4] == "" and got[5] == ""
    out = lines.dedup_lines(rows)
    assert out.columns == rows.columns and out.filter("n_chars <> length(text)").count() == 0
    assert lines.dedup_lines(docs(spark, [])).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_equal_brute_force(spark):
    rng = random.Random(11)
    bases = [prose(rng, rng.choice((6, 20, 80))).split() for _ in range(12)]
    texts = []
    for _ in range(40):
        own = []
        for _ in range(3):
            t = list(rng.choice(bases))
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = rng.choice(WORDS)
            own.append(" ".join(t))
        texts.append("\n".join(own))
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs(spark, texts)).collect()}
    at = [(d, i, x.split()) for d, t in enumerate(texts) for i, x in enumerate(t.split("\n"))]
    link = lambda x, y: x == y or edit_distance(x, y) <= int(max(len(x), len(y)) * 0.2)
    pairs = [(i, j) for i, j in itertools.combinations(range(len(at)), 2) if link(at[i][2], at[j][2])]
    groups = find_groups(pairs)
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if groups.get(3 * d + i, 3 * d + i) == 3 * d + i) for d, t in enumerate(texts)}
    assert got == want


def test_long_lines_of_one_passage_are_told_apart(spark):
    """Sets of words, not the shared passage alone, say which long lines are compared."""
    rng = random.Random(23)
    passage = [f"passage{k}" for k in range(8)]
    own = [[f"{rng.getrandbits(40):x}" for _ in range(40)] for _ in range(6)]
    own.append([*own[0][:-4], "a", "b", "c", "d"])
    texts = [" ".join(passage + x) for x in own]
    rows = lines.with_rid(docs(spark, texts), "doc_id", "text")
    prints = lines.line_prints(rows, 1, 0.8)
    facts = common.staged(lines.line_texts(rows, prints, prints.select(F.col("key").alias("id"))), "facts")
    other = facts.toDF(*(f"{c}_b" for c in facts.columns))
    pairs = facts.crossJoin(other).filter("id < id_b").filter(lines.alike(0.8)(F.col, lambda c: F.col(f"{c}_b")))
    assert facts.count() == 7 and pairs.count() == 1


def test_small_groups_meet_once_and_large_ones_lose_no_link(spark):
    """All pairs of four ids are tried in one search; ids that share more find every link, and the hubs' pairs do not come back."""
    rng = random.Random(29)
    own = [rng.getrandbits(62) for _ in range(60)]
    at = {x: k for k, x in enumerate(own)}
    rows = [(key, x) for key in (1, 2, 3) for x in own[:4]] + [(key, x) for key in (4,) for x in own[4:]]
    place = spark.createDataFrame(list(at.items()), "id long, place long")
    seen = []

    def facts_of(ids):
        return place.join(ids, "id", "left_semi")

    def linked(x, y):
        return {x, y} <= set(range(4, 60)) and abs(x - y) == 7

    def verify(pairs):
        got = [(r.a, r.b) for r in pairs.collect()]
        seen.append(got)
        return spark.createDataFrame([p for p in got if linked(at[p[0]], at[p[1]])], "a long, b long")

    close = lambda a, b: F.abs(a("place") - b("place")) <= 20
    small = common.key_components(spark.createDataFrame(rows[:12], "key long, id long"), verify, close, facts_of)
    assert small.count() == 0 and [len(x) for x in seen] == [6]
    seen.clear()
    got = common.key_components(spark.createDataFrame(rows, "key long, id long"), verify, close, facts_of).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.component, set()).add(at[r.id])
    assert sorted(map(sorted, groups.values())) == sorted(sorted(range(k, 60, 7)) for k in range(4, 11))
    assert len(seen) == 2 and not set(seen[0]) & set(seen[1])


def test_very_long_lines(spark):
    rng = random.Random(12)
    many = " ".join(f"{rng.getrandbits(60):015x}" for _ in range(200_000))
    words = [f"{rng.getrandbits(60):015x}" for _ in range(20_000)]
    near, far = list(words), list(words)
    for k in rng.sample(range(20_000), 3_000):
        near[k] = "changed"
    for k in rng.sample(range(20_000), 6_000):
        far[k] = "changed"
    texts = [many, f"own\n{many}", " ".join(words), " ".join(near), " ".join(far), "a b c d e"]
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs(spark, texts)).collect()}
    assert got == {0: many, 1: "own", 2: texts[2], 3: "", 4: texts[4], 5: texts[5]}


def test_recall_of_line_search(spark):
    """Pairs just within the similarity are found, whatever their length."""
    rng = random.Random(19)
    texts = []
    for n in range(4, 130):
        for _ in range(3):
            t = base = prose(rng, n).split()
            t = list(t)
            for _ in range(int(n * 0.2) if n > 4 else 0):
                at = rng.randrange(len(t))
                t[at : at + rng.randrange(2)] = rng.choice(([], [rng.choice(WORDS)], [rng.choice(WORDS)]))
            texts += [" ".join(base), " ".join(t)]
    near = [k for k in range(0, len(texts), 2) if edit_distance(texts[k].split(), texts[k + 1].split()) <= int(max(texts[k].count(" "), texts[k + 1].count(" ")) * 0.2 + 0.2 + 1e-9)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs(spark, texts)).collect()}
    found = sum(got[k + 1] == "" for k in near)
    assert len(near) > 250 and found >= 0.99 * len(near), (found, len(near))


def test_whole_lines_equal_brute_force(spark):
    """All links of the edit similarity, without fingerprints."""
    rng = random.Random(13)
    bases = [prose(rng, n).split() for n in (4, 5, 6, 7, 9, 12, 20, 34, 80) for _ in range(3)]
    bases.append("a a a a a a a a a b".split())
    texts = []
    for _ in range(60):
        own = []
        for _ in range(3):
            t = list(rng.choice(bases))
            for _ in range(rng.randrange(1 + len(t) // 4)):
                at = rng.randrange(len(t))
                t[at : at + rng.randrange(2)] = rng.choice(([], [rng.choice(WORDS)]))
            own.append(" ".join(t))
        texts.append("\n".join(own))
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs(spark, texts), min_words=4).collect()}
    at = [x.split() for t in texts for x in t.split("\n")]
    link = lambda x, y: x == y or edit_distance(x, y) <= int(max(len(x), len(y)) * 0.2 + 1e-9)
    pairs = [(i, j) for i, j in itertools.combinations(range(len(at)), 2) if min(len(at[i]), len(at[j])) >= 4 and link(at[i], at[j])]
    groups = find_groups(pairs)
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if groups.get(3 * d + i, 3 * d + i) == 3 * d + i) for d, t in enumerate(texts)}
    assert got == want


def test_short_lines_and_scripts_without_spaces(spark):
    rng = random.Random(16)
    han = "".join(chr(0x4E00 + rng.randrange(9000)) for _ in range(40))
    near = han[:20] + chr(0x4E00) + han[21:]
    kana, thai = "".join(chr(0x3042 + k % 60) for k in range(30)), "".join(chr(0x0E01 + k % 40) for k in range(30))
    texts = [f"All rights reserved\nown one\n\n{han}\n{thai}", f"all rights reserved.\nown two\n\n{near}\n{kana}", f"{kana}\n{thai}\n\nown one two"]
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs(spark, texts)).collect()}
    assert got == {0: texts[0], 1: f"own two\n\n{kana}", 2: "\nown one two"}


# Rules ---------------------------------------------------------------------------


def slow_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    full = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(map((text or "").count, "#*$%&|<>")), len(full) - len(set(full)), len(covered)


def test_rules(spark):
    rng = random.Random(4)
    period = " ".join(rng.choice(WORDS) for _ in range(40))
    texts = [t for t in ODD if t != ODD[7]] + [prose(rng, 120), f"{period} {period} {prose(rng, 100)}", "a b c d " * 40, "x\ty\x0bz\r\nq #|& <>\n\nq #|& <>", " ".join(map(str, range(100))) + " 1 2 3 4"]
    rows = docs(spark, texts, n_words=9, kept=True, base_failed=1).unionByName(docs(spark, texts[:2], n_words=9, kept=True, base_failed=1))
    got = rules.rules(rows).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_stats(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert rules.rules(docs(spark, [])).count() == 0
    passing = rules.keep_passing(rows)
    assert passing.columns == rows.columns and {r.doc_id for r in passing.collect()} == {r.doc_id for r in got if r.kept}


def test_bad_host_takes_its_documents(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 60 if host != "bad" or i % 10 == 0 else 5), "en", host, 0) for host in ("good", "fine", "bad", None) for i in range(30)]
    got = rules.rules(spark.createDataFrame(rows, DOC)).groupBy("base_failed", "kept").count().collect()
    assert {(r.base_failed, r.kept): r["count"] for r in got} == {(False, True): 90, (True, False): 27, (False, False): 3}


# Chat ----------------------------------------------------------------------------


def test_chat_trees(spark):
    rows = [
        ("t", 1, None, "user", "hi", 1.0), ("t", 2, 1, "assistant", "a", 0.2), ("t", 3, 1, "assistant", r"b \# </turn> ### user: x", 0.9),
        ("t", 4, 3, "user", None, 0.9), ("t", 5, 99, None, "orphan", 0.1), ("c", 1, 2, "user", "ring", 1.0), ("c", 2, 1, "user", "ring", 1.0),
    ]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    out = chat.read_back(chat.formatted(nodes, top=2)).orderBy("rank").collect()
    assert [(r.tree, r.leaf, r["rank"]) for r in out] == [("t", 4, 1), ("t", 2, 2)]
    assert [(t.role, t.text) for t in out[0].turns] == [("user", "hi"), ("assistant", rows[2][4]), ("user", "")]
    assert out[0].loss_text == rows[2][4] and out[1].loss_text == "a"
    assert chat.formatted(nodes.limit(0)).count() == 0


def test_long_and_repeated_conversations(spark):
    rng = random.Random(8)
    marks = ["\\", "#", "</turn>", "\n", "### ", ": ", "x", "\\#", "é", "\\/"]
    rows = [(1, i, rng.choice(("user", "assistant", "a:b")), "".join(rng.choice(marks) for _ in range(rng.randrange(12)))) for i in range(150)]
    rows += [(2, 0, "user", "same"), (2, 0, "user", "same"), (3, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(5))
    got = {r.tree: r for r in chat.read_back(chat.formatted(chat.linear(turns))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2], r[3]) for r in rows[:150]]
    assert got[1].loss_text == "".join(r[3] for r in rows[:150] if r[2] == "assistant")
    assert len(got[2].turns) == 2 and [(t.role, t.text) for t in got[3].turns] == [("", "")]


def test_no_paths_through_the_driver(spark):
    """Tables of nodes are small as files however many rows they have, so they are not broadcast."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for c in range(20) for t in range(9)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.formatted(chat.linear(turns))
    assert out.count() == 20
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


# BPE -----------------------------------------------------------------------------


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    pool = "aabbethingr's'''!!??--..  \n\té漢字🙂İΣßﬁ①²٣5 \x1c"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(80))) for _ in range(300)]
    texts += [*ODD[1:], "Hello  world's 123", "a<|endoftext|> b<|startoftext|>", "supercalifragilistic" * 30, "z" * 3000]
    path = queries.vocabulary()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    got = {r.doc_id: r for r in bpe.encode(docs(spark, [*texts, None]), path).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == library.decode(ids, skip_special_tokens=False)
    assert got[len(texts)].ids == [] and got[len(texts)].decoded == ""
    row = bpe.digests(docs(spark, ["Hello world"]), path).first()
    assert row.ids_sha256 == hashlib.sha256(np.array(library.encode("Hello world").ids, dtype="<u4").tobytes()).hexdigest()
    assert bpe.digests(docs(spark, []), path).count() == 0


def test_bpe_ways_agree():
    b = bpe.Bpe(queries.vocabulary(), cache=50)
    rng = random.Random(10)
    words = ["".join(rng.choice("aeithnsrol") for _ in range(rng.randrange(1, 70))) for _ in range(400)]
    exact = [b.merged(w + bpe.END) for w in words]
    assert b.merged_all(words) == exact
    for w, e in zip(words, exact, strict=True):
        pairs = np.array(e)
        assert b.compatible(pairs[:-1], pairs[1:]).all(), w
    assert [np.frombuffer(i, "<u4").tolist() for i, _ in b.encode_all(words)] == exact


# Decontamination -----------------------------------------------------------------


def slow_align(p, w):
    best, rows = 0, [[0] * (len(p) + 1)]
    for x in w:
        row = [0]
        for j, y in enumerate(p):
            row.append(max(0, rows[-1][j] + (2 if x == y else -1), rows[-1][j + 1] - 1, row[j] - 1))
        rows.append(row)
        best = max(best, max(row))
    return best


def test_decontamination(spark):
    rng = random.Random(12)
    items = [prose(rng, n) for n in (40, 25, 8, 2)] + [None, ""]
    edited = items[0].split()
    for i in range(3, 40, 6):
        edited[i] = "other"
    texts = [f"{prose(rng, 200)} {items[0]} {prose(rng, 50)}", f"{prose(rng, 30)} {' '.join(edited)}", prose(rng, 500), f"{items[1].upper()}!", *ODD, f"x {items[2]} y {items[2]}"]
    frame = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for size in (decontam.BLOCK_GRAMS, 30):
        found = decontam.contaminated(docs(spark, texts, item_id=4, words=1), frame, block_grams=size).collect()
        assert {(r.doc_id, r.item_id) for r in found} == {(0, 0), (1, 0), (3, 1), (4 + len(ODD), 2)}
        spans = {(r.doc_id, r.item_id): (r.start_word, r.end_word, round(r.score, 3)) for r in found}
        assert spans[0, 0] == (200, 240, 1.0) and spans[1, 0][:2] == (30, 69)  # the last word is edited
    clean = decontam.keep_clean(docs(spark, texts), frame)
    assert {r.doc_id for r in clean.collect()} == {2, *range(4, 4 + len(ODD))}
    words = [wordhash.word_hashes(t) for t in texts]
    for r in found:
        own = wordhash.word_hashes(items[r.item_id])
        assert round(slow_align(words[r.doc_id].tolist(), own.tolist()) / (2 * len(own)), 6) == round(r.score, 6)
    assert decontam.contaminated(docs(spark, []), frame).count() == 0
    assert decontam.contaminated(docs(spark, texts), frame.limit(0)).count() == 0


def test_common_phrases_bring_nothing_together(spark):
    rng = random.Random(20)
    items = spark.createDataFrame([(i, f"which of the following {prose(rng, 20)}") for i in range(400)], "item_id long, text string")
    texts = docs(spark, [f"{prose(rng, 30)} which of the {prose(rng, 30)}" for _ in range(500)])
    grams = common.staged(decontam.item_grams(decontam.item_words(items)), "grams")
    rows = texts.select("doc_id", "text")
    seeds = decontam.rare(grams, decontam.counts(rows, grams))
    phrase = wordhash.ngrams(wordhash.word_hashes("which of the"), 3).view(np.int64)[0]
    assert grams.filter(F.col("gram") == int(phrase)).count() == 400 and seeds.filter(F.col("gram") == int(phrase)).count() == 0
    assert 2 * seeds.count() >= grams.count() and decontam.contaminated(texts, items).count() == 0


def test_recall_of_edited_copies(spark):
    """All copies that align as a whole are found, a word of three, four or five changed, lost or put in."""
    rng = random.Random(21)
    items = [prose(rng, n) for n in (12, 20, 30, 45, 60) for _ in range(4)]
    texts, where = [], []
    for k, item in enumerate(items):
        for step in (3, 4, 5):
            for edit in (lambda w: ["other"], lambda w: [], lambda w: [w, "more"]):
                words = [x for i, w in enumerate(item.split()) for x in (edit(w) if i % step == step - 1 else [w])]
                texts.append(f"{prose(rng, 40)} {' '.join(words)} {prose(rng, 40)}")
                where.append(k)
    want = set()
    for d, k in enumerate(where):
        own, text = wordhash.word_hashes(items[k]).tolist(), wordhash.word_hashes(texts[d]).tolist()
        if slow_align(text, own) >= len(own):
            want.add((d, k))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert len(want) > 150 and len(got & want) >= 0.98 * len(want), (len(got & want), len(want))
    assert got <= want | {(d, k) for d, k in got if slow_align(wordhash.word_hashes(texts[d]).tolist(), wordhash.word_hashes(items[k]).tolist()) >= items[k].count(" ") + 1}


def test_texts_that_are_not_utf8(spark):
    rows = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("cast(X'6F6E65FF2074776F' as string)").alias("text"))
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert decontam.contaminated(rows, items).count() == 0
    assert copies.near_copies(rows).count() == 1 and simhash.near_duplicates(rows).count() == 1
    assert licenses.license_spans(rows).count() == 0 and bpe.encode(rows, queries.vocabulary()).count() == 1


def test_hot_passage(spark):
    rng = random.Random(13)
    item = prose(rng, 30)
    texts = [f"{prose(rng, 20)} {item}" for _ in range(60)] + [prose(rng, 50) for _ in range(30)]
    found = decontam.contaminated(docs(spark, texts), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id for r in found.collect()} == set(range(60))


def test_word_hashes_of_segments():
    text = " ".join(f"w{i}" for i in range(120_000))
    words = wordhash.word_hashes(text)
    assert len(words) == len(set(words.tolist())) == 120_000
    assert (wordhash.word_hashes("W5, w77!") == words[[5, 77]]).all()


# Licenses ------------------------------------------------------------------------


def test_bpe_equals_the_library_on_every_character():
    import unicodedata

    import tokenizers

    library, own = tokenizers.Tokenizer.from_file(queries.vocabulary()), bpe.load(queries.vocabulary())
    for start in range(0, 0x110000, 0x8000):
        texts = [f"b{chr(c)}b {chr(c)}{chr(c)} {chr(c)}1" for c in range(start, start + 0x8000) if unicodedata.category(chr(c)) not in ("Cs", "Co")]
        if texts:
            want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
            assert [ids for ids, _ in own.encode_all(texts)] == want


def test_every_notice_gets_its_own_name():
    """All notices by exhaustive containment over every window of their length, also damaged, among near ones."""
    rng = random.Random(12)
    t = licenses.Templates()
    sets = [set(g.tolist()) for g in t.sets]
    texts, want = [], []
    for k, (_, notice) in enumerate(licenses.NOTICES):
        for damage in (0, 1, 2, 5):
            words = notice.split(" ")
            for _ in range(damage * len(words) // 20):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(f"{prose(rng, rng.randrange(40))} {' '.join(words)} {prose(rng, 30)}")
            grams = wordhash.ngrams(wordhash.word_hashes(texts[-1]), licenses.SHINGLE).tolist()
            held = {}
            for name, own in zip(t.names, sets, strict=True):
                size = 5 * len(own) // 4 + 1
                share = max(len(own & set(grams[i : i + size])) for i in range(max(1, len(grams) - size + 1))) / len(own)
                held[name] = max(share, held.get(name, 0))
            top = max(held.values())
            # Who is found must hold enough and as much as any other.
            want.append({n for n, s in held.items() if s == top} if top >= 0.8 else set())
            assert damage or want[-1] == {t.names[k]}
    got = {}
    for i, name, *_ in t.scan(texts):
        got.setdefault(i, set()).add(name)
    assert all(bool(got.get(i)) == bool(w) and len(got.get(i, ())) <= 1 and got.get(i, set()) <= w for i, w in enumerate(want))


def test_licenses(spark):
    rng = random.Random(14)
    notice = licenses.NOTICES[1][1]
    cut = notice.split()
    cut[20] = "something"
    texts = [prose(rng, 300), f"{prose(rng, 77)}. {licenses.NOTICES[0][1]} {prose(rng, 9)}", f"{prose(rng, 10)} {notice}", " ".join(cut), *ODD, f"{licenses.NOTICES[7][1]}\n{prose(rng, 40)}\n{licenses.NOTICES[7][1]}"]
    got = sorted((r.doc_id, r.license, r.start_word, r.end_word) for r in licenses.license_spans(docs(spark, texts, license=1)).collect())
    last = 4 + len(ODD)
    assert [g[:2] for g in got] == [(1, "MIT"), (2, "MIT"), (3, "MIT"), (last, "CC-BY-NC-4.0"), (last, "CC-BY-NC-4.0")]
    assert got[0][2:] == (77, 82) and got[3][2:] == (0, 7)
    assert licenses.license_spans(docs(spark, [])).count() == 0


def test_retrieval_misses_nothing():
    rng = random.Random(15)
    t = licenses.Templates()
    for _ in range(40):
        k = rng.randrange(len(licenses.NOTICES))
        words = wordhash.word_hashes(f"{prose(rng, rng.randrange(200))} {licenses.NOTICES[k][1]} {prose(rng, rng.randrange(200))}")
        grams = wordhash.ngrams(words, licenses.SHINGLE)
        hits = {x for x, a, b in t.retrieve(grams, np.array([len(grams)])) if t.verify(x, grams[a:b])}
        assert k in hits
    assert licenses.collision(0.2) > 0.999


# Language ------------------------------------------------------------------------


def test_language(spark):
    rng = random.Random(16)
    kinds = {"aa": "the and of ing with that".split(), "bb": "der und nicht ein schon auf".split(), "cc": "les une dans que pour eau".split()}
    make = lambda k: " ".join(rng.choice(kinds[k]) + rng.choice(("", rng.choice(kinds[k]))) for _ in range(rng.randrange(5, 80)))
    rows = [(i, make(k), k, "s", 0) for i, k in enumerate(rng.choice(list(kinds)) for _ in range(400))]
    df = spark.createDataFrame(rows, DOC)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.train(df.filter(~held))
    found = langid.identify(df.filter(held), model).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97 and all(0 <= r.score <= 1 for r in found)
    odd = langid.identify(docs(spark, [None, "", "123 !?", "the and of"], lang_pred=1, score=2), model).collect()
    assert [r.lang_pred for r in sorted(odd)] == ["und", "und", "und", "aa"]
    none = langid.train(df.limit(0))
    assert {r.lang_pred for r in langid.identify(docs(spark, ["the"]), none).collect()} == {"und"}


def test_pieces_of_long_texts():
    text = "ab cde " * 100_000
    whole = langid.bag(text)
    assert whole[1].sum() >= 100_000 * 10 and set(langid.bag("ab cde ab cde")[0]) >= set(whole[0])


# Quality -------------------------------------------------------------------------


def test_trees_equal_a_plain_walk():
    rng = np.random.default_rng(17)
    x = rng.normal(size=(500, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 1)).astype(float)
    model = quality.fit(x, y, trees=20)
    score = model.score(x)
    assert ((score > 0.5) == y).mean() > 0.97
    for row, s in zip(x[:50], score[:50], strict=True):
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += v[node - len(f)]
        assert abs(1 / (1 + np.exp(-total)) - s) < 1e-12


def test_quality(spark):
    rng = random.Random(18)
    texts = [prose(rng, 100) if i % 2 else " ".join(w + "***" for w in prose(rng, 100).split()) for i in range(200)] + ODD
    df = docs(spark, texts, score=1, quality=2)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(1, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    got = {r.doc_id: r for r in quality.classify(df, labels, learn).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].predicted == i % 2 for i in held)
    assert {r.score for r in quality.classify(df.limit(3), labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs(spark, []), labels).count() == 0


# HTML ----------------------------------------------------------------------------


def page(i, body, extra=""):
    links = "".join(f'<li><a href="/{k}">menu {k}</a></li>' for k in range(1 + i % 3))
    return f'<!DOCTYPE html><html><head><title>t{i}</title><script>var a="</p>";</script></head><body><nav><ul>{links}</ul></nav><!-- x --><div class="ad">buy {i}</div><article>{body}</article>{extra}<footer>&copy; {i}</footer></body></html>'


def test_html(spark):
    bodies = {
        1: ("<h1>T &amp; x</h1><p><b>One.<br><p>two\n  words</p><p></p>", "T & x\nOne.\ntwo words"),
        2: ("<h1>A&nbsp;B</h1><div class='comments'><p>no</p></div><p>yes <i>it</i> is</p><aside>no</aside>", "A B\nyes it is"),
        3: ("plain &lt;b&gt; &am", "plain <b> &am"),
        4: ("<p>same</p><form>no</form><p>same</p><script>no</script>", "same\nsame"),
        5: ("", ""),
    }
    rows = [(i, "http://h.example/x", page(i, b, '<section id="comments"><p>reader</p></section>')) for i, (b, _) in bodies.items()]
    rows += [(6, None, None), (7, "", ""), (8, "http://one.example/", "<p>bare<p>page"), (9, "http://two.example/", "<article><p>cut of"), (10, "x", "</div></p>< a <b")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()}
    for i, (_, text) in bodies.items():
        assert got[i] == text, (i, got[i])
    assert got[6] == got[7] == "" and got[8] == "bare\npage" and got[9] == "cut of" and got[10] == "< a <b"
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_decides(spark):
    """No element or class says what is menu or article: only that the one is the same on all pages."""
    rng = random.Random(23)
    body = [prose(rng, 30) for _ in range(30)]
    make = lambda i: f'<html><body class="has-sidebar"><div class="top">Home About us</div><div class="x">{body[i]}<div class="y">Share it</div></div><div class="btm">Copyright, all rights</div></body></html>'
    rows = [(i, "http://a.example/p", make(i)) for i in range(30)] + [(99, "http://b.example/", make(3)), (100, None, make(4)), (None, "http://a.example/q", None)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in range(30)} == dict(enumerate(body))
    assert got[99] == body[3] and got[100] == body[4] and got[None] == ""
    alone = html.extract(spark.createDataFrame(rows[30:31], "page_id long, url string, html string")).first()
    assert alone.text == f"Home About us\n{body[3]}\nShare it\nCopyright, all rights"
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").limit(50).collect()
    assert sum(html.main_text(r.html) != t.text for r, t in zip(pages, [x for x in queries.op7_html_extraction(spark, SMALL).collect() if x.page_id in {p.page_id for p in pages}], strict=True)) > 25


def test_classes_equal_brute_force(spark):
    rng = random.Random(24)
    pages = []
    for i in range(12):
        parts = [f'<div class="{c}">{prose(rng, 3)}</div>' * rng.choice((1, 1, n)) for c, n in (("a", 1), ("b", 2), ("c", 3)) if rng.random() < 0.9]
        pages.append((i, f"http://h{i % 2}.example/", f"<html><body>{''.join(parts)}<article><h1>{i}</h1><p>{prose(rng, 40)}</p></article></body></html>"))
    frame = spark.createDataFrame(pages, "page_id long, host string, html string").withColumn("host", F.regexp_extract("host", "//([^/]*)", 1))
    got = {r.host: (sorted(r.slots), sorted(r.constant)) for r in html.templates(frame).filter(F.col("host") != html.ALL).collect()}
    import pandas as pd

    for host in ("h0.example", "h1.example"):
        per = {}
        for i, url, page in pages:
            if host in url:
                for t in html.tokens(page):
                    per.setdefault(t[0], {})[i] = t
        rows = []
        for t, on in per.items():
            if len(on) >= html.SUPPORT and all(x[3] == 1 for x in on.values()):
                rows.append({"token": t, "parent": on[min(on)][1], "kind": on[min(on)][2], "on": len(on), "letters": sum(x[4] for x in on.values()), "constant": len({x[5] for x in on.values()}) == 1 and len(on) >= html.CONSTANT})
        want = html.article_slots(pd.DataFrame([r for r in rows if r["letters"] or len(per) > 1]))
        assert got[host] == (sorted(want[0]), sorted(want[1]))


def test_long_and_deep_pages_end_soon(spark):
    import time

    began = time.monotonic()
    assert html.main_text('<a "' * 200_000) == '<a "' * 200_000
    assert html.main_text('<a x="' * 200_000 + ">") == ""
    assert html.main_text("<div>" * 100_000 + "x" + "</i>" * 100_000) == "x"
    assert html.main_text("<b>" * 100_000 + "<p>x" * 1000).count("x") == 1000
    assert len(html.tokens("<div>" * 100_000 + "x")) == 100_000
    assert html.main_text("<p>" + "word " * 500_000) == ("word " * 500_000).strip()
    assert time.monotonic() - began < 60


def test_html_of_the_tables(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r.text for r in queries.op7_html_extraction(spark, SMALL).collect()}
    import html as entities

    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


# Pipeline ------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    docs_in = spark.read.parquet(f"{SMALL}/documents.parquet")
    now = docs_in
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = common.staged(stage(spark, now, SMALL), "stage")
        assert now.columns == docs_in.columns
    want = bpe.digests(now, queries.vocabulary())
    got = corpus_pipeline.run(spark, SMALL)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(got) == key(want)
    ids = {r.doc_id for r in now.select("doc_id").collect()}
    leaks = {r.doc_id for r in decontam.contaminated(now, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert not ids & leaks and 0 < len(ids) < docs_in.count()
