"""Values of single operators on small tables."""

import random

import pytest
from pyspark.sql import functions as F
from treeward.functions import columns as C
from treeward.operators import apply, changelog, classify, find, namespace, policy, reports, sets
from treeward.operators.predicate import all_of, any_of, cmp, negated, to_column
from treeward.sources import catalog, fixtures
from treeward.sources.schema import ENTRY

NOW = 1_000_000


def entry_rows(spark, *rows):
    base = dict.fromkeys(ENTRY.names)
    base |= {"filesystem_id": "a", "object_kind": 0, "kind": 0, "size": 0, "nlink": 1, "uid": 0, "gid": 0, "last_seen": 0, "depth": 0, "name": "", "xattr": {}}
    return spark.createDataFrame([tuple((base | r)[c] for c in ENTRY.names) for r in rows], ENTRY)


def values(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# Arguments ---------------------------------------------------------------------


def test_size_arguments():
    assert find.size_predicate("+1M") == cmp("size", "gt", 1 << 20)
    assert find.size_predicate("-10") == cmp("size", "lt", 10)
    assert find.size_predicate("2G") == cmp("size", "eq", 2 << 30)
    with pytest.raises(ValueError):
        find.size_predicate("big")


def test_time_arguments():
    assert find.time_predicate("mtime", "+1h", NOW) == cmp("mtime", "lt", NOW - 3600)
    assert find.time_predicate("mtime", "-2", NOW) == cmp("mtime", "gt", NOW - 2 * 86400)
    assert find.time_predicate("atime", "1y", NOW) == cmp("atime", "le", NOW - 365 * 86400)


def test_when():
    assert find.parse_when("atime < -90d, size > 1GB", NOW) == all_of(cmp("atime", "lt", NOW - 90 * 86400), cmp("size", "gt", 1 << 30))
    for bad in ("colour > 1", "size >", "atime < -3w", ""):
        with pytest.raises(ValueError):
            find.parse_when(bad, NOW)


def test_triggers():
    assert policy.parse_trigger("2h") == {"type": "interval", "seconds": 7200}
    assert policy.parse_trigger("cron:0 2 * * *") == {"type": "cron", "cron": "0 0 2 * * *"}
    assert policy.parse_trigger("volume>100GB")["high"] == 100 << 30
    assert policy.parse_trigger("ost>80%") == {"type": "ost_percent", "high": 80, "check_interval": 300, "low": 0, "cooldown": 0}
    for bad in ("fs>0%", "fs>101%", "count>x", "cron:1 2", ""):
        with pytest.raises(ValueError):
            policy.parse_trigger(bad)


def test_globs(spark):
    df = spark.createDataFrame([("a.txt",), ("ab.txt",), ("a.TXT",), ("b^.txt",), ("x\ny",)], "n string")
    of = lambda g: values(df.filter(C.glob_filter("n", [g])), "n")
    assert of("?.txt") == [("a.txt",)]
    assert of("[b^]*.txt") == [("b^.txt",)]
    assert of("x*") == [("x\ny",)]
    assert C.glob_to_like("a*b?c%_") == r"a%b_c\%\_"


# Columns -----------------------------------------------------------------------


def test_ids(spark):
    df = spark.createDataFrame([("[0x200000401:0x1a:0x0]",), ("200000401:1a:0",), ("nonsense",)], "t string").select(C.fid_from_text("t").alias("f"))
    assert [r[0] for r in df.select(F.hex("f")).collect()] == ["00000002000004010000001A00000000"] * 2 + [None]
    assert df.select(C.fid_to_text("f")).first()[0] == "[0x200000401:0x1a:0x0]"
    one = spark.range(1).select(C.inode_bytes(F.lit(42)).alias("b"), C.fid_bytes(F.lit(1), F.lit(2), F.lit(3)).alias("f"))
    assert one.select(C.inode_from_bytes("b"), F.hex("f")).first() == (42, "00000000000000010000000200000003")


def test_text_helpers(spark):
    row = spark.range(1).select(
        C.percent_decoded(F.lit("a%2Cb+c")), C.percent_decoded(F.lit("%zz")), C.rendered("{path} {size} {other}", {"path": "/x", "size": F.lit(3)}),
        C.human_bytes(F.lit(512)), C.human_bytes(F.lit(1536)), C.human_bytes(F.lit(5 << 30)),
    ).first()
    assert tuple(row) == ("a,b+c", None, "/x 3 {other}", "512 B", "1.50 KiB", "5.00 GiB")


def test_maps(spark):
    df = spark.range(1).select(F.expr("map('a', '1', 'b', '2')").alias("m"), F.expr("map('b', '3')").alias("n"))
    assert df.select(C.merged("m", "n"), C.retagged("m", ["a"], F.col("n"))).first() == ({"a": "1", "b": "3"}, {"b": "3"})


def test_hsm_patch(spark):
    rows = [(0, 0, 0, None), (3, 0, 0, "archived"), (4, 0, 0, "archived"), (0, 1, 22, None), (5, 0, 0, "released")]
    df = spark.createDataFrame(rows, "e int, f int, x int, s string")
    p = C.hsm_patch("e", "f", "x", "s")
    got = [tuple(r) for r in df.select(p["hsm_state"], p["hsm_dirty"], p["hsm_last_error"]).collect()]
    assert got == [("archived", False, None), ("released", False, None), ("none", False, None), (None, True, 22), ("released", False, None)]


# Predicates --------------------------------------------------------------------


def test_null_under_not(spark):
    df = entry_rows(spark, {"object_id": 1, "pool_name": "ssd"}, {"object_id": 2, "pool_name": "hdd"}, {"object_id": 3})
    p = negated({"op": "in_pool", "pool": "ssd"})
    assert values(df.filter(to_column(p)), "object_id") == [(2,)]
    assert values(df.filter(to_column(p, "match")), "object_id") == [(2,), (3,)]
    zero = cmp("stripe_count", "eq", 0)
    assert df.filter(to_column(zero)).count() == 0 and df.filter(to_column(zero, "match")).count() == 3


def test_predicate_errors(spark):
    for bad in (cmp("colour", "eq", 1), cmp("size", "eq", "big"), {"op": "near"}, {"op": "on_ost", "osts": [1]}):
        with pytest.raises(ValueError):
            to_column(bad)


def test_odd_leaves(spark):
    df = entry_rows(spark, {"object_id": 1, "name": "A%b", "xattr": {"user.tier": "hot", "n": "7"}}, {"object_id": 2, "name": "axb"})
    of = lambda p: values(df.filter(to_column(p)), "object_id")
    assert of({"op": "name_like", "pattern": r"A\%b"}) == [(1,)]
    assert of({"op": "iname_like", "pattern": "a%B"}) == [(1,), (2,)]
    assert of({"op": "name_regex", "pattern": "("}) == []
    assert of({"op": "xattr", "key": "n", "cmp": "gt", "value": 6}) == [(1,)]
    assert of({"op": "tags", "match_tags": {"user.tier": "hot"}}) == [(1,)]
    assert of(all_of()) == [(1,), (2,)] and of(any_of()) == []
    assert of({"op": "on_ost", "osts": []}) == []


# Reports and policies ----------------------------------------------------------


def test_size_profile(spark):
    sizes = [0, 1, 1023, 1024, (1 << 20) - 1, 1 << 20, 1 << 30]
    df = entry_rows(spark, *({"object_id": i, "size": s} for i, s in enumerate(sizes)), {"object_id": 99, "kind": 1, "size": 5})
    got = [(r.bucket, r["count"]) for r in reports.size_profile(df, "a").collect()]
    assert got == [("0", 1), ("<1K", 2), ("1K-1M", 2), ("1M-100M", 1), (">=1G", 1)]


def test_isolation(spark):
    df = entry_rows(spark, {"object_id": 1, "size": 5}, {"object_id": 1, "size": 7, "filesystem_id": "b"})
    assert reports.sum_size_where(df, "a").first()[0] == 5 and reports.sum_size_where(df, "c").first()[0] == 0


def test_candidates(spark):
    rows = [{"object_id": i, "size": 10, "atime": 100 - i, "nlink": 2 if i == 8 else 1} for i in range(10)]
    df = entry_rows(spark, *rows)
    p = policy.Policy("p", "a", lru="atime", max_count=5, max_volume=25, skip_hardlinked=True)
    got = [(r.object_id, r.decision) for r in policy.select_candidates(df, p).orderBy("position").collect()]
    assert got == [(9, "dispatch"), (8, "skipped_hardlink"), (7, "dispatch"), (6, "over_budget"), (5, "over_budget")]


def test_empty_usage(spark):
    none = spark.createDataFrame([], "ost_index long, name string, used long, total long")
    assert reports.fs_usage(none).first()["percent"] == 0.0
    assert policy.full_target(none, 10).count() == 0


def test_sweep(spark):
    old, new = 1_700_000_000, 1_900_000_000
    df = entry_rows(spark, *({"object_id": i, "last_seen": new if i < 2 else old, "kind": 1 if i == 4 else 0} for i in range(5)))
    edges = spark.createDataFrame([], "filesystem_id string, object_kind int, parent_id long, name string, object_id long")
    removed = df.limit(0).withColumn("rm_time", F.lit(0).cast("long"))
    assert sets.orphans(df, "a", 1_899_999_000).count() == 2
    left, _, gone = sets.sweep_orphans(df, edges, removed, "a", 1_899_999_000, NOW)
    assert values(left, "object_id") == [(0,), (1,), (4,)] and values(gone, "object_id", "rm_time") == [(2, NOW), (3, NOW)]


def test_classifier(spark):
    df = entry_rows(spark, {"object_id": 1, "size": 5, "xattr": {"k": "old", "x": "1"}}, {"object_id": 2, "size": 50, "xattr": {"k": "old"}})
    c = classify.Classifier("c", ("k",), (classify.Rule({"k": "big"}, "size > 10"), classify.Rule({"k": "?"}, "no such")))
    got = {r.object_id: r.xattr for r in classify.apply_classifier(df, c, NOW).collect()}
    assert got == {1: {"k": "old", "x": "1"}, 2: {"k": "big"}}
    assert classify.counters(df, c, NOW).first() == (2, 1)
    assert classify.validate(c) == ["not a condition: 'no such'"]
    assert classify.validate(classify.Classifier("", (), ())) == ["name is empty", "manages is empty", "rules is empty"]


def test_listing(spark):
    rows = [("/", 1, 1, 0), ("/a", 2, 1, 5), ("/a/x.tmp", 3, 0, 9), ("/skip", 4, 1, 5), ("/skip/y", 5, 0, 9), ("/a/old", 6, 0, 1), ("/a/b/c/d", 7, 0, 9)]
    df = spark.createDataFrame(rows, "path string, object_id long, kind int, mtime long")
    entries, edges = catalog.ingest_listing(df, "a", ["skip", "*.tmp"], since_mtime=4, max_depth=2)
    assert values(entries, "object_id", "depth", "name", "parent_id") == [(1, 0, "", None), (2, 1, "a", 1)]
    assert values(edges, "parent_id", "object_id") == [(1, 2)]


def test_ignore_file(spark, tmp_path):
    (tmp_path / "ignore").write_text("# no\n\n  *.o  \n.git\n")
    assert catalog.load_ignore(spark, str(tmp_path / "ignore"), ["x"]) == ["*.o", ".git", "x"]


# Namespace ---------------------------------------------------------------------


def tree(spark):
    rows = [(1, None, "", 0, 1), (2, 1, "a.txt", 1000, 0), (3, 1, "sub", 0, 1), (4, 3, "b.txt", 2000, 0), (5, 3, "c.txt", 3000, 0)]
    df = entry_rows(spark, *({"object_id": i, "parent_id": p, "name": n, "size": s, "kind": k, "depth": {1: 0, 2: 1, 3: 1}.get(i, 2)} for i, p, n, s, k in rows))
    return df, df.filter("parent_id IS NOT NULL").select("filesystem_id", "object_kind", "parent_id", "name", "object_id")


def test_subtree(spark):
    df, _ = tree(spark)
    roots = spark.createDataFrame([("a", 1), ("a", 3), ("a", 77)], "filesystem_id string, object_id long")
    assert values(namespace.subtree_totals(df, roots), "root", "n", "bytes") == [(1, 5, 6000), (3, 3, 5000), (77, 0, 0)]
    assert values(namespace.directory_sizes(df, "a"), "object_id", "n", "bytes") == [(1, 5, 6000), (3, 3, 5000)]


def brute_totals(rows):
    """Below each object, itself included, the rows and bytes of all objects that parents lead back to it."""
    kids, own, out = {}, {}, {}
    for o, parent, size in rows:
        kids.setdefault(parent, set()).add(o)
        own.setdefault(o, []).append(size)
    for o in own:
        inside, todo = {o}, [o]
        while todo:
            new = kids.get(todo.pop(), set()) - inside
            inside |= new
            todo += new
        out[o] = (sum(len(own[x]) for x in inside), sum(sum(own[x]) for x in inside))
    return sorted((o, *v) for o, v in out.items())


@pytest.mark.parametrize("tangled", [False, True])
def test_totals_below_equal_brute_force(spark, tangled):
    """Trees, chains, rings with trees on them, an object that is its own parent, parents that are not there; several parents."""
    rng = random.Random(9)
    rows = [(o, rng.choice([None, *range(1, 70)]), rng.randrange(100)) for o in range(1, 60)] + [(80, 80, 5), (81, 80, 6), (82, 81, 7)]
    rows += [(100 + i, 99 + i if i else 99, 1) for i in range(8)]
    if tangled:
        rows += [(o, rng.randrange(1, 60), 1) for o in (3, 7, 30)]
    df = entry_rows(spark, *({"object_id": o, "parent_id": p, "size": s} for o, p, s in rows))
    assert values(namespace.totals_below(df), "object_id", "n", "bytes") == sorted(brute_totals(rows), key=repr)


def test_sizes_of_folders_make_no_pairs(spark, monkeypatch):
    """``du`` of every path of a tree adds level by level and pairs no folder with what lies below it."""
    monkeypatch.delattr(namespace, "subtree_members")
    rows = [(1, None, 1), (2, 1, 2), (3, 2, 4), (4, 2, 8), (5, 1, 16)]
    names = {2: "a", 3: "x", 4: "y", 5: "b"}
    df = entry_rows(spark, *({"object_id": o, "parent_id": p, "size": s, "name": names.get(o, "")} for o, p, s in rows))
    edges = df.filter("parent_id IS NOT NULL").select("filesystem_id", "parent_id", "name", "object_id")
    paths = spark.createDataFrame([(f"/m{x}",) for x in ("", "/", "/a", "/a//x", "/a/y/", "/b", "/b", "/c", "/a/x/q", "/../b")], "path string")
    got = values(namespace.du(df, edges, paths, "a", 1, "/m"), "path", "n", "bytes")
    assert got == [("/m", 5, 31), ("/m/", 5, 31), ("/m/a", 3, 14), ("/m/a//x", 1, 4), ("/m/a/y/", 1, 8), ("/m/b", 1, 16), ("/m/b", 1, 16)]


def test_paths(spark):
    df, edges = tree(spark)
    more = spark.createDataFrame([("a", 0, 1, "hard", 4), ("a", 0, 99, "lost", 6), ("a", 0, 8, "r", 9), ("a", 0, 9, "r", 8), ("a", 0, 8, "leaf", 10)], edges.schema)
    df = df.unionByName(entry_rows(spark, *({"object_id": i, "kind": 1} for i in (6, 8, 9, 10))))
    got = values(namespace.full_paths(df, edges.unionByName(more), "a", 1), "object_id", "path", "status")
    want = [(1, "/", "ok"), (10, None, "missing_parent"), (2, "/a.txt", "ok"), (3, "/sub", "ok"), (4, "/hard", "ok"), (4, "/sub/b.txt", "ok"), (5, "/sub/c.txt", "ok"), (6, None, "missing_parent"), (8, None, "cycle"), (9, None, "cycle")]
    assert got == sorted(want, key=repr)
    paths = spark.createDataFrame([("/m/sub/b.txt",), ("/m",), ("/m/nope/x",), ("/other",), ("/m/../x",)], "path string")
    got = values(namespace.resolve_paths(edges, paths, "a", 1, "/m"), "path", "object_id", "status")
    assert got == sorted([("/m/sub/b.txt", 4, "ok"), ("/m", 1, "ok"), ("/m/nope/x", None, "stale"), ("/other", None, "rejected"), ("/m/../x", None, "rejected")], key=repr)


# Change stream -----------------------------------------------------------------


def events(spark, *rows):
    """(object, kind) or (object, kind, last_link) in order."""
    data = [("a", "s", 0, i, r[0], r[1], r[2] if len(r) > 2 else False) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "filesystem_id string, source string, batch_id long, idx long, object_id long, kind string, last_link boolean")


def survivors(spark, *rows):
    return sorted(r[0] for r in values(changelog.dedup(events(spark, *rows)), "idx"))


def test_dedup_rules(spark):
    assert survivors(spark, (1, "CREAT"), (1, "UNLNK", True)) == []
    assert survivors(spark, (1, "MKDIR"), (1, "RMDIR")) == []
    assert survivors(spark, (1, "CLOSE"), (1, "CLOSE")) == [0]
    assert survivors(spark, (1, "CLOSE"), (1, "MTIME")) == [0]
    assert survivors(spark, (1, "CLOSE"), (2, "CLOSE")) == [0, 1]
    assert survivors(spark, (1, "CREAT"), (1, "UNLNK", True), (1, "CREAT")) == [2]
    assert survivors(spark, (1, "CREAT"), (1, "RENME"), (1, "UNLNK", True)) == [0, 1, 2]
    assert survivors(spark, (1, "UNLNK", True), (1, "CREAT")) == [0, 1]
    assert survivors(spark, (1, "CREAT"), (1, "CREAT"), (1, "UNLNK", True)) == [0]
    assert survivors(spark, (1, "CREAT"), (1, "UNLNK", False)) == [0, 1]


def test_dedup_equals_a_plain_loop(spark):
    import random

    rng = random.Random(3)
    kinds = ["CREAT", "UNLNK", "MKDIR", "RMDIR", "RENME", "HLINK", "CLOSE", "TRUNC", "MTIME", "CTIME", "SATTR", "XATTR"]
    rows = [(rng.randrange(40), rng.choice(kinds), rng.random() < 0.7) for _ in range(1500)]
    kept, had, stacks, block = {}, {}, {}, {}
    for i, (obj, kind, last) in enumerate(rows):
        seen = had.setdefault(obj, set())
        if seen & set(changelog.MASKS.get(kind, ())):
            continue
        seen.add(kind)
        kept[i] = True
        files, dirs = stacks.setdefault(obj, ([], []))
        if kind in ("RENME", "HLINK"):
            block[obj] = i
        if kind == "CREAT":
            files.append(i)
        elif kind == "MKDIR":
            dirs.append(i)
        elif kind == "RMDIR" and dirs:
            kept.pop(i), kept.pop(dirs.pop())
        elif kind == "UNLNK" and last and files and files[-1] > block.get(obj, -1):
            kept.pop(i), kept.pop(files.pop())
    assert survivors(spark, *rows) == sorted(kept)


def test_text_records(spark):
    lines = [
        "1.0|SETATTR(42,1,0,1,1,420,0,1,1,0,0,1,0,0)|(1,2)", "2|MOVE(1,old%2Cname,2,new,0,0,0):7", "3.5|CREATE(1,f,5,6,2,493,0,0,0,0):9|(x)", "4|UNLINK(1,f,0,0,0):11", "4|UNLINK(1,f,0,0,0)",
        "bad", "1|CREATE(1,f,5,6,99,493,0,0,0,0):9", "1|WRITE(1,2)", "x|WRITE(1,0,0,0,0,0,0)", "1|INCR_COUNTER(a,b)", "1|NOSUCH(1)",
    ]
    good, bad = changelog.decode_text(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert values(good, "time", "change", "object_id", "src_name", "kind") == sorted([(1, "metadata_changed", 42, None, None), (2, "renamed", 7, "old,name", None), (3, "created", 9, None, 1), (4, "unlinked", 11, None, None)], key=repr)
    assert bad.count() == 6


def test_cursors(spark):
    old = spark.createDataFrame([("a", "s", 10)], "filesystem_id string, source string, position long")
    new = spark.createDataFrame([("a", "s", 7), ("a", "t", 3)], old.schema)
    assert values(changelog.commit(old, new), "source", "position") == [("s", 10), ("t", 3)]
    with pytest.raises(Exception, match="go back"):
        changelog.commit(old, new, strict=True).collect()


def test_baseline():
    assert changelog.next_baseline("scanning", 0, None) == "catching_up"
    assert changelog.next_baseline("catching_up", 1, True) == "catching_up"
    assert changelog.next_baseline("catching_up", 2, True) == "ready"
    assert changelog.next_baseline("catching_up", 2, False) == changelog.next_baseline("ready", 0, True, gap=True) == "invalid"
    assert changelog.next_baseline("invalid", 0, None) == "scanning"


def test_links_twice(spark):
    df, edges = tree(spark)
    link = spark.createDataFrame([("a", 0, 1, "hard", 4), ("a", 0, 1, "a.txt", 5), ("a", 0, 1, "ghost", 77)], edges.schema)
    for _ in range(2):
        df, edges, errors = apply.hardlink(df, edges, link, NOW)
    assert df.filter("object_id = 4").first().nlink == 2 and df.filter("object_id = 5").first().nlink == 1
    assert values(errors, "object_id", "error") == [(5, "name is taken"), (77, "unknown object")]
    gone = link.filter("name = 'hard'")
    df, edges, removed = apply.unlink(df, edges, gone, NOW)
    assert removed.count() == 0 and df.filter("object_id = 4").first().nlink == 1
    again = apply.unlink(df, edges, gone, NOW)
    assert again[0].filter("object_id = 4").first().nlink == 1 and again[2].count() == 0
    last = edges.filter("object_id = 4")
    assert values(apply.unlink(df, edges, last, NOW)[2], "object_id", "rm_time") == [(4, NOW)]


def test_rename_displaces(spark):
    df, edges = tree(spark)
    r = spark.createDataFrame([("a", 0, 4, 3, "c.txt", 3, "b.txt", 9, "s", 1)], "filesystem_id string, object_kind int, object_id long, parent_id long, name string, src_parent_id long, src_name string, time long, source string, idx long")
    state = apply.rename(apply.State(df, edges, df.limit(0).withColumn("rm_time", F.lit(0).cast("long"))), r, NOW)
    assert values(state.entries.filter("parent_id = 3"), "object_id", "name", "ctime") == [(4, "c.txt", 9)]
    assert values(state.edges.filter("parent_id = 3"), "object_id", "name") == [(4, "c.txt")]
    assert values(state.removed, "object_id") == [(5,)]


def plain_batch(entries, edges, events, observed=()):
    """``apply_batch`` one event after the other: ({id: (parent, name, nlink)}, {(parent, name): id}, {removed id: (parent, name, nlink, time)})."""
    entries, edges, removed = {k: list(v) for k, v in entries.items()}, dict(edges), {}

    def remove(o, time):
        if o in entries:
            removed[o] = (*entries.pop(o), time)
        for k in [k for k, v in edges.items() if v == o]:
            del edges[k]

    for e in sorted(events, key=lambda e: e["idx"]):
        o, at, change = e["object_id"], (e["parent_id"], e["name"]), e["change"]
        if change == "created":
            entries[o], edges[at] = [*at, 1], o
        elif change == "hardlinked" and o in entries and at not in edges:
            edges[at] = o
            entries[o][2] += 1
        elif change == "unlinked" and e["last_link"]:
            if o not in observed:
                remove(o, e["time"])
        elif change == "unlinked" and edges.get(at) == o:
            del edges[at]
            if o in entries:
                entries[o][2] -= 1
                if entries[o][2] < 1:
                    remove(o, e["time"])
        elif change == "renamed" and o in entries:
            if edges.get(at, o) != o:
                remove(edges[at], e["time"])
            src = (e["src_parent_id"], e["src_name"])
            if edges.get(src) == o:
                del edges[src]
            edges[at] = o
            entries[o][:2] = at
    return {k: tuple(v) for k, v in entries.items()}, edges, removed


EVENT = "filesystem_id string, source string, idx long, object_kind int, object_id long, change string, parent_id long, name string, src_parent_id long, src_name string, last_link boolean, time long, entry_kind int, uid long, gid long, mode long, hsm_event int, hsm_flags int, hsm_error int"


def event(idx, change, o, at, src=(None, None), last=False):
    return {"filesystem_id": "a", "source": "s", "idx": idx, "object_kind": 0, "object_id": o, "change": change, "parent_id": at[0], "name": at[1], "src_parent_id": src[0], "src_name": src[1], "last_link": last, "time": 100 + idx, "entry_kind": 0, "uid": 1, "gid": 1, "mode": 420}


def batch_result(spark, entries, edges, events):
    from treeward.sources import schema

    base = {"filesystem_id": "a", "object_kind": 0, "kind": 0, "size": 1, "ctime": 1}
    rows = [base | {"object_id": o, "parent_id": v[0], "name": v[1], "nlink": v[2]} for o, v in entries.items()]
    table = lambda rows, kind: spark.createDataFrame([tuple(r.get(f.name) for f in kind) for r in rows], kind)
    links = [{"filesystem_id": "a", "object_kind": 0, "parent_id": k[0], "name": k[1], "object_id": v} for k, v in edges.items()]
    kind = spark.createDataFrame([], EVENT).schema
    df = table(rows, schema.ENTRY)
    state = apply.State(df, table(links, schema.EDGE), df.limit(0).withColumn("rm_time", F.lit(0).cast("long")))
    out = apply.apply_batch(state, table(events, kind), spark.createDataFrame([], schema.OBSERVATION), NOW)
    got = {r.object_id: (r.parent_id, r.name, r.nlink) for r in out.entries.collect()}
    gone = out.removed.collect()
    assert len(gone) == len({r.object_id for r in gone})
    return got, {(r.parent_id, r.name): r.object_id for r in out.edges.collect()}, {r.object_id: (r.parent_id, r.name, r.nlink, r.rm_time) for r in gone}


def test_batch_rotates_names(spark):
    """log -> log.1, then log.tmp -> log; the object that was log stays under its new name."""
    entries, edges = {4: (1, "log", 1), 5: (1, "log.tmp", 1), 6: (1, "log.1", 1)}, {(1, "log"): 4, (1, "log.tmp"): 5, (1, "log.1"): 6}
    ev = [event(1, "renamed", 4, (1, "log.1"), (1, "log")), event(2, "renamed", 5, (1, "log"), (1, "log.tmp"))]
    got = batch_result(spark, entries, edges, ev)
    assert got == ({4: (1, "log.1", 1), 5: (1, "log", 1)}, {(1, "log.1"): 4, (1, "log"): 5}, {6: (1, "log.1", 1, 101)})
    assert got == plain_batch(entries, edges, ev)


def test_batch_unlinks_before_rename(spark):
    """A name that its object has left is free: the object keeps its other link."""
    entries, edges = {4: (1, "a", 2), 5: (1, "c", 1)}, {(1, "a"): 4, (1, "b"): 4, (1, "c"): 5}
    ev = [event(1, "unlinked", 4, (1, "a")), event(2, "renamed", 5, (1, "a"), (1, "c"))]
    got = batch_result(spark, entries, edges, ev)
    assert got == ({4: (1, "a", 1), 5: (1, "a", 1)}, {(1, "b"): 4, (1, "a"): 5}, {})
    assert got == plain_batch(entries, edges, ev)


def test_batch_of_links_that_fail(spark):
    """A link onto a taken name changes nothing: who took the name first may free it, and the next link gets it."""
    entries, edges = {4: (2, "a", 1), 5: (2, "b", 1), 6: (2, "c", 1)}, {(2, "a"): 4, (2, "b"): 5, (2, "c"): 6}
    ev = [event(i, what, o, (1, "lock")) for i, (what, o) in enumerate([("hardlinked", 4), ("hardlinked", 5), ("unlinked", 5), ("unlinked", 4), ("hardlinked", 6), ("hardlinked", 4)])]
    got = batch_result(spark, entries, edges, ev)
    assert got == ({4: (2, "a", 1), 5: (2, "b", 1), 6: (2, "c", 2)}, edges | {(1, "lock"): 6}, {})
    assert got == plain_batch(entries, edges, ev)


@pytest.mark.parametrize("seed", range(3))
def test_batch_equals_plain_loop(spark, seed):
    rng = random.Random(seed)
    entries = {o: (1, f"n{o}", 1) for o in range(10, 22)}
    edges = {(1, f"n{o}"): o for o in entries}
    now, held, ev, fresh = {o: {v[:2]} for o, v in entries.items()}, dict(edges), [], 100
    names = [(1, f"n{i}") for i in range(10, 30)]
    for idx in range(60):
        what, free = rng.choice(["created", "hardlinked", "unlinked", "renamed", "renamed"]), [n for n in names if n not in held]
        if what == "created" and free:
            at, fresh = rng.choice(free), fresh + 1
            ev.append(event(idx, what, fresh, at))
            held[at], now[fresh] = fresh, {at}
        elif what == "hardlinked" and free and held:
            at, o = rng.choice(free), rng.choice(sorted(held.values()))
            ev.append(event(idx, what, o, at))
            held[at] = o
            now[o].add(at)
        elif what == "unlinked" and held:
            at = rng.choice(sorted(held))
            o = held.pop(at)
            now[o].discard(at)
            ev.append(event(idx, what, o, at, last=not now[o]))
        elif what == "renamed" and held:
            src = rng.choice(sorted(held))
            o = held[src]
            # An object of several names is not displaced: its other names would outlive it on a real system.
            at = rng.choice([n for n in names if n not in held or len(now[held[n]]) == 1 and held[n] != o] or [src])
            ev.append(event(idx, what, o, at, src))
            if at in held:
                now[held[at]].discard(at)
            del held[src]
            held[at] = o
            now[o] = now[o] - {src} | {at}
    assert batch_result(spark, entries, edges, ev) == plain_batch(entries, edges, ev)


@pytest.mark.parametrize("seed", range(3))
def test_batch_of_anything_equals_plain_loop(spark, seed):
    """Records of objects that are gone, or never were, and of names that others hold; objects made again; several links displaced."""
    rng = random.Random(100 + seed)
    entries = {o: (1, f"n{o}", 1 + o % 2) for o in range(10, 18)}
    edges = {(1, f"n{o}"): o for o in entries} | {(2, f"m{o}"): o for o in entries if o % 2}
    names = [*edges, *((1, f"n{i}") for i in range(30, 34))]
    ev = []
    for idx in range(45):
        what = rng.choice(["created", "hardlinked", "unlinked", "unlinked", "renamed", "renamed", "renamed"])
        ev.append(event(idx, what, rng.choice([*range(10, 18), 50, 51]), rng.choice(names), rng.choice(names), last=what == "unlinked" and rng.random() < 0.4))
    assert batch_result(spark, entries, edges, ev) == plain_batch(entries, edges, ev)


def test_archive_truncate_release(spark):
    """A release that shows as a truncation, one that is told, errors, and objects without a state."""
    kind = spark.createDataFrame([], EVENT + ", detail string").schema
    rows = entry_rows(spark, *({"object_id": i, "hsm_state": s} for i, s in ((1, "archived"), (2, None), (3, "archived"), (4, "released"), (5, "archived"), (6, "archived"))))
    hsm = lambda idx, o, ev, err=0, flags=0: {**event(idx, "hsm_changed", o, (None, None)), "hsm_event": ev, "hsm_flags": flags, "hsm_error": err}
    cut_off = lambda idx, o: {**event(idx, "content_changed", o, (None, None)), "detail": "truncate"}
    ev = [hsm(1, 1, 0), cut_off(2, 1), cut_off(3, 2), hsm(4, 3, 3, 5, 1), hsm(5, 4, 4), cut_off(6, 4), cut_off(7, 5), cut_off(8, 6), hsm(9, 6, 0)]
    events = spark.createDataFrame([tuple(r.get(f.name) for f in kind) for r in ev], kind)
    seen = spark.createDataFrame([("a", 1, 9), ("a", 2, 9), ("a", 3, 9), ("a", 4, 9), ("a", 5, 0), ("a", 6, 8)], "filesystem_id string, object_id long, hsm_bits long")
    got = values(apply.apply_hsm(rows, events, seen), "object_id", "hsm_state", "hsm_last_op", "hsm_last_event_ts", "hsm_last_error")
    assert got == [(1, "released", "archive", 101, None), (2, None, None, None, None), (3, "archived", "release", 104, 5), (4, "none", "remove", 105, None), (5, "none", None, None, None), (6, "archived", "archive", 109, None)]


def test_batch_twice_is_once(spark):
    from .conftest import SMALL

    ev = changelog.normalize(changelog.dedup(fixtures.derived(spark, SMALL, "changes"))).withColumns({"object_kind": F.lit(0), "mode": F.lit(420).cast("long")})
    ev = ev.filter("change IN ('hardlinked', 'metadata_changed', 'content_changed', 'hsm_changed')")
    observed = fixtures.derived(spark, SMALL, "observations")
    start = apply.State(fixtures.entries(spark, SMALL, "fs-a"), fixtures.derived(spark, SMALL, "edges").filter("filesystem_id = 'fs-a'"), fixtures.derived(spark, SMALL, "removed").drop("tier"))
    from treeward.sources.staging import cut

    once = apply.apply_batch(start, cut(ev), observed, NOW)
    once = apply.State(cut(once.entries), cut(once.edges), cut(once.removed))
    twice = apply.apply_batch(once, ev, observed, NOW)
    cols = ("object_id", "size", "nlink", "hsm_state", "name")
    assert values(once.entries, *cols) == values(twice.entries, *cols)


def test_names_and_ids_of_any_bytes(spark):
    """Strings that look like base64 objects, bytes that are none, and the greatest inode survive; malformed ones do not."""
    from treeward.functions import columns as C
    from treeward.sources.schema import wide

    kind = wide(ENTRY)
    names = [b"plain", b"\xff\xfe", b'{"base64":"QQ=="}', "\u00fc\u6f22".encode(), b"", b'q"\\\x01', None]
    base = dict.fromkeys(ENTRY.names) | {"filesystem_id": "a", "kind": 0, "size": 1}
    rows = [base | {"object_kind": i % 2, "object_id": bytes([255 * (i % 2 == 0)] * 8) + bytes([255] * 7 + [i]), "name": n} for i, n in enumerate(names)]
    df = spark.createDataFrame([tuple(r[c] for c in ENTRY.names) for r in rows], kind)
    lines = catalog.dump(df)
    assert [r.object_id for r in lines.collect()] == sorted(r["object_id"] for r in rows)
    good, bad = catalog.restore(lines.select("value"), kind)
    got = [(bytes(r.object_id), None if r.name is None else bytes(r.name)) for r in good.collect()]
    assert sorted(got, key=repr) == sorted(((r["object_id"], r["name"]) for r in rows), key=repr)
    assert bad.count() == 0
    wrong = ['{"object_kind":0,"object_id":"[0x1:0x2]","name":"a"}', '{"object_kind":1,"object_id":"18446744073709551616","name":"a"}', '{"object_kind":1,"object_id":"5","name":{"base64":"*"}}', '{"object_kind":1,"object_id":"x"}']
    good, bad = catalog.restore(spark.createDataFrame([(w,) for w in wrong], "value string"), kind)
    assert good.count() == 0 and bad.count() == 4
    assert [r[0] for r in df.orderBy("object_id").select(C.shown("name")).collect()].count("\ufffd\ufffd") == 1


def test_batch_with_ids_of_16_bytes(spark):
    """The same batch over numbers and over bytes ends alike."""
    from treeward.functions import columns as C
    from treeward.sources import schema

    rng = random.Random(8)
    entries, edges = {o: (1, f"n{o}", 1) for o in range(10, 16)}, {(1, f"n{o}"): o for o in range(10, 16)}
    names = [(1, f"n{i}") for i in range(10, 20)]
    ev = [event(i, rng.choice(["created", "hardlinked", "unlinked", "renamed"]), rng.randrange(10, 17), rng.choice(names), rng.choice(names), last=rng.random() < 0.3) for i in range(25)]
    kind = spark.createDataFrame([], EVENT).schema
    table = lambda rows, kind: spark.createDataFrame([tuple(r.get(f.name) for f in kind) for r in rows], kind)
    base = {"filesystem_id": "a", "object_kind": 0, "kind": 0, "size": 1, "ctime": 1}
    e = table([base | {"object_id": o, "parent_id": v[0], "name": v[1], "nlink": v[2]} for o, v in entries.items()], schema.ENTRY)
    g = table([base | {"parent_id": k[0], "name": k[1], "object_id": v} for k, v in edges.items()], schema.EDGE)
    seen = spark.createDataFrame([], schema.OBSERVATION)
    raw = lambda c: F.concat(F.unhex(F.lit("FF" * 8)), F.substring(C.inode_bytes(c), 9, 8))

    def bytes_of(df):
        new = {c: raw(c) for c in df.columns if c in schema.ID_COLUMNS} | {c: F.concat(F.encode(c, "utf-8"), F.unhex(F.lit("FF"))) for c in df.columns if c in ("name", "src_name")}
        return df.withColumns(new)

    out = apply.apply_batch(apply.State(*map(bytes_of, (e, g, e.limit(0).withColumn("rm_time", F.lit(0).cast("long"))))), bytes_of(table(ev, kind)), bytes_of(seen), NOW)
    number = lambda c: C.inode_from_bytes(c).alias(c)
    text = F.substring(F.hex("name"), 1, F.length(F.hex("name")) - 2)
    got = {r.object_id: (r.parent_id, bytes.fromhex(r.name).decode(), r.nlink) for r in out.entries.select(number("object_id"), number("parent_id"), text.alias("name"), "nlink").collect()}
    want, links, gone = plain_batch(entries, edges, ev)
    assert got == want
    assert {r.object_id for r in out.removed.select(number("object_id")).collect()} == set(gone)
    assert out.edges.count() == len(links)


def test_rendered_values_are_not_templates(spark):
    got = spark.range(1).select(C.rendered("a{path}{x{size}", {"path": "/{size}", "size": F.lit(3)})).first()[0]
    assert got == "a/{size}{x3"


def test_internal_text_operations(spark):
    rows = [("1.0|NEWSESSION(1,a)|(1,2)",), ("1.0|DELSUSTAINED(1,2)|(1,2)",), ("1.0|NEW_SESSION(1)|(1,2)",), ("1.0|UNLINK(1,a,0,0,0)|(1,2)",), ("1.0|UNLINK(1,a,0,0,0):7|(1,2)",), ("1.0|RMDIR(1,d,0):8|(1,2)",)]
    good, bad = changelog.decode_text(spark.createDataFrame(rows, "value string"))
    assert sorted(r.object_id for r in good.collect()) == [7, 8] and sorted(r.value for r in bad.collect()) == sorted([rows[2][0], rows[3][0]])


# Any number of rows ------------------------------------------------------------------------


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_budgets_over_any_count_equal_the_small_ones(spark, monkeypatch):
    from dataclasses import replace

    rng = random.Random(3)
    rows = entry_rows(spark, *({"object_id": i, "size": rng.randrange(1000), "atime": rng.randrange(50), "nlink": 1 + (i % 9 == 0)} for i in range(3000))).repartition(8)
    p = policy.Policy("p", "a", lru="atime", max_count=2000, max_volume=600_000, skip_hardlinked=True)
    cols = ("object_id", "position", "cumulative", "decision")
    few = values(policy.select_candidates(rows, p), *cols)
    monkeypatch.setattr(policy, "FEW", 10)
    many = policy.select_candidates(rows, p)
    assert values(many, *cols) == few and len(few) == 2000
    assert "SinglePartition" not in plan_of(many)
    assert policy.select_candidates(rows, replace(p, max_count=100_000_000)).count() == 3000
    assert policy.select_candidates(rows.limit(0), p).count() == 0


def test_lost_chains_and_rings_take_few_rounds(spark, monkeypatch):
    """A lost chain of 5,000, one that leads into a ring, rings of several lengths, and a node above itself."""
    chain = [(10_000 + i, f"c{i}", 10_001 + i) for i in range(5000)]
    into = [(20_000 + i, f"i{i}", 20_001 + i) for i in range(300)] + [(30_002, "top", 20_000)]
    rings = [(30_000 + (i + 1) % 3, f"r{i}", 30_000 + i) for i in range(3)] + [(40_000, "self", 40_000)] + [(50_000 + (i + 1) % 700, f"l{i}", 50_000 + i) for i in range(700)]
    links = [*chain, *into, *rings, (1, "home", 2)]
    edges = spark.createDataFrame([("a", 0, p, n, o) for p, n, o in links], "filesystem_id string, object_kind int, parent_id long, name string, object_id long")
    ids = {1, *(o for _, _, o in links)}
    df = entry_rows(spark, *({"object_id": o, "kind": 1} for o in sorted(ids)))
    rounds = []
    monkeypatch.setattr(namespace, "cut", lambda df, cut=namespace.cut: rounds.append(1) or cut(df))
    got = {r.object_id: r.status for r in namespace.full_paths(df, edges, "a", 1).collect()}
    on_ring = {30_000, 30_001, 30_002, 40_000, *range(50_000, 50_700)}
    assert got == {o: "ok" if o in (1, 2) else "cycle" if o in on_ring else "missing_parent" for o in ids}
    assert len(rounds) < 22


def test_percentiles_of_merged_periods(spark):
    from treeward.operators import reports

    rng = random.Random(2)
    rows = [(p, d, rng.random() ** 3 * 1000) for p in ("a", "b") for d in range(30) for _ in range(400 if p == "a" else 7)]
    sketches = reports.run_sketches(spark.createDataFrame(rows, "policy string, day int, seconds double"), F.col("day"))
    assert sketches.count() == 60
    for days in (30, 10):  # any periods
        got = {r.policy: r for r in reports.run_percentiles(sketches.filter(F.col("period") < days)).collect()}
        for p in ("a", "b"):
            own = sorted(s for q, d, s in rows if q == p and d < days)
            assert got[p].n == len(own)
            for rank, value in ((0.5, got[p].p50), (0.95, got[p].p95)):
                below, upto = sum(s < value for s in own) / len(own), sum(s <= value for s in own) / len(own)
                assert below - reports.RANK_ERROR <= rank <= upto + reports.RANK_ERROR + 1 / len(own)


def test_equal_listings_shuffle_digests_only(spark):
    from treeward.operators import sets

    rows = spark.range(20_000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), (F.col("id") % 100).alias("size"), F.lit(1).alias("depth"), F.col("id").alias("object_id"))
    seen = rows.select("name", "size", "depth")
    assert sets.diff(seen, rows).count() == 0
    a, b = sets.differing(seen.select("name", "size"), rows, ["name", "size"])
    assert a.count() == b.count() == 0
    # One row more, one changed, repeated rows and nulls on one side: only their ranges are compared.
    other = seen.unionByName(seen.limit(3)).unionByName(spark.createDataFrame([("new", 1, 1), (None, 2, 1)], "name string, size long, depth int")).filter("name <> 'n7' OR name IS NULL")
    a, b = sets.differing(other.select("name", "size"), rows, ["name", "size"])
    assert a.count() < 200 and b.count() < 200
    assert values(sets.diff(other, rows), "side", "name", "size", "object_id", "total") == [("catalog", "n7", 7, 7, 1), ("filesystem", "new", 1, None, 2), ("filesystem", None, 2, None, 2)]
    assert len(values(sets.diff(other, rows, limit=1), "side")) == 2
