"""Personal data: base spans against the plain patterns, labelers and classifier on planted proposals, odd texts."""

import hashlib
import random
import re
import string

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from treeward.llm import pii, queries

DOC = "doc_id long, text string"


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, digits[::-1])):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    """The patterns as they are written, and their conditions."""
    n = lambda m: len(re.sub("[^0-9]", "", m[0]))
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= n(m) <= 19 and luhn(re.sub("[^0-9]", "", m[0]))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= n(m) <= 15),
    }
    return sorted(((m.start(), m.end(), k) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m)), key=lambda x: (x[0], list(rules).index(x[2])))


PIECES = ["a.b@c.de", "@", "x@y", "x@y.z", "..@a..b", "a@b.cc@d.ee", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "001.02.3.4", "9.", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (319) 555-5132", "+12", "++1234567890", " ", "-", "\n", "ünï", "漢字", "🙂", "12345678901234567890", "0", "+", ".", "(", "%_"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES) | st.text("a.@0+- 9(", max_size=6), max_size=14))
def test_base_spans_equal_the_patterns(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == plain(text)


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1" * 100_000, "1 " * 150_000, " at " * 80_000, ":a" * 100_000, "x@" + "a-" * 100_000):
        assert pii.spans_of(text, np.zeros(pii.WIDTH + 1)) is not None


def test_reliabilities_are_found_again():
    rng = random.Random(1)
    truth = [(0.95, 0.9), (0.7, 0.8), (0.9, 0.95), (0.8, 0.7), (0.85, 0.9), (0.75, 0.9)]
    counts, means = {}, {}
    for _ in range(30_000):
        real = rng.random() < 0.5
        votes = "".join("-" if rng.random() < 0.2 else str(int(real == (rng.random() < t[0 if real else 1]))) for t in truth)
        counts["email", votes] = counts.get(("email", votes), 0) + 1
        means.setdefault(("email", votes), []).append(real)
    likely, right = pii.reliabilities(counts)
    assert np.abs(right - np.array(truth)).max() < 0.04
    often = [k for k in counts if counts[k] > 200]
    assert max(abs(likely[k] - np.mean(means[k])) for k in often) < 0.1


WORDS = "thon inghast ered oushing nealy onthe tion wheder sticht pfung eaux cion".split()


def planted(rng, n):
    """Texts with one proposal each, and whether it is personal: written-around emails, bare numbers, cards, credentials, and what only looks alike."""
    out = []
    letters = lambda k: "".join(rng.choice(string.ascii_lowercase) for _ in range(k))
    for i in range(n):
        a, b = (" ".join(rng.choice(WORDS) for _ in range(8)) for _ in range(2))
        num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
        hexes = "".join(rng.choice("0123456789abcdef") for _ in range(24))
        card = next(c for c in iter(lambda: "4" + num(15), None) if luhn(c))
        kind, text = [
            (True, f"mail {letters(6)} (at) {letters(5)} (dot) com"),
            (True, f"password={hexes}"),
            (True, f'token = "{hexes}"'),
            (True, f"call ({num(3)}) {num(3)}-{num(4)}"),
            (True, f"card {card[:4]}.{card[4:8]}.{card[8:12]}.{card[12:]}"),
            (False, f"sha: {hexes}"),
            (False, f"id={num(12)}"),
            (False, f"page: {letters(9)}"),
            (False, f"x{num(3)} {num(3)} {num(4)}"),
            (False, f"9{num(3)}.{num(4)}.{num(4)}.{num(4)}/x"),
        ][i % 10]
        out.append((kind, f"{a} {text} {b}"))
    return out


def test_planted_spans_are_found_and_the_rest_left(spark):
    rows = planted(random.Random(2), 1500)
    fit, held = rows[:1000], rows[1000:]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(fit)] + [(5000 + i, f"x a{i}@b.com 1.2.3.{i % 9} +1 (319) 555-5{i % 900 + 100}") for i in range(300)], DOC)
    weights, _ = pii.train(docs)
    right = [bool(pii.spans_of(t, weights)) == real for real, t in held]
    assert np.mean(right) > 0.97
    assert pii.train(docs.filter("false"))[0][-1] < 0  # nothing to learn from accepts nothing


def test_query_equals_brute_force_and_odd_texts(spark, tmp_path):
    texts = [None, "", " \n", "a@b.co", "ü a@b.co 漢 1.2.3.4, +1 (319) 555-5132, 4111 1111 1111 1111", "a@b.co", "x" * 100_000 + " 10.0.0.1", "1.2.3.4 " * 3000, "\x00 a@b.co"]
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)] + [(3, texts[3], "s", 1), (None, "c@d.ee", "s", 1)]
    spark.createDataFrame(rows, DOC + ", spans string, kind int").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op12_pii(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, text, *_ in rows:
        base = plain(text or "")
        line = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        want.append((i, *(sum(x[2] == k for x in base) for k in pii.BASE), hashlib.sha256(line.encode()).hexdigest(), line))
    assert got == sorted(want, key=str)
    none = spark.createDataFrame([], DOC)
    assert pii.find(none, np.zeros(pii.WIDTH + 1)).count() == 0


def test_masking():
    assert pii.masked("x a@b.co y 1.2.3.4", [(2, 8, "email"), (11, 18, "ip")]) == "x <email> y <ip>"
    assert pii.masked("abcdef", [(1, 4, "a"), (2, 6, "b")]) == "a<a>" and pii.masked(None, []) is None


@pytest.mark.parametrize("kind", pii.KINDS)
def test_every_kind_has_cues(kind):
    assert pii.CUES[kind] and F is not None
