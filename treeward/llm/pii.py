"""Personal data by weak supervision.

Plain patterns find base spans of four kinds, which always stay. Looser searches propose
more: emails and addresses that are written around, numbers without their plus, cards
with other separators, credentials. No one has labelled these. So labelers of three
sorts (patterns, gazetteers, context) vote on every proposal or abstain, votes are
counted over the whole corpus, expectation-maximisation over the counts estimates how
reliable each labeler is and how likely each pattern of votes means personal data, and
these likelihoods are the soft labels from which the final classifier of spans learns.
It sees a span's shape, its neighbours and its kind, not the votes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, strings

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
#: Distinct proposals that the classifier learns from, at most; a span is accepted from this score.
SAMPLE, ACCEPT = 20_000, 0.5
#: The share of personal data among proposals of a kind that the labelers' votes are weighed against.
BALANCE = 0.5
WIDTH = 4096
SPAN = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"

Span = tuple[int, int, str]

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits without the rest of an address is passed as a whole: no match can begin inside it.
_IP = re.compile(r"[0-9]+(?:\.[0-9]+\.[0-9]+\.[0-9]+)?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[Span]:
    """``(start, end, kind)`` of the base patterns, each kind leftmost and without overlaps, by start and kind."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        m = _AT.match(text, at)
        start = at
        while m and start > end and text[start - 1] in _LOCAL:
            start -= 1
        if m and start < at:
            end = m.end()
            out.append((start, end, "email"))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if m.end() - m.start() > 6 and "." in m[0] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := digits_of(m[0])) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= len(digits_of(m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=order)


def order(span: Span) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


# Proposals -----------------------------------------------------------------------------

_AT_WORD = re.compile(r"[(\[{]at[)\]}]|(?<= )at(?= )")
_BEFORE = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?$")
_AFTER = re.compile(r" ?[A-Za-z0-9-]{1,63}(?:(?: ?[(\[{]dot[)\]}] ?| dot |\.)[A-Za-z0-9-]{1,63}){1,8}")
_IP_DOTS = re.compile(r"[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])")
_IP_SIX = re.compile(r"(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])")
_CARD_OTHER = re.compile(r"[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])")
_PHONE_BARE = re.compile(r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_VALUE = re.compile(r"[=:] ?[\"']?([^\s\"',;<>]{6,256})")
_KEY = re.compile(r"(?i)(?:pass(?:word|wd|phrase)?|pwd|token|secret|api[_-]?key|access[_-]?key|auth(?:orization)?|key|id|hash|sha|md5|url|time|date) ?[\"']?$")
_MARKED = tuple(map(re.compile, (r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])", r"ghp_[A-Za-z0-9]{36}(?![0-9A-Za-z])", r"sk-[A-Za-z0-9]{20,64}(?![0-9A-Za-z])", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----")))


def proposals(text: str) -> list[Span]:
    """Looser spans, sorted; they may overlap."""
    out: list[Span] = []
    if "at" in text:
        for m in _AT_WORD.finditer(text):
            after = _AFTER.match(text, m.end())
            plain = m[0] == "at"  # a word like others, unless dots are written out too
            if not after or plain and "dot" not in after[0]:
                continue
            if before := _BEFORE.search(text, max(0, m.start() - 65), m.start()):
                out.append((before.start(), after.end(), "email"))
    if "[.]" in text:
        out += [(m.start(), m.end(), "ip") for m in _IP_DOTS.finditer(text)]
    for m in _IP_SIX.finditer(text):
        start = m.start()
        while start > 0 and m.start() - start < 4 and text[start - 1] in "0123456789abcdefABCDEF":
            start -= 1
        if start < m.start():
            out.append((start, m.end(), "ip"))
    out += [(m.start(), m.end(), "card") for m in _CARD_OTHER.finditer(text)]
    for m in _PHONE_BARE.finditer(text):
        start = m.start() - (text[m.start() - 1 : m.start()] == "(")
        out.append((start, m.end(), "phone"))
    for m in _VALUE.finditer(text):
        if _KEY.search(text, max(0, m.start() - 24), m.start()):
            out.append((m.start(1), m.end(1), "secret"))
    for pattern in _MARKED:
        out += [(m.start(), m.end(), "secret") for m in pattern.finditer(text)]
    return sorted(set(out), key=order)


# Labelers: 1 personal, 0 not, None no opinion ---------------------------------------------

#: Gazetteers: fixed word lists.
DOMAINS = frozenset("com org net edu gov io de fr es it uk ch at eu info example".split())
CREDENTIALS = re.compile(r"(?i)(?:pass(?:word|wd|phrase)?|pwd|token|secret|api[_-]?key|access[_-]?key|auth(?:orization)?)[ \"']*[:=]?[ \"']*$")
HARMLESS = re.compile(r"(?i)(?:sha|sha1|sha256|md5|hash|commit|checksum|version|isbn|issn|doi|page|time|date|url|id)[ \"'#]*[:=]?[ \"']*$")
CUES = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|write|contact|reach|correo|kontakt|courriel)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|login|from|addr)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|mobile|fax|cell|whatsapp|telefon|appelez|llame)\b"),
    "secret": re.compile(r"(?i)\b(?:password|passwd|token|secret|credential|login|private)\b"),
}


def by_shape(text: str, s: int, e: int, kind: str) -> int | None:
    """A pattern: the strict form of the kind."""
    span = text[s:e]
    if kind == "email":
        return 1 if "@" in span or re.search(r"[(\[{](?:at|dot)[)\]}]| at .* dot ", span) else None
    if kind == "ip":
        return 1 if span.count(":") == 7 or all(int(p) <= 255 for p in span.replace("[.]", ".").split(".") if p.isdigit() and len(p) < 5) else 0
    if kind == "card":
        return int(luhn(digits_of(span)))
    if kind == "phone":
        return 1 if span[0] in "+(" else None
    mixed = any(c.isdigit() for c in span) and any(c.isalpha() for c in span)
    return 1 if mixed and len(span) >= 12 else 0 if span.isdigit() or span.isalpha() else None


def by_variety(text: str, s: int, e: int, kind: str) -> int | None:
    """A pattern: values that are all one character, or counted up, are examples."""
    span = [c for c in text[s:e] if c.isalnum()]
    few = len(set(span)) <= max(2, len(span) // 8)
    return 0 if few else 1 if kind == "secret" and len(set(span)) >= 8 else None


def by_gazetteer(text: str, s: int, e: int, kind: str) -> int | None:
    """Word lists: known ends of domains, issuers of cards, names of credentials."""
    span = text[s:e]
    if kind == "email":
        return int(re.split(r"[^A-Za-z0-9]+", span.rstrip(")]}"))[-1].lower() in DOMAINS)
    if kind == "ip":
        first = re.match("[0-9]+", span)
        return 0 if ":" not in span and first and int(first[0][:4]) in (0, 127, 255) else None
    if kind == "card":
        return int(span[0] in "3456")
    if kind == "secret":
        known = CREDENTIALS.search(text, max(0, s - 24), s) or span.startswith(("AKIA", "ghp_", "sk-", "-----BEGIN"))
        return 1 if known else 0 if HARMLESS.search(text, max(0, s - 24), s) else None
    return None


def by_cue(text: str, s: int, e: int, kind: str) -> int | None:
    """Context: a word before it that announces the kind."""
    return 1 if CUES[kind].search(text, max(0, s - 40), s) else None


def by_harm(text: str, s: int, e: int, kind: str) -> int | None:
    """Context: a name just before it that says what else it is."""
    return 0 if HARMLESS.search(text, max(0, s - 16), s) else None


def by_edges(text: str, s: int, e: int, kind: str) -> int | None:
    """Context: personal data stands alone, parts of longer tokens are something else."""
    left, right = text[s - 1 : s], text[e : e + 1]
    return 0 if left.isalnum() or right.isalnum() or left in ("+", "/", "_") and left else 1


LABELERS = (by_shape, by_variety, by_gazetteer, by_cue, by_harm, by_edges)


def votes(text: str, span: Span) -> str:
    """A span's votes, a character for each labeler: ``1``, ``0`` or ``-``."""
    given = (f(text, *span) for f in LABELERS)
    return "".join("-" if v is None else str(v) for v in given)


def features(text: str, span: Span) -> list[int]:
    """What the classifier sees, as places in its weights."""
    s, e, kind = span
    shape = re.sub("[^\x00-\x7f]", "u", re.sub("[0-9]", "9", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", text[s : min(e, s + 64)]))))
    short = re.sub(r"(.)\1+", r"\1", shape)
    before = re.findall(r"[^\W_]+", text[max(0, s - 32) : s].lower())[-2:]
    names = [f"kind {kind}", f"shape {kind} {short[:12]}", f"length {kind} {(e - s).bit_length()}", f"left {text[max(0, s - 1) : s]}", f"right {text[e : e + 1]}"]
    names += [f"word {kind} {w}" for w in before] + [f"gram {short[i : i + 3]}" for i in range(len(short) - 2)]
    return sorted({zlib.crc32(n.encode("utf-8", "replace")) % WIDTH for n in names})


# Learning ------------------------------------------------------------------------------------


def reliabilities(counts: dict[tuple[str, str], int], rounds: int = 60) -> tuple[dict[tuple[str, str], float], np.ndarray]:
    """Expectation-maximisation over counts of ``(kind, votes)``.

    Returns how likely each pattern is personal data, and for each labeler how often it
    is right on personal data and on other spans. Labelers are independent given the truth;
    who abstains says nothing. Each starts out right four times in five, which also
    settles which of the two classes is which. The share of personal data is not estimated but
    ``BALANCE``: a kind that is mostly genuine should not vouch for what its labelers doubt.
    """
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    vote = np.array([[{"1": 1, "0": 0, "-": -1}[c] for c in v] for _, v in keys]).reshape(len(keys), len(LABELERS))
    right = np.full((len(LABELERS), 2), 0.8)
    posterior = np.full(len(keys), 0.5)
    for _ in range(rounds):
        yes, no = right[:, 0], right[:, 1]
        log_yes = np.where(vote == 1, np.log(yes), np.where(vote == 0, np.log(1 - yes), 0)).sum(1) + np.log(BALANCE)
        log_no = np.where(vote == 1, np.log(1 - no), np.where(vote == 0, np.log(no), 0)).sum(1) + np.log(1 - BALANCE)
        posterior = 1 / (1 + np.exp(np.clip(log_no - log_yes, -500, 500)))
        w, v = n * posterior, n * (1 - posterior)
        for j in range(len(LABELERS)):
            one, zero = vote[:, j] == 1, vote[:, j] == 0
            right[j] = (w[one].sum() + 8) / (w[one | zero].sum() + 10), (v[zero].sum() + 8) / (v[one | zero].sum() + 10)
        right = np.clip(right, 0.05, 0.99)
    return dict(zip(keys, posterior.tolist(), strict=True)), right


def classifier(rows: list[list[int]], soft: np.ndarray, weight: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic model for soft labels, the last one its bias; plain gradient steps with a little shrinkage."""
    w = np.zeros(WIDTH + 1)
    if not len(rows):
        w[-1] = -10.0
        return w
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    where = np.concatenate([np.asarray(r, int) for r in rows])
    weight = weight / weight.sum()
    seen = np.bincount(where, weight[at], WIDTH) + 1e-3
    for _ in range(rounds):
        score = np.bincount(at, w[where], len(rows)) + w[-1]
        off = weight * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - soft)
        w[:-1] -= 0.5 * (np.bincount(where, off[at], WIDTH) / np.sqrt(seen) + 1e-4 * w[:-1])
        w[-1] -= 0.5 * off.sum()
    return w


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(weights, reliabilities): votes are counted over all documents; the classifier learns from ``sample`` distinct proposals at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in strings(b["text"]):
                if text:
                    for span in {*base_spans(text), *proposals(text)}:
                        out.append({"kind": span[2], "votes": votes(text, span), "features": features(text, span)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("kind", pa.string()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))

    found = docs.select("text").mapInArrow(run, "kind string, votes string, features array<int>")
    found = staged(found.groupBy("kind", "votes", "features").agg(F.count("*").alias("n")), "proposals")
    # At most three votes of each labeler for each kind.
    counts = {(r.kind, r.votes): r.n for r in found.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()}
    likely, right = reliabilities(counts)
    key = F.xxhash64("kind", "votes", "features")
    rows = found.orderBy(key, "kind", "votes", "features").limit(sample).collect()
    soft = np.array([likely[r.kind, r.votes] for r in rows])
    return classifier([r.features for r in rows], soft, np.array([float(r.n) for r in rows])), right


def spans_of(text: str, weights: np.ndarray) -> list[tuple[int, int, str, bool, float]]:
    """Base spans and accepted proposals ``(start, end, kind, base, score)``, by start and kind; a proposal that overlaps what is there goes."""
    base = base_spans(text)
    out = [(*s, True, 1.0) for s in base]
    scored = []
    for span in proposals(text):
        score = float(1 / (1 + np.exp(-np.clip(weights[features(text, span)].sum() + weights[-1], -30, 30))))
        if score >= ACCEPT:
            scored.append((-score, *span))
    taken = sorted((s, e) for s, e, _ in base)
    for score, s, e, kind in sorted(scored):
        if all(e <= a or b <= s for a, b in taken):
            taken.append((s, e))
            out.append((s, e, kind, False, -score))
    return sorted(out, key=lambda x: order(x[:3]))


def find(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``(doc_id, spans)`` of every document: kind, start and end in code points (end exclusive), whether it is a base span, score.

    Null and empty texts have none. Texts are searched whole, in time that grows with their
    length. Repeated documents each have a row, empty tables give none; other columns are
    not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())])
        for b in batches:
            rows = [[{"kind": k, "start": s, "end": e, "base": base, "score": p} for s, e, k, base, p in spans_of(t or "", weights)] for t in strings(b["text"])]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(rows, pa.list_(struct))], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPAN}")


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """A text with each span as its kind in angle brackets; what overlaps an earlier span is part of it."""
    if text is None:
        return None
    out, at = [], 0
    for s, e, kind in sorted(spans):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])
