"""HTML extraction by equivalence classes of tags over the pages of a host.

A token is a tag with the path above it. Tokens of a host that occur equally often on
each of its pages, told by a sum over pages of hashes of page and count, form a class. The
classes of several tokens that each occur once a page are the template, nested by their
paths. What lies under a token is a slot. Slots whose text is the same on all pages are
template as well. Down from the root, the slot that holds more than half of the other
text of its pages is the article, unless a heading would be left outside; its text is
extracted. Names of elements count only where HTML itself says that they hold no
article, and words of classes only inside the slot that was found.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, strings

# Fixed values of HTML: elements without an end, with raw text, that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an opening tag of the same list ends, up to the nearest element that holds them.
SIBLINGS = {
    **dict.fromkeys(("p",), frozenset("p".split())),
    "li": frozenset("li p".split()),
    "dt": frozenset("dt dd p".split()),
    "dd": frozenset("dt dd p".split()),
    "tr": frozenset("tr td th p".split()),
    "td": frozenset("td th p".split()),
    "th": frozenset("td th p".split()),
    "option": frozenset("option".split()),
}
#: What is never part of an article: by element, anywhere, and by words of class, id and role, inside the article's slot.
OUTSIDE = frozenset("nav header footer aside form script style noscript template iframe button select menu dialog head".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header menu "
    "modal nav navbar navigation newsletter notice notification pagination popup promo related reply share sharing sidebar social sponsor "
    "sponsored subscribe toolbar widget".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
START = re.compile(r"<(?:!--|/?[a-zA-Z]|[!?])")
INSIDE = re.compile(r"=\s*([\"'])|>")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
SPACES = re.compile(r"\s+")
#: Pages that a template needs, and pages on which the text of a slot must be the same.
SUPPORT, CONSTANT = 2, 3
#: How many numbers of templates may be sent to every executor (16 MB or so).
SMALL = 1_000_000
SALTS = 16
ALL = "*"


class Element:
    """An open element; ``path`` is a hash of the tags above it and its own."""

    __slots__ = ("hash", "letters", "name", "path", "state", "words")

    def __init__(self, name: str, above: int, words: tuple[str, ...]):
        self.name, self.words = name, words
        self.path = xxhash.xxh64_intdigest(f"{above:x}/{name}.{'.'.join(words)}".encode("utf-8", "surrogatepass"))
        self.letters = self.hash = self.state = 0


def tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where the tag that starts at ``at`` ends: after the first ``>`` that is not in an attribute's quotes.

    A quote that nothing closes is none. ``last`` has the last places of quotes and of
    ``>``, one of which must follow.
    """
    to = at + 1
    while (m := INSIDE.search(page, to)) and m[0] != ">":
        to = page.index(m[1], m.end()) + 1 if last[m[1]] >= m.end() else m.end()
    return m.end() if m else page.index(">", at) + 1


def walk(page: str) -> Iterator[tuple[str, list[Element], str]]:
    """(kind, open elements, text) of a page: ``text``, ``open`` and ``close`` of the last element, ``break``.

    Mends what pages leave open as browsers do: a paragraph ends where the next
    begins, an end tag ends what is open inside its element, and one without a start is
    nothing; what looks like a tag but has no end is text. At the end all is closed. The
    time grows with the page's length, but for tags inside thousands of others left open.
    """
    stack: list[Element] = []
    count: dict[str, int] = {}
    last = {c: page.rfind(c) for c in "\"'>"}

    def closed(k: int) -> Iterator[tuple[str, list[Element], str]]:
        while len(stack) > k:
            yield "close", stack, stack[-1].name
            count[stack.pop().name] -= 1

    def nearest(names, stop=frozenset()) -> int | None:
        if any(count.get(n) for n in names):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name in names:
                    return k
                if stack[k].name in stop:
                    return None
        return None

    at = 0
    while at < len(page):
        found = START.search(page, at) if at <= last[">"] else None
        start = found.start() if found and found.start() < last[">"] else len(page)
        if start > at:
            yield "text", stack, page[at:start]
            at = start
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        end = tag_end(page, at, last)
        source, at = page[at:end], end
        if not (named := NAME.match(source[:-1])):
            continue
        name = named[1].lower()
        if source[1] == "/":
            if (k := nearest((name,))) is not None:
                yield from closed(k)
            continue
        if name in BLOCK or name in SIBLINGS:
            if (k := nearest(SIBLINGS.get(name, SIBLINGS["p"]), BLOCK)) is not None:
                yield from closed(k)
        if name in VOID:
            yield "break", stack, name
            continue
        words = {w for a in ATTRIBUTE.finditer(source[named.end() : -1]) for w in re.split(r"[^a-z]+", (a[2] or a[3] or a[4] or "").lower()) if w}
        stack.append(Element(name, stack[-1].path if stack else 0, tuple(sorted(words))))
        count[name] = count.get(name, 0) + 1
        yield "open", stack, name
        if name in RAW:
            over = ENDS[name].search(page, at)
            at = over.end() if over else len(page)
            yield from closed(len(stack) - 1)
    yield from closed(0)


def signed(h: int) -> int:
    return (h & (1 << 64) - 1) - (1 << 64) * (h >> 63 & 1)


def tokens(page: str | None) -> list[tuple[int, int, int, int, int, int]]:
    """(path, path above, kind, how often, letters, hash of the text) of each token of a page that may hold text.

    ``kind`` is 1 for headings, 2 for the element ``article``, else 0. Letters and hash
    are of all that lies below, added up when elements close.
    """
    found: dict[int, list[int]] = {}
    hidden = 0
    for kind, stack, text in walk(page or ""):
        if kind == "text":
            if not hidden and stack and (piece := SPACES.sub(" ", text).strip()):
                stack[-1].letters += len(piece)
                stack[-1].hash += xxhash.xxh64_intdigest(piece.encode("utf-8", "surrogatepass"))
        elif kind == "open":
            hidden += text in OUTSIDE
        elif kind == "close":
            hidden -= text in OUTSIDE
            if not hidden and text not in OUTSIDE:
                e, above = stack[-1], stack[-2] if len(stack) > 1 else None
                if above:
                    above.letters, above.hash = above.letters + e.letters, above.hash + e.hash
                own = found.setdefault(e.path, [above.path if above else 0, 1 if text in HEADINGS else 2 * (text == "article"), 0, 0, 0])
                own[2], own[3], own[4] = own[2] + 1, own[3] + e.letters, own[4] + e.hash
    return [(signed(path), signed(own[0]), *own[1:4], signed(own[4])) for path, own in found.items()]


def article_slots(frame: pd.DataFrame) -> tuple[list[int], list[int]]:
    """The slots that hold articles and the constant ones, from one host's template.

    ``frame`` has the host's tokens that occur once a page: token, parent, kind, on (how
    many pages), letters, constant. From the roots down, a slot gives way to the one below
    that holds more than half of its text on their pages, text of constant slots aside,
    unless a heading would be left out or it is an ``article``.
    """
    rows = {r.token: r for r in frame.itertuples()}
    below: dict[int, list[int]] = {}
    for t, r in rows.items():
        below.setdefault(r.parent, []).append(t)
    order, roots = [], [t for t, r in rows.items() if r.parent not in rows]
    todo = list(roots)
    while todo:
        order.append(todo.pop())
        todo += below.get(order[-1], ())
    own: dict[int, int] = {}
    for t in reversed(order):
        r = rows[t]
        own[t] = 0 if r.constant else r.letters - sum(rows[c].letters - own[c] for c in below.get(t, ()))
    found, todo = [], [t for t in roots if own[t] > 0]
    while todo:
        t = todo.pop()
        r, parts = rows[t], [c for c in below.get(t, ()) if own[c] > 0]
        deeper = [c for c in parts if 2 * own[c] * r.on > own[t] * rows[c].on]
        headed = any(rows[c].kind == 1 for c in parts)
        if deeper and r.kind != 2 and not (headed and all(rows[c].kind != 1 for c in deeper)) and not any(rows[c].kind == 1 for c in deeper):
            todo += deeper
        else:
            found.append(t)
    return found, [t for t in order if rows[t].constant]


def main_text(page: str | None, *ways: tuple[set[int], set[int]]) -> str:
    """The text of the article's slots by the first of some templates, slots and constant ones, of which the page has one.

    If there is none, of all elements that HTML does not set apart.
    """
    whole = ""
    for slots, constant in ways or ((set(), set()),):
        inside, whole = texts(page, slots, constant)
        if inside is not None:
            return inside
    return whole


def texts(page: str | None, slots: set[int], constant: set[int]) -> tuple[str | None, str]:
    """The text in the article's slots, None if the page has none of them, and all text that HTML does not set apart."""
    inside: list[str] = []
    whole: list[str] = []
    block: list[str] = []
    any_slot = False
    HIDDEN, SLOT, OFF = 1, 2, 4

    def end_block(state: int) -> None:
        text = SPACES.sub(" ", html.unescape("".join(block))).strip()
        block.clear()
        if text and not state & HIDDEN:
            whole.append(text)
            if state & (SLOT | OFF) == SLOT:
                inside.append(text)

    for kind, stack, text in walk(page or ""):
        state = stack[-1].state if stack else 0
        if kind == "text":
            block.append("" if state & HIDDEN else text)
        elif kind == "break":
            block.append(" ")
            if text == "hr":
                end_block(state)
        elif kind == "open":
            above, e = (stack[-2].state if len(stack) > 1 else 0), stack[-1]
            path = signed(e.path)
            e.state = above | (HIDDEN if text in OUTSIDE else 0)
            if above & SLOT and (path in constant or not OUTSIDE_WORDS.isdisjoint(e.words)):
                e.state |= OFF
            if path in slots:
                e.state |= SLOT
                any_slot |= not e.state & HIDDEN
            if text in BLOCK or e.state != above:
                end_block(above)
        elif text in BLOCK or (len(stack) > 1 and stack[-2].state != state):
            end_block(state)
    end_block(0)
    return "\n".join(inside) if any_slot else None, "\n".join(whole)


def templates(pages: DataFrame) -> DataFrame:
    """``(host, slots, constant)``: where the articles of each host are, and its constant slots.

    ``pages`` has ``host, page_id, html``. A class is valid if it has two tokens or more on
    ``SUPPORT`` pages; the template are those whose tokens occur once a page. What is gathered of a host
    is no more than a few pages have of different tags. The host ``ALL`` stands for all
    pages, by the tokens that one in a hundred of them has.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "parent", "kind", "times", "letters", "text"]
        for b in it:
            rows = [(h, i, *t) for h, i, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strings(b.column(2)), strict=True) for t in tokens(page)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            types = (pa.string(), *[pa.int64()] * 7)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["host", "page_id", *names])

    schema = "host string, page_id long, token long, parent long, kind long, times long, letters long, text long"
    one = pages.select("host", F.coalesce("page_id", F.xxhash64("html")).alias("page_id"), "html").mapInArrow(batches, schema)
    # The hashes are halved before the sum, which then wraps nowhere for billions of pages of a token.
    mark = F.shiftright(F.xxhash64("page_id", "times"), 31)
    sums = [F.sum(mark).alias("vector"), F.count("*").alias("on"), F.max("times").alias("most"), F.max("parent").alias("parent"), F.max("kind").alias("kind")]
    sums += [F.sum("letters").alias("letters"), F.min("text").alias("low"), F.max("text").alias("high")]
    vectors = staged(one.groupBy("host", "token").agg(*sums), "vectors")
    more = [F.sum(c).alias(c) if c in ("vector", "on", "letters") else F.min(c).alias(c) if c == "low" else F.max(c).alias(c) for c in vectors.columns[2:]]
    over = vectors.groupBy("token").agg(*more).withColumn("host", F.lit(ALL)).filter(100 * F.col("on") >= pages.count())
    vectors = staged(vectors.filter("host <> ''").unionByName(over).filter(F.col("on") >= SUPPORT), "vectors")
    classes = vectors.groupBy("host", "vector", "on").agg(F.count("*").alias("size")).filter("size > 1")
    valid = vectors.filter("most = 1").join(classes, ["host", "vector", "on"], "left_semi")
    # An element that holds text stands for itself, though no other has its vector.
    alone = vectors.filter("most = 1 AND letters > 0").join(classes, ["host", "vector", "on"], "left_anti")
    valid = valid.unionByName(alone)
    constant = (F.col("low") == F.col("high")) & (F.col("on") >= CONSTANT)
    valid = valid.select("host", "token", "parent", "kind", "on", "letters", constant.alias("constant"))

    def nested(frame: pd.DataFrame) -> pd.DataFrame:
        slots, same = article_slots(frame)
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "slots": [slots], "constant": [same]})

    return valid.groupBy("host").applyInPandas(nested, "host string, slots array<long>, constant array<long>")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``(page_id, url, text)``: the article of each page, blocks joined by newlines.

    Null and empty pages have the empty text. Character references are decoded, white
    space in a block is one space. Pages are read whole, repeated rows each, and null ids are passed on. A page
    whose host has no template, as it has no other page or no host at all, or that has
    none of the template's slots, gives all text but that of elements which HTML itself
    sets apart, such as ``nav``, if the template of all pages has none of its slots either. Other columns are ignored; empty in, empty out.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.col(page).cast("string").alias("html"),
        F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)).alias("host"),
    )
    known = staged(templates(rows), "templates")
    # Bounded by the share of pages that its tokens are on.
    overall = [(set(r.slots), set(r.constant)) for r in known.filter(F.col("host") == ALL).collect()]
    known = known.filter(F.col("host") != ALL)
    size = known.agg(F.sum(F.size("slots") + F.size("constant") + 4)).first()[0] or 0
    if size <= SMALL:
        joined = rows.join(F.broadcast(known), "host", "left")
    else:
        # Pages of one host are dealt to several tasks.
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS)))
        joined = rows.join(known.withColumn("salt", F.explode(F.array(*(F.lit(k).cast("long") for k in range(SALTS))))), ["host", "salt"], "left")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            slots, constant = ([set(x or ()) for x in b.column(k).to_pylist()] for k in (3, 4))
            texts = [main_text(page, (s, c), *overall) for page, s, c in zip(strings(b.column(2)), slots, constant, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.select("page_id", "url", "html", "slots", "constant").mapInArrow(batches, "page_id long, url string, text string")
