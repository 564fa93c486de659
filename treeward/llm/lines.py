"""Fuzzy line deduplication.

Lines are lower-cased, freed of common punctuation and cut into words. A line's
fingerprint is a set of SimHashes, one for each window of a few words: a bit is 1 if most
of the window's word hashes have it. These are its pigeonhole blocks, as an edit spoils
no more of them than a window has words. Lines that share one of the blocks
that come first in an order of all blocks are compared by the edit distance of their
words, and of each connected group one occurrence stays. One SimHash of a whole line would
not do: lines of edit similarity 0.8 differ in 13 of 64 bits, which no blocks can bridge.
All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, key_components, let, staged

SEPARATORS = r"[ \t\r.,;:!?|*#$%&]+"
#: How many numbers may be sent to every executor (1 MB or so); with more, as all but small corpora have, Spark shuffles.
SMALL = 50_000
#: Thai, Lao, Burmese, Khmer, kana and Chinese characters: no space parts their words, so each counts as a word.
SPACELESS = r"([\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}])"
#: Blocks that a line is found by, of two words in lines with one edit at most, of three in longer ones; in lines of
#: ``LONG`` words or more, whose neighbours may share a passage and little else, of two words from anywhere in the line.
PAIRS, THREES, SPREAD, LONG = 3, 7, 12, 30
#: A word hash has 59 bits, and above them four that order words by length.
HASH_BITS = 59
#: So many of the last bits of a line's hash hold its number of words, or the highest number that they can.
COUNT_BITS = 10


def words_of(line: Column) -> Column:
    """The words of a line that is ``plain``: what space and common punctuation part."""
    return F.array_remove(F.split(line, SEPARATORS), "")


def plain(text: Column) -> Column:
    """Lower case, and spaces around characters of SPACELESS."""
    # Texts of one byte a character have none of them.
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(F.regexp_replace(t, SPACELESS, " $1 ")))


def bounded(df: DataFrame, numbers: Column | None = None) -> DataFrame:
    """A broadcast hint, if a count says that the rows are few; ``numbers`` is what a row counts for, 1 without it."""
    size = df.agg(F.sum(F.lit(1) if numbers is None else numbers)).first()[0] or 0
    return F.broadcast(df) if size <= SMALL else df


def ranked_hash(word: Column) -> Column:
    """59 bits of the word's hash under its rank: the longer, and so as a rule rarer, the lower."""
    rank = F.lit(15) - F.least(F.length(word), F.lit(15))
    return F.shiftrightunsigned(F.xxhash64(word), 64 - HASH_BITS).bitwiseOR(F.shiftleft(rank.cast("long"), HASH_BITS))


def simhash(*hashes: Column) -> Column:
    """The SimHash of two or three words: the bits that more than half of their hashes have."""
    if len(hashes) == 2:
        return hashes[0].bitwiseAND(hashes[1])
    a, b, c = hashes
    return a.bitwiseAND(b.bitwiseOR(c)).bitwiseOR(b.bitwiseAND(c))


def ranked_windows(hashes: Column, size: int) -> Column:
    """The SimHash of each run of ``size`` ranked hashes, under the highest of their ranks."""
    high, low = F.lit(15 << HASH_BITS), F.lit((1 << HASH_BITS) - 1)

    def ranked(x: Column, i: Column) -> Column:
        own = [x, *(F.get(hashes, i + k) for k in range(1, size))]
        # By its place in the window a word counts as another: two the same would outvote the third.
        return simhash(*(F.shiftleft(h, k) for k, h in enumerate(own))).bitwiseAND(low).bitwiseOR(F.greatest(*own).bitwiseAND(high))

    return F.transform(F.slice(hashes, 1, F.size(hashes) - (size - 1)), ranked)


def near_blocks(words: Column, least: float) -> Column:
    """The blocks of a line of under ``LONG`` words: windows in the order of the text, those with the longest words first."""
    n = F.size(words)
    border = 2 / (1 - least)
    first = lambda b, k: F.slice(F.sort_array(F.array_distinct(b)), 1, k)
    none = F.expr("cast(array() as array<bigint>)")
    start = lambda x, least_words: F.greatest(F.lit(round(x, 6)), F.lit(least_words))
    pairs = lambda h: F.when((n >= start(least * border / 2, 2)) & (n < round(border, 6)), first(ranked_windows(h, 2), PAIRS)).otherwise(none)
    threes = lambda h: F.when(n >= start(least * border, 3), first(ranked_windows(h, 3), THREES)).otherwise(none)
    return F.when(n < LONG, let(F.transform(words, ranked_hash), lambda h: F.concat(pairs(h), threes(h)))).otherwise(none)


def low_hashes(words: Column) -> Column:
    """The first of the different words' hashes, so that the longest words come first; all of ten letters or more are as long."""
    rank = lambda w: F.least(F.length(w), F.lit(10)).cast("long") * F.lit(1 << HASH_BITS)
    own = lambda w: F.shiftrightunsigned(F.xxhash64(w), 64 - HASH_BITS) - rank(w)
    return F.slice(F.sort_array(F.array_distinct(F.transform(words, own))), 1, SPREAD + 1)


def line_key(words: Column, n: Column) -> Column:
    """The hash of a line's words, with their number as its last bits."""
    most = (1 << COUNT_BITS) - 1
    return F.xxhash64(words).bitwiseAND(F.lit(~most)).bitwiseOR(F.least(n, F.lit(most)).cast("long"))


def near_counts(least: float):
    """What holds of the keys of any two lines of an edit similarity ``least``: their numbers of words are near, or too many to tell."""
    most = F.lit((1 << COUNT_BITS) - 1)

    def may(a: Column, b: Column) -> Column:
        x, y = a.bitwiseAND(most), b.bitwiseAND(most)
        return (F.abs(x - y) <= F.floor(F.greatest(x, y) * F.lit(round(1 - least, 6)))) | (F.greatest(x, y) == most)

    return may


def line_prints(rows: DataFrame, min_words: int, least: float) -> DataFrame:
    """``(doc_id, rid, line, key, n, near, low)`` of all lines with ``min_words`` words or more, 1 at least.

    ``rows`` has ``doc_id, rid, text``. ``key`` is the ``line_key``, ``n`` the number of words. ``near`` and ``low`` are for ``line_blocks``.
    """
    # Outer explodes: a plain one has its array computed once more, for a filter below it.
    lines = rows.select("doc_id", "rid", F.posexplode_outer(F.split(plain(F.col("text")), "\n")).alias("line", "norm"))
    lines = lines.select("doc_id", "rid", "line", words_of(F.col("norm")).alias("words"))
    words, n = F.col("words"), F.size("words")
    low = F.when(n >= round(least * LONG, 6), low_hashes(words))
    prints = lines.select("doc_id", "rid", "line", line_key(words, n).alias("key"), n.alias("n"), near_blocks(words, least).alias("near"), low.alias("low"))
    # Not before the table is written: the words would be made once more for the filter.
    return staged(prints, "prints").filter(F.col("n") >= max(1, min_words))


def line_blocks(prints: DataFrame) -> DataFrame:
    """``(key, id)``: the pigeonhole blocks of each line.

    Lines with so few words that those near them differ in one edit, and so in two
    windows of two words, have the first ``PAIRS`` of these. Lines of two edits, which
    spoil six windows of three words, have the first ``THREES`` of these, and so have
    lines up to ``LONG`` words. Longer ones put their different words in the order of
    their ranked hashes and have the first ``SPREAD`` windows of two of this ring. Lines whose
    numbers of words may fall on either side of a border have both kinds, lines too short
    for an edit none.
    """
    far = prints.select("key", "low", F.posexplode(F.slice("low", 1, SPREAD)).alias("i", "x"))
    after = F.get("low", F.pmod(F.col("i") + 1, F.size("low")))
    far = far.select(simhash(F.col("x"), after).alias("block"), "key")
    both = prints.select(F.explode("near").alias("block"), "key").unionByName(far)
    return both.select(F.col("block").alias("key"), F.col("key").alias("id"))


def codes_of(words: Column) -> Column:
    """The words as numbers of 16 bits, by hash among 51,200."""
    return F.transform(words, lambda w: (F.pmod(F.xxhash64(w), F.lit(0xC800)) - F.lit(0x8000)).cast("smallint"))


def spelled(codes: Column) -> Column:
    """A string with one character for each code, so that edits of it are edits of words."""
    return F.decode(F.unhex(F.array_join(F.transform(codes, lambda c: F.hex(c.cast("int") + F.lit(0x9000))), "")), "UTF-16BE")


def word_sets(codes: Column) -> Column:
    """The set of the codes modulo 256, in four longs."""

    def part(k: int) -> Column:
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)))
        own = lambda m, c: let(c.cast("int"), lambda x: F.when(F.shiftright(x, 6).bitwiseAND(F.lit(3)) == k, m.bitwiseOR(bit(x))).otherwise(m))
        return F.aggregate(codes, F.lit(0).cast("long"), own)

    return F.array(*(part(k) for k in range(4)))


def line_texts(rows: DataFrame, prints: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, n, codes, sets, own)`` of the lines whose keys are ``ids``; ``own`` has each code once."""
    # Any occurrence of a line will do.
    want = prints.select("key", "rid", "line").join(bounded(ids), prints["key"] == ids["id"], "left_semi")
    want = staged(want.groupBy(F.col("key").alias("id")).agg(F.min(F.struct("rid", "line")).alias("at")).select("id", "at.*"), "wanted")
    # Shuffled at any size: a broadcast would suit small tables only.
    texts = rows.select("rid", "text").join(want.select("rid").distinct().hint("shuffle_hash"), "rid", "left_semi")
    texts = texts.select("rid", F.posexplode(F.split("text", "\n")).alias("line", "raw")).join(want.hint("shuffle_hash"), ["rid", "line"])
    texts = texts.select("id", words_of(plain(F.col("raw"))).alias("words"))
    texts = staged(texts.select("id", F.size("words").alias("n"), codes_of(F.col("words")).alias("codes")).dropDuplicates(["id"]), "texts")
    dropped(want)
    # The sets are made of few lines, where they are asked for.
    return texts.select("id", "n", "codes", word_sets(F.col("codes")).alias("sets"), F.array_distinct("codes").alias("own"))


def alike(least: float):
    """What holds of the lengths and word sets of any two lines of an edit similarity ``least``."""

    def close(a, b) -> Column:
        most = F.floor(F.greatest(a("n"), b("n")) * F.lit(round(1 - least, 6)))
        # An edit takes one word from a set at most.
        lost = lambda x, y: sum(F.bit_count(a_or_b.bitwiseAND(F.bitwise_not(other))) for a_or_b, other in zip(x, y, strict=True)) <= most
        x, y = ([c("sets")[k] for k in range(4)] for c in (a, b))
        # The sets modulo 256 are quick to compare and end most meetings, those of all codes the rest.
        same = F.size(F.array_intersect(a("own"), b("own"))) >= F.greatest(F.size(a("own")), F.size(b("own"))) - most
        return (F.abs(a("n") - b("n")) <= most) & lost(x, y) & lost(y, x) & same

    return close


def line_components(rows: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """``(id, component)``: the groups of lines that share a block and have an edit similarity, 1 - distance / longer length, of ``least`` over words."""
    texts: list[DataFrame] = []

    def facts_of(ids: DataFrame) -> DataFrame:
        if not texts:
            texts.append(line_texts(rows, prints, ids))
        return texts[0].select("id", "n", "sets", "own").join(ids, "id", "left_semi")

    def verify(pairs: DataFrame) -> DataFrame:
        own = texts[0].select("id", "codes")
        both = pairs.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b")
        both = both.withColumn("most", F.floor(F.greatest(F.size("x"), F.size("y")) * F.lit(round(1 - least, 6))).cast("int"))
        # An edit takes one word from a set at most.
        words = F.greatest(F.size(F.array_distinct("x")), F.size(F.array_distinct("y")))
        both = both.filter((F.abs(F.size("x") - F.size("y")) <= F.col("most")) & (F.size(F.array_intersect("x", "y")) >= words - F.col("most")))
        # The distance is sought in a band of that width only.
        near = F.call_function("levenshtein", spelled(F.col("x")), spelled(F.col("y")), F.col("most"))
        return both.filter(near >= 0).select("a", "b")

    return key_components(line_blocks(prints), verify, alike(least), facts_of, may=near_counts(least))


def duplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 1, similarity: float = 0.8) -> DataFrame:
    """``(rid, gone)``: for each text that loses lines, its row hash and the numbers of these lines.

    ``rid`` hashes doc_id and text. Of each group of lines that are equal once
    normalised, or linked by a shared block and an edit similarity of ``similarity``
    over words, the first by doc_id, row hash and line number stays.
    """
    rows = with_rid(docs, doc_id, text)
    prints = line_prints(rows, min_words, similarity)
    groups = line_components(rows, prints, similarity)
    again = prints.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    named = again.join(groups, again["key"] == groups["id"], "full").select(F.coalesce("key", "id").alias("key"), F.coalesce("component", "key").alias("component"))
    named = staged(named, "named")
    repeated = staged(prints.select("doc_id", "rid", "line", "key").join(bounded(named, F.lit(2)), "key").drop("key"), "repeated")
    stays = staged(repeated.groupBy("component").agg(F.min(F.struct("doc_id", "rid", "line")).alias("stays")), "stays")
    gone = repeated.join(bounded(stays, F.lit(4)), "component").filter(~F.struct("doc_id", "rid", "line").eqNullSafe(F.col("stays")))
    gone = staged(gone.groupBy("rid").agg(F.collect_set("line").alias("gone")), "gone")
    dropped(prints, named, repeated, stays)
    return gone


def with_rid(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    own = F.col(text).cast("string")
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), own).alias("rid"), own.alias("text"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` with repeated lines cut out of ``text``; all rows and columns stay.

    ``n_chars``, if there, follows the text. Lines of fewer than ``min_words`` words,
    or of none, stay, as do null texts; a text may become empty. Rows that
    repeat both doc_id and text count as one document and come out alike; a null doc_id
    comes before all others. Other columns, whatever their names, are passed on. Empty in,
    empty out. The settings are those of ``duplicate_lines``.
    """
    gone = duplicate_lines(docs, doc_id, text, **settings).withColumnRenamed("rid", "_tw_rid").withColumnRenamed("gone", "_tw_gone")
    # Few texts lose lines, as a rule: then all texts need not be shuffled to meet them.
    gone = bounded(gone, F.size("_tw_gone") + 4)
    own = F.col(text).cast("string")
    joined = docs.withColumn("_tw_rid", F.xxhash64(F.col(doc_id), own)).join(gone, "_tw_rid", "left")
    lines = F.split(own, "\n")
    stay = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_tw_gone"))
    kept = let(lines, lambda x: F.array_join(F.transform(stay(x), lambda i: F.get(x, i)), "\n"))
    joined = joined.withColumn(text, F.when(F.col("_tw_gone").isNull(), own).otherwise(kept))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return joined.select(*docs.columns)
