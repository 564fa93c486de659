"""Quality rules of documents and of their hosts.

A document fails by its own word counts and repeats, or because its host does: the
failures of each host are counted, the rates are shrunk by a beta prior fitted to all
hosts, and a host whose shrunk rate is too high takes its documents with it. All of
it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, staged

#: What separates words: space and the controls 9 to 13.
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: Column, window: int = 3) -> Column:
    """How many words lie in a window of ``window`` words that the array has twice or more.

    Windows are compared by 64-bit hash. If all differ, as in most texts, that is
    all. Else sorting brings equal windows together, and the positions of the
    repeated ones, in order, each cover what the next leaves of their words.
    """

    def covered(w: Column) -> Column:
        hashes = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (window - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, window))))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(h), lambda s: let(F.array_distinct(F.filter(s, lambda x, i: F.coalesce(x == F.get(s, i + 1), F.lit(False)))), lambda d: some(h, d)))))

    def some(h: Column, repeated: Column) -> Column:
        # A short list is searched for each window; for a long one the windows are sorted with their positions.
        listed = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(repeated, x), i)), lambda i: i.isNotNull())
        by_sort = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), spread)
        return F.when(F.size(repeated) <= 32, let(listed, total)).otherwise(by_sort)

    def spread(s: Column) -> Column:
        same = lambda x, i: F.coalesce(x["h"] == F.get(s, i)["h"], F.lit(False))
        twice = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), total)

    def total(p: Column) -> Column:
        own = F.transform(p, lambda at, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - at, F.lit(window))))
        return F.aggregate(own, F.lit(0), lambda acc, n: acc + n)

    return let(words, covered)


def without(text: Column, characters: str, by: str = "") -> Column:
    """``text`` with each of some characters replaced; plain searches, so that no pattern is run over long texts."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def with_stats(docs: DataFrame, text: str = "text", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """``docs`` with the columns ``STATS`` and ``base_failed``, replacing any of these names.

    A null text counts as empty: all zero, and failed for its lack of words.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    spaced = without(t, WHITE[1:], WHITE[0])
    bare = F.replace(spaced, F.lit(" "), F.lit(""))
    words = F.array_remove(F.split(spaced, " "), "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    lines_twice = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r")))
    docs = docs.withColumn("_tw_words", of_words).withColumns(
        {
            "n_words": F.col("_tw_words.n").cast("long"),
            "word_chars": F.length(bare).cast("long"),
            "n_symbols": (F.length(bare) - F.length(without(bare, SYMBOLS))).cast("long"),
            "n_dup_lines": lines_twice.cast("long"),
            "n_repeat_words": F.col("_tw_words.r").cast("long"),
        }
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return docs.withColumn("base_failed", failed).drop("_tw_words")


def host_verdicts(scored: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """``(host, n, fails, host_rate, host_failed)``, a row for each host, null among them.

    The prior is beta with the mean of all documents' failures and the strength that
    the spread of the hosts' rates beyond chance leaves, by moments: hosts that hardly
    differ pull each other to the mean, and a host with few documents says little.
    ``host_failed`` if the shrunk rate is over ``max_rate``. The driver gets the two numbers of the prior.
    """
    hosts = scored.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("fails"))
    hosts = staged(hosts, "hosts")
    rate = F.col("fails") / F.col("n")
    sums = hosts.agg(
        F.sum("n").alias("docs"),
        F.sum("fails").alias("failed"),
        F.sum(F.col("n") * rate * rate).alias("squares"),
        F.count("*").alias("hosts"),
    )
    mean = F.col("failed") / F.col("docs")
    chance = mean * (1 - mean) * F.col("hosts") / F.col("docs")
    beyond = F.greatest(F.col("squares") / F.col("docs") - mean * mean - chance, F.lit(1e-6))
    prior = sums.select(mean.alias("mean"), F.greatest(mean * (1 - mean) / beyond - 1, F.lit(1.0)).alias("strength")).first()
    mean, strength = (F.lit(float(x or 0.0)) for x in (prior["mean"], prior["strength"]))
    shrunk = (F.col("fails") + mean * strength) / (F.col("n") + strength)
    return hosts.select("host", "n", "fails", shrunk.alias("host_rate"), (shrunk > max_rate).alias("host_failed"))


def judged(scored: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """``scored`` rows, which have ``base_failed``, with the column ``kept``.

    Not kept if the document failed by itself or its host did. A null host is a host
    of its own.
    """
    verdicts = verdicts.select(F.col("host").alias("_tw_host"), F.col("host_failed").alias("_tw_failed"))
    joined = scored.join(verdicts, F.col(host).eqNullSafe(F.col("_tw_host")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("_tw_failed")).drop("_tw_host", "_tw_failed")


def keep_passing(docs: DataFrame) -> DataFrame:
    """The documents that are kept, columns and texts unchanged.

    The texts are counted twice, once for the hosts and once for the documents: that
    costs less than writing the texts down with their counts.
    """
    own = docs.select(*(F.col(c).alias(f"_tw_own_{c}") for c in docs.columns), "text", "source")
    scored = with_stats(own)
    verdicts = host_verdicts(scored.select("source", "base_failed"))
    kept = judged(scored, verdicts).filter("kept")
    return kept.select(*(F.col(f"_tw_own_{c}").alias(c) for c in docs.columns))


def rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``(doc_id, *STATS, base_failed, kept)``, a row for each row of ``docs``.

    Nulls and empty texts fail for their lack of words; repeated rows are judged each
    and counted each for their host; other columns are ignored; empty in, empty out.
    """
    rows = with_stats(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("source")))
    scored = staged(rows.drop("text"), "scored")
    return judged(scored, host_verdicts(scored)).select("doc_id", *STATS, "base_failed", "kept")
