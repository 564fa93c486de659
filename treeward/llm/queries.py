"""The operators' queries over whole tables, and SQL where it can express them."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, html, langid, licenses, lines, negatives, pii, quality, repair, rules, simhash
from .common import crc32_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The path of the word vocabulary; TREEWARD_TOKENIZERS names another folder."""
    folder = os.environ.get("TREEWARD_TOKENIZERS")
    if not folder:
        folder = os.path.dirname(importlib.util.find_spec("public_tokenizers").origin)
    return os.path.join(folder, "word_bpe_49k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from the labels that are not held out."""
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc32_mod("doc_id", 5) != 0)
    return found.select("doc_id", (crc32_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after line deduplication: its lines before and after, and a digest of its text."""
    docs = table(spark, sf_dir, "documents")
    before = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines")
    out = lines.dedup_lines(docs.select("doc_id", before, "text"))
    return out.select(
        "doc_id",
        "n_lines",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_left"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rules(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(crc32_mod("doc_id", 4) != 2))
    found = langid.identify(docs, model)
    return found.select("doc_id", (crc32_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\\\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.expr(f"'{tricky}'").alias("text"),
    )
    out = chat.read_back(chat.formatted(chat.linear(turns.unionByName(own))))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    found = html.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license notices in documents."""
    return licenses.license_spans(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of documents that align with benchmark items."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each 50th vector, some labels moved on."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.select("vec_id", "embedding", label.alias("label")))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data in every document."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs)[0])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = map(count, pii.BASE)
    base = pii.joined(F.filter("spans", lambda s: s["base"]))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faults of every damaged conversation and its cheapest repair."""
    turns = table(spark, sf_dir, "conversations")
    return repair.repaired_conversations(turns, repair.damaged(turns))


def _plus(e: str, cost: str, letter: str) -> str:
    """SQL of a weight, twelve digits of cost before an audit, with one edit more."""
    return f"lpad(CAST(CAST({e}[1:12] AS BIGINT) + {cost} AS VARCHAR), 12, '0') || {e}[13:] || '{letter}'"


def _step() -> str:
    """SQL of the four states' weights after a turn, from those before it, with what may be put in."""
    two = f"least(s.w[3], {_plus('s.w[1]', '3', 'I')}, {_plus('s.w[2]', '3', 'I')}, {_plus('s.w[4]', '3', 'I')})"
    return f"""
  SELECT f.conv_id, f.n, [
    {_plus('w0', '4', 'D')},
    least({_plus('w1', '4', 'D')}, CASE WHEN f.i = 's' AND NOT f.del THEN {_plus('w0', 'f.t', 'K')} END),
    least({_plus('w2', '4', 'D')}, CASE WHEN NOT f.del THEN least({_plus('least(w0, w1, w3)', '3 + f.t', 'R')}, CASE WHEN f.i = 'u' THEN {_plus('least(w0, w1, w3)', 'f.t', 'K')} END) END),
    least({_plus('w3', '4', 'D')}, CASE WHEN NOT f.del THEN least({_plus('w2', '3 + f.t', 'R')}, CASE WHEN f.i = 'a' THEN {_plus('w2', 'f.t', 'K')} END) END)]
  FROM (SELECT conv_id, n, w[1] AS w0, w[2] AS w1, w2, least(w[4], {_plus('w2', '3', 'I')}) AS w3 FROM (SELECT s.*, {two} AS w2 FROM s)) x
  JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.n = x.n + 1"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_line_dedup,
        op3_quality_rules,
        op4_simhash_near_dedup,
        op5_language_id,
        op6_chat_formatting,
        op7_html_extraction,
        op8_license_scan,
        op9_bpe,
        op10_decontamination,
        op11_hard_negatives,
        op12_pii,
        op13_conversation_repair,
    )
}

SQL = {
    "op3_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM (
        SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w))),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n >= 2) GROUP BY rid),
s AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
h AS (SELECT source, count(*) AS n, sum(CAST(base_failed AS INT)) AS fails FROM b GROUP BY source),
m AS (SELECT sum(fails) / sum(n) AS mean, sum(n * (fails / n) * (fails / n)) / sum(n) AS sq, count(*) / sum(n) AS share FROM h),
p AS (SELECT mean, greatest(mean * (1 - mean) / greatest(sq - mean * mean - mean * (1 - mean) * share, 1e-6) - 1, 1.0) AS strength FROM m),
v AS (SELECT source, (fails + mean * strength) / (n + strength) > 0.5 AS host_failed FROM h, p)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
""",
    "op6_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>') AS escaped,
        replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ':', '\:') AS named FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(named) + 2 + length(escaped) + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op11_hard_negatives": r"""
WITH e AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.rid AS other, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.rid <> b.rid WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id, other) <= 5),
n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, p.score AS positive_score, s.other_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other_id, s.other) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
""",
    "op13_conversation_repair": rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
b AS (
  SELECT *, flatten(list_transform(string_split(name, ''), lambda x: list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda j: CAST((ascii(x) >> j) & 1 AS BIGINT)))) AS bits FROM k),
h AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(bits, lambda a, x: xor(a >> 1, CASE WHEN xor(a & 1, x) = 1 THEN 3988292384 ELSE 0 END), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 20 AS kind FROM b),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM h WHERE kind <> 0)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM d),
g AS (
  SELECT *, role[1:1] AS i, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1:1] AS pair FROM o),
f AS (SELECT *, fault IN ('blank', 'duplicate') AS del, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS t FROM g),
z AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
s AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, ['000000000000', NULL, NULL, NULL]::VARCHAR[] AS w FROM z
  UNION ALL {_step()}),
e AS (
  SELECT s.conv_id, least(w[1], w[4], {_plus('w[3]', '3', 'I')}, {_plus('w[2]', '6', 'II')}) AS best FROM s JOIN z ON z.conv_id IS NOT DISTINCT FROM s.conv_id AND z.n = s.n),
r AS (
  SELECT conv_id, best[13:] AS audit, CAST(best[1:12] AS BIGINT) AS cost, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS n, 0 AS state, []::VARCHAR[] AS out FROM e
  UNION ALL
  SELECT r.conv_id, r.audit, r.cost, r.k + 1, r.n + CASE WHEN l = 'I' THEN 0 ELSE 1 END,
    CASE WHEN l = 'D' THEN r.state WHEN l = 'K' AND f.i = 's' THEN 1 WHEN r.state = 2 THEN 3 ELSE 2 END,
    CASE l WHEN 'D' THEN r.out WHEN 'K' THEN list_append(r.out, f.role || ':' || f.text) ELSE list_append(r.out, CASE WHEN r.state = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN l = 'R' THEN f.text ELSE '' END) END
  FROM (SELECT *, audit[k + 1:k + 1] AS l FROM r WHERE k < length(audit)) r LEFT JOIN f ON l <> 'I' AND f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.n = r.n + 1)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(r.audit, '') AS audit, sha256(coalesce(array_to_string(r.out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id AND r.k = length(r.audit)
""",
}
