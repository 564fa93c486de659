"""Chat formatting of reply trees.

Messages are nodes with a parent and a score. Pointer doubling, self-joins that square
the reach of each pointer, finds for every leaf its root, the length and the score of
its path in a logarithmic number of joins; the best leaves are chosen, the nodes of
their paths are marked by the same pointers in turn, and each path becomes one string.
All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, staged

HEAD, MID, TAIL = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    r"""Text in which the template's marks can't occur: ``\``, ``#`` and ``</turn>`` get a backslash."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("#"), F.lit("\\#"))
    return F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))


def escape_role(role: Column) -> Column:
    """A role in which the colon that ends it can't occur either."""
    return F.replace(escape(role), F.lit(":"), F.lit("\\:"))


def unescape(text: Column) -> Column:
    """The inverse of both: a backslash goes, what follows it stays."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def segment(role: Column, text: Column) -> Column:
    """One formatted turn."""
    return F.concat(F.lit(HEAD), escape_role(role), F.lit(MID), escape(text), F.lit(TAIL))


def merged(df: DataFrame) -> DataFrame:
    """A hint to join by shuffle: numbers of nodes take so little room in files that Spark would send many rows through the driver."""
    return df.hint("merge")


def linear(turns: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations as trees without branches: ``(tree, node, parent, role, text, score)``.

    Rows of a conversation are ordered by turn, then role and text; each replies to
    the one before. Repeated rows all count. Nulls come first.
    """
    own = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = turns.select(F.col(tree).alias("tree"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.withColumn("node", F.row_number().over(own).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def best_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """``(tree, leaf, rank, node, depth)``: the nodes of the ``top`` best root-to-leaf paths of each tree.

    ``nodes`` has ``tree, node, parent, score``, ``node`` unique in its tree. A
    path's score is the mean of its nodes'; ties go to the longer path, then the
    smaller leaf. A parent that is missing makes its child a root. Nodes on a cycle
    reach no root and are left out, and so are nodes of a null tree, which ``formatted`` keeps.
    """
    base = nodes.select("tree", "node", "parent", "score")
    known = merged(base.select("tree", F.col("node").alias("parent")).withColumn("has", F.lit(True)))
    links = base.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("has"), F.col("parent")).alias("jump"), "score")
    start = links.select("tree", "node", "jump", F.lit(1).cast("long").alias("steps"), F.col("score").cast("double").alias("total"))
    now = staged(start, "hops-0")
    # Only nodes that have not reached their root take part in the next join.
    ends, hops, limit = now.filter("jump IS NULL"), [now.filter("jump IS NOT NULL")], now.count()
    while not hops[-1].isEmpty() and 2 ** (len(hops) - 1) <= limit:
        far = hops[-1].unionByName(ends).toDF("tree", "jump", "jump2", "steps2", "total2")
        now = hops[-1].join(merged(far), ["tree", "jump"]).select(
            "tree",
            "node",
            F.col("jump2").alias("jump"),
            (F.col("steps") + F.col("steps2")).alias("steps"),
            (F.col("total") + F.col("total2")).alias("total"),
        )
        now = staged(now, f"hops-{len(hops)}")
        ends = ends.unionByName(now.filter("jump IS NULL"))
        hops.append(now.filter("jump IS NOT NULL"))
    parents = hops[0].select("tree", F.col("jump").alias("node")).distinct()
    leaves = ends.join(merged(parents), ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("steps")), F.desc("steps"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    path = staged(chosen.select("tree", F.col("node").alias("leaf"), "rank", "node"), "chosen")
    # A node is 2^k steps over another for each k in the binary form of their distance:
    # going through the pointers from far to near, each adds the other half of the path.
    for hop in reversed(hops[:-1]):
        up = hop.select("tree", "node", "jump")
        path = path.unionByName(path.join(merged(up), ["tree", "node"]).select("tree", "leaf", "rank", F.col("jump").alias("node")))
        path = staged(path.distinct(), "path")
    depths = ends.select("tree", "node", F.col("steps").alias("depth"))
    return path.join(merged(depths), ["tree", "node"]).select("tree", "leaf", "rank", "node", "depth")


def formatted(nodes: DataFrame, top: int = 1, learn_role: str = "assistant") -> DataFrame:
    """``(tree, leaf, rank, formatted, loss_spans)``, a row for each chosen path.

    ``formatted`` holds the turns in order, ``### role: text</turn>`` and a newline
    each, with marks inside texts escaped. ``loss_spans`` says what the loss covers:
    for each turn of ``learn_role`` the turn's number from 0, and the start and length
    of its text in characters of that turn. Null texts and roles count as empty, and a null
    tree is one like others.
    """
    # A struct of a null equals itself, so joins find it.
    nodes = nodes.withColumn("tree", F.struct(F.col("tree").alias("key")))
    rows = best_paths(nodes, top).join(merged(nodes.select("tree", "node", "role", "text")), ["tree", "node"])
    made = segment(F.col("role"), F.col("text"))
    size = F.length(escape(F.col("text")))
    start = F.length(made) - size - len(TAIL)
    turn = F.struct(F.col("depth"), made.alias("made"), (F.col("role") == learn_role).alias("learn"), start.alias("start"), size.alias("length"))
    paths = rows.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.transform(
        F.filter(F.transform("turns", lambda x, i: F.struct(i.alias("turn"), x["start"].alias("start"), x["length"].alias("length"), x["learn"].alias("learn"))), lambda x: x["learn"]),
        lambda x: F.struct(x["turn"].alias("turn"), x["start"].alias("start"), x["length"].alias("length")),
    )
    text = F.array_join(F.transform("turns", lambda x: x["made"]), "")
    return paths.select(F.col("tree.key").alias("tree"), "leaf", "rank", text.alias("formatted"), spans.alias("loss_spans"))


def read_back(out: DataFrame) -> DataFrame:
    """``out`` with ``turns``, an array of (role, text), and ``loss_text``, both parsed from the formatted string."""
    parts = F.filter(F.split("formatted", TAIL), lambda x: x != "")
    parsed = F.transform(
        "_tw_parts",
        lambda p: F.struct(
            unescape(F.regexp_extract(p, r"(?s)^### ((?:[^\\:]|\\.)*): ", 1)).alias("role"),
            unescape(F.regexp_replace(p, r"(?s)^### (?:[^\\:]|\\.)*: ", "")).alias("text"),
        ),
    )
    loss = let(
        F.col("_tw_parts"),
        lambda p: F.transform("loss_spans", lambda s: F.substring(F.get(p, s["turn"]), s["start"] + 1, s["length"])),
    )
    out = out.withColumn("_tw_parts", parts)
    return out.withColumns({"turns": parsed, "loss_text": unescape(F.array_join(loss, ""))}).drop("_tw_parts")
