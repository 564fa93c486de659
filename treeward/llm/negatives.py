"""Hard negatives by exact inner-product search in a forest of cover trees.

A row's vector gets one more component, the square root of what its squared norm lacks
to the greatest one. So all rows have one norm, and the inner product with an anchor,
whose extra component is 0, is at most that with a node's centre plus the anchor's norm
times the node's covering radius, and at least that less the same.

The forest has two storeys. A net of a bounded sample parts all rows into cells of known
radius, and cells into chunks of some 2,000 rows by a hash, so no cell is too large for
a task. Each chunk gets a cover tree in the task that searches it: nodes are nets of
their points, each level's with the radius that it really covers. An anchor goes to the
cells that its bounds admit; a floor under its results comes from the sample, whose
rows are candidates too. In a tree it descends by levels, leaves with the best bounds
come first, and a leaf that is outside the window of admitted scores or under the worst
result so far is skipped; what is left is compared exactly. The search is exact: the
sample only makes it shorter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged

#: Rows whose net makes the cells and whose scores are the first floors; pivots of that net; rows a tree, points a leaf, children a node.
SAMPLE, PIVOTS, CHUNK, LEAF, FAN = 1024, 32, 2048, 64, 16
LOW, HIGH = -(1 << 62), 1 << 62
_FOUND = "a_rid long, a_key long, a_id long, p_id long, p_score long, score long, vec_id long, rid long"


def prepared(rows: DataFrame, scale: int = 256, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(rid, vec_id, label, v)`` of rows that take part, ``v`` being the vector in whole numbers, written down.

    Rows with a null id, label or vector, and with a null, infinite or NaN component, take
    no part. Components are held to what keeps a score times 100 a long: 2^28 over the
    square root of their number, far beyond any embedding.
    """
    x = F.col(vector)
    fine = F.col(id).isNotNull() & F.col(label).isNotNull() & x.isNotNull()
    fine &= ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    most = F.floor(F.lit(float(1 << 28)) / F.sqrt(F.greatest(F.size(x), F.lit(1)))).cast("long")
    whole = F.transform(x, lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale).cast("long"), most), -most))
    out = rows.filter(fine).select(F.monotonically_increasing_id().alias("rid"), F.col(id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), whole.alias("v"))
    return staged(out, "vectors")


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """An Arrow column of lists as a matrix of longs; what a shorter vector lacks is 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), np.int64)
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact inner products of whole-number rows; in doubles where these are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 2**53 else a @ b.T


def augmented(v: np.ndarray, norm2: float) -> np.ndarray:
    """Vectors with the component that lifts each to the norm."""
    x = v.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(0, norm2 - (x * x).sum(1)))[:, None]])


def net(x: np.ndarray, most: int, within: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, nearest, distance): points taken farthest first until all are within a distance of one, ``most`` at most."""
    centres, nearest = [0], np.zeros(len(x), np.int64)
    away = ((x - x[0]) ** 2).sum(1)
    while len(centres) < most:
        far = int(away.argmax())
        if away[far] <= within * within:
            break
        new = ((x - x[far]) ** 2).sum(1)
        nearest[new < away] = len(centres)
        away = np.minimum(away, new)
        centres.append(far)
    return np.array(centres), nearest, np.sqrt(away)


class CoverTree:
    """Nodes by level over the rows of a chunk, and the leaves with their points."""

    def __init__(self, v: np.ndarray, label: np.ndarray, ids: np.ndarray, rids: np.ndarray, norm2: float):
        self.v, self.label, self.ids, self.rids = v, label, ids, rids
        x = augmented(v, norm2)
        #: Of each level the nodes' centres, radii, parents, and the leaf that a node is or -1.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.leaves: list[np.ndarray] = []
        nodes = [(0, np.arange(len(x)), 0)]
        while nodes:
            centres, radii, parents, leaf, below = [], [], [], [], []
            for centre, points, parent in nodes:
                radius = float(np.sqrt(((x[points] - x[centre]) ** 2).sum(1).max()))
                leaf.append(len(self.leaves) if len(points) <= LEAF else -1)
                if len(points) <= LEAF:
                    self.leaves.append(points)
                elif radius == 0:  # equal points have no net
                    below += [(centre, points[i : i + LEAF], len(centres)) for i in range(0, len(points), LEAF)]
                else:
                    own, nearest, _ = net(x[points], FAN, radius / 2)
                    below += [(points[c], points[nearest == i], len(centres)) for i, c in enumerate(own)]
                centres.append(centre)
                radii.append(radius)
                parents.append(parent)
            self.levels.append((v[np.array(centres)], np.array(radii), np.array(parents), np.array(leaf)))
            nodes = below

    def search(self, q: np.ndarray, label: np.ndarray, rid: np.ndarray, same: bool, k: int, lo: np.ndarray, hi: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, point, score) of each query's ``k`` best rows of its label, or of others, within its window; and the leaves compared.

        Ties at the k-th place all come. Rows under ``floor`` can't be among a query's best
        anywhere; a query's own row never counts.
        """
        best = np.full((len(q), k), LOW)
        least = np.maximum(floor, lo)
        length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        bound = np.full((len(q), len(self.leaves)), -np.inf)
        open_ = np.ones((len(q), 1), bool)
        for centres, radii, parents, leaf in self.levels:
            at = products(q, centres).astype(np.float64)
            slack = length[:, None] * radii * (1 + 1e-9) + 1
            open_ = open_[:, parents] & (at + slack >= least[:, None]) & (at - slack <= hi[:, None])
            ends = leaf >= 0
            bound[:, leaf[ends]] = np.where(open_[:, ends], np.minimum(at + slack, hi[:, None])[:, ends], -np.inf)
        order = np.argsort(-bound, axis=1, kind="stable")
        found, compared, start, wide = [], 0, 0, 1
        while start < len(self.leaves):
            wave = order[:, start : start + wide]
            top = np.take_along_axis(bound, wave, 1)
            live = (top > -np.inf) & (top >= least[:, None])
            if not live.any():
                break  # bounds fall along the order
            who, leaf = np.nonzero(live)[0], wave[live]
            by = np.argsort(leaf, kind="stable")
            ends = np.searchsorted(leaf[by], np.arange(len(self.leaves) + 1))
            for points, s, e in zip(self.leaves, ends, ends[1:], strict=False):
                if s == e:
                    continue
                compared += int(e - s)
                at = who[by[s:e]]
                score = products(q[at], self.v[points])
                ok = ((self.label[points] == label[at][:, None]) == same) & (self.rids[points] != rid[at][:, None])
                ok &= (score >= least[at][:, None]) & (score <= hi[at][:, None])
                score = np.where(ok, score, LOW)
                both = np.hstack([best[at], score])
                best[at] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                i, j = np.nonzero(ok)
                found.append((at[i], points[j], score[i, j]))
            least = np.maximum(least, best.min(1))
            start, wide = start + wide, wide * 8
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none, compared
        i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = score >= least[i]
        return i[keep], j[keep], score[keep], compared


class Forest:
    """Candidates in cells and chunks, and what the driver knows of them: bounded, whatever the number of rows."""

    def __init__(self, rows: DataFrame):
        x = F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c * c)
        facts = rows.agg(F.count("*").alias("n"), F.max(x).alias("norm2"), F.max(F.size("v")).alias("dim")).first()
        self.n, self.norm2, self.dim = facts.n, float(facts.norm2 or 0), int(facts.dim or 0)
        if not self.n:
            return
        sample = rows.orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE).toArrow()
        self.sample = matrix(sample["v"], self.dim)
        self.sample_label, self.sample_rid = (sample[c].to_numpy() for c in ("label", "rid"))
        self.pivots = self.sample[net(augmented(self.sample, self.norm2), PIVOTS, 0)[0]]
        cells = rows.mapInArrow(self._cells(), "rid long, vec_id long, label long, v array<long>, cell int, away double")
        cells = staged(cells, "cells")
        known = {r.cell: (r.n, r.radius) for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
        self.radius = np.array([known.get(i, (0, -1))[1] for i in range(len(self.pivots))])
        self.chunks = np.array([math.ceil(known.get(i, (0, 0))[0] / CHUNK) for i in range(len(self.pivots))])
        counts = F.element_at(F.array(*map(F.lit, self.chunks.tolist())), F.col("cell") + 1)
        self.rows = cells.select("rid", "vec_id", "label", "v", "cell", F.pmod(F.xxhash64("rid"), counts).cast("int").alias("chunk"))
        self.trees = int(self.chunks.sum())

    def _cells(self):
        pivots, norm2, dim = augmented(self.pivots, self.norm2), self.norm2, self.dim

        def run(batches):
            for b in batches:
                x = augmented(matrix(b["v"], dim), norm2)
                near2 = np.stack([((x - p) ** 2).sum(1) for p in pivots], 1)
                cell = near2.argmin(1)
                away = np.sqrt(near2[np.arange(len(x)), cell])
                yield pa.RecordBatch.from_arrays([*(b[c] for c in ("rid", "vec_id", "label", "v")), pa.array(cell, pa.int32()), pa.array(away)], ["rid", "vec_id", "label", "v", "cell", "away"])

        return run

    def _route(self, same: bool, k: int):
        """For each query its floor from the sample, and a row for each cell that its bounds admit."""
        sample, labels, rids, pivots, radius, dim = self.sample, self.sample_label, self.sample_rid, self.pivots, self.radius, self.dim

        def run(batches):
            for b in batches:
                q = matrix(b["v"], dim)
                label, rid, lo, hi = (b[c].to_numpy(zero_copy_only=False) for c in ("label", "a_rid", "lo", "hi"))
                score = products(q, sample)
                ok = ((labels == label[:, None]) == same) & (rids != rid[:, None]) & (score >= lo[:, None]) & (score <= hi[:, None])
                score = np.where(ok, score, LOW)
                floor = np.partition(score, -k, axis=1)[:, -k] if len(sample) >= k else np.full(len(q), LOW)
                at = products(q, pivots).astype(np.float64)
                slack = np.sqrt((q.astype(np.float64) ** 2).sum(1))[:, None] * np.maximum(radius, 0) * (1 + 1e-9) + 1
                i, cell = np.nonzero((radius >= 0) & (at + slack >= np.maximum(floor, lo)[:, None]) & (at - slack <= hi[:, None]))
                out = b.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(floor[i]), pa.array(cell, pa.int32())], [*out.schema.names, "floor", "cell"])

        return run

    def _search(self, same: bool, k: int):
        norm2, dim = self.norm2, self.dim

        def run(batches):
            tree = key = None
            held: list[pa.RecordBatch] = []
            for b in batches:
                keys = np.stack([b["cell"].to_numpy(), b["chunk"].to_numpy(), b["query"].to_numpy(zero_copy_only=False)], 1)
                cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
                for s, e in zip([0, *cuts], [*cuts, len(b)], strict=True):
                    if s == e:
                        continue
                    part, at = b.slice(s, e - s), tuple(keys[s])
                    if at[:2] != key:
                        tree, key, held = None, at[:2], []
                    if not at[2]:
                        held.append(part)
                        continue
                    if not held and tree is None:
                        continue
                    if tree is None:
                        rows = pa.Table.from_batches(held)
                        tree = CoverTree(matrix(rows["v"], dim), *(rows[c].to_numpy() for c in ("label", "vec_id", "a_rid")), norm2)
                        held = []
                    label, rid, lo, hi, floor = (part[c].to_numpy(zero_copy_only=False) for c in ("label", "a_rid", "lo", "hi", "floor"))
                    i, j, score, _ = tree.search(matrix(part["v"], dim), label, rid, same, k, lo, hi, floor)
                    took = part.take(pa.array(i))
                    columns = [took[c] for c in ("a_rid", "a_key", "vec_id", "p_id", "p_score")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array(tree.ids[j]), pa.array(tree.rids[j])], ["a_rid", "a_key", "a_id", "p_id", "p_score", "score", "vec_id", "rid"])

        return run

    def best(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """Each query's ``k`` best rows of its label, or of others: the query's columns with ``score, vec_id, rid, rank``.

        ``queries`` has ``a_rid, a_key, vec_id, p_id, p_score, label, v, lo, hi``: scores count from
        ``lo`` to ``hi``, and the row ``a_rid`` does not. ``a_key`` tells queries of one row apart.
        """
        width = queries.schema.fieldNames()
        routed = queries.mapInArrow(self._route(same, k), T.StructType([*queries.schema.fields, T.StructField("floor", T.LongType()), T.StructField("cell", T.IntegerType())]))
        counts = F.element_at(F.array(*map(F.lit, self.chunks.tolist())), F.col("cell") + 1)
        routed = routed.withColumn("chunk", F.explode(F.sequence(F.lit(0), counts - 1))).withColumn("query", F.lit(True))
        none = F.lit(0).cast("long")
        trees = self.rows.withColumnRenamed("rid", "a_rid").withColumns({"query": F.lit(False), **{c: none for c in [*width, "floor"] if c not in ("a_rid", "vec_id", "label", "v")}})
        parts = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), self.trees)
        both = trees.unionByName(routed).repartition(parts, "cell", "chunk").sortWithinPartitions("cell", "chunk", "query")
        found = both.mapInArrow(self._search(same, k), _FOUND)
        own = Window.partitionBy("a_rid", "a_key").orderBy(F.desc("score"), "vec_id", "rid")
        return found.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column | None = None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, **names) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``anchor`` is a condition on ``vec_id``, each 50th by default. An anchor's positives are the
    best other rows of its label, and of each come the best rows of other labels whose score is
    ``low`` to ``high`` hundredths of the positive's; fewer where there are fewer. Ties go to the
    smaller id. Repeated rows all count: each is its own anchor and another's positive, so results
    may repeat. Negative scores of positives admit nothing, a score of 0 just 0. Rows of ``prepared``
    take part; vectors of different lengths compare with zeros. Empty tables give no rows; other
    columns, whatever their names, do not matter.
    """
    spark = rows.sparkSession
    base = prepared(rows, **names)
    forest = Forest(base)
    if not forest.n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    zero = F.lit(0).cast("long")
    asked = base.filter(F.col("vec_id") % 50 == 0 if anchor is None else anchor).withColumnRenamed("rid", "a_rid")
    asked = asked.select("a_rid", zero.alias("a_key"), "vec_id", zero.alias("p_id"), zero.alias("p_score"), "label", "v", F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi"))
    near = staged(forest.best(asked, True, positives), "positives")
    # 50 p <= 100 n <= 95 p, n being whole.
    lo, hi = F.expr(f"(p_score * {low} + 99) div 100"), F.expr(f"(p_score * {high}) div 100")
    windows = near.filter("score >= 0").select("a_rid", F.col("rank").cast("long").alias("a_key"), F.col("vec_id").alias("p_id"), F.col("score").alias("p_score"))
    windows = windows.join(asked.select("a_rid", "vec_id", "label", "v"), "a_rid").withColumns({"lo": lo, "hi": hi})
    found = forest.best(windows.select(*asked.columns), False, negatives)
    return found.select(F.col("a_id").alias("anchor_id"), F.col("p_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("p_score").alias("positive_score"), F.col("score").alias("negative_score"))
