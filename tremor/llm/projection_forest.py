"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample: a node projects on the direction between two of its vectors and splits at
the median. Every vector of the table is sent down every tree to a leaf. A query descends all trees through one
shared priority queue, nearest side first, until the leaves it has opened hold the wanted share of the rows; opened
leaves and their vectors meet by a join on the leaf, are compared exactly, and the nearest of each leaf go on to one
merge for each query.

Equal vectors are one point, held with the smallest ids that can be among a query's neighbours, so copies cost
nothing. Leaves and the queries that open them are cut into blocks of bounded size.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.plans.loops import CutTable

#: Vectors the trees are fitted on, at most.
SAMPLE = 1 << 15
ROW_BLOCK, QUERY_BLOCK = 4096, 512


@dataclass(frozen=True)
class Forest:
    """Perfect binary trees of one depth: ``normal[t, n]`` and ``offset[t, n]`` of inner node n, children 2n+1 and 2n+2."""

    normal: np.ndarray
    offset: np.ndarray
    depth: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(tree, row): the leaf of each vector in each tree."""
        out = np.empty((len(self.normal), len(x)), np.int32)
        for t in range(len(self.normal)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", x, self.normal[t, node]) > self.offset[t, node]
                node = 2 * node + 1 + right
            out[t] = node - ((1 << self.depth) - 1)
        return out

    def opened(self, q: np.ndarray, rows: np.ndarray, wanted: float) -> list[tuple[int, int]]:
        """Leaves (tree, leaf) in the order in which a query opens them until they hold ``wanted`` rows; rows: (tree, leaf)."""
        inner = (1 << self.depth) - 1
        margin = self.normal @ q - self.offset
        queue = [(0.0, t, 0) for t in range(len(self.normal))]  # (largest distance past a split on the way, tree, node)
        found, held = [], 0
        while queue and held < wanted:
            past, t, node = heapq.heappop(queue)
            if node >= inner:
                if rows[t, node - inner]:
                    found.append((t, node - inner))
                    held += rows[t, node - inner]
                continue
            m = margin[t, node]
            heapq.heappush(queue, (max(past, m), t, 2 * node + 1))
            heapq.heappush(queue, (max(past, -m), t, 2 * node + 2))
        return found


def fit(sample: np.ndarray, trees: int, leaves: int, seed: int) -> Forest:
    """``trees`` trees with at least ``leaves`` leaves each (a power of two, and no more than the sample has vectors)."""
    depth = 0
    while (1 << depth) < min(leaves, max(len(sample), 1)):
        depth += 1
    rng = np.random.default_rng(seed)
    normal = np.zeros((trees, max((1 << depth) - 1, 1), sample.shape[1]))
    offset = np.zeros(normal.shape[:2])
    for t in range(trees):
        members = [np.arange(len(sample))]
        for node in range((1 << depth) - 1):
            own = members[node]
            w = np.zeros(sample.shape[1])
            if len(own) > 1:
                a, b = sample[rng.choice(own, 2, replace=False)]
                w = a - b
            if not w.any():
                w = rng.normal(size=sample.shape[1])
            w /= np.linalg.norm(w)
            p = sample[own] @ w
            normal[t, node], offset[t, node] = w, np.median(p) if len(own) else 0.0
            right = p > offset[t, node]
            members += [own[~right], own[right]]
    return Forest(normal, offset, depth)


def _clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector): null, empty and zero vectors and those with null or non-finite components left out."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    nonzero = F.exists(v, lambda x: x != 0.0)
    # 0.0 + x turns -0.0 into 0.0, so that equal vectors are equal keys
    return vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & nonzero).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("vector"))


def search(vectors: DataFrame, is_query, k: int = 10, *, trees: int = 8, leaf_rows: int = 512, share: float = 1.2, sample: int = SAMPLE, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row for which ``is_query`` holds.

    ``share`` is the number of rows to open, over all trees, in parts of the table's points; a query opens more if
    that leaves it without k others. Rows with one ``vec_id`` and different vectors are each candidates; a query's
    own id never is. Vectors of another length than most are compared with those of their own length only.
    """
    spark = vectors.sparkSession
    clean = CutTable(_clean(vectors).withColumn("is_query", is_query)).df
    sizes = [r["d"] for r in clean.groupBy(F.size("vector").alias("d")).count().orderBy(F.col("count").desc(), "d").toLocalIterator()]
    out = None
    for d in sizes:
        part = _search_one(clean.where(F.size("vector") == d), k, trees, leaf_rows, share, sample, seed)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")


def _search_one(clean: DataFrame, k: int, trees: int, leaf_rows: int, share: float, sample: int, seed: int) -> DataFrame:
    spark = clean.sparkSession
    # a point: one vector, its k + 1 smallest ids (one may be the query's own), one number
    by = Window.partitionBy("vector").orderBy("vec_id")
    ids = clean.select("vector", "vec_id").distinct().withColumn("no", F.row_number().over(by)).where(F.col("no") <= k + 1)
    held = ids.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = CutTable(held.select(F.element_at("ids", 1).alias("point"), F.xxhash64("vector").alias("salt"), "vector", "ids")).df
    total = points.count()
    part = min(1.0, 1.2 * sample / max(total, 1))
    rows = points.where(F.pmod(F.xxhash64(F.lit(seed), "vector"), F.lit(1 << 40)) < F.lit(part * float(1 << 40))).select("vector").limit(sample).toLocalIterator()
    fitted = np.array([r["vector"] for r in rows] or [r["vector"] for r in points.select("vector").take(1)], np.float64)
    forest = fit(fitted, trees, max(1, -(-total // leaf_rows)), seed)
    shared = spark.sparkContext.broadcast(forest)

    def to_leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vector"))
            for t, leaf in enumerate(shared.value.leaves(x)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(leaf), *b.columns], names=["tree", "leaf", *b.schema.names])

    placed = CutTable(points.mapInArrow(to_leaves, "tree int, leaf int, point bigint, salt bigint, vector array<double>, ids array<bigint>")).df
    counts = np.zeros((trees, 1 << forest.depth), np.int64)  # bounded by the sample, not by the table
    for r in placed.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        counts[r["tree"], r["leaf"]] = r["n"]
    wanted = max(share * total, float(2 * (k + 1)))
    asked = CutTable(clean.where("is_query").select("vec_id", "vector")).df
    queries = asked.groupBy("vector").agg(F.min("vec_id").alias("query"))
    n_queries = queries.count()
    blocks = np.maximum(1, -(-counts // ROW_BLOCK))
    query_blocks = max(1, -(-n_queries // QUERY_BLOCK))

    def to_opened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vector"))
            for j, q in enumerate(x):
                rows_ = [(t, leaf, block) for t, leaf in shared.value.opened(q, counts, wanted) for block in range(blocks[t, leaf])]
                one = b.slice(j, 1).take(pa.array(np.zeros(len(rows_), np.int64)))
                cols = [pa.array(c, pa.int32()) for c in zip(*rows_)]
                yield pa.RecordBatch.from_arrays([*cols, *one.columns], names=["tree", "leaf", "block", *b.schema.names])

    opened = queries.mapInArrow(to_opened, "tree int, leaf int, block int, vector array<double>, query bigint")
    opened = opened.withColumn("query_block", F.pmod(F.xxhash64("query"), F.lit(query_blocks)).cast("int"))
    of = F.create_map(*[F.lit(x) for t in range(trees) for leaf in np.flatnonzero(blocks[t] > 1).tolist() for x in (t * counts.shape[1] + leaf, int(blocks[t, leaf]))]) if (blocks > 1).any() else None
    n_blocks = F.coalesce(F.element_at(of, F.col("tree") * counts.shape[1] + F.col("leaf")), F.lit(1)) if of is not None else F.lit(1)
    stored = placed.withColumn("block", F.pmod(F.col("salt"), n_blocks).cast("int")).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    key = ["tree", "leaf", "block", "query_block"]

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            none = np.zeros(0, np.int64)
            return pd.DataFrame({"query": none, "point": none, "d": none.astype(float), "ids": none.astype(object)})
        q, x = np.stack(left["vector"].to_list()), np.stack(right["vector"].to_list())
        norm = (x * x).sum(axis=1)
        near: tuple[list, list] = ([], [])
        for a in range(0, len(q), 64):
            rough = norm[None, :] - 2.0 * (q[a:a + 64] @ x.T)
            most = min(k + 1, len(x))
            bar = np.partition(rough, most - 1, axis=1)[:, most - 1] + 1e-9 * (1.0 + norm.max())
            r, c = np.nonzero(rough <= bar[:, None])
            near[0].append(r + a)
            near[1].append(c)
        r, c = np.concatenate(near[0]), np.concatenate(near[1])
        d = np.sqrt(((q[r] - x[c]) ** 2).sum(axis=1))
        return pd.DataFrame({"query": left["query"].to_numpy()[r], "point": right["point"].to_numpy()[c], "d": d, "ids": right["ids"].to_numpy()[c]})

    near = opened.groupBy(*key).cogroup(stored.groupBy(*key)).applyInPandas(compare, "query bigint, point bigint, d double, ids array<bigint>")
    # a point found in several trees counts once; ranks are cut before the shuffle
    first = Window.partitionBy("query").orderBy("d", "point")
    best = near.groupBy("query", "point").agg(F.first("d").alias("d"), F.first("ids").alias("ids")).withColumn("no", F.row_number().over(first)).where(F.col("no") <= k + 1)
    listed = CutTable(best.select("query", "d", F.explode("ids").alias("vec_id"))).df
    own = asked.join(queries, "vector").select(F.col("vec_id").alias("query_id"), "query").distinct()
    ranked = own.join(listed, "query").where(F.col("query_id") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))
    return ranked.groupBy("query_id", "vec_id").agg(F.min("d").alias("d")).withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("d").alias("score"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
