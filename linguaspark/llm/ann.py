"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample; every row is then put into its leaf.
A query walks the tree with a priority queue, always opening the node whose
centre is nearest, and visits leaves in that order. How many leaves are
visited is calibrated: for some rows the true neighbours are found by brute
force over all rows, and visits widen until the wanted share of these
neighbours lies in visited leaves. Visited (query, leaf) pairs meet the
leaf's members in an equi-join of blocks, where distances are exact.

Leaves larger than a block are split into blocks, so equal vectors that
fill a leaf never meet in one task; each block keeps its best k, and a top-k
per query over the blocks is exact for the visited leaves.

Defined cases: vectors that are null, zero, hold a null or non-finite
component or are not of the most common length (ties: the shortest) take no
part; rows with a query's own id are never its neighbours; of several query
rows with one id the least vector counts; fewer candidates than k give
fewer rows; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linguaspark.llm.common import cut_lineage, hash_sample, pick, returning

SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 64 << 20  # fit on at most so much
MAX_LEAVES, LEAF_ROWS, BRANCH = 4096, 256, 16
BLOCK, QUERY_BLOCK = 512, 8192


@dataclass
class Tree:
    """Nodes in arrays; ``kids[i]`` are the children of node i, ``leaf[i]`` its leaf number or -1."""

    centers: np.ndarray
    kids: list[np.ndarray]
    leaf: np.ndarray

    @property
    def n_leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest child at every level (ties: the first)."""
        out = np.empty(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = self.kids[node]
            near = _sq(x[rows], self.centers[kids]).argmin(1)
            todo += [(k, rows[near == i]) for i, k in enumerate(kids) if (near == i).any()]
        return out

    def visits(self, q: np.ndarray, limit: int, least: int = 0, held: np.ndarray | None = None,
               own: dict[int, int] | None = None) -> list[int]:
        """The first ``limit`` leaves in best-bin-first order, and more until they hold ``least`` rows.

        ``held`` has the row count of each leaf, ``own`` the rows among them that do not count.
        """
        heap, out = [(0.0, 0)], []
        while heap and (len(out) < limit or least > 0):
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                out.append(int(self.leaf[node]))
                if held is not None:
                    least -= int(held[out[-1]]) - (own or {}).get(out[-1], 0)
                continue
            kids = self.kids[node]
            diff = self.centers[kids] - q
            for d, k in zip(np.einsum("ij,ij->i", diff, diff).tolist(), kids.tolist(), strict=True):
                heapq.heappush(heap, (d, k))
        return out


def _sq(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        c = distinct
    else:
        c = distinct[rng.choice(len(distinct), k, replace=False)]
        for _ in range(rounds):
            near = _sq(x, c).argmin(1)
            n = np.bincount(near, minlength=len(c))
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            c = total[n > 0] / n[n > 0, None]
    return c, _sq(x, c).argmin(1)


def fit_tree(x: np.ndarray, leaf_rows: float, max_leaves: int = MAX_LEAVES, branch: int = BRANCH, seed: int = 5) -> Tree:
    """Split the fullest node into up to ``branch`` clusters until none holds over ``leaf_rows`` rows of the sample."""
    rng = np.random.default_rng(seed)
    centers, kids, rows = [x.mean(0)], [np.empty(0, np.int64)], {0: np.arange(len(x))}
    heap, leaves = [(-len(x), 0)], 1
    while heap and leaves + branch - 1 <= max_leaves:
        n, node = heapq.heappop(heap)
        if -n <= leaf_rows:
            break
        own = x[rows[node]]
        c, near = _kmeans(own, min(branch, max(2, math.ceil(-n / leaf_rows))), rng)
        if len(c) < 2:
            continue
        kids[node] = np.arange(len(centers), len(centers) + len(c))
        for i in range(len(c)):
            rows[len(centers)] = rows[node][near == i]
            heapq.heappush(heap, (-len(rows[len(centers)]), len(centers)))
            centers.append(c[i])
            kids.append(np.empty(0, np.int64))
        del rows[node]
        leaves += len(c) - 1
    leaf = np.full(len(centers), -1)
    ends = [i for i, k in enumerate(kids) if not len(k)]
    leaf[ends] = np.arange(len(ends))
    return Tree(np.array(centers), kids, leaf)


def usable(df: DataFrame, id: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v as array<double>) of the rows that take part, and their length (0: none)."""
    d = pick(df, id=id, v=vector).select("id", F.col("v").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    d = d.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    top = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if top is None:
        return d, 0
    return d.where(F.size("v") == top["n"]), top["n"]


def _matrix(col: pd.Series, dim: int) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64) if len(col) else np.empty((0, dim))


def nearest(q_id: np.ndarray, q: np.ndarray, m_id: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query row, member row, distance) of the k nearest members of each query, own id left out.

    Members near the k-th place by the expanded square are measured again
    from the differences, so ties and order are those of the exact distance.
    """
    out: tuple[list, list, list] = ([], [], [])
    scale = max((q * q).sum(1).max(initial=0), (m * m).sum(1).max(initial=0))
    for at in range(0, len(q), 256):
        d = _sq(q[at:at + 256], m)
        d[q_id[at:at + 256, None] == m_id[None]] = np.inf
        for i, row in enumerate(d, at):
            if len(row) > k:
                kth = np.partition(row, k - 1)[k - 1]
                near = np.flatnonzero(row <= kth + 1e-9 * scale)
            else:
                near = np.arange(len(row))
            near = near[np.isfinite(row[near])]
            dist = np.sqrt(((m[near] - q[i]) ** 2).sum(1))
            order = np.lexsort((m_id[near], dist))[:k]
            out[0].append(np.full(len(order), i))
            out[1].append(near[order])
            out[2].append(dist[order])
    return tuple(np.concatenate(x) if x else np.empty(0, t) for x, t in zip(out, (int, int, float), strict=True))


def _best(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(df: DataFrame, queries: Column, id: str = "vec_id", vector: str = "embedding", k: int = 10,
           recall: float = 0.97, calibration: int = 128, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance, double) of each query's k nearest found.

    ``queries`` is a condition on a column ``id``: the rows that are
    queries; all rows are candidates. ``recall`` is the calibrated share of
    true neighbours in visited leaves.
    """
    spark = df.sparkSession
    rows, dim = usable(df, id, vector)
    schema = "query_id long, rank int, vec_id long, score double"
    if not dim:
        return spark.createDataFrame([], schema)
    rows = rows.withColumn("id", F.col("id").cast("long"))
    n_sample = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    sample = _matrix(hash_sample(rows, ["id", "v"], n_sample).select("v").toPandas()["v"], dim)
    total = rows.count() if len(sample) == n_sample else len(sample)
    tree = fit_tree(sample, leaf_rows * len(sample) / total)
    shared = spark.sparkContext.broadcast(tree)  # at most MAX_LEAVES * 17 / 16 centres

    @returning
    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(leaf=shared.value.assign(_matrix(b["v"], dim)))

    index = cut_lineage(rows.mapInPandas(put, "id long, v array<double>, leaf long"), "ann-index")
    visits = calibrate(index, tree, dim, k, recall, calibration)

    # blocks: a leaf's members and its visiting queries, both bounded
    q = (index.where(queries).groupBy("id", "leaf").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("n"))
         .groupBy("id").agg(F.min("v").alias("v"), F.map_from_entries(F.collect_list(F.struct("leaf", "n"))).alias("own")))
    count = index.groupBy("leaf").count().toPandas()  # one row per leaf, MAX_LEAVES at most
    held = np.zeros(tree.n_leaves, np.int64)
    held[count["leaf"].to_numpy()] = count["count"].to_numpy()
    shared_held = spark.sparkContext.broadcast(held)

    @returning
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.iloc[at:at + 512]
                leaves = [shared.value.visits(v, visits, k, shared_held.value, own)
                          for v, own in zip(_matrix(part["v"], dim), part["own"], strict=True)]
                yield part[["id", "v"]].assign(leaf=leaves).explode("leaf").astype({"leaf": "int64"})

    walked = cut_lineage(q.mapInPandas(walk, "id long, v array<double>, leaf long"), "ann-visits")
    sizes = (index.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("mb"))
             .join(walked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("qb")), "leaf"))
    sizes = F.broadcast(sizes)  # one row per leaf, MAX_LEAVES at most
    spread = lambda col: F.explode(F.sequence(F.lit(0).cast("long"), F.col(col) - 1))
    members = (index.join(sizes, "leaf").withColumn("m", F.pmod(F.xxhash64("id"), F.col("mb")))
               .withColumn("q", spread("qb")).select("leaf", "m", "q", "id", "v"))
    askers = (walked.join(sizes, "leaf").withColumn("q", F.pmod(F.xxhash64("id"), F.col("qb")))
              .withColumn("m", spread("mb")).select("leaf", "m", "q", "id", "v"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        qi, mi, d = nearest(a["id"].to_numpy(), _matrix(a["v"], dim), b["id"].to_numpy(), _matrix(b["v"], dim), k)
        return pd.DataFrame({"query_id": a["id"].to_numpy()[qi], "vec_id": b["id"].to_numpy()[mi], "score": d})

    key = ["leaf", "m", "q"]
    found = askers.groupBy(*key).cogroup(members.groupBy(*key)).applyInPandas(
        meet, "query_id long, vec_id long, score double")
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def calibrate(index: DataFrame, tree: Tree, dim: int, k: int, recall: float, n: int) -> int:
    """Leaf visits needed so that ``recall`` of the true neighbours of ``n`` hashed rows lie in visited leaves."""
    probes = hash_sample(index.select("id", "v"), ["id", "v"], n).toPandas()
    p_id, p = probes["id"].to_numpy(), _matrix(probes["v"], dim)

    @returning
    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, leaf = b["id"].to_numpy(), b["leaf"].to_numpy()
            qi, mi, d = nearest(p_id, p, ids, _matrix(b["v"], dim), k)
            yield pd.DataFrame({"query_id": qi, "vec_id": ids[mi], "score": d, "leaf": leaf[mi]})

    true = index.mapInPandas(brute, "query_id long, vec_id long, score double, leaf long")
    got = _best(true, k).select("query_id", "leaf").toPandas()  # n * k rows at most
    ranks = []
    for i, leaves in got.groupby("query_id")["leaf"]:
        place = {leaf: r for r, leaf in enumerate(tree.visits(p[i], tree.n_leaves))}
        ranks += [place[leaf] for leaf in leaves]
    if not ranks:
        return tree.n_leaves
    return int(np.sort(ranks)[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)]) + 1
