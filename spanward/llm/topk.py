"""Exact inner-product top-k by norm order and rotated partial sums.

Vectors are laid out by descending length, once. A query whose length times that of the longest vector of a block is
below its k-th score so far passes that block over; a reread may bring blocks in any order. For the others the first coordinates after a rotation, the singular vectors
of a sample, give most of the product, and Cauchy-Schwarz bounds what the other coordinates can add; only vectors that
could still enter are multiplied exactly, in integers. Every query starts from its k-th score among the longest
vectors. The rotation and the start only decide how much is pruned: results are exact.

Queries go to the vectors in chunks of ``CHUNK`` rows, which bounds what a task holds besides its batch.

Defined cases: a vector takes part if it is not null and all its components are finite; shorter vectors are filled
with zeros; components are floor(scale * x), whole numbers of any size, and a score that needs more than 63 bits is
refused (``OverflowError``): no long holds it; rows with null id take no part; of
query rows with one id the least vector asks; a query does not meet rows with its own id; repeated rows are vectors of
their own; equal scores go to the smaller id; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, ship, slices

#: Queries of one pass over the vectors.
CHUNK = 4096
#: Longest vectors that give every query a first k-th score.
SEEDS = 2048
#: Vectors whose singular vectors give the rotation.
SAMPLE = 4096
#: Vectors compared at once.
BLOCK = 1024


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024) -> DataFrame:
    """(vec_id, v, norm): integer components of the vectors that take part."""
    wide = F.col(vector_col).cast("array<double>")
    fine = ~F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def floored(x):  # from 52 bits on a double is whole, and may be beyond what floor returns
        y = x * F.lit(float(scale))
        return F.when(F.abs(y) >= 2.0**52, y).otherwise(F.floor(y).cast("double"))

    whole = F.transform(wide, floored)
    kept = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine)
    kept = kept.select(F.col(id_col).cast("bigint").alias("vec_id"), whole.alias("v"))
    return kept.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    sizes = np.diff(column.offsets.to_numpy())
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class Best:
    """The k best (score, id) of every query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.query, self.score, self.vec = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        query, score, vec = np.append(self.query, query), np.append(self.score, score), np.append(self.vec, vec)
        order = np.lexsort((vec, -score, query))
        query, score, vec = query[order], score[order], vec[order]
        first = np.searchsorted(query, query)
        rank = np.arange(len(query)) - first
        keep = rank < self.k
        self.query, self.score, self.vec = query[keep], score[keep], vec[keep]
        last = rank[keep] == self.k - 1
        self.floor[self.query[last]] = np.maximum(self.floor[self.query[last]], self.score[last])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers: floats hold them below 53 bits, longs below 63, else Python's integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    left, right = ([[int(x) for x in row] for row in m.tolist()] for m in (a, b))
    exact = [[sum(x * y for x, y in zip(p, q)) for q in right] for p in left]
    return np.array(exact, object).astype(np.int64)


def _search(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, floor, rotation, head = sent.value
        width = q.shape[1]
        turned = q @ rotation
        q_norm = np.linalg.norm(q, axis=1)
        q_rest = np.sqrt(np.maximum((turned[:, head:] ** 2).sum(axis=1), 0))
        best = Best(len(ids), k, floor)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                norm = part.column(2).to_numpy()
                # a task reads several files in any order, so a block can begin with the short end of one of them
                live = np.flatnonzero(q_norm * norm.max() * (1 + 1e-9) + 1 >= best.floor)
                if not len(live):
                    continue
                x, vec = _matrix(part.column(1), width), part.column(0).to_numpy()
                x_turned = x @ rotation
                x_rest = np.sqrt((x_turned[:, head:] ** 2).sum(axis=1))
                bound = turned[live, :head] @ x_turned[:, :head].T + q_rest[live, None] * x_rest[None, :]
                slack = 1 + 1e-9 * q_norm[live, None] * norm[None, :]
                may = (bound + slack >= best.floor[live, None]) & (ids[live, None] != vec[None, :])
                rows, columns = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
                if not len(rows):
                    continue
                exact = products(q[live[rows]], x[columns])
                a, b = np.nonzero(may[np.ix_(rows, columns)])
                score = exact[a, b]
                use = score >= best.floor[live[rows[a]]]
                best.add(live[rows[a]][use], score[use], vec[columns[b]][use])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[best.query], pa.int64()), pa.array(best.vec, pa.int64()), pa.array(best.score, pa.int64())],
            ["query_id", "vec_id", "score"],
        )

    return run


def _rows(df: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    rows = df.select("vec_id", "v").collect()
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r["v"])] = r["v"]
    return np.array([r["vec_id"] for r in rows], np.int64), out


def _first_floor(ids: np.ndarray, q: np.ndarray, seed_ids: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """At most the k-th score of each query among the seeds; minus infinity if they are fewer."""
    scores = np.where(ids[:, None] == seed_ids[None, :], -np.inf, q @ seeds.T)
    if scores.shape[1] < k:
        return np.full(len(ids), -np.inf)
    most = np.linalg.norm(q, axis=1) * np.linalg.norm(seeds, axis=1).max()
    kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return np.where(most < 2.0**52, kth, kth - 1e-9 * most)  # long products are rounded


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of ``queries`` among ``vectors``, both (vec_id, v, norm)."""
    spark = vectors.sparkSession
    ship(spark)
    laid = vectors.repartitionByRange(slices(spark), F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    stored = materialise(laid, "vectors-by-norm")
    asked = materialise(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    width = stored.agg(F.max(F.size("v"))).first()[0] or 1
    width = max(width, asked.agg(F.max(F.size("v"))).first()[0] or 1)
    seed_ids, seeds = _rows(stored.orderBy(F.desc("norm"), "vec_id").limit(SEEDS), width)
    _, sample = _rows(stored.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE), width)
    scaled = sample / max(float(np.abs(sample).max(initial=0)), 1e-300)
    strength, turned = np.linalg.eigh(scaled.T @ scaled)  # squares of the singular values, ascending, and the right vectors
    strength, rotation = np.maximum(strength[::-1], 0), turned[:, ::-1]
    share = np.cumsum(strength) / max(float(strength.sum()), 1e-300)
    head = int(min(width, max(1, np.searchsorted(share, 0.9) + 1)))
    chunks = max(1, -(-asked.count() // CHUNK))
    found = None
    for i in range(chunks):
        ids, q = _rows(asked.where(F.expr(f"pmod(xxhash64(vec_id), {chunks}) = {i}")), width)
        sent = spark.sparkContext.broadcast((ids, q, _first_floor(ids, q, seed_ids, seeds, k), rotation, head))
        one = stored.mapInArrow(_search(sent, k), "query_id bigint, vec_id bigint, score bigint")
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
