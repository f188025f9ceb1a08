"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes: vectors are centred and rotated by ``ROTATIONS`` orthogonal matrices learned by iterative
quantisation on a bounded sample (``SAMPLE`` rows); the signs are the bits. The Hamming radius is learned on
the same sample: the ``QUANTILE`` of the distances between the codes of a sampled query and its nearest
neighbours in the sample. Neighbours in the whole table are at least as near, so the radius errs to the wide
side.

Index: every row's code is split into substrings of ``SUB_BITS``, each indexed by value. By the pigeonhole principle a
code within the radius r must be within t_i of the query in some substring i when the sum of all (t_i + 1) is
r + 1; the thresholds are dealt out evenly. Probing substring i visits the occupied index cells within t_i. All
codes found are checked for their whole distance, and those within the radius are ranked by the exact distance of
their vectors. Where fewer than k rows lie within the radius it grows until there are k.

The search runs in blocks: the index is hashed into parts of at most about ``PART_ROWS`` rows (fewer where more tasks
can run), the queries into blocks of ``QUERY_BLOCK``; each pair of them is one task, and the best k of every query are
merged at the end. So a row is moved once for each block of queries, and a query once for each part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import sampled

SAMPLE, SAMPLE_QUERIES, ROTATIONS, ITERATIONS, QUANTILE = 4_096, 256, 4, 20, 0.95
PART_ROWS, QUERY_BLOCK, LEAST_ROWS = 65_536, 32_768, 4_096
SUB_BITS = 64  # short substrings would let nearly every code through at the radii of real neighbours


@dataclass
class Coder:
    mean: np.ndarray
    rotation: np.ndarray  # dim x bits
    radius: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Bit codes as substrings of ``SUB_BITS``, [row, substring]."""
        bits = ((x - self.mean) @ self.rotation) > 0
        return np.packbits(bits, axis=1, bitorder="little").view(f"<u{SUB_BITS // 8}")


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all codes in ``a`` to the code ``b``."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int32)


def learn(x: np.ndarray, k: int, seed: int = 5) -> Coder:
    """Rotations by iterative quantisation and the radius, from a sample of vectors."""
    dim = x.shape[1]
    width = -(-dim // SUB_BITS) * SUB_BITS
    mean = x.mean(axis=0)
    y = x - mean
    _, _, axes = np.linalg.svd(y, full_matrices=False) if len(y) >= dim else (None, None, np.eye(dim))
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(ROTATIONS):
        more = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-width // dim) - 1)]
        base = np.concatenate([axes.T, *(axes.T @ m for m in more)], axis=1)[:, :width]
        r = np.linalg.qr(rng.normal(size=(width, width)))[0]
        v = y @ base
        for _ in range(ITERATIONS):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(base @ r)
    coder = Coder(mean, np.concatenate(out, axis=1), width * ROTATIONS)
    codes = coder.codes(x)
    near = []
    for q in rng.permutation(len(x))[:SAMPLE_QUERIES]:
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        near.append(hamming(codes[np.argsort(d)[:k]], codes[q]))
    if near and len(x) > 1:
        coder.radius = int(math.ceil(np.quantile(np.concatenate(near), QUANTILE)))
    return coder


class SubstringIndex:
    """Rows of a part by the value of each substring of their codes. ``probed`` counts the rows that probing has found."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, self.cells, self.probed = codes, [], 0
        for i in range(codes.shape[1]):
            order = np.argsort(codes[:, i], kind="stable")
            values, first = np.unique(codes[order, i], return_index=True)
            self.cells.append((values, np.append(first, len(order)), order))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose whole code is within the radius, and only those."""
        m = len(self.cells)
        each, more = divmod(radius + 1 - m, m)
        found = np.zeros(len(self.codes), bool)
        for i, (values, first, order) in enumerate(self.cells):
            t = each + (i < more)
            if t < 0:
                continue
            hit = np.flatnonzero(np.bitwise_count(values ^ code[i]) <= t)
            size = first[hit + 1] - first[hit]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(np.append(0, size[:-1])), size)
            found[order[np.repeat(first[hit], size) + inner]] = True
        rows = np.flatnonzero(found)
        self.probed += len(rows)
        return rows[hamming(self.codes[rows], code) <= radius]


def search_part(coder: Coder, query_ids, queries, ids, vectors, k: int):
    """For each query its k nearest rows of the part, other than those with its own id: (query, id, distance)."""
    codes = coder.codes(vectors)
    index, wanted = SubstringIndex(codes), coder.codes(queries)
    bits = codes.shape[1] * SUB_BITS
    out = []
    for q, x, code in zip(query_ids, queries, wanted, strict=True):
        radius, rows = coder.radius, np.zeros(0, np.int64)
        while True:
            rows = index.within(code, radius)
            rows = rows[ids[rows] != q]
            if len(rows) >= k or radius >= bits:
                break
            radius = min(bits, radius + max(4, bits // 16))
        d = np.sqrt(((vectors[rows] - x) ** 2).sum(axis=1))
        best = np.lexsort((ids[rows], d))[:k]
        out.append((np.full(len(best), q), ids[rows[best]], d[best]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def usable(vector: Column) -> Column:
    """Neither null nor empty, no null or non-finite component, and not the zero vector."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda c: c != 0), F.lit(False))


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` its k nearest other rows.

    ``score`` is the Euclidean distance in double precision; ties go to the smaller id. Rows without an id and
    vectors that aren't ``usable`` take no part, nor do vectors whose length isn't the most frequent one. Rows
    that share an id are one row, that with the smallest vector. With k rows or fewer all others are returned;
    an empty table gives an empty result. Other columns of the input are ignored."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("x"))).withColumn("dim", F.size("x"))
    sizes = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], result)
    dim, n = sizes[0]["dim"], sizes[0]["count"]
    rows = rows.filter(F.col("dim") == dim).select("id", "x")
    sample = sampled(rows, SAMPLE, n, "id").toArrow()
    coder = spark.sparkContext.broadcast(learn(_matrix(sample.column("x"), dim), k))

    parts = max(1, math.ceil(n / PART_ROWS), min(spark.sparkContext.defaultParallelism, math.ceil(n / LEAST_ROWS)))
    query_blocks = max(1, math.ceil(n / every / QUERY_BLOCK))
    queries = rows.filter(F.pmod("id", F.lit(every)) == 0)
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    part, block = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(query_blocks)).cast("int")
    left = queries.select("id", "x", block.alias("block"), numbers(parts).alias("part"))
    right = rows.select("id", "x", part.alias("part"), numbers(query_blocks).alias("block"))

    def search(q: pa.Table, r: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(q) and len(r):
            found = search_part(coder.value, *_single(q, dim), *_single(r, dim), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _single(t: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, one row per id: that with the smallest vector."""
    ids, x = t.column("id").to_numpy(), _matrix(t.column("x"), dim)
    if len(np.unique(ids)) == len(ids):
        return ids, x
    order = np.lexsort((*x.T[::-1], ids))
    order = order[np.diff(ids[order], prepend=ids[order[0]] - 1) != 0]
    return ids[order], x[order]
