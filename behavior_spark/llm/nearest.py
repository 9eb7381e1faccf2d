"""Approximate nearest neighbours by cross-polytope hashing.

A fast pseudo-rotation (three rounds of random signs and a Hadamard transform) turns a unit vector; its hash is the nearest
signed axis, that is the coordinate of largest absolute value and its sign. A table joins ``width`` such hashes into a
bucket. A query looks into its own bucket and the next best ones (multiprobe), and all that is found there is ranked by the exact cosine.

How many buckets a query looks into is set by measurement: for a bounded sample of queries the true neighbours are found
by brute force over all rows, and the fewest probes are taken that would find ``recall`` of them.

Every row is indexed. Equal vectors are one entry in the index, with the smallest ``k + 1`` ids (no query can have use for more). A
bucket is searched in blocks of rows and of queries, so no task holds a whole large bucket.

Defined results: vectors that are null, zero, of the wrong length (the most common length, the shorter of equals, is right) or hold null or
non-finite components take no part, nor do rows without an id. Rows that repeat id and vector are one row; a query never finds its own id. Ties go to
the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from behavior_spark.llm.common import written


@dataclass(frozen=True)
class CrossPolytope:
    tables: int = 8
    bucket_rows: int = 1_000  # rows in a bucket on average, which sets the number of hashes in a table
    recall: float = 0.96  # wanted, on the sample
    most_probes: int = 512  # per table; if these are too few, buckets are made larger, up to an exact search
    sample: int = 64  # queries in the sample
    block: int = 4_096  # rows of a bucket in one task
    query_block: int = 1_024
    seed: int = 5


class Hash:
    """The rotations and hashes of all tables; a few hundred sign vectors."""

    def __init__(self, dim: int, width: int, conf: CrossPolytope):
        self.dim, self.width, self.tables = dim, width, conf.tables
        self.size = 1 << max(1, math.ceil(math.log2(max(dim, 2))))
        signs = np.random.default_rng(conf.seed).integers(0, 2, (conf.tables, width, 3, self.size)) * 2 - 1
        self.signs = signs.astype(np.float32)

    def turned(self, x: np.ndarray, table: int, part: int) -> np.ndarray:
        y = np.zeros((len(x), self.size), np.float32)
        y[:, : self.dim] = x
        for sign in self.signs[table, part]:
            y *= sign
            step = 1
            while step < self.size:
                y = y.reshape(len(x), -1, 2, step)
                y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), self.size)
                step *= 2
            y /= np.float32(math.sqrt(self.size))
        return y

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for part in range(self.width):
            y = self.turned(x, table, part)
            axis = np.abs(y).argmax(axis=1)
            out = out * (2 * self.size) + 2 * axis + (y[np.arange(len(x)), axis] < 0)
        return out

    def probes(self, x: np.ndarray, table: int, n: int) -> np.ndarray:
        """The n buckets nearest to each vector (all, if there are fewer), nearest first."""
        best = None
        for part in range(self.width):
            y = self.turned(x, table, part)
            signed = np.stack([y, -y], axis=2).reshape(len(x), -1)  # by code 2 * axis + sign
            cost = signed.max(axis=1, keepdims=True) - signed
            order = np.argsort(cost, axis=1, kind="stable")[:, :n]
            cost = np.take_along_axis(cost, order, axis=1)
            if best is None:
                best = cost, order.astype(np.int64)
                continue
            costs = (best[0][:, :, None] + cost[:, None, :]).reshape(len(x), -1)
            codes = (best[1][:, :, None] * (2 * self.size) + order[:, None, :]).reshape(len(x), -1)
            order = np.argsort(costs, axis=1, kind="stable")[:, :n]
            best = np.take_along_axis(costs, order, axis=1), np.take_along_axis(codes, order, axis=1)
        return best[1]


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of one vector with each row in double precision; equal rows give equal values."""
    q, r = query.astype(np.float64), rows.astype(np.float64)
    return (r * q).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((r * r).sum(axis=1)))


def _best(ids: np.ndarray, vectors: np.ndarray, keys: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """For every query its k best rows: a fast product picks what may be among them, the exact measure ranks."""
    unit = vectors.astype(np.float64)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    out = []
    for at in range(0, len(keys), 256):
        q = queries[at : at + 256].astype(np.float64)
        q /= np.sqrt((q * q).sum(axis=1, keepdims=True))
        rough = q @ unit.T
        for i, key in enumerate(keys[at : at + 256]):
            rough[i, ids == key] = -2
            floor = np.partition(rough[i], -k)[-k] if len(ids) > k else -2
            some = np.flatnonzero((rough[i] >= floor - 1e-9) & (ids != key))
            score = cosines(queries[at + i], vectors[some])
            order = np.lexsort((ids[some], -score))[:k]
            out += [(int(key), int(ids[some][j]), float(score[j])) for j in order]
    return out


def valid(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v: array<float>) of the rows that take part."""
    v = F.col(vector).cast("array<float>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(ident).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & fine)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0)).distinct()


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _neighbours(queries: DataFrame, rows: DataFrame, dim: int, k: int) -> dict[int, np.ndarray]:
    """Brute force for a few queries: vectors of their k nearest rows."""
    asked = queries.collect()
    keys, matrix = np.array([r.id for r in asked], np.int64), np.array([r.v for r in asked], np.float32)
    if not len(keys):
        return {}

    def scan(batches):
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
            found = _best(ids, vectors, keys, matrix, k)
            at = {int(i): n for n, i in enumerate(ids)}
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                 pa.array([f[2] for f in found], pa.float64()), pa.array([vectors[at[f[1]]].tolist() for f in found], pa.list_(pa.float32()))],
                ["q", "id", "score", "v"],
            )

    near = rows.mapInArrow(scan, "q long, id long, score double, v array<float>")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    out: dict[int, list] = {}
    for r in near.select("q", "v").collect():
        out.setdefault(r.q, []).append(r.v)
    return {q: np.array(v, np.float32) for q, v in out.items()}


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def probes_needed(hashes: Hash, asked: dict[int, np.ndarray], true: dict[int, np.ndarray], conf: CrossPolytope) -> int | None:
    """The fewest probes per table with which the sample's true neighbours are found often enough; None if that takes too many.

    With one hash in a table every bucket may be probed, which finds all neighbours.
    """
    most = 2 * hashes.size if hashes.width == 1 else min(conf.most_probes, (2 * hashes.size) ** hashes.width)
    ranks = []
    for q, near in true.items():
        best = np.full(len(near), most + 1)
        for table in range(conf.tables):
            probed = hashes.probes(_unit(asked[q][None, :]), table, most)[0]
            where = {int(b): i + 1 for i, b in enumerate(probed)}
            best = np.minimum(best, [where.get(int(b), most + 1) for b in hashes.buckets(_unit(near), table)])
        ranks += best.tolist()
    if not ranks:
        return 1
    ranks = np.sort(ranks)
    needed = int(ranks[min(len(ranks) - 1, math.ceil(conf.recall * len(ranks)) - 1)])
    return needed if needed <= most else None


def search(vectors: DataFrame, is_query: Column | str, k: int = 5, conf: CrossPolytope = CrossPolytope(), ident: str = "vec_id", vector: str = "embedding") -> DataFrame:  # noqa: B008, E501
    """(query_id, rank, vec_id, score): the k nearest rows found for each row for which ``is_query`` (on column id) holds."""
    rows = written(valid(vectors, ident, vector), "vectors")
    queries = rows.where(is_query)
    # Of equal vectors the smallest k + 1 ids: a query can be one of them.
    equal = Window.partitionBy("v").orderBy("id")
    index = written(rows.withColumn("n", F.row_number().over(equal)).where(F.col("n") <= k + 1).drop("n"), "index")
    count = index.count()
    first = index.first()
    dim = len(first.v) if first else 1
    width = max(1, round(math.log(max(count / conf.bucket_rows, 2)) / math.log(2 * (1 << max(1, math.ceil(math.log2(max(dim, 2))))))))
    sample = queries.orderBy(F.xxhash64("id", F.lit(conf.seed)), "id").limit(conf.sample)
    asked = {r.id: np.array(r.v, np.float32) for r in sample.collect()}
    true, tables = _neighbours(sample, index, dim, k), conf.tables
    hashes, probes = None, None
    while probes is None:  # fewer hashes in a table make larger buckets, down to an exact search
        hashes = Hash(dim, width, conf)
        probes, width = probes_needed(hashes, asked, true, conf), width - 1

    def buckets(batches, n: int):
        """n = 0: the bucket of each row; otherwise the n probes of each query."""
        for batch in batches:
            unit = _unit(_matrix(batch.column(1), dim))
            for table in range(tables):
                codes = hashes.probes(unit, table, n) if n else hashes.buckets(unit, table)[:, None]
                take = np.repeat(np.arange(len(unit)), codes.shape[1])
                columns = [pa.array(np.full(len(take), table, np.int32)), pa.array(codes.ravel())]
                yield pa.RecordBatch.from_arrays([*columns, batch.column(0).take(pa.array(take)), batch.column(1).take(pa.array(take))], ["t", "b", "id", "v"])

    ddl = "t int, b long, id long, v array<float>"
    entries = index.mapInArrow(lambda x: buckets(x, 0), ddl)
    looks = queries.mapInArrow(lambda x: buckets(x, probes), ddl)
    # Blocks of large buckets: counts first (ids only), then rows to one block of rows, queries to one block of queries,
    # and each to all blocks of the other.
    sizes = entries.groupBy("t", "b").agg(F.count("*").alias("rows"))
    asks = looks.groupBy("t", "b").agg(F.count("*").alias("asks"))
    cells = written(
        sizes.join(asks, ["t", "b"]).select(
            F.col("t").alias("ct"), F.col("b").alias("cb"), F.ceil(F.col("rows") / conf.block).alias("rb"), F.ceil(F.col("asks") / conf.query_block).alias("qb")
        ),
        "cells",
    )
    same = (F.col("t") == F.col("ct")) & (F.col("b") == F.col("cb"))
    left = entries.join(cells, same).withColumn("i", F.pmod(F.xxhash64("id"), F.col("rb"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb") - 1)))
    right = looks.join(cells, same).withColumn("j", F.pmod(F.xxhash64("id", F.lit(1)), F.col("qb"))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rb") - 1)))
    both = left.select("t", "b", "i", "j", "id", "v", F.lit(False).alias("asks")).union(right.select("t", "b", "i", "j", "id", "v", F.lit(True).alias("asks")))

    def within(group: pd.DataFrame) -> pd.DataFrame:
        asking = group["asks"].to_numpy()
        ids, matrix = group["id"].to_numpy(), np.array(group["v"].tolist(), np.float32).reshape(len(group), -1)
        found = _best(ids[~asking], matrix[~asking], ids[asking], matrix[asking], k) if asking.any() and not asking.all() else []
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = both.groupBy("t", "b", "i", "j").applyInPandas(within, "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(vectors: DataFrame, is_query: Column | str, k: int = 5, ident: str = "vec_id", vector: str = "embedding") -> pd.DataFrame:
    """The exact answer for small tables, on the driver; for tests and for measuring recall."""
    rows = valid(vectors, ident, vector)
    table = rows.toPandas().sort_values("id")
    asked = rows.where(is_query).toPandas().sort_values("id")
    ids, matrix = table["id"].to_numpy(), np.array(table["v"].tolist(), np.float32)
    found = _best(ids, matrix, asked["id"].to_numpy(), np.array(asked["v"].tolist(), np.float32), k)
    return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])
