"""Nearest neighbours by randomly rotated one-bit codes.

A vector's residual from the centre is rotated by a random matrix with orthonormal rows into ``SPREAD``
times as many dimensions and kept as one bit for each, with two correction scalars: its norm and its
inner product with its own code.  From bits and scalars the search estimates inner products and bounds
their error.  The candidates with the k best estimates are ranked on original vectors first; of the
others only those are ranked again whose upper bound reaches the k-th score found so.

Queries meet rows in large blocks; vectors aren't split into cells, as on vectors without clusters a recall
of 0.9 would take about half of all cells.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part, nor do
those with a null id; vectors of different lengths are no candidates of one another; rows that repeat
an id are rows of their own, as queries and as candidates; ties go to the smaller id; fewer candidates
than k give all of them; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, batch, stored, table, workspace

K, EPSILON, SPREAD, SEED = 20, 2.0, 4, 20240229
#: Rows of a block of the index and of a block of queries; a task holds one of each.
DATA_BLOCK, QUERY_BLOCK, STEP = 16_384, 32_768, 128


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, vec_id, v array<double>) of the vectors that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def rotation(dim: int, seed: int = SEED, spread: int = SPREAD) -> np.ndarray:
    """``dim`` orthonormal rows of a random rotation of ``spread`` times as many dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim * spread, dim)))
    return (q * np.sign(np.diag(r))).T


def encode(v: np.ndarray, center: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits, residual norms, and inner products of unit residuals with their codes."""
    r = v - center
    norm = np.sqrt((r * r).sum(axis=1))
    turned = (r / np.where(norm > 0, norm, 1)[:, None]) @ turn
    return np.packbits(turned >= 0, axis=1), norm, np.abs(turned).sum(axis=1) / math.sqrt(turn.shape[1])


def build_index(rows: DataFrame, dim: int, center: np.ndarray, seed: int = SEED) -> DataFrame:
    """row, vec_id, code, norm, self_dot and the original vector of every row."""
    schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("code", pa.binary()), ("norm", pa.float64()), ("self_dot", pa.float64()), ("vector", pa.binary())])
    mid = center.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, c = rotation(dim, seed), np.array(mid)
        for b in batches:
            v = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            code, norm, own = encode(v, c, turn)
            yield batch(schema, [b.column(0), b.column(1), [x.tobytes() for x in code], norm, own, [x.tobytes() for x in v]])

    return arrow_map(rows, run, "row long, vec_id long, code binary, norm double, self_dot double, vector binary")


def search_block(q_rows, q, rows, ids, code, norm, own, v, center, turn, k, epsilon):
    """The k best of a block for each query: lists of query row, row, id, score; and how many were ranked on original vectors."""
    bits = turn.shape[1]
    signs = np.unpackbits(code, axis=1, count=bits).astype(np.float32) * 2 - 1
    own = np.maximum(own, 1e-9)
    scale = (norm / own / math.sqrt(bits)).astype(np.float32)
    slack = (norm * np.sqrt(np.maximum(1 - own**2, 0)) / own * epsilon / math.sqrt(max(bits - 1, 1))).astype(np.float32)
    turned, at_center, q_norm = (q @ turn).astype(np.float32), q @ center, np.sqrt((q * q).sum(axis=1))
    places = {r: i for i, r in enumerate(rows.tolist())}
    out_q, out_r, out_v, out_s, ranked = [], [], [], [], 0
    for i in range(0, len(q), STEP):
        estimate = (turned[i : i + STEP] @ signs.T) * scale + at_center[i : i + STEP, None].astype(np.float32)
        for j, e in enumerate(estimate, i):
            self_at = places.get(q_rows[j])
            if self_at is not None:
                e[self_at] = -1e30
            least = -np.inf
            if len(e) > k:
                top = np.argpartition(e, len(e) - k)[len(e) - k :]
                least = (v[top] @ q[j]).min() if e[top].min() > -1e30 else -np.inf
            near = np.flatnonzero(e + slack * np.float32(q_norm[j]) + np.float32(1e-5) * (1 + np.abs(e)) >= least)
            if self_at is not None:
                near = near[near != self_at]
            ranked += len(near)
            score = (v[near] * q[j]).sum(axis=1)
            best = np.lexsort((rows[near], ids[near], -score))[:k]
            out_q += [q_rows[j]] * len(best)
            out_r += rows[near][best].tolist()
            out_v += ids[near][best].tolist()
            out_s += score[best].tolist()
    return (out_q, out_r, out_v, out_s), ranked


def nearest(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", epsilon: float = EPSILON, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of every row for which ``is_query`` (a Column of vec_id) holds."""
    spark = vectors.sparkSession
    path = workspace(spark, "ann")
    rows = stored(usable(vectors, id_col, vector_col), f"{path}/rows")
    dims = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())  # lengths of vectors: one, as a rule
    found = [_nearest_of(rows.filter(F.size("v") == dim), dim, is_query, k, epsilon, seed, f"{path}/{dim}") for dim in dims or [1]]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _nearest_of(rows: DataFrame, dim: int, is_query, k: int, epsilon: float, seed: int, path: str) -> DataFrame:
    """``nearest`` among vectors of one length."""
    sums = rows.agg(F.count("*").alias("n"), *[F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dim)]).first()
    n = sums["n"]
    center = np.array([round((sums[f"s{i}"] or 0.0) / max(n, 1), 9) for i in range(dim)])
    index = stored(build_index(rows, dim, center, seed), f"{path}/index")
    queries = index.filter(is_query(F.col("vec_id"))).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    n_queries = queries.count()
    data_blocks, query_blocks = max(1, -(-n // DATA_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = index.withColumn("db", F.pmod(F.xxhash64("row"), F.lit(data_blocks)).cast("int")).withColumn("qb", every(query_blocks))
    right = queries.withColumn("qb", F.pmod(F.xxhash64("query_row"), F.lit(query_blocks)).cast("int")).withColumn("db", every(data_blocks))
    schema = pa.schema([("query_row", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    mid = center.tolist()

    def run(data: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(data) or not len(asked):
            return schema.empty_table()
        raw = lambda t, c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind).reshape(len(t), -1)
        found, _ = search_block(
            asked.column("query_row").to_numpy(), raw(asked, "query", np.float64), data.column("row").to_numpy(), data.column("vec_id").to_numpy(), raw(data, "code", np.uint8),
            data.column("norm").to_numpy(), data.column("self_dot").to_numpy(), raw(data, "vector", np.float64), np.array(mid), rotation(dim, seed), k, epsilon,
        )
        return pa.table(list(found), schema=schema)

    local = left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db")).applyInArrow(run, "query_row long, row long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    best = local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(queries.select("query_row", "query_id"), "query_row").select("query_id", "rank", "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda c: c % 20 == 0)


OP8_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
QUALIFY rank <= 20
"""
