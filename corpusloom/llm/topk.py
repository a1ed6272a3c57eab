"""Exact top-k by inner product, pruned by segment statistics from coarse to fine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm._common import ship, size_in_bytes, table

TOP = 10
SCALE = 1024
#: Segments a vector is summed up in, coarse to fine.
LEVELS = (4, 8, 16)
#: Vectors of a block, of queries or of candidates.
BLOCK = 1024
_EXACT = float(1 << 53)


def scaled(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.floor(vectors.astype(np.float64) * scale)


def segment_stats(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of each row's segments, each times the root of the segment's length."""
    cuts = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(np.int64)
    size = np.diff(cuts).astype(np.float64)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / size
    square = np.add.reduceat(x * x, cuts[:-1], axis=1) / size
    return mean * np.sqrt(size), np.sqrt(np.maximum(square - mean * mean, 0)) * np.sqrt(size)


class Block:
    """Vectors of one length with their ids, norms and segment statistics."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.norms = (x * x).sum(axis=1)
        self.stats = [segment_stats(x, p) for p in LEVELS]


def upper_bounds(q: Block, rows: np.ndarray, c: Block, columns: np.ndarray, level: int) -> np.ndarray:
    """Of the inner products of pairs: (|q|^2 + |c|^2 - d^2) / 2, where d^2 is the lower bound of the
    squared distance that means and deviations of segments give; a little more for rounding."""
    (qm, qd), (cm, cd) = q.stats[level], c.stats[level]
    apart = ((qm[rows] - cm[columns]) ** 2).sum(axis=1) + ((qd[rows] - cd[columns]) ** 2).sum(axis=1)
    return _slack((q.norms[rows] + c.norms[columns] - apart) / 2, q, c)


def all_upper_bounds(q: Block, c: Block) -> np.ndarray:
    (qm, qd), (cm, cd) = q.stats[0], c.stats[0]
    return _slack(qm @ cm.T + qd @ cd.T, q, c)


def _slack(bounds: np.ndarray, q: Block, c: Block) -> np.ndarray:
    return bounds + 1 + 1e-9 * (float(q.norms.max(initial=0)) + float(c.norms.max(initial=0)))


def exact(q: Block, rows: np.ndarray, c: Block, columns: np.ndarray) -> np.ndarray:
    """Inner products of pairs as int64; beyond 2**53 in Python integers, held to the ends of int64."""
    if math.sqrt(float(q.norms.max(initial=0))) * math.sqrt(float(c.norms.max(initial=0))) < _EXACT:
        return np.einsum("ij,ij->i", q.x[rows], c.x[columns]).astype(np.int64)
    sums = [sum(int(a) * int(b) for a, b in zip(q.x[r], c.x[k], strict=True)) for r, k in zip(rows, columns, strict=True)]
    return np.array([max(-(2**63), min(2**63 - 1, s)) for s in sums], np.int64)


def best_of(q: Block, c: Block, top: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of at most ``top`` candidates a query; raises ``floor``, the
    score that each query's top-th has at least, from what it finds."""
    n = len(c.ids)
    bounds = all_upper_bounds(q, c)
    own = q.ids[:, None] == c.ids[None, :]
    bounds[own] = -np.inf
    # the most promising give a first floor
    seeds = np.argpartition(-bounds, min(top, n) - 1, axis=1)[:, :top] if n > top else np.tile(np.arange(n), (len(q.ids), 1))
    rows = np.repeat(np.arange(len(q.ids)), seeds.shape[1])
    scores = exact(q, rows, c, seeds.reshape(-1)).reshape(seeds.shape).astype(np.float64)
    scores[np.take_along_axis(own, seeds, axis=1)] = -np.inf
    if seeds.shape[1] >= top:
        np.maximum(floor, scores.min(axis=1), out=floor)
    rows, columns = np.nonzero(bounds >= floor[:, None])
    real = ~own[rows, columns]
    rows, columns = rows[real], columns[real]
    for level in range(1, len(LEVELS)):
        keep = upper_bounds(q, rows, c, columns, level) >= floor[rows]
        rows, columns = rows[keep], columns[keep]
    found = exact(q, rows, c, columns)
    order = np.lexsort((c.ids[columns], -found, rows))
    rows, columns, found = rows[order], columns[order], found[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    last = rank == top - 1
    floor[rows[last]] = np.maximum(floor[rows[last]], found[last])
    keep = rank < top
    return rows[keep], columns[keep], found[keep]


def _block_schema(prefix: str) -> str:
    return f"part long, {prefix}_ids binary, {prefix}_x binary, dims int"


def _blocks(prefix: str, scale: int, size: int, parts: int):
    """Packs rows into blocks; rows of different lengths go to different blocks."""

    def block(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        part = (int(ids[0]) * 0x9E3779B97F4A7C15 % (1 << 64)) % parts
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([x.shape[1]], pa.int32())], ["part", f"{prefix}_ids", f"{prefix}_x", "dims"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            ids = np.asarray(batch.column("vec_id"), np.int64)
            column = batch.column("embedding")
            sizes = np.diff(np.asarray(column.offsets, np.int64))
            flat = np.asarray(column.flatten(), np.float64)
            starts = np.cumsum(sizes) - sizes
            for dims in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dims)
                x = scaled(flat[starts[rows][:, None] + np.arange(dims)], scale)
                for a in range(0, len(rows), size):
                    held.setdefault(dims, []).append((ids[rows[a : a + size]], x[a : a + size]))
                    while sum(len(i) for i, _ in held[dims]) >= size:
                        all_ids, all_x = (np.concatenate(z) for z in zip(*held[dims], strict=True))
                        yield block(all_ids[:size], all_x[:size])
                        held[dims] = [(all_ids[size:], all_x[size:])] if len(all_ids) > size else []
        for parts_ in held.values():
            if parts_:
                all_ids, all_x = (np.concatenate(z) for z in zip(*parts_, strict=True))
                if len(all_ids):
                    yield block(all_ids, all_x)

    return run


#: Query blocks that a task holds with their statistics and floors: all of a part, as a rule.
HELD = 64


def _search(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, int], tuple[Block, np.ndarray]] = {}  # the block used last is the last
        for batch in batches:
            for i in range(batch.num_rows):
                ids, dims = batch.column("q_ids")[i].as_py(), batch.column("dims")[i].as_py()
                q, floor = held.pop((ids, dims), (None, None))
                if q is None:
                    q = Block(np.frombuffer(ids, np.int64), np.frombuffer(batch.column("q_x")[i].as_py(), np.float64).reshape(-1, dims))
                    floor = np.full(len(q.ids), -np.inf)
                    if len(held) >= HELD:  # one that comes again begins without a floor
                        held.pop(next(iter(held)))
                held[ids, dims] = q, floor
                c = Block(np.frombuffer(batch.column("c_ids")[i].as_py(), np.int64), np.frombuffer(batch.column("c_x")[i].as_py(), np.float64).reshape(-1, dims))
                rows, columns, scores = best_of(q, c, top, floor)
                yield pa.RecordBatch.from_arrays([pa.array(q.ids[rows]), pa.array(c.ids[columns]), pa.array(scores)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, *, top: int = TOP, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """The ``top`` highest integer inner products of each query with all vectors but its own.

    ``vectors`` and ``queries`` have vec_id and embedding; components count as floor(scale * x). Returns
    query_id, rank from 1, vec_id, score; ties go to the smaller vec_id. Exact: a pair is skipped only
    if an upper bound from its segment statistics is below what the query's k-th has already.

    Queries and candidates are packed into blocks of a bounded number of vectors. Parts form a grid: a
    candidate block goes to all parts of its row, a query block to all of its column, and each pair of blocks
    meets in one part. With queries a hundredth of the vectors, a column for every ten rows copies least.
    What leaves a pair of blocks is ``top`` rows a query at most.

    Edge cases: vectors that are null, empty or hold null or non-finite components take no part, nor do
    rows without vec_id. Vectors of another length than the query's are not compared. With fewer
    candidates than ``top`` all come. A query's own vec_id is never its candidate, even if it repeats;
    a repeated query id is searched once, for its smallest vector. Repeated candidate rows rank apart.
    """
    spark = vectors.sparkSession
    ship(spark)
    fine = "vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    good = lambda df: df.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    parts = int(max(spark.sparkContext.defaultParallelism, min(4096, size_in_bytes(vectors) // (1 << 20))))
    asked = good(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    columns = max(1, round(math.sqrt(parts / 100)))
    rows = -(-parts // columns)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = asked.mapInArrow(_blocks("q", scale, block, columns), _block_schema("q")).withColumn("row", every(rows))
    q = q.withColumn("part", F.col("row") * columns + F.col("part")).drop("row")
    c = good(vectors).mapInArrow(_blocks("c", scale, block, rows), _block_schema("c")).withColumn("column", every(columns))
    c = c.withColumn("part", F.col("part") * columns + F.col("column")).drop("column")
    met = c.join(q, ["part", "dims"]).select("q_ids", "q_x", "c_ids", "c_x", "dims")
    found = met.mapInArrow(_search(top), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP10_SQL = f"""
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM good q JOIN good c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {TOP}
"""
