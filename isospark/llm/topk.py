"""Exact top-k inner-product search over norm-sorted vectors with SVD-rotated partial sums.

Components are turned to floor(1024 * x), so scores are whole numbers and exact.
Vectors are range-partitioned by descending length (ties by id, so a vector that
a third of the rows share is spread too) and packed into blocks; the query set
is packed into blocks as well. A query's threshold is its k-th best score among
the longest HEAD vectors. Only numbers and lengths of blocks are compared at
first: a block of queries needs vectors of some least length to reach any of its
thresholds (Cauchy-Schwarz), and meets the blocks whose longest vector has it,
through levels of length. Vectors move only for the pairs of blocks that remain,
each block of vectors once. Within a block, the axes are rotated
to the singular vectors of all data, the leading axes are summed, and the rest
is bounded by the product of the residual lengths: only vectors whose bound
reaches the threshold are scored, in integers. Bounds carry a margin for
floating-point rounding, so no true result is lost.

Memory is bounded by the sizes of blocks. The driver sees the second moments (a
row for each dimension) and the HEAD vectors.

Defined cases: vectors that are null or hold null or non-finite components, and
rows without id, take no part; shorter vectors are as if filled up with zeros;
repeated rows of one id and vector count once, and no vector with the query's
own id is among its results. Components and scores outside the range of a long
are taken as its ends. Input columns are chosen by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, table

SCALE, K, HEAD, BLOCK_ROWS, QUERY_ROWS = 1024, 10, 4096, 4096, 256
#: Share of the squared length that the leading axes should hold, in a quarter to all of the axes.
ENERGY = 0.8
#: Parts into which blocks of one level of length are spread.
PARTS = 8


def integer_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<long>, size double: the length) of the rows that take part."""
    usable = F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.col(id_col).isNotNull()
    rows = df.where(usable).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v")).distinct()
    return rows.withColumn("size", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    ends = column.offsets.to_numpy() - column.offsets[0].as_py()
    out = np.zeros((len(column), dim), np.int64)
    sizes = np.diff(ends)
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(int(sizes.sum())) - np.repeat(ends[:-1], sizes)] = column.flatten().to_numpy()
    return out


def second_moments(vectors: DataFrame, dim: int) -> np.ndarray:
    """Sum of v v^T over all vectors: each task sends a row for each dimension, Spark adds them up, and dim rows reach the driver."""

    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column(0), dim).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array([r.tobytes() for r in total])], ["cell", "line"])

    def add(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), float) for x in parts["line"])
        return pa.table({"cell": parts["cell"].slice(0, 1), "line": pa.array([total.tobytes()], pa.binary())})

    shape = "cell long, line binary"
    out = np.zeros((dim, dim))
    for r in vectors.select("v").mapInArrow(run, shape).groupBy("cell").applyInArrow(add, shape).collect():
        out[r.cell] = np.frombuffer(r.line, float)
    return out


def level(length: Column) -> Column:
    """Levels of length, four to a doubling, so their number is bounded."""
    return F.floor(4 * F.log2(F.greatest(F.least(length, F.lit(1e300)), F.lit(1.0)))).cast("int")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= edge)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in integers; by floating point where all sums stay below 2^53."""
    high = max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0))) * max(1, a.shape[1])
    if high < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if high < 1 << 63:
        return a @ b.T
    full = a.astype(object) @ b.T.astype(object)
    return np.clip(full, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def search_block(q_ids, q, floor, c_ids, c, axes, lead: int, k: int):
    """(query id, id, score) of each query's k best in a block that can reach its threshold."""
    fq, fc = q @ axes, c @ axes
    long_q, long_c = np.linalg.norm(fq, axis=1), np.linalg.norm(fc, axis=1)
    margin = 1e-9 * long_q * long_c.max(initial=0) * max(1, q.shape[1]) + 1e-6
    alive = np.flatnonzero(long_q * long_c.max(initial=0) + margin >= floor)
    rest_q, rest_c = np.linalg.norm(fq[:, lead:], axis=1), np.linalg.norm(fc[:, lead:], axis=1)
    out = []
    for at in range(0, len(alive), 64):
        some = alive[at : at + 64]
        bound = fq[some, :lead] @ fc[:, :lead].T + rest_q[some, None] * rest_c + margin[some, None]
        for row, i in enumerate(some):
            near = np.flatnonzero((bound[row] >= floor[i]) & (c_ids != q_ids[i]))
            if len(near):
                scores = exact(q[i : i + 1], c[near])[0]
                top = best(c_ids[near], scores, k)
                out.append((np.full(len(top), q_ids[i]), c_ids[near][top], scores[top]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def near_blocks(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """(block, q_block) of the blocks (block, longest) that blocks of queries (q_block, q_least) can need; no vectors move."""
    placed = blocks.withColumn("level", level(F.col("longest"))).withColumn("part", F.pmod(F.xxhash64("block"), F.lit(PARTS)).cast("int"))
    highest = placed.agg(F.max("level")).first()[0] or 0
    reached = asked.withColumn("level", F.explode(F.sequence(F.least(level(F.col("q_least")), F.lit(highest + 1)), F.lit(highest + 1))))
    reached = reached.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    # Sizes of exploded rows are underestimated; the hint keeps them from being broadcast.
    return placed.join(reached.hint("merge"), ["level", "part"]).where(F.col("longest") >= F.col("q_least")).select("block", "q_block")


def top_k(df: DataFrame, queries, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score. queries: a condition on column id (the rows that are queries)."""
    spark = df.sparkSession
    vectors = cut(integer_vectors(df, id_col, vector_col), "vectors")
    found = vectors.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("n"), F.count_if(queries).alias("q")).first()
    dim, empty = max(1, found.dim or 1), "query_id long, rank int, vec_id long, score long"
    if not found.q:
        return spark.createDataFrame([], empty)
    power, axes = np.linalg.eigh(second_moments(vectors, dim))
    power, axes = np.maximum(power[::-1], 0), axes[:, ::-1].copy()
    lead = int(np.clip(np.searchsorted(np.cumsum(power), ENERGY * power.sum()) + 1, (dim + 3) // 4, dim))
    longest = vectors.orderBy(F.desc("size"), "id").limit(HEAD).toArrow()
    head_ids, head = longest["id"].to_numpy(), _matrix(longest["v"].combine_chunks(), dim)
    shared = spark.sparkContext.broadcast((axes, lead, head_ids, head))

    def pack(rows: int, asks: bool):
        def emit(ids, m):
            lengths = np.linalg.norm(m.astype(float), axis=1)
            cells = [pa.array([(TaskContext.get().partitionId() << 32) + emit.count]), pa.array([ids.tobytes()]), pa.array([m.tobytes()]), pa.array([lengths.max()])]
            emit.count += 1
            if asks:
                _, _, h_ids, h = shared.value
                scores = exact(m, h).astype(float)
                scores[ids[:, None] == h_ids] = -np.inf
                floor = np.partition(scores, len(h_ids) - k, axis=1)[:, len(h_ids) - k] if len(h_ids) >= k else np.full(len(ids), -np.inf)
                # The least length that reaches the floor of any query, less a margin for rounding.
                least = np.where(floor <= 0, 0.0, np.divide(floor, lengths, out=np.full(len(floor), np.inf), where=lengths > 0)).min()
                cells[3:] = [pa.array([floor.tobytes()]), pa.array([least * (1 - 1e-9) - 1e-6])]
            return pa.RecordBatch.from_arrays(cells, ["block", "ids", "m", *(["floor", "least"] if asks else ["longest"])])

        def run(batches):
            emit.count, held_ids, held = 0, np.zeros(0, np.int64), np.zeros((0, dim), np.int64)
            for batch in batches:
                held_ids, held = np.concatenate([held_ids, batch.column(0).to_numpy()]), np.concatenate([held, _matrix(batch.column(1), dim)])
                while len(held_ids) >= rows:
                    yield emit(held_ids[:rows], held[:rows])
                    held_ids, held = held_ids[rows:], held[rows:]
            if len(held_ids):
                yield emit(held_ids, held)

        return run

    parts = max(1, -(-found.n // (BLOCK_ROWS * 4)))
    by_length = vectors.repartitionByRange(parts, F.desc("size"), "id").sortWithinPartitions(F.desc("size"), "id").select("id", "v")
    blocks = cut(by_length.mapInArrow(pack(BLOCK_ROWS, False), "block long, ids binary, m binary, longest double"), "blocks")
    asked = vectors.where(queries).repartitionByRange(max(1, -(-found.q // (QUERY_ROWS * 4))), F.desc("size"), "id").sortWithinPartitions(F.desc("size"), "id").select("id", "v")
    asked = cut(asked.mapInArrow(pack(QUERY_ROWS, True), "block long, ids binary, m binary, floor binary, least double"), "queries").select(*[F.col(c).alias(f"q_{c}") for c in ("block", "ids", "m", "floor", "least")])
    pairs = cut(near_blocks(blocks.select("block", "longest"), asked.select("q_block", "q_least")), "block-pairs")
    pairs = pairs.join(asked.drop("q_least"), "q_block").join(blocks.drop("longest"), "block")

    def compare(batches):
        axes, lead, _, _ = shared.value
        of = lambda cell, kind: np.frombuffer(cell.as_py(), kind)
        for batch in batches:
            for c_ids, c, q_ids, q, floor in zip(*batch.columns, strict=True):
                got = search_block(of(q_ids, np.int64), of(q, np.int64).reshape(-1, dim), of(floor, float), of(c_ids, np.int64), of(c, np.int64).reshape(-1, dim), axes, lead, k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["query_id", "vec_id", "score"])

    near = pairs.select("ids", "m", "q_ids", "q_m", "q_floor").mapInArrow(compare, "query_id long, vec_id long, score long").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


ORACLE = {
    "op7_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) score from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(rank as integer) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10"""
}
QUERIES = {"op7_topk": op7_topk}
