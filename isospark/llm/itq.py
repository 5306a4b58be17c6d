"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Equal vectors are one class at first. On a bounded sample of the classes
rotations are learned that turn centred vectors so that the signs of their
components lose least (iterative quantisation, each from another random start);
the signs of all rotations are a vector's binary code. The code is cut into
strings of bits, one for each table, and vectors that agree on one string meet
in that table: all pairs whose codes differ in fewer bits than there are tables,
and most of the others up to the threshold. How many tables that takes is
measured: pairs at exactly the threshold's angle are made from the sample, and
tables are added until FOUND of them meet. A string's length follows from the
number of vectors, so buckets stay small at any size.

First only codes meet: a vector goes on if some other one in a bucket of its has
a code within the radius (that of the made pairs, with a margin). Most vectors
end here, and no vector has moved. Those that go on meet in the same buckets with
their components; large buckets are cut into blocks of parts against parts, so a
task holds at most two parts. Cosines are computed from the components, in
doubles. Links are counted in the first table in which a pair meets, so no pair
is written; what leaves a block is one row for each vector with its number of
links and the smallest vector of its part of the graph, and components follow
from those by components.py.

Nothing below the threshold is linked. Links are found with the measured
probability (0.999 for pairs at the threshold, more for closer ones); equal
vectors always are.

Defined cases: vectors that are null, zero or hold null or non-finite
components, and rows without id, link with nothing and are kept; shorter vectors
are as if filled up with zeros; rows that repeat a vector are linked with each
other, whether or not they share an id. Input columns are chosen by name, others
are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_cut, release, table
from .components import components
from .simhash import join_unique

#: Cosine that links, share of pairs at that cosine that must meet, classes in the sample, vectors in an average bucket.
COSINE, FOUND, SAMPLE, BUCKET = 0.95, 0.999, 8192, 64
#: Bits of a rotation at most, bits of a table's string at least and at most, tables at most, steps of the fit.
ROTATION_BITS, FEWEST, MOST, TABLES, STEPS = 64, 6, 24, 128, 30
#: Vectors in a part of a large bucket, probes compared at once.
PART, PROBES = 2048, 256


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of vectors, scaled to a greatest component of 1, filled up with zeros."""
    sizes = np.array(column.value_lengths(), np.int64)
    rows, ends = np.repeat(np.arange(len(column)), sizes), np.cumsum(sizes)
    out = np.zeros((len(column), dim))
    out[rows, np.arange(len(rows)) - np.repeat(ends - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out / np.maximum(np.abs(out).max(axis=1, initial=0, keepdims=True), np.finfo(float).tiny)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.finfo(float).tiny)


def rotation(x: np.ndarray, seed: int) -> np.ndarray:
    """An orthogonal matrix from a random start, fitted to the signs of x rotated by it."""
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1],) * 2))[0]
    for _ in range(STEPS):
        left, _, right = np.linalg.svd(np.where(x @ turn > 0, 1.0, -1.0).T @ x)
        turn = right.T @ left.T
    return turn


class Coder:
    """Codes of vectors, and their strings by table."""

    def __init__(self, sample: np.ndarray, length: int, cosine: float):
        x = unit(sample)
        self.mean, self.length = x.mean(axis=0), length
        centred = x - self.mean
        self.axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, : min(ROTATION_BITS, x.shape[1])]
        self.turns: list[np.ndarray] = []
        random = np.random.default_rng(0)
        side = random.normal(size=x.shape)
        side = unit(side - (side * x).sum(axis=1, keepdims=True) * x)
        made = cosine * x + math.sqrt(1 - cosine**2) * side
        self.tables, missed = 0, 1.0
        while missed > 1 - FOUND and self.tables < TABLES:
            self.turns.append(rotation(centred @ self.axes, len(self.turns)))
            self.tables = len(self.turns) * self.axes.shape[1] // length
            if self.tables:
                same = self.strings(self.bits(x)) == self.strings(self.bits(made))
                shares = np.cumprod(1 - same.mean(axis=0))
                # Tables beyond those that are needed are left out.
                enough = np.flatnonzero(shares <= 1 - FOUND)
                self.tables = min(TABLES, int(enough[0]) + 1 if len(enough) else self.tables)
                missed = float(shares[self.tables - 1])
        differ = (self.bits(x) != self.bits(made)).sum(axis=1)
        self.radius = min(self.size, int(differ.mean() + 5 * differ.std()) + 1)

    @property
    def size(self) -> int:
        return self.tables * self.length

    def bits(self, unit_vectors: np.ndarray) -> np.ndarray:
        flat = (unit_vectors - self.mean) @ self.axes
        signs = np.concatenate([flat @ t > 0 for t in self.turns], axis=1)
        return signs[:, : self.size] if self.tables else signs

    def strings(self, bits: np.ndarray) -> np.ndarray:
        """Numbers of the strings, one column for each table."""
        split = bits[:, : self.size].reshape(len(bits), self.tables, self.length)
        return (split << np.arange(self.length)).sum(axis=2).astype(np.int32)

    def words(self, bits: np.ndarray) -> np.ndarray:
        packed = np.packbits(bits, axis=1)
        return np.ascontiguousarray(np.pad(packed, [(0, 0), (0, -packed.shape[1] % 8)])).view(np.int64)


def coded(classes: DataFrame, coder, dim: int, words: int) -> DataFrame:
    """(cid, keys, c0, c1, ...) of classes (cid, v): strings by table, and the code in words. coder is a broadcast."""
    names = ["cid", "keys", *(f"c{k}" for k in range(words))]

    def run(batches):
        release()
        for batch in batches:
            bits = coder.value.bits(unit(matrix(batch.column(1), dim)))
            keys, code = coder.value.strings(bits), coder.value.words(bits)
            ends = np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel())), *(pa.array(np.ascontiguousarray(code[:, k])) for k in range(words))], names)

    return classes.select("cid", "v").mapInArrow(run, "cid long, keys array<int>, " + ", ".join(f"c{k} long" for k in range(words)))


def with_partner(codes: DataFrame, words: int, radius: int) -> DataFrame:
    """(cid) of the classes that meet another one with a code within the radius."""
    entries = codes.select("cid", *(f"c{k}" for k in range(words)), F.posexplode("keys").alias("t", "key"))
    differ = sum(F.bit_count(F.col(f"a.c{k}").bitwiseXOR(F.col(f"b.c{k}"))) for k in range(words))
    on = (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.cid") != F.col("b.cid")) & (differ <= radius)
    # Sizes of exploded rows are underestimated; the hint keeps them from being broadcast.
    return entries.alias("a").join(entries.alias("b").hint("merge"), on, "left_semi").select("cid").distinct()


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each of n nodes' components, with edges (a, b)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def linked(near: DataFrame, dim: int, cosine: float) -> DataFrame:
    """(cid, links, root) from near (cid, n, v, keys): by block, what a class links with that it first meets here, and a class of its component."""
    entries = near.select("cid", "n", "v", "keys", F.posexplode("keys").alias("t", "key"))
    sizes = entries.groupBy("t", "key").agg(F.count("*").alias("size")).where("size > 1")
    placed = entries.join(sizes.hint("merge"), ["t", "key"]).withColumn("parts", F.ceil(F.col("size") / PART).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    # A part meets every part, once as the one that asks (role 0) and once as the one that is asked (1).
    turn = lambda role: F.transform(others, lambda x: F.struct((F.col("own") if role == 0 else x).alias("asks"), (x if role == 0 else F.col("own")).alias("asked"), F.lit(role).alias("role")))
    alone = F.array(F.struct(F.lit(0).alias("asks"), F.lit(0).alias("asked"), F.lit(2).alias("role")))
    spread = placed.withColumn("b", F.explode(F.when(F.col("parts") == 1, alone).otherwise(F.concat(turn(0), turn(1)))))
    spread = spread.select("t", "key", "b.asks", "b.asked", "b.role", "cid", "n", "v", "keys")

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        t, role, cid, n = block["t"][0].as_py(), block["role"].to_numpy(), block["cid"].to_numpy(), block["n"].to_numpy()
        keys = block["keys"].combine_chunks().flatten().to_numpy().reshape(len(cid), -1)
        x = matrix(block["v"].combine_chunks(), dim)
        norm = np.linalg.norm(x, axis=1)
        asks, asked = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
        links, froms, tos = np.zeros(len(cid), np.int64), [], []
        for at in range(0, len(asks), PROBES):
            some = asks[at : at + PROBES]
            i, j = np.nonzero(x[some] @ x[asked].T / (norm[some, None] * norm[asked]) >= cosine)
            i, j = some[i], asked[j]
            fresh = (cid[i] != cid[j]) & ~(keys[i, :t] == keys[j, :t]).any(axis=1)
            i, j = i[fresh], j[fresh]
            np.add.at(links, i, n[j])
            froms.append(i)
            tos.append(j)
        # A class may stand twice in a block of one part against itself.
        nodes, node = np.unique(cid, return_inverse=True)
        a, b = node[np.concatenate(froms)], node[np.concatenate(tos)]
        root = nodes[roots(a, b, len(nodes))][node]
        some = np.flatnonzero((links > 0) | (root != cid))
        return pa.table({"cid": cid[some], "links": links[some], "root": root[some]})

    # Dealt by block, as the join's dealing by bucket would leave all blocks of a large bucket in one task.
    block = ["t", "key", "asks", "asked"]
    return spread.repartition(*block).groupBy(*block).applyInArrow(run, "cid long, links long, root long")


def near_duplicates(df: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    spark = df.sparkSession
    v, limit = F.col("v"), F.lit(float("inf"))
    usable = F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == limit)) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).withColumn("usable", F.coalesce(usable, F.lit(False)))
    rows = rows.withColumns({"h1": F.when(F.col("usable"), F.xxhash64("v")), "h2": F.when(F.col("usable"), F.xxhash64("v", F.lit(1)))})
    apart = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    vectors = cut(rows.where("usable").select("vec_id", "h1", "h2", "v"), "vectors")
    classes = vectors.groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("cid"), "*"), "vector-classes")
    found = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    if not found.n:
        return apart
    length = int(np.clip(math.ceil(math.log2(max(1, found.n / BUCKET))), FEWEST, MOST))
    sample = classes.select("h1", "h2", "v").orderBy("h1", "h2").limit(SAMPLE).toArrow()
    made = Coder(matrix(sample["v"].combine_chunks(), found.dim), length, cosine)
    words, coder = -(-made.size // 64), spark.sparkContext.broadcast(made)
    codes = cut(coded(classes, coder, found.dim, words), "codes")
    partners = cut(with_partner(codes, words, made.radius), "partners")
    near = cut(classes.select("cid", "n", "v").join(codes.select("cid", "keys"), "cid").join(partners, "cid", "left_semi"), "near")
    links = cut(linked(near, found.dim, cosine), "links")
    drop_cut(near)
    groups = components(links.select(F.col("cid").alias("u"), F.col("root").alias("v")), "vector-links")
    counts = links.groupBy("cid").agg(F.sum("links").alias("links"))
    placed = classes.select("cid", "h1", "h2", "first", "n").join(counts, "cid", "left").join(groups.withColumnRenamed("node", "cid"), "cid", "left")
    placed = cut(placed.withColumns({"component": F.coalesce("component", "cid"), "links": F.coalesce("links", F.lit(0))}), "placed")
    ids = cut(placed.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("classes")), "component-ids")
    named = cut(join_unique(placed, ids, "component", "classes").select("h1", "h2", "n", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id"), "named")
    out = join_unique(vectors.select("vec_id", "h1", "h2"), named.select("*", F.col("n").alias("rows")).drop("n"), ["h1", "h2"], "rows")
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).union(apart)


def op13_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = {
    "op13_itq": """
with recursive r as (select row_number() over () rid, vec_id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings),
v as (select * from r where vec_id is not null and v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
pairs as materialized (select a.rid a, b.rid b from v a join v b on a.rid <> b.rid where list_cosine_similarity(a.v, b.v) >= 0.95e0),
reach(s, e) as (select rid, rid from v union select r.s, p.b from reach r join pairs p on p.a = r.e),
low as (select s rid, min(vec_id) component_id from reach join v on v.rid = e group by s),
n as (select a rid, count(*) n from pairs group by a)
select vec_id, cast(coalesce(n.n, 0) as bigint) n_links, coalesce(component_id, vec_id) component_id, coalesce(vec_id = component_id, true) kept from r left join n using (rid) left join low using (rid)"""
}
QUERIES = {"op13_itq": op13_itq}
