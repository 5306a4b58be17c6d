"""SimHash near-duplicate detection by anchor-point covering.

Fingerprints are 64-bit SimHashes of 3-word shingles. The anchors are the words
of a covering code of the 64-bit space, the product of four perfect codes: two
binary Golay codes of 23 bits (radius 3), a Hamming code of 15 bits (radius 1)
and a repetition code of 3 bits (radius 1). Being perfect, each has exactly one
word within its radius of any point, found by its syndrome.

Two fingerprints that differ in at most 2 bits have a point in the middle, at
most 1 bit from either. That point lies within the covering radius of its
anchor, so both fingerprints lie within the covering radius plus that one bit
(half the threshold is enough, as both are replicated): in one block at most
the distance may exceed the block's radius, by one. Each distinct fingerprint is
replicated to those anchors, about 17 rows, and compared with the others there.
There are 2^36 anchors, so unrelated fingerprints seldom meet at any scale.

Fingerprints are compared anchor by anchor, at the anchors that several share: two
of an anchor differ in at most 2 bits if some point of the anchor is at most 1 bit
from either. So an anchor's fingerprints are sub-grouped by those of their points
that lie within the covering radius of this anchor (each point has one anchor, so
a fingerprint has 65 points over all its anchors), and those at one point (65 at
most) are linked through the smallest. An anchor of a large family of near copies
costs no more a fingerprint than another, and makes no pairs. Components follow
by components.py.

keep_one_each, the filter, links texts by the similarity of their word sets. It
takes the fingerprints' links first, each confirmed on the words, and completes
them by similarity.py, since most texts that share four fifths of their shingles
are further apart than any threshold of bits that can be covered.

Defined cases: null, empty and wordless texts have fingerprint zero and link
like any other; a row without id has the component of its fingerprint, the
smallest id reachable, or null if there is none. Repeated rows give one row
each. The filter keeps of each group the row with the smallest id (rows without
id come last; of texts with one id the one with the smaller hash), and rows that
repeat id and text count once. Input columns are chosen by name, others are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import similarity
from .common import as_bytes, cut, drop_cut, release, table
from .components import components

#: Words of a shingle, bits that linked fingerprints may differ in, seed of the hash.
SHINGLE, THRESHOLD, SEED = 3, 2, 42


def simhash(text: bytes) -> int:
    """The fingerprint, unsigned."""
    words = similarity.words_of(text)
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    return similarity.majority(np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(words, words[1:], words[2:])), np.uint64, len(words) - SHINGLE + 1))


def fingerprint(text: Column) -> Column:
    """The fingerprint as a signed long with the same bits."""

    @F.arrow_udf("bigint")
    def simhash_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        for batch in batches:
            yield pa.array(np.fromiter((simhash(raw) if raw else 0 for raw in as_bytes(batch)), np.uint64, len(batch)).view(np.int64))

    return simhash_of.asNondeterministic()(text)


class PerfectCode:
    """A perfect code by the syndromes of single bits: leaders within the radius, shells one beyond."""

    def __init__(self, syndromes: list[int], radius: int):
        self.bits, self.single = len(syndromes), syndromes
        size = 1 << max(syndromes).bit_length()
        self.leader = np.zeros(size, np.int64)
        shells: list[list[int]] = [[] for _ in range(size)]
        for weight in range(radius + 2):
            for places in combinations(range(self.bits), weight):
                syndrome = 0
                for p in places:
                    syndrome ^= syndromes[p]
                word = sum(1 << p for p in places)
                if weight <= radius:
                    self.leader[syndrome] = word
                else:
                    shells[syndrome].append(word)
        self.shell_ends = np.cumsum([0, *map(len, shells)])
        self.shell = np.array([x for s in shells for x in s], np.int64)

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for p, s in enumerate(self.single):
            out ^= np.where(x >> p & 1, s, 0)
        return out


def _golay() -> PerfectCode:
    """The binary Golay code, by the remainders of x^p modulo x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1."""
    remainders, r = [], 1
    for _ in range(23):
        remainders.append(r)
        r <<= 1
        if r >> 11:
            r ^= 0b110001110101
    return PerfectCode(remainders, 3)


def blocks() -> list[PerfectCode]:
    golay = _golay()
    return [golay, golay, PerfectCode(list(range(1, 16)), 1), PerfectCode([1, 2, 3], 1)]


def anchors(fingerprints: np.ndarray, codes: list[PerfectCode]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (place in fingerprints, anchor) for all anchors within the radius plus one bit."""
    x, home, at, per_block = fingerprints.view(np.uint64), np.zeros(len(fingerprints), np.int64), 0, []
    for code in codes:
        part = (x >> np.uint64(at) & np.uint64((1 << code.bits) - 1)).astype(np.int64)
        syndrome = code.syndrome(part)
        nearest = part ^ code.leader[syndrome]
        home |= nearest << at
        per_block.append((at, code, part, syndrome, nearest))
        at += code.bits
    index = np.arange(len(x))
    rows, found = [index], [home]
    for at, code, part, syndrome, nearest in per_block:
        starts = code.shell_ends[syndrome]
        counts = code.shell_ends[syndrome + 1] - starts
        who = np.repeat(index, counts)
        which = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        rows.append(who)
        found.append(home[who] ^ (nearest[who] ^ part[who] ^ code.shell[which]) << at)
    return np.concatenate(rows), np.concatenate(found)


def homes(points: np.ndarray, codes: list[PerfectCode]) -> np.ndarray:
    """The one anchor within the covering radius of each point."""
    x, out, at = points.view(np.uint64), np.zeros(len(points), np.int64), 0
    for code in codes:
        part = (x >> np.uint64(at) & np.uint64((1 << code.bits) - 1)).astype(np.int64)
        out |= (part ^ code.leader[code.syndrome(part)]) << at
        at += code.bits
    return out


def replicate(fingerprints: DataFrame) -> DataFrame:
    """(anchor, fp) for every fingerprint (fp long) and anchor it belongs to."""

    def run(batches):
        codes = blocks()
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            rows, found = anchors(fp, codes)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(fp[rows])], ["anchor", "fp"])

    return fingerprints.select("fp").mapInArrow(run, "anchor bigint, fp bigint")


def anchor_points(replicas: DataFrame) -> DataFrame:
    """(anchor, point, fp): the points within one bit of a fingerprint that belong to the anchor of its replica."""

    def run(batches):
        codes = blocks()
        flips = np.append(0, np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))).astype(np.uint64).view(np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                anchor, fp = (batch.column(k).slice(at, 4096).to_numpy(zero_copy_only=False) for k in (0, 1))
                points = (fp[:, None] ^ flips).ravel()
                mine = np.flatnonzero(homes(points, codes) == np.repeat(anchor, len(flips)))
                row = mine // len(flips)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[row]), pa.array(points[mine]), pa.array(fp[row])], ["anchor", "point", "fp"])

    return replicas.select("anchor", "fp").mapInArrow(run, "anchor bigint, point bigint, fp bigint")


def links(fingerprints: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (fp long) within the threshold, with the components of all such pairs."""
    replicas = cut(replicate(fingerprints), "replicas")
    shared = replicas.groupBy("anchor").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("anchor")
    points = cut(anchor_points(replicas.join(shared, "anchor", "left_semi")), "points")
    drop_cut(replicas)
    smallest = points.groupBy("anchor", "point").agg(F.min("fp").alias("v"), F.max("fp").alias("w")).where("v <> w").select("anchor", "point", "v")
    return points.join(smallest, ["anchor", "point"]).where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


#: Keys with one of so many rows or more are joined by broadcast; there are no more of them than that.
HOT = 256


def join_unique(rows: DataFrame, unique: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined with unique, one row a key, whose column count tells how many rows a key has. Hot keys are not shuffled."""
    total = unique.agg(F.sum(count)).first()[0] or 0
    hot = unique.where(F.col(count) * HOT >= total).drop(count)
    rest = unique.where(F.col(count) * HOT < total).drop(count)
    few = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(few, key, "left_anti").join(rest, key))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (long) and component_id of each row."""
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fp")), "fingerprints")
    smallest = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows")), "distinct")
    groups = components(links(smallest), "links")
    labelled = smallest.join(groups, smallest.fp == groups.node, "left").select("fp", "first_id", "n_rows", F.coalesce("component", "fp").alias("component"))
    labelled = cut(labelled, "labelled")
    ids = cut(labelled.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")), "ids")
    by_print = cut(join_unique(labelled, ids, "component", "n").select("fp", "component_id", "n_rows"), "classes")
    return join_unique(rows, by_print, "fp", "n_rows").select("doc_id", "fp", "component_id")


def closest(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes (rid, fp) with equal fingerprints or a fingerprint within the threshold, through one node of each."""
    prints = cut(nodes.groupBy("fp").agg(F.min("rid").alias("rid")), "prints")
    equal = nodes.select("fp", "rid").join(prints.withColumnRenamed("rid", "v"), "fp").where("rid <> v").select(F.col("rid").alias("u"), "v")
    at = lambda x: prints.select(F.col("fp").alias(x), F.col("rid").alias(f"{x}_rid"))
    return equal.union(links(prints).join(at("u"), "u").join(at("v"), "v").select("u_rid", "v_rid")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def keep_one_each(docs: DataFrame, length: int = similarity.SHINGLE, share: int = similarity.SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of texts that share `share` hundredths of their shingles of `length` words, with its own columns."""
    names, text = docs.columns, F.col(text_col)
    last = docs.sparkSession.sparkContext.broadcast(similarity.frequent(docs, text_col, length))
    name = [F.col(id_col).isNull().alias("k0"), F.coalesce(F.xxhash64(id_col), F.lit(0)).alias("k1"), *similarity.text_keys(text)]
    found = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), *name, similarity.features(text, last, length, share).alias("r"))
    rows = cut(found.select("rid", "id", "k0", "k1", "t1", "t2", "r.*"), "shingles")
    distinct = cut(rows.groupBy("digest").agg(F.min("rid").alias("rid"), F.min(F.struct("k0", "id", "t1", "t2", "k1")).alias("first")).select("rid", "first"), "distinct")
    nodes = cut(rows.drop("id", "k0", "k1", "digest").join(distinct.select("rid"), "rid", "left_semi"), "nodes")
    drop_cut(rows)
    plain = docs.select(text.alias("text"))
    met = similarity.meetings(nodes, share)
    pairs = similarity.candidates(closest(nodes).union(similarity.with_hubs(met)), nodes, share)
    edges = similarity.confirmed(pairs, nodes, plain, length, share, "first")
    groups = components(edges, "families").withColumnRenamed("node", "rid")
    rest = similarity.confirmed(similarity.unconnected(met, nodes, groups, share), nodes, plain, length, share, "rest")
    drop_cut(met)
    groups = components(edges.union(rest), "links").withColumnRenamed("node", "rid")
    chosen = distinct.join(groups, "rid", "left").groupBy(F.coalesce("component", "rid").alias("component")).agg(F.min("first").alias("first"))
    keys = ["k0", "k1", "t1", "t2"]
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    return docs.select(row, *name).join(chosen.select("first.*").select(keys), keys).dropDuplicates(keys).select("row.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
ORACLE = {}
