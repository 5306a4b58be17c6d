"""Links between texts by the share of common shingles, for the SimHash operator's filter.

Two texts are linked if their sets of SHINGLE consecutive words (words as in
simhash.py; a shorter text is one shingle) have a Jaccard similarity of
SIMILARITY hundredths or more. Fingerprints that are a few bits apart tell of
the closest copies alone, so the filter completes their links by these:

- Two linked sets of n and m shingles, n <= m, share at least s*m of them, and at
  least 2s/(1+s)*n. So whatever order all shingles are put in, the first one that
  they share is among the first m - ceil(s*m) + 1 of the larger set (its prefix),
  and among the first n - ceil(2s/(1+s)*n) + 1 of the smaller (its head). Sets
  meet at a shingle only if it is in the head of one. Shingles are ordered by
  their number in a sample of texts, rare ones first, so texts made from one
  template that aren't similar enough have only shingles of their own in their
  heads, and don't meet at the template's. The sample only decides how many rows
  meet.
- First each set is compared with hubs: at each shingle of its prefix, the first
  of the sets that meet there in HUBS orders: by how many prefix shingles a set
  has in common with others (the middle of a family of copies has the most), by
  number and by hashes. Hubs are minima, which are aggregated before they are
  shuffled, so a shingle of a third of all texts makes no more pairs for a set
  than others. The pairs that are confirmed, and the fingerprints' links, make
  components.
- Then only pairs at one shingle whose ends aren't connected yet are compared,
  which changes no component. Nothing is left out.
- Pairs are candidates if their sizes allow the similarity, and so do 1024
  parities of their shingles (each parity that differs stands for one shingle at
  least that only one of the sets has). Both are judged within the join, so other
  pairs are never written. Of long sets, whose parities tell little, numbers of
  shingles in buckets must allow it too. Candidates are confirmed on the words of
  both texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, drop_cut, release, settle

#: Words of a shingle, hundredths of similarity that link.
SHINGLE, SIMILARITY = 5, 80
#: One of so many texts is in the sample, and its most frequent shingles, found in so many texts at least, are put last.
ONE_OF, FREQUENT, IN_TEXTS = 16, 50_000, 4
#: Keys of candidates that are broadcast, else shuffled.
BROADCAST = 100_000

#: Sets that a set is compared with at each shingle before components are made.
HUBS = 6
#: Shingles from which a set is long, and buckets that its shingles are counted in.
LONG, BUCKETS = 1000, 2048

#: Parities in words of 64 bits.
WORDS = 16
PARITIES = tuple(f"p{k}" for k in range(WORDS))
FEATURES = f"struct<digest:binary,size:int,fp:bigint,{','.join(f'{p}:bigint' for p in PARITIES)},counts:binary,prefix:array<bigint>>"

#: A-Z to a-z.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Folded words; bytes split at \\x20 and \\x09-\\x0D."""
    return text.translate(LOWER).split() if text else []


def shingle_set(text: bytes | None, length: int = SHINGLE) -> set[tuple[bytes, ...]]:
    words = words_of(text)
    return set(zip(*(words[k:] for k in range(length)))) if len(words) >= length else {tuple(words)} if words else set()


def hashes(text: bytes | None, length: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the distinct shingles, sorted."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    length = min(length, len(w))
    n = len(w) - length + 1
    h = np.full(n, length, np.uint64)
    for k in range(length):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n]
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ h >> np.uint64(31))


def majority(h: np.ndarray) -> int:
    """The SimHash of hashes: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        ones += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def similar(a: bytes | None, b: bytes | None, length: int, similarity: int) -> bool:
    x, y = shingle_set(a, length), shingle_set(b, length)
    both = len(x & y)
    return 100 * both >= similarity * (len(x) + len(y) - both)


def frequent(docs: DataFrame, text_col: str, length: int) -> np.ndarray:
    """Hashes of frequent shingles of the sample, rarer ones first."""

    def run(batches):
        release()
        for batch in batches:
            for raw in as_bytes(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(hashes(raw, length).view(np.int64))], ["h"])

    sample = docs.where(F.pmod(F.xxhash64(text_col), F.lit(ONE_OF)) == 0).select(text_col)
    counted = sample.mapInArrow(run, "h bigint").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= IN_TEXTS)
    found = counted.orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    return np.array([r.h for r in reversed(found)], np.int64).view(np.uint64)


def features(text: Column, last, length: int, similarity: int) -> Column:
    """Digest, size, SimHash, parities and prefix of each text's set; last is a broadcast of the shingles to put last."""

    @F.arrow_udf(FEATURES)
    def shingles_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        order = np.argsort(last.value)
        known = last.value[order]
        bits = 64 * WORDS
        for batch in batches:
            digests, sizes, prints, parities, counts, prefixes = [], [], [], [], [], []
            for raw in as_bytes(batch):
                h = hashes(raw, length)
                n = len(h)
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(n)
                prints.append(majority(h))
                odd = (np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
                parities.append(np.packbits(odd).view(np.int64))
                counts.append(np.bincount((h % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS).clip(0, 65535).astype("<u2").tobytes() if n >= LONG else None)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    h = h[np.argsort(np.where(known[at] == h, order[at] + 1, 0), kind="stable")]
                prefixes.append(h[: n - -(-similarity * n // 100) + 1 if n else 0].view(np.int64))
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.int64), *prefixes])
            p = np.array(parities, np.int64).reshape(-1, WORDS)
            columns = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)), *[pa.array(p[:, k]) for k in range(WORDS)], pa.array(counts, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))]
            yield pa.StructArray.from_arrays(columns, ["digest", "size", "fp", *PARITIES, "counts", "prefix"])

    return shingles_of.asNondeterministic()(text)


def possible(a: str, b: str, similarity: int) -> Column:
    """Whether sizes and parities of two sets allow the similarity."""
    of = lambda side, c: F.col(f"{side}.{c}")
    differ = sum(F.bit_count(of(a, c).bitwiseXOR(of(b, c))) for c in PARITIES)
    least, most = F.least(of(a, "size"), of(b, "size")), F.greatest(of(a, "size"), of(b, "size"))
    return (least * 100 >= most * similarity) & (differ * (100 + similarity) <= (least + most) * (100 - similarity))


def text_keys(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2")]


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, length: int, similarity: int, label: str) -> DataFrame:
    """The pairs (u, v) among pairs (u, v, long) of nodes (rid, size, counts, t1, t2) whose texts in docs (text) are similar."""

    @F.arrow_udf("boolean")
    def similar_texts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        release()
        for a, b in batches:
            yield pa.array([similar(x, y, length, similarity) for x, y in zip(as_bytes(a), as_bytes(b), strict=True)], pa.bool_())
            settle()

    pairs = cut(counts_allow(cut(pairs, f"{label}-pairs"), nodes, similarity), f"{label}-candidates")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("rid")).distinct()
    keys = cut(nodes.select("rid", "t1", "t2").join(ends, "rid", "left_semi"), f"{label}-keys")
    keyed = docs.select("text", *text_keys(F.col("text")))
    # One text for each key, chosen before it is shuffled: copies of a text move once a task at most.
    texts = cut(keyed.join(F.broadcast(keys) if keys.count() <= BROADCAST else keys, ["t1", "t2"]).groupBy("rid").agg(F.min("text").alias("text")), f"{label}-texts")
    u, v = (texts.select(F.col("rid").alias(x), F.col("text").alias(f"{x}_text")) for x in "uv")
    judged = pairs.join(u, "u").join(v, "v").withColumn("same", similar_texts.asNondeterministic()("u_text", "v_text"))
    out = cut(judged.where("same").select("u", "v"), f"{label}-confirmed")
    drop_cut(keys)
    drop_cut(texts)
    return out


def counts_allow(pairs: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """The pairs (u, v, long) whose bucket counts allow the similarity, where both sets are long; else all."""

    @F.arrow_udf("boolean")
    def near(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for a, b, n in batches:
            differ = [int(np.abs(np.frombuffer(x, "<u2").astype(np.int32) - np.frombuffer(y, "<u2")).sum()) for x, y in zip(as_bytes(a), as_bytes(b), strict=True)]
            yield pa.array(np.array(differ, np.int64) * (100 + similarity) <= n.to_numpy(zero_copy_only=False) * (100 - similarity))

    counted = nodes.where("counts is not null")
    u, v = (counted.select(F.col("rid").alias(x), F.col("size").alias(f"{x}_size"), F.col("counts").alias(f"{x}_counts")) for x in "uv")
    both = pairs.where("long").join(u, "u").join(v, "v").withColumn("near", near.asNondeterministic()("u_counts", "v_counts", (F.col("u_size") + F.col("v_size")).cast("bigint")))
    return pairs.where("not long").select("u", "v").union(both.where("near").select("u", "v"))


def candidates(pairs: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """The pairs (u, v), once each, that sizes and parities of nodes allow, and whether both are long."""
    shape = nodes.select("rid", "size", *PARITIES)
    a, b = shape.alias("a"), shape.alias("b")
    both = pairs.select("u", "v").distinct().join(a, F.col("u") == F.col("a.rid")).join(b, F.col("v") == F.col("b.rid"))
    return both.where(possible("a", "b", similarity)).select("u", "v", both_long())


def both_long() -> Column:
    return (F.least("a.size", "b.size") >= LONG).alias("long")


def head_size(size: Column, similarity: int) -> Column:
    """Shingles of the head of a set: where the first shingle that it shares with a similar set of its size or more must be."""
    return size + 1 - F.floor((2 * similarity * size + (99 + similarity)) / (100 + similarity)).cast("int")


def meetings(nodes: DataFrame, similarity: int) -> DataFrame:
    """(h, rid, head, hubs): nodes (rid, size, prefix) at each shingle of their prefixes that is in the head of one, and the first of them in some orders."""
    entries = nodes.select(F.posexplode("prefix").alias("pos", "h"), "rid", "size").select("h", "rid", (F.col("pos") < head_size(F.col("size"), similarity)).alias("head"))
    several = entries.groupBy("h").agg(F.min("rid").alias("low"), F.max("rid").alias("high"), F.max("head").alias("any")).where("low <> high and any").select("h")
    met = cut(entries.join(several, "h"), "shared")
    common = met.join(met.groupBy("rid").agg(F.count("*").alias("n")), "rid")
    order = [F.struct(-F.col("n"), "rid"), F.struct("rid"), *[F.struct(F.xxhash64("rid", F.lit(k)), "rid") for k in range(2, HUBS)]]
    hubs = common.groupBy("h").agg(F.array_distinct(F.array(*[F.min(o).getField("rid") for o in order])).alias("hubs"))
    out = cut(met.join(hubs, "h"), "met")
    drop_cut(met)
    return out


def with_hubs(met: DataFrame) -> DataFrame:
    """The pairs (u, v) of sets and hubs."""
    hub = met.select("rid", F.explode("hubs").alias("hub")).where("rid <> hub")
    return hub.select(F.least("rid", "hub").alias("u"), F.greatest("rid", "hub").alias("v"))


def unconnected(met: DataFrame, nodes: DataFrame, groups: DataFrame, similarity: int) -> DataFrame:
    """The pairs (u, v, long), once each, that meet and may be similar but are in different groups (rid, component)."""
    placed = met.join(groups, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    mixed = placed.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("h")
    # Pairs with hubs have been judged.
    rest = placed.where(~F.array_contains("hubs", F.col("rid"))).drop("hubs").join(mixed, "h", "left_semi").join(nodes.select("rid", "size", *PARITIES), "rid")
    # The smaller set of a pair (of equal ones, that of the smaller number) has the shingle in its head.
    smaller = F.struct("a.size", "a.rid") < F.struct("b.size", "b.rid")
    apart = smaller & (F.col("a.component") != F.col("b.component"))
    pairs = rest.where("head").alias("a").join(rest.alias("b"), "h").where(apart & possible("a", "b", similarity))
    return pairs.select(F.least("a.rid", "b.rid").alias("u"), F.greatest("a.rid", "b.rid").alias("v"), both_long()).distinct()
