"""Ranked lexical search by Block-Max WAND over an index of compressed posting blocks.

The index is built in one pass without a shuffle: each task cuts its documents
into segments (a bounded number of postings), and a segment is a row: ids and
lengths of its documents, its terms and their document counts, and posting
lists in blocks of BLOCK documents. A block keeps its first and last document,
its compressed gaps and occurrences, and its impacts: the pairs (occurrences,
length) that no other posting of the block beats in both. What a term weighs and
how lengths count follow from totals of the whole corpus, so a block's maximum
impact is made from those pairs when the totals are known.

Queries go to the segments in blocks of a bounded number of terms; each block is
broadcast. In a segment a query's shallow pointers move over block boundaries
alone: between two neighbouring boundaries its lists stand in fixed blocks, whose
maximum impacts add up to a bound. The pivot is the next stretch of documents
whose bound reaches the threshold; everything before it is skipped without
decompression. Only blocks over such stretches are decompressed, and their
documents scored, which raises the threshold. Some segments are searched first;
their k-th best scores are thresholds for the others. All scores are whole
numbers, so bounds are exact and nothing is lost.

Defined cases: null and wordless documents count for nothing; a document row
without id is ranked with a null id, after others of its score; repeated rows
are ranked each; item rows of one id are one query, which has their terms once
each; terms that no document has are ignored, items without results give no
rows. Input columns are chosen by name, others are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import as_bytes, cut, release, table

#: Results of a query, documents of a posting block, postings of a segment (or one document), terms of a block of queries.
K, BLOCK, SEGMENT_POSTINGS, QUERY_TERMS = 50, 128, 1 << 20, 100_000
#: One of so many segments is searched first. Documents that are scored at once. Bytes of text that are split at once.
FIRST_OF, WINDOW, CHUNK = 8, 2048, 1 << 20

#: Lower case; everything that isn't part of a term is a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
SEGMENT = "segment long, docs long, total long, ids array<bigint>, lengths binary, terms array<binary>, dfs array<int>, blocks binary, impacts binary, impact_ends binary, data binary"
#: A posting block: first and last document, where its bytes begin, bytes of a gap and of a number of occurrences.
PLACE = np.dtype([("first", "<i4"), ("last", "<i4"), ("at", "<i4"), ("gap", "u1"), ("tf", "u1")])


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Terms in order, a chunk of the text at a time; chunks end where a term does."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and FOLD[text[end]] != 32:
            end += 1
        yield text[at:end].translate(FOLD).split()
        at = end


class Builder:
    """Postings of a segment's documents."""

    def __init__(self):
        self.ids, self.lengths, self.terms, self.parts, self.postings = [], [], {}, [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        counts = Counter()
        for found in tokens(text):
            counts.update(found)
        if counts:
            number = self.terms
            self.parts.append((np.fromiter((number.setdefault(t, len(number)) for t in counts), np.int32, len(counts)), np.fromiter(counts.values(), np.int32, len(counts))))
            self.ids.append(doc_id)
            self.lengths.append(counts.total())
            self.postings += len(counts)

    def row(self, segment: int) -> list[pa.Array]:
        """The columns of SEGMENT."""
        lengths = np.array(self.lengths, np.int64)
        term, tf = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), [len(t) for t, _ in self.parts])
        order = np.argsort(term, kind="stable")
        term, doc, tf = term[order], doc[order], tf[order]
        df = np.bincount(term, minlength=len(self.terms))
        place = np.arange(len(term)) - (np.cumsum(df) - df)[term]
        start = np.flatnonzero(place % BLOCK == 0)
        block = np.cumsum(place % BLOCK == 0) - 1
        sizes = np.diff(np.append(start, len(term)))
        gaps = np.diff(doc, prepend=0) - 1
        gaps[start] = 0
        blocks = np.zeros(len(start), PLACE)
        blocks["first"], blocks["last"] = doc[start], doc[start + sizes - 1]
        for name, values in (("gap", gaps), ("tf", tf - 1)):
            most = np.maximum.reduceat(values, start)
            blocks[name] = np.select([most == 0, most < 1 << 8, most < 1 << 16], [0, 1, 2], 4)
        blocks["at"] = np.cumsum(sizes * (blocks["gap"].astype(np.int64) + blocks["tf"])) - sizes * (blocks["gap"].astype(np.int64) + blocks["tf"])
        data = np.zeros(int((sizes * (blocks["gap"].astype(np.int64) + blocks["tf"])).sum()), np.uint8)
        within = place % BLOCK
        for name, values, base in (("gap", gaps, blocks["at"]), ("tf", tf - 1, blocks["at"] + sizes * blocks["gap"])):
            for width in (1, 2, 4):
                here = np.flatnonzero(blocks[name][block] == width)
                at = base[block[here]] + within[here] * width
                data[at[:, None] + np.arange(width)] = values[here].astype(f"<u{width}").view(np.uint8).reshape(-1, width)
        # A block's pairs by rising length, each with more occurrences than all before it.
        order = np.lexsort((-tf, lengths[doc], block))
        height = block[order].astype(np.int64) << 32 | tf[order]
        best = height > np.concatenate([[-1], np.maximum.accumulate(height)[:-1]])
        chosen = order[best]
        impacts = np.stack([tf[chosen], lengths[doc[chosen]]], axis=1).astype("<i4")
        ends = np.cumsum(np.bincount(block[chosen], minlength=len(start))).astype("<i4")
        cells = [segment, len(lengths), int(lengths.sum()), self.ids, lengths.astype("<i8").tobytes(), list(self.terms), df.tolist(), blocks.tobytes(), impacts.tobytes(), ends.tobytes(), data.tobytes()]
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())] + [pa.binary()] * 4
        return [pa.array([c], k) for c, k in zip(cells, kinds, strict=True)]


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The segments of documents."""
    names = [part.split()[0] for part in SEGMENT.split(", ")]

    def run(batches):
        release()
        made, now = TaskContext.get().partitionId() << 32, Builder()
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                now.add(doc_id, raw or b"")
                if now.postings >= SEGMENT_POSTINGS:
                    yield pa.RecordBatch.from_arrays(now.row(made), names)
                    made, now = made + 1, Builder()
        if now.postings:
            yield pa.RecordBatch.from_arrays(now.row(made), names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SEGMENT)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term), once each."""

    def run(batches):
        release()
        for batch in batches:
            for k, raw in enumerate(as_bytes(batch.column(1))):
                terms = list({t for found in tokens(raw or b"") for t in found})
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column(0).slice(k, 1)] * len(terms)) if terms else batch.column(0).slice(0, 0), pa.array(terms, pa.binary())], ["item_id", "term"])

    kind = items.schema[id_col].dataType.simpleString()
    return items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).mapInArrow(run, f"item_id {kind}, term binary").distinct()


def impact(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """What occurrences in documents of some length are worth, before the term's weight."""
    longest = int(length.max(initial=0))
    counted = length.astype(np.int64) if 50 * longest * n < 1 << 63 else length.astype(object)
    m = (50 + 50 * counted * n // total).astype(np.int64)
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Segment:
    """One segment's lists for the queries of a block: bounds of posting blocks, and decompressed blocks once they are needed."""

    def __init__(self, row: dict, wanted: dict[bytes, int], n: int, total: int):
        self.ids = row["ids"]
        self.lengths = np.frombuffer(row["lengths"], "<i8")
        self.df, self.blocks = row["dfs"], np.frombuffer(row["blocks"], PLACE)
        self.impacts, self.impact_ends, self.data = np.frombuffer(row["impacts"], "<i4").reshape(-1, 2), np.frombuffer(row["impact_ends"], "<i4"), np.frombuffer(row["data"], np.uint8)
        self.n, self.total = n, total
        at = np.append(0, np.cumsum(-(-self.df // BLOCK)))
        self.lists = {t: (k, w, at[k], at[k + 1]) for k, t in enumerate(row["terms"]) if (w := wanted.get(t))}
        self.bounds: dict[bytes, np.ndarray] = {}
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bound(self, term: bytes) -> np.ndarray:
        """The maximum impact of each of a term's blocks."""
        if term not in self.bounds:
            _, w, low, high = self.lists[term]
            start = self.impact_ends[low - 1] if low else 0
            pairs = self.impacts[start : self.impact_ends[high - 1]]
            ends = self.impact_ends[low:high] - start
            self.bounds[term] = w * np.maximum.reduceat(impact(pairs[:, 0], pairs[:, 1], self.n, self.total), np.append(0, ends[:-1]))
        return self.bounds[term]

    def decompressed(self, term: bytes, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block, and what the term adds to their scores."""
        if block not in self.open:
            k, w, low, high = self.lists[term]
            size = int(self.df[k] - (high - 1 - low) * BLOCK) if block == high - 1 else BLOCK
            first, _, at, gap, tf = self.blocks[block].tolist()
            values = []
            for width in (gap, tf):
                values.append(self.data[at : at + size * width].view(f"<u{width}").astype(np.int64) if width else np.zeros(size, np.int64))
                at += size * width
            doc = first + np.cumsum(values[0]) + np.arange(size)
            self.open[block] = doc, w * impact(values[1] + 1, self.lengths[doc], self.n, self.total)
        return self.open[block]

    def search(self, terms: list[bytes], floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best that reach the floor and 1, ties to smaller ids."""
        terms = [t for t in terms if t in self.lists]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not terms:
            return docs, scores
        block = np.concatenate([np.arange(*self.lists[t][2:]) for t in terms])
        whose = np.repeat(np.arange(len(terms)), [self.lists[t][3] - self.lists[t][2] for t in terms])
        high = np.concatenate([self.bound(t) for t in terms])
        # Stretches of documents between neighbouring block boundaries, and what their blocks' impacts add up to.
        edges, spot = np.unique(np.concatenate([self.blocks["first"][block], self.blocks["last"][block] + 1]), return_inverse=True)
        opens, closes = spot[: len(block)], spot[len(block) :]
        steps = np.zeros(len(edges), np.int64)
        np.add.at(steps, opens, high)
        np.add.at(steps, closes, -high)
        reach, wide = np.cumsum(steps)[:-1], np.diff(edges)
        least, at = max(1, floor), 0
        while True:
            # Shallow moves: to the next stretches whose bound reaches the threshold.
            pivots = at + np.flatnonzero(reach[at:] >= least)
            if not len(pivots):
                return docs, scores
            pivots = pivots[: max(1, int(np.searchsorted(np.cumsum(wide[pivots]), WINDOW)))]
            at = int(pivots[-1]) + 1
            live = np.zeros(len(wide), bool)
            live[pivots] = True
            start = int(edges[pivots[0]])
            shown = np.repeat(live[pivots[0] : at], wide[pivots[0] : at])
            passed = np.append(0, np.cumsum(live))
            sums = np.zeros(len(shown), np.int64)
            near = np.flatnonzero(passed[closes] > passed[opens])
            for w in np.unique(whose[near]):
                got = [self.decompressed(terms[w], int(b)) for b in block[near[whose[near] == w]]]
                doc, value = (np.concatenate(x) for x in zip(*got, strict=True))
                doc = doc - start
                inside = (doc >= 0) & (doc < len(shown))
                sums[doc[inside]] += value[inside]
            found = np.flatnonzero(shown & (sums >= least))
            docs, scores = np.concatenate([docs, found + start]), np.concatenate([scores, sums[found]])
            if len(docs) > k:
                ids = [self.ids[d] for d in docs.tolist()]
                order = sorted(range(len(docs)), key=lambda x: (-scores[x], ids[x] is None, ids[x] or 0))[:k]
                docs, scores = docs[order], scores[order]
            if len(docs) == k:
                least = max(least, int(scores.min()))


def search(segments: DataFrame, queries, n: int, total: int, k: int, id_type: str) -> DataFrame:
    """(item_id, doc_id, score): each segment's k best for each query. queries: a broadcast of [(item_id, terms, weights, floor)]."""

    def run(batches):
        release()
        wanted = {t: w for _, terms, weights, _ in queries.value for t, w in zip(terms, weights, strict=True)}
        for batch in batches:
            for at in range(batch.num_rows):
                cells = {c: batch.column(c).slice(at, 1) for c in batch.schema.names}
                row = {c: cells[c][0].as_py() for c in ("ids", "lengths", "terms", "blocks", "impacts", "impact_ends", "data")}
                part = Segment(row | {"dfs": cells["dfs"].flatten().to_numpy()}, wanted, n, total)
                items, docs, scores = [], [], []
                for item, terms, _, floor in queries.value:
                    found, score = part.search(terms, floor, k)
                    items += [item] * len(found)
                    docs += [part.ids[d] for d in found.tolist()]
                    scores += score.tolist()
                if items:
                    yield pa.RecordBatch.from_arrays([pa.array(items, pa_type), pa.array(docs, pa.int64()), pa.array(scores, pa.int64())], ["item_id", "doc_id", "score"])

    pa_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
    return segments.drop("segment", "docs", "total").mapInArrow(run, f"item_id {id_type}, doc_id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id (long, int or string), rank, doc_id, score: each item's k best documents."""
    spark = docs.sparkSession
    segments = cut(index(docs), "segments")
    sizes = segments.agg(F.sum("docs").alias("n"), F.sum("total").alias("total")).first()
    n, total = sizes.n or 0, sizes.total or 0
    asked = cut(item_terms(items), "item-terms")
    id_type = asked.schema["item_id"].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    distinct = asked.select("term").distinct()
    counted = segments.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.dfs").cast("long").alias("df"))
    df = counted.join(distinct, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.log((2.0 * n + 2) / (2.0 * F.col("df") + 1)) * 1000.0).cast("long")
    weighed = cut(asked.join(df, "term").select("item_id", "term", weight.alias("w")).where("w > 0"), "weights")
    parts = max(1, -(-weighed.count() // QUERY_TERMS))
    numbered = weighed.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
    early = F.pmod(F.xxhash64("segment"), F.lit(FIRST_OF)) == 0
    out = None
    for part in range(parts):
        # So many terms at most (or one item's) reach the driver at once.
        block = numbered.where(F.col("part") == part).groupBy("item_id").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("ws")).collect()
        queries = [(r.item_id, [bytes(t) for t in r.terms], list(r.ws), 0) for r in block]
        first = cut(search(segments.where(early), spark.sparkContext.broadcast(queries), n, total, k, id_type), "early")
        floors = {r.item_id: r.score for r in best(first, k).where(F.col("rank") == k).select("item_id", "score").collect()}
        queries = [(item, terms, ws, floors.get(item, 0)) for item, terms, ws, _ in queries]
        rest = cut(search(segments.where(~early), spark.sparkContext.broadcast(queries), n, total, k, id_type), "late")
        found = best(first.union(rest), k).select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.union(found)
    return out


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = {
    "op11_lexical": r"""
with d as (select row_number() over () rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') t from documents where text is not null),
e as (select rid, doc_id, t, len(t) n from d where len(t) > 0),
size as (select count(*) nn, cast(sum(n) as bigint) ll from e),
tf as (select rid, term, count(*) tf from (select rid, unnest(t) term from e) group by all),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark),
w as (select term, cast(floor(ln((2e0 * any_value(nn) + 2) / (2e0 * count(*) + 1)) * 1000e0) as bigint) w from tf, size group by term),
scores as (select q.item_id, e.doc_id, tf.rid, cast(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (100 - 50 + ((50 * e.n * nn) // ll))))) as bigint) score
  from q join w using (term) join tf using (term) join e on e.rid = tf.rid, size group by all)
select item_id, cast(rank as integer) as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from scores where score > 0) where rank <= 50"""
}
QUERIES = {"op11_lexical": op11_lexical}
