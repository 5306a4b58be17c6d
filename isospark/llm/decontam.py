"""Benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are the windows of 13 consecutive words of every benchmark item (an
item of fewer words is one window), written as " w1 w2 ... w13 " in bytes, and
a document is normalised to the same form, so matches keep to whole words. The
search looks at the block of BLOCK bytes that ends at the current position: the
shift table says how far the window may jump without passing an occurrence (a
block that no pattern has in its first m bytes jumps m - BLOCK + 1 bytes, m the
shortest pattern). The table is an array of fixed size addressed by a hash of the
block; blocks with one address share the smaller shift, which is always safe.
Where the shift is zero, the block's bucket gives the patterns whose first m
bytes end with it, and direct comparison confirms.

The search is a column function: texts of documents are read once, nothing is
shuffled, and a document's size bounds a task's memory. The patterns go to the
executors as broadcasts of at most BLOCK_BYTES of item text each (a longer item
alone). A worker keeps the tables of KEPT of them; with more, it builds tables
again for each batch, so the benchmark's size is not limited by its memory.

Defined cases: a null or wordless document has no words and is clean; a null or
wordless item has no window; repeated items count each, repeated rows are
judged each. Item ids are compared as strings, null ids are left out of
item lists but their windows count. Input columns are chosen by name, others are
not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, table, worker_state

#: Words of a window, and bytes of a block of the shift table.
WINDOW, BLOCK = 13, 10
#: Bytes of benchmark text in one broadcast, whose tables take about 50 times that (measured: 52 MB); tables that a worker keeps.
BLOCK_BYTES, KEPT = 1 << 20, 3
#: Addresses of the shift table (a power of two, a byte each), and the longest jump.
ADDRESSES, FARTHEST = 1 << 22, 255
#: A document is contaminated if at least one of so many words is hit.
SHARE = 20

#: A-Z to a-z; ASCII other than letters and digits to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

RESULT = "struct<n_words:bigint,n_hit:bigint,items:array<string>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class WuManber:
    """Finds all windows of a set of items in normalised texts."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.patterns: dict[bytes, tuple] = {}
        full, short = [], []
        for item, text in items:
            words = words_of(text)
            for k in range(max(1, len(words) - window + 1) if words else 0):
                part = words[k : k + window]
                pattern = b" %s " % b" ".join(part)
                known = self.patterns.get(pattern, ())
                if not known:
                    (full if len(part) == window else short).append(pattern)
                if item not in known:
                    self.patterns[pattern] = (*known, item)
        # Short items would shorten every jump, so they get tables of their own.
        self.tables = [self.tables_of(group) for group in (full, short) if group]

    def tables_of(self, patterns: list[bytes]) -> tuple:
        m = min(map(len, patterns))
        block = min(BLOCK, m)
        shift = bytearray([min(m - block + 1, FARTHEST)]) * ADDRESSES
        bucket: dict[bytes, list[bytes]] = {}
        for p in patterns:
            for end in range(block, m + 1):
                at = hash(p[end - block : end]) % ADDRESSES
                if shift[at] > m - end:
                    shift[at] = m - end
            bucket.setdefault(p[m - block : m], []).append(p)
        return m, block, shift, bucket

    def search(self, text: bytes) -> list[tuple[int, bytes]]:
        """(start, pattern) of each occurrence in a normalised text."""
        found = []
        for m, block, shift, bucket in self.tables:
            end, n = m, len(text)
            while end <= n:
                piece = text[end - block : end]
                step = shift[hash(piece) % ADDRESSES]
                if step:
                    end += step
                    continue
                start = end - m
                for p in bucket.get(piece, ()):
                    if text.startswith(p, start):
                        found.append((start, p))
                end += 1
        return found

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Numbers of the words inside any occurrence, and the items found."""
        if not words or not self.tables:
            return np.zeros(0, np.int64), set()
        text = b" %s " % b" ".join(words)
        found = self.search(text)
        if not found:
            return np.zeros(0, np.int64), set()
        spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        first = np.searchsorted(spaces, [start for start, _ in found])
        marks = np.zeros(len(words) + 1, np.int64)
        np.add.at(marks, first, 1)
        np.add.at(marks, first + np.array([p.count(b" ") - 1 for _, p in found]), -1)
        return np.flatnonzero(np.cumsum(marks[:-1]) > 0), {i for _, p in found for i in self.patterns[p] if i is not None}


def _searcher(block) -> WuManber:
    """The tables of a broadcast."""
    return worker_state(("wu-manber", getattr(block, "_path", None) or id(block)), lambda: WuManber(block.value), KEPT)


class Benchmark:
    """Items in broadcasts of bounded size, and the column function that looks for them."""

    def __init__(self, items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES):
        context = items.sparkSession.sparkContext
        rows = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")).where("t is not null").toLocalIterator()
        self.blocks, now, size = [], [], 0
        for r in rows:
            now.append((r.i, bytes(r.t)))
            size += len(now[-1][1])
            if size >= block_bytes:
                self.blocks.append(context.broadcast(now))
                now, size = [], 0
        if now:
            self.blocks.append(context.broadcast(now))

    def scan(self, text: Column) -> Column:
        """struct of n_words, n_hit, items (sorted as strings) for each text."""
        blocks = self.blocks

        @F.arrow_udf(RESULT)
        def wu_manber(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                n_words, hit, items = [], [np.zeros(0, np.int64)] * len(batch), [set() for _ in range(len(batch))]
                for b, block in enumerate(blocks):
                    searcher = _searcher(block)
                    for k, raw in enumerate(as_bytes(batch)):
                        words = words_of(raw) if raw else []
                        if not b:
                            n_words.append(len(words))
                        places, found = searcher.hits(words)
                        if found or len(places):
                            hit[k] = np.union1d(hit[k], places)
                            items[k] |= found
                if not blocks:
                    n_words = [len(words_of(raw)) if raw else 0 for raw in as_bytes(batch)]
                yield pa.StructArray.from_arrays(
                    [pa.array(n_words, pa.int64()), pa.array([len(x) for x in hit], pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], ["n_words", "n_hit", "items"]
                )

        return wu_manber.asNondeterministic()(text)


def contaminated(n_words: Column, n_hit: Column) -> Column:
    return (n_hit > 0) & (n_hit * SHARE >= n_words)


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_hit, items array<string> and contaminated of each row."""
    found = docs.select(F.col(id_col).alias("doc_id"), Benchmark(items).scan(F.col(text_col)).alias("r"))
    return found.select("doc_id", "r.n_words", "r.n_hit", "r.items", contaminated(F.col("r.n_words"), F.col("r.n_hit")).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that are not contaminated, with their own columns."""
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    judged = docs.select(row, Benchmark(items).scan(F.col(text_col)).alias("r"))
    return judged.where(~contaminated(F.col("r.n_words"), F.col("r.n_hit"))).select("row.*")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE = {
    "op9_decontamination": rf"""
with bw as (select item_id, coalesce(list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}'), lambda x: x <> ''), []) w from benchmark),
win as (select item_id, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + 12], ' '))) p, least(len(w), 13) k from bw where len(w) > 0),
dw as (select row_number() over () r, doc_id, coalesce(list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}'), lambda x: x <> ''), []) w from documents),
ks as (select distinct k from win),
grams as (select r, k, unnest(range(1, len(w) - k + 2)) s, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) p from dw, ks where len(w) >= k),
hits as (select distinct g.r, g.s, g.k, win.item_id from grams g join win on g.p = win.p and g.k = win.k),
n_hit as (select r, count(distinct i) n from (select r, unnest(range(s, s + k)) i from hits) group by r),
n_items as (select r, count(*) n, string_agg(i, ',' order by i) l from (select distinct r, cast(item_id as varchar) i from hits) group by r)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(h.n, 0) as bigint) n_hit, cast(coalesce(i.n, 0) as bigint) n_items, sha256(coalesce(l, '')) items_sha256,
  coalesce(h.n, 0) > 0 and 20 * coalesce(h.n, 0) >= len(w) contaminated
from dw left join n_hit h using (r) left join n_items i using (r)"""
}

QUERIES = {"op9_decontamination": op9_decontamination}
