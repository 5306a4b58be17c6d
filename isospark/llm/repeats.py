"""Repeated passages by a sparse suffix array.

Reported is every maximal run of words covered by windows of LENGTH words that
another text holds too (words fold A-Z and split at other ASCII). Suffixes are
retained only where content selects them: a window's 5-word grams 1 to SPAN have
one of smallest hash (leftmost if equal), and the suffix at that gram is
retained, about one of 15 positions. Two equal windows select the same place, so
no repeat is lost: both texts retain it, and agree on BEFORE words to its left
and LENGTH to its right as far as the window goes.

1. Suffixes whose first KEY words no other text retains are dropped (by a hash of
   the words; a collision only keeps one too many). Suffixes that agree in all
   words within reach of a window become one context, by the words themselves.
2. Contexts are sorted by their words to the right, and again by those to the
   left. Neighbours of different texts are compared word by word and extended
   both ways; what they share says which windows are repeated. The neighbours in
   the two orders share the most words to the right and to the left that any
   context shares, which bounds what further ones could add.
3. Where the bound leaves a window open (one context shares the left part,
   another the right), the windows of its interval are compared whole.
4. Windows side by side merge into maximal spans.

A frequent passage is one context wherever its surroundings are out of reach;
contexts at its ends differ, so the sort spreads them over ranges. Contexts at
the ends of a range don't see all neighbours and are left to step 3.

Exact copies are the same text, so they don't confirm each other's windows; each
is reported as one span that covers it. Texts are shuffled once, in step 2, and
only those with suffixes that others retain, one of each group of exact copies.

Defined cases: null and shorter texts hold no window; rows without id take no
part; repeated rows of one id and text count once. Repeats within one text alone
aren't reported. Input columns are chosen by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import as_bytes, cut, release, table
from .decontam import words_of

#: Words of a repeat, of a gram, grams among which a window selects, words of a key (a window's rest).
LENGTH, GRAM, SPAN = 50, 5, 30
KEY = LENGTH - SPAN + 1
#: Words before a place that a window which selects it can hold.
BEFORE = SPAN - 1
STEP = np.uint64(0x9E3779B97F4A7C15)


def rolling(h: np.ndarray, size: int, step: np.uint64 = STEP) -> np.ndarray:
    """Hashes of all runs of size words, from the words' hashes, by doubling."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, at, part, width, power = None, 0, h, 1, step
        left = size
        while left:
            if left & 1:
                piece = part[at : at + n]
                out = piece if out is None else out * power + piece
                at += width
            left >>= 1
            if left:
                m = len(part) - width
                part = part[:m] * power + part[width : width + m]
                width, power = width * 2, power * power
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(29))


def retained(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of words, and for each window's start the place that it selects."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - LENGTH + 1
    if n <= 0:
        return h, np.zeros(0, np.int64)
    grams = rolling(h, GRAM)[: n + SPAN - 1]
    out = np.zeros(n, np.int64)
    for k in range(0, n, 8192):
        some = grams[k : min(n, k + 8192) + SPAN - 1]
        out[k : k + 8192] = np.lib.stride_tricks.sliding_window_view(some, SPAN).argmin(axis=1)
    return h, out + np.arange(n)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, kind.to_pandas_dtype()), *values]), kind))


def suffixes(text: Column) -> Column:
    """struct<body: hash of all words, n_words, places, keys> of the retained suffixes."""

    @F.arrow_udf("struct<body:bigint,n_words:bigint,places:array<int>,keys:array<bigint>>")
    def retained_suffixes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        for batch in batches:
            body, sizes, places, keys = [], [], [], []
            for raw in as_bytes(batch):
                words = words_of(raw) if raw else []
                body.append(xxhash.xxh64_intdigest(b" ".join(words)))
                sizes.append(len(words))
                h, selected = retained(words) if len(words) >= LENGTH else (None, np.zeros(0, np.int64))
                at = np.unique(selected)
                places.append(at.astype(np.int32))
                keys.append(rolling(h, KEY)[at].view(np.int64) if len(at) else np.zeros(0, np.int64))
            yield pa.StructArray.from_arrays([pa.array(np.array(body, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), _lists(places, pa.int32()), _lists(keys, pa.int64())], ["body", "n_words", "places", "keys"])

    return retained_suffixes.asNondeterministic()(text)


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words around each retained suffix (before: nearest first), a few thousand at a time. Rows: doc_id, body, text, places."""
    release()
    out = []
    for batch in batches:
        doc_ids, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for doc_id, body, raw, places in zip(doc_ids, bodies, as_bytes(batch.column(2)), batch.column(3), strict=True):
            words = words_of(raw)
            if np.uint64(xxhash.xxh64_intdigest(b" ".join(words))).view(np.int64) != body:
                continue  # another text of the same id
            for place in places.values.to_pylist():
                after = b" ".join([*words[place : place + LENGTH], b""])
                before = b" ".join([*reversed(words[max(0, place - BEFORE) : place]), b""])
                key = np.uint64(xxhash.xxh64_intdigest(b" ".join(words[place : place + KEY]))).view(np.int64)
                out.append((doc_id, body, place, key, xxhash.xxh3_128_digest(before + b"|" + after), before, after))
                if len(out) == 4096:
                    yield _batch(out, CONTEXT)
                    out = []
    if out:
        yield _batch(out, CONTEXT)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def common(a: list[bytes], b: list[bytes]) -> int:
    """The number of leading words that a and b share."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def window_bits(left: int, right: int) -> int:
    """The windows within `left` words before a place and `right` from it on: bit a for the one that begins a words before."""
    low, high = max(0, LENGTH - right), min(BEFORE, left)
    return (1 << high + 1) - (1 << low) if low <= high else 0


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What sorted contexts share with the nearest ones of other texts. Rows: ctx, key, before, after, body (null: of several texts), low, high.

    Held are the neighbouring contexts of one text, no more than the text has.
    """
    release()
    key, last, run, unseen, out = None, None, [], True, []

    def compare(x, y):
        left, right = common(x[2], y[2]), common(x[3], y[3])
        bits = window_bits(left, right)
        low, high = (min(x[5], y[5]), max(x[6], y[6])) if bits else (None, None)
        out.extend((z[0], z[1], bits, left, right, low, high) for z in (x, y))

    def reach(x, bits=0):
        out.append((x[0], x[1], bits, len(x[2]), len(x[3]), *(x[5:7] if bits else (None, None))))

    for batch in batches:
        for k in range(0, len(batch), 1024):
            for ctx, row_key, before, after, body, low, high in zip(*(c.to_pylist() for c in batch.slice(k, 1024).columns), strict=True):
                row = (ctx, row_key, before.split(), after.split(), body, low, high)
                if row_key != key:
                    unseen = key is None
                    key, last, run = row_key, None, [row]
                elif body is not None and run[-1][4] == body:
                    run.append(row)
                    if last:
                        compare(last, row)
                else:
                    for x in run:
                        compare(x, row)
                    last, run, unseen = run[-1], [row], False
                if body is None:
                    reach(row, window_bits(len(row[2]), len(row[3])))
                elif unseen:
                    reach(row)
            if out:
                yield _batch(out, SHARED)
                out = []
    for x in run:
        reach(x)
    if out:
        yield _batch(out, SHARED)


def open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The possible windows of contexts, in words. Rows: ctx, possible, known, before, after, a, b, low, high."""
    release()
    for batch in batches:
        for k in range(0, len(batch), 256):
            out = []
            for ctx, possible, known, before, after, *held in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns), strict=True):
                left, right = before.split(), after.split()
                for n in range(BEFORE + 1):
                    if possible >> n & 1:
                        out.append((ctx, 1 << n, not known >> n & 1, b" ".join([*left[:n][::-1], *right[: LENGTH - n]]), *held))
            if out:
                yield _batch(out, WINDOW)


_LONG, _BYTES = pa.int64(), pa.binary()
CONTEXT = pa.schema([("doc_id", _LONG), ("body", _LONG), ("place", pa.int32()), ("key", _LONG), ("ctx", _BYTES), ("before", _BYTES), ("after", _BYTES)])
SHARED = pa.schema([("ctx", _BYTES), ("key", _LONG), ("bits", _LONG), ("left", pa.int32()), ("right", pa.int32()), ("low", _LONG), ("high", _LONG)])
WINDOW = pa.schema([("ctx", _BYTES), ("bit", _LONG), ("open", pa.bool_()), ("window", _BYTES), ("a", _LONG), ("b", _LONG), ("low", _LONG), ("high", _LONG)])


def _ddl(schema: pa.Schema) -> str:
    names = {_LONG: "long", pa.int32(): "int", _BYTES: "binary", pa.bool_(): "boolean"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def repeated_windows(around: DataFrame) -> DataFrame:
    """ctx, bits of the repeated windows, low and high (two ids of holders) of the contexts that hold any."""
    held = [F.min("body").alias("a"), F.max("body").alias("b"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")]
    distinct = cut(around.groupBy("ctx", "key", "before", "after").agg(*held), "contexts")
    rows = distinct.select("ctx", "key", "before", "after", F.when(F.col("a") == F.col("b"), F.col("a")).alias("body"), "low", "high")
    ordered = [rows.repartitionByRange("key", *by).sortWithinPartitions("key", *by).select(*rows.columns).mapInArrow(neighbours, _ddl(SHARED)) for by in (("after", "before"), ("before", "after"))]
    found = [F.bit_or("bits").alias("bits"), F.min("low").alias("low"), F.max("high").alias("high")]
    extended = ordered[0].union(ordered[1]).groupBy("ctx", "key").agg(*found, F.max("left").alias("left"), F.max("right").alias("right"))
    first, end = F.greatest(F.lit(0), LENGTH - F.col("right")), F.least(F.lit(BEFORE), F.col("left")) + 1
    possible = F.when(first < end, F.expr("shiftleft(1L, end)") - F.expr("shiftleft(1L, first)")).otherwise(F.lit(0))
    extended = cut(extended.withColumn("first", first).withColumn("end", end).withColumn("possible", possible).drop("first", "end", "left", "right"), "extended")
    # A window lies at the same place in all contexts that hold it, so those open in no context of an interval aren't looked at.
    wanted = cut(extended.where("possible & ~bits <> 0").groupBy("key").agg(F.bit_or(F.expr("possible & ~bits")).alias("wanted")), "unsettled")
    asked = extended.join(wanted, "key").where("possible & wanted <> 0").select("ctx", F.expr("possible & wanted").alias("possible"), F.col("bits").alias("known"))
    asked = asked.join(distinct.join(wanted.select("key"), "key"), "ctx").select("ctx", "possible", "known", "before", "after", "a", "b", "low", "high")
    whole = cut(asked.mapInArrow(open_windows, _ddl(WINDOW)), "windows")
    several = whole.groupBy("window").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("low").alias("low"), F.max("high").alias("high")).where("a <> b")
    settled = whole.where("open").select("ctx", F.col("bit").alias("bits"), "window").join(several.select("window", "low", "high"), "window").select("ctx", "bits", "low", "high")
    return extended.where("bits <> 0").select("ctx", "bits", "low", "high").union(settled).groupBy("ctx").agg(*found)


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start_word, end_word (exclusive), other_doc_id (a document that shares words of it) of each maximal span."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    found = cut(texts.select("doc_id", suffixes(F.col("text")).alias("s")).where(f"s.n_words >= {LENGTH}").select("doc_id", "s.*"), "suffixes")
    copies = cut(found.groupBy("body").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high"), "copies")
    entries = found.select("doc_id", "body", F.explode(F.arrays_zip("places", "keys")).alias("e")).select("doc_id", "body", F.col("e.places").alias("place"), F.col("e.keys").alias("key"))
    keys = cut(entries.groupBy("key").agg(F.min("body").alias("a"), F.max("body").alias("b")).where("a <> b").select("key"), "shared-suffixes")
    remaining = entries.join(keys, "key").groupBy("doc_id", "body").agg(F.collect_set("place").alias("places"))
    remaining = remaining.join(copies.select("body", "low"), "body", "left").where("low is null or low = doc_id")
    around = cut(texts.join(remaining, "doc_id").select("doc_id", "body", "text", "places").mapInArrow(contexts, _ddl(CONTEXT)), "places")
    marked = around.select("doc_id", "body", "place", "ctx").join(repeated_windows(around), "ctx")

    # Runs of repeated windows around a place, then those that touch, in the order of a text.
    has = lambda n: F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), n)) != 0
    places = F.sequence(F.lit(0), F.lit(BEFORE))
    begins = F.filter(places, lambda n: has(n) & ~((n > 0) & has(F.greatest(n - 1, F.lit(0)))))
    ends = F.filter(places, lambda n: has(n) & ~((n < BEFORE) & has(n + 1)))
    runs = marked.select("doc_id", "body", "place", "low", "high", F.explode(F.arrays_zip(begins.alias("near"), ends.alias("far"))).alias("r"))
    runs = runs.select("doc_id", "body", "low", "high", (F.col("place") - F.col("r.far")).alias("first"), (F.col("place") - F.col("r.near")).alias("last"))
    text = Window.partitionBy("doc_id", "body").orderBy("first")
    runs = runs.withColumn("reached", F.max("last").over(text.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("span", F.count_if(F.col("reached").isNull() | (F.col("first") > F.col("reached") + LENGTH)).over(text.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("doc_id", "body", "span").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("low").alias("low"), F.max("high").alias("high"))
    spans = cut(spans, "spans")

    members = found.select("doc_id", "body", "n_words").distinct().join(copies, "body")
    other = F.when(F.col("low") == F.col("doc_id"), F.col("high")).otherwise(F.col("low"))
    columns = ["doc_id", F.col("first").cast("long").alias("start_word"), (F.col("last") + LENGTH).cast("long").alias("end_word"), other.alias("other_doc_id")]
    of_copies = spans.drop("doc_id").join(members.where("doc_id <> low").select("body", "doc_id"), "body")
    whole = members.select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n_words").alias("end_word"), other.alias("other_doc_id"))
    return spans.select(*columns).union(of_copies.select(*columns)).union(whole).groupBy("doc_id", "start_word", "end_word").agg(F.min("other_doc_id").alias("other_doc_id"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(table(spark, sf_dir, "documents"))


QUERIES, ORACLE = {"op4_repeats": op4_repeats}, {}
