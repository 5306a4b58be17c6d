"""Phrase collocation mining over generalised suffix automata, one for each shard of texts.

Texts of a language are split into pieces and words. A shard (a bounded number
of words of one task's documents) numbers its words and builds the generalised
suffix automaton of its pieces, bounded to phrases of LONGEST words: a state
holds the phrases that end at the same places, its longest and shortest one, the
number of those places, and its suffix link. The states are found level by
level: end positions are grouped by their last word, then by the word before
it, and so on, so a group's parent is its suffix link, and a group with as many
places as its parent is in one state with it.

Words are counted first: a phrase that is found LEAST times has only words that are
found as often. These are numbered over all shards (Lexicon), and other words end a
piece as stops do. A shard then gives one row for each state with places of its own,
those that none of the states linked to it has: its longest phrase and the number of
these places. That is a row a word at most, whatever is frequent. A phrase's count is
the sum over all states whose longest phrase ends with it, so Spark deals the rows by
their last two words, sorts them by their words from the last one on, and each
partition adds neighbours up.

The lexicon is broadcast, so its size is bounded (LEXICON_WORDS, LEXICON_BYTES). With
more frequent words than that, each state's phrases are enumerated with its count as
texts, and Spark adds these. A pass before it then counts pairs of frequent words, by
hashes; words and pairs reach the tasks as bit sets of a fixed size (FILTER_BITS at
most), which may let further words and pairs pass but hold none back.

A candidate inside a longer candidate that is found almost as often is dropped.
Phrases with one more word are enough for that, as counts only fall with length:
those with a word before it have the phrase as their suffix link, those with a
word behind it as their prefix.

Defined cases: null texts are empty, null languages are `und`; repeated rows
count each; phrases keep their bytes as they are. Input columns are chosen by
name, others are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import as_bytes, cut, drop_cut, release, table

#: Words of the longest phrase, occurrences of a candidate, hundredths of its count that subsume a phrase, rows a language.
LONGEST, LEAST, SUBSUMED, TOP = 4, 30, 80, 2000
#: Words of a shard, bytes of text that are split at once, bits of a filter at least and at most.
SHARD_WORDS, CHUNK, FEWEST_BITS, FILTER_BITS = 1 << 20, 1 << 20, 1 << 16, 1 << 28
#: Words of the lexicon and their bytes at most. Words that make up one in so many of all are heavy.
LEXICON_WORDS, LEXICON_BYTES, HEAVY = 1 << 22, 1 << 26, 256
#: Seed of the hash of a language, which is the seed of its words' hashes (as Spark's xxhash64 of both).
SEED = 42

#: Lower case, separators of pieces as full stops, tabs as blanks.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\v\f\r" else 32 if c == 9 else c for c in range(256))
STOP = b"."


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words in order, with a full stop for each separator, a chunk of the text at a time."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            # A chunk ends at a blank, a tab or a separator; a longer word is taken whole.
            while end < len(text) and FOLD[text[end]] not in b". ":
                end += 1
        yield text[at:end].translate(FOLD).replace(STOP, b" . ").split()
        at = end


class Words(dict):
    """Numbers of words in order of appearance; the full stop is 0."""

    def __init__(self):
        super().__init__({STOP: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Shard:
    """Words of the pieces of one language, as numbers; a 0 stands between pieces and between texts."""

    def __init__(self):
        self.words, self.parts, self.size = Words(), [np.zeros(1, np.int32)], 1

    def add(self, text: bytes) -> None:
        number = self.words.__getitem__
        for found in tokens(text):
            self.parts.append(np.fromiter(map(number, found), np.int32, len(found)))
            self.size += len(found)
        self.parts.append(np.zeros(1, np.int32))

    def ids(self) -> np.ndarray:
        return np.concatenate(self.parts)

    def hashes(self, lang: str) -> np.ndarray:
        """64-bit hashes of language and word by number; that of the full stop is never looked up."""
        seed = xxhash.xxh64_intdigest(lang.encode(), SEED)
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of pairs of words from their own."""
    h = (first ^ first >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + second
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


class Filter:
    """A set of hashes as bits: all that were put in pass, few others do."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(64 * len(bits) - 1)

    def passed(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in _places(h, self.mask):
            out &= (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def _places(h, mask):
    """The two bits of a hash."""
    return h & mask, h >> np.uint64(32) & mask


def bit_set(hashes: DataFrame) -> np.ndarray:
    """The bits of a filter with the hashes (h long) in, 64 in a word. The driver sees at most FILTER_BITS of them."""
    n = hashes.count()
    bits = int(min(FILTER_BITS, max(FEWEST_BITS, 1 << (16 * n).bit_length())))
    both = hashes.select(F.explode(F.array(*[p.bitwiseAND(F.lit(bits - 1)) for p in (F.col("h"), F.shiftrightunsigned("h", 32))])).alias("p"))
    lines = both.groupBy(F.shiftright("p", 6).cast("int").alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("value"))
    found, out = lines.toArrow(), np.zeros(bits // 64, np.uint64)
    out[found["place"].to_numpy()] = found["value"].to_numpy().view(np.uint64)
    return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Shard]]:
    """Shards of at most SHARD_WORDS words (or one text) from batches (lang, text)."""
    held: dict[str, Shard] = {}
    for batch in batches:
        for lang, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            if raw:
                held.setdefault(lang, Shard()).add(raw)
                if sum(s.size for s in held.values()) >= SHARD_WORDS:
                    yield from held.items()
                    held = {}
    yield from held.items()


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of texts (lang, text)."""

    def run(batches):
        release()
        counts: dict[str, Counter] = {}

        def emit():
            for lang, found in counts.items():
                found.pop(STOP, None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])
            counts.clear()

        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                for found in tokens(raw or b""):
                    counts.setdefault(lang, Counter()).update(found)
                if sum(map(len, counts.values())) >= SHARD_WORDS // 4:
                    yield from emit()
        yield from emit()

    parts = texts.mapInArrow(run, "lang string, word binary, n long")
    return parts.groupBy("lang", F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))


def pair_counts(texts: DataFrame, frequent) -> DataFrame:
    """(h, n): pairs of neighbouring words that both pass the filter frequent (a broadcast)."""

    def run(batches):
        release()
        words = Filter(frequent.value)
        for lang, shard in _shards(batches):
            ids, h = shard.ids(), shard.hashes(lang)
            known = words.passed(h)
            known[0] = False
            good = known[ids]
            at = np.flatnonzero(good[:-1] & good[1:])
            pairs, n = np.unique(ids[at].astype(np.int64) << 32 | ids[at + 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair_hashes(h[pairs >> 32], h[pairs & 0xFFFFFFFF]).view(np.int64)), pa.array(n)], ["h", "n"])

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def automaton(ids: np.ndarray, joined: np.ndarray, longest: int = LONGEST) -> dict[str, np.ndarray]:
    """States of the suffix automaton of ids, bounded to so many words.

    joined tells of each position whether its word may follow the one before it;
    0 ends a piece. A state has the end of one of its occurrences, the lengths of
    its longest and shortest phrase, its number of end positions and its suffix
    link (a state, or -1 for the root).
    """
    end = np.flatnonzero(ids > 0)
    before = np.full(len(end), -1)  # the state of each position's phrase that is one word shorter
    out = {k: [] for k in ("end", "longest", "shortest", "count", "link")}
    made = 0
    for depth in range(1, longest + 1):
        if depth > 1:
            start = end - (depth - 1)
            keep = start >= 0
            keep[keep] = (ids[start[keep]] > 0) & joined[start[keep] + 1]
            end, before = end[keep], before[keep]
        if not len(end):
            break
        key = (before + 1).astype(np.int64) << 32 | ids[end - (depth - 1)]
        _, first, which, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        parent = before[first]
        longer = np.zeros(len(first), bool)
        if depth > 1:
            # As many places as the parent, and so all of them: the phrase joins its parent's state.
            counts = np.concatenate(out["count"])
            longer = count == counts[parent]
            for k in ("end", "longest"):
                values = np.concatenate(out[k])
                values[parent[longer]] = end[first[longer]] if k == "end" else depth
                out[k] = [values]
        fresh = ~longer
        state = np.where(longer, parent, made + np.cumsum(fresh) - 1)
        for k, v in (("end", end[first]), ("longest", np.full(len(first), depth)), ("shortest", np.full(len(first), depth)), ("count", count), ("link", parent)):
            out[k].append(v[fresh])
        made += int(fresh.sum())
        before = state[which]
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def phrases(ids: np.ndarray, joined: np.ndarray, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, their numbers as rows, counts) of all phrases of two words or more."""
    states = automaton(ids, joined, longest)
    for k in range(2, longest + 1):
        here = (states["shortest"] <= k) & (k <= states["longest"])
        at = states["end"][here]
        yield k, ids[at[:, None] + np.arange(1 - k, 1)], states["count"][here]


def phrase_counts(texts: DataFrame, frequent, pairs) -> DataFrame:
    """(lang, phrase, words, a): counts of phrases all of whose words and pairs pass the filters (broadcasts)."""

    def run(batches):
        release()
        known_words, known_pairs = Filter(frequent.value), Filter(pairs.value)
        for lang, shard in _shards(batches):
            ids, h = shard.ids(), shard.hashes(lang)
            known = known_words.passed(h)
            known[0] = False
            joined = np.zeros(len(ids), bool)
            good = known[ids]
            at = np.flatnonzero(good[:-1] & good[1:])
            joined[at[known_pairs.passed(pair_hashes(h[ids[at]], h[ids[at + 1]]))] + 1] = True
            # Places that no frequent pair reaches are left out; a stop stands between the rest.
            used = joined.copy()
            used[:-1] |= joined[1:]
            place = np.flatnonzero(used)
            apart = np.flatnonzero(~joined[place])
            ids, joined = np.insert(ids[place], apart, 0), np.insert(joined[place], apart, False)
            words = list(shard.words)
            for k, rows, count in phrases(ids, joined):
                for part in range(0, len(rows), 100_000):
                    text = [b" ".join([words[w] for w in row]) for row in rows[part : part + 100_000].tolist()]
                    n = len(text)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(text, pa.binary()), pa.array(np.full(n, k, np.int32)), pa.array(count[part : part + n])], ["lang", "phrase", "words", "a"])

    parts = texts.mapInArrow(run, "lang string, phrase binary, words int, a long")
    return parts.groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "words").agg(F.sum("a").alias("a"))


class Lexicon:
    """Frequent words with their language, numbered from 1 by descending count."""

    def __init__(self, found: pa.Table, total: int):
        n = found["n"].to_numpy()
        order = np.argsort(-n, kind="stable")
        self.heavy = int((n * HEAVY >= total).sum())
        named = found["lang"].combine_chunks().dictionary_encode()
        self.langs, self.lang = named.dictionary.to_pylist(), named.indices.to_numpy()[order]
        words = found["word"].combine_chunks().cast(pa.large_binary()).take(pa.array(order))
        self.at = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)
        self.bytes = words.buffers()[2].to_pybytes()
        h = found["h"].to_numpy().view(np.uint64)[order]
        self.order = np.argsort(h).astype(np.int32)
        self.hashes = h[self.order]

    def exact(self) -> bool:
        """Whether all hashes differ, so that one comparison finds a word."""
        return bool((self.hashes[1:] != self.hashes[:-1]).all())

    def word(self, number: int) -> bytes:
        return self.bytes[self.at[number - 1] : self.at[number]]

    def numbers(self, lang: str, shard: Shard) -> np.ndarray:
        """Numbers by the shard's own; 0 for words that aren't frequent."""
        h = shard.hashes(lang)
        out = np.zeros(len(h), np.int32)
        if lang in self.langs:
            code, place = self.langs.index(lang), np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            words = list(shard.words)
            for k in np.flatnonzero(self.hashes[place] == h).tolist():
                number = int(self.order[place[k]]) + 1
                if k and self.lang[number - 1] == code and self.word(number) == words[k]:
                    out[k] = number
        return out


def lexicon(common: DataFrame, total: DataFrame) -> Lexicon | None:
    """The lexicon of the words common, or None where it would be too large to be broadcast."""
    size = common.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("b")).first()
    if size.n == 0 or size.n > LEXICON_WORDS or size.b > LEXICON_BYTES:
        return None
    made = Lexicon(common.select("lang", "word", "n", F.xxhash64("lang", "word").alias("h")).toArrow(), total.agg(F.sum("n")).first()[0])
    return made if made.exact() else None


def own_windows(texts: DataFrame, known) -> DataFrame:
    """(last, before, n): longest phrases of states with places of their own, as numbers of the lexicon (a broadcast).

    last has the last word's number in its upper half and that of the one before it in its lower half; before
    has those of the two words before them, or 0.
    """

    def run(batches):
        release()
        for lang, shard in _shards(batches):
            ids = known.value.numbers(lang, shard)[shard.ids()]
            states = automaton(ids, np.ones(len(ids), bool))
            link = states["link"]
            below = np.bincount(link[link >= 0], states["count"][link >= 0], len(link))
            own = states["count"] - below.astype(np.int64)
            here = (own > 0) & (states["longest"] > 1)
            end, longest, own = states["end"][here], states["longest"][here], own[here]
            back = lambda j: np.where(j < longest, ids[end - j], 0).astype(np.int64)
            columns = [back(0) << 32 | back(1), back(2) << 32 | back(3), own]
            for part in range(0, len(end), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[part : part + 100_000]) for c in columns], ["last", "before", "n"])

    return texts.mapInArrow(run, "last long, before long, n long")


def suffix_counts(windows: DataFrame, heavy: int, least: int) -> DataFrame:
    """(last, before, a): ends of windows of two to four words, with their counts, if these are least or more.

    Windows that end with two heavy words are dealt by the word before them too, so no task has all of a
    frequent pair; counts of such pairs are added up from several tasks.
    """
    low = (1 << 32) - 1
    both = (F.shiftright("last", 32) <= heavy) & (F.col("last").bitwiseAND(F.lit(low)) <= heavy)
    dealt = windows.repartition("last", F.when(both, F.shiftright("before", 32)).otherwise(F.lit(0))).sortWithinPartitions("last", "before")

    def run(batches):
        # The end of each length that the rows so far end with, and its sum.
        held: dict[int, tuple[int, int, int]] = {}

        def rows(k, last, before, n):
            keep = n >= least
            if k == 2:
                keep |= (last >> 32 <= heavy) & (last & low <= heavy)
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (last, before, n)], ["last", "before", "a"])

        for batch in batches:
            last, before, n = (c.to_numpy() for c in batch.columns)
            for k, has, end in ((2, None, before * 0), (3, before > 0, before & ~low), (4, before & low > 0, before)):
                x, y, z = (last, end, n) if has is None else (last[has], end[has], n[has])
                if not len(x):
                    continue
                if k in held:
                    x, y, z = (np.concatenate([[v], c]) for v, c in zip(held[k], (x, y, z), strict=True))
                first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
                x, y, z = x[first], y[first], np.add.reduceat(z, first)
                held[k] = (x[-1], y[-1], z[-1])
                yield rows(k, x[:-1], y[:-1], z[:-1])
        for k, values in held.items():
            yield rows(k, *(np.array([v], np.int64) for v in values))

    return dealt.mapInArrow(run, "last long, before long, a long").groupBy("last", "before").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def spelled(counts: DataFrame, known) -> DataFrame:
    """(lang, phrase, words, a) of (last, before, a), by the lexicon (a broadcast)."""

    def run(batches):
        names = known.value
        for batch in batches:
            last, before = (batch.column(k).to_numpy() for k in range(2))
            found = [[int(w) for w in row if w] for row in np.stack([before & 0xFFFFFFFF, before >> 32, last & 0xFFFFFFFF, last >> 32], axis=1)]
            lang = [names.langs[names.lang[row[-1] - 1]] for row in found]
            text = [b" ".join(map(names.word, row)) for row in found]
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(text, pa.binary()), pa.array(list(map(len, found)), pa.int32()), batch.column(2)], ["lang", "phrase", "words", "a"])

    return counts.mapInArrow(run, "lang string, phrase binary, words int, a long").withColumn("phrase", F.col("phrase").cast("string"))


def frequent_phrases(texts: DataFrame, common: DataFrame, total: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, a): phrases of two words or more that are found `least` times, of the words common."""
    spark = texts.sparkSession
    if names := lexicon(common, total):
        known = spark.sparkContext.broadcast(names)
        return cut(spelled(suffix_counts(own_windows(texts, known), names.heavy, least), known), "phrases")
    frequent = spark.sparkContext.broadcast(bit_set(common.select(F.xxhash64("lang", "word").alias("h"))))
    pairs = cut(pair_counts(texts, frequent).where(F.col("n") >= least).select("h"), "word-pairs")
    linked = spark.sparkContext.broadcast(bit_set(pairs))
    drop_cut(pairs)
    return cut(phrase_counts(texts, frequent, linked).where(F.col("a") >= least), "phrases")


def _share(words: str, first: str, count: str) -> Column:
    return F.expr(f"array_join(slice({words}, {first}, {count}), ' ')")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, subsumed: int = SUBSUMED, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` candidates."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = cut(word_counts(texts), "words")
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    common = words.where(F.col("n") >= least)
    found = frequent_phrases(texts, common, total, least)

    # Parts of candidates are candidates or frequent words, so their counts are all here.
    parts = cut(found.select("lang", "phrase", F.col("a").alias("f")).union(common.select("lang", "word", "n")), "parts")
    each = found.select("lang", "phrase", "words", "a", F.split("phrase", " ").alias("w")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = each.select("lang", "phrase", "words", "a", "k", _share("w", "1", "k").alias("head"), _share("w", "k + 1", "words - k").alias("tail"))
    # Sizes of exploded rows are underestimated; the hint keeps them from being broadcast.
    head, tail = (parts.select("lang", F.col("phrase").alias(x), F.col("f").alias(y)).hint("merge") for x, y in (("head", "l"), ("tail", "r")))
    scored = cuts.join(head, ["lang", "head"]).join(tail, ["lang", "tail"])
    scored = scored.withColumn("score", F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div cast(cast(l as decimal(19,0)) + r as decimal(20,0))"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.a", "b.l", "b.r", "b.score")

    longer = found.where("words > 2").withColumn("w", F.split("phrase", " "))
    inside = longer.select("lang", "a", F.explode(F.array(_share("w", "2", "words - 1"), _share("w", "1", "words - 1"))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("most")).hint("merge")
    kept = best.join(inside, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * subsumed))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(total.withColumnRenamed("lang", "of"), F.col("lang") == F.col("of")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


ORACLE = {
    "op12_collocations": r"""
with pieces as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
split as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from pieces),
spans as (select lang, k, list_aggregate(w[i + 1 : i + k], 'string_agg', ' ') phrase from (select lang, w, k, unnest(range(0, len(w) - k + 1)) i from split, range(1, 5) ks(k) where len(w) >= k)),
f as (select lang, k, phrase, count(*) f from spans group by all having count(*) >= 30),
total as (select lang, sum(len(w)) n from split group by lang),
cand as (select lang, phrase, k, f a, string_split(phrase, ' ') w from f where k > 1),
cuts as (select c.*, unnest(range(1, c.k)) j from cand c),
scored as (select c.lang, c.phrase, c.k, c.a, j, p.f l, q.f r, (cast(2000000 as hugeint) * c.a) // (p.f + q.f) score
  from cuts c join f p on p.lang = c.lang and p.phrase = array_to_string(c.w[1 : j], ' ') join f q on q.lang = c.lang and q.phrase = array_to_string(c.w[j + 1 : c.k], ' ')),
best as (select * from (select *, row_number() over (partition by lang, phrase order by score, j) z from scored) where z = 1),
kept as (select b.* from best b where not exists (select 1 from cand g where g.lang = b.lang and g.k > b.k and contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' ') and 100 * cast(g.a as hugeint) >= 80 * cast(b.a as hugeint))),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from kept)
select lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) a, cast(l as bigint) l, cast(r as bigint) r, cast(n as bigint) n, cast(score as bigint) score from ranked join total using (lang) where rank <= 2000"""
}
QUERIES = {"op12_collocations": op12_collocations}
