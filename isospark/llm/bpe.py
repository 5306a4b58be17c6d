"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The merges are driven by a queue over merge ranks: a bitmap whose set bits are
the ranks that have candidates, with a second level that sums it up, so
find-first-set on either gives the lowest rank in two steps. Each rank's bucket
holds positions of a linked list of parts. Nothing is searched in the queue when
a merge makes an entry invalid: entries stay and are skipped when their bucket
comes up, as the rank noted at their position differs by then.

Pre-tokens are independent, so one queue serves all new pre-tokens of a batch
(their linked lists don't touch) and each bucket is merged as one NumPy step.
Within a pre-token the order stays that of the ranks, leftmost first: a bucket
is merged at once only if no pair with its token has a lower rank; otherwise one
position of each pre-token is merged and the others wait. A pre-token of n bytes
costs O(n log n) whatever its length.

Defined cases: a null text encodes to an empty list, an empty text too; null
ids decode to null, ids outside the vocabulary to no bytes. Bytes that aren't
UTF-8 (a string column may hold them) are encoded as bytes and decode to
themselves. Repeated rows are encoded each. Codec's operators are column
functions, so columns of any name pass; bpe_round_trip chooses its columns by
name.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .common import as_bytes, settle, table, worker_state

#: The ranges of Unicode White_Space, which \s stands for.
SPACE_RANGES = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
SPACES = "".join(f"{chr(a)}-{chr(b)}" for a, b in SPACE_RANGES)
#: Bytes of pre-tokens and their entries that a Python worker keeps before it starts afresh.
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 200
#: Characters of texts that are encoded together and leave the worker together, at least one text; this bounds its memory.
TOGETHER = 1_500_000
#: Positions that are looked up at a time before the first merge.
LOOKED_UP = 1 << 17


class RankQueue:
    """Arrays of positions by rank; pop() gives those of the lowest rank.

    Bit r % WIDTH of leaf r // WIDTH is set where rank r has a bucket, and bit l
    of the summary where leaf l is not zero.
    """

    WIDTH = 240

    def __init__(self, ranks: int):
        self.leaves = [0] * (ranks // self.WIDTH + 1)
        self.summary = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [positions]
            leaf = rank // self.WIDTH
            self.leaves[leaf] |= 1 << rank % self.WIDTH
            self.summary |= 1 << leaf
        else:
            bucket.append(positions)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if len(ranks) == 1:
            self.push(int(ranks[0]), positions)
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        edges = np.flatnonzero(np.diff(ranks)) + 1
        starts, ends = [0, *edges.tolist()], [*edges.tolist(), len(ranks)]
        for rank, a, b in zip(ranks[starts].tolist(), starts, ends, strict=True):
            self.push(rank, positions[a:b])

    def pop(self) -> tuple[int, list[np.ndarray]]:
        """The lowest rank with its arrays; the rank is -1 where nothing is left."""
        summary = self.summary
        if not summary:
            return -1, []
        leaf = (summary & -summary).bit_length() - 1
        word = self.leaves[leaf]
        low = word & -word
        rank = leaf * self.WIDTH + low.bit_length() - 1
        self.leaves[leaf] = word ^ low
        if word == low:
            self.summary = summary & (summary - 1)
        return rank, self.buckets.pop(rank)


#: Most texts keep to characters below this one; for them re splits with classes spelt out, about twice as fast.
NEAR = 0x180


def near_pattern(pattern: str) -> str | None:
    r"""The pattern for texts of characters below NEAR, its classes spelt out; None where it has others than \s, \S, \p{L}, \p{N}."""
    out, inside = [], False
    for token in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        if token in ("[", "]"):
            inside = token == "["
        if token.startswith("\\p{"):
            members = "".join(re.escape(c) for c in map(chr, range(NEAR)) if regex.match(token, c))
            token = members if inside else f"[{members}]"
        elif token == r"\s":
            token = SPACES if inside else f"[{SPACES}]"
        elif token == r"\S" and not inside:
            token = f"[^{SPACES}]"
        elif token.startswith("\\"):
            return None
        out.append(token)
    return "".join(out)


def splitter(pattern: str):
    r"""A function that lists a text's matches; \s and \S mean Unicode White_Space."""
    spelt = pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"\S", f"[^{SPACES}]").replace(r"\s", f"[{SPACES}]")
    anywhere, near = regex.compile(spelt).findall, near_pattern(pattern)
    if near is None:
        return anywhere
    near_only, beyond = re.compile(near).findall, re.compile(f"[^\0-{chr(NEAR - 1)}]").search
    return lambda text: anywhere(text) if beyond(text) else near_only(text)


class Merges:
    """Which two tokens side by side make which token, and the queue's loop."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values(), default=0) + 1
        keys, made = array("q"), array("i")
        for t, rank in ranks.items():
            for k in range(1, len(t)):
                if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None:
                    keys.append(a * self.size + b)
                    made.append(rank)
        keys, made = np.array(keys, np.int64), np.array(made, np.int32)
        order = np.lexsort((made, keys))
        keys, made = keys[order], made[order]
        self.keys, self.rank_of = np.append(keys, np.iinfo(np.int64).max), np.append(made, -1).astype(np.int32)
        lowest = np.full(self.size, np.iinfo(np.int32).max)
        for side in (keys // self.size, keys % self.size):
            np.minimum.at(lowest, side, made)
        self.at_once = (lowest > np.arange(self.size)).tolist()
        self.byte_rank = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.rank_of[at], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' tokens one after the other, and how many each has. Needs all single bytes in the vocabulary."""
        sizes = np.array([len(x) for x in pieces], np.int64)
        tokens = np.append(self.byte_rank[np.frombuffer(b"".join(pieces), np.uint8)], -1)
        n = len(tokens) - 1
        ends = np.cumsum(sizes)
        piece_of = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends[sizes > 0] - 1] = n  # place n stands for no part
        before[(ends - sizes)[sizes > 0]] = n
        alive, noted = np.ones(n, bool), np.full(n + 1, -1, np.int32)
        queue = RankQueue(self.size)

        def note(at: np.ndarray) -> None:
            to = after[at]
            found = np.where(to < n, self.look_up(tokens[at], tokens[to]), -1)
            noted[at] = found
            if len(hit := np.flatnonzero(found >= 0)):
                queue.push_all(found[hit], at[hit])

        for k in range(0, n, LOOKED_UP):
            note(np.arange(k, min(n, k + LOOKED_UP), dtype=np.int32))
        while True:
            rank, arrays = queue.pop()
            if rank < 0:
                break
            at = arrays[0] if len(arrays) == 1 else np.concatenate(arrays)
            at = at[noted[at] == rank]  # the others are stale
            if not len(at):
                continue
            if len(at) > 1:
                at = np.unique(at)
                if self.at_once[rank]:
                    touches = np.append(False, after[at[:-1]] == at[1:])
                    if touches.any():  # a run of one repeated part: every other position
                        index = np.arange(len(at))
                        at = at[(index - np.maximum.accumulate(np.where(touches, 0, index))) % 2 == 0]
                else:
                    first = np.append(True, np.diff(piece_of[at]) > 0)
                    if not first.all():
                        queue.push(rank, at[~first])
                        at = at[first]
            gone = after[at]
            end = after[gone]
            after[at], tokens[at], noted[gone], alive[gone] = end, rank, -1, False
            noted[at] = -1
            before[end] = at
            left = before[at]
            note(np.unique(np.concatenate([at, left[left < n]])))
        return tokens[:-1][alive], np.bincount(piece_of[alive], minlength=len(pieces))


class Encoder(dict):
    """Numbers pre-tokens; the numbers' tokens lie in flat arrays, kept for later batches."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.merges, self.split = Merges(ranks), splitter(pattern)
        self.known = [b""] * self.merges.size
        for token, rank in ranks.items():
            self.known[rank] = token
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.held = 0
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __missing__(self, piece: str) -> int:
        self.fresh.append(piece)
        self[piece] = number = len(self)
        return number

    def learn(self) -> None:
        """Finds the tokens of the pre-tokens numbered since the last call."""
        pieces, self.fresh = [to_bytes(x) for x in self.fresh], []
        self.held += sum(map(len, pieces)) + ENTRY_BYTES * len(pieces)
        whole = [self.merges.ranks.get(x) for x in pieces]
        rest = [k for k, x in enumerate(whole) if x is None]
        tokens, counts = self.merges.merge([pieces[k] for k in rest])
        sizes = np.ones(len(pieces), np.int64)
        sizes[rest] = counts
        flat = np.repeat(np.array([-1 if x is None else x for x in whole], np.int32), sizes)
        flat[flat < 0] = tokens
        self.flat = np.concatenate([self.flat, flat])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def encode_batch(self, texts: Iterator[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in two passes: number the pre-tokens, then look their tokens up."""
        numbered = [array("i", map(self.__getitem__, self.split(text))) for text in texts]
        if self.fresh:
            self.learn()
        for numbers in numbered:
            at = np.frombuffer(numbers, np.int32) if numbers else np.zeros(0, np.int32)
            starts = self.ends[at]
            sizes = self.ends[at + 1] - starts
            shift = np.cumsum(sizes) - sizes
            yield self.flat[np.repeat(starts - shift, sizes) + np.arange(int(sizes.sum()))]

    def encode_parts(self, texts: Iterable[str]) -> Iterator[list[np.ndarray]]:
        """The ids of each text, as lists for some texts at a time."""
        batch, size = [], 0
        for text in texts:
            batch.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield list(self.encode_batch(batch))
                batch, size = [], 0
                if self.held >= CACHE_BYTES:
                    self.forget()
        if batch:
            yield list(self.encode_batch(batch))

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        for part in self.encode_parts(texts):
            yield from part

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes one after the other; ids outside the vocabulary stand for none."""
        known = self.known
        inside = (ids >= 0) & (ids < len(known))
        return b"".join(map(known.__getitem__, (ids if inside.all() else ids[inside]).tolist()))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch([text])).tolist()


def to_text(raw: bytes | None) -> str:
    """Bytes that aren't UTF-8 become code points of their own, which to_bytes turns back."""
    return raw.decode("utf-8", "surrogateescape") if raw else ""


def to_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


def worker_encoder(ranks, pattern: str) -> Encoder:
    """The encoder of this Python worker, with the pre-tokens that it has met in earlier tasks."""
    return worker_state(("bpe", getattr(ranks, "_path", None) or id(ranks), pattern), lambda: Encoder(ranks.value, pattern))


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: base64 bytes and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Column functions over one vocabulary, read on the driver and broadcast.

    The broadcast holds the vocabulary file's entries alone (about a megabyte
    for 50,000 tokens); its size does not depend on the documents.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.ranks = spark.sparkContext.broadcast(read_ranks(path))
        self.pattern = pattern

    def encode(self, text: Column) -> Column:
        ranks, pattern = self.ranks, self.pattern

        @F.arrow_udf("array<int>")
        def bpe_encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder = worker_encoder(ranks, pattern)
            for batch in batches:
                yield id_lists(list(encoder.encode_all(map(to_text, as_bytes(batch)))))

        return bpe_encode.asNondeterministic()(text)

    def decode(self, ids: Column) -> Column:
        ranks, pattern = self.ranks, self.pattern

        @F.arrow_udf("binary")
        def bpe_decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder = worker_encoder(ranks, pattern)
            for batch in batches:
                decoded = []
                for k in range(0, len(batch), 256):
                    part = batch.slice(k, 256)
                    ids = part.flatten().fill_null(-1).to_numpy()
                    ends = np.cumsum([0, *(n or 0 for n in pc.list_value_length(part).to_pylist())])
                    decoded += [encoder.decode(ids[a:b]) if ok else None for a, b, ok in zip(ends, ends[1:], part.is_valid().to_pylist())]
                yield pa.array(decoded, pa.binary())

        return bpe_decode.asNondeterministic()(ids)


def id_lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def bpe_round_trip(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """id as doc_id, the columns named in also, ids array<int>, and decoded binary (what the ids decode to) of each row.

    Encoding and decoding are one step in one Python worker, and rows leave it
    as soon as their part of the batch is done.
    """
    ranks, pattern = codec.ranks, codec.pattern
    rows = docs.select(F.col(id_col).alias("doc_id"), *[F.col(f"`{c}`") for c in also], F.col(text_col).alias("text"))
    names = [*rows.columns[:-1], "ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(ranks, pattern)
        for batch in batches:
            at = 0
            for ids in encoder.encode_parts(map(to_text, as_bytes(batch.column(batch.num_columns - 1)))):
                kept = [batch.column(k).slice(at, len(ids)) for k in range(batch.num_columns - 1)]
                at += len(ids)
                yield pa.RecordBatch.from_arrays([*kept, id_lists(ids), pa.array(map(encoder.decode, ids), pa.binary())], names)
            settle()

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField("ids", ArrayType(IntegerType())), StructField("decoded", BinaryType())]))


def multi_50k(spark: SparkSession) -> Codec:
    import public_tokenizers

    return Codec(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_round_trip(table(spark, sf_dir, "documents"), multi_50k(spark))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op1_bpe": op1_bpe}
ORACLE = {}
