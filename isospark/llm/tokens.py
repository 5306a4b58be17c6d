"""Token counts of documents in flat token files, by separator scan.

A token file is a stream of token ids with an end-of-document id after each
document and no index. It is read as blocks of bytes in order; within a block
all separators are found in one vectorised search. What a block alone can't know
is stitched by a prefix scan over the blocks' summaries (tokens, separators,
where the last separator stands): how many documents ended before the block, and
how many tokens of its first document lie in earlier blocks. A document may span
any number of blocks; tokens after the last separator are a last document.

A stream is a shard (one input partition), stored in the shared folder as rows
of (shard, block, data) that Spark reads from any store. Ids of documents are
kept apart in a manifest in the order of writing.

Defined cases: null and empty texts are documents of no tokens; repeated rows
are documents each; ids may be null. Input columns are chosen by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Codec, to_text, worker_encoder
from .common import as_bytes, cut, table

#: Tokens of a block; ids of a manifest row. Tokens are unsigned 16-bit integers where the vocabulary allows.
BLOCK_TOKENS, MANIFEST_IDS = 1 << 16, 4096


def token_kind(largest: int) -> np.dtype:
    return np.dtype("<u2" if largest < 1 << 16 else "<u4")


def write_token_files(docs: DataFrame, codec: Codec, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Streams (shard, block, data) and their manifest (shard, block, ids) in the shared folder."""
    ranks, pattern = codec.ranks, codec.pattern
    kind = token_kind(max(end_id, max(ranks.value.values())))

    def run(batches):
        encoder, shard = worker_encoder(ranks, pattern), TaskContext.get().partitionId()
        stream, names, n_block, n_names, size = bytearray(), [], 0, 0, block_tokens * kind.itemsize
        end = np.array([end_id], kind).tobytes()

        def row(number, data, ids):
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([number], pa.int64()), pa.array([data], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], ["shard", "block", "data", "ids"])

        for batch in batches:
            ids = iter(batch.column(0).to_pylist())
            for tokens in encoder.encode_all(map(to_text, as_bytes(batch.column(1)))):
                stream += tokens.astype(kind).tobytes() + end
                names.append(next(ids))
                while len(stream) >= size:
                    yield row(n_block, bytes(stream[:size]), None)
                    del stream[:size]
                    n_block += 1
                if len(names) >= MANIFEST_IDS:
                    yield row(n_names, None, names)
                    names, n_names = [], n_names + 1
        if stream:
            yield row(n_block, bytes(stream), None)
        if names:
            yield row(n_names, None, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "shard long, block long, data binary, ids array<long>")
    files = cut(rows, "tokens")
    return files.where("data is not null").select("shard", "block", "data"), files.where("ids is not null").select("shard", "block", "ids")


def scan_token_files(blocks: DataFrame, end_id: int, largest: int) -> DataFrame:
    """(shard, ordinal, n_tokens) of every document in streams (shard, block, data)."""
    kind = token_kind(max(largest, end_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ends, inner, head, last = [], [], [], [], []
            for data in batch.column(2):
                tokens = np.frombuffer(data.as_buffer(), kind)
                at = np.flatnonzero(tokens == end_id)
                n.append(len(tokens))
                ends.append(len(at))
                head.append(int(at[0]) if len(at) else len(tokens))
                last.append(int(at[-1]) + 1 if len(at) else 0)
                inner.append((np.diff(at) - 1).astype(np.int64))
            names = ["shard", "block", "n", "ends", "head", "last", "inner"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n, ends, head, last)), pa.array(inner, pa.list_(pa.int64()))], names)

    found = blocks.select("shard", "block", "data").mapInArrow(run, "shard long, block long, n long, ends long, head long, last long, inner array<long>")
    # The prefix scan: summaries of earlier blocks of the shard, one small row a block.
    order = Window.partitionBy("shard").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    scanned = found.withColumn("start", start).withColumn("done", F.coalesce(F.sum("ends").over(earlier), F.lit(0)))
    scanned = scanned.withColumn("open", F.coalesce(F.max(F.when(F.col("ends") > 0, F.col("start") + F.col("last"))).over(earlier), F.lit(0)))
    final = F.lead("block").over(order).isNull()
    rest = F.col("start") + F.col("n") - F.when(F.col("ends") > 0, F.col("start") + F.col("last")).otherwise(F.col("open"))
    closed = F.when(F.col("ends") > 0, F.concat(F.array(F.col("start") + F.col("head") - F.col("open")), F.col("inner"))).otherwise(F.array().cast("array<long>"))
    sizes = F.concat(closed, F.when(final & (rest > 0), F.array(rest)).otherwise(F.array().cast("array<long>")))
    return scanned.select("shard", "done", sizes.alias("sizes")).select("shard", "done", F.posexplode("sizes").alias("k", "n_tokens")).select("shard", (F.col("done") + F.col("k")).alias("ordinal"), "n_tokens")


def count_tokens(docs: DataFrame, codec: Codec, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, shard, ordinal, n_tokens of each row, counted in the token files written from docs."""
    blocks, manifest = write_token_files(docs, codec, end_id, id_col, text_col)
    sizes = scan_token_files(blocks, end_id, max(codec.ranks.value.values()))
    names = manifest.select("shard", F.posexplode("ids").alias("k", "doc_id"), "block").select("shard", (F.col("block") * MANIFEST_IDS + F.col("k")).alias("ordinal"), "doc_id")
    # Sizes of exploded rows are underestimated; the hint keeps them from being broadcast.
    return names.join(sizes.hint("merge"), ["shard", "ordinal"]).select("doc_id", "shard", "ordinal", "n_tokens")


#: Of the vocabulary byte_bpe_50k; its number is free there.
END_OF_DOCUMENT = 50256


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    codec = Codec(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return count_tokens(table(spark, sf_dir, "documents"), codec, END_OF_DOCUMENT).select("doc_id", "n_tokens")


QUERIES, ORACLE = {"op6_token_counts": op6_token_counts}, {}
