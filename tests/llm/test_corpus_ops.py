import hashlib
import math
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from isospark.llm import bpe, repeats, tokens, topk, toxicity
from isospark.llm.common import cut
from isospark.llm.decontam import words_of

from . import brute
from .test_text_ops import EDGE, docs  # noqa: F401


def brute_top(rows, k):
    ints = {i: np.floor(1024 * np.array(v, dtype=float)).astype(np.int64) for i, v in rows}
    dim = max(map(len, ints.values()))
    ints = {i: np.pad(v, (0, dim - len(v))) for i, v in ints.items()}
    out = set()
    for q in ints:
        if q % 100 == 0:
            best = sorted(((-int(ints[q] @ v), i) for i, v in ints.items() if i != q))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "HEAD", 30)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 5]) * np.array([4, 2, 1, 1, 0.5, 0.1, 0.1, 0])).astype(np.float32).tolist()) for i in range(350)]
    rows += [(i, [0.5] * 8) for i in range(400, 460)] + [(500, [1.0, 2.0]), (501, [])]  # ties, shorter and empty vectors
    bad = [(600, None), (601, [1.0, None]), (602, [float("nan")] * 8), (603, [float("inf")] * 8), (None, [1.0] * 8), (5, rows[5][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = {tuple(r) for r in topk.top_k(df, F.col("id") % 100 == 0).collect()}
    assert got == brute_top(rows, 10)
    few = df.where("vec_id in (0, 1, 2)")
    assert {tuple(r) for r in topk.top_k(few, F.col("id") % 100 == 0).collect()} == brute_top(rows[:3], 10)
    assert topk.top_k(df.limit(0), F.col("id") % 100 == 0).count() == 0
    large = np.array([[1 << 40, 3]]), np.array([[1 << 40, 5], [1, 1]])
    assert topk.exact(*large).tolist() == [[(1 << 63) - 1, (1 << 40) + 3]]


def test_far_blocks_are_not_joined(spark):
    blocks = spark.createDataFrame([(0, 1000.0), (1, 90.0), (2, 89.0), (3, 0.0)], "block long, longest double")
    asked = spark.createDataFrame([(10, 89.5), (11, -1.0), (12, 2000.0), (13, float("inf"))], "q_block long, q_least double")
    got = {tuple(r) for r in topk.near_blocks(blocks, asked).collect()}
    assert got == {(0, 10), (1, 10), (0, 11), (1, 11), (2, 11), (3, 11)}
    assert topk.near_blocks(blocks.limit(0), asked).count() == 0


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    s = x @ [2.0, -1.0, 0.0] + rng.logistic(size=2000)
    grade = (s > 0).astype(int) + (s > 1.5) + (s > 3)
    w, t = toxicity.fit_ordinal(x, grade, np.ones(2000))
    assert w == pytest.approx([2, -1, 0], abs=0.3) and list(t) == sorted(t) and t == pytest.approx([0, 1.5, 3], abs=0.4)
    p = toxicity.Model({}, tuple(t)).chances(np.linspace(-50, 50, 9))
    assert (np.diff(p, axis=1) <= 0).all() and (np.diff(p.sum(axis=1)) >= 0).all()


def toxic_corpus(spark, n=600):
    rng = random.Random(2)
    fill, bad = [f"w{k}" for k in range(300)], ["idiot", "scum", "moron", "clown"]
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(fill) for _ in range(rng.randrange(20, 200))]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(max(2, len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(bad).upper()
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), labels


def test_toxicity_on_held_out_rows(spark):
    corpus, labels = toxic_corpus(spark)
    some = [x for x in labels if x[0] < 400] + [(None, 1), (3, None), (1, 0)]
    model = toxicity.train(corpus, spark.createDataFrame(some, "doc_id long, toxic int"))
    held = {r.doc_id: r for r in toxicity.grade_texts(corpus, model).collect()}
    wrong = [k for k, y in labels if k >= 400 and held[k].toxic != bool(y)]
    assert len(wrong) <= 2
    assert all(0 <= r.severity <= toxicity.GRADES - 1 and r.chance <= r.severity + 1e-9 for r in held.values())
    assert toxicity.drop_toxic(corpus, model).columns == corpus.columns


def test_toxicity_edges(spark, docs):  # noqa: F811
    none = toxicity.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    rows = toxicity.grade_texts(docs, none).collect()
    assert len(rows) == docs.count() and not any(r.toxic for r in rows)
    assert toxicity.grade_texts(docs.limit(0), none).count() == 0


def plain_position(model, text):
    """Every feature counted by itself: a word with a blank behind it, else a beginning of longer words."""
    words, s = brute.words_of(text), 0.0
    for f, w in model.weights.items():
        c = sum(x + " " == f for x in words) + sum(len(x) > len(f) and len(f) in toxicity.STEMS and x.startswith(f) for x in words)
        s += w * math.log(1 + 100 * c / (len(words) + 20))
    return s


def test_toxicity_of_inflected_words(spark, docs, tmp_path):  # noqa: F811
    """Toxic words of two languages never look alike twice; scores are those of the plain version."""
    rng = random.Random(9)
    ends = ["".join(rng.choice("aeoutn") for _ in range(k % 5 + 1)) for k in range(3000)]
    fill = [["fr" + rng.choice(ends) for _ in range(400)], ["de" + rng.choice(ends) for _ in range(400)]]
    rows, labels = [], []
    for k in range(800):
        lang, toxic = k % 2, k % 8 < 2
        words = [rng.choice(fill[lang]) for _ in range(rng.randrange(30, 300))]
        for _ in range(len(words) // 25 if toxic else 0):
            words[rng.randrange(len(words))] = ("Réeux" if lang == 0 else "Achlich") + rng.choice(ends)
        if not toxic and k % 9 == 0 and len(words) > 250:
            words[3] = ("réeux" if lang == 0 else "achlich") + rng.choice(ends)
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    spark.createDataFrame(rows, "doc_id long, text string").union(docs.where("doc_id is not null").select(F.col("doc_id") + 10000, "text")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([x for x in labels if x[0] < 500], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in toxicity.op5_toxicity(spark, str(tmp_path)).collect()}
    wrong = [k for k, y in labels if k >= 500 and got[k].toxic != bool(y)]
    assert len(wrong) <= 3
    corpus, known = (spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("documents", "labels"))
    model = toxicity.train(corpus, known)
    for r in corpus.where("doc_id % 40 = 0 or doc_id >= 10000").collect():
        if r.doc_id != 10003:  # an id with two texts
            p = [1 / (1 + math.exp(t - plain_position(model, r.text))) for t in model.thresholds]
            assert got[r.doc_id].severity == pytest.approx(sum(p), abs=1e-6) and got[r.doc_id].chance == pytest.approx(p[0], abs=1e-6)


def test_labels_that_are_grades(spark):
    corpus, labels = toxic_corpus(spark, 300)
    graded = [(k, y * (1 + k % 3)) for k, y in labels]
    model = toxicity.train(corpus, spark.createDataFrame(graded, "doc_id long, toxic int"))
    assert len(model.thresholds) == 3 and list(model.thresholds) == sorted(model.thresholds)


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_token_files(spark, docs, block, monkeypatch):  # noqa: F811
    monkeypatch.setattr(tokens, "MANIFEST_IDS", 4)
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    small = docs.where("text is null or length(text) < 200") if block == 1 else docs
    texts = sorted(len(library.encode_ordinary(r.text or "")) for r in small.collect())
    blocks, manifest = tokens.write_token_files(small, codec, 50256, block_tokens=block)
    sizes = tokens.scan_token_files(blocks, 50256, 50255)
    assert sorted(r.n_tokens for r in sizes.collect()) == texts
    assert sum(len(r.ids) for r in manifest.collect()) == len(texts)


def test_token_counts_by_document(spark, docs):  # noqa: F811
    codec = bpe.Codec(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = sorted(((r.doc_id, r.n_tokens) for r in tokens.count_tokens(docs, codec, 50256).collect()), key=str)
    assert got == sorted(((r.doc_id, len(library.encode_ordinary(r.text or ""))) for r in docs.collect()), key=str)
    assert tokens.count_tokens(docs.limit(0), codec, 50256).count() == 0


def test_stream_without_a_last_separator(spark):
    data = np.array([5, 6, 9, 7, 9, 9, 1, 2], "<u2")
    rows = [(0, k, data[2 * k : 2 * k + 2].tobytes()) for k in range(4)] + [(1, 0, np.array([9], "<u2").tobytes())]
    out = tokens.scan_token_files(spark.createDataFrame(rows, "shard long, block long, data binary"), 9, 8).orderBy("shard", "ordinal").collect()
    assert [(r.shard, r.ordinal, r.n_tokens) for r in out] == [(0, 0, 2), (0, 1, 1), (0, 2, 0), (0, 3, 2), (1, 0, 0)]


def brute_repeats(rows, length=repeats.LENGTH):
    texts = {k: words_of(t.encode()) for k, t in rows}
    held = {}
    for w in texts.values():
        for a in range(len(w) - length + 1):
            held.setdefault(tuple(w[a : a + length]), set()).add(tuple(w))
    out = {}
    for k, w in texts.items():
        cover = set()
        for a in range(len(w) - length + 1):
            if len(held[tuple(w[a : a + length])]) > 1:
                cover |= set(range(a, a + length))
        if len(w) >= length and sum(v == w for v in texts.values()) > 1:
            cover = set(range(len(w)))
        if cover:
            out[k] = cover
    return out


def test_repeats(spark, docs):  # noqa: F811
    rng = random.Random(3)
    word = lambda n: [f"w{rng.randrange(40 if n % 2 else 4000)}" for _ in range(n)]
    rows, shared = [], [word(n) for n in (49, 50, 51, 75, 130)]
    for k in range(60):
        parts = word(rng.randrange(5, 160))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(parts))
            parts[at:at] = rng.choice(shared)
        rows.append((k, " ".join(parts)))
    base = word(300)
    for k in range(100, 130):  # near copies, each with other words changed
        copy = list(base)
        for _ in range(k % 7):
            copy[rng.randrange(300)] = f"x{k}"
        rows.append((k, " ".join(copy)))
    rows += [(200, "same " * 500), (201, "same " * 400), (202, "Rep, " * 60), (203, "rep " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in repeats.find_repeats(df).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        assert r.other_doc_id != r.doc_id
    assert got == brute_repeats(rows)
    repeats.find_repeats(docs).collect()
    assert repeats.find_repeats(df.limit(0)).count() == 0


def test_repeats_whose_parts_meet_in_different_texts(spark, tmp_path, monkeypatch):
    """Around one core, texts share some words to the left with some and some to the right with others."""
    rng = random.Random(5)
    core, lefts, rights = [f"c{k}" for k in range(24)], [[f"l{n}x{k}" for k in range(45)] for n in range(3)], [[f"r{n}x{k}" for k in range(45)] for n in range(3)]
    rows = []
    for k in range(90):
        a, b = rng.randrange(1, 45), rng.randrange(1, 45)
        parts = [f"a{k}"] + rng.choice(lefts)[45 - a :] + core + rng.choice(rights)[:b] + [f"z{k}"]
        rows.append((k, " ".join(parts * rng.choice((1, 1, 2)))))
    asked = []
    monkeypatch.setattr(repeats, "cut", lambda df, label: asked.append((label, out := cut(df, label))) or out)
    got = {}
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in repeats.op4_repeats(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert got == brute_repeats(rows)
    assert dict(asked)["windows"].where("open").count() > 0


def test_common_words():
    words = [b"a", b"b", b"c"]
    assert [repeats.common(words, x) for x in ([], [b"x"], [b"a", b"c", b"c"], words, words + [b"d"])] == [0, 0, 1, 3, 3]
    assert [repeats.window_bits(left, right) for left, right in ((0, 49), (0, 50), (29, 21), (40, 50), (3, 48))] == [0, 1, 1 << 29, (1 << 30) - 1, 0b1100]


def test_pipeline_stages(spark, tmp_path):
    """Each stage against its plain version, on what the one before kept."""
    corpus, labels = toxic_corpus(spark, 240)
    long = " ".join(f"bench{k}" for k in range(40))
    extra = [(1000, "clean words write to a.b@example.org or 4845168114407329 now"), (1001, "clean words write to a.b@example.org or 4845168114407329 now"), (1002, "some text " + long), (1003, None), (1004, "")]
    columns = corpus.union(spark.createDataFrame(extra, corpus.schema)).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    columns.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, long)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf, now = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = now
        out = str(tmp_path / f"stage{n}")
        stage(spark, now, sf).write.parquet(out)
        now = spark.read.parquet(out)
        if n < 4:
            assert now.columns == columns.columns
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
        if name == "near_duplicates":
            prints = {r.doc_id: brute.simhash(r.text) for r in before.collect()}
            label = brute.components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
            assert kept[-1] == set(label.values())
    toxic = {k for k, y in labels if y}
    assert len(kept[0] & toxic) <= 1 and kept[0] >= {k for k, y in labels if not y} | {1000, 1001, 1002, 1003, 1004}
    assert kept[2] == kept[1] - {1002} and kept[3] == kept[2] == kept[4]
    masked = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "stage3")).collect()}
    assert masked[1000].text == "clean words write to [EMAIL] or [CARD] now" and masked[1000].n_chars == len(masked[1000].text)
    for r in now.collect():
        assert r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256((masked[r.doc_id].text or "").encode()).hexdigest()
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == kept[4]
