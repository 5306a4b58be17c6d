import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from isospark.llm import lexical as L

from .brute import lower

DOCS, ITEMS = "doc_id long, text string, score string", "item_id long, text string, rank string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))


def brute(docs, items, k):
    counted = [(i, Counter(words(t))) for i, t, _ in docs if words(t)]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t, _ in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c in counted:
            m = 100 - 50 + 50 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def made(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "ß2", "THE", "the"]
    text = lambda m: "".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(64)])[0] + rng.choice([" ", "-", "\n", "\x7f"]) for _ in range(rng.randrange(m)))
    return [(i, text(80), "clash") for i in range(n)], [(i, text(12), "clash") for i in range(40)]


@pytest.mark.parametrize("postings, block, window", [(1 << 20, 128, 2048), (300, 4, 5), (2000, 16, 64)])
def test_ranked_equals_brute_force(spark, monkeypatch, postings, block, window):
    monkeypatch.setattr(L, "SEGMENT_POSTINGS", postings)
    monkeypatch.setattr(L, "BLOCK", block)
    monkeypatch.setattr(L, "WINDOW", window)
    monkeypatch.setattr(L, "QUERY_TERMS", 100)
    monkeypatch.setattr(L, "CHUNK", 11)
    docs, items = made(block, 250)
    docs += [(900, None, ""), (901, "", ""), (902, "--", ""), (None, docs[3][1], ""), (3, docs[3][1], ""), (903, "w1 " * 5000, ""), (904, "w2", "")]
    items += [(70, None, ""), (71, "...", ""), (72, "nowhere", ""), (5, "w7 w8", ""), (5, "w7 w8", "")]
    got = L.ranked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), 10)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, 10)


def test_empty_tables(spark):
    docs, items = made(0, 5)
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame(docs, DOCS)
    assert L.ranked(none, spark.createDataFrame(items, ITEMS)).count() == 0
    assert L.ranked(some, spark.createDataFrame([], ITEMS)).count() == 0
    assert L.ranked(spark.createDataFrame([(1, None, "")], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0


def segment(docs):
    builder = L.Builder()
    for i, t, _ in docs:
        builder.add(i, t.encode())
    row = {name.split()[0]: cell[0].as_py() for name, cell in zip(L.SEGMENT.split(", "), builder.row(0))}
    return row, builder


def test_blocks_decompress_to_their_postings():
    rng = random.Random(1)
    docs = [(i, " ".join(["common"] * rng.choice([1, 1, 2, 300, 70000 if i == 77 else 1]) + ["rare"] * (i % 500 == 0)), "") for i in range(2000)]
    row, _ = segment(docs)
    part = L.Segment(row | {"dfs": np.array(row["dfs"])}, {b"common": 3, b"rare": 5}, 2000, row["total"])
    for term in (b"common", b"rare"):
        _, w, low, high = part.lists[term]
        got = [x for b in range(low, high) for x in zip(*map(np.ndarray.tolist, part.decompressed(term, b)))]
        want = [(i, w * int(L.impact(np.array([n]), np.array([len(words(t))]), 2000, row["total"])[0])) for i, t, _ in docs if (n := words(t).count(term.decode()))]
        assert got == want
        # A block's bound is the highest value in it, no more.
        assert part.bound(term).tolist() == [int(part.decompressed(term, b)[1].max()) for b in range(low, high)]


def test_blocks_below_the_threshold_stay_compressed():
    docs = [(i, "the " * (1 + i % 3) + ("needle " * 3 if i in (640, 641) else ""), "") for i in range(4000)]
    row, _ = segment(docs)
    part = L.Segment(row | {"dfs": np.array(row["dfs"])}, {b"the": 1, b"needle": 7000}, 4000, row["total"])
    found, scores = part.search([b"the", b"needle"], 1_000_000, 2)
    assert sorted(found.tolist()) == [640, 641] and (scores > 1_000_000).all()
    assert len(part.open) <= 3 < len(part.blocks)
