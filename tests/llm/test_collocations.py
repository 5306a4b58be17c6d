import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from isospark.llm import collocations as C

from .brute import lower

SCHEMA = "doc_id long, text string, lang string, phrase string"


def brute(rows, least, top):
    import re

    n, f = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    out = []
    by_lang = defaultdict(list)
    for (lang, p), a in cand.items():
        inside = any(g == lang and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in cand.items())
        if not inside:
            score, k, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            by_lang[lang].append((-score, -a, " ".join(p).encode(), left, right))
    for lang, found in by_lang.items():
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = "a b c d é ß E \x1c x-y ' 12".split(" ")
    make = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "! "]) for _ in range(rng.randrange(60)))
    return [(i, make(), rng.choice(["en", "en", "fr", None, "und"]), "clash") for i in range(n)]


@pytest.mark.parametrize("shard", [1 << 21, 50])
def test_mine_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(C, "SHARD_WORDS", shard)
    monkeypatch.setattr(C, "CHUNK", 7)
    rows = texts(shard, 120) + [(500, None, "en", ""), (501, "", None, ""), (502, " \n ", "fr", ""), (503, "Q r s t. " * 9, "en", ""), (503, "Q r s t. " * 9, "en", "")]
    got = sorted(tuple(r) for r in C.mine(spark.createDataFrame(rows, SCHEMA), least=6, top=40).collect())
    assert got == brute(rows, 6, 40)


@pytest.mark.parametrize("changed", [{"LEXICON_WORDS": 1}, {"HEAVY": 1}, {"HEAVY": 9}])
def test_other_ways_equal_brute_force(spark, monkeypatch, changed):
    for name, value in {"SHARD_WORDS": 300, **changed}.items():
        monkeypatch.setattr(C, name, value)
    rows = texts(5, 150)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted(tuple(r) for r in C.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), least=6, top=40).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows, 6, 40)


def test_rows_grow_with_the_words_alone(spark):
    """Words from a small vocabulary: with five times the text most pairs become frequent, which were rare."""
    rng = random.Random(8)
    made = [(i, " ".join(str(rng.randrange(60)) for _ in range(400)), "en", "") for i in range(100)]
    counts = []
    for n in (20, 100):
        seen = spark.createDataFrame(made[:n], SCHEMA).select("lang", "text").coalesce(1)
        words = C.word_counts(seen)
        names = C.lexicon(words.where("n >= 6"), words.groupBy("lang").agg({"n": "sum"}).toDF("lang", "n"))
        known = spark.sparkContext.broadcast(names)
        counts.append(C.own_windows(seen, known).count())
        assert counts[-1] <= 400 * n
        found = {tuple(r) for r in C.frequent_phrases(seen, words.where("n >= 6"), words.select("lang", "n"), 6).collect()}
        old = C.phrase_counts(seen, spark.sparkContext.broadcast(np.full(1 << 10, -1, np.int64).view(np.uint64)), spark.sparkContext.broadcast(np.full(1 << 10, -1, np.int64).view(np.uint64)))
        assert found == {tuple(r) for r in old.where("a >= 6").collect()}
    assert counts[1] <= 5.2 * counts[0]


def test_empty_tables(spark):
    assert C.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.mine(spark.createDataFrame([(1, None, None, None), (2, "one two", "en", "")], SCHEMA)).count() == 0


def online(pieces):
    """Counts and classes of all substrings: {substring: end positions}."""
    ends = defaultdict(set)
    for at, piece in pieces:
        for i in range(len(piece)):
            for k in range(1, 5):
                if i - k + 1 >= 0:
                    ends[tuple(piece[i - k + 1 : i + 1])].add(at + i)
    return ends


def test_states_are_end_position_classes():
    rng = np.random.default_rng(3)
    ids = np.concatenate([[0], *[np.append(rng.integers(1, 4, rng.integers(0, 12)), 0) for _ in range(30)]]).astype(np.int32)
    states = C.automaton(ids, np.ones(len(ids), bool))
    pieces, at = [], 0
    for k in range(len(ids) + 1):
        if k == len(ids) or ids[k] == 0:
            pieces.append((at, ids[at:k].tolist()))
            at = k + 1
    ends = online(pieces)
    classes = defaultdict(list)
    for phrase, places in ends.items():
        classes[frozenset(places)].append(phrase)
    want = {(max(map(len, p)), min(map(len, p)), len(places), max(p, key=len)) for places, p in classes.items()}
    got = {(int(n), int(s), int(c), tuple(ids[e - n + 1 : e + 1].tolist())) for e, n, s, c in zip(states["end"], states["longest"], states["shortest"], states["count"])}
    assert got == want
    for k, link in enumerate(states["link"]):
        # The link is the class of the longest suffix that ends at more places.
        phrase = tuple(ids[states["end"][k] - states["shortest"][k] + 2 : states["end"][k] + 1].tolist())
        if not phrase:
            assert link == -1
        else:
            assert states["longest"][link] == len(phrase) and states["count"][link] == len(ends[phrase]) > states["count"][k]


def test_filters_hold_nothing_back(spark):
    h = np.random.default_rng(0).integers(-(1 << 63), 1 << 63, 5000, dtype=np.int64)
    bits = C.Filter(C.bit_set(spark.createDataFrame([(int(x),) for x in h], "h long")))
    assert bits.passed(h.view(np.uint64)).all()
    assert bits.passed(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.int64).view(np.uint64)).mean() < 0.05
