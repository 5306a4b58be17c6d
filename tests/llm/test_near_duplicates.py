import random

from pyspark.sql import functions as F

import corpus_pipeline
from isospark.llm import similarity, simhash

from . import brute


def shingles(text):
    words = brute.lower(text or "").split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def linked(a, b):
    return len(a & b) * 5 >= len(a | b) * 4


def texts():
    """Families of near copies about the threshold, exact copies, common lines, short and empty texts."""
    rng = random.Random(5)
    word = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    out, line = [], word(30)
    for size, copies, edits in ((100, 40, 3), (300, 30, 7), (60, 20, 2), (1000, 8, 20), (9, 6, 1)):
        base = word(size)
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randrange(edits + 1)):
                copy[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    out += [" ".join(line + word(rng.randrange(10, 60))) for _ in range(60)] + [" ".join(word(80)) for _ in range(40)]
    out += ["One two", "one  TWO", "one two three", "", " ", None, out[3], out[3].upper(), "a b c d e", "a b c d f"]
    rng.shuffle(out)
    return out


def test_one_of_each_group_of_similar_texts(spark, monkeypatch):
    monkeypatch.setattr(similarity, "ONE_OF", 2)
    rows = list(enumerate(texts()))
    sets = {k: shingles(t) for k, t in rows}
    label = brute.components(list(sets), lambda a, b: linked(sets[a], sets[b]))
    assert len(set(label.values())) < len(rows) - 40
    docs = spark.createDataFrame([*rows, (0, rows[0][1]), (None, "one two"), (None, "no other"), (None, "no  Other")], "doc_id long, text string").withColumn("k0", F.lit("clash"))
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([*set(label.values()), None], key=str)
    assert simhash.keep_one_each(docs.limit(0)).count() == 0


def test_an_id_with_two_texts(spark):
    """Only the text that represents its group stays, not every text of its id."""
    one, two = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    docs = spark.createDataFrame([(1, two), (3, one), (3, two), (3, one), (4, one)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one_each(docs).collect()) == [(1, two), (3, one)]


def test_pipeline_stage_drops_near_copies(spark):
    """A word in the middle of 100 changed: 91 of 101 shingles in common, 3 or more bits of the fingerprint apart."""
    base = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join([*base[:50], f"x{k}", *base[51:]])) for k in range(8)]
    prints = [brute.simhash(t) for _, t in rows]
    assert any((a ^ b).bit_count() > 2 for a in prints for b in prints)
    docs = spark.createDataFrame([*rows, (9, "another text of other words")], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {0, 9}


def template(n):
    """Texts of 104 words with three of their own at fixed places: 85 of 115 shingles in common, which isn't enough."""
    base = [f"w{k}" for k in range(104)]
    return [" ".join(f"own{i}x{k}" if k in (17, 50, 83) else w for k, w in enumerate(base)) for i in range(n)]


def met_pairs(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    last = spark.sparkContext.broadcast(similarity.frequent(docs, "text", 5))
    nodes = docs.select(F.col("doc_id").alias("rid"), similarity.features(F.col("text"), last, 5, 80).alias("r")).select("rid", "r.*")
    met = similarity.meetings(nodes, 80)
    return met.where("head").alias("a").join(met.alias("b"), "h").where("a.rid <> b.rid").count()


def test_texts_of_a_template_do_not_all_meet(spark, monkeypatch):
    """Pairs grow with the number of texts, not with its square, and nothing is dropped."""
    monkeypatch.setattr(similarity, "ONE_OF", 2)
    rows = list(enumerate(template(400)))
    small, large = met_pairs(spark, rows[:100]), met_pairs(spark, rows)
    assert large <= 4 * max(small, 100)
    docs = spark.createDataFrame([*rows, (1000, rows[7][1] + " more")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one_each(docs).collect()) == list(range(400))


def test_sets_of_different_sizes_meet(spark, monkeypatch):
    """Parts of a text from two thirds to all of it, and with words of their own: links equal a comparison of all pairs."""
    monkeypatch.setattr(similarity, "ONE_OF", 2)
    rng = random.Random(8)
    rows = []
    for f in range(4):
        base = [f"f{f}w{k}" for k in range(90)]
        for _ in range(30):
            a = rng.randrange(20)
            part = base[a : a + rng.randrange(60, 91)] + [f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(12))]
            rows.append((len(rows), " ".join(part)))
    sets = {k: shingles(t) for k, t in rows}
    label = brute.components(list(sets), lambda a, b: linked(sets[a], sets[b]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one_each(docs).collect()) == sorted(set(label.values()))
