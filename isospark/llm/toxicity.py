"""Toxicity by cumulative-link ordinal regression.

The model gives every text a position s = w.x from sparse features and shares w
across ordered thresholds: P(grade > j) = logistic(s - t_j), t_0 < t_1 < ... The
output is the expected grade (the sum of those chances) and P(grade > 0).

Features are the words of a text and the beginnings of words (STEMS characters),
so that inflected words speak through their stems. A feature's value is
log(1 + 100 c / (n + 20)), c its number in a text of n words: what counts is how
densely a text holds it, since long clean texts hold any stem by chance.

Training takes a bounded sample of labelled rows, SAMPLE of each class, chosen
by hash of the id over all labels and weighted to the classes' true sizes. Spark
counts in how many sampled texts each feature is dense (once in DENSE words or
more). Features whose likelihood ratio between the classes is LEVEL nats or more
are kept, whatever their number and whichever class they speak for; weights may
have either sign, and a penalty on their squares keeps them small. The kept
features and the sampled rows' counts of them reach the driver; both are bounded
by the sample. Scoring reads every text whole, in batches, with nothing shuffled.

Grades: labels above 1 are grades by themselves. Where labels are 0 and 1 only,
rows labelled 1 are graded by terciles of a position that a two-class model
gives them which was fitted without them (two halves by hash of the text, so
copies stay together, each judged by the other half's model).

Defined cases: null or wordless texts have no features and get the score of
those. Without labels of both classes, or without a telling feature, all scores
are near zero and nothing is toxic. Null labels and ids are left out of
training, labels below zero count as zero; with several labels for an id the
highest counts. Input columns are chosen by name, others are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, cut, release, table
from .decontam import words_of

#: Labelled rows of each class that training takes at most.
SAMPLE = 3000
#: Characters of the beginnings of words; words per occurrence of a dense feature; nats that a feature must tell.
STEMS, DENSE, LEVEL = (3, 4, 5, 6, 7, 8), 200, 8.0
#: Grades made of 0/1 labels, and the chance of toxicity that rejects a text.
GRADES, REJECT = 4, 0.5
PENALTY, STEPS = 1e-4, 500
#: Different words whose features a worker remembers, none longer than so many bytes.
REMEMBERED, SHORT = 100_000, 64


def features_of(word: bytes) -> list[str]:
    """The word itself, marked by a blank, and its beginnings."""
    text = word.decode("utf-8", "replace")
    return [text + " ", *(text[:k] for k in STEMS if len(text) > k)]


def value(count: float, n_words: int) -> float:
    return log1p(100 * count / (n_words + 20))


class Places(dict):
    """For each word, the places of its features among the known ones."""

    def __init__(self, known: dict[str, int]):
        super().__init__()
        self.known = known

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = tuple(self.known[f] for f in features_of(word) if f in self.known)
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found

    def counts(self, words: list[bytes]) -> dict[int, int]:
        """How often each known feature stands in words."""
        out: dict[int, int] = {}
        for word, n in Counter(words).items():
            for k in self[word]:
                out[k] = out.get(k, 0) + n
        return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def scorer(self):
        """A function of a text that gives its position."""
        places, w = Places({f: k for k, f in enumerate(self.weights)}), list(self.weights.values())

        def position(text: bytes | None) -> float:
            words = words_of(text) if text else []
            return sum(w[k] * value(c, len(words)) for k, c in sorted(places.counts(words).items()))

        return position

    def chances(self, s: np.ndarray) -> np.ndarray:
        """P(grade > j) for each text and threshold."""
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds) - s[:, None], -500, 500)))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds by gradient descent (Adam) on the weighted likelihood."""
    levels = int(grade.max())
    weight = weight / weight.sum()
    above = np.array([weight[grade > j].sum() for j in range(levels)]).clip(1e-6, 1 - 1e-6)
    first = np.log((1 - above) / above)
    p = np.concatenate([np.zeros(x.shape[1]), first[:1], np.log(np.diff(first).clip(1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for step in range(1, steps + 1):
        w, gaps = p[: x.shape[1]], np.exp(p[x.shape[1] + 1 :])
        t = p[x.shape[1]] + np.concatenate([[0], np.cumsum(gaps)])
        s = x @ w
        up = np.where(grade > 0, logistic(s - t[np.maximum(grade - 1, 0)]), 1.0)
        down = np.where(grade < levels, logistic(s - t[np.minimum(grade, levels - 1)]), 0.0)
        chance = np.maximum(up - down, 1e-12)
        d_up, d_down = weight * up * (1 - up) / chance, weight * down * (1 - down) / chance
        d_t = np.bincount(np.maximum(grade - 1, 0), d_up, levels) - np.bincount(np.minimum(grade, levels - 1), d_down, levels)
        tail = np.cumsum(d_t[::-1])[::-1]
        g = np.concatenate([-x.T @ (d_up - d_down) + penalty * w, tail[:1], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    gaps = np.exp(p[x.shape[1] + 1 :])
    return p[: x.shape[1]], p[x.shape[1]] + np.concatenate([[0], np.cumsum(gaps)])


def grades_of(x: np.ndarray, label: np.ndarray, half: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Grades from labels: as they are above 1, else terciles of positions given by the other half's model."""
    levels, grade = np.unique(label, return_inverse=True)
    if len(levels) > 2:
        return grade
    s = np.full(len(label), np.nan)
    for side in (0, 1):
        fit, judged = half != side, (half == side) & (label > 0)
        if len(np.unique(label[fit])) == 2:
            s[judged] = x[judged] @ fit_ordinal(x[fit], (label[fit] > 0).astype(int), weight[fit])[0]
        if (some := s[judged & ~np.isnan(s)]).size:
            edges = np.quantile(some, [k / (GRADES - 1) for k in range(1, GRADES - 1)])
            s[judged] = np.searchsorted(edges, s[judged], side="right")
    graded = np.where(label > 0, 1 + np.nan_to_num(s), 0).astype(int)
    return np.unique(graded, return_inverse=True)[1]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from texts and labels by id: 0, 1 or grades."""
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.greatest(F.col(label_col).cast("long"), F.lit(0))).alias("label"))
    known = known.withColumn("y", (F.col("label") > 0).cast("int"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    none = Model({}, tuple(50.0 + j for j in range(GRADES - 1)))
    if len(sizes) < 2:
        return none
    chosen = [r for y in sizes for r in known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
    chosen = spark.createDataFrame(chosen, known.schema)
    texts = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id"), "labelled")
    total = {r.y: r.n for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return none

    def dense(batches):
        release()
        for batch in batches:
            for raw, y in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words, count = words_of(raw) if raw else [], Counter()
                for word, n in Counter(words).items():
                    for f in features_of(word):
                        count[f] += n
                here = [f for f, n in count.items() if n * DENSE >= len(words)]
                yield pa.RecordBatch.from_arrays([pa.array(here, pa.string()), pa.array([y] * len(here), pa.int64())], ["feature", "y"])

    held = texts.select("text", "y").mapInArrow(dense, "feature string, y long").groupBy("feature").agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b"))
    of = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    share, n = total[1] / (total[0] + total[1]), F.col("a") + F.col("b")
    absent = sum(total.values()) - n
    ratio = of(F.col("a"), n * share) + of(F.col("b"), n * (1 - share)) + of(total[1] - F.col("a"), absent * share) + of(total[0] - F.col("b"), absent * (1 - share))
    vocabulary = sorted(r.feature for r in held.where(ratio >= LEVEL).select("feature").collect())
    if not vocabulary:
        return none
    place = {f: k for k, f in enumerate(vocabulary)}

    def counts(batches):
        release()
        places = Places(place)
        for batch in batches:
            rows = []
            for raw, label in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words = words_of(raw) if raw else []
                c = places.counts(words)
                rows.append({"label": label, "body": xxhash.xxh64_intdigest(raw or b"") >> 1, "at": list(c), "x": [value(v, len(words)) for v in c.values()]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("label", pa.int64()), ("body", pa.int64()), ("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float64()))]))

    rows = texts.select("text", "label").mapInArrow(counts, "label long, body long, at array<int>, x array<double>").collect()
    rows.sort(key=lambda r: (r.label, r.body))
    x, label = np.zeros((len(rows), len(vocabulary))), np.array([r.label for r in rows])
    for k, r in enumerate(rows):
        x[k, r["at"]] = r.x
    weight = np.where(label > 0, sizes[1] / total[1], sizes[0] / total[0])
    grade = grades_of(x, label, np.array([r.body % 2 for r in rows]), weight)
    w, thresholds = fit_ordinal(x, grade, weight)
    return Model(dict(zip(vocabulary, w.tolist(), strict=True)), tuple(thresholds.tolist()))


def score(text: Column, model: Model) -> Column:
    """struct<severity: expected grade, chance: P(grade > 0)>."""

    @F.arrow_udf("struct<severity:double,chance:double>")
    def severity_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        position = model.scorer()
        for batch in batches:
            p = model.chances(np.fromiter(map(position, as_bytes(batch)), float, len(batch)))
            yield pa.StructArray.from_arrays([pa.array(p.sum(axis=1)), pa.array(p[:, 0])], ["severity", "chance"])

    return severity_of.asNondeterministic()(text)


def grade_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, severity, chance and toxic of each row."""
    scored = docs.select(F.col(id_col).alias("doc_id"), score(F.col(text_col), model).alias("r"))
    return scored.select("doc_id", "r.severity", "r.chance", (F.col("r.chance") >= REJECT).alias("toxic"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that are not toxic, with their own columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, score(F.col(text_col), model).alias("r")).where(F.col("r.chance") < REJECT).select("row.*")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return grade_texts(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES, ORACLE = {"op5_toxicity": op5_toxicity}, {}
