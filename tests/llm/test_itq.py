import numpy as np
import pytest

from isospark.llm import itq

from .brute import components

SCHEMA = "vec_id long, embedding array<float>, n_links string"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def beside(x, cosine, rng):
    side = rng.normal(size=x.shape)
    side = unit(side - (side * x).sum(-1, keepdims=True) * x)
    return cosine * x + np.sqrt(1 - cosine**2) * side


def brute(ids, m):
    u = unit(m.astype(float))
    near = u @ u.T >= 0.95
    label = components(list(range(len(ids))), lambda a, b: near[a, b])
    least = {}
    for n, c in label.items():
        least[c] = min(least.get(c, ids[n]), ids[n])
    return sorted((i, int(near[k].sum()) - 1, least[label[k]], i == least[label[k]]) for k, i in enumerate(ids))


@pytest.mark.parametrize("part", [2048, 8])
def test_links_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(itq, "PART", part)
    monkeypatch.setattr(itq, "PROBES", 5)
    rng = np.random.default_rng(part)
    base = unit(rng.normal(size=(120, 32)))
    hub = unit(rng.normal(size=32))
    family = np.stack([beside(hub, c, rng) for c in rng.uniform(0.97, 1, 60)])
    pairs = beside(base[:40], 0.96, rng)
    m = np.concatenate([base, pairs, family, np.repeat(family[:1], 15, axis=0)]) * rng.uniform(0.1, 30, (235, 1))
    m[-15:] = m[160]
    m = m.astype(np.float32)
    ids = [int(i) for i in rng.permutation(1000)[: len(m)]]
    bad = [(2000, None), (2001, [0.0] * 32), (2002, [1.0, None]), (2003, [float("nan")] * 32), (2004, [float("inf")] * 32), (2005, []), (None, m[0].tolist())]
    df = spark.createDataFrame([(i, v.tolist(), "") for i, v in zip(ids, m)] + [(i, v, "") for i, v in bad], SCHEMA)
    got = [tuple(r) for r in itq.near_duplicates(df).collect()]
    assert sorted(r for r in got if r[0] is not None and r[0] < 2000) == brute(ids, m)
    assert {r for r in got if r[0] is None or r[0] >= 2000} == {(i, 0, i, True) for i, _ in bad}


def test_empty_and_single(spark):
    assert itq.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in itq.near_duplicates(spark.createDataFrame([(7, None, "")], SCHEMA)).collect()] == [(7, 0, 7, True)]
    assert [tuple(r) for r in itq.near_duplicates(spark.createDataFrame([(7, [1.0, 2.0], "")], SCHEMA)).collect()] == [(7, 0, 7, True)]
    repeated = spark.createDataFrame([(7, [1.0, 2.0], ""), (7, [1.0, 2.0], ""), (9, [2.0, 4.0, 0.0], "")], SCHEMA)
    assert sorted(tuple(r) for r in itq.near_duplicates(repeated).collect()) == [(7, 2, 7, True), (7, 2, 7, True), (9, 2, 7, False)]


@pytest.mark.parametrize("length", [8, 12])
def test_pairs_at_the_threshold_meet(length):
    """Held-out pairs at exactly the threshold, of data with a mean far from zero."""
    rng = np.random.default_rng(5)
    cloud = lambda n: unit(rng.normal(size=(n, 64)) * np.linspace(2, 0.5, 64) + 0.3)
    coder = itq.Coder(cloud(3000), length, 0.95)
    x = cloud(4000)
    y = beside(x, 0.95, rng)
    a, b = coder.bits(x), coder.bits(y)
    met = (coder.strings(a) == coder.strings(b)).any(axis=1) & ((a != b).sum(axis=1) <= coder.radius)
    assert met.mean() >= 0.995
    # Codes are balanced: about half of the vectors have each bit.
    assert abs(a.mean(axis=0) - 0.5).max() < 0.2
    words = coder.words(a)
    assert (np.array([bin(int(v)).count("1") for v in (words[0] ^ words[1]).view(np.uint64)]).sum()) == (a[0] != a[1]).sum()


def test_rotations_lose_less_than_random_ones():
    rng = np.random.default_rng(2)
    x = unit(rng.normal(size=(2000, 16)) * np.linspace(3, 0.2, 16))
    loss = lambda t: np.linalg.norm(np.where(x @ t > 0, 1, -1) - x @ t)
    turn = itq.rotation(x, 1)
    assert np.allclose(turn @ turn.T, np.eye(16))
    assert loss(turn) < loss(np.linalg.qr(rng.normal(size=(16, 16)))[0])
