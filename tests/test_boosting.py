"""Histogram boosting against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting, metrics, model
from tidemark.sources import binned


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 4))
    x[:, 3] = r.integers(0, 3, 600)
    z = 2 * (x[:, 0] > 0.3) - 1.5 * (x[:, 1] < -0.2) + x[:, 3] + r.normal(size=600) * 0.5
    data = [(int(i), *[None if r.random() < 0.15 else float(v) for v in x[i]], int(z[i] > 1.0), float(r.choice([1.0, 2.0, 5.0])), bool(i % 4 == 0)) for i in range(600)]
    return spark.createDataFrame(data, "event_id long, a double, b double, c double, d double, target int, sample_weight double, validation boolean").repartition(3)


FEATURES = ["a", "b", "c", "d"]


def test_bins(spark, rows):
    cuts = binned.cuts_of(rows, FEATURES, bins=16)
    got = binned.binned(rows, FEATURES, cuts, ["event_id"]).collect()
    plain = {r.event_id: r for r in rows.collect()}
    for r in got:
        want = [binned.MISSING if plain[r.event_id][f] is None else sum(c <= plain[r.event_id][f] for c in cuts[i]) for i, f in enumerate(FEATURES)]
        assert list(r.bins) == want
    share = np.bincount([r.bins[0] for r in got if r.bins[0] != binned.MISSING], minlength=16) / sum(r.bins[0] != binned.MISSING for r in got)
    assert len(cuts[0]) == 15 and share.max() < 0.09 and len(cuts[3]) <= 3
    odd = spark.createDataFrame([(math.inf, None, math.nan, "1"), (2.0, None, 1.0, "x")], "a double, b double, c double, d string")
    found = binned.cuts_of(odd, ["a", "b", "c"])
    assert [c.tolist() for c in found] == [[2.0], [], [1.0]]
    assert [list(r.bins) for r in binned.binned(odd, ["a", "b", "c", "d"], [*found, np.array([0.5])], []).collect()] == [[255, 255, 255, 1], [1, 255, 1, 255]]


def test_best_split_against_loops():
    r = np.random.default_rng(5)
    for _ in range(40):
        g, h = np.zeros(256), np.zeros(256)
        used = r.choice(255, 6, replace=False)
        g[used], h[used] = r.normal(size=6), r.random(6) * 2
        g[255], h[255] = r.normal(), r.random()
        s = boosting.Settings(least_weight=0.5, gamma=r.choice([0.0, 0.2]), alpha=r.choice([0.0, 0.3]), l2=1.5)
        soft = lambda v: math.copysign(max(abs(v) - s.alpha, 0), v)
        value = lambda a, b: soft(a) ** 2 / (b + s.l2)
        best = 0.0
        for cut in range(254):
            for left in (True, False):
                gl, hl = g[: cut + 1].sum() + left * g[255], h[: cut + 1].sum() + left * h[255]
                gr, hr = g.sum() - gl, h.sum() - hl
                if hl >= 0.5 and hr >= 0.5:
                    best = max(best, 0.5 * (value(gl, hl) + value(gr, hr) - value(g.sum(), h.sum())) - s.gamma)
        assert boosting.best_split(g, h, s)[0] == pytest.approx(best)


def plain_boosting(bins, target, weight, s):
    """Every tree by loops over rows, nodes, features and cuts; margins of all rows."""
    margin = np.zeros(len(bins))
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - target), weight * p * (1 - p)

        def grow(here, depth):
            total = g[here].sum(), h[here].sum()
            best = (1e-12, None, None)
            if depth < s.depth:
                for f in range(bins.shape[1]):
                    code = bins[here, f]
                    for left in (True, False):
                        for cut in range(int(code[code < 255].max(initial=0)) + 1):
                            goes = np.where(code == 255, left, code <= cut)
                            gl, hl = g[here][goes].sum(), h[here][goes].sum()
                            gr, hr = total[0] - gl, total[1] - hl
                            if min(hl, hr) >= s.least_weight:
                                gain = 0.5 * (gl**2 / (hl + s.l2) + gr**2 / (hr + s.l2) - total[0] ** 2 / (total[1] + s.l2)) - s.gamma
                                if gain > best[0] + 1e-9:
                                    best = (gain, here[goes], here[~goes])
            if best[1] is None:
                margin[here] += -s.rate * total[0] / (total[1] + s.l2)
            else:
                grow(best[1], depth + 1)
                grow(best[2], depth + 1)

        grow(np.arange(len(bins)), 0)
    return margin


def test_training_equals_plain_loops(spark, rows):
    train = rows.where("NOT validation").withColumn("validation", F.lit(False))
    s = boosting.Settings(rounds=3, depth=2, rate=0.3, rows=1.0, columns=1.0, gamma=0.1)
    booster = boosting.train(train, FEATURES, s)
    got = {r.event_id: r.predict for r in boosting.scored(booster, train).collect()}
    cuts = [np.array(c) for c in booster.cuts]
    data = binned.binned(train, FEATURES, cuts, ["event_id", "target", "sample_weight"]).collect()
    want = plain_boosting(np.array([list(r.bins) for r in data]), np.array([r.target for r in data]), np.array([r.sample_weight for r in data]), s)
    assert len(booster.trees) == 3 and np.allclose([got[r.event_id] for r in data], want, atol=1e-6)


def test_sampling_stopping_and_files(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(boosting, "STORE", 2)
    s = boosting.Settings(rounds=4, depth=2, rate=0.3, rows=0.7, columns=0.75, stop=1)
    booster = boosting.train(rows, FEATURES, s)
    assert 1 <= len(booster.trees) <= 4 and boosting.train(rows, FEATURES, s) == booster  # the same at every run
    boosting.save(booster, str(tmp_path / "model"))
    assert boosting.load(spark, str(tmp_path / "model")) == booster
    held = rows.where("validation")
    precision = lambda out: metrics.average_precision(out, weight="sample_weight").first().average_precision
    better = boosting.train(rows, FEATURES, boosting.Settings(rounds=8, depth=4, rate=0.3, rows=0.9, columns=1.0))
    own = precision(boosting.scored(better, held))
    other = precision(model.scored(model.train(rows, FEATURES, maxIter=5), held, FEATURES))
    assert own > other - 0.02 and own > 0.7
    assert [r.score for r in boosting.scored(booster, held).where(F.abs(F.col("score") - 1 / (1 + F.exp(-F.col("predict")))) > 1e-12).collect()] == []
