"""Merged batches give the figures of one pass."""

import math

import numpy as np
import pytest

from tasador.operators import stats, summaries
from tasador.sources import runs

SCHEMA = "place string, x double, y double"


def batches(rng):
    for i in range(5):
        n = int(rng.integers(1, 400))
        own = [(str(rng.choice(["a", "b"])), float(x) if rng.random() < 0.9 else None, float(y)) for x, y in zip(rng.normal(1950, 30, n), rng.normal(1e6, 10, n))]
        yield own + [("only", 3.0, 4.0 + i), (None, 1.0, 1.0), ("a", 1.0, None), ("none", None, 2.0)]


@pytest.fixture(scope="module")
def merged(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("summaries"))
    rows = []
    assert summaries.read_summaries(spark, path) is None
    for i, own in enumerate(batches(np.random.default_rng(6))):
        rows += own
        for _ in range(2):  # a batch handed in again is not merged again
            took = summaries.merge_batch(spark.createDataFrame(own, SCHEMA), path, "x", "y", ["place"], 5.0, f"day {i}")
        assert not took
    return path, rows


def test_moments_and_bins_equal_one_pass(spark, merged):
    path, rows = merged
    found, bins = summaries.read_summaries(spark, path)
    whole, all_bins = summaries.summarise(spark.createDataFrame(rows, SCHEMA), "x", "y", ["place"], 5.0)
    assert bins.exceptAll(all_bins).isEmpty() and all_bins.exceptAll(bins).isEmpty()
    want = {r["place"]: r for r in whole.collect()}
    got = found.collect()
    assert {r["place"] for r in got} == {"a", "b", "only", "none"} and len(got) == 4
    for r in got:
        for c in set(found.columns) - {"place", "sketch"}:
            assert r[c] == pytest.approx(want[r["place"]][c], rel=1e-9, abs=1e-6), c


def test_trend_equals_the_operator(spark, merged):
    path, rows = merged
    found = {r["place"]: r for r in summaries.trend(summaries.read_summaries(spark, path)[0], ["place"]).collect()}
    for r in stats.linear_trend(spark.createDataFrame(rows, SCHEMA), "x", "y", ["place"]).collect():
        own = found[r["place"]]
        assert own["n"] == r["n"]
        for c in ("slope", "intercept", "r2"):
            assert (own[c] is None) == (r[c] is None)
            assert own[c] is None or own[c] == pytest.approx(r[c], rel=1e-6)


def test_quantiles_are_within_the_rank_error(spark, tmp_path):
    rng, values = np.random.default_rng(2), []
    for day in range(6):
        own = rng.lognormal(3, 1, 4000)
        values.append(own)
        df = spark.createDataFrame([("g", 1.0, float(v)) for v in own], SCHEMA)
        summaries.merge_batch(df, str(tmp_path / "s"), "x", "y", ["place"], 5.0, str(day))
    probs = [0.02, 0.25, 0.5, 0.75, 0.98]
    found = summaries.quantile(summaries.read_summaries(spark, str(tmp_path / "s"))[0], probs, ["place"]).first()["q"]
    every = np.sort(np.concatenate(values))
    for p, q in zip(probs, found):
        assert abs(np.searchsorted(every, q) / len(every) - p) < summaries.RANK_ERROR
    assert not math.isnan(found[0])


def test_a_batch_that_comes_in_between_is_kept(spark, tmp_path, monkeypatch):
    path, real = str(tmp_path / "s"), runs._publish
    df = lambda y: spark.createDataFrame([("g", 1.0, y)], SCHEMA)
    merge = lambda y, label: summaries.merge_batch(df(y), path, "x", "y", ["place"], 5.0, label)
    merge(1.0, "mo")

    def overtaken(session, where, entry):
        monkeypatch.setattr(runs, "_publish", real)
        merge(2.0, "tu")
        return real(session, where, entry)

    monkeypatch.setattr(runs, "_publish", overtaken)
    assert merge(4.0, "we")
    row = summaries.read_summaries(spark, path)[0].first()
    assert (row["n"], row["lo"], row["hi"]) == (3, 1.0, 4.0)
