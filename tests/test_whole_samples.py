"""Samples of the report queries are all documents of all sources."""

import hashlib

import pytest

from glyphmill.operators import stats
from glyphmill.plans import registry

N = {"src0": 45, "src9": 40, "other": 31}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("samples"))
    rows = [(i * 3 + k, s, (i * 7 + k * 11) % 250) for k, (s, n) in enumerate(N.items()) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d, {s: [float(c % 100) for _, x, c in sorted(rows) if x == s] for s in N}


def means(x):
    """Of 100 resamples."""
    drawn = lambda b, i: int(hashlib.md5(f"42:{b}:{i}".encode()).hexdigest()[:8], 16) % len(x)
    return [sum(x[drawn(b, i)] for i in range(len(x))) / len(x) for b in range(100)]


def quantile(x, q):
    x, at = sorted(x), q * (len(x) - 1)
    low = int(at)
    return x[low] + (at - low) * (x[min(low + 1, len(x) - 1)] - x[low])


def test_samples_and_intervals(spark, folder):
    d, own = folder
    q = registry.queries()
    assert {(r.model, r.idx): r.value for r in q["metric_samples"](spark, d).collect()} == {(s, i): v for s, x in own.items() for i, v in enumerate(x)}
    mean = {s: sum(x) / len(x) for s, x in own.items()}
    best = min(mean, key=lambda s: (-mean[s], s))
    assert [tuple(r) for r in q["best_model"](spark, d).collect()] == [(best, round(mean[best], 6))]
    got = {r.model: r for r in q["bootstrap_ci"](spark, d).collect()}
    for s, x in own.items():
        assert got[s].n == len(x)
        assert [got[s].ci_low, got[s].ci_high] == pytest.approx([quantile(means(x), 0.025), quantile(means(x), 0.975)], abs=2e-6)


def test_pairs(spark, folder):
    d, own = folder
    q = registry.queries()
    best = min(own, key=lambda s: (-sum(own[s]) / len(own[s]), s))
    diffs = {s: [a - b for a, b in zip(own[best], x, strict=False)] for s, x in own.items() if s != best}
    assert {(r.model, r.idx): r["diff"] for r in q["paired_diff"](spark, d).collect()} == {(s, i): v for s, x in diffs.items() for i, v in enumerate(x)}
    got = {r.model: r for r in q["paired_bootstrap"](spark, d).collect()}
    tied = {r.model: r.tied for r in q["significance_flag"](spark, d).collect()}
    assert tied.keys() == own.keys() and tied[best]
    for s, x in diffs.items():
        m = means(x)
        p = min(1.0, 2 * min(sum(v <= 0 for v in m), sum(v >= 0 for v in m)) / 100)
        assert got[s].n == len(x) and got[s].p == pytest.approx(p)
        assert tied[s] == (p >= 0.05 or quantile(m, 0.025) <= 0)


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_draws_are_not_broadcast_and_not_made_by_one_task(spark):
    """2 keys of 5,000 and 3 samples, whose draws were made by one task and sent to the driver."""
    rows = [("a", i, float(i)) for i in range(5_000)] + [("b", i, float(i)) for i in range(3)]
    samples = spark.createDataFrame(rows, "model string, idx long, value double")
    got = stats.resampled_means(samples, ["model"], "value", 4)
    assert "Broadcast" not in _plan(got) and "ShuffledHashJoin" in _plan(got)
    for r in got.collect():
        n = 5_000 if r.model == "a" else 3
        assert r.m == pytest.approx(sum(int(hashlib.md5(f"42:{r.b}:{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)) / n)
    assert got.count() == 8


@pytest.mark.parametrize("name", ["paired_bootstrap", "significance_flag"])
def test_draws_of_queries_are_shuffled(spark, folder, name):
    assert "ShuffledHashJoin" in _plan(registry.queries()[name](spark, folder[0]))
