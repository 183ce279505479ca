"""Registries, settings, nested results, axis bands, streaming packers and logs."""

import json

import pytest
from pyspark.sql import functions as F

from glyphmill import registries, reporting, settings
from glyphmill.functions import text as t
from glyphmill.operators import logs
from glyphmill.plans import registry
from glyphmill.streaming import stateful


def test_chosen_names():
    known = ["one", "Two", "three"]
    assert registries.chosen(None, known) == registries.chosen(" ALL ", known) == (known, [])
    assert registries.chosen("two, ONE,two,,x,old", known, {"Old": "three"}) == (["Two", "one", "three"], ["x"])


def test_every_registered_query_exists():
    names = {q for g in (registries.EVALUATORS, registries.ARTIFACTS) for x in g.values() for q in x}
    assert names <= set(registry.queries())


def test_failures_are_isolated(spark):
    seen = []
    groups = {"bad": ("no_such_query",), "good": ("lr_schedule", "phase_schedule")}
    done, failed = registries.run(spark, "/nowhere", "bad,good,unknown", groups, lambda n, df: seen.append((n, df.count())))
    assert done == ["good"] and list(failed) == ["bad"] and seen == [("lr_schedule", 200), ("phase_schedule", 40)]


def test_settings():
    s = settings.overlaid({"seed": None, "training": {"seed": 7, "lr": 1}, "x": [1]}, {"training": {"lr": 2}, "max_samples": "5", "x": []})
    assert s == {"seed": None, "training": {"seed": 7, "lr": 2}, "max_samples": "5", "x": []}
    assert settings.seed(s) == settings.subsample_seed(s) == 7 and settings.seed({}) == 42 and settings.seed({"seed": 0}) == 0
    assert settings.max_samples(s) == 5 and settings.max_samples(s | {"benchmarks": {"max_samples": 3}}) == 3 and settings.max_samples({}) is None
    assert json.loads(settings.dumped(s)) == s


def test_data_sources():
    has = lambda *names: {f"p/{n}" for n in names}.__contains__
    assert settings.data_sources(has(), "p", "t", "v") == ("t", "v")
    assert settings.data_sources(has("train_shuffled", "train_packed", "val_packed"), "p", "t", "v") == ("p/train_shuffled", "p/val_packed")
    with pytest.raises(FileNotFoundError):
        settings.data_sources(has("train_packed"), "p", "t", "v")


def test_details_at_every_depth(spark):
    df = spark.sql("select 1 as a, array(1, 2, 3) as examples, named_struct('detailed_results_x', 1, 'b', named_struct('generations', array('u'), 'c', 5)) as r, array(1) as detailed_results")
    out = reporting.without_details(df)
    assert out.columns == ["num_examples", "a", "r"]
    assert out.first().asDict(recursive=True) == {"num_examples": 3, "a": 1, "r": {"b": {"num_generations": 1, "c": 5}}}


@pytest.mark.parametrize(("values", "want"), [([0.5, 1.0, 2.9], 3.0), ([1.0] * 19 + [50.0], 3.0), ([1.0] * 18 + [10.0, 50.0], 10.4), ([-1.0, 1.0], 3.0), ([-1.0] * 5 + [8.0], 8.32)])
def test_axis_band(spark, values, want):
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    r = logs.axis_band(df, "g", "v", 0.0, 3.0).first()
    assert (r.lo, r.hi) == (0.0, pytest.approx(want))


def test_steps(spark):
    rows = spark.createDataFrame([(10, None, 100), (-1, 5, 100), (None, None, 3)], "configured int, recorded int, n int")
    out = rows.select(logs.max_steps(F.col("configured"), F.col("n"), F.lit(0)).alias("a"), logs.steps_per_epoch(F.col("recorded"), F.col("n"), F.lit(2), F.lit(4)).alias("b"))
    assert [tuple(r) for r in out.collect()] == [(10, 12), (100, 5), (3, 1)]


def test_slot_length(spark):
    df = spark.createDataFrame([("a bb " + "c" * 50,), ("",), (None,)], "text string")
    assert [r.n for r in df.select(t.slot_length(F.col("text"), 24).alias("n")).collect()] == [5, 0, None]


def test_long_rows_in_a_stream(spark, tmp_path):
    rows = [(i, "b", n) for i, n in enumerate([600, 100, 300, 5, 250])]
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, "k long, bucket string, n long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k long, bucket string, n long").parquet(f"{tmp_path}/in")
    got = stateful.drained(stateful.packed_samples(stream, "bucket", "k", "n", 256), "packed_test", "append", f"{tmp_path}/c").collect()
    assert sorted((r.sample_id, r.used) for r in got) == [(0, 256), (1, 256), (2, 188), (3, 256), (4, 49)]


def test_tailed_log(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text('{"step": 1, "loss": 2.5}\nnot json\n{"step": 2}\n')
    got = stateful.drained(stateful.tailed_log(spark, f"{tmp_path}/log", "step long, loss double"), "log_test", "append", f"{tmp_path}/c").collect()
    assert sorted((r.step, r.loss) for r in got) == [(1, 2.5), (2, None)]
