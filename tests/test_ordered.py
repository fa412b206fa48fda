import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadlake.operators.ordered import nearest_rank, top_within, windowed

SPECS = {"rn": ("row_number", None), "s": ("sum", "v"), "sb": ("sum_before", "v"),
         "lo": ("min", "v"), "lob": ("min_before", "v"), "hi": ("max", "v"),
         "hib": ("max_before", "v"), "prev": ("lag", "row")}


def frame(spark, n=400):
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "hot", "cold", None]), i,
             rng.choice([None, -2, -1, 1, 3])) for i in range(n)]
    return spark.createDataFrame(rows, "k string, i int, v int").withColumn(
        "row", F.struct("v"))


def test_split_equals_plain_window(spark):
    df = frame(spark)
    for order in (["i"], [F.col("i").desc()]):
        whole = windowed(df, ["k"], order, SPECS)
        cut = windowed(df, ["k"], order, SPECS, max_group_rows=30)
        assert whole.columns == cut.columns
        assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))


def test_small_groups_use_one_window(spark):
    plan = windowed(frame(spark), ["k"], ["i"], {"rn": ("row_number", None)})
    assert "_range" not in plan._jdf.queryExecution().toString()


def test_top_within_is_cut_before_the_shuffle(spark):
    plan = top_within(frame(spark), ["k"], ["i"], 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 20), min_size=1, max_size=30), st.sampled_from([2, 10_000]))
def test_nearest_rank(spark, values, limit):
    df = spark.createDataFrame([(1, v) for v in values], "k int, v int")
    got = nearest_rank(df, ["k"], "v", {"p50": 50, "p95": 95, "p100": 100}, limit).first()
    ordered = sorted(values)
    for p in (50, 95, 100):
        at = max(0, min(len(ordered) - 1, -(-p * len(ordered) // 100) - 1))
        assert got[f"p{p}"] == ordered[at]


def test_the_ranges_do_not_grow_with_the_rows(spark, monkeypatch):
    from threadlake.operators import ordered
    df, staged, real = frame(spark), [], ordered.materialize
    monkeypatch.setattr(ordered, "MAX_RANGES", 4)
    monkeypatch.setattr(ordered, "materialize", lambda d, label: staged.append(real(d, label)) or staged[-1])
    cut = windowed(df, ["k"], ["i"], SPECS, max_group_rows=10)
    assert sorted(map(str, cut.collect())) == sorted(map(str, windowed(df, ["k"], ["i"], SPECS).collect()))
    assert 1 < staged[0].select("_range").distinct().count() <= 4
