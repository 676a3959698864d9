"""Operators on small panels: closed forms and hand computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosstide.operators import cross_section as cs
from crosstide.operators import time_series as ts
from crosstide.operators.chain import Chain, empty_sessions
from crosstide.operators.spec import SpecError, check_argument, history


def day(spark, values, **more):
    rows = [(0, 101 + i, v, *[c[i] for c in more.values()]) for i, v in enumerate(values)]
    kinds = {"g": "int", "pool": "boolean"}
    return spark.createDataFrame(rows, "di int, ii int, x double" + "".join(f", {c} {kinds[c]}" for c in more))


def series(spark, values):
    return spark.createDataFrame([(i, 1, v) for i, v in enumerate(values)], "di int, ii int, x double")


def out(df, column="x"):
    return [r[column] for r in df.orderBy("di", "ii").collect()]


def test_rank_range_ties_and_missing(spark):
    assert out(cs.rank(day(spark, [3.0, 1.0, None, 2.0, 5.0]), "x")) == pytest.approx([1 / 6, -0.5, None, -1 / 6, 0.5])
    assert out(cs.rank(day(spark, [1.0, 1.0, 2.0]), "x")) == pytest.approx([-0.25, -0.25, 0.5])
    assert out(cs.rank(day(spark, [7.0, None]), "x")) == [0.0, None]


def test_neutralize_missing_group_is_a_group(spark):
    got = out(cs.neutralize(day(spark, [1.0, 3.0, 10.0, 20.0, 30.0], g=[1, 1, 2, 2, 2]), "x", "g"))
    assert got == pytest.approx([-1, 1, -10, 0, 10])
    got = out(cs.neutralize(day(spark, [1.0, 3.0, 5.0, None], g=[1, None, None, None]), "x", "g"))
    assert got == [0.0, -1.0, 1.0, None]


def test_truncate_once_and_keeps_missing(spark):
    assert out(cs.truncate(day(spark, [0.9, 0.05, -0.05, None]), "x", 0.1)) == pytest.approx([0.1, 0.05, -0.05, None])
    assert out(cs.truncate(day(spark, [0.0, None]), "x", 0.1)) == [0.0, None]


def test_scale_pool_before_gross(spark):
    got = out(cs.scale(day(spark, [1.0, -1.0, 2.0, None], pool=[True, True, False, True]), "x", "pool"))
    assert got == [0.5, -0.5, 0.0, 0.0]


def test_scale_empty_book_is_flagged(spark):
    df, flags = Chain([("scale", "book")]).apply(day(spark, [0.0, None]), "x")
    assert out(df) == [0.0, 0.0]
    assert [r["di"] for r in empty_sessions(df, flags).collect()] == [0]


def test_zscore_without_variation(spark):
    assert out(cs.zscore(day(spark, [2.0, 2.0, None]), "x")) == [0.0, 0.0, None]
    assert out(cs.zscore(day(spark, [1.0, 2.0, 3.0]), "x")) == pytest.approx([-1, 0, 1])


def test_linear_decay_closed_form(spark):
    got = out(series(spark, [1.0, 2.0, 3.0, 4.0, 5.0]).withColumn("x", ts.linear_decay("x", 3)))
    assert got == pytest.approx([1, 1.6, 14 / 6, 20 / 6, 26 / 6])
    assert out(series(spark, [1.0, None, 3.0]).withColumn("x", ts.linear_decay("x", 3))) == pytest.approx([1, 1, 2.5])


@pytest.mark.parametrize("span", [10, 100_000])
def test_exp_decay_recurrence(spark, span):
    values = [1.0, None, 4.0, -2.0, None, None, 3.0]
    got = out(ts.exp_decay(series(spark, values), "x", 2))
    num = den = 0.0
    for v, g in zip(values, got):
        num, den = num * 0.5**0.5 + (v or 0.0), den * 0.5**0.5 + (v is not None)
        assert g == pytest.approx(num / den)


def test_exp_decay_before_any_value(spark):
    assert out(ts.exp_decay(series(spark, [None, 2.0]), "x", 2))[0] is None


def test_delay_is_over_sessions_not_rows(spark):
    sparse = spark.createDataFrame([(0, 1, 1.0), (2, 1, 3.0), (3, 1, 4.0)], "di int, ii int, x double")
    assert out(sparse.withColumn("x", ts.delay("x", 1))) == [None, None, 3.0]


def test_chain_repeats_an_operator(spark):
    df, _ = Chain([("delay", 1), ("delay", 1)]).apply(series(spark, [1.0, 2.0, 3.0]), "x")
    assert out(df) == [None, None, 1.0]


def test_pool_exit_gets_no_weight(spark):
    rows = [(0, 101, 1.0, True), (0, 102, 1.0, True), (0, 103, 1.0, True), (1, 101, 1.0, True), (1, 102, 1.0, True), (1, 103, 1.0, False)]
    panel = spark.createDataFrame(rows, "di int, ii int, x double, pool boolean")
    df, _ = Chain([("delay", 1), ("scale", None)]).apply(panel, "x", "pool")
    assert out(df.where("di = 1")) == [0.5, 0.5, 0.0]


def test_runs_and_proxy(spark):
    values = [1.0, None, None, 2.0, None, None, None]
    runs = out(ts.missing_runs(series(spark, values), "x"), "run_length")
    assert runs == [None, 2, 2, None, 3, 3, 3]
    assert out(ts.halted_by_proxy(series(spark, values), "x", 3), "halted") == [False] * 4 + [True] * 3
    with pytest.raises(ValueError):
        ts.halted_by_proxy(series(spark, values), "x", 1)


def test_pct_change_gap_leaves_two_missing(spark):
    assert out(series(spark, [1.0, None, 2.0, 4.0]).withColumn("x", ts.pct_change("x"))) == [None, None, None, 1.0]


def test_median_and_first_time(spark):
    assert out(series(spark, [1.0, 9.0, None, 3.0]).withColumn("x", ts.median("x", 3))) == [1.0, 5.0, 5.0, 6.0]
    flags = series(spark, [0.0, 1.0, 0.0, 1.0]).withColumn("x", ts.first_time(F.col("x") > 0))
    assert out(flags) == [False, True, False, False]


def test_registry_checks():
    assert history([("delay", 2), ("linear_decay", 5), ("exp_decay", 3), ("rank", None)]) == 2 + 4 + 12
    for name, arg in (("rank", 1), ("truncate", "0.02,"), ("truncate", 0), ("linear_decay", 2.5), ("delay", True), ("delay", 0), ("scale", "cash"), ("neutralize", None), ("zap", None)):
        with pytest.raises(SpecError):
            check_argument(name, arg)


def test_whole_chain_against_pandas(spark):
    rng = np.random.default_rng(4)
    days, names = 14, 12
    x = np.where(rng.random((days, names)) < 0.15, np.nan, rng.normal(size=(days, names)).round(1))
    pool, group = rng.random((days, names)) < 0.8, rng.integers(0, 3, names)
    rows = [(t, i, None if np.isnan(x[t, i]) else float(x[t, i]), bool(pool[t, i]), int(group[i])) for t in range(days) for i in range(names)]
    panel = spark.createDataFrame(rows, "di int, ii int, x double, pool boolean, g int")
    df, _ = Chain([("rank", None), ("neutralize", "g"), ("linear_decay", 3), ("truncate", 0.2), ("scale", None)]).apply(panel, "x", "pool", first=0, last=days - 1)
    got = df.toPandas().pivot(index="di", columns="ii", values="x").to_numpy()
    buffer, want = [], []
    for t in range(days):
        v = pd.Series(np.where(pool[t], x[t], np.nan))
        k = v.count()
        v = v * 0 if k <= 1 else (v.rank() - 1) / (k - 1) - 0.5
        buffer = ([v - v.groupby(group).transform("mean")] + buffer)[:3]
        weights = [3, 2, 1][: len(buffer)]
        num = sum(w * b.fillna(0) for w, b in zip(weights, buffer))
        den = sum(w * b.notna() for w, b in zip(weights, buffer))
        v = (num / den.where(den > 0)).clip(-0.2 * (num / den.where(den > 0)).abs().sum(), 0.2 * (num / den.where(den > 0)).abs().sum())
        v = v.where(pool[t])
        want.append((v / v.abs().sum()).fillna(0).to_numpy())
    np.testing.assert_allclose(got, np.array(want), atol=1e-12)
