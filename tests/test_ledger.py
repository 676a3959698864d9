"""The ledger: identities, halts, delistings, ghosts, limits; metrics and gates."""

import json
import warnings

import numpy as np
import pandas as pd
import pytest

from crosstide.operators import gates, ledger
from crosstide.operators import metrics as m
from crosstide.plans.evaluate import measure, render

warnings.simplefilter("ignore")
BOOK = 20e6


def frame(spark, array, name):
    rows = [(t, 100 + i, None if np.isnan(v) else float(v)) for t, row in enumerate(array) for i, v in enumerate(row)]
    return spark.createDataFrame(rows, f"di int, ii int, {name} double")


def sessions(spark, n):
    return spark.createDataFrame([(t, str(d.date())) for t, d in enumerate(pd.bdate_range("2024-01-01", periods=n))], "di int, date string").selectExpr("di", "to_date(date) AS date")


def run(spark, w, r, **options):
    options = {"booksize": BOOK, "halt_proxy": 0} | options
    return ledger.simulate(frame(spark, np.asarray(w, float), "w"), frame(spark, np.asarray(r, float), "ret"), **options)


def cells(result, column):
    return result.cells.toPandas().pivot(index="di", columns="ii", values=column).to_numpy()


@pytest.fixture(scope="module")
def busy(spark):
    rng = np.random.default_rng(7)
    t, n = 60, 12
    w = rng.normal(size=(t, n))
    w /= np.abs(w).sum(axis=1, keepdims=True)
    r = rng.normal(scale=0.02, size=(t, n))
    r[10:13, 2] = r[30:34, 5] = np.nan
    r[40, 3], r[41:, 3] = -0.3, np.nan
    adv = np.full((t, n), 4e6)
    adv[20:25, 1] = np.nan
    day = sessions(spark, t)
    gone = spark.createDataFrame([(103, str(pd.bdate_range("2024-01-01", periods=t)[40].date()))], "ii int, delist_date string")
    return run(spark, w, r, adv_dollar=frame(spark, adv, "adv"), cost_bps=10.0, delist=gone, sessions=day, halt_proxy=2), w, r, adv


def test_accounting_identities(busy):
    gap = busy[0].identity_gaps().first()
    assert gap["cell_gap"] < 1e-6 and gap["nav_gap"] < 1e-6
    nav = busy[0].daily.toPandas().sort_values("di")
    np.testing.assert_allclose(nav["nav"], nav["pnl"].cumsum(), atol=1e-5)


def test_against_a_plain_loop(busy):
    result, w, r, adv = busy
    pos, got = np.zeros(w.shape[1]), cells(result, "pos")
    halted = np.zeros_like(r, bool)
    halted[10:13, 2] = halted[30:34, 5] = True
    for t in range(len(w)):
        moved = pos * (1 + np.nan_to_num(r[t]))
        after, due = np.arange(w.shape[1]) == 3, t >= 40
        tradable = ~np.isnan(r[t]) & ~(after & (t > 40))
        frozen = ~tradable & (moved != 0) & ~(after & due)
        share = np.where(tradable & ~(after & due), w[t], 0)
        target = share / np.abs(share).sum() * max(BOOK - np.abs(moved[frozen]).sum(), 0)
        limit = np.where(np.isnan(adv[t]), np.inf, 0.1 * adv[t])
        pos = moved + np.where(tradable, np.clip(target - moved, -limit, limit), 0)
        pos = np.where(after & due, 0, pos)
        np.testing.assert_allclose(got[t], pos, atol=1e-4)


def test_turnover_splits_up(busy):
    d = busy[0].daily.toPandas()
    np.testing.assert_allclose(d["alpha_turnover"] + d["realloc_turnover"], d["trade_dollar"] / BOOK, atol=1e-12)
    assert list(d.columns[2:]) == ledger.DAILY_COLUMNS
    assert busy[0].audit["delist_events"] == 1


def test_chunks_change_nothing(spark, busy):
    _, w, r, _ = busy
    whole = run(spark, w[:40], r[:40], halt_proxy=2, cost_bps=3.0)
    parts = run(spark, w[:40], r[:40], halt_proxy=2, cost_bps=3.0, chunk_sessions=11)
    np.testing.assert_allclose(cells(whole, "pos"), cells(parts, "pos"), atol=1e-6)
    assert whole.audit == parts.audit


def test_strategies_are_independent(spark, busy):
    _, w, r, _ = busy
    one = frame(spark, w[:10], "w")
    both = one.selectExpr("'a' AS strategy", "di", "ii", "w").unionByName(one.selectExpr("'b' AS strategy", "di", "ii", "-w AS w"))
    out = ledger.simulate(both, frame(spark, r[:10], "ret"), booksize=BOOK, halt_proxy=0).daily.toPandas().pivot(index="di", columns="strategy", values="holding_pnl")
    np.testing.assert_allclose(out["a"], -out["b"], atol=1e-6)


def test_fast_path_equals_the_fold(spark):
    rng = np.random.default_rng(1)
    w, r = rng.normal(size=(20, 5)), rng.normal(scale=0.01, size=(20, 5))
    slow = run(spark, w, r, cost_bps=10.0)
    panel = frame(spark, w, "w").join(frame(spark, r, "ret"), ["di", "ii"])
    fast = ledger.fast_cells(panel, BOOK, 10.0)
    for c in ("pos", "hp", "delta", "cost", "pnl"):
        np.testing.assert_allclose(fast.toPandas().pivot(index="di", columns="ii", values=c).to_numpy(), cells(slow, c), atol=1e-6)
    a, b = ledger.fast_daily(fast, BOOK).toPandas().sort_values("di"), slow.daily.toPandas().sort_values("di")
    np.testing.assert_allclose(a["nav"], b["nav"], atol=1e-5)


def test_halted_positions_are_held_and_reprice(spark):
    w = [[0.5, -0.5]] * 6
    r = [[0, 0], [0.01, 0], [np.nan, 0], [np.nan, 0], [0.10, 0], [0, 0]]
    got = run(spark, w, r, halt_proxy=2)
    d = got.daily.toPandas().sort_values("di")
    assert list(d["frozen_count"]) == [0, 0, 1, 1, 0, 0]
    assert d["frozen_reprice_pnl"].iloc[4] == pytest.approx(0.10 * 0.5 * BOOK)
    assert d["avail"].iloc[2] == pytest.approx(BOOK / 2)


def test_both_sides_frozen_count_gross(spark):
    w = [[0.25, -0.25, 0.25, -0.25]] * 4
    r = [[0] * 4, [np.nan, np.nan, 0, 0], [np.nan, np.nan, 0, 0], [0] * 4]
    d = run(spark, w, r, halt_proxy=2).daily.toPandas().sort_values("di")
    assert d["frozen_value"].iloc[1] == pytest.approx(BOOK / 2)


def test_ghosts_close_or_fail(spark):
    w, r = [[0.5, -0.5]] * 12, np.zeros((12, 2))
    r[5, 0] = np.nan
    with pytest.raises(ledger.SimError, match="neither a delisting nor a halt"):
        run(spark, w, r, halt_proxy=2)
    got = run(spark, w, r, halt_proxy=2, ghost_tolerance=1.0)
    assert got.audit["ghost_cells"] == 1 and cells(got, "pos")[5, 0] == 0
    assert run(spark, w, r, halt_proxy=0).audit["ghost_cells"] == 0


def test_refusals(spark):
    w, r = [[0.5, -0.5]] * 3, np.zeros((3, 2))
    for options in ({"halt_proxy": None}, {"halt_proxy": 1}, {"booksize": 0}, {"participation": 0}, {"cost_bps": float("nan")}):
        with pytest.raises(ledger.SimError):
            run(spark, w, r, **options)
    with pytest.raises(ledger.SimError, match="no return at all"):
        run(spark, w, [[0, np.nan]] * 3)
    with pytest.raises(ledger.SimError, match="lacks"):
        run(spark, w, r[:2])
    with pytest.raises(ledger.SimError, match="empty"):
        ledger.simulate(frame(spark, np.zeros((0, 2)), "w"), frame(spark, r, "ret"), booksize=1, halt_proxy=0)


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(11)
    t, n = 300, 8
    market = rng.normal(scale=0.01, size=t)
    r = 0.5 * market[:, None] + rng.normal(scale=0.01, size=(t, n))
    w = rng.normal(size=(t, n))
    w /= np.abs(w).sum(axis=1, keepdims=True)
    result = run(spark, w, r, cost_bps=1.0)
    out = measure(result, sessions(spark, t), meta={"region_hash": "a", "region_hash_canonical": "a"})
    d = result.daily.toPandas().sort_values("di")
    ret = d["return"].to_numpy()
    sharpe = ret.mean() / ret.std(ddof=1) * np.sqrt(252)
    assert out["scalar"]["sharpe"] == pytest.approx(sharpe)
    turnover = d["trade_dollar"].mean() / BOOK
    assert out["scalar"]["fitness"] == pytest.approx(sharpe * np.sqrt(abs(ret.mean() * 252) / max(turnover, 0.125)))
    cum = d["pnl"].cumsum().to_numpy()
    assert out["scalar"]["max_drawdown_dollar"] == pytest.approx((np.maximum(np.maximum.accumulate(cum), 0) - cum).max())
    assert sum(v["days"] for v in out["by_month"].values()) == t == sum(v["days"] for v in out["by_year"].values())
    by = {g["gate"]: g for g in out["gates"]}
    assert len(by) == 7 and by["pool hygiene"]["state"] == gates.NO_BASIS and by["lookahead status"]["state"] == gates.FAIL
    x, y = d["market_ret"].to_numpy(), ret
    assert by["market beta"]["numbers"]["r2"] == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2)
    rolling = pd.Series(ret).rolling(252)
    assert by["period stability"]["numbers"]["worst_rolling_1y_sharpe"] == pytest.approx((rolling.mean() / rolling.std() * np.sqrt(252)).min())
    json.dumps(out, allow_nan=False)
    assert "submission readiness" in render("demo", out)


def test_gates_have_no_basis_on_an_empty_book(spark):
    result = run(spark, np.zeros((5, 2)), np.zeros((5, 2)))
    states = {g["gate"]: g["state"] for g in gates.evaluate(result)["gates"]}
    assert states["concentration"] == states["cost breakeven"] == states["long/short balance"] == states["market beta"] == gates.NO_BASIS


def test_drawdown_of_gains_is_zero(spark):
    daily = spark.createDataFrame([(0, 1.0), (1, 2.0)], "di int, pnl double")
    assert m.drawdown(daily).first()["max_drawdown"] == 0.0
