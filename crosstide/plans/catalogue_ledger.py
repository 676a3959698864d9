"""Queries of the general ledger and its gates; the SQL steps through the sessions recursively."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstide.operators import gates, ledger
from crosstide.plans import demo
from crosstide.plans.catalogue import BOOK_CTE, _cells, r, register, rs
from crosstide.sources import files

#: One session of the ledger from the last one's positions, in SQL: each level adds what the next one needs.
STEP = """SELECT di, ii, after + settle AS pos, frozen, prev, hp, moved, target, wanted, delta, abs(delta) * 0.001 AS cost, settle, hp - abs(delta) * 0.001 AS pnl, ghost, CASE WHEN was AND tradable THEN hp ELSE 0.0 END AS reprice, avail, stuck, tradable, missing, w, free, growth
FROM (SELECT *, CASE WHEN ghost THEN -after ELSE 0.0 END AS settle
FROM (SELECT *, moved + delta AS after
FROM (SELECT *, CASE WHEN cap IS NULL THEN wanted ELSE greatest(-cap, least(wanted, cap)) END AS delta
FROM (SELECT *, CASE WHEN tradable THEN target - moved ELSE 0.0 END AS wanted
FROM (SELECT *, CASE WHEN total > 0 THEN share / total ELSE share END * avail AS target
FROM (SELECT *, sum(abs(share)) OVER () AS total, greatest(1e6 - stuck, 0.0) AS avail
FROM (SELECT *, sum(CASE WHEN frozen THEN abs(moved) ELSE 0.0 END) OVER () AS stuck, CASE WHEN tradable THEN w ELSE 0.0 END AS share
FROM (SELECT *, NOT tradable AND moved <> 0 AND NOT ghost AS frozen
FROM (SELECT i.di, i.ii, i.w, i.free, i.cap, i.growth, i.missing, NOT i.missing AS tradable, rec.frozen AS was, rec.pos AS prev, rec.pos * i.growth AS hp, rec.pos + rec.pos * i.growth AS moved, {detect} AND i.missing AND NOT i.halted AND rec.pos <> 0 AS ghost
FROM rec JOIN inp i ON i.ii = rec.ii AND i.di = rec.di + 1)))))))))"""


def general_sql(detect: bool, capped: bool) -> str:
    """CTEs up to cells (gcells) and sessions (gdays) of the general ledger on the demonstration book."""
    halted = "coalesce(ret IS NULL AND count(*) OVER (PARTITION BY ii, ret IS NULL, isl) >= 2, false)" if detect else "false"
    cap = "CASE WHEN px * vol IS NULL THEN NULL ELSE greatest(px * vol * 0.1, 0.0) END" if capped else "CAST(NULL AS DOUBLE)"
    return f"""{BOOK_CTE}, isl AS (SELECT *, row_number() OVER (PARTITION BY ii ORDER BY di) - row_number() OVER (PARTITION BY ii, ret IS NULL ORDER BY di) AS isl FROM book),
inp AS MATERIALIZED (SELECT di, ii, w, coalesce(w / nullif(sum(abs(w)) OVER (PARTITION BY di), 0), 0.0) * 1e6 AS free, {cap} AS cap, coalesce(ret, 0.0) AS growth, ret IS NULL AS missing, {halted} AS halted FROM isl),
rec AS (SELECT -1 AS di, ii, 0.0::DOUBLE AS pos, false AS frozen, 0.0::DOUBLE AS prev, 0.0::DOUBLE AS hp, 0.0::DOUBLE AS moved, 0.0::DOUBLE AS target, 0.0::DOUBLE AS wanted, 0.0::DOUBLE AS delta, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS settle, 0.0::DOUBLE AS pnl, false AS ghost, 0.0::DOUBLE AS reprice, 0.0::DOUBLE AS avail, 0.0::DOUBLE AS stuck, true AS tradable, false AS missing, 0.0::DOUBLE AS w, 0.0::DOUBLE AS free, 0.0::DOUBLE AS growth
  FROM (SELECT DISTINCT ii FROM inp) UNION ALL {STEP.format(detect=str(detect).lower())}),
gcells AS MATERIALIZED (SELECT *, abs(free - moved) AS by_alpha, abs(target - free) AS by_freeze FROM rec WHERE di >= 0),
gshare AS (SELECT *, coalesce(by_alpha / nullif(by_alpha + by_freeze, 0), 1.0) AS sh FROM gcells),
gsum AS (SELECT di, sum(CASE WHEN pos > 0 THEN pos ELSE 0 END) AS long_value, sum(CASE WHEN pos < 0 THEN pos ELSE 0 END) AS short_value, sum((pos > 0)::INT) AS long_count, sum((pos < 0)::INT) AS short_count, sum(abs(delta)) AS trade_dollar, sum(hp) AS holding_pnl, 0.0 AS trading_pnl,
  sum(cost) AS cost, 1e6 - sum(abs(pos)) AS cash, sum(pnl) AS pnl, sum(pnl) / 1e6 AS "return", sum(CASE WHEN tradable THEN abs(delta) * sh ELSE 0 END) / 1e6 AS alpha_turnover, sum(CASE WHEN tradable THEN abs(delta) * (1 - sh) ELSE 0 END) / 1e6 AS realloc_turnover,
  sum(CASE WHEN tradable THEN abs(wanted - delta) ELSE 0 END) AS gap_participation, sum(CASE WHEN tradable THEN by_freeze ELSE 0 END) AS gap_realloc, sum(CASE WHEN NOT tradable THEN abs(free - pos) ELSE 0 END) AS gap_reprice, sum(-(delta + cost + settle)) AS flow, sum(pos) AS net,
  max(stuck) AS frozen_value, sum(frozen::INT) AS frozen_count, max(avail) AS avail, sum(reprice) AS frozen_reprice_pnl, sum(ghost::INT) AS ghost_count, sum(CASE WHEN ghost THEN abs(prev) ELSE 0 END) AS ghost_value, 0.0 AS delist_close_value,
  sum(growth) / nullif(count(*) - sum(missing::INT), 0) AS market_ret, sum(abs(w)) AS weight_gross, sum((w <> 0)::INT) AS target_count FROM gshare GROUP BY di),
gdays AS MATERIALIZED (SELECT *, sum(flow) OVER (ORDER BY di) AS cash_account, net + sum(flow) OVER (ORDER BY di) AS nav FROM gsum)"""


def _general(spark, d, capped: bool = False, **options):
    """The demonstration book, written once as a store would hold it, through the ledger."""
    book = files.written(demo.sp_book(spark, d).select("di", F.col("ii").cast("int").alias("ii"), "w", "ret", (F.col("px") * F.col("vol")).alias("adv")), "book")
    adv = book.select("di", "ii", "adv") if capped else None
    return ledger.simulate(book.select("di", "ii", "w"), book.select("di", "ii", "ret"), booksize=demo.BOOK, cost_bps=10.0, halt_proxy=options.pop("halt_proxy", 0), ghost_tolerance=1.0, adv_dollar=adv, **options)


SHOWN = [c for c in ledger.DAILY_COLUMNS if c != "oop_weight"]
CELLS = {"prev": "prev", "hp": "hp", "target": "target", "delta": "delta", "cost": "cost", "settle": "settle", "pos": "pos", "pnl": "pnl", "reprice": "reprice"}
_days = lambda: ", ".join(rs(f'"{c}"', f'"{c}"', 2 if c not in ("return", "market_ret", "alpha_turnover", "realloc_turnover") else 6) for c in SHOWN)


def _rolled(daily):
    return daily.select(F.col("di").cast("int").alias("di"), *[r(F.col(f"`{c}`"), 2 if c not in ("return", "market_ret", "alpha_turnover", "realloc_turnover") else 6).alias(c) for c in SHOWN])


@register("WITH RECURSIVE " + general_sql(True, False) + f" SELECT di::INTEGER AS di, ii, {', '.join(rs(c, c, 2) for c in CELLS)}, frozen, ghost FROM gcells")
def ledger_general(spark, d):
    """The fold with halts by proxy of two months and ghosts closed, every cell."""
    cells = _general(spark, d, halt_proxy=2).cells
    return _cells(cells, *CELLS, digits=2).join(cells.select(F.col("di"), F.col("ii").cast("long").alias("ii"), "frozen", "ghost"), ["di", "ii"])


@register("WITH RECURSIVE " + general_sql(True, False) + f" SELECT di::INTEGER AS di, {_days()} FROM gdays")
def ledger_general_daily(spark, d):
    """Its roll-up by session: all columns but those of a pool."""
    return _rolled(_general(spark, d, halt_proxy=2).daily)


@register("WITH RECURSIVE " + general_sql(False, True) + f" SELECT di::INTEGER AS di, {_days()} FROM gdays")
def ledger_capped_fold(spark, d):
    """The fold with a limit of a tenth of each name's dollar volume: its daily roll-up."""
    return _rolled(_general(spark, d, capped=True).daily)


@register("WITH RECURSIVE " + general_sql(True, False) + """ SELECT CAST(sum(ghost::INT) AS BIGINT) AS ghost_cells, count(DISTINCT CASE WHEN ghost THEN di END) AS ghost_days, CAST(sum((c.halted)::INT) AS BIGINT) AS halt_cells,
round(sum(ghost::INT) / sum((prev <> 0)::INT), 9) AS ghost_rate, count(DISTINCT di) AS n_sessions, count(DISTINCT ii) AS n_securities, 'proxy(2)' AS ghost_detection, 'none' AS delist_source FROM (SELECT g.*, i.halted FROM gcells g JOIN inp i USING (di, ii)) c""")
def ledger_audit(spark, d):
    """The audit record of the general run."""
    audit = _general(spark, d, halt_proxy=2).audit
    names = ["ghost_cells", "ghost_days", "halt_cells", "ghost_rate", "n_sessions", "n_securities", "ghost_detection", "delist_source"]
    row = [round(audit["ghost_rate"], 9) if k == "ghost_rate" else audit[k] for k in names]
    return spark.createDataFrame([row], "ghost_cells long, ghost_days long, halt_cells long, ghost_rate double, n_sessions long, n_securities long, ghost_detection string, delist_source string")


#: Facts of the gates in SQL, by gate, and each gate's state from them.
FACTS = """ok AS (SELECT "return" AS y, market_ret AS x FROM gdays WHERE market_ret IS NOT NULL AND "return" IS NOT NULL), b AS (SELECT count(*) AS n_obs, regr_slope(y, x) AS beta, regr_r2(y, x) AS r2 FROM ok),
hd AS (SELECT avg(y - beta * x) / stddev_samp(y - beta * x) * sqrt(252) AS hedged FROM ok, b), nm AS (SELECT abs(sum(pnl)) AS p, sum(pnl) AS s, row_number() OVER (ORDER BY abs(sum(pnl)) DESC, ii) AS k FROM gcells GROUP BY ii),
cn AS (SELECT sum(p) AS total, sum((s <> 0)::INT) AS names, sum(CASE WHEN k <= 1 THEN p END) / sum(p) AS t1, sum(CASE WHEN k <= 5 THEN p END) / sum(p) AS t5, sum(CASE WHEN k <= 20 THEN p END) / sum(p) AS t20 FROM nm),
hv AS (SELECT "return" AS r, row_number() OVER (ORDER BY di) <= (SELECT count(*) FROM gdays) // 2 AS a FROM gdays), sh AS (SELECT avg(r) FILTER (a) / nullif(stddev_samp(r) FILTER (a), 0) * sqrt(252) AS s1, avg(r) FILTER (NOT a) / nullif(stddev_samp(r) FILTER (NOT a), 0) * sqrt(252) AS s2 FROM hv),
dy AS (SELECT sum(cost) AS cost, sum(pnl) + sum(cost) AS gross, (sum(pnl) + sum(cost)) / nullif(sum(cost), 0) AS be, avg(long_value) AS lv, avg(short_value) AS sv, avg(long_count) AS lc, avg(short_count) AS sc, avg("return") / stddev_samp("return") * sqrt(252) AS raw, max(abs(pnl)) / sum(abs(pnl)) AS day1,
  sum((weight_gross = 0)::INT) AS empty, max(CASE WHEN weight_gross > 0 THEN abs(weight_gross - 1) END) AS dev, min(target_count) AS c0, avg(target_count) AS ca, max(target_count) AS c1, sum(ghost_count) AS ghosts, sum((ghost_count > 0)::INT) AS ghost_days FROM gdays),
f AS (SELECT *, CASE WHEN s1 > 0 THEN s2 / s1 END AS ratio, lv / -sv AS ls FROM b, hd, cn, sh, dy),
g(gate, state, fact, value) AS (
  SELECT 'market beta', CASE WHEN n_obs < 30 THEN 'NO-BASIS' WHEN r2 <= 0.25 THEN 'PASS' ELSE 'FAIL' END, unnest(['n_obs', 'beta', 'r2', 'sharpe_hedged', 'sharpe_raw']), unnest([n_obs, beta, r2, hedged, raw]) FROM f
  UNION ALL SELECT 'concentration', CASE WHEN t1 <= 0.2 AND t5 <= 0.5 AND day1 <= 0.2 THEN 'PASS' ELSE 'FAIL' END, unnest(['total_abs_pnl', 'n_names_with_pnl', 'top1_share', 'top5_share', 'top20_share', 'top1_day_share']), unnest([total, names, t1, t5, t20, day1]) FROM f
  UNION ALL SELECT 'period stability', CASE WHEN ratio IS NULL THEN 'NO-BASIS' WHEN ratio >= 0.25 THEN 'PASS' ELSE 'FAIL' END, unnest(['sharpe_first_half', 'sharpe_second_half', 'half_ratio']), unnest([s1, s2, ratio]) FROM f
  UNION ALL SELECT 'cost breakeven', CASE WHEN be >= 2 THEN 'PASS' ELSE 'FAIL' END, unnest(['cost_total', 'pnl_gross', 'breakeven_cost']), unnest([cost, gross, be]) FROM f
  UNION ALL SELECT 'long/short balance', CASE WHEN ls BETWEEN 0.67 AND 1.5 THEN 'PASS' ELSE 'FAIL' END, unnest(['avg_long_value', 'avg_short_value', 'avg_long_count', 'avg_short_count', 'long_short_ratio', 'net_exposure_frac_of_gross']), unnest([lv, sv, lc, sc, ls, (lv + sv) / (lv - sv)]) FROM f
  UNION ALL SELECT 'pool hygiene', 'NO-BASIS', unnest(['empty_weight_days', 'weight_gross_dev_max', 'coverage_min', 'coverage_avg', 'coverage_max']), unnest([empty, dev, c0, ca, c1]) FROM f
  UNION ALL SELECT 'lookahead status', 'FAIL', unnest(['ghost_days', 'delist_events']), unnest([ghost_days, 0]) FROM f)"""


@register("WITH RECURSIVE " + general_sql(True, False) + ", " + FACTS + f" SELECT gate, state, fact, {rs('value', 'value', 4)} FROM g")
def quality_gates(spark, d):
    """The seven gates of the general ledger: state and numbers."""
    judged = gates.evaluate(_general(spark, d, halt_proxy=2))["gates"]
    left_out = {"top_day", "worst_rolling_1y_sharpe", "out_of_pool_weight_max"}
    rows = [(g["gate"], g["state"], k, float(v) if v is not None else None) for g in judged for k, v in g["numbers"].items() if k not in left_out and (v is None or isinstance(v, (int, float))) and k not in ("region_hash", "region_hash_canonical", "region_hash_match", "deps_tc_resolved", "worst_year")]
    return spark.createDataFrame(rows, "gate string, state string, fact string, value double").withColumn("value", r("value", 4))
