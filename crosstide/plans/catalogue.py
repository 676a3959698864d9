"""The registered queries, each with independent DuckDB SQL where SQL can say it.

Numbers are rounded alike on both sides: six digits, two for amounts of money.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions import scalar as s
from crosstide.operators import cross_section as cs
from crosstide.operators import events as evt
from crosstide.operators import ledger
from crosstide.operators import metrics as m
from crosstide.operators import time_series as ts
from crosstide.operators.chain import weights
from crosstide.plans import demo
from crosstide.sources import panels

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

CHAIN = [("rank", None), ("neutralize", "g"), ("linear_decay", 3), ("truncate", 0.02), ("scale", "book")]


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(s.col(c).cast("double"), digits) + F.lit(0.0)


def _cells(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(F.col("di").cast("int").alias("di"), F.col("ii").cast("long").alias("ii"), *[r(c, digits).alias(c) for c in columns])


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ SQL fragments
EV = "ev AS (SELECT CAST(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) AS INTEGER) AS di, user_id AS ii, sum(value) AS x, count(*) AS n FROM events GROUP BY 1, 2)"
EVG = EV + """, evg AS (SELECT d.di, u.ii, e.x, e.n, CASE WHEN u.ii % 11 = 0 THEN NULL ELSE u.ii % 5 END AS g
  FROM (SELECT unnest(generate_series(0, (SELECT max(di) FROM ev)))::INTEGER AS di) d CROSS JOIN (SELECT DISTINCT ii FROM ev) u LEFT JOIN ev e ON e.di = d.di AND e.ii = u.ii)"""
EVP = EVG + """, m5 AS (SELECT *, avg(x) OVER (PARTITION BY ii ORDER BY di ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM evg),
evp AS (SELECT di, ii, x, g, coalesce(m IS NOT NULL AND (SELECT count(*) FROM m5 b WHERE b.di = a.di AND b.m > a.m) + ((SELECT count(*) FROM m5 b WHERE b.di = a.di AND b.m = a.m) + 1) / 2.0 <= 100, false) AS in_pool FROM m5 a)"""
SP = """sp0 AS (SELECT year(l_shipdate) * 12 + month(l_shipdate) AS m, l_suppkey AS ii, sum(l_extendedprice) / sum(l_quantity) AS px, sum(l_quantity) AS vol FROM lineitem GROUP BY 1, 2),
sp AS (SELECT CAST(m - (SELECT min(m) FROM sp0) AS INTEGER) AS di, ii, px, vol FROM sp0)"""
SPG = SP + """, spg0 AS (SELECT d.di, u.ii, p.px, p.vol FROM (SELECT unnest(generate_series(0, (SELECT max(di) FROM sp)))::INTEGER AS di) d CROSS JOIN (SELECT DISTINCT ii FROM sp) u LEFT JOIN sp p ON p.di = d.di AND p.ii = u.ii),
spg AS (SELECT *, px / nullif(lag(px) OVER (PARTITION BY ii ORDER BY di), 0) - 1 AS ret FROM spg0)"""
#: Ranks of v in table t by di, ties averaged, spread over [-0.5, 0.5].
RANK = """CASE WHEN {v} IS NULL THEN NULL WHEN count({v}) OVER (PARTITION BY di) <= 1 THEN 0.0 ELSE
  (rank() OVER (PARTITION BY di, {v} IS NULL ORDER BY {v}) + (count(*) OVER (PARTITION BY di, {v}) - 1) / 2.0 - 1) / (count({v}) OVER (PARTITION BY di) - 1) - 0.5 END"""
BOOK_CTE = SPG + f""", mom AS (SELECT *, -(px / nullif(lag(px, 3) OVER (PARTITION BY ii ORDER BY di), 0) - 1) AS v FROM spg),
rk AS (SELECT *, {RANK.format(v='v')} AS k FROM mom),
book AS (SELECT *, coalesce(k / nullif(sum(abs(k)) OVER (PARTITION BY di), 0), 0.0) AS w FROM rk)"""
LEDGER = BOOK_CTE + """, tgt AS (SELECT *, coalesce(w / nullif(sum(abs(w)) OVER (PARTITION BY di), 0), 0) * 1e6 AS pos FROM book),
prv AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY ii ORDER BY di), 0) AS prev FROM tgt),
hpn AS (SELECT *, prev * coalesce(ret, 0) AS hp FROM prv),
dlt AS (SELECT *, pos - prev - hp AS delta FROM hpn),
cells AS (SELECT *, abs(delta) * 0.001 AS cost, hp - abs(delta) * 0.001 AS pnl FROM dlt),
daily AS (SELECT di, sum(greatest(pos, 0)) AS long_value, sum(least(pos, 0)) AS short_value, sum(abs(delta)) AS trade_dollar, sum(hp) AS holding_pnl, sum(cost) AS cost, sum(pnl) AS pnl, sum(pnl) / 1e6 AS ret,
  sum(sum(-(delta + cost))) OVER (ORDER BY di) AS cash_account, sum(pos) AS net, avg(cells.ret) AS market_ret, sum((pos > 0)::INT) AS long_count, sum((pos < 0)::INT) AS short_count FROM cells GROUP BY di)"""
S_LINES = "splits AS (SELECT o_custkey % (SELECT count(*) FROM supplier) AS ii, CAST(o_orderdate AS DATE) AS ex_date, CAST(1 + (o_orderkey % 5) / 50.0 AS DOUBLE) AS ratio, o_orderkey AS event FROM orders)"
B_LINES = "bars AS (SELECT l_suppkey AS ii, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / nullif(sum(l_quantity), 0) AS close FROM lineitem GROUP BY 1, 2)"


def q(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


def rs(e: str, alias: str, digits: int = 6) -> str:
    return f"(round(CAST({e} AS DOUBLE), {digits}) + 0.0) AS {alias}"


# ------------------------------------------------------------------ panels and joins
@register(q(EVG, f"SELECT di, ii, {rs('x', 'x')} FROM evg"))
def panel_grid_align(spark, d):
    """A sparse panel on the whole axes."""
    return _cells(panels.aligned(demo.ev_panels(spark, d), demo.EV_X).withColumnRenamed("value", "x"), "x")


@register(q(EV, f"SELECT di, ii, {rs('x', 'x')} FROM ev WHERE di BETWEEN 5 AND 20"))
def panel_range(spark, d):
    """Sessions 5 to 20 by their dates."""
    store = demo.ev_panels(spark, d)
    return _cells(store.read(demo.EV_X, store.axes.date(5), store.axes.date(20)).withColumnRenamed("value", "x"), "x")


@register(q(EV, f"SELECT di, ii, {rs('x', 'x')} FROM ev WHERE di > (SELECT max(di) FROM ev) - 3"))
def panel_tail(spark, d):
    return _cells(demo.ev_panels(spark, d).tail(demo.EV_X, 3).withColumnRenamed("value", "x"), "x")


@register(q(EVP, "SELECT di, ii, in_pool FROM evp"))
def universe_top_n(spark, d):
    return demo.ev_pool(spark, d).select(F.col("di").cast("int").alias("di"), "ii", "in_pool")


@register(q(EV, "SELECT 'g_demo.field_demo_ev.x' AS ref, 'di,ii' AS dims, 'f8' AS dtype, 1 AS version, min(di) AS first_session, max(di) AS last_session, CAST(count(DISTINCT ii) AS INTEGER) AS n_cols_covered FROM ev"))
def panel_coverage(spark, d):
    """The catalog's row of a panel: extent and names covered."""
    return demo.ev_panels(spark, d).catalog().where(F.col("ref") == demo.EV_X).select("ref", "dims", "dtype", "version", "first_session", "last_session", "n_cols_covered")


# ------------------------------------------------------------------ cross-sections
@register(q(EVG, f"SELECT di, ii, {rs(RANK.format(v='x'), 'y')} FROM evg"))
def cs_rank(spark, d):
    return _cells(cs.rank(demo.ev_grid(spark, d), "x", "y"), "y")


@register(q(EVG, f"SELECT di, ii, {rs('x - avg(x) OVER (PARTITION BY di, g)', 'y')} FROM evg"))
def cs_neutralize(spark, d):
    return _cells(cs.neutralize(demo.ev_grid(spark, d), "x", "g", "y"), "y")


@register(q(EVG, f"SELECT di, ii, {rs('x - avg(x) OVER (PARTITION BY di)', 'y')} FROM evg"))
def cs_demean(spark, d):
    return _cells(cs.demean(demo.ev_grid(spark, d), "x", "y"), "y")


@register(q(EVG, f"SELECT di, ii, {rs('CASE WHEN stddev_samp(x) OVER w > 0 THEN (x - avg(x) OVER w) / stddev_samp(x) OVER w ELSE x * 0 END', 'y')} FROM evg WINDOW w AS (PARTITION BY di)"))
def cs_zscore(spark, d):
    return _cells(cs.zscore(demo.ev_grid(spark, d), "x", "y"), "y")


@register(q(EVG, f"SELECT di, ii, CASE WHEN x IS NULL THEN NULL ELSE {rs('greatest(-0.01 * sum(abs(x)) OVER w, least(x, 0.01 * sum(abs(x)) OVER w))', 'y').removesuffix(' AS y')} END AS y FROM evg WINDOW w AS (PARTITION BY di)"))
def cs_truncate(spark, d):
    return _cells(cs.truncate(demo.ev_grid(spark, d), "x", 0.01, "y"), "y")


@register(q(EVP, f"SELECT di, ii, {rs('coalesce(CASE WHEN in_pool THEN x END / nullif(sum(abs(CASE WHEN in_pool THEN x END)) OVER (PARTITION BY di), 0), 0)', 'w')} FROM evp"))
def cs_scale_gate(spark, d):
    return _cells(cs.scale(demo.ev_pool(spark, d), "x", "in_pool", "w"), "w")


@register(q(EV, f"SELECT di, {rs('sum(abs(x))', 'gross')} FROM ev GROUP BY di"))
def cs_gross(spark, d):
    e = demo.ev(spark, d).withColumn("gross", cs.gross("x"))
    return e.groupBy(F.col("di").cast("int").alias("di")).agg(r(F.max("gross")).alias("gross"))


# ------------------------------------------------------------------ time series
@register(q(EVG, f"SELECT a.di, a.ii, {rs('b.x', 'y')} FROM evg a LEFT JOIN evg b ON b.ii = a.ii AND b.di = a.di - 2"))
def ts_delay(spark, d):
    return _cells(demo.ev_grid(spark, d).withColumn("y", ts.delay("x", 2)), "y")


@register(q(EVG, f"SELECT a.di, a.ii, {rs('sum(b.x * (5 - (a.di - b.di))) / nullif(sum(CASE WHEN b.x IS NOT NULL THEN 5 - (a.di - b.di) END), 0)', 'y')} FROM evg a JOIN evg b ON b.ii = a.ii AND b.di BETWEEN a.di - 4 AND a.di GROUP BY a.di, a.ii"))
def ts_linear_decay(spark, d):
    return _cells(demo.ev_grid(spark, d).withColumn("y", ts.linear_decay("x", 5)), "y")


@register(q(EVG, f"SELECT a.di, a.ii, {rs('sum(b.x * pow(0.5, (a.di - b.di) / 3.0)) / nullif(sum(CASE WHEN b.x IS NOT NULL THEN pow(0.5, (a.di - b.di) / 3.0) END), 0)', 'y')} FROM evg a JOIN evg b ON b.ii = a.ii AND b.di <= a.di GROUP BY a.di, a.ii"))
def ts_exp_decay(spark, d):
    return _cells(ts.exp_decay(demo.ev_grid(spark, d), "x", 3, "y"), "y")


LONG = """dd AS (SELECT CAST(date_diff('day', (SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem), CAST(l_shipdate AS DATE)) AS INTEGER) AS di, l_suppkey % 7 AS ii, sum(l_quantity) AS x FROM lineitem WHERE CAST(l_shipdate AS DATE) < DATE '1995-03-01' OR CAST(l_shipdate AS DATE) > DATE '2001-09-01' GROUP BY 1, 2),
dg AS (SELECT t.di, u.ii, dd.x FROM (SELECT unnest(generate_series(0, (SELECT max(di) FROM dd)))::INTEGER AS di) t CROSS JOIN (SELECT DISTINCT ii FROM dd) u LEFT JOIN dd ON dd.di = t.di AND dd.ii = u.ii),
lo AS (SELECT di, ii, last_value(CASE WHEN x IS NOT NULL THEN di END IGNORE NULLS) OVER (PARTITION BY ii ORDER BY di) AS seen FROM dg)"""


@register(q(LONG, f"SELECT a.di, a.ii, {rs('sum(b.x * pow(0.5, (a.seen - b.di) / 1.0)) / nullif(sum(pow(0.5, (a.seen - b.di) / 1.0)), 0)', 'y')} FROM lo a LEFT JOIN dd b ON b.ii = a.ii AND b.di <= a.seen AND b.di > a.seen - 200 GROUP BY a.di, a.ii"))
def ts_exp_decay_long(spark, d):
    """Half-life 1 over an axis of 2,500 sessions whose middle years have no value: the last values stand."""
    items = demo.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date"), (F.col("l_suppkey") % 7).alias("ii"), "l_quantity")
    first = items.agg(F.min("date").alias("first"))
    ends = items.where((F.col("date") < F.lit("1995-03-01").cast("date")) | (F.col("date") > F.lit("2001-09-01").cast("date")))
    days = ends.crossJoin(F.broadcast(first)).groupBy(F.date_diff("date", "first").alias("di"), "ii").agg(F.sum("l_quantity").alias("x"))  # one row
    return _cells(ts.exp_decay(demo.dense(days), "x", 1, "y"), "y")


@register(q(SPG, f"SELECT di, ii, {rs('px / nullif(lag(px, 6) OVER (PARTITION BY ii ORDER BY di), 0) - 1', 'y')} FROM spg"))
def ts_momentum(spark, d):
    return _cells(demo.sp_grid(spark, d).withColumn("y", ts.momentum("px", 6)), "y")


@register(q(SPG, f"SELECT di, ii, {rs('-(px / nullif(lag(px, 3) OVER (PARTITION BY ii ORDER BY di), 0) - 1) / nullif(stddev_samp(ret) OVER (PARTITION BY ii ORDER BY di ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) * sqrt(252), 0)', 'y')} FROM spg"))
def ts_reversal_volnorm(spark, d):
    frame = demo.sp_grid(spark, d).withColumns({"_m": ts.momentum("px", 3), "_v": ts.deviation("ret", 12)})
    return _cells(frame.withColumn("y", s.safe_div(-F.col("_m"), F.col("_v") * math.sqrt(252))), "y")


@register(q(SPG, f"SELECT di, ii, {rs('avg(px * vol) OVER (PARTITION BY ii ORDER BY di ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)', 'y')} FROM spg"))
def ts_adv20(spark, d):
    return _cells(demo.sp_grid(spark, d).withColumn("_v", F.col("px") * F.col("vol")).withColumn("y", ts.mean("_v", 20)), "y")


@register(q(SPG, f"SELECT di, ii, {rs('avg(abs(ret) / nullif(px * vol, 0)) OVER (PARTITION BY ii ORDER BY di ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * 1e6', 'y')} FROM spg"))
def ts_illiq20(spark, d):
    frame = demo.sp_grid(spark, d).withColumn("_v", s.safe_div(F.abs("ret"), F.col("px") * F.col("vol")))
    return _cells(frame.withColumn("y", ts.mean("_v", 20) * 1e6), "y")


@register(q(SPG, f"SELECT di, ii, {rs('stddev_samp(ret) OVER (PARTITION BY ii ORDER BY di ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(252)', 'y')} FROM spg"))
def ts_rvol20(spark, d):
    return _cells(demo.sp_grid(spark, d).withColumn("y", ts.deviation("ret", 20) * math.sqrt(252)), "y")


@register(q(EVG, f"SELECT di, ii, CASE WHEN count(x) OVER w >= 8 THEN {rs('avg(x) OVER w', 'y').removesuffix(' AS y')} END AS y FROM evg WINDOW w AS (PARTITION BY ii ORDER BY di ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"))
def ts_rolling_min_periods(spark, d):
    return _cells(demo.ev_grid(spark, d).withColumn("y", ts.mean("x", 10, 8)), "y")


@register(q(EVG, f"SELECT di, ii, {rs('x / nullif(lag(x) OVER (PARTITION BY ii ORDER BY di), 0) - 1', 'y')} FROM evg"))
def ts_pct_change(spark, d):
    return _cells(demo.ev_grid(spark, d).withColumn("y", ts.pct_change("x")), "y")


@register(q(EVG, f"SELECT di, ii, {rs('coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY ii ORDER BY di ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)', 'y')} FROM evg"))
def ts_ffill(spark, d):
    return _cells(demo.ev_grid(spark, d).withColumn("y", F.coalesce(ts.forward_fill("x"), F.lit(0.0))), "y")


@register(q(EVG, f"SELECT di, ii, {rs('median(x) OVER (PARTITION BY ii ORDER BY di ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 'y')} FROM evg"))
def ts_rolling_median(spark, d):
    return _cells(demo.ev_grid(spark, d).withColumn("y", ts.median("x", 7)), "y")


RUNS = EVG + """, isl AS (SELECT *, row_number() OVER (PARTITION BY ii ORDER BY di) - row_number() OVER (PARTITION BY ii, x IS NULL ORDER BY di) AS k FROM evg),
runs AS (SELECT *, CASE WHEN x IS NULL THEN count(*) OVER (PARTITION BY ii, x IS NULL, k) END AS run FROM isl)"""


@register(q(RUNS, "SELECT di, ii, coalesce(run >= 2, false) AS halted FROM runs"))
def halt_proxy_runs(spark, d):
    return ts.halted_by_proxy(demo.ev_grid(spark, d), "x", 2).select(F.col("di").cast("int").alias("di"), "ii", "halted")


@register(q(RUNS, "SELECT run AS run_length, CAST(count(*) / run AS BIGINT) AS runs FROM runs WHERE run IS NOT NULL GROUP BY run"))
def nan_run_histogram(spark, d):
    return ts.run_length_histogram(demo.ev_grid(spark, d), "x")


@register(q(EVG, "SELECT di, ii FROM (SELECT di, ii, x IS NULL AS f, coalesce(bool_or(x IS NULL) OVER (PARTITION BY ii ORDER BY di ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS b FROM evg) WHERE f AND NOT b"))
def first_occurrence(spark, d):
    return demo.ev_grid(spark, d).withColumn("_f", ts.first_time(F.col("x").isNull())).where("_f").select(F.col("di").cast("int").alias("di"), "ii")


# ------------------------------------------------------------------ chains
ALPHA = EVP + f""", c0 AS (SELECT di, ii, g, in_pool, CASE WHEN in_pool THEN x END AS v FROM evp),
c1 AS (SELECT *, {RANK.format(v='v')} AS a FROM c0),
c2 AS (SELECT *, a - avg(a) OVER (PARTITION BY di, g) AS b FROM c1),
c3 AS (SELECT p.di, p.ii, any_value(p.in_pool) AS in_pool, sum(h.b * (3 - (p.di - h.di))) / nullif(sum(CASE WHEN h.b IS NOT NULL THEN 3 - (p.di - h.di) END), 0) AS e FROM c2 p JOIN c2 h ON h.ii = p.ii AND h.di BETWEEN p.di - 2 AND p.di GROUP BY p.di, p.ii),
c4 AS (SELECT *, CASE WHEN e IS NULL THEN NULL WHEN coalesce(sum(abs(e)) OVER (PARTITION BY di), 0) <= 0 THEN e ELSE greatest(-0.02 * sum(abs(e)) OVER (PARTITION BY di), least(e, 0.02 * sum(abs(e)) OVER (PARTITION BY di))) END AS t FROM c3),
c5 AS (SELECT *, CASE WHEN in_pool THEN t END AS u FROM c4)
SELECT di, ii, (round(coalesce(CASE WHEN coalesce(sum(abs(u)) OVER (PARTITION BY di), 0) > 0 THEN u / sum(abs(u)) OVER (PARTITION BY di) ELSE u END, 0), 6) + 0.0) AS w FROM c5"""


@register("WITH " + ALPHA)
def alpha_chain_full(spark, d):
    out = weights(demo.ev_pool(spark, d).withColumn("w", F.col("x")), "w", CHAIN, "in_pool", 0, 29)
    return _cells(out, "w")


@register(q(EVG, f"""SELECT di, ii, (round(coalesce(y / nullif(sum(abs(y)) OVER (PARTITION BY di), 0), 0), 6) + 0.0) AS w FROM (
  SELECT di, ii, 0.6 * a + 0.4 * b AS y FROM (SELECT di, ii, {RANK.format(v='x')} AS a, x - avg(x) OVER (PARTITION BY di, g) AS b0, (x - avg(x) OVER (PARTITION BY di, g)) / nullif(sum(abs(x)) OVER (PARTITION BY di), 0) AS b FROM evg))"""))
def alpha_combo_mix(spark, d):
    grid = demo.ev_grid(spark, d).withColumn("_gross", cs.gross("x"))
    grid = cs.neutralize(cs.rank(grid, "x", "_a"), "x", "g", "_b")
    mixed = grid.withColumn("w", 0.6 * F.col("_a") + 0.4 * s.safe_div("_b", "_gross"))
    return _cells(cs.scale(mixed, "w"), "w")


@register(q(EVG, f"SELECT di, ii, (round(coalesce(y / nullif(sum(abs(y)) OVER (PARTITION BY di), 0), 0), 6) + 0.0) AS w FROM (SELECT a.di, a.ii, b.x AS y FROM evg a LEFT JOIN evg b ON b.ii = a.ii AND b.di = a.di - 3)"))
def chain_delay_twice(spark, d):
    return _cells(weights(demo.ev_grid(spark, d).withColumn("w", F.col("x")), "w", [("delay", 1), ("delay", 2), ("scale", None)]), "w")


# ------------------------------------------------------------------ ledger and metrics
@register(q(LEDGER, f"SELECT di, ii, {rs('prev', 'prev', 2)}, {rs('hp', 'hp', 2)}, {rs('delta', 'delta', 2)}, {rs('cost', 'cost', 2)}, {rs('pos', 'pos', 2)}, {rs('pnl', 'pnl', 2)} FROM cells"))
def ledger_fast(spark, d):
    return _cells(ledger.fast_cells(demo.sp_book(spark, d), demo.BOOK, 10.0), "prev", "hp", "delta", "cost", "pos", "pnl", digits=2)


@register(q(LEDGER, "SELECT di, " + ", ".join(rs(c, c, 2) for c in ("long_value", "short_value", "trade_dollar", "holding_pnl", "cost", "pnl", "cash_account")) + f", {rs('net + cash_account', 'nav', 2)} FROM daily"))
def ledger_daily(spark, d):
    daily = ledger.fast_daily(ledger.fast_cells(demo.sp_book(spark, d), demo.BOOK, 10.0), demo.BOOK)
    return daily.select(F.col("di").cast("int").alias("di"), *[r(c, 2).alias(c) for c in ("long_value", "short_value", "trade_dollar", "holding_pnl", "cost", "pnl", "cash_account", "nav")])


@register(q(LEDGER, f"SELECT di, {rs('net + cash_account', 'nav', 2)}, {rs('sum(pnl) OVER (ORDER BY di)', 'cum_pnl', 2)} FROM daily"))
def ledger_nav_identity(spark, d):
    daily = ledger.fast_daily(ledger.fast_cells(demo.sp_book(spark, d), demo.BOOK, 10.0), demo.BOOK)
    total = F.sum("pnl").over(Window.orderBy("di"))  # over one row per session
    return daily.select(F.col("di").cast("int").alias("di"), r("nav", 2).alias("nav"), r(total, 2).alias("cum_pnl"))


#: Metrics of a set of sessions in SQL, by name.
COMMON = {
    "sharpe": "avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252)", "ann_return": "avg(ret) * 252", "turnover": "avg(trade_dollar) / 1e6", "margin_bps": "sum(pnl) / nullif(sum(trade_dollar), 0) * 1e4", "cost_share_of_gross": "sum(cost) / nullif(sum(holding_pnl), 0)",
    "avg_long_value": "avg(long_value)", "avg_short_value": "avg(short_value)", "avg_long_count": "avg(long_count)", "avg_short_count": "avg(short_count)", "long_short_ratio": "avg(long_value) / nullif(-avg(short_value), 0)", "return_std_daily": "stddev_samp(ret)", "hit_rate": "avg((pnl > 0)::INT)",
}
SCALAR = COMMON | {
    "fitness": f"{COMMON['sharpe']} * sqrt(abs({COMMON['ann_return']}) / greatest({COMMON['turnover']}, 0.125))", "ann_return_dollar": "avg(ret) * 252 * 1e6", "ann_return_long_side": "avg(ret) * 252 * 1e6 / nullif(avg(long_value), 0)", "pnl_total": "sum(pnl)", "holding_pnl_total": "sum(holding_pnl)",
    "cost_total": "sum(cost)", "trade_dollar_total": "sum(trade_dollar)", "net_share_of_gross": "sum(pnl) / nullif(sum(holding_pnl), 0)",
}
PERIOD = COMMON | {"pnl": "sum(pnl)", "holding_pnl": "sum(holding_pnl)", "cost": "sum(cost)", "trade_dollar": "sum(trade_dollar)", "long_share": "avg(long_value) / nullif(avg(long_value) + abs(avg(short_value)), 0)"}
_money = lambda c: 2 if c in ("avg_long_value", "avg_short_value", "ann_return_dollar", "pnl_total", "holding_pnl_total", "cost_total", "trade_dollar_total", "pnl", "holding_pnl", "cost", "trade_dollar") else 6


@register(q(LEDGER, "SELECT count(*) AS n_days, " + ", ".join(rs(e, c, _money(c)) for c, e in SCALAR.items()) + " FROM daily"))
def metrics_scalar(spark, d):
    """All metrics of the whole run."""
    return m.scalars(demo.sp_daily(spark, d), demo.BOOK).select("n_days", *[r(c, _money(c)).alias(c) for c in SCALAR])


@register(q(LEDGER + """, dated AS (SELECT *, strftime(DATE '1995-01-01' + to_months(di), '%Y') AS y, strftime(DATE '1995-01-01' + to_months(di), '%Y-%m') AS ym FROM daily),
lv AS (SELECT unnest(['all', y, ym]) AS period, di, pnl FROM dated), cm AS (SELECT period, di, sum(pnl) OVER (PARTITION BY period ORDER BY di) AS c FROM lv), fl AS (SELECT period, -min(c - p) AS f FROM (SELECT period, c, greatest(max(c) OVER (PARTITION BY period ORDER BY di), 0) AS p FROM cm) GROUP BY period)""",
    "SELECT k.*, f.max_drawdown FROM (SELECT coalesce(ym, y, 'all') AS period, count(*) AS days, " + ", ".join(rs(e, c, _money(c)) for c, e in PERIOD.items()) + f" FROM dated GROUP BY GROUPING SETS ((), (y), (y, ym))) k JOIN (SELECT period, {rs('f / 1e6', 'max_drawdown')} FROM fl) f USING (period)"))
def metrics_grouping_sets(spark, d):
    """All fields of the run's, the years' and the months' records."""
    return m.periods(demo.sp_daily(spark, d), demo.BOOK).select("period", "days", *[r(c, _money(c)).alias(c) for c in PERIOD], r("max_drawdown").alias("max_drawdown"))


@register(q(LEDGER + ", cum AS (SELECT di, sum(pnl) OVER (ORDER BY di) AS c FROM daily), pk AS (SELECT di, c, greatest(max(c) OVER (ORDER BY di), 0) AS p FROM cum), tr AS (SELECT min(c - p) AS dd FROM pk), tt AS (SELECT min(di) AS t FROM pk, tr WHERE c - p = dd)", f"SELECT {rs('-(SELECT dd FROM tr)', 'max_drawdown', 2)}, (SELECT min(di) FROM pk WHERE di <= (SELECT t FROM tt) AND c = (SELECT max(c) FROM pk WHERE di <= (SELECT t FROM tt))) AS from_di, (SELECT t FROM tt) AS to_di"))
def drawdown(spark, d):
    return m.drawdown(demo.sp_daily(spark, d)).select(r("max_drawdown", 2).alias("max_drawdown"), F.col("from_di").cast("int").alias("from_di"), F.col("to_di").cast("int").alias("to_di"))


@register(q(LEDGER, f"SELECT di, CASE WHEN count(ret) OVER w = 24 THEN {rs('avg(ret) OVER w / nullif(stddev_samp(ret) OVER w, 0) * sqrt(252)', 'y').removesuffix(' AS y')} END AS rolling_sharpe FROM daily WINDOW w AS (ORDER BY di ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"))
def rolling_sharpe(spark, d):
    return m.rolling_sharpe(demo.sp_daily(spark, d), 24).select(F.col("di").cast("int").alias("di"), r("rolling_sharpe").alias("rolling_sharpe"))


@register(q(LEDGER + ", ok AS (SELECT ret AS y, market_ret AS x FROM daily WHERE market_ret IS NOT NULL), b AS (SELECT count(*) AS n_obs, regr_slope(y, x) AS beta, regr_r2(y, x) AS r2 FROM ok)", f"SELECT n_obs, {rs('beta', 'beta')}, {rs('r2', 'r2')}, {rs('(SELECT avg(y - beta * x) / stddev_samp(y - beta * x) * sqrt(252) FROM ok)', 'sharpe_hedged')} FROM b"))
def beta_gate(spark, d):
    return m.regression(demo.sp_daily(spark, d)).select("n_obs", r("beta").alias("beta"), r("r2").alias("r2"), r("sharpe_hedged").alias("sharpe_hedged"))


@register(q(LEDGER + ", nm AS (SELECT ii, abs(sum(pnl)) AS p, row_number() OVER (ORDER BY abs(sum(pnl)) DESC, ii) AS k FROM cells GROUP BY ii)", f"SELECT {rs('sum(p)', 'total_abs_pnl', 2)}, {rs('sum(CASE WHEN k <= 1 THEN p END) / sum(p)', 'top1_share')}, {rs('sum(CASE WHEN k <= 5 THEN p END) / sum(p)', 'top5_share')}, {rs('sum(CASE WHEN k <= 20 THEN p END) / sum(p)', 'top20_share')}, {rs('(SELECT max(abs(pnl)) / sum(abs(pnl)) FROM daily)', 'top1_day_share')} FROM nm"))
def concentration_topk(spark, d):
    cells = ledger.fast_cells(demo.sp_book(spark, d), demo.BOOK, 10.0)
    out = m.concentration(cells, demo.sp_daily(spark, d))
    return out.select(r("total_abs_pnl", 2).alias("total_abs_pnl"), *[r(c).alias(c) for c in ("top1_share", "top5_share", "top20_share", "top1_day_share")])


@register(q(LEDGER, f"SELECT {rs('sum(cost)', 'cost_total', 2)}, {rs('sum(pnl) + sum(cost)', 'pnl_gross', 2)}, {rs('(sum(pnl) + sum(cost)) / nullif(sum(cost), 0)', 'breakeven_cost')} FROM daily"))
def breakeven(spark, d):
    return m.breakeven(demo.sp_daily(spark, d)).select(r("cost_total", 2).alias("cost_total"), r("pnl_gross", 2).alias("pnl_gross"), r("breakeven_cost").alias("breakeven_cost"))


@register(q(LEDGER + ", pl AS (SELECT ret, row_number() OVER (ORDER BY di) <= (SELECT count(*) FROM daily) // 2 AS a FROM daily)", f"SELECT {rs('avg(ret) FILTER (a) / nullif(stddev_samp(ret) FILTER (a), 0) * sqrt(252)', 'sharpe_first_half')}, {rs('avg(ret) FILTER (NOT a) / nullif(stddev_samp(ret) FILTER (NOT a), 0) * sqrt(252)', 'sharpe_second_half')} FROM pl"))
def stability_halves(spark, d):
    return m.halves(demo.sp_daily(spark, d)).select(r("sharpe_first_half").alias("sharpe_first_half"), r("sharpe_second_half").alias("sharpe_second_half"))


@register(q(SPG, f"SELECT di, {rs('avg(ret)', 'market_ret')} FROM spg GROUP BY di"))
def market_return(spark, d):
    from crosstide.plans import base

    out = base.market_return(demo.sp_grid(spark, d).withColumnRenamed("ret", "ret_1d"))
    return out.select(F.col("di").cast("int").alias("di"), r("value").alias("market_ret"))


# ------------------------------------------------------------------ stores and streams
@register(q(EV, f"SELECT di, ii, {rs('CASE WHEN di BETWEEN 10 AND 12 THEN 2 * x ELSE x END', 'value')} FROM ev"))
def store_upsert(spark, d):
    """ev written to a store, three sessions written again with doubled values, read back."""
    store, e = _store(spark, d)
    rows = e.select("di", F.col("ii").cast("int").alias("ii"), F.col("x").alias("value"))
    ref = "g_demo.field_demo_ev.x"
    store.write(ref, rows, dtype="f8")
    store.write(ref, rows.where(F.col("di").between(10, 12)).withColumn("value", F.col("value") * 2), dtype="f8")
    return _cells(store.read(ref), "value")


def _store(spark, d):
    from crosstide.sources import files
    from crosstide.sources.panels import Store

    e = demo.ev(spark, d)
    store = Store(spark, files.scratch(spark, "store"))
    last = e.agg(F.max("di")).first()[0]
    days = [str(x[0]) for x in spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.date_add(F.lit("2024-01-01").cast("date"), last)))).collect()]  # the axis
    store.create_axes(days, [x["ii"] for x in e.select("ii").distinct().orderBy("ii").collect()])  # the axis
    return store, e


@register(q(EV, f"SELECT di, ii, {rs('x', 'x')}, n FROM ev"))
def psv_roundtrip(spark, d):
    """ev as pipe files and back through the strict reader."""
    from crosstide.sources import files, pipe

    path = files.scratch(spark, "psv")
    pipe.write_pipe(demo.ev(spark, d).select("di", "ii", F.format_string("%.10f", "x").alias("x"), "n"), path)
    return pipe.read_pipe(spark, path, "di int, ii bigint, x double, n bigint").select("di", "ii", r("x").alias("x"), "n")


@register("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, user_id AS ii, (round(sum(value), 6) + 0.0) AS x FROM events WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY 1, 2")
def stream_daily_upsert(spark, d):
    """events as a stream of files to a panel, days that the watermark has passed."""
    from crosstide.sources import files
    from crosstide.sources.panels import Store
    from crosstide.streaming import daily

    root = files.scratch(spark, "stream")
    table = demo.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    store = Store(spark, f"{root}/store")
    store.create_axes([], [])
    stream = spark.readStream.schema(demo.table(spark, d, "events").schema).parquet(f"{d}/events.parquet*").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    assert stream.schema == table.schema
    daily.upsert_daily(daily.daily_totals(stream), store, "g_demo.field_demo_stream.x", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = store.read("g_demo.field_demo_stream.x").join(store.axes.session_table(), "di")
    return out.select(F.col("date").cast("string").alias("date"), F.col("ii").cast("long").alias("ii"), r("value").alias("x"))


@register(q(EVG, f"SELECT a.di, a.ii, {rs('sum(b.x * pow(0.5, (a.di - b.di) / 3.0)) / nullif(sum(CASE WHEN b.x IS NOT NULL THEN pow(0.5, (a.di - b.di) / 3.0) END), 0)', 'y')} FROM evg a JOIN evg b ON b.ii = a.ii AND b.di <= a.di WHERE a.x IS NOT NULL GROUP BY a.di, a.ii"))
def stream_exp_decay(spark, d):
    """ev's sessions as a stream; the decay's two sums are kept per name between batches."""
    from crosstide.sources import files
    from crosstide.streaming import daily

    root = files.scratch(spark, "decay")
    # One file per ten sessions, in their order: a batch reads one file.
    for k, (a, b) in enumerate([(0, 9), (10, 19), (20, 1 << 20)]):
        demo.ev(spark, d).where(F.col("di").between(a, b)).select("di", "ii", "x").coalesce(1).write.mode("append").parquet(f"{root}/in/part={k}")
    batches = spark.readStream.schema("di int, ii bigint, x double").option("maxFilesPerTrigger", 1).parquet(f"{root}/in/part=*")
    daily.streaming_exp_decay(batches, 3).writeStream.outputMode("append").option("checkpointLocation", f"{root}/checkpoint").format("parquet").option("path", f"{root}/out").trigger(availableNow=True).start().awaitTermination()
    return _cells(spark.read.parquet(f"{root}/out"), "y")


# ------------------------------------------------------------------ events and reference data
@register(f"WITH {S_LINES}, {B_LINES} SELECT s.event, {rs('(SELECT max_by(close, date) FROM bars b WHERE b.ii = s.ii AND b.date < s.ex_date)', 'before', 9)}, {rs('(SELECT min_by(close, date) FROM bars b WHERE b.ii = s.ii AND b.date >= s.ex_date)', 'after', 9)} FROM splits s")
def asof_prev_next(spark, d):
    return evt.as_of(demo.splits(spark, d), demo.bars(spark, d), "ii", "close").select("event", r("before", 9).alias("before"), r("after", 9).alias("after"))


@register(f"WITH {S_LINES}, {B_LINES}, p AS (SELECT event, ii, ratio, (SELECT max_by(close, date) FROM bars b WHERE b.ii = s.ii AND b.date < s.ex_date) / nullif((SELECT min_by(close, date) FROM bars b WHERE b.ii = s.ii AND b.date >= s.ex_date), 0) AS j FROM splits s) SELECT event, CASE WHEN j IS NULL THEN true ELSE abs(ln(j)) <= abs(ln(j / ratio)) END AS vendor_applied FROM p")
def split_classify(spark, d):
    return evt.classify_splits(demo.splits(spark, d), demo.bars(spark, d)).select("event", "vendor_applied")


@register(f"WITH {S_LINES}, {B_LINES} SELECT b.ii, CAST(b.date AS VARCHAR) AS date, {rs('coalesce((SELECT product(ratio) FROM splits s WHERE s.ii = b.ii AND s.ex_date > b.date), 1)', 'factor')} FROM bars b")
def theta_future_product(spark, d):
    out = evt.later_product(demo.bars(spark, d), demo.splits(spark, d).where("ratio > 0"), "ii", "ratio", "factor")
    return out.select("ii", F.col("date").cast("string").alias("date"), r("factor").alias("factor"))


@register(q(SPG, f"SELECT di, ii, {rs('coalesce((SELECT product(1 + b.ret / 10) FROM spg b WHERE b.ii = a.ii AND b.di > a.di AND b.ret IS NOT NULL), 1)', 'y')} FROM spg a"))
def reverse_cumprod(spark, d):
    frame = demo.sp_grid(spark, d).withColumn("_f", 1 + F.col("ret") / 10)
    return _cells(frame.withColumn("y", ts.future_product("_f")), "y")


#: Constituents are customers, the exchange's list is the suppliers, filings are nations by turns; keys differ in their separators.
REF = """cons AS (SELECT c_custkey, 'K.' || c_custkey AS sym, c_name AS sec, ['Energy', 'Materials', 'Utilities'][c_nationkey % 3 + 1] AS sector, c_mktsegment AS sub, CASE WHEN c_custkey % 10 = 0 THEN 'soon' WHEN c_custkey % 10 = 1 THEN NULL ELSE '03/' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') || '/2001' END AS added, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey::VARCHAR ELSE '' END AS cik FROM customer),
lst AS (SELECT 'K-' || s_suppkey AS k, s_name AS nm, chr(CAST(65 + s_nationkey AS INTEGER)) AS ex, CASE WHEN s_suppkey % 5 = 0 THEN 'Y' ELSE 'N' END AS etf, CASE WHEN s_suppkey % 7 = 0 THEN 'D' ELSE 'N' END AS st FROM supplier),
fil AS (SELECT 'K-' || c_custkey AS k, lpad((c_custkey + c_custkey % 2)::VARCHAR, 10, '0') AS cik FROM customer WHERE c_custkey % 3 <> 0),
jn AS (SELECT replace(c.sym, '.', '-') AS ticker_yahoo, c.sym AS ticker_sp, coalesce(l.nm, c.sec) AS name, coalesce(l.ex, '') AS exchange, CASE WHEN c.cik <> '' THEN lpad(c.cik, 10, '0') ELSE coalesce(f.cik, '') END AS cik, c.sector AS gics_sector,
  CASE l.etf WHEN 'Y' THEN 1 WHEN 'N' THEN 0 END AS is_etf, coalesce(l.st, '') AS financial_status, CASE WHEN c_custkey % 10 > 1 THEN '2001-03-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') END AS added,
  l.k IS NULL AS no_listing, f.k IS NULL AS no_filing, coalesce(c.cik <> '' AND lpad(c.cik, 10, '0') <> f.cik, false) AS cik_mismatch, c_custkey % 10 = 0 AS date_unparseable
  FROM cons c LEFT JOIN lst l ON l.k = replace(c.sym, '.', '-') LEFT JOIN fil f ON f.k = replace(c.sym, '.', '-'))"""


def _reference(spark, d):
    from crosstide.plans import ingest

    c, sup = demo.table(spark, d, "customer"), demo.table(spark, d, "supplier")
    key, at = F.col("c_custkey"), F.col("c_custkey") % 10
    text = lambda x: x.cast("string")
    constituents = c.select(
        F.concat(F.lit("K."), text(key)).alias("Symbol"), F.col("c_name").alias("Security"), F.element_at(F.array(F.lit("Energy"), F.lit("Materials"), F.lit("Utilities")), (F.col("c_nationkey") % 3 + 1).cast("int")).alias("GICS Sector"), F.col("c_mktsegment").alias("GICS Sub-Industry"),
        F.when(at == 0, "soon").when(at > 1, F.concat(F.lit("03/"), F.lpad(text(key % 28 + 1), 2, "0"), F.lit("/2001"))).alias("Date added"), F.when(key % 4 != 0, text(key)).otherwise("").alias("CIK"),
    )
    listed = sup.select(
        F.concat(F.lit("K."), text(F.col("s_suppkey"))).alias("NASDAQ Symbol"), F.lit("").alias("CQS Symbol"), F.lit("k").alias("Symbol"), F.col("s_name").alias("Security Name"), F.chr(F.lit(65) + F.col("s_nationkey")).alias("Listing Exchange"),
        F.when(F.col("s_suppkey") % 5 == 0, "Y").otherwise("N").alias("ETF"), F.lit(100).alias("Round Lot Size"), F.when(F.col("s_suppkey") % 7 == 0, "D").otherwise("N").alias("Financial Status"),
    )
    filings = c.where("c_custkey % 3 <> 0").select(F.concat(F.lit("K-"), text(key)).alias("ticker"), (key + key % 2).alias("cik"))
    return ingest.join_reference(constituents, listed, filings)


@register(q(REF, "SELECT * FROM jn"))
def ref_join_normalised(spark, d):
    """Constituents with listings and identifiers: folded keys, checked identifiers, mismatches as columns."""
    out = _reference(spark, d)
    return out.select("ticker_yahoo", "ticker_sp", "name", "exchange", "cik", "gics_sector", F.col("is_etf").cast("int").alias("is_etf"), "financial_status", F.col("sp500_date_added").cast("string").alias("added"), "no_listing", "no_filing", "cik_mismatch", "date_unparseable")


@register(q(REF, "SELECT 'no_listing' AS \"check\", count(*) AS n FROM jn WHERE no_listing HAVING count(*) > 0 UNION ALL SELECT 'no_filing', count(*) FROM jn WHERE no_filing HAVING count(*) > 0 UNION ALL SELECT 'cik_mismatch', count(*) FROM jn WHERE cik_mismatch HAVING count(*) > 0 UNION ALL SELECT 'cik_missing', count(*) FROM jn WHERE cik = '' HAVING count(*) > 0 UNION ALL SELECT 'date_unparseable', count(*) FROM jn WHERE date_unparseable HAVING count(*) > 0 UNION ALL SELECT 'etf', count(*) FROM jn WHERE is_etf = 1 HAVING count(*) > 0 UNION ALL SELECT 'financial_status', count(*) FROM jn WHERE financial_status NOT IN ('N', '') HAVING count(*) > 0"))
def ref_join_report(spark, d):
    """The join's verification: how many rows each check finds."""
    from crosstide.plans import ingest

    return ingest.reference_report(_reference(spark, d)).select("check", "n")


@register("SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date, CAST(len(list_distinct(list(l_suppkey))) AS INTEGER) AS symbols FROM lineitem WHERE CAST(l_shipdate AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders) GROUP BY 1")
def anti_off_axis(spark, d):
    """Shipments as events against the sessions of orders: the dates off the axis and their symbols."""
    from crosstide.plans import ingest

    events = demo.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("ex_date"), F.col("l_suppkey").alias("symbol"))
    sessions = demo.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    _, strangers = ingest.off_axis(events, sessions)
    return strangers.select(F.col("ex_date").cast("string").alias("date"), F.size("symbols").alias("symbols"))


@register(q(EV + ", f AS (SELECT ii, min(di) AS a FROM ev GROUP BY ii), s AS (SELECT DISTINCT di FROM ev)", "SELECT s.di, f.ii FROM s JOIN f ON f.a <= s.di"))
def pit_listing(spark, d):
    e = demo.ev(spark, d)
    first = F.lit("2024-01-01").cast("date")
    sessions = e.select("di").distinct().withColumn("date", F.date_add(first, F.col("di")))
    securities = e.groupBy("ii").agg(F.date_add(first, F.min("di")).alias("first_trade_date"))
    return evt.listed_on(sessions, securities).select(F.col("di").cast("int").alias("di"), "ii")


@register("WITH old AS (SELECT c_custkey AS key, row_number() OVER (ORDER BY c_custkey) AS security_id FROM customer WHERE c_custkey % 3 = 0) SELECT key, security_id FROM old UNION ALL SELECT c_custkey, (SELECT count(*) FROM old) + row_number() OVER (ORDER BY c_acctbal, c_custkey) FROM customer WHERE c_custkey % 3 <> 0")
def id_registry_append(spark, d):
    customer = demo.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_acctbal")
    empty = spark.createDataFrame([], "key bigint, security_id bigint")
    old = evt.register(empty, customer.where("key % 3 = 0").select("key"), ["key"], [F.col("key")])
    return evt.register(old, customer, ["key"], [F.col("c_acctbal"), F.col("key")]).select("key", "security_id")


#: Daily bars of all suppliers; events are the orders of customers who stand for them.
DAY = f"{S_LINES}, {B_LINES}"
JUMPS = DAY + ", rets AS (SELECT ii, date, close / nullif(lag(close) OVER (PARTITION BY ii ORDER BY date), 0) - 1 AS r FROM bars), j AS (SELECT ii, date, r FROM rets WHERE abs(r) > 0.4 AND NOT EXISTS (SELECT 1 FROM splits s WHERE s.ii = rets.ii AND s.ex_date = rets.date))"


def _jumps(spark, d):
    from crosstide.plans import ingest

    bars = demo.bars(spark, d).withColumns({"raw_close": F.col("close"), "adj_factor": F.lit(1.0), "adjclose": F.col("close")})
    return ingest.unexplained_jumps(ingest.returns(bars, "ii"), demo.splits(spark, d), "ii")


@register(f"WITH {JUMPS} SELECT ii, CAST(date AS VARCHAR) AS date, {rs('r', 'r')} FROM j")
def jump_detect(spark, d):
    """Returns beyond 40% on days without an event."""
    return _jumps(spark, d).select("ii", F.col("date").cast("string").alias("date"), r("r_own").alias("r"))


@register(f"WITH {JUMPS} SELECT ii, count(*) AS n_jumps, CAST(min(date) AS VARCHAR) AS first, CAST(max(date) AS VARCHAR) AS last FROM j GROUP BY ii HAVING count(*) >= 2")
def suspects_having(spark, d):
    from crosstide.plans import ingest

    return ingest.suspects(_jumps(spark, d), "ii").select("ii", "n_jumps", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"))


@register(f"WITH {DAY}, vend AS (SELECT ii, date, close, close * (1 + (ii % 3) / 1000.0 * (day(date) % 2)) AS adjclose FROM bars), gaps AS (SELECT ii, date, abs(close / nullif(lag(close) OVER w, 0) - adjclose / nullif(lag(adjclose) OVER w, 0)) AS g FROM vend WINDOW w AS (PARTITION BY ii ORDER BY date)) SELECT ii, {rs('max(g)', 'worst_gap')} FROM gaps GROUP BY ii HAVING max(g) > 1e-4")
def vendor_divergence(spark, d):
    """The worst gap between our returns and a vendor's that drift by the day."""
    from crosstide.plans import ingest

    drift = 1 + (F.col("ii") % 3) / 1000.0 * (F.dayofmonth("date") % 2)
    bars = demo.bars(spark, d).withColumns({"raw_close": F.col("close"), "adj_factor": F.lit(1.0), "adjclose": F.col("close") * drift})
    return ingest.vendor_divergence(ingest.returns(bars, "ii"), "ii").select("ii", r("worst_gap").alias("worst_gap"))


@register(f"WITH {DAY}, dv AS (SELECT ii, ex_date AS date, max(ratio - 1) AS amount FROM splits GROUP BY 1, 2), sx AS (SELECT ii, ex_date AS date, product(1 / ratio) AS f FROM splits GROUP BY 1, 2), st AS (SELECT b.ii, b.date, coalesce(sx.f, 1) * coalesce(CASE WHEN dv.amount IS NOT NULL THEN 1 - dv.amount / nullif(lag(b.close) OVER (PARTITION BY b.ii ORDER BY b.date), 0) END, 1) AS step FROM bars b LEFT JOIN sx ON sx.ii = b.ii AND sx.date = b.date LEFT JOIN dv ON dv.ii = b.ii AND dv.date = b.date) SELECT ii, CAST(date AS VARCHAR) AS date, {rs('coalesce(product(step) OVER (PARTITION BY ii ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)', 'adj_factor')} FROM st")
def adjustment_factor(spark, d):
    """Backward factors from splits and dividends that fall on bars."""
    from crosstide.plans import ingest

    splits = demo.splits(spark, d)
    dividends = splits.select("ii", "ex_date", (F.col("ratio") - 1).alias("amount"))
    bars = demo.bars(spark, d).withColumns({"raw_close": F.col("close"), "split_cum": F.lit(1.0)})
    out = ingest.adjustment_factor(bars, splits, dividends, "ii")
    return out.select("ii", F.col("date").cast("string").alias("date"), r("adj_factor").alias("adj_factor"))


@register(f"WITH {DAY}, ap AS (SELECT event, ii, ex_date, ratio, (SELECT max_by(close, date) FROM bars b WHERE b.ii = s.ii AND b.date < s.ex_date) / nullif((SELECT min_by(close, date) FROM bars b WHERE b.ii = s.ii AND b.date >= s.ex_date), 0) AS jp FROM splits s), ok AS (SELECT ii, ex_date, ratio FROM ap WHERE jp IS NULL OR abs(ln(jp)) <= abs(ln(jp / ratio))), ct AS (SELECT b.ii, b.date, b.close, coalesce((SELECT product(ratio) FROM ok WHERE ok.ii = b.ii AND ok.ex_date > b.date), 1) AS f FROM bars b) SELECT ii, CAST(date AS VARCHAR) AS date, {rs('f', 'split_cum')}, {rs('ln(close * f)', 'log_raw_close', 9)} FROM ct")
def split_reconstruct(spark, d):
    """Raw prices: quotes times the splits after them that the vendor applied."""
    from crosstide.plans import ingest

    bars = demo.bars(spark, d).withColumns({c: F.col("close") for c in ("open", "high", "low")} | {"volume": F.lit(1000)})
    out, _ = ingest.reconstruct(bars, demo.splits(spark, d), "ii")
    return out.select("ii", F.col("date").cast("string").alias("date"), r("split_cum").alias("split_cum"), r(F.log("raw_close"), 9).alias("log_raw_close"))


@register(q(EV, "SELECT ii, count(*) AS n_sessions, min(di) AS first_session, max(di) AS last_session FROM ev GROUP BY ii"))
def coverage(spark, d):
    from crosstide.plans import ingest

    e = demo.ev(spark, d).withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("di")))
    out = ingest.coverage(e.drop("di"), e.select("di", "date").distinct(), "ii")
    return out.select("ii", "n_sessions", F.col("first_session").cast("int").alias("first_session"), F.col("last_session").cast("int").alias("last_session"))


THIN = "cnt AS (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS n FROM lineitem GROUP BY 1), med AS (SELECT median(n) * 0.5 AS h FROM cnt)"


@register(f"WITH {THIN} SELECT CAST(date AS VARCHAR) AS date, n FROM cnt WHERE date <= (SELECT max(date) FROM cnt, med WHERE n >= h)")
def trim_trailing(spark, d):
    from crosstide.plans import ingest

    rows = demo.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.col("l_orderkey").alias("symbol"))
    kept = rows.join(ingest.thin_tail(rows), "date", "left_anti")
    return kept.groupBy(F.col("date").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS session, CAST(date AS VARCHAR) AS date, CAST((month(date) = 11 AND dayofweek(date) = 5 AND day(date) BETWEEN 23 AND 29) OR (month(date) = 12 AND day(date) = 24) OR (month(date) = 7 AND day(date) = 3) AS INTEGER) AS is_half_day, n AS n_securities FROM (SELECT CAST(l_shipdate AS DATE) AS date, CAST(count(*) AS INTEGER) AS n FROM lineitem GROUP BY 1)")
def calendar_sessions(spark, d):
    from crosstide.plans import ingest

    bars = demo.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.col("l_orderkey").alias("symbol"), F.col("l_quantity").cast("long").alias("raw_volume"))
    return ingest.calendar(bars).select("session", F.col("date").cast("string").alias("date"), "is_half_day", "n_securities")


@register("SELECT event_id, CAST(CAST(make_timestamp(epoch_us(ts)) - CASE WHEN ts >= TIMESTAMP '2024-03-10 07:00:00' AND ts < TIMESTAMP '2024-11-03 06:00:00' THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS DATE) AS VARCHAR) AS ny_date, CAST(CAST(ts AS DATE) AS VARCHAR) AS utc_date FROM events")
def epoch_to_ny_date(spark, d):
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    events = demo.table(spark, d, "events").select("event_id", seconds.alias("epoch"))
    return events.select("event_id", s.market_date("epoch").cast("string").alias("ny_date"), s.utc_date("epoch").cast("string").alias("utc_date"))


@register("SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date, (round(sum(l_extendedprice), 2) + 0.0) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume FROM lineitem GROUP BY 1, 2")
def json_parse(spark, d):
    """Vendor charts, one JSON payload per supplier, back to bars."""
    from crosstide.sources import vendor

    items = demo.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("symbol"), F.to_date("l_shipdate").alias("date")).agg(F.sum("l_extendedprice").alias("x"), F.sum("l_quantity").cast("long").alias("v"))
    day = F.struct((F.unix_date("date").cast("long") * 86400 + 15 * 3600).alias("t"), F.round("x", 4).alias("x"), F.col("v"))
    series = items.groupBy("symbol").agg(F.array_sort(F.collect_list(day)).alias("s"))
    quote = F.struct(F.col("s.x").alias("open"), F.col("s.x").alias("high"), F.col("s.x").alias("low"), F.col("s.x").alias("close"), F.col("s.v").alias("volume"))
    chart = F.struct(F.struct(F.lit(None).cast("string").alias("error"), F.array(F.struct(F.struct("symbol").alias("meta"), F.col("s.t").alias("timestamp"), F.struct(F.array(quote).alias("quote"), F.array(F.struct(F.col("s.x").alias("adjclose"))).alias("adjclose")).alias("indicators"))).alias("result")).alias("chart"))
    bars = vendor.bars(vendor.parse_charts(series.select("symbol", F.to_json(chart).alias("payload"))))
    return bars.select("symbol", F.col("date").cast("string").alias("date"), r("close", 2).alias("close"), "volume")


@register("SELECT n_name, CAST(levenshtein(n_name, 'NATION_17') AS INTEGER) AS distance FROM nation")
def levenshtein_suggest(spark, d):
    """The preflight's edit distance, by which it shows how far a suggestion is."""
    from crosstide.plans import preflight

    names = [x["n_name"] for x in demo.table(spark, d, "nation").select("n_name").collect()]  # 25 names
    return spark.createDataFrame([(n, preflight.distance(n, "NATION_17")) for n in names], "n_name string, distance int")


@register("SELECT p_partkey, translate(p_name || '|' || p_type || chr(10), '|' || chr(13) || chr(10), '   ') AS field, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS cik, printf('%.6f', p_retailprice) AS price, p_partkey || '|' || p_name || '|' || p_size AS line FROM part")
def clean_fields(spark, d):
    from crosstide.sources.pipe import pipe_lines

    part = demo.table(spark, d, "part")
    text = F.concat("p_name", F.lit("|"), "p_type", F.lit("\n"))
    lines = pipe_lines(part.select("p_partkey", "p_name", "p_size"), ["p_partkey", "p_name", "p_size"]).withColumn("p_partkey", F.split("line", "[|]")[0].cast("long"))
    return part.select("p_partkey", s.clean_field(text).alias("field"), s.padded_cik("p_partkey").alias("cik"), s.price_text("p_retailprice").alias("price")).join(lines, "p_partkey")


@register("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY p_brand")
def distribution(spark, d):
    from crosstide.plans import ingest

    return ingest.distribution(demo.table(spark, d, "part"), "p_brand")


@register("SELECT p_name AS key, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def key_collisions(spark, d):
    return evt.colliding_keys(demo.table(spark, d, "part"), "p_name")


@register("SELECT n_nationkey, (n_nationkey % 12 + 1) AS k, CAST([10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60][CAST(n_nationkey % 12 + 1 AS INTEGER)] AS TINYINT) AS code FROM nation")
def sector_codes(spark, d):
    """Sector names by turns, a twelfth of them unknown, to their codes."""
    names = F.array(*[F.lit(n) for n in [*s.SECTOR_CODES, "Unknown"]])
    n = demo.table(spark, d, "nation").withColumn("k", F.col("n_nationkey") % 12 + 1)
    return n.select("n_nationkey", "k", s.sector_code(F.element_at(names, F.col("k").cast("int"))).alias("code"))
