"""Metrics of a daily roll-up: whole run, years and months, drawdown, regression, concentration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions.scalar import safe_div

DAYS = 252


def sharpe(x: Column | str, days: int = DAYS) -> Column:
    """Mean over sample deviation, annualised; NULL below two observations or without variation."""
    return safe_div(F.avg(x), F.stddev_samp(x)) * math.sqrt(days)


def drawdown(daily: DataFrame, by: list[str] | None = None, pnl: str = "pnl", day: str = "di") -> DataFrame:
    """(by..., max_drawdown, from_di, to_di) on the running sum of pnl, whose peak is never below 0.

    from_di is the session of the running sum's highest value up to the trough.
    """
    by = by or []
    order = Window.partitionBy(*by).orderBy(day)
    run = daily.withColumn("_c", F.sum(F.coalesce(F.col(pnl), F.lit(0.0))).over(order))
    run = run.withColumn("_peak", F.greatest(F.max("_c").over(order), F.lit(0.0))).withColumn("_d", F.col("_c") - F.col("_peak"))
    first = F.min(F.struct(F.col("_d"), F.col(day).alias("t")))
    trough = run.groupBy(*by).agg(first.alias("_m"))
    at = run.join(F.broadcast(trough), by) if by else run.crossJoin(F.broadcast(trough))  # one row
    out = at.where(F.col(day) <= F.col("_m.t")).groupBy(*by, "_m").agg(F.max(F.struct(F.col("_c"), (-F.col(day)).alias("t"))).alias("_p"))
    return out.select(*by, (-F.col("_m._d")).alias("max_drawdown"), (-F.col("_p.t")).alias("from_di"), F.col("_m.t").alias("to_di"))


def _common(booksize: float, days: int) -> dict[str, Column]:
    r, pnl, trade = F.col("return"), F.col("pnl"), F.col("trade_dollar")
    return {
        "sharpe": sharpe(r, days), "ann_return": F.avg(r) * days, "turnover": F.avg(trade) / booksize, "margin_bps": safe_div(F.sum(pnl), F.sum(trade)) * 1e4, "cost_share_of_gross": safe_div(F.sum("cost"), F.sum("holding_pnl")),
        "avg_long_value": F.avg("long_value"), "avg_short_value": F.avg("short_value"), "avg_long_count": F.avg("long_count"), "avg_short_count": F.avg("short_count"),
        "long_short_ratio": safe_div(F.avg("long_value"), -F.avg("short_value")), "return_std_daily": F.stddev_samp(r), "hit_rate": F.avg((pnl > 0).cast("double")),
    }


def scalars(daily: DataFrame, booksize: float, days: int = DAYS, by: list[str] | None = None) -> DataFrame:
    """A row of metrics over the whole run (drawdown apart), per strategy with by=["strategy"]."""
    c = _common(booksize, days)
    fitness = c["sharpe"] * F.sqrt(F.abs(c["ann_return"]) / F.greatest(c["turnover"], F.lit(0.125)))
    return daily.groupBy(*by or []).agg(
        F.count(F.lit(1)).alias("n_days"), *[v.alias(k) for k, v in c.items()], fitness.alias("fitness"), (c["ann_return"] * booksize).alias("ann_return_dollar"), safe_div(c["ann_return"] * booksize, F.avg("long_value")).alias("ann_return_long_side"),
        F.sum("pnl").alias("pnl_total"), F.sum("holding_pnl").alias("holding_pnl_total"), F.sum("trading_pnl").alias("trading_pnl_total"), F.sum("cost").alias("cost_total"), F.sum("trade_dollar").alias("trade_dollar_total"), safe_div(F.sum("pnl"), F.sum("holding_pnl")).alias("net_share_of_gross"),
    )


def periods(daily: DataFrame, booksize: float, days: int = DAYS, date: str = "date") -> DataFrame:
    """One row for the run, each year and each month: (period, ...), the run's period is 'all'.

    Grouping sets give all three levels in one aggregation. Drawdowns are of each
    period's own curve.
    """
    dated = daily.withColumns({"year": F.date_format(date, "yyyy"), "month": F.date_format(date, "yyyy-MM")})
    c = _common(booksize, days)
    gross = F.avg("long_value") + F.abs(F.avg("short_value"))
    sums = [F.count(F.lit(1)).alias("days"), F.sum("pnl").alias("pnl"), F.sum("holding_pnl").alias("holding_pnl"), F.sum("cost").alias("cost"), F.sum("trade_dollar").alias("trade_dollar"), safe_div(F.avg("long_value"), gross).alias("long_share")]
    keyed = dated.groupingSets([[], ["year"], ["year", "month"]], "year", "month").agg(*[v.alias(k) for k, v in c.items()], *sums)
    out = keyed.withColumn("period", F.coalesce("month", "year", F.lit("all"))).drop("year", "month")
    levels = dated.withColumn("period", F.explode(F.array(F.lit("all"), F.col("year"), F.col("month"))))
    falls = drawdown(levels, ["period"]).select("period", (F.col("max_drawdown") / booksize).alias("max_drawdown"))
    return out.join(falls, "period")


def regression(daily: DataFrame, market: str = "market_ret", r: str = "return", days: int = DAYS) -> DataFrame:
    """(n_obs, beta, r2, sharpe_hedged, sharpe_raw) of returns on the market's, where both are known."""
    both = daily.where(F.col(market).isNotNull() & F.col(r).isNotNull())
    fit = both.agg(F.count(F.lit(1)).alias("n_obs"), safe_div(F.covar_samp(r, market), F.var_samp(market)).alias("beta"), F.var_samp(r).alias("_vy"), F.var_samp(market).alias("_vx"), F.covar_samp(r, market).alias("_c"))
    fit = fit.withColumn("r2", safe_div(F.col("_c") * F.col("_c"), F.col("_vx") * F.col("_vy")))
    hedged = both.crossJoin(F.broadcast(fit.select("beta"))).agg(sharpe(F.col(r) - F.col("beta") * F.col(market), days).alias("sharpe_hedged"))  # one row
    return fit.select("n_obs", "beta", "r2").crossJoin(hedged).crossJoin(daily.agg(sharpe(r, days).alias("sharpe_raw")))


def concentration(cells: DataFrame, daily: DataFrame) -> DataFrame:
    """Shares of the absolute pnl of the largest 1, 5 and 20 securities and of the largest session."""
    names = cells.groupBy("ii").agg(F.sum("pnl").alias("p"))
    whole = names.agg(F.sum(F.abs("p")).alias("total_abs_pnl"), F.sum((F.col("p") != 0).cast("long")).alias("n_names_with_pnl"))
    top = names.orderBy(F.abs("p").desc(), "ii").limit(20).withColumn("k", F.row_number().over(Window.orderBy(F.abs("p").desc(), "ii")))  # 20 rows
    tops = top.agg(*[F.sum(F.when(F.col("k") <= k, F.abs("p"))).alias(f"_t{k}") for k in (1, 5, 20)])
    days = daily.agg(safe_div(F.max(F.abs("pnl")), F.sum(F.abs("pnl"))).alias("top1_day_share"), F.max_by("di", F.abs("pnl")).alias("top_day"))
    out = whole.crossJoin(tops).crossJoin(days)  # one row each
    return out.select("total_abs_pnl", "n_names_with_pnl", *[safe_div(f"_t{k}", "total_abs_pnl").alias(f"top{k}_share") for k in (1, 5, 20)], "top1_day_share", "top_day")


def rolling_sharpe(daily: DataFrame, days: int = DAYS, r: str = "return", annual: int = DAYS, by: list[str] | None = None) -> DataFrame:
    """daily with the Sharpe ratio of the last so many sessions, NULL before there are as many."""
    frame = Window.partitionBy(*by or []).orderBy("di").rowsBetween(-(days - 1), 0)  # over one row per session
    value = safe_div(F.avg(r).over(frame), F.stddev_samp(r).over(frame)) * math.sqrt(annual)
    return daily.withColumn("rolling_sharpe", F.when(F.count(r).over(frame) == days, value))


def halves(daily: DataFrame, r: str = "return", days: int = DAYS, by: list[str] | None = None) -> DataFrame:
    """(sharpe_first_half, sharpe_second_half): the first n // 2 sessions and the rest."""
    own = Window.partitionBy(*by or [])
    placed = daily.withColumn("_first", F.row_number().over(own.orderBy("di")) <= F.floor(F.count(F.lit(1)).over(own) / 2))  # over one row per session
    of = lambda flag: F.when(flag, F.col(r))
    return placed.groupBy(*by or []).agg(sharpe(of(F.col("_first")), days).alias("sharpe_first_half"), sharpe(of(~F.col("_first")), days).alias("sharpe_second_half"))


def breakeven(daily: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many times the cost could be larger before the gross is gone."""
    return daily.groupBy(*by or []).agg(F.sum("cost").alias("cost_total"), (F.sum("pnl") + F.sum("cost")).alias("pnl_gross"), safe_div(F.sum("pnl") + F.sum("cost"), F.sum("cost")).alias("breakeven_cost"))
