"""Operators over one session's cross-section: windows partitioned by session.

Each takes a panel (di, ii, x, ...) and adds or replaces a column. NULL means no
observation and no statistic counts it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions.scalar import clip, col, safe_div

DAY = ("di",)


def _day(by: tuple[str, ...] = DAY) -> Window:
    return Window.partitionBy(*by)


def average_rank(x: Column | str, descending: bool = False, by: tuple[str, ...] = DAY) -> Column:
    """Rank from 1 among the session's observed values; ties share their mean rank."""
    x = col(x)
    ordered = Window.partitionBy(*by, x.isNull()).orderBy(x.desc() if descending else x.asc())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return F.when(x.isNotNull(), F.rank().over(ordered) + (ties - 1) / 2.0)


def rank(df: DataFrame, x: str, out: str | None = None, by: tuple[str, ...] = DAY) -> DataFrame:
    """Ranks spread over [-0.5, 0.5]; a lone observation is 0."""
    m = F.count(col(x)).over(_day(by))
    value = F.when(col(x).isNull(), None).when(m <= 1, 0.0).otherwise((average_rank(x, by=by) - 1) / (m - 1) - 0.5)
    return df.withColumn(out or x, value.cast("double"))


def neutralize(df: DataFrame, x: str, group: str, out: str | None = None, by: tuple[str, ...] = DAY) -> DataFrame:
    """x less its group's mean; a missing group is a group of its own."""
    return df.withColumn(out or x, col(x) - F.avg(x).over(Window.partitionBy(*by, group)))


def demean(df: DataFrame, x: str, out: str | None = None, by: tuple[str, ...] = DAY) -> DataFrame:
    return df.withColumn(out or x, col(x) - F.avg(x).over(_day(by)))


def zscore(df: DataFrame, x: str, out: str | None = None, by: tuple[str, ...] = DAY) -> DataFrame:
    """(x - mean) / sample deviation; zeros where the deviation is zero or unknown."""
    deviation = F.stddev_samp(x).over(_day(by))
    value = F.when(deviation > 0, safe_div(col(x) - F.avg(x).over(_day(by)), deviation)).otherwise(col(x) * 0.0)
    return df.withColumn(out or x, value)


def gross(x: Column | str, by: tuple[str, ...] = DAY) -> Column:
    """Sum of absolute values, 0 where nothing is observed."""
    return F.coalesce(F.sum(F.abs(col(x))).over(_day(by)), F.lit(0.0))


def truncate(df: DataFrame, x: str, share: float, out: str | None = None, by: tuple[str, ...] = DAY) -> DataFrame:
    """Values clipped once to share of the gross before clipping; an empty book stays."""
    total = gross(x, by)
    return df.withColumn(out or x, F.when(total > 0, clip(x, -share * total, share * total)).otherwise(col(x)))


def in_pool_only(x: Column | str, pool: Column | str | None) -> Column:
    """Gate before a chain: outside the pool nothing is observed."""
    return col(x) if pool is None else F.when(F.coalesce(col(pool), F.lit(False)), col(x))


def as_weights(x: Column | str, pool: Column | str | None = None) -> Column:
    """Gate after a chain: outside the pool, and where nothing is observed, the weight is 0."""
    return F.coalesce(in_pool_only(x, pool), F.lit(0.0))


def scale(df: DataFrame, x: str, pool: str | None = None, out: str | None = None, by: tuple[str, ...] = DAY, degenerate: str | None = None) -> DataFrame:
    """Weights whose absolute values sum to 1 per session; the pool applies before the sum.

    A session whose values are all missing or cancel has no book: its weights are 0,
    and the degenerate column, if named, says so.
    """
    inside = in_pool_only(x, pool)
    total = F.coalesce(F.sum(F.abs(inside)).over(_day(by)), F.lit(0.0))
    value = F.coalesce(F.when(total > 0, safe_div(inside, total)).otherwise(inside), F.lit(0.0))
    columns = {out or x: value}
    if degenerate:
        columns[degenerate] = total <= 0
    return df.withColumns(columns)


def top_members(df: DataFrame, x: str, n: int, out: str = "in_pool", by: tuple[str, ...] = DAY) -> DataFrame:
    """Membership of the n largest values of the session by average rank; missing values are outside.

    The count over the session, true wherever a rank is, comes first in the plan: the
    finer windows of the rank then reuse its exchange, one in place of two.
    """
    seen = F.count(col(x)).over(_day(by)) > 0
    return df.withColumn(out, F.coalesce(seen & (average_rank(x, descending=True, by=by) <= n), F.lit(False)))


def member(value: Column | str) -> Column:
    """Membership test of a pool panel: positive is inside, missing is outside."""
    return F.coalesce(col(value).cast("double") > 0, F.lit(False))
