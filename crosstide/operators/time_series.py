"""Operators along sessions for each security: windows partitioned by security.

Frames are ranges over the dense integer session axis, so a row that is absent
counts as a missing observation without being made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions.scalar import col, safe_div

NAME = ("ii",)
#: Half-lives of a block of sessions in exp_decay: its weights stay within 2^0 and 2^400.
BLOCK_HALF_LIVES = 400


def along(by: tuple[str, ...] = NAME) -> Window:
    return Window.partitionBy(*by).orderBy("di")


def last_sessions(n: int, by: tuple[str, ...] = NAME) -> Window:
    """The last n sessions including this one."""
    return along(by).rangeBetween(-(n - 1), 0)


def delay(x: Column | str, k: int, by: tuple[str, ...] = NAME) -> Column:
    """The value k sessions ago, NULL where that session has none. Works on sparse panels."""
    return F.max(col(x)).over(along(by).rangeBetween(-k, -k))


def mean(x: Column | str, n: int, least: int = 1, by: tuple[str, ...] = NAME) -> Column:
    """Mean of the observations among the last n sessions, if there are at least so many."""
    frame = last_sessions(n, by)
    return F.when(F.count(col(x)).over(frame) >= least, F.avg(col(x)).over(frame))


def deviation(x: Column | str, n: int, by: tuple[str, ...] = NAME) -> Column:
    """Sample deviation of the observations among the last n sessions."""
    return F.stddev_samp(col(x)).over(last_sessions(n, by))


def median(x: Column | str, n: int, by: tuple[str, ...] = NAME, today: bool = True) -> Column:
    """Median of the observations among n sessions, with or without this one."""
    frame = along(by).rangeBetween(-(n - 1), 0) if today else along(by).rangeBetween(-n, -1)
    values = F.array_sort(F.collect_list(col(x)).over(frame))
    size = F.size(values)
    at = lambda i: F.get(values, i.cast("int"))
    return F.when(size > 0, (at(F.floor((size - 1) / 2)) + at(F.floor(size / 2))) / 2.0)


def momentum(x: Column | str, n: int, by: tuple[str, ...] = NAME) -> Column:
    """x over its value n sessions ago, less 1."""
    return safe_div(x, delay(x, n, by)) - 1


def pct_change(x: Column | str, by: tuple[str, ...] = NAME) -> Column:
    """Change against the previous session; a gap leaves two sessions without a change."""
    return momentum(x, 1, by)


def forward_fill(x: Column | str, by: tuple[str, ...] = NAME) -> Column:
    return F.last(col(x), ignorenulls=True).over(along(by).rowsBetween(Window.unboundedPreceding, 0))


def linear_decay(x: Column | str, n: int, by: tuple[str, ...] = NAME) -> Column:
    """Weights n for today down to 1, over the weights of what is observed.

    The weight of session s at t is s + n - t: two sliding sums replace n lags.
    """
    if n < 1:
        raise ValueError("linear_decay needs a positive number of sessions")
    x, frame = col(x).cast("double"), last_sessions(n, by)
    seen = F.when(x.isNotNull(), 1.0)
    place = (F.col("di") + n).cast("double")
    sums = lambda c: F.sum(c).over(frame)
    t = F.col("di").cast("double")
    return safe_div(sums(x * place) - t * sums(x), sums(seen * place) - t * sums(seen))


def exp_decay(df: DataFrame, x: str, half_life: int, out: str | None = None, by: tuple[str, ...] = NAME) -> DataFrame:
    """df with out: weight 0.5^(age / half_life) over all earlier sessions, over the weights of what is observed.

    Memory is without end, and a value does not depend on the span of the axis.
    Sessions are cut into fixed blocks in which weights are powers of two from the
    block's start on. At an observation, the sums of its own block and those of the
    block before hold all weight but 2^-400 of it; on a session without one, both
    sums have faded alike since the last observation, whose value stands.
    """
    if half_life < 1:
        raise ValueError("exp_decay needs a positive half-life")
    block = BLOCK_HALF_LIVES * half_life
    frame = df.withColumns({"_x": col(x).cast("double"), "_b": F.floor(F.col("di") / block)})
    growth = F.when(F.col("_x").isNotNull(), F.pow(F.lit(2.0), (F.col("di") - F.col("_b") * block) / float(half_life)))
    frame = frame.withColumns({"_g": growth, "_xg": F.col("_x") * growth})
    # All three windows share one exchange and one order: by, block, session.
    own = Window.partitionBy(*by, "_b").orderBy("di").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_b").rangeBetween(-1, -1)
    faded = lambda c: F.sum(c).over(own) + F.coalesce(F.sum(c).over(before), F.lit(0.0)) * 2.0**-BLOCK_HALF_LIVES
    frame = frame.withColumns({"_n": faded("_xg"), "_w": faded("_g")})
    value = F.when(F.col("_x").isNotNull(), safe_div("_n", "_w"))
    last = Window.partitionBy(*by).orderBy("_b", "di").rowsBetween(Window.unboundedPreceding, 0)
    frame = frame.withColumn("_y", value).withColumn(out or x, F.last("_y", ignorenulls=True).over(last))
    return frame.drop("_x", "_b", "_g", "_xg", "_n", "_w", "_y")


def missing_runs(df: DataFrame, x: str, within: Column | None = None, by: tuple[str, ...] = NAME) -> DataFrame:
    """Adds run_length: the length of the run of missing sessions that a row is in, NULL for observed rows.

    Rows must be dense in di. Islands are the differences of two row numbers.
    """
    gone = col(x).isNull() if within is None else col(x).isNull() & within
    numbered = df.withColumn("_gone", gone)
    island = F.row_number().over(along(by)) - F.row_number().over(Window.partitionBy(*by, "_gone").orderBy("di"))
    return (
        numbered.withColumn("_island", island)
        .withColumn("run_length", F.when(F.col("_gone"), F.count(F.lit(1)).over(Window.partitionBy(*by, "_gone", "_island"))))
        .drop("_gone", "_island")
    )


def halted_by_proxy(df: DataFrame, x: str, k: int, out: str = "halted", within: Column | None = None, by: tuple[str, ...] = NAME) -> DataFrame:
    """Runs of at least k missing sessions count as halts, the whole run: this looks ahead by design.

    Only the missing rows, mostly few, are numbered and counted: along dense
    sessions a run is where di less the row number stays the same.
    """
    if k < 2:
        raise ValueError("a proxy needs k >= 2: with 1, every missing return would be a halt")
    gone = col(x).isNull() if within is None else col(x).isNull() & within
    missing = df.where(gone).select(*by, "di")
    run = missing.withColumn("_run", F.col("di") - F.row_number().over(along(by)))
    size = F.count(F.lit(1)).over(Window.partitionBy(*by, "_run"))
    halts = run.withColumn(out, size >= k).where(out).select(*by, "di", out)
    return df.join(halts, [*by, "di"], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def run_length_histogram(df: DataFrame, x: str, by: tuple[str, ...] = NAME) -> DataFrame:
    """(run_length, runs): how many runs of missing sessions have each length."""
    cells = missing_runs(df, x, by=by).where("run_length is not null").groupBy("run_length").agg(F.count(F.lit(1)).alias("cells"))
    return cells.select(F.col("run_length").cast("long").alias("run_length"), (F.col("cells") / F.col("run_length")).cast("long").alias("runs"))


def first_time(flag: Column | str, by: tuple[str, ...] = NAME) -> Column:
    """Whether the flag holds here for the first time along sessions."""
    flag = F.coalesce(col(flag), F.lit(False))
    before = F.max(flag.cast("int")).over(along(by).rowsBetween(Window.unboundedPreceding, -1))
    return flag & (F.coalesce(before, F.lit(0)) == 0)


def future_product(ratio: Column | str, by: tuple[str, ...] = NAME) -> Column:
    """Product of the ratios of all later sessions, 1 at the last: a running product in descending order."""
    later = Window.partitionBy(*by).orderBy(F.col("di").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.product(F.coalesce(col(ratio).cast("double"), F.lit(1.0))).over(later), F.lit(1.0))
