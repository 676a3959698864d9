"""As-of joins, products over later events, listing ranges, key checks and registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions.scalar import safe_div
from crosstide.sources.files import written


def as_of(events: DataFrame, bars: DataFrame, key: str, value: str, date: str = "date", event_date: str = "ex_date") -> DataFrame:
    """events with before: the last value strictly before the event, and after: the first on or after it.

    Bars and events of a key are one ordered sequence: running frames over it in
    ascending and in descending order, one exchange, no range join.
    """
    # At one date events come before bars: the bar of that date is after the event.
    marks = events.select("*", F.col(event_date).alias("_t"), F.lit(0).alias("_o"), F.lit(None).cast(dict(bars.dtypes)[value]).alias("_v"))
    points = bars.where(F.col(value).isNotNull()).select(key, F.col(date).alias("_t"), F.lit(1).alias("_o"), F.col(value).alias("_v"))
    both = marks.unionByName(points, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("_t", "_o")
    back = Window.partitionBy(key).orderBy(F.desc("_t"), F.desc("_o"))
    running = lambda w: F.last("_v", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumns({"before": running(order), "after": running(back)})
    return both.where("_o = 0").drop("_t", "_o", "_v")


def classify_splits(splits: DataFrame, bars: DataFrame, key: str = "ii", close: str = "close") -> DataFrame:
    """splits (key, ex_date, ratio) with vendor_applied: whether the quotes already contain the split.

    The jump across the ex-date is nearer to 1 (applied) or to the ratio (not), in
    logs; without a bar on either side, or a bad ratio, it counts as applied.
    """
    seen = as_of(splits, bars, key, close)
    jump = safe_div("before", "after")
    usable = jump.isNotNull() & (jump > 0) & (F.col("ratio") > 0)
    applied = F.abs(F.log(jump)) <= F.abs(F.log(safe_div(jump, F.col("ratio"))))
    evidence = F.when(usable, F.format_string("jump=%.4f vs ratio=%.4f", jump, F.col("ratio"))).otherwise(F.lit("no bar on one side of the ex-date; assumed applied"))
    return seen.withColumns({"vendor_applied": F.when(usable, applied).otherwise(F.lit(True)), "evidence": evidence})


def later_product(bars: DataFrame, events: DataFrame, key: str, ratio: str, out: str, date: str = "date", event_date: str = "ex_date") -> DataFrame:
    """bars with out: the product of the ratios of all events strictly after the bar, 1 without any."""
    marks = events.select(key, F.col(event_date).alias("_t"), F.lit(0).alias("_o"), F.col(ratio).cast("double").alias("_r"))
    points = bars.select("*", F.col(date).alias("_t"), F.lit(1).alias("_o"))
    both = points.unionByName(marks, allowMissingColumns=True)
    # In descending order events of the bar's own date sort after it and so do not count.
    after = Window.partitionBy(key).orderBy(F.desc("_t"), F.desc("_o")).rowsBetween(Window.unboundedPreceding, -1)
    product = F.coalesce(F.product(F.coalesce(F.col("_r"), F.lit(1.0))).over(after), F.lit(1.0))
    return both.withColumn(out, product).where("_o = 1").drop("_t", "_o", "_r")


def listed_on(sessions: DataFrame, securities: DataFrame, since: str = "first_trade_date", date: str = "date") -> DataFrame:
    """Point-in-time membership: every security on every session from its first trade date on.

    A security is exploded over the session numbers it has, found as-of once per
    security; dates and securities are never paired and then filtered.
    """
    first_after = sessions.select(F.col(date).alias("_d"), F.col("di").alias("_i"))
    last = first_after.agg(F.max("_i").alias("_n"))
    marks = securities.where(F.col(since).isNotNull()).select("*", F.col(since).alias("_d"), F.lit(0).alias("_o"))
    starts = marks.select(F.col("_d")).distinct().withColumn("_o", F.lit(0)).unionByName(first_after.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    found = starts.withColumn("_from", F.min("_i").over(Window.orderBy(F.desc("_d"), F.desc("_o")).rowsBetween(Window.unboundedPreceding, 0))).where("_o = 0").select("_d", "_from")
    ranged = marks.join(found, "_d").crossJoin(F.broadcast(last)).where(F.col("_from").isNotNull())
    return ranged.withColumn("di", F.explode(F.sequence("_from", "_n"))).drop("_d", "_o", "_from", "_n").join(F.broadcast(sessions), "di")


def colliding_keys(df: DataFrame, key: Column | str) -> DataFrame:
    """(key, n) of keys that occur more than once."""
    return df.groupBy((F.col(key) if isinstance(key, str) else key).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def register(existing: DataFrame, found: DataFrame, key: list[str], order: list[Column], id_col: str = "security_id") -> DataFrame:
    """existing with found's new keys appended: ids go on from the largest, in the given order.

    Ids that exist never change. A key's first row in the order counts, and ties go
    by the other columns, so ids do not depend on tasks. New keys are numbered within
    ranges of the order, which are then shifted by the counts before them, so no task
    numbers all of them.
    """
    best = Window.partitionBy(*key).orderBy(*order, *[F.col(c) for c in found.columns])
    fresh = found.join(existing.select(*key).distinct(), key, "left_anti").withColumn("_k", F.row_number().over(best)).where("_k = 1")
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    parts = fresh.repartitionByRange(max(1, fresh.sparkSession.sparkContext.defaultParallelism), *order, *key).sortWithinPartitions(*order, *key)
    # Written once: both reads below must see the same ranges.
    parts = written(parts.withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id()), "registered")
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_k").alias("_first"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = parts.join(F.broadcast(sizes), "_p").crossJoin(F.broadcast(top))
    numbered = numbered.withColumn(id_col, (F.col("_top") + F.col("_before") + F.col("_k") - F.col("_first") + 1).cast(dict(existing.dtypes)[id_col]))
    return existing.unionByName(numbered.drop("_p", "_k", "_n", "_first", "_before", "_top"), allowMissingColumns=True)
