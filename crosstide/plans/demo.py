"""Panels derived from star-schema tables, on which the registered queries run.

ev: users by day of events. sp: suppliers by month of shipped lineitems.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.functions.scalar import safe_div
from crosstide.operators import cross_section as cs
from crosstide.operators import time_series as ts
from crosstide.sources import files
from crosstide.sources.panels import MemoryPanels

POOL = 100
BOOK = 1e6


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ev(spark: SparkSession, folder: str) -> DataFrame:
    """(di, ii, x, n): events' values and counts by day and user, sparse."""
    events = table(spark, folder, "events").select(F.to_date("ts").alias("date"), F.col("user_id").alias("ii"), "value")
    days = events.groupBy("date", "ii").agg(F.sum("value").alias("x"), F.count(F.lit(1)).alias("n"))
    first = events.agg(F.min("date").alias("first"))
    return days.crossJoin(F.broadcast(first)).select(F.date_diff("date", "first").alias("di"), "ii", "x", "n")  # one row


def sp(spark: SparkSession, folder: str) -> DataFrame:
    """(di, ii, px, vol): mean price and quantity by month and supplier, sparse."""
    items = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("ii"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("m"), "l_quantity", "l_extendedprice")
    months = items.groupBy("m", "ii").agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("px"), F.sum("l_quantity").alias("vol"))
    first = items.agg(F.min("m").alias("first"))
    return months.crossJoin(F.broadcast(first)).select((F.col("m") - F.col("first")).alias("di"), "ii", "px", "vol")  # one row


def dense(panel: DataFrame) -> DataFrame:
    """The panel on all of its sessions for all of its names.

    The panel, far smaller than its source, is written once: its extent, its names and its cells then come from it.
    """
    panel = files.written(panel, "panel")
    last = panel.agg(F.max("di").alias("last"))
    names = panel.select("ii").distinct().crossJoin(F.broadcast(last))  # one row
    return names.select(F.explode(F.sequence(F.lit(0), "last")).alias("di"), "ii").join(panel, ["di", "ii"], "left")


def grouped(panel: DataFrame) -> DataFrame:
    """With g: five groups, and a missing one."""
    return panel.withColumn("g", F.when(F.col("ii") % 11 != 0, (F.col("ii") % 5).cast("int")))


def ev_grid(spark: SparkSession, folder: str) -> DataFrame:
    return grouped(dense(ev(spark, folder)))


def ev_pool(spark: SparkSession, folder: str) -> DataFrame:
    """ev's grid with in_pool: the POOL names of largest mean over the last five days."""
    grid = ev_grid(spark, folder).withColumn("m5", ts.mean("x", 5))
    return cs.top_members(grid, "m5", POOL).drop("m5")


def sp_grid(spark: SparkSession, folder: str) -> DataFrame:
    """sp's grid with ret, the change of price."""
    return dense(sp(spark, folder)).withColumn("ret", ts.pct_change("px"))


def sp_book(spark: SparkSession, folder: str) -> DataFrame:
    """sp's grid with w: three-month reversal ranks, scaled; missing changes have no weight."""
    frame = sp_grid(spark, folder).withColumn("w", -ts.momentum("px", 3))
    return cs.scale(cs.rank(frame, "w"), "w")


def sp_daily(spark: SparkSession, folder: str) -> DataFrame:
    """The fast ledger's roll-up of sp_book at 10 bps, with market_ret and trading_pnl."""
    from crosstide.operators import ledger

    cells = ledger.fast_cells(sp_book(spark, folder), BOOK, 10.0)
    more = [F.avg("ret").alias("market_ret"), F.sum((F.col("pos") > 0).cast("int")).alias("long_count"), F.sum((F.col("pos") < 0).cast("int")).alias("short_count")]
    daily = ledger.fast_daily(cells, BOOK, more=more)
    dated = daily.withColumn("trading_pnl", F.lit(0.0)).withColumn("date", F.add_months(F.lit("1995-01-01").cast("date"), F.col("di")))
    # A row per session: what reads it several times does not run the book again.
    return files.written(dated.coalesce(1), "daily")


#: References of the panels of events' values and counts.
EV_X, EV_N = "g_demo.field_demo_ev.x", "g_demo.field_demo_ev.n"


def ev_panels(spark: SparkSession, folder: str) -> MemoryPanels:
    """ev as panels over views, on axes of its days and names."""
    e = ev(spark, folder).withColumn("ii", F.col("ii").cast("int"))
    last = e.agg(F.max("di")).first()[0]
    days = [str(date(2024, 1, 1) + timedelta(k)) for k in range(last + 1)]
    out = MemoryPanels(spark, days, [x["ii"] for x in e.select("ii").distinct().orderBy("ii").collect()])  # the axis
    for ref, column in ((EV_X, "x"), (EV_N, "n")):
        out.write(ref, e.select("di", "ii", F.col(column).cast("double").alias("value")), dtype="f8", sessions=(0, last))
    return out


def run_panels(spark: SparkSession, folder: str) -> MemoryPanels:
    """What the demonstration's nodes read: ev, its daily mean, a pool and groups."""
    out = ev_panels(spark, folder)
    whole = (0, out.axes.n_sessions - 1)
    pool = ev_pool(spark, folder)
    out.write("g_demo.field_demo_mkt.mean", out.read(EV_X).groupBy("di").agg(F.avg("value").alias("value")), dims=("di",), dtype="f8", sessions=whole)
    out.write("g_demo.field_demo_pool.top", pool.select("di", "ii", F.col("in_pool").alias("value")), dtype="bool", sessions=whole)
    out.write("g_demo.factor_demo_group.g", pool.select("di", "ii", F.coalesce(F.col("g") + 1, F.lit(0)).alias("value")), dtype="i1", sessions=whole)
    return out


def splits(spark: SparkSession, folder: str) -> DataFrame:
    """(ii, ex_date, ratio, event): every order as a split of the supplier that its customer stands for, ratios 1 to 1.08."""
    suppliers = table(spark, folder, "supplier").agg(F.count(F.lit(1)).alias("n"))
    orders = table(spark, folder, "orders").crossJoin(F.broadcast(suppliers))  # one row
    return orders.select((F.col("o_custkey") % F.col("n")).alias("ii"), F.to_date("o_orderdate").alias("ex_date"), (1 + F.col("o_orderkey") % 5 / 50).cast("double").alias("ratio"), F.col("o_orderkey").alias("event"))


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """(ii, date, close): the mean price by day and supplier."""
    items = table(spark, folder, "lineitem")
    return items.groupBy(F.col("l_suppkey").alias("ii"), F.to_date("l_shipdate").alias("date")).agg(safe_div(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("close"))
