"""The base panels of the store, from the daily tables."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.operators import cross_section as cs
from crosstide.operators import time_series as ts
from crosstide.sources import files, pipe
from crosstide.sources.panels import Store

#: Names of the base panels.
PRICE, VOLUME, RETURN = (f"g_common.field_base_px.{n}" for n in ("adj_close_1500", "volume_1500", "ret_1d_1500"))
ADV, MARKET, SECTOR = "g_common.field_base_px.adv_dollar", "g_common.field_base_px.market_ret", "g_common.factor_common_gics.sector"
POOL = "g_common.field_common_univ.us_top{n}"
ADV_SESSIONS, ADV_LEAST = 20, 5


def base_frame(bars: DataFrame, sectors: DataFrame, grid: DataFrame, top: int) -> DataFrame:
    """All base panels on one dense frame (di, ii): prices and sectors join once, windows share their exchange."""
    cells = bars.select("di", "ii", (F.col("close") * F.col("adj_factor")).cast("float").cast("double").alias("adj_close"), F.col("volume").cast("double").alias("volume"), (F.col("close") * F.col("volume")).cast("float").cast("double").alias("dollar"))
    frame = grid.join(cells, ["di", "ii"], "left").join(sectors.select("di", "ii", "sector"), ["di", "ii"], "left")
    frame = frame.withColumns({"ret_1d": ts.pct_change("adj_close"), "adv_dollar": ts.mean("dollar", ADV_SESSIONS, ADV_LEAST), "sector": F.coalesce(ts.forward_fill("sector"), F.lit(0))})
    return cs.top_members(frame, "adv_dollar", top, out="in_pool")


def market_return(frame: DataFrame) -> DataFrame:
    """Equal-weighted mean of the returns that are there."""
    return frame.groupBy("di").agg(F.avg("ret_1d").alias("value"))


def build_base(spark: SparkSession, tables: str, store: Store, top: int = 400, asof: str = "", securities: list[int] | None = None) -> list[str]:
    """Read the daily tables under a folder, extend the axes and write the seven panels anew.

    The securities are those of the latest sec_master file unless they are given.
    """
    calendar = pipe.read_daily(spark, tables, "calendar").orderBy("session")
    dates = [str(r["date"]) for r in calendar.select("date").collect()]  # one value per session
    names = securities or [r[0] for r in pipe.read_daily(spark, tables, "sec_master", latest=True).select("security_id").distinct().orderBy("security_id").collect()]
    store.create_axes(dates, names)
    days = F.broadcast(store.axes.session_table())
    keyed = lambda df: df.withColumnRenamed("security_id", "ii").join(days, "date")
    bars, sectors = keyed(pipe.read_daily(spark, tables, "pv")), keyed(pipe.read_daily(spark, tables, "industry")).withColumnRenamed("gics_sector_code", "sector")
    frame = files.written(base_frame(bars, sectors, store.axes.grid(), top), "base")
    span = (0, store.axes.n_sessions - 1)
    fingerprint = "sha256:" + hashlib.sha256(Path(__file__).read_bytes() + asof.encode()).hexdigest()[:16]
    jobs = [(PRICE, "adj_close", "f4"), (VOLUME, "volume", "f4"), (RETURN, "ret_1d", "f4"), (ADV, "adv_dollar", "f4"), (SECTOR, "sector", "i1"), (POOL.format(n=top), "in_pool", "bool")]
    meta = {"region": store.region, "cutoff": "1500", "source_asof": asof}
    for ref, column, dtype in jobs:
        store.write(ref, frame.select("di", "ii", F.col(column).alias("value")), dtype=dtype, sessions=span, rebuild=True, fingerprint=fingerprint, meta=meta)
    store.write(MARKET, market_return(frame), dims=("di",), sessions=span, rebuild=True, fingerprint=fingerprint, meta=meta)
    return [*(j[0] for j in jobs), MARKET]
