"""Sessions as a stream: idempotent daily writes, late data, and decays that keep state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from crosstide.sources.panels import Panels


def daily_totals(stream: DataFrame, late: str = "2 days", ts: str = "ts", key: str = "user_id", value: str = "value") -> DataFrame:
    """Totals by day and key; a day is final when the watermark passes it, and later rows do not count."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), F.col(key).alias("ii")).agg(F.sum(value).alias("x"), F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("date"), "ii", "x", "n")


def upsert_daily(stream: DataFrame, panels: Panels, ref: str, checkpoint: str, value: str = "x", dtype: str = "f8"):
    """Write each batch's finished sessions to a panel. A batch that repeats replaces its own sessions.

    Batches come in order and hold whole days (append mode), so a session is
    written once, and a repeated batch writes the same rows again.
    """

    def write(batch: DataFrame, _: int) -> None:
        days = sorted(str(r["date"]) for r in batch.select("date").distinct().collect())  # one value per session
        if not days:
            return
        panels.axes.ensure_sessions([d for d in days if d not in panels.axes])
        # Only ids that are not on the axis yet reach the driver.
        strangers = batch.select(F.col("ii").cast("int").alias("ii")).distinct().join(panels.axes.security_table(), "ii", "left_anti")
        panels.axes.ensure_securities([r["ii"] for r in strangers.orderBy("ii").collect()])
        first, last = panels.axes.pos(days[0]), panels.axes.pos(days[-1])
        rows = batch.join(F.broadcast(panels.axes.session_table(first, last + 1)), "date").select("di", "ii", F.col(value).alias("value"))
        panels.write(ref, rows, dtype=dtype, sessions=(first, last))

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)


def streaming_exp_decay(stream: DataFrame, half_life: int) -> DataFrame:
    """stream (di, ii, x) to (di, ii, y): decayed weighted means whose two sums are kept per security.

    The sums decay with the sessions that passed since the security's last row, so
    sessions without a row count as missing. Rows of a security arrive in the order
    of sessions between batches; within a batch they are sorted.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, weight, last = state.get if state.exists else (0.0, 0.0, None)
        rows = pd.concat(list(frames)).sort_values("di")
        out = []
        for di, x in zip(rows["di"], rows["x"]):
            if last is not None:
                fade = 0.5 ** ((di - last) / half_life)
                total, weight = total * fade, weight * fade
            if pd.notna(x):
                total, weight = total + float(x), weight + 1.0
            last = int(di)
            out.append((last, key[0], total / weight if weight else None))
        state.update((total, weight, last))
        yield pd.DataFrame(out, columns=["di", "ii", "y"])

    return stream.groupBy("ii").applyInPandasWithState(step, "di int, ii long, y double", "total double, weight double, last int", "append", GroupStateTimeout.NoTimeout)


class DelayProcessor(StatefulProcessor):
    """delay k over a stream keyed by ii, for transformWithStateInPandas: the last k sessions are the state."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getMapState("past", "di int", "x double")

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows)).sort_values("di")
        out = []
        for di, x in zip(frame["di"], frame["x"]):
            before = (int(di) - self.k,)
            out.append((int(di), key[0], self.past.getValue(before)[0] if self.past.containsKey(before) else None))
            self.past.updateValue((int(di),), (None if pd.isna(x) else float(x),))
            for (old,) in [k for k in self.past.keys() if k[0] < di - self.k]:
                self.past.removeKey((old,))
        yield pd.DataFrame(out, columns=["di", "ii", "y"])

    def close(self) -> None:
        pass


class Cursor:
    """Sessions must come one after the other; anything else shifts every lag without a word."""

    def __init__(self):
        self.last: int | None = None

    def advance(self, t: int) -> None:
        if self.last is not None and t != self.last + 1:
            raise ValueError(f"session {t} after {self.last}: reset() before another period")
        self.last = t

    def reset(self) -> None:
        self.last = None
