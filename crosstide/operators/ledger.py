"""The position-value ledger: target weights and returns to positions, flows and a daily roll-up.

Positions are coupled across securities (frozen value leaves the book that the
rest shares) and along sessions, so the general path folds over sessions, once
per strategy, in arrays; strategies and book sizes run in parallel, and long
histories run in chunks of sessions that carry positions. Everything before and
after the fold is a plan. Where nothing is frozen, delisted or capped, the fast
path needs windows only.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions.scalar import nan_to_null, safe_div
from crosstide.operators import time_series as ts
from crosstide.sources.files import discard, written

BPS = 1e-4
#: Cells of a strategy that one task holds; longer histories run in chunks of sessions.
CELLS_AT_ONCE = 4_000_000
#: Cells of an Arrow batch that the fold sends back.
SENT_AT_ONCE = 200_000
KEYS = ["strategy", "di", "ii"]
#: Columns of the daily roll-up, in order.
DAILY_COLUMNS = [
    "long_value", "short_value", "long_count", "short_count", "trade_dollar", "holding_pnl", "trading_pnl", "cost", "cash", "pnl", "return", "alpha_turnover", "realloc_turnover",
    "gap_participation", "gap_realloc", "gap_reprice", "cash_account", "nav", "frozen_value", "frozen_count", "avail", "frozen_reprice_pnl", "ghost_count", "ghost_value", "delist_close_value",
    "market_ret", "weight_gross", "target_count", "oop_weight",
]


class SimError(RuntimeError):
    """Inputs that a simulation cannot be trusted on."""


@dataclass
class SimResult:
    cells: DataFrame  # strategy, di, ii and what happened to the position
    daily: DataFrame  # strategy, di, DAILY_COLUMNS
    audit: dict = field(default_factory=dict)

    @property
    def booksize(self) -> float:
        return float(self.audit["booksize"])

    @property
    def holding(self) -> DataFrame:
        """Value and weight of each holding: the weight is value over the book."""
        return self.cells.select(*KEYS, F.col("pos").alias("holding_value"), (F.col("pos") / self.booksize).alias("holding_weight"))

    def discard(self) -> None:
        """Delete the written cells and days."""
        discard(self.cells, self.daily)

    def identity_gaps(self) -> DataFrame:
        """Largest violation of the two accounting identities, per strategy: both are 0 but for rounding."""
        cell = F.abs(F.col("pos") - F.col("prev") - (F.col("pnl") + F.col("delta") + F.col("settle") + F.col("cost")))
        own = Window.partitionBy("strategy").orderBy("di")
        nav = F.abs(F.col("nav") - F.coalesce(F.lag("nav").over(own), F.lit(0.0)) - F.col("pnl"))
        days = self.daily.withColumn("_g", nav).groupBy("strategy").agg(F.max("_g").alias("nav_gap"))
        return self.cells.groupBy("strategy").agg(F.max(cell).alias("cell_gap")).join(days, "strategy")


# --------------------------------------------------------------------- the fold
_INPUT = ["w", "ret", "cap", "bps", "halted", "delist_ord", "day_ord", "in_pool", "pos0", "frozen0", "seen0"]
_OUTPUT = "strategy string, di int, ii int, w double, prev double, hp double, adv_pos double, target double, target_free double, wanted double, delta double, cost double, settle double, pos double, pnl double, frozen boolean, ghost boolean, tradable boolean, due boolean, closed boolean, reprice double, r double, missing boolean, no_cap boolean, halted boolean, in_pool boolean, avail double, frozen_value double"


def _fold(days: np.ndarray, names: np.ndarray, grid: dict[str, np.ndarray], booksize: float, detect: bool) -> dict[str, np.ndarray]:
    """One strategy's sessions in order: arrays of sessions by securities in, the same out."""
    t_n, n = len(days), len(names)
    weight = grid["w"].astype(float)
    raw = grid["ret"].astype(float)
    missing = np.isnan(raw)
    growth = np.where(missing, 0.0, raw)
    cap = grid["cap"].astype(float)  # infinite: no limit; NaN: none known
    bps = grid["bps"].astype(float)
    halted, pool = grid["halted"].astype(bool), grid["in_pool"].astype(bool)
    gone = grid["day_ord"] > grid["delist_ord"]
    due = grid["day_ord"] >= grid["delist_ord"]
    tradable = ~missing & ~gone
    gross = np.abs(weight).sum(axis=1)
    free = np.divide(weight, gross[:, None], out=np.zeros_like(weight), where=gross[:, None] > 0) * booksize
    pos, was_frozen, seen = grid["pos0"][0].astype(float), grid["frozen0"][0].astype(bool), grid["seen0"][0].astype(bool)
    out = {c: np.zeros((t_n, n)) for c in ("prev", "hp", "adv_pos", "target", "wanted", "delta", "cost", "settle", "pos", "reprice")}
    flags = {c: np.zeros((t_n, n), bool) for c in ("frozen", "ghost", "closed", "no_cap")}
    avail, stuck_value = np.zeros(t_n), np.zeros(t_n)
    for t in range(t_n):
        prev, held = pos, pos != 0
        gain = prev * growth[t]
        moved = prev + gain
        ghost = missing[t] & ~gone[t] & ~halted[t] & held if detect else np.zeros(n, bool)
        frozen = ~tradable[t] & (moved != 0) & ~ghost & ~due[t]
        # Gross, so that longs and shorts that are stuck do not offset each other.
        stuck_value[t] = np.abs(moved[frozen]).sum()
        avail[t] = max(booksize - stuck_value[t], 0.0)
        share = np.where(tradable[t] & ~due[t], weight[t], 0.0)
        total = np.abs(share).sum()
        target = (share / total if total > 0 else share) * avail[t]
        wanted = np.where(tradable[t], target - moved, 0.0)
        limit = np.where(np.isnan(cap[t]), np.inf, np.maximum(cap[t], 0.0))
        delta = np.clip(wanted, -limit, limit)
        after = moved + delta
        settle = np.where((due[t] & (after != 0)) | ghost, -after, 0.0)
        pos = after + settle
        closed = due[t] & ~seen & held
        seen = seen | due[t]
        values = (prev, gain, moved, target, wanted, delta, np.abs(delta) * bps[t] * BPS, settle, pos, np.where(was_frozen & tradable[t], gain, 0.0))
        for c, v in zip(out, values):
            out[c][t] = v
        for c, v in zip(flags, (frozen, ghost, closed, np.isnan(cap[t]) & (wanted != 0))):
            flags[c][t] = v
        was_frozen = frozen
    return out | flags | {
        "w": weight, "target_free": free, "r": growth, "missing": missing, "tradable": tradable, "due": due, "halted": halted, "in_pool": pool, "pnl": out["hp"] - out["cost"],
        "avail": np.repeat(avail[:, None], n, axis=1), "frozen_value": np.repeat(stuck_value[:, None], n, axis=1),
    }


def _folder(booksize: float, detect: bool):
    """The fold for mapInArrow: a row holds a session's cells as arrays, in order of strategy and session."""
    names_out = [c.split()[0] for c in _OUTPUT.split(", ")][2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            strategies = batch.column(0).to_pylist()
            at = 0
            while at < len(strategies):
                end = at
                while end < len(strategies) and strategies[end] == strategies[at]:
                    end += 1
                if strategies[at] != key:
                    yield from done(key, held)
                    held, key = [], strategies[at]
                held.append(batch.slice(at, end - at))
                at = end
        yield from done(key, held)

    def done(key, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        days = table.column("di").to_numpy()
        flat = {c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ["ii", *_INPUT]}
        ii = flat.pop("ii").reshape(len(days), -1) if len(flat["ii"]) % len(days) == 0 else None
        if ii is None or (ii != ii[0]).any():
            raise SimError("the ledger needs every security on every session once")
        grid = {c: v.reshape(ii.shape) for c, v in flat.items()}
        out = _fold(days, ii[0], grid, booksize, detect) | {"ii": ii}
        step = max(1, SENT_AT_ONCE // ii.shape[1])
        for a in range(0, len(days), step):
            part = days[a : a + step]
            offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * ii.shape[1])
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(out[c][a : a + step]).ravel())) for c in names_out]
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), pa.string()), pa.array(part, pa.int32()), *lists], ["strategy", "di", *names_out])

    return run


def _run_fold(start: DataFrame, booksize: float, detect: bool) -> DataFrame:
    """Cells in, cells out. Sessions are packed to arrays and unpacked in parallel; one task folds a strategy."""
    cells = F.sort_array(F.collect_list(F.struct("ii", *_INPUT)))
    packed = start.groupBy("strategy", "di").agg(cells.alias("c")).select("strategy", "di", *[F.col(f"c.{x}").alias(x) for x in ["ii", *_INPUT]])
    fields = [f.split() for f in _OUTPUT.split(", ")][2:]
    schema = "strategy string, di int, " + ", ".join(f"{n} array<{t}>" for n, t in fields)
    folded = packed.repartition("strategy").sortWithinPartitions("strategy", "di").mapInArrow(_folder(booksize, detect), schema)
    rows = folded.repartition("strategy", "di").select("strategy", "di", F.explode(F.arrays_zip(*[n for n, _ in fields])).alias("c"))
    return rows.select("strategy", "di", *[f"c.{n}" for n, _ in fields])


def _daily(cells: DataFrame, booksize: float, with_pool: bool) -> DataFrame:
    """The roll-up of cells by session: one aggregation, and running sums over its few rows."""
    pos, trade = F.col("pos"), F.abs("delta")
    by_alpha, by_freeze = F.abs(F.col("target_free") - F.col("adv_pos")), F.abs(F.col("target") - F.col("target_free"))
    share = F.coalesce(safe_div(by_alpha, by_alpha + by_freeze), F.lit(1.0))
    traded = F.when(F.col("tradable"), trade).otherwise(0.0)
    when = lambda c, v: F.sum(F.when(c, v).otherwise(0.0))
    count = lambda c: F.sum(c.cast("int"))
    open_, shut = F.col("tradable"), ~F.col("tradable")
    live = F.count(F.lit(1)) - count(F.col("missing"))
    out = cells.groupBy("strategy", "di").agg(
        when(pos > 0, pos).alias("long_value"), when(pos < 0, pos).alias("short_value"), count(pos > 0).alias("long_count"), count(pos < 0).alias("short_count"),
        F.sum(trade).alias("trade_dollar"), F.sum("hp").alias("holding_pnl"), F.lit(0.0).alias("trading_pnl"), F.sum("cost").alias("cost"), (booksize - F.sum(F.abs(pos))).alias("cash"),
        F.sum("pnl").alias("pnl"), (F.sum("pnl") / booksize).alias("return"), (F.sum(traded * share) / booksize).alias("alpha_turnover"), (F.sum(traded * (1 - share)) / booksize).alias("realloc_turnover"),
        when(open_, F.abs(F.col("wanted") - F.col("delta"))).alias("gap_participation"), when(open_, by_freeze).alias("gap_realloc"), when(shut, F.abs(F.col("target_free") - pos)).alias("gap_reprice"),
        F.sum(-(F.col("delta") + F.col("cost") + F.col("settle"))).alias("_cash"), F.sum(pos).alias("_net"),
        F.max("frozen_value").alias("frozen_value"), count(F.col("frozen")).alias("frozen_count"), F.max("avail").alias("avail"), F.sum("reprice").alias("frozen_reprice_pnl"),
        count(F.col("ghost")).alias("ghost_count"), when(F.col("ghost"), F.abs("prev")).alias("ghost_value"), when(F.col("closed"), F.abs("adv_pos")).alias("delist_close_value"),
        F.when(live > 0, F.sum("r") / live).alias("market_ret"), F.sum(F.abs("w")).alias("weight_gross"), count(F.col("w") != 0).alias("target_count"),
        (when(~F.col("in_pool"), F.abs("w")) if with_pool else F.lit(None).cast("double")).alias("oop_weight"),
    )
    cash = F.sum("_cash").over(Window.partitionBy("strategy").orderBy("di"))
    return out.withColumn("cash_account", cash).withColumn("nav", F.col("_net") + F.col("cash_account")).select("strategy", "di", *DAILY_COLUMNS)


def _keyed(df: DataFrame, value: str, cast: str = "double") -> DataFrame:
    return df.select(F.col("di").cast("int").alias("di"), F.col("ii").cast("int").alias("ii"), (nan_to_null(value) if cast == "double" else F.col(value).cast(cast)).alias(value))


def _check_dense(dense: DataFrame) -> None:
    """A session of the weights without any row in a panel is an error, and so are cells without a cost and names without returns."""
    days = dense.groupBy("di").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(c) for c in ("has_w", "has_ret", "has_adv", "has_cost")], F.sum(F.col("bps").isNull().cast("long")).alias("costless"))
    lacking = [f(F.when(F.col("has_w") & ~F.col(c), F.col("di"))).alias(f"{c}_{n}") for c in ("has_ret", "has_adv", "has_cost") for n, f in (("first", F.min), ("n", F.count))]
    found = days.agg(*lacking, F.sum("costless").alias("costless")).first()
    for c, what in (("has_ret", "ret"), ("has_adv", "adv_dollar"), ("has_cost", "cost_bps")):
        if found[f"{c}_n"]:
            raise SimError(f"{what} lacks {found[f'{c}_n']} sessions of the weights, first number {found[f'{c}_first']}")
    if found["costless"]:
        raise SimError("cost_bps has missing cells: fill them with 0 or a model's value")
    names = dense.groupBy("strategy", "ii").agg(F.max(F.abs("w")).alias("g"), F.count("ret").alias("k")).where("g > 0 AND k = 0")
    n, one = names.agg(F.count(F.lit(1)), F.min("ii")).first()
    if n:
        raise SimError(f"{n} securities carry weight but have no return at all, such as {one}: axes or dates do not match")


def simulate(
    weights: DataFrame, ret: DataFrame, *, booksize: float, adv_dollar: DataFrame | None = None, cost_bps: DataFrame | float = 0.0, delist: DataFrame | None = None, sessions: DataFrame | None = None,
    is_halted: DataFrame | None = None, participation: float = 0.10, halt_proxy: int | None = None, universe: DataFrame | None = None, ghost_tolerance: float = 0.005, securities: DataFrame | None = None, chunk_sessions: int | None = None, keep: bool = True,
) -> SimResult:
    """weights (di, ii, w[, strategy]) and returns (di, ii, ret) to a SimResult.

    adv_dollar (di, ii, adv), cost_bps (a number or di, ii, cost_bps), is_halted
    (di, ii, halted) and universe (di, ii, in_pool) are panels; delist (ii,
    delist_date) needs sessions (di, date). securities (ii) is the axis, by default
    the names of the weights. A missing weight is 0, a missing limit is none, a
    missing cost is an error. NaN counts as missing everywhere. chunk_sessions sets
    the sessions that are folded at once; by default they follow CELLS_AT_ONCE. keep
    writes the cells to the shared folder, so that they are folded once.
    """
    booksize = float(booksize)
    if not np.isfinite(booksize) or booksize <= 0:
        raise SimError(f"booksize must be positive and finite, not {booksize}")
    if not 0 < participation <= 1:
        raise SimError(f"participation must lie in (0, 1], not {participation}")
    if is_halted is None and halt_proxy is None:
        raise SimError("no halt signal: pass is_halted, or halt_proxy=K >= 2 (degraded), or halt_proxy=0 to go without detection")
    if is_halted is None and halt_proxy == 1:
        raise SimError("halt_proxy=1 would count every missing return as a halt; use K >= 2, or 0 to go without")
    if is_halted is not None and halt_proxy is not None:
        warnings.warn("both is_halted and halt_proxy given: the field counts", stacklevel=2)
    if "strategy" not in weights.columns:
        weights = weights.withColumn("strategy", F.lit("book"))
    own = weights.select("strategy", F.col("di").cast("int").alias("di"), F.col("ii").cast("int").alias("ii"), nan_to_null("w").alias("w"))
    table = written if keep else lambda df, _: df
    own = table(own, "weights")
    # One pass: extent, cells and cells that occur twice.
    once = own.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.count("w").alias("g"))
    first, last, days, cells_n, given, most = once.agg(F.min("di"), F.max("di"), F.countDistinct("di"), F.sum("n"), F.sum("g"), F.max("n")).first()
    if first is None:
        raise SimError("weights are empty")
    if most > 1:
        raise SimError("a security has two weights on one session")
    axis = (securities or own).select("ii").distinct()
    span = own.groupBy("strategy").agg(F.min("di").alias("a"), F.max("di").alias("z"))
    dense = span.crossJoin(F.broadcast(axis)).select("strategy", F.explode(F.sequence("a", "z")).alias("di"), "ii")  # a few strategies by the axis
    dense = dense.join(own.withColumn("has_w", F.lit(True)), KEYS, "left").fillna({"w": 0.0})
    dense = dense.join(_keyed(ret, "ret").withColumn("has_ret", F.lit(True)), ["di", "ii"], "left")
    if adv_dollar is None:
        dense = dense.withColumns({"cap": F.lit(float("inf")), "has_adv": F.lit(True)})
    else:
        adv = _keyed(adv_dollar, "adv").withColumn("has_adv", F.lit(True))
        dense = dense.join(adv, ["di", "ii"], "left").withColumn("cap", F.col("adv") * participation).drop("adv")
    if isinstance(cost_bps, DataFrame):
        dense = dense.join(_keyed(cost_bps, "cost_bps").withColumnRenamed("cost_bps", "bps").withColumn("has_cost", F.lit(True)), ["di", "ii"], "left")
        cost_kind = "panel"
    else:
        if not np.isfinite(cost_bps):
            raise SimError("cost_bps is not a finite number")
        dense = dense.withColumns({"bps": F.lit(float(cost_bps)), "has_cost": F.lit(True)})
        cost_kind = "flat"
    never = F.lit(1 << 40)
    if delist is None:
        dense = dense.withColumns({"delist_ord": never, "day_ord": F.col("di").cast("long")})
        warnings.warn("no delist dates: delisted securities would stay frozen for good (delist_source=none)", stacklevel=2)
    else:
        if sessions is None:
            raise SimError("delist dates need the session dates")
        dates = F.broadcast(sessions.select("di", F.unix_date(F.to_date("date")).cast("long").alias("day_ord")))
        ends = delist.select(F.col("ii").cast("int").alias("ii"), F.unix_date(F.to_date("delist_date")).cast("long").alias("delist_ord"))
        dense = dense.join(dates, "di").join(ends, "ii", "left").withColumn("delist_ord", F.coalesce("delist_ord", never))
    if is_halted is not None:
        dense = dense.join(_keyed(is_halted, "halted", "boolean"), ["di", "ii"], "left").fillna({"halted": False})
        detection = "field"
    elif halt_proxy == 0:
        dense, detection = dense.withColumn("halted", F.lit(False)), "disabled"
    else:
        dense, detection = dense.withColumn("halted", F.lit(False)), f"proxy({int(halt_proxy)})"
    if universe is None:
        dense = dense.withColumn("in_pool", F.lit(True))
    else:
        dense = dense.join(_keyed(universe, "in_pool", "boolean"), ["di", "ii"], "left").fillna({"in_pool": False})
    # From here on the inputs are a table: the checks, and each chunk, read it again.
    dense = dense_table = table(dense.select(*KEYS, *[c for c in _INPUT if c not in ("pos0", "frozen0", "seen0")], "has_w", "has_ret", "has_adv", "has_cost"), "ledger")
    _check_dense(dense)
    if detection.startswith("proxy"):
        dense = ts.halted_by_proxy(dense.drop("halted"), "ret", int(halt_proxy), within=F.col("day_ord") <= F.col("delist_ord"), by=("strategy", "ii"))
    cost_mean = dense.agg(F.avg("bps")).first()[0] if cost_kind == "panel" else float(cost_bps)
    if chunk_sessions is None and (names := axis.count()) * (last - first + 1) > CELLS_AT_ONCE:
        chunk_sessions = max(20, CELLS_AT_ONCE // names)
    cells = _folded(dense, booksize, detection != "disabled", first, last, chunk_sessions)
    if keep and (not chunk_sessions or last - first < chunk_sessions):
        cells = written(cells, "cells")
    daily = _daily(cells, booksize, universe is not None)
    if keep:
        daily = written(daily.coalesce(1), "daily")  # a row per session and strategy
    count = lambda c: F.sum(c.cast("long"))
    ghosts = F.col("ghost")
    a = cells.agg(
        count(ghosts).alias("ghost_cells"), F.countDistinct(F.when(ghosts, F.col("di"))).alias("ghost_days"), count(F.col("prev") != 0).alias("held"), count(F.col("closed")).alias("delist_events"),
        count(F.col("halted")).alias("halt_cells"), count(F.col("no_cap")).alias("uncapped"), F.countDistinct("ii").alias("n"),
    ).first()
    rate = a["ghost_cells"] / a["held"] if a["held"] else 0.0
    examples = [(r["di"], r["ii"], r["prev"]) for r in cells.where(ghosts).orderBy("di", "ii").limit(10).select("di", "ii", "prev").collect()] if a["ghost_cells"] else []
    if detection != "disabled" and rate > ghost_tolerance:
        raise SimError(f"{a['ghost_cells']} held cells ({rate:.2%}, tolerance {ghost_tolerance:.2%}) have a missing return that is neither a delisting nor a halt, such as {examples[:5]}")
    if a["ghost_cells"]:
        warnings.warn(f"{a['ghost_cells']} ghost cells on {a['ghost_days']} sessions were closed at their last price ({detection})", stacklevel=2)
    audit = {
        "booksize": booksize, "participation": participation, "n_sessions": days, "n_securities": a["n"], "sd": first, "ed": last, "ghost_detection": detection, "ghost_detection_lookahead": detection.startswith("proxy"),
        "delist_source": "none" if delist is None else "field", "ghost_days": a["ghost_days"], "ghost_cells": a["ghost_cells"], "ghost_rate": rate, "ghost_examples": examples, "ghost_tolerance": ghost_tolerance,
        "delist_events": a["delist_events"], "halt_cells": a["halt_cells"], "weight_nan_cells": int(cells_n - given), "adv_uncapped_cells": a["uncapped"], "adv_constrained": adv_dollar is not None,
        "universe_supplied": universe is not None, "cost_model": cost_kind, "cost_bps_avg": cost_mean,
    }
    if keep:
        discard(own, dense_table)  # cells and days are tables of their own by now
    return SimResult(cells, daily, audit)


def _folded(dense: DataFrame, booksize: float, detect: bool, first: int, last: int, chunk: int | None) -> DataFrame:
    """The fold, whole or in chunks of sessions that hand on positions."""
    start = dense.withColumns({"pos0": F.lit(0.0), "frozen0": F.lit(False), "seen0": F.lit(False)}).select(*KEYS, *_INPUT)
    run = lambda df: _run_fold(df, booksize, detect)
    if not chunk or last - first < chunk:
        return run(start)
    done: list[DataFrame] = []
    state = None
    for a in range(first, last + 1, chunk):
        part = start.where(F.col("di").between(a, a + chunk - 1))
        if state is not None:
            part = part.drop("pos0", "frozen0", "seen0").join(state, ["strategy", "ii"], "left").fillna({"pos0": 0.0, "frozen0": False, "seen0": False}).select(*KEYS, *_INPUT)
        done.append(written(run(part), "cells"))
        ends = done[-1].join(done[-1].groupBy("strategy").agg(F.max("di").alias("di")), ["strategy", "di"])
        state = ends.select("strategy", "ii", F.col("pos").alias("pos0"), F.col("frozen").alias("frozen0"), F.col("due").alias("seen0"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


# ------------------------------------------------------------------ the fast path
def fast_cells(panel: DataFrame, booksize: float, cost_bps: float = 0.0, by: tuple[str, ...] = ("ii",), day: tuple[str, ...] = ("di",)) -> DataFrame:
    """panel (di, ii, w, ret), dense, without frozen, delisted or capped cells: positions are the targets.

    Adds target_free, prev, hp, delta, cost, pos and pnl. A missing return counts as 0.
    """
    gross = F.sum(F.abs(F.coalesce("w", F.lit(0.0)))).over(Window.partitionBy(*day))
    target = F.coalesce(safe_div(F.coalesce(F.col("w"), F.lit(0.0)), gross), F.lit(0.0)) * booksize
    out = panel.withColumn("target_free", target)
    out = out.withColumn("prev", F.coalesce(F.lag("target_free").over(ts.along(by)), F.lit(0.0)))
    out = out.withColumn("hp", F.col("prev") * F.coalesce(F.col("ret"), F.lit(0.0)))
    out = out.withColumn("delta", F.col("target_free") - F.col("prev") - F.col("hp"))
    out = out.withColumn("cost", F.abs("delta") * (cost_bps * BPS)).withColumn("pos", F.col("target_free"))
    return out.withColumn("pnl", F.col("hp") - F.col("cost"))


def fast_daily(cells: DataFrame, booksize: float, by: tuple[str, ...] = (), more: list[Column] | None = None) -> DataFrame:
    """(by..., di, long_value, short_value, trade_dollar, holding_pnl, cost, pnl, return, cash_account, nav), and more sums of the sessions."""
    pos = F.col("pos")
    out = cells.groupBy(*by, "di").agg(
        F.sum(F.greatest(pos, F.lit(0.0))).alias("long_value"), F.sum(F.least(pos, F.lit(0.0))).alias("short_value"), F.sum(F.abs("delta")).alias("trade_dollar"),
        F.sum("hp").alias("holding_pnl"), F.sum("cost").alias("cost"), F.sum("pnl").alias("pnl"), F.sum(-(F.col("delta") + F.col("cost"))).alias("_cash"), F.sum(pos).alias("_net"), *more or [],
    )
    cash = F.sum("_cash").over(Window.partitionBy(*by).orderBy("di"))  # over one row per session
    return out.withColumn("return", F.col("pnl") / booksize).withColumn("cash_account", cash).withColumn("nav", F.col("_net") + F.col("cash_account")).drop("_cash", "_net")


def held(cells: DataFrame) -> Column:
    return F.col("prev") != 0
