"""Weights to metrics: read, simulate, measure, write and show."""

from __future__ import annotations

import difflib
import json
import math
import unicodedata
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.operators import gates
from crosstide.operators import metrics as m
from crosstide.operators.ledger import SimResult, simulate
from crosstide.plans import base
from crosstide.sources import files
from crosstide.sources.panels import Panels, StoreError
from crosstide.sources.weights import drop_empty_sessions, read_weights, require_contiguous

#: What the data are known to lack; goes with every result.
KNOWN_DEFECTS = ["survivorship_bias_no_delisted", "no_vwap", "no_shares_outstanding", "equal_weighted_market_proxy"]
TABLE_ROWS = 36


def plain(x):
    """For strict JSON: NaN and infinities are null, keys are text."""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x if x is None or isinstance(x, (bool, int, float, str)) else str(x)


def measure(result: SimResult, sessions: DataFrame, *, market: DataFrame | None = None, meta: dict | None = None, thresholds: dict | None = None, days: int = m.DAYS) -> dict:
    """All metrics of one strategy as plain values. sessions: (di, date)."""
    audit, book = result.audit, result.booksize
    daily = result.daily.join(F.broadcast(sessions.select("di", "date")), "di")
    scalar = m.scalars(daily, book, days).first().asDict()
    fall = m.drawdown(daily).first()
    scalar |= {"max_drawdown_dollar": fall["max_drawdown"], "max_drawdown": fall["max_drawdown"] / book}
    dates = {r["di"]: str(r["date"]) for r in daily.where(F.col("di").isin(fall["from_di"], fall["to_di"])).select("di", "date").collect()}
    scalar |= {"max_drawdown_from": dates.get(fall["from_di"]), "max_drawdown_to": dates.get(fall["to_di"])}
    if not scalar["avg_short_value"]:
        scalar["long_short_ratio"] = math.inf
    per = {r["period"]: {k: v for k, v in r.asDict().items() if k != "period"} for r in m.periods(daily, book, days).collect()}
    by_year = {k: per[k] for k in sorted(per) if len(k) == 4}
    judged = gates.evaluate(result, thresholds=thresholds, market=market, meta=meta, by_year=by_year, days=days)
    mean = lambda c: F.avg(c).alias(f"{c}_avg")
    summed = daily.agg(
        mean("frozen_value"), F.max("frozen_value").alias("frozen_value_max"), mean("frozen_count"), F.sum("frozen_reprice_pnl").alias("frozen_reprice_pnl"), mean("realloc_turnover"), mean("alpha_turnover"), mean("cash"), F.max("cash").alias("cash_max"),
        mean("gap_participation"), mean("gap_realloc"), mean("gap_reprice"), F.max_by("nav", "di").alias("nav_final"),
    ).first().asDict()
    passed_on = ("ghost_detection", "ghost_detection_lookahead", "delist_source", "ghost_days", "ghost_cells", "ghost_rate", "ghost_examples", "delist_events", "halt_cells", "weight_nan_cells", "adv_uncapped_cells")
    snapshot = {k: audit[k] for k in ("booksize", "participation", "sd", "ed", "n_sessions", "n_securities", "cost_model", "cost_bps_avg", "adv_constrained", "ghost_detection", "delist_source")} | {"ann_days": days} | (meta or {})
    return plain({"scalar": scalar, "by_year": by_year, "by_month": {k: per[k] for k in sorted(per) if len(k) == 7}, "audit": {k: audit[k] for k in passed_on} | summed, **judged, "snapshot": snapshot})


def write_deliverables(result: SimResult, sessions: DataFrame, folder: str, metrics: dict | None = None) -> dict[str, str]:
    """holding, pnl and daily as pipe files, one row per session, and metrics.json."""
    dated = result.cells.join(F.broadcast(sessions.select("di", "date")), "di")
    names = [r[0] for r in dated.select("ii").distinct().orderBy("ii").collect()]  # the columns of the files
    wide = lambda df, value: df.groupBy("date").pivot("ii", names).agg(F.first(value))
    cells = dated.withColumn("holding_weight", F.col("pos") / result.booksize)
    value = wide(cells, "pos").withColumnsRenamed({str(n): f"holding_value:{n}" for n in names})
    weight = wide(cells, "holding_weight").withColumnsRenamed({str(n): f"holding_weight:{n}" for n in names})
    daily = result.daily.join(F.broadcast(sessions.select("di", "date")), "di").drop("di", "strategy")
    tables = {"holding": value.join(weight, "date"), "pnl": wide(dated, "pnl"), "daily": daily.select("date", *[c for c in daily.columns if c != "date"])}
    out = {}
    for name, df in tables.items():
        out[name] = f"{folder}/{name}.psv"
        df.orderBy("date").coalesce(1).write.options(sep="|", header="true").mode("overwrite").csv(out[name])  # one row per session
    if metrics is not None:
        files.write_text(result.cells.sparkSession, f"{folder}/metrics.json", json.dumps(metrics, indent=1, ensure_ascii=False, allow_nan=False))
    return out


def evaluate(panels: Panels, *, node: str | None = None, weight: str | None = None, sd: str | None = None, ed: str | None = None, booksize: float = 20e6, return_metric: str = base.RETURN, cost_bps: float = 10.0, participation: float = 0.10, halt_proxy: int | None = None, universe: str | None = None, delist: DataFrame | None = None, out: str | None = None, region_hash: str | None = None, by: str = "both", show: bool = False, adv_ref: str = base.ADV, market_ref: str = base.MARKET) -> dict:
    """Simulate a stored alpha, or weights from a file, and return its metrics.

    universe and delist are optional: without them the pool gate has no basis and
    the look-ahead gate fails, as nothing was checked.
    """
    axes = panels.axes
    if weight:
        w = read_weights(panels.spark, weight)
        w = w.join(axes.session_table(), "date", "left")
    else:
        if not panels.exists(node):
            near = difflib.get_close_matches(node, panels.list_refs(), 3, 0.4)
            raise StoreError(f"no node {node}" + (f"; did you mean {', '.join(near)}?" if near else "") + " (an alpha's output is called weight)")
        w = panels.read(node, sd, ed).withColumnRenamed("value", "w").join(axes.session_table(), "di")
    w = drop_empty_sessions(w)
    first, last = require_contiguous(w, axes)
    lo, hi = axes.date(first), axes.date(last)
    read = lambda ref, name: panels.read(ref, lo, hi).withColumnRenamed("value", name) if panels.exists(ref) else None
    pool = read(universe, "in_pool") if universe else None
    # A price move needs both ends: sessions without any return (the first) are kept as missing.
    returns = read(return_metric, "ret").unionByName(axes.session_table(first, last + 1).select("di", F.lit(axes.securities[0]).alias("ii"), F.lit(None).cast("float").alias("ret"))).groupBy("di", "ii").agg(F.max("ret").alias("ret"))
    adv = read(adv_ref, "adv")
    if adv is not None:
        adv = adv.unionByName(axes.session_table(first, last + 1).select("di", F.lit(axes.securities[0]).alias("ii"), F.lit(None).cast("float").alias("adv"))).groupBy("di", "ii").agg(F.max("adv").alias("adv"))
    result = simulate(w.select("di", "ii", "w"), returns, booksize=booksize, adv_dollar=adv, cost_bps=cost_bps, participation=participation, halt_proxy=halt_proxy, universe=pool, delist=delist, sessions=axes.session_table(), securities=axes.security_table())
    name = node or Path(weight).stem
    computed = (panels.meta(node) or {}).get("region_hash") if node else None
    meta = {"node": name, "return_metric": return_metric, "region_hash": region_hash, "region_hash_canonical": computed, "booksize": booksize, "sd": lo, "ed": hi, "cost_bps": cost_bps, "participation": participation, "known_defects": KNOWN_DEFECTS}
    metrics = measure(result, axes.session_table(), market=read(market_ref, "market_ret"), meta=meta)
    if out:
        write_deliverables(result, axes.session_table(), f"{out}/{name}", metrics)
    if show:
        print(render(name, metrics, f"{out}/{name}" if out else "-", by))
    return metrics


# ------------------------------------------------------------------- the report
def _known(x) -> bool:
    return isinstance(x, (int, float)) and math.isfinite(x)


def number(x, digits: int | None = None) -> str:
    return "n/a" if not _known(x) else f"{x:,.{digits}f}" if digits is not None else f"{x:,.4g}"


def percent(x) -> str:
    return f"{x:.2%}" if _known(x) else "n/a"


def money(x) -> str:
    if not _known(x):
        return "n/a"
    size, unit = next(((s, u) for s, u in ((1e9, "B"), (1e6, "M"), (1e3, "K")) if abs(x) >= s), (1, ""))
    return f"${x / size:,.2f}{unit}" if unit else f"${x:,.0f}"


def padded(text: str, width: int) -> str:
    """At least one space after the text; wide characters count twice."""
    shown = sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)
    return text + " " * max(1, width - shown)


def _table(title: str, rows: dict[str, dict], columns: list[tuple[str, str, object]]) -> list[str]:
    names = sorted(rows)
    more = f" (last {TABLE_ROWS} of {len(names)})" if len(names) > TABLE_ROWS else ""
    out = [f" {title}{more}", " " + padded("period", 11) + "".join(h.rjust(12) for h, _, _ in columns)]
    return out + [" " + padded(n, 11) + "".join(f(rows[n].get(k)).rjust(12) for _, k, f in columns) for n in names[-TABLE_ROWS:]]


def render(name: str, metrics: dict, where: str = "-", by: str = "both") -> str:
    """The report as text."""
    s, snap, audit = metrics["scalar"], metrics["snapshot"], metrics["audit"]
    line = "-" * 100
    out = ["=" * 100, f" {name}", f" {snap.get('sd')} .. {snap.get('ed')}   {snap.get('n_sessions')} sessions x {snap.get('n_securities')} names   book {money(snap.get('booksize'))}", "=" * 100]
    groups = {
        "Return": [("Sharpe", number(s["sharpe"])), ("AnnRet", percent(s["ann_return"])), ("AnnRet$", money(s["ann_return_dollar"])), ("Fitness", number(s["fitness"])), ("HitRate", percent(s["hit_rate"])), ("DailyVol", percent(s["return_std_daily"]))],
        "Cost": [("Turnover", percent(s["turnover"])), ("Margin", f"{number(s['margin_bps'])} bps"), ("CostTotal", money(s["cost_total"])), ("Cost/Gross", percent(s["cost_share_of_gross"])), ("Gross", money(s["holding_pnl_total"])), ("Net", money(s["pnl_total"]))],
        "Risk": [("MaxDD", percent(s["max_drawdown"])), ("MaxDD$", money(s["max_drawdown_dollar"])), ("DDWindow", f"{s['max_drawdown_from']} to {s['max_drawdown_to']}")],
        "Book": [("Long", f"{money(s['avg_long_value'])} / {number(s['avg_long_count'])}"), ("Short", f"{money(s['avg_short_value'])} / {number(s['avg_short_count'])}"), ("L/S", number(s["long_short_ratio"]))],
    }
    for head, cells in groups.items():
        for i in range(0, len(cells), 3):
            out.append(" " + padded(head if not i else "", 8) + "".join(padded(f"{k}={v}", 30) for k, v in cells[i : i + 3]))
    returns = [("days", "days", lambda v: str(v)), ("sharpe", "sharpe", lambda v: number(v, 3)), ("annRet", "ann_return", percent), ("pnl", "pnl", money), ("cost", "cost", money), ("margin", "margin_bps", lambda v: number(v, 2)), ("maxDD", "max_drawdown", percent), ("hit", "hit_rate", percent)]
    book = [("turnover", "turnover", percent), ("traded", "trade_dollar", money), ("longN", "avg_long_count", lambda v: number(v, 1)), ("shortN", "avg_short_count", lambda v: number(v, 1)), ("longV", "avg_long_value", money), ("shortV", "avg_short_value", money), ("long", "long_share", percent)]
    for what, key in (("year", "by_year"), ("month", "by_month")):
        if by in (what, "both") and metrics.get(key):
            out += [line, *_table(f"By {what}: returns and cost", metrics[key], returns), *_table(f"By {what}: trading and book", metrics[key], book)]
    out += [line, f" Gates    {metrics['n_pass']}/{metrics['n_total']} passed"]
    for g in metrics["gates"]:
        shown = "  ".join(f"{k}={number(v) if isinstance(v, float) else v}" for k, v in list(g["numbers"].items())[:3])
        out.append(f"   [{g['state']:<8}] {padded(g['gate'], 19)}{shown}")
    out += [line, f" Audit    ghost_detection={audit['ghost_detection']}  ghost_days={audit['ghost_days']}  delist_source={audit['delist_source']}"]
    if snap.get("known_defects"):
        out.append(f" Defects  {', '.join(snap['known_defects'])}")
    return "\n".join([*out, f" Verdict  {metrics['summary']}", f" Output   {where}: daily.psv, pnl.psv, holding.psv, metrics.json", "=" * 100])
