"""Quality gates as data: facts measured once, and a table of rules that judges them.

measure() turns a result into one flat record of facts by a few aggregations.
RULES says, per gate, which facts it shows, when there is no basis to judge, and
which requirements must hold. judge() applies the table; nothing else decides.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.operators import metrics as m

PASS, FAIL, NO_BASIS = "PASS", "FAIL", "NO-BASIS"
#: Limits of the gates; each can be overridden.
THRESHOLDS = {
    "beta_r2_max": 0.25, "conc_top1_max": 0.20, "conc_top5_max": 0.50, "conc_day1_max": 0.20, "stab_half_ratio_min": 0.25, "stab_roll1y_sharpe_min": 0.0,
    "breakeven_min": 2.0, "ls_ratio_lo": 0.67, "ls_ratio_hi": 1.50, "pool_gross_tol": 1e-6,
}
#: Fixed value: pairs of returns below which a regression says nothing.
LEAST_OBSERVATIONS = 30


def finite(x: object) -> bool:
    return isinstance(x, (int, float)) and math.isfinite(x)


@dataclass(frozen=True)
class Require:
    """fact within limits (names of THRESHOLDS, or numbers); an unknown fact is no objection unless it is needed."""

    fact: str
    least: str | float | None = None
    most: str | float | None = None
    above: str | float | None = None
    needed: bool = False

    def broken(self, facts: dict, limits: dict) -> bool:
        value = facts[self.fact]
        if value is None:
            return self.needed
        number = lambda x: limits[x] if isinstance(x, str) else x
        return bool(
            self.least is not None and not value >= number(self.least)
            or self.most is not None and not value <= number(self.most)
            or self.above is not None and not value > number(self.above)
        )

    def text(self, limits: dict) -> str:
        parts = [f"{sign} {limits[x] if isinstance(x, str) else x}" for sign, x in ((">=", self.least), ("<=", self.most), (">", self.above)) if x is not None]
        return f"{self.fact} {' and '.join(parts)}"


@dataclass(frozen=True)
class Rule:
    """A gate: what it shows, reasons for having no basis, plain objections, and requirements."""

    gate: str
    shows: tuple[str, ...]
    baseless: tuple[tuple[str, Callable[[dict], bool]], ...] = ()
    objections: tuple[tuple[str, Callable[[dict], bool]], ...] = ()
    requires: tuple[Require, ...] = ()
    #: Facts that mean nothing without a basis and are shown as unknown then.
    hidden: tuple[str, ...] = ()
    #: Whether objections are raised before the basis is asked for.
    objects_first: bool = False

    def judge(self, facts: dict, limits: dict) -> dict:
        reasons = [text for text, holds in self.baseless if holds(facts)]
        objections = [text for text, holds in self.objections if holds(facts)]
        broken = [r for r in self.requires if r.broken(facts, limits)]
        if reasons and not (self.objects_first and objections):
            state, note = NO_BASIS, "; ".join(reasons)
        elif objections:
            state, note = FAIL, "; ".join(objections)
        else:
            state, note = (FAIL if broken else PASS), "; ".join(r.text(limits) for r in self.requires)
        unknown = self.hidden if state == NO_BASIS else ()
        return {"gate": self.gate, "state": state, "numbers": {k: None if k in unknown else facts[k] for k in self.shows}, "note": note}


RULES = (
    Rule(
        "market beta", ("n_obs", "beta", "r2", "sharpe_hedged", "sharpe_raw", "market_source"),
        baseless=((f"fewer than {LEAST_OBSERVATIONS} pairs of returns", lambda f: f["n_obs"] < LEAST_OBSERVATIONS), ("returns without variation", lambda f: not finite(f["r2"]))),
        requires=(Require("r2", most="beta_r2_max"),), hidden=("beta", "r2", "sharpe_hedged"),
    ),
    Rule(
        "concentration", ("total_abs_pnl", "n_names_with_pnl", "top1_share", "top5_share", "top20_share", "top1_day_share", "top_day"),
        baseless=(("no pnl at all", lambda f: not f["total_abs_pnl"]),),
        requires=(Require("top1_share", most="conc_top1_max"), Require("top5_share", most="conc_top5_max"), Require("top1_day_share", most="conc_day1_max")),
    ),
    Rule(
        "period stability", ("sharpe_first_half", "sharpe_second_half", "worst_rolling_1y_sharpe", "half_ratio", "sharpe_by_year", "worst_year"),
        baseless=(("neither a rolling year nor a first half with a positive ratio", lambda f: f["worst_rolling_1y_sharpe"] is None and f["half_ratio"] is None),),
        requires=(Require("worst_rolling_1y_sharpe", above="stab_roll1y_sharpe_min"), Require("half_ratio", least="stab_half_ratio_min")),
    ),
    Rule("cost breakeven", ("cost_total", "pnl_gross", "breakeven_cost"), baseless=(("no cost was charged", lambda f: not f["cost_total"]),), requires=(Require("breakeven_cost", least="breakeven_min"),)),
    Rule(
        "long/short balance", ("avg_long_value", "avg_short_value", "avg_long_count", "avg_short_count", "long_short_ratio", "net_exposure_frac_of_gross"),
        baseless=(("the book is empty throughout", lambda f: not f["avg_long_value"] and not f["avg_short_value"]),), objections=(("long only", lambda f: not f["avg_short_value"]),),
        requires=(Require("long_short_ratio", least="ls_ratio_lo", most="ls_ratio_hi"),),
    ),
    Rule(
        "pool hygiene", ("empty_weight_days", "weight_gross_dev_max", "coverage_min", "coverage_avg", "coverage_max", "out_of_pool_weight_max"),
        baseless=(("no pool was supplied", lambda f: not f["universe_supplied"]),),
        requires=(Require("out_of_pool_weight_max", most=0.0, needed=True), Require("weight_gross_dev_max", most="pool_gross_tol", needed=True)),
    ),
    Rule(
        "lookahead status", ("ghost_detection", "ghost_days", "delist_source", "delist_events", "region_hash", "region_hash_canonical", "region_hash_match", "deps_tc_resolved"),
        baseless=(("the region's hash is unknown", lambda f: f["region_hash"] is None),), objects_first=True,
        objections=(("ghost detection is disabled", lambda f: f["ghost_detection"] == "disabled"), ("no delist dates", lambda f: f["delist_source"] == "none"), ("the region's conventions differ", lambda f: f["region_hash_match"] is False)),
    ),
)


def measure(result, market: DataFrame | None, meta: dict, by_year: dict, days: int) -> dict:
    """Every fact that the rules speak of, of one strategy's result."""
    daily = result.daily
    paired = daily if market is None else daily.drop("market_ret").join(F.broadcast(market.select("di", "market_ret")), "di", "left")
    live = F.col("weight_gross") > 0
    sums = daily.agg(
        F.count(F.lit(1)).alias("n_sessions"), *[F.avg(c).alias(f"avg_{c}") for c in ("long_value", "short_value", "long_count", "short_count")],
        F.sum((F.col("weight_gross") == 0).cast("long")).alias("empty_weight_days"), F.max(F.when(live, F.abs(F.col("weight_gross") - 1))).alias("weight_gross_dev_max"),
        F.min("target_count").alias("coverage_min"), F.avg("target_count").alias("coverage_avg"), F.max("target_count").alias("coverage_max"), F.max("oop_weight").alias("out_of_pool_weight_max"),
    )
    rolling = m.rolling_sharpe(daily, m.DAYS, annual=days).agg(F.min("rolling_sharpe").alias("worst_rolling_1y_sharpe"))
    # One row each: a single job collects them side by side.
    row = sums.crossJoin(m.regression(paired, days=days)).crossJoin(m.halves(daily, days=days)).crossJoin(m.breakeven(daily)).crossJoin(rolling).crossJoin(m.concentration(result.cells, daily))
    facts = row.first().asDict()
    if facts["n_sessions"] <= m.DAYS:
        facts["worst_rolling_1y_sharpe"] = None
    first, second = facts["sharpe_first_half"], facts["sharpe_second_half"]
    facts["half_ratio"] = second / first if finite(first) and finite(second) and first > 0 else None
    yearly = {year: row["sharpe"] for year, row in by_year.items()}
    known = {year: x for year, x in yearly.items() if finite(x)}
    facts |= {"sharpe_by_year": yearly, "worst_year": min(known or yearly, key=lambda y: (known.get(y, math.inf), y), default=None)}
    long, short = facts["avg_long_value"] or 0.0, -(facts["avg_short_value"] or 0.0)
    facts |= {"long_short_ratio": long / short if short else math.inf, "net_exposure_frac_of_gross": (long - short) / (long + short) if long + short else None}
    own, standard = meta.get("region_hash"), meta.get("region_hash_canonical")
    facts |= {"region_hash": own, "region_hash_canonical": standard, "region_hash_match": own == standard if own and standard else None, "deps_tc_resolved": meta.get("deps_tc")}
    facts |= {k: result.audit[k] for k in ("ghost_detection", "ghost_days", "delist_source", "delist_events", "universe_supplied")}
    return facts | {"market_source": "panel_equal_weight" if market is None else "given"}


def evaluate(result, *, thresholds: dict | None = None, market: DataFrame | None = None, meta: dict | None = None, by_year: dict | None = None, days: int = m.DAYS) -> dict:
    """All gates of one strategy's result. market (di, market_ret) replaces the panel's mean return."""
    facts, limits = measure(result, market, meta or {}, by_year or {}, days), THRESHOLDS | (thresholds or {})
    judged = [rule.judge(facts, limits) for rule in RULES]
    passed = [g["gate"] for g in judged if g["state"] == PASS]
    return {"gates": judged, "n_pass": len(passed), "n_total": len(judged), "all_pass": len(passed) == len(judged), "summary": f"submission readiness: {len(passed)}/{len(judged)} gates pass"}
