"""Queries that run node files of the demonstration repository through specs, preflight and the runner."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from crosstide.plans import config, demo, freshness, node, preflight
from crosstide.plans.catalogue import ALPHA, EV, EVG, RANK, _cells, q, r, register, rs

FILES = Path(__file__).parent / "demo_repos" / "g_demo" / "nodes"


def _spec(name: str):
    (file,) = (FILES / name).glob("*.yaml")
    return config.load_spec(file)


def _run(spark, d, name: str):
    panels = demo.run_panels(spark, d)
    node.run(_spec(name), panels)
    return panels


@register(q(EVG, f"""SELECT di, ii, {rs('avg(x) OVER w4', 'average')}, {rs('stddev_samp(x) OVER w4', 'spread')}, {rs(RANK.format(v='x'), 'ranked')}, {rs('x - avg(x) OVER (PARTITION BY di)', 'excess')}, {rs('sqrt(abs(x)) / nullif(n, 0) + 1', 'each')}, {rs('2 * lag(x, 2) OVER (PARTITION BY ii ORDER BY di)', 'late')}
FROM evg WINDOW w4 AS (PARTITION BY ii ORDER BY di ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"""))
def node_plan(spark, d):
    """A node of seven outputs as one plan: its six panels side by side."""
    panels = _run(spark, d, "factor_demo_math")
    out = panels.axes.grid()
    for key in ("average", "spread", "ranked", "excess", "each", "late"):
        out = out.join(panels.read(f"g_demo.factor_demo_math.{key}").withColumnRenamed("value", key), ["di", "ii"], "left")
    return _cells(out, "average", "spread", "ranked", "excess", "each", "late")


@register(q(EV, f"SELECT di, {rs('avg(x)', 'level')} FROM ev GROUP BY di"))
def node_sessions(spark, d):
    """Its output of sessions alone."""
    out = _run(spark, d, "factor_demo_math").read("g_demo.factor_demo_math.level")
    return out.select("di", r("value").alias("level"))


@register("WITH " + ALPHA)
def node_alpha(spark, d):
    """An alpha file: pool, chain with groups, weights in the store."""
    panels = _run(spark, d, "alpha_demo_rev")
    out = panels.axes.grid().join(panels.read("g_demo.alpha_demo_rev.weight").withColumnRenamed("value", "w"), ["di", "ii"], "left")
    return _cells(out, "w")


@register(q(EVG, f"SELECT a.di, a.ii, {rs('sum(coalesce(b.x, 0) * pow(1.0 / 3, a.di - b.di))', 'y')} FROM evg a JOIN evg b ON b.ii = a.ii AND b.di <= a.di GROUP BY a.di, a.ii"))
def node_recursion(spark, d):
    """A node that reads its own values, session by session."""
    return _cells(_run(spark, d, "factor_demo_ema").read("g_demo.factor_demo_ema.ema").withColumnRenamed("value", "y"), "y")


@register("""SELECT * FROM (VALUES ('factor_demo_broken', 'DEP_MISSING', 'error'), ('factor_demo_broken', 'DECL_ORDER', 'error'), ('factor_demo_broken', 'DEP_WILDCARD_EMPTY', 'error'), ('factor_demo_broken', 'NEUTRALIZE_NOT_IN_DEPS', 'error'), ('factor_demo_broken', 'NEUTRALIZE_DTYPE', 'warn'),
('-', 'UNIVERSE_DTYPE', 'error'), ('factor_demo_broken', 'DEP_NOT_DECLARED', 'error'), ('factor_demo_later', 'DEP_NOT_DECLARED', 'error'), ('factor_demo_broken', 'OUTPUTS_KEY_UNKNOWN', 'error'), ('factor_demo_broken', 'OUTPUTS_KEY_MISSING', 'error'), ('factor_demo_later', 'OUTPUTS_SINGLE_MULTI', 'error'),
('-', 'SD_NOT_SESSION', 'error'), ('-', 'ED_NOT_SESSION', 'error'), ('-', 'SD_AFTER_ED', 'error')) t(node, code, severity)""")
def preflight_codes(spark, d):
    """What the preflight says of a file with a mistake of every common kind."""
    found = preflight.preflight(_spec("factor_demo_broken"), demo.run_panels(spark, d), "2023-12-30", "2023-12-29")
    return spark.createDataFrame(sorted({(f.node, f.code, f.severity) for f in found}), "node string, code string, severity string")


@register("""SELECT * FROM (VALUES ('alpha_demo_rev', 'alpha', 'weight', 2, 2, 'rank neutralize linear_decay truncate scale'), ('factor_demo_ema', 'factor', 'ema', 2, 0, ''), ('factor_demo_math', 'factor', 'average', 2, 5, ''), ('factor_demo_math', 'factor', 'each', 2, 5, ''),
('factor_demo_math', 'factor', 'excess', 2, 5, ''), ('factor_demo_math', 'factor', 'late', 2, 5, 'delay'), ('factor_demo_math', 'factor', 'level', 1, 5, ''), ('factor_demo_math', 'factor', 'ranked', 2, 5, ''), ('factor_demo_math', 'factor', 'spread', 2, 5, '')) t(node, kind, output, rank, warmup, ops)""")
def spec_outputs(spark, d):
    """The declared outputs of the demonstration's files, with ranks, chains and warm-up."""
    rows = []
    for name in ("alpha_demo_rev", "factor_demo_ema", "factor_demo_math"):
        spec = _spec(name)
        rows += [(n.name, n.kind, o.key, o.rank, n.history(spec.lookback), " ".join(op for op, _ in o.ops)) for n in spec.nodes.values() for o in n.outputs.values()]
    return spark.createDataFrame(rows, "node string, kind string, output string, rank int, warmup int, ops string")


@register(q(EV, "SELECT CAST(max(di) - 4 AS INTEGER) AS last, 'g_demo.field_demo_short.x' AS binding, CAST(DATE '2024-01-01' + CAST(max(di) - 4 AS INTEGER) AS VARCHAR) AS day FROM ev"))
def freshness_limit(spark, d):
    """Where inputs end: a panel that lacks the last four sessions binds."""
    panels = demo.run_panels(spark, d)
    last = panels.axes.n_sessions - 5
    short = panels.read(demo.EV_X).where(F.col("di") <= last)
    panels.write("g_demo.field_demo_short.x", short, dtype="f8", sessions=(0, last))
    end, binding = freshness.limit(panels, {demo.EV_X, "g_demo.field_demo_short.x"})
    return spark.createDataFrame([(end, binding, panels.axes.date(end))], "last int, binding string, day string")
