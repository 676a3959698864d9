"""Specs, preflight, node runs (plans and day by day), the store and the command line."""

import json
import textwrap

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosstide import cli
from crosstide.operators.spec import SpecError
from crosstide.plans import config, evaluate, freshness, naming, node, preflight
from crosstide.plans.build import accept_panels
from crosstide.sources.axes import Axes
from crosstide.sources.panels import MemoryPanels, Panels, Store, StoreError, aligned

DAYS = [str(d.date()) for d in pd.bdate_range("2025-01-01", periods=25)]
NAMES = [101, 102, 103, 104]
PX, POOL, SECTOR, MKT = "g_common.field_base_px.px", "g_common.field_base_univ.top", "g_common.factor_base_gics.sector", "g_common.field_base_px.mkt"


def fill(panels, spark):
    rows = [(t, s, float(t * 4 + i + 100)) for t in range(25) for i, s in enumerate(NAMES)]
    panels.write(PX, spark.createDataFrame(rows, "di int, ii int, value double"), dtype="f8")
    panels.write(POOL, spark.createDataFrame([(t, s, s != 104) for t, s, _ in rows], "di int, ii int, value boolean"), dtype="bool")
    panels.write(SECTOR, spark.createDataFrame([(t, s, s % 2) for t, s, _ in rows], "di int, ii int, value int"), dtype="i1")
    panels.write(MKT, spark.createDataFrame([(t, t / 100) for t in range(25)], "di int, value double"), dims=("di",), dtype="f8")
    return panels


@pytest.fixture
def memory(spark):
    return fill(MemoryPanels(spark, DAYS, NAMES), spark)


@pytest.fixture
def repo(tmp_path):
    def add(name, yaml, code, directory="alpha_me_x"):
        folder = tmp_path / "repos" / "g_me" / "nodes" / directory
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.yaml").write_text(textwrap.dedent(yaml))
        (folder / f"{name}.py").write_text(textwrap.dedent(code))
        return folder / f"{name}.yaml"

    return add


MOMENTUM = 'PX = "g_common.field_base_px.px"\ndef handle(ctx):\n    n = ctx.params["window"]\n    px = ctx.win(PX, n + 1)\n    return px.loc[0] / px.loc[-n] - 1\n'
ALPHA = f"""
    region: us
    universe: {POOL}
    lookback: 3
    nodes:
      alpha_me_x:
        params: {{window: 3}}
        deps: [{PX}, {SECTOR}]
        ops: [rank, {{neutralize: {SECTOR}}}, {{linear_decay: 3}}, {{truncate: 0.5}}, {{scale: book}}]
"""


def test_references():
    r = naming.parse_ref("g_me.alpha_me_x.alpha_me_x_w005-weight")
    assert str(r) == "g_me.alpha_me_x.alpha_me_x_w005-weight" and r.kind == "alpha" and r.owner == "me"
    assert str(naming.parse_ref("g_me.alpha_me_x.weight")) == "g_me.alpha_me_x.weight"
    for bad in ("a.b", "g_me.alpha_me_x.alpha_me_x-weight", "G.alpha_me_x.w", "g_me.thing_me_x.w", "g_me.alpha_me_x.alpha_me_y-a-b", ".alpha_me_x.w", "g_me.alpha_me_x.alpha_me_y-"):
        with pytest.raises(SpecError):
            naming.parse_ref(bad)
    assert naming.expand("a.b.*", ["a.b.x", "a.c.x", "a.b.y"]) == ["a.b.x", "a.b.y"]
    for bad in ("A", "a__b", "x" * 41, "class", "nodes", "px_tc"):
        with pytest.raises(SpecError):
            naming.check_name(bad, "name")


def test_specs(repo):
    spec = config.load_spec(repo("x", ALPHA, MOMENTUM))
    n = spec.nodes["alpha_me_x"]
    assert n.history(spec.lookback) == 5 and list(n.outputs) == ["weight"] and str(n.ref("weight")) == "g_me.alpha_me_x.weight"
    same = config.load_spec(repo("y", ALPHA.replace("{window: 3}", "[{window: 3}]").replace("alpha_me_x:", "alpha_me_x:\n        code: x.py"), MOMENTUM))
    assert same.nodes["alpha_me_x"].params == n.params
    wrong = {
        "lookbak: 3": ("lookback: 3", "lookbak: 3"), "no scale": (", {scale: book}", ""), "other repo": ("alpha_me_x:", "alpha_you_x:"), "bad op": ("rank,", "rnk,"),
        "text book": ("region: us", "region: us\n    booksize: 20e6"), "rank of ops": ("ops:", "outputs: {weight: {dims: [di]}}\n        ops:"),
    }
    for old, new in wrong.values():
        with pytest.raises(SpecError):
            config.load_spec(repo("bad", ALPHA.replace(old, new), MOMENTUM))


def test_tags_and_region(repo, tmp_path):
    two = ALPHA.replace("alpha_me_x:", "alpha_me_rev_w003:\n        code: x.py") + ALPHA.split("nodes:\n")[1].replace("alpha_me_x:", "alpha_me_rev_w005:\n        code: x.py")
    with pytest.raises(SpecError, match="w=005"):
        config.load_spec(repo("x", two, MOMENTUM))
    regions = tmp_path / "repos" / "g_me" / "regions"
    regions.mkdir(parents=True)
    (regions / "us.yaml").write_text("booksize: 5\ntime_cutoff: '1500'\nl3_root: /here\n")
    spec = config.load_spec(repo("x", ALPHA.replace("field_base_px.px", "field_base_px.px_tc"), MOMENTUM))
    assert spec.booksize == 5.0 and spec.nodes["alpha_me_x"].deps[0].endswith("px_1500")
    assert config.region_hash({"a": 1, "l3_root": "/x"}) == config.region_hash({"l3_root": "/y", "a": 1})
    other = tmp_path / "repos" / "g_you" / "regions"
    other.mkdir(parents=True)
    (other / "us.yaml").write_text("booksize: 6\n")
    with pytest.raises(SpecError, match="differ"):
        config.find_region("us", root=tmp_path, start=tmp_path)


def test_start_point_does_not_matter(spark, memory, repo):
    spec = config.load_spec(repo("x", ALPHA, MOMENTUM))
    node.run(spec, memory, DAYS[0], DAYS[-1])
    whole = {(r["di"], r["ii"]): r["value"] for r in memory.read("g_me.alpha_me_x.weight").collect()}
    node.run(spec, memory, DAYS[12], DAYS[14], rebuild=True)
    part = {(r["di"], r["ii"]): r["value"] for r in memory.read("g_me.alpha_me_x.weight", DAYS[12], DAYS[14]).collect()}
    assert len(part) == 12 and all(part[k] == pytest.approx(whole[k], abs=1e-6) for k in part)
    assert all(v == 0 for (t, s), v in whole.items() if s == 104)
    assert accept_panels(memory, [PX, MKT, "g_me.alpha_me_x.weight"], POOL).where("violations > 0").isEmpty()


def test_plan_against_day_by_day(spark, memory, repo):
    code = 'import numpy as np\nPX = "g_common.field_base_px.px"\ndef handle(ctx):\n    px = ctx.win(PX, 4)\n    d = px.abs()\n    return ctx.multi_outputs(a=d.mean() * 1e2, b=(px / d).std() * np.sqrt(252), c=ctx.cs.rank(ctx.f(PX)), m=ctx.f(PX).mean())\n'
    yaml = f"""
        universe: {POOL}
        lookback: 3
        nodes:
          factor_me_y:
            deps: [{PX}]
            outputs: {{a: {{dtype: f8}}, b: {{dtype: f8}}, c: {{ops: [{{delay: 1}}]}}, m: {{dims: [di], dtype: f8}}}}
    """
    got = []
    for engine in ("", 'ENGINE = "python"\n'):
        spec = config.load_spec(repo("y", yaml, engine + code, "factor_me_y"))
        node.run(spec, memory, DAYS[5], DAYS[9], rebuild=True)
        got.append({k: sorted(tuple(r) for r in memory.read(f"g_me.factor_me_y.{k}").collect()) for k in "abcm"})
    for k in "abcm":
        np.testing.assert_allclose(np.array(got[0][k], float), np.array(got[1][k], float), atol=1e-6)
    assert len(got[0]["m"]) == 5


def test_self_reference_and_state(spark, memory, repo):
    code = 'ENGINE = "python"\nME = "g_me.factor_me_n.n"\ndef handle(ctx):\n    ctx.state["k"] = ctx.state.get("k", 0) + 1\n    if ctx.state["k"] == 4:\n        return None\n    return ctx.win(ME, 2).loc[-1].fillna(0) + 1\n'
    spec = config.load_spec(repo("n", "nodes:\n  factor_me_n:\n    deps: [g_me.factor_me_n.n]\n", code, "factor_me_n"))
    node.run(spec, memory, DAYS[0], DAYS[4])
    assert [r["value"] for r in memory.read("g_me.factor_me_n.n").where("ii = 101").orderBy("di").collect()] == [1, 2, 3, 3, 4]


def test_probe_writes_nothing_and_errors_are_clear(spark, memory, repo):
    spec = config.load_spec(repo("x", ALPHA, MOMENTUM))
    out = node.run(spec, memory, probe=3)
    assert not memory.exists("g_me.alpha_me_x.weight") and out[0]["probe"] and out[0]["sd"] == DAYS[21]
    for code, error in (("def handle(ctx):\n    return ctx.f('g_common.field_base_px.other')\n", KeyError), ("def handle(ctx):\n    return ctx.win('g_common.field_base_px.px', 3)\n", ValueError), ("def handle(ctx):\n    return ctx.win('g_common.field_base_px.px', 3).loc[1]\n", IndexError), ("def init(ctx):\n    ctx.f('g_common.field_base_px.px')\ndef handle(ctx):\n    return 1\n", RuntimeError)):
        with pytest.raises(error):
            node.run(config.load_spec(repo("x", ALPHA, code)), memory, DAYS[5], DAYS[6])


def test_rank_three(spark, memory, repo):
    cube = spark.createDataFrame([(t, s, k, float(t + k)) for t in range(25) for s in NAMES for k in range(3)], "di int, ii int, ti int, value double")
    memory.write("g_common.field_base_bars.close", cube, dims=("di", "ii", "ti"), dtype="f8")
    code = 'from pyspark.sql import functions as F\nC = "g_common.field_base_bars.close"\ndef handle(ctx):\n    return ctx.f(C).map(lambda c: F.transform(c, lambda v: v * 2))\n'
    yaml = "nodes:\n  factor_me_cube:\n    deps: [g_common.field_base_bars.close]\n    outputs: {cube: {dims: [di, ii, ti], grid: m5, dtype: f8}}\n"
    node.run(config.load_spec(repo("cube", yaml, code, "factor_me_cube")), memory, DAYS[2], DAYS[3])
    got = memory.read("g_me.factor_me_cube.cube")
    assert got.count() == 2 * 4 * 3 and got.where("di = 3 AND ti = 2 AND value <> 10").isEmpty()


def test_preflight(memory, repo):
    good = preflight.preflight(config.load_spec(repo("x", ALPHA, MOMENTUM)), memory)
    assert preflight.errors(good) == 0
    yaml = f"""
        universe: {PX}
        nodes:
          factor_me_b:
            deps: [g_common.field_base_px.pxx, g_me.factor_me_b.factor_me_later-later, g_common.field_none_z.*, {MKT}]
            outputs: {{one: {{ops: [{{neutralize: {PX}}}]}}, two: {{}}}}
          factor_me_later: {{deps: [{PX}]}}
    """
    code = f'A = "{SECTOR}"\ndef handle(ctx):\n    return ctx.multi_outputs(one=ctx.f(A), tow=1)\n'
    found = preflight.preflight(config.load_spec(repo("b", yaml, code, "factor_me_b")), memory, "2025-01-04", "2024-01-01")
    codes = {f.code for f in found}
    assert {"DEP_MISSING", "DECL_ORDER", "DEP_WILDCARD_EMPTY", "NEUTRALIZE_NOT_IN_DEPS", "NEUTRALIZE_DTYPE", "UNIVERSE_DTYPE", "DEP_NOT_DECLARED", "OUTPUTS_KEY_UNKNOWN", "OUTPUTS_KEY_MISSING", "OUTPUTS_SINGLE_MULTI", "SD_NOT_SESSION", "ED_NOT_SESSION", "SD_AFTER_ED"} <= codes
    near = next(f for f in found if f.code == "DEP_MISSING")
    assert "'px'" in near.suggestion or "px" in near.suggestion
    assert preflight.distance("kitten", "sitting") == 3
    (repo("b", yaml, "def handle(:\n", "factor_me_b"))
    assert "CODE_SYNTAX" in {f.code for f in preflight.preflight(config.load_spec(repo("b", yaml, "def handle(:\n", "factor_me_b")), memory)}


def test_freshness(spark, memory):
    memory.write("g_common.field_base_px.short", spark.createDataFrame([(t, 101, 1.0) for t in range(10)], "di int, ii int, value double"))
    assert freshness.effective_end(memory, None, [PX, "g_common.field_base_px.short"]) == (DAYS[9], "g_common.field_base_px.short")
    assert freshness.effective_end(memory, DAYS[3], [PX, "g_common.field_base_px.short"]) == (DAYS[3], None)


def test_axes(spark, tmp_path):
    Axes.create(spark, str(tmp_path), DAYS[:3], NAMES)
    for days, names in ((DAYS[1:4], NAMES), (DAYS[:3], [100, *NAMES]), (DAYS[2::-1], NAMES)):
        with pytest.raises(ValueError):
            Axes.create(spark, str(tmp_path), days, names)
    a = Axes.create(spark, str(tmp_path), DAYS[:4], [*NAMES, 105])
    assert a.ensure_sessions([DAYS[3], DAYS[5], DAYS[5]]) == 1 and a.slice(DAYS[1], DAYS[4]) == (1, 4)
    with pytest.raises(ValueError):
        a.ensure_sessions([DAYS[4]])
    assert Axes.load(spark, str(tmp_path)).sessions == [*DAYS[:4], DAYS[5]]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create_axes(DAYS, NAMES)
    assert isinstance(store, Panels) and isinstance(MemoryPanels(spark, DAYS, NAMES), Panels)
    fill(store, spark)
    assert store.list_refs() == sorted([PX, POOL, SECTOR, MKT]) and store.expand("g_common.field_base_px.*") == [MKT, PX]
    one = lambda t, v: spark.createDataFrame([(t, 101, v)], "di int, ii int, value double")
    for k in range(40):
        store.write(PX, one(7, float(k)), dtype="f8", fingerprint="f")
    assert [r["value"] for r in store.read(PX, DAYS[7], DAYS[7]).collect()] == [39.0] and store.read(PX).count() == 24 * 4 + 1
    assert len(store.meta(PX)["segments"]) < 40 and store.meta(PX)["n_cols_covered"] == 4 and store.meta(PX)["last_session"] == 24
    with pytest.raises(StoreError, match="definition"):
        store.write(PX, one(7, 1.0), fingerprint="g")
    assert store.write(PX, one(7, 1.0), dtype="f8", fingerprint="g", rebuild=True)["version"] == 2
    with pytest.raises(StoreError, match="not on the axis"):
        store.write(PX, spark.createDataFrame([(7, 999, 1.0)], "di int, ii int, value double"))
    with pytest.raises(StoreError, match="holes"):
        store.write(PX, one(3, 1.0).union(one(5, 1.0)))
    with pytest.raises(StoreError):
        store.expand("g_common.none.*")
    assert aligned(store, POOL, DAYS[0], DAYS[1]).count() == 8 and aligned(store, PX, DAYS[7], DAYS[7]).where("value IS NULL").count() == 3
    assert store.tail(MKT, 2).count() == 2 and store.catalog().count() == 4
    nan = spark.createDataFrame([(0, 101, float("nan")), (0, 102, 1.0)], "di int, ii int, value double")
    store.write("g_common.field_base_px.nan", nan)
    assert store.read("g_common.field_base_px.nan").count() == 1


def test_command_line(spark, tmp_path, repo, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    store = Store(spark, str(tmp_path / "store"))
    store.create_axes(DAYS, NAMES)
    fill(store, spark)
    rets = spark.createDataFrame([(t, s, 0.01 * ((t * s) % 7 - 3)) for t in range(25) for s in NAMES], "di int, ii int, value double")
    store.write("g_common.field_base_px.ret_1d_1500", rets)
    path = repo("x", ALPHA, MOMENTUM)
    args = ["--store", str(tmp_path / "store")]
    assert cli.main([*args, "run", str(path), "--sd", DAYS[5], "--halt-proxy", "2", "--out", str(tmp_path / "out"), "--record", str(tmp_path / "rec.json")], spark) == 0
    shown = capsys.readouterr().out
    assert "submission readiness" in shown and "preflight OK" in shown
    assert json.loads((tmp_path / "rec.json").read_text())["nodes"][0]["warmup"] == 5
    assert json.loads((tmp_path / "out" / "g_me.alpha_me_x.weight" / "metrics.json").read_text())["n_total"] == 7
    assert cli.main([*args, "store", "ls"], spark) == 0 and "g_me.alpha_me_x.weight" in capsys.readouterr().out
    assert cli.main([*args, "store", "status"], spark) == 0 and cli.main([*args, "store", "meta", PX], spark) == 0
    assert cli.main([*args, "store", "meta", PX + "x"], spark) == 1
    assert cli.main([*args, "pnl", "--node", "g_me.alpha_me_x.wight"], spark) == 1 and "did you mean" in capsys.readouterr().err
    bad = repo("z", ALPHA.replace("{window: 3}", "{}"), MOMENTUM, "alpha_me_z")
    bad.write_text(bad.read_text().replace("alpha_me_x", "alpha_me_z"))
    assert cli.main([*args, "run", str(bad.parent)], spark) == 1 and "z.py:3" in capsys.readouterr().out


def test_weights_from_files(spark, tmp_path, memory):
    wide = pd.DataFrame({"date": DAYS[5:10], "101": 0.5, "102": -0.5})
    wide.to_csv(tmp_path / "w.psv", sep="|", index=False)
    memory.write("g_common.field_base_px.ret_1d_1500", memory.read(PX).withColumn("value", F.lit(0.01)))
    m = evaluate.evaluate(memory, weight=str(tmp_path / "w.psv"), halt_proxy=2, universe=POOL)
    assert m["scalar"]["n_days"] == 5 and m["scalar"]["holding_pnl_total"] == pytest.approx(0.0, abs=1e-2)
    assert {g["gate"]: g["state"] for g in m["gates"]}["pool hygiene"] == "PASS"
    wide.drop(index=2).to_csv(tmp_path / "hole.csv", index=False)
    with pytest.raises(StoreError, match="lack 1 session"):
        evaluate.evaluate(memory, weight=str(tmp_path / "hole.csv"), halt_proxy=2)
    with pytest.raises(StoreError):
        evaluate.evaluate(memory, weight=str(tmp_path / "w.txt"), halt_proxy=2)
