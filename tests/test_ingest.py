"""Vendor payloads, reference files, reconstruction, calendars and streams."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosstide.functions import scalar as s
from crosstide.operators import events as ev
from crosstide.plans import base, build, ingest
from crosstide.sources import pipe, vendor
from crosstide.sources.panels import Store
from crosstide.streaming import daily


def payload(symbol="AAA", closes=(10.0, 11.0, None, 6.0), splits=None, dividends=None):
    stamps = [1704205800 + 86400 * i for i in range(len(closes))]
    event = lambda d, f: {str(stamps[i]): {"date": stamps[i], **f(v)} for i, v in (d or {}).items()}
    return json.dumps({"chart": {"error": None, "result": [{
        "meta": {"symbol": symbol, "firstTradeDate": 1704205800, "currency": "USD", "exchangeName": "X", "instrumentType": "EQUITY"}, "timestamp": stamps,
        "indicators": {"quote": [{k: list(closes) for k in ("open", "high", "low", "close")} | {"volume": [100] * len(closes)}], "adjclose": [{"adjclose": list(closes)}]},
        "events": {"dividends": event(dividends, lambda v: {"amount": v}), "splits": event(splits, lambda v: {"numerator": v[0], "denominator": v[1], "splitRatio": f"{v[0]}:{v[1]}"})}}]}})


def test_charts(spark):
    rows = [("AAA", payload(splits={3: (2, 1)}, dividends={1: 0.5})), ("BAD", "{nope"), ("ERR", json.dumps({"chart": {"error": {"code": "x", "description": "gone"}, "result": None}}))]
    charts = vendor.parse_charts(spark.createDataFrame(rows, "symbol string, payload string"))
    assert {r["symbol"]: r["error"] for r in charts.collect()}["ERR"] == "gone"
    good, dropped = vendor.settled(vendor.bars(charts))
    assert good.count() == 3 and dropped.first()["dropped"] == 1
    assert [str(r["date"]) for r in good.orderBy("date").collect()] == ["2024-01-02", "2024-01-03", "2024-01-05"]
    assert vendor.dividends(charts).first()["amount"] == 0.5 and vendor.splits(charts).first()["ratio"] == 2.0
    found = {r["symbol"]: r for r in vendor.inspect(charts).collect()}
    assert found["AAA"]["n_bars"] == 4 and found["AAA"]["problem"] is None and found["BAD"]["problem"] == "unparseable json"


def test_reconstruct_and_factor(spark):
    day = lambda i: dt.date(2024, 1, 2 + i)
    closes = [10.0, 10.2, 10.1, 10.3]  # already divided by the first split, not by the second
    bars = spark.createDataFrame([("A", day(i), c, c, c, c, 100, c) for i, c in enumerate(closes)] + [("A", day(4), 5.2, 5.2, 5.2, 5.2, 100, 5.2)], "symbol string, date date, open double, high double, low double, close double, volume bigint, adjclose double")
    splits = spark.createDataFrame([("A", day(2), 2.0), ("A", day(4), 2.0)], "symbol string, ex_date date, ratio double")
    dividends = spark.createDataFrame([("A", day(1), 0.1)], "symbol string, ex_date date, amount double")
    raw, judged = ingest.reconstruct(bars, splits)
    assert [r["vendor_applied"] for r in judged.orderBy("ex_date").collect()] == [True, False]
    got = ingest.adjustment_factor(raw, splits, dividends).orderBy("date").collect()
    assert [r["raw_close"] for r in got] == pytest.approx([20.0, 20.4, 10.1, 10.3, 5.2])
    assert [r["raw_volume"] for r in got] == [50, 50, 100, 100, 100]
    assert [r["adj_factor"] for r in got] == pytest.approx([0.25 * (1 - 0.1 * 2 / 20.0), 0.25, 0.5, 0.5, 1.0])
    with_returns = ingest.returns(ingest.adjustment_factor(raw, splits, dividends))
    assert ingest.vendor_divergence(with_returns).first()["worst_gap"] > 0.4
    jumps = ingest.unexplained_jumps(with_returns.withColumn("r_own", F.lit(0.5)), splits.select("symbol", "ex_date"))
    assert jumps.count() == 3 and ingest.suspects(jumps).first()["n_jumps"] == 3


def test_as_of_edges(spark):
    bars = spark.createDataFrame([("A", 1, 1.0), ("A", 3, 3.0)], "k string, date int, v double")
    events = spark.createDataFrame([("A", 1), ("A", 2), ("A", 4), ("B", 2)], "k string, ex_date int")
    got = {(r["k"], r["ex_date"]): (r["before"], r["after"]) for r in ev.as_of(events, bars, "k", "v").collect()}
    assert got == {("A", 1): (None, 1.0), ("A", 2): (1.0, 3.0), ("A", 4): (3.0, None), ("B", 2): (None, None)}


def test_calendar_and_thin_tail(spark):
    bars = spark.createDataFrame([(dt.date(2024, 11, 18 + i), f"S{k}", 100) for i in range(12) if i not in (5, 6) for k in range(10 if i < 11 else 2)], "date date, symbol string, raw_volume bigint")
    assert [str(r["date"]) for r in ingest.thin_tail(bars).collect()] == ["2024-11-29"]
    cal = ingest.calendar(bars).orderBy("session").collect()
    assert [r["is_half_day"] for r in cal][-1] == 1 and cal[-1]["suspicious"] is False and cal[0]["n_securities"] == 10


def test_reference_join(spark, tmp_path):
    (tmp_path / "listed.txt").write_bytes(b"Symbol|NASDAQ Symbol|CQS Symbol|Security Name|Listing Exchange|ETF|Round Lot Size|Financial Status\r\nBRK.B|BRK.B|BRK.B|Berk|N|N|100|N\r\nAAA|AAA|AAA|Triple|Q|Y|100|D\r\nFile Creation Time: 1\r\n")
    listed, malformed = pipe.read_ragged(spark, str(tmp_path / "listed.txt"))
    assert listed.count() == 2 and malformed.count() == 1
    (tmp_path / "f.json").write_text(json.dumps({"fields": ["cik", "name", "ticker", "exchange"], "data": [[7, "B", "BRK-B", "N"], [8, "A", "AAA", "Q"], [9, "none", None, "Q"]]}))
    filings = vendor.keyed_json(spark, str(tmp_path / "f.json"))
    assert filings.count() == 2
    pd.DataFrame([["BRK.B", "Berkshire", "Financials", "X", "2010-02-16", "7"], ["AAA", "Triple A", "Energy", "Y", "June 3, 2020", "12"], ["ZZZ", "Zed", "Other", "Z", "soon", ""], ["AAA", "dup", "", "", "", ""]], columns=["Symbol", "Security", "GICS Sector", "GICS Sub-Industry", "Date added", "CIK"]).to_csv(tmp_path / "c.csv", index=False)
    assert [r["symbol"] for r in vendor.read_symbols(spark, str(tmp_path / "c.csv")).orderBy("place").collect()] == ["BRK-B", "AAA", "ZZZ"]
    constituents = spark.read.option("header", True).csv(str(tmp_path / "c.csv")).where("Security <> 'dup'")
    got = {r["ticker_yahoo"]: r for r in ingest.join_reference(constituents, listed, filings).collect()}
    assert got["BRK-B"]["ticker_nasdaq"] == "BRK.B" and got["BRK-B"]["cik"] == "0000000007" and not got["BRK-B"]["cik_mismatch"]
    assert got["AAA"]["cik"] == "0000000012" and got["AAA"]["cik_mismatch"] and str(got["AAA"]["sp500_date_added"]) == "2020-06-03"
    assert got["ZZZ"]["no_listing"] and got["ZZZ"]["date_unparseable"] and got["ZZZ"]["cik"] == ""
    report = {r["check"]: r["n"] for r in ingest.reference_report(ingest.join_reference(constituents, listed, filings)).collect()}
    assert report["cik_mismatch"] == 1 and report["etf"] == 1 and report["financial_status"] == 1


def test_registry_appends(spark):
    old = spark.createDataFrame([("x", 5)], "key string, security_id bigint")
    found = spark.createDataFrame([("x", 1), ("b", 2), ("a", 2), ("c", 1)], "key string, since int")
    got = {r["key"]: r["security_id"] for r in ev.register(old, found, ["key"], [F.col("since"), F.col("key")]).collect()}
    assert got == {"x": 5, "c": 6, "a": 7, "b": 8}


def test_scalars(spark):
    df = spark.createDataFrame([("a|b\n", "12", "03-Jan-2020"), (None, "x1", "13/13/2020"), ("nan", "12345678901", "2020/1/5")], "t string, c string, d string")
    rows = df.select(s.clean_field("t").alias("t"), s.padded_cik("c").alias("c"), s.parse_date("d").cast("string").alias("d"), s.price_text(F.lit(None)).alias("p"), s.factor_text(F.lit(0.5)).alias("f")).collect()
    assert [tuple(r) for r in rows] == [("a b ", "0000000012", "2020-01-03", "", "0.5000000000"), ("", "", None, "", "0.5000000000"), ("", "12345678901", "2020-01-05", "", "0.5000000000")]
    days = spark.createDataFrame([("2025-11-28", 1), ("2025-11-21", 0), ("2025-12-24", 1), ("2025-07-03", 1), ("2024-11-29", 1), ("2024-11-22", 0)], "d string, h int")
    assert days.where(s.half_day(F.to_date("d")).cast("int") != F.col("h")).isEmpty()
    assert spark.range(1).select(s.nan_to_null(F.lit(float("nan"))), s.nan_to_null(F.lit(float("inf"))), s.safe_div(F.lit(1), F.lit(0))).first() == (None, None, None)


def test_pipe_is_strict_and_base_panels(spark, tmp_path):
    days = pd.bdate_range("2025-01-01", periods=8)
    names = {1: 5.0, 2: 7.0, 3: 9.0}
    pv = [(d.date(), i, f"S{i}", c, c, c, c * 1.01**t, 1000 * i, 1.0, c) for t, d in enumerate(days) for i, c in names.items() if not (i == 2 and t == 4)]
    frames = {
        "pv": spark.createDataFrame(pv, pipe.SCHEMAS["pv"]),
        "industry": spark.createDataFrame([(d.date(), i, f"S{i}", 10 * i if i < 3 else None, "", "", d.date(), "x") for d in days for i in names], pipe.SCHEMAS["industry"]),
        "sec_master": spark.createDataFrame([(d.date(), i, f"S{i}", "", "", "", "n", "", "0000000001", 0, 100, "N", d.date(), "USD", d.date(), "x") for d in days for i in names], pipe.SCHEMAS["sec_master"]),
    }
    root = tmp_path / "l2"
    for table, df in frames.items():
        for r in df.select("date").distinct().collect():
            folder = root / table / f"{r['date']:%Y}" / f"{r['date']:%m}"
            folder.mkdir(parents=True, exist_ok=True)
            lines = [x["line"] for x in pipe.pipe_lines(df.where(F.col("date") == F.lit(r["date"])), df.columns).collect()]
            (folder / f"{table}.{r['date']:%Y%m%d}").write_text("\n".join(["|".join(df.columns), *lines]) + "\n")
    (root / "calendar" / "2025").mkdir(parents=True)
    (root / "calendar" / "2025" / "calendar.2025").write_text("session|date|is_half_day|n_securities\n" + "".join(f"{t}|{d.date()}|0|3\n" for t, d in enumerate(days)))
    store = Store(spark, str(tmp_path / "l3"))
    refs = base.build_base(spark, str(root), store, top=2, asof="2025-02-01")
    assert sorted(refs) == store.list_refs() and len(refs) == 7
    rets = store.read(base.RETURN).where("ii = 2").orderBy("di").collect()
    assert [r["di"] for r in rets] == [1, 2, 3, 6, 7] and rets[0]["value"] == pytest.approx(0.01, abs=1e-6)
    assert store.read(base.POOL.format(n=2)).where("value AND di < 4").isEmpty() and store.read(base.POOL.format(n=2)).where("value AND di = 7").count() == 2
    assert store.read(base.SECTOR).where("ii = 3 AND value <> 0").isEmpty() and store.meta(base.SECTOR)["dtype"] == "i1"
    (root / "calendar" / "2025" / "calendar.2025").write_text("session|date|is_half_day|n_securities\n0|2025-01-01|0|3|extra\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|record"):
        pipe.read_daily(spark, str(root), "calendar").collect()


def test_daily_tables_end_to_end(spark, tmp_path):
    rows = [("AAA", payload("AAA", [10.0, 10.5, 10.2, 5.2, 5.3, 5.25, 5.3, 5.4, None], {3: (2, 1)}, {5: 0.05})), ("BBB", payload("BBB", [20.0, 20.2, 20.1, 20.4, 20.5, 20.6, 20.3, 20.9, 21.0], None, {8: 0.1})), ("BAD", "{"), ("CCC", payload("CCC", [7.0] * 8 + [None]))]
    payloads = spark.createDataFrame(rows, "symbol string, payload string")
    args = {"out": str(tmp_path / "l2"), "registry": str(tmp_path / "ids"), "sd": "2024-01-01", "ed": "2024-02-01", "asof": "2024-02-01"}
    meta = build.build_daily_tables(spark, payloads, **args)
    assert meta["n_sessions"] == 8 and meta["row_counts"]["pv"] == 24 and [f["symbol"] for f in meta["failed_symbols"]] == ["BAD"]
    assert meta["trimmed_trailing_sessions"] == ["2024-01-10"] and meta["off_axis_events_dropped"] == {"2024-01-10": ["BBB"]} and meta["dropped_null_close_by_date"] == {"2024-01-10": 2}
    assert meta["splits_vendor_had_not_applied"][0]["symbol"] == "AAA" and json.loads((tmp_path / "l2" / "_meta.json").read_text())["n_securities"] == 3
    text = (tmp_path / "l2" / "pv" / "2024" / "01" / "pv.20240102").read_text().splitlines()
    assert text[0].startswith("date|security_id|ticker|open") and text[1].startswith("2024-01-02|1|AAA|10.000000|") and len(text) == 4
    pv = pipe.read_daily(spark, args["out"], "pv")
    assert pv.count() == 24 and pv.where("security_id = 1 AND date = '2024-01-02'").first()["adj_factor"] == pytest.approx(0.5 * (1 - 0.05 / 5.3))
    assert pipe.read_daily(spark, args["out"], "calendar").count() == 8 and pipe.read_daily(spark, args["out"], "sec_master").count() == 24
    found = {r["rule"]: r["violations"] for r in build.accept_daily(spark, args["out"]).collect()}
    assert {k for k, v in found.items() if v} <= {"returns differ from the vendor's by over 1 bp"}
    again = build.build_daily_tables(spark, payloads.unionByName(spark.createDataFrame([("AA0", payload("AA0", [1.0] * 9))], payloads.schema)), **args)
    ids = {r["ticker_yahoo"]: r["security_id"] for r in build.read_registry(spark, args["registry"]).collect()}
    assert again["n_securities"] == 4 and ids == {"AAA": 1, "BBB": 2, "CCC": 3, "AA0": 4}


def test_fetch_retries():
    calls, saved = [], {}

    def get(symbol):
        calls.append(symbol)
        if len(calls) < 3:
            raise OSError("busy")
        return b"x"

    out = vendor.fetch(["A", "B"], get, saved.__setitem__, lambda x: x == "B", sleep=lambda _: None)
    assert out == {"A": "fetched", "B": "cached"} and saved == {"A": b"x"} and len(calls) == 3


def test_pace_shrinks_when_refusals_go_on():
    now, slept = [0.0], []

    def sleep(x):
        slept.append(x)
        now[0] += x

    pace = vendor.Pace(8, 3, sleep, lambda: now[0])
    for _ in range(10):
        pace.start()
        pace.end()
    assert now[0] == pytest.approx(6 / 8)  # four at once, then one each eighth of a second
    for _ in range(6):
        pace.start()
        pace.end(refused=True)
    assert pace.shrinks == [(3, 4.0, 2), (6, 2.0, 1)]
    for _ in range(20):
        pace.start()
        pace.end(refused=True)
    assert (pace.rate, pace.workers) == (1.0, 1)


def test_fetch_by_several_workers(spark, tmp_path):
    saved, busy = {}, {"n": 0}

    def get(symbol):
        if symbol == "S07" and busy["n"] < 2:
            busy["n"] += 1
            raise vendor.Refused("slow down")
        return symbol.encode()

    names = [f"S{i:02d}" for i in range(20)]
    out = vendor.fetch(names, get, saved.__setitem__, lambda x: x == "S03", sleep=lambda _: None, workers=4)
    assert list(out) == names and out["S03"] == "cached" and all(out[n] == "fetched" for n in names if n != "S03") and len(saved) == 19
    charts = vendor.parse_charts(spark.createDataFrame([("S01", "{}")], "symbol string, payload string"))
    assert vendor.write_manifest(spark, f"{tmp_path}/manifest.jsonl", charts, out) == 20
    assert (tmp_path / "manifest.jsonl").read_text().splitlines()[0].startswith('{"symbol": "S00", "outcome": "fetched"')


def test_cursor():
    c = daily.Cursor()
    c.advance(3)
    c.advance(4)
    with pytest.raises(ValueError):
        c.advance(6)
    c.reset()
    c.advance(9)
