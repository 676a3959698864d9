"""The daily tables, from payloads to files: one run of ingestion, its audit document, and acceptance rules."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.functions import scalar as s
from crosstide.operators import events as ev
from crosstide.plans import ingest
from crosstide.sources import files, pipe, vendor

#: Columns of the id registry, and what the data are known to lack.
REGISTRY = "security_id int, cik string, ticker_yahoo string, name string, first_trade_date date, added_asof date"
DEFECTS = ["survivorship_bias_no_delisted", "no_vwap", "adj_factor_not_pit"]
NO_ATTRIBUTES = "symbol string, ticker_nasdaq string, ticker_cqs string, name string, exchange string, cik string, is_etf int, round_lot string, financial_status string, gics_sector string, gics_sub_industry string"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Ids that were given out before: none if there is no file yet. An empty field of the key is text, not missing."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], REGISTRY)
    return pipe.read_pipe(spark, path, REGISTRY).fillna("", ["cik", "ticker_yahoo", "name"])


def build_daily_tables(spark: SparkSession, payloads: DataFrame, out: str, registry: str, sd: str, ed: str, asof: str, attributes: DataFrame | None = None) -> dict:
    """payloads (symbol, payload) to pv, cax, calendar, sec_master, industry and _meta.json under out.

    attributes are the joined reference rows (ingest.join_reference) with symbol as
    their key; without them those columns are empty. Sessions are those that remain
    after the thin end is cut, and everything is judged against them. Ids come from
    the registry, which only grows. Returns the audit document.
    """
    attributes = spark.createDataFrame([], NO_ATTRIBUTES) if attributes is None else attributes
    charts = files.written(vendor.parse_charts(payloads), "charts")
    found, unsettled = vendor.settled(vendor.bars(charts))
    splits, dividends = vendor.splits(charts), vendor.dividends(charts)
    raw, judged = ingest.reconstruct(found, splits)
    bars = files.written(ingest.adjustment_factor(raw, splits, dividends), "bars")
    listings = vendor.listings(charts).join(attributes, "symbol", "left").withColumn("cik", F.coalesce("cik", F.lit("")))
    new = listings.select("cik", F.col("symbol").alias("ticker_yahoo"), F.coalesce("name", F.lit("")).alias("name"), "first_trade_date", F.lit(asof).cast("date").alias("added_asof"))
    order = [F.coalesce("first_trade_date", F.lit("1900-01-01").cast("date")), F.col("ticker_yahoo")]
    ids = files.written(ev.register(read_registry(spark, registry), new, ["cik", "ticker_yahoo"], order), "ids")
    pipe.write_pipe(ids.orderBy("security_id").coalesce(1), registry)  # one row per security
    known = listings.join(ids.select("cik", F.col("ticker_yahoo").alias("symbol"), "security_id"), ["cik", "symbol"])
    window = bars.where(F.col("date").between(F.lit(sd).cast("date"), F.lit(ed).cast("date")))
    thin = ingest.thin_tail(window)
    kept = files.written(window.join(F.broadcast(thin), "date", "left_anti").join(known.select("symbol", "security_id"), "symbol"), "kept")
    calendar = files.written(ingest.calendar(kept), "calendar")
    sessions = calendar.select(F.col("session").alias("di"), "date")
    events = splits.select("symbol", "ex_date", F.lit("split").alias("event_type"), F.lit(None).cast("double").alias("amount"), "num", "den", "ratio").unionByName(
        dividends.select("symbol", "ex_date", F.lit("div").alias("event_type"), "amount", *[F.lit(None).cast("double").alias(c) for c in ("num", "den", "ratio")])
    ).where(F.col("ex_date").between(F.lit(sd).cast("date"), F.lit(ed).cast("date")))
    on_axis, strangers = ingest.off_axis(events, sessions)
    placed = on_axis.join(known.select("symbol", "security_id"), "symbol")
    pit = ingest.point_in_time(sessions, known, attributes.select("symbol").limit(0), asof)

    price = lambda c: s.price_text(c)
    tables = {
        "pv": kept.select("date", "security_id", F.col("symbol").alias("ticker"), *[price(f"raw_{c}").alias(c) for c in ("open", "high", "low", "close")], F.col("raw_volume").alias("volume"), s.factor_text("adj_factor").alias("adj_factor"), price("adjclose").alias("adj_close_vendor")),
        "cax": placed.select(F.col("ex_date").alias("date"), "security_id", F.col("symbol").alias("ticker"), "event_type", price("amount").alias("div_amount"), *[F.col(c).alias(f"split_{c}") for c in ("num", "den")], s.factor_text("ratio").alias("split_ratio")),
        "sec_master": pit.select("date", "security_id", F.col("symbol").alias("ticker"), "ticker_nasdaq", "ticker_cqs", F.col("symbol").alias("ticker_yahoo"), "name", "exchange", "cik", "is_etf", "round_lot", "financial_status", "first_trade_date", "currency", "ref_asof", F.lit("vendor_chart").alias("source")),
        "industry": pit.select("date", "security_id", F.col("symbol").alias("ticker"), "gics_sector_code", "gics_sector", "gics_sub_industry", "ref_asof", F.lit("constituents").alias("source")),
    }
    counts = {name: pipe.write_daily(df, out, name, df.columns) for name, df in tables.items()}
    counts["calendar"] = pipe.write_daily(calendar.select("session", "date", "is_half_day", "n_securities"), out, "calendar", ["session", "date", "is_half_day", "n_securities"])
    returns = files.written(ingest.returns(kept), "returns")
    rows = lambda df: [{k: str(v) if hasattr(v, "isoformat") else v for k, v in r.asDict().items()} for r in df.collect()]  # noqa: E731  reports of exceptions
    span = calendar.agg(F.min("date"), F.max("date"), F.count(F.lit(1))).first()
    cover = ingest.coverage(kept, sessions)
    meta = {
        "version": 1, "asof": asof, "sd": sd, "ed": ed, "sd_actual": str(span[0]), "ed_actual": str(span[1]), "n_sessions": span[2], "n_securities": known.count(), "known_defects": DEFECTS, "row_counts": counts,
        "dropped_null_close_by_date": {str(r["date"]): r["dropped"] for r in unsettled.where(F.col("date").between(F.lit(sd).cast("date"), F.lit(ed).cast("date"))).orderBy("date").collect()},
        "failed_symbols": rows(charts.where("error is not null").select("symbol", "error")), "half_day_notes": rows(calendar.where("suspicious").select("date", "volume_ratio")), "trimmed_trailing_sessions": [str(r["date"]) for r in thin.orderBy("date").collect()],
        "off_axis_events_dropped": {str(r["ex_date"]): r["symbols"] for r in strangers.collect()}, "vendor_return_divergence": rows(ingest.vendor_divergence(returns).orderBy(F.col("worst_gap").desc())),
        "splits_vendor_had_not_applied": rows(judged.where("NOT vendor_applied").select("symbol", "ex_date", "ratio", "evidence")), "unexplained_jumps_gt_40pct": rows(ingest.unexplained_jumps(returns, events).orderBy(F.abs("r_own").desc())),
        "suspect_securities": rows(ingest.suspects(ingest.unexplained_jumps(returns, events))), "coverage_partial": rows(cover.where(F.col("n_sessions") < span[2])), "validation": "not_run",
    }
    files.write_text(spark, f"{out}/_meta.json", json.dumps(meta, indent=1))
    return meta


def accept_daily(spark: SparkSession, root: str) -> DataFrame:
    """(rule, violations) of the daily tables: returns, calendar, references, prices, ids and coverage."""
    pv, cax, industry, master, calendar = (pipe.read_daily(spark, root, t) for t in ("pv", "cax", "industry", "sec_master", "calendar"))
    key = ["date", "security_id"]
    ordered = ingest.returns(pv.select("date", "security_id", F.col("close").alias("raw_close"), "adj_factor", F.col("adj_close_vendor").alias("adjclose")), "security_id")
    low, high = F.least("open", "close", "high"), F.greatest("open", "close", "low")
    rules = {
        "returns differ from the vendor's by over 1 bp": ordered.where(F.abs(F.col("r_own") - F.col("r_vendor")) > 1e-4),
        "bars on dates that are no session": pv.join(calendar, "date", "left_anti"),
        "sessions without bars": calendar.join(pv, "date", "left_anti"),
        "calendar counts that are not the bars'": calendar.join(pv.groupBy("date").agg(F.count(F.lit(1)).alias("n")), "date").where("n <> n_securities"),
        "bars of unlisted securities": pv.join(master, key, "left_anti"),
        "industry rows of unlisted securities": industry.join(master, key, "left_anti"),
        "events of securities without a bar": cax.join(pv, key, "left_anti"),
        "prices out of order": pv.where((F.col("low") > low) | (F.col("high") < high) | (F.col("close") <= 0) | (F.col("volume") < 0)),
        "repeated keys": pv.groupBy(key).count().where("count > 1"),
        "session numbers out of step": calendar.agg(F.max("session").alias("m"), F.min("session").alias("a"), F.countDistinct("session").alias("n")).where("a <> 0 OR m + 1 <> n"),
        "splits without a ratio": cax.where("event_type = 'split' AND (split_ratio IS NULL OR split_ratio <= 0)"),
    }
    out = None
    for name, df in rules.items():
        row = df.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("violations"))
        out = row if out is None else out.unionByName(row)
    return out


def accept_panels(panels, refs: list[str], pool: str | None = None) -> DataFrame:
    """(ref, rule, violations) of stored panels: keys on the axes, no repeats, weights that add up."""
    axes = panels.axes
    out = None
    for ref in refs:
        meta, df = panels.meta(ref), panels.read(ref)
        rules = {
            "repeated keys": df.groupBy(*meta["dims"]).count().where("count > 1"),
            "sessions off the axis": df.where(~F.col("di").between(0, axes.n_sessions - 1)),
            "sessions outside the recorded range": df.where(~F.col("di").between(meta["first_session"], meta["last_session"])),
        }
        if "ii" in meta["dims"]:
            rules["securities off the axis"] = df.join(axes.security_table(), "ii", "left_anti")
        if ref.endswith("weight"):
            rules["books other than 0 or 1"] = df.groupBy("di").agg(F.sum(F.abs("value")).alias("g")).where("g <> 0 AND abs(g - 1) > 1e-6")
            if pool:
                members = panels.read(pool).where("value").select("di", "ii")
                rules["weights outside the pool"] = df.where("value <> 0").join(members, ["di", "ii"], "left_anti")
        for name, bad in rules.items():
            row = bad.agg(F.lit(ref).alias("ref"), F.lit(name).alias("rule"), F.count(F.lit(1)).alias("violations"))
            out = row if out is None else out.unionByName(row)
    return out
