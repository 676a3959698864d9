"""Daily tables from raw vendor data: splits, raw prices, factors, calendar, point-in-time tables, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions import scalar as s
from crosstide.functions.scalar import safe_div
from crosstide.operators import events as ev

JUMP, RETURN_GAP, THIN = 0.40, 1e-4, 0.5


def reconstruct(bars: DataFrame, splits: DataFrame, key: str = "symbol") -> tuple[DataFrame, DataFrame]:
    """(bars with split_cum and raw prices, splits with vendor_applied).

    Quotes are divided by the splits that the vendor applied and that lie after the bar.
    """
    judged = ev.classify_splits(splits, bars, key, "close")
    out = ev.later_product(bars, judged.where("vendor_applied"), key, "ratio", "split_cum")
    raw = {f"raw_{c}": F.col(c) * F.col("split_cum") for c in ("open", "high", "low", "close")}
    return out.withColumns(raw | {"raw_volume": F.bround(safe_div("volume", "split_cum")).cast("bigint")}), judged


def adjustment_factor(bars: DataFrame, splits: DataFrame, dividends: DataFrame, key: str = "symbol") -> DataFrame:
    """bars with adj_factor from events: 1 at the last bar, times each later split's 1/ratio and dividend's 1 - D/C.

    An event counts if its date is a bar's date. A dividend is stated in current
    shares, so it is scaled by the split factor of its own date; C is the raw
    close of the bar before.
    """
    by_split = splits.groupBy(key, F.col("ex_date").alias("date")).agg(F.product(safe_div(F.lit(1.0), F.col("ratio"))).alias("_split"))
    by_dividend = dividends.groupBy(key, F.col("ex_date").alias("date")).agg(F.max_by("amount", "amount").alias("_amount"))
    out = bars.join(by_split, [key, "date"], "left").join(by_dividend, [key, "date"], "left")
    order = Window.partitionBy(key).orderBy("date")
    before = F.lag("raw_close").over(order)
    paid = F.when(F.col("_amount").isNotNull() & (before != 0), 1.0 - safe_div(F.col("_amount") * F.col("split_cum"), before))
    out = out.withColumn("_step", F.coalesce("_split", F.lit(1.0)) * F.coalesce(paid, F.lit(1.0)))
    later = Window.partitionBy(key).orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("adj_factor", F.coalesce(F.product("_step").over(later), F.lit(1.0))).drop("_split", "_amount", "_step")


def thin_tail(bars: DataFrame, key: str = "symbol") -> DataFrame:
    """(date) of the sessions at the end with fewer than half the median number of bars."""
    counts = bars.groupBy("date").agg(F.count(key).alias("n"))
    half = counts.agg((F.percentile("n", 0.5) * THIN).alias("half"))
    judged = counts.crossJoin(F.broadcast(half))  # one row
    last_full = judged.where("n >= half").agg(F.max("date").alias("full"))
    return judged.crossJoin(F.broadcast(last_full)).where("full is null or date > full").select("date")  # one row


def calendar(bars: DataFrame, key: str = "symbol") -> DataFrame:
    """(session, date, is_half_day, n_securities, volume_ratio, suspicious).

    The rule says which days close early; a volume near the median of the 20
    sessions before contradicts it and is flagged.
    """
    days = bars.groupBy("date").agg(F.count(key).cast("int").alias("n_securities"), F.sum(F.coalesce(F.col("raw_volume"), F.lit(0))).alias("volume"))
    order = Window.orderBy("date")  # over one row per session
    out = days.withColumn("session", (F.row_number().over(order) - 1).cast("int"))
    prior = F.array_sort(F.collect_list("volume").over(order.rowsBetween(-20, -1)))
    size = F.size(prior)
    middle = (F.get(prior, F.floor((size - 1) / 2).cast("int")) + F.get(prior, F.floor(size / 2).cast("int"))) / 2.0
    out = out.withColumns({"is_half_day": s.half_day("date").cast("int"), "volume_ratio": safe_div("volume", middle)})
    return out.withColumn("suspicious", F.coalesce((F.col("is_half_day") == 1) & (F.col("volume_ratio") > 0.8), F.lit(False))).drop("volume")


def off_axis(events: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events on sessions, (ex_date, symbols) of the others)."""
    dates = sessions.select(F.col("date").alias("ex_date"))
    strangers = events.join(dates, "ex_date", "left_anti").groupBy("ex_date").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
    return events.join(dates, "ex_date", "left_semi"), strangers


def point_in_time(sessions: DataFrame, securities: DataFrame, attributes: DataFrame, asof: str, key: str = "symbol") -> DataFrame:
    """Securities on every session from their first trade date on, with attributes as of a snapshot date.

    The snapshot's date is a column of its own: attributes observed later are visible as such.
    """
    known = securities.join(attributes, key, "left")
    out = ev.listed_on(sessions, known)
    return out.withColumns({"ref_asof": F.lit(asof).cast("date"), "gics_sector_code": s.sector_code("gics_sector")})


def join_reference(constituents: DataFrame, listed: DataFrame, filings: DataFrame) -> DataFrame:
    """Constituents with exchange attributes and identifiers; every mismatch stays visible in a column.

    constituents: Symbol, Security, GICS Sector, GICS Sub-Industry, Date added, CIK.
    listed: NASDAQ Symbol, CQS Symbol, Security Name, Listing Exchange, ETF, Round Lot Size, Financial Status.
    filings: ticker, cik. Keys meet in folded form; the constituents' CIK counts, the
    filings' fills gaps only.
    """
    clean = lambda c: s.clean_field(c, trim=True)
    left = constituents.withColumn("key", s.fold_symbol("Symbol"))
    # The last of colliding keys counts, and collisions are reported by colliding_keys.
    last = Window.partitionBy(s.fold_symbol("`NASDAQ Symbol`")).orderBy(F.col("Symbol").desc())
    right = listed.withColumn("_k", F.row_number().over(last)).where("_k = 1").select(
        s.fold_symbol("`NASDAQ Symbol`").alias("key"), F.col("NASDAQ Symbol").alias("_nasdaq"), F.col("CQS Symbol").alias("_cqs"), F.col("Security Name").alias("_name"),
        F.col("Listing Exchange").alias("_exchange"), F.col("ETF").alias("_etf"), F.col("Round Lot Size").alias("_lot"), F.col("Financial Status").alias("_status"), F.lit(True).alias("_listed"),
    )
    # Of several identifiers of one ticker the smallest counts.
    filed = filings.groupBy(F.trim("ticker").alias("key")).agg(F.min(s.padded_cik("cik")).alias("_filed"), F.lit(True).alias("_known"))
    out = left.join(right, "key", "left").join(filed, "key", "left")
    own = s.padded_cik("CIK")
    added = s.parse_date("`Date added`")
    name = clean("_name")
    return out.select(
        clean("key").alias("ticker_yahoo"), clean("Symbol").alias("ticker_sp"), clean("_nasdaq").alias("ticker_nasdaq"), clean("_cqs").alias("ticker_cqs"), F.when(name != "", name).otherwise(clean("Security")).alias("name"),
        clean("_exchange").alias("exchange"), F.when(own != "", own).otherwise(F.coalesce("_filed", F.lit(""))).alias("cik"), clean("`GICS Sector`").alias("gics_sector"), clean("`GICS Sub-Industry`").alias("gics_sub_industry"),
        s.yes_no("_etf").alias("is_etf"), clean("_lot").alias("round_lot"), clean("_status").alias("financial_status"), added.alias("sp500_date_added"),
        F.col("_listed").isNull().alias("no_listing"), F.col("_known").isNull().alias("no_filing"), F.coalesce((own != "") & (F.col("_filed") != "") & (own != F.col("_filed")), F.lit(False)).alias("cik_mismatch"),
        (added.isNull() & (F.coalesce(F.trim("`Date added`"), F.lit("")) != "")).alias("date_unparseable"),
    )


def reference_report(joined: DataFrame) -> DataFrame:
    """(check, n, examples): the sections of the join's verification."""
    flags = {
        "no_listing": F.col("no_listing"), "no_filing": F.col("no_filing"), "cik_mismatch": F.col("cik_mismatch"), "cik_missing": F.col("cik") == "", "date_unparseable": F.col("date_unparseable"),
        "etf": F.coalesce(F.col("is_etf") == 1, F.lit(False)), "financial_status": ~F.col("financial_status").isin("N", ""),
    }
    checks = F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()])
    rows = joined.select("ticker_yahoo", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("check"))
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy("check").orderBy("ticker_yahoo")))
    return ranked.groupBy("check").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("_k") <= 5, F.col("ticker_yahoo")))).alias("examples"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value")


def coverage(bars: DataFrame, sessions: DataFrame, key: str = "symbol") -> DataFrame:
    """(key, n_sessions, first_session, last_session)."""
    placed = bars.join(F.broadcast(sessions.select("date", F.col("di").alias("session"))), "date")
    return placed.groupBy(key).agg(F.countDistinct("session").alias("n_sessions"), F.min("session").alias("first_session"), F.max("session").alias("last_session"))


def returns(bars: DataFrame, key: str = "symbol") -> DataFrame:
    """bars with ours and the vendor's return against the bar before."""
    order = Window.partitionBy(key).orderBy("date")
    own = F.col("raw_close") * F.col("adj_factor")
    out = bars.withColumns({"_own": own})
    return out.withColumns({"r_own": safe_div("_own", F.lag("_own").over(order)) - 1, "r_vendor": safe_div("adjclose", F.lag("adjclose").over(order)) - 1}).drop("_own")


def vendor_divergence(with_returns: DataFrame, key: str = "symbol", least: float = RETURN_GAP) -> DataFrame:
    """(key, worst_gap, date) of securities whose returns differ from the vendor's."""
    gap = F.abs(F.col("r_own") - F.col("r_vendor"))
    return with_returns.withColumn("_g", gap).where("_g is not null").groupBy(key).agg(F.max("_g").alias("worst_gap"), F.max_by("date", "_g").alias("date")).where(F.col("worst_gap") > least)


def unexplained_jumps(with_returns: DataFrame, events: DataFrame, key: str = "symbol", jump: float = JUMP) -> DataFrame:
    """(key, date, r_own) of large returns on dates without an event."""
    dated = events.select(key, F.col("ex_date").alias("date")).distinct()
    return with_returns.where(F.abs("r_own") > jump).join(dated, [key, "date"], "left_anti").select(key, "date", "r_own")


def suspects(jumps: DataFrame, key: str = "symbol", least: int = 2) -> DataFrame:
    """Securities with several unexplained jumps."""
    return jumps.groupBy(key).agg(F.count(F.lit(1)).alias("n_jumps"), F.min("date").alias("first"), F.max("date").alias("last")).where(F.col("n_jumps") >= least)
