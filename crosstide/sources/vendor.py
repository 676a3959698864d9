"""Vendor payloads: chart JSON to bars, dividends and splits; structural checks; reference files."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosstide.functions.scalar import fold_symbol, market_date, utc_date, vendor_symbol
from crosstide.sources import files

CHART = """chart struct<error: struct<code: string, description: string>, result: array<struct<
  meta: struct<symbol: string, firstTradeDate: bigint, currency: string, exchangeName: string, instrumentType: string>,
  timestamp: array<bigint>,
  indicators: struct<quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<bigint>>>, adjclose: array<struct<adjclose: array<double>>>>,
  events: struct<dividends: map<string, struct<date: bigint, amount: double>>, splits: map<string, struct<date: bigint, numerator: double, denominator: double, splitRatio: string>>>>>>"""


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, payload): whole files, named after their symbol."""
    return spark.read.option("wholetext", "true").text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("symbol"), F.col("value").alias("payload"))


def parse_charts(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """payloads with doc (the parsed result) and error (NULL where it can be used)."""
    parsed = payloads.withColumn("_c", F.from_json(column, CHART, {"mode": "PERMISSIVE"}))
    first = F.get(F.col("_c.chart.result"), F.lit(0))
    error = F.when(F.col("_c.chart").isNull(), F.lit("unparseable json")).when(first.isNull(), F.coalesce(F.col("_c.chart.error.description"), F.lit("no result")))
    return parsed.withColumns({"doc": first, "error": error}).drop("_c")


def bars(charts: DataFrame) -> DataFrame:
    """(symbol, date, open .. volume, adjclose) of every stamp; close may be NULL."""
    quote, adjusted = F.get("doc.indicators.quote", F.lit(0)), F.get("doc.indicators.adjclose", F.lit(0))
    fields = ["open", "high", "low", "close", "volume"]
    zipped = F.arrays_zip(F.col("doc.timestamp").alias("epoch"), *[quote[f].alias(f) for f in fields], adjusted["adjclose"].alias("adjclose"))
    rows = charts.where("error is null").select(_symbol(charts), F.posexplode(zipped).alias("place", "b")).where("b.epoch is not null")
    return rows.select("symbol", market_date("b.epoch").alias("date"), *[F.col(f"b.{f}").alias(f) for f in [*fields, "adjclose"]])


def _symbol(charts: DataFrame) -> Column:
    own = F.col("symbol") if "symbol" in charts.columns else F.lit(None).cast("string")
    return F.coalesce(F.col("doc.meta.symbol"), own).alias("symbol")


def settled(all_bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars with a close, tally by date of those without)."""
    return all_bars.where("close is not null"), all_bars.where("close is null").groupBy("date").agg(F.count(F.lit(1)).alias("dropped"))


def dividends(charts: DataFrame) -> DataFrame:
    rows = charts.where("error is null").select(_symbol(charts), F.explode(F.map_values("doc.events.dividends")).alias("e"))
    return rows.select("symbol", market_date("e.date").alias("ex_date"), F.col("e.amount").alias("amount"))


def splits(charts: DataFrame) -> DataFrame:
    rows = charts.where("error is null").select(_symbol(charts), F.explode(F.map_values("doc.events.splits")).alias("e"))
    return rows.select("symbol", market_date("e.date").alias("ex_date"), F.col("e.numerator").alias("num"), F.col("e.denominator").alias("den"), F.try_divide("e.numerator", "e.denominator").alias("ratio"), F.col("e.splitRatio").alias("ratio_text"))


def listings(charts: DataFrame) -> DataFrame:
    return charts.where("error is null").select(_symbol(charts), market_date("doc.meta.firstTradeDate").alias("first_trade_date"), F.col("doc.meta.currency").alias("currency"))


def inspect(charts: DataFrame) -> DataFrame:
    """One manifest row per payload: counts, first and last date, and what is wrong with it."""
    stamps = F.col("doc.timestamp")
    problem = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.get("doc.indicators.quote", F.lit(0)).isNull(), F.lit("indicators.quote[0] missing"))
        .when(F.get("doc.indicators.adjclose", F.lit(0))["adjclose"].isNull(), F.lit("indicators.adjclose[0].adjclose missing"))
        .when(F.coalesce(F.size(stamps), F.lit(0)) <= 0, F.lit("timestamp empty"))
    )
    size = lambda c: F.greatest(F.coalesce(F.size(F.map_keys(c)), F.lit(0)), F.lit(0))
    return charts.select(
        _symbol(charts), problem.alias("problem"), F.greatest(F.coalesce(F.size(stamps), F.lit(0)), F.lit(0)).alias("n_bars"), utc_date(F.get(stamps, F.lit(0))).alias("first_date"), utc_date(F.try_element_at(stamps, F.lit(-1))).alias("last_date"),
        utc_date("doc.meta.firstTradeDate").alias("first_trade_date"), F.col("doc.meta.currency").alias("currency"), F.col("doc.meta.exchangeName").alias("exchange_name"), F.col("doc.meta.instrumentType").alias("instrument_type"),
        size("doc.events.dividends").alias("n_dividends"), size("doc.events.splits").alias("n_splits"),
    )


def keyed_json(spark: SparkSession, path: str, key: str = "ticker") -> DataFrame:
    """{fields: [...], data: [[...], ...]} as one row per record with a key."""
    doc = spark.read.option("wholetext", "true").text(path).select(F.from_json("value", "fields array<string>, data array<array<string>>").alias("d"))
    names = doc.select("d.fields").first()[0]
    rows = doc.select(F.explode("d.data").alias("r")).select(*[F.get("r", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return rows.where(F.coalesce(F.trim(key), F.lit("")) != "").withColumn(key, F.trim(key))


def read_symbols(spark: SparkSession, path: str, column: str = "Symbol") -> DataFrame:
    """(place, source, symbol) in file order, the first of equal symbols."""
    df = spark.read.options(header="true", quote='"', escape='"').csv(path)
    if column not in df.columns:
        raise ValueError(f"{path} has no column {column}")
    rows = df.select(F.monotonically_increasing_id().alias("place"), F.trim(column).alias("source")).where("source <> ''").withColumn("symbol", vendor_symbol("source"))
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy("place"))).where("_k = 1").drop("_k")


def symbol_key(c: str) -> Column:
    return fold_symbol(c)


class Refused(Exception):
    """The vendor asks for fewer requests (its transport saw status 429)."""


class Pace:
    """When requests may start, and how many at once; both shrink when refusals go on.

    Starts follow a schedule: each moves the next one by 1 / rate, and a start may be
    early by the length of a burst. Of the permits for requests under way, a shrink
    keeps one back for good.
    """

    #: Refusals before the first shrink (they double after each), the factor of the rate and its floor, and the longest burst.
    FIRST_SHRINK, FACTOR, FLOOR, BURST = 3, 0.5, 1.0, 4.0

    def __init__(self, rate: float, workers: int = 1, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.rate, self.workers = float(rate), workers
        self.refusals, self.shrinks = 0, []
        self._sleep, self._clock = sleep, clock
        self._lock, self._permits = threading.Lock(), threading.Semaphore(workers)
        self._due = clock()

    def start(self) -> None:
        """Wait for a permit and for the schedule."""
        self._permits.acquire()
        with self._lock:
            now, step = self._clock(), 1.0 / self.rate
            early = (max(1.0, min(self.rate, self.BURST)) - 1.0) * step
            self._due = max(self._due, now)
            wait = self._due - early - now
            self._due += step
        if wait > 0:
            self._sleep(wait)

    def end(self, refused: bool = False) -> None:
        """Give the permit back, or keep it if this refusal shrinks the job."""
        keep = False
        with self._lock:
            self.refusals += refused
            if refused and self.refusals >= self.FIRST_SHRINK << len(self.shrinks):
                self.rate = max(self.FLOOR, self.rate * self.FACTOR)
                keep = self.workers > 1
                self.workers -= keep
                self.shrinks.append((self.refusals, self.rate, self.workers))
        if not keep:
            self._permits.release()


def fetch(symbols: list[str], get: Callable[[str], bytes], save: Callable[[str, bytes], None], have: Callable[[str], bool], tries: int = 4, pause: float = 0.5, rate: float = 6.0, sleep: Callable[[float], None] = time.sleep, workers: int = 1, pace: Pace | None = None) -> dict[str, str]:
    """Download what is not there yet by several workers, at most rate a second, with growing pauses after failures.

    get, save and have stand for the transport and the cache, so that nothing here
    needs a network; get raises Refused where the vendor throttles. Returns the
    outcome of each symbol, in order of the symbols.
    """
    pace = pace or Pace(rate, workers, sleep)

    def one(symbol: str) -> str:
        if have(symbol):
            return "cached"
        outcome = ""
        for k in range(tries):
            refused = False
            pace.start()
            try:
                save(symbol, get(symbol))
                return "fetched"
            except Refused as e:
                refused, outcome = True, f"refused: {e}"
            except Exception as e:  # the transport's own errors: try again, then report
                outcome = f"failed: {e}"
            finally:
                pace.end(refused)
            sleep(pause * 2**k)
        return outcome

    with ThreadPoolExecutor(workers) as pool:
        return dict(zip(symbols, pool.map(one, symbols)))


def write_manifest(spark: SparkSession, path: str, charts: DataFrame, outcomes: dict[str, str]) -> int:
    """A line of JSON per symbol, in order: how it was fetched and what inspect() says of its payload. Returns the lines."""
    seen = {r["symbol"]: r.asDict() for r in inspect(charts).collect()}  # one row per symbol
    rows = [{"symbol": name, "outcome": outcomes.get(name), **{k: str(v) if hasattr(v, "isoformat") else v for k, v in seen.get(name, {}).items() if k != "symbol"}} for name in sorted({*outcomes, *seen})]
    files.write_text(spark, path, "".join(json.dumps(r) + "\n" for r in rows))
    return len(rows)
