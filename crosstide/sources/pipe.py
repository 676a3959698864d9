"""Pipe files: unquoted, one header line, missing fields empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.functions.scalar import clean_field
from crosstide.sources import files

#: Columns of the daily tables.
SCHEMAS = {
    "pv": "date date, security_id int, ticker string, open double, high double, low double, close double, volume bigint, adj_factor double, adj_close_vendor double",
    "cax": "date date, security_id int, ticker string, event_type string, div_amount double, split_num double, split_den double, split_ratio double",
    "sec_master": "date date, security_id int, ticker string, ticker_nasdaq string, ticker_cqs string, ticker_yahoo string, name string, exchange string, cik string, is_etf tinyint, round_lot int, financial_status string, first_trade_date date, currency string, ref_asof date, source string",
    "industry": "date date, security_id int, ticker string, gics_sector_code tinyint, gics_sector string, gics_sub_industry string, ref_asof date, source string",
    "calendar": "session int, date date, is_half_day int, n_securities int",
}


def read_pipe(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Strict: a line with another number of fields than the header is an error."""
    options = {"sep": "|", "header": "true", "mode": "FAILFAST", "enforceSchema": "false", "quote": "", "nullValue": "", "dateFormat": "yyyy-MM-dd"}
    return spark.read.options(**options).schema(schema).csv(path)


def read_ragged(spark: SparkSession, path: str, sep: str = "|") -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines): lines whose number of fields is not the header's are set aside."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", r"\r$", "").alias("line")).where("line <> ''")
    header = lines.first()["line"]
    names = header.split(sep)
    parts = lines.where(F.col("line") != header).withColumn("_p", F.split("line", f"[{sep}]", -1))
    good = F.size("_p") == len(names)
    return parts.where(good).select(*[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(names)]), parts.where(~good).select("line")


def read_daily(spark: SparkSession, root: str, table: str, latest: bool = False) -> DataFrame:
    """All files of a date-partitioned table, or the rows of its last date."""
    levels = "*" if table == "calendar" else "*/*"
    df = read_pipe(spark, f"{root}/{table}/{levels}/{table}.*", SCHEMAS[table])
    return df.join(F.broadcast(df.agg(F.max("date").alias("date"))), "date") if latest else df


def pipe_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line) of each row: fields cleaned, missing ones empty."""
    return df.select(F.concat_ws("|", *[clean_field(c) for c in columns]).alias("line"))


def _texts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fields as they are written: cleaned, missing ones NULL."""
    return df.select(*[F.when(clean_field(c) != "", clean_field(c)).alias(c) for c in columns])


_OPTIONS = {"sep": "|", "header": "true", "nullValue": "", "emptyValue": "", "quote": "", "lineSep": "\n"}


def write_pipe(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A folder of pipe files, each with the header."""
    _texts(df, columns or df.columns).write.options(**_OPTIONS).mode("overwrite").csv(path)


def write_daily(df: DataFrame, root: str, table: str, columns: list[str]) -> int:
    """One file per date, table/YYYY/mm/table.YYYYMMDD (the calendar: table/YYYY/table.YYYY); returns the rows.

    Files are written in parallel and then moved to their names: a move per date
    changes metadata only. A date that is written again replaces its file.
    """
    spark = df.sparkSession
    by_year = table == "calendar"
    at = files.scratch(spark, f"daily-{table}")
    ordered = df.withColumn("_part", F.date_format("date", "yyyy" if by_year else "yyyyMMdd"))
    ordered = ordered.repartition("_part").sortWithinPartitions("_part", "session" if by_year else F.col("security_id").cast("int"))
    fields = [F.when(clean_field(c) != "", clean_field(c)).alias(c) for c in columns]
    ordered.select(*fields, "_part").write.partitionBy("_part").options(**_OPTIONS).csv(at)
    for folder in (f for f in files.children(spark, at) if f.startswith("_part=")):
        day = folder.partition("=")[2]
        parts = [f for f in files.children(spark, f"{at}/{folder}") if f.startswith("part-")]
        target = f"{root}/{table}/{day[:4]}/{table}.{day}" if by_year else f"{root}/{table}/{day[:4]}/{day[4:6]}/{table}.{day}"
        files.move(spark, f"{at}/{folder}/{parts[0]}", target)
    rows = df.count()
    files.delete(spark, at)
    return rows
