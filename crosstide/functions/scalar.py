"""Scalar column functions: missing values, text fields, identifiers, dates and formats.

Missing is NULL everywhere: NaN is turned into NULL where data enter, and every
division goes through safe_div, as ANSI mode raises on division by zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Official sector codes.
SECTOR_CODES = {
    "Energy": 10, "Materials": 15, "Industrials": 20, "Consumer Discretionary": 25, "Consumer Staples": 30, "Health Care": 35,
    "Financials": 40, "Information Technology": 45, "Communication Services": 50, "Utilities": 55, "Real Estate": 60,
}
#: Date formats that reference files use.
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "yyyy/MM/dd", "dd-MMM-yyyy", "MMMM d, yyyy")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    """NaN and infinities as NULL."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None).cast("double")).otherwise(c)


def normalise_missing(df: DataFrame) -> DataFrame:
    """Every float column of a source with NULL for NaN."""
    floats = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: nan_to_null(n).cast(dict(df.dtypes)[n]) for n in floats})


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is zero or either is missing."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clip(x: Column | str, low: Column, high: Column) -> Column:
    """x between low and high; a missing x stays missing, a missing bound does not bind."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(low, F.least(x, high)))


def clean_field(c: Column | str, trim: bool = False, tabs: bool = False) -> Column:
    """A field of an unquoted pipe file: missing and nan are empty, separators become spaces."""
    text = col(c).cast("string")
    text = F.when(F.lower(text).isin("nan", "none"), F.lit("")).otherwise(text)
    bad = "|\r\n\t" if tabs else "|\r\n"
    text = F.translate(F.coalesce(text, F.lit("")), bad, " " * len(bad))
    return F.trim(text) if trim else text


def clean_flag(c: Column | str) -> Column:
    """A boolean field as true or false, missing as empty."""
    return F.coalesce(F.lower(col(c).cast("string")), F.lit(""))


def price_text(c: Column | str) -> Column:
    """Six decimals, missing as empty."""
    c = col(c)
    return F.when(c.isNull(), F.lit("")).otherwise(F.format_string("%.6f", c.cast("double")))


def factor_text(c: Column | str) -> Column:
    """Ten decimals, missing as empty."""
    c = col(c)
    return F.when(c.isNull(), F.lit("")).otherwise(F.format_string("%.10f", c.cast("double")))


def fold_symbol(c: Column | str) -> Column:
    """Share classes are written with a dot or a hyphen: the hyphen is the key."""
    return F.translate(F.trim(col(c)), ".", "-")


def vendor_symbol(c: Column | str) -> Column:
    return F.upper(fold_symbol(c))


def padded_cik(c: Column | str) -> Column:
    """Ten digits with leading zeros; empty unless all characters are digits."""
    text = F.trim(col(c).cast("string"))
    return F.when(text.rlike("^[0-9]+$"), F.when(F.length(text) >= 10, text).otherwise(F.lpad(text, 10, "0"))).otherwise(F.lit(""))


def parse_date(c: Column | str) -> Column:
    """A date in any of the known formats, else NULL."""
    text = F.trim(col(c))
    # Month names must match their pattern first: the parser raises on some inputs under ANSI mode.
    shapes = {"yyyy-MM-dd": r"^\d{4}-\d{1,2}-\d{1,2}$", "MM/dd/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "yyyy/MM/dd": r"^\d{4}/\d{1,2}/\d{1,2}$", "dd-MMM-yyyy": r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "MMMM d, yyyy": r"^[A-Za-z]+ \d{1,2}, \d{4}$"}
    lenient = {"yyyy-MM-dd": "y-M-d", "MM/dd/yyyy": "M/d/y", "yyyy/MM/dd": "y/M/d", "dd-MMM-yyyy": "d-MMM-y", "MMMM d, yyyy": "MMMM d, y"}
    return F.coalesce(*[F.when(text.rlike(shapes[f]), F.to_date(F.try_to_timestamp(F.initcap(text) if "MMM" in f else text, F.lit(lenient[f])))) for f in DATE_FORMATS])


def market_date(epoch: Column | str, zone: str = "America/New_York") -> Column:
    """Local date of an epoch in seconds, whatever the session's time zone."""
    seconds = col(epoch).cast("bigint")
    utc = F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc))


def utc_date(epoch: Column | str) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(col(epoch).cast("bigint") / 86400).cast("int"))


def half_day(date: Column | str) -> Column:
    """Early closes by rule: the day after Thanksgiving, 24 December and 3 July."""
    d = col(date)
    month, day = F.month(d), F.dayofmonth(d)
    after_thanksgiving = (month == 11) & (F.dayofweek(d) == 6) & day.between(23, 29)
    return after_thanksgiving | ((month == 12) & (day == 24)) | ((month == 7) & (day == 3))


def sector_code(c: Column | str) -> Column:
    codes = F.create_map(*[F.lit(v) for pair in SECTOR_CODES.items() for v in pair])
    return F.try_element_at(codes, col(c)).cast("tinyint")


def yes_no(c: Column | str) -> Column:
    """Y and N as 1 and 0, all else NULL."""
    return F.when(F.trim(col(c)) == "Y", 1).when(F.trim(col(c)) == "N", 0)


def half_life_weight(h: float) -> float:
    return 0.5 ** (1.0 / h)


def tag_number(name: Column | str, tag: str) -> Column:
    """The number of a _tagNNN part of a name, else NULL."""
    found = F.regexp_extract(col(name), rf"_{tag}([0-9]+)(?:_|$)", 1)
    return F.when(found != "", found.cast("int"))
