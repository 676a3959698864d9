"""Weights from files by extension, wide or long, to (date, ii, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.functions.scalar import nan_to_null
from crosstide.sources.panels import StoreError


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """The first column is the date; every other one is a security, unless the columns are (date, ii, w)."""
    suffix = path.rpartition(".")[2].lower()
    if suffix in ("psv", "csv"):
        df = spark.read.options(header="true", sep="|" if suffix == "psv" else ",", nullValue="").csv(path)
    elif suffix == "parquet":
        df = spark.read.parquet(path)
    elif suffix == "feather":
        import pyarrow.feather as feather

        df = spark.createDataFrame(feather.read_feather(path).rename(columns=str))
    else:
        raise StoreError(f"{path}: weights come as psv, csv, feather or parquet")
    date, *names = df.columns
    if names == ["ii", "w"]:
        return df.select(F.to_date(F.col(date)).alias("date"), F.col("ii").cast("int").alias("ii"), nan_to_null("w").alias("w"))
    wide = df.select(F.to_date(F.col(f"`{date}`").cast("string")).alias("date"), *[F.col(f"`{n}`").cast("double").alias(n) for n in names])
    return wide.unpivot("date", names, "ii", "w").select("date", F.col("ii").cast("int").alias("ii"), nan_to_null("w").alias("w"))


def drop_empty_sessions(weights: DataFrame) -> DataFrame:
    """Without the sessions on which no security has a weight."""
    return weights.join(weights.groupBy("date").agg(F.count("w").alias("_n")).where("_n > 0").select("date"), "date", "left_semi")


def require_contiguous(weights: DataFrame, axes) -> tuple[int, int]:
    """The first and last session number; a hole, or a date that is no session, is an error."""
    days = sorted(str(r["date"]) for r in weights.select("date").distinct().collect())  # one value per session
    if not days:
        raise StoreError("weights are empty")
    for d in days:
        if d not in axes:
            raise StoreError(f"{d} in the weights is no session")
    first, last = axes.pos(days[0]), axes.pos(days[-1])
    holes = sorted(set(axes.sessions[first : last + 1]) - set(days))
    if holes:
        raise StoreError(f"weights lack {len(holes)} sessions between {days[0]} and {days[-1]}, first {holes[0]}")
    return first, last
