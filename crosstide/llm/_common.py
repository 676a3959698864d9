"""Shared folder, written intermediate tables and table access for the operators."""

from __future__ import annotations

import atexit
import threading

from pyspark.sql import DataFrame, SparkSession

from crosstide.sources import files


class _Tables(threading.local):
    """What a thread has written, in order: marks of one thread say nothing of another's tables."""

    def __init__(self):
        self.own: list[tuple[SparkSession, str]] = []


_tables = _Tables()
#: The tables of all threads, which go when the interpreter ends.
_everyone: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in the folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: computed once, its lineage cut, safe from lost executors."""
    spark = df.sparkSession
    path = files.scratch(spark, label)
    df.write.parquet(path)
    _tables.own.append((spark, path))
    _everyone[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def mark() -> int:
    """A point in the sequence of written tables, for discard_since."""
    return len(_tables.own)


def discard_since(point: int, *kept: DataFrame) -> None:
    """Delete the tables written since the point but those kept: nothing that is still lazy may read the others."""
    paths = {getattr(df, "_written_at", None) for df in kept}
    for spark, path in _tables.own[point:]:
        if path not in paths:
            discard(spark, path)
    _tables.own[point:] = [(spark, path) for spark, path in _tables.own[point:] if path in paths]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table; a session that has ended has nothing to delete."""
    _everyone.pop(path, None)
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc.sc().isStopped():
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _discard_all() -> None:
    for path, spark in list(_everyone.items()):
        try:
            discard(spark, path)
        except Exception:  # the JVM may already be gone when the interpreter ends
            return


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the Arrow batches that Python workers hold, for rows of whole texts can be long.

    Spark reads the setting when a plan runs, so it is lowered for the session; a lower one stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
