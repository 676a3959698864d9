"""Small files through Hadoop's file systems, so that any path that Spark reads works."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: list[tuple[SparkSession, str]] = []


def _at(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return fs.exists(target)


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _at(spark, path)
    stream = fs.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _replace(spark: SparkSession, source, target) -> None:
    """One rename that replaces the target: at no time is there neither the old file nor the new one."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    how = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    whole = target.getFileSystem(conf).makeQualified
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole(target).toUri(), conf).rename(whole(source), whole(target), how)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the target, then rename: readers see the old file or the new one."""
    fs, target = _at(spark, path)
    _, beside = _at(spark, f"{path}.tmp")
    stream = fs.create(beside, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    _replace(spark, beside, target)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it does not exist."""
    fs, target = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _at(spark, path)
    fs.delete(target, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file, in place of one that is there."""
    fs, old = _at(spark, source)
    _, new = _at(spark, target)
    fs.mkdirs(new.getParent())
    _replace(spark, old, new)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own; on a
    cluster without it there is no safe place, and that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='crosstide-')}")
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/crosstide/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, deleted when the interpreter ends.

    It is computed once, and a lost executor costs no more than reading it again.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    _scratch.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing lazy reads any more."""
    for df in tables:
        if path := getattr(df, "_written_at", None):
            delete(df.sparkSession, path)
            _scratch[:] = [(s, p) for s, p in _scratch if p != path]


@atexit.register
def _clean() -> None:
    for spark, path in _scratch:
        try:
            if not spark.sparkContext._jsc.sc().isStopped():
                delete(spark, path)
        except Exception:  # the JVM may already be gone
            return
