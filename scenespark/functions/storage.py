"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Of sessions without spark.checkpoint.dir (tests), by application id.
_OWN: dict[str, str] = {}

#: Scratch tables of this process, by application id, and the catalogue's names of those that have one, by path.
_SCRATCH: dict[str, list[str]] = {}
_NAMES: dict[str, str] = {}

#: Clones of sessions with options of their own, by session and options.
_ASIDE: dict[tuple, object] = {}

#: For writes: shuffle files go when the write is done, not when the driver happens to collect its garbage. For those that end in windows of a key: joins with more keys leave rows dealt by that one in place.
_WRITE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_DEALT = {**_WRITE, "spark.sql.requireAllClusterKeysForCoPartition": "false"}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set; else, on a local master as in tests, a folder of this session."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = Path(tempfile.mkdtemp(prefix="spark-")).as_uri()
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _scratch(spark: SparkSession, name: str) -> str:
    path = new_path(spark, name)
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    if path in _NAMES:
        spark.sql(f"DROP TABLE IF EXISTS {_NAMES.pop(path)}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back.

    The lineage ends there, on files that outlive any executor, and later plans know the
    table's true size: Spark broadcasts it only below spark.sql.autoBroadcastJoinThreshold
    and shuffles otherwise.
    """
    spark = df.sparkSession
    path = _scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _aside(spark: SparkSession, options: dict[str, str]) -> object:
    """A clone of the session (on the JVM) with its options as they are now, but for these; the session itself keeps its own."""
    own = spark._jsparkSession
    key = (own.sessionUUID(), *options.items())
    if key not in _ASIDE:
        _ASIDE[key] = own.cloneSession()
    now = spark._jvm.java.util.Properties()
    now.putAll(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(own.sessionState().conf().getAllConfs()))
    now.putAll(options)
    _ASIDE[key].sessionState().conf().setConf(now)
    return _ASIDE[key]


def _moved(spark: SparkSession, to: object, frame: object) -> DataFrame:
    """A frame of the JVM as one of another of its sessions."""
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(to, frame.queryExecution().analyzed()), spark)


def sized(df: DataFrame, name: str, dealt: bool = False) -> DataFrame:
    """Like cut(), and later plans know what its rows take in memory. dealt: df ends in windows of its first key, so joins may leave rows where that key puts them.

    Sorted keys compress to a hundredth, so by the size of its files a table of a million
    rows would be broadcast, through the driver. Rows are counted as they are written. Spark
    has a factor of files' sizes for this, but only as a session's option: the table is
    read by a clone of the session that has it set, and the frame belongs to the session.
    Another clone writes, so that the write's shuffle files go with it.
    """
    spark, rows = df.sparkSession, Observation()
    path = _scratch(spark, name)
    out = _moved(spark, _aside(spark, _DEALT if dealt else _WRITE), df._jdf)
    out.observe(rows, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    schema = out._jdf.schema()
    memory = rows.get["n"] * (schema.defaultSize() + 8 * len(out.columns))
    files = max(1, out._jdf.queryExecution().analyzed().stats().sizeInBytes())
    factor = 1 << max(0, -(-memory // files) - 1).bit_length()
    if factor > 1:
        reader = _aside(spark, {"spark.sql.sources.fileCompressionFactor": str(factor)})
        out = _moved(spark, spark._jsparkSession, reader.read().schema(schema).parquet(spark._jvm.PythonUtils.toSeq([path])))
    out.scratch_path = path
    return out


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Like cut(), in as many buckets as there are shuffle partitions, so that joins on keys leave these rows in place. Its name leaves the catalogue with its files."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, table = _scratch(spark, name), f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(n, *keys).option("path", path).option("compression", "zstd").saveAsTable(table)
    _NAMES[path] = table
    out = spark.table(table)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() or bucketed() made, when nothing that is still to run reads them."""
    for t in tables:
        _delete(t.sparkSession, t.scratch_path)
        _SCRATCH[t.sparkSession.sparkContext.applicationId].remove(t.scratch_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """The scratch tables made within go at its end, and no others: write there every result that reads them."""
    own = _SCRATCH.setdefault(spark.sparkContext.applicationId, [])
    before = set(own)
    try:
        yield
    finally:
        for path in [p for p in own if p not in before]:
            _delete(spark, path)
            own.remove(path)


def ranked(df: DataFrame, name: str, *order: Column, write: Callable[[DataFrame, str], DataFrame] = cut) -> DataFrame:
    """df with rank (long, from 0) in the global order; no single task sees all rows.

    Rows are range-sorted and written; the only thing that reaches the driver is one
    count for each written partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seq = F.monotonically_increasing_id()
    rows = write(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__seq", seq), name)
    part = F.shiftright("__seq", 33)
    sizes = {r[0]: r[1] for r in rows.groupBy(part.alias("p")).count().collect()}
    starts, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(p, 0)
    start = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts or [0]]), (part + 1).cast("int"))
    return rows.withColumn("rank", start + F.col("__seq").bitwiseAND((1 << 33) - 1)).drop("__seq")
