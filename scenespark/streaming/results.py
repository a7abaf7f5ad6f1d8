"""The append-only response log as a stream: current state and running coverage, resumable at any point.

State lies in buckets by a hash of the cell. A batch reads and rewrites only the buckets
that its rows fall in, so what it writes follows the batch, not the log. A manifest a
batch names each bucket's folder and carries the running counts; it is written last, by a
rename, so a batch counts when its manifest is there, and one that is run again after a
failure starts from the same manifest and writes the same.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.keys import host_of, is_exceeded, is_ok, question_type
from ..operators.cells import CELL_KEY, latest_responses

LOG_SCHEMA = "question_id string, scene_id string, question_type string, representation string, repetition int, responder string, judge string, answer_correctness double, error string, write_order long"

#: Folders of state; a table keeps the number that it was begun with.
BUCKETS = 256

#: Manifests, with the folders that only they name, kept for readers and for a batch that is run again.
KEPT = 3

_COUNTS = ("n", "error_count", "context_exceeded", "n_scored")


def coverage(state: DataFrame) -> DataFrame:
    """Running counts by host, representation and type, of rows that count: the last of each key."""
    keys = [host_of("scene_id").alias("host"), F.col("representation").alias("rep"), question_type().alias("qt")]
    return state.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(~is_ok() & ~is_exceeded()).alias("error_count"), F.count_if(is_exceeded()).alias("context_exceeded"), F.count(F.when(is_ok(), F.col("answer_correctness"))).alias("n_scored"))


class _Folder:
    """The files of a table, through Hadoop's file system, which knows every store that Spark does."""

    def __init__(self, spark: SparkSession, table: str) -> None:
        self.spark, self.table, self.jvm = spark, table.rstrip("/"), spark._jvm
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.table}/{name}" if name else self.table)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(""))) if self.fs.exists(self.path("")) else []

    def manifests(self) -> list[int]:
        return [int(n[9:18]) for n in self.names() if n.startswith("manifest-") and n.endswith(".json")]

    def read(self, batch: int) -> dict:
        stream = self.fs.open(self.path(f"manifest-{batch:09d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def commit(self, batch: int, manifest: dict) -> None:
        name, draft = self.path(f"manifest-{batch:09d}.json"), self.path(f"_manifest-{batch:09d}")
        stream = self.fs.create(draft, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        self.fs.delete(name, False)
        if not self.fs.rename(draft, name):
            raise OSError(f"{name} could not be put in place")

    def sweep(self) -> None:
        """Manifests older than the last few, and folders that none of those left names."""
        old = self.manifests()[:-KEPT]
        for batch in old:
            self.fs.delete(self.path(f"manifest-{batch:09d}.json"), False)
        named = {f for b in self.manifests() for f in self.read(b)["folders"].values()}
        newest = max(self.manifests(), default=-1)
        for n in self.names():
            if n.startswith("batch-") and int(n[6:]) < newest:
                kept = [f.split("/")[1] for f in named if f.startswith(f"{n}/")]
                if not kept:
                    self.fs.delete(self.path(n), True)
                for s in self.fs.listStatus(self.path(n)) if kept else []:
                    if s.getPath().getName().startswith("bucket=") and s.getPath().getName() not in kept:
                        self.fs.delete(s.getPath(), True)


def _before(folder: _Folder, batch: int | None = None) -> dict:
    """The manifest of the last batch before the given one, or of the last."""
    done = [b for b in folder.manifests() if batch is None or b < batch]
    return folder.read(done[-1]) if done else {"buckets": BUCKETS, "folders": {}, "coverage": []}


def _rows(folder: _Folder, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
    paths = [f"{folder.table}/{f}" for b, f in sorted(manifest["folders"].items()) if buckets is None or int(b) in buckets]
    spark = folder.spark
    return spark.read.schema(LOG_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], LOG_SCHEMA)


def read_state(spark: SparkSession, table: str) -> DataFrame:
    """The state after the last finished batch: last write of each key, ordinary errors included."""
    folder = _Folder(spark, table)
    return _rows(folder, _before(folder))


def merge_batch(spark: SparkSession, table: str, batch: DataFrame, number: int) -> None:
    """One batch into the table. Rows that repeat a cell: the last write counts; ties go to either.

    Each overwritten row takes back from the running counts what it had added.
    """
    folder = _Folder(spark, table)
    manifest = _before(folder, number)
    bucket = F.pmod(F.xxhash64(*CELL_KEY), F.lit(manifest["buckets"])).cast("int")
    new = latest_responses(batch, "write_order", CELL_KEY).withColumn("bucket", bucket)
    touched = sorted(r[0] for r in new.select("bucket").distinct().collect())
    if not touched:
        folder.commit(number, manifest)
        return
    old = _rows(folder, manifest, touched)
    merged = latest_responses(old.unionByName(new.drop("bucket")), "write_order", CELL_KEY).withColumn("bucket", bucket)
    out = f"batch-{number:09d}"
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder.table}/{out}")
    now = spark.read.schema(f"{LOG_SCHEMA}, bucket int").parquet(f"{folder.table}/{out}").drop("bucket")
    keys = new.select(*CELL_KEY)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"k.{c}")) for c in CELL_KEY]
    only = lambda df: df.alias("a").join(keys.alias("k"), same, "left_semi")
    change = coverage(only(now)).select("host", "rep", "qt", *_COUNTS).unionByName(coverage(only(old)).select("host", "rep", "qt", *[(-F.col(c)).alias(c) for c in _COUNTS]))
    totals = {(h, r, q): counts for h, r, q, *counts in manifest["coverage"]}
    for row in change.groupBy("host", "rep", "qt").agg(*[F.sum(c).alias(c) for c in _COUNTS]).collect():
        have = totals.get((row["host"], row["rep"], row["qt"]), [0] * len(_COUNTS))
        totals[row["host"], row["rep"], row["qt"]] = [x + row[c] for x, c in zip(have, _COUNTS)]
    folders = manifest["folders"] | {str(b): f"{out}/bucket={b}" for b in touched}
    folder.commit(number, {"buckets": manifest["buckets"], "folders": folders, "coverage": [[*k, *v] for k, v in totals.items() if v[0]]})
    folder.sweep()


def stream_results(spark: SparkSession, log: str, table: str, checkpoint: str, available_now: bool = True, files: int | None = None) -> StreamingQuery:
    """Keep table up to date with the log's JSON lines: the last write of a key wins. files: how many new ones a batch takes at most.

    Corrupt lines and rows without a question are left out.
    """
    rows = spark.readStream.schema(f"{LOG_SCHEMA}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    rows = (rows.option("maxFilesPerTrigger", files) if files else rows).json(log)
    rows = rows.where("_corrupt IS NULL AND question_id IS NOT NULL").drop("_corrupt")
    writer = rows.writeStream.foreachBatch(lambda batch, number: merge_batch(batch.sparkSession, table, batch, number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_coverage(spark: SparkSession, table: str) -> DataFrame:
    """Running coverage, as the last manifest has it: nothing is counted again."""
    folder = _Folder(spark, table)
    rows = [tuple(r) for r in _before(folder)["coverage"]]
    return spark.createDataFrame(rows, "host string, rep string, qt string, n long, error_count long, context_exceeded long, n_scored long")
