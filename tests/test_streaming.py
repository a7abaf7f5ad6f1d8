"""The stream's incremental state against the log as a whole."""

import json
import random

import pytest

from scenespark.operators.cells import CELL_KEY, latest_responses
from scenespark.streaming import results as T


def rows(rng, n, start):
    e = [None, "", "timeout", "CONTEXT_EXCEEDED: x"]
    return [(f"q{rng.randint(0, 40)}", f"procthor_{rng.randint(0, 2)}", "route", rng.choice(["r", "s", None]), rng.randint(1, 2), "m", "j", rng.choice([0.5, 1.0, None]), rng.choice(e), start + i) for i in range(n)]


def test_batches_add_up(spark, tmp_path):
    """Rewritten cells, late and out-of-order rows, null keys; an empty batch; a batch run again; states after each."""
    rng = random.Random(3)
    log, table = [], str(tmp_path / "table")
    for number, n in enumerate([60, 1, 0, 90, 5]):
        new = rows(rng, n, rng.choice([0, 1000]) + 100 * number)
        log += new
        df = spark.createDataFrame(new, T.LOG_SCHEMA)
        for _ in range(2 if number in (1, 3) else 1):
            T.merge_batch(spark, table, df, number)
        want = latest_responses(spark.createDataFrame(log, T.LOG_SCHEMA), "write_order", CELL_KEY)
        assert sorted(map(str, T.read_state(spark, table).collect())) == sorted(map(str, want.collect()))
        assert sorted(map(str, T.stream_coverage(spark, table).collect())) == sorted(map(str, T.coverage(want).collect()))


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    """One row into a large table rewrites one bucket of it; folders that no manifest names go."""
    rng = random.Random(4)
    table = tmp_path / "table"
    T.merge_batch(spark, str(table), spark.createDataFrame([(f"q{i}", "procthor_1", "route", "r", 1, "m", "j", 0.5, "", i) for i in range(3000)], T.LOG_SCHEMA), 0)
    for number in range(1, 7):
        T.merge_batch(spark, str(table), spark.createDataFrame(rows(rng, 1, 10_000 * number), T.LOG_SCHEMA), number)
        assert len(list((table / f"batch-{number:09d}").glob("bucket=*"))) == 1
    size = lambda n: sum(f.stat().st_size for f in (table / f"batch-{n:09d}").rglob("*.parquet"))
    assert size(6) < size(0) / 50 and len(list(table.glob("manifest-*"))) == T.KEPT
    assert T.read_state(spark, str(table)).count() >= 3000


def test_a_stopped_batch_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "table")
    rng = random.Random(5)
    T.merge_batch(spark, table, spark.createDataFrame(rows(rng, 30, 0), T.LOG_SCHEMA), 0)
    before = sorted(map(str, T.read_state(spark, table).collect()))
    late = spark.createDataFrame(rows(rng, 30, 100), T.LOG_SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(T._Folder, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            T.merge_batch(spark, table, late, 1)
    assert sorted(map(str, T.read_state(spark, table).collect())) == before
    T.merge_batch(spark, table, late, 1)
    assert sorted(map(str, T.read_state(spark, table).collect())) != before


def test_a_stream_of_many_files(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rng = random.Random(6)
    names = [f.split()[0] for f in T.LOG_SCHEMA.split(", ")]
    every = []
    for i in range(3):
        new = rows(rng, 20, 50 * i)
        every += new
        (log / f"{i}.json").write_text("\n".join([*(json.dumps(dict(zip(names, r))) for r in new), "corrupt", "{}"]))
    T.stream_results(spark, str(log), str(tmp_path / "t"), str(tmp_path / "c"), files=1).awaitTermination()
    want = latest_responses(spark.createDataFrame(every, T.LOG_SCHEMA), "write_order", CELL_KEY)
    assert sorted(map(str, T.read_state(spark, str(tmp_path / "t")).collect())) == sorted(map(str, want.collect()))
