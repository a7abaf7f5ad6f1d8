"""What plans know of written tables: rows' size in memory, whatever their files compress to."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from scenespark.functions import storage
from scenespark.functions.storage import sized
from scenespark.operators import geometry as M
from scenespark.operators import graph as G
from scenespark.operators import render as V


@contextmanager
def broadcasting(spark, most):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def rooms(spark, scenes, each):
    c = F.col
    ids = spark.range(scenes * each).withColumn("n", c("id") % each)
    place = lambda k, m: (c("id") * k % m / 10).cast("double")
    return sized(ids.select(F.concat(F.lit("scene_"), F.floor(c("id") / each).cast("string")).alias("scene_id"), c("id").cast("string").alias("room_id"), c("n").cast("int").alias("room_ord"), F.lit("hall").alias("category"), F.lit(None).cast("string").alias("floor"), place(37, 101).alias("x"), place(11, 7).alias("y"), place(53, 97).alias("z")).coalesce(1), "rooms")


def test_sized(spark):
    with broadcasting(spark, "1m"):
        large, small, none = (sized(spark.range(n).withColumn("one", F.lit(1)), "sized") for n in (400_000, 100, 0))
        assert large._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() >= 400_000 * 12
        assert "Broadcast" not in planned(large.join(large.select("id"), "id"))
        assert "Broadcast" not in planned(large.unionByName(small).join(large.select("id"), "id", "left_semi"))
        assert "Broadcast" in planned(large.join(small.select("id"), "id"))
        assert (large.count(), small.count(), none.count(), large.join(small.select("id"), "id").count()) == (400_000, 100, 0, 100)


def test_nearest_rooms_stay_off_the_driver(spark):
    with broadcasting(spark, "64k"):
        assert "Broadcast" not in planned(M.knn_rooms(rooms(spark, 200, 25)))


@pytest.mark.parametrize("rep", ["metric_relations", "metric_framing"])
def test_placed_rooms_stay_off_the_driver(spark, rep):
    at = rooms(spark, 800, 5)
    links = sized(at.where("room_ord > 0").select("scene_id", F.col("room_id").alias("src"), (F.col("room_id").cast("bigint") - F.col("room_ord")).cast("string").alias("dst"), F.lit(0).alias("nbr_ord")).coalesce(1), "adjacency")
    things = sized(at.select("scene_id", "room_id", F.col("room_id").alias("object_id"), "room_ord", F.lit(None).cast("string").alias("short_id"), F.lit("cup").alias("category")).withColumnRenamed("room_ord", "obj_ord").coalesce(1), "objects")
    tables = {"rooms": at, "adjacency": links, "objects": things, "scenes": at.select("scene_id").distinct().withColumn("name", F.col("scene_id"))}
    with broadcasting(spark, "24k"):
        found = V.render(tables, rep)
        assert "Broadcast" not in planned(found)
    assert found.count() == 800


def test_writes_leave_no_shuffle_files(spark):
    mapped = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    # One that is still in use stays; those of the write have to go.
    before = set(str(k) for k in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(mapped.keys().toSeq()))
    out = sized(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    after = set(str(k) for k in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(mapped.keys().toSeq()))
    assert not after - before
    assert out.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_statements_are_dealt_once(spark):
    things = spark.range(60).select(F.concat(F.lit("s"), F.col("id") % 3).alias("scene_id"), F.col("id").cast("string").alias("object_id"), F.lit(None).cast("string").alias("short_id"), F.lit("cup").alias("category"))
    links = things.select("scene_id", F.col("object_id").cast("int").alias("rel_ord"), F.col("object_id").alias("subject_id"), F.lit("left").alias("predicate"), F.lit("0").alias("object_id"))
    scene = V._Scene({"objects": sized(things, "objects"), "relations": sized(links, "relations")})
    plans, write = [], V.sized

    def watched(df, name, dealt=False):
        if name.startswith("render_statements"):
            assert dealt
            own = storage._moved(spark, storage._aside(spark, storage._DEALT), df._jdf)
            plans.append(own._jdf.queryExecution().executedPlan().toString())
        return write(df, name, dealt)

    V.sized = watched
    try:
        assert V._statements(scene, True).count() == 60
    finally:
        V.sized = write
    # Relations once, labels for either end; no exchange for grouping or ranking.
    assert 2 <= plans[0].count("Exchange hashpartitioning") <= 3


def test_navigation_asks_for_nearest_rooms_where_none_are_connected(spark, monkeypatch):
    at, asked, knn = rooms(spark, 4, 3), [], V.M.knn_rooms
    links = spark.createDataFrame([("scene_0", "0", "1", 0), ("scene_0", "1", "0", 0), ("scene_2", "6", "7", 0), ("scene_2", "7", "6", 0)], "scene_id string, src string, dst string, nbr_ord int")
    things = spark.createDataFrame([], "scene_id string, room_id string, object_id string, obj_ord int, short_id string, category string")
    tables = {"rooms": at, "adjacency": links, "objects": things, "scenes": at.select("scene_id").distinct().withColumn("name", F.col("scene_id"))}
    monkeypatch.setattr(V.M, "knn_rooms", lambda rooms: asked.append(sorted(r[0] for r in rooms.select("scene_id").distinct().collect())) or knn(rooms))
    texts = dict(V.render(tables, "navigation").select("scene_id", "text").collect())
    assert asked == [["scene_1", "scene_3"]]
    assert {k: "proximity" in v for k, v in texts.items()} == {"scene_0": False, "scene_1": True, "scene_2": False, "scene_3": True}
