"""What rooms hold. rooms: scene_id, room_id, room_ord, category; objects: scene_id, room_id, object_id, obj_ord, category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _listing(counted: DataFrame, keys: list[str], name: str, *more: Column) -> DataFrame:
    """Categories by falling count, then first appearance: `chair (×4), table`; and more aggregates."""
    item = F.struct((-F.col("n")).alias("k"), "first", F.when(F.col("n") > 1, F.concat(F.col("category"), F.lit(" (×"), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col("category")).alias("t"))
    return counted.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ", ").alias(name), *more)


def object_inventory(rooms: DataFrame, objects: DataFrame) -> DataFrame:
    """(scene_id, room_id, n_objects, inventory) for every room; an empty one has no objects, an unnamed category is object."""
    named = objects.withColumn("category", F.when(F.coalesce("category", F.lit("")) == "", "object").otherwise(F.col("category")))
    counted = named.groupBy("scene_id", "room_id", "category").agg(F.count(F.lit(1)).alias("n"), F.min("obj_ord").alias("first"))
    held = _listing(counted, ["scene_id", "room_id"], "inventory", F.sum("n").cast("int").alias("n_objects")).select("scene_id", "room_id", "n_objects", "inventory")
    out = rooms.select("scene_id", "room_id").join(held, ["scene_id", "room_id"], "left")
    return out.fillna(0, ["n_objects"]).fillna("no objects", ["inventory"])


def room_type_summary(rooms: DataFrame) -> DataFrame:
    """(scene_id, room_types): room categories in the same form; scenes without any have an empty one."""
    counted = rooms.where("category <> ''").groupBy("scene_id", "category").agg(F.count(F.lit(1)).alias("n"), F.min("room_ord").alias("first"))
    return rooms.select("scene_id").distinct().join(_listing(counted, ["scene_id"], "room_types"), "scene_id", "left").fillna("", ["room_types"])


def scene_totals(rooms: DataFrame, objects: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(scene_id, n_rooms, n_objects, n_connections, n_floors, single): counts, and the category of a scene's only room."""
    own = rooms.groupBy("scene_id").agg(F.count(F.lit(1)).cast("int").alias("n_rooms"), F.count_distinct(F.nullif("floor", F.lit(""))).cast("int").alias("n_floors"), F.min(F.coalesce(F.nullif("category", F.lit("")), F.lit("room"))).alias("__c"))
    # Objects of rooms that the scene has.
    n = objects.join(rooms.select("scene_id", "room_id"), ["scene_id", "room_id"], "left_semi").groupBy("scene_id").agg(F.count(F.lit(1)).cast("int").alias("n_objects"))
    c = adjacency.groupBy("scene_id").agg(F.floor(F.count(F.lit(1)) / 2).cast("int").alias("n_connections"))
    out = own.join(n, "scene_id", "left").join(c, "scene_id", "left").fillna(0, ["n_objects", "n_connections"])
    return out.withColumn("single", F.when(F.col("n_rooms") == 1, F.col("__c"))).select("scene_id", "n_rooms", "n_objects", "n_connections", "n_floors", "single")


def room_label(category: str = "category", room_id: str = "room_id") -> Column:
    return F.concat(F.coalesce(F.nullif(F.col(category), F.lit("")), F.lit("room")), F.lit(" ["), F.col(room_id), F.lit("]"))
