"""Raw scenes to normalized tables: houses, scans, buildings.

Each reader returns a dict of DataFrames: scenes, rooms, objects, adjacency, relations.
Insertion order, on which later ties depend, is kept as ordinals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import cut

_XYZ = "struct<x:double,y:double,z:double>"
HOUSE_SCHEMA = f"rooms array<struct<id:string,roomType:string,floorPolygon:array<{_XYZ}>>>, objects array<struct<id:string,position:{_XYZ},children:array<struct<id:string,position:{_XYZ}>>>>, doors array<struct<room0:string,room1:string>>, walls array<struct<roomId:string,polygon:array<{_XYZ}>,empty:boolean>>"
_ROOM = ["scene_id", "room_id", "room_ord", "category", "floor", "x", "y", "z", "size", "floor_area", "volume"]
_OBJECT = ["scene_id", "room_id", "object_id", "obj_ord", "short_id", "category", "position", "size", "affordances", "material", "visual_texture", "tactile_texture"]


def _null(kind: str, name: str) -> Column:
    return F.lit(None).cast(kind).alias(name)


def read_houses(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """(scene_id, house): JSON lines, gzipped or plain; a scene is its file's stem and line number, whatever splits a file is read in.

    Lines are counted by split first (a row a split), so a line's number is its place in
    its split after those of the splits before; lines themselves are shuffled only to
    spread their parsing.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__i"))
    splits = lines.groupBy("__f", "__b").agg(F.count(F.lit(1)).alias("n"), F.min("__i").alias("__first"))
    before = F.sum("n").over(Window.partitionBy("__f").orderBy("__b")) - F.col("n")
    splits = cut(splits.select("__f", "__b", (before - F.col("__first")).alias("__shift")), "house_splits")
    rows = lines.join(splits, ["__f", "__b"]).withColumn("scene_id", F.concat(_split_name("__f"), F.lit(":"), (F.col("__i") + F.col("__shift")).cast("string")))
    n = partitions or spark.sparkContext.defaultParallelism
    return parse_houses(rows.select("scene_id", "value").repartition(n, "scene_id"))


def _split_name(path: str) -> Column:
    return F.url_decode(F.regexp_extract(path, r"([^/]+?)\.jsonl(?:\.gz)?$", 1))


def parse_houses(lines: DataFrame) -> DataFrame:
    """(scene_id, house) of lines (scene_id, value); those that are no records are left out."""
    return lines.select("scene_id", F.from_json("value", HOUSE_SCHEMA).alias("house")).where("coalesce(size(house.rooms), size(house.objects), size(house.doors), size(house.walls)) >= 0")


def normalize_houses(houses: DataFrame) -> dict[str, DataFrame]:
    """Normalized tables of house records."""
    rooms = house_rooms(houses)
    objects, pairs = house_objects(houses, rooms)
    doors, passages = door_edges(houses, rooms), open_plan_edges(houses, rooms)
    edges = doors.unionByName(passages.join(doors.select("scene_id", "src", "dst"), ["scene_id", "src", "dst"], "left_anti"))
    order = Window.partitionBy("scene_id", "src").orderBy("edge_ord", "dst")
    relations = on_relations(pairs).unionByName(group_relations(objects, pairs))
    number = Window.partitionBy("scene_id").orderBy("kind", "ord", "sub")
    return {
        "scenes": houses.select("scene_id", F.lit("procthor").alias("host"), F.col("scene_id").alias("name"), _null(_XYZ, "size")),
        "rooms": rooms, "objects": mint_short_ids(objects),
        "adjacency": edges.select("scene_id", "src", "dst", (F.row_number().over(order) - 1).alias("nbr_ord")),
        "relations": relations.select("scene_id", (F.row_number().over(number) - 1).alias("rel_ord"), "subject_id", "predicate", "object_id"),
    }


def _part(c: str | Column, i: int) -> Column:
    return F.get(F.split(c, r"\|"), F.lit(i))


def house_rooms(houses: DataFrame) -> DataFrame:
    """Rooms; the position is the mean of the floor polygon's corners, on the ground."""
    r = houses.select("scene_id", F.posexplode("house.rooms").alias("room_ord", "r"))
    mean = lambda a: F.aggregate("r.floorPolygon", F.lit(0.0), lambda s, p: s + p[a]) / F.size("r.floorPolygon")
    return r.select("scene_id", _part("r.id", 1).alias("room_id"), "room_ord", F.col("r.roomType").alias("category"), _null("string", "floor"), mean("x").alias("x"), F.lit(0.0).alias("y"), mean("z").alias("z"), _null(_XYZ, "size"), _null("double", "floor_area"), _null("double", "volume"))


def house_objects(houses: DataFrame, rooms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects and their children in rooms that exist, and the pairs (child and parent loaded or not).

    A room is an id's second part, or its third where the second is surface.
    """
    top = houses.select("scene_id", F.posexplode("house.objects").alias("ord", "o"))
    kids = top.select("scene_id", "ord", F.col("o.id").alias("parent"), F.posexplode("o.children").alias("sub", "o")).withColumn("sub", F.col("sub") + 1)
    every = top.select("scene_id", "ord", F.lit(0).alias("sub"), _null("string", "parent"), "o.id", "o.position").unionByName(kids.select("scene_id", "ord", "sub", "parent", "o.id", "o.position"))
    every = every.withColumn("room_id", F.when(_part("id", 1) == "surface", _part("id", 2)).otherwise(_part("id", 1)))
    loaded = every.join(rooms.select("scene_id", "room_id"), ["scene_id", "room_id"], "left_semi")
    order = Window.partitionBy("scene_id").orderBy("ord", "sub")
    objects = loaded.select("scene_id", "room_id", F.col("id").alias("object_id"), (F.row_number().over(order) - 1).alias("obj_ord"), _null("string", "short_id"), _part("id", 0).alias("category"), "position", _null(_XYZ, "size"), _null("array<string>", "affordances"), _null("array<string>", "material"), _null("string", "visual_texture"), _null("string", "tactile_texture"))
    return objects, loaded.select("scene_id", "ord", "sub", "parent", "id")


def on_relations(pairs: DataFrame) -> DataFrame:
    """Children on their parents, where both are loaded."""
    # A parent counts from its own place on: an equal id further down doesn't.
    tops = pairs.select("scene_id", F.col("id").alias("parent"), F.col("ord").alias("__o"), F.col("sub").alias("__s"))
    seen = pairs.where("parent IS NOT NULL").join(tops, ["scene_id", "parent"]).where("__o < ord OR __o = ord AND __s <= sub")
    return seen.select("scene_id", F.lit(0).alias("kind"), "ord", "sub", F.col("id").alias("subject_id"), F.lit("on").alias("predicate"), F.col("parent").alias("object_id")).distinct()


def group_relations(objects: DataFrame, pairs: DataFrame) -> DataFrame:
    """Members of an asset group are arranged with the one of least number."""
    parts = F.split("id", r"\|")
    top = pairs.where((F.col("sub") == 0) & (F.size(parts) == 4) & (F.get(parts, F.lit(1)) != "surface") & F.get(parts, F.lit(3)).rlike(r"^\d+$"))
    top = top.select("scene_id", "ord", "id", F.get(parts, F.lit(1)).alias("room"), F.get(parts, F.lit(2)).alias("g"), F.get(parts, F.lit(3)).cast("bigint").alias("m"))
    group = Window.partitionBy("scene_id", "room", "g")
    top = top.withColumns({"anchor": F.first("id").over(group.orderBy("m", "id")), "rank": F.row_number().over(group.orderBy("m", "id")), "first": F.min("ord").over(group)})
    return top.where("rank > 1").select("scene_id", F.lit(1).alias("kind"), F.col("first").alias("ord"), F.col("rank").alias("sub"), F.col("id").alias("subject_id"), F.lit("arranged with").alias("predicate"), F.col("anchor").alias("object_id"))


def mint_short_ids(objects: DataFrame) -> DataFrame:
    """Running numbers over rooms by number, objects in insertion order."""
    order = Window.partitionBy("scene_id").orderBy(F.col("room_id").cast("bigint"), "obj_ord")
    return objects.withColumn("short_id", F.row_number().over(order).cast("string"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("scene_id", F.col("a").alias("src"), F.col("b").alias("dst"), "edge_ord").unionByName(edges.select("scene_id", F.col("b").alias("src"), F.col("a").alias("dst"), "edge_ord"))


def _known(edges: DataFrame, rooms: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        edges = edges.join(rooms.select("scene_id", F.col("room_id").alias(side)), ["scene_id", side], "left_semi")
    return edges


def door_edges(houses: DataFrame, rooms: DataFrame) -> DataFrame:
    """(scene_id, src, dst, edge_ord): doors between two rooms that exist, each pair once, in both directions."""
    d = houses.select("scene_id", F.posexplode("house.doors").alias("edge_ord", "d"))
    p, q = _part("d.room0", 1), _part("d.room1", 1)
    d = d.select("scene_id", "edge_ord", F.least(p, q).alias("a"), F.greatest(p, q).alias("b")).where("a <> b").groupBy("scene_id", "a", "b").agg(F.min("edge_ord").alias("edge_ord"))
    return _both(_known(d, rooms))


def open_plan_edges(houses: DataFrame, rooms: DataFrame) -> DataFrame:
    """Walls of equal footprint that two rooms own and that are all flagged empty."""
    w = houses.select("scene_id", F.posexplode("house.walls").alias("edge_ord", "w")).withColumn("room", _part("w.roomId", 1))
    w = w.join(rooms.select("scene_id", F.col("room_id").alias("room")), ["scene_id", "room"], "left_semi")
    r3 = lambda c: F.round(c, 3) + 0.0
    foot = F.array_sort(F.array_distinct(F.transform("w.polygon", lambda p: F.struct(r3(p["x"]).alias("x"), r3(p["z"]).alias("z")))))
    g = w.groupBy("scene_id", foot.alias("f")).agg(F.array_sort(F.collect_set("room")).alias("rooms"), F.bool_and(F.coalesce("w.empty", F.lit(False))).alias("open"), (F.min("edge_ord") + 1_000_000).alias("edge_ord"))
    g = g.where("size(rooms) = 2 AND open").select("scene_id", F.col("rooms")[0].alias("a"), F.col("rooms")[1].alias("b"), "edge_ord").groupBy("scene_id", "a", "b").agg(F.min("edge_ord").alias("edge_ord"))
    return _both(g)


SEGMENT_SCHEMA = "segGroups array<struct<objectId:int,label:string,obb:struct<centroid:array<double>,axesLengths:array<double>>>>"
_META_SCHEMA = "scans array<struct<scan:string,objects:array<struct<id:string,label:string,affordances:array<string>>>>>"
_RELATION_SCHEMA = "scans array<struct<scan:string,relationships:array<array<string>>>>"


def _triple(c: str) -> Column:
    """Three numbers, rounded to 4; null for anything else."""
    at = lambda i: F.round(F.get(c, F.lit(i)), 4)
    return F.when(at(0).isNotNull() & at(1).isNotNull() & at(2).isNotNull(), F.struct(at(0).alias("x"), at(1).alias("y"), at(2).alias("z")))


def read_scans(spark: SparkSession, segments: str, objects: str | None = None, relationships: str | None = None) -> dict[str, DataFrame]:
    """Normalized tables of scans: geometry by scan folder, metadata and relations from two optional files; a scan is one room without a place."""
    seg = spark.read.schema(SEGMENT_SCHEMA).json(segments, multiLine=True).withColumn("scene_id", F.url_decode(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)))
    seg = seg.select("scene_id", F.posexplode("segGroups").alias("__ord", "s")).withColumn("object_id", F.col("s.objectId").cast("string"))
    # Of segments with one id the last counts, in the first one's place.
    seg = seg.groupBy("scene_id", "object_id").agg(F.max_by("s", "__ord").alias("s"), F.min("__ord").alias("__ord"))
    meta = spark.createDataFrame([], "scene_id string, object_id string, label string, affordances array<string>")
    if objects:
        scans = spark.read.schema(_META_SCHEMA).json(objects, multiLine=True).select(F.explode("scans").alias("c"))
        meta = scans.select(F.col("c.scan").alias("scene_id"), F.explode("c.objects").alias("o")).select("scene_id", F.col("o.id").alias("object_id"), "o.label", "o.affordances").dropDuplicates(["scene_id", "object_id"])
    rows = seg.join(meta, ["scene_id", "object_id"], "left")
    order = Window.partitionBy("scene_id").orderBy("__ord")
    category = F.coalesce(F.nullif("label", F.lit("")), "s.label")
    afford = F.when(F.size("affordances") > 0, F.col("affordances"))
    objs = rows.select("scene_id", F.col("scene_id").alias("room_id"), "object_id", (F.row_number().over(order) - 1).alias("obj_ord"), _null("string", "short_id"), category.alias("category"), _triple("s.obb.centroid").alias("position"), _triple("s.obb.axesLengths").alias("size"), afford.alias("affordances"), _null("array<string>", "material"), _null("string", "visual_texture"), _null("string", "tactile_texture"))
    scenes = seg.select("scene_id").distinct()
    relations = spark.createDataFrame([], "scene_id string, rel_ord int, subject_id string, predicate string, object_id string")
    if relationships:
        scans = spark.read.schema(_RELATION_SCHEMA).json(relationships, multiLine=True).select(F.explode("scans").alias("c"))
        r = scans.select(F.col("c.scan").alias("scene_id"), F.posexplode("c.relationships").alias("rel_ord", "r"))
        relations = r.select("scene_id", "rel_ord", F.col("r")[0].alias("subject_id"), F.col("r")[3].alias("predicate"), F.col("r")[1].alias("object_id")).where("predicate <> 'same object type'")
    one = scenes.select("scene_id", F.col("scene_id").alias("room_id"), F.lit(0).alias("room_ord"), _null("string", "category"), _null("string", "floor"), *[_null("double", c) for c in "xyz"], _null(_XYZ, "size"), _null("double", "floor_area"), _null("double", "volume"))
    return {"scenes": scenes.select("scene_id", F.lit("3rscan").alias("host"), F.col("scene_id").alias("name"), _null(_XYZ, "size")), "rooms": one, "objects": objs, "adjacency": spark.createDataFrame([], "scene_id string, src string, dst string, nbr_ord int"), "relations": relations}


_PART = "location array<double>, size array<double>"
BUILDING_SCHEMA = "building struct<name:string,size:array<double>,object_ids:array<bigint>,room_ids:array<bigint>>, object map<string,struct<class_:string,location:array<double>,size:array<double>,parent_room:bigint,action_affordance:array<string>,material:array<string>,visual_texture:string,tactile_texture:string>>, room map<string,struct<scene_category:string,location:array<double>,size:array<double>,floor_number:string,floor_area:double,volume:double>>"


def _plain(c: str) -> Column:
    at = lambda i: F.get(c, F.lit(i))
    return F.when(at(0).isNotNull() & at(1).isNotNull() & at(2).isNotNull(), F.struct(at(0).alias("x"), at(1).alias("y"), at(2).alias("z")))


def read_buildings(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Normalized tables of building records, one JSON line each (exported from their archives): ids distinct and rising, 0 left out; an object without room goes with the rooms that aren't there."""
    b = spark.read.schema(BUILDING_SCHEMA).json(path).withColumn("scene_id", F.col("building.name"))
    ids = lambda c: F.filter(F.array_sort(F.array_distinct(c)), lambda x: x != 0)
    r = b.select("scene_id", "room", F.posexplode(ids("building.room_ids")).alias("room_ord", "id")).withColumn("r", F.element_at("room", F.col("id").cast("string")))
    place = _plain("r.location")
    rooms = r.select("scene_id", F.col("id").cast("string").alias("room_id"), "room_ord", F.col("r.scene_category").alias("category"), F.col("r.floor_number").alias("floor"), *[place[c].alias(c) for c in "xyz"], _plain("r.size").alias("size"), "r.floor_area", "r.volume")
    o = b.select("scene_id", "object", F.posexplode(ids("building.object_ids")).alias("obj_ord", "id")).withColumn("o", F.element_at("object", F.col("id").cast("string")))
    full = lambda c: F.when(F.size(c) > 0, F.col(c))
    objects = o.select("scene_id", F.coalesce("o.parent_room", F.lit(0)).cast("string").alias("room_id"), F.col("id").cast("string").alias("object_id"), "obj_ord", _null("string", "short_id"), F.col("o.class_").alias("category"), _plain("o.location").alias("position"), _plain("o.size").alias("size"), full("o.action_affordance").alias("affordances"), full("o.material").alias("material"), "o.visual_texture", "o.tactile_texture")
    objects = objects.join(rooms.select("scene_id", "room_id"), ["scene_id", "room_id"], "left_semi").select(*_OBJECT)
    empty = spark.createDataFrame([], "scene_id string, src string, dst string, nbr_ord int")
    return {"scenes": b.select("scene_id", F.lit("gibson").alias("host"), F.col("building.name").alias("name"), _plain("building.size").alias("size")), "rooms": rooms, "objects": objects, "adjacency": empty, "relations": spark.createDataFrame([], "scene_id string, rel_ord int, subject_id string, predicate string, object_id string")}


#: Readers by name; add one's own: a function of (spark, …) that returns the normalized tables.
READERS: dict[str, Callable[..., dict[str, DataFrame]]] = {"houses": lambda spark, path: normalize_houses(read_houses(spark, path)), "scans": read_scans, "buildings": read_buildings}
