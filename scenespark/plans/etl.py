"""Queries over raw houses: the driver's customers and orders as house records in JSON, read back and normalized.

The SQL starts from the parts that the records are made of, and knows nothing of JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import cut
from ..sources.scenes import normalize_houses, parse_houses
from .adapters import ctes, shape


def _point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for n, c in (("x", x), ("y", y), ("z", z))])


def _listed(df: DataFrame, name: str, *fields: Column) -> DataFrame:
    """(scene_id, name): an array of structs by ord."""
    rows = df.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("v")))).alias("a"))
    return rows.select("scene_id", F.transform("a", lambda x: x["v"]).alias(name))


def house_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_id, value): a house record a scene, as JSON."""
    c, zero = F.col, F.lit(0)
    rooms = shape(spark, sf_dir, "rooms").withColumn("ord", c("room_ord"))
    corner = lambda dx, dz: _point(c("room_ord") * 3 + dx, zero, c("room_id").cast("bigint") % 7 + dz)
    floor = F.array(corner(0, 0), corner(2, 0), corner(2, 4), corner(0, 4)).alias("floorPolygon")
    out = _listed(rooms, "rooms", F.concat(F.lit("room|"), "room_id").alias("id"), c("category").alias("roomType"), floor)
    at = _point(c("k") % 5, c("k") % 3, zero).alias("position")
    kids = F.when(c("kid").isNotNull(), F.array(F.struct(c("kid").alias("id"), at))).otherwise(F.array()).alias("children")
    out = out.join(_listed(shape(spark, sf_dir, "house_objects"), "objects", c("id"), at, kids), "scene_id", "left")
    room = lambda name: F.concat(F.lit("room|"), name)
    out = out.join(_listed(shape(spark, sf_dir, "house_doors"), "doors", room("a").alias("room0"), room("b").alias("room1")), "scene_id", "left")
    # A shared wall's corners differ in their order, in height and beyond the third digit.
    ends = F.array(_point(c("place"), zero, zero), _point(c("place"), F.lit(3), zero), _point(c("place") + F.when(c("j") == 1, 0.0004).otherwise(0.0), zero, F.lit(2)))
    polygon = F.when(c("j") == 1, F.reverse(ends)).otherwise(ends).alias("polygon")
    out = out.join(_listed(shape(spark, sf_dir, "house_walls"), "walls", room("room").alias("roomId"), polygon, c("empty")), "scene_id", "left")
    return out.select("scene_id", F.to_json(F.struct("rooms", "objects", "doors", "walls")).alias("value"))


def _table(name: str, *columns: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return normalize_houses(parse_houses(cut(house_lines(spark, sf_dir), "houses")))[name].select("scene_id", *columns)

    return query


QUERIES = {
    "house_rooms": _table("rooms", "room_id", "room_ord", "category", "x", "y", "z"),
    "house_objects": _table("objects", "room_id", "object_id", "obj_ord", "short_id", "category"),
    "house_adjacency": _table("adjacency", "src", "dst", "nbr_ord"),
    "house_relations": _table("relations", "rel_ord", "subject_id", "predicate", "object_id"),
}

_LOADED = """every AS (SELECT scene_id, ord, 0 AS sub, k, room_id, cat AS category, id, CAST(NULL AS VARCHAR) AS parent FROM house_objects WHERE k % 11 <> 0 AND k % 13 <> 0
    UNION ALL SELECT scene_id, ord, 1, k, room_id, 'Cup', kid, id FROM house_objects WHERE kid IS NOT NULL),
loaded AS (SELECT *, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY ord, sub) - 1 AS INT) AS obj_ord FROM every)"""

ORACLES = {
    "house_rooms": f"WITH {ctes('rooms')}\nSELECT scene_id, room_id, room_ord, category, CAST(room_ord * 3 + 1 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, CAST(CAST(room_id AS BIGINT) % 7 + 2 AS DOUBLE) AS z FROM rooms",
    "house_objects": f"""WITH {ctes('house_objects')},
{_LOADED}
SELECT scene_id, room_id, id AS object_id, obj_ord, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY CAST(room_id AS BIGINT), obj_ord) AS VARCHAR) AS short_id, category FROM loaded""",
    "house_adjacency": f"""WITH {ctes('house_doors', 'house_walls')},
walls AS (SELECT scene_id, min(ord) AS ord, min(room) AS a, max(room) AS b FROM house_walls WHERE j < 2 GROUP BY scene_id, place HAVING bool_and(empty) AND count(DISTINCT room) = 2),
doors AS (SELECT scene_id, min(ord) AS ord, least(a, b) AS a, greatest(a, b) AS b FROM house_doors WHERE a <> b AND b <> 'unknown' GROUP BY ALL),
e AS (SELECT scene_id, 0 AS kind, ord, a, b FROM doors UNION ALL SELECT scene_id, 1, ord, a, b FROM walls w WHERE NOT EXISTS (SELECT 1 FROM doors d WHERE d.scene_id = w.scene_id AND d.a = w.a AND d.b = w.b)),
both_ways AS (SELECT scene_id, kind, ord, a AS src, b AS dst FROM e UNION ALL SELECT scene_id, kind, ord, b, a FROM e)
SELECT scene_id, src, dst, CAST(row_number() OVER (PARTITION BY scene_id, src ORDER BY kind, ord, dst) - 1 AS INT) AS nbr_ord FROM both_ways""",
    "house_relations": f"""WITH {ctes('house_objects')},
{_LOADED},
held AS (SELECT c.scene_id, 0 AS kind, c.ord, 1 AS sub, c.id AS subject_id, 'on' AS predicate, p.id AS object_id FROM loaded c JOIN loaded p ON p.scene_id = c.scene_id AND p.id = c.parent),
members AS (SELECT *, first_value(id) OVER w AS anchor, row_number() OVER w AS k2, min(ord) OVER (PARTITION BY scene_id, room_id, k % 2) AS lead FROM loaded WHERE sub = 0 AND k % 5 = 1 WINDOW w AS (PARTITION BY scene_id, room_id, k % 2 ORDER BY k)),
r AS (SELECT * FROM held UNION ALL SELECT scene_id, 1, lead, k2, id, 'arranged with', anchor FROM members WHERE k2 > 1)
SELECT scene_id, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY kind, ord, sub) - 1 AS INT) AS rel_ord, subject_id, predicate, object_id FROM r""",
}
