"""Where rooms lie: floor groups, planes, bearings, neighbours.

rooms: scene_id, room_id, room_ord, floor and x, y, z (null where a room is not placed).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import rounded
from ..functions.storage import sized

# Sectors counter-clockwise from east.
SECTORS = ["east", "north-east", "north", "north-west", "west", "south-west", "south", "south-east"]
NEAREST = 4


def capabilities(rooms: DataFrame, adjacency: DataFrame, relations: DataFrame) -> DataFrame:
    """What a scene can be asked: (scene_id, multiroom, connected, floors, relations)."""
    own = rooms.groupBy("scene_id").agg((F.count_if(F.col("x").isNotNull()) >= 2).alias("multiroom"), (F.count_distinct("floor") >= 2).alias("floors"))
    has = lambda df, name: df.select("scene_id").distinct().withColumn(name, F.lit(True))
    return own.join(has(adjacency, "connected"), "scene_id", "left").join(has(relations, "relations"), "scene_id", "left").fillna(False).select("scene_id", "multiroom", "connected", "floors", "relations")


def floor_groups(rooms: DataFrame) -> DataFrame:
    """Placed rooms with group_floor and group_ord: one group a floor where there are two or more, rooms without floor last; else one group."""
    scene = Window.partitionBy("scene_id")
    placed = rooms.where("x IS NOT NULL").withColumn("__lo", F.min("floor").over(scene)).withColumn("__hi", F.max("floor").over(scene))
    # Floors of rooms that are not placed count, too, for whether a scene has floors.
    scenes = rooms.groupBy("scene_id").agg((F.count_distinct("floor") >= 2).alias("__many"))
    out = placed.drop("__lo", "__hi").join(scenes, "scene_id").withColumn("group_floor", F.when(F.col("__many"), F.col("floor")))
    return out.withColumn("group_ord", F.dense_rank().over(scene.orderBy(F.col("group_floor").asc_nulls_last()))).drop("__many")


def floor_plane(placed: DataFrame, digits: int | None = None) -> DataFrame:
    """placed rooms with u and v: the two axes other than the one of least variance in their group (the first of equals; digits: to so many digits)."""
    var = placed.groupBy("scene_id", "group_ord").agg(F.array(*[rounded(F.var_pop(c), digits) for c in "xyz"]).alias("__v"))
    up = F.array_position("__v", F.array_min("__v"))
    out = placed.join(var.select("scene_id", "group_ord", up.alias("up")), ["scene_id", "group_ord"])
    return out.withColumns({"u": F.when(F.col("up") == 1, F.col("y")).otherwise(F.col("x")), "v": F.when(F.col("up") == 3, F.col("y")).otherwise(F.col("z"))})


def compass(du: Column, dv: Column) -> Column:
    """The nearest of eight bearings; halves go to the even sector."""
    sector = F.pmod(F.rint(F.atan2(dv, du) / (math.pi / 4)).cast("int"), F.lit(8))
    return F.element_at(F.array(*[F.lit(s) for s in SECTORS]), sector + 1)


def distance_3d(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a, b)), F.lit(0.0)))


def _side(plane: DataFrame, s: str) -> DataFrame:
    return plane.select("scene_id", "group_ord", F.col("room_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("u", "v", "room_ord")])


def _placed_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of rooms (a, a_u, …, b, b_u, …, nbr_ord) with distance and both bearings."""
    du, dv = F.col("a_u") - F.col("b_u"), F.col("a_v") - F.col("b_v")
    return pairs.select("scene_id", "group_ord", "a", "b", "nbr_ord", F.hypot(du, dv).alias("distance"), compass(du, dv).alias("a_from_b"), compass(-du, -dv).alias("b_from_a"))


def _pairs(plane: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs of links (scene_id, src, dst, nbr_ord) that lie in one group."""
    links = links.select("scene_id", F.col("src").alias("a"), F.col("dst").alias("b"), "nbr_ord")
    return _placed_pairs(links.join(_side(plane, "a"), ["scene_id", "a"]).join(_side(plane, "b"), ["scene_id", "group_ord", "b"]))


#: Rooms of a grid cell at a group's finest level, and how often its extent is quartered at most.
CROWD, LEVELS = 32, 20


def _cell(c: str, level: Column) -> Column:
    """Which of 4^level equal strips of the group's extent a coordinate lies in."""
    return F.floor((F.col(c) - F.col(f"{c[-1]}0")) / F.col("extent") * F.pow(F.lit(4.0), level)).cast("long")


def _grids(plane: DataFrame) -> DataFrame:
    """(scene_id, group_ord, u0, v0, extent, finest): each group's square, quartered both ways until no cell holds more than CROWD different places."""
    key = ["scene_id", "group_ord"]
    box = plane.groupBy(*key).agg(F.min("u").alias("u0"), F.min("v").alias("v0"), F.greatest(F.max("u") - F.min("u"), F.max("v") - F.min("v")).alias("extent"), F.count(F.lit(1)).alias("n"))
    box = sized(box.withColumn("extent", F.when(F.col("extent") > 0, F.col("extent")).otherwise(1.0) * 1.000001), "grid_boxes")
    done, left = box.where(F.col("n") <= CROWD).withColumn("finest", F.lit(0)), box.where(F.col("n") > CROWD)
    places = plane.select(*key, "u", "v").distinct()
    level = 0
    while level < LEVELS and not left.isEmpty():
        level += 1
        cells = places.join(left, key).groupBy(*key, _cell("u", F.lit(level)).alias("i"), _cell("v", F.lit(level)).alias("j")).agg(F.count(F.lit(1)).alias("c"))
        most = sized(cells.groupBy(*key).agg(F.max("c").alias("c")), "grid_cells")
        done = done.unionByName(left.join(most.where(F.col("c") <= CROWD).select(*key), key).withColumn("finest", F.lit(level)))
        left = left.join(most.where(F.col("c") > CROWD).select(*key), key)
    return sized(done.unionByName(left.withColumn("finest", F.lit(level))).drop("n"), "grids")


def knn_rooms(rooms: DataFrame, k: int = NEAREST, digits: int | None = None) -> DataFrame:
    """Each placed room's k nearest of its group, nearest first, insertion order between equals (digits: to so many digits): (…, rank, distance, a_from_b, b_from_a).

    Rooms lie in square cells of a grid a group, fine enough that few share one. A room is
    held against those of its own and the eight cells around it; if its k-th distance is
    no more than a cell's side, no other room can be nearer. Rooms for which that fails go
    on to cells four times as wide, up to the whole floor. Such rooms have few others about
    them, so few of them share a cell: the work of a level is linear in the rooms. Of
    rooms on one spot only the first k + 1 can be anyone's neighbour.
    """
    key = ["scene_id", "group_ord"]
    plane = sized(floor_plane(floor_groups(rooms), digits).select(*key, "room_id", "room_ord", "u", "v"), "knn_plane")
    grids = _grids(plane)
    on_spot = F.row_number().over(Window.partitionBy(*key, "u", "v").orderBy("room_ord", "room_id"))
    near = sized(plane.withColumn("spot", on_spot).where(F.col("spot") <= k + 1).drop("spot").join(grids, key), "knn_places")
    waiting = sized(plane.join(grids, key), "knn_rooms")
    top = waiting.agg(F.max("finest")).first()[0] or 0
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o")
    w = Window.partitionBy("scene_id", "group_ord", "a").orderBy(rounded(F.col("distance"), digits), "nbr_ord", "b")
    found, done = None, None
    for level in range(top, -1, -1):
        at, open_ = F.lit(level), waiting.where(F.col("finest") >= level)
        if done is not None:
            open_ = open_.join(done, [*key, "room_id"], "left_anti")
        places, side = ["u", "v", "room_ord"], lambda df, s: df.select(*key, F.col("room_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in places], *[c for c in ("extent", "i", "j") if c in df.columns])  # noqa: B023
        mine, theirs, on = open_, near.drop("extent"), key
        if level:  # at level 0 the whole floor is one cell
            cells, on = {"i": _cell("u", at), "j": _cell("v", at)}, [*key, "i", "j"]
            mine = mine.withColumns(cells).select("*", around).withColumns({"i": F.col("i") + F.col("o.i"), "j": F.col("j") + F.col("o.j")})
            theirs = near.withColumns(cells).drop("extent")
        mine = side(mine, "a")
        pairs = mine.join(side(theirs, "b"), on).where("a <> b").withColumn("nbr_ord", F.col("b_room_ord"))
        reach = mine.groupBy(*key, "a").agg((F.first("extent") / 4.0**level * (1 - 1e-9) - (10.0**-digits if digits else 0)).alias("reach"))
        best = _placed_pairs(pairs).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("nbr_ord")
        if level:
            best = sized(best, "knn_best")
            kth = best.groupBy(*key, "a").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far")).join(reach, [*key, "a"])
            sure = sized(kth.where((F.col("n") == k) & (F.col("far") < F.col("reach"))).select(*key, "a"), "knn_sure")
            best = best.join(sure, [*key, "a"], "left_semi")
            sure = sure.withColumnRenamed("a", "room_id")
            done = sure if done is None else done.unionByName(sure)
        found = best if found is None else found.unionByName(best)
    return found


def connected_placements(rooms: DataFrame, adjacency: DataFrame, digits: int | None = None) -> DataFrame:
    """Each room's connected rooms of its group, nearest first, list order between equals."""
    pairs = _pairs(floor_plane(floor_groups(rooms), digits), adjacency)
    w = Window.partitionBy("scene_id", "a").orderBy(rounded(F.col("distance"), digits), "nbr_ord")
    return pairs.withColumn("rank", F.row_number().over(w)).drop("nbr_ord")


def isolated_rooms(rooms: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Placed rooms without a connected room in their group."""
    return floor_groups(rooms).select("scene_id", "group_ord", F.col("room_id").alias("a")).join(_pairs(floor_plane(floor_groups(rooms)), adjacency).select("scene_id", "a").distinct(), ["scene_id", "a"], "left_anti").withColumnRenamed("a", "room_id")


def exhaustive_flag(rooms: DataFrame, k: int = NEAREST) -> DataFrame:
    """(scene_id, exhaustive): no group has a room with more than k others."""
    sizes = floor_groups(rooms).groupBy("scene_id", "group_ord").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("scene_id").agg((F.max("n") - 1 <= k).alias("exhaustive"))
