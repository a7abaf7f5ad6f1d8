"""Scenes as texts: one function a representation, tables -> (scene_id, text).

tables: scenes (scene_id, name, size), rooms, objects, adjacency, relations. Each text is
a union of line tables with places, put together by one grouping on the scene. Scenes
that lack what a representation needs have no row. Trees are drawn from the paths of
their nodes: the order of paths is the order of lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import id_key
from ..functions.storage import sized
from ..functions.text import assemble, json_indented, lines, py_fixed
from . import geometry as M
from . import graph as G
from . import inventory as I
from . import relations as R

Tables = dict[str, DataFrame]


def _cat(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _c(name: str) -> Column:
    return F.col(name)


def _plural(n: Column) -> Column:
    return F.when(n != 1, "s").otherwise("")


def _rank(*by: Column) -> Column:
    return F.row_number().over(Window.partitionBy("scene_id").orderBy(*by))


class _Scene:
    """What several representations share, each computed when it is asked for."""

    def __init__(self, t: Tables):
        self.t = t
        self._made: dict[str, DataFrame] = {}

    def _once(self, name: str, make: Callable[[], DataFrame], dealt: bool = False) -> DataFrame:
        if name not in self._made:
            self._made[name] = sized(make(), f"render_{name}", dealt)
        return self._made[name]

    @property
    def head(self) -> DataFrame:
        """Scenes with name, totals and room types."""
        t = self.t
        return self._once("head", lambda: t["scenes"].select("scene_id", "name").join(I.scene_totals(t["rooms"], t["objects"], t["adjacency"]), "scene_id").join(I.room_type_summary(t["rooms"]), "scene_id"))

    @property
    def rooms(self) -> DataFrame:
        """Rooms with label, inventory, degree of the lists as they are, and their neighbours' labels."""

        def make() -> DataFrame:
            t = self.t
            out = t["rooms"].withColumn("label", I.room_label()).join(I.object_inventory(t["rooms"], t["objects"]), ["scene_id", "room_id"]).join(G.degrees(t["rooms"], t["adjacency"], clean=False), ["scene_id", "room_id"])
            to = out.select("scene_id", _c("room_id").alias("dst"), "label", "degree")
            key = F.struct((-_c("degree")).alias("d"), id_key("dst").alias("k"), "label")
            near = t["adjacency"].select("scene_id", "src", "dst").distinct().join(to, ["scene_id", "dst"]).groupBy("scene_id", _c("src").alias("room_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["label"]), ", ").alias("neighbours"))
            return out.join(near, ["scene_id", "room_id"], "left")

        return self._once("rooms", make)

    @property
    def placed(self) -> DataFrame:
        """Placed rooms by floor group, of scenes with two or more."""
        return self._once("placed", lambda: self.laid_out(M.floor_groups(self.rooms)))

    @property
    def nearest(self) -> DataFrame:
        """Nearest rooms with both labels and the distance as text."""
        return self._once("nearest", lambda: self.near(self.t["rooms"]))

    def near(self, rooms: DataFrame) -> DataFrame:
        return _named(self, M.knn_rooms(rooms)).withColumn("m", _metres())

    @property
    def labels(self) -> DataFrame:
        return self._once("labels", lambda: R.labels(self.t["objects"]))

    @property
    def relations(self) -> DataFrame:
        """Relations with both labels."""
        return self._once("relations", lambda: self.resolved(self.dealt, "subject_id", "subject", "object_id", "object"), dealt=True)

    @property
    def dealt(self) -> DataFrame:
        """Relations dealt by scene once, so that what follows can stay there: a scene's text is put together in one place anyway."""
        return self.t["relations"].repartition("scene_id")

    def resolved(self, df: DataFrame, a: str, la: str, b: str, lb: str) -> DataFrame:
        """df, dealt by scene, with the labels of two columns of objects."""
        names = self.labels.repartition("scene_id")
        return R.resolve(R.resolve(df, names, a, la), names, b, lb)

    def having(self, df: DataFrame, *tables: str) -> DataFrame:
        """df's scenes that have rows in all these tables."""
        for name in tables:
            df = df.join(self.t[name].select("scene_id").distinct(), "scene_id", "left_semi")
        return df

    def laid_out(self, df: DataFrame) -> DataFrame:
        """df's scenes with two or more placed rooms."""
        return df.join(self.t["rooms"].where("x IS NOT NULL").groupBy("scene_id").count().where("count >= 2"), "scene_id", "left_semi")

    def labelled(self, df: DataFrame, keys: list[str], ids: str, names: DataFrame, node: str, out: str, sep: str = ", ") -> DataFrame:
        """df (keys, an array of ids) with the labels of the ids, joined in order."""
        rows = df.select(*keys, F.posexplode(ids).alias("__p", node)).join(names.select("scene_id", node, "label"), ["scene_id", node], "left")
        rows = rows.withColumn("label", F.coalesce("label", _cat("object [", _c(node), "]")))
        return df.join(rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__p", "label"))), lambda x: x["label"]), sep).alias(out)), keys)


# ---- inventories and lists --------------------------------------------------------
def inventory(s: _Scene) -> DataFrame:
    h = s.head
    first = F.when(_c("n_rooms") == 1, _cat(_c("name"), " — single ", _c("single"), " with ", _c("n_objects"), " objects.")).otherwise(_cat(_c("name"), " — ", _c("n_rooms"), " rooms, ", _c("n_objects"), " objects."))
    types = F.when((_c("n_rooms") > 1) & (_c("room_types") != ""), _cat("Room types: ", _c("room_types"), "."))
    return assemble(lines(h, 0, first), lines(h, 1, types), lines(h, 2, F.lit("")), lines(s.rooms, 3, _cat(_c("label"), " — contains: ", _c("inventory"), "."), _rank(F.desc("n_objects"), id_key("room_id"))))


def _by_degree() -> Column:
    return _rank(F.desc("degree"), id_key("room_id"), F.desc("n_objects"))


def _connects(s: _Scene) -> Column:
    return _cat("  connects to: ", F.coalesce("neighbours", F.lit("(none)")))


def topology(s: _Scene) -> DataFrame:
    h, r = s.having(s.head, "adjacency"), s.having(s.rooms, "adjacency")
    head = _cat(_c("name"), " — ", _c("n_rooms"), " rooms, ", _c("n_connections"), " room connections (doorways or open passages).")
    return assemble(lines(h, 0, head), lines(h, 1, F.lit("")), lines(r, 2, _c("label"), _by_degree(), 0), lines(r, 2, _connects(s), _by_degree(), 1))


def topology_inventory(s: _Scene) -> DataFrame:
    h, r = s.having(s.head, "adjacency"), s.having(s.rooms, "adjacency")
    types = F.when(_c("room_types") != "", _cat(" Room types: ", _c("room_types"), ".")).otherwise("")
    head = _cat(_c("name"), " — ", _c("n_rooms"), " rooms, ", _c("n_objects"), " objects, ", _c("n_connections"), " room connections (doorways or open passages).", types)
    body = [lines(r, 2, text, _by_degree(), i) for i, text in enumerate((_c("label"), _connects(s), _cat("  contains: ", _c("inventory"))))]
    return assemble(lines(h, 0, head), lines(h, 1, F.lit("")), *body)


def _room_line(count: bool) -> Column:
    near = F.when(_c("neighbours").isNotNull(), _cat("; connects to ", _c("neighbours"))).otherwise("")
    n = _cat(_c("n_objects"), " object", _plural(_c("n_objects"))) if count else F.lit("")
    return _cat(_c("label"), near, "; contains ", n, ": ", _c("inventory"), ".") if count else _cat(_c("label"), near, "; contains: ", _c("inventory"), ".")


def _prose_head(h: DataFrame, single: bool) -> list[DataFrame]:
    floors = F.when(_c("n_floors") > 0, _cat(" across ", _c("n_floors"), " floor", _plural(_c("n_floors")))).otherwise("")
    many = _cat(_c("name"), " contains ", _c("n_rooms"), " rooms", floors, " and ", _c("n_objects"), " objects.")
    one = _cat(_c("name"), " is a single ", _c("single"), " containing ", _c("n_objects"), " objects.")
    joined = F.when(_c("n_connections") > 0, _cat("Rooms are connected by ", _c("n_connections"), " room connection", _plural(_c("n_connections")), " (doorways or open passages)."))
    return [lines(h, 0, F.when((_c("n_rooms") == 1) & F.lit(single), one).otherwise(many)), lines(h, 1, F.when(_c("room_types") != "", _cat("Room types: ", _c("room_types"), "."))), lines(h, 2, joined)]


def narrative(s: _Scene) -> DataFrame:
    h, r = s.having(s.head, "adjacency"), s.having(s.rooms, "adjacency")
    return assemble(*_prose_head(h, False), lines(h, 3, F.lit("")), lines(r, 4, _room_line(False), _by_degree()))


def _by_floor(s: _Scene, section: int, indent_all: bool) -> list[DataFrame]:
    """Room lines by floor where there are several: a head, the rooms, a blank line; rooms without floor last."""
    r = s.rooms.join(s.head.select("scene_id", (_c("n_floors") > 1).alias("many")), "scene_id").withColumn("fl", F.when(_c("many"), F.nullif("floor", F.lit(""))))
    r = r.withColumn("a", F.dense_rank().over(Window.partitionBy("scene_id").orderBy(_c("fl").asc_nulls_last()))).withColumn("b", F.row_number().over(Window.partitionBy("scene_id", "fl").orderBy(F.desc("degree"), id_key("room_id"), F.desc("n_objects"))))
    floors = r.where("fl IS NOT NULL").groupBy("scene_id", "a", "fl").agg(F.count(F.lit(1)).alias("n"))
    indent = F.lit("  ") if indent_all else F.when(_c("fl").isNotNull(), "  ").otherwise("")
    return [lines(floors, section, _cat("Floor ", _c("fl"), " (", _c("n"), " rooms):"), "a", 0), lines(r, section, _cat(indent, _room_line(True)), "a", 1, "b"), lines(floors, section, F.lit(""), "a", 2)]


def _statements(s: _Scene, same: bool) -> DataFrame:
    """(scene_id, subject_id, subject, said, spatial, total, rank): a subject's predicates by kind and name, attributes limited to three; its rank in the scene."""

    def make() -> DataFrame:
        rel = s.dealt if same else s.dealt.where(~_c("predicate").startswith("same "))
        rel = s.resolved(rel, "subject_id", "subject", "object_id", "object").withColumn("attr", R.is_attribute(_c("predicate")))
        p = rel.groupBy("scene_id", "subject_id", "subject", "attr", "predicate").agg(F.transform(F.array_sort(F.collect_list(F.struct("rel_ord", "object"))), lambda x: x["object"]).alias("o"))
        more = F.when(_c("attr") & (F.size("o") > R.ATTRIBUTE_CAP), _cat(" (+", F.size("o") - R.ATTRIBUTE_CAP, " more)")).otherwise("")
        shown = F.when(_c("attr"), F.slice("o", 1, R.ATTRIBUTE_CAP)).otherwise(_c("o"))
        p = p.withColumn("t", _cat(_c("predicate"), " ", F.array_join(shown, ", "), more)).withColumn("n", F.size("o"))
        out = p.groupBy("scene_id", "subject_id", "subject").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("attr", "predicate", "t"))), lambda x: x["t"]), "; ").alias("said"), F.sum(F.when(~_c("attr"), _c("n")).otherwise(0)).alias("spatial"), F.sum("n").alias("total"))
        return out.withColumn("rank", _rank(F.desc("spatial"), F.desc("total"), id_key("subject_id")))

    return s._once(f"statements_{same}", make, dealt=True)


def _groups(s: _Scene) -> DataFrame:
    """Relation components with their members' labels."""
    return s._once("groups", lambda: s.labelled(R.relation_components(s.t["relations"]), ["scene_id", "kind", "component"], "members", s.labels, "object_id", "shown"))


def _relations_by_room(s: _Scene, section: int, groups: bool) -> list[DataFrame]:
    homes = s.t["objects"].select("scene_id", _c("object_id").alias("subject_id"), "room_id")
    st = _statements(s, False).join(homes, ["scene_id", "subject_id"])
    order = s.rooms.select("scene_id", "room_id", "label", _by_degree().alias("a"))
    st = st.join(order, ["scene_id", "room_id"])
    heads, scenes = st.select("scene_id", "a", "label").distinct(), st.select("scene_id").distinct()
    out = [lines(scenes, section, F.lit("")), lines(scenes, section, F.lit("Spatial relations by room:"), 0, 1), lines(heads, section, _cat(_c("label"), ":"), "a", 0), lines(st, section, _cat("  ", _c("subject"), " is ", _c("said"), "."), "a", "rank")]
    if groups:
        g = _groups(s).where("kind <> 'proximity'").join(scenes, "scene_id", "left_semi")
        k = _rank(_c("kind"), id_key(F.get("members", F.lit(0))))
        some = g.select("scene_id").distinct()
        out += [lines(some, section + 1, F.lit("")), lines(some, section + 1, F.lit("  Shared attributes (each line lists items sharing that property):"), 0, 1), lines(g, section + 1, _cat("  Same ", F.expr("substring(kind, 6)"), ": ", _c("shown"), "."), k)]
    return out


def prose(s: _Scene) -> DataFrame:
    return assemble(*_prose_head(s.head, True), lines(s.head, 3, F.lit("")), *_by_floor(s, 4, False), *_relations_by_room(s, 5, True))


# ---- graphs -----------------------------------------------------------------------
def _digest(s: _Scene, section: int) -> list[DataFrame]:
    """Groups, hubs, bottlenecks and routes of the connection graph."""
    t = {k: s.having(s.t[k], "adjacency") for k in ("rooms", "adjacency")}
    rooms, adj = t["rooms"], t["adjacency"]
    deg = G.degrees(rooms, adj).join(s.rooms.select("scene_id", "room_id", "label"), ["scene_id", "room_id"])
    deg = s._once("degrees", lambda: deg)
    groups, comp = s._once("reach", lambda: G.reachability_groups(rooms, adj)), G.room_components(rooms, adj)
    key = F.struct((-_c("degree")).alias("d"), id_key("room_id").alias("k"), "label")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["label"]), ", ")
    members = comp.join(deg, ["scene_id", "room_id"]).join(groups, ["scene_id", "component"]).groupBy("scene_id", "group", "size").agg(listed.alias("m"))
    n = groups.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))
    reach = F.when(_c("n") == 1, "Reachability: every room is reachable from every other (one connected group).").otherwise(_cat("Reachability: the rooms split into ", _c("n"), " separate groups — you cannot walk from one group to another."))
    group = F.when(_c("size") == 1, _cat("Group ", _c("group"), " (1 room): ", _c("m"), " — isolated, no connections.")).otherwise(_cat("Group ", _c("group"), " (", _c("size"), " rooms): ", _c("m")))
    top = G.hubs(rooms, adj).join(deg.select("scene_id", "room_id", "label"), ["scene_id", "room_id"]).groupBy("scene_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(id_key("room_id").alias("k"), _cat(_c("label"), " (", _c("degree"), " connections)").alias("t")))), lambda x: x["t"]), ", ").alias("h"))
    cuts = s._once("bottlenecks", lambda: G.bottlenecks(rooms, adj))
    names = deg.select("scene_id", _c("room_id"), "label")
    pieces = s.labelled(cuts.withColumnRenamed("room_id", "cut"), ["scene_id", "cut", "piece"], "members", names, "room_id", "shown")
    pieces = pieces.groupBy("scene_id", _c("cut").alias("room_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "shown"))), lambda x: F.concat(F.lit("{"), x["shown"], F.lit("}"))), "  |  ").alias("p")).join(deg, ["scene_id", "room_id"])
    uncut = n.join(pieces.select("scene_id").distinct().withColumn("__has", F.lit(True)), "scene_id", "left")
    cut_head = F.when(_c("__has").isNotNull(), "Bottlenecks (removing the room cuts its group apart):").otherwise("Bottlenecks: none — no single room is a sole connector.")
    routes = s._once("routes", lambda: G.shortest_routes(rooms, adj))
    shown = s.labelled(routes, ["scene_id", "src", "dst"], "route", names, "room_id", "shown", " -> ")
    far = _rank(F.desc("distance"), id_key("src"), id_key("dst"))
    return [
        lines(n, section, reach), lines(n, section, F.lit(""), 1), lines(members, section, group, 2, "group"), lines(n, section, F.lit(""), 3), lines(top, section, _cat("Hub rooms (most connections): ", _c("h"), "."), 4),
        lines(uncut, section, cut_head, 5), lines(pieces, section, _cat("  ", _c("label"), " — without it these become mutually unreachable: ", _c("p")), 6, _rank(F.desc("degree"), id_key("room_id"))), lines(n, section, F.lit(""), 7),
        lines(routes.select("scene_id").distinct(), section, F.lit("Distance between rooms (connections to cross; only multi-step pairs):"), 8), lines(shown, section, _cat("  ", _c("shown")), 9, far),
    ]


def _clean_head(s: _Scene, tail: str) -> DataFrame:
    h = s.having(s.head, "adjacency").join(G.connection_count(s.t["rooms"], s.t["adjacency"], clean=True), "scene_id")
    return lines(h, 0, _cat(_c("name"), " — ", _c("n_rooms"), " rooms, ", _c("connections"), f" room connections (doorways or open passages). {tail}"))


def graph_digest(s: _Scene) -> DataFrame:
    h = s.having(s.head, "adjacency")
    return assemble(_clean_head(s, "Connectivity digest (derived from the room connection graph; no metric data)."), lines(h, 1, F.lit("")), *_digest(s, 2))


def drawn(nodes: DataFrame, keys: list[str], suffix: Column | None = None) -> DataFrame:
    """nodes (keys, node, parent, path, label) with row: the tree's branch glyphs, then the label.

    A node's glyphs follow from which of its ancestors, and itself, come last among their
    siblings; rows are in order of path.
    """
    w = Window.partitionBy(*keys, "parent").orderBy(id_key("node").desc())
    nodes = nodes.withColumn("last", F.col("parent").isNotNull() & (F.row_number().over(w) == 1))
    steps = nodes.select(*keys, "node", F.size("path").alias("__d"), F.posexplode("path").alias("pos", "k")).where("pos > 0").select(*keys, "node", "__d", "pos", F.col("k.id").alias("at"))
    steps = steps.join(nodes.select(*keys, F.col("node").alias("at"), "last"), [*keys, "at"])
    glyph = F.when(F.col("pos") == F.col("__d") - 1, F.when(F.col("last"), "`-- ").otherwise("|-- ")).otherwise(F.when(F.col("last"), "    ").otherwise("|   "))
    prefix = steps.groupBy(*keys, "node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", glyph.alias("g")))), lambda x: x["g"]), "").alias("__p"))
    text = F.concat(F.coalesce("__p", F.lit("")), "label", F.lit("") if suffix is None else F.coalesce(suffix, F.lit("")))
    return nodes.join(prefix, [*keys, "node"], "left").withColumn("row", text).drop("__p", "last")


def room_tree(s: _Scene) -> DataFrame:
    rooms, adj = s.having(s.t["rooms"], "adjacency"), s.having(s.t["adjacency"], "adjacency")
    tree, loops = G.spanning_tree(rooms, adj)
    names = s.rooms.select("scene_id", "room_id", "label")
    groups = s._once("reach_by_id", lambda: G.reachability_groups(rooms, adj, by_least_id=True))
    n = groups.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))
    rows = tree.join(names, ["scene_id", "room_id"]).withColumnRenamed("room_id", "node").join(groups, ["scene_id", "component"])
    rows = drawn(rows, ["scene_id", "component"], F.when(F.col("size") == 1, "  (isolated, no connections)"))
    b = F.row_number().over(Window.partitionBy("scene_id", "component").orderBy("path"))
    side = lambda c: names.select("scene_id", F.col("room_id").alias(c), F.col("label").alias(f"l{c}"))
    loops = loops.join(side("a"), ["scene_id", "a"]).join(side("b"), ["scene_id", "b"])
    many = groups.join(n.where("n > 1"), "scene_id")
    h = s.having(s.head, "adjacency")
    tail = "Connectivity tree: rooms drawn as an indented tree; each room is listed under a room it directly connects to (indentation and branch lines show the connection)."
    return assemble(
        _clean_head(s, tail), lines(h, 1, F.lit("")), lines(many, 2, _cat("Group ", _c("group"), " (", _c("size"), " rooms):"), "group", 0), lines(rows, 2, _c("row"), "group", 1, b), lines(groups, 2, F.lit(""), "group", 2),
        lines(loops.select("scene_id").distinct(), 3, F.lit("Additional connections (these close loops, so they are not drawn as branches above):")), lines(loops, 4, _cat("  ", _c("la"), " -- ", _c("lb")), _rank(id_key("a"), id_key("b"))),
    )


# ---- geometry ---------------------------------------------------------------------
def _floors(s: _Scene) -> tuple[DataFrame, DataFrame]:
    """Placed rooms with label, and one row a floor group with its head line where there are several."""
    placed = s.placed
    groups = placed.groupBy("scene_id", "group_ord", "group_floor").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("scene_id")) > 1)
    name = F.when(_c("group_floor").isNotNull(), _cat("Floor ", _c("group_floor"))).otherwise("Unassigned floor")
    return placed, groups.withColumn("title", F.when(_c("many"), _cat(name, " (", _c("n"), " rooms):")))


def _placed_head(s: _Scene, placed: DataFrame, text: Callable[[Column, Column], Column]) -> DataFrame:
    n = placed.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n")).join(s.head.select("scene_id", "name", "room_types"), "scene_id")
    return lines(n, 0, text(_c("name"), _c("n")))


def _metres() -> Column:
    return py_fixed(_c("distance"), 1)


def _named(s: _Scene, pairs: DataFrame) -> DataFrame:
    side = lambda c: s.rooms.select("scene_id", _c("room_id").alias(c), _c("label").alias(f"l{c}"))
    return pairs.join(side("a"), ["scene_id", "a"]).join(side("b"), ["scene_id", "b"])


#: Within a floor's lines, the place of its head, its rooms' contents, its note and, from BLOCKS on, its rooms' blocks; ranks are a level of their own.
HEAD, HELD, NOTE, BLOCKS = range(4)


def _blocks(placed: DataFrame, pairs: DataFrame, order: Column, title: Column, item: Column, section: int = 1) -> list[DataFrame]:
    """A title for each room with pairs, its items by rank. order: of rooms within their group."""
    rooms = placed.withColumn("b", order).select("scene_id", "group_ord", _c("room_id").alias("a"), "label", "b")
    pairs = pairs.join(rooms.select("scene_id", "a", "b"), ["scene_id", "a"]) if "b" not in pairs.columns else pairs.withColumnRenamed("b", "other").join(rooms.select("scene_id", "a", "b"), ["scene_id", "a"])
    with_any = rooms.join(pairs.select("scene_id", "a").distinct(), ["scene_id", "a"], "left_semi")
    place = F.col("b") + BLOCKS
    return [lines(with_any, section, title, "group_ord", place), lines(pairs, section, item, "group_ord", place, "rank")]


def _in_group(*by: Column) -> Column:
    return F.row_number().over(Window.partitionBy("scene_id", "group_ord").orderBy(*by))


def _group_heads(groups: DataFrame, section: int = 1) -> list[DataFrame]:
    return [lines(groups, section, F.lit(""), "group_ord", HEAD, 0), lines(groups, section, _c("title"), "group_ord", HEAD, 1)]


def _walkable(s: _Scene, head: Callable[[Column, Column], Column], item: Column, bearing: str, only: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """Connected rooms of each placed room by distance, in scenes with connections."""
    placed, groups = _floors(s)
    placed, groups = only(placed), only(groups)
    pairs = _named(s, only(M.connected_placements(s.rooms, s.t["adjacency"]))).withColumn("bearing", _c(bearing)).withColumn("m", _metres())
    order = _in_group(F.desc("degree"), id_key("room_id"))
    alone = placed.withColumn("b", order).join(pairs.select("scene_id", _c("a").alias("room_id")).distinct(), ["scene_id", "room_id"], "left_anti")
    lonely = lines(alone, 1, _cat(_c("label"), " — no connected rooms (isolated)."), "group_ord", _c("b") + BLOCKS)
    return [_placed_head(s, placed, head), *_group_heads(groups), *_blocks(placed, pairs, order, _cat(_c("label"), " — connected rooms:"), item), lonely]


def topology_metric(s: _Scene) -> DataFrame:
    head = lambda name, n: _cat(name, " — ", n, " rooms. Room connections (doorways or open passages), with each room placed relative to each of its connected neighbours.")
    return assemble(*_walkable(s, head, _cat("  is ", _c("m"), " m ", _c("bearing"), " of ", _c("lb"), "."), "a_from_b", lambda df: s.having(df, "adjacency")))


def navigation(s: _Scene) -> DataFrame:
    head = lambda mode: lambda name, n: _cat(name, " — ", n, f" rooms. Routes by {mode}.")
    walk = _walkable(s, head("room connections (doorways or open passages)"), _cat("  you can walk to ", _c("lb"), ", ", _c("m"), " m ", _c("bearing"), "."), "b_from_a", lambda df: s.having(df, "adjacency"))
    without = lambda df: df.join(s.t["adjacency"].select("scene_id").distinct(), "scene_id", "left_anti")
    placed, groups = (without(x) for x in _floors(s))
    pairs = s._once("nearest_unlinked", lambda: s.near(without(s.t["rooms"])))
    near = _blocks(placed, pairs, _in_group(id_key("room_id")), _cat(_c("label"), " -- nearest neighbours:"), _cat("  ", _c("lb"), ", ", _c("m"), " m ", _c("b_from_a"), " away."))
    return assemble(*walk, _placed_head(s, placed, head("proximity")), *_group_heads(groups), *near)


def _nearest(s: _Scene, placed: DataFrame, title: Column, section: int) -> list[DataFrame]:
    pairs = s.nearest.join(placed.select("scene_id").distinct(), "scene_id", "left_semi")
    return _blocks(placed, pairs, _in_group(id_key("room_id")), title, _cat("  is ", _c("m"), " m ", _c("a_from_b"), " of ", _c("lb"), "."), section)


def metric_framing(s: _Scene) -> DataFrame:
    placed, groups = _floors(s)
    head = lambda name, n: _cat(name, " -- ", n, f" rooms. Each room's position stated relative to its {M.NEAREST} nearest same-floor neighbours.")
    return assemble(_placed_head(s, placed, head), *_group_heads(groups), *_nearest(s, placed, _cat(_c("label"), " -- nearest neighbours:"), 1))


def metric_relations(s: _Scene) -> DataFrame:
    placed, groups = _floors(s)
    n = placed.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("group_ord").alias("g")).join(s.head.select("scene_id", "name"), "scene_id").join(I.room_type_summary(placed), "scene_id").join(s.t["rooms"].groupBy("scene_id").agg((F.count_distinct("floor") >= 2).alias("f")), "scene_id")
    types = F.when(_c("room_types") != "", _cat(" Room types: ", _c("room_types"), ".")).otherwise("")
    head = lines(n, 0, _cat(_c("name"), " — ", _c("n"), " rooms", F.when(_c("f"), _cat(", across ", _c("g"), " floors")).otherwise(""), ".", types))
    held = lines(placed, 1, _cat(_c("label"), " — contains: ", _c("inventory"), "."), "group_ord", HELD, _in_group(F.desc("n_objects"), id_key("room_id")))
    several = groups.where("n >= 2").join(groups.groupBy("scene_id").agg((F.max("n") - 1 <= M.NEAREST).alias("exhaustive")), "scene_id")
    note = F.when(_c("exhaustive"), "Spatial relations grouped by room (all neighbours, nearest first):").otherwise(f"Spatial relations grouped by room (each room's {M.NEAREST} nearest neighbours, nearest first):")
    return assemble(head, *_group_heads(groups), held, lines(several, 1, F.lit(""), "group_ord", NOTE, 0), lines(several, 1, note, "group_ord", NOTE, 1), *_nearest(s, placed, _cat(_c("label"), ":"), 1))


# ---- object relations -------------------------------------------------------------
def _related(s: _Scene) -> DataFrame:
    n = s.t["relations"].groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("subject_id").alias("subjects"), F.count_distinct("predicate").alias("predicates"))
    return s.head.select("scene_id", "name").join(n, "scene_id")


def relations_flat(s: _Scene) -> DataFrame:
    h = _related(s)
    rows = s.relations.withColumn("k", _rank(id_key("subject_id"), _c("predicate"), id_key("object_id"), _c("rel_ord")))
    head = _cat(_c("name"), " -- ", _c("n"), " object relations, one per line as (subject, relation, object) triples; unordered, every edge stated separately.")
    return assemble(lines(h, 0, head), lines(h, 1, F.lit("")), lines(rows, 2, _cat("(", _c("subject"), ", ", _c("predicate"), ", ", _c("object"), ")"), "k"))


def relations_subject(s: _Scene) -> DataFrame:
    h, st = _related(s), _statements(s, True)
    head = _cat(_c("name"), " -- object relations grouped by object (", _c("subjects"), " objects have outgoing relations).")
    return assemble(lines(h, 0, head), lines(h, 1, F.lit("")), lines(st, 2, _cat(_c("subject"), ": ", _c("said"), "."), "rank"))


def relations_predicate(s: _Scene) -> DataFrame:
    h, buckets = _related(s), R.predicate_buckets(s.t["relations"])
    shown = _pairs_shown(s, "unordered", R.unordered_pairs(s.dealt), ", ", "{", "}").unionByName(_pairs_shown(s, "directed", R.directed_pairs(s.dealt), " -> ", "", ""))
    rows = buckets.join(shown, ["scene_id", "predicate"])
    same = buckets.where(_c("predicate").startswith("same "))
    g = _groups(s).where("kind <> 'proximity'").join(buckets.select("scene_id", _c("predicate").alias("kind"), "bucket"), ["scene_id", "kind"])
    k = F.row_number().over(Window.partitionBy("scene_id", "kind").orderBy(F.desc("size"), id_key(F.get("members", F.lit(0)))))
    head = _cat(_c("name"), " -- object relations grouped by relation type (", _c("predicates"), " relation types).")
    return assemble(lines(h, 0, head), lines(h, 1, F.lit("")), lines(rows, 2, _cat(_c("predicate"), ": ", _c("shown")), "bucket"), lines(same, 2, _cat(_c("predicate"), ":"), "bucket", 0), lines(g, 2, _cat("  {", _c("shown"), "}"), "bucket", k))


def _pairs_shown(s: _Scene, name: str, df: DataFrame, sign: str, a: str, z: str) -> DataFrame:
    key = F.struct(id_key("a").alias("x"), id_key("b").alias("y"), _cat(a, _c("la"), sign, _c("lb"), z).alias("t"))
    make = lambda: s.resolved(df, "a", "la", "b", "lb").groupBy("scene_id", "predicate").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["t"]), "; ").alias("shown"))
    return s._once(f"pairs_{name}", make, dealt=True)


def relations_tree(s: _Scene) -> DataFrame:
    h, rel = _related(s), s.t["relations"]
    forest, extra = R.support_forest(rel)
    paths = R.support_paths(rel, forest)
    # Roots that carry nothing aren't drawn.
    nodes = paths.where((F.size("path") > 1) | ~F.col("leaf")).join(forest.select("scene_id", _c("child").alias("node"), "parent", "predicate"), ["scene_id", "node"], "left")
    nodes = R.resolve(nodes, s.labels, "node", "label").withColumn("root", F.col("path")[0]["id"])
    rows = drawn(nodes, ["scene_id", "root"], F.when(_c("predicate").isNotNull(), _cat(" (", _c("predicate"), ")")))
    roots = rows.select("scene_id", "root").distinct()
    a = roots.withColumn("a", _rank(id_key("root")))
    rows = rows.join(a, ["scene_id", "root"]).withColumn("b", F.row_number().over(Window.partitionBy("scene_id", "root").orderBy("path")))
    bare = h.join(roots.select("scene_id").distinct(), "scene_id", "left_anti")
    links = s.labelled(R.extra_support_links(extra), ["scene_id", "child", "predicate"], "parents", s.labels, "object_id", "shown")
    links = R.resolve(links, s.labels, "child", "label")
    linked = links.select("scene_id").distinct()
    census = R.relation_census(rel)
    names = {"proximity": "proximity (close by / next to)", "directional": "directional (left / right / front / behind)", "attribute": "comparative / shared-attribute (same ... / ... than)", "other": "other"}
    parts = F.concat_ws(", ", *[F.when(_c(k) > 0, _cat(_c(k), f" {v}")) for k, v in names.items()])
    head = _cat(_c("name"), " -- support / containment structure drawn as an indented tree. Each object is listed under the one it sits on or is fixed to, and the parenthesised relation says how it attaches to that object above it -- e.g. 'wall [2] (attached to)' under 'floor [1]' means wall [2] is attached to floor [1].")
    return assemble(
        lines(h, 0, head), lines(h, 1, F.lit("")), lines(bare, 2, F.lit("No support or containment relations to draw in this scene.")), lines(rows, 2, _c("row"), "a", 0, "b"), lines(a, 2, F.lit(""), "a", 1),
        lines(linked, 3, F.lit("Additional support links not drawn (a second base for an object, or one that would close a loop):")), lines(links, 4, _cat("  ", _c("label"), " is also ", _c("predicate"), " ", _c("shown")), _rank(id_key("child"), _c("predicate"))), lines(linked, 5, F.lit("")),
        lines(census, 6, F.when(parts != "", _cat("Relations not shown in this support view: ", parts, "."))),
    )


def _relation_digest(s: _Scene, section: int) -> list[DataFrame]:
    rel, h = s.t["relations"], _related(s)
    forest, _ = R.support_forest(rel)
    chains = R.support_chains(rel)
    hops = chains.select("scene_id", "rank", F.posexplode("chain").alias("p", "child")).join(forest.select("scene_id", "child", "predicate"), ["scene_id", "child"], "left")
    hops = R.resolve(hops, s.labels, "child", "label")
    hop = F.struct((-_c("p")).alias("p"), F.concat(_c("label"), F.when(_c("p") > 0, _cat(" (", _c("predicate"), ") ")).otherwise("")).alias("t"))
    chain = hops.groupBy("scene_id", "rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(hop)), lambda x: x["t"]), "").alias("t"))
    deep = chains.select("scene_id", "max_depth").distinct()
    built = forest.select("scene_id").distinct()
    state = h.join(built.withColumn("built", F.lit(True)), "scene_id", "left").join(deep, "scene_id", "left")
    first = F.when(_c("built").isNull(), "No support or containment relations in this scene.").when(_c("max_depth").isNull(), "Support: every item sits directly on its base (nothing stacked deeper).").otherwise(_cat("Deepest support nesting: ", _c("max_depth"), " levels."))
    top = R.resolve(R.receptacles(rel, forest=forest), s.labels, "object_id", "label")
    top = top.groupBy("scene_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", _cat(_c("label"), " (", _c("n"), " object", _plural(_c("n")), ")").alias("t")))), lambda x: x["t"]), ", ").alias("t"))
    g = _groups(s)
    near = g.where("kind = 'proximity'").withColumn("k", _rank(F.desc("size"), id_key(F.get("members", F.lit(0)))))
    n = near.groupBy("scene_id").agg(F.count(F.lit(1)).alias("k"))
    some = rel.where(R.classify() == "proximity").select("scene_id").distinct().join(n, "scene_id", "left").fillna(0)
    alike, share = g.where("kind <> 'proximity'"), rel.where(_c("predicate").startswith("same ")).select("scene_id").distinct()
    order = _rank(_c("kind"), F.desc("size"), id_key(F.get("members", F.lit(0))))
    names = {"support": "support/containment", "proximity": "proximity", "directional": "directional", "attribute": "comparative/shared-attribute", "other": "other"}
    census = F.concat_ws(", ", *[F.when(_c(k) > 0, _cat(_c(k), f" {v}")) for k, v in names.items()])
    return [
        lines(state, section, first), lines(deep, section, F.lit("Support chains (deepest first):"), 1), lines(chain, section, _cat("  ", _c("t")), 2, "rank"), lines(h, section, F.lit(""), 3),
        lines(top, section, _cat("Main receptacles (carry the most objects): ", _c("t"), "."), 4), lines(top, section, F.lit(""), 5),
        lines(some, section, _cat("Proximity clusters (", _c("k"), " group", _plural(_c("k")), " of objects near each other):"), 6), lines(near.where(_c("k") <= R.TOP_CHAINS), section, _cat("  {", _c("shown"), "}"), 7, "k"), lines(some, section, F.lit(""), 8),
        lines(share, section, F.lit("Shared attributes (each group lists items sharing that property):"), 9), lines(alike, section, _cat("  ", _c("kind"), ": ", _c("shown")), 10, order), lines(share, section, F.lit(""), 11),
        lines(R.relation_census(rel), section, _cat("Relation census: ", census, "."), 12),
    ]


def relations_digest(s: _Scene) -> DataFrame:
    h = _related(s)
    head = _cat(_c("name"), " -- object-relation digest (derived from ", _c("n"), " relations; facts pre-computed, not the raw edge list).")
    return assemble(lines(h, 0, head), lines(h, 1, F.lit("")), *_relation_digest(s, 2))


# ---- records and the synthesis ----------------------------------------------------
def json_mini(s: _Scene) -> DataFrame:
    """The whole record as JSON without white space: rooms and objects by id, numbers to four digits, nulls and empty lists left out."""
    t = s.t
    r4 = lambda c: F.bround(c, 4)
    three = lambda c: F.when(F.col(c).isNotNull(), F.array(*[r4(F.col(c)[k]) for k in "xyz"]))
    full = lambda c: F.when(F.size(c) > 0, F.col(c))
    have = lambda df, **kinds: df.withColumns({k: F.lit(None).cast(v) for k, v in kinds.items() if k not in df.columns})
    xyz = "struct<x:double,y:double,z:double>"
    o = have(t["objects"], position=xyz, size=xyz, affordances="array<string>", material="array<string>", visual_texture="string", tactile_texture="string")
    one = F.struct(_c("object_id").alias("id"), "category", three("position").alias("position"), three("size").alias("size"), full("affordances").alias("affordances"), full("material").alias("material"), "visual_texture", "tactile_texture")
    objects = o.groupBy("scene_id", "room_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(id_key("object_id").alias("k"), "obj_ord", one.alias("o")))), lambda x: x["o"]).alias("objects"))
    rooms = have(t["rooms"], size=xyz, floor_area="double", volume="double").join(objects, ["scene_id", "room_id"], "left")
    place = F.when(_c("x").isNotNull(), F.array(*[r4(F.col(k)) for k in "xyz"]))
    room = F.struct(_c("room_id").alias("id"), "category", "floor", place.alias("position"), three("size").alias("size"), r4(F.col("floor_area")).alias("floor_area"), r4(F.col("volume")).alias("volume"), "objects")
    rooms = rooms.groupBy("scene_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(id_key("room_id").alias("k"), "room_ord", room.alias("r")))), lambda x: x["r"]).alias("rooms"))
    relation = F.struct(_c("subject_id").alias("subject"), "predicate", _c("object_id").alias("object"))
    rel = t["relations"].groupBy("scene_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rel_ord", relation.alias("r")))), lambda x: x["r"]).alias("relations"))
    near = t["adjacency"].groupBy("scene_id", _c("src").alias("room_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nbr_ord", "dst"))), lambda x: x["dst"]).alias("n"))
    lists = s.having(t["rooms"], "adjacency").select("scene_id", "room_id", "room_ord").join(near, ["scene_id", "room_id"], "left")
    entry = F.struct("room_ord", F.struct("room_id", F.coalesce("n", F.array().cast("array<string>")).alias("n")).alias("e"))
    lists = lists.groupBy("scene_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"])).alias("connectivity"))
    out = have(t["scenes"], size=xyz).select("scene_id", "name", three("size").alias("size")).join(lists, "scene_id", "left").join(rooms, "scene_id", "left").join(rel, "scene_id", "left")
    text = F.to_json(F.struct(F.struct("name", "size", "connectivity").alias("building"), F.coalesce("rooms", F.from_json(F.lit("[]"), rooms.schema["rooms"].dataType)).alias("rooms"), "relations"))
    # Of numbers with four digits, these are written with an exponent.
    return out.select("scene_id", F.regexp_replace(text, r"([\[,:]-?)([1-9])\.0E-4(?=[,\]}])", r"$10.000$2").alias("text"))


def json_pretty(s: _Scene) -> DataFrame:
    return json_mini(s).withColumn("text", json_indented(_c("text")))


def synthesis(s: _Scene) -> DataFrame:
    """One document of all that a scene has, each section only where it has what it needs."""
    h = s.head
    joined, related = s.having(h, "adjacency"), s.having(h, "relations")
    placed, groups = _floors(s)
    some = groups.where("n >= 2").select("scene_id").distinct()
    metric = [lines(some, 7, F.lit("")), lines(some, 7, F.lit(f"Salient metric relations (each room's {M.NEAREST} nearest neighbours, nearest first):"), 0, 1), lines(groups.where("n >= 2"), 7, _c("title"), "group_ord", HEAD, 1), *_nearest(s, placed, _cat(_c("label"), ":"), 7)]
    derived = F.lit("Derived object-relation structure (support depth, receptacles, proximity clusters, shared attributes, relation census):")
    return assemble(
        *_prose_head(h, True), lines(joined, 3, F.lit("")), lines(joined, 3, F.lit("Connectivity (derived from the room connection graph; no metric data):"), 1), *_digest(s, 4),
        lines(h, 5, F.lit("")), lines(h, 5, F.lit("Rooms:"), 1), *_by_floor(s, 6, True), *metric, *_relations_by_room(s, 8, False), lines(related, 10, F.lit("")), lines(related, 10, derived, 1), *_relation_digest(s, 11),
    )


RENDERERS: dict[str, Callable[[_Scene], DataFrame]] = {
    f.__name__: f
    for f in (inventory, topology, topology_inventory, narrative, prose, graph_digest, room_tree, topology_metric, navigation, metric_framing, metric_relations, relations_flat, relations_subject, relations_predicate, relations_tree, relations_digest, json_mini, json_pretty, synthesis)
}


def render(tables: Tables, *reps: str) -> DataFrame:
    """(scene_id, representation, text) of the named representations, all by default; one's own can be added to RENDERERS."""
    scene = _Scene(tables)
    out = None
    for rep in reps or RENDERERS:
        part = RENDERERS[rep](scene).select("scene_id", F.lit(rep).alias("representation"), "text")
        out = part if out is None else out.unionByName(part)
    return out


def render_with(tables: Tables, fn: Callable[[dict], str | None], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """(scene_id, text) by a function of one's own: it gets a scene's tables as lists of rows, None for not applicable.

    All tables are one stream of rows, partitioned by scene and ordered by table and place,
    through a table function that holds one scene at a time: one shuffle, no joins. A
    scene's rows are gathered there, so scenes must be of a size that a text can hold.
    """
    names = [n for n in ("rooms", "objects", "adjacency", "relations") if n in tables]
    places = {"rooms": "room_ord", "objects": "obj_ord", "adjacency": "nbr_ord", "relations": "rel_ord"}
    stream = tables["scenes"].select("scene_id", F.lit(-1).alias("t"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("row"))
    for i, n in enumerate(names):
        own = [c for c in (columns or {}).get(n, tables[n].columns) if c != "scene_id"]
        place = F.col(places[n]).cast("long") if places[n] in tables[n].columns else F.lit(0).cast("long")
        stream = stream.unionByName(tables[n].select("scene_id", F.lit(i).alias("t"), place.alias("place"), F.to_json(F.struct(*own)).alias("row")))

    class Render:
        def __init__(self):
            self.scene, self.known, self.rows = None, False, {n: [] for n in names}

        def eval(self, row):
            import json

            self.scene = row["scene_id"]
            if row["t"] < 0:
                self.known = True
            else:
                self.rows[names[row["t"]]].append(json.loads(row["row"]))

        def terminate(self):
            text = fn(self.rows) if self.known else None
            if text is not None:
                yield self.scene, text

    table = F.udtf(Render, returnType="scene_id string, text string")
    return table(stream.asTable().partitionBy("scene_id").orderBy("t", "place"))
