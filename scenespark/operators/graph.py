"""Room graphs, all scenes at once: every key starts with the scene, every loop ends when nothing changes.

rooms: scene_id, room_id, room_ord (and category). adjacency: scene_id, src, dst, one row
a direction or both. Paths are arrays of sort keys, so that the least array is the route
that a breadth-first search with ordered neighbours finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import id_key
from ..functions.pointers import Ancestors
from ..functions.pointers import components as star_components
from ..functions.storage import ranked, sized


def clean_edges(rooms: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(scene_id, src, dst): symmetric, distinct, without self-loops and unknown rooms."""
    both = adjacency.select("scene_id", "src", "dst").unionByName(adjacency.select("scene_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    known = rooms.select("scene_id", "room_id")
    return both.join(known.withColumnRenamed("room_id", "src"), ["scene_id", "src"], "left_semi").join(known.withColumnRenamed("room_id", "dst"), ["scene_id", "dst"], "left_semi")


def components(nodes: DataFrame, edges: DataFrame, keys: list[str], node: str = "node", rank: Column | None = None) -> DataFrame:
    """nodes (keys, node) with component: the node of the least rank reachable, within equal keys.

    edges: keys, src, dst, one direction or both. Nodes of all keys are numbered by rank
    once, so the rounds deal in pairs of longs.
    """
    order = (id_key(node) if rank is None else rank).alias("__r")
    ends = ranked(nodes.select(*keys, node, order).distinct(), "component_nodes", *map(F.col, keys), F.col("__r"), F.col(node), write=sized).drop("__r")
    pairs = edges.select(*keys, "src", "dst").where("src <> dst")
    for column, name in (("src", "a"), ("dst", "b")):
        pairs = pairs.join(ends.select(*keys, F.col(node).alias(column), F.col("rank").alias(name)), [*keys, column])
    found = star_components(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "a", "b", write=sized)
    out = ends.join(found.withColumnRenamed("node", "rank"), "rank", "left").withColumn("component", F.coalesce("component", "rank"))
    named = ends.select(F.col("rank").alias("component"), F.col(node).alias("__name"))
    return out.join(named, "component").select(*keys, node, F.col("__name").alias("component"))


def room_components(rooms: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(scene_id, room_id, component): component is its first-inserted room."""
    edges = clean_edges(rooms, adjacency)
    out = components(rooms.select("scene_id", F.col("room_id").alias("node"), "room_ord"), edges, ["scene_id"], rank=F.col("room_ord"))
    return out.withColumnRenamed("node", "room_id")


def reachability_groups(rooms: DataFrame, adjacency: DataFrame, by_least_id: bool = False) -> DataFrame:
    """Components numbered by size, then by their first-inserted room (or their least id), with the number of members."""
    comp = room_components(rooms, adjacency)
    lead = F.min(id_key("room_id")) if by_least_id else F.min(id_key("component"))
    groups = comp.groupBy("scene_id", "component").agg(F.count(F.lit(1)).cast("int").alias("size"), lead.alias("__lead"))
    return groups.withColumn("group", F.row_number().over(Window.partitionBy("scene_id").orderBy(F.desc("size"), "__lead"))).drop("__lead")


def connectivity_check(rooms: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Scenes of several rooms that fall into more than one component."""
    comp = room_components(rooms, adjacency)
    return comp.groupBy("scene_id").agg(F.count_distinct("component").alias("components")).where("components > 1")


def degrees(rooms: DataFrame, adjacency: DataFrame, clean: bool = True) -> DataFrame:
    """(scene_id, room_id, degree): distinct known neighbours; 0 for rooms without. clean False: of the directed lists as they are."""
    if clean:
        edges = clean_edges(rooms, adjacency)
    else:
        edges = adjacency.join(rooms.select("scene_id", F.col("room_id").alias("dst")), ["scene_id", "dst"], "left_semi")
    n = edges.groupBy("scene_id", F.col("src").alias("room_id")).agg(F.count_distinct("dst").cast("int").alias("degree"))
    return rooms.select("scene_id", "room_id").join(n, ["scene_id", "room_id"], "left").fillna(0, ["degree"])


def ordered_neighbours(rooms: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(scene_id, room_id, neighbours): known neighbours of the lists as they are, by falling degree, then id."""
    deg = degrees(rooms, adjacency, clean=False)
    pairs = adjacency.select("scene_id", F.col("src").alias("room_id"), "dst").distinct()
    pairs = pairs.join(deg.withColumnsRenamed({"room_id": "dst"}), ["scene_id", "dst"])
    key = F.struct((-F.col("degree")).alias("d"), id_key("dst").alias("k"))
    return pairs.groupBy("scene_id", "room_id").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["k"]["id"]).alias("neighbours"))


def connection_count(rooms: DataFrame, adjacency: DataFrame, clean: bool = False) -> DataFrame:
    """(scene_id, connections): half the directed entries, floored; raw lists, or cleaned symmetric ones."""
    edges = clean_edges(rooms, adjacency) if clean else adjacency
    n = edges.groupBy("scene_id").agg(F.floor(F.count(F.lit(1)) / 2).cast("int").alias("connections"))
    return rooms.select("scene_id").distinct().join(n, "scene_id", "left").fillna(0, ["connections"])


def hubs(rooms: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Rooms that share a scene's highest degree, if that is above 0."""
    deg = degrees(rooms, adjacency)
    return deg.withColumn("r", F.rank().over(Window.partitionBy("scene_id").orderBy(F.desc("degree")))).where("r = 1 AND degree > 0").drop("r")


def _doors(rooms: DataFrame, adjacency: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rooms numbered by scene and insertion (scene_id, room_id, room_ord, rank), and their connections (a, b) in both directions, as numbers."""
    nodes = ranked(rooms.select("scene_id", "room_id", "room_ord").distinct(), "numbered_rooms", F.col("scene_id"), F.col("room_ord"), id_key("room_id"), write=sized)
    pairs = clean_edges(rooms, adjacency)
    for column, name in (("src", "a"), ("dst", "b")):
        pairs = pairs.join(nodes.select("scene_id", F.col("room_id").alias(column), F.col("rank").alias(name)), ["scene_id", column])
    return nodes, sized(pairs.select("a", "b"), "numbered_doors")


def _breadth_first(nodes: DataFrame, doors: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, parent): a spanning tree of each root's component, parents of least number; the root's own parent is null. Each node is in one front."""
    front = sized(roots.select("node", F.lit(None).cast("long").alias("parent")), "tree_front")
    before, seen = front.where("false"), front
    while True:
        grown = front.select(F.col("node").alias("a")).join(doors, "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        # What borders a front lies in it, in the one before or in the next.
        grown = grown.join(front.select("node"), "node", "left_anti").join(before.select("node"), "node", "left_anti")
        before, front = front, sized(grown, "tree_front")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def preorder(tree: DataFrame) -> DataFrame:
    """(node, p, size, parent_p, root_p, root_size) of trees (node, parent, root): preorder numbers, contiguous within a tree, sizes of subtrees, and the same of parents and roots.

    A tour goes down to and up from each node. Its steps are one list a tree, whose ranks
    come from pointer doubling: rounds are logarithmic even where trees are paths.
    """
    w = Window.partitionBy("parent").orderBy("node")
    kids = sized(tree.where("parent IS NOT NULL").withColumn("next", F.lead("node").over(w)).withColumn("first", F.min("node").over(Window.partitionBy("parent"))), "tour_children")
    first = kids.select(F.col("parent").alias("node"), "first").distinct()
    down = tree.select("node").join(first, "node", "left").select((F.col("node") * 2).alias("node"), F.coalesce(F.col("first") * 2, F.col("node") * 2 + 1).alias("parent"))
    up = kids.select((F.col("node") * 2 + 1).alias("node"), F.coalesce(F.col("next") * 2, F.col("parent") * 2 + 1).alias("parent"))
    left = Ancestors(down.unionByName(up)).depths
    at = lambda bit, name: left.where(F.col("node") % 2 == bit).select(F.shiftright("node", 1).alias("node"), F.col("depth").alias(name))
    steps = tree.join(at(0, "down"), "node").join(at(1, "up"), "node", "left").fillna(0, ["up"])
    p = ranked(steps.select("node", "parent", "root", ((F.col("down") - F.col("up") + 1) / 2).cast("long").alias("size"), "down"), "preorder", F.col("root"), F.desc("down"), write=sized).withColumnRenamed("rank", "p")
    p = sized(p.drop("down"), "preorder")
    of = lambda column, *names: p.select(F.col("node").alias(column), *[F.col(c).alias(f"{column}_{c}") for c in names])
    return p.join(of("parent", "p"), "parent", "left").join(of("root", "p", "size"), "root").select("node", "p", "size", "parent_p", "root_p", "root_size")


def _reach(tree: DataFrame, ends: DataFrame) -> DataFrame:
    """(p, low, high): the least and greatest number among a subtree's nodes and what their other connections (ends: p, q) lead to, by doubling intervals."""
    own = tree.select("p", F.col("p").alias("q")).unionByName(ends).groupBy("p").agg(F.min("q").alias("low"), F.max("q").alias("high"))
    level, k = sized(own, "reach"), 0
    asked = tree.select("p", "size", F.floor(F.log2("size")).cast("int").alias("k"))
    top, out = asked.agg(F.max("k")).first()[0] or 0, None
    while True:
        here = asked.where(F.col("k") == k)
        far = level.select(F.col("p").alias("end"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        found = here.join(level, "p").withColumn("end", F.col("p") + F.col("size") - (1 << k)).join(far, "end").select("p", F.least("low", "low2").alias("low"), F.greatest("high", "high2").alias("high"))
        out = found if out is None else out.unionByName(found)
        if k == top:
            return sized(out, "reach")
        ahead = level.select((F.col("p") - (1 << k)).alias("p"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        level = sized(level.join(ahead, "p", "left").select("p", F.least("low", F.coalesce("low2", "low")).alias("low"), F.greatest("high", F.coalesce("high2", "high")).alias("high")), "reach")
        k += 1


def bottlenecks(rooms: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(scene_id, room_id, piece, size, members): rooms whose removal adds components, and the pieces beside them, smallest first.

    Blocks come from one spanning tree a component: two tree connections are in one block
    if another connection leads around the room between them, as the least and greatest
    number that a subtree reaches tell (components of that relation, after Tarjan and
    Vishkin). A room in several blocks is a bottleneck, and a piece is the subtrees that
    hang on it in one block, or what lies outside its own: intervals of numbers, so rows
    stay linear in the connections until members are listed.
    """
    nodes, doors = _doors(rooms, adjacency)
    comp = star_components(doors.where("a < b"), "a", "b", write=sized)
    roots = comp.where("node = component").select("node")
    tree = sized(_breadth_first(nodes, doors, roots).join(comp.withColumnRenamed("component", "root"), "node"), "block_tree")
    tree = sized(preorder(tree), "block_preorder")
    at = lambda column, *names: tree.select(F.col("node").alias(column), F.col("p").alias(f"{column}_p"), *[F.col(c).alias(f"{column}_{c}") for c in names])
    others = doors.join(at("a", "parent_p", "size"), "a").join(at("b", "parent_p"), "b").where("NOT (a_parent_p <=> b_p OR b_parent_p <=> a_p)")
    others = sized(others.select(F.col("a_p").alias("p"), F.col("b_p").alias("q"), F.col("a_size").alias("size")), "block_others")
    reach = _reach(tree.select("p", "size"), others.select("p", "q"))
    parent = tree.select(F.col("p").alias("parent_p"), F.col("size").alias("parent_size"), F.col("parent_p").alias("above"))
    around = tree.select("p", "parent_p").join(reach, "p").join(parent, "parent_p").where("above IS NOT NULL AND (low < parent_p OR high >= parent_p + parent_size)")
    same = around.select(F.col("p").alias("a"), F.col("parent_p").alias("b")).unionByName(others.where("q >= p + size").select(F.col("p").alias("a"), F.col("q").alias("b")))
    block = star_components(same, "a", "b", write=sized).withColumnRenamed("node", "p")
    edges = tree.where("parent_p IS NOT NULL").join(block, "p", "left").withColumn("block", F.coalesce("component", "p"))
    edges = sized(edges.select("p", "size", "parent_p", "root_p", "root_size", "block"), "blocks")
    span = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    c = F.col
    below = edges.select(c("parent_p").alias("v"), "block", span(c("p"), c("p") + c("size") - 1).alias("s"))
    outside = edges.select(c("p").alias("v"), "block", F.explode(F.array(span(c("root_p"), c("p") - 1), span(c("p") + c("size"), c("root_p") + c("root_size") - 1))).alias("s"))
    spans = below.unionByName(outside)
    several = spans.groupBy("v").agg(F.min("block").alias("x"), F.max("block").alias("y")).where("x <> y").select("v")
    spans = spans.where("s.lo <= s.hi").join(several, "v", "left_semi")
    named = sized(tree.select("p", c("node").alias("rank")).join(nodes, "rank").join(degrees(rooms, adjacency), ["scene_id", "room_id"]).select("p", "scene_id", "room_id", "room_ord", "degree"), "block_rooms")
    members = spans.select("v", "block", F.explode(F.sequence("s.lo", "s.hi")).alias("p")).join(named, "p")
    member = F.struct((-c("degree")).alias("d"), id_key("room_id").alias("k"))
    lead = F.min_by(id_key("room_id"), F.struct("room_ord", id_key("room_id"))).alias("lead")
    pieces = members.groupBy("scene_id", "v", "block").agg(F.count(F.lit(1)).cast("int").alias("size"), F.transform(F.array_sort(F.collect_list(member)), lambda x: x["k"]["id"]).alias("members"), lead)
    w = Window.partitionBy("v").orderBy("size", "lead")
    out = pieces.withColumn("piece", F.row_number().over(w)).join(named.select(c("p").alias("v"), "room_id"), "v")
    return out.select("scene_id", "room_id", "piece", "size", "members")


def shortest_paths(rooms: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(scene_id, src, dst, distance, path) for all pairs in reach, src = dst included, or those of sources (scene_id, src); path: sort keys, the least of the shortest."""
    start = rooms.select("scene_id", F.col("room_id").alias("src")) if sources is None else sources.select("scene_id", "src")
    start = start.select("scene_id", "src", F.col("src").alias("dst"), F.lit(0).alias("distance"), F.array(id_key("src")).alias("path"))
    seen = front = sized(start, "paths")
    before, pair = front.where("false"), ["scene_id", "src", "dst"]
    step = 0
    hops = edges.select("scene_id", F.col("src").alias("dst"), F.col("dst").alias("to"))
    while True:
        step += 1
        grown = front.join(hops, ["scene_id", "dst"]).select("scene_id", "src", F.col("to").alias("dst"), F.concat("path", F.array(id_key("to"))).alias("path"))
        grown = grown.groupBy(*pair).agg(F.min("path").alias("path")).withColumn("distance", F.lit(step)).select(*start.columns)
        # What borders a front lies in it, in the one before or in the next.
        grown = grown.join(front.select(*pair), pair, "left_anti").join(before.select(*pair), pair, "left_anti")
        before, front = front, sized(grown, "paths")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def shortest_routes(rooms: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(scene_id, src, dst, distance, route): pairs two or more connections apart, each once, src before dst by id."""
    paths = shortest_paths(rooms, sized(clean_edges(rooms, adjacency), "route_edges"))
    out = paths.where((F.col("distance") >= 2) & (id_key("src") < id_key("dst")))
    return out.select("scene_id", "src", "dst", "distance", F.transform("path", lambda k: k["id"]).alias("route"))


def _peeled(nodes: DataFrame, doors: DataFrame) -> DataFrame:
    """The last one or two nodes of trees (nodes: node, root; doors: a, b, both directions) whose leaves go round by round."""
    left = sized(nodes.select("node", "root"), "peeled")
    doors = sized(doors.join(left.select(F.col("node").alias("a")), "a", "left_semi"), "peeled_doors")
    out = None
    while True:
        small = left.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n <= 2").select("root")
        done = sized(left.join(small, "root", "left_semi"), "peeled_done")
        out = done if out is None else out.unionByName(done)
        left = left.join(small, "root", "left_anti")
        inner = doors.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
        left = sized(left.join(inner, "node", "left_semi"), "peeled")
        if left.isEmpty():
            return out
        one = left.select("node")
        doors = sized(doors.join(one.withColumnRenamed("node", "a"), "a", "left_semi").join(one.withColumnRenamed("node", "b"), "b", "left_semi"), "peeled_doors")


def graph_center(rooms: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(scene_id, component, center): least eccentricity, then highest degree, then id; also where there are cycles.

    Of a component that is a tree, leaves are peeled until one or two rooms are left. Only
    components with a cycle need their rooms' eccentricities, and so all their distances.
    """
    nodes, doors = _doors(rooms, adjacency)
    comp = star_components(doors.where("a < b"), "a", "b", write=sized)
    nodes = sized(nodes.join(comp.withColumnRenamed("node", "rank"), "rank", "left").select(F.col("rank").alias("node"), F.coalesce("component", "rank").alias("root"), "scene_id", "room_id"), "center_rooms")
    ends = nodes.join(doors.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("d")), "node", "left").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("d"), F.lit(0)).alias("ends"))
    cyclic_roots = sized(ends.where("ends <> 2 * (n - 1)").select("root"), "center_cyclic")
    ring = nodes.join(cyclic_roots, "root", "left_semi")
    best = _peeled(nodes.join(cyclic_roots, "root", "left_anti"), doors).select("node", F.lit(0).alias("ecc"))
    if not cyclic_roots.isEmpty():
        inside = clean_edges(rooms, adjacency).join(ring.select("scene_id", F.col("room_id").alias("src")), ["scene_id", "src"], "left_semi")
        paths = shortest_paths(rooms, sized(inside, "center_edges"), ring.select("scene_id", F.col("room_id").alias("src")))
        ecc = paths.groupBy("scene_id", F.col("src").alias("room_id")).agg(F.max("distance").alias("ecc"))
        best = best.unionByName(ring.join(ecc, ["scene_id", "room_id"]).select("node", "ecc"))
    rows = nodes.join(best, "node").join(degrees(rooms, adjacency), ["scene_id", "room_id"])
    chosen = rows.groupBy("root").agg(F.min(F.struct("ecc", (-F.col("degree")).alias("d"), id_key("room_id").alias("k"), "scene_id")).alias("b"))
    first = nodes.select(F.col("node").alias("root"), F.col("room_id").alias("component"))
    return chosen.join(first, "root").select("b.scene_id", "component", F.col("b.k.id").alias("center"))


def spanning_tree(rooms: DataFrame, adjacency: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees from each component's centre, (scene_id, component, room_id, parent, depth, path), and the edges that would close loops, (scene_id, a, b)."""
    edges = sized(clean_edges(rooms, adjacency), "tree_edges")
    centre = sized(graph_center(rooms, adjacency).select("scene_id", "component", F.col("center").alias("src")), "tree_centres")
    paths = shortest_paths(rooms, edges, centre)
    tree = paths.join(centre, ["scene_id", "src"])
    parent = F.when(F.col("distance") > 0, F.element_at("path", -2)["id"])
    tree = sized(tree.select("scene_id", "component", F.col("dst").alias("room_id"), parent.alias("parent"), F.col("distance").alias("depth"), "path"), "tree")
    pairs = edges.where(id_key("src") < id_key("dst")).select("scene_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    drawn = tree.where("parent IS NOT NULL")
    used = drawn.select("scene_id", F.col("room_id").alias("a"), F.col("parent").alias("b")).unionByName(drawn.select("scene_id", F.col("parent").alias("a"), F.col("room_id").alias("b")))
    return tree, pairs.join(used, ["scene_id", "a", "b"], "left_anti")
