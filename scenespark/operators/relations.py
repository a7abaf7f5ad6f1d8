"""Relations between a scene's objects. relations: scene_id, rel_ord, subject_id, predicate, object_id; a multigraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import id_key
from ..functions.pointers import Ancestors, cyclic
from ..functions.storage import ranked, sized
from .graph import components

# Predicates by class.
SUPPORT = ["on", "supported by", "standing on", "lying on", "sitting on", "hanging on", "standing in", "lying in", "hanging in", "inside", "build in", "cover", "leaning against", "part of", "belonging to", "attached to"]
PROXIMITY = ["close by", "next to", "near", "beside", "arranged with"]
DIRECTIONAL = ["left", "right", "front", "behind", "above", "below"]
CLASSES = ["support", "proximity", "directional", "other", "attribute"]

TOP_CHAINS, TOP_RECEPTACLES, ATTRIBUTE_CAP = 8, 5, 3


def is_attribute(p: Column) -> Column:
    return p.startswith("same ") | p.endswith(" than")


def classify(predicate: str | Column = "predicate") -> Column:
    p = F.col(predicate) if isinstance(predicate, str) else predicate
    return F.when(is_attribute(p), "attribute").when(p.isin(SUPPORT), "support").when(p.isin(PROXIMITY), "proximity").when(p.isin(DIRECTIONAL), "directional").otherwise("other")


def labels(objects: DataFrame) -> DataFrame:
    """(scene_id, object_id, label): category and short id, or object where there is no category."""
    shown = F.coalesce(F.nullif("short_id", F.lit("")), F.col("object_id"))
    return objects.select("scene_id", "object_id", F.concat(F.coalesce(F.nullif("category", F.lit("")), F.lit("object")), F.lit(" ["), shown, F.lit("]")).alias("label"))


def resolve(df: DataFrame, names: DataFrame, column: str, out: str) -> DataFrame:
    """df with the label of an id column; an id that no object has is shown as object."""
    one = names.select("scene_id", F.col("object_id").alias(column), F.col("label").alias(out))
    return df.join(one, ["scene_id", column], "left").withColumn(out, F.coalesce(out, F.concat(F.lit("object ["), F.col(column), F.lit("]"))))


def support_edges(relations: DataFrame) -> DataFrame:
    """(scene_id, child, parent, predicate, parent_rank): distinct support edges without loops, the least predicate of each, parents ranked by id."""
    rows = relations.where((classify() == "support") & (F.col("subject_id") != F.col("object_id")))
    rows = rows.groupBy("scene_id", F.col("subject_id").alias("child"), F.col("object_id").alias("parent")).agg(F.min("predicate").alias("predicate"))
    return rows.withColumn("parent_rank", F.row_number().over(Window.partitionBy("scene_id", "child").orderBy(id_key("parent"))))


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ends of edges (scene_id, child, parent) numbered by scene and id, (scene_id, object_id, rank), and the edges with node and to."""
    ends = edges.select("scene_id", F.col("child").alias("object_id")).unionByName(edges.select("scene_id", F.col("parent").alias("object_id"))).distinct()
    nodes = ranked(ends, "objects", F.col("scene_id"), id_key("object_id"), write=sized)
    for column, name in (("child", "node"), ("parent", "to")):
        edges = edges.join(nodes.select("scene_id", F.col("object_id").alias(column), F.col("rank").alias(name)), ["scene_id", column])
    return nodes, edges


def support_forest(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The forest (scene_id, child, parent, predicate) and the extra links, same columns.

    A child hangs on its parent of least id. A child's edge is cut where its walk upwards
    runs into a cycle and no node on the walk has a lesser id; that breaks each cycle once.
    Walks are followed by pointer doubling, in as many rounds as the logarithm of the longest.
    """
    edges = sized(support_edges(relations), "support_edges")
    chosen = sized(_numbered(edges.where("parent_rank = 1"))[1].select("scene_id", "child", "parent", "predicate", "node", "to"), "support_chosen")
    cuts = cyclic(chosen).where("node = least").select("node")
    shown = ["scene_id", "child", "parent", "predicate"]
    forest = chosen.join(cuts, "node", "left_anti").select(*shown)
    extra = edges.where("parent_rank > 1").select(*shown).unionByName(chosen.join(cuts, "node", "left_semi").select(*shown))
    return sized(forest, "forest"), extra


def forest_roots(relations: DataFrame, forest: DataFrame) -> DataFrame:
    """(scene_id, object_id): ends of support edges that hang on nothing."""
    edges = support_edges(relations)
    nodes = edges.select("scene_id", F.col("child").alias("object_id")).unionByName(edges.select("scene_id", F.col("parent").alias("object_id"))).distinct()
    return nodes.join(forest.select("scene_id", F.col("child").alias("object_id")), ["scene_id", "object_id"], "left_anti")


def support_paths(relations: DataFrame, forest: DataFrame) -> DataFrame:
    """(scene_id, node, path, leaf): the path of sort keys from its root to every node of the forest."""
    level = sized(forest_roots(relations, forest).select("scene_id", F.col("object_id").alias("node"), F.array(id_key("object_id")).alias("path")), "chains")
    out = level
    down = forest.select("scene_id", F.col("parent").alias("node"), F.col("child").alias("next"))
    while True:
        level = level.join(down, ["scene_id", "node"]).select("scene_id", F.col("next").alias("node"), F.concat("path", F.array(id_key("next"))).alias("path"))
        level = sized(level, "chains")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    inner = forest.select("scene_id", F.col("parent").alias("node")).distinct().withColumn("__inner", F.lit(True))
    return out.join(inner, ["scene_id", "node"], "left").withColumn("leaf", F.col("__inner").isNull()).drop("__inner")


def support_chains(relations: DataFrame, top: int | None = TOP_CHAINS, forest: DataFrame | None = None) -> DataFrame:
    """(scene_id, rank, size, chain, max_depth): root-to-leaf chains of three or more, longest first, then by leaf; max_depth of all paths.

    Depths come from pointer doubling; only the lines of the leaves that are shown are laid out. An
    object that nothing holds and that holds nothing is a chain of itself, which counts in max_depth.
    """
    forest = support_forest(relations)[0] if forest is None else forest
    lone = forest_roots(relations, forest).select("scene_id").distinct()
    nodes, edges = _numbered(forest)
    nodes, edges = sized(nodes, "chain_nodes"), sized(edges.select("node", F.col("to").alias("parent")), "chain_edges")
    ancestors = Ancestors(edges)
    leaves = ancestors.depths.join(edges.select(F.col("parent").alias("node")).distinct(), "node", "left_anti").join(nodes.withColumnRenamed("rank", "node"), "node")
    depth = lone.join(leaves.groupBy("scene_id").agg(F.max("depth").cast("int").alias("max_depth")), "scene_id", "left").fillna(0, ["max_depth"])
    w = Window.partitionBy("scene_id").orderBy(F.desc("depth"), "node")
    shown = leaves.where("depth >= 2").select("scene_id", "node", F.row_number().over(w).alias("rank"), (F.col("depth") + 1).cast("int").alias("size"))
    shown = sized(shown if top is None else shown.where(F.col("rank") <= top), "chains")
    lines = ancestors.lines(shown).join(nodes.select(F.col("rank").alias("at"), "object_id"), "at")
    chain = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("up"), "object_id"))), lambda x: x["object_id"])
    return shown.join(lines.groupBy("node").agg(chain.alias("chain")), "node").join(depth, "scene_id").select("scene_id", "rank", "size", "chain", "max_depth")


def receptacles(relations: DataFrame, top: int | None = TOP_RECEPTACLES, forest: DataFrame | None = None) -> DataFrame:
    """(scene_id, rank, object_id, n): what carries most, then by id."""
    forest = support_forest(relations)[0] if forest is None else forest
    n = forest.groupBy("scene_id", F.col("parent").alias("object_id")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    n = n.withColumn("rank", F.row_number().over(Window.partitionBy("scene_id").orderBy(F.desc("n"), id_key("object_id"))))
    return n if top is None else n.where(F.col("rank") <= top)


def extra_support_links(extra: DataFrame) -> DataFrame:
    """(scene_id, child, predicate, parents): links beside the forest, parents by id."""
    return extra.groupBy("scene_id", "child", "predicate").agg(F.transform(F.array_sort(F.collect_list(id_key("parent"))), lambda k: k["id"]).alias("parents"))


def relation_components(relations: DataFrame) -> DataFrame:
    """(scene_id, kind, component, size, members): groups of two or more by `same …` predicate, and of proximity (kind proximity); members by id.

    Pairs are made unordered and distinct first, so that a clique's edges are as few as they can be.
    """
    kind = F.when(F.col("predicate").startswith("same "), F.col("predicate")).when(classify() == "proximity", "proximity")
    pairs = relations.withColumn("kind", kind).where("kind IS NOT NULL")
    pairs = pairs.select("scene_id", "kind", F.least("subject_id", "object_id").alias("a"), F.greatest("subject_id", "object_id").alias("b")).distinct()
    edges = sized(pairs.select("scene_id", "kind", F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select("scene_id", "kind", F.col("b").alias("src"), F.col("a").alias("dst"))), "relation_edges")
    nodes = edges.select("scene_id", "kind", F.col("src").alias("node"))
    comp = components(nodes, edges, ["scene_id", "kind"])
    out = comp.groupBy("scene_id", "kind", "component").agg(F.count(F.lit(1)).cast("int").alias("size"), F.transform(F.array_sort(F.collect_list(id_key("node"))), lambda k: k["id"]).alias("members"))
    return out.where("size >= 2")


def relation_census(relations: DataFrame) -> DataFrame:
    """(scene_id, one count a class, total)."""
    return relations.groupBy("scene_id").agg(*[F.count_if(classify() == c).cast("int").alias(c) for c in CLASSES], F.count(F.lit(1)).cast("int").alias("total"))


def unordered_pairs(relations: DataFrame) -> DataFrame:
    """(scene_id, predicate, a, b): proximity edges, each pair once, the lesser id first."""
    a, b = F.least(id_key("subject_id"), id_key("object_id")), F.greatest(id_key("subject_id"), id_key("object_id"))
    return relations.where(classify() == "proximity").select("scene_id", "predicate", a["id"].alias("a"), b["id"].alias("b")).distinct()


def directed_pairs(relations: DataFrame) -> DataFrame:
    """(scene_id, predicate, a, b): distinct edges of all other predicates but `same …`."""
    rows = relations.where((classify() != "proximity") & ~F.col("predicate").startswith("same "))
    return rows.select("scene_id", "predicate", F.col("subject_id").alias("a"), F.col("object_id").alias("b")).distinct()


def predicate_buckets(relations: DataFrame) -> DataFrame:
    """(scene_id, bucket, predicate, class, n): predicates by class, falling count of edges, name."""
    rank = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("class"))
    out = relations.groupBy("scene_id", "predicate").agg(F.count(F.lit(1)).cast("int").alias("n")).withColumn("class", classify())
    return out.withColumn("bucket", F.row_number().over(Window.partitionBy("scene_id").orderBy(rank, F.desc("n"), "predicate")))


def subject_predicates(relations: DataFrame) -> DataFrame:
    """(scene_id, subject_id, predicate, attribute, targets, n): targets in input order."""
    out = relations.groupBy("scene_id", "subject_id", "predicate").agg(F.transform(F.array_sort(F.collect_list(F.struct("rel_ord", "object_id"))), lambda x: x["object_id"]).alias("targets"))
    return out.withColumns({"attribute": is_attribute(F.col("predicate")), "n": F.size("targets")})


def subject_groups(relations: DataFrame) -> DataFrame:
    """(scene_id, rank, subject_id, spatial_degree, degree): subjects by spatial degree, then degree, then id."""
    out = relations.groupBy("scene_id", "subject_id").agg(F.count_if(~is_attribute(F.col("predicate"))).cast("int").alias("spatial_degree"), F.count(F.lit(1)).cast("int").alias("degree"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("scene_id").orderBy(F.desc("spatial_degree"), F.desc("degree"), id_key("subject_id"))))


def flat_triples(relations: DataFrame) -> DataFrame:
    """(scene_id, line, subject_id, predicate, object_id): all triples, repeats kept, by subject, predicate, object and input order."""
    w = Window.partitionBy("scene_id").orderBy(id_key("subject_id"), "predicate", id_key("object_id"), "rel_ord")
    return relations.select("scene_id", F.row_number().over(w).alias("line"), "subject_id", "predicate", "object_id")
