"""Pointer doubling, components, grids and quantiles against plain versions, on shapes where rounds or groups would grow."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenespark.functions import pointers
from scenespark.functions.quantiles import quantiles
from scenespark.operators import geometry as M
from scenespark.operators import graph as G
from scenespark.operators import relations as R


@pytest.fixture
def rounds(monkeypatch):
    """Names of the tables that loops write."""
    names = []
    for module in (pointers, R, G, M):
        real = module.cut
        monkeypatch.setattr(module, "cut", lambda df, name, real=real: names.append(name) or real(df, name))
    return names


def relation(pairs, scene="s"):
    return [(scene, i, str(a), "on", str(b)) for i, (a, b) in enumerate(pairs)]


REL = "scene_id string, rel_ord int, subject_id string, predicate string, object_id string"


def test_a_chain_of_ten_thousand_takes_log_rounds(spark, rounds):
    n = 10_000
    chain = relation([(i, i + 1) for i in range(n)])
    df = spark.createDataFrame(chain + relation([(0, 1), (1, 2), (2, 0), (3, 2)], "loop"), REL)
    forest, extra = R.support_forest(df)
    assert forest.where("scene_id = 's'").count() == n and extra.where("scene_id = 'loop'").count() == 1
    chains = {r["scene_id"]: r for r in R.support_chains(df, forest=forest).collect()}
    assert chains["s"]["size"] == n + 1 and chains["s"]["max_depth"] == n and chains["s"]["chain"] == [str(i) for i in range(n, -1, -1)]
    assert chains["loop"]["chain"] == ["0", "2", "3"] or chains["loop"]["size"] >= 3
    assert rounds.count("walks") <= 18 and rounds.count("ancestors") <= 17


def test_walks_and_ancestors_equal_plain_ones(spark):
    rng = random.Random(1)
    to = {i: rng.randint(0, 79) for i in range(80) if rng.random() < 0.9}
    got = {r["node"]: r["least"] for r in pointers.cyclic(spark.createDataFrame(list(to.items()), "node long, to long")).collect()}
    want = {}
    for x in to:
        walk, at = [], x
        while at in to and at not in walk:
            walk.append(at)
            at = to[at]
        if at in walk:
            want[x] = min(walk)
    assert got == want
    parent = {i: rng.randint(0, i - 1) for i in range(1, 90) if rng.random() < 0.9}
    a = pointers.Ancestors(spark.createDataFrame(list(parent.items()), "node long, parent long"))
    lines = {}
    for r in a.lines(spark.createDataFrame([(i,) for i in range(0, 90, 7)], "node long")).collect():
        lines.setdefault(r["node"], []).append((r["up"], r["at"]))
    depths = {r["node"]: r["depth"] for r in a.depths.collect()}
    for i in range(0, 90, 7):
        line = [i]
        while line[-1] in parent:
            line.append(parent[line[-1]])
        assert sorted(lines[i]) == list(enumerate(line)) and depths.get(i, 0) == len(line) - 1
    none = pointers.Ancestors(spark.createDataFrame([], "node long, parent long"))
    assert none.depths.count() == 0 and pointers.cyclic(spark.createDataFrame([], "node long, to long")).count() == 0


def test_chains_without_objects_or_with_ties(spark):
    rows = relation([(1, 2), (2, 3), (4, 3), (5, 4), (9, 9)]) + relation([(1, 2)], "flat") + [("odd", 0, "b", "on", "a"), ("odd", 1, "10", "on", "b"), ("odd", 2, "9", "on", "b"), (None, 0, "1", "on", "2")]
    got = {(r["scene_id"], r["rank"]): (r["chain"], r["max_depth"]) for r in R.support_chains(spark.createDataFrame(rows, REL)).collect()}
    assert got == {("s", 1): (["3", "2", "1"], 2), ("s", 2): (["3", "4", "5"], 2), ("odd", 1): (["a", "b", "9"], 2), ("odd", 2): (["a", "b", "10"], 2)}
    assert R.support_chains(spark.createDataFrame([], REL)).count() == 0


def test_long_paths_are_components_in_log_rounds(spark, rounds):
    n = 4000
    rooms = spark.createDataFrame([("p", str(i), n - i) for i in range(n)] + [("q", "7", 0), ("q", "8", 1)], "scene_id string, room_id string, room_ord int")
    doors = spark.createDataFrame([("p", str(i), str(i + 1)) for i in range(n - 1) if i != 2000] + [("p", "5", "unknown"), ("q", "8", "8")], "scene_id string, src string, dst string")
    got = {(r["scene_id"], r["room_id"]): r["component"] for r in G.room_components(rooms, doors).collect()}
    assert got == {("p", str(i)): "2000" if i <= 2000 else str(n - 1) for i in range(n)} | {("q", "7"): "7", ("q", "8"): "8"}
    assert rounds.count("cc") < 30


def placed(points, scene="s"):
    return [(scene, str(i), i, None, float(x), 0.0, float(z)) for i, (x, z) in enumerate(points)]


ROOMS = "scene_id string, room_id string, room_ord int, floor string, x double, y double, z double"


def nearest(points, k=4):
    p = np.array(points, float)
    out = {}
    for i in range(len(p)):
        d = np.floor(np.hypot(p[i, 0] - p[:, 0], p[i, 1] - p[:, 1]) * 1e9 + 0.5) / 1e9
        order = sorted((j for j in range(len(p)) if j != i), key=lambda j: (d[j], j))[:k]
        out[str(i)] = [str(j) for j in order]
    return out


def test_neighbours_on_a_grid_equal_brute_force(spark):
    """Ties on cell borders, a crowd with outliers, a third of the rooms on one spot, a line, and small groups."""
    rng = random.Random(6)
    shapes = {
        "lattice": [(i % 16, i // 16) for i in range(256)],
        "crowd": [(rng.gauss(0, 1e-2), rng.gauss(0, 1e-2)) for _ in range(200)] + [(rng.uniform(-1000, 1000), rng.uniform(-1000, 1000)) for _ in range(30)],
        "spot": [(1.5, 2.5)] * 80 + [(rng.uniform(0, 3), rng.uniform(0, 3)) for _ in range(160)],
        "line": [(i * i / 7, 0.0) for i in range(150)],
        "few": [(0, 0), (1, 0), (5, 5)],
        "one": [(4, 4)],
        "same": [(2, 2)] * 50,
    }
    rooms = spark.createDataFrame([r for s, ps in shapes.items() for r in placed(ps, s)] + [("none", "1", 0, None, None, None, None)], ROOMS)
    got = {}
    for r in M.knn_rooms(rooms, digits=9).collect():
        got.setdefault((r["scene_id"], r["a"]), {})[r["rank"]] = r["b"]
    want = {(s, a): bs for s, ps in shapes.items() for a, bs in nearest(ps).items() if bs}
    assert {x: [ranks[i] for i in sorted(ranks)] for x, ranks in got.items()} == want


def test_a_floor_of_fifty_thousand_rooms(spark):
    rng = random.Random(8)
    points = [(rng.random() * 100, rng.random() * 100) if i % 3 else (rng.gauss(50, 0.1), rng.gauss(50, 0.1)) for i in range(50_000)]
    out = M.knn_rooms(spark.createDataFrame(placed(points), ROOMS), digits=9).where("CAST(a AS INT) % 500 = 0").collect()
    got = {}
    for r in out:
        got.setdefault(int(r["a"]), {})[r["rank"]] = int(r["b"])
    p = np.array(points)
    assert len(got) == 100
    for i, ranks in got.items():
        d = np.floor(np.hypot(p[i, 0] - p[:, 0], p[i, 1] - p[:, 1]) * 1e9 + 0.5) / 1e9
        d[i] = math.inf
        assert [ranks[j] for j in (1, 2, 3, 4)] == np.lexsort((np.arange(len(p)), d))[:4].tolist()


@pytest.mark.parametrize("buckets", [24])
def test_quantiles_are_exact(spark, buckets):
    rng = random.Random(buckets)
    groups = {"even": [float(i) for i in range(100)], "one": [3.5], "two": [1.0, 2.0], "ties": [5.0] * 40 + [6.0] * 3, "wide": [rng.uniform(0, 1) ** 30 * 1e12 for _ in range(300)], "minus": [-1e-300, 0.0, -5.0, 1e300], "some": [rng.gauss(0, 1) for _ in range(333)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("null", None)]
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r["g"]: r["q"] for r in quantiles(df, ["g"], "x", ps, buckets).collect()}
    want = {r["g"]: r["q"] for r in df.where("x IS NOT NULL").groupBy("g").agg(F.percentile("x", ps).alias("q")).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[g], want[g], rtol=1e-12, atol=0) for g in want)
