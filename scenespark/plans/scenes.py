"""Queries over scenes: inventories, geometry, graphs, relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import sized
from ..operators import geometry as M
from ..operators import graph as G
from ..operators import inventory as I
from ..operators import relations as R
from .adapters import ctes, shape
from .common import DIGITS, final, r9


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    """Adapters, written once: loops read them again and again, and so do the adapters after them."""
    made: dict[str, DataFrame] = {}
    for n in names:
        made[n] = sized(shape(spark, d, n, made), n)
    return [made[n] for n in names]


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


_RA, _RO, _REL = ("rooms", "adjacency"), ("rooms", "objects"), ("relations",)

QUERIES = {
    "object_inventory": lambda s, d: I.object_inventory(*_t(s, d, *_RO)),
    "room_type_summary": lambda s, d: I.room_type_summary(*_t(s, d, "rooms")),
    "scene_totals": lambda s, d: I.scene_totals(*_t(s, d, "rooms", "objects", "adjacency")).drop("single"),
    "capabilities": lambda s, d: M.capabilities(*_t(s, d, "rooms", "adjacency", "relations")),
    "floor_plane": lambda s, d: final(M.floor_plane(M.floor_groups(*_t(s, d, "rooms")), DIGITS), "scene_id", "room_id", "group_ord", "up", "u", "v"),
    "knn_rooms": lambda s, d: final(M.knn_rooms(*_t(s, d, "rooms"), digits=DIGITS)),
    "connected_placements": lambda s, d: final(M.connected_placements(*_t(s, d, *_RA), digits=DIGITS)),
    "isolated_rooms": lambda s, d: M.isolated_rooms(*_t(s, d, *_RA)),
    "exhaustive_flag": lambda s, d: M.exhaustive_flag(*_t(s, d, "rooms")),
    "components": lambda s, d: G.room_components(*_t(s, d, *_RA)),
    "connectivity_check": lambda s, d: G.connectivity_check(*_t(s, d, *_RA)),
    "reachability_groups": lambda s, d: G.reachability_groups(*_t(s, d, *_RA)),
    "degrees": lambda s, d: G.degrees(*_t(s, d, *_RA)),
    "ordered_neighbours": lambda s, d: _joined(G.ordered_neighbours(*_t(s, d, *_RA)), "neighbours"),
    "connection_count": lambda s, d: G.connection_count(*_t(s, d, *_RA)),
    "hubs": lambda s, d: G.hubs(*_t(s, d, *_RA)),
    "bottlenecks": lambda s, d: _joined(G.bottlenecks(*_t(s, d, *_RA)), "members"),
    "shortest_routes": lambda s, d: _joined(G.shortest_routes(*_t(s, d, *_RA)), "route"),
    "graph_center": lambda s, d: G.graph_center(*_t(s, d, *_RA)),
    "spanning_tree": lambda s, d: G.spanning_tree(*_t(s, d, *_RA))[0].drop("path"),
    "loop_edges": lambda s, d: G.spanning_tree(*_t(s, d, *_RA))[1],
    "relation_census": lambda s, d: R.relation_census(*_t(s, d, *_REL)),
    "support_forest": lambda s, d: R.support_forest(*_t(s, d, *_REL))[0],
    "extra_support_links": lambda s, d: _joined(R.extra_support_links(R.support_forest(*_t(s, d, *_REL))[1]), "parents"),
    "support_chains": lambda s, d: _joined(R.support_chains(*_t(s, d, *_REL)), "chain"),
    "receptacles": lambda s, d: R.receptacles(*_t(s, d, *_REL)),
    "relation_components": lambda s, d: _joined(R.relation_components(*_t(s, d, *_REL)), "members"),
    "unordered_pairs": lambda s, d: R.unordered_pairs(*_t(s, d, *_REL)),
    "directed_pairs": lambda s, d: R.directed_pairs(*_t(s, d, *_REL)),
    "predicate_buckets": lambda s, d: R.predicate_buckets(*_t(s, d, *_REL)),
    "subject_groups": lambda s, d: R.subject_groups(*_t(s, d, *_REL)),
    "subject_predicates": lambda s, d: _joined(R.subject_predicates(*_t(s, d, *_REL)), "targets"),
    "flat_triples": lambda s, d: R.flat_triples(*_t(s, d, *_REL)),
}

_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)
_CLASS = f"CASE WHEN predicate LIKE 'same %' OR predicate LIKE '% than' THEN 'attribute' WHEN predicate IN ({_LIST(R.SUPPORT)}) THEN 'support' WHEN predicate IN ({_LIST(R.PROXIMITY)}) THEN 'proximity' WHEN predicate IN ({_LIST(R.DIRECTIONAL)}) THEN 'directional' ELSE 'other' END"
_N = "CAST({0} AS BIGINT)"
_EDGES = "edges AS (SELECT DISTINCT scene_id, src, dst FROM adjacency WHERE src <> dst)"
_COMP = f"""{_EDGES},
reach AS (WITH RECURSIVE r(scene_id, room_id, pos) AS (SELECT scene_id, room_id, room_id FROM rooms UNION SELECT r.scene_id, r.room_id, e.dst FROM r JOIN edges e ON r.scene_id = e.scene_id AND r.pos = e.src) SELECT * FROM r),
comp AS (SELECT t.scene_id, t.room_id, arg_min(m.room_id, m.room_ord) AS component FROM reach t JOIN rooms m ON m.scene_id = t.scene_id AND m.room_id = t.pos GROUP BY t.scene_id, t.room_id)"""
_DEG = "deg AS (SELECT r.scene_id, r.room_id, CAST(count(DISTINCT e.dst) AS INT) AS degree FROM rooms r LEFT JOIN edges e ON e.scene_id = r.scene_id AND e.src = r.room_id GROUP BY ALL)"
# Ids of the adapters are numbers, so paths of numbers order like paths of sort keys.
_PATHS = """paths AS (WITH RECURSIVE p(scene_id, src, dst, d, path) AS (SELECT scene_id, room_id, room_id, 0, [CAST(room_id AS BIGINT)] FROM rooms
    UNION ALL SELECT scene_id, src, dst, d, path FROM (SELECT x.*, row_number() OVER (PARTITION BY scene_id, src, dst ORDER BY path) AS k FROM (
        SELECT p.scene_id, p.src, e.dst, p.d + 1 AS d, list_append(p.path, CAST(e.dst AS BIGINT)) AS path FROM p JOIN edges e ON e.scene_id = p.scene_id AND e.src = p.dst WHERE NOT list_contains(p.path, CAST(e.dst AS BIGINT)) AND p.d < 12) x) WHERE k = 1)
    SELECT scene_id, src, dst, min(d) AS d, arg_min(path, d) AS path FROM p GROUP BY ALL)"""
_GROUPS = f"""fl AS (SELECT scene_id, count(DISTINCT floor) >= 2 AS many FROM rooms GROUP BY ALL),
grp AS (SELECT r.*, CASE WHEN many THEN floor END AS gf, CAST(dense_rank() OVER (PARTITION BY scene_id ORDER BY CASE WHEN many THEN floor END NULLS LAST) AS INT) AS group_ord FROM rooms r JOIN fl USING (scene_id) WHERE x IS NOT NULL),
va AS (SELECT scene_id, group_ord, {r9('var_pop(x)')} AS vx, {r9('var_pop(y)')} AS vy, {r9('var_pop(z)')} AS vz FROM grp GROUP BY ALL),
pl AS (SELECT grp.*, CASE WHEN vx <= vy AND vx <= vz THEN 1 WHEN vy <= vz THEN 2 ELSE 3 END AS up FROM grp JOIN va USING (scene_id, group_ord)),
plane AS (SELECT *, CASE WHEN up = 1 THEN y ELSE x END AS u, CASE WHEN up = 3 THEN y ELSE z END AS v FROM pl)"""
_BEAR = f"[{_LIST(M.SECTORS)}][1 + ((CAST(round_even(atan2({{1}}, {{0}}) / (pi() / 4), 0) AS INT) % 8) + 8) % 8]"
_PAIRS = f"""pairs AS (SELECT a.scene_id, a.group_ord, a.room_id AS a, b.room_id AS b, {{ord}} AS nbr_ord, sqrt((a.u - b.u) * (a.u - b.u) + (a.v - b.v) * (a.v - b.v)) AS distance, {_BEAR.format("(a.u - b.u)", "(a.v - b.v)")} AS a_from_b, {_BEAR.format("(-(a.u - b.u))", "(-(a.v - b.v))")} AS b_from_a
    FROM plane a JOIN plane b ON a.scene_id = b.scene_id AND a.group_ord = b.group_ord {{join}})"""
_SUP = f"""se AS (SELECT scene_id, subject_id AS child, object_id AS parent, min(predicate) AS predicate FROM relations WHERE {_CLASS} = 'support' AND subject_id <> object_id GROUP BY ALL),
sr AS (SELECT *, row_number() OVER (PARTITION BY scene_id, child ORDER BY CAST(parent AS BIGINT)) AS k FROM se),
ch AS (SELECT * FROM sr WHERE k = 1),
walk AS (WITH RECURSIVE w(scene_id, child, pos, seen, closed) AS (SELECT scene_id, child, parent, [child], FALSE FROM ch UNION ALL SELECT w.scene_id, w.child, ch.parent, list_append(w.seen, w.pos), list_contains(list_append(w.seen, w.pos), ch.parent) FROM w JOIN ch ON ch.scene_id = w.scene_id AND ch.child = w.pos WHERE NOT w.closed) SELECT * FROM w),
cuts AS (SELECT scene_id, child FROM walk WHERE closed AND CAST(child AS BIGINT) = list_min(list_transform(seen, lambda x: CAST(x AS BIGINT)))),
forest AS (SELECT scene_id, child, parent, predicate FROM ch WHERE (scene_id, child) NOT IN (SELECT scene_id, child FROM cuts))"""


def _w(*names: str, rest: str = "") -> str:
    return f"WITH RECURSIVE {ctes(*names)}" + (f",\n{rest}" if rest else "") + "\n"


ORACLES = {
    "object_inventory": _w("objects", rest="""c AS (SELECT scene_id, room_id, coalesce(category, 'object') AS c, count(*) AS n, min(obj_ord) AS f FROM objects GROUP BY ALL),
i AS (SELECT scene_id, room_id, CAST(sum(n) AS INT) AS n_objects, string_agg(CASE WHEN n > 1 THEN c || ' (×' || n || ')' ELSE c END, ', ' ORDER BY n DESC, f) AS inventory FROM c GROUP BY ALL)""") + "SELECT r.scene_id, r.room_id, coalesce(n_objects, 0) AS n_objects, coalesce(inventory, 'no objects') AS inventory FROM rooms r LEFT JOIN i USING (scene_id, room_id)",
    "room_type_summary": _w("rooms", rest="c AS (SELECT scene_id, category AS c, count(*) AS n, min(room_ord) AS f FROM rooms GROUP BY ALL)") + "SELECT scene_id, string_agg(CASE WHEN n > 1 THEN c || ' (×' || n || ')' ELSE c END, ', ' ORDER BY n DESC, f) AS room_types FROM c GROUP BY ALL",
    "scene_totals": _w("objects", "adjacency") + """SELECT r.scene_id, CAST(count(*) AS INT) AS n_rooms, CAST((SELECT count(*) FROM objects o WHERE o.scene_id = r.scene_id) AS INT) AS n_objects, CAST(floor((SELECT count(*) FROM adjacency a WHERE a.scene_id = r.scene_id) / 2) AS INT) AS n_connections, CAST(count(DISTINCT floor) AS INT) AS n_floors FROM rooms r GROUP BY r.scene_id""",
    "capabilities": _w("adjacency", "relations") + """SELECT scene_id, count(x) >= 2 AS multiroom, scene_id IN (SELECT scene_id FROM adjacency) AS connected, count(DISTINCT floor) >= 2 AS floors, scene_id IN (SELECT scene_id FROM relations) AS relations FROM rooms GROUP BY scene_id""",
    "floor_plane": _w("rooms", rest=_GROUPS) + f"SELECT scene_id, room_id, group_ord, {_N.format('up')} AS up, {r9('u')} AS u, {r9('v')} AS v FROM plane",
    "knn_rooms": _w("rooms", rest=_GROUPS + ",\n" + _PAIRS.format(ord="b.room_ord", join="AND a.room_id <> b.room_id")) + f"SELECT scene_id, group_ord, a, b, {r9('distance')} AS distance, a_from_b, b_from_a, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, group_ord, a ORDER BY {r9('distance')}, nbr_ord) AS k FROM pairs) WHERE k <= 4",
    "connected_placements": _w("adjacency", rest=_GROUPS + ",\n" + _PAIRS.format(ord="l.nbr_ord", join="JOIN adjacency l ON l.scene_id = a.scene_id AND l.src = a.room_id AND l.dst = b.room_id")) + f"SELECT scene_id, group_ord, a, b, {r9('distance')} AS distance, a_from_b, b_from_a, CAST(row_number() OVER (PARTITION BY scene_id, a ORDER BY {r9('distance')}, nbr_ord) AS INT) AS rank FROM pairs",
    "isolated_rooms": _w("adjacency", rest=_GROUPS) + "SELECT scene_id, room_id, group_ord FROM grp g WHERE NOT EXISTS (SELECT 1 FROM adjacency l JOIN grp h ON h.scene_id = l.scene_id AND h.room_id = l.dst WHERE l.scene_id = g.scene_id AND l.src = g.room_id AND h.group_ord = g.group_ord)",
    "exhaustive_flag": _w("rooms", rest=_GROUPS) + "SELECT scene_id, max(n) - 1 <= 4 AS exhaustive FROM (SELECT scene_id, group_ord, count(*) AS n FROM grp GROUP BY ALL) GROUP BY scene_id",
    "components": _w("adjacency", rest=_COMP) + "SELECT scene_id, room_id, component FROM comp",
    "connectivity_check": _w("adjacency", rest=_COMP) + "SELECT scene_id, count(DISTINCT component) AS components FROM comp GROUP BY scene_id HAVING count(DISTINCT component) > 1",
    "reachability_groups": _w("adjacency", rest=_COMP) + 'SELECT scene_id, component, CAST(count(*) AS INT) AS size, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY count(*) DESC, CAST(component AS BIGINT)) AS INT) AS "group" FROM comp GROUP BY scene_id, component',
    "degrees": _w("adjacency", rest=f"{_EDGES},\n{_DEG}") + "SELECT * FROM deg",
    "ordered_neighbours": _w("adjacency", rest=f"{_EDGES},\n{_DEG}") + "SELECT a.scene_id, a.src AS room_id, string_agg(a.dst, ',' ORDER BY degree DESC, CAST(a.dst AS BIGINT)) AS neighbours FROM edges a JOIN deg d ON d.scene_id = a.scene_id AND d.room_id = a.dst GROUP BY ALL",
    "connection_count": _w("adjacency") + "SELECT r.scene_id, CAST(floor((SELECT count(*) FROM adjacency a WHERE a.scene_id = r.scene_id) / 2) AS INT) AS connections FROM rooms r GROUP BY r.scene_id",
    "hubs": _w("adjacency", rest=f"{_EDGES},\n{_DEG}") + "SELECT scene_id, room_id, degree FROM (SELECT *, rank() OVER (PARTITION BY scene_id ORDER BY degree DESC) AS r FROM deg) WHERE r = 1 AND degree > 0",
    "bottlenecks": _w("adjacency", rest=f"""{_COMP},
{_DEG},
rr AS (WITH RECURSIVE r(scene_id, removed, room_id, pos) AS (SELECT a.scene_id, x.room_id, a.room_id, a.room_id FROM rooms a JOIN rooms x ON x.scene_id = a.scene_id AND x.room_id <> a.room_id UNION SELECT r.scene_id, r.removed, r.room_id, e.dst FROM r JOIN edges e ON r.scene_id = e.scene_id AND r.pos = e.src AND e.dst <> r.removed) SELECT * FROM r),
rc AS (SELECT t.scene_id, t.removed, t.room_id, arg_min(m.room_id, m.room_ord) AS component FROM rr t JOIN rooms m ON m.scene_id = t.scene_id AND m.room_id = t.pos GROUP BY ALL),
base AS (SELECT scene_id, count(DISTINCT component) AS n FROM comp GROUP BY ALL),
more AS (SELECT rc.scene_id, removed FROM rc JOIN base USING (scene_id) GROUP BY rc.scene_id, removed, n HAVING count(DISTINCT component) > n),
pc AS (SELECT rc.scene_id, rc.removed, rc.component, CAST(count(*) AS INT) AS size, string_agg(rc.room_id, ',' ORDER BY degree DESC, CAST(rc.room_id AS BIGINT)) AS members FROM rc JOIN more USING (scene_id, removed) JOIN deg ON deg.scene_id = rc.scene_id AND deg.room_id = rc.room_id GROUP BY ALL
    HAVING bool_or(EXISTS (SELECT 1 FROM edges e WHERE e.scene_id = rc.scene_id AND e.src = rc.removed AND e.dst = rc.room_id)))""") + "SELECT scene_id, removed AS room_id, CAST(row_number() OVER (PARTITION BY scene_id, removed ORDER BY size, CAST(component AS BIGINT)) AS INT) AS piece, size, members FROM pc",
    "shortest_routes": _w("adjacency", rest=f"{_EDGES},\n{_PATHS}") + "SELECT scene_id, src, dst, d AS distance, array_to_string(list_transform(path, lambda x: CAST(x AS VARCHAR)), ',') AS route FROM paths WHERE d >= 2 AND CAST(src AS BIGINT) < CAST(dst AS BIGINT)",
    "graph_center": _w("adjacency", rest=f"{_COMP},\n{_DEG},\n{_PATHS},\necc AS (SELECT scene_id, src AS room_id, max(d) AS e FROM paths GROUP BY ALL)") + "SELECT scene_id, component, room_id AS center FROM (SELECT comp.*, row_number() OVER (PARTITION BY comp.scene_id, component ORDER BY e, degree DESC, CAST(comp.room_id AS BIGINT)) AS k FROM comp JOIN ecc USING (scene_id, room_id) JOIN deg USING (scene_id, room_id)) WHERE k = 1",
    "relation_census": _w("relations") + f"SELECT scene_id, {', '.join(f'CAST(count_if({_CLASS} = {chr(39)}{c}{chr(39)}) AS INT) AS {c}' for c in R.CLASSES)}, CAST(count(*) AS INT) AS total FROM relations GROUP BY scene_id",
    "support_forest": _w("relations", rest=_SUP) + "SELECT scene_id, child, parent, predicate FROM forest",
    "extra_support_links": _w("relations", rest=_SUP) + "SELECT scene_id, child, predicate, string_agg(parent, ',' ORDER BY CAST(parent AS BIGINT)) AS parents FROM (SELECT scene_id, child, parent, predicate FROM sr WHERE k > 1 UNION ALL SELECT ch.scene_id, ch.child, ch.parent, ch.predicate FROM ch JOIN cuts USING (scene_id, child)) GROUP BY ALL",
    "support_chains": _w("relations", rest=f"""{_SUP},
nodes AS (SELECT scene_id, child AS n FROM se UNION SELECT scene_id, parent FROM se),
down AS (WITH RECURSIVE q(scene_id, node, path) AS (SELECT scene_id, n, [n] FROM nodes WHERE (scene_id, n) NOT IN (SELECT scene_id, child FROM forest) UNION ALL SELECT q.scene_id, f.child, list_append(q.path, f.child) FROM q JOIN forest f ON f.scene_id = q.scene_id AND f.parent = q.node) SELECT * FROM q),
leaf AS (SELECT * FROM down WHERE (scene_id, node) NOT IN (SELECT scene_id, parent FROM forest)),
mx AS (SELECT scene_id, max(len(path)) - 1 AS m FROM leaf GROUP BY ALL)""") + "SELECT * FROM (SELECT l.scene_id, CAST(row_number() OVER (PARTITION BY l.scene_id ORDER BY len(path) DESC, CAST(node AS BIGINT)) AS INT) AS rank, CAST(len(path) AS INT) AS size, array_to_string(path, ',') AS chain, CAST(m AS INT) AS max_depth FROM leaf l JOIN mx USING (scene_id) WHERE len(path) >= 3) WHERE rank <= 8",
    "receptacles": _w("relations", rest=_SUP) + "SELECT * FROM (SELECT scene_id, parent AS object_id, CAST(count(*) AS INT) AS n, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY count(*) DESC, CAST(parent AS BIGINT)) AS INT) AS rank FROM forest GROUP BY scene_id, parent) WHERE rank <= 5",
    "unordered_pairs": _w("relations") + f"SELECT DISTINCT scene_id, predicate, CASE WHEN CAST(subject_id AS BIGINT) <= CAST(object_id AS BIGINT) THEN subject_id ELSE object_id END AS a, CASE WHEN CAST(subject_id AS BIGINT) <= CAST(object_id AS BIGINT) THEN object_id ELSE subject_id END AS b FROM relations WHERE {_CLASS} = 'proximity'",
    "directed_pairs": _w("relations") + f"SELECT DISTINCT scene_id, predicate, subject_id AS a, object_id AS b FROM relations WHERE {_CLASS} <> 'proximity' AND predicate NOT LIKE 'same %'",
    "predicate_buckets": _w("relations") + f"SELECT scene_id, predicate, n, class, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY list_position([{_LIST(R.CLASSES)}], class), n DESC, predicate) AS INT) AS bucket FROM (SELECT scene_id, predicate, CAST(count(*) AS INT) AS n, {_CLASS} AS class FROM relations GROUP BY ALL)",
    "subject_groups": _w("relations") + f"SELECT *, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY spatial_degree DESC, degree DESC, CAST(subject_id AS BIGINT)) AS INT) AS rank FROM (SELECT scene_id, subject_id, CAST(count_if({_CLASS} <> 'attribute') AS INT) AS spatial_degree, CAST(count(*) AS INT) AS degree FROM relations GROUP BY ALL)",
    "subject_predicates": _w("relations") + f"SELECT scene_id, subject_id, predicate, string_agg(object_id, ',' ORDER BY rel_ord) AS targets, {_CLASS} = 'attribute' AS attribute, CAST(count(*) AS INT) AS n FROM relations GROUP BY ALL",
    "flat_triples": _w("relations") + "SELECT scene_id, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY CAST(subject_id AS BIGINT), predicate, CAST(object_id AS BIGINT), rel_ord) AS INT) AS line, subject_id, predicate, object_id FROM relations",
    "relation_components": _w("relations", rest=f"""re AS (SELECT DISTINCT scene_id, CASE WHEN predicate LIKE 'same %' THEN predicate ELSE 'proximity' END AS kind, subject_id AS a, object_id AS b FROM relations WHERE predicate LIKE 'same %' OR {_CLASS} = 'proximity'),
rs AS (SELECT scene_id, kind, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM re UNION SELECT scene_id, kind, CAST(b AS BIGINT), CAST(a AS BIGINT) FROM re),
rt AS (WITH RECURSIVE t(scene_id, kind, node, pos) AS (SELECT DISTINCT scene_id, kind, a, a FROM rs UNION SELECT t.scene_id, t.kind, t.node, rs.b FROM t JOIN rs ON rs.scene_id = t.scene_id AND rs.kind = t.kind AND rs.a = t.pos) SELECT * FROM t),
rl AS (SELECT scene_id, kind, node, min(pos) AS component FROM rt GROUP BY ALL)""") + "SELECT scene_id, kind, CAST(component AS VARCHAR) AS component, CAST(count(*) AS INT) AS size, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS members FROM rl GROUP BY scene_id, kind, component HAVING count(*) >= 2",
}
_TREE = f"""{_COMP},
{_DEG},
{_PATHS},
ecc AS (SELECT scene_id, src AS room_id, max(d) AS e FROM paths GROUP BY ALL),
cen AS (SELECT scene_id, component, room_id AS center FROM (SELECT comp.*, row_number() OVER (PARTITION BY comp.scene_id, component ORDER BY e, degree DESC, CAST(comp.room_id AS BIGINT)) AS k FROM comp JOIN ecc USING (scene_id, room_id) JOIN deg USING (scene_id, room_id)) WHERE k = 1),
tree AS (SELECT p.scene_id, c.component, p.dst AS room_id, CASE WHEN d > 0 THEN CAST(path[-2] AS VARCHAR) END AS parent, d AS depth FROM paths p JOIN cen c ON c.scene_id = p.scene_id AND c.center = p.src)"""
ORACLES["spanning_tree"] = _w("adjacency", rest=_TREE) + "SELECT scene_id, component, room_id, parent, depth FROM tree"
ORACLES["loop_edges"] = _w("adjacency", rest=_TREE) + "SELECT scene_id, src AS a, dst AS b FROM edges e WHERE CAST(src AS BIGINT) < CAST(dst AS BIGINT) AND NOT EXISTS (SELECT 1 FROM tree t WHERE t.scene_id = e.scene_id AND (t.room_id = e.src AND t.parent = e.dst OR t.room_id = e.dst AND t.parent = e.src))"
