"""Queries that render scenes: one for each representation, over the scenes made from customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import sized
from ..operators.render import RENDERERS, render
from .adapters import _SHAPES, ctes, shape
from .scenes import _DEG, _EDGES


class _Tables(dict):
    """The tables of a rendering, each written when it is first asked for, from those before it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name == "scenes":
            self[name] = self["rooms"].select("scene_id").distinct().withColumn("name", F.concat(F.lit("House "), "scene_id"))
        else:
            for n in _SHAPES[name][1]:
                self[n]
            self[name] = sized(shape(self.spark, self.sf_dir, name, {n: self[n] for n in _SHAPES[name][1]}), name, dealt=True)
        return self[name]


QUERIES = {f"render_{rep}": lambda s, d, rep=rep: render(_Tables(s, d), rep) for rep in RENDERERS}

_LABEL = "coalesce(category, 'room') || ' [' || room_id || ']'"
_TEXT = "SELECT scene_id, '{0}' AS representation, string_agg(line, chr(10) ORDER BY s, a, b) || chr(10) AS text FROM lines GROUP BY scene_id"
_INV = """c AS (SELECT scene_id, room_id, coalesce(category, 'object') AS c, count(*) AS n, min(obj_ord) AS f FROM objects GROUP BY ALL),
i AS (SELECT scene_id, room_id, CAST(sum(n) AS INT) AS n_objects, string_agg(CASE WHEN n > 1 THEN c || ' (×' || n || ')' ELSE c END, ', ' ORDER BY n DESC, f) AS inv FROM c GROUP BY ALL),
ri AS (SELECT r.*, coalesce(n_objects, 0) AS n_objects, coalesce(inv, 'no objects') AS inv FROM rooms r LEFT JOIN i USING (scene_id, room_id)),
ty AS (SELECT scene_id, string_agg(CASE WHEN n > 1 THEN c || ' (×' || n || ')' ELSE c END, ', ' ORDER BY n DESC, f) AS types FROM (SELECT scene_id, category AS c, count(*) AS n, min(room_ord) AS f FROM rooms GROUP BY ALL) GROUP BY ALL)"""
_NEAR = f"""{_EDGES},
{_DEG},
lab AS (SELECT scene_id, room_id, {_LABEL} AS label, degree FROM rooms JOIN deg USING (scene_id, room_id)),
nb AS (SELECT e.scene_id, e.src AS room_id, string_agg(label, ', ' ORDER BY degree DESC, CAST(e.dst AS BIGINT)) AS nb FROM edges e JOIN lab ON lab.scene_id = e.scene_id AND lab.room_id = e.dst GROUP BY ALL),
tot AS (SELECT scene_id, count(*) AS n, CAST(floor((SELECT count(*) FROM adjacency a WHERE a.scene_id = r.scene_id) / 2) AS INT) AS k FROM rooms r GROUP BY scene_id)"""

ORACLES = {
    "render_inventory": f"""WITH {ctes("objects")},
{_INV},
lines AS (SELECT scene_id, 0 AS s, 0 AS a, 0 AS b, 'House ' || scene_id || ' — ' || count(*) || ' rooms, ' || sum(n_objects) || ' objects.' AS line FROM ri GROUP BY scene_id
    UNION ALL SELECT scene_id, 1, 0, 0, 'Room types: ' || types || '.' FROM ty UNION ALL SELECT scene_id, 2, 0, 0, '' FROM ty
    UNION ALL SELECT scene_id, 3, row_number() OVER (PARTITION BY scene_id ORDER BY n_objects DESC, CAST(room_id AS BIGINT)), 0, {_LABEL} || ' — contains: ' || inv || '.' FROM ri)
{_TEXT.format("inventory")}""",
    "render_topology": f"""WITH {ctes("adjacency")},
{_NEAR},
o AS (SELECT lab.*, nb, row_number() OVER (PARTITION BY lab.scene_id ORDER BY degree DESC, CAST(lab.room_id AS BIGINT)) AS a FROM lab LEFT JOIN nb USING (scene_id, room_id)),
lines AS (SELECT scene_id, 0 AS s, 0 AS a, 0 AS b, 'House ' || scene_id || ' — ' || n || ' rooms, ' || k || ' room connections (doorways or open passages).' AS line FROM tot UNION ALL SELECT scene_id, 1, 0, 0, '' FROM tot
    UNION ALL SELECT scene_id, 2, a, 0, label FROM o UNION ALL SELECT scene_id, 2, a, 1, '  connects to: ' || coalesce(nb, '(none)') FROM o)
{_TEXT.format("topology")}""",
    "render_topology_inventory": f"""WITH {ctes("adjacency", "objects")},
{_INV},
{_NEAR},
o AS (SELECT lab.*, nb, inv, row_number() OVER (PARTITION BY lab.scene_id ORDER BY degree DESC, CAST(lab.room_id AS BIGINT)) AS a FROM lab JOIN ri USING (scene_id, room_id) LEFT JOIN nb USING (scene_id, room_id)),
lines AS (SELECT scene_id, 0 AS s, 0 AS a, 0 AS b, 'House ' || scene_id || ' — ' || n || ' rooms, ' || (SELECT sum(n_objects) FROM ri WHERE ri.scene_id = tot.scene_id) || ' objects, ' || k || ' room connections (doorways or open passages). Room types: ' || types || '.' AS line FROM tot JOIN ty USING (scene_id) UNION ALL SELECT scene_id, 1, 0, 0, '' FROM tot
    UNION ALL SELECT scene_id, 2, a, 0, label FROM o UNION ALL SELECT scene_id, 2, a, 1, '  connects to: ' || coalesce(nb, '(none)') FROM o UNION ALL SELECT scene_id, 2, a, 2, '  contains: ' || inv FROM o)
{_TEXT.format("topology_inventory")}""",
    "render_relations_flat": f"""WITH {ctes("relations")},
l AS (SELECT scene_id, object_id, coalesce(category, 'object') || ' [' || object_id || ']' AS label FROM objects),
lines AS (SELECT scene_id, 0 AS s, 0 AS a, 0 AS b, 'House ' || scene_id || ' -- ' || count(*) || ' object relations, one per line as (subject, relation, object) triples; unordered, every edge stated separately.' AS line FROM relations GROUP BY scene_id UNION ALL SELECT DISTINCT scene_id, 1, 0, 0, '' FROM relations
    UNION ALL SELECT r.scene_id, 2, row_number() OVER (PARTITION BY r.scene_id ORDER BY CAST(subject_id AS BIGINT), predicate, CAST(r.object_id AS BIGINT), rel_ord), 0, '(' || a.label || ', ' || predicate || ', ' || b.label || ')' FROM relations r JOIN l a ON a.scene_id = r.scene_id AND a.object_id = subject_id JOIN l b ON b.scene_id = r.scene_id AND b.object_id = r.object_id)
{_TEXT.format("relations_flat")}""",
}
