"""The driver's tables in the shapes of a scene-graph experiment.

Each adapter is one SELECT that Spark and DuckDB both run, over views named like the
tables, so that a query and its SQL start from the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame, SparkSession

_HOST = "CASE s.s_nationkey % 3 WHEN 0 THEN 'procthor' WHEN 1 THEN '3rscan' ELSE 'gibson' END"

#: Result rows of an experiment from line items: model, question, representation and repetition by keys, scores from discounts.
RESULTS = f"""
SELECT l_returnflag AS model, 'judge' AS judge, concat(scene_id, ':', q) AS question_id, scene_id, split_part(reps, ',', CAST(l_orderkey % n_reps AS INT) + 1) AS representation,
       l_linenumber AS repetition, split_part(types, ',', CAST(CAST(floor(q / 2) AS INT) % n_types AS INT) + 1) AS question_type,
       CASE WHEN q % 2 = 0 THEN 'natural' ELSE 'constructed' END AS question_style,
       CASE WHEN CAST(l_quantity AS INT) % 7 = 0 THEN '0' WHEN l_partkey % 11 = 0 THEN '' ELSE CAST(CAST(l_quantity AS INT) * 10 + l_orderkey % n_reps AS STRING) END AS prompt_tokens,
       CASE WHEN l_orderkey % 37 = 0 OR l_orderkey % 41 = 0 OR l_suppkey % 13 = 0 THEN NULL
            ELSE floor(least(1e0, l_discount * 10 * (5e-1 + 1e-1 * (l_orderkey % n_reps))) * 10000 + 5e-1) / 10000 END AS answer_correctness,
       CASE WHEN l_orderkey % 37 = 0 OR l_orderkey % 41 = 0 OR l_partkey % 3 = 0 THEN NULL ELSE floor(l_tax * 120000 + 5e-1) / 10000 END AS answer_correctness_detail,
       l_extendedprice AS latency_ms,
       CASE WHEN l_orderkey % 37 = 0 THEN 'CONTEXT_EXCEEDED: prompt' WHEN l_orderkey % 41 = 0 THEN 'timeout' ELSE '' END AS error
FROM (SELECT l.*, l_partkey % 20 AS q, {_HOST} AS host,
             CASE s.s_nationkey % 3 WHEN 0 THEN concat('procthor_', s.s_nationkey) WHEN 1 THEN concat('3rscan_', s.s_nationkey) ELSE concat('Building', s.s_nationkey) END AS scene_id,
             CASE s.s_nationkey % 3 WHEN 0 THEN 'inventory,json_mini,topology,room_tree,graph_digest,topology_inventory,narrative,topology_metric,navigation,json_pretty,prose,synthesis'
                  WHEN 1 THEN 'inventory,json_mini,relations_flat,relations_subject,relations_predicate,relations_tree,relations_digest,synthesis'
                  ELSE 'inventory,json_mini,metric_framing,navigation,json_pretty,metric_relations' END AS reps,
             CASE s.s_nationkey % 3 WHEN 0 THEN 12 WHEN 1 THEN 8 ELSE 6 END AS n_reps,
             CASE s.s_nationkey % 3 WHEN 0 THEN 'connectivity,direction,route,aggregation,set_logic,containment,planning,connectivity,proximity,connectivity'
                  WHEN 1 THEN 'object_relation,relation_structure,relation_aggregate,planning,object_relation'
                  ELSE 'aggregation,set_logic,direction,containment,planning,direction' END AS types,
             CASE s.s_nationkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 5 ELSE 6 END AS n_types
      FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey) x
"""

#: Pairs of wordings: questions 2k and 2k + 1 of a scene.
PAIRS = """
SELECT DISTINCT scene_id, split_part(question_id, ':', 2) AS id, concat('p', CAST(floor(CAST(split_part(question_id, ':', 2) AS INT) / 2) AS INT)) AS pair_id FROM results
"""

#: The coverage flavour: languages as hosts, sources as representations, quality labels as scores.
COVERAGE = """
SELECT 'm' AS model, 'judge' AS judge, concat('d', d.doc_id) AS question_id, CASE d.lang WHEN 'en' THEN 'procthor_en' WHEN 'de' THEN '3rscan_de' ELSE concat('Building_', d.lang) END AS scene_id,
       d.source AS representation, 1 AS repetition, CASE WHEN d.n_chars % 3 = 0 THEN 'object_relation' ELSE 'aggregation' END AS question_type, CAST(NULL AS STRING) AS question_style,
       CAST(d.n_chars AS STRING) AS prompt_tokens, CAST(l.quality AS DOUBLE) AS answer_correctness, CAST(l.toxic AS DOUBLE) AS answer_correctness_detail, CAST(d.n_chars AS DOUBLE) AS latency_ms,
       CASE WHEN d.n_chars > 8000 THEN 'CONTEXT_EXCEEDED: prompt' ELSE '' END AS error
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

#: An append log with rewrites: three cells a user and event type; later events overwrite earlier ones.
LOG = """
SELECT concat('u', user_id) AS question_id, event_type AS representation, CAST(event_id % 3 AS INT) AS repetition, concat('m', user_id % 5) AS responder,
       event_id AS write_order, value AS latency_ms, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'CONTEXT_EXCEEDED: prompt' WHEN event_id % 5 = 0 THEN 'timeout' ELSE '' END AS error
FROM events
"""

#: Questions from benchmark items: id, scene, type, style and a pair for most.
QUESTIONS = """
SELECT CAST(item_id AS STRING) AS id, CASE item_id % 3 WHEN 0 THEN concat('procthor_', item_id % 4) WHEN 1 THEN concat('3rscan_', item_id % 4) ELSE concat('Building', item_id % 4) END AS scene_id,
       text, split_part('connectivity,planning,aggregation,direction,object_relation,route,unheard_of', ',', CAST(item_id % 7 AS INT) + 1) AS question_type,
       CASE WHEN item_id % 5 = 0 THEN CAST(NULL AS STRING) WHEN item_id % 2 = 0 THEN 'natural' ELSE 'constructed' END AS question_style,
       CASE WHEN item_id % 10 = 9 THEN CAST(NULL AS STRING) ELSE concat('p', CAST(floor(item_id / 6) AS INT)) END AS pair_id,
       split_part(text, ' ', 1) AS fact_1, split_part(text, ' ', 2) AS fact_2, split_part(text, ' ', 3) AS fact_3, item_id % 4 AS n_facts
FROM benchmark
"""

#: Scenes from customers: a nation's customers, 750 keys (about 30 rooms) a scene, so that scenes grow in number with the data.
ROOMS = """
SELECT concat('scene_', c_nationkey, '_', block) AS scene_id, CAST(c_custkey AS STRING) AS room_id, CAST(rn AS INT) AS room_ord, c_mktsegment AS category,
       CASE WHEN c_nationkey % 3 = 0 THEN CAST(NULL AS STRING) WHEN rn % 11 = 0 THEN CAST(NULL AS STRING) ELSE CAST(rn % 2 AS STRING) END AS floor,
       CASE WHEN rn % 13 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST((c_custkey * 37) % 101 AS DOUBLE) / 10 END AS x, CAST((c_custkey * 11) % 7 AS DOUBLE) / 10 AS y, CAST((c_custkey * 53) % 97 AS DOUBLE) / 10 AS z
FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, block ORDER BY c_custkey) - 1 AS rn FROM (SELECT *, CAST(floor(c_custkey / 750) AS INT) AS block FROM customer) k) c
"""

#: A tree over each scene's rooms with a few chords; the last four of each 30 rooms have no door.
ADJACENCY = """
SELECT scene_id, src, dst, CAST(row_number() OVER (PARTITION BY scene_id, src ORDER BY d) - 1 AS INT) AS nbr_ord
FROM (SELECT a.scene_id, a.room_id AS src, b.room_id AS dst, b.room_ord AS d
      FROM rooms a JOIN rooms b ON a.scene_id = b.scene_id AND a.room_ord % 30 < 26 AND b.room_ord % 30 < 26
       AND (a.room_ord = floor((b.room_ord - 1) / 2) AND b.room_ord > 0 OR b.room_ord = floor((a.room_ord - 1) / 2) AND a.room_ord > 0
            OR abs(a.room_ord - b.room_ord) = 7 AND (a.room_ord + b.room_ord) % 9 = 0)) e
"""

#: Objects from orders.
OBJECTS = """
SELECT r.scene_id, r.room_id, CAST(o.o_orderkey AS STRING) AS object_id, CAST(row_number() OVER (PARTITION BY r.scene_id ORDER BY r.room_ord, o.o_orderkey) - 1 AS INT) AS obj_ord,
       CAST(NULL AS STRING) AS short_id, CASE WHEN o.o_orderkey % 17 = 0 THEN CAST(NULL AS STRING) ELSE o.o_orderpriority END AS category
FROM orders o JOIN rooms r ON CAST(o.o_custkey AS STRING) = r.room_id
"""

#: Relations from line items: an order's object and another one of its scene, a predicate by line and supplier.
RELATIONS = """
SELECT s.scene_id, CAST(row_number() OVER (PARTITION BY s.scene_id ORDER BY l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_partkey, l.l_extendedprice) - 1 AS INT) AS rel_ord, s.object_id AS subject_id,
       split_part('standing on,lying on,close by,next to,left,right,same color,same type,bigger than,supported by,hanging on,front,part of', ',', CAST((l.l_linenumber + l.l_suppkey) % 13 AS INT) + 1) AS predicate,
       o.object_id AS object_id
FROM lineitem l JOIN objects s ON CAST(l.l_orderkey AS STRING) = s.object_id
     JOIN (SELECT scene_id, max(obj_ord) + 1 AS n FROM objects GROUP BY scene_id) c ON c.scene_id = s.scene_id
     JOIN objects o ON o.scene_id = s.scene_id AND o.obj_ord = (s.obj_ord * 5 + l.l_partkey) % c.n
"""

#: Parts of raw houses. An order is an object of its customer's room, with an id in one of the forms of such records, some of them without a room; each third one has a child.
HOUSE_OBJECTS = """
SELECT scene_id, room_id, obj_ord AS ord, k, cat, CASE WHEN k % 11 = 0 THEN 'bad' WHEN k % 13 = 0 THEN concat(cat, '|unknown|', CAST(k AS STRING)) WHEN k % 5 = 0 THEN concat(cat, '|surface|', room_id, '|', CAST(k AS STRING))
            WHEN k % 5 = 1 THEN concat(cat, '|', room_id, '|', CAST(k % 2 AS STRING), '|', CAST(k AS STRING)) ELSE concat(cat, '|', room_id, '|', CAST(k AS STRING)) END AS id,
       CASE WHEN k % 3 = 0 THEN concat('Cup|surface|', room_id, '|c', CAST(k AS STRING)) END AS kid
FROM (SELECT scene_id, room_id, obj_ord, CAST(object_id AS BIGINT) AS k, coalesce(category, 'Box') AS cat FROM objects) o
"""

#: Doors from a room to the next, some twice, some into the room itself or nowhere.
HOUSE_DOORS = """
SELECT scene_id, room_ord * 4 + j AS ord, CASE j WHEN 1 THEN b ELSE a END AS a, CASE j WHEN 0 THEN b WHEN 1 THEN a WHEN 2 THEN a ELSE 'unknown' END AS b
FROM (SELECT scene_id, room_ord, room_id AS a, lead(room_id) OVER (PARTITION BY scene_id ORDER BY room_ord) AS b FROM rooms) r CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) s
WHERE b IS NOT NULL AND (j = 0 AND room_ord % 3 <> 2 OR j = 1 AND room_ord % 5 = 0 AND room_ord % 3 <> 2 OR j = 2 AND room_ord % 7 = 0 OR j = 3 AND room_ord % 11 = 0)
"""

#: Walls that a room without a door shares with the next, open or not, and outer ones.
HOUSE_WALLS = """
SELECT scene_id, room_ord * 4 + j AS ord, CASE j WHEN 1 THEN b ELSE a END AS room, CASE j WHEN 2 THEN -1 - room_ord ELSE room_ord END AS place, j, room_ord % 2 = 0 AS empty
FROM (SELECT scene_id, room_ord, room_id AS a, lead(room_id) OVER (PARTITION BY scene_id ORDER BY room_ord) AS b FROM rooms) r CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2) s
WHERE b IS NOT NULL AND (j < 2 AND room_ord % 3 = 2 OR j = 2 AND room_ord % 4 = 0)
"""

#: Judge texts from conversations: numbered lines with verdicts, some in thought.
JUDGED = """
SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN concat('<think>', substring(text, 1, 40), '</think>  ', substring(text, 41)) WHEN conv_id % 3 = 1 THEN concat(substring(text, 1, 50), '<think>', substring(text, 51)) ELSE concat('  ', text) END AS text
FROM conversations
"""

#: Parts of a judge's text from conversations: a numbered verdict a turn, in one of seven forms by its length, and the turn's text below.
RUBRICS = """
SELECT conv_id, k, concat(CAST(CASE WHEN length(text) % 17 = 0 THEN 99 ELSE k END AS STRING), '. ', CASE CAST(length(text) % 7 AS INT) WHEN 0 THEN '**YES** — stated' WHEN 1 THEN 'NO: absent' WHEN 2 THEN concat('YES the fact again', chr(10), '   - NO')
             WHEN 3 THEN 'Not stated - left out' WHEN 4 THEN concat('a remark of many words on it - so', chr(10), '  YES') WHEN 5 THEN 'YES the fact again' ELSE concat('no, not yet', chr(10), '- ', CAST(k AS STRING), ') `Yes`') END, chr(10), text) AS line
FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations) t
"""

_SHAPES = {
    "results": (RESULTS, []), "coverage_results": (COVERAGE, []), "pairs": (PAIRS, ["results"]), "log": (LOG, []), "questions": (QUESTIONS, []), "rooms": (ROOMS, []),
    "adjacency": (ADJACENCY, ["rooms"]), "objects": (OBJECTS, ["rooms"]), "relations": (RELATIONS, ["rooms", "objects"]), "house_objects": (HOUSE_OBJECTS, ["objects"]), "house_doors": (HOUSE_DOORS, ["rooms"]), "house_walls": (HOUSE_WALLS, ["rooms"]),
    "judged": (JUDGED, []), "rubrics": (RUBRICS, []),
}


def _needed(names: tuple[str, ...], made: Collection[str] = ()) -> list[str]:
    out: list[str] = []
    for name in names:
        for x in [*_needed(tuple(n for n in _SHAPES[name][1] if n not in made), made), name]:
            if x not in out:
                out.append(x)
    return out


def ctes(*names: str, made: Collection[str] = ()) -> str:
    """The adapters as common table expressions, without WITH; those made already are left out."""
    return ",\n".join(f"{n} AS ({_SHAPES[n][0].strip()})" for n in _needed(names, made))


def shape(spark: SparkSession, sf_dir: str, name: str, made: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """One adapter's rows, from those of others that are made already. Tables are read as they are; Spark prunes columns and pushes filters through the SELECT."""
    made = made or {}
    text = f"WITH {ctes(name, made=made)} SELECT * FROM {name}"
    tables = [t for t in ("lineitem", "supplier", "documents", "labels", "events", "benchmark", "customer", "orders", "conversations") if t in text]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    frames |= {t: df for t, df in made.items() if t != name and re.search(rf"\b(FROM|JOIN) {t}\b", text)}
    for t in frames:  # placeholders rather than views: sessions run several sizes side by side
        text = _placeholder(text, t)
    return spark.sql(text, **frames)


def _placeholder(text: str, table: str) -> str:
    return re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", text)
