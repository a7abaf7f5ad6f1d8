"""Operators on hand-made rows: verdicts, rubric texts, logs, scope, graphs with cycles, sources, the stream."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from scenespark import registry as R
from scenespark.functions.keys import id_key
from scenespark.functions.text import json_indented, py_fixed
from scenespark.operators import cells as L
from scenespark.operators import graph as G
from scenespark.operators import judging as J
from scenespark.operators import paired as P
from scenespark.operators import questions as Q
from scenespark.operators import relations as Rel
from scenespark.operators.render import render, render_with
from scenespark.sources import scenes as S
from scenespark.sources import tables as T
from scenespark.streaming.results import coverage, read_state, stream_coverage, stream_results


@pytest.mark.parametrize(
    ("deltas", "capped", "gate", "expected"),
    [
        ([0.2, 0.1, 0.15], False, "", R.CONSISTENT), ([0.2, 0.1, 0.15], True, "", R.DIRECTIONAL), ([0.2, 0.1], False, "a n=3 (< 6)", R.NOT_LICENSED), ([], False, "", R.NOT_LICENSED),
        ([0.3, -0.2], False, "", R.MIXED), ([0.05, -0.05], False, "", R.NO_SEPARATION), ([0.5, -0.05], False, "", R.MIXED), ([0.1, -0.05], False, "", R.NO_SEPARATION), ([0.01, 0.02], False, "", R.DIRECTIONAL), ([0.4, 0.0], False, "", R.DIRECTIONAL),
    ],
)
def test_verdict(spark, deltas, capped, gate, expected):
    df = spark.createDataFrame([(deltas, capped, gate)], "d array<double>, c boolean, g string")
    assert df.select(P.verdict(F.col("d"), F.col("c"), F.col("g"))).first()[0] == expected


@pytest.mark.parametrize(
    ("text", "n", "verdicts", "error"),
    [
        ("1. YES — seen\n2. NO: absent", 2, [True, False], None), ("**1.** YES, ok\n`2)` no", 2, [True, False], None), ("1. YES the fact restated\n   - NO", 1, [False], None), ("1. Not stated - reason", 1, [False], None),
        ("1. YES.\n1. NO.", 1, [False], None), ("1. YES", 2, [True, False], "no verdict for fact(s) [2] of 2"), ("", 0, [], None), ("7. YES", 1, [False], "no verdict for fact(s) [1] of 1"), ("1. a long remark of many words - so\n  YES it is", 1, [True], None),
        (None, 1, [False], "no verdict for fact(s) [1] of 1"), ("1. YES again\n9. YES\n  no", 1, [False], None), ("1. YES again\n9. what was that\n  no", 1, [False], "no verdict for fact(s) [1] of 1"), ("2. left out: so\n2. YES\n1. no.\n2. gone: so", 2, [False, True], None),
    ],
)
def test_rubric(spark, text, n, verdicts, error):
    got = spark.createDataFrame([(text, n)], "text string, n int").select(J.parse_rubric("text", F.col("n")).alias("r")).first()["r"]
    assert (got["verdicts"], got["error"]) == (verdicts, error)


def test_judging_end_to_end(spark):
    facts = [("a room", 3.0), ("a door", 1.0)]
    kinds = "question_id string, question_text string, raw_answer string, error string, key_facts array<struct<fact:string,weight:double>>"
    rows = spark.createDataFrame([("1", "q", "long", None, facts), ("2", "q", "x", "timeout", facts), ("3", "q", "boom", None, facts), ("4", "q", "a", None, [("only", 1.0)])], kinds)

    def judge():
        def call(prompt):
            if "boom" in prompt:
                raise TimeoutError("slow")
            return "1. YES - there\n2. NO - not there" if "2." in prompt else "1. YES."

        return call

    out = {r["question_id"]: r for r in J.batch_judge(rows, judge, "j").collect()}
    assert (out["1"]["answer_correctness"], out["1"]["answer_correctness_detail"], out["1"]["error"]) == (1.0, 0.0, None)
    assert out["2"]["error"] == "timeout" and out["3"]["error"] == "TimeoutError: slow" and out["4"]["error"] == "no core fact"


def test_log_rules(spark):
    kinds = "question_id string, representation string, repetition int, write_order long, error string"
    log = spark.createDataFrame([("a", "r", 1, 1, ""), ("a", "r", 1, 2, "timeout"), ("b", "r", 1, 3, "timeout"), ("b", "r", 1, 4, None), ("c", "r", 1, 5, "CONTEXT_EXCEEDED: x")], kinds)
    assert {r[0] for r in L.compact_log(log).collect()} == {"b", "c"}
    assert {(r[0], r[3]) for r in L.latest_responses(log).collect()} == {("a", 2), ("b", 4), ("c", 5)}
    assert {r[0] for r in L.pending_cells(log.select(*L.CELL_KEY).distinct(), L.latest_responses(log)).collect()} == {"a"}


def test_scope_and_plans(spark):
    rows = spark.createDataFrame([("topology", "route", "procthor"), ("relations_tree", "relation_structure", "3rscan"), ("topology", "planning", "gibson"), ("mine", "route", "x"), ("topology", "new", "x")], "representation string, question_type string, host string")
    assert [r["in_scope"] for r in L.in_scope(rows).orderBy("representation", "question_type").collect()] == [True, True, True, False, False]
    with pytest.raises(ValueError, match="host"):
        L.in_scope(rows, host=None)
    models, scenes = spark.createDataFrame([("m",)], "model string"), spark.createDataFrame([("s",)], "scene_id string")
    assert L.plan_runs(models, scenes).count() == 1
    with pytest.raises(ValueError, match="unknown model: z"):
        L.plan_runs(models, scenes, ["z"])


def test_guards_and_tokens(spark):
    df = spark.createDataFrame([("x" * 1376, 344), ("x" * 1376, None), ("x" * 1375, None)], "p string, n int")
    got = [r[0] for r in df.select(L.context_guard(F.col("n"), F.length("p"), 600)).collect()]
    assert got == [None, "CONTEXT_EXCEEDED: 344 tokens of 344", None]
    counted = L.count_tokens(spark.createDataFrame([("a b c",), (None,)], "t string"), lambda: lambda ts: [len(t.split()) for t in ts], "t")
    assert [r[1] for r in counted.collect()] == [4, None]
    text = spark.createDataFrame([("<think>a</think>  b",), (" c<think>d",)], "t string")
    assert [r[0] for r in text.select(L.strip_thinking(F.col("t"))).collect()] == ["b", "c"]
    assert spark.range(1).select(L.chat_prompt(F.lit("p"), F.lit("qwen3:8b"))).first()[0].startswith("<|im_start|>user\np<|im_end|>")


def test_id_order_and_formats(spark):
    ids = spark.createDataFrame([("10",), ("9",), ("b",), ("a1",)], "i string").orderBy(id_key("i")).collect()
    assert [r[0] for r in ids] == ["9", "10", "a1", "b"]
    assert spark.createDataFrame([(0.25,), (0.35,), (None,)], "x double").select(py_fixed(F.col("x"), 1)).collect() == [(f"{0.25:.1f}",), (f"{0.35:.1f}",), (None,)]
    assert spark.createDataFrame([('{"a":[1,"é"]}',)], "j string").select(json_indented(F.col("j"))).first()[0] == json.dumps({"a": [1, "é"]}, indent=2, ensure_ascii=False)


def random_scene(rng, n, extra):
    rooms = [(f"s{n}", str(i), k) for k, i in enumerate(rng.sample(range(1, 99), n))]
    ids = [r[1] for r in rooms]
    edges = {tuple(sorted(rng.sample(ids, 2))) for _ in range(n - 2 + extra)}
    return rooms, edges


def test_graphs_against_plain_python(spark):
    rng = random.Random(7)
    rooms, edges = [], []
    for n, extra in ((3, 0), (5, 0), (6, 2), (8, 3)):
        r, e = random_scene(rng, n, extra)
        rooms += r
        edges += [(f"s{n}", a, b) for a, b in e]
    df = spark.createDataFrame(rooms, "scene_id string, room_id string, room_ord int")
    adj = spark.createDataFrame(edges, "scene_id string, src string, dst string")
    routes = {(r["scene_id"], r["src"], r["dst"]): r["route"] for r in G.shortest_routes(df, adj).collect()}
    comps = {(r["scene_id"], r["room_id"]): r["component"] for r in G.room_components(df, adj).collect()}
    cuts = {(r["scene_id"], r["room_id"]) for r in G.bottlenecks(df, adj).collect()}
    for scene in {r[0] for r in rooms}:
        ids = [r[1] for r in rooms if r[0] == scene]
        near = {i: sorted({b for s, a, b in edges if s == scene and a == i} | {a for s, a, b in edges if s == scene and b == i}, key=int) for i in ids}

        def parts(left, near=near):
            seen, n = set(), 0
            for x in left:
                n += x not in seen
                todo = [x]
                while todo:
                    y = todo.pop()
                    if y not in seen:
                        seen.add(y)
                        todo += [z for z in near[y] if z in left]
            return n

        assert len({comps[scene, i] for i in ids}) == parts(ids)
        assert {i for s, i in cuts if s == scene} == {i for i in ids if parts([x for x in ids if x != i]) > parts(ids)}
        for a in ids:
            came, todo = {a: None}, [a]
            for x in todo:
                for y in near[x]:
                    if y not in came:
                        came[y] = x
                        todo.append(y)
            for b in came:
                path = [b]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                if len(path) > 2 and int(a) < int(b):
                    assert routes[scene, a, b] == path[::-1]


def test_support_forest_cuts_cycles(spark):
    rel = [("s", i, a, p, b) for i, (a, p, b) in enumerate([("1", "on", "2"), ("2", "on", "3"), ("3", "on", "2"), ("4", "inside", "1"), ("4", "on", "9"), ("5", "near", "1"), ("6", "on", "6"), ("7", "on", "8"), ("7", "cover", "8")])]
    df = spark.createDataFrame(rel, "scene_id string, rel_ord int, subject_id string, predicate string, object_id string")
    forest, extra = Rel.support_forest(df)
    # In id order: 1's walk repeats 2, so 1 is cut; 2's walk comes back to itself.
    assert {(r["child"], r["parent"], r["predicate"]) for r in forest.collect()} == {("3", "2", "on"), ("4", "1", "inside"), ("7", "8", "cover")}
    assert {(r["child"], r["parent"]) for r in extra.collect()} == {("1", "2"), ("2", "3"), ("4", "9")}


def test_questions(spark):
    rows = [("1", "s", "t", "route", "natural", "p", [("f", 3.0)]), ("2", "s", "t", None, "natural", "p", [("f", 1.0)]), ("3", "s", "", "x", None, "q", []), ("4", "s", "t", "x", "natural", None, [("f", 2.0)])]
    q = spark.createDataFrame(rows, T.QUESTION_SCHEMA)
    assert {(r["id"], r["problem"]) for r in Q.validate_questions(q).collect()} == {("2", "no core fact"), ("3", "missing text"), ("3", "no key facts"), ("3", "pair without style"), ("4", "style without pair")}
    assert {r["pair_id"] for r in Q.validate_pairs(q).collect()} == {"p", "q"}
    with pytest.raises(ValueError, match="no question"):
        Q.select_types(q, ["none"])


def test_files(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "1", "scene_id": "s", "text": "t", "question_type": "", "key_facts": [{"fact": "f"}]}\n\n{"id": "2", "scene_id": "s", "text": "t", "key_facts": [{"fact": "f", "weight": 3}]}\n')
    q = T.read_questions(spark, str(tmp_path / "q.jsonl")).orderBy("id").collect()
    assert [(r["id"], r["question_type"], r["key_facts"][0]["weight"]) for r in q] == [("1", None, 1.0), ("2", None, 3.0)]
    row = {c: None for c in J.RESULT_COLUMNS} | {"question_id": "1", "scene_id": "s", "representation": "r", "repetition": 1, "raw_answer": 'a "quoted"\nline', "answer_correctness": 0.5, "error": None}
    T.write_results(spark.createDataFrame([tuple(row.values())], T.RESULT_SCHEMA), str(tmp_path / "m" / "one" / "x"))
    back = T.pool_results(spark, str(tmp_path / "m" / "*" / "*")).first()
    assert (back["question_id"], back["raw_answer"], back["model"]) == ("s:1", 'a "quoted"\nline', "one")
    (tmp_path / "log.jsonl").write_text('{"question_id": "1", "error": null}\nnot json\n')
    assert T.read_responses(spark, str(tmp_path / "log.jsonl")).count() == 1
    for scene, rep in (("s", "topology.txt"), ("s", "prose.txt"), ("s", "prose.md")):
        (tmp_path / "c" / scene).mkdir(parents=True, exist_ok=True)
        (tmp_path / "c" / scene / rep).write_text("x\ny")
    found = T.read_contexts(spark, str(tmp_path / "c"))
    assert {(r["representation"], r["text"]) for r in found.collect()} == {("topology", "x\ny"), ("prose", "x\ny")}
    wanted = spark.createDataFrame([("s", "topology"), ("s", "prose"), ("s", "gone")], "scene_id string, representation string")
    assert {(r["representation"], r["n"]) for r in T.context_problems(wanted, found).collect()} == {("prose", 2), ("gone", 0)}


HOUSE = {
    "rooms": [{"id": f"room|{i}", "roomType": k, "floorPolygon": [{"x": i, "y": 0, "z": 0}, {"x": i + 2, "y": 0, "z": 4}]} for i, k in ((2, "Kitchen"), (10, "Bath"), (3, "Hall"))],
    "objects": [
        {"id": "Table|2|0|0", "position": {"x": 1, "y": 0, "z": 1}, "children": [{"id": "Cup|surface|2|5", "position": {"x": 1, "y": 1, "z": 1}}, {"id": "Bad", "position": {"x": 0, "y": 0, "z": 0}}]},
        {"id": "Chair|2|0|2", "position": {"x": 1, "y": 0, "z": 1}}, {"id": "Chair|2|0|1", "position": {"x": 1, "y": 0, "z": 1}}, {"id": "Lost|9|1", "position": {"x": 1, "y": 0, "z": 1}}, {"id": "Sink|10|1", "position": {"x": 1, "y": 0, "z": 1}},
    ],
    "doors": [{"room0": "room|2", "room1": "room|10"}, {"room0": "room|2", "room1": "room|2"}, {"room0": "room|10", "room1": "room|2"}, {"room0": "room|1", "room1": "room|2"}],
    "walls": [{"roomId": "room|3", "polygon": [{"x": 1, "y": 0, "z": 2}, {"x": 1, "y": 3, "z": 2.0001}], "empty": True}, {"roomId": "room|10", "polygon": [{"x": 1, "y": 0, "z": 2}], "empty": True}, {"roomId": "room|2", "polygon": [{"x": 5, "y": 0, "z": 2}], "empty": False}],
}


def test_houses(spark, tmp_path):
    with gzip.open(tmp_path / "train.jsonl.gz", "wt") as f:
        f.write(json.dumps(HOUSE) + "\n" + json.dumps(HOUSE) + "\n")
    t = S.READERS["houses"](spark, str(tmp_path / "train.jsonl.gz"))
    one = {k: df.where("scene_id = 'train:1'") for k, df in t.items()}
    assert {(r["room_id"], r["room_ord"], r["x"], r["z"]) for r in one["rooms"].collect()} == {("2", 0, 3.0, 2.0), ("10", 1, 11.0, 2.0), ("3", 2, 4.0, 2.0)}
    assert [(r["object_id"], r["room_id"], r["short_id"]) for r in one["objects"].orderBy("obj_ord").collect()] == [("Table|2|0|0", "2", "1"), ("Cup|surface|2|5", "2", "2"), ("Chair|2|0|2", "2", "3"), ("Chair|2|0|1", "2", "4"), ("Sink|10|1", "10", "5")]
    assert {(r["src"], r["dst"]) for r in one["adjacency"].collect()} == {("2", "10"), ("10", "2"), ("3", "10"), ("10", "3")}
    assert [tuple(r)[2:] for r in one["relations"].orderBy("rel_ord").collect()] == [("Cup|surface|2|5", "on", "Table|2|0|0"), ("Chair|2|0|1", "arranged with", "Table|2|0|0"), ("Chair|2|0|2", "arranged with", "Table|2|0|0")]
    text = {r["representation"]: r["text"] for r in render({k: df for k, df in one.items()}, "inventory", "room_tree", "json_mini").collect()}
    assert text["inventory"].startswith("train:1 — 3 rooms, 5 objects.\nRoom types: Kitchen, Bath, Hall.\n\nKitchen [2] — contains: Chair (×2), Table, Cup.\n")
    assert text["room_tree"].endswith("Bath [10]\n|-- Kitchen [2]\n`-- Hall [3]\n")
    assert json.loads(text["json_mini"])["building"]["connectivity"] == {"2": ["10"], "10": ["2", "3"], "3": ["10"]}
    own = render_with(one, lambda s: f"{len(s['rooms'])} rooms" if s["relations"] else None).collect()
    assert [r["text"] for r in own] == ["3 rooms"]


def test_scans_and_buildings(spark, tmp_path):
    (tmp_path / "scan1").mkdir()
    seg = {"segGroups": [{"objectId": i, "label": f"l{i}", "obb": {"centroid": c, "axesLengths": [1.00005, 2, 3]}} for i, c in ((4, [0.12345, 1, 2]), (1, [0, 1]))]}
    (tmp_path / "scan1" / "semseg.v2.json").write_text(json.dumps(seg))
    (tmp_path / "o.json").write_text(json.dumps({"scans": [{"scan": "scan1", "objects": [{"id": "4", "label": "chair", "affordances": ["sit"]}, {"id": "1", "label": "", "affordances": []}]}]}))
    (tmp_path / "r.json").write_text(json.dumps({"scans": [{"scan": "scan1", "relationships": [[4, 1, 2, "left"], [4, 1, 3, "same object type"]]}]}))
    t = S.read_scans(spark, str(tmp_path / "*" / "semseg.v2.json"), str(tmp_path / "o.json"), str(tmp_path / "r.json"))
    got = [(r["object_id"], r["category"], r["position"] and r["position"]["x"], r["affordances"]) for r in t["objects"].orderBy("obj_ord").collect()]
    assert got == [("4", "chair", pytest.approx(0.1235, abs=1e-4), ["sit"]), ("1", "l1", None, None)]
    assert [tuple(r)[2:] for r in t["relations"].collect()] == [("4", "left", "1")]
    b = {"building": {"name": "B", "size": [1, 2, 3], "object_ids": [2, 0, 1, 2], "room_ids": [0, 7]}, "object": {"1": {"class_": "bed", "parent_room": 7, "material": []}, "2": {"class_": None}}, "room": {"7": {"scene_category": "bedroom", "location": [0, 1, 2], "floor_number": "A"}}}
    (tmp_path / "b.json").write_text(json.dumps(b))
    t = S.read_buildings(spark, str(tmp_path / "b.json"))
    assert [(r["object_id"], r["room_id"], r["material"]) for r in t["objects"].collect()] == [("1", "7", None)]
    assert [(r["room_id"], r["category"], r["floor"], r["x"]) for r in t["rooms"].collect()] == [("7", "bedroom", "A", 0.0)]


def test_stream(spark, tmp_path):
    log, table, mark = (str(tmp_path / d) for d in ("log", "table", "mark"))
    (tmp_path / "log").mkdir()
    line = lambda q, o, e=None, ac=0.5: json.dumps({"question_id": q, "scene_id": "procthor_1", "question_type": "route", "representation": "r", "repetition": 1, "write_order": o, "error": e, "answer_correctness": ac})
    (tmp_path / "log" / "1.json").write_text("\n".join([line("a", 1), line("b", 2, "timeout"), "corrupt"]))
    stream_results(spark, log, table, mark).awaitTermination()
    (tmp_path / "log" / "2.json").write_text("\n".join([line("b", 3), line("c", 4, "CONTEXT_EXCEEDED: x"), line("a", 5, "timeout")]))
    stream_results(spark, log, table, mark).awaitTermination()
    assert {(r["question_id"], r["write_order"]) for r in read_state(spark, table).collect()} == {("a", 5), ("b", 3), ("c", 4)}
    r = stream_coverage(spark, table).first()
    assert (r["host"], r["n"], r["error_count"], r["context_exceeded"], r["n_scored"]) == ("procthor", 3, 1, 1, 1)
    assert coverage(read_state(spark, table + "-none")).count() == 0


def test_registered_names():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert len(queries) > 90 and set(oracles) <= set(queries)
