"""The adapters keep every row of the tables that they are made from."""

import pytest

from scenespark.plans.adapters import shape


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    tables = {
        "customer": ([(i, i % 3, "BUILDING") for i in range(1, 1701)], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "conversations": ([(i, 0, f"{i} " + "word " * 100 + "end") for i in range(6)], "conv_id long, turn int, text string"),
        "benchmark": ([(i, "One two three. And the rest.") for i in range(6)], "item_id long, text string"),
        "lineitem": ([(i, n, i % 7, i * n, 1.0) for i in range(1, 1701) for n in range(1, 8)], "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_extendedprice double"),
        "orders": ([(i, i, "1-URGENT") for i in range(1, 1701)], "o_orderkey long, o_custkey long, o_orderpriority string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def test_every_customer_is_a_room(spark, sf_dir):
    rooms = [tuple(r) for r in shape(spark, sf_dir, "rooms").select("scene_id", "room_id", "room_ord").collect()]
    assert sorted(int(r[1]) for r in rooms) == list(range(1, 1701)) and len({r[0] for r in rooms}) == 9
    assert len({(r[0], r[2]) for r in rooms}) == 1700 and max(r[2] for r in rooms) == 249
    assert shape(spark, sf_dir, "objects").count() == 1700
    doors = {r["src"] for r in shape(spark, sf_dir, "adjacency").select("src").collect()}
    assert len(doors & {r[1] for r in rooms if r[2] >= 30}) > 1000


def test_every_line_item_is_a_relation(spark, sf_dir):
    relations = shape(spark, sf_dir, "relations")
    assert relations.count() == 7 * 1700 == relations.select("scene_id", "rel_ord").distinct().count()


def test_texts_are_whole(spark, sf_dir):
    judged = {r["conv_id"]: r["text"] for r in shape(spark, sf_dir, "judged").collect()}
    assert all(t.replace("<think>", "").replace("</think>  ", "").strip() == f"{i} " + "word " * 100 + "end" for i, t in judged.items())
    assert {r["text"] for r in shape(spark, sf_dir, "questions").collect()} == {"One two three. And the rest."}
