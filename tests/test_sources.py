"""Line numbers of houses, whatever splits their files are read in; the reader and the format agree."""

import gzip
import json

import pytest

from scenespark.sources import formats
from scenespark.sources.scenes import HOUSE_SCHEMA, normalize_houses, parse_houses, read_houses


def house(i):
    square = [{"x": float(x), "y": 0.0, "z": float(z)} for x, z in ((0, 0), (2, 0), (2, i % 5 + 1), (0, i % 5 + 1))]
    wall = {"polygon": [{"x": 0.0, "y": 0.0, "z": 0.0}, {"x": 1.0, "y": 0.0, "z": 0.0}], "empty": i % 2 == 0}
    return {
        "rooms": [{"id": f"room|{k}", "roomType": "Kitchen", "floorPolygon": square} for k in (1, 2)],
        "objects": [{"id": f"Table|1|0|{i}", "position": {"x": 1.0, "y": 0.0, "z": 1.0}, "children": [{"id": f"Cup|surface|1|{i}", "position": {"x": 1.0, "y": 1.0, "z": 1.0}}]}, {"id": "bad", "position": None}],
        "doors": [{"room0": "room|1", "room1": "room|2"}] if i % 3 else [],
        "walls": [wall | {"roomId": f"room|{k}"} for k in (1, 2)],
    }


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("houses")
    lines = [json.dumps(house(i)) for i in range(300)]
    lines[7] = "no record"
    (d / "train.jsonl").write_text("\n".join(lines) + "\n")
    with gzip.open(d / "val part.jsonl.gz", "wt") as f:
        f.write("\r\n".join(lines[:20]))
    (d / "test.jsonl").write_text("")
    return d


def test_line_numbers_of_split_files(spark, folder):
    """A plain file in many splits, packed in any order, keeps its lines' numbers."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 10_000)
        rows = read_houses(spark, str(folder / "*.jsonl*")).select("scene_id", "house.objects").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {r["scene_id"]: r["objects"][0]["id"] for r in rows}
    assert got == {f"train:{i}": f"Table|1|0|{i}" for i in range(300) if i != 7} | {f"val part:{i}": f"Table|1|0|{i}" for i in range(20) if i != 7}


@pytest.mark.parametrize("split", [40_000, 64 << 20])
def test_the_format_gives_the_same_tables(spark, folder, split):
    formats.register(spark)
    lines = spark.read.format("houses").option("split", split).load(str(folder))
    assert lines.rdd.getNumPartitions() > (5 if split == 40_000 else 1)
    one, other = normalize_houses(parse_houses(lines)), normalize_houses(read_houses(spark, str(folder / "*.jsonl*")))
    for name in one:
        assert sorted(map(str, one[name].collect())) == sorted(map(str, other[name].collect())), name
    assert one["rooms"].count() == 2 * 318


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_every_line_is_in_one_split(tmp_path, size):
    for k, text in enumerate(["", "a", "a\n", "\n", "\n\n", "ab\ncd", "ab\n\ncd\n", "x" * 20 + "\ny\n" + "z" * 9]):
        f = tmp_path / f"{k}.jsonl"
        f.write_text(text)
        reader = formats.HouseReader({"path": str(f), "split": size})
        got = [(i, v) for p in reader.partitions() for b in reader.read(p) for i, v in zip(b["scene_id"].to_pylist(), b["value"].to_pylist())]
        want = text.split("\n")
        want = want[:-1] if want[-1] == "" else want
        assert got == [(f"{k}:{i}", v) for i, v in enumerate(want)]


def test_formats_of_missing_paths(tmp_path):
    with pytest.raises(FileNotFoundError):
        formats.HouseReader({"path": str(tmp_path / "none*.jsonl")}).partitions()
    assert "rooms" in HOUSE_SCHEMA
