"""What leaves the library: aggregates, contexts, report lines, flat records; and guards after a call."""

import csv

import pytest
from pyspark.sql import functions as F

from scenespark.operators import cells as L
from scenespark.operators import geometry as M
from scenespark.operators import judging as J
from scenespark.sources import tables as S


def test_aggregates_are_sorted_with_the_total_last(spark, tmp_path):
    kinds = "host string, rep string, qt string, n long, error_count long, context_exceeded long, n_scored long, coverage double, ac_mean double, ac_std double, ac_lo double, ac_hi double, detail_mean double, detail_std double, n_detail long"
    rows = [("procthor", "b", "route", 3, 0, 1, 2, 2 / 3, 0.5, 0.25, 0.25, 0.75, None, None, 0), ("gibson", "a", "route", 1, 1, 0, 0, 0.0, None, None, None, None, None, None, 0)]
    total = [("all", "all", "operational-total", 4, 1, 1, 2, 0.5), ("x", "y", "other", 9, 9, 9, 9, 0.9)]
    S.write_aggregate(spark.createDataFrame(rows, kinds), spark.createDataFrame(total, ", ".join(kinds.split(", ")[:8])), str(tmp_path / "out"))
    lines = list(csv.reader(next((tmp_path / "out").glob("part-*.csv")).open()))
    assert lines[0] == S.AGGREGATE_COLUMNS and len(lines[0]) == 14
    assert [r[:3] for r in lines[1:]] == [["gibson", "a", "route"], ["procthor", "b", "route"], ["all", "all", "operational-total"]]
    one = dict(zip(lines[0], lines[2]))
    assert one["coverage"] == "0.6667" and one["answer_correctness_mean"] == "0.5000" and one["answer_correctness_q_range"] == "0.2500..0.7500" and one["answer_correctness_detail_mean"] == ""
    assert dict(zip(lines[0], lines[1]))["answer_correctness_q_range"] == "" and lines[3][8:] == [""] * 6


def test_contexts_are_one_folder_a_representation(spark, tmp_path):
    rows = [("s1", "inventory", "a\nb\n"), ("s2", "inventory", "ü\n"), ("s1", "json_mini", "{}")]
    path = str(tmp_path / "contexts")
    S.write_contexts(spark.createDataFrame(rows, "scene_id string, representation string, text string"), path)
    assert {p.name for p in (tmp_path / "contexts").iterdir() if p.is_dir()} == {"representation=inventory", "representation=json_mini"}
    assert {tuple(r) for r in spark.read.parquet(path).select("scene_id", "representation", "text").collect()} == set(rows)
    with pytest.raises(Exception, match="already exists"):
        S.write_contexts(spark.createDataFrame(rows, "scene_id string, representation string, text string"), path)


def test_report_lines(spark):
    df = spark.createDataFrame([("b", 2, None), ("a", 1, 0.5)], "rep string, n int, mean double")
    lines = [r["line"] for r in S.report_table(df, ["rep", "n", "mean"]).orderBy("line_no").collect()]
    assert lines == ["| rep | n | mean |", "| --- | --- | --- |", "| a | 1 | 0.5 |", "| b | 2 |  |"]


def test_guard_after_the_call(spark):
    budget = 1000 - L.RESERVED_TOKENS
    rows = [(1, budget, budget, ""), (2, budget + 1, budget, ""), (3, budget + 1, None, "timeout"), (4, None, 5, None), (5, budget + 1, budget + 1, None)]
    got = {r["id"]: (r["error"], r["drift"]) for r in L.post_call_guard(spark.createDataFrame(rows, "id int, prompt_tokens int, predicted_tokens int, error string"), 1000).collect()}
    over = f"CONTEXT_EXCEEDED: {budget + 1} tokens of {budget}"
    assert got == {1: ("", False), 2: (over, True), 3: ("timeout", False), 4: (None, False), 5: (over, False)}


def test_flat_records_have_the_columns_in_order(spark):
    names = S.RESULT_COLUMNS
    df = spark.createDataFrame([tuple(str(i) for i in range(len(names) + 1))], ", ".join(f"{c} string" for c in ["extra", *reversed(names)]))
    flat = J.flatten_record(df)
    assert flat.columns == names and len(names) == 17 and flat.first()["question_id"] == str(len(names))


def test_distance_in_three_dimensions(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 2.0, 3.0, 6.0), (1.0, None, 0.0, 0.0, 0.0, 0.0)], "a double, b double, c double, x double, y double, z double")
    assert [r[0] for r in df.select(M.distance_3d([F.col(k) for k in "abc"], [F.col(k) for k in "xyz"])).collect()] == [7.0, None]
