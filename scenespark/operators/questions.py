"""Checks of a question set: id, scene_id, text, question_type, question_style, pair_id, key_facts array<struct<fact, weight>>."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _blank(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit("")) == ""


def validate_questions(questions: DataFrame) -> DataFrame:
    """(scene_id, id, problem): one row for each broken rule."""
    core = F.coalesce(F.exists("key_facts", lambda f: F.coalesce(f["weight"], F.lit(1.0)) > 1), F.lit(False))
    empty = F.coalesce(F.size("key_facts"), F.lit(0)) <= 0
    rules = {
        "missing id": _blank("id"), "missing scene_id": _blank("scene_id"), "missing text": _blank("text"), "no key facts": empty, "no core fact": ~empty & ~core,
        "pair without style": ~_blank("pair_id") & _blank("question_style"), "style without pair": _blank("pair_id") & ~_blank("question_style"),
    }
    problems = F.filter(F.array(*[F.when(bad, name) for name, bad in rules.items()]), lambda p: p.isNotNull())
    return questions.select("scene_id", "id", F.explode(problems).alias("problem"))


def validate_pairs(questions: DataFrame) -> DataFrame:
    """(scene_id, pair_id, styles): pairs that are not one natural and one constructed question. Only for a set that no filter has cut."""
    out = questions.where(~_blank("pair_id")).groupBy("scene_id", "pair_id").agg(F.array_sort(F.collect_list(F.coalesce("question_style", F.lit("")))).alias("styles"))
    return out.where(F.col("styles") != F.array(F.lit("constructed"), F.lit("natural")))


def missing_ids(questions: DataFrame, asked: DataFrame) -> DataFrame:
    """Ids (column id) that were asked for and aren't there."""
    return asked.select("id").distinct().join(questions.select("id"), "id", "left_anti")


def pair_map(questions: DataFrame) -> DataFrame:
    """(scene_id, id, pair_id) of paired questions."""
    return questions.where(~_blank("pair_id")).select("scene_id", F.col("id").cast("string").alias("id"), "pair_id").distinct()


def select_types(questions: DataFrame, types: list[str]) -> DataFrame:
    """Questions of the listed types; none at all is an error."""
    out = questions.where(F.col("question_type").isin(types))
    if out.isEmpty():
        raise ValueError(f"no question of type {', '.join(types)}")
    return out
