"""Small vectorized helpers for texts that must match another language's number and JSON formats."""

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def py_fixed(value: Column, digits: int) -> Column:
    """A number with fixed digits, halves by the exact binary value; Spark's own formatting rounds decimal halves up."""

    @F.pandas_udf("string")
    def fixed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if pd.isna(x) else f"{x:.{digits}f}")

    return fixed(value)


def json_indented(text: Column) -> Column:
    """JSON with an indent of two spaces."""

    @F.pandas_udf("string")
    def indented(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else json.dumps(json.loads(x), indent=2, ensure_ascii=False))

    return indented(text)


def lines(df: DataFrame, section: int, text: Column, a: Column | str | int = 0, b: Column | str | int = 0, c: Column | str | int = 0) -> DataFrame:
    """Rows of a scene's text: their place is (section, a, b, c)."""
    at = lambda v: (F.lit(v) if isinstance(v, int) else F.col(v) if isinstance(v, str) else v).cast("long")
    return df.select("scene_id", F.lit(section).alias("s"), at(a).alias("a"), at(b).alias("b"), at(c).alias("c"), text.alias("line"))


def assemble(*parts: DataFrame) -> DataFrame:
    """(scene_id, text): all parts' lines in their places, trailing white space cut, one newline at the end. Null lines are left out."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    ordered = F.array_sort(F.collect_list(F.struct("s", "a", "b", "c", "line")))
    text = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    return rows.where("line IS NOT NULL").groupBy("scene_id").agg(F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n")).alias("text"))
