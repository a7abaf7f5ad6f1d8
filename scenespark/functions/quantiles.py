"""Exact quantiles of groups of any size: counts by value bucket, of which only those that hold an asked rank are refined."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut, discard

BUCKETS = 1024


def quantiles(rows: DataFrame, keys: list[str], value: str, probabilities: list[float], buckets: int = BUCKETS) -> DataFrame:
    """(keys, q): of each group the exact quantiles, in the order of `probabilities`, interpolated between neighbouring ranks as percentile() does.

    Nulls don't count; a group of nulls alone does not appear. No task gathers a group: a
    round counts the values of the ranges that are still open in `buckets` equal strips,
    and an asked rank's range becomes the least and greatest value of its strip. These
    lie in different strips of the next round, so ranges shrink until they are one value.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    counts = cut(rows.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c")), "quantile_values")
    group = counts.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("c").alias("n"))
    place = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    asked = F.explode(F.array_distinct(F.array(*[f(place(p)).cast("long") for p in probabilities for f in (F.floor, F.ceil)])))
    open_ = cut(group.select(*keys, "n", "lo", "hi", asked.alias("rank"), F.lit(0).cast("long").alias("below")), "quantile_ranges")
    found = None
    w = Window.partitionBy(*keys, "lo", "hi").orderBy("strip")
    while True:
        settled = open_.where("lo = hi").select(*keys, "n", "rank", F.col("lo").alias("v"))
        found = settled if found is None else found.unionByName(settled)
        ranges = open_.where("lo < hi").select(*keys, "lo", "hi").distinct()
        if ranges.isEmpty():
            break
        strip = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets), F.lit(buckets - 1))
        strips = counts.join(ranges, keys).where("v >= lo AND v <= hi").groupBy(*keys, "lo", "hi", strip.alias("strip")).agg(F.sum("c").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        strips = cut(strips.withColumn("before", F.sum("c").over(w) - F.col("c")), "quantile_strips")
        inside = open_.join(strips, [*keys, "lo", "hi"]).where("rank >= below + before AND rank < below + before + c")
        new = inside.select(*keys, "n", F.col("least").alias("lo"), F.col("most").alias("hi"), "rank", (F.col("below") + F.col("before")).alias("below"))
        open_ = cut(new, "quantile_ranges")
        discard(strips)
    values = found.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("m"))

    def between(p: float):
        at = place(p)
        low, high = F.floor(at), F.ceil(at)
        a, b = F.element_at("m", low.cast("long")), F.element_at("m", high.cast("long"))
        return F.when(low == high, a).otherwise((high - at) * a + (at - low) * b)

    return values.select(*keys, F.array(*[between(p) for p in probabilities]).alias("q"))
