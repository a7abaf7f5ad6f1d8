"""Mixing sources to target weights by thresholds on a hash of each document; nothing is sorted.

A source whose target is t words and whose size is s is taken floor(t / s) times whole.
The rest of its budget goes to the documents whose hash lies below a threshold: words
are summed by source and hash bucket, the bucket in which the running sum passes the
budget is found, and only that bucket is summed again in finer buckets, until one hash
is left. What the last document would have overshot is filled the same way, nested, by
the documents above the threshold that are no larger than the gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ranked

HASH_BITS, BUCKET_BITS = 60, 10
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(id_col: str, text: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), F.coalesce(F.col(text), F.lit(""))), 64 - HASH_BITS)


def _source(source: str) -> Column:
    """The source with a mark in front, so that null is a value and comes last."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("~"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), limit: float = 3.0) -> DataFrame:
    """sizes (__source, source_size) with target: all words shared by weight, none above limit times its source's size.

    Sources in code point order, null last, get the weights in turn. What a source at its
    limit leaves is shared by weight among the others until none is above. Only three sums
    a round reach the driver.
    """
    rows = ranked(sizes, "mix_ranked", F.col("__source").asc())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = cut(rows.withColumn("w", w).drop("rank"), "mix_weights")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    top, share, capped = limit * F.col("source_size"), 0.0, -1
    while True:
        full = F.col("w") * share > top
        row = rows.agg(F.count_if(full), F.sum(F.when(full, top).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        if row[0] == capped or not row[2]:
            break
        capped, share = row[0], max(0.0, (total - row[1]) / row[2])
    return rows.withColumn("target", F.least(F.col("w") * share, top)).drop("w")


def _threshold(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """budgets (__source, need) with cut (hashes below it are taken) and gap (what is left of need).

    rows: (__source, h, size). A source whose rows all fit gets the cut beyond all hashes.
    """
    state = budgets.select("__source", F.lit(0).cast("long").alias("lo"), "need")
    done = None
    active = rows
    for shift in range(HASH_BITS - BUCKET_BITS, -1, -BUCKET_BITS):
        sums = active.groupBy("__source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("s"), F.min("h").alias("least"), F.max("h").alias("most"))
        # At most 2^BUCKET_BITS rows of a source meet here, whatever its size.
        w = Window.partitionBy("__source").orderBy("b")
        sums = sums.join(state.select("__source", "need"), "__source").withColumn("sum", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        edge = sums.where(F.col("sum") > F.col("need")).withColumn("n", F.row_number().over(w)).where("n = 1")
        edge = edge.select("__source", "b", "least", "most", (F.col("need") - F.col("sum") + F.col("s")).alias("need"))
        edge = cut(edge, "mix_edge")
        single = edge.where("least = most").select("__source", F.col("least").alias("cut"), F.col("need").alias("gap"))
        done = single if done is None else done.unionByName(single)
        state = edge.where("least < most").select("__source", F.col("b").alias("lo"), "need")
        if state.isEmpty():
            break
        active = active.join(state.select("__source", "lo"), "__source").where(F.shiftright("h", shift) == F.col("lo")).drop("lo")
        active = cut(active, "mix_active")
    rest = budgets.join(done, "__source", "left")
    fits = rows.groupBy("__source").agg(F.sum("size").alias("all"))
    rest = rest.join(fits, "__source", "left").withColumn("gap", F.coalesce("gap", F.col("need") - F.coalesce("all", F.lit(0)))).drop("all")
    return rest.withColumn("cut", F.coalesce("cut", F.lit(1 << HASH_BITS).cast("long")))


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = (1.0, 2.0, 3.0), limit: float = 3.0, levels: int = 3) -> DataFrame:
    """docs with size, source_size, target, copies and taken: copies of the whole document that the mix takes, and their words.

    A null text has no words; a document without words is taken with 0 words. Hashes
    come from id and text, so repeated rows share their fate; a null id is an id like any
    other and a null source is a source. A source without words has target 0. The result
    depends on the rows alone, not on their order or partitions. An empty table gives an
    empty table. Columns of docs with the names of the new ones are replaced.
    """
    new = ["size", "source_size", "target", "copies", "taken"]
    rows = cut(docs.select(_source(source).alias("__source"), _hash(id_col, text).alias("h"), n_words(F.col(text)).alias("size")), "mix_rows")
    sizes = rows.groupBy("__source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, limit)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(limit)))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("need", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("long"))
    plan = cut(plan, "mix_plan")
    left, budgets = rows.where("size > 0"), plan.select("__source", "need")
    for level in range(levels):
        found = cut(_threshold(left, budgets), "mix_cuts").withColumnsRenamed({"cut": f"cut{level}", "need": f"need{level}"})
        plan = plan.join(found.drop("gap"), "__source")
        budgets = found.select("__source", F.col("gap").alias("need"))
        # The next level: documents at or above the cut that fit into the gap.
        above = found.select("__source", F.col(f"cut{level}").alias("cut"), "gap")
        left = left.join(above, "__source").where((F.col("h") >= F.col("cut")) & (F.col("size") <= F.col("gap"))).drop("cut", "gap")
        left = cut(left, "mix_left") if level + 1 < levels else left
    plan = cut(plan, "mix_thresholds")
    taken = F.col("__h") < F.col("cut0")
    for level in range(1, levels):
        taken = taken | ((F.col("size") <= F.col(f"need{level}")) & (F.col("__h") < F.col(f"cut{level}")))
    out = docs.drop(*[c for c in new if c not in (id_col, source, text)])
    out = out.withColumn("__h", _hash(id_col, text)).withColumn("size", n_words(F.col(text))).withColumn("__source", _source(source))
    out = out.join(plan, "__source").withColumn("copies", F.col("whole") + F.when((F.col("size") > 0) & taken, 1).otherwise(0))
    out = out.withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    return out.select(*[c for c in docs.columns if c not in new or c in (id_col, source, text)], *new)
