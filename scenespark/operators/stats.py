"""From result rows to cells. Everything starts from one wide aggregate: counters and sums by question.

Result rows have model, judge, question_id, scene_id, representation, question_type,
prompt_tokens, answer_correctness, answer_correctness_detail, latency_ms and error. The
wide texts of a log are never among the columns read. Every statistic below that first
groupBy works on a table smaller by the number of repetitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import registry as R
from ..functions.keys import host_of, is_exceeded, is_ok, question_type, tokens
from ..functions.quantiles import quantiles
from ..functions.storage import cut
from .cells import in_scope

RUN = ["model", "judge"]
CELL = [*RUN, "host", "rep", "qt"]


def _mean(total: str, n: str) -> Column:
    return F.when(F.col(n) > 0, F.col(total) / F.col(n))


def question_stats(results: DataFrame, *extra: str) -> DataFrame:
    """One row by model, judge, host, rep, qt, scene and question (and extra columns): counters, and means over repetitions."""
    ok = is_ok()
    ac, detail, tok, ms = (F.when(ok, c.cast("double")) for c in (F.col("answer_correctness"), F.col("answer_correctness_detail"), tokens(), F.nullif(F.col("latency_ms"), F.lit(0))))
    keys = [*[F.col(c) for c in RUN], host_of("scene_id").alias("host"), F.col("representation").alias("rep"), question_type().alias("qt"), "scene_id", "question_id", *extra]
    out = results.select(*keys, ok.alias("ok"), is_exceeded().alias("over"), ac.alias("ac"), detail.alias("detail"), tok.alias("tok"), ms.alias("ms"))
    out = out.groupBy(*CELL, "scene_id", "question_id", *extra).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok") & ~F.col("over")).alias("error_count"), F.count_if("over").alias("context_exceeded"),
        *[f(c).alias(f"{name}_{c}") for c in ("ac", "detail", "tok", "ms") for name, f in (("n", F.count), ("sum", F.sum))],
    )
    return out.withColumns({f"{c}_q": _mean(f"sum_{c}", f"n_{c}") for c in ("ac", "detail", "tok", "ms")})


def aggregate_groups(results: DataFrame) -> DataFrame:
    """Counts, coverage, and mean, population sd and range over per-question means, by (model, judge, host, rep, qt)."""
    out = question_stats(results).groupBy(*CELL).agg(
        *[F.sum(c).alias(c) for c in ("n", "error_count", "context_exceeded")], F.sum("n_ac").alias("n_scored"), F.count("ac_q").alias("__n"),
        F.avg("ac_q").alias("ac_mean"), F.stddev_pop("ac_q").alias("ac_std"), F.min("ac_q").alias("lo"), F.max("ac_q").alias("hi"),
        F.avg("detail_q").alias("detail_mean"), F.stddev_pop("detail_q").alias("detail_std"), F.count("detail_q").alias("n_detail"),
    )
    out = out.withColumn("coverage", F.col("n_scored") / F.col("n"))
    return out.withColumns({"ac_lo": F.when(F.col("__n") > 1, F.col("lo")), "ac_hi": F.when(F.col("__n") > 1, F.col("hi"))}).drop("__n", "lo", "hi")


def operational_total(results: DataFrame) -> DataFrame:
    """Counts by (model, judge, host, rep, qt) and one row for all, by one aggregate with grouping sets; no quality columns."""
    return results.sparkSession.sql("""
        SELECT coalesce(model, 'ALL') AS model, coalesce(judge, 'ALL') AS judge, coalesce(host, 'ALL') AS host, coalesce(rep, 'ALL') AS rep,
               CASE WHEN grouping_id() = 0 THEN qt ELSE 'operational-total' END AS qt,
               sum(n) AS n, sum(error_count) AS error_count, sum(context_exceeded) AS context_exceeded, sum(n_ac) AS n_scored, sum(n_ac) / sum(n) AS coverage
        FROM {counts} GROUP BY GROUPING SETS ((model, judge, host, rep, qt), ())""", counts=question_stats(results))


def cells_of(questions: DataFrame, *extra: str) -> DataFrame:
    """Cells from question_stats rows: means over questions for correctness, over rows for detail and tokens; and the reporting gate."""
    out = questions.groupBy(*CELL, *extra).agg(
        *[F.sum(c).alias(c) for c in ("n", "error_count", "context_exceeded")], F.sum("n_ac").alias("n_scored"),
        F.coalesce(F.avg("ac_q"), F.lit(0.0)).alias("ac_mean"), F.coalesce(F.min("ac_q"), F.lit(0.0)).alias("ac_lo"), F.coalesce(F.max("ac_q"), F.lit(0.0)).alias("ac_hi"),
        F.sum("sum_tok").alias("__st"), F.sum("n_tok").alias("__nt"), F.sum("sum_detail").alias("__sd"), F.sum("n_detail").alias("n_detail"),
    )
    out = out.withColumns({"coverage": F.col("n_scored") / F.col("n"), "tokens_mean": _mean("__st", "__nt"), "detail_mean": _mean("__sd", "n_detail")})
    return out.drop("__st", "__nt", "__sd").withColumn("rank_eligible", rank_eligible())


def cells(results: DataFrame) -> DataFrame:
    return cells_of(question_stats(results))


def rank_eligible() -> Column:
    return (F.col("n") >= R.MIN_OBSERVATIONS) & (F.col("n_scored") > 0) & (F.col("coverage") >= R.MIN_COVERAGE)


def gate_reason(rep: Column, n: Column, coverage: Column, eligible: Column) -> Column:
    """Why a cell fails the gate; null where it passes or is missing."""
    short = F.concat(rep, F.lit(" n="), n.cast("string"), F.lit(f" (< {R.MIN_OBSERVATIONS})"))
    return F.when(~eligible, F.when(n < R.MIN_OBSERVATIONS, short).otherwise(F.concat(rep, F.lit(" coverage "), F.rint(coverage * 100).cast("int").cast("string"), F.lit("%"))))


def small_n_register(results: DataFrame) -> DataFrame:
    return cells(results).where((F.col("n") > 0) & (F.col("n") < R.MIN_OBSERVATIONS) & ~F.col("rep").isin(R.NOT_EVALUATED))


def coverage_table(results: DataFrame) -> DataFrame:
    """Cells with overflow, or of the object-relation types."""
    kinds = ["object_relation", "relation_structure", "relation_aggregate"]
    return cells(results).where(((F.col("context_exceeded") > 0) | F.col("qt").isin(kinds)) & ~F.col("rep").isin(R.NOT_EVALUATED))


def detail_table(results: DataFrame) -> DataFrame:
    return cells(results).where((F.col("n_detail") > 0) & ~F.col("rep").isin(R.NOT_EVALUATED)).select(*CELL, "n_detail", "detail_mean")


def pooled_groups(results: DataFrame, allow_partial: bool = False) -> DataFrame:
    """(model, judge, group, scenes, partial): all and each host; a host with few scenes is partial and makes all partial."""
    scenes = results.select(*RUN, host_of("scene_id").alias("host"), "scene_id").distinct()
    by_host = scenes.groupBy(*RUN, "host").agg(F.count(F.lit(1)).alias("scenes"))
    by_host = by_host.withColumn("partial", F.col("scenes") < R.MIN_SCENES_A_HOST)
    out = by_host.select(*RUN, F.explode(F.array(F.lit("all"), F.col("host"))).alias("group"), "scenes", "partial")
    out = out.groupBy(*RUN, "group").agg(F.sum("scenes").alias("scenes"), F.bool_or("partial").alias("partial"))
    return out if allow_partial else out.where(~F.col("partial"))


def unregistered_scenes(results: DataFrame, registered: DataFrame) -> DataFrame:
    """Pooled scenes that the registry (scene_id) doesn't know."""
    return results.select("scene_id").distinct().join(registered.select("scene_id"), "scene_id", "left_anti")


def question_points(results: DataFrame) -> DataFrame:
    """One mean correctness by (model, judge, host, qt, rep, question) over scored rows."""
    return question_stats(results).where("n_ac > 0").select(*CELL, "question_id", F.col("ac_q").alias("ac"))


def _admitted(df: DataFrame) -> DataFrame:
    """Evaluated representations in scope; inventory always."""
    return in_scope(df.where(~F.col("rep").isin(R.NOT_EVALUATED)), "rep", "qt", "host").where(F.col("in_scope") | (F.col("rep") == R.NON_SPATIAL_ANCHOR)).drop("in_scope")


def ac_by_type(results: DataFrame) -> DataFrame:
    """Mean correctness by cell with one population sd to each side, clipped to [0, 1]."""
    out = _admitted(question_points(results)).groupBy(*CELL).agg(F.avg("ac").alias("mean"), F.coalesce(F.stddev_pop("ac"), F.lit(0.0)).alias("sd"), F.count(F.lit(1)).alias("n_q"))
    return out.withColumns({"lo": F.greatest(F.lit(0.0), F.col("mean") - F.col("sd")), "hi": F.least(F.lit(1.0), F.col("mean") + F.col("sd"))})


def ac_matrix(results: DataFrame) -> DataFrame:
    """Representations by question types: mean correctness, one column a type, in registry order."""
    types = sorted({t[0] for t in R.TYPE_NEEDS})
    out = _admitted(question_points(results)).groupBy(*RUN, "host", "rep").pivot("qt", types).agg(F.avg("ac"))
    return with_registry_order(out)


def with_registry_order(df: DataFrame, rep: str = "rep") -> DataFrame:
    """block and rank of each representation: by role and ladder, never by result. Unknown names are poles after the ladder."""
    order = R.registry_order(df.sparkSession).withColumnRenamed("rep", rep)
    return df.join(F.broadcast(order), rep, "left").withColumns({"block": F.coalesce("block", F.lit(1)), "rank": F.coalesce("rank", F.lit(len(R.REP_CAPS)))})


def cost_quality(results: DataFrame) -> DataFrame:
    """Mean correctness and mean tokens over the questions that have both, for evaluated representations in scope."""
    both = question_stats(results).where((F.col("n_ac") > 0) & (F.col("n_tok") > 0) & ~F.col("rep").isin(R.NOT_EVALUATED))
    both = in_scope(both, "rep", "qt", "host").where("in_scope")
    return both.groupBy(*CELL).agg(F.avg("ac_q").alias("ac"), F.avg("tok_q").alias("tokens"), F.count(F.lit(1)).alias("n_q"))


def latency_profile(results: DataFrame) -> DataFrame:
    """Quartiles of per-question mean seconds by representation, whiskers at 1.5 interquartile ranges, and outliers beyond.

    Quartiles are exact and come from histograms, so no task holds a representation's questions.
    """
    per_q = question_stats(results).where("n_ms > 0").groupBy(*RUN, "rep", "question_id").agg((F.sum("sum_ms") / F.sum("n_ms") / 1000).alias("s"))
    per_q = cut(per_q, "latencies")
    box = quantiles(per_q, [*RUN, "rep"], "s", [0.25, 0.5, 0.75]).select(*RUN, "rep", *[F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("s") >= F.col("q1") - reach) & (F.col("s") <= F.col("q3") + reach)
    return per_q.join(box, [*RUN, "rep"]).groupBy(*RUN, "rep", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("s"))).alias("whisker_lo"), F.max(F.when(inside, F.col("s"))).alias("whisker_hi"), F.count_if(~inside).alias("outliers"), F.count(F.lit(1)).alias("n_q")
    )
