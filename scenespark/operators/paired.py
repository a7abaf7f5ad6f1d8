"""Matched comparisons of representations, scene by scene, and what they license.

All comparisons come from one table of per-question means. For each question its
representations are gathered in one map, so any number of pairs is read by one explode
and no self-join. Everything after that is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import registry as R
from ..functions.keys import rounded, row_key
from ..functions.storage import cut
from .cells import in_scope
from .stats import CELL, RUN, cells_of, gate_reason, question_stats


def _stats(results: DataFrame, *extra: str) -> tuple[DataFrame, DataFrame]:
    """Question statistics and cells, written once: every step after them reads tables far smaller than the results."""
    questions = cut(question_stats(results, *extra), "question_stats")
    return questions, cut(cells_of(questions, *extra), "cells")


PAIR = ["axis_id", "host", "qt", "rep_a", "rep_b"]
RUNPAIR = [*RUN, *PAIR]


def declared_pairs(cells: DataFrame, axes: list[R.Axis] | None = None, *extra: str) -> DataFrame:
    """(run, extra, axis, host, qt, rep_a, rep_b) by the registry, of cells that exist.

    The first rung in scope with each later one, the headline pair, and each rung with
    the full record. cells: RUN, host, rep, qt and extra columns.
    """
    spark = cells.sparkSession
    run = [*RUN, *extra]
    have = cells.select(*run, "host", "qt", "rep").distinct()
    rungs = in_scope(R.axis_rungs(spark, axes), "rep", "qt", "host").where("in_scope").drop("in_scope")
    rungs = have.join(F.broadcast(rungs), ["host", "qt", "rep"])  # a registry of tens of rows
    ladder = rungs.groupBy(*run, "axis_id", "host", "qt").agg(F.array_sort(F.collect_list(F.struct("rung", "rep"))).alias("r"))
    later = ladder.select(*run, "axis_id", "host", "qt", F.col("r")[0]["rep"].alias("rep_a"), F.explode(F.expr("slice(r, 2, size(r))")).alias("x")).select(*run, *PAIR[:3], "rep_a", F.col("x.rep").alias("rep_b"))
    heads = R.axis_heads(spark, axes)
    for side in ("rep_a", "rep_b"):
        heads = in_scope(heads, side, "qt", "host").where("in_scope").drop("in_scope")
    heads = have.withColumnRenamed("rep", "rep_a").join(F.broadcast(heads), ["host", "qt", "rep_a"]).join(have.withColumnRenamed("rep", "rep_b"), [*run, "host", "qt", "rep_b"]).select(*run, *PAIR)
    full = have.where(F.col("rep") == R.FULL_RECORD_ANCHOR).select(*run, "host", "qt", F.col("rep").alias("rep_b"))
    full = rungs.withColumnRenamed("rep", "rep_a").join(full, [*run, "host", "qt"]).select(*run, *PAIR)
    return later.unionByName(heads).unionByName(full).where("rep_a <> rep_b").distinct()


def anchor_pairs(cells: DataFrame, anchor: str, axis_id: str) -> DataFrame:
    """Every evaluated representation in scope with the anchor, where both have cells."""
    have = cells.select(*RUN, "host", "qt", "rep").distinct()
    reps = in_scope(have.where((F.col("rep") != anchor) & ~F.col("rep").isin(R.NOT_EVALUATED)), "rep", "qt", "host").where("in_scope")
    base = have.where(F.col("rep") == anchor).select(*RUN, "host", "qt", F.col("rep").alias("rep_a"))
    return reps.withColumnRenamed("rep", "rep_b").join(base, [*RUN, "host", "qt"]).select(*RUN, F.lit(axis_id).alias("axis_id"), "host", "qt", "rep_a", "rep_b")


def question_deltas(questions: DataFrame, pairs: DataFrame, *extra: str) -> DataFrame:
    """One row for each pair and question that both representations have scored: ac_a, ac_b, tok_a, tok_b."""
    run = [*RUN, *extra]
    values = F.map_from_entries(F.collect_list(F.struct("rep", F.struct("ac_q", "tok_q")))).alias("v")
    by_q = questions.where("n_ac > 0 OR n_tok > 0").groupBy(*run, "host", "qt", "scene_id", "question_id").agg(values)
    wanted = pairs.groupBy(*run, "host", "qt").agg(F.collect_list(F.struct("axis_id", "rep_a", "rep_b")).alias("p"))
    out = by_q.join(wanted, [*run, "host", "qt"]).select(*run, "host", "qt", "scene_id", "question_id", "v", F.explode("p").alias("p"))
    side = lambda rep: F.element_at("v", F.col(rep))
    out = out.select(*run, "host", "qt", "scene_id", "question_id", "p.*", "v").withColumns({"__a": side("rep_a"), "__b": side("rep_b")})
    out = out.where(F.col("__a.ac_q").isNotNull() & F.col("__b.ac_q").isNotNull())
    return out.select(*run, *PAIR, "scene_id", "question_id", *[F.col(f"__{s}.{c}_q").alias(f"{c}_{s}") for s in "ab" for c in ("ac", "tok")])


def verdict(deltas: Column, capped: Column, ineligible: Column) -> Column:
    """The verdict on an array of scene deltas; capped: a terminology test lowers a consistent one."""
    n = F.size(deltas)
    mean = F.aggregate(deltas, F.lit(0.0), lambda a, x: a + x) / n
    sign = F.signum(mean)
    disagree = (F.array_max(deltas) >= R.PRACTICAL_MARGIN) & (F.array_min(deltas) <= -R.PRACTICAL_MARGIN)
    reverses = F.exists(deltas, lambda x: F.signum(x) == -sign)
    met = F.abs(mean) >= R.PRACTICAL_MARGIN
    showing = F.size(F.filter(deltas, lambda x: F.signum(x) == sign))
    return (
        F.when((F.coalesce(ineligible, F.lit("")) != "") | (F.coalesce(n, F.lit(0)) <= 0), R.NOT_LICENSED)
        .when(disagree, R.MIXED)
        .when(sign == 0, R.NO_SEPARATION)
        .when(reverses, F.when(met, R.MIXED).otherwise(R.NO_SEPARATION))
        .when(met & (showing >= R.MIN_SCENES_SHOWING), F.when(capped, R.DIRECTIONAL).otherwise(R.CONSISTENT))
        .otherwise(R.DIRECTIONAL)
    )


def summarise(deltas: DataFrame, cells: DataFrame, notes: bool, digits: int | None, *extra: str, axes: list[R.Axis] | None = None) -> DataFrame:
    """Pairs with scene deltas, mean, range, tokens, gates and verdict. digits: round scene deltas before the verdict, so that engines agree at the margin."""
    spark = deltas.sparkSession
    run = [*RUN, *extra]
    delta = F.col("ac_b") - F.col("ac_a")
    both = F.col("tok_a").isNotNull() & F.col("tok_b").isNotNull()
    fact = [F.collect_set("factset").alias("f")] if "factset" in deltas.columns else []
    scenes = deltas.groupBy(*run, *PAIR, "scene_id").agg(
        rounded(F.avg(delta), digits).alias("d"), F.count(F.lit(1)).alias("n_q"), F.array_sort(F.collect_list(F.struct("question_id", delta.alias("d")))).alias("q"),
        *[F.sum(F.when(both, F.col(f"tok_{s}"))).alias(f"t{s}") for s in "ab"], F.count_if(both).alias("n_t"), *fact,
    )
    entries = F.array_sort(F.collect_list(F.struct("scene_id", "d")))
    out = scenes.groupBy(*run, *PAIR).agg(
        entries.alias("e"), F.sum("n_q").alias("n_questions"), F.sum("n_t").alias("n_token_pairs"), F.sum("ta").alias("ta"), F.sum("tb").alias("tb"),
        F.array_sort(F.collect_list(F.struct("scene_id", "q"))).alias("q"), *([F.array_distinct(F.flatten(F.collect_list("f"))).alias("f")] if fact else []),
    )
    out = out.withColumn("deltas", F.transform("e", lambda x: x["d"]))
    size = F.size("deltas")
    out = out.withColumns({
        "scene_deltas": F.map_from_entries("e"), "scenes": size, "mean": F.aggregate("deltas", F.lit(0.0), lambda a, x: a + x) / size,
        "spread_lo": F.array_min("deltas"), "spread_hi": F.array_max("deltas"),
        "q_deltas": F.flatten(F.transform("q", lambda x: F.transform(x["q"], lambda y: y["d"]))),
        "tokens_a": F.when(F.col("n_token_pairs") > 0, F.col("ta") / F.col("n_token_pairs")), "tokens_b": F.when(F.col("n_token_pairs") > 0, F.col("tb") / F.col("n_token_pairs")),
        "n_factsets": F.size("f") if fact else F.lit(0),
    })
    for side in "ab":
        c = cells.select(*run, "host", "qt", F.col("rep").alias(f"rep_{side}"), F.col("n").alias("__n"), F.col("coverage").alias("__c"), F.col("rank_eligible").alias("__e"))
        out = out.join(c, [*run, "host", "qt", f"rep_{side}"], "left")
        out = out.withColumn(f"gate_{side}", gate_reason(F.col(f"rep_{side}"), F.col("__n"), F.col("__c"), F.col("__e"))).drop("__n", "__c", "__e")
    out = out.withColumn("ineligible", F.concat_ws("; ", "gate_a", "gate_b"))
    if notes:
        out = out.join(F.broadcast(R.axis_notes(spark, axes)), "axis_id", "left")
        applies = (F.col("note") != "") & ((F.size("note_reps") == 0) | F.array_contains("note_reps", F.col("rep_a")) | F.array_contains("note_reps", F.col("rep_b")))
        out = out.withColumn("terminology_note", F.when(applies, F.col("note")).otherwise("")).withColumn("pooled_forbidden", applies & (F.col("note_kind") == "vocabulary"))
    else:
        out = out.withColumns({"terminology_note": F.lit(""), "pooled_forbidden": F.lit(False)})
    noted = F.col("terminology_note") != ""
    out = out.withColumn("verdict", verdict(F.col("deltas"), noted, F.col("ineligible")))
    capped = noted & (F.col("verdict") == R.DIRECTIONAL) & (verdict(F.col("deltas"), F.lit(False), F.col("ineligible")) == R.CONSISTENT)
    order = F.array_position(F.array(*[F.lit(v) for v in R.VERDICT_ORDER]), F.col("verdict"))
    return out.withColumns({"capped": capped, "verdict_order": order}).select(
        *run, *PAIR, "scene_deltas", "scenes", "mean", "spread_lo", "spread_hi", "n_questions", "q_deltas", "verdict", "verdict_order", "terminology_note", "capped", "ineligible",
        "tokens_a", "tokens_b", "n_token_pairs", "n_factsets", "pooled_forbidden",
    )


def _factsets(deltas: DataFrame, pair_ids: DataFrame | None) -> DataFrame:
    """deltas with factset: the (scene, pair) whose wording a question is; pair_ids: (scene_id, id, pair_id)."""
    if pair_ids is None:
        return deltas
    named = pair_ids.select("scene_id", F.col("id").alias("__id"), F.concat_ws("\0", "scene_id", "pair_id").alias("factset"))
    return deltas.withColumn("__id", row_key()).join(named, ["scene_id", "__id"], "left").drop("__id")


def paired_rows(results: DataFrame, pair_ids: DataFrame | None = None, axes: list[R.Axis] | None = None, digits: int | None = None) -> DataFrame:
    """All declared comparisons by axis and probe type."""
    questions, cells = _stats(results)
    deltas = _factsets(question_deltas(questions, cut(declared_pairs(cells, axes), "pairs")), pair_ids)
    return summarise(deltas, cells, True, digits, axes=axes)


def pooled(paired: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Comparisons that the pooled table may show, and those that a terminology test keeps out of it."""
    return paired.where(~F.col("pooled_forbidden")), paired.where("pooled_forbidden")


def anchor_lifts(results: DataFrame, anchor: str, axis_id: str, digits: int | None = None) -> DataFrame:
    """Every evaluated representation in scope against one anchor, by question type and host."""
    return _lifts(*_stats(results), anchor, axis_id, digits)


def _lifts(questions: DataFrame, cells: DataFrame, anchor: str, axis_id: str, digits: int | None) -> DataFrame:
    return summarise(question_deltas(questions, anchor_pairs(cells, anchor, axis_id)), cells, False, digits)


def non_spatial_lifts(results: DataFrame, digits: int | None = None) -> DataFrame:
    return anchor_lifts(results, R.NON_SPATIAL_ANCHOR, "non_spatial_anchor", digits)


def full_record_lifts(results: DataFrame, digits: int | None = None) -> DataFrame:
    return anchor_lifts(results, R.FULL_RECORD_ANCHOR, "full_record_anchor", digits)


def structure_lift(results: DataFrame, digits: int | None = None) -> DataFrame:
    """Lifts over inventory for the question types that inventory itself cannot answer."""
    lifts = non_spatial_lifts(results, digits)
    return in_scope(lifts.withColumn("__inv", F.lit(R.NON_SPATIAL_ANCHOR)), "__inv", "qt", "host").where(~F.col("in_scope")).drop("__inv", "in_scope")


def planning_lifts(results: DataFrame, digits: int | None = None) -> DataFrame:
    """Planning comparisons: with both anchors, and licensed pairs that reuse an axis; with the role of each."""
    spark = results.sparkSession
    questions, cells = _stats(results.where(F.col("question_type") == "planning"))
    pairs = anchor_pairs(cells, R.NON_SPATIAL_ANCHOR, "non_spatial_anchor").unionByName(anchor_pairs(cells, R.FULL_RECORD_ANCHOR, "full_record_anchor"))
    fixed = spark.createDataFrame([(h, a, b, x) for h, a, b, x in R.PLANNING_PAIRS], "host string, rep_a string, rep_b string, axis_id string").withColumn("qt", F.lit("planning"))
    for side in ("rep_a", "rep_b"):
        fixed = in_scope(fixed, side, "qt", "host").where("in_scope").drop("in_scope")
        have = cells.select(*(RUN if side == "rep_a" else [*RUN, "host"]), *(["host"] if side == "rep_a" else []), F.col("rep").alias(side)).distinct()
        fixed = have.join(F.broadcast(fixed), ["host", side]) if side == "rep_a" else fixed.join(have, [*RUN, "host", side])
    pairs = pairs.unionByName(fixed.select(*RUNPAIR))
    out = summarise(question_deltas(questions, pairs), cells, False, digits)
    # The cap of an axis applies to its reuse.
    notes = R.axis_notes(spark)
    out = out.drop("terminology_note").join(F.broadcast(notes), "axis_id", "left")
    applies = F.coalesce((F.col("note") != "") & ((F.size("note_reps") == 0) | F.array_contains("note_reps", F.col("rep_a")) | F.array_contains("note_reps", F.col("rep_b"))), F.lit(False))
    out = out.withColumn("terminology_note", F.when(applies, F.col("note")).otherwise("")).withColumn("__applies", applies).drop("note", "note_reps", "note_kind")
    out = out.withColumn("verdict", F.when(F.col("__applies") & (F.col("verdict") == R.CONSISTENT), R.DIRECTIONAL).otherwise(F.col("verdict"))).drop("__applies")
    json = F.create_map(*[F.lit(x) for kv in R.JSON_AXES.items() for x in kv])
    anchored = F.col("axis_id").isin("non_spatial_anchor", "full_record_anchor")
    same = (F.col("axis_id") == "full_record_anchor") & (F.col("rep_b") == "json_pretty") & F.element_at(json, F.col("host")).isNotNull()
    axis = F.when(same, F.element_at(json, F.col("host"))).when(~anchored, F.col("axis_id"))
    return out.withColumn("role", F.when(axis.isNull(), "reference").otherwise(F.concat(F.lit("axis effect ("), axis, F.lit(")"))))


def candidate_audit(results: DataFrame, digits: int | None = None) -> DataFrame:
    """synthesis against the full record, by host and type."""
    questions, cells = _stats(results)
    have = lambda rep, name: cells.where(F.col("rep") == rep).select(*RUN, "host", "qt", F.col("rep").alias(name))
    pairs = have(R.FULL_RECORD_ANCHOR, "rep_a").join(have(R.CANDIDATE, "rep_b"), [*RUN, "host", "qt"]).withColumn("axis_id", F.lit("candidate"))
    return summarise(question_deltas(questions, pairs.select(*RUNPAIR)), cells, False, digits)


def _vocabulary_axes(axes: list[R.Axis] | None) -> list[R.Axis]:
    return [a for a in axes or R.AXES if a.note_kind == "vocabulary"]


def _tested(spark, axes: list[R.Axis]) -> DataFrame:
    """(axis_id, note_reps) of axes with a vocabulary test."""
    return R.axis_notes(spark, axes).select("axis_id", "note_reps")


def _only_tested(pairs: DataFrame, axes: list[R.Axis]) -> DataFrame:
    tested = pairs.join(F.broadcast(_tested(pairs.sparkSession, axes)), "axis_id")
    hit = (F.size("note_reps") == 0) | F.array_contains("note_reps", F.col("rep_a")) | F.array_contains("note_reps", F.col("rep_b"))
    return tested.where(hit).drop("note_reps")


def style_recut(results: DataFrame, pair_ids: DataFrame, axes: list[R.Axis] | None = None, digits: int | None = None) -> DataFrame:
    """Comparisons under a vocabulary test by question style, the test lifted and the gates recomputed; a style without questions has null figures.

    Only questions that belong to a pair count. pair_ids: (scene_id, id, pair_id).
    """
    axes = _vocabulary_axes(axes)
    rows = results.where(F.col("question_style").isin(R.STYLES)).withColumn("__id", row_key())
    rows = rows.join(pair_ids.select("scene_id", F.col("id").alias("__id")).distinct(), ["scene_id", "__id"], "left_semi").withColumnRenamed("question_style", "style")
    questions, cells = _stats(rows, "style")
    pairs = cut(_only_tested(declared_pairs(cells, axes, "style"), axes), "pairs")
    found = cut(summarise(question_deltas(questions, pairs, "style"), cells, False, digits, "style"), "style_recut")
    every = found.select(*RUNPAIR).distinct().withColumn("style", F.explode(F.array(*[F.lit(s) for s in R.STYLES])))
    return every.join(found, [*RUNPAIR, "style"], "left")


def matched_factsets(results: DataFrame, pair_ids: DataFrame, axes: list[R.Axis] | None = None, digits: int | None = None) -> DataFrame:
    """Within each pair of wordings: the delta of the constructed less that of the natural one, by scene, with a verdict."""
    axes = _vocabulary_axes(axes)
    questions = cut(question_stats(results, "question_style"), "question_stats")
    cells = cut(cells_of(questions), "cells")
    pairs = _only_tested(declared_pairs(cells, axes), axes)
    deltas = question_deltas(questions.where(F.col("question_style").isin(R.STYLES)), pairs.crossJoin(F.broadcast(pairs.sparkSession.createDataFrame([(s,) for s in R.STYLES], "question_style string"))), "question_style")
    named = pair_ids.select("scene_id", F.col("id").alias("__id"), "pair_id")
    deltas = deltas.withColumn("__id", row_key()).join(named, ["scene_id", "__id"])
    d = F.col("ac_b") - F.col("ac_a")
    sets = deltas.groupBy(*RUNPAIR, "scene_id", "pair_id").agg(*[F.max(F.when(F.col("question_style") == s, d)).alias(s) for s in R.STYLES]).where("natural IS NOT NULL AND constructed IS NOT NULL")
    by_scene = sets.groupBy(*RUNPAIR, "scene_id").agg(rounded(F.avg(F.col("constructed") - F.col("natural")), digits).alias("d"), F.avg("natural").alias("n"), F.avg("constructed").alias("c"), F.count(F.lit(1)).alias("k"))
    out = by_scene.groupBy(*RUNPAIR).agg(F.array_sort(F.collect_list(F.struct("scene_id", "d"))).alias("e"), F.avg("n").alias("d_natural"), F.avg("c").alias("d_constructed"), F.sum("k").alias("n_factsets"))
    out = out.withColumn("deltas", F.transform("e", lambda x: x["d"])).withColumn("mean", F.aggregate("deltas", F.lit(0.0), lambda a, x: a + x) / F.size("deltas"))
    for side in "ab":
        c = cells.select(*RUN, "host", "qt", F.col("rep").alias(f"rep_{side}"), F.col("n").alias("__n"), F.col("coverage").alias("__c"), F.col("rank_eligible").alias("__e"))
        out = out.join(c, [*RUN, "host", "qt", f"rep_{side}"], "left").withColumn(f"gate_{side}", gate_reason(F.col(f"rep_{side}"), F.col("__n"), F.col("__c"), F.col("__e"))).drop("__n", "__c", "__e")
    out = out.withColumn("ineligible", F.concat_ws("; ", "gate_a", "gate_b")).withColumn("verdict", verdict(F.col("deltas"), F.lit(False), F.col("ineligible")))
    return out.select(*RUNPAIR, F.map_from_entries("e").alias("scene_deltas"), "d_natural", "d_constructed", "mean", "n_factsets", "verdict", "ineligible")


def _matched_runs(paired: DataFrame, judges: DataFrame) -> DataFrame:
    """Comparisons of two models side by side: model (here), other, and whether their judges agree."""
    rows = paired.where(~F.col("pooled_forbidden")).groupBy("model", *PAIR).agg(F.first("mean").alias("mean"), F.first(F.array_sort(F.map_keys("scene_deltas"))).alias("scene_set"))
    rows = rows.join(judges.select("model", "judges"), "model")
    there = rows.select(F.col("model").alias("other"), *PAIR, F.col("mean").alias("mean_there"), F.col("scene_set").alias("set_there"), F.col("judges").alias("judges_there"))
    return rows.join(there, PAIR).where("model <> other")


def _runs(results: DataFrame, digits: int | None) -> tuple[DataFrame, DataFrame]:
    """The paired table and, by model, its judges and representations; both written, since models are compared with one another."""
    judges = results.groupBy("model").agg(F.array_sort(F.collect_set("judge")).alias("judges"), F.array_sort(F.collect_set("representation")).alias("reps"))
    return cut(paired_rows(results, digits=digits), "paired"), cut(judges, "judges")


def _checked(both: DataFrame) -> DataFrame:
    both = both.where("judges = judges_there AND scene_set = set_there")
    return both.select("model", "other", *PAIR, "mean", "mean_there", F.size("scene_set").alias("scenes"), outcome(F.col("mean"), F.col("mean_there")).alias("outcome"))


def outcome(here: Column, there: Column) -> Column:
    """How the other model orders a comparison; a mean within the margin is no separation."""
    state = lambda d: F.when(d >= R.PRACTICAL_MARGIN, 1).when(d <= -R.PRACTICAL_MARGIN, -1).otherwise(0)
    h, t = state(here), state(there)
    return (
        F.when((h != 0) & (t != 0), F.when(h == t, R.PRESERVED).otherwise(R.REVERSED))
        .when(h != 0, F.when((there >= 0) == (here >= 0), R.LEANS_SAME).otherwise(R.LEANS_OPPOSITE))
        .when(t != 0, R.ONLY_THERE).otherwise(R.NULL_BOTH)
    )


def cross_model_check(results: DataFrame, digits: int | None = None) -> DataFrame:
    """Comparisons of each two models with the same judges and the same scenes, with the outcome. The paired table is tiny: one row a model and comparison."""
    return _checked(_matched_runs(*_runs(results, digits)))


def cross_model_gaps(results: DataFrame, digits: int | None = None) -> DataFrame:
    """By two models: how many comparisons match and how they come out, how many have other scenes, which axes have no match, and the representations never run there."""
    paired, judges = _runs(results, digits)
    two = judges.select("model", "judges").join(judges.select(F.col("model").alias("other"), "judges", F.col("reps").alias("reps_there")), "judges").where("model <> other")
    both = cut(_matched_runs(paired, judges), "matched_runs")
    check = _checked(both)
    names = [R.PRESERVED, R.REVERSED, R.LEANS_SAME, R.LEANS_OPPOSITE, R.ONLY_THERE, R.NULL_BOTH]
    tally = check.groupBy("model", "other").agg(F.count(F.lit(1)).alias("matched"), *[F.count_if(F.col("outcome") == n).alias(k) for n, k in zip(names, ("preserved", "reversed", "leans_same", "leans_opposite", "only_there", "neither"))], F.collect_set("axis_id").alias("axes_matched"))
    mism = both.where("judges = judges_there AND scene_set <> set_there").groupBy("model", "other").agg(F.count(F.lit(1)).alias("mismatched"))
    here = paired.where(~F.col("pooled_forbidden")).select("model", *PAIR).distinct()
    lost = two.join(here, "model").join(here.withColumnRenamed("model", "other"), ["other", *PAIR], "left_anti")
    absent = F.filter(F.array("rep_a", "rep_b"), lambda r: ~F.array_contains("reps_there", r))
    lost = lost.groupBy("model", "other").agg(F.array_sort(F.collect_set("axis_id")).alias("axes_lost"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(absent)))).alias("reps_missing"))
    out = two.select("model", "other").join(tally, ["model", "other"], "left").join(mism, ["model", "other"], "left").join(lost, ["model", "other"], "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("axes_uncovered", F.array_sort(F.array_except(F.coalesce("axes_lost", none), F.coalesce("axes_matched", none)))).withColumn("reps_missing", F.coalesce("reps_missing", none))
    return out.drop("axes_lost", "axes_matched").fillna(0)


def axis_cards(results: DataFrame, digits: int | None = None) -> DataFrame:
    """By axis and probe type: anchors and ladder in order with their cells and lift over inventory; only where two or more have cells."""
    spark = results.sparkSession
    questions, cells = _stats(results)
    rungs = in_scope(R.axis_rungs(spark), "rep", "qt", "host").where("in_scope").select("axis_id", "host", "qt", "rung", "rep")
    ends = rungs.select("axis_id", "host", "qt").distinct()
    ends = ends.select("*", F.lit(-1).alias("rung"), F.lit(R.NON_SPATIAL_ANCHOR).alias("rep")).unionByName(ends.select("*", F.lit(999).alias("rung"), F.lit(R.FULL_RECORD_ANCHOR).alias("rep")))
    rows = cells.join(F.broadcast(rungs.unionByName(ends)), ["host", "qt", "rep"])
    shown = rows.groupBy(*RUN, "axis_id", "qt").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").drop("k")
    lifts = _lifts(questions, cells, R.NON_SPATIAL_ANCHOR, "non_spatial_anchor", digits).select(*RUN, "host", "qt", F.col("rep_b").alias("rep"), F.col("mean").alias("lift"), F.col("verdict").alias("lift_verdict"))
    out = rows.join(shown, [*RUN, "axis_id", "qt"], "left_semi").join(lifts, [*RUN, "host", "qt", "rep"], "left")
    own = (F.col("rep") == R.NON_SPATIAL_ANCHOR) & (F.col("n_scored") > 0)
    lift = F.when(own, 0.0).when(F.col("lift_verdict") != R.NOT_LICENSED, F.col("lift"))
    return out.select(*RUN, "axis_id", "host", "qt", "rung", "rep", "n", "coverage", "ac_mean", "ac_lo", "ac_hi", lift.alias("lift"))
