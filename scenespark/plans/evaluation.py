"""Queries over result rows: cells, statistics, paired comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import registry as R
from ..operators import paired as P
from ..operators import stats as S
from .adapters import ctes, shape
from .common import DIGITS, final, r9, scope_cte, values

_RUN = "model, judge"
_KEY = "model, judge, host, rep, qt"


def _results(spark: SparkSession, d: str) -> DataFrame:
    return shape(spark, d, "results")


# ---- SQL blocks -------------------------------------------------------------------
_HOST = "CASE WHEN lower(scene_id) LIKE 'procthor%' THEN 'procthor' WHEN lower(scene_id) LIKE '3rscan%' THEN '3rscan' ELSE 'gibson' END"


def _pq(source: str = "results", extra: str = "", where: str = "TRUE") -> str:
    """Question statistics."""
    x = f", {extra}" if extra else ""
    return f"""pr AS (SELECT model, judge, {_HOST} AS host, representation AS rep, CASE WHEN coalesce(question_type, '') = '' THEN 'unknown' ELSE question_type END AS qt, scene_id, question_id{x},
    error = '' AS ok, error LIKE 'CONTEXT_EXCEEDED%' AS over, CASE WHEN error = '' THEN answer_correctness END AS ac, CASE WHEN error = '' THEN answer_correctness_detail END AS det,
    CASE WHEN error = '' AND prompt_tokens NOT IN ('', '0') THEN try_cast(prompt_tokens AS DOUBLE) END AS tok, CASE WHEN error = '' AND latency_ms <> 0 THEN latency_ms END AS ms FROM {source} WHERE {where}),
pq AS (SELECT {_KEY}, scene_id, question_id{x}, count(*) AS n, count_if(NOT ok AND NOT over) AS error_count, count_if(over) AS context_exceeded, count(ac) AS n_ac, avg(ac) AS ac_q, count(det) AS n_det, sum(det) AS sum_det, avg(det) AS det_q,
    count(tok) AS n_tok, sum(tok) AS sum_tok, avg(tok) AS tok_q, count(ms) AS n_ms, sum(ms) AS sum_ms FROM pr GROUP BY ALL)"""


def _cells(extra: str = "") -> str:
    x = f", {extra}" if extra else ""
    return f"""cells AS (SELECT *, n >= 6 AND n_scored > 0 AND coverage >= 8e-1 AS rank_eligible FROM (
    SELECT {_KEY}{x}, sum(n) AS n, sum(error_count) AS error_count, sum(context_exceeded) AS context_exceeded, sum(n_ac) AS n_scored, coalesce(avg(ac_q), 0) AS ac_mean, coalesce(min(ac_q), 0) AS ac_lo, coalesce(max(ac_q), 0) AS ac_hi,
           sum(n_ac) / sum(n) AS coverage, CASE WHEN sum(n_tok) > 0 THEN sum(sum_tok) / sum(n_tok) END AS tokens_mean, CASE WHEN sum(n_det) > 0 THEN sum(sum_det) / sum(n_det) END AS detail_mean, sum(n_det) AS n_detail
    FROM pq GROUP BY ALL))"""


def _declared(extra: str = "", axes: list[R.Axis] | None = None) -> str:
    from .common import fits

    x = f", {extra}" if extra else ""
    axes = axes or R.AXES
    rungs = [(a.id, a.host, qt, i, r) for a in axes for qt in a.probes for i, r in enumerate(a.ladder) if r not in (R.NON_SPATIAL_ANCHOR, R.FULL_RECORD_ANCHOR) and fits(r, qt, a.host)]
    heads = [(a.id, a.host, qt, *a.headline) for a in axes if a.headline for qt in a.probes if all(fits(r, qt, a.host) for r in a.headline)]
    run = f"{_RUN}{x}"
    on = " AND ".join(f"a.{c} = b.{c}" for c in [*run.split(", "), "host", "qt"])
    a_run = ", ".join(f"a.{c}" for c in run.split(", "))
    return f"""{values(rungs, "rungs", "axis_id, host, qt, rung, rep")},
{values(heads, "heads", "axis_id, host, qt, rep_a, rep_b")},
have AS (SELECT DISTINCT {run}, host, qt, rep FROM cells),
lad AS (SELECT {run}, axis_id, host, qt, rung, rep, row_number() OVER (PARTITION BY {run}, axis_id, qt ORDER BY rung) AS k FROM have JOIN rungs USING (host, qt, rep)),
pairs AS (SELECT DISTINCT * FROM (
    SELECT {a_run}, a.axis_id, a.host, a.qt, a.rep AS rep_a, b.rep AS rep_b FROM lad a JOIN lad b ON {on} AND a.axis_id = b.axis_id AND a.k = 1 AND b.k > 1
    UNION ALL SELECT {a_run}, h.axis_id, a.host, a.qt, h.rep_a, h.rep_b FROM heads h JOIN have a ON a.host = h.host AND a.qt = h.qt AND a.rep = h.rep_a JOIN have b ON {on} AND b.rep = h.rep_b
    UNION ALL SELECT {a_run}, a.axis_id, a.host, a.qt, a.rep, b.rep FROM lad a JOIN have b ON {on} AND b.rep = 'json_mini'))"""


_V = f"""CASE WHEN ineligible <> '' THEN '{R.NOT_LICENSED}' WHEN list_max(ds) >= 1e-1 AND list_min(ds) <= -1e-1 THEN '{R.MIXED}' WHEN mean = 0 THEN '{R.NO_SEPARATION}'
    WHEN len(list_filter(ds, lambda v: sign(v) = -sign(mean))) > 0 THEN CASE WHEN abs(mean) >= 1e-1 THEN '{R.MIXED}' ELSE '{R.NO_SEPARATION}' END
    WHEN abs(mean) >= 1e-1 AND len(list_filter(ds, lambda v: sign(v) = sign(mean))) >= 2 THEN {{consistent}} ELSE '{R.DIRECTIONAL}' END"""


def _gate(side: str) -> str:
    c = f"c{side}"
    return f"CASE WHEN NOT {c}.rank_eligible THEN CASE WHEN {c}.n < 6 THEN rep_{side} || ' n=' || CAST({c}.n AS VARCHAR) || ' (< 6)' ELSE rep_{side} || ' coverage ' || CAST(CAST(round_even({c}.coverage * 100, 0) AS INT) AS VARCHAR) || '%' END END"


def _summary(extra: str = "", note: str = "FALSE") -> str:
    """From pairs, pq and cells to `paired`."""
    run = [*_RUN.split(", "), *([extra] if extra else [])]
    pair = ", ".join([*run, "axis_id, host, qt, rep_a, rep_b"])
    eq = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in [*run, "host", "qt"])
    return f"""deltas AS (SELECT {", ".join("p." + c for c in run)}, p.axis_id, p.host, p.qt, p.rep_a, p.rep_b, a.scene_id, a.question_id, b.ac_q - a.ac_q AS d, a.tok_q AS ta, b.tok_q AS tb
    FROM pairs p JOIN pq a ON {eq("p", "a")} AND a.rep = p.rep_a AND a.ac_q IS NOT NULL JOIN pq b ON {eq("p", "b")} AND b.rep = p.rep_b AND b.question_id = a.question_id AND b.scene_id = a.scene_id AND b.ac_q IS NOT NULL),
sc AS (SELECT {pair}, scene_id, {r9("avg(d)")} AS d, count(*) AS n_q, count_if(ta IS NOT NULL AND tb IS NOT NULL) AS n_t, sum(CASE WHEN tb IS NOT NULL THEN ta END) AS ta, sum(CASE WHEN ta IS NOT NULL THEN tb END) AS tb FROM deltas GROUP BY ALL),
pa AS (SELECT {pair}, list(d ORDER BY scene_id) AS ds, avg(d) AS mean0, count(*) AS scenes, sum(n_q) AS n_questions, sum(n_t) AS n_token_pairs, sum(ta) AS ta, sum(tb) AS tb, string_agg(scene_id, ',' ORDER BY scene_id) AS scene_set FROM sc GROUP BY ALL),
pb AS (SELECT pa.*, list_sum(ds) / len(ds) AS mean, concat_ws('; ', {_gate("a")}, {_gate("b")}) AS ineligible, {note} AS noted
    FROM pa LEFT JOIN cells ca ON {eq("pa", "ca")} AND ca.rep = rep_a LEFT JOIN cells cb ON {eq("pa", "cb")} AND cb.rep = rep_b),
paired AS (SELECT *, {_V.format(consistent=f"CASE WHEN noted THEN '{R.DIRECTIONAL}' ELSE '{R.CONSISTENT}' END")} AS verdict, {_V.format(consistent=f"'{R.CONSISTENT}'")} AS free_verdict FROM pb)"""


_NOTED = "(axis_id = 'structure' AND 'graph_digest' IN (rep_a, rep_b)) OR (axis_id = 'relation_linearization' AND 'relations_digest' IN (rep_a, rep_b))"
_PAIRED_COLUMNS = ["model", "judge", "axis_id", "host", "qt", "rep_a", "rep_b", "scenes", "mean", "spread_lo", "spread_hi", "n_questions", "verdict", "capped", "ineligible", "tokens_a", "tokens_b", "n_token_pairs", "deltas"]
_PAIRED_SELECT = f"""model, judge, axis_id, host, qt, rep_a, rep_b, CAST(scenes AS INT) AS scenes, {r9("mean")} AS mean, {r9("list_min(ds)")} AS spread_lo, {r9("list_max(ds)")} AS spread_hi, CAST(n_questions AS BIGINT) AS n_questions, verdict,
    noted AND verdict = '{R.DIRECTIONAL}' AND free_verdict = '{R.CONSISTENT}' AS capped, ineligible, CASE WHEN n_token_pairs > 0 THEN {r9("ta / n_token_pairs")} END AS tokens_a, CASE WHEN n_token_pairs > 0 THEN {r9("tb / n_token_pairs")} END AS tokens_b,
    CAST(n_token_pairs AS BIGINT) AS n_token_pairs, array_to_string(list_transform(ds, lambda x: CAST(CAST(round(x * 1e9) AS BIGINT) AS VARCHAR)), ',') AS deltas"""


def _shown(df: DataFrame, *extra: str) -> DataFrame:
    """A paired table as compared: scene deltas as text, in order of scenes."""
    entries = F.array_sort(F.map_entries("scene_deltas"))
    text = F.array_join(F.transform(entries, lambda e: F.round(e["value"] * 1e9).cast("long").cast("string")), ",")
    return final(df.withColumn("deltas", text), *_PAIRED_COLUMNS, *extra)


def _anchor_cte(anchor: str, axis: str) -> str:
    return f"""{scope_cte()},
pairs AS (SELECT a.model, a.judge, '{axis}' AS axis_id, a.host, a.qt, a.rep AS rep_a, b.rep AS rep_b FROM (SELECT * FROM cells WHERE rep = '{anchor}') a JOIN cells b ON a.model = b.model AND a.judge = b.judge AND a.host = b.host AND a.qt = b.qt
    JOIN scope s ON s.rep = b.rep AND s.qt = b.qt AND s.host = b.host WHERE b.rep <> '{anchor}' AND b.rep NOT IN ('prose', 'synthesis', 'metric_relations'))"""


# ---- queries ----------------------------------------------------------------------
_GROUPS = ["model", "judge", "host", "rep", "qt", "n", "error_count", "context_exceeded", "n_scored", "coverage", "ac_mean", "ac_std", "ac_lo", "ac_hi", "detail_mean", "detail_std", "n_detail"]
_CELLS = ["model", "judge", "host", "rep", "qt", "n", "error_count", "context_exceeded", "n_scored", "coverage", "ac_mean", "ac_lo", "ac_hi", "tokens_mean", "detail_mean", "n_detail", "rank_eligible"]
_CELLS_SQL = f"""{_KEY}, CAST(n AS BIGINT) AS n, CAST(error_count AS BIGINT) AS error_count, CAST(context_exceeded AS BIGINT) AS context_exceeded, CAST(n_scored AS BIGINT) AS n_scored, {r9("coverage")} AS coverage, {r9("ac_mean")} AS ac_mean, {r9("ac_lo")} AS ac_lo, {r9("ac_hi")} AS ac_hi,
    {r9("tokens_mean")} AS tokens_mean, {r9("detail_mean")} AS detail_mean, CAST(n_detail AS BIGINT) AS n_detail, rank_eligible"""
_EVALUATED = "rep NOT IN ('prose', 'synthesis', 'metric_relations')"
_TYPES = sorted({q for q, *_ in R.TYPE_NEEDS})


def _pair_ids(spark: SparkSession, d: str) -> DataFrame:
    return shape(spark, d, "pairs")


QUERIES = {
    "aggregate_groups": lambda s, d: final(S.aggregate_groups(_results(s, d)), *_GROUPS),
    "operational_total": lambda s, d: final(S.operational_total(_results(s, d))),
    "cells": lambda s, d: final(S.cells(_results(s, d)), *_CELLS),
    "small_n_register": lambda s, d: final(S.small_n_register(shape(s, d, "coverage_results")), *_CELLS),
    "coverage_table": lambda s, d: final(S.coverage_table(shape(s, d, "coverage_results")), *_CELLS),
    "detail_table": lambda s, d: final(S.detail_table(_results(s, d))),
    "question_points": lambda s, d: final(S.question_points(_results(s, d))),
    "ac_by_type": lambda s, d: final(S.ac_by_type(_results(s, d))),
    "ac_matrix": lambda s, d: final(S.ac_matrix(_results(s, d)), "model", "judge", "host", "rep", *_TYPES),
    "cost_quality": lambda s, d: final(S.cost_quality(_results(s, d))),
    "latency_profile": lambda s, d: final(S.latency_profile(_results(s, d))),
    "pooled_groups": lambda s, d: S.pooled_groups(_results(s, d), allow_partial=True),
    "unregistered_scenes": lambda s, d: S.unregistered_scenes(_results(s, d), _results(s, d).where("repetition = 1 AND answer_correctness > 0.9").select("scene_id").distinct()),
    "paired_rows": lambda s, d: _shown(P.paired_rows(_results(s, d), digits=DIGITS), "terminology_note", "pooled_forbidden"),
    "paired_factsets": lambda s, d: P.paired_rows(_results(s, d), _pair_ids(s, d), digits=DIGITS).select(*P.RUNPAIR, "n_factsets"),
    "pooled_paired": lambda s, d: P.pooled(P.paired_rows(_results(s, d), digits=DIGITS))[0].groupBy("axis_id", "verdict", "verdict_order").count(),
    "axis_cards": lambda s, d: final(P.axis_cards(_results(s, d), DIGITS)),
    "non_spatial_lifts": lambda s, d: _shown(P.non_spatial_lifts(_results(s, d), DIGITS)),
    "full_record_lifts": lambda s, d: _shown(P.full_record_lifts(_results(s, d), DIGITS)),
    "structure_lift": lambda s, d: _shown(P.structure_lift(_results(s, d), DIGITS)),
    "planning_lifts": lambda s, d: _shown(P.planning_lifts(_results(s, d), DIGITS), "role"),
    "candidate_audit": lambda s, d: _shown(P.candidate_audit(_results(s, d), DIGITS)),
    "style_recut": lambda s, d: final(P.style_recut(_results(s, d), _pair_ids(s, d), digits=DIGITS), *P.RUNPAIR, "style", "mean", "n_questions", "verdict", "ineligible"),
    "matched_factsets": lambda s, d: final(P.matched_factsets(_results(s, d), _pair_ids(s, d), digits=DIGITS).drop("scene_deltas")),
    "cross_model_check": lambda s, d: final(P.cross_model_check(_results(s, d), DIGITS)),
    "cross_model_gaps": lambda s, d: P.cross_model_gaps(_results(s, d), DIGITS).withColumns({c: F.array_join(c, ",") for c in ("axes_uncovered", "reps_missing")}),
}

_R = f"WITH {ctes('results')},\n"
_C = f"WITH {ctes('coverage_results')},\n"
_RP = f"WITH {ctes('results', 'pairs')},\n"
_VOCABULARY = [a for a in R.AXES if a.note_kind == "vocabulary"]
_OUTCOME = f"""CASE WHEN h <> 0 AND t <> 0 THEN CASE WHEN h = t THEN '{R.PRESERVED}' ELSE '{R.REVERSED}' END
    WHEN h <> 0 THEN CASE WHEN (mean_there >= 0) = (mean >= 0) THEN '{R.LEANS_SAME}' ELSE '{R.LEANS_OPPOSITE}' END WHEN t <> 0 THEN '{R.ONLY_THERE}' ELSE '{R.NULL_BOTH}' END"""
_STATE = "CASE WHEN {0} >= 1e-1 THEN 1 WHEN {0} <= -1e-1 THEN -1 ELSE 0 END"
_CHECK = f"""two AS (SELECT a.model, b.model AS other, a.axis_id, a.host, a.qt, a.rep_a, a.rep_b, a.mean, b.mean AS mean_there, a.scenes, a.scene_set, b.scene_set AS set_there
    FROM paired a JOIN paired b USING (axis_id, host, qt, rep_a, rep_b) WHERE a.model <> b.model AND NOT a.noted),
chk AS (SELECT *, {_STATE.format("mean")} AS h, {_STATE.format("mean_there")} AS t FROM two WHERE scene_set = set_there),
checked AS (SELECT model, other, axis_id, host, qt, rep_a, rep_b, mean, mean_there, scenes, {_OUTCOME} AS outcome FROM chk)"""
_ALL_PAIRED = f"{_pq()},\n{_cells()},\n{_declared()},\n{_summary(note=_NOTED)}"


def _lift_sql(anchor: str, axis: str, where: str = "TRUE") -> str:
    return f"{_R}{_pq()},\n{_cells()},\n{_anchor_cte(anchor, axis)},\n{_summary()}\nSELECT {_PAIRED_SELECT} FROM paired WHERE {where}"


def _planning_sql() -> str:
    from .common import fits

    fixed = [(h, a, b, x) for h, a, b, x in R.PLANNING_PAIRS if fits(a, "planning", h) and fits(b, "planning", h)]
    anchors = " UNION ALL ".join(
        f"SELECT a.model, a.judge, '{x}' AS axis_id, a.host, a.qt, a.rep AS rep_a, b.rep AS rep_b FROM cells a JOIN cells b ON a.model = b.model AND a.judge = b.judge AND a.host = b.host AND a.qt = b.qt JOIN scope s ON s.rep = b.rep AND s.qt = b.qt AND s.host = b.host WHERE a.rep = '{r}' AND b.rep <> '{r}' AND b.{_EVALUATED}"
        for r, x in ((R.NON_SPATIAL_ANCHOR, "non_spatial_anchor"), (R.FULL_RECORD_ANCHOR, "full_record_anchor"))
    )
    pairs = f"""{values(fixed, "fixed", "host, rep_a, rep_b, axis_id")},
pairs AS ({anchors} UNION ALL SELECT a.model, a.judge, f.axis_id, a.host, a.qt, f.rep_a, f.rep_b FROM fixed f JOIN cells a ON a.host = f.host AND a.rep = f.rep_a JOIN cells b ON b.model = a.model AND b.judge = a.judge AND b.host = a.host AND b.rep = f.rep_b)"""
    role = """CASE WHEN axis_id = 'full_record_anchor' AND rep_b = 'json_pretty' AND host = 'procthor' THEN 'axis effect (json_formatting)' WHEN axis_id = 'full_record_anchor' AND rep_b = 'json_pretty' AND host = 'gibson' THEN 'axis effect (json_formatting_gibson)'
        WHEN axis_id IN ('non_spatial_anchor', 'full_record_anchor') THEN 'reference' ELSE concat('axis effect (', axis_id, ')') END"""
    select = _PAIRED_SELECT.replace(f"noted AND verdict = '{R.DIRECTIONAL}' AND free_verdict = '{R.CONSISTENT}' AS capped", "FALSE AS capped")
    return f"{_R}{_pq(where=chr(39).join(['question_type = ', 'planning', '']))},\n{_cells()},\n{scope_cte()},\n{pairs},\n{_summary(note=_NOTED)}\nSELECT {select}, {role} AS role FROM paired"


def _matched_sql() -> str:
    return f"""{_RP}{_pq(extra="question_style")},
{_cells().replace("FROM pq GROUP BY ALL", "FROM pq GROUP BY model, judge, host, rep, qt")},
{_declared(axes=_VOCABULARY)},
dl AS (SELECT p.model, p.judge, p.axis_id, p.host, p.qt, p.rep_a, p.rep_b, a.scene_id, a.question_style, r.pair_id, b.ac_q - a.ac_q AS d
    FROM (SELECT * FROM pairs WHERE {_NOTED}) p JOIN pq a ON a.model = p.model AND a.judge = p.judge AND a.host = p.host AND a.qt = p.qt AND a.rep = p.rep_a JOIN pq b ON b.model = p.model AND b.judge = p.judge AND b.host = p.host AND b.qt = p.qt AND b.rep = p.rep_b AND b.question_id = a.question_id
    JOIN pairs_of r ON r.scene_id = a.scene_id AND r.id = split_part(a.question_id, ':', 2) WHERE a.ac_q IS NOT NULL AND b.ac_q IS NOT NULL),
fs AS (SELECT model, judge, axis_id, host, qt, rep_a, rep_b, scene_id, pair_id, max(d) FILTER (question_style = 'natural') AS nat, max(d) FILTER (question_style = 'constructed') AS con FROM dl GROUP BY ALL HAVING nat IS NOT NULL AND con IS NOT NULL),
sc AS (SELECT model, judge, axis_id, host, qt, rep_a, rep_b, scene_id, {r9("avg(con - nat)")} AS d, avg(nat) AS n, avg(con) AS c, count(*) AS k FROM fs GROUP BY ALL),
pa AS (SELECT model, judge, axis_id, host, qt, rep_a, rep_b, list(d ORDER BY scene_id) AS ds, avg(n) AS d_natural, avg(c) AS d_constructed, sum(k) AS n_factsets FROM sc GROUP BY ALL),
pb AS (SELECT pa.*, list_sum(ds) / len(ds) AS mean, concat_ws('; ', {_gate("a")}, {_gate("b")}) AS ineligible FROM pa
    LEFT JOIN cells ca ON pa.model = ca.model AND pa.judge = ca.judge AND pa.host = ca.host AND pa.qt = ca.qt AND ca.rep = rep_a LEFT JOIN cells cb ON pa.model = cb.model AND pa.judge = cb.judge AND pa.host = cb.host AND pa.qt = cb.qt AND cb.rep = rep_b)
SELECT model, judge, axis_id, host, qt, rep_a, rep_b, {r9("d_natural")} AS d_natural, {r9("d_constructed")} AS d_constructed, {r9("mean")} AS mean, CAST(n_factsets AS BIGINT) AS n_factsets, {_V.format(consistent=f"'{R.CONSISTENT}'")} AS verdict, ineligible FROM pb""".replace("pairs AS (SELECT DISTINCT scene_id", "pairs_of AS (SELECT DISTINCT scene_id")


def _recut_sql() -> str:
    base = f"{_RP}{_pq(extra='question_style', where='TRUE')},\n{_cells('question_style')},\n{_declared('question_style', _VOCABULARY)}".replace("pairs AS (SELECT DISTINCT scene_id", "pairs_of AS (SELECT DISTINCT scene_id")
    base = base.replace("pairs AS (SELECT DISTINCT * FROM (", f"pairs AS (SELECT DISTINCT * FROM (SELECT * FROM (", 1).replace("b.rep = 'json_mini'))", f"b.rep = 'json_mini') WHERE {_NOTED}))", 1)
    return f"""{base},
{_summary("question_style")},
ev AS (SELECT DISTINCT model, judge, axis_id, host, qt, rep_a, rep_b, s.style FROM paired CROSS JOIN (VALUES ('natural'), ('constructed')) s(style))
SELECT ev.*, {r9("p.mean")} AS mean, CAST(p.n_questions AS BIGINT) AS n_questions, p.verdict, p.ineligible
FROM ev LEFT JOIN paired p ON ev.model = p.model AND ev.judge = p.judge AND ev.axis_id = p.axis_id AND ev.qt = p.qt AND ev.rep_a = p.rep_a AND ev.rep_b = p.rep_b AND ev.style = p.question_style"""


_CARD_RUNGS = "SELECT axis_id, host, qt, rung, rep FROM rungs UNION ALL SELECT DISTINCT axis_id, host, qt, -1, 'inventory' FROM rungs UNION ALL SELECT DISTINCT axis_id, host, qt, 999, 'json_mini' FROM rungs"

ORACLES = {
    "aggregate_groups": f"""{_R}{_pq()}
SELECT {_KEY}, CAST(sum(n) AS BIGINT) AS n, CAST(sum(error_count) AS BIGINT) AS error_count, CAST(sum(context_exceeded) AS BIGINT) AS context_exceeded, CAST(sum(n_ac) AS BIGINT) AS n_scored, {r9("sum(n_ac) / sum(n)")} AS coverage, {r9("avg(ac_q)")} AS ac_mean, {r9("stddev_pop(ac_q)")} AS ac_std,
    CASE WHEN count(ac_q) > 1 THEN {r9("min(ac_q)")} END AS ac_lo, CASE WHEN count(ac_q) > 1 THEN {r9("max(ac_q)")} END AS ac_hi, {r9("avg(det_q)")} AS detail_mean, {r9("stddev_pop(det_q)")} AS detail_std, count(det_q) AS n_detail FROM pq GROUP BY {_KEY}""",
    "operational_total": f"""{_R}{_pq()}
SELECT coalesce(model, 'ALL') AS model, coalesce(judge, 'ALL') AS judge, coalesce(host, 'ALL') AS host, coalesce(rep, 'ALL') AS rep, coalesce(qt, 'operational-total') AS qt, CAST(sum(n) AS BIGINT) AS n, CAST(sum(error_count) AS BIGINT) AS error_count, CAST(sum(context_exceeded) AS BIGINT) AS context_exceeded,
    CAST(sum(n_ac) AS BIGINT) AS n_scored, {r9("sum(n_ac) / sum(n)")} AS coverage FROM pq GROUP BY GROUPING SETS (({_KEY}), ())""",
    "cells": f"{_R}{_pq()},\n{_cells()}\nSELECT {_CELLS_SQL} FROM cells",
    "small_n_register": f"{_C}{_pq('coverage_results')},\n{_cells()}\nSELECT {_CELLS_SQL} FROM cells WHERE n > 0 AND n < 6 AND {_EVALUATED}",
    "coverage_table": f"{_C}{_pq('coverage_results')},\n{_cells()}\nSELECT {_CELLS_SQL} FROM cells WHERE (context_exceeded > 0 OR qt IN ('object_relation', 'relation_structure', 'relation_aggregate')) AND {_EVALUATED}",
    "detail_table": f"{_R}{_pq()},\n{_cells()}\nSELECT {_KEY}, CAST(n_detail AS BIGINT) AS n_detail, {r9('detail_mean')} AS detail_mean FROM cells WHERE n_detail > 0 AND {_EVALUATED}",
    "question_points": f"{_R}{_pq()}\nSELECT {_KEY}, question_id, {r9('ac_q')} AS ac FROM pq WHERE n_ac > 0",
    "ac_by_type": f"""{_R}{_pq()},
{scope_cte()}
SELECT *, {r9("greatest(0, mean0 - sd0)")} AS lo, {r9("least(1, mean0 + sd0)")} AS hi FROM (SELECT {_KEY}, avg(ac_q) AS mean0, stddev_pop(ac_q) AS sd0, {r9("avg(ac_q)")} AS mean, {r9("stddev_pop(ac_q)")} AS sd, count(*) AS n_q FROM pq WHERE n_ac > 0 AND {_EVALUATED} AND (rep = 'inventory' OR (rep, qt, host) IN (SELECT rep, qt, host FROM scope)) GROUP BY {_KEY})
""".replace("SELECT *, floor", f"SELECT {_KEY}, mean, sd, n_q, floor"),
    "ac_matrix": f"""{_R}{_pq()},
{scope_cte()}
SELECT model, judge, host, rep, {", ".join(f"{r9(f'avg(ac_q) FILTER (qt = {chr(39)}{t}{chr(39)})')} AS {t}" for t in _TYPES)} FROM pq WHERE n_ac > 0 AND {_EVALUATED} AND (rep = 'inventory' OR (rep, qt, host) IN (SELECT rep, qt, host FROM scope)) GROUP BY model, judge, host, rep""",
    "cost_quality": f"""{_R}{_pq()},
{scope_cte()}
SELECT {_KEY}, {r9("avg(ac_q)")} AS ac, {r9("avg(tok_q)")} AS tokens, count(*) AS n_q FROM pq WHERE n_ac > 0 AND n_tok > 0 AND {_EVALUATED} AND (rep, qt, host) IN (SELECT rep, qt, host FROM scope) GROUP BY {_KEY}""",
    "latency_profile": f"""{_R}{_pq()},
s AS (SELECT model, judge, rep, question_id, sum(sum_ms) / sum(n_ms) / 1000 AS s FROM pq WHERE n_ms > 0 GROUP BY ALL),
b AS (SELECT model, judge, rep, quantile_cont(s, 0.25) AS q1, quantile_cont(s, 0.5) AS med, quantile_cont(s, 0.75) AS q3 FROM s GROUP BY ALL)
SELECT b.model, b.judge, b.rep, {r9("q1")} AS q1, {r9("med")} AS median, {r9("q3")} AS q3, {r9("min(s) FILTER (s >= q1 - 15e-1 * (q3 - q1))")} AS whisker_lo, {r9("max(s) FILTER (s <= q3 + 15e-1 * (q3 - q1))")} AS whisker_hi,
    count(*) FILTER (s < q1 - 15e-1 * (q3 - q1) OR s > q3 + 15e-1 * (q3 - q1)) AS outliers, count(*) AS n_q FROM s JOIN b USING (model, judge, rep) GROUP BY b.model, b.judge, b.rep, q1, med, q3""",
    "pooled_groups": f"""WITH {ctes("results")},
h AS (SELECT model, judge, {_HOST} AS host, count(DISTINCT scene_id) AS scenes FROM results GROUP BY ALL)
SELECT model, judge, host AS "group", CAST(scenes AS BIGINT) AS scenes, scenes < 3 AS partial FROM h UNION ALL SELECT model, judge, 'all', CAST(sum(scenes) AS BIGINT), bool_or(scenes < 3) FROM h GROUP BY model, judge""",
    "unregistered_scenes": f"WITH {ctes('results')}\nSELECT DISTINCT scene_id FROM results WHERE scene_id NOT IN (SELECT scene_id FROM results WHERE repetition = 1 AND answer_correctness > 0.9)",
    "paired_rows": f"""{_R}{_ALL_PAIRED}
SELECT {_PAIRED_SELECT}, CASE WHEN noted AND axis_id = 'structure' THEN '{R.AXES[3].note.replace("'", "''")}' WHEN noted THEN '{R.AXES[4].note.replace("'", "''")}' ELSE '' END AS terminology_note, noted AS pooled_forbidden FROM paired""",
    "paired_factsets": f"""{_R}{_ALL_PAIRED}
SELECT model, judge, axis_id, host, qt, rep_a, rep_b, CAST(count(DISTINCT scene_id || '/' || CAST(floor(CAST(split_part(question_id, ':', 2) AS INT) / 2) AS VARCHAR)) AS INT) AS n_factsets FROM deltas GROUP BY ALL""",
    "pooled_paired": f"""{_R}{_ALL_PAIRED}
SELECT axis_id, verdict, CAST(list_position([{", ".join(f"'{v}'" for v in R.VERDICT_ORDER)}], verdict) AS BIGINT) AS verdict_order, count(*) AS count FROM paired WHERE NOT noted GROUP BY axis_id, verdict""",
    "axis_cards": f"""{_R}{_pq()},
{_cells()},
{_declared().replace("pairs AS", "unused AS")},
{_anchor_cte(R.NON_SPATIAL_ANCHOR, "non_spatial_anchor")},
{_summary()},
card AS (SELECT c.*, r.axis_id, r.rung FROM cells c JOIN ({_CARD_RUNGS}) r USING (host, qt, rep)),
k AS (SELECT model, judge, axis_id, qt, count(*) AS k FROM card GROUP BY ALL)
SELECT c.model, c.judge, c.axis_id, c.host, c.qt, CAST(c.rung AS INT) AS rung, c.rep, CAST(c.n AS BIGINT) AS n, {r9("c.coverage")} AS coverage, {r9("c.ac_mean")} AS ac_mean, {r9("c.ac_lo")} AS ac_lo, {r9("c.ac_hi")} AS ac_hi,
    CASE WHEN c.rep = 'inventory' AND c.n_scored > 0 THEN 0 WHEN p.verdict <> '{R.NOT_LICENSED}' THEN {r9("p.mean")} END AS lift
FROM card c JOIN k ON k.model = c.model AND k.judge = c.judge AND k.axis_id = c.axis_id AND k.qt = c.qt AND k.k >= 2 LEFT JOIN paired p ON p.model = c.model AND p.judge = c.judge AND p.host = c.host AND p.qt = c.qt AND p.rep_b = c.rep""",
    "non_spatial_lifts": _lift_sql(R.NON_SPATIAL_ANCHOR, "non_spatial_anchor"),
    "full_record_lifts": _lift_sql(R.FULL_RECORD_ANCHOR, "full_record_anchor"),
    "structure_lift": _lift_sql(R.NON_SPATIAL_ANCHOR, "non_spatial_anchor", "(qt, host) NOT IN (SELECT qt, host FROM scope WHERE rep = 'inventory')"),
    "planning_lifts": _planning_sql(),
    "candidate_audit": f"""{_R}{_pq()},
{_cells()},
pairs AS (SELECT a.model, a.judge, 'candidate' AS axis_id, a.host, a.qt, a.rep AS rep_a, b.rep AS rep_b FROM cells a JOIN cells b ON a.model = b.model AND a.judge = b.judge AND a.host = b.host AND a.qt = b.qt AND a.rep = 'json_mini' AND b.rep = 'synthesis'),
{_summary()}
SELECT {_PAIRED_SELECT} FROM paired""",
    "style_recut": _recut_sql(),
    "matched_factsets": _matched_sql(),
    "cross_model_check": f"""{_R}{_ALL_PAIRED},
{_CHECK}
SELECT model, other, axis_id, host, qt, rep_a, rep_b, {r9("mean")} AS mean, {r9("mean_there")} AS mean_there, CAST(scenes AS INT) AS scenes, outcome FROM checked""",
    "cross_model_gaps": f"""{_R}{_ALL_PAIRED},
{_CHECK},
m AS (SELECT DISTINCT model FROM results),
mm AS (SELECT a.model, b.model AS other FROM m a JOIN m b ON a.model <> b.model),
t AS (SELECT model, other, count(*) AS matched, {", ".join(f"count_if(outcome = '{n}') AS {k}" for n, k in zip((R.PRESERVED, R.REVERSED, R.LEANS_SAME, R.LEANS_OPPOSITE, R.ONLY_THERE, R.NULL_BOTH), ("preserved", "reversed", "leans_same", "leans_opposite", "only_there", "neither")))} FROM checked GROUP BY ALL),
w AS (SELECT model, other, count(*) AS mismatched FROM two WHERE scene_set <> set_there GROUP BY ALL),
lost AS (SELECT mm.model, mm.other, p.axis_id, p.rep_a, p.rep_b FROM mm JOIN paired p ON p.model = mm.model AND NOT p.noted WHERE NOT EXISTS (SELECT 1 FROM paired q WHERE q.model = mm.other AND NOT q.noted AND q.axis_id = p.axis_id AND q.host = p.host AND q.qt = p.qt AND q.rep_a = p.rep_a AND q.rep_b = p.rep_b)),
u AS (SELECT model, other, string_agg(axis_id, ',' ORDER BY axis_id) AS axes FROM (SELECT DISTINCT model, other, axis_id FROM lost EXCEPT SELECT model, other, axis_id FROM checked) GROUP BY ALL),
g AS (SELECT model, other, string_agg(r, ',' ORDER BY r) AS reps FROM (SELECT DISTINCT model, other, unnest([rep_a, rep_b]) AS r FROM lost) l WHERE NOT EXISTS (SELECT 1 FROM results x WHERE x.model = l.other AND x.representation = l.r) GROUP BY ALL)
SELECT mm.model, mm.other, coalesce(matched, 0) AS matched, {", ".join(f"coalesce({k}, 0) AS {k}" for k in ("preserved", "reversed", "leans_same", "leans_opposite", "only_there", "neither"))}, coalesce(mismatched, 0) AS mismatched, coalesce(u.axes, '') AS axes_uncovered, coalesce(g.reps, '') AS reps_missing
FROM mm LEFT JOIN t USING (model, other) LEFT JOIN w USING (model, other) LEFT JOIN u USING (model, other) LEFT JOIN g USING (model, other)""",
}
