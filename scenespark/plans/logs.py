"""Queries over the question set and the response log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import registry as R
from ..functions.keys import error_class, host_of, row_key
from ..functions.storage import new_path
from ..operators import cells as L
from ..operators import judging as J
from ..operators import questions as Q
from ..streaming import results as T
from .adapters import ctes, shape
from .common import fits, values

_WINDOW = 600


def _log(s: SparkSession, d: str) -> DataFrame:
    return shape(s, d, "log")


def _questions(s: SparkSession, d: str) -> DataFrame:
    """Questions with up to three facts: weights 3, 1, 3."""
    facts = F.array(*[F.struct(F.col(f"fact_{i}").alias("fact"), F.lit(w).alias("weight")) for i, w in ((1, 3.0), (2, 1.0), (3, 3.0))])
    return shape(s, d, "questions").withColumn("key_facts", F.slice(facts, 1, F.col("n_facts").cast("int"))).withColumn("host", host_of("scene_id"))


def _contexts(s: SparkSession, d: str) -> DataFrame:
    """Every scene of the questions with each declared representation's capability-free name."""
    reps = s.createDataFrame([(r,) for r in R.REP_CAPS], "representation string")
    return _questions(s, d).select("scene_id").distinct().crossJoin(F.broadcast(reps))


def _plan_cells(s: SparkSession, d: str) -> DataFrame:
    return L.plan_cells(_questions(s, d), _contexts(s, d), repetitions=2).select("scene_id", "id", "question_type", "representation", "repetition")


def _pending(s: SparkSession, d: str) -> DataFrame:
    cells = _log(s, d).select(*L.CELL_KEY).distinct()
    return L.pending_cells(cells, L.latest_responses(_log(s, d)))


def _merged(s: SparkSession, d: str, coverage: bool) -> DataFrame:
    """The log, dealt to three batches out of order, through the stream's incremental state."""
    log = _log(s, d)
    rows = log.select("question_id", F.concat(F.lit("procthor_"), F.col("responder")).alias("scene_id"), F.col("responder").alias("question_type"), "representation", "repetition", "responder", F.lit("judge").alias("judge"), F.when(F.col("error") == "", F.col("latency_ms")).alias("answer_correctness"), "error", F.col("write_order").cast("long").alias("write_order"))
    table = new_path(s, "log_table")
    for number in range(3):
        T.merge_batch(s, table, rows.where(F.pmod(F.col("write_order"), F.lit(3)) == (number + 1) % 3), number)
    return T.stream_coverage(s, table) if coverage else T.read_state(s, table).drop("question_type", "judge")


def _documents(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source", "n_chars")


def _guard(s: SparkSession, d: str) -> DataFrame:
    exact = F.when(F.col("n_chars") % 2 == 0, F.floor(F.col("n_chars") / 5))
    return _documents(s, d).select("doc_id", L.context_guard(exact, F.length("text"), _WINDOW).alias("error"))


def _reported(s: SparkSession, d: str) -> DataFrame:
    """Documents as responses whose reported tokens are a quarter of their characters; each third one has no prediction, some are off by one, some failed."""
    n = F.floor(F.col("n_chars") / 4)
    rows = _documents(s, d).select("doc_id", n.alias("prompt_tokens"), F.when(F.col("doc_id") % 3 != 0, n + F.col("doc_id") % 2).alias("predicted_tokens"), F.when(F.col("doc_id") % 7 == 0, "timeout").otherwise("").alias("error"))
    return L.post_call_guard(rows, _WINDOW).select("doc_id", "error", "drift")


def _counted(s: SparkSession, d: str) -> DataFrame:
    """Characters, as a tokenizer's tokens, of every document in its model family's wrapper."""
    model = F.element_at(F.array(*[F.lit(m) for m in ("llama3", "qwen2.5", "gemma", "unheard-of")]), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = _documents(s, d).select("doc_id", L.chat_prompt(F.col("text"), model).alias("prompt"))
    return L.count_tokens(rows, lambda: lambda texts: [len(t) for t in texts], "prompt").select("doc_id", "predicted_tokens")


def _runs(s: SparkSession, d: str) -> DataFrame:
    results = shape(s, d, "results")
    return L.plan_runs(results.select("model").distinct(), results.select("scene_id").distinct(), only_models=["A", "R"])


def _prompts(s: SparkSession, d: str) -> DataFrame:
    text = L.build_prompt("Context: {context}\nQuestion: {question}", "text", "source")
    return _documents(s, d).select("doc_id", F.length(text).alias("n"), F.md5(text).alias("md5"))


def _scores(s: SparkSession, d: str) -> DataFrame:
    said = F.transform("key_facts", lambda f: F.length(f["fact"]) % 2 == 0)
    t = J.tier_scores("key_facts", said)
    return _questions(s, d).select("scene_id", "id", t["core"].alias("core"), t["detail"].alias("detail"), t["error"].alias("error"))


def _scope(s: SparkSession, d: str) -> DataFrame:
    rows = _questions(s, d).select("question_type", "host").distinct().crossJoin(F.broadcast(s.createDataFrame([(r,) for r in [*R.REP_CAPS, "own_view"]], "representation string")))
    return L.in_scope(rows).select("representation", "question_type", "host", "in_scope")


def _reply(prompt: str) -> dict:
    """A stand-in for a model: deterministic, failing at times."""
    if len(prompt) % 7 == 0:
        raise TimeoutError("no answer")
    return {"text": prompt[-20:], "prompt_tokens": len(prompt) // 4, "completion_tokens": 5, "latency_ms": 1.0}


def _generate(s: SparkSession, d: str) -> DataFrame:
    cells = _documents(s, d).select("doc_id", F.when(F.col("doc_id") % 11 != 0, F.col("text")).alias("prompt"))
    return L.batch_generate(cells, lambda: _reply).select("doc_id", "raw_answer", "prompt_tokens", "error")


def _rubric(s: SparkSession, d: str) -> DataFrame:
    """Judge texts from conversations, each turn's verdict in one of seven forms with the turn's text below it, of as many facts as turns and one more for some."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n")
    out = shape(s, d, "rubrics").groupBy("conv_id").agg(ordered.alias("text"), (F.count(F.lit(1)) + F.col("conv_id") % 2).alias("n"))
    out = out.withColumn("r", J.parse_rubric("text", F.col("n")))
    return out.select("conv_id", F.array_join(F.transform("r.verdicts", lambda v: F.when(v, "Y").otherwise("N")), "").alias("verdicts"), "r.error")


QUERIES = {
    "error_class": lambda s, d: _log(s, d).groupBy(error_class().alias("error_class"), "representation").count(),
    "latest_responses": lambda s, d: L.latest_responses(_log(s, d)),
    "stream_state": lambda s, d: _merged(s, d, False),
    "stream_coverage": lambda s, d: _merged(s, d, True),
    "post_call_guard": _reported,
    "count_tokens": _counted,
    "plan_runs": _runs,
    "select_types": lambda s, d: Q.select_types(_questions(s, d), ["connectivity", "route", "unheard_of"]).select("scene_id", "id", "question_type"),
    "compact_log": lambda s, d: L.compact_log(_log(s, d)),
    "pending_cells": _pending,
    "continuity": lambda s, d: L.continuity_violations(_log(s, d), "responder", "m0"),
    "pending_scores": lambda s, d: L.pending_scores(_log(s, d).select(*L.CELL_KEY).distinct(), _log(s, d).where("error = ''").withColumn("judge", F.col("responder")), "m1"),
    "run_summary": lambda s, d: L.run_summary(_log(s, d).select(*L.CELL_KEY).distinct(), L.latest_responses(_log(s, d))),
    "plan_cells": _plan_cells,
    "scope_matrix": _scope,
    "undeclared": lambda s, d: L.undeclared(_log(s, d), _questions(s, d)),
    "context_guard": _guard,
    "build_prompt": _prompts,
    "strip_thinking": lambda s, d: shape(s, d, "judged").select("conv_id", "turn", L.strip_thinking(F.col("text")).alias("text")),
    "validate_questions": lambda s, d: Q.validate_questions(_questions(s, d)),
    "validate_pairs": lambda s, d: Q.validate_pairs(_questions(s, d)).withColumn("styles", F.array_join("styles", ",")),
    "missing_ids": lambda s, d: Q.missing_ids(_questions(s, d), _questions(s, d).select((F.col("id").cast("int") + 3).cast("string").alias("id"))),
    "pair_map": lambda s, d: Q.pair_map(_questions(s, d)),
    "row_key": lambda s, d: shape(s, d, "results").select("scene_id", row_key().alias("id")).distinct(),
    "judge_prompt": lambda s, d: _questions(s, d).select("scene_id", "id", F.md5(J.judge_prompt("text", "scene_id", template="Q {question} A {answer}\n{facts}")).alias("md5")),
    "tier_scores": _scores,
    "parse_rubric": _rubric,
    "batch_generate": _generate,
}

_W = lambda *n: f"WITH {ctes(*n)}\n"
_Q = f"WITH {ctes('questions')},\nq AS (SELECT *, CASE WHEN scene_id LIKE 'procthor%' THEN 'procthor' WHEN scene_id LIKE '3rscan%' THEN '3rscan' ELSE 'gibson' END AS host FROM questions),\nf AS (SELECT q.*, i AS k, [fact_1, fact_2, fact_3][i] AS fact, [3e0, 1e0, 3e0][i] AS w FROM q, range(1, 4) t(i) WHERE i <= n_facts)\n"
_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, representation, repetition ORDER BY write_order DESC) AS k FROM log)"
_TYPES = sorted({q for q, *_ in R.TYPE_NEEDS})
_SCOPE = values([(r, q, h) for r in [*R.REP_CAPS, "own_view"] for q in [*_TYPES, "unheard_of"] for h in R.HOSTS if fits(r, q, h)], "sc", "rep, qt, host")
_REPS = values([(r,) for r in [*R.REP_CAPS, "own_view"]], "reps", "representation")
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_BUDGET = _WINDOW - L.RESERVED_TOKENS
_HEAD, _OPENS = r"^[-\s]*([0-9]+)[.)]\s*", r"(?i)^(yes|no)([^0-9A-Za-z_]|$)"
_SHORT = r"^[^-–—:;,.!\s]+(\s+[^-–—:;,.!\s]+){0,2}\s*[-–—:;,.!]"

ORACLES = {
    "error_class": _W("log") + "SELECT CASE WHEN error = '' THEN 'ok' WHEN error LIKE 'CONTEXT_EXCEEDED%' THEN 'context_exceeded' ELSE 'error' END AS error_class, representation, count(*) AS count FROM log GROUP BY ALL",
    "latest_responses": _W("log") + f"SELECT question_id, representation, repetition, responder, write_order, latency_ms, error FROM ({_LAST}) WHERE k = 1",
    "stream_state": _W("log") + f"SELECT question_id, concat('procthor_', responder) AS scene_id, representation, repetition, responder, CASE WHEN error = '' THEN latency_ms END AS answer_correctness, error, write_order FROM ({_LAST}) WHERE k = 1",
    "stream_coverage": _W("log") + f"SELECT 'procthor' AS host, representation AS rep, responder AS qt, count(*) AS n, count_if(error <> '' AND error NOT LIKE 'CONTEXT_EXCEEDED%') AS error_count, count_if(error LIKE 'CONTEXT_EXCEEDED%') AS context_exceeded, count_if(error = '') AS n_scored FROM ({_LAST}) WHERE k = 1 GROUP BY ALL",
    "post_call_guard": """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'timeout' WHEN n_chars // 4 > 344 THEN concat('CONTEXT_EXCEEDED: ', n_chars // 4, ' tokens of 344') ELSE '' END AS error, doc_id % 3 <> 0 AND doc_id % 2 = 1 AS drift FROM documents""",
    "count_tokens": f"""SELECT doc_id, length(text) + 1 + CASE doc_id % 4 {' '.join(f"WHEN {i} THEN {sum(map(len, L.CHAT_TEMPLATES[m]))}" for i, m in enumerate(("llama", "qwen", "gemma")))} END AS predicted_tokens FROM documents""",
    "plan_runs": _W("results") + "SELECT model, scene_id FROM (SELECT DISTINCT model FROM results WHERE model IN ('A', 'R')) CROSS JOIN (SELECT DISTINCT scene_id FROM results)",
    "select_types": _W("questions") + "SELECT scene_id, id, question_type FROM questions WHERE question_type IN ('connectivity', 'route', 'unheard_of')",
    "compact_log": _W("log") + f"SELECT question_id, representation, repetition, responder, write_order, latency_ms, error FROM ({_LAST}) WHERE k = 1 AND (error = '' OR error LIKE 'CONTEXT_EXCEEDED%')",
    "pending_cells": _W("log") + f"SELECT question_id, representation, repetition FROM ({_LAST}) WHERE k = 1 AND error <> '' AND error NOT LIKE 'CONTEXT_EXCEEDED%'",
    "continuity": _W("log") + "SELECT DISTINCT responder AS tag FROM log WHERE responder <> 'm0'",
    "pending_scores": _W("log") + "SELECT DISTINCT question_id, representation, repetition FROM log EXCEPT SELECT question_id, representation, repetition FROM log WHERE error = '' AND responder = 'm1'",
    "run_summary": _W("log") + f"SELECT count_if(error = '') AS generated, count_if(error <> '' AND error NOT LIKE 'CONTEXT_EXCEEDED%') AS errored, count_if(error LIKE 'CONTEXT_EXCEEDED%') AS context_exceeded, count(*) AS planned, CAST(0 AS BIGINT) AS skipped, count_if(error = '' OR error LIKE 'CONTEXT_EXCEEDED%') = 0 AS failed FROM ({_LAST}) WHERE k = 1",
    "plan_cells": _Q + f", {_SCOPE}, {_REPS} SELECT q.scene_id, q.id, q.question_type, r.representation, CAST(n AS INT) AS repetition FROM q CROSS JOIN reps r CROSS JOIN range(1, 3) t(n) WHERE r.representation <> 'own_view' AND (r.representation = 'inventory' OR (r.representation, q.question_type, q.host) IN (SELECT rep, qt, host FROM sc))",
    "scope_matrix": _Q + f", {_SCOPE}, {_REPS} SELECT r.representation, q.question_type, q.host, (r.representation, q.question_type, q.host) IN (SELECT rep, qt, host FROM sc) AS in_scope FROM (SELECT DISTINCT question_type, host FROM q) q CROSS JOIN reps r",
    "undeclared": f"WITH {ctes('log', 'questions')}, {values([(r,) for r in R.REP_CAPS], 'reps', 'name')}, {values([(t,) for t in _TYPES], 'types', 'name')} SELECT DISTINCT 'representation' AS kind, representation AS name FROM log WHERE representation NOT IN (SELECT name FROM reps) UNION ALL SELECT DISTINCT 'question_type', coalesce(question_type, '') FROM questions WHERE coalesce(question_type, '') NOT IN (SELECT name FROM types)",
    "context_guard": f"SELECT doc_id, CASE WHEN n_chars % 2 = 0 AND floor(n_chars / 5) > {_BUDGET} THEN 'CONTEXT_EXCEEDED: ' || CAST(CAST(floor(n_chars / 5) AS BIGINT) AS VARCHAR) || ' tokens of {_BUDGET}' WHEN n_chars % 2 <> 0 AND floor(length(text) / 4) >= {_BUDGET} THEN 'CONTEXT_EXCEEDED: ' || CAST(CAST(floor(length(text) / 4) AS BIGINT) AS VARCHAR) || ' tokens of {_BUDGET}' END AS error FROM documents",
    "build_prompt": f"SELECT doc_id, CAST(length(p) AS INT) AS n, md5(p) AS md5 FROM (SELECT doc_id, 'Context: ' || {_TRIM.format('text')} || chr(10) || 'Question: ' || {_TRIM.format('source')} AS p FROM documents)",
    "strip_thinking": _W("judged") + r"SELECT conv_id, turn, regexp_replace(split_part(regexp_replace(text, '<think>.*?</think>\s*', '', 'gs'), '<think>', 1), '^\s+', '') AS text FROM judged",
    "validate_questions": _Q + "SELECT q.scene_id, q.id, p.problem FROM q, (VALUES ('missing text'), ('no key facts'), ('pair without style'), ('style without pair')) p(problem) WHERE CASE p.problem WHEN 'missing text' THEN coalesce(text, '') = '' WHEN 'no key facts' THEN n_facts = 0 WHEN 'pair without style' THEN pair_id IS NOT NULL AND question_style IS NULL ELSE pair_id IS NULL AND question_style IS NOT NULL END",
    "validate_pairs": _Q + "SELECT * FROM (SELECT scene_id, pair_id, string_agg(coalesce(question_style, ''), ',' ORDER BY coalesce(question_style, '')) AS styles FROM q WHERE pair_id IS NOT NULL GROUP BY ALL) WHERE styles <> 'constructed,natural'",
    "missing_ids": _Q + "SELECT DISTINCT CAST(CAST(id AS INT) + 3 AS VARCHAR) AS id FROM q WHERE CAST(CAST(id AS INT) + 3 AS VARCHAR) NOT IN (SELECT id FROM q)",
    "pair_map": _Q + "SELECT DISTINCT scene_id, id, pair_id FROM q WHERE pair_id IS NOT NULL",
    "row_key": _W("results") + "SELECT DISTINCT scene_id, split_part(question_id, ':', 2) AS id FROM results",
    "judge_prompt": _Q + f"SELECT q.scene_id, q.id, md5('Q ' || {_TRIM.format('q.text')} || ' A ' || q.scene_id || chr(10) || coalesce((SELECT string_agg(k || '. ' || fact, chr(10) ORDER BY k) FROM f WHERE f.id = q.id), '')) AS md5 FROM q",
    "tier_scores": _Q + """SELECT q.scene_id, q.id, round(sum(CASE WHEN length(fact) % 2 = 0 THEN w ELSE 0 END) FILTER (w > 1) / sum(w) FILTER (w > 1), 4) AS core, round(sum(CASE WHEN length(fact) % 2 = 0 THEN w ELSE 0 END) FILTER (w <= 1) / sum(w) FILTER (w <= 1), 4) AS detail,
    CASE WHEN coalesce(sum(w) FILTER (w > 1), 0) = 0 THEN 'no core fact' END AS error FROM q LEFT JOIN f ON f.id = q.id GROUP BY q.scene_id, q.id""",
    "parse_rubric": _W("rubrics") + rf"""
, rt AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS text, count(*) + conv_id % 2 AS n FROM rubrics GROUP BY conv_id),
ln AS (SELECT conv_id, n, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM rt),
br AS (SELECT *, regexp_replace(translate(line, '*`_', ''), '^\s+|\s+$', '', 'g') AS bare FROM ln),
nm AS (SELECT *, CASE WHEN regexp_matches(bare, '{_HEAD}.') THEN coalesce(try_cast(regexp_extract(bare, '{_HEAD}', 1) AS INT), 0) END AS fact, regexp_replace(bare, '{_HEAD}', '') AS body FROM br),
mk AS (SELECT *, lower(regexp_extract(body, '{_OPENS}', 1)) AS said, fact IS NOT NULL AND regexp_matches(body, '(?i)^(yes|no)\s*([-–—:;,.!]|$)') AS strong,
              fact IS NOT NULL AND regexp_matches(body, '{_SHORT}') AS short, CASE WHEN fact IS NULL AND regexp_matches(line, '^[ \t*-]') THEN lower(regexp_extract(bare, '(?i)^[-•\s]*(yes|no)([^0-9A-Za-z_]|$)', 1)) ELSE '' END AS under FROM nm),
ow AS (SELECT *, last_value(CASE WHEN fact BETWEEN 1 AND n THEN fact WHEN fact IS NOT NULL AND said = '' THEN 0 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY i) AS owner FROM mk),
st AS (SELECT conv_id, fact AS k, arg_max(said = 'yes', i) AS yes FROM ow WHERE strong AND fact BETWEEN 1 AND n GROUP BY ALL),
wk AS (SELECT conv_id, owner AS k, arg_min(under = 'yes', i) AS yes FROM ow WHERE owner BETWEEN 1 AND n AND (fact = owner AND said = '' AND short OR under <> '') GROUP BY ALL),
fc AS (SELECT conv_id, n, unnest(generate_series(1, n)) AS k FROM rt),
vd AS (SELECT fc.*, coalesce(st.yes, wk.yes) AS yes FROM fc LEFT JOIN st USING (conv_id, k) LEFT JOIN wk USING (conv_id, k))
SELECT conv_id, string_agg(CASE WHEN yes THEN 'Y' ELSE 'N' END, '' ORDER BY k) AS verdicts,
       CASE WHEN count(yes) < count(*) THEN 'no verdict for fact(s) [' || string_agg(CAST(k AS VARCHAR), ', ' ORDER BY k) FILTER (yes IS NULL) || '] of ' || CAST(any_value(n) AS VARCHAR) END AS error
FROM vd GROUP BY conv_id""",
    "batch_generate": """SELECT doc_id, CASE WHEN doc_id % 11 = 0 OR length(text) % 7 = 0 THEN '' ELSE right(text, 20) END AS raw_answer, CAST(CASE WHEN doc_id % 11 = 0 OR length(text) % 7 = 0 THEN 0 ELSE floor(length(text) / 4) END AS INT) AS prompt_tokens,
    CASE WHEN doc_id % 11 = 0 THEN 'context not found' WHEN length(text) % 7 = 0 THEN 'TimeoutError: no answer' END AS error FROM documents""",
}
