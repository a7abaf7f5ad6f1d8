"""The evaluation matrix and its response log: scope, planning, guards, resume."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import registry as R
from ..functions.keys import is_exceeded, is_ok

CELL_KEY = ["question_id", "representation", "repetition"]
RESERVED_TOKENS = 256
CHARS_A_TOKEN = 4


def in_scope(df: DataFrame, rep: str = "representation", qt: str = "question_type", host: str | None = "host", caps: DataFrame | None = None, needs: DataFrame | None = None) -> DataFrame:
    """df with in_scope: the representation tells all that some alternative of the question type needs.

    Unknown representations tell everything; unknown types and undeclared hosts need
    nothing. A type whose needs depend on the host is an error without a host column.
    """
    spark = df.sparkSession
    caps = R.rep_caps(spark) if caps is None else caps
    needs = R.type_needs(spark) if needs is None else needs
    # One row for each type and host case: a bounded registry, so both joins broadcast.
    table = needs.groupBy("qt", "need_host").agg(F.collect_list("needs").alias("alts"))
    any_host = table.where("need_host IS NULL").select(F.col("qt").alias("__qt"), F.col("alts").alias("__any"))
    by_host = table.where("need_host IS NOT NULL")
    if host is None and not by_host.join(df.select(F.col(qt).alias("qt")).distinct(), "qt", "left_semi").isEmpty():
        raise ValueError("a question type's needs depend on the host: pass a host column")
    own = by_host.select(F.col("qt").alias("__hqt"), F.col("need_host").alias("__host"), F.col("alts").alias("__own"))
    out = df.join(F.broadcast(caps.select(F.col("rep").alias("__rep"), F.col("caps").alias("__caps"))), F.col(rep) == F.col("__rep"), "left")
    out = out.join(F.broadcast(any_host), F.col(qt) == F.col("__qt"), "left")
    out = out.join(F.broadcast(own), (F.col(qt) == F.col("__hqt")) & (F.col(host) == F.col("__host") if host else F.lit(False)), "left")
    have = F.coalesce("__caps", F.array(*[F.lit(c) for c in R.CAPABILITIES]))
    alts = F.coalesce("__own", "__any")
    fits = F.exists(alts, lambda a: F.size(F.array_except(a, have)) == 0)
    return out.withColumn("in_scope", F.when(alts.isNull(), True).otherwise(fits)).drop("__rep", "__caps", "__qt", "__any", "__hqt", "__host", "__own")


def undeclared(reps: DataFrame, types: DataFrame, caps: DataFrame | None = None, needs: DataFrame | None = None) -> DataFrame:
    """(kind, name): representations and question types without a declaration; a null or empty type is one."""
    spark = reps.sparkSession
    caps = R.rep_caps(spark) if caps is None else caps
    needs = R.type_needs(spark) if needs is None else needs
    a = reps.select(F.col("representation").alias("name")).distinct().join(caps.select(F.col("rep").alias("name")), "name", "left_anti").select(F.lit("representation").alias("kind"), "name")
    b = types.select(F.coalesce("question_type", F.lit("")).alias("name")).distinct().join(needs.select(F.col("qt").alias("name")), "name", "left_anti")
    return a.unionByName(b.select(F.lit("question_type").alias("kind"), "name"))


def plan_runs(models: DataFrame, scenes: DataFrame, only_models: list[str] | None = None, only_scenes: list[str] | None = None) -> DataFrame:
    """Models by scenes, both registries; names that a selection asks for and the registry lacks are an error."""
    for df, col, asked in ((models, "model", only_models), (scenes, "scene_id", only_scenes)):
        if asked:
            known = {r[0] for r in df.where(F.col(col).isin(asked)).select(col).distinct().collect()}
            if missing := sorted(set(asked) - known):
                raise ValueError(f"unknown {col}: {', '.join(missing)}")
    models = models.where(F.col("model").isin(only_models)) if only_models else models
    scenes = scenes.where(F.col("scene_id").isin(only_scenes)) if only_scenes else scenes
    return models.crossJoin(F.broadcast(scenes))  # two registries of tens of rows


def plan_cells(questions: DataFrame, contexts: DataFrame, repetitions: int = 1, host: str = "host") -> DataFrame:
    """Questions by their scene's representations in scope (inventory always) by repetitions; contexts need scene_id and representation only."""
    cells = questions.join(contexts.select("scene_id", "representation").distinct(), "scene_id")
    cells = in_scope(cells, "representation", "question_type", host).where(F.col("in_scope") | (F.col("representation") == R.NON_SPATIAL_ANCHOR)).drop("in_scope")
    return cells.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))


def pending_cells(cells: DataFrame, log: DataFrame) -> DataFrame:
    """Cells without an ok or overflowed row in the log."""
    done = log.where(is_ok() | is_exceeded()).select(*CELL_KEY)
    return cells.join(done, CELL_KEY, "left_anti")


def build_prompt(template: str, context: str = "context", question: str = "question_text") -> Column:
    """The template's {context} and {question} filled with stripped texts."""
    strip = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", "")
    parts = template.replace("{question}", "\0q\0").replace("{context}", "\0c\0").split("\0")
    return F.concat(*[strip(question) if p == "q" else strip(context) if p == "c" else F.lit(p) for p in parts])


def context_guard(prompt_tokens: Column, prompt_chars: Column, window: int) -> Column:
    """The overflow sentinel, or null. Exact counts overflow beyond the budget; estimates (characters / 4) at it."""
    budget = window - RESERVED_TOKENS
    estimate = F.floor(prompt_chars / CHARS_A_TOKEN)
    over = F.when(prompt_tokens.isNotNull(), prompt_tokens > budget).otherwise(estimate >= budget)
    return F.when(over, F.concat(F.lit(f"{R.CONTEXT_EXCEEDED}: "), F.coalesce(prompt_tokens, estimate).cast("string"), F.lit(f" tokens of {budget}")))


def post_call_guard(responses: DataFrame, window: int, predicted: str = "predicted_tokens", reported: str = "prompt_tokens") -> DataFrame:
    """responses with error set where the reported tokens pass the budget, and drift where prediction and report differ."""
    budget = window - RESERVED_TOKENS
    over = F.coalesce(F.col(reported) > budget, F.lit(False)) & is_ok()
    error = F.when(over, F.concat(F.lit(f"{R.CONTEXT_EXCEEDED}: "), F.col(reported).cast("string"), F.lit(f" tokens of {budget}"))).otherwise(F.col("error"))
    return responses.withColumn("error", error).withColumn("drift", F.col(predicted).isNotNull() & F.col(reported).isNotNull() & (F.col(predicted) != F.col(reported)))


#: Chat wrappers by model family, longest matching prefix first.
CHAT_TEMPLATES = {
    "llama": ("<|start_header_id|>user<|end_header_id|>\n\n", "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"),
    "qwen": ("<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"),
    "gemma": ("<start_of_turn>user\n", "<end_of_turn>\n<start_of_turn>model\n"),
}


def chat_prompt(prompt: Column, model: Column, templates: dict[str, tuple[str, str]] | None = None) -> Column:
    """The prompt in its model family's chat wrapper; null for an unknown family."""
    out = F.lit(None).cast("string")
    for prefix, (before, after) in sorted((templates or CHAT_TEMPLATES).items(), key=lambda x: len(x[0])):
        out = F.when(model.startswith(prefix), F.concat(F.lit(before), prompt, F.lit(after))).otherwise(out)
    return out


def count_tokens(df: DataFrame, tokenizer: Callable[[], Callable[[list[str]], list[int]]], text: str, out: str = "predicted_tokens", extra: int = 1) -> DataFrame:
    """Token counts of a text column by any tokenizer, plus `extra` for the start token; null for null. tokenizer() is built once a task."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = tokenizer()
        for s in batches:
            at = [i for i, t in enumerate(s) if t is not None]
            counts: list[int | None] = [None] * len(s)
            for i, n in zip(at, count([s.iloc[i] for i in at]) if at else []):
                counts[i] = n + extra
            yield pd.Series(counts, dtype="Int64")

    return df.withColumn(out, counted(F.col(text)))


def strip_thinking(text: Column) -> Column:
    """Without <think> blocks and what follows an unclosed one; left-trimmed."""
    text = F.regexp_replace(text, r"(?s)<think>.*?</think>\s*", "")
    return F.regexp_replace(F.split_part(text, F.lit("<think>"), F.lit(1)), r"^\s+", "")


def compact_log(log: DataFrame, order: str = "write_order", key: list[str] | None = None) -> DataFrame:
    """The last row of each key, ordinary errors then dropped: such a key is gone and will be run again."""
    return latest_responses(log, order, key).where(is_ok() | is_exceeded())


def latest_responses(log: DataFrame, order: str = "write_order", key: list[str] | None = None) -> DataFrame:
    """The last row of each key. max_by combines before the shuffle, where a window would sort the whole log."""
    key = key or CELL_KEY
    rest = [c for c in log.columns if c not in key]
    out = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__r"))
    return out.select(*key, *[F.col("__r")[c].alias(c) for c in rest]).select(*log.columns)


def continuity_violations(log: DataFrame, column: str, expected: str) -> DataFrame:
    """Tags of other responders or judges in a log that is about to be resumed."""
    return log.select(F.col(column).alias("tag")).where("tag IS NOT NULL").distinct().where(F.col("tag") != expected)


def pending_scores(responses: DataFrame, results: DataFrame, judge: str) -> DataFrame:
    """Responses without a result by this judge."""
    return responses.join(results.where(F.col("judge") == judge).select(*CELL_KEY), CELL_KEY, "left_anti")


def run_summary(planned: DataFrame, log: DataFrame) -> DataFrame:
    """One row: generated, errored, context_exceeded, skipped, and whether nothing came through."""
    counts = log.agg(F.count_if(is_ok()).alias("generated"), F.count_if(~is_ok() & ~is_exceeded()).alias("errored"), F.count_if(is_exceeded()).alias("context_exceeded"), F.count(F.lit(1)).alias("__n"))
    total = planned.agg(F.count(F.lit(1)).alias("planned"))
    out = counts.crossJoin(F.broadcast(total)).withColumn("skipped", F.col("planned") - F.col("__n"))  # two single rows
    return out.withColumn("failed", (F.col("__n") > 0) & (F.col("generated") + F.col("context_exceeded") == 0)).drop("__n")


RESPONSE_SCHEMA = "raw_answer string, prompt_tokens int, completion_tokens int, latency_ms double, error string"


def batch_generate(cells: DataFrame, responder: Callable[[], Callable[[str], dict]], prompt: str = "prompt") -> DataFrame:
    """cells with a response each: responder() makes a task's client, which maps a prompt to text, prompt_tokens, completion_tokens and latency_ms.

    An exception becomes an error row. A cell that has an error already (missing
    context, overflow) keeps it and calls nobody. A null prompt is a missing context.
    """
    names = [c for c in cells.columns if c not in ("raw_answer", "prompt_tokens", "completion_tokens", "latency_ms", "error")]
    had = "error" in cells.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*names).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = None
        for df in batches:
            rows = []
            for text, error in zip(df[prompt], df["error"] if had else [None] * len(df)):
                row = {"raw_answer": "", "prompt_tokens": 0, "completion_tokens": 0, "latency_ms": 0.0, "error": error or None}
                if not error and text is None:
                    row["error"] = "context not found"
                elif not error:
                    try:
                        call = call or responder()
                        got = call(text)
                        row |= {"raw_answer": got["text"], **{k: got.get(k, 0) for k in ("prompt_tokens", "completion_tokens")}, "latency_ms": float(got.get("latency_ms", 0))}
                    except Exception as e:  # noqa: BLE001
                        row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pd.concat([df[names].reset_index(drop=True), pd.DataFrame(rows, columns=["raw_answer", "prompt_tokens", "completion_tokens", "latency_ms", "error"])], axis=1)

    return cells.mapInPandas(run, f"{fields}, {RESPONSE_SCHEMA}")
