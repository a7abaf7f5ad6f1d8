"""Judging answers: numbered facts, rubric verdicts, weighted scores, flat result rows."""

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import is_ok

RUBRIC = """Judge an answer by a list of facts.

QUESTION: {question}
ANSWER: {answer}

Say for each fact, on a line that starts with its number, YES if the answer states or clearly implies it, else NO, then why.
- A fact about a certain object, id or room is met only by that very one. Guesses at what kind of thing it may be don't meet it.
- A fact with several conditions is met only if the answer supports each of them. Go through them one by one; where your reason names one that is missing, the verdict is NO.
- Where the answer weighs several candidates and then settles on a conclusion, only the conclusion counts, not what was considered on the way.

FACTS:
{facts}"""

# The tier limit, the longest refusal in words, separators after a verdict, and the columns of a result file.
CORE_ABOVE = 1.0
MAX_VERDICT_WORDS = 3
_SEPARATORS = "-–—:;,.!"
RESULT_COLUMNS = ["question_id", "scene_id", "representation", "repetition", "responder", "judge", "question_type", "question_style", "question_text", "raw_answer", "rubric_reasoning", "prompt_tokens", "completion_tokens", "answer_correctness", "answer_correctness_detail", "latency_ms", "error"]

_WORD = rf"[^{_SEPARATORS}\s]+"
_LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def number_facts(facts: str | Column = "key_facts") -> Column:
    """`1. fact` lines in order."""
    facts = F.col(facts) if isinstance(facts, str) else facts
    return F.array_join(F.transform(facts, lambda f, i: F.concat((i + 1).cast("string"), F.lit(". "), f["fact"])), "\n")


def judge_prompt(question: str = "question_text", answer: str = "raw_answer", facts: str = "key_facts", template: str = RUBRIC) -> Column:
    """The template's {question}, {answer} and {facts} filled; question and answer stripped."""
    strip = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", "")
    fill = {"{question}": strip(question), "{answer}": strip(answer), "{facts}": number_facts(facts)}
    return F.concat(*[fill.get(p, F.lit(p)) for p in re.split(r"(\{question\}|\{answer\}|\{facts\})", template) if p])


def _line(line: Column) -> Column:
    """What one line of a judge's text is: struct of fact (null without a number), strong and weak verdicts and whether it restates its fact.

    strong: a number, then YES or NO, then a separator or nothing. weak: a numbered phrase
    of few words before a separator, which affirms nothing, or YES or NO on an indented line without a number.
    """
    bare = F.regexp_replace(F.translate(line, "*`_", ""), r"^\s+|\s+$", "")
    numbered, opens = r"^[-\s]*([0-9]+)[.)]\s*", r"(?i)^(yes|no)(?:[^0-9A-Za-z_]|$)"
    number = F.when(bare.rlike(numbered + "."), F.coalesce(F.regexp_extract(bare, numbered, 1).try_cast("int"), F.lit(0)))
    body = F.regexp_replace(bare, numbered, "")
    said = F.lower(F.regexp_extract(body, opens, 1))
    strong = number.isNotNull() & body.rlike(rf"(?i)^(?:yes|no)\s*(?:[{_SEPARATORS}]|$)")
    short = body.rlike(rf"^{_WORD}(?:\s+{_WORD}){{0,{MAX_VERDICT_WORDS - 1}}}\s*[{_SEPARATORS}]")
    under = F.when(number.isNull() & line.rlike(r"^[ \t*-]"), F.lower(F.regexp_extract(bare, r"(?i)^[-•\s]*(yes|no)(?:[^0-9A-Za-z_]|$)", 1)))
    weak = F.when(number.isNotNull() & (said == "") & short, F.lit(False)).when(under != "", under == "yes")
    return F.struct(number.alias("fact"), F.when(strong, said == "yes").alias("strong"), weak.alias("weak"), (said != "").alias("restates"))


def parse_rubric(text: str | Column, n: Column) -> Column:
    """Struct of n verdicts and the error for facts that have none, from a judge's text.

    A fact's last strong verdict holds. Without one its first weak verdict does; one on a
    line without a number belongs to the fact of the numbered line above it. Numbers of no
    fact end what stands above them, unless YES or NO follows. A null text has no verdicts.
    """
    text = F.col(text) if isinstance(text, str) else text
    n = n.cast("int")
    marks = F.transform(F.split(F.coalesce(text, F.lit("")), _LINE_END), _line)
    none = F.array_repeat(F.lit(None).cast("boolean"), n)
    start = F.struct(F.lit(0).alias("at"), none.alias("strong"), none.alias("weak"))

    def step(state: Column, mark: Column) -> Column:
        known = mark["fact"].between(1, n)
        at = F.when(mark["fact"].isNull() | (~known & mark["restates"]), state["at"]).when(known, mark["fact"]).otherwise(0)
        own = lambda i: (at == i + 1) & (mark["fact"].isNull() | known)
        strong = F.transform(state["strong"], lambda v, i: F.when(own(i), F.coalesce(mark["strong"], v)).otherwise(v))
        weak = F.transform(state["weak"], lambda v, i: F.when(own(i), F.coalesce(v, mark["weak"])).otherwise(v))
        return F.struct(at.alias("at"), strong.alias("strong"), weak.alias("weak"))

    def finish(state: Column) -> Column:
        found = F.zip_with(state["strong"], state["weak"], lambda s, w: F.coalesce(s, w))
        missing = F.filter(F.transform(found, lambda v, i: F.when(v.isNull(), i + 1)), lambda i: i.isNotNull())
        said = F.concat(F.lit("no verdict for fact(s) ["), F.array_join(missing, ", "), F.lit("] of "), n.cast("string"))
        return F.struct(F.transform(found, lambda v: F.coalesce(v, F.lit(False))).alias("verdicts"), F.when(F.size(missing) > 0, said).alias("error"))

    return F.aggregate(marks, start, step, finish)


def tier_scores(facts: str | Column, verdicts: Column) -> Column:
    """Struct of core, detail and error: the weight of affirmed facts in that of all, facts above weight 1 and the others; no detail facts: null; no core facts: an error."""
    facts = F.col(facts) if isinstance(facts, str) else facts
    both = F.zip_with(facts, verdicts, lambda f, v: F.struct(F.coalesce(f["weight"], F.lit(1.0)).alias("w"), v.alias("v")))

    def tier(core: bool) -> Column:
        own = F.filter(both, lambda x: (x["w"] > CORE_ABOVE) if core else (x["w"] <= CORE_ABOVE))
        total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x["w"])
        hit = F.aggregate(own, F.lit(0.0), lambda a, x: a + F.when(x["v"], x["w"]).otherwise(0.0))
        return F.when(total > 0, F.round(hit / total, 4))

    core = tier(True)
    return F.struct(core.alias("core"), tier(False).alias("detail"), F.when(core.isNull(), "no core fact").alias("error"))


def batch_judge(responses: DataFrame, judge: Callable[[], Callable[[str], str]], tag: str) -> DataFrame:
    """responses (with key_facts) with judge, rubric_reasoning, scores and error: one judge call for each ok response with facts.

    judge() makes a task's client, which maps a prompt to a text. Rows with an error pass
    through; an exception or a text without all verdicts becomes an error.
    """
    rows = responses.withColumn("__prompt", F.when(is_ok() & (F.size("key_facts") > 0), judge_prompt()))
    names = rows.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = None
        for df in batches:
            out = []
            for prompt in df["__prompt"]:
                try:
                    call = call or judge()
                    out.append((call(prompt), None) if prompt is not None else (None, None))
                except Exception as e:  # noqa: BLE001
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.concat([df[names].reset_index(drop=True), pd.DataFrame(out, columns=["rubric_reasoning", "__failed"])], axis=1)

    out = rows.mapInPandas(run, f"{fields}, rubric_reasoning string, __failed string")
    parsed = F.when(F.col("rubric_reasoning").isNotNull(), parse_rubric("rubric_reasoning", F.size("key_facts")))
    out = out.withColumn("__v", parsed).withColumn("__s", F.when(F.col("__v.error").isNull() & F.col("__v").isNotNull(), tier_scores("key_facts", F.col("__v.verdicts"))))
    error = F.coalesce(F.nullif("error", F.lit("")), "__failed", "__v.error", "__s.error")
    return out.select(*[c for c in responses.columns if c != "error"], F.lit(tag).alias("judge"), "rubric_reasoning", F.col("__s.core").alias("answer_correctness"), F.col("__s.detail").alias("answer_correctness_detail"), error.alias("error"))


def flatten_record(judged: DataFrame) -> DataFrame:
    """The 17 result columns in order."""
    return judged.select(*RESULT_COLUMNS)
