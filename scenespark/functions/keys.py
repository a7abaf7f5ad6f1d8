"""Keys and null rules that many operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import CONTEXT_EXCEEDED


def id_key(c: str | Column) -> Column:
    """Sort key of an id: numbers by value, before all others by code point."""
    c = F.col(c) if isinstance(c, str) else c
    number = c.try_cast("bigint")
    return F.struct(number.isNull().alias("text"), number.alias("number"), c.alias("id"))


def host_of(scene: str | Column) -> Column:
    """The source dataset of a scene by its id; null and unprefixed ones are gibson's."""
    low = F.lower(F.col(scene) if isinstance(scene, str) else scene)
    return F.when(low.startswith("procthor"), "procthor").when(low.startswith("3rscan"), "3rscan").otherwise("gibson")


def is_ok(error: str | Column = "error") -> Column:
    return F.coalesce(F.col(error) if isinstance(error, str) else error, F.lit("")) == ""


def is_exceeded(error: str | Column = "error") -> Column:
    """A terminal overflow: never retried, never scored."""
    return F.coalesce((F.col(error) if isinstance(error, str) else error).startswith(CONTEXT_EXCEEDED), F.lit(False))


def error_class(error: str | Column = "error") -> Column:
    return F.when(is_ok(error), "ok").when(is_exceeded(error), "context_exceeded").otherwise("error")


def question_type(c: str = "question_type") -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) == "", "unknown").otherwise(F.col(c))


def tokens(c: str = "prompt_tokens") -> Column:
    """A token count that counts: not blank, not "0", and a number."""
    text = F.col(c).cast("string")
    return F.when(~text.isin("", "0"), text.try_cast("double"))


def row_key(scene: str = "scene_id", question: str = "question_id") -> Column:
    """The question id without its scene's prefix."""
    prefix = F.concat(F.col(scene), F.lit(":"))
    return F.when(F.startswith(F.col(question), prefix), F.substring(F.col(question), F.length(prefix) + 1, F.length(question))).otherwise(F.col(question))


def rounded(c: Column, digits: int | None) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits, which engines agree on; unchanged for None."""
    return c if digits is None else F.floor(c * 10.0**digits + 0.5) / 10.0**digits
