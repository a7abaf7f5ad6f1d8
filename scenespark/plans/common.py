"""Both engines' last digits: doubles are rounded by one formula before they are compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import registry as R

DIGITS = 9


def final(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, doubles rounded to DIGITS."""
    kinds = dict(df.dtypes)
    r = lambda c: (F.floor(F.col(c) * 10.0**DIGITS + 0.5) / 10.0**DIGITS).alias(c) if kinds[c] == "double" else F.col(c)
    return df.select(*[r(c) for c in columns or df.columns])


def r9(expr: str) -> str:
    """final()'s rounding in SQL."""
    return f"floor(({expr}) * 1e9 + 5e-1) / 1e9"


def fits(rep: str, qt: str, host: str) -> bool:
    """Scope by the registry, for the SQL side."""
    alts = [set(n) for q, h, _, n in R.TYPE_NEEDS if q == qt and h in (None, host)]
    return not alts or any(a <= set(R.REP_CAPS.get(rep, R.CAPABILITIES)) for a in alts)


def values(rows: list[tuple], name: str, columns: str) -> str:
    """A CTE of literal rows."""
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


def scope_cte() -> str:
    types = sorted({q for q, *_ in R.TYPE_NEEDS})
    rows = [(r, q, h) for r in R.REP_CAPS for q in types for h in R.HOSTS if fits(r, q, h)]
    return values(rows, "scope", "rep, qt, host")
