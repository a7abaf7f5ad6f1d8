"""What several operators of this subpackage share: folding, text keys, ranges; and the tables of the shared folder."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import bucketed, cut, discard, new_path, ranked, scratch, shared_dir

__all__ = ["bucketed", "cut", "discard", "new_path", "ranked", "scratch", "shared_dir"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: White space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else. lower() is much faster and agrees on ASCII."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_key(text: Column) -> list[Column]:
    """Two hashes that stand for a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def below_share(h: Column, share: float) -> Column:
    """Whether a 64-bit hash lies in the lowest `share` of its range, to the full width of the hash."""
    return F.lit(True) if share >= 1 else h < min(int((share - 0.5) * 2**64), 2**63 - 1)


def id_keys(df: DataFrame, column: str, nulls_last: bool = True) -> list[Column]:
    """An id column as sort keys without nulls: whether it is null, then the value; integers by value, other types by their text."""
    c = F.col(column)
    whole = df.schema[column].dataType.typeName() in ("byte", "short", "integer", "long")
    null = c.isNull() if nulls_last else c.isNotNull()
    return [null.cast("int"), F.coalesce(c.cast("long"), F.lit(0).cast("long")) if whole else F.coalesce(c.cast("string"), F.lit(""))]


def range_bounds(rows: DataFrame, keys: list[str], size: Column, ranges: int | None = None, each: int = 8 << 20, most: int = 1 << 16, per: int = 16) -> list[tuple]:
    """Rising keys, each the greatest of a range of about equal bytes; keys: columns without nulls, integers or strings.

    There is a range for each shuffle partition, and more where one would hold over `each`
    bytes, up to `most`. Bounds come from a sample of `per` rows a range, taken by a hash
    of the keys, so equal rows always get equal bounds; only that sample reaches the
    driver. Keys are whole sort keys, so rows of one id are dealt to several ranges where
    they are many.
    """
    k = [F.col(c) for c in keys]
    n, total, top = rows.agg(F.count(F.lit(1)), F.sum(size), F.max(F.struct(*k))).first()
    if not n:
        return []
    want = ranges or min(most, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // each)))
    share = min(1.0, per * want / n)
    picked = rows.where(below_share(F.xxhash64(*k), share))
    sample = sorted((tuple(r[:-1]), r[-1] or 0) for r in picked.select(*k, size.alias("__size")).collect())
    out, passed, step = [], 0, max(1.0, sum(b for _, b in sample) / want)
    for key, b in sample:
        passed += b
        if passed >= step * (len(out) + 1) and (not out or key != out[-1]):
            out.append(key)
    out = [key for key in out[: want - 1] if key < tuple(top)]
    return [*out, tuple(top)]


def range_code(bounds: list[tuple], *keys: str) -> Column:
    """Twice the range that keys fall in, and one more for a range's greatest key. The bounds travel as data of the task, not as literals of the plan."""

    @F.arrow_udf("int")
    def code(*columns: pa.Array) -> pa.Array:
        out = []
        for key in zip(*(c.to_pylist() for c in columns)):
            i = bisect_left(bounds, key)
            out.append(2 * i + (bounds[i] == key))
        return pa.array(out, pa.int32())

    return code(*keys)
