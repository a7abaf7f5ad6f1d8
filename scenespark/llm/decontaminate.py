"""Benchmark decontamination by winnowing, in DataFrame functions only.

A document and a benchmark item share a window of `window` words only if they share a
winnowing fingerprint: the least hash among the k-grams of such a window is the same on
both sides. So
  1. each document yields the least k-gram hash of every window, and those that some item
     has stay: a semi-join on bare hashes, which pairs no document with any item,
  2. documents with such a hash are tokenized again, and each place of a hit is extended
     to the windows around it,
  3. those windows meet the items' windows word for word. An item's windows are kept once
     however many items share them, with a class that stands for the set of those items,
     so a phrase that all documents and many items have costs each document one row.
Items shorter than a window have one window, the whole item; its hash is its fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable
from string import digits

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, cut, discard, text_key


def _run_of(ascii_kept: str) -> str:
    """Pattern of a run of these characters and of everything beyond ASCII.

    The others are listed one by one: Java looks a character up in a table then, where it
    walks a chain of ranges over ten times as slowly.
    """
    return "[^" + "".join(rf"\x{i:02X}" for i in range(128) if chr(i) not in ascii_kept) + "]+"


#: After lower-casing A-Z: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
WORD = _run_of(digits + LOWER)
#: The same words before lower-casing, for counting.
_ANY_CASE = _run_of(digits + LOWER + UPPER)
_KEY = ["__k1", "__k2"]


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _key(text: Column) -> list[Column]:
    return [k.alias(name) for k, name in zip(text_key(text), _KEY)]


def _joined(a: str, b: str, shift: int, op: Callable[[Column, Column], Column]) -> Column:
    """op of a's elements and those of b that lie shift further, as far as b goes."""
    size = F.greatest(F.size(b) - shift, F.lit(0))
    return F.zip_with(F.slice(a, 1, size), F.slice(b, shift + 1, size), op)


def _over(df: DataFrame, source: str, n: int, out: str, op: Callable[[Column, Column], Column]) -> DataFrame:
    """df with out: op over each n consecutive elements of source, by doubling; empty where there are fewer.

    Every step is a column of its own, so that it is computed once.
    """
    done, at = {1: source}, 1
    while 2 * at <= n:
        done[2 * at] = f"{out}{2 * at}"
        df = df.withColumn(done[2 * at], _joined(done[at], done[at], at, op))
        at *= 2
    now, covered = done[at], at
    for size in sorted(done, reverse=True):
        if covered + size <= n:
            name = f"{out}_{covered + size}"
            df = df.withColumn(name, _joined(now, done[size], covered, op))
            now, covered = name, covered + size
    return df.withColumn(out, F.col(now))


def _hashed(df: DataFrame, window: int, k: int, lengths: list[int]) -> DataFrame:
    """df (w: words) with g, the k-gram hashes, m, the winnowed ones, and n<length>, the hashes of so many words, for items of so few."""
    pair = lambda a, b: F.xxhash64(a, b)
    df = df.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    df = _over(df, "h", k, "g", pair)
    df = _over(df, "g", window - k + 1, "m", lambda a, b: F.least(a, b))
    for n in lengths:
        df = _over(df, "h", n, f"n{n}", pair)
    return df


def _fingerprints(lengths: list[int]) -> Column:
    return F.array_distinct(F.concat("m", *[F.col(f"n{n}") for n in lengths]))


def _windows(items: DataFrame, item_id: str, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """Items as (w, n) and their windows as (win, class, ids): each window once, ids the sorted items that have it, class a hash of ids."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    rows = rows.groupBy("w").agg(F.array_sort(F.array_compact(F.collect_set("item"))).alias("ids")).withColumn("n", F.least(F.size("w"), F.lit(window)))
    rows = cut(rows, "winnow_items")
    at = F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)
    own = rows.select("ids", F.explode(F.array_distinct(F.transform(at, lambda s: F.array_join(F.slice("w", s, F.col("n")), " ")))).alias("win"))
    own = own.groupBy("win").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    return rows, cut(own.withColumn("class", F.xxhash64("ids")), "winnow_windows")


def contaminated_spans(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5) -> DataFrame:
    """One row for each different text with a hit: (__k1, __k2, spans, n_hit, item_ids).

    spans: sorted [s, e) of words, the maximal runs that windows cover. item_ids: sorted
    as strings, without nulls.
    """
    if not 1 <= k <= window:
        raise ValueError("k must be between 1 and window")
    rows, wins = _windows(items, item_id, item_text, window)
    lengths = sorted(r[0] for r in rows.where(F.col("n") < window).select("n").distinct().collect())  # window - 1 at most
    known = F.when(F.col("n") == window, F.col("m")).otherwise(F.coalesce(*[F.when(F.col("n") == n, F.col(f"n{n}")) for n in lengths], F.array().cast("array<bigint>")))
    index = cut(_hashed(rows, window, k, lengths).select(F.explode(known).alias("f")).distinct(), "winnow_index")

    own = _hashed(docs.select(*_key(F.col(text)), words(F.col(text)).alias("w")), window, k, lengths)
    hits = own.select(*_KEY, F.explode(_fingerprints(lengths)).alias("f")).join(index, "f", "left_semi")
    hits = cut(hits.groupBy(*_KEY).agg(F.collect_set("f").alias("hits")), "winnow_hits")

    # Copies are combined before the shuffle.
    texts = docs.select(*_key(F.col(text)), F.col(text).alias("text")).groupBy(*_KEY).agg(F.first("text").alias("text")).join(hits, _KEY)
    found = _hashed(texts.select(*_KEY, "hits", words(F.col("text")).alias("w")), window, k, lengths)
    places = lambda c: F.filter(F.transform(c, lambda f, i: F.when(F.array_contains("hits", f), i)), lambda i: i.isNotNull())
    around = F.flatten(F.transform(places("g"), lambda i: F.sequence(F.greatest(i - (window - k), F.lit(0)), F.least(i, F.size("w") - window))))
    sized = lambda at, n: F.transform(at, lambda s: F.struct(s.alias("s"), F.lit(n).alias("n")))
    starts = [sized(F.array_distinct(around), window), *[sized(places(f"n{n}"), n) for n in lengths]]
    # In a text shorter than a window, no place can be extended to one.
    starts[0] = F.when(F.size("w") >= window, starts[0]).otherwise(F.array().cast("array<struct<s:int,n:int>>"))
    found = found.select(*_KEY, "w", F.concat(*starts).alias("at"))
    found = found.select(*_KEY, F.explode(F.transform("at", lambda x: F.struct(x["s"].alias("s"), (x["s"] + x["n"]).alias("e"), F.array_join(F.slice("w", x["s"] + 1, x["n"]), " ").alias("win")))).alias("x"))
    matched = cut(found.select(*_KEY, "x.*").join(wins.select("win", "class"), "win").select(*_KEY, "s", "e", "class"), "winnow_matches")

    order = Window.partitionBy(*_KEY).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = matched.select(*_KEY, "s", "e").distinct().withColumn("new", F.coalesce(F.col("s") > reach, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(order)).groupBy(*_KEY, "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    spans = runs.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"), F.sum(F.col("e") - F.col("s")).cast("long").alias("n_hit"))
    classes = wins.groupBy("class").agg(F.first("ids").alias("ids"))
    ids = matched.select(*_KEY, "class").distinct().join(classes, "class").groupBy(*_KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("item_ids"))
    out = cut(spans.join(ids, _KEY), "winnow_result")
    discard(rows, wins, index, hits, matched)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5) -> DataFrame:
    """docs with n_words long, n_hit long, item_ids, spans (in words) and contaminated, for every row.

    A null or empty text has no words, hence no hit. An item without words has no
    window. Repeated rows and equal texts get equal results; equal items count once by
    their id; an item with a null id hits words but is not listed. A very long text is one
    row, whole. An empty table on either side gives no hit. Columns of docs with the names
    of the new ones are replaced; others stay.
    """
    new = ["n_words", "n_hit", "item_ids", "spans", "contaminated"]
    found = contaminated_spans(docs.select(text), items.select(item_id, item_text), text, item_id, item_text, window, k)
    rows = docs.drop(*[c for c in new if c != text]).withColumn("n_words", F.coalesce(F.regexp_count(text, F.lit(_ANY_CASE)), F.lit(0)).cast("long"))
    k1, k2 = _key(F.col(text))
    rows = rows.withColumn("__k1", k1).withColumn("__k2", k2).join(found, _KEY, "left").drop(*_KEY)
    none = F.array().cast("array<string>")
    rows = rows.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("item_ids", F.coalesce("item_ids", none))
    return rows.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>"))).withColumn("contaminated", F.col("n_hit") > 0)
