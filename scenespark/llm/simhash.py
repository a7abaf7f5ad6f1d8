"""SimHash near-duplicates: a positional byte index with count filtering, then components.

Two 64-bit fingerprints that differ in `max_bits` = 4 bits or fewer differ in 4 bytes
or fewer, so they share at least 8 - 4 = 4 of their 8 bytes, place by place. The index
is keyed by several positional bytes at once: a family of position sets is used such
that any 4 positions contain one of the sets whole (7 pairs, 20 triples or all 70
quadruples: more fingerprints, longer keys). A pair that reaches the minimum of 4
shared bytes thus meets in a posting list. There its shared bytes are tallied, pairs
below the minimum are dropped, and the rest are verified by their differing bits.

Only different fingerprints are indexed, so copies cost nothing. A posting list emits
a spanning forest of its links rather than its pairs. A list of more than `long_list`
fingerprints is not gathered at all: two fingerprints lie within 4 bits exactly if some
value lies within 2 bits of both, so each member of such a list is linked to the values
around it by a grouped minimum, which is linear in the list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

BYTES = 8
_NEW = ("fp", "component_id", "component")


def cover(width: int) -> list[tuple[int, ...]]:
    """Sets of `width` byte positions such that any 4 of the 8 positions contain one of them.

    Three parts of the positions: a set lies in one part, or (triples) has two in
    one part and one in the next.
    """
    parts = [(0, 1, 2), (3, 4, 5), (6, 7)]
    if width == 2:
        return [c for p in parts for c in combinations(p, 2)]
    if width == 3:
        inside = [p for p in parts if len(p) == 3]
        return inside + [tuple(sorted((*two, one))) for i, p in enumerate(parts) for two in combinations(p, 2) for one in parts[(i + 1) % 3]]
    return list(combinations(range(BYTES), 4))


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of one text: bit i is set if over half of the shingles' hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    h = xxhash.xxh64_intdigest
    last = ends[min(shingle, len(words)) - 1 :]
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 65536):  # a very long text takes no more memory than this at a time
        hashes = np.array([h(line[s:e], seed) for s, e in zip(starts[i : min(n, i + 65536)].tolist(), last[i : i + 65536].tolist())], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, id_col: str, text: str, keep: list[str], shingle: int, seed: int) -> DataFrame:
    """keep columns and __fp: the fingerprint as a signed long."""
    schema = docs.select(*keep).withColumn("__fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column("__text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(values)], names=[*keep, "__fp"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(255)


def _forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one posting list: few passes, each over blocks of rows."""
    n = len(fps)
    label = np.arange(n)
    a, b = [], []
    by = fps.view(np.uint8).reshape(n, BYTES)

    def find(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i in range(n - 1):
        rest = slice(i + 1, n)
        tally = (by[rest] == by[i]).sum(axis=1)  # shared positional bytes
        near = np.flatnonzero(tally >= BYTES - max_bits)
        near = near[np.bitwise_count(fps[rest][near] ^ fps[i]) <= max_bits] + i + 1
        for j in near.tolist():
            x, y = find(i), find(j)
            if x != y:
                label[max(x, y)] = min(x, y)
                a.append(i)
                b.append(j)
    return fps[a], fps[b]


def links(fps: DataFrame, max_bits: int = 4, width: int | None = None, long_list: int = 8192) -> DataFrame:
    """(a, b): links between different fingerprints (column fp, distinct longs) that connect all that lie within max_bits.

    Every pair within max_bits is connected through rows of the result, and every row
    is such a pair or (from long lists) joins both to a value between them.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("the byte index guarantees a shared key for up to 4 bits")
    if width is None:
        n = fps.count()
        width = 2 if n < 1 << 16 else 3 if n < 1 << 26 else 4
    keys = []
    for number, places in enumerate(cover(width)):
        key = F.lit(number).cast("long")
        for p in places:
            key = key * 256 + _byte(F.col("fp"), p)
        keys.append(key)
    posted = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = cut(posted.groupBy("key").count().where("count > 1"), "simhash_sizes")
    lists = posted.join(sizes.where(F.col("count") <= long_list).select("key"), "key").groupBy("key").agg(F.collect_list("fp").alias("fps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_forest(np.sort(np.array(x.as_py(), np.int64).view(np.uint64)), max_bits) for x in batch.column("fps")]
            if out:
                a, b = (np.concatenate([o[i] for o in out]).view(np.int64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    near = lists.select("fps").mapInArrow(run, "a long, b long").distinct()
    crowded = cut(posted.join(sizes.where(F.col("count") > long_list).select("key"), "key").select("fp").distinct(), "simhash_crowded")
    return near if crowded.isEmpty() else near.unionByName(_through_middle(crowded, max_bits))


def _through_middle(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links of all that lie within max_bits of one another, by values in the middle."""
    reach, odd = divmod(max_bits, 2)
    masks = [0] + [sum(1 << b for b in c) for k in range(1, reach + 1) for c in combinations(range(64), k)]
    more = [sum(1 << b for b in c) for c in combinations(range(64), reach + 1)] if odd else []
    signed = lambda xs: [x - (1 << 64) if x >> 63 else x for x in xs]
    ball = lambda xs: F.transform(F.array(*[F.lit(x).cast("long") for x in signed(xs)]), lambda m: F.col("fp").bitwiseXOR(m))
    inner = fps.select("fp", F.explode(ball(masks)).alias("mid"))
    least = inner.groupBy("mid").agg(F.min("fp").alias("least"), F.max("fp").alias("most"))
    if not odd:
        shared = least.where("least <> most").select("mid", "least")
        return inner.join(shared, "mid").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()
    outer = fps.select("fp", F.explode(ball(masks + more)).alias("mid"))
    return outer.join(least, "mid").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_bits: int = 4, shingle: int = 4, seed: int = 42, keep: list[str] | None = None, width: int | None = None, long_list: int = 8192) -> DataFrame:
    """keep columns (default: the id) with fp long, component_id (the least id reachable over links) and component (its least fp).

    A text without words (null, empty, white space) has fingerprint 0 and links like any
    other; one of fewer than `shingle` words has its whole sequence as one shingle.
    Repeated rows each get their row. Null ids are never a component's least id, unless
    it has no other. An empty table gives an empty table. Ids must be ordered (any type
    that min() takes); columns other than the id and the text are not read unless kept,
    and kept ones with the names of the new ones are replaced.
    """
    keep = [c for c in dict.fromkeys([id_col, *(keep or [])]) if c not in _NEW or c == id_col]
    rows = cut(with_fingerprint(docs, id_col, text, keep, shingle, seed), "simhash")
    fps = cut(rows.groupBy("__fp").agg(F.min(id_col).alias("__least")), "simhash_fps")
    comp = components(links(fps.select(F.col("__fp").alias("fp")), max_bits, width, long_list), "a", "b")
    comp = fps.join(comp, fps["__fp"] == comp["node"], "left").select("__fp", "__least", F.coalesce("component", "__fp").alias("__c"))
    comp = cut(comp, "simhash_components")
    least = comp.groupBy("__c").agg(F.min("__least").alias("component_id"))
    out = rows.join(comp.join(least, "__c").select("__fp", "component_id", F.col("__c").alias("component")), "__fp")
    return out.select(*keep, F.col("__fp").alias("fp"), "component_id", "component")
