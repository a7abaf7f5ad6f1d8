"""Links between texts whose sets of five-word shingles have a Jaccard similarity of `least` or more.

Candidates come from MinHash bands: 24 bands of 5 minima, by which a pair at 0.8 is met
with probability 0.9999. Small buckets give their pairs. The texts of buckets of more
than `crowd` (large clusters of near copies, or texts with a template in common) are
joined among themselves by an exact set-similarity join instead: each text's shingles
are ordered, rare ones first, and a pair at `least` must share one among the first
|x| - ceil(least |x|) + 1 of the larger text and the first |y| - ceil(2 least / (1 +
least) |y|) + 1 of the smaller. A template that is not nearly all of a text is behind
those, so it makes no candidates. Lists of a shingle that are still long are near copies
for the most part: members are held against two, then up to sixteen of them, and only
those that these links leave in other classes than the largest are held against all.
Lengths, positions and parity bitmaps rule pairs out before any set is fetched. Every
link is verified on the exact sets; texts never meet in a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

BANDS, ROWS = 24, 5
#: Cells that shingles of crowded texts are counted in, for their order alone; longs of a parity bitmap; salts of a long list.
CELLS, LONGS, SALTS = 1 << 18, 16, 16
#: Odd factors of the hash family, from a fixed seed.
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PAIR = "a1 long, a2 long, b1 long, b2 long"


def shingle_set(text: bytes, k: int = 5) -> np.ndarray:
    """The different XXH3 hashes, rising, of each k words in a row (A-Z lower-cased, one space between them); fewer words are one shingle, none give none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - k + 1)
    h = xxhash.xxh3_64_intdigest
    return np.unique(np.array([h(line[s:e]) for s, e in zip(starts[:n].tolist(), ends[-n:].tolist())], np.uint64))


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets; 0 where one is empty."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if both else 0.0


def jaccard(a: bytes, b: bytes) -> float:
    """Of the five-word shingle sets of two texts; 0 where one has no words."""
    return similarity(shingle_set(a), shingle_set(b))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _band_keys(grams: np.ndarray) -> np.ndarray:
    least = np.concatenate([_mixed(grams[:, None] * _FACTORS[i : i + BANDS]).min(axis=0) for i in range(0, len(_FACTORS), BANDS)]).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) ^ least[:, r])
    return key


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    for b in batches:
        for k1, k2, t in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("text")):
            grams = shingle_set(t.as_buffer().to_pybytes())
            if len(grams):
                yield k1, k2, grams


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = _rows(batches)
    while some := [(k1, k2, _band_keys(g)) for (k1, k2, g), _ in zip(rows, range(2048))]:
        k1, k2, keys = zip(*some)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(k1, BANDS)), pa.array(np.repeat(k2, BANDS)), pa.array(np.concatenate(keys).view(np.int64))], names=["k1", "k2", "key"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each bucket's members, a few thousand at a time."""
    names = ["a1", "a2", "b1", "b2"]
    for b in batches:
        rows: list[tuple] = []
        for m in b.column("members"):
            rows += ((x["k1"], x["k2"], y["k1"], y["k2"]) for x, y in combinations(sorted(m.as_py(), key=lambda t: (t["k1"], t["k2"])), 2))
            if len(rows) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of this task a cell's shingles occur."""
    counts = np.zeros(CELLS, np.int64)
    for _, _, grams in _rows(batches):
        np.add.at(counts, grams >> np.uint64(46), 1)
    at = np.flatnonzero(counts)
    for i in range(0, len(at), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 16)].astype(np.int32)), pa.array(counts[at[i : i + (1 << 16)]])], names=["cell", "n"])


def prefixes(n: int, least: float) -> tuple[int, int]:
    """Of a set of n: how many of its first members a pair at `least` must look at, if the other is smaller, and if it is larger."""
    return n - math.ceil(least * n - 1e-9) + 1, n - math.ceil(2 * least / (1 + least) * n - 1e-9) + 1


def _postings(least: float, order: np.ndarray):
    """Each text's first shingles by their cells' counts (their logarithms, as in `order`), with all that rules pairs out."""
    names = ["token", "k1", "k2", "n", "pos", "index", "bits"]
    span = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k1, k2, grams in _rows(batches):
            n = len(grams)
            probe, index = prefixes(n, least)
            parity = np.bincount((_mixed(grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64), minlength=64 * LONGS) & 1
            bits = np.packbits(parity.astype(np.uint8)).view(np.int64).tolist()
            first = grams[np.lexsort((grams, order[grams >> np.uint64(46)]))[:probe]]
            for i in range(0, probe, 8192):
                pos = np.arange(i, min(probe, i + 8192), dtype=np.int32)
                m = len(pos)
                yield pa.RecordBatch.from_arrays([pa.array(first[pos].view(np.int64)), pa.array(np.full(m, k1)), pa.array(np.full(m, k2)), pa.array(np.full(m, n, np.int32)), pa.array(pos), pa.array(pos < index), pa.array([bits] * m, span)], names=names)

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(t.as_buffer().to_pybytes()).tobytes() for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(sets, pa.binary())], names=["k1", "k2", "grams"])


def _verified(least: float):
    names = ["a1", "a2", "b1", "b2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = zip(*([np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(c)] for c in ("ag", "bg")))
            yield b.select(names).filter(pa.array([similarity(x, y) >= least for x, y in both], pa.bool_()))

    return run


def _linked(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Of the pairs (a1, a2, b1, b2) those whose sets resemble each other. Sets are made once a text, and of these texts alone."""
    ends = pairs.select(F.col("a1").alias("k1"), F.col("a2").alias("k2")).unionByName(pairs.select(F.col("b1").alias("k1"), F.col("b2").alias("k2"))).distinct()
    sets = cut(texts.select("k1", "k2", "text").join(ends, ["k1", "k2"], "left_semi").mapInArrow(_sets, "k1 long, k2 long, grams binary"), "near_sets")
    side = lambda x: sets.select(F.col("k1").alias(f"{x}1"), F.col("k2").alias(f"{x}2"), F.col("grams").alias(f"{x}g"))
    both = pairs.join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"]).select("a1", "a2", "b1", "b2", "ag", "bg")
    return cut(both.mapInArrow(_verified(least), _PAIR), "near_links")


def _flat(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Pairs of keys (structs x and y) as distinct (a1, a2, b1, b2), the lesser key first."""
    pairs = pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a <> b")
    return pairs.select(*[F.col(f"{e}.k{i}").alias(f"{e}{i}") for e in "ab" for i in (1, 2)]).distinct()


def _classes(edges: DataFrame) -> DataFrame:
    """(me, cls) of each end of an edge: the class that the edges make it part of."""
    ends = edges.select(F.struct(F.col("a1").alias("k1"), F.col("a2").alias("k2")).alias("a"), F.struct(F.col("b1").alias("k1"), F.col("b2").alias("k2")).alias("b"))
    return components(ends, "a", "b").select(F.col("node").alias("me"), F.col("component").alias("cls"))


def _may(x: str, y: str, least: float) -> Column:
    """Whether members x and y of one list can be a pair at `least`: y the smaller and within its index prefix, or the other way round."""

    def way(large: str, small: str) -> Column:
        c = lambda e, name: F.col(f"{e}.{name}")
        need = F.ceil((c(large, "n") + c(small, "n")) * F.lit(least / (1 + least)) - 1e-9)
        fits = c(small, "index") & (c(small, "n") <= c(large, "n")) & (c(small, "n") >= F.ceil(c(large, "n") * F.lit(least) - 1e-9))
        return fits & (F.least(c(large, "n") - c(large, "pos"), c(small, "n") - c(small, "pos")) >= need)

    differ = F.aggregate(F.zip_with(f"{x}.bits", f"{y}.bits", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)
    total = F.col(f"{x}.n") + F.col(f"{y}.n")
    return (way(x, y) | way(y, x)) & (differ <= total - 2 * F.ceil(total * F.lit(least / (1 + least)) - 1e-9))


def _crowded(texts: DataFrame, keys: DataFrame, found: DataFrame, least: float, crowd: int) -> DataFrame:
    """All links among the texts of keys (k1, k2), but for pairs that other links (those of `found`, too) have put into one class."""
    some = texts.select("k1", "k2", "text").join(keys, ["k1", "k2"], "left_semi")
    cells = some.mapInArrow(_cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n >= 16").toArrow()
    order = np.zeros(CELLS, np.uint8)
    order[cells.column("cell").to_numpy()] = np.log2(cells.column("n").to_numpy()).astype(np.uint8)
    schema = "token long, k1 long, k2 long, n int, pos int, index boolean, bits array<long>"
    posted = cut(some.mapInArrow(_postings(least, order), schema), "near_postings")
    lists = posted.groupBy("token").agg(F.count(F.lit(1)).alias("members"), F.bool_or("index").alias("met")).where("members > 1 AND met")
    lists = cut(lists.select("token", "members"), "near_lists")
    member = F.struct(F.struct("k1", "k2").alias("me"), "n", "pos", "index", "bits")
    few = posted.join(lists.where(F.col("members") <= crowd).select("token"), "token").groupBy("token").agg(F.array_sort(F.collect_list(member)).alias("x"))
    few = few.select(F.explode(F.transform("x", lambda x, i: F.struct(x.alias("x"), F.slice("x", i + 2, F.size("x")).alias("ys")))).alias("e")).select("e.x", F.explode("e.ys").alias("y"))
    long = cut(posted.join(lists.where(F.col("members") > crowd), "token").select("token", "members", member.alias("x")), "near_long")
    ends = long.where("x.index").groupBy("token").agg(F.min(F.struct("x.me", "x")).alias("lo"), F.max(F.struct("x.me", "x")).alias("hi"))
    star = long.join(ends, "token").select("x", F.explode(F.array("lo.x", "hi.x")).alias("y"))
    pairs = few.unionByName(star).where("x.me <> y.me").where(_may("x", "y", least))
    links = _linked(cut(_flat(pairs, "x.me", "y.me"), "near_pairs"), texts, least)
    out = links

    def open_lists(edges: DataFrame) -> DataFrame:
        """Members of long lists in which there are two classes, with their own."""
        now = long.join(_classes(edges).withColumnRenamed("me", "key"), F.col("x.me") == F.col("key"), "left").withColumn("cls", F.coalesce("cls", "x.me")).drop("key")
        now = cut(now, "near_now")
        mixed = now.groupBy("token").agg(F.min("cls").alias("u"), F.max("cls").alias("v")).where("u <> v").select("token")
        return cut(now.join(mixed, "token", "left_semi"), "near_open")

    # Up to sixteen members of each such list against all of other classes, then what is left against all.
    now = open_lists(found.unionByName(links))
    if now.isEmpty():
        return out
    part = F.pmod(F.xxhash64("x.me"), F.lit(16))
    pivots = now.where("x.index").groupBy("token", part.alias("part")).agg(F.min(F.struct("x.me", "x", "cls")).alias("p")).select("token", F.col("p.x").alias("y"), F.col("p.cls").alias("of"))
    pairs = now.join(pivots, "token").where("cls <> of").where(_may("x", "y", least))
    links = _linked(cut(_flat(pairs, "x.me", "y.me"), "near_pairs"), texts, least)
    out = out.unionByName(links)
    now = open_lists(found.unionByName(out))
    if now.isEmpty():
        return out
    largest = now.groupBy("token", "cls").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.max(F.struct("c", "cls")).alias("top")).select("token", F.col("top.cls").alias("top"))
    # A long list's members are dealt by salts, the few that are held against them go to each.
    minor = now.join(largest, "token").where("cls <> top").select("token", F.col("x").alias("y"), F.col("cls").alias("of"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rest = now.withColumn("salt", F.pmod(F.xxhash64("x.me"), F.lit(SALTS)).cast("int"))
    pairs = rest.join(minor, ["token", "salt"]).where("cls <> of").where(_may("x", "y", least))
    return out.unionByName(_linked(cut(_flat(pairs, "x.me", "y.me"), "near_pairs"), texts, least))


def resembling(texts: DataFrame, least: float = 0.8, crowd: int = 32) -> DataFrame:
    """(a1, a2, b1, b2): keys of pairs of different texts (columns k1, k2, text) with a similarity of `least` or more.

    Of texts in a bucket of more than `crowd`, links that join two classes are all there;
    pairs within a class may be left out, as they change no class. A text without words
    resembles none. Very long texts are whole sets; no task gathers a bucket or a list.
    """
    posted = cut(texts.select("k1", "k2", "text").mapInArrow(_bands, "k1 long, k2 long, key long"), "near_bands")
    sizes = cut(posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near_sizes")
    lists = posted.join(sizes.where(F.col("n") <= crowd).select("key"), "key").groupBy("key").agg(F.collect_list(F.struct("k1", "k2")).alias("members"))
    pairs = cut(lists.select("members").mapInArrow(_pairs, _PAIR).distinct(), "near_pairs")
    found = _linked(pairs, texts, least)
    crowded = cut(posted.join(sizes.where(F.col("n") > crowd).select("key"), "key", "left_semi").select("k1", "k2").distinct(), "near_crowded")
    return found if crowded.isEmpty() else found.unionByName(_crowded(texts, crowded, found, least, crowd))
