"""Spelling variants: words of a corpus at one edit, each led to its most frequent neighbour, and from there to a root.

Two words at one inserted, deleted or replaced code point have a common prefix and a
common suffix that together reach the longer one's length less one, so one of the two
reaches half of that. Words are therefore dealt by the first and by the last half of
what a pair of each length would share. Within such a bucket, blocks of words are laid
out as padded code-point matrices, and each pair of blocks is one dense tile: the
matrix of common prefixes plus that of common suffixes marks the single edits. A bucket
of more than one block is dealt as pairs of blocks, so no task holds more than two.
What leaves a tile is a line a word (neighbours, best neighbour), never a line a pair.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

#: Runs that count as words, once A-Z are lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")

#: Words of a block, and of the rows and columns of a tile computed at once.
BLOCK, TILE = 2048, 512

#: A batch's words are handed on when so many different ones are counted.
_FLUSH = 1 << 17

_NEAR = "word string, n_near long, best_n long, best string"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_length: int = 6, drop: int = 199) -> DataFrame:
    """(word, n): words of `least_length` code points or more, counted over all whole texts.

    Words are runs of letters with A-Z lower-cased. Where `drop` divides the crc32 of
    "<id>:<word>", the word has lost the code point at that hash modulo its length (a
    reproducible misprint); 0 leaves words as they are. A null text has no words, a null
    id counts as empty. Counts are combined within a task before anything is shuffled.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return b

        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("text")):
                own = Counter(RUN.findall(t.as_buffer().to_pybytes().lower().decode()))
                for w, n in own.items():
                    if len(w) >= least_length:
                        if drop and not (h := zlib.crc32(f"{i}:{w}".encode())) % drop:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                            if len(w) < least_length:
                                continue
                        counts[w] += n
                if len(counts) >= _FLUSH:
                    yield out()
        if counts:
            yield out()

    rows = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _matrix(words: list[str], width: int, right: bool) -> np.ndarray:
    """Code points, one row a word, padded with zeros behind or before."""
    laid = "".join(w.rjust(width, "\0") if right else w.ljust(width, "\0") for w in words)
    return np.frombuffer(laid.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width)


def _common(a: np.ndarray, b: np.ndarray, columns: Iterator[int]) -> np.ndarray:
    """For each row of a and each of b, in how many of the columns, from the first on, they agree."""
    run, total = np.ones((len(a), len(b)), bool), np.zeros((len(a), len(b)), np.int32)
    for c in columns:
        run &= a[:, c, None] == b[None, :, c]
        total += run
    return total


def single_edits(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, prefix): the pairs of a[i] and b[j] at exactly one edit, and the length of their common prefix."""
    width = max(map(len, a + b))
    la, lb = np.array([len(w) for w in a]), np.array([len(w) for w in b])
    prefix = _common(_matrix(a, width, False), _matrix(b, width, False), range(width))
    suffix = _common(_matrix(a, width, True), _matrix(b, width, True), range(width - 1, -1, -1))
    longer = np.maximum(la[:, None], lb[None, :])
    near = (prefix + suffix >= longer - 1) & (np.abs(la[:, None] - lb[None, :]) <= 1)
    near &= (prefix < longer) | (la[:, None] != lb[None, :])  # equal words; padding agrees with padding
    i, j = np.nonzero(near)
    return i, j, prefix[i, j]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket's pair of blocks: a line for each word that has a neighbour there."""
    for batch in batches:
        for longest, head, x, y, words in zip(*(batch.column(c) for c in ("longest", "head", "x", "y", "words"))):
            longest, head, x, y = longest.as_py(), head.as_py(), x.as_py(), y.as_py()
            rows = words.as_py()
            long = [r for r in rows if len(r["word"]) == longest]
            short = [r for r in rows if len(r["word"]) < longest]
            found: dict[str, list] = {}

            def note(a: dict, b: dict) -> None:
                line = found.setdefault(a["word"], [0, 0, ""])
                line[0] += 1
                if (-b["n"], b["word"]) < (-line[1], line[2]):
                    line[1:] = b["n"], b["word"]

            for p, q, same in ((long, long, True), (long, short, False)):
                for s in range(0, len(p), TILE):
                    for t in range(s if same else 0, len(q), TILE):
                        ps, qs = p[s : s + TILE], q[t : t + TILE]
                        i, j, prefix = single_edits([r["word"] for r in ps], [r["word"] for r in qs])
                        # Each pair counts once: in the blocks' own tile, and by its prefix where that reaches half.
                        keep = np.ones(len(i), bool) if head else prefix < longest // 2
                        for m, n in zip(i[keep].tolist(), j[keep].tolist()):
                            a, b = ps[m], qs[n]
                            if (same and s == t and m >= n) or {a["block"], b["block"]} != {x, y}:
                                continue
                            note(a, b)
                            note(b, a)
            if found:
                names = list(found)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([found[w][k] for w in names], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))], names=["word", "n_near", "best_n", "best"])


def neighbours(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word distinct, n) that have others at one edit; best: the most frequent, then the least.

    Words of any length take part, the empty one too (dealt with those of length one).
    """
    w, n = F.col("word"), F.length("word")
    sides = F.explode(F.array(*[F.struct((n + more).alias("longest"), F.lit(head).alias("head")) for more in (0, 1) for head in (True, False)])).alias("k")
    half = (F.col("k.longest") / 2).cast("int")
    part = F.when(F.col("k.head"), F.left(w, half)).otherwise(F.right(w, half))
    posted = words.select("word", "n", sides).select("word", "n", "k.longest", "k.head", part.alias("part"))
    key = ["longest", "head", "part"]
    # A bucket has pairs only if it has words of the full length, and two words at all.
    sizes = posted.groupBy(*key).agg(F.count(F.lit(1)).alias("members"), F.max(F.length("word")).alias("most")).where("members > 1 AND most = longest")
    sizes = cut(sizes.select(*key, F.ceil(F.col("members") / block).cast("int").alias("blocks")), "spelling_sizes")
    rows = posted.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    pair: Column = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y"))))
    tiles = rows.withColumn("pair", pair).groupBy(*key, "pair.x", "pair.y").agg(F.collect_list(F.struct("word", "n", "block")).alias("words")).where(F.size("words") > 1)
    lines = tiles.select("longest", "head", "x", "y", "words").mapInArrow(_tiles, _NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return lines.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def variants(words: DataFrame, ratio: int = 5, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word (word, n): its form is the most frequent word at one edit, if `ratio` times as frequent.

    Ties go to the least word in code-point order. The root is where forms end, found by
    pointer doubling; forms are ever more frequent, so they end. Rows with a null word
    are left out; rows that repeat a word are added up; an empty table gives an empty one.
    """
    words = cut(words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "spelling_words")
    near = words.join(neighbours(words, block), "word", "left")
    led = F.col("best_n") >= ratio * F.col("n")
    rows = cut(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(led, F.col("best")).alias("form"), F.when(led, F.col("best_n")).alias("form_n")), "spelling_forms")
    step = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    hops = cut(step, "spelling_roots")
    while True:
        ahead = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = cut(hops.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling_roots")
        moved = not new.where("moved").isEmpty()
        discard(hops)
        hops = new
        if not moved:
            break
    return rows.join(hops.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5, ratio: int = 5, drop: int = 199) -> DataFrame:
    """variants() of the words of all whole texts that occur `least_count` times or more.

    Null and empty texts have no words; repeated rows repeat their words; very long texts
    are one pass each; an empty table gives an empty table. Other columns are not read.
    """
    counts = word_counts(docs, id_col, text, least_length, drop)
    return variants(counts.where(F.col("n") >= least_count), ratio)
