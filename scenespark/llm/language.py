"""LM scoring: a hashed maximum-entropy model of the next token with a class-factored softmax.

A token's probability is that of its class times that of the token in its class, each a
softmax over hashed features of the tokens before it: the last one, the one before
that (a skip), and both together. Classes of frequent words are clusters of
words with like neighbours, of at most `SIZE` words. Other words share classes by their
last three bytes, and are told apart there by their counts alone, one added, with one
event left for all words never seen: so every text has a probability and all of a
position's sum to one.

Counts cover all training texts. The model is trained in rounds of distributed gradient
updates (iterative parameter mixing): every training text is in one round; each task
takes minibatch steps over its shard from the round's weights, and hands on the rows that
it changed, which are averaged in proportion to how often each shard saw the feature.
Model, dictionary and what each task hands on have fixed bounds. Only counts of words
outside the dictionary grow with the corpus; they are joined, never broadcast.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import below_share, cut, discard

#: Words with a class and a place in it; words whose counts travel with the model; classes' greatest size; clusters of either kind; endings.
FREQUENT, DICTIONARY, SIZE, CLUSTERS, RARE, ENDINGS = 1536, 65536, 64, 16, 16, 1024

#: Words whose neighbourhood tells classes apart; rows of the weight tables; tokens of a gradient step; its size.
LANDMARKS, HASHES, STEP, RATE = 128, 1 << 14, 4096, 0.15

#: Sixteenths of the training texts in each round, and tokens of a shard.
ROUNDS, SHARD = (1, 3, 12), 4 << 20

#: Rows of a weight table that travel together.
BLOCK = 1024

_FLUSH = 1 << 18
_BLOCKS = "name int, block int, part int, rows binary, weights binary, sums binary"
_FACTORS = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint64)


def tokens(text: bytes) -> list[bytes]:
    """What ASCII white space parts, A-Z lower-cased."""
    return text.lower().split()


def _ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def token_counts(texts: DataFrame) -> DataFrame:
    """(word, ending, c) of all texts (column text); combined within a task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = list(counts)
            b = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([_ending(w) for w in words], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["word", "ending", "c"])
            counts.clear()
            return b

        for b in batches:
            for t in b.column("text"):
                counts.update(tokens(t.as_buffer().to_pybytes()))
                if len(counts) >= _FLUSH:
                    yield out()
        if counts:
            yield out()

    return texts.select("text").mapInArrow(run, "word string, ending int, c long").groupBy("word", "ending").agg(F.sum("c").alias("c"))


class Words(dict):
    """Word -> number; a word that isn't there is noted, and its number tells its ending."""

    def __init__(self, words: list[bytes]) -> None:
        super().__init__(zip(words, range(len(words))))
        self.size, self.missed = len(words), []

    def __missing__(self, word: bytes) -> int:
        self.missed.append(word)
        return self.size + _ending(word)

    def number(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[list[bytes]]]:
        """Each text's numbers, and its words that aren't there."""
        lines, missed = [], []
        for t in texts:
            ws, self.missed = tokens(t), []
            lines.append(np.fromiter(map(self.__getitem__, ws), np.int32, len(ws)))
            missed.append(self.missed)
        return lines, missed


@dataclass
class Model:
    """Codes are frequent words, then endings, then the end of a text and what stands before its beginning."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    kinds: int
    ends: int
    frequent: int
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # of a dictionary number
    classes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # of a code
    places: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # of a code in its class
    rare_sums: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of a class
    class_bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    word_bias: np.ndarray = field(default_factory=lambda: np.zeros((0, SIZE), np.float32))
    tables: list[np.ndarray] = field(default_factory=list)  # class and word weights
    scales: list[np.ndarray] = field(default_factory=list)  # of each row of both: mean squares of its gradients so far

    @property
    def end(self) -> int:
        return self.frequent + ENDINGS

    def base(self, c: np.ndarray | float) -> np.ndarray | float:
        return np.log10((c + 1) / (self.total + self.kinds + 1))

    def lay(self, lines: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts in one line: codes (two marks before each text, an end after it), dictionary numbers (-1 for the end), and each text's length."""
        numbers, codes, end, marks = [], [], np.array([-1], np.int32), np.full(2, self.end + 1, np.int32)
        for line in lines:
            numbers += [line, end]
            codes += [marks, self.codes[line], end + (self.end + 1)]
        return np.concatenate(codes), np.concatenate(numbers), np.array([len(x) + 1 for x in lines])

    def encode(self, words: Words, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
        """lay() of texts, and each text's words outside the dictionary."""
        lines, missed = words.number(texts)
        return *self.lay(lines), missed

    def features(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the class table (a line a feature), and the last two codes, for rows of the word table."""
        last, skip = (codes[at - d].astype(np.uint64) for d in (1, 2))
        mixed = [last * _FACTORS[0], skip * _FACTORS[1] + np.uint64(1), last * _FACTORS[2] + (skip + np.uint64(7)) * _FACTORS[3]]
        return np.stack([_hash(m) for m in mixed]), np.stack((last, skip))


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(50)).astype(np.uint16)


def _word_rows(back: np.ndarray, classes: np.ndarray) -> np.ndarray:
    c = classes.astype(np.uint64) * np.uint64(1000003)
    return np.stack([_hash((back[d] * _FACTORS[d] + np.uint64(11 + d)) ^ c) for d in (0, 1)])


def _logits(bias: np.ndarray, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = np.take(table, rows[0], axis=0, mode="clip")
    for more in rows[1:]:
        z += np.take(table, more, axis=0, mode="clip")
    z += bias
    z -= z.max(axis=1, keepdims=True)
    return z


def _log_softmax(bias: np.ndarray, table: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probabilities of the targets."""
    z = _logits(bias, table, rows)
    own = z[np.arange(len(z)), target]
    np.exp(z, out=z)
    return own - np.log(z.sum(axis=1))


def _gradient(bias: np.ndarray, table: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of the negative log probabilities by the logits: all probabilities, less one at the target."""
    z = _logits(bias, table, rows)
    np.exp(z, out=z)
    z *= 1 / z.sum(axis=1, keepdims=True)
    z[np.arange(len(z)), target] -= 1
    return z


def _step(table: np.ndarray, scale: np.ndarray, seen: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
    """One gradient step on the rows that the tokens' features name; each row's steps shrink with its gradients so far."""
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")
    flat, token = flat[order], order % rows.shape[1]
    heads = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    times = np.diff(np.concatenate((heads, [len(flat)])))
    # Rows of a few tokens are summed together, token by token; the few of many each in one run.
    sums, left = gradient[token[heads]], np.flatnonzero((times > 1) & (times <= 6))
    for k in range(1, 6):
        sums[left] += gradient[token[heads[left] + k]]
        left = left[times[left] > k + 1]
    often = times > 6
    if often.any():
        runs = times[often]
        sums[often] = np.add.reduceat(gradient[token[np.repeat(often, times)]], np.cumsum(runs) - runs, axis=0)
    at = flat[heads]
    seen[at] += times
    scale[at] += np.einsum("ij,ij->i", sums, sums) / sums.shape[1]
    table[at] -= sums * (RATE / np.sqrt(scale[at] + 1e-8))[:, None]


class Trainer:
    """Minibatch steps of one shard."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.tables, self.scales = [t.copy() for t in model.tables], [t.copy() for t in model.scales]
        self.seen = [np.zeros(HASHES, np.float32) for _ in self.tables]

    def learn(self, codes: np.ndarray) -> None:
        m = self.model
        places = np.flatnonzero(codes != m.end + 1)
        for i in range(0, len(places), STEP):
            at = places[i : i + STEP]
            target = codes[at]
            rows, back = m.features(codes, at)
            cls = m.classes[target]
            _step(self.tables[0], self.scales[0], self.seen[0], rows, _gradient(m.class_bias, self.tables[0], rows, cls))
            known = np.flatnonzero(m.places[target] >= 0)
            if len(known):
                c, place = cls[known], m.places[target[known]]
                rows = _word_rows(back[:, known], c)
                _step(self.tables[1], self.scales[1], self.seen[1], rows, _gradient(m.word_bias[c], self.tables[1], rows, place))

    def changes(self, part: int) -> Iterator[pa.RecordBatch]:
        for name, seen in enumerate(self.seen):
            change = [np.column_stack((x.tables[name], x.scales[name])) for x in (self, self.model)]
            yield from _blocks(name, part, np.flatnonzero(seen), seen, change[0] - change[1])


def _blocks(name: int, part: int, rows: np.ndarray, weights: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of a matrix that are to be summed, block by block; each times its weight."""
    for block in np.unique(rows // BLOCK):
        own = rows[rows // BLOCK == block].astype(np.int32)
        w = weights[own].astype(np.float32)
        cells = [own.tobytes(), w.tobytes(), (values[own] * w[:, None]).astype(np.float32).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([block], pa.int32()), pa.array([part], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], names=["name", "block", "part", "rows", "weights", "sums"])


def _summed(widths: list[int]):
    """Sums of equal blocks that stand together; no more than one block is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, weights, sums = None, None, None

        def out() -> Iterator[pa.RecordBatch]:
            if key is not None:
                rows = np.flatnonzero(weights).astype(np.int32)
                cells = [(rows + key[1] * BLOCK).tobytes(), weights[rows].astype(np.float32).tobytes(), sums[rows].astype(np.float32).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([key[2]], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], names=["name", "block", "part", "rows", "weights", "sums"])

        for b in batches:
            for name, block, salt, rows, w, s in zip(*(b.column(c) for c in ("name", "block", "salt", "rows", "weights", "sums"))):
                now = (name.as_py(), block.as_py(), salt.as_py())
                if now != key:
                    yield from out()
                    key, weights, sums = now, np.zeros(BLOCK), np.zeros((BLOCK, widths[now[0]]))
                at = np.frombuffer(rows.as_py(), np.int32) - now[1] * BLOCK
                weights[at] += np.frombuffer(w.as_py(), np.float32)
                sums[at] += np.frombuffer(s.as_py(), np.float32).reshape(len(at), -1)
        yield from out()

    return run


def _total(blocks: DataFrame, sizes: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, sums) of each matrix over all tasks: by 16 groups of tasks, then over these. Only sums of fixed size reach the driver."""
    blocks = cut(blocks, "language_changes")
    widths = [w for _, w in sizes]
    salted = blocks.withColumn("salt", F.col("part") % 16)
    part = salted.repartition("name", "block", "salt").sortWithinPartitions("name", "block", "salt", "part").mapInArrow(_summed(widths), _BLOCKS)
    whole = part.withColumn("salt", F.lit(0)).repartition("name", "block").sortWithinPartitions("name", "block", "part").mapInArrow(_summed(widths), _BLOCKS)
    out = [(np.zeros(n, np.float32), np.zeros((n, w), np.float32)) for n, w in sizes]
    for r in whole.collect():
        at = np.frombuffer(r["rows"], np.int32)
        out[r["name"]][0][at] = np.frombuffer(r["weights"], np.float32)
        out[r["name"]][1][at] = np.frombuffer(r["sums"], np.float32).reshape(len(at), -1)
    discard(blocks)
    return out


def _numbered(batch: pa.RecordBatch, part: int = 256) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The rows of a batch some at a time, with their texts' dictionary numbers."""
    for i in range(0, len(batch), part):
        some = batch.slice(i, part)
        yield some, [np.frombuffer(x.as_buffer(), np.int32) for x in some.column("numbers")]


def _over(encoded: DataFrame, size: int, work, schema: str) -> DataFrame:
    """work(lists of texts' numbers, task number) over encoded texts, in tasks of about a shard each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work((lines for b in batches for _, lines in _numbered(b)), TaskContext.get().partitionId())

    return encoded.select("numbers").coalesce(max(1, -(-size // SHARD))).mapInArrow(run, schema)


def _clusters(vectors: np.ndarray, k: int, passes: int = 12) -> np.ndarray:
    """k-means of rows taken as distributions (Hellinger), from evenly spaced rows."""
    x = np.sqrt(vectors / np.maximum(vectors.sum(axis=1, keepdims=True), 1))
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    of = np.zeros(len(x), int)
    for _ in range(passes):
        of = (x @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1)
        sums, n = np.zeros_like(centres), np.bincount(of, minlength=len(centres))
        np.add.at(sums, of, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return of


def _with_classes(model: Model, near: np.ndarray, ending_sums: np.ndarray) -> None:
    """Classes of the codes from their neighbours, and the biases that give each token its share of the counts."""
    k = model.frequent
    sizes, classes, places = [1], np.zeros(model.end + 2, np.int32), np.full(model.end + 2, -1, np.int32)
    places[model.end] = 0  # the end of a text is a class of its own
    if k:
        of = _clusters(near[:k], CLUSTERS)
        for c in np.unique(of):
            members = np.flatnonzero(of == c)  # by falling count, as codes are
            for i in range(0, len(members), SIZE):
                own = members[i : i + SIZE]
                classes[own], places[own] = len(sizes), np.arange(len(own))
                sizes.append(len(own))
    first = len(sizes)
    of = _clusters(near[k : k + ENDINGS], RARE)
    classes[k : k + ENDINGS] = first + of
    model.classes, model.places = classes, places
    model.rare_sums = np.zeros(first + RARE)
    np.add.at(model.rare_sums, first + of, ending_sums)
    mass = model.rare_sums + 1
    mass[:first] = np.bincount(classes[:k], model.counts[:k] + 1, first) if k else 1
    mass[0] = model.ends + 1
    model.class_bias = np.log(mass / mass.sum()).astype(np.float32)
    model.word_bias = np.full((first, SIZE), -1e9, np.float32)
    model.word_bias[classes[:k], places[:k]] = np.log((model.counts[:k] + 1) / mass[classes[:k]])
    model.word_bias[0, 0] = 0
    model.tables = [np.zeros((HASHES, width), np.float32) for width in (len(mass), SIZE)]
    model.scales = [np.zeros(HASHES, np.float32) for _ in model.tables]


def dictionary_of(counts: DataFrame, ends: int, frequent: int = FREQUENT, dictionary: int = DICTIONARY) -> Model:
    """A model without weights: the most frequent words of token_counts(), about `dictionary` at most; ends: how many texts they are from.

    A histogram of the counts' logarithms tells from which count on words fit; of those in
    the strip where it fills up, as many as there is room for are taken by a hash. Only
    the histogram and the words taken reach the driver.
    """
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    strip = F.floor(F.log2("c") * 64).cast("int")
    room, taken = dictionary, F.lit(False)
    for r in sorted(counts.groupBy(strip.alias("s")).count().collect(), key=lambda r: -r["s"]):
        taken = strip >= r["s"] if room >= r["count"] else (strip > r["s"]) | ((strip == r["s"]) & below_share(F.xxhash64("word"), room / r["count"]))
        room -= r["count"]
        if room <= 0:
            break
    top = sorted(counts.where(taken).select("word", "c").collect(), key=lambda r: (-r["c"], r["word"]))
    model = Model([r["word"].encode() for r in top], np.array([r["c"] for r in top], np.int64), total + ends, kinds + (ends > 0), ends, min(frequent, len(top)))
    k = model.frequent
    model.codes = np.concatenate((np.arange(k), k + np.array([_ending(w) for w in model.words[k:]], int), k + np.arange(ENDINGS))).astype(np.int32)
    return model


def encode(rows: DataFrame, model: Model) -> DataFrame:
    """rows (column text; others stay) with their texts' numbers (32-bit, as bytes) and their words outside the dictionary in place of the text; written."""
    shared = rows.sparkSession.sparkContext.broadcast(model.words)
    keep = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value)
        for b in batches:
            for i in range(0, len(b), 1024):
                part = b.slice(i, 1024)
                lines, missed = words.number([t.as_buffer().to_pybytes() for t in part.column("text")])
                rare = [list(Counter(w).items()) for w in missed]
                offsets = np.concatenate(([0], np.cumsum([len(r) for r in rare]))).astype(np.int32)
                flat = pa.StructArray.from_arrays([pa.array([w for r in rare for w, _ in r], pa.binary()).cast(pa.string()), pa.array([n for r in rare for _, n in r], pa.int32())], names=["word", "n"])
                columns = [pa.array([x.tobytes() for x in lines], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), flat)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *columns], names=[*keep, "numbers", "rare"])

    out = rows.select(*keep, "text").mapInArrow(run, f"{schema}, numbers binary, rare array<struct<word:string,n:int>>")
    return cut(out.withColumn("row", F.monotonically_increasing_id()), "language_encoded")


def fit(encoded: DataFrame, counts: DataFrame, model: Model) -> Model:
    """The model with weights learned from encode()d texts (columns numbers, round: 0 to 15)."""
    spark = encoded.sparkSession
    k, sums = model.frequent, np.zeros(ENDINGS)
    for r in counts.groupBy("ending").agg(F.sum(F.col("c") + 1).alias("n")).collect():
        sums[r["ending"]] = r["n"]
    for w, c in zip(model.words[:k], model.counts[:k]):
        sums[_ending(w)] -= c + 1
    sizes = {r[0]: r[1] for r in encoded.groupBy("round").agg(F.sum(F.octet_length("numbers") / 4 + 1).cast("long")).collect()}
    shared = spark.sparkContext.broadcast(model)

    def neighbourhoods(texts: Iterator[list[np.ndarray]], part: int) -> Iterator[pa.RecordBatch]:
        m = shared.value
        near = np.zeros((m.end + 2) * LANDMARKS, np.int64)
        for lines in texts:
            codes = m.lay(lines)[0].astype(np.int64)
            at = np.flatnonzero(codes < min(LANDMARKS, m.frequent))  # never a line's first or last
            for beside in (codes[at - 1], codes[at + 1]):
                np.add.at(near, beside * LANDMARKS + codes[at], 1)
        near = near.reshape(-1, LANDMARKS)
        rows = np.flatnonzero(near.any(axis=1))
        yield from _blocks(0, part, rows, np.ones(len(near)), near)

    near = _total(_over(encoded, sum(sizes.values()), neighbourhoods, _BLOCKS), [(-(-(model.end + 2) // BLOCK) * BLOCK, LANDMARKS)])[0][1]
    shared.destroy()
    _with_classes(model, near.astype(float), sums)

    start = 0
    for share in ROUNDS:
        end = start + share
        size = sum(sizes.get(r, 0) for r in range(start, end))
        shared = spark.sparkContext.broadcast(model)

        def learned(texts: Iterator[list[np.ndarray]], part: int, shared=shared) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(shared.value)
            for lines in texts:
                trainer.learn(trainer.model.lay(lines)[0])
            yield from trainer.changes(part)

        mine = encoded.where((F.col("round") >= start) & (F.col("round") < end))
        summed = _total(_over(mine, size, learned, _BLOCKS), [(HASHES, t.shape[1] + 1) for t in model.tables])
        for table, scale, (seen, change) in zip(model.tables, model.scales, summed):
            change /= np.maximum(seen, 1)[:, None]
            table += change[:, :-1]
            scale += change[:, -1]
        shared.destroy()
        start = end
    return model


def log_probabilities(model: Model, codes: np.ndarray) -> np.ndarray:
    """log10 of each token's probability, but for the share of a rare word's count in its class."""
    places = np.flatnonzero(codes != model.end + 1)
    out = np.empty(len(places))
    for i in range(0, len(places), STEP):
        at = places[i : i + STEP]
        target = codes[at]
        rows, back = model.features(codes, at)
        cls = model.classes[target]
        log = _log_softmax(model.class_bias, model.tables[0], rows, cls).astype(float)
        known = model.places[target] >= 0
        k = np.flatnonzero(known)
        if len(k):
            log[k] += _log_softmax(model.word_bias[cls[k]], model.tables[1], _word_rows(back[:, k], cls[k]), model.places[target[k]])
        log[~known] -= np.log(model.rare_sums[cls[~known]] + 1)
        out[i : i + STEP] = log
    return out / np.log(10)


def _scored(shared):
    """Of each text: tokens, words known, sums of base and model, as far as the dictionary goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        counts = np.concatenate((m.counts, np.zeros(ENDINGS, np.int64), [m.ends]))
        in_dictionary = np.arange(len(counts)) < len(m.words)
        in_dictionary[-1] = True
        base = np.where(in_dictionary, m.base(counts), m.base(0))
        # A rare word's count is part of the model's probability, too.
        own = np.where(in_dictionary & (np.arange(len(counts)) >= m.frequent), np.log10(counts + 1), 0)
        own[-1] = 0
        for b in batches:
            for part, lines in _numbered(b):
                codes, numbers, sizes = m.lay(lines)
                heads = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                log = log_probabilities(m, codes) + own[numbers]
                known = in_dictionary[numbers] & (counts[numbers] > 0)
                sums = [np.add.reduceat(v, heads) for v in (known.astype(np.int64), base[numbers], log)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "id", "held_out")), pa.array(sizes, pa.int64()), *map(pa.array, sums)], names=["row", "id", "held_out", "n_tokens", "n_known", "base", "log"])

    return run


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, learned from those not held out.

    Tokens are what ASCII white space parts, A-Z lower-cased, and an end; a null text is
    empty and so has an end alone. base_score is the add-one unigram log10 probability of
    the text, score the model's. Repeated rows are learned from and scored each; equal
    texts have equal scores but for rounding; whole texts are read, however long, 256 texts
    at a time. Without training rows each token is an unseen one; an empty table gives an
    empty one. Columns of other names are not read. Held-out texts leave no trace in model
    or counts; a null held_out counts as false.
    """
    spark: SparkSession = docs.sparkSession
    ids = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    train = rows.where("NOT held_out")
    counts = cut(token_counts(train), "language_counts")
    model = dictionary_of(counts, train.count())
    encoded = encode(rows.withColumn("round", F.pmod(F.xxhash64("text"), F.lit(16)).cast("int")), model)
    shared = spark.sparkContext.broadcast(fit(encoded.where("NOT held_out"), counts, model))
    schema = f"row long, id {ids}, held_out boolean, n_tokens long, n_known long, base double, log double"
    scored = encoded.select("row", "id", "held_out", "numbers").mapInArrow(_scored(shared), schema)
    rare = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n").join(counts.select("word", "c"), "word")
    log = F.col("n") * F.log10(F.col("c") + 1)
    seen = rare.groupBy("row").agg(F.sum("n").alias("more"), F.sum(log).alias("own"))
    out = scored.join(seen, "row", "left")
    more = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + more("more")).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + more("own")).alias("base_score"), (F.col("log") + more("own")).alias("score"),
    )
