"""Toxicity by a weighted lexicon: folded text, one Aho-Corasick pass, exception phrases, a score normalised by length.

Folding maps look-alike letters of other scripts and digits or signs that stand for
letters onto one form, in texts and lexicon alike; l and i are one class, because 1, !
and | stand for either. Terms are words or word beginnings. Their weights are smoothed
log-odds of documents, learned from labelled rows: terms are counted by Spark over a
sample of at most `max_rows` different labelled texts, and the model that leaves the
driver is a lexicon of at most `max_terms` terms and four coefficients.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import below_share, cut, text_key

# Letters that look alike, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ո": "n", "օ": "o", "ѵ": "v", "ԁ": "d", "ԛ": "q", "ԝ": "w",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
INVISIBLE = "­​‌‍⁠﻿"

#: Words that are insults whatever the corpus; learned weights replace the weight below.
SEEDS = "idiot imbecile moron stupid dumb loser scum trash pathetic disgusting worthless clown jerk bastard bitch whore slut faggot retard crétin abruti connard salope imbécile idiote dummkopf trottel arschloch schlampe vollidiot estúpido imbécil gilipollas puta cabrón pendejo".split()
SEED_WEIGHT = 3.0

#: Phrases in which a term does not count.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "clown car", "pathetic fallacy", "dumb bell", "dumb waiter", "jerk chicken", "jerk seasoning", "sore loser")

_TABLE = str.maketrans({**HOMOGLYPHS, **DIGITS, "l": "i", **dict.fromkeys(INVISIBLE)})
_SIGN = re.compile(r"[@$€](?=\w)|(?<=\w)[!|](?=\w)")
_GAP = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """The folded words of a text, each with a space before and after it."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = _SIGN.sub(lambda m: SIGNS[m[0]], text.lower()).translate(_TABLE)
    return " " + _GAP.sub(" ", text).strip() + " "


@dataclass(frozen=True)
class Model:
    """lexicon: folded term -> weight; a term starts a word, and ends one if it ends in a space. coefficients of 1, log(1 + sum), log(1 + sum per 100 words), and share of distinct terms."""

    lexicon: dict[str, float]
    coefficients: tuple[float, float, float, float]
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for phrase in self.exceptions:
            a.add_word(fold(phrase), (len(fold(phrase)), None, 0.0))
        for term, weight in self.lexicon.items():
            a.add_word(term, (len(term), term, weight))
        a.make_automaton()
        return a


def _measure(a: ahocorasick.Automaton, text: str | None) -> tuple[float, float, float]:
    """log(1 + weights), log(1 + weights per 100 words), log(1 + different terms)."""
    folded = fold(text)
    n = max(1, folded.count(" ") - 1)
    found, excused = [], []
    for end, (size, term, weight) in a.iter(folded):
        (excused if term is None else found).append((end + 1 - size, end + 1, term, weight))
    if excused:
        found = [f for f in found if not any(s <= f[0] and f[1] <= e for s, e, *_ in excused)]
    total = sum(f[3] for f in found)
    return math.log1p(total), math.log1p(total * 100 / n), math.log1p(len({f[2] for f in found}))


def _terms(words: set[str], least: int = 4, most: int = 10) -> set[str]:
    """Words whole and their beginnings."""
    out = {f" {w} " for w in words if len(w) >= 3}
    for w in words:
        if len(w) > least:
            out.update(" " + w[:i] for i in range(least, min(len(w), most) + 1))
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other texts have each term: summed within a batch before anything is shuffled."""
    for b in batches:
        toxic, other = Counter(), Counter()
        for text, y in zip(b.column("text"), b.column("toxic").to_pylist()):
            (toxic if y else other).update(_terms(set(fold(text.as_py()).split())))
        names = list(toxic.keys() | other.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([other[x] for x in names], pa.int64())], names=["term", "t", "o"])


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of terms by head and falling evidence those that neither begin nor continue one chosen before.

    Such terms have their first letters, the head, in common, so each head is chosen from by itself.
    """
    head, chosen = None, []
    for b in batches:
        keep = []
        for i, (now, term) in enumerate(zip(b.column("head").to_pylist(), b.column("term").to_pylist())):
            if now != head:
                head, chosen = now, []
            if not any(term.startswith(x) or x.startswith(term) for x in chosen):
                chosen.append(term)
                keep.append(i)
        yield b.take(pa.array(keep, pa.int64()))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps over weighted rows with a ridge on all but the constant."""
    x = np.column_stack((np.ones(len(x)), x))
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (p - y)) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 8000, max_terms: int = 300, least_gain: float = 20.0, least_weight: float = 2.0, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """A model from labelled rows.

    max_rows bounds the sample of labelled rows that it learns from, but for the chance in
    a hash: half of it toxic rows and half others, or all rows of a label that has fewer,
    those with the least hashes of their ids. Terms are weighed by their share of either
    label's rows, and rows count in the coefficients by their label's share of all labels,
    so rare labels are learned from and scores keep to the true rates. An id with several
    labels is toxic if any says so; rows with a null id or label are left out; equal texts
    count once, whole texts are read. A term must gain `least_gain` in log-likelihood ratio,
    and no chosen term begins or continues another; the best max_terms of all are taken. Without toxic or other rows, and for empty tables,
    the seeds are the lexicon and the coefficients are fixed ones. Ties between terms go
    to the longer one, then by code point, so a second run learns the same model.
    """
    spark = docs.sparkSession
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(id_col).agg((F.max(label) > 0).cast("int").alias("toxic"))
    marks = cut(marks, "toxicity_marks")
    sizes = {r[0]: r[1] for r in marks.groupBy("toxic").count().collect()}
    picked = F.lit(False)
    for y, n in sizes.items():
        room = max(max_rows // 2, max_rows - sizes.get(1 - y, 0))
        picked = picked | ((F.col("toxic") == y) & below_share(F.xxhash64(F.col(id_col).cast("string")), room / n))
    k1, k2 = text_key(F.col("text"))
    sample = docs.select(id_col, F.col(text).alias("text")).join(marks.where(picked), id_col).groupBy(k1, k2).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = cut(sample.select("text", "toxic"), "toxicity_sample")
    counts = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    nt, no = counts.get(1, 0), counts.get(0, 0)
    lexicon = {f"{fold(s)}": SEED_WEIGHT for s in SEEDS}
    if not nt or not no:
        return Model(lexicon, (-3.0, 1.5, 0.5, 0.5), exceptions)
    terms = sample.repartition(max(4, spark.sparkContext.defaultParallelism)).mapInArrow(_counts, "term string, t long, o long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    # The most telling first: log-likelihood ratio of a term against labels, then the longer term.
    t, o, p = F.col("t"), F.col("o"), (F.col("t") + F.col("o")) / (nt + no)
    gain = 2 * (t * F.log(t / (nt * p)) + F.when(o > 0, o * F.log(o / (no * p))).otherwise(0.0))
    weight = F.log((t + 0.5) / (nt + 1)) - F.log((o + 0.5) / (no + 1))
    scored = terms.where((t >= 3) & (weight >= least_weight) & (gain >= least_gain))
    scored = scored.select(F.left("term", F.lit(5)).alias("head"), "term", F.round(gain, 6).alias("gain"), F.length("term").alias("size"), F.least(weight, F.lit(8.0)).alias("weight"))
    apart = scored.repartition("head").sortWithinPartitions("head", F.desc("gain"), F.desc("size"), "term").mapInArrow(_apart, scored.schema)
    top = apart.orderBy(F.desc("gain"), F.desc("size"), "term").limit(max_terms).collect()
    learned = {r["term"]: r["weight"] for r in top}
    lexicon = {s: w for s, w in lexicon.items() if not any(s.startswith(x) or x.startswith(s) for x in learned)} | learned
    blank = Model(lexicon, (0.0, 0.0, 0.0, 0.0), exceptions)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = blank.automaton()
        for b in batches:
            x = np.array([_measure(a, t.as_py()) for t in b.column("text")]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(3)), b.column("toxic")], names=["a", "b", "c", "toxic"])

    rows = np.array(sample.mapInArrow(measured, "a double, b double, c double, toxic int").collect(), float)
    rows = rows[np.lexsort(rows.T)]  # sums in one order, whichever task ends first
    y = rows[:, 3]
    weight = np.where(y == 1, sizes[1] / nt, sizes[0] / no)
    return Model(lexicon, tuple(float(v) for v in _logistic(rows[:, :3], y, weight * len(y) / weight.sum())), exceptions)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """docs (all columns, or those to keep) with score double (0 to 1) and predicted int.

    A null, empty or wordless text has the score of a text without terms. The score
    depends on the whole text alone, so repeated rows have equal scores and ties stay ties;
    a very long text is one pass over it. An empty table gives an empty table. Columns of
    docs named score or predicted are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    schema = docs.select(*keep).withColumn("score", F.lit(0.0)).schema
    rows = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, w = model.automaton(), model.coefficients
        for b in batches:
            z = [w[0] + sum(c * v for c, v in zip(w[1:], _measure(a, t.as_py()))) for t in b.column("__text")]
            values = 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(values)], names=[*keep, "score"])

    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
