"""Document fingerprints: threshold-scaled sketches of shingle hashes.

Every hash of a shingle below a fixed share of the hash range is kept, in any document,
so that sketches of texts of any sizes compare and merge by set operations alone: the
union of two sketches is the sketch of the union. Shingles are 16 bytes of a text whose
white space is folded, and one hash in 16 is kept, so that a text of a line has a few
hashes below the threshold and each of them is in the sketch of any text that holds the
line. A text that has shingles but none below the threshold is marked by its least hash,
which tells it from other texts and takes no part in any comparison but with its equals.
A text shorter than a shingle is one shingle, which only its equals have.
A fingerprint is the sorted hashes in hexadecimal, ten digits each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_keys, range_bounds, range_code

SHINGLE, SHARE_BITS = 16, 4  # bytes; one hash in 2^4 is kept
_DROP = 24  # low bits of a 64-bit hash that a fingerprint leaves out
_U = np.uint64
#: Hashes below this are kept. Of ten hexadecimal digits the first is 0.
THRESHOLD = _U(1 << (64 - _DROP - SHARE_BITS))
CHUNK = 1 << 20  # bytes of text that are hashed at a time
_BASE, _MIX = 0x9E3779B97F4A7C15 | 1, _U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.array([int.from_bytes(hashlib.sha256(bytes([i, 1])).digest()[:8], "little") | 1 for i in range(256)], np.uint64)
_POW = [np.cumprod(np.concatenate(([_U(1)], np.full(CHUNK + 64, b, np.uint64))), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _MIX
    h = (h ^ (h >> _U(29))) * _MIX
    return h ^ (h >> _U(32))


def _folded(text: str | None) -> np.ndarray:
    """The UTF-8 bytes, each run of white space one space, none at the ends."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    gap = _SPACE[data]
    data = np.where(gap, np.uint8(32), data)[~(gap & np.concatenate(([True], gap[:-1])))]
    return data[:-1] if len(data) and data[-1] == 32 else data


def sketch(text: str | None) -> np.ndarray:
    """Sorted 40-bit hashes below the threshold; of a text that has none, its least hash; of one without words, nothing."""
    data = _folded(text)
    if not len(data):
        return np.zeros(0, np.uint64)
    k, kept, least = min(SHINGLE, len(data)), [], []
    for i in range(0, len(data) - k + 1, CHUNK):
        part = data[i : i + CHUNK + k - 1]
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _POW[0][: len(part)], out=prefix[1:])
        h = _mixed((prefix[k:] - prefix[:-k]) * _POW[1][: len(part) - k + 1] + _U(k)) >> _U(_DROP)
        kept.append(h[h < THRESHOLD])
        least.append(h.min())
    kept = np.unique(np.concatenate(kept))
    return kept if len(kept) else np.array([min(least)], np.uint64)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of what two texts have together."""
    both = np.union1d(a, b)
    kept = both[both < THRESHOLD]
    return kept if len(kept) else both[:1]


def encode(s: np.ndarray) -> str:
    """Ten hexadecimal digits a hash."""
    raw = s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    return np.ascontiguousarray(raw).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated containment of the smaller text's shingles in the larger's: shared hashes to those of the smaller sketch.

    Where one of the two has no hash below the threshold: 1 for equal sketches, else 0.
    """
    if not len(a) or not len(b) or a[0] >= THRESHOLD or b[0] >= THRESHOLD:
        return float(np.array_equal(a, b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of a text column; null counts as empty. A column of that name is replaced."""
    rows = docs.drop(name)
    names = [*rows.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([encode(sketch(t.as_py())) for t in b.column(text)], pa.string())], names=names)

    return rows.mapInArrow(run, rows.withColumn(name, F.lit("")).schema)


def containment(a: str, b: str) -> Column:
    """Of two fingerprint columns: the share of a's hashes below the threshold that b holds (null where a has none), in Spark's own functions."""
    parts = lambda c: F.filter(F.split(c, "(?<=\\G.{10})"), lambda x: x.startswith("0"))
    return F.size(F.array_intersect(parts(a), parts(b))) / F.nullif(F.size(parts(a)), F.lit(0))


def edited_text(text: str, after: str) -> str:
    """text with its last third of code points replaced by the first as many of another."""
    m = len(text) // 3
    return text[: len(text) - m] + after[:m]


_OUT = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_OUT_SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """For each document: its fingerprint, that of its text edited with the next document's, and their likeness.

    Next is the following document by falling id (nulls last, equal ids by rising text
    hash), and for the last the first. Ids are integers, or of a type that is ordered by
    its text. Texts are shuffled once, in ranges of (id, hash) that are read upwards: a
    document's next is the one read before it. A range's greatest document is dealt to the
    range above it as well, so no task waits for another; each holds two texts at a time,
    however long. A null text is empty. A single document is its own next. Repeated rows
    follow one another. Other columns of docs are not read; an empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    null, key = id_keys(rows, "id", nulls_last=False)
    rows = rows.withColumns({"k0": null, "k1": key, "k2": F.negative(F.xxhash64("text"))})
    keys = ["k0", "k1", "k2"]
    bounds = range_bounds(rows, keys, F.octet_length("text"), ranges)
    n = max(1, len(bounds))
    # Twice the range, odd for a range's greatest key: such a row leads the next range, and the last one leads the first.
    rows = rows.withColumn("code", range_code(bounds, *keys) if bounds else F.lit(0))
    own = F.struct(F.shiftright("code", 1).alias("r"), F.lit(False).alias("lead"))
    lead = F.struct(((F.shiftright("code", 1) + 1) % n).cast("int").alias("r"), F.lit(True).alias("lead"))
    dealt = rows.withColumn("to", F.explode(F.when(F.col("code") % 2 == 1, F.array(own, lead)).otherwise(F.array(own))))
    dealt = dealt.select("to.r", "to.lead", *keys, "id", "text").repartitionById(n, "r").sortWithinPartitions(F.desc("lead"), *keys)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            at, out, size = [], [], 0
            leads = b.column("lead").to_pylist()
            for i, value in enumerate(b.column("text")):
                if leads[i] and before is not None:
                    continue  # equal ids and texts as the first lead
                this = value.as_py()
                s = sketch(this)
                if not leads[i]:
                    edited = edited_text(this, before[0])
                    e = sketch(edited)
                    at.append(i)
                    out.append((len(this), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), encode(s), encode(e), likeness(s, e), likeness(s, before[1])))
                    size += len(out[-1][2]) + len(out[-1][3])
                before = (this, s)
                if out and (size > 1 << 20 or i + 1 == len(b)):
                    yield made(b.column("id").take(pa.array(at)), out)
                    at, out, size = [], [], 0
            if out:
                yield made(b.column("id").take(pa.array(at)), out)

    def made(ids: pa.Array, out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*out), types))], names=["id", *_OUT])

    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return dealt.select("lead", "id", "text").mapInArrow(run, f"id {kind}, {_OUT_SCHEMA}").withColumnRenamed("id", id_col)
