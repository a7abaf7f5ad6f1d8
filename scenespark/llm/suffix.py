"""Suffix-array dedup: find every byte covered by a `length`-byte string that starts twice.

A string of `length` bytes starts twice exactly if, in sorted order, the suffix at its
start shares `length` bytes or more with a neighbour. Sorting every suffix of a corpus
in one place is out of question, so suffixes are dealt out first:

  1. Anchors. In each `length`-byte window the k-gram with the least hash is its anchor;
     equal windows have equal anchors at equal distance. Windows that follow one another
     mostly share theirs, so there is one row for every 150 bytes or so: the anchor's
     hash and the hash of the stretch that its windows cover. Stretches that a text
     repeats within itself (a run of one byte, a refrain) are one row of that text.
  2. Anchors that occur once are done: none of their windows starts twice. Of stretches
     that occur twice or more all windows do; two of each are compared byte by byte.
     Copies of any number are one specimen from there on.
  3. One specimen of each stretch whose anchor others share is read and dealt by the
     anchor's hash and the window's distance from it. There the windows are sorted by a
     mergesort; two suffixes are compared through prefix polynomial hashes, by a binary
     search for their common extension. Neighbours in that order that share `length`
     bytes by their hashes are compared byte by byte before they count.
  4. Anchors with very many different stretches (a line that a third of all documents
     have) are dealt by the hash of a longer core of fewer windows instead. Where even
     such a core is crowded, its windows are counted by two hashes of their bytes, which
     combines before the shuffle, and two places of each that counts are compared byte
     by byte. So no task gets a line, a passage or a core whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, cut, discard, text_key

CHUNK = 1 << 18  # bytes of text that are hashed at a time: about 20 arrays of eight bytes for each, which idle Python workers keep
_U = np.uint64
_BASE, _MIX = 0x9E3779B97F4A7C15 | 1, _U(0xD6E8FEB86659FD93)
#: Odd numbers for the 256 byte values, from a fixed rule.
_BYTE = np.array([int.from_bytes(hashlib.sha256(bytes([i])).digest()[:8], "little") | 1 for i in range(256)], np.uint64)
_POW: list[np.ndarray] = []
#: Masks of the first 0 to 8 bytes of a little-endian number.
_EIGHT = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64, i below n at least."""
    if not _POW or len(_POW[0]) < n:
        size = max(n, CHUNK + 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        _POW[:] = [np.cumprod(np.concatenate(([_U(1)], np.full(size - 1, b, np.uint64))), dtype=np.uint64) for b in (_BASE, inverse)]
    return _POW[0], _POW[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _MIX
    h = (h ^ (h >> _U(29))) * _MIX
    return h ^ (h >> _U(32))


def _prefix(data: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Prefix polynomial hashes; at: each byte's exponent (default: its place)."""
    power, _ = _powers(len(data) if at is None else int(at.max(initial=0)) + 1)
    terms = _BYTE[data]
    terms *= power[: len(data)] if at is None else power[at]
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(terms, out=out[1:])
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> dict[str, np.ndarray]:
    """Of texts laid end to end (offsets: their starts and the end): each anchor's first and last window start, its own place, its hashes and how often it stands so in its text; and own_…, what texts repeat within themselves."""
    n, w = len(data), length - k + 1
    starts, ends = offsets[:-1], offsets[1:]
    none = {c: np.zeros(0, np.int64) for c in ("text", "first", "last", "place", "anchor", "span", "check", "times", "own_text", "own_first", "own_end")}
    if n < length or not ((ends - starts) >= length).any():
        return none
    prefix = _prefix(data)
    _, inverse = _powers(n)
    grams = _mixed((prefix[k:] - prefix[:-k]) * inverse[: n - k + 1])
    bits = _U(int(n).bit_length())
    low = (_U(1) << bits) - _U(1)
    order = (grams & ~low) | np.arange(n - k + 1, dtype=np.uint64)  # ties: the first
    # The least of each w, by running minima from both ends of blocks of w.
    pad = -len(order) % w
    blocks = np.concatenate((order, np.full(pad, ~_U(0)))).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - length + 1  # windows
    place = (np.minimum(back[:m], ahead[w - 1 : w - 1 + m]) & low).astype(np.int64)
    valid = np.zeros(m + 1, np.int32)
    long = (ends - starts) >= length
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:-1]))
    if not len(at):
        return none
    p = place[at]
    new = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1))))
    first, last, p = at[new], at[np.concatenate((new[1:], [len(at)])) - 1], p[new]
    # A text that begins where another's windows end has its own run: windows of two texts never follow one another without a gap.
    text = np.searchsorted(offsets, first, side="right") - 1
    anchor = grams[p]
    span = _mixed((prefix[last + length] - prefix[first]) * inverse[first] + (p - first).astype(np.uint64) * _MIX)
    raw, base = data.tobytes(), starts[text]
    times, again = _settled(raw, first, last, text, anchor, span, length)
    keep = np.flatnonzero(times)
    h = xxhash.xxh3_64_intdigest
    check = np.array([h(raw[a:b]) for a, b in zip(first[keep].tolist(), (last[keep] + length).tolist())], np.uint64)
    out = {"text": text, "first": first - base, "last": last - base, "place": p - base, "anchor": anchor, "span": span, "times": times}
    out = {c: v[keep].view(np.int64) for c, v in out.items()} | {"check": check.view(np.int64)}
    # What a text repeats within itself goes, whatever other texts hold: overlapping places are one.
    at = np.flatnonzero(again)
    new = np.flatnonzero(np.concatenate(([True], (text[at[1:]] != text[at[:-1]]) | (first[at[1:]] > np.maximum.accumulate(last[at] + length)[:-1])))) if len(at) else at
    end = (last[at] + length)[np.concatenate((new[1:], [len(at)])) - 1] if len(at) else at
    return out | {"own_text": text[at[new]], "own_first": (first - base)[at[new]], "own_end": end - base[at[new]]}


def _settled(raw: bytes, first: np.ndarray, last: np.ndarray, text: np.ndarray, anchor: np.ndarray, span: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of stretches: how often each occurs in its text, 0 for all but its first place; and the places of those that repeat. Bytes decide, not hashes."""
    by = np.lexsort((first, span, anchor, text))
    same = np.concatenate(([False], (text[by[1:]] == text[by[:-1]]) & (anchor[by[1:]] == anchor[by[:-1]]) & (span[by[1:]] == span[by[:-1]])))
    times, again = np.ones(len(first), np.int64), np.zeros(len(first), bool)
    head = by[np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))]
    for i in np.flatnonzero(same).tolist():
        me, other = by[i], head[i]
        if raw[first[me] : last[me] + length] == raw[first[other] : last[other] + length]:
            times[other] += 1
            times[me] = 0
            again[me] = again[other] = True
    return times, again


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of an Arrow string column without nulls, uncopied."""
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    o = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), o


_ANCHOR_SCHEMA = "k1 long, k2 long, first int, last int, place int, anchor long, span long, check long, times int"


def _anchor_rows(length: int, k: int):
    """Rows of _ANCHOR_SCHEMA; one without an anchor is a span [first, last) that its text repeats within itself."""
    names = ["k1", "k2", "first", "last", "place", "anchor", "span", "check", "times"]

    def made(b: pa.RecordBatch, rows: np.ndarray, found: dict, shift: int = 0) -> pa.RecordBatch:
        own = len(found["own_text"])
        take = pa.array(np.concatenate((rows[found["text"]], rows[found["own_text"]])))
        near = {c: np.concatenate((found[c], found[o])) + shift for c, o in (("first", "own_first"), ("last", "own_end"), ("place", "own_first"))}
        far = [pa.concat_arrays([pa.array(found[c]), pa.nulls(own, pa.int64())]) for c in ("anchor", "span", "check")]
        times = np.concatenate((found["times"], np.zeros(own, np.int64)))
        ints = [pa.array(v.astype(np.int32)) for v in (*near.values(), times)]
        return pa.RecordBatch.from_arrays([b.column("k1").take(take), b.column("k2").take(take), *ints[:3], *far, ints[3]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = _buffers(b.column("text"))
            i = 0
            while i < len(b):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
                if offsets[j] - offsets[i] <= CHUNK:
                    o = offsets[i : j + 1]
                    yield made(b, np.arange(i, j), anchors(data[o[0] : o[-1]], o - o[0], length, k))
                else:  # one text beyond CHUNK: its windows, a stretch at a time
                    for s in range(offsets[i], offsets[j] - length + 1, CHUNK):
                        part = data[s : min(offsets[j], s + CHUNK + length - 1)]
                        yield made(b, np.array([i]), anchors(part, np.array([0, len(part)]), length, k), int(s - offsets[i]))
                i = j

    return run


def _common(prefix: np.ndarray, inverse: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """How many of `length` bytes the suffixes at a and b share: a binary search by prefix hashes."""
    lo, hi = np.zeros(len(a), np.int64), np.full(len(a), length, np.int64)
    ia, ib, pa_, pb = inverse[at[a]], inverse[at[b]], prefix[a], prefix[b]
    while (open_ := lo < hi).any():
        mid = (lo + hi + 1) >> 1
        same = (prefix[a + mid] - pa_) * ia == (prefix[b + mid] - pb) * ib
        lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)
    return lo


def sorted_suffixes(data: np.ndarray, prefix: np.ndarray, at: np.ndarray, group: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Indexes that sort suffixes by group, then by their first `length` bytes: a mergesort, all groups at once.

    group: ascending. In each round runs of r suffixes merge with their neighbours: every
    suffix finds its rank in the neighbour by binary search, its comparisons each taking
    a logarithmic number of hash tests.
    """
    n = len(start)
    _, inverse = _powers(int(at.max(initial=0)) + 1)
    head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((head, [n])))
    base, count = np.repeat(head, size), np.repeat(size, size)
    local = np.arange(n) - base
    order, r = np.arange(n), 1
    while n and r < size.max():
        run = local // r
        other = (run ^ 1) * r
        left = (run & 1) == 0
        busy = np.flatnonzero(other < count)
        b, o = base[busy], other[busy]
        lo, hi = o.copy(), np.minimum(o + r, count[busy])
        me, stable = start[order[busy]], left[busy]
        first = o.copy()
        while (open_ := lo < hi).any():
            idx = np.flatnonzero(open_)
            mid = (lo[idx] + hi[idx]) >> 1
            you = start[order[b[idx] + mid]]
            same = _common(prefix, inverse, at, you, me[idx], length)
            whole = same == length
            end = np.minimum(same, length - 1)
            before = np.where(whole, ~stable[idx], data[you + end] < data[me[idx] + end])  # the other one goes first
            lo[idx] = np.where(before, mid + 1, lo[idx])
            hi[idx] = np.where(before, hi[idx], mid)
        rank = local[busy] - run[busy] * r + (lo - first)
        new = order.copy()
        new[b + np.minimum(run[busy] * r, o) + rank] = order[busy]
        order, r = new, r * 2
    return order


def repeated_windows(data: np.ndarray, at: np.ndarray, group: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Of windows (in groups, ascending): whether another of the group has the same `length` bytes. Neighbours in suffix order decide, and their bytes."""
    out = np.zeros(len(start), bool)
    if len(start) < 2:
        return out
    prefix = _prefix(data, at)
    _, inverse = _powers(int(at.max(initial=0)) + 1)
    order = sorted_suffixes(data, prefix, at, group, start, length)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(group[a] == group[b])
    pairs = near[_common(prefix, inverse, at, start[a[near]], start[b[near]], length) == length]
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    wrong = []
    for i in range(0, len(pairs), 4096):
        x, y = a[pairs[i : i + 4096]], b[pairs[i : i + 4096]]
        equal = (view[start[x]] == view[start[y]]).all(axis=1)
        out[x[equal]] = out[y[equal]] = True
        wrong += group[x[~equal]].tolist()
    for bad in set(wrong):  # a collision of hashes: that group again, by its bytes alone
        rows, seen = np.flatnonzero(group == bad), {}
        for i in rows.tolist():
            seen.setdefault(view[start[i]].tobytes(), []).append(i)
        out[rows] = False
        out[[i for x in seen.values() if len(x) > 1 for i in x]] = True
    return out


_SPECIMEN = ["key", "k1", "k2", "first", "offset", "windows", "stretch"]
_SPECIMEN_SCHEMA = "key long, k1 long, k2 long, first int, offset int, windows int, stretch binary"
_SPECIMEN_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _batches(rows: Iterator[tuple], types: list, names: list[str], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows, whose last value may be bytes, in batches of about `size` bytes."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += 64 + (len(row[-1]) if isinstance(row[-1], bytes) else 0)
        if held >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


DEAL, CROWDED, COMPARE = 0, 1, 2


def _specimens(length: int, block: int):
    """Of texts with the stretches asked of them: those stretches, dealt by anchor or, if that is crowded, by the core of each `block` windows. One to be compared has no windows of its own."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        h = xxhash.xxh3_64_intdigest
        for b in batches:
            asked, k1s, k2s = b.column("asked"), b.column("k1").to_pylist(), b.column("k2").to_pylist()
            for i, text in enumerate(b.column("text")):
                raw = text.as_buffer().to_pybytes()
                for x in asked[i].as_py():
                    first, last, place = x["first"], x["last"], x["place"]
                    if x["kind"] != CROWDED:
                        yield x["key"], k1s[i], k2s[i], first, place - first, last - first + 1 if x["kind"] == DEAL else 0, raw[first : last + length]
                        continue
                    # Blocks lie at fixed distances from the anchor: equal windows fall in equal blocks, and hold the block's core.
                    for lo in range((place - last) // block * block, place - first + 1, block):
                        hi = lo + block - 1
                        f, t = max(first, place - hi), min(last, place - lo)
                        key = _signed(h(raw[place - lo : place - hi + length], lo + 1))
                        yield key, k1s[i], k2s[i], f, place - f, t - f + 1, raw[f : t + length]

    return lambda batches: _batches(rows(batches), _SPECIMEN_TYPES, _SPECIMEN)


_WINDOW_SCHEMA = "h1 long, h2 long, k1 long, k2 long, s int"


def _windows(length: int):
    """Each window of crowded specimens by two hashes of its bytes."""
    names = ["h1", "h2", "k1", "k2", "s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2, first, windows = (b.column(c).to_pylist() for c in ("k1", "k2", "first", "windows"))
            out: list[list[np.ndarray]] = []
            for i, stretch in enumerate(b.column("stretch")):
                raw, n = stretch.as_buffer().to_pybytes(), windows[i]
                prefix = _prefix(np.frombuffer(raw, np.uint8))
                h1 = _mixed((prefix[length : length + n] - prefix[:n]) * _powers(n)[1][:n])
                h2 = np.array([xxhash.xxh3_64_intdigest(raw[j : j + length]) for j in range(n)], np.uint64)
                out.append([h1.view(np.int64), h2.view(np.int64), np.full(n, k1[i]), np.full(n, k2[i]), (first[i] + np.arange(n)).astype(np.int32)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

    return run


def _judge_chunk(rows: list[tuple], length: int) -> Iterator[tuple]:
    """Specimens whose keys are complete: the stretches of their windows that start twice. Those to be compared must be equal."""
    seen: dict[int, bytes] = {}
    for r in rows:
        if not r[5] and seen.setdefault(r[0], r[6]) != r[6]:
            raise ValueError("different bytes share two 64-bit hashes")
    rows = [r for r in rows if r[5]]
    if not rows:
        return
    sizes = np.array([len(r[6]) for r in rows])
    data = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    at = np.arange(len(data), dtype=np.int32) - np.repeat(base, sizes).astype(np.int32)
    windows, offset = np.array([r[5] for r in rows]), np.array([r[4] for r in rows])
    row = np.repeat(np.arange(len(rows)), windows)
    step = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    _, key = np.unique(np.array([r[0] for r in rows]), return_inverse=True)
    # Equal windows lie at equal distances from their anchor.
    group = key[row].astype(np.int64) * (1 << 32) + (offset[row] - step)
    by = np.argsort(group, kind="stable")
    twice = np.zeros(len(row), bool)
    twice[by] = repeated_windows(data, at, group[by], (base[row] + step)[by], length)
    edge = np.flatnonzero(twice)
    if len(edge):
        new = np.concatenate(([True], (edge[1:] != edge[:-1] + 1) | (row[edge[1:]] != row[edge[:-1]])))
        heads = np.flatnonzero(new)
        tails = np.concatenate((heads[1:], [len(edge)])) - 1
        for a, z in zip(edge[heads].tolist(), edge[tails].tolist()):
            r = rows[row[a]]
            yield r[1], r[2], r[3] + int(step[a]), r[3] + int(step[z]) + length


_SPAN_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def _judge(length: int):
    """Specimens sorted by key: judged some MB at a time, never a key in two parts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, size = [], 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if size >= CHUNK and r[0] != held[-1][0]:
                    yield from _judge_chunk(held, length)
                    held, size = [], 0
                held.append(r)
                size += len(r[6])
        if held:
            yield from _judge_chunk(held, length)

    return lambda batches: _batches(rows(batches), _SPAN_TYPES, ["k1", "k2", "s", "e"])


def _runs(spans: pa.ListScalar) -> list[list[int]]:
    """Spans [s, e), structs of an Arrow list, as their maximal runs, ascending."""
    x = spans.values
    if x is None or not len(x):
        return []
    s, e = x.field("s").to_numpy(), x.field("e").to_numpy()
    by = np.argsort(s, kind="stable")
    s, e = s[by], np.maximum.accumulate(e[by])
    head = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
    return np.stack((s[head], e[np.concatenate((head[1:], [len(s)])) - 1]), axis=1).tolist()


def _whole(raw: bytes, spans: list[list[int]]) -> list[list[int]]:
    """Spans shrunk to whole code points of UTF-8."""
    out = []
    for s, e in spans:
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append([s, e])
    return out


_RESULT = ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"]
_RESULT_SCHEMA = "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<s:int,e:int>>, kept string"
_APART_SCHEMA = _RESULT_SCHEMA.replace("kept string", "passages array<struct<s:int,e:int>>, kept string")


def _apply(length: int, with_text: bool, words: int = 0, apart: bool = False):
    span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    names = [*_RESULT[:7], *["passages"] * apart, "kept"]

    def listed(spans: list) -> list[dict]:
        return [{"s": s, "e": e} for s, e in spans]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            spans = b.column("spans")
            meta = zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "copies")))
            for i, (k1, k2, copies) in enumerate(meta):
                raw = b.column("text")[i].as_buffer().to_pybytes()
                wordy = copies > 1 and words and len(raw.split()) >= words
                if copies > 1 and len(raw) >= length or wordy and not apart:
                    cutting = [[0, len(raw)]]
                else:
                    cutting = _runs(spans[i])
                edges = [0, *(x for c in cutting for x in c), len(raw)]
                digest = hashlib.sha256()
                for s, e in zip(edges[::2], edges[1::2]):
                    digest.update(raw[s:e])
                kept = None
                if with_text:
                    edges = [0, *(x for c in _whole(raw, cutting) for x in c), len(raw)]
                    kept = b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2]))
                out = [k1, k2, len(raw), sum(e - s for s, e in cutting), len(cutting), digest.hexdigest(), listed(cutting)]
                if apart:  # of copies: from the first word to the last
                    out.append(listed([(len(raw) - len(raw.lstrip()), len(raw.rstrip()))] if wordy else _runs(b.column("passages")[i])))
                yield *out, kept

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span, *[span] * apart]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(rows(batches), [*types, pa.binary()], names):
            columns = part.columns[:-1] + [part.column("kept").cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts laid end to end; a word ends with its text."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([True], space[:-1])) | edge[:-1]
    after = np.concatenate((space[1:], [True])) | edge[1:]
    return np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1


def _word_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes over words, each word by its length and the eight bytes at its start, middle and end. That does for anchors: equal words agree, and what else agrees is told apart by its windows' digests."""
    if not len(starts):
        return np.zeros(1, np.uint64)
    line = np.concatenate((data[starts[0] : ends[-1]], np.zeros(8, np.uint8)))
    eight = np.ndarray(len(line) - 7, "<u8", line, strides=(1,))
    at, size = starts - starts[0], ends - starts
    keep, rest = _EIGHT[np.minimum(size, 8)], np.maximum(size - 8, 0)
    hashes = _mixed(size.astype(np.uint64))
    for i in (at, at + rest // 2, at + rest):
        hashes = _mixed(hashes ^ (eight[i] & keep))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _powers(len(starts))[0][: len(starts)], dtype=np.uint64)))


def _word_grams(sums: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of each k words, or of those that begin at the given words."""
    at = np.arange(len(sums) - k) if at is None else at
    return _mixed((sums[at + k] - sums[at]) * _powers(len(sums))[1][at])


def word_anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, words: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each anchor's first and last window of `words` words (by its first word) and its hash. text: each word's text, ascending."""
    n, w = len(starts), words - k + 1
    at = np.flatnonzero(text[words - 1 :] == text[: n - words + 1]) if n >= words else np.zeros(0, np.int64)
    if not len(at):
        return at, at, np.zeros(0, np.int64)
    grams = _word_grams(_word_sums(data, starts, ends), k)
    low = (_U(1) << _U(int(n).bit_length())) - _U(1)
    order = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    blocks = np.concatenate((order, np.full(-len(order) % w, ~_U(0)))).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    p = (np.minimum(back[at], ahead[at + w - 1]) & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1))))
    return at[new], at[np.concatenate((new[1:], [len(at)])) - 1], grams[p[new]].view(np.int64)


def _pieces(n: int, words: int, size: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Ranges of n words that overlap such that each window lies whole in one."""
    for i in range(0, max(1, n - words + 1), size):
        yield i, min(n, i + size + words - 1)


def _word_anchor_rows(words: int, k: int):
    names = ["k1", "k2", "first", "last", "anchor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = _buffers(b.column("text"))
            i = 0
            while i < len(b):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
                part, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends = _words(part, o)
                text = np.searchsorted(o, starts, side="right") - 1
                head = np.searchsorted(text, np.arange(j - i))
                for x, y in _pieces(len(starts), words):
                    first, last, anchor = word_anchors(part, starts[x:y], ends[x:y], text[x:y], words, k)
                    if len(first):
                        row = text[first + x]
                        take = pa.array(row + i)
                        near = [pa.array((v + x - head[row]).astype(np.int32)) for v in (first, last)]
                        yield pa.RecordBatch.from_arrays([b.column("k1").take(take), b.column("k2").take(take), *near, pa.array(anchor)], names=names)
                i = j

    return run


def _word_windows(words: int):
    """Of texts with the stretches asked of them: each of their windows, its words' BLAKE2 digest (128 bits, as two longs) and its bytes' place."""
    names = ["h1", "h2", "k1", "k2", "s", "e"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (text, k1, k2) in enumerate(zip(b.column("text"), b.column("k1").to_pylist(), b.column("k2").to_pylist())):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                starts, ends = _words(data, np.array([0, len(data)]))
                asked = np.zeros(len(starts) + 1, np.int32)
                for a in b.column("asked")[i].as_py():
                    asked[a["first"]] += 1
                    asked[a["last"] + 1] -= 1
                asked = np.cumsum(asked[:-1]) > 0
                line = b" ".join(data.tobytes().split())  # as _words parts them
                stops = np.cumsum(ends - starts + 1) - 1
                for x in range(0, len(starts), 1 << 16):
                    at = x + np.flatnonzero(asked[x : x + (1 << 16)])
                    if len(at):
                        heads, tails = (stops[at] - (ends - starts)[at]).tolist(), stops[at + words - 1].tolist()
                        h = np.frombuffer(b"".join(blake2b(line[s:e], digest_size=16).digest() for s, e in zip(heads, tails)), np.int64).reshape(-1, 2)
                        near = [starts[at].astype(np.int32), ends[at + words - 1].astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (h[:, 0], h[:, 1], np.full(len(at), k1), np.full(len(at), k2), *near)], names=names)

    return run


def repeated_passages(texts: DataFrame, words: int, k: int = 8) -> DataFrame:
    """(k1, k2, s, e): the bytes of each window of `words` words that starts twice in different texts (columns k1, k2, text) or in one.

    Words are what white space parts, so what stands between them may differ. Anchors
    are as above, in words. The windows of shared anchors are counted by a cryptographic
    digest of their words, all of which stands for equality at each place, combined before
    the shuffle: no group is gathered, however common.
    """
    rows = cut(texts.select("k1", "k2", "text").mapInArrow(_word_anchor_rows(words, k), "k1 long, k2 long, first int, last int, anchor long"), "passage_anchors")
    shared = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    asked = rows.join(shared, "anchor").groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias("asked"))
    windows = texts.select("k1", "k2", "text").join(asked, ["k1", "k2"]).mapInArrow(_word_windows(words), "h1 long, h2 long, k1 long, k2 long, s int, e int")
    windows = cut(windows, "passage_windows")
    discard(rows)
    # Written first, so that the join reads plain shuffles, which Spark splits where a window is in very many texts.
    twice = cut(windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2"), "passage_twice")
    out = cut(windows.join(twice, ["h1", "h2"]).select("k1", "k2", "s", "e"), "passages")
    discard(windows, twice)
    return out


def repeats(docs: DataFrame, text: str = "text", length: int = 400, crowd: int = 512, block: int = 32, with_text: bool = False, words: int = 0, apart: bool = False) -> DataFrame:
    """One row for each different text (null counts as empty), keyed by text_key(): n_bytes, n_removed, n_spans, kept_sha256, removed [s, e) spans, kept.

    kept, where asked for, is the text without its removed spans, these shrunk to whole
    code points so that it stays UTF-8. crowd: how many different stretches of one anchor
    are sorted in one task before they are dealt by their cores instead. words: passages
    of so many words that start twice go as well, whatever their length; 0: none. apart:
    these stay, and [s, e) of their maximal runs are in a column passages.
    """
    if apart and not words:
        raise ValueError("apart needs words")
    if length < 16:
        raise ValueError("length must be 16 bytes or more")
    k = length * 4 // 25  # 64 of 400
    t = F.coalesce(F.col(text), F.lit(""))
    k1, k2 = text_key(F.col(text))
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), t.alias("text"))
    texts = bucketed(texts.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")), "suffix_texts", "k1", "k2")
    rows = cut(texts.select("k1", "k2", "text").mapInArrow(_anchor_rows(length, k), _ANCHOR_SCHEMA), "suffix_anchors")
    # Of each stretch two places: where it occurs twice or more they are different ones, unless it does so in one text, where its bytes have been compared.
    two = [f(c).alias(f"{c}{x}") for x, f in (("", F.first), ("_", F.last)) for c in ("k1", "k2", "first", "last", "place")]
    spans = cut(rows.where("anchor IS NOT NULL").groupBy("anchor", "span", "check").agg(F.sum("times").alias("n"), *two), "suffix_spans")
    groups = spans.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    kind = F.when(F.col("kinds") > crowd, CROWDED).otherwise(DEAL)
    dealt = spans.join(groups, "anchor").select("k1", "k2", F.struct("first", "last", "place", F.col("anchor").alias("key"), kind.alias("kind")).alias("x"))
    judged_at = "k1 long, k2 long, s int, e int"

    def read(asked: DataFrame) -> DataFrame:
        asked = asked.groupBy("k1", "k2").agg(F.collect_list("x").alias("asked"))
        return texts.select("k1", "k2", "text").join(asked, ["k1", "k2"]).mapInArrow(_specimens(length, block), _SPECIMEN_SCHEMA)

    def judge(specimens: DataFrame) -> DataFrame:
        return specimens.repartition("key").sortWithinPartitions("key").mapInArrow(_judge(length), judged_at)

    def both(df: DataFrame, *key: str) -> DataFrame:
        """Two places of each row of df, to be compared byte by byte."""
        place = lambda x: df.select(F.col(f"k1{x}").alias("k1"), F.col(f"k2{x}").alias("k2"), F.struct(*[F.col(f"{c}{x}").alias(c) for c in ("first", "last", "place")], F.xxhash64(*key).alias("key"), F.lit(COMPARE).alias("kind")).alias("x"))
        return place("").unionByName(place("_"))

    twice = spans.where("n > 1")
    plain = dealt.where(F.col("x.kind") == DEAL).unionByName(both(twice, "span", "check"))
    blocks = cut(read(dealt.where(F.col("x.kind") == CROWDED)), "suffix_blocks")
    crowded = cut(blocks.groupBy("key").count().where(F.col("count") > crowd).select("key"), "suffix_crowded")
    loose = blocks.join(crowded, "key", "left_anti").select(*_SPECIMEN)
    windows = cut(blocks.join(crowded, "key", "left_semi").select("k1", "k2", "first", "windows", "stretch").mapInArrow(_windows(length), _WINDOW_SCHEMA), "suffix_windows")
    ends = [f(c).alias(f"{c}{x}") for x, f in (("", F.first), ("_", F.last)) for c in ("k1", "k2", "s")]
    often = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), *ends).where("n > 1")
    often = cut(often.withColumns({f"{c}{x}": F.col(f"s{x}") for x in ("", "_") for c in ("first", "last", "place")}), "suffix_often")
    found = judge(read(plain.unionByName(both(often, "h1", "h2"))).unionByName(loose))
    found = found.unionByName(windows.join(often.select("h1", "h2"), ["h1", "h2"]).select("k1", "k2", "s", (F.col("s") + length).alias("e")))
    same = rows.join(twice.select("span", "check").distinct(), ["span", "check"]).select("k1", "k2", F.col("first").alias("s"), (F.col("last") + length).alias("e"))
    own = rows.where("anchor IS NULL").select("k1", "k2", F.col("first").alias("s"), F.col("last").alias("e"))
    found = found.unionByName(same).unionByName(own)
    scratch = [rows, spans, blocks, crowded, windows, often]
    span, lists = F.struct("s", "e"), {}
    if words:
        found = cut(found, "suffix_found")
        discard(*scratch)
        scratch = [found]
    if apart:
        # Longer anchors than the pipeline's: more rows of them, but fewer windows in stretches that share a common line only.
        passages = repeated_passages(texts, words, max(1, words // 2))
        scratch.append(passages)
        found = found.withColumn("passage", F.lit(False)).unionByName(passages.withColumn("passage", F.lit(True)))
        lists = {"spans": F.when(~F.col("passage"), span), "passages": F.when(F.col("passage"), span)}
    elif words:
        found = found.unionByName(repeated_passages(texts, words))
    lists = lists or {"spans": span}
    cutting = cut(found.groupBy("k1", "k2").agg(*[F.collect_list(x).alias(c) for c, x in lists.items()]), "suffix_cutting")
    if apart or not words:
        discard(*scratch)
    done = texts.join(cutting, ["k1", "k2"], "left").select("k1", "k2", "text", "copies", *lists)
    return done.mapInArrow(_apply(length, with_text, words, apart), _APART_SCHEMA if apart else _RESULT_SCHEMA)


def dedup_substrings(docs: DataFrame, text: str = "text", length: int = 400, crowd: int = 512, with_text: bool = False, words: int = 0, apart: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256, removed (and kept): every byte covered by a repeated `length`-byte string is removed.

    Strings are judged on the input: each of their places goes, and overlaps count. A
    null text is empty; a text shorter than `length` keeps all. Repeated rows repeat each
    other's bytes, so from `length` bytes on they go whole. With words, each passage of
    so many words that starts twice goes as well, however few its bytes; apart: it stays, and
    a column passages has the [s, e) bytes of all such. An empty table gives an empty table. Columns of docs with the names of the new ones are replaced; others stay.
    """
    made = [*_RESULT[2:], *["passages"] * apart]
    new = [*made, "k1", "k2"]
    found = repeats(docs.select(text), text, length, crowd, with_text=with_text, words=words, apart=apart)
    found = found.select(*[F.col(c).alias(f"__{c}") for c in ["k1", "k2", *made] if with_text or c != "kept"])
    k1, k2 = text_key(F.col(text))
    rows = docs.drop(*[c for c in new if c != text]).withColumn("__k1", k1).withColumn("__k2", k2).join(found, ["__k1", "__k2"]).drop("__k1", "__k2")
    return rows.withColumnsRenamed({f"__{c}": c for c in made})
