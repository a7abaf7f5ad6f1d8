"""License scans: MinHash bands over overlapping word windows retrieve templates, exact containment verifies.

A template of L words is sought in windows of about its own size and a quarter, a quarter
of it apart, so that any stretch of L words lies whole in some window. Every window of
every text is hashed and looked up by its bands; with `bands` bands of `rows` MinHashes
one whose shingles agree with a template's to Jaccard s shares a band with probability
1 - (1 - s^rows)^bands: over 0.9998 at s = 0.55, which is about what a template of which a
fifth has been changed has with such a window. What the bands find, and nothing else, is
verified on the words themselves. The index over templates is part of each task: it is
bounded by `max_templates`.

A shingle is five words, or all words of a template that has fewer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

# Notices as their licenses give them, and the one-line forms in common use.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT line": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
}

SHINGLE = 5
PIECE = 1 << 12  # words that are hashed at a time
FEW = 8  # templates of one size that are compared one by one, without a lookup
_WORD = re.compile(r"\w+")
_U = np.uint64
_STEPS = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(SHINGLE)], np.uint64)
_MIX = _U(0xD6E8FEB86659FD93)


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(ws: list[str], n: int | None = None) -> list[str]:
    """Each n consecutive words; by default five, or all where there are fewer."""
    n = min(SHINGLE, len(ws)) if n is None else n
    return [" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)] if n else []


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _MIX
    return h ^ (h >> _U(29))


def _step(n: int) -> int:
    """How far apart the windows for a template of n words are."""
    return max(1, (n + 1) // 4)


class _Hashes(dict):
    """Hashes of words, kept for as long as they are few; long words aren't kept."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word, 0)
        if len(word) <= 64:
            if len(self) >= 1 << 18:
                self.clear()
            self[word] = h
        return h


class Index:
    """Templates by bands of MinHashes."""

    def __init__(self, templates: dict[str, str], bands: int = 24, rows: int = 2, max_templates: int = 10_000):
        if len(templates) > max_templates:
            raise ValueError(f"{len(templates)} templates; the index in each task holds {max_templates}")
        rng = np.random.default_rng(7)
        self.a = rng.integers(1, 1 << 32, bands * rows, np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, np.uint32)
        self.bands, self.rows, self.hashes = bands, rows, _Hashes()
        split = {name: ws for name, t in templates.items() if (ws := words(t))}
        self.names = sorted(split)
        self.sets = {name: frozenset(shingles(ws)) for name, ws in split.items()}
        self.shingle = {name: min(SHINGLE, len(ws)) for name, ws in split.items()}
        #: (words of a shingle, words of a template) of each group of templates that share their windows.
        self.groups = sorted({(self.shingle[name], len(ws)) for name, ws in split.items()})
        self.widest = max((n + _step(n) for _, n in self.groups), default=0)
        # By group: band keys, rising, the template of each, a filter by their low bits, and of a few templates each one's keys.
        self.tables = []
        for group in self.groups:
            own = [i for i, name in enumerate(self.names) if (self.shingle[name], len(split[name])) == group]
            each = [self.keys(self.spread(self.word_hashes(split[self.names[i]]), group[0]).min(axis=0)[None, :])[0] for i in own]
            keys, owners = np.concatenate(each), np.repeat(own, bands)
            order = np.argsort(keys, kind="stable")
            low = np.zeros(1 << max(12, int(64 * len(keys)).bit_length()), bool)
            low[keys & _U(len(low) - 1)] = True
            self.tables.append((keys[order], owners[order], low, list(zip(own, each)) if len(own) <= FEW else None))

    def word_hashes(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.hashes.__getitem__, ws), np.uint64, len(ws))

    def spread(self, h: np.ndarray, k: int) -> np.ndarray:
        """Every hash function of every shingle of k words, from the words' hashes."""
        n = len(h) - k + 1
        x = np.zeros(n, np.uint64)
        for j in range(k):
            x += h[j : j + n] * _STEPS[j]
        return (_mixed(x) >> _U(32)).astype(np.uint32)[:, None] * self.a + self.b

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """The band keys of each row of minima."""
        if self.rows == 2:
            return minima.view(np.uint64)  # two minima side by side are the key
        m = minima.reshape(len(minima), self.bands, self.rows)
        key = m[:, :, 0].astype(np.uint64)
        for r in range(1, self.rows):
            key = key * _STEPS[2] + m[:, :, r]
        return key

    def candidates(self, texts: list[list[str]]) -> Iterator[tuple[int, str, int, int]]:
        """(text, template, first word, end word) of every window that shares a band with a template.

        The minima of a window are those of two runs of a power of two that cover it; runs
        are made once, by doubling, for the windows of all templates.
        """
        h = self.word_hashes([w for ws in texts for w in ws])
        size = np.array([len(ws) for ws in texts])
        begin = np.cumsum(size) - size
        for k in sorted({k for k, _ in self.groups}):
            own = np.flatnonzero(size >= k)
            if not len(own):
                continue
            m = size[own] - k + 1
            made = []  # group, text, first shingle, shingles
            for g, (kk, n) in enumerate(self.groups):
                if kk == k:
                    step = _step(n)
                    last = np.maximum(0, m - (n + step - k + 1))  # the last window ends with its text
                    count = -(-last // step) + 1
                    text = np.repeat(np.arange(len(own)), count)
                    at = np.minimum((np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * step, last[text])
                    made.append((g, text, at, np.minimum(m[text], n + step - k + 1)))
            level = [np.frexp(c[3].astype(float))[1] - 1 for c in made]
            top, run = max(int(c.max()) for c in level), self.spread(h, k)
            for p in range(top + 1):
                for (g, text, at, length), own_level in zip(made, level):
                    here = np.flatnonzero(own_level == p)
                    if not len(here):
                        continue
                    text, at, length = text[here], at[here], length[here]
                    place = begin[own][text] + at
                    found = self.keys(np.minimum(run.take(place, axis=0), run.take(place + length - (1 << p), axis=0)))
                    keys, owners, low, few = self.tables[g]
                    if few is not None:
                        pairs = ((r, i) for i, own_keys in few for r in np.flatnonzero(found == own_keys) // self.bands)
                    else:
                        hit = np.flatnonzero(low.take((found & _U(len(low) - 1)).view(np.int64)))
                        key = found.ravel()[hit]
                        lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                        pairs = ((r, i) for r, a, z in zip(hit // self.bands, lo, hi) for i in owners[a:z])
                    for w, i in sorted({(int(r), int(i)) for r, i in pairs}):
                        yield int(own[text[w]]), self.names[i], int(at[w]), int(at[w] + length[w] + k - 1)
                if p < top:
                    run = np.minimum(run[: -(1 << p)], run[1 << p :])

    def scan(self, texts: list[str | None], threshold: float) -> Iterator[tuple[int, str, float, int, int]]:
        """(text, template, containment, first word, end word) of the best window of each template that reaches the threshold, text by text."""
        held, at, room = [], [], PIECE
        best: dict[tuple[int, str], tuple[float, int, int]] = {}

        def verify() -> None:
            for j, name, s, e in self.candidates(held):
                i, p = at[j]
                own = self.sets[name]
                share = len(own.intersection(shingles(held[j][s:e], self.shingle[name]))) / len(own)
                old = best.get((i, name))
                if share >= threshold and (old is None or (-share, p + s) < (-old[0], old[1])):
                    best[i, name] = (share, p + s, p + e)
            held.clear()
            at.clear()

        for i, text in enumerate(texts):
            ws = words(text)
            for p in range(0, max(1, len(ws) - self.widest), PIECE):  # pieces overlap by the widest window
                held.append(ws[p : p + PIECE + self.widest])
                at.append((i, p))
                room -= len(held[-1])
                if room <= 0:
                    verify()
                    room = PIECE
        verify()
        yield from ((i, name, *best[i, name]) for i, name in sorted(best))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, threshold: float = 0.8, bands: int = 24, rows: int = 2, max_templates: int = 10_000) -> DataFrame:
    """One row for each document and template of which a window holds `threshold` of the shingles or more.

    (id, license, containment double, first_word int, end_word int): of several windows
    the fullest, then the first. A null or empty text matches nothing; a template of
    fewer words than a shingle is one shingle, all its words, and is sought in documents
    of any length. Repeated rows each get their rows. Very long texts are hashed in
    pieces that overlap. An empty table gives an empty table. Only the id and the text
    are read, so other columns of docs, whatever their names, make no difference.
    """
    index = Index(TEMPLATES if templates is None else templates, bands, rows, max_templates)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = list(index.scan(b.column("t").to_pylist(), threshold))
            if hits:
                at, *rest = zip(*hits)
                columns = [pa.array(c, t) for c, t in zip(rest, (pa.string(), pa.float64(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), *columns], names=["id", "license", "containment", "first_word", "end_word"])

    rows_ = docs.selectExpr(f"`{id_col}` AS id", f"`{text}` AS t").mapInArrow(run, f"id {kind}, license string, containment double, first_word int, end_word int")
    return rows_.withColumnRenamed("id", id_col)
