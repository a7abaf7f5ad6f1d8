"""Hard negatives, language model and spelling variants against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenespark.llm import language, negatives, spelling

EMB = "vec_id long, embedding array<float>, label int, id string, v string, key int"


def mined(rows, positives=5, count=3, real=np.float32):
    """The contract, row by row."""
    good = [(i, lab, [math.floor(256 * float(real(x))) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, la, va in {(i, lab, tuple(v)) for i, lab, v in good if i % 5 == 0}:
        scored = sorted(((-dot(va, v), i, lab) for i, lab, v in good if i != a))
        for s, p, _ in [x for x in scored if x[2] == la][:positives]:
            hard = [(n, t) for t, n, lab in scored if lab != la and 50 * -s <= 100 * -t <= 95 * -s][:count]
            out += [(a, p, r + 1, n, -s, -t) for r, (n, t) in enumerate(hard)]
    return sorted(out)


def embeddings(rng, n=260):
    """Clusters and loose vectors, a third copies of one vector, ties, nulls and non-finite components."""
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    rows = [(i, unit([x + rng.gauss(0, 0.3) for x in centres[i % 6]]), rng.randint(0, 3)) for i in range(n // 3)]
    rows += [(i, unit([rng.gauss(0, 1) for _ in range(12)]), rng.randint(0, 3)) for i in range(n // 3, 2 * n // 3)]
    rows += [(i, unit(centres[0]), i % 3) for i in range(2 * n // 3, n)]
    rows += [(n, None, 1), (n + 5, [1.0, None], 1), (n + 10, [float("nan")] * 3, 1), (n + 15, [float("inf")], 2), (n + 20, [0.5] * 12, None), (None, [0.5] * 12, 1)]
    return [*rows, (n + 25, [0.0] * 12, 1), (n + 30, [], 2), (n + 35, [0.25, 0.5], 3), rows[5], rows[5], rows[10], (n + 41, [3.0] * 12, 0), (n + 45, [-2.0] * 12, 0)]


@pytest.mark.parametrize("tile", [8, 16384])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(negatives, "MOST", tile)
    monkeypatch.setattr(negatives, "LEAST", min(tile, 1024))
    monkeypatch.setattr(negatives, "CHUNK", tile)
    rows = embeddings(random.Random(tile))
    df = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], EMB)
    got = negatives.mine(negatives.prepared(df), F.col("id") % 5 == 0).collect()
    assert sorted(map(tuple, got)) == mined(rows)


def test_hard_negatives_of_very_large_components_and_nothing(spark):
    """Scores beyond 2^53 stay exact."""
    rows = [(i, [1e8 * (1 + i) + i % 4, float(i % 3)], i % 2) for i in range(12)]
    df = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], EMB.replace("float", "double"))
    got = negatives.mine(negatives.prepared(df, scale=1), F.col("id") % 5 == 0).collect()
    assert sorted(map(tuple, got)) == mined([(i, [x / 256 for x in v], lab) for i, v, lab in rows], real=float) != []
    for none in (df.where("false"), df.where("label IS NULL"), df.where("vec_id % 5 <> 0")):
        assert negatives.mine(negatives.prepared(none), F.col("id") % 5 == 0).count() == 0


def test_best_keeps_order_and_ties():
    rng = np.random.default_rng(3)
    scores, ids = rng.integers(-4, 4, (7, 400)), rng.permutation(400)
    scores[2] = negatives.NONE
    scores[3, 2:] = negatives.NONE
    for big in (1, 1 << 45):
        s = np.where(scores == negatives.NONE, scores, scores * big)
        got, at = negatives._best(s, ids, 5)
        for r in range(7):
            want = sorted(zip((-s[r]).tolist(), ids.tolist()))[:5]
            assert got[r].tolist() == [-x for x, _ in want]
            assert all(a == b for a, (x, b) in zip(at[r].tolist(), want) if -x != negatives.NONE)


def edit(a, b):
    """Whether exactly one insertion, deletion or replacement leads from a to b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts, ratio=5):
    near = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, ns in near.items():
        best = min(ns, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    root = {}
    for w in counts:
        r = w
        while form[r]:
            r = form[r]
        root[w] = r
    return {(w, form[w], root[w], counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


@pytest.mark.parametrize("block", [3, 2048])
def test_variants_equal_brute_force(spark, block):
    """Hot prefixes and suffixes, ties, chains of forms, the empty word, astral code points; one block a bucket or many."""
    rng = random.Random(block)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(150)}
    words |= {f"prefix{rng.choice('abcé')}{rng.choice('xyz')}" for _ in range(12)} | {f"{rng.choice('abcé')}{rng.choice('xyz')}suffix" for _ in range(12)} | {"𝔘nicode", "unicode", "𝔘nicod", "éa", "è"}
    counts = {w: 5 ** rng.randint(0, 5) * rng.choice([1, 1, 2]) for w in sorted(words)}
    rows = [(w, n) for w, n in counts.items()]
    df = spark.createDataFrame([*rows, (None, 7)], "word string, n long")
    assert set(map(tuple, spelling.variants(df, block=block).collect())) == grouped(counts)
    assert spelling.variants(df.where("false")).count() == 0


def test_spelling_of_documents_equals_brute_force(spark):
    import re

    rng = random.Random(13)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(5, 9))) for _ in range(40)]
    say = lambda k: " ".join(w.capitalize() if rng.random() < 0.2 else w for w in rng.choices(base, [1 / (i + 1) for i in range(40)], k=k))
    texts = [say(rng.choice([3, 40, 200])) for _ in range(250)] + [None, "", "  ", "ÀBCDEFG×÷ÿ-abcdef9ABCDEF_" * 7, say(30000), "x" * 70000]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[4])]
    counts = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c < "\x7f" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(5)
    got = set(map(tuple, spelling.spelling_variants(docs).collect()))
    assert got == grouped(counts) and any(r[1] for r in got)


TEXTS = "doc_id long, text string, word string, score string, c int"


def speech(rng, n):
    """Two invented languages with their own small words."""
    tongues = [["the", "of", "and", "to"], ["le", "de", "et", "un"]]
    vocabulary = [["".join(rng.choice(s) for _ in range(rng.randint(3, 8))) for _ in range(120)] for s in ("bcdfaeiou", "lmnréèaeu")]
    out = []
    for i in range(n):
        t = i % 2
        out.append(" ".join(x for _ in range(rng.choice([5, 60, 150])) for x in (rng.choice(tongues[t]), rng.choice(vocabulary[t]))))
    return out


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def test_language_model(spark):
    """Counts and base score by brute force; better than them where held out; the same again; odd texts."""
    rng = random.Random(12)
    texts = [*speech(rng, 300), None, "", " \n\t", "NEVER-seen words ONLY", "the " * 30000, "a\x1cb \x85c\xa0d", "é" * 5000]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[4])]
    docs = spark.createDataFrame([(i, t, "w", "s", 1) for i, t in rows], TEXTS).repartition(3)
    mark = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) == 2
    got = language.score(docs, mark).collect()
    cut = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + [None]
    counts = Counter(w for i, t in rows if not held(i) for w in cut(t))
    total, kinds = sum(counts.values()), len(counts)
    want = Counter((i, held(i), len(cut(t)), sum(counts[w] > 0 for w in cut(t)), total, round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in cut(t)), 6)) for i, t in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    out = [r for r in got if r["held_out"] and r["n_tokens"] > 20]
    assert len(out) > 20 and sum(r["score"] for r in out) > sum(r["base_score"] for r in out) + 0.2 * sum(r["n_tokens"] for r in out)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    again = {(r["doc_id"], r["n_tokens"]): r["score"] for r in language.score(docs, mark).collect()}
    assert all(abs(again[r["doc_id"], r["n_tokens"]] - r["score"]) < 1e-4 * r["n_tokens"] for r in got)


def test_language_model_sums_to_one(spark):
    """Over all words of training and one unseen event a rare class, after any words; and what it learned isn't what held-out texts say."""
    rng = random.Random(5)
    texts = spark.createDataFrame([(t, i % 16) for i, t in enumerate(speech(rng, 160))], "text string, round int")
    counts = language.token_counts(texts)
    model = language.dictionary_of(counts, 160, frequent=60, dictionary=120)
    assert 60 < len(model.words) <= 140 and min(model.counts) >= 1
    model = language.fit(language.encode(texts, model), counts, model)
    words = [(r["word"].encode(), r["c"]) for r in counts.collect()]
    lookup = language.Words(model.words)
    for context in (b"", b"the", b"le xxx", b"of and zzz never"):
        total = 0.0
        for w, c in words:
            codes, numbers, _, missed = model.encode(lookup, [context + b" " + w])
            at = codes[:-1]  # without the end: the word's own probability is the last
            p = language.log_probabilities(model, at)[-1]
            if numbers[-2] >= model.frequent:
                p += math.log10(c + 1)
            total += 10**p
        codes = model.encode(lookup, [context])[0]
        total += 10 ** language.log_probabilities(model, codes)[-1]  # the end
        at = np.array([len(codes) - 1])
        p = language._gradient(model.class_bias, model.tables[0], model.features(codes, at)[0], np.array([0]))[0]
        p[0] += 1
        rare = np.arange(len(p)) >= len(p) - language.RARE
        total += float((p[rare] / (model.rare_sums[rare] + 1)).sum())
        assert abs(total - 1) < 1e-4


def test_language_model_without_rows_or_training(spark):
    docs = spark.createDataFrame([(1, "some words", "w", "s", 1), (2, None, "w", "s", 1)], TEXTS)
    assert language.score(docs.where("false"), F.lit(False)).count() == 0
    got = {r["doc_id"]: r for r in language.score(docs, F.lit(True)).collect()}
    assert got[1]["n_tokens"] == 3 and got[2]["n_tokens"] == 1 and got[1]["n_known"] == got[1]["train_tokens"] == 0 and got[1]["base_score"] == 0
    assert got[1]["score"] < 0
