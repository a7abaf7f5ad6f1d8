"""The five stages on a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline as P


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(9)
    words = ["".join(rng.choice("abdeghiklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    bench, passage = [say(25) for _ in range(4)], say(90)
    rows, labels = [], []
    for i in range(220):
        t = say(rng.randint(40, 120))
        if i % 11 == 0:
            t = t.replace(" ", " stupid idiot ", 3)
        labels.append((i, 1, int(i % 11 == 0)))
        rows.append([i, t])
    rows[101][1] = rows[100][1]  # copy
    rows[103][1] = rows[102][1] + " end"  # near copy
    for i in (105, 106):
        rows[i][1] += " " + passage + " " + say(30)
    rows[107][1] += " " + bench[1]
    rows[108][1], rows[109][1] = None, ""
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), passage


def test_stages(spark, sf_dir):
    d, passage = sf_dir
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES:
        path = f"{d}/out_{name}"
        stage(spark, docs, d).write.parquet(path)
        docs = spark.read.parquet(path)
        assert name == "mix" or docs.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = set(range(0, 220, 11))
    assert not toxic & set(kept["toxicity"]) and len(kept["toxicity"]) == 220 - len(toxic)
    near = kept["simhash_near_dedup"]
    assert 100 in near and 101 not in near and 108 in near and 109 not in near
    texts = kept["suffix_dedup"]
    assert all(passage[40:-40] not in (t or "") for t in texts.values()) and set(texts) == set(near)
    assert all(texts[i] == near[i] for i in near if i not in (102, 103, 105, 106))
    assert set(kept["decontaminate"]) == set(texts) - {107}
    assert set(kept["mix"]) <= set(kept["decontaminate"])


def test_run_and_registration(spark, sf_dir):
    import __spark_entry__ as entry

    assert {"pipeline", "op1_mix_sources", "op10_toxicity"} <= set(entry.queries())
    out = P.run(spark, sf_dir[0])
    assert out.where("copies < 1").count() == 0 and out.count() > 0


def test_missing_subpackage_leaves_the_rest(tmp_path):
    """A copy without the llm folders still has its other queries, with corpus_pipeline.py left in it or not."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(P.__file__).resolve().parent
    shutil.copytree(root / "scenespark", tmp_path / "scenespark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copy(root / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'paired_rows' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)


def test_stages_take_odd_tables(spark, tmp_path):
    """Empty tables, nulls in every column, repeated rows, ties, and columns of any name and type."""
    text = " ".join(f"word{i}" for i in range(80))
    kinds = "doc_id long, text string, source string, score string, predicted int, spans map<string,int>, n_hit int, kept string, removed string, contaminated boolean, fp int, component_id int, `k1` int, n_words string, Size int"
    row = lambda i, t, s="a": (i, t, s, "s", 1, {"a": 1}, 2, "k", "r", True, 3, 4, 5, "n", 6)
    rows = [row(1, text), row(1, text), row(2, text + " more"), (None,) * 15, (None,) * 15, row(3, None), row(4, ""), row(5, " \n"), row(None, "some words of its own"), row(6, "what a stupid idiot stupid idiot"), row(7, "eleven words that the benchmark has as well as this text"), row(8, "plain and short")]
    docs = spark.createDataFrame(rows, kinds)
    d = str(tmp_path)
    spark.createDataFrame([(1, 0), (6, 1), (None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "eleven words that the benchmark has as well as this text"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    same = lambda out: sorted(map(str, (tuple(r)[2:] for r in out)))
    for name, stage in P.STAGES:
        none = stage(spark, docs.where("false"), d)
        assert none.count() == 0 and (name == "mix" or none.columns == docs.columns)
        out = stage(spark, docs, d)
        got = out.collect()
        if name != "mix":
            assert out.columns == docs.columns and set(same(got)) <= set(same(map(tuple, rows)))
        ids = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in got)
        if name == "toxicity":
            assert ids == [-1, -1, -1, 1, 1, 2, 3, 4, 5, 7, 8]
        if name == "simhash_near_dedup":
            assert ids == [-1, 1, 3, 6, 7, 8]
        if name == "suffix_dedup":
            assert ids == [-1, -1, -1, 2, 3, 4, 5, 6, 7, 8] and {r["doc_id"]: r["text"] for r in got}[2].strip() == "more"
        if name == "decontaminate":
            assert ids == [-1, -1, -1, 1, 1, 2, 3, 4, 5, 6, 8]


def test_passages_of_51_words(spark):
    """51 short words that two documents share go, 50 stay; byte by byte as by brute force."""
    rng = random.Random(51)
    say = lambda k: " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 9999)}"[: rng.randint(2, 5)] for _ in range(k))
    p51, p50, own = say(51), say(50), say(60)
    texts = [f"{say(30)} {p51} {say(20)}", f"{say(9)}  {p51}\n{say(70)}", f"{say(30)} {p50} {say(5)}", f"{say(3)} {p50} {say(40)}", f"{own} x {own}", p51, "é " * 60 + say(5), say(50), "", " \n", say(300)]
    assert len(p51) < 400
    rows = [(i, t, len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: r for r in P.cut_repeats(spark, docs, "").collect()}

    import re

    where = {}
    for i, t in enumerate(texts):
        words = list(re.finditer(r"[^\x20\x09-\x0D]+", t))
        for j in range(len(words) - 50):
            where.setdefault(tuple(w[0] for w in words[j : j + 51]), []).append((i, words[j].start(), words[j + 50].end()))
    gone = [set() for _ in texts]
    for places in where.values():
        for i, s, e in places if len(places) > 1 else []:
            gone[i] |= set(range(s, e))
    want = {i: "".join(c for x, c in enumerate(t) if x not in gone[i]) for i, t in enumerate(texts)}
    want = {i: t for i, t in want.items() if t.strip() or not gone[i]}
    assert {i: r["text"] for i, r in got.items()} == want and all(r["n_chars"] == len(want[i]) for i, r in got.items())
    assert 5 not in want and p51 not in want[0] and p50 in want[2] and own not in want[4]


@pytest.mark.parametrize("size", [7, 1 << 17])
def test_long_texts_are_taken_in_pieces(size):
    from scenespark.llm import suffix as X

    words = [f"w{random.Random(i).randint(0, 30)}" for i in range(400)]
    data = X.np.frombuffer(" ".join(words).encode(), X.np.uint8)
    starts, ends = X._words(data, X.np.array([0, len(data)]))
    seen = {}
    for x, y in X._pieces(len(starts), 51, size):
        first, last, anchor = X.word_anchors(data, starts[x:y], ends[x:y], X.np.zeros(y - x, int), 51, 8)
        for f, z, a in zip(first.tolist(), last.tolist(), anchor.tolist()):
            seen.update({i + x: a for i in range(f, z + 1)})
    whole = X.word_anchors(data, starts, ends, X.np.zeros(len(starts), int), 51, 8)
    assert seen == {i: a for f, z, a in zip(*(v.tolist() for v in whole)) for i in range(f, z + 1)} and len(seen) == 350


def test_near_copies_at_0_8_go(spark):
    """Every pair whose exact five-word similarity is 0.8 or more is linked, and no clean text goes."""
    rng = random.Random(80)
    say = lambda k: [f"w{rng.randint(0, 99999)}" for _ in range(k)]
    texts = [say(150) for _ in range(60)]
    texts += [[*t[:20], "changed", *t[21 : 60 + i], "again", *t[61 + i :]] for i, t in enumerate(texts[:40])]
    texts += [t[:90] + say(60) for t in texts[40:50]]  # similarity under 0.5: stays
    texts += [say(3), say(3)]
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)]

    sets = [{tuple(t[j : j + 5]) for j in range(max(1, len(t) - 4))} for t in texts]
    gone = {j for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in P.drop_near_duplicates(spark, docs, "").collect()}
    assert len(gone) == 40 and kept == set(range(len(texts))) - gone


def test_crowded_buckets_are_not_gathered(spark):
    from scenespark.llm.resemblance import resembling

    line = [f"w{i}" for i in range(200)]
    rows = [(i, -i, " ".join([*line[:100], f"x{i}", *line[100:]])) for i in range(80)]
    found = resembling(spark.createDataFrame(rows, "k1 long, k2 long, text string"), crowd=8).collect()
    assert {x for r in found for x in (r["a1"], r["b1"])} == set(range(80)) and len(found) < 80 * 79 / 2


def test_crowded_buckets_lose_no_link(spark):
    """Drifting copies, of which the ends don't resemble each other, and two clusters that share buckets: classes as by brute force."""
    from scenespark.llm.resemblance import jaccard, resembling

    rng = random.Random(4)
    line = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(50):  # each one word further from the first
        line[3 * i] = f"x{rng.randint(0, 9999)}"
        texts.append(" ".join(line))
    base = [f"v{i}" for i in range(200)]
    for c in range(2):  # similarity across the two about 0.7
        own = [f"{w}c{c}" if 90 <= i < 112 else w for i, w in enumerate(base)]
        texts += [" ".join([*own[: 4 * i], f"y{i}", *own[4 * i :]]) for i in range(25)]
    rows = [(i, -i, t) for i, t in enumerate(texts)]
    found = {(r["a1"], r["b1"]) for r in resembling(spark.createDataFrame(rows, "k1 long, k2 long, text string"), crowd=4).collect()}
    true = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if jaccard(texts[i].encode(), texts[j].encode()) >= 0.8}

    def classes(pairs):
        top = list(range(len(texts)))
        for a, b in sorted(pairs):
            x, y = top[a], top[b]
            top = [min(x, y) if t in (x, y) else t for t in top]
        return top

    assert found <= true and len(found) < len(true) and classes(found) == classes(true)
    assert len(set(classes(true))) >= 3 and jaccard(texts[0].encode(), texts[49].encode()) < 0.8


def test_templates_make_no_pairs(spark):
    """Hundreds of texts with most of their words in common: the links are those of brute force, and few pairs are verified for them."""
    from scenespark.llm import resemblance as R

    rng = random.Random(9)
    template = [f"t{i}" for i in range(100)]
    texts = []
    for i in range(240):  # from half to nearly all of the words are the template's
        own = [f"u{rng.randint(0, 10**9)}" for _ in range(rng.choice([5, 18, 25, 40, 90]))]
        texts.append(" ".join([*template, *own]))
    rows = spark.createDataFrame([(i, -i, t) for i, t in enumerate(texts)], "k1 long, k2 long, text string")
    seen = []
    real = R._linked
    try:
        R._linked = lambda pairs, *rest: seen.append(pairs.count()) or real(pairs, *rest)
        found = {(r["a1"], r["b1"]) for r in R.resembling(rows, crowd=8).collect()}
    finally:
        R._linked = real
    sets = [R.shingle_set(t.encode()) for t in texts]
    true = {(i, j) for i in range(240) for j in range(i + 1, 240) if R.similarity(sets[i], sets[j]) >= 0.8}
    linked = {x for p in true for x in p}
    top = list(range(240))
    for a, b in sorted(found):
        x, y = top[a], top[b]
        top = [min(x, y) if t in (x, y) else t for t in top]
    assert found <= true and len(true) > 500 and all(top[a] == top[b] for a, b in true)
    assert sum(seen) < 240 * 239 / 8 and 0 < len(linked) < 240


def test_bitmaps_and_prefixes_rule_no_pair_out(spark):
    """Every pair at 0.8 or more is still there after lengths, positions and parity bitmaps."""
    from scenespark.llm import resemblance as R

    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[: rng.randint(50, 60)], *[f"z{rng.randint(0, 40)}" for _ in range(rng.randint(0, 9))]]) for _ in range(60)] + ["a b c", "a b c d", "one", ""]
    texts = list(dict.fromkeys(texts))
    df = spark.createDataFrame([(i, -i, t) for i, t in enumerate(texts)], "k1 long, k2 long, text string")
    keys = df.select("k1", "k2")
    none = spark.createDataFrame([], "a1 long, a2 long, b1 long, b2 long")
    found = {(r["a1"], r["b1"]) for r in R._crowded(df, keys, none, 0.8, 10**6).collect()}
    true = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if R.jaccard(texts[i].encode(), texts[j].encode()) >= 0.8}
    assert found == true and len(true) > 20


def test_words_whose_polynomial_hashes_collide(spark):
    """Two words of 1,024 letters (a Thue-Morse sequence and its complement) are not one another, in passages and in near copies."""
    from scenespark.llm.resemblance import jaccard
    from scenespark.llm.suffix import repeated_passages

    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    half = [f"w{i}" for i in range(60)]
    say = lambda w: " ".join([*half[:30], w, *half[30:]])
    rows = lambda *ts: spark.createDataFrame([(i, -i, t) for i, t in enumerate(ts)], "k1 long, k2 long, text string")
    assert repeated_passages(rows(say(one), say(other)), 51).count() == 0
    assert repeated_passages(rows(say(one), say(one) + " more"), 51).count() == 22
    assert abs(jaccard(say(one).encode(), say(other).encode()) - 52 / 62) < 1e-9


def test_frames_outlive_other_stages(spark, tmp_path):
    """Two operators and two stages, built one after the other and run after that; the session's settings stay."""
    from scenespark.llm import entry as E

    text = " ".join(f"word{i}" for i in range(80))
    d = str(tmp_path)
    docs = spark.createDataFrame([(i, f"{text} x{i}" if i % 3 else f"own{i} " * 30, "en", "ab"[i % 2], 9) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 0), (6, 1)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    settings = dict(spark.conf.getAll)
    frames = [E.op9_simhash(spark, d), E.op1_mix_sources(spark, d), *(stage(spark, docs, d) for _, stage in P.STAGES)]
    assert dict(spark.conf.getAll) == settings
    assert [f.count() for f in frames][:2] == [30, 30]
