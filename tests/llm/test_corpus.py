"""Brute force beside every operator, and the cases all of them must stand: nulls, ties, repeats, empty tables."""

import itertools
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import language_id, ngram_join, nn_descent, quality_rules, substring_dedup, textkernel, toxicity, warc
from quarrylight.llm.chat import rotate_perspectives
from quarrylight.llm.components import components
from quarrylight.llm.fm_index import FMIndex
from quarrylight.llm.mixing import mix_sources
from quarrylight.llm.ngram_join import ngram_jaccard_join, signatures
from quarrylight.llm.nn_descent import near_duplicate_classes
from quarrylight.llm.packing import best_cuts, pack_documents
from quarrylight.llm.substring_dedup import remove_repeats, repeated_spans
from quarrylight.llm.textkernel import buffers
from quarrylight.llm.toxicity import fit, score_toxicity, train
from quarrylight.llm.warc import LoserTree, capture_index

DOCS = "doc_id long, text string, lang string, source string, n_chars long, m_rows int, copy string"


def words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower()) if text else []


def corpus(n=60, seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(2, 6))) for _ in range(400)]
    text = lambda k: " ".join(r.choices(vocabulary, k=k))
    rows = [[i, text(r.randint(1, 90))] for i in range(n)]
    shared = text(60)
    for i in range(0, n, 5):
        rows[i][1] += ". " + shared
    for i in range(1, n, 6):
        w = rows[i][1].split()
        w[r.randrange(len(w))] = "changed"
        rows.append([n + i, " ".join(w)])
    rows += [[900, rows[3][1]], [901, rows[3][1].upper()], [902, None], [903, ""], [904, " .,! "], [905, "one"], [906, "One"], [None, rows[3][1]], [7, rows[7][1]], [7, rows[7][1]]]
    return [(i, t, "en", f"s{(i or 0) % 3}" if i != 5 else None, len(t or ""), 1, "x") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


def classes_by_brute_force(rows, t=0.5, n=3):
    """{id: (class, links)}: every pair of texts compared, links followed."""
    sets = {}
    for i, x in {r[:2] for r in rows if r[0] is not None}:
        w = words(x)
        sets[i, x] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    links, root = dict.fromkeys(sets, 0), {x: x[0] for x in sets}
    pairs = [(x, y) for x, y in itertools.permutations(sets, 2) if sets[x] and len(sets[x] & sets[y]) >= t * len(sets[x] | sets[y])]
    for x, y in pairs:
        links[x] += 1
    for _ in sets:
        for x, y in pairs:
            root[x] = min(root[x], root[y])
    return {i: (min(v for (j, _), v in root.items() if j == i), sum(v for (j, _), v in links.items() if j == i)) for i, _ in sets}


def test_ngram_join_is_exact(docs):
    want = classes_by_brute_force([(i, t) for i, t, *_ in corpus()])
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_jaccard_join(docs).collect()}
    assert got == want and any(n > 1 for _, n in want.values())


def test_ngram_join_of_large_groups(spark, monkeypatch):
    """A chain, a group of near copies over several tiles, thousands of equal texts: nothing is lost."""
    monkeypatch.setattr(ngram_join, "TILE", 7)
    r = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(40):
        w = list(base)
        for k in r.sample(range(60), r.randint(0, 6)):
            w[k] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    chain = [f"c{k}" for k in range(120)]
    rows += [(100 + i, " ".join(chain[8 * i : 8 * i + 40])) for i in range(10)]
    rows += [(1000 + i, "equal words of all these rows") for i in range(300)] + [(5000, "x " * 30_000), (5001, "x " * 40_000)]
    got = {x.doc_id: (x.class_id, x.n_links) for x in ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes_by_brute_force(rows)


@pytest.mark.parametrize("seed", range(2))
def test_ngram_join_parts_large_groups(spark, monkeypatch, seed):
    """Near copies of several bases that run into each other: cores, sets near to cores, and the rest, over several tiles."""
    monkeypatch.setattr(ngram_join, "TILE", 6)
    monkeypatch.setattr(ngram_join, "CENTRES", 2)
    r = random.Random(seed)
    bases = [[f"b{k}_{x}" for x in range(50)] for k in range(3)]
    for k in (1, 2):  # bases share half of their words
        bases[k][: 25 + 3 * k] = bases[k - 1][: 25 + 3 * k]
    rows = []
    for i in range(120):
        w = list(r.choice(bases))
        for k in r.sample(range(50), r.choice([0, 0, 1, 2, 3, 6])):
            w[k] = f"x{r.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    got = {x.doc_id: (x.class_id, x.n_links) for x in ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes_by_brute_force(rows)


def test_ngram_join_parts_groups_that_only_signatures_hold_together(spark, monkeypatch):
    """Documents that share a few rare passages with others, but link to none of them, aren't compared tile by tile."""
    monkeypatch.setattr(ngram_join, "TILE", 7)
    monkeypatch.setattr(ngram_join, "_tiled", lambda *_: pytest.fail("compared tile by tile"))
    r = random.Random(3)
    shared = [" ".join(f"s{k}_{x}" for x in range(5)) for k in range(20)]
    rows = [(i, " ".join(f"{p} u{i}" for p in r.sample(shared, 5))) for i in range(60)]
    rows += [(100 + i, f"{rows[i][1]} more") for i in range(3)]
    want = classes_by_brute_force(rows)
    assert sum(n > 0 for _, n in want.values()) < 12
    assert {x.doc_id: (x.class_id, x.n_links) for x in ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_pipeline_parts_groups_that_only_signatures_hold_together(spark, monkeypatch):
    """The stage for near duplicates doesn't compare them tile by tile either, and drops near copies only."""
    import corpus_pipeline

    monkeypatch.setattr(ngram_join, "TILE", 7)
    monkeypatch.setattr(ngram_join, "_tiled", lambda *_: pytest.fail("compared tile by tile"))
    r = random.Random(4)
    shared = [" ".join(f"s{k}_{x}" for x in range(5)) for k in range(20)]
    rows = [(i, " ".join(f"{p} u{i}" for p in r.sample(shared, 5))) for i in range(60)]
    rows += [(100 + i, f"{rows[i][1]} more") for i in range(3)]
    want = {i for i, (least, _) in classes_by_brute_force(rows).items() if least == i}
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert {x.doc_id for x in kept} == want and 45 < len(want) <= 60


def test_ngram_join_moves_only_what_can_link():
    """A range names a set once for all its pieces, and only sets with enough repeated tokens for a partner have a body."""
    r = random.Random(6)
    rows = [(i, " ".join([f"u{i}_{x}" for x in range(40)] + ["a", "b", "c", "d"] * r.randint(1, 3))) for i in range(40)]
    rows += [(100 + i, f"{rows[i][1]} more") for i in range(5)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows])})
    counted = list(ngram_join._count(1, 4)(ngram_join._spread(3, 1, 4)(iter([batch]))))
    assert sum(k == 0 for b in counted for k in b.column("kind").to_pylist()) == 1
    items = [x for b in ngram_join._gather(0.5)(iter(counted)) for x in b.to_pylist() if x["kind"] == 0]
    assert len(items) == 45 and sum(len(x["body"]) > 0 for x in items) == 10


def test_near_duplicates_parts_groups_of_long_texts(spark, monkeypatch):
    """Texts of more words than a short sketch has bits, which share passages but don't link, aren't compared tile by tile."""
    import corpus_pipeline

    monkeypatch.setattr(ngram_join, "TILE", 7)
    monkeypatch.setattr(ngram_join, "_tiled", lambda *_: pytest.fail("compared tile by tile"))
    r = random.Random(5)
    shared = [" ".join(f"s{k}_{x}" for x in range(50)) for k in range(90)]
    rows = [(i, " ".join(f"{p} u{i}" for p in r.sample(shared, 30))) for i in range(30)]
    rows += [(100 + i, f"{rows[i][1]} more") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes_by_brute_force(rows)
    assert sum(n > 0 for _, n in want.values()) == 6
    assert {x.doc_id: (x.class_id, x.n_links) for x in ngram_jaccard_join(df).collect()} == want
    assert {x.doc_id for x in corpus_pipeline.near_duplicates(spark, df, "").collect()} == set(range(30))


@pytest.mark.parametrize("crowd", [20_000_000, 30])
def test_sketches_lose_no_pair(monkeypatch, crowd):
    """Sets that reach the threshold and share a key stay together; many that don't are parted."""
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(ngram_join, "AT_ONCE", 7)
    r = np.random.default_rng(crowd)
    bases = [r.integers(0, 1 << 62, size=k).astype(np.uint64) for k in (12, 30, 300, 3000)]
    sets = [np.unique(np.concatenate([b[r.random(len(b)) < r.choice([0.6, 0.8, 0.95])], r.integers(0, 1 << 62, size=3).astype(np.uint64)])) for b in bases for _ in range(25)]
    size = np.array([len(x) + r.integers(0, 3) for x in sets])
    keys, at = r.integers(0, 6, size=400).astype(np.uint64), r.integers(0, 100, size=400)
    bits = np.stack([ngram_join.sketch(x) for x in sets]).view(np.uint64)
    label = ngram_join.similar_groups(keys, at, size, np.array([len(x) for x in sets]), bits, 0.5)
    for i, j in itertools.combinations(range(100), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if both >= 0.5 * (size[i] + size[j] - both) and set(keys[at == i]) & set(keys[at == j]):
            assert label[i] == label[j]
    assert crowd < 100 or len(np.unique(label)) >= 4


def test_signatures_are_complete():
    """Sets that reach the threshold share a signature, whatever the classes."""
    r = np.random.default_rng(0)
    for _ in range(300):
        t = float(r.choice([0.5, 0.7, 0.9]))
        n = int(r.integers(2, 60))
        universe = np.arange(200, dtype=np.uint64)
        df = np.sort(r.integers(2, 3000, 200))
        x = r.choice(200, n, replace=False)
        y = x.copy()
        y[: int(r.integers(0, max(1, n // 3)))] = r.choice(np.setdiff1d(np.arange(200), x), 1)[0]
        y = np.unique(y)
        if len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= t and len(y) > 1 and set(x) != set(y):
            with np.errstate(over="ignore"):
                a, b = (signatures(universe[np.sort(s)], df[np.sort(s)], len(s), t, (500, 1500)) for s in (x, y))
            assert len(np.intersect1d(a, b))


def test_fm_index():
    r = np.random.default_rng(0)
    for _ in range(15):
        text = [r.integers(1, 4, int(r.integers(1, 20))) for _ in range(int(r.integers(1, 6)))]
        n, w = np.array([len(p) for p in text]), r.integers(1, 3, len(text))
        symbols, ends = np.concatenate(text), np.cumsum(n)
        own = np.arange(len(symbols)) + np.repeat(np.arange(len(n)), n)
        got = {int(a): int(q) for a, q, _ in zip(*FMIndex(symbols, n, w).matches(symbols, ends - n, ends, 2, 2, own))}
        want = {}
        for i, p in enumerate(text):
            for a in range(len(p)):
                best = max((k for k in range(1, len(p) - a + 1) if sum(w[j] * sum((q[x : x + k] == p[a : a + k]).all() for x in range(len(q) - k + 1)) for j, q in enumerate(text)) >= 2), default=0)
                if best >= 2:
                    want[int(ends[i] - n[i] + a)] = best
        assert got == want


def test_repeats_are_exact(docs):
    least = 20
    texts = sorted({(i, t) for i, t, *_ in corpus() if i is not None and t is not None})
    seen = {}
    for i, t in texts:
        w = words(t)
        for k in range(len(w) - least + 1):
            seen.setdefault(tuple(w[k : k + least]), []).append((i, k))
    want = set()
    for i, t in texts:
        w = words(t)
        for earlier in (False, True):
            on = [False] * len(w)
            for k in range(len(w) - least + 1):
                places = seen[tuple(w[k : k + least])]
                if len(places) > 1 and (not earlier or min(places) < (i, k)):
                    on[k : k + least] = [True] * least
            for flag, run in itertools.groupby(range(len(w)), key=lambda k: on[k]):
                run = list(run)
                if flag:
                    want.add((i, earlier, run[0], run[-1] + 1))
    assert {(r.doc_id, r.earlier, r.start_word, r.end_word) for r in repeated_spans(docs, least).collect()} == want
    left = remove_repeats(docs, least)
    assert left.columns == docs.columns
    assert repeated_spans(left.where("doc_id <> 7"), least).where("earlier").count() == 0
    assert left.where("doc_id = 902 and text is null").count() == 1 and left.where("doc_id = 900").count() == 0


def test_packing_costs_least(docs):
    r = random.Random(3)
    for _ in range(60):
        size, kind = np.array([r.randint(1, 5) for _ in range(8)]), np.array([r.choice([0, 1, 2]) for _ in range(8)])
        cost = lambda cuts: sum(6 - int(size[a:b].sum()) + (0, 2, 5)[kind[b - 1]] if size[a:b].sum() <= 6 else 10**6 for a, b in zip([0, *cuts], cuts))
        best = min(cost([*c, 8]) for k in range(8) for c in itertools.combinations(range(1, 8), k))
        assert cost(best_cuts(size, kind, 6, (0, 2, 5))) == best
    windows = sorted(pack_documents(docs, 32).collect(), key=lambda w: (w.shard, w.window))
    assert all(w.n_tokens + w.n_padding == 32 for w in windows)
    assert sum(w.n_tokens for w in windows) == sum(len(words(t)) for _, t, *_ in corpus())
    order = [i for w in windows for i in w.doc_ids if i is not None]
    assert order == sorted(order)
    mine = [x for w in windows for x in zip(w.doc_ids, w.starts, w.stops) if x[0] == 0]
    assert mine[0][1] == 0 and all(a[2] == b[1] for a, b in zip(mine, mine[1:]))


def test_packed_documents_cost_least(spark):
    """All windows of a table against a plain search over sentences found by another way."""
    r = random.Random(12)
    cap, soft, hard = 16, 3.0, 9.0
    sentence = lambda: " ".join(r.choices(["alpha", "be", "Gamma", "d9"], k=r.choice([1, 3, 5, 7, 40]))) + r.choice([". ", "! ", "?\n", "\n", " - "])
    rows = [(i, "".join(sentence() for _ in range(r.randint(0, 6)))) for i in range(25)] + [(None, "first of all. yes"), (30, None), (7, "again. again"), (7, "again. again")]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), cap, soft, hard).collect()
    cost = sum(w.n_padding + {"document": 0, "sentence": soft, "hard": hard}[w.cut] for w in got if w.shard >= 0)
    units = []
    for _, t in sorted((x for x in rows if x[0] is not None and x[1]), key=lambda x: x):
        parts = [len(words(p)) for p in re.split(r"(?<=[.!?])(?=\s)|\n", t)]
        parts = [n for n in parts if n]
        for k, n in enumerate(parts):
            while n > cap:
                units.append((cap, hard))
                n -= cap
            units.append((n, 0 if k == len(parts) - 1 else soft))
    best = [0.0]
    for j in range(1, len(units) + 1):
        best.append(min(best[i] + cap - sum(n for n, _ in units[i:j]) + units[j - 1][1] for i in range(j) if sum(n for n, _ in units[i:j]) <= cap))
    assert cost == best[-1] and sum(w.n_tokens for w in got if w.shard >= 0) == sum(n for n, _ in units)


def test_mixing(docs):
    out = mix_sources(docs, weights={"s0": 1, "s1": 3}, rows=8)
    assert set(out.columns) == set(docs.columns) and {r.source for r in out.select("source").distinct().collect()} == {"s0", "s1"}
    total = sum(len(t or "") for _, t, *_ in corpus())
    for s, share in (("s0", 0.25), ("s1", 0.75)):
        mine = [t for i, t, _, so, *_ in corpus() if so == s]
        each = share * total / sum(len(t or "") for t in mine)
        counts = {(r.doc_id): r["count"] for r in out.where(F.col("source") == s).groupBy("doc_id").count().collect()}
        assert abs(sum(counts.values()) - each * len(mine)) <= 1
        single = [i for i, t, _, so, *_ in corpus() if so == s and i not in (None, 7)]
        assert all(abs(counts.get(i, 0) - each) < 1 for i in single)


def test_toxicity(spark):
    r = random.Random(5)
    plain = ["".join(r.choices(["th", "on", "er", "an", "ing", "re"], k=3)) for _ in range(300)]
    bad = ["scumbag", "vermin", "wretch"]
    text = lambda toxic: " ".join(r.choices(plain, k=60) + (r.sample(bad, 2) if toxic else []))
    rows = [(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(240)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (1000, ""), (1001, "é 中 !")], "doc_id long, text string")
    model = fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows if i < 160] + [(None, 1), (3, None)], "doc_id long, toxic int"))
    got = {x.doc_id: x.toxic for x in score_toxicity(docs, model).collect()}
    held = [(got[i], bool(y)) for i, _, y in rows if i >= 160]
    assert np.mean([a == b for a, b in held]) > 0.95 and not got[None] and not got[1000]
    assert train([], [b"a"]).threshold > 1000


def test_toxicity_threshold():
    r = np.random.default_rng(3)
    for _ in range(50):
        toxic, ordinary = r.integers(0, 30, int(r.integers(1, 40))), r.integers(0, 20, int(r.integers(1, 400)))
        got, share = toxicity.threshold(toxic, ordinary, 0.1, 0.02), 0.1
        worth = {}
        for t in range(1, 40):
            caught, alarms = (toxic >= t).mean(), (ordinary >= t).mean()
            if alarms <= 0.02 and caught:
                precision = share * caught / (share * caught + (1 - share) * alarms)
                worth[t] = 2 * precision * caught / (precision + caught)
        if worth:
            assert got in worth and worth[got] > max(worth.values()) - 1e-9 and (ordinary >= got).mean() <= 0.02
        else:
            assert got > 1000


def test_toxicity_windows(monkeypatch):
    """The best window of each text, against all windows one by one."""
    gain = lambda h: (h % np.uint64(7)).astype(np.int64) * (h % np.uint64(5) == 0)
    monkeypatch.setattr(toxicity.Scorer, "gains", lambda self, buf, s, e, h: gain(h))
    texts = [t for _, t, *_ in corpus()] + ["one two " * 300, "x" * 5000]
    score, word = toxicity.Scorer(b"", b"").rows(pa.array(texts, pa.string()))
    for t, got, best in zip(texts, score, word):
        buf, offs = buffers(pa.array([t], pa.string()))
        g = gain(textkernel.words(buf, offs)[3]).tolist()
        assert got == max((sum(g[max(0, k - toxicity.WINDOW + 1) : k + 1]) for k in range(len(g))), default=0)
        assert (best is None) == (max(g, default=0) == 0) and (best is None or best.lower() == words(t)[g.index(max(g))])


@pytest.mark.parametrize("sf, caught, alarms", [("sf0.01", 0.5, 0.03), ("check_s", 0.95, 0.02)])
def test_toxicity_on_held_out_labels(spark, sf, caught, alarms):
    """What the flag catches, and which ordinary documents it flags, among labels that training didn't see."""
    folder = f"/root/testdata/{sf}"
    if not os.path.exists(folder):
        pytest.skip("no tables")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = fit(docs, labels.where("doc_id % 3 > 0"), 400, 800)
    held = docs.join(labels.where("doc_id % 3 = 0"), "doc_id").withColumnRenamed("toxic", "is_toxic")
    rows = score_toxicity(held, model).groupBy("is_toxic").agg(F.avg(F.col("toxic").cast("double")).alias("share")).collect()
    share = {r.is_toxic: r.share for r in rows}
    assert share[1] >= caught and share[0] <= alarms


def test_toxicity_edges(spark):
    """Clashing names are replaced, rows of one id score alike, long texts are read to their end; without labels nothing is toxic."""
    model = toxicity.Model(*toxicity.train_dictionaries([b"grumbleword here " * 3] * 30, [b"other talk goes on %d" % k for k in range(60)]), 5)
    rows = [(1, "a grumbleword", "x", 7), (1, "a grumbleword", "x", 7), (2, "calm talk " * 200_000 + "grumbleword", None, None), (3, None, "x", 1), (None, "", "x", 1)]
    out = score_toxicity(spark.createDataFrame(rows, "doc_id long, text string, Toxic_Score string, toxic int"), model)
    assert out.columns == ["doc_id", "text", "toxic_score", "toxic_word", "toxic"]
    got = out.collect()
    assert [x.toxic for x in got] == [True, True, True, False, False] and got[0] == got[1] and got[2].toxic_word == "grumbleword"
    assert score_toxicity(out.limit(0), model).count() == 0
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string, toxic int")
    none = fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert score_toxicity(docs, none).where("toxic").count() == 0 and fit(docs.limit(0), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")).threshold > 1000


def test_language(spark):
    r = random.Random(2)
    a, b = (["".join(r.choices(s, k=r.randint(3, 7))) for _ in range(200)] for s in ("abcde", "uvxyz"))
    rows = [(i, " ".join(r.choices(a if i % 2 else b, k=40)), "aa" if i % 2 else "bb") for i in range(80)]
    mixed = " ".join(a[:30] + ["12"] + b[:30]) + " привет мир"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    test = spark.createDataFrame([(1, mixed), (2, None), (None, "..")], "doc_id long, text string")
    out = language_id.language_spans(test, model).orderBy("doc_id", "span").collect()
    assert [(x.doc_id, x.lang) for x in out] == [(None, "und"), (1, "aa"), (1, "bb"), (1, "und-Cyrl"), (2, "und")]
    assert abs(out[1].n_words - 30) <= 1 and out[3].n_words == 2


def test_quality_rules(spark):
    rows = [(i, ("word here. " * 20) if i % 2 else ("a|b|c " * 30), i % 2) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(500, None)], "doc_id long, text string")
    rules = quality_rules.fit(docs, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int"))
    assert rules
    got = {x.doc_id: x.keep for x in quality_rules.apply_rules(docs, rules).collect()}
    assert all(got[i] == bool(q) for i, _, q in rows)
    assert quality_rules.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")) == []


def test_language_path_is_the_best():
    """Every labelling of short texts, scored one by one."""
    r = np.random.default_rng(7)
    for _ in range(40):
        length = r.integers(0, 6, 4)
        x = r.standard_normal((int(length.sum()), 3)).astype(np.float32) * 4
        path = language_id._viterbi(x, length, 2.5)
        at = 0
        for n in length.tolist():
            worth = lambda p: sum(float(x[at + k, v]) for k, v in enumerate(p)) - 2.5 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
            assert n == 0 or abs(worth(path[at : at + n].tolist()) - max(worth(p) for p in itertools.product(range(3), repeat=n))) < 1e-4
            at += n


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.exists(sf):
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1 and n_chars > 100")
    spans = language_id.language_spans(held, model).groupBy("doc_id", "lang").agg(F.sum("n_words").alias("n"))
    main = spans.groupBy("doc_id").agg(F.max_by("lang", "n").alias("found"))
    assert held.join(main, "doc_id").agg(F.avg((F.col("lang") == F.col("found")).cast("double"))).first()[0] > 0.97
    # halves of two languages: the switch is found within a few words
    a, b = (held.where(F.col("lang") == x).orderBy("doc_id").select("text").limit(20).collect() for x in ("en", "fr"))
    mixed = [(i, " ".join(words(x.text)[:30] + words(y.text)[:30])) for i, (x, y) in enumerate(zip(a, b)) if len(words(x.text)) >= 30 <= len(words(y.text))]
    found = language_id.language_spans(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect()
    ends = {x.doc_id: x.end_word for x in found if x.span == 0}
    assert len(mixed) > 5 and np.mean([abs(v - 30) <= 3 for v in ends.values()]) > 0.8


def test_rules_by_another_evaluator(spark):
    """Statistics and decisions of a real table, computed from the text in Python."""
    sf = "/root/testdata/sf0.01"
    if not os.path.exists(sf):
        pytest.skip("no tables")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality_rules.fit(docs, labels)
    assert rules
    count = lambda t, chars: sum(c in chars for c in t)

    def statistics(t):
        n, w = max(1, len(t)), count(t, " \n\t") + bool(t)
        share = lambda chars: round(count(t, chars) / n, 4)
        lines = t.split("\n")
        return {"chars": len(t), "word_length": round(n / max(1, w), 4), "upper": share(quality_rules._UPPER), "digits": share("0123456789"), "symbols": share(quality_rules._SYMBOLS), "pipes": share("|"), "exclamations": share("!?"), "stops": share(".,;:"), "distinct_lines": round(len(set(lines)) / len(lines), 4)}

    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "| | " * 100_000)], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(extra).withColumns({"q_chars": F.lit("x"), "Rule": F.lit(7)})
    out = quality_rules.apply_rules(table, rules)
    assert out.columns == ["doc_id", "text", "q_chars", "rule", "reason", "keep"]
    for x in out.collect():
        s = statistics(x.text or "")
        hit = next((k for k, r in enumerate(rules, 1) if all(s[c] <= v if most else s[c] >= v for c, most, v in r.conditions)), 0)
        assert x.rule == hit and x.keep == (hit == 0) and (x.reason is None) == (hit == 0)


def test_best_condition_by_enumeration():
    r = np.random.default_rng(2)
    for _ in range(30):
        x = {"a": r.integers(0, 6, 30).astype(float), "b": r.integers(0, 4, 30).astype(float)}
        bad = (x["a"] > 3) ^ (r.random(30) < 0.2)
        gain, (name, most, at) = quality_rules._best_condition(x, bad)
        worth = {}
        for s, v in x.items():
            for t in np.unique(v):
                for le in (True, False):
                    inside = v <= t if le else v >= t
                    if 0 < inside.sum() < 30:
                        worth[s, le, t] = float(quality_rules._gain(float(bad.sum()), float((~bad).sum()), np.array([(bad & inside).sum()], float), np.array([(~bad & inside).sum()], float))[0])
        assert abs(max([0.0, *worth.values()]) - gain) < 1e-6 and (gain == 0 or abs(worth[name, most, at] - gain) < 1e-6)


def test_loser_tree():
    r = random.Random(0)
    for k in range(7):
        runs = [sorted((r.randint(0, 9), r.randint(0, 9)) for _ in range(r.randint(0, 6))) for _ in range(k)]
        assert list(LoserTree(runs)) == sorted(itertools.chain(*runs))


def test_captures(spark):
    rows = [(1, "http://www.Example.com:80/a/?b=2&a=1&utm_x=1#f", "x"), (2, "https://example.com/a?a=1&b=2", "x"), (3, "http://example.com/a?a=1&b=2", "y"), (4, None, "z"), (5, "http://b.example.com", None), (5, "http://b.example.com", None)]
    out = capture_index(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("position").collect()
    assert [(x.page_id, x.urlkey, x.capture, x.revisit) for x in out] == [
        (1, "com,example)/a?a=1&b=2", 1, False), (2, "com,example)/a?a=1&b=2", 2, True), (3, "com,example)/a?a=1&b=2", 3, False), (5, "com,example,b)/", 1, False), (5, "com,example,b)/", 2, True)
    ]


def vector_classes(x, t=0.9):
    """(class, links) of each row of x: every pair compared, links followed."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= t
    np.fill_diagonal(linked, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        low = np.minimum(root, np.where(linked, root[None, :], len(x)).min(axis=1))
        if (low == root).all():
            break
        root = low
    return list(zip(root.tolist(), linked.sum(axis=1).tolist()))


def test_captures_of_a_hot_key(spark, monkeypatch):
    """A key with a third of all captures goes over many ranges; repeated rows and equal times are ties."""
    monkeypatch.setattr(warc, "RANGE_ROWS", 15)
    r = random.Random(4)
    rows = [(i, "http://hot.com/a" if i % 3 == 0 else f"http://s{r.randrange(6)}.com/", r.choice("xy"), r.randrange(40)) for i in range(240)]
    rows += [rows[3], (400, "http://long.com/" + "p" * 5000, "h" * 300_000, 1), (401, "  ", "x", 1)]
    out = capture_index(spark.createDataFrame(rows, "page_id long, url string, html string, part long").repartition(5), ts=F.col("part")).orderBy("position").collect()
    key = lambda u: (u.split("/")[2].split(".")[1] + "," + u.split("/")[2].split(".")[0]) + ")/" + u.split("/", 3)[3].rstrip("/")
    want = sorted((key(u), t, i, u, h) for i, u, h, t in rows if u.strip())
    assert [(x.urlkey, x.ts, x.page_id) for x in out] == [w[:3] for w in want] and [x.position for x in out] == list(range(len(want)))
    seen, last = {}, {}
    for x, w in zip(out, want):
        seen[w[0]] = seen.get(w[0], 0) + 1
        assert x.capture == seen[w[0]] and x.revisit == (last.get(w[0]) == x.digest)
        last[w[0]] = x.digest
    assert capture_index(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_nn_descent(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((500, 24)).astype(np.float32)
    for i in range(60):
        x[100 + i] = x[i % 3] + 0.02 * r.standard_normal(24)
    x[300:340] = x[340:380] + 0.05 * r.standard_normal((40, 24))
    x[400:470] = x[399]  # equal vectors
    want = vector_classes(x.astype(np.float64))
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(3, x[3].tolist(), "y"), (None, [1.0] * 24, "x"), (1000, None, "x"), (1001, [0.0] * 24, None), (1002, [float("nan")] * 24, "x"), (1003, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, class_id string").repartition(3)
    got = {e.vec_id: (e.class_id, e.n_links) for e in near_duplicate_classes(df).collect()}
    assert got == dict(enumerate(want)) | {i: (i, 0) for i in range(1000, 1004)} and sum(n for _, n in want) > 5000
    assert near_duplicate_classes(df.limit(0)).count() == 0 and near_duplicate_classes(df.where("vec_id = 1")).collect() == [(1, 1, 0)]
    with pytest.raises(ValueError):
        near_duplicate_classes(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>"))


def test_nn_descent_large_groups(spark):
    """Two groups larger than any list whose members are nearer to their own than to the others, and one with a third of all rows."""
    r = np.random.default_rng(6)

    def around(centre, n):  # cosine of about 0.99 to each other
        return centre + 0.1 * np.linalg.norm(centre) / np.sqrt(len(centre)) * r.standard_normal((n, len(centre)))

    a, b, c = (v / np.linalg.norm(v) for v in r.standard_normal((3, 32)))
    b -= (a @ b) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b)
    x = np.concatenate([around(a, 120), around(b, 120), around(c, 300), r.standard_normal((300, 32))]).astype(np.float32)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = unit @ unit.T
    across = sim[:120, 120:240]
    assert 0.9 < np.median(across) and np.max(across) < np.min(sim[:120, :120]) and np.min(sim[:120, :120]) > 0.97
    got = {e.vec_id: (e.class_id, e.n_links) for e in near_duplicate_classes(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), audit=50).collect()}
    low, high = (vector_classes(x.astype(np.float64), t) for t in (0.9 + 1e-6, 0.9 - 1e-6))
    assert all(low[i][1] <= got[i][1] <= high[i][1] and got[i][0] in (low[i][0], high[i][0]) for i in range(len(x)))


def test_nn_descent_audit(spark, monkeypatch):
    """A search that finds nothing doesn't pass its audit, even where no two vectors are near."""
    monkeypatch.setattr(nn_descent, "_search", lambda codes, *_: codes.sparkSession.createDataFrame([], "kind int, a long, b long"))
    x = np.random.default_rng(1).standard_normal((50, 16))
    with pytest.raises(RuntimeError, match="recall"):
        near_duplicate_classes(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"))


def test_chat(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "ann", "hi <|x|>"), (1, 2, "bob b", None), (1, 3, "ann", "yo"), (None, 1, "a", "b"), (2, None, "system", "s")]
    out = {x.speaker: x for x in rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(out) == {"ann", "bob b"}
    a = out["ann"]
    assert a.text == "<|system|>\nbe<|end|>\n<|assistant|>\nhi < |x|><|end|>\n<|user name=bob_b|>\n<|end|>\n<|assistant|>\nyo<|end|>\n"
    assert [a.text[s:e] for s, e in a.mask] == ["hi < |x|><|end|>\n", "yo<|end|>\n"]


def test_chat_by_hand(spark):
    """Longer conversations with ties, repeated rows and a long text, rendered turn by turn."""
    r = random.Random(3)
    rows = [(c, r.choice([None, *range(6)]), r.choice(["ann", "bob", "c d", "system", "", None]), r.choice(["x", "yy <|", None, "z" * 9])) for c in range(8) for _ in range(25)]
    rows += [rows[0], (9, 0, "ann", "long " * 100_000)]
    got = {(x.conv_id, x.speaker): x for x in rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("start", F.lit(1))).collect()}
    names = 0
    for c in range(10):
        said = sorted((-(1 << 63) if t is None else t, x or "unknown", (y or "").replace("<|", "< |")) for k, t, x, y in rows if k == c)
        for who in {x for _, x, _ in said} - {"system"}:
            text, mask = "", []
            for _, x, y in said:
                text += "<|system|>\n" if x == "system" else "<|assistant|>\n" if x == who else f"<|user name={re.sub('[^0-9A-Za-z_-]', '_', x)}|>\n"
                at = len(text)
                text += y + "<|end|>\n"
                mask += [[at, len(text)]] if x == who else []
            assert (got[c, who].text, got[c, who].mask, got[c, who].n_turns, got[c, who].n_learned) == (text, mask, len(said), len(mask))
            names += 1
    assert len(got) == names
    assert rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x.node: x.component for x in components(spark.createDataFrame(edges + [(None, 1)], "a long, b long")).collect()}
    assert got == label


def test_anchors_in_blocks():
    r = np.random.default_rng(1)
    for n in (5, 60, 700):
        h, d = r.integers(0, 30, n).astype(np.uint64), np.sort(r.integers(0, 3, n))
        whole, parts = substring_dedup._anchors(d, h, 20), substring_dedup._anchors(d, h, 20, most=50)
        assert all((a == b).all() for a, b in zip(whole, parts))


def test_very_long_texts(spark):
    """A text of some megabytes beside short ones, in every operator on texts."""
    r = random.Random(1)
    long = " ".join(r.choices([f"w{k}" for k in range(5000)], k=400_000))
    rows = [(1, long, "en", "a", len(long)), (2, "short words here", "en", "a", 16), (3, long[: len(long) // 2].rsplit(" ", 1)[0], "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    half = len(words(rows[2][1]))
    spans = {(x.doc_id, x.earlier): (x.start_word, x.end_word) for x in repeated_spans(docs).collect()}
    assert spans == {(1, False): (0, half), (3, False): (0, half), (3, True): (0, half)}
    assert {x.doc_id: x.n_links for x in ngram_jaccard_join(docs, threshold=0.4).collect()} == {1: 1, 2: 0, 3: 1}
    assert sum(w.n_tokens for w in pack_documents(docs).collect()) == 400_003 + half
    assert {x.doc_id: x.n_words for x in language_id.language_spans(docs, language_id.fit(docs)).collect()} == {1: 400_000, 2: 3, 3: half}
    assert mix_sources(docs, alpha=1.0).count() == 3


def test_columns_of_other_names(spark, docs):
    """Extra columns named like those the operators use come through unharmed."""
    clash = docs.withColumns({c: F.col("doc_id").cast("string") for c in ("r_id", "r_spans", "m_source", "m_range", "part", "kind", "id", "n_id", "body", "shard")})
    assert {tuple(x) for x in ngram_jaccard_join(clash).collect()} == {tuple(x) for x in ngram_jaccard_join(docs).collect()}
    cut, plain = remove_repeats(clash, 20), remove_repeats(docs, 20)
    assert cut.columns == clash.columns and sorted(map(str, cut.select(docs.columns).collect())) == sorted(map(str, plain.collect()))
    assert all(x.r_id == (None if x.doc_id is None else str(x.doc_id)) for x in cut.collect())
    assert mix_sources(clash, rows=8).columns == [c for c in clash.columns if c != "copy"] + ["copy"]
    assert pack_documents(clash).count() == pack_documents(docs).count()


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for df in (ngram_jaccard_join(none), repeated_spans(none), remove_repeats(none), pack_documents(none), mix_sources(none), language_id.language_spans(none, language_id.fit(none)), quality_rules.apply_rules(none, [quality_rules.Rule((("chars", True, 5.0),))])):
        assert df.count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.exists(sf):
        pytest.skip("no tables")
    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    near = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, sf)
    gone = {r.doc_id for r in ngram_jaccard_join(docs).collect() if r.class_id != r.doc_id}
    assert near.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in near.collect()} == gone
    assert corpus_pipeline.run(spark, sf).count() > 0
