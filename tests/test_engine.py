import hashlib
import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylight import queries
from quarrylight.functions import vector as V
from quarrylight.model import check_metadata, complete, decode_cursor, encode_cursor, split_citation
from quarrylight.operators import ranking, text
from quarrylight.operators.evaluation import evaluate, regressions
from quarrylight.operators.text import QueryError, TextIndex, keyword_search, parse_query
from quarrylight.operators.vectors import ClusterIndex, CompressedIndex, knn, knn_batch, two_stage
from quarrylight.plans.engine import SearchEngine
from quarrylight.plans.filters import compile_filter, targets_image, visible
from quarrylight.plans.request import Caller, SearchRequest
from quarrylight.sources import changes, ingest
from quarrylight.sources.store import ChunkStore
from quarrylight.streaming import cdc, pgoutput
from quarrylight.streaming.service import take_token

SCHEMA = "collection string, doc_id string, chunk_id long, kind string, text string, page int, section_id long, heading_path array<string>, tenant string, acl array<string>, searchable boolean, embedding array<float>"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        ("kb", "a", 1, "paragraph", "red fox jumps over the lazy dog", 1, 1, ["animals"], None, ["public"], True, [1.0, 0.0]),
        ("kb", "a", 2, "paragraph", "a red dog sleeps", 2, 1, ["animals", "dogs"], "acme", ["public"], True, [0.8, 0.6]),
        ("kb", "b", 1, "image", "workshop of workers", 3, 0, [], "acme", ["team"], True, [0.0, 1.0]),
        ("kb", "c", 1, "table", "", None, 0, None, "globex", ["public"], True, None),
        ("kb", "d", 1, "code", "red hidden", 1, 0, [], None, ["public"], False, [1.0, 0.0]),
    ]
    return complete(spark.createDataFrame(rows, SCHEMA)).cache()


def ids(df):
    return sorted((r["doc_id"], r["chunk_id"]) for r in df.select("doc_id", "chunk_id").collect())


LEAVES = [
    ({"eq": ["page", 1]}, lambda r: r["page"] == 1),
    ({"ne": ["page", 1]}, lambda r: r["page"] is not None and r["page"] != 1),
    ({"gt": ["page", 1]}, lambda r: r["page"] is not None and r["page"] > 1),
    ({"lte": ["page", 2]}, lambda r: r["page"] is not None and r["page"] <= 2),
    ({"in": ["tenant", ["acme", 3]]}, lambda r: r["tenant"] == "acme"),
    ({"in": ["tenant", []]}, lambda r: False),
    ({"exists": "tenant"}, lambda r: r["tenant"] is not None),
    ({"gt": ["tenant", 3]}, lambda r: False),
    ({"eq": ["colour", 3]}, lambda r: False),
    ({"and": []}, lambda r: True),
    ({"or": []}, lambda r: False),
    ({"heading_prefix": ["animals"]}, lambda r: (r["heading_path"] or [])[:1] == ["animals"]),
    ({"heading_prefix": []}, lambda r: True),
]


@pytest.mark.parametrize("negated", [False, True])
def test_filters_have_two_values(chunks, negated):
    rows = chunks.collect()
    flags = chunks.select("doc_id", "chunk_id", *[compile_filter({"not": t} if negated else t).alias(f"f{i}") for i, (t, _) in enumerate(LEAVES)]).collect()
    for row, got in zip(rows, flags):
        for i, (tree, want) in enumerate(LEAVES):
            assert bool(got[f"f{i}"]) == (bool(want(row)) != negated), (tree, row)


def test_filter_pushes_down(spark, tmp_path):
    spark.range(10).selectExpr("id as page", "'x' as kind").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where(compile_filter({"not": {"gt": ["page", 3]}}))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Or(IsNull(page),LessThanOrEqual(page,3))" in plan


def test_access(chunks):
    assert ids(chunks.where(visible("acme"))) == [("a", 2)]
    assert ids(chunks.where(visible("acme", ("team",)))) == [("a", 2), ("b", 1)]
    assert ids(chunks.where(visible(None))) == [("a", 1), ("a", 2), ("c", 1), ("d", 1)]
    assert targets_image({"or": [{"eq": ["modality", "image"]}]}) and not targets_image({"not": {"eq": ["modality", "image"]}})


@pytest.mark.parametrize(
    "query,want",
    [
        ("red", [("a", 1), ("a", 2)]),
        ("red -lazy", [("a", 2)]),
        ("red AND lazy", [("a", 1)]),
        ("+dog fox", [("a", 1), ("a", 2)]),
        ('"lazy dog"', [("a", 1)]),
        ('"red dog"~4', [("a", 2)]),
        ('"red jumps"~1', [("a", 1)]),
        ("nothing wor*", [("b", 1)]),
        ("heading:dogs", [("a", 2)]),
        ("(fox OR sleeps) AND red", [("a", 1), ("a", 2)]),
        ("  ", [("a", 1), ("a", 2), ("b", 1), ("c", 1)]),
        ("!!!", []),
    ],
)
def test_keyword_queries(chunks, query, want):
    assert ids(keyword_search(chunks, query)) == want


QUERIES = ["red", "red -lazy", "red AND lazy", "+dog fox", '"lazy dog"', '"red dog"~4', '"red jumps"~1', "nothing wor*", "heading:dogs", "(fox OR sleeps) AND red", "  ", "!!!", "-red", "-red OR sleeps", '"a red" -"dog dog"', "NOT wor*", "dog dog lazy"]


def test_index_searches_as_the_scan(spark, chunks, tmp_path):
    """Every kind of query gives the rows and scores of the scan, from the saved index."""
    engine = SearchEngine.create(chunks, str(tmp_path / "e"), clusters=2)
    for query in QUERIES:
        scores = lambda df: {(r["doc_id"], r["chunk_id"]): round(r["bm25"], 9) for r in df.collect()}
        assert scores(engine.text.keyword(engine.chunks.drop(*engine.WIDE), query)) == scores(keyword_search(chunks, query)), query
    where = compile_filter({"eq": ["page", 2]})
    assert ids(engine.text.keyword(engine.chunks, "red", where)) == [("a", 2)]
    request = SearchRequest(query="red dog", vector=[1.0, 0.2], candidates=10, top_k=5, include_text=True)
    pick = lambda df: [(r["citation_id"], round(r["score"], 9), r["text"]) for r in df.collect()]
    assert pick(engine.search(request, Caller("acme", ("team",)))) == pick(SearchEngine(chunks).search(request, Caller("acme", ("team",))))
    again = SearchEngine.rebuild(spark, str(tmp_path / "e"), clusters=1)
    assert pick(again.search(request)) == pick(SearchEngine(chunks).search(request))


def test_index_reads_its_own_words_only(spark, chunks, tmp_path):
    TextIndex.build(chunks).save(str(tmp_path / "t"), 4)
    hits = TextIndex.load(spark, str(tmp_path / "t")).keyword(chunks.drop("text"), "red workers")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [red,workers])" in plan.split("PushedFilters:", 1)[1] and "positions" not in plan.split("ReadSchema: struct<term")[1].split(">")[0]
    ClusterIndex.build(chunks, 2).save(str(tmp_path / "v"))
    index = ClusterIndex.load(spark, str(tmp_path / "v"))
    index.n = 10**6
    plan = index.search([1.0, 0.0], 1, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cluster" in plan.split("PartitionFilters:")[1].split("]")[0]


def _shuffled(df):
    """Exchanges of a plan, those of a join's small side or of counts included."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_postings_in_runs(spark, tmp_path, monkeypatch):
    """Postings are made without a shuffle, whatever the runs; rows that share an identifier are one chunk."""
    words = ["red", "fox", "dog", "Hund", "große", "市场", "x1", "\U0001f600", "é"]
    r = np.random.default_rng(4)
    docs = [("kb", f"d{i // 3}", i, " ".join(r.choice(words, r.integers(0, 40))), ["Top", str(r.choice(words))]) for i in range(120)]
    schema = "collection string, doc_id string, chunk_id long, text string, heading_path array<string>"

    def want(rows):
        out = {}
        for c, d, i, text, path in rows:
            for field, x in (("text", text), ("heading", " ".join(path))):
                ws = [w for w in x.lower().split() if w != "\U0001f600"]
                for pos, w in enumerate(ws):
                    out.setdefault((w, field, c, d, i), []).append((pos, len(ws)))
        return {k: (len(v), v[0][1], sorted(p for p, _ in v)) for k, v in out.items()}

    got = lambda index: {tuple(p[:5]): tuple(p[5:]) for p in index.postings.collect()}
    rows = complete(spark.createDataFrame(docs, schema).repartition(3))
    index = TextIndex.build(rows)
    assert _shuffled(index.postings) == 0 and got(index) == want(docs)
    twice = docs + [docs[5]]
    assert got(TextIndex.build(complete(spark.createDataFrame(twice, schema)))) == want(twice)
    small = [b for b in text._runs(iter([pa.RecordBatch.from_pylist([{"collection": c, "doc_id": d, "chunk_id": i, "text_tokens": x.split(), "heading_tokens": p} for c, d, i, x, p in docs])]))]
    monkeypatch.setattr(text, "RUN", 50)
    many = [b for b in text._runs(iter([pa.RecordBatch.from_pylist([{"collection": c, "doc_id": d, "chunk_id": i, "text_tokens": x.split(), "heading_tokens": p} for c, d, i, x, p in docs])]))]
    key = lambda batches: sorted(str(p) for b in batches for p in b.to_pylist())
    assert len(many) > len(small) and key(many) == key(small)
    assert all(b["term"].to_pylist() == sorted(b["term"].to_pylist()) for b in many)


def test_index_tokenizer(spark, tmp_path):
    rows = spark.createDataFrame([("kb", "a", 1, "股票市场上涨 today"), ("kb", "b", 1, "市上 股场")], "collection string, doc_id string, chunk_id long, text string")
    TextIndex.build(complete(rows), "cjk_bigram").save(str(tmp_path / "t"), 2)
    index = TextIndex.load(spark, str(tmp_path / "t"))
    assert index.tokenizer == "cjk_bigram"
    assert ids(index.keyword(complete(rows), "市场")) == [("a", 1)] and ids(index.keyword(complete(rows), "票市场")) == [("a", 1)] and ids(index.keyword(complete(rows), "today 市上")) == [("a", 1), ("b", 1)]


def test_cluster_recall(spark):
    """10 or more of 64 clusters find nine in ten of the true neighbours; fewer probes find less, all of them everything."""
    r = np.random.default_rng(5)
    centres = r.standard_normal((40, 32))
    x = (centres[r.integers(0, 40, 3000)] + 1.2 * r.standard_normal((3000, 32))).astype(np.float32)
    rows = spark.createDataFrame([("c", "d", i, True, v.tolist()) for i, v in enumerate(x)], "collection string, doc_id string, chunk_id long, searchable boolean, embedding array<float>").cache()
    index = ClusterIndex.build(rows, 64)
    index.rows = index.rows.cache()
    assert index.n > index.EXACT and len(index.centroids) == 64
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def recall(**kw):
        found = 0
        for i in range(0, 3000, 300):
            truth = set(np.argsort(-(unit @ unit[i]), kind="stable")[:10].tolist())
            found += len(truth & {h["chunk_id"] for h in index.search(x[i].tolist(), 10, **kw).collect()})
        return found / 100

    assert recall() >= 0.9 and recall(probes=1) < recall(probes=64) == 1.0


def test_two_stage_recall(spark):
    r = np.random.default_rng(8)
    x = (r.standard_normal((30, 48))[r.integers(0, 30, 2000)] + 0.6 * r.standard_normal((2000, 48))).astype(np.float32)
    rows = spark.createDataFrame([("c", "d", i, True, v.tolist()) for i, v in enumerate(x)], "collection string, doc_id string, chunk_id long, searchable boolean, embedding array<float>").cache()
    found = sum(len(set(ids(two_stage(rows, x[i].tolist(), 10, 8))) & set(ids(knn(rows, x[i].tolist(), 10)))) for i in range(0, 2000, 400))
    assert found >= 45


def test_knn_batch_in_blocks(spark):
    x = np.random.default_rng(3).standard_normal((90, 8)).astype(np.float32)
    rows = spark.createDataFrame([("c", "d", i, True, v.tolist()) for i, v in enumerate(x)], "collection string, doc_id string, chunk_id long, searchable boolean, embedding array<float>")
    queries_ = rows.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = {}
    for h in knn_batch(rows, queries_, 3, block=20).collect():
        got.setdefault(h["query_id"], set()).add(h["chunk_id"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == {i: set(np.argsort(-(unit @ unit[i]))[:3].tolist()) for i in range(90)}
    assert knn_batch(rows, queries_.limit(0), 3).count() == 0


def test_hash_embedding(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None)], "id long, t array<string>")
    got = {r["id"]: r["e"] for r in rows.select("id", V.hash_embedding(F.col("t"), 8, "q:").alias("e")).collect()}
    want = np.zeros(8)
    for w in "aba":
        d = hashlib.md5(("q:" + w).encode()).hexdigest()
        want[int(d[:8], 16) % 8] += 1 if int(d[8:16], 16) % 2 == 0 else -1
    assert np.allclose(got[1], want / np.linalg.norm(want), atol=1e-6) and got[2] == [0.0] * 8 and got[3] == [0.0] * 8


def test_hash_embedding_of_many_long_texts():
    """A batch of rows is hashed in pieces: tokens don't become Python's strings, of which a batch has millions."""
    rows = pa.array([None, []] + [[f"w{i % 5000}" for i in range(k, k + 2000)] for k in range(1000)])
    embed = V._hashed
    whole = embed(rows, 16, "p:")
    tracemalloc.start()
    assert np.array_equal(np.concatenate([embed(rows.slice(i, 100), 16, "p:") for i in range(0, len(rows), 100)]), whole)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 and not whole[:2].any() and np.allclose((whole[2:] ** 2).sum(axis=1), 1)


def test_hash_embedding_in_pieces(spark):
    rows = spark.createDataFrame([(i, [f"w{j}" for j in range(i % 40)] if i % 9 else None) for i in range(300)], "id long, t array<string>").coalesce(1)
    got = lambda: {r["id"]: r["e"] for r in rows.select("id", V.hash_embedding(F.col("t"), 8).alias("e")).collect()}
    want = got()
    for i in (1, 40, 299):
        x = np.zeros(8)
        for j in range(i % 40 if i % 9 else 0):
            d = hashlib.md5(f"w{j}".encode()).hexdigest()
            x[int(d[:8], 16) % 8] += 1 - 2 * (int(d[8:16], 16) % 2)
        assert np.allclose(want[i], x / (np.linalg.norm(x) or 1), atol=1e-6)


def test_batch_searches_all_words(spark, tmp_path):
    docs = [(1, "one two three", "en", "s", 13), (2, "only nine is here", "en", "s", 17), (3, "something else", "en", "s", 14)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(7, "one two three four five six seven eight nine")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r["citation_id"].rsplit(":", 1)[1] for r in queries.QUERIES["bm25_batch"](spark, str(tmp_path)).collect()}
    assert found == {"1", "2"}


def test_best_of_a_batch_as_all(spark, tmp_path):
    """The best of blocks have the k best of every query, ties too, and far fewer rows than all that matches."""
    r = np.random.default_rng(6)
    words = [f"w{i}" for i in range(30)]
    docs = [("kb", f"d{i}", i % 7, " ".join(r.choice(words, 12, p=np.arange(30, 0, -1) / 465)), [words[i % 3]]) for i in range(300)]
    docs += [("kb", f"e{i}", i, "w0 w1 w2", ["w9"]) for i in range(20)]
    rows = complete(spark.createDataFrame(docs, "collection string, doc_id string, chunk_id long, text string, heading_path array<string>"))
    TextIndex.build(rows).save(str(tmp_path / "t"), 2)
    index = TextIndex.load(spark, str(tmp_path / "t"))
    asked = spark.createDataFrame([(i, " ".join(r.choice(words, 4))) for i in range(9)] + [(9, "w0 w1 w2"), (10, "none"), (11, None)], "query_id long, query string")
    top = lambda df: {(h["query_id"], h["doc_id"], h["chunk_id"], h["key"]) for h in ranking.top(df.withColumn("key", F.round("bm25", 9)), "key", 5, ["query_id"]).collect()}
    every = index.search(asked)
    for options in ({}, {"block": 50, "asked": 4}):
        assert top(index.best(asked, 5, **options)) == top(every)
    assert index.best(asked, 5).count() < every.count() / 4
    silent = {"text_boost": 0.0}
    assert top(index.best(asked, 5, **silent)) == top(index.search(asked, **silent))
    assert index.best(asked.limit(0), 5).count() == 0


def test_query_errors():
    for bad in ("(a", "a)", "a AND", '+"'):
        with pytest.raises(QueryError):
            parse_query(bad)


def test_fusion_by_hand(spark):
    hits = lambda rows, name: spark.createDataFrame([("c", "d", i, s) for i, s in rows], f"collection string, doc_id string, chunk_id long, {name} double")
    out = {r["chunk_id"]: r["score"] for r in ranking.fuse(hits([(1, 10.0), (2, 5.0)], "bm25"), hits([(2, 0.9), (3, 0.8)], "vector")).collect()}
    assert out == pytest.approx({1: 1 / 61, 2: 1 / 62 + 1 / 61, 3: 1 / 62})
    mixed = {r["chunk_id"]: r["score"] for r in ranking.fuse(hits([(1, 7.0)], "bm25"), hits([(2, 0.9), (3, 0.8)], "vector"), "normalized", ratio=0.25).collect()}
    assert mixed == pytest.approx({1: 0.75, 2: 0.25, 3: 0.0})


def test_search_pages_tile(chunks):
    engine = SearchEngine(chunks)
    rows = [r["citation_id"] for p in engine.pages(SearchRequest(query="red dog workers", mode="keyword", top_k=1, candidates=10)) for r in p]
    assert rows == [r["citation_id"] for r in engine.search(SearchRequest(query="red dog workers", mode="keyword")).collect()]
    assert engine.search(SearchRequest(query="red", mode="keyword"), Caller("nobody")).count() == 0
    assert engine.similar("kb:b:1", caller=Caller("globex")).count() == 0
    with pytest.raises(ValueError):
        engine.search(SearchRequest(query="x", top_k=0))


def test_vectors(chunks):
    assert [r["chunk_id"] for r in knn(chunks, [1.0, 0.1], 2).collect()] == [1, 2]
    assert ids(two_stage(chunks, [1.0, 0.1], 2, 100)) == ids(knn(chunks, [1.0, 0.1], 2))
    with pytest.raises(Exception):
        knn(chunks, [1.0, 0.0, 0.0], 2).collect()


def test_quantiser():
    for bits, want in ((2, 0.1175), (3, 0.03454), (4, 0.009497)):
        levels, edges = V.gaussian_codebook(bits)
        x = np.random.default_rng(0).standard_normal(400_000)
        assert np.mean((x - levels[np.searchsorted(edges, x)]) ** 2) == pytest.approx(want, rel=0.02)
    flips = V.rotation(48)
    x = np.random.default_rng(1).standard_normal((5, 48)).astype(np.float32)
    assert np.allclose(V.rotate(x, flips) @ V.rotate(x, flips).T, x @ x.T, atol=1e-3)


def test_compressed_recall(spark):
    x = np.random.default_rng(2).standard_normal((400, 32)).astype(np.float32)
    rows = spark.createDataFrame([("c", "d", i, True, v.tolist()) for i, v in enumerate(x)], "collection string, doc_id string, chunk_id long, searchable boolean, embedding array<float>")
    index = CompressedIndex.build(rows, 32, 4)
    exact = ids(knn(rows, x[3].tolist(), 10))
    assert ids(index.search(x[3].tolist(), 10, chunks=rows)) == exact
    assert len(set(ids(index.search(x[3].tolist(), 10))) & set(exact)) >= 7


def test_identifiers():
    assert split_citation("c:a:b:7") == ("c", "a:b", 7)
    assert [split_citation(x) for x in ("c:7", ":a:7", "c:a:x", "c::7")] == [None] * 4
    assert decode_cursor(encode_cursor(0.125, "c:a:b:7")) == (0.125, ("c", "a:b", 7))
    for bad in ("[]", '{"a":' * 20 + "1" + "}" * 20):
        with pytest.raises(ValueError):
            check_metadata(bad)


def test_evaluation(spark):
    results = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, citation string, rank int")
    judged = spark.createDataFrame([("q", "y", 1.0), ("p", "z", 1.0)], "query_id string, citation string, grade double")
    got = {r["query_id"]: r for r in evaluate(results, judged, 2).collect()}
    assert got["q"]["ndcg"] == pytest.approx(0.6309, abs=1e-4) and got["q"]["mrr"] == 0.5 and got["p"]["ndcg"] == 0
    assert regressions({"ndcg": 0.5, "recall": 1, "mrr": 1, "precision": 1}, {"ndcg": 0.6, "recall": 1, "mrr": 1, "precision": 1}) == ["ndcg"]


def test_changes(spark, chunks, tmp_path):
    gone, told = changes.delete_chunks(chunks, changes.ids_frame(spark, [("kb", "a", 2), ("kb", "b", 1), ("x", "y", 1)]), visible("acme"))
    assert [r["deleted"] for r in told.collect()] == [True, False, False] and ("a", 2) not in ids(gone)
    with pytest.raises(ValueError):
        changes.upsert(chunks, chunks.where("doc_id = 'b'").withColumn("tenant", F.lit("other")))
    with pytest.raises(PermissionError):
        changes.delete_doc(chunks, "kb", "b", visible("acme"))
    store = ChunkStore(spark, str(tmp_path / "s"))
    assert store.write(chunks) == 1 and store.write(store.read().where("doc_id = 'a'")) == 2
    assert ids(store.read()) == [("a", 1), ("a", 2)]
    log = spark.createDataFrame([(5, 0, "upsert", "kb", "z", 1, "new"), (6, 0, "delete_doc", "kb", "a", None, None), (7, 0, "upsert", "kb", "a", 9, "back"), (8, 0, "delete", "kb", "z", 1, None)], "lsn long, seq int, op string, collection string, doc_id string, chunk_id long, text string")
    applier = cdc.Applier(store)
    applier(log, 0)
    assert ids(store.read()) == [("a", 9)] and store.manifest()["applied_lsn"] == 8
    applier(log, 0)
    assert store.manifest()["version"] == 3


def test_store_survives_a_crash(spark, chunks, tmp_path, monkeypatch):
    """Whatever step of a write is the last, a reader sees the old version or the new one."""
    store = ChunkStore(spark, str(tmp_path / "s"))
    store.write(chunks.where("doc_id = 'a'"), applied_lsn=5)
    (tmp_path / "s" / "manifests" / "000000000002.x.new").write_text("{")  # a manifest half written
    assert store.manifest()["version"] == 1 and store.manifest()["applied_lsn"] == 5
    with monkeypatch.context() as m:
        m.setattr(ChunkStore, "_point", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            ChunkStore(spark, store.path).write(chunks, applied_lsn=9)
    assert ids(store.read()) == [("a", 1), ("a", 2)] and store.manifest()["applied_lsn"] == 5
    assert store.write(chunks, applied_lsn=9) == 2 and store.manifest()["applied_lsn"] == 9
    store.write(chunks.limit(1))
    store.vacuum(1)
    assert ids(store.read()) == [("a", 1)] and store.manifest()["version"] == 3 and len(list((tmp_path / "s" / "manifests").glob("*.json"))) == 1


def test_one_lsn_in_several_batches(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    log = spark.createDataFrame([(5, k, "upsert", "kb", "z", k, f"t{k}") for k in range(4)], "lsn long, seq int, op string, collection string, doc_id string, chunk_id long, text string")
    store.write(log.drop("lsn", "seq", "op").limit(0))
    applier = cdc.Applier(store)
    for k, part in enumerate((log.where("seq < 2"), log.where("seq >= 2"), log.where("seq >= 2"))):
        applier(part, k)
    assert ids(store.read()) == [("z", k) for k in range(4)] and store.manifest()["version"] == 3


def test_stream(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    log = spark.createDataFrame([(1, 0, "upsert", "kb", "z", 1, "new")], "lsn long, seq int, op string, collection string, doc_id string, chunk_id long, text string")
    store.write(log.drop("lsn", "seq", "op").limit(0))
    log.write.parquet(str(tmp_path / "log"))
    cdc.run(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")), store, str(tmp_path / "cp")).awaitTermination()
    assert ids(store.read()) == [("z", 1)]


def test_ingest():
    got = list(ingest.chunk_markdown("# A\nx\ny\n\n## B\nz\n# C\n#no"))
    assert [(g[1], g[2], g[4]) for g in got] == [("heading", "A", ["A"]), ("paragraph", "x y", ["A"]), ("heading", "B", ["A", "B"]), ("paragraph", "z", ["A", "B"]), ("heading", "C", ["C"]), ("paragraph", "#no", ["C"])]
    assert [g[2] for g in ingest.chunk_html("<h1>T</h1><script>no</script><p>a <b>b</b></p>")] == ["T", "a b"]
    assert len(list(ingest.pack_paragraphs("a" * 500 + "\n\n" + "b" * 500))) == 2


def test_pgoutput():
    s = lambda x: x.encode() + b"\0"
    relation = b"R" + struct.pack(">I", 7) + s("public") + s("chunks") + b"d" + struct.pack(">H", 2) + b"\1" + s("id") + struct.pack(">Ii", 20, -1) + b"\0" + s("text") + struct.pack(">Ii", 25, -1)
    insert = b"I" + struct.pack(">I", 7) + b"N" + struct.pack(">H", 2) + b"t" + struct.pack(">I", 1) + b"5" + b"u"
    good, bad = pgoutput.decode_all([(1, insert), (2, relation), (3, insert), (4, b"?"), (5, b"B" + struct.pack(">QQI", 9, 0, 0))])
    assert [l for l, _ in bad] == [1, 4] and good[1][1].row == {"id": "5", "text": pgoutput.UNCHANGED} and good[2][1].lsn == 9
    assert pgoutput.lsn_text(pgoutput.lsn_of("1A/2B")) == "1A/2B" and pgoutput.text_array('{a,"b \\" c",NULL}') == ["a", 'b " c', None]


def test_rate():
    assert [take_token(1.0, None, 0.0, 1, 1)[0], take_token(0.0, 0.0, 0.5, 1, 1)[0], take_token(0.0, 0.0, 1.0, 1, 1)[0]] == [True, False, True]
