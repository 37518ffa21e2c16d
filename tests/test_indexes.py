"""Indexes of vectors, texts and entities, and the model hook, against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import entity_index as E
from ledgerloom.operators import model_hook as H
from ledgerloom.operators import text_index as X
from ledgerloom.operators import vector_index as V

SF = "/root/testdata/sf0.1"


# --- vectors --------------------------------------------------------------------------------


def vectors():
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.3 * rnd.normal(size=16)).astype(np.float32).tolist()) for i in range(900)]
    hot = rows[7][1]
    rows += [(1000 + i, hot) for i in range(300)]  # a third of them one vector
    rows += [(2000, None), (2001, [0.0] * 16), (2002, (2 * np.array(hot)).tolist())]
    return rows


def plain_nearest(rows, asked, k):
    out = {}
    for q, v in asked:
        if v is None or not any(v):
            continue
        v = np.array(v, float)
        scores = [(-round(float(v @ np.array(w, float) / np.linalg.norm(v) / np.linalg.norm(np.array(w, float))), 6), i) for i, w in rows if w is not None and any(w)]
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rows = vectors()
    asked = [r for r in rows if r[0] % 50 == 0 or r[0] in (2001, 2002)]
    stored = spark.createDataFrame(rows, "vec_id long, v array<float>")
    return rows, asked, stored, spark.createDataFrame(asked, "query_id long, q array<float>")


def test_nearest_and_exact_search(spark, tables, monkeypatch, tmp_path):
    rows, asked, stored, queries = tables
    want = plain_nearest(rows, asked, 20)
    assert found(V.nearest(queries, stored, 20)) == want
    monkeypatch.setattr(V, "QUERY_BLOCK", 5)
    assert found(V.nearest(queries, stored, 20)) == want
    monkeypatch.setattr(V, "PIECE", 40)
    monkeypatch.setattr(V, "ASKERS", 3)
    index = V.build_index(stored)
    assert index.rows.count() == sum(1 for _, v in rows if v is not None and any(v))
    index.write(str(tmp_path / "index"))
    for x in (index, V.open_index(spark, str(tmp_path / "index"))):
        assert found(V.search_exact(x, queries, 20, 1)) == want
        assert found(V.search(x, queries, 20, len(x.centroids))) == want


def test_only_probed_lists_are_scored(spark, tables):
    _, _, stored, queries = tables
    index = V.build_index(stored, 12)
    opened = {(r.query_id, r.list) for r in V.probed_lists(index, queries, 2).collect()}
    of = {r.vec_id: r.list for r in index.rows.collect()}
    hits = V.probe(index, V.probed_lists(index, queries, 2), 20).collect()
    assert hits and all((r.query_id, of[r.vec_id]) in opened for r in hits)


def test_recall_at_20_on_the_given_table(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.col("embedding").alias("v"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    want = {(r.query_id, r.vec_id) for r in V.nearest(q, e, 20).collect()}
    got = {(r.query_id, r.vec_id) for r in V.search(V.build_index(e), q, 20).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_empty_and_uneven_vectors(spark, tables):
    _, _, stored, queries = tables
    index = V.build_index(stored.limit(0))
    assert V.nearest(queries, stored.limit(0), 3).count() == 0
    assert V.search_exact(V.build_index(stored), queries.limit(0), 3).count() == 0
    assert index.rows.count() == 0
    with pytest.raises(Exception, match="different lengths"):
        V.nearest(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "query_id long, q array<float>"), stored, 3)


# --- texts ----------------------------------------------------------------------------------


def texts():
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 25)))) for i in range(150)]
    rows += [(200 + i, rows[0][1].upper()) for i in range(40)] + [(300 + i, rows[0][1] + " more") for i in range(40)]
    rows += [(400, None), (401, " \n "), (402, "w1"), (403, "w1 w1"), (404, "unseen w1"), (405, "w5 " * 2000), (500, "w1"), (-50, "w2")]
    return rows


def plain_conjunctive(rows, k, terms=lambda t: (t or "").lower().split()):
    counts = {i: Counter(terms(t)) for i, t in rows}
    out = []
    for q, t in rows:
        need = set(terms(t))
        if q % 50 or not need:
            continue
        hits = sorted((-sum(c[w] for w in need), i) for i, c in counts.items() if need <= set(c))
        out += [(q, i, -s, n) for n, (s, i) in enumerate(hits[:k], 1)]
    return sorted(out)


def test_conjunctions(spark):
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    index = X.build_text_index(docs)
    got = X.conjunctive(index, asked, 20)
    assert sorted((r.query_id, r.doc_id, r.score, r.rank) for r in got.collect()) == plain_conjunctive(texts(), 20)
    rows = index.postings.collect()
    counts = {i: Counter((t or "").lower().split()) for i, t in texts()}
    assert {(r.term, d): (n, m) for r in rows for d, n, m in zip(r.docs, r.counts, r.sizes, strict=True)} == {(w, i): (n, len(c)) for i, c in counts.items() for w, n in c.items()}
    assert sum(len(r.docs) for r in rows) == sum(map(len, counts.values()))
    assert X.conjunctive(X.build_text_index(docs.limit(0)), asked, 20).count() == 0


def test_the_segmentation_is_used_on_both_sides(spark):
    rows = [(0, "hoàn hàng nhanh"), (1, "hàng hoàn nhanh"), (2, "khách hoàn hàng nhanh"), (3, "hoàn  hàng (a.b) nhanh nhanh")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    segment = X.compounds(["hoàn hàng", "hoàn", "(a.b) nhanh"])
    assert [r.t for r in docs.orderBy("doc_id").select(segment(F.col("text")).alias("t")).collect()] == [
        ["hoàn_hàng", "nhanh"], ["hàng", "hoàn", "nhanh"], ["khách", "hoàn_hàng", "nhanh"], ["hoàn_hàng", "(a.b)_nhanh", "nhanh"],
    ]
    asked = docs.where("doc_id = 0").select(F.col("doc_id").alias("query_id"), "text")
    both = lambda s: [(r.doc_id, r.score) for r in X.conjunctive(X.build_text_index(docs, s), asked, 9).orderBy("rank").collect()]
    assert both(segment) == [(0, 2), (2, 2), (3, 2)]
    assert both(X.words) == [(3, 4), (0, 3), (1, 3), (2, 3)]


# --- entities -------------------------------------------------------------------------------


def grams(text):
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in (text or "").lower()).split()
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def names():
    rnd = random.Random(6)
    parts = ["chair", "table", "lamp", "desk", "chairs", "stable", "lamps", "a", "xy", "z9"]
    rows = [(i, " ".join(rnd.choices(parts, k=rnd.randint(1, 4))) + f" K{i % 30}") for i in range(200)]
    return rows + [(300 + i, "chair table K1") for i in range(60)] + [(400, None), (401, " - "), (402, "漢字"), (403, "chair")]


@pytest.mark.parametrize("k", [1, 8, 500])
def test_similar_names(spark, k):
    asked = [(q, t) for q, t in names() if q % 25 == 0] + [(900, "chiar tabel"), (901, None), (902, "qqq")]
    got = E.similar(spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(names(), "id long, text string"), k)
    want = []
    for q, t in asked:
        scores = sorted((-round(len(grams(t) & grams(n)) / len(grams(t) | grams(n)), 6), i) for i, n in names() if grams(t) & grams(n))
        want += [(q, i, -s, r) for r, (s, i) in enumerate(scores[:k], 1)]
    assert sorted((r.query_id, r.id, r.score, r.rank) for r in got.collect()) == sorted(want)


def test_what_both_channels_find_comes_first(spark):
    ranks = lambda ids: spark.createDataFrame([(1, i, n) for n, i in enumerate(ids, 1)], "query_id long, id long, rank long")
    order = lambda df: [r.id for r in df.orderBy("pos").collect()]
    assert order(E.fused(ranks([9, 5]), ranks([9, 7]))) == [9, 5, 7]
    assert order(E.fused(ranks([9, 5]), None)) == [9, 5]
    live = spark.createDataFrame([(7, "sofa"), (9, "new name")], "id long, name string")
    assert [(r.id, r.name, r.pos) for r in E.verified(E.fused(ranks([5, 9]), ranks([5, 7])), live).orderBy("pos").collect()] == [(9, "new name", 1), (7, "sofa", 2)]


def test_containing_names(spark):
    live = spark.createDataFrame([(i, n) for i, n in names() if n], "id long, name string")
    asked = [(1, "CHAIR t"), (2, "able K"), (3, "a"), (4, "y"), (5, " "), (6, "漢"), (7, "% k"), (8, None)]
    got = E.containing(spark.createDataFrame(asked, "query_id long, text string"), live, 5)
    want = [(q, i) for q, t in asked if (t or "").strip() for i, _ in sorted((i, n) for i, n in names() if n and t.lower() in n.lower())[:5]]
    assert sorted((r.query_id, r.id) for r in got.collect()) == sorted(want)


def test_resolution(spark):
    queries = spark.createDataFrame([(1, "chair"), (2, "lamp"), (3, "none"), (4, "desk"), (5, "Table ")], "query_id long, text string")
    lexical = spark.createDataFrame([(1, 10, "chair", 1), (1, 11, "chair big", 2), (2, 20, "lamp a", 1), (2, 21, "lamp b", 2), (5, 50, "table", 1), (5, 51, "TABLE", 2)], "query_id long, id long, name string, pos long")
    semantic = spark.createDataFrame([(2, 20, "lamp a", 1), (2, 22, "torch", 2), (4, 40, "desk one", 1)], "query_id long, id long, name string, pos long")
    score = F.when(F.col("id") == 20, 0.9).when(F.col("id") == 40, 0.6).when(F.col("id") == 11, 0.99).otherwise(0.5)
    rows = {r.query_id: (r.n, r.picked, r.needs) for r in E.resolve(queries, lexical, semantic, score).collect()}
    assert rows == {1: (2, 10, False), 2: (3, 20, False), 3: (0, None, False), 4: (1, 40, False), 5: (2, None, True)}
    # with the semantic channel switched off, the lexical one decides alone
    rows = {r.query_id: (r.n, r.picked, r.needs) for r in E.resolve(queries, lexical, None, score).collect()}
    assert rows[2] == (2, 20, False) and rows[4] == (0, None, False)


# --- the hook -------------------------------------------------------------------------------


def test_a_failing_loader_is_tried_once_per_worker(monkeypatch):
    monkeypatch.setattr(H, "_loaded", {})
    calls = []

    def boom():
        calls.append(1)
        raise RuntimeError("no network")

    assert H.values("m", boom, [["a"]]) is None and H.values("m", boom, [["b"]]) is None
    assert len(calls) == 1


def test_a_wrong_number_of_scores_fails_open(monkeypatch):
    monkeypatch.setattr(H, "_loaded", {})
    assert H.values("m", lambda: lambda a: [1.0], [["a", "b"]]) is None
    assert H._loaded["m"] is False
    assert H.values("n", lambda: lambda a: [0.2, 0.9], [["a", "b"]]) == [0.2, 0.9]


def pool(spark):
    rows = [(q, i, i, 1.0 / i, [None, "x" * i][q % 2 or i != 3]) for q in (1, 2, 3) for i in range(1, 8)]
    return spark.createDataFrame(rows, "query_id long, id long, pos long, rrf double, text string")


def test_rerank_keeps_ties_and_falls_back_per_question(spark):
    longest = lambda: lambda texts: [min(len(t), 5) for t in texts]  # noqa: E731  (fails where a text is null)
    scored = H.scored(pool(spark).repartition(3, "query_id"), "longest", longest, ["text"], batch=100)
    rows = {}
    for r in H.rerank(scored, 3).orderBy("query_id", "place").collect():
        rows.setdefault(r.query_id, []).append((r.id, r.method, round(r.top_score, 6)))
    assert rows[2] == [(1, "hybrid-rrf", 1.0), (2, "hybrid-rrf", 1.0), (3, "hybrid-rrf", 1.0)]
    good = [(5, "hybrid-rrf+rerank", 0.2), (6, "hybrid-rrf+rerank", 0.2), (7, "hybrid-rrf+rerank", 0.2)]
    kept = [(1, "hybrid-rrf", 1.0), (2, "hybrid-rrf", 1.0), (3, "hybrid-rrf", 1.0)]
    assert rows[1] in (good, kept) and rows[3] in (good, kept)  # a worker that has failed before stays out of use
    off = H.rerank(H.scored(pool(spark), "longest", longest, ["text"], enabled=False), 3)
    assert {r.method for r in off.collect()} == {"hybrid-rrf"}
    on = H.rerank(H.scored(pool(spark).where("text is not null"), "longest again", longest, ["text"]), 3)
    assert [(r.id, r.method) for r in on.where("query_id = 1").orderBy("place").collect()] == [(i, "hybrid-rrf+rerank") for i in (5, 6, 7)]


def test_embeddings_fail_loudly(spark):
    lengths = lambda: lambda texts, role: [[float(len(t)), 1.0 if role == "query" else 0.0] for t in texts]
    short = lambda: lambda texts, role: [[0.0, 0.0]] * (len(texts) - 1)
    none = lambda: None
    df = spark.createDataFrame([("a",), ("abc",)], "text string")
    assert sorted(r.embedding for r in H.embedded(df, "lengths", lengths, "text", 2, role="query").collect()) == [[1.0, 1.0], [3.0, 1.0]]
    assert sorted(r.embedding for r in H.embedded(df, "lengths", lengths, "text", 2).collect()) == [[1.0, 0.0], [3.0, 0.0]]
    for name, loader, dim, message in (("short", short, 2, "vectors for"), ("lengths", lengths, 3, "another dimension"), ("none", none, 2, "failed")):
        with pytest.raises(Exception, match=message):
            H.embedded(df, name, loader, "text", dim).collect()
    with pytest.raises(ValueError, match="role"):
        H.embedded(df, "lengths", lengths, "text", 2, role="other")
