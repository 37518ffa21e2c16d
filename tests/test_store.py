"""Versioned stores: replacing documents, markers, mirrors."""

import threading

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import model_hook as H
from ledgerloom.sources import store as S


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, text string").withColumn("hash", F.sha2(F.col("text").cast("binary"), 256))


def lines(rows):
    return rows.select("doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("chunk_index", "chunk_text"))


def stored(store, version=None):
    return sorted((r.doc_id, r.chunk_index, r.chunk_text, r.version) for r in store.chunks(version).collect())


def test_unchanged_documents_are_skipped_and_changed_ones_replaced(spark, tmp_path):
    store = S.ChunkStore(spark, str(tmp_path / "s"))
    assert store.documents() is None and store.chunks() is None
    assert store.replace(docs(spark, [("a", "one\ntwo"), ("b", "three"), ("e", "\n")]), lines) == {"ingested": 2, "skipped": 1, "chunks": 3}
    assert store.replace(docs(spark, [("a", "one\ntwo")]), lines) == {"ingested": 0, "skipped": 1, "chunks": 0}
    assert store.log.version() == 1
    assert store.replace(docs(spark, [("a", "four"), ("b", "three"), ("c", "five")]), lines) == {"ingested": 2, "skipped": 1, "chunks": 2}
    assert stored(store) == [("a", 0, "four", 2), ("b", 0, "three", 1), ("c", 0, "five", 2)]
    assert stored(store, 1) == [("a", 0, "one", 1), ("a", 1, "two", 1), ("b", 0, "three", 1)]
    # back to an earlier text: its chunks are taken anew, the first ones stay hidden
    store.replace(docs(spark, [("a", "one\ntwo")]), lines)
    assert [x[:3] for x in stored(store)] == [("a", 0, "one"), ("a", 1, "two"), ("b", 0, "three"), ("c", 0, "five")]
    assert store.drop_missing(docs(spark, []).limit(0)) == 0
    assert store.drop_missing(docs(spark, [("a", ""), ("c", "")])) == 1
    before = [x[:3] for x in stored(store)]
    assert before == [("a", 0, "one"), ("a", 1, "two"), ("c", 0, "five")]
    store.compact()
    assert [x[:3] for x in stored(store)] == before and len(store.log.entries()) == 1
    assert [x[:3] for x in stored(store, 2)] == [("a", 0, "four"), ("b", 0, "three"), ("c", 0, "five")]
    assert store.replace(docs(spark, [("c", "five")]), lines)["skipped"] == 1


def test_a_failed_embedding_changes_nothing(spark, tmp_path):
    store = S.ChunkStore(spark, str(tmp_path / "s"))
    good = lambda: lambda texts, role: [[float(len(t))] for t in texts]
    bad = lambda: lambda texts, role: [[1.0]]  # noqa: E731  (one vector, however many texts)
    chunk = lambda name, loader: lambda rows: H.embedded(lines(rows), name, loader, "chunk_text", 1)
    store.replace(docs(spark, [("a", "old")]), chunk("good", good))
    with pytest.raises(Exception, match="vectors for"):
        store.replace(docs(spark, [("a", "new\nlines"), ("b", "more\nthan\none")]).coalesce(1), chunk("bad", bad))
    assert stored(store) == [("a", 0, "old", 1)]
    assert [r.doc_id for r in store.documents().collect()] == ["a"]
    assert store.chunks().first()["embedding"] == [3.0]


def together(*calls):
    """Results of calls that start at once."""
    gate, found = threading.Barrier(len(calls)), [None] * len(calls)

    def go(i):
        gate.wait()
        found[i] = calls[i]()

    threads = [threading.Thread(target=go, args=(i,)) for i in range(len(calls))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return found


def test_of_writers_at_once_one_wins(spark, tmp_path):
    for n in range(5):
        path = f"file://{tmp_path}/marker-{n}"
        won = together(*[lambda v=v: S.put_if_absent(spark, path, str(v)) for v in range(6)])
        assert won.count(True) == 1
        assert S.read_text(spark, path) == str(won.index(True))
    assert not [x for x in tmp_path.iterdir() if "." in x.name]  # nothing is left of those that lost


def test_marker(spark, tmp_path):
    path = str(tmp_path / "marker.json")
    first, second = {"model": "m3", "dim": 1024}, {"model": "other", "dim": 3072}
    S.assert_marker(spark, path, second)  # nothing is marked yet
    assert S.marker(spark, path, first) == first
    assert S.marker(spark, path, second) == first
    S.assert_marker(spark, path, first)
    with pytest.raises(RuntimeError, match="3072"):
        S.assert_marker(spark, path, second)


def test_two_writers_of_one_store(spark, tmp_path):
    store = S.ChunkStore(spark, str(tmp_path / "s"))
    found = together(lambda: store.replace(docs(spark, [("a", "x"), ("b", "y")]), lines), lambda: store.replace(docs(spark, [("b", "y"), ("c", "z")]), lines))
    assert store.log.version() == 2
    assert sorted((x["ingested"], x["skipped"]) for x in found) == [(1, 1), (2, 0)]  # the later one sees b as known
    assert [x[:3] for x in stored(store)] == [("a", 0, "x"), ("b", 0, "y"), ("c", 0, "z")]


def pages(spark, folder, rows):
    folder.mkdir()
    for i, page in enumerate(rows):
        spark.createDataFrame(page, "id long, name string").coalesce(1).write.parquet(f"{folder}/page-{i}")
    return spark.readStream.schema("id long, name string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_mirror_sync(spark, tmp_path):
    mirror = S.Mirror(spark, str(tmp_path / "mirror"))
    rows = lambda: sorted((r.id, r.name) for r in mirror.rows().collect())
    first = pages(spark, tmp_path / "first", [[(1, "a"), (2, "b")], [(3, "c")]])
    assert S.sync(first, mirror, "run 1", str(tmp_path / "c1")) == {"fetched": 3, "deleted": 0}
    assert rows() == [(1, "a"), (2, "b"), (3, "c")]
    at = mirror.log.version()
    second = pages(spark, tmp_path / "second", [[(2, "B")], [(4, "d")]])
    assert S.sync(second, mirror, "run 2", str(tmp_path / "c2")) == {"fetched": 2, "deleted": 2}
    assert rows() == [(2, "B"), (4, "d")]
    assert {r.id: r.action for r in mirror.changes(at, mirror.log.version()).collect()} == {1: "delete", 2: "update", 3: "delete", 4: "insert"}
    # an empty fetch deletes nothing
    third = pages(spark, tmp_path / "third", [[]])
    assert S.sync(third, mirror, "run 3", str(tmp_path / "c3")) == {"fetched": 0, "deleted": 0}
    assert rows() == [(2, "B"), (4, "d")]
    # a batch that was committed before its stream failed is not taken twice
    version = mirror.log.version()
    mirror.upsert(spark.createDataFrame([(9, "z")], "id long, name string"), "run 4", 0)
    mirror.upsert(spark.createDataFrame([(9, "z")], "id long, name string"), "run 4", 0)
    assert mirror.log.version() == version + 1


def test_keyset_pages(spark):
    got = S.numbered_pages(spark.range(0, 1000, 7).repartition(3), "id", 100).orderBy("page").collect()
    assert [(r.page, r.first, r.last, r.n) for r in got] == [(0, 0, 693, 100), (1, 700, 994, 43)]
