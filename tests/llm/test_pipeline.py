"""The pipeline's stages, each held against a plain version on its own input."""

import re

import duckdb

import corpus_pipeline
from ledgerloom.llm import quality_rules

SF = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x20\x09-\x0d]+")
TOKENS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append(docs.collect())
    start = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality_rules.judge(start).where("kept").collect()}
    assert {r.doc_id for r in kept[0]} == good and len(good) > 100
    sets = {}
    for r in kept[0]:
        w = WORDS.findall(r.text.translate(LOWER))
        sets[r.doc_id] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if not sets[i].isdisjoint(sets[j]) and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert sorted(r.doc_id for r in kept[1]) == sorted(i for i in sets if find(i) == i)
    windows = set()
    for (text,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall():
        w = TOKENS.findall((text or "").translate(LOWER))
        n = min(10, len(w))
        windows |= {tuple(w[j : j + n]) for j in range(len(w) - n + 1) if n}
    assert {len(x) for x in windows} == {10}

    def hit(text):
        w = TOKENS.findall(text.translate(LOWER))
        return any(tuple(w[j : j + 10]) in windows for j in range(len(w) - 9))

    assert {r.doc_id for r in kept[2]} == {r.doc_id for r in kept[1] if not hit(r.text)}
    assert {r.text for r in kept[3]} <= {r.text for r in kept[2]} and len({r.doc_id for r in kept[3]}) == len(kept[3]) > 100
    assert sorted(r.doc_id for r in kept[4]) == sorted(r.doc_id for r in kept[3])
    ordered = sorted(kept[4], key=lambda r: r.doc_id)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:], strict=False))
