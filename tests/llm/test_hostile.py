"""Very long texts, null and repeated ids, ties and clashing columns, in the operators that score or count."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import quality_rules, recurrent_lm, token_store, toxicity
from ledgerloom.llm.decontaminate import find_benchmark

WORDS = re.compile("[^\x20\x09-\x0d]+")
TOKENS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows():
    rnd = random.Random(21)
    vocabulary = ["".join(rnd.choice("abcdefghijé") for _ in range(rnd.randint(2, 8))) for _ in range(3000)]
    long = " ".join(rnd.choices(vocabulary, k=200_000))
    passage = " ".join(rnd.choices(vocabulary, k=14))
    short = [" ".join(rnd.choices(vocabulary, k=60)) for _ in range(40)]
    out = [(i, t) for i, t in enumerate(short)]
    out += [(100, long), (101, long + " " + passage), (None, short[0]), (None, None), (5, short[5]), (5, "other " + short[5]), (102, None), (102, ""), (103, passage.upper()), (104, "x" * 300_000)]
    return out, passage


@pytest.fixture(scope="module")
def docs(spark):
    data, _ = rows()
    clash = ["n_words", "n_hit", "items", "score", "held_out", "cells", "toxic", "label_id", "n_tokens", "bin", "g", "start", "kept", "ids", "spans"]
    df = spark.createDataFrame([(i, t, "en", None) for i, t in data], "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("other") for c in clash}).repartition(4)


def test_benchmark_search(spark, docs):
    data, passage = rows()
    items = [(1, passage), (1, passage), (2, "never seen words of an item that is longer than ten of them"), (None, passage), (3, None)]
    got = sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in find_benchmark(docs, spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr)
    want = []
    for i, t in data:
        w = TOKENS.findall((t or "").translate(LOWER))
        hits = set()
        p = passage.split()
        for k in range(len(w) - 9):
            if any(w[k : k + 10] == p[j : j + 10] for j in range(len(p) - 9) if w[k] == p[j]):
                hits |= set(range(k, k + 10))
        want.append((i, len(w), len(hits), 1 if hits else 0))
    assert got == sorted(want, key=repr)


def test_statistics_of_long_texts(docs):
    data, _ = rows()
    got = Counter((r.doc_id, r.n_words, r.word_chars) for r in quality_rules.judge(docs).collect())
    assert got == Counter((i, len(WORDS.findall(t or "")), sum(map(len, WORDS.findall(t or "")))) for i, t in data)


def test_language_model_base(docs):
    data, _ = rows()
    train = [t for i, t in data if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    counts = Counter()
    for t in train:
        counts.update(WORDS.findall((t or "").translate(LOWER)))
    n, end = sum(counts.values()) + len(train), len(train)
    v = len(counts) + 1
    want = []
    for i, t in data:
        w = WORDS.findall((t or "").translate(LOWER))
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((end + 1) / (n + v + 1))
        want.append((i, len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n, base))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in recurrent_lm.score_documents(docs).collect()), key=repr)
    for g, w in zip(got, sorted(want, key=repr), strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-6)
        assert g[5] is not None and math.isfinite(g[5]) and g[5] < 0


def test_token_store(spark, docs):
    data, _ = rows()
    path = token_store.new_store_path(spark)
    token_store.write_token_store(docs, path)
    got = token_store.read_documents(spark, path).orderBy("start").collect()
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(token_store._tokenizer_path("byte_bpe_50k.json")).encode
    want = Counter((i, len(encode(t or "", add_special_tokens=False).ids) + 1) for i, t in data if i is not None)
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]


def test_toxicity_of_repeats(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    out = toxicity.detect(docs, labels).collect()
    data, _ = rows()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in data)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert len({r.score for r in out if r.doc_id == 102}) == 1  # null and empty alike
