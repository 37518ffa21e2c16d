"""Cases that the reviews of rounds found, for the operators."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from ledgerloom.llm import line_dedup, token_store, toxicity
from ledgerloom.session import saved


def test_long_texts_do_not_throw_the_fit_off():
    rng = np.random.default_rng(3)
    labels = (np.arange(3000) % 10 == 0).astype(float)
    sizes = np.where(np.arange(3000) % 3 == 0, 6000, 60)
    sets = [np.unique(np.append((20000 * rng.random(n) ** 3).astype(int) + 100, rng.integers(7, 12) if toxic else 20)).astype(np.int32) for n, toxic in zip(sizes, labels, strict=True)]
    cells, counts = np.concatenate(sets), np.array([len(s) for s in sets])
    caught = 1 / (1 + np.exp(-toxicity.logits(*toxicity.train(labels, cells, counts), cells, counts, True))) >= toxicity.THRESHOLD
    assert caught[labels == 1].mean() > 0.95 and caught[labels == 0].mean() < 0.05


@pytest.mark.parametrize("per_term", [False, True])
def test_a_fit_and_its_scores_have_the_same_pairs(per_term):
    # rows of both terms or neither are positive, which only pairs can tell
    sets = [np.array([1] * a + [2] * b + [10 + i % 10], np.int32) for i, (a, b) in enumerate([(0, 0), (0, 1), (1, 0), (1, 1)] * 1000)]
    labels, cells, counts = np.array([1.0, 0.0, 0.0, 1.0] * 1000), np.concatenate(sets), np.array([len(s) for s in sets])
    model, bias = toxicity.train(labels, cells, counts, per_term=per_term)
    z = toxicity.logits(model, bias, cells, counts, per_term)
    assert ((z > 0) == (labels == 1)).mean() > 0.95


@pytest.mark.parametrize("cache", [20, 1000])
def test_remembered_pieces_are_bounded_and_the_common_ones_stay(monkeypatch, cache):
    monkeypatch.setattr(token_store, "CACHE_PIECES", cache)
    encoder = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["", None, " ", "a", " a", "a ", "a  b", "a \n b", "a\u00a0b c", "a\x00 b", "don't 12 34", "x <|endoftext|> y", "\u00e9t\u00e9, \u6f22\u5b57 \U0001f600!", "a \u2003b", "tab\t x", "a\x1c b"]
    asked = []
    encode = encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda texts: asked.extend(texts) or encode(texts))
    for k in range(6):
        texts = odd + [f"so many common words here and rare{k}x{i} ones" for i in range(30)]
        want = [[] if not t else encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        del asked[:]
        ids, counts = encoder.run(pa.array(texts))
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
        assert len(encoder.known) <= cache + 80
        assert k == 0 or not any("common" in t for t in asked)


def test_sets_of_lines_are_not_put_in_order(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a line of some words that is much like the others {i % 3} and goes on for a while") for i in range(30)], "doc_id long, text string")
    plans = []
    monkeypatch.setattr(line_dedup, "saved", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or saved(df))
    kept = {r.doc_id for r in line_dedup.dedup_lines(docs).collect() if r.n_removed == 0}
    words = lambda i: f"a line of some words that is much like the others {i % 3} and goes on for a while".split()
    sets = [{tuple(words(i)[j : j + 5]) for j in range(len(words(i)) - 4)} for i in range(30)]
    assert kept == {i for i in range(30) if not any(4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]) for j in range(i))}
    assert sum("sort_array" in p for p in plans) == 1  # only where prefixes are taken


def test_texts_are_hashed_once_and_frequent_tokens_come_last(spark, monkeypatch):
    draw = np.random.default_rng(5)
    common = [f"c{k}" for k in range(24)]
    texts = []
    for i in range(60):  # all share long passages, few are similar
        own = [f"w{x}" for x in draw.integers(0, 10**6, 4 + 4 * (i % 5))]
        texts.append(" ".join([*common[: 12 + i % 13], *own]))
        if i % 7 == 0:
            texts.append(" ".join([*common[: 12 + i % 13], *own[:-1], "x"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plans, counted = [], []
    cells = line_dedup._cells
    monkeypatch.setattr(line_dedup, "_cells", lambda tokens, *a: counted.append(tokens._jdf.queryExecution().optimizedPlan().toString()) or cells(tokens, *a))
    monkeypatch.setattr(line_dedup, "saved", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or saved(df))
    kept = {r.doc_id for r in line_dedup.dedup_lines(docs).collect() if r.n_removed == 0}
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in map(str.split, texts)]
    assert kept == {i for i in range(len(texts)) if not any(4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]) for j in range(i))}
    assert sum("sort_array" in p for p in plans) == 2  # of all lines, and of those with frequent tokens
    assert counted and not any("xxhash64" in p for p in counted)  # what is counted was hashed before
