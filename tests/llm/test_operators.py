"""The operators against brute force on small hostile tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import html_text, line_dedup, mixing, ngram_join, quality_rules, recurrent_lm, substring_dedup, textscan, token_store, toxicity
from ledgerloom.llm.decontaminate import drop_contaminated, find_benchmark

SPACED = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return SPACED.findall((text or "").translate(LOWER))


def hostile():
    """Nulls, empties, ties, repeats, long texts, families of copies at all similarities."""
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdeéß漢") for _ in range(rnd.randint(1, 7))) for _ in range(600)]
    some = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, " \n\t ", "en", None), (4, "One", "en", "s"), (5, "one", None, "s"), (6, "a b c d", "en", "s")]
    base, passage = some(150), some(60)
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randint(0, 12)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        rows.append((100 + i, " ".join(w), "en", "hot"))
    for i in range(20):
        rows.append((300 + i, " ".join(some(40) + passage[: rnd.randint(45, 60)] + some(rnd.randint(0, 50))), "de", "hot"))
    rows += [(400, " ".join(base), "en", "hot"), (401, " ".join(base).upper(), "en", "hot"), (402, "x " * 3000, "en", "s"), (403, "\n".join([" ".join(base)] * 3), "fr", None)]
    return [(i, t, lang, src, None) for i, t, lang, src in rows]


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns whose names clash with the operators' own."""
    df = spark.createDataFrame(hostile(), DOCS)
    clash = ["n_words", "comp", "token", "keys", "kept", "id", "x", "n", "group", "bin", "held_out", "score", "mix_rate", "label_id"]
    return df.withColumns({c: F.lit("other") for c in clash})


def texts():
    return {i: t for i, t, *_ in hostile()}


def test_word_hashes_equal_words():
    samples = ["", None, "a b  c\n\td", "é漢 x", "A" * 3000, " lead", "trail "] + ["w%d v" % i for i in range(50)]
    found = textscan.scan(pa.array(samples, pa.string()))
    h = found.hashes()
    seen = {}
    for i, t in enumerate(samples):
        mine = words(t)
        a, b = found.first[i], found.first[i + 1]
        assert b - a == len(mine)
        for w, x in zip(mine, h[a:b].tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_line_dedup(docs):
    got = {r.doc_id: (r.n_lines, r.n_removed, list(r.kept_lines)) for r in line_dedup.dedup_lines(docs).collect()}
    earlier, want = [], {}
    for d, t in sorted(texts().items()):
        kept = n = 0
        kept = []
        for i, line in enumerate((t or "").split("\n")):
            w = SPACED.findall(line)
            if not w:
                continue
            n += 1
            s = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
            if not any(100 * len(s & e) >= 75 * len(s | e) for e in earlier):
                kept.append(i)
            earlier.append(s)
        want[d] = (n, n - len(kept), kept)
    assert got == want


def test_line_dedup_settles_unlike_copies(spark):
    """Variants of one line that only some others resemble, words parted by any white space."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(24)]
    rows = []
    for d in range(120):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(24)] = f"v{rnd.randrange(6)}"
        rows.append((d, rnd.choice(["\t", " ", "\x0b", "\x0c \r"]).join(w) + "\n\t\x0b"))
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    earlier, want = [], {}
    for d, t in rows:
        w = SPACED.findall(t)
        s = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        want[d] = (1, int(any(100 * len(s & e) >= 75 * len(s | e) for e in earlier)))
        earlier.append(s)
    assert got == want
    assert 20 < sum(r for _, r in want.values()) < 110


def brute_classes():
    sets = {}
    for i, t in texts().items():
        w = words(t)
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block", [1000, 7])
def test_ngram_join(docs, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", block)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicate_classes(docs).collect()}
    want = brute_classes()
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 20


def test_keep_one_of_each(docs):
    kept = sorted(r.doc_id for r in ngram_join.keep_one_of_each(docs).collect())
    assert kept == sorted(i for i, (_, c) in brute_classes().items() if i == c)


def test_decontamination(spark, docs):
    t = texts()
    long = t[300]
    items = [(7, " ".join(long.split()[45:62])), (8, "One"), (9, None), (10, "!!"), (11, "b c"), (11, "b c"), (None, "漢 zz qq")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.items)) for r in find_benchmark(docs, benchmark).collect()}
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    cut = lambda s: pattern.findall((s or "").translate(LOWER))
    for i, text in t.items():
        w, hit, found = cut(text), set(), set()
        for item, body in items:
            b = cut(body)
            n = min(10, len(b))
            for j in range(len(b) - n + 1 if n else 0):
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == b[j : j + n]:
                        hit |= set(range(k, k + n))
                        found.add(item)
        assert got[i] == (len(w), len(hit), sorted(x for x in found if x is not None)), i
    left = {r.doc_id for r in drop_contaminated(docs, benchmark).collect()}
    assert left == {i for i in t if got[i][1] == 0}


def test_mixing(docs):
    rows = mixing.mix_sources(docs, weights={"hot": 3.0, "s": 1.0}, seed=5).collect()
    assert [r.mix_key for r in rows] == sorted(r.mix_key for r in rows)
    counts = {}
    for r in rows:
        counts.setdefault(r.doc_id, set()).add(r.mix_copy)
        assert r.mix_copies == len(counts[r.doc_id]) or r.mix_copy < r.mix_copies
    sizes = {}
    for i, t, _, src, _ in hostile():
        sizes[src or ""] = sizes.get(src or "", 0) + len(t or "")
    total = sum(sizes.values())
    for i, t, _, src, _ in hostile():
        rate = {"hot": 0.75, "s": 0.25}.get(src or "", 0.0) * total / sizes[src or ""] if sizes[src or ""] else 0.0
        p = c = np.exp(-rate)
        u = (int(hashlib.md5(f"5:{i}:1".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        n = 0
        while c < u:
            n += 1
            p *= rate / n
            c += p
        assert len(counts.get(i, ())) == n


def test_mixing_large_mean(spark):
    df = spark.createDataFrame([(i, "abc", "s") for i in range(200)], "doc_id long, text string, source string")
    n = mixing.mix_sources(df, epochs=100.0).count()
    assert abs(n - 20000) < 6 * 20000**0.5


def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>
    <article><h1>Head &amp; more</h1><p>First   part<br>of it <b>bold<p>Second &lt;one&gt;<div class="comments"><p>reader</p></div><aside>side</aside></article>
    <footer>foot</footer><script>var a="</p>"</script></body></html>"""
    assert html_text.main_text(page) == "Head & more\n\nFirst part of it bold\n\nSecond <one>"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>menu</nav>") == ""
    plain = "<body><div class='menu'><a>a</a></div><div>" + "".join(f"<p>{'word ' * 20}{i}</p>" for i in range(4)) + "</div><div id='cookie-banner'>we use cookies</div>"
    assert html_text.main_text(plain).count("\n\n") == 3
    assert html_text.main_text("<article><p>cut off &am") == "cut off &am"


def test_html_body_by_distribution():
    """No article tag: only the distribution can tell the body from the link lists around it."""
    links = lambda name: "<ul>" + "".join(f"<li><a href=x>{name} {i}</a></li>" for i in range(5)) + "</ul>"
    long = "a sentence of the main text that is long enough to make a surge by its own characters alone"
    body = ["Title", "By Someone", long, "Short one.", "See the long linked name of a source here", "After the advert.", "Brief.", f"{long} {long} {long} {long} {long}", "The end."]
    html = [f"<h1>{body[0]}</h1>", *[f"<p>{x}</p>\n" for x in body[1:]]]
    html[4] = "<p>See <a href=x>the long linked name of a source</a> here</p>"
    html.insert(5, "<div class=ad><div><div><p>Buy</p><div>now</div></div></div></div>\n\n")
    page = f"<body>{links('Top')}<div class=x>\n<div>\n{''.join(html)}</div></div>{links('Bottom')}<div>Made by us</div></body>"
    assert html_text.main_text(page).split("\n\n") == body
    assert html_text.main_text(page.replace("<div class=x>", "<main>")).split("\n\n")[: len(body)] == body
    # a dive inside the body cuts nothing, a small stretch after one is kept if it surges
    halves = f"<div><p>{long * 9}</p>{links('Mid')}<p>{long}</p><p>Last.</p></div>{links('Bottom')}"
    assert html_text.main_text(halves).split("\n\n") == [long * 9, *[f"Mid {i}" for i in range(5)], long, "Last."]
    assert html_text.main_text("<body><p>Only this.</p></body>") == "Only this."


def test_quality_statistics(docs):
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert len(got) == len(texts())
    for i, t in texts().items():
        t = t or ""
        w = SPACED.findall(t)
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        at = {}
        for j in range(len(w) - 7):
            at.setdefault(tuple(w[j : j + 8]), []).append(j)
        cover = {k for v in at.values() if len(v) > 1 for j in v for k in range(j, j + 8)}
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)), i
        assert g.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
        assert not (g.base_failed and g.kept)


def test_quality_rejects_outliers(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join("w" * rnd.randint(2, 8) + str(rnd.random())[:3] for _ in range(60)), "en", "s") for i in range(80)]
    rows += [(900, "### *** $$$ " * 10 + " ".join(f"a{i}" for i in range(30)), "en", "s")]
    out = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not out[900] and sum(out.values()) == 80


def test_toxicity_held_out(spark):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(1200):
        bad = i % 4 == 0
        w = [f"w{rnd.randrange(400)}" for _ in range(60)] + ([rnd.choice(["awful", "nasty"])] * 2 if bad else [])
        rnd.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(5000, None), (5001, "")]
    out = toxicity.detect(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 5000]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) > 0.97 * len(held)


def test_pairs_weigh_more_than_their_parts():
    """Only the two terms together are positive: no additive weights can tell."""
    rng = np.random.default_rng(0)
    sets, y = [], []
    for _ in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        sets.append(np.array([1] * a + [2] * b + [int(rng.integers(10, 20))], np.int32))
        y.append(float(a and b))
    model, bias = toxicity.train(np.array(y), np.concatenate(sets), np.array([len(s) for s in sets]))
    z = toxicity.logits(model, bias, np.array([1, 2, 1, 2], np.int32), np.array([1, 1, 2, 0]))
    assert z[2] > 0 > max(z[0], z[1], z[3])


def test_pairs_of_terms_without_signal_of_their_own():
    """Each term has the same share in both classes; rows are positive that have both terms or neither."""
    rng = np.random.default_rng(0)
    sets, y = [], []
    for a, b in [(0, 0), (0, 1), (1, 0), (1, 1)] * 1000:
        sets.append(np.array([1] * a + [2] * b + [int(rng.integers(10, 20))], np.int32))
        y.append(float(a == b))
    model, bias = toxicity.train(np.array(y), np.concatenate(sets), np.array([len(s) for s in sets]))
    z = toxicity.logits(model, bias, np.array([1, 2, 1, 2], np.int32), np.array([1, 1, 2, 0]))
    assert min(z[2], z[3]) > 0 > max(z[0], z[1])


def test_a_rare_term_weighs():
    """A word of five rows, all toxic, among thousands: too few for four standard errors."""
    y = np.array([float(i % 3 == 0) for i in range(3000)])
    sets = [np.array(([1] if i < 15 and i % 3 == 0 else []) + [10 + i % 50], np.int32) for i in range(3000)]
    model, bias = toxicity.train(y, np.concatenate(sets), np.array([len(s) for s in sets]))
    z = toxicity.logits(model, bias, np.array([1, 10, 10], np.int32), np.array([2, 1]))
    assert z[0] > z[1] + 0.2


def test_gradients(monkeypatch):
    """One step of training against numeric differences of the loss."""
    counts = np.ones(recurrent_lm.CLASSES * recurrent_lm.CLASS_SIZE)
    w = {k: v.astype(np.float64) for k, v in recurrent_lm.new_weights(counts).items()}
    rng = np.random.default_rng(1)
    ids, first = rng.integers(0, 200, 18).astype(np.int32), np.array([0, 7, 18])
    loss = lambda v: -recurrent_lm.score_on(v, ids, first).sum() / len(ids)
    memory = {k: np.zeros_like(v) for k, v in w.items()}
    after = {k: v.copy() for k, v in w.items()}
    monkeypatch.setattr(recurrent_lm, "RATE", 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        recurrent_lm.train_on(after, memory, ids, first)
    for k in w:
        for at in rng.choice(w[k].size, 6, replace=False):
            if memory[k].ravel()[at] == 0:
                continue
            up, down = {**w, k: w[k].copy()}, {**w, k: w[k].copy()}
            up[k].ravel()[at] += 1e-4
            down[k].ravel()[at] -= 1e-4
            numeric = (loss(up) - loss(down)) / 2e-4
            assert abs(abs(numeric) - memory[k].ravel()[at] ** 0.5) < 2e-3 * max(1e-2, abs(numeric)), k


def test_training_carries_long_documents_on(monkeypatch):
    """Each token is trained on after its true predecessor and the state of all tokens before it, as in scoring."""
    rng = np.random.default_rng(4)
    sizes = [2500, 3, 1500, 1, 40]
    ids = rng.integers(0, 200, sum(sizes)).astype(np.int32)
    first = np.concatenate([[0], np.cumsum(sizes)])
    ids[first[1:] - 1] = 7  # the end token
    w = recurrent_lm.new_weights(np.ones(recurrent_lm.CLASSES * recurrent_lm.CLASS_SIZE))
    monkeypatch.setattr(recurrent_lm, "RATE", 0.0)
    step = recurrent_lm._step

    def states(run):
        seen = []

        def spy(w, x, h):
            seen.extend(zip(x.tolist(), np.round(h.sum(axis=1), 3).tolist(), strict=True))
            return step(w, x, h)

        monkeypatch.setattr(recurrent_lm, "_step", spy)
        run()
        return sorted(seen)

    trained = states(lambda: recurrent_lm.train_on(w, {k: np.ones_like(v) for k, v in w.items()}, ids, first))
    scored = states(lambda: recurrent_lm.score_on(w, ids, first))
    before = sorted(x for a, b in zip(first[:-1], first[1:], strict=True) for x in [7, *ids[a : b - 1].tolist()])
    assert [x for x, _ in trained] == before and sum(h == 0 for _, h in trained) >= len(sizes)
    assert [x for x, _ in scored] == before
    assert np.abs(np.array(trained) - np.array(scored)).max() < 2e-3


def test_lm_scores(docs):
    out = {r.doc_id: r for r in recurrent_lm.score_documents(docs).collect()}
    toks = {i: [*words(t), None] for i, t in texts().items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    c = {}
    for i, ts in toks.items():
        for t in ts if not held[i] else ():
            c[t] = c.get(t, 0) + 1
    n = sum(c.values())
    for i, ts in toks.items():
        base = sum(np.log10((c.get(t, 0) + 1) / (n + len(c) + 1)) for t in ts)
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ts), sum(t in c for t in ts), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0


def test_dac_round_trip():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 300, 500), rng.integers(0, 2**32, 300), [0, 255, 256, 2**32 - 1]]).astype(np.uint32)
    levels, more, ranks = token_store.dac_encode(ids)
    assert (token_store.dac_decode(levels, more) == ids).all()
    assert [token_store.dac_get(levels, more, ranks, i) for i in range(len(ids))] == ids.tolist()


def test_token_store(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    odd = [(801, "it's    foo\tbar \n baz  \n\n q 12 3!?"), (802, "x <|endoftext|> y"), (803, "\x00 a \x00b"), (804, " lead"), (805, "trail "), (806, "a  b c…")]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    path = token_store.new_store_path(spark)
    token_store.write_token_store(both, path)
    got = {r.doc_id: r for r in token_store.read_documents(spark, path).collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, flat = 0, []
    for i, t in sorted({**texts(), **dict(odd)}.items()):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)
        flat += ids
    asked = [0, 17, len(flat) - 1, len(flat), -1]
    tokens = token_store.read_tokens(spark, path, spark.createDataFrame([(p,) for p in asked], "position long")).collect()
    assert {r.position: r.token for r in tokens} == {p: flat[p] for p in asked if 0 <= p < len(flat)}


def test_substring_dedup(docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_copied_substrings(docs).collect()}
    cut = {i: SPACED.findall(t or "") for i, t in texts().items()}
    first = {}
    for i in sorted(cut):
        for j in range(len(cut[i]) - 49):
            first.setdefault(tuple(cut[i][j : j + 50]), i)
    removed = 0
    for i, w in cut.items():
        keep = [True] * len(w)
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < i:
                keep[j : j + 50] = [False] * 50
        removed += keep.count(False)
        kept = " ".join(x for x, k in zip(w, keep, strict=True) if k)
        assert got[i] == (len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest()), i
    assert removed > 1000


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    path = token_store.new_store_path(spark)
    token_store.write_token_store(none, path)
    for df in (
        line_dedup.dedup_lines(none), ngram_join.near_duplicate_classes(none), find_benchmark(none, benchmark), mixing.mix_sources(none), html_text.extract_main_text(pages),
        quality_rules.judge(none), recurrent_lm.score_documents(none), token_store.read_documents(spark, path), substring_dedup.remove_copied_substrings(none),
    ):
        assert df.count() == 0
    assert toxicity.detect(none, labels).count() == 0
    assert all(r.n_hit == 0 for r in find_benchmark(docs, benchmark).collect())


def test_repeated_and_null_ids(spark):
    """Rows that share an id, rows without one, ties, in the operators that put documents in an order."""
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(5, long), (5, long), (5, "z " + long), (None, long), (None, None), (7, long + " end"), (9, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("other") for c in ("token", "part", "n", "to_doc", "share", "spans")})
    lines = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(df).collect()}
    assert lines == {5: (1, 0), 7: (1, 1), 9: (0, 0)}
    near = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicate_classes(df).collect()), key=repr)
    assert len(near) == len(rows) and {c for i, _, c in near if i in (5, 7)} == {5} and {c for i, _, c in near if i is None} == {None}
    removed = sorted(((r.doc_id, r.n_removed) for r in substring_dedup.remove_copied_substrings(df).collect()), key=repr)
    assert len(removed) == len(rows) and (7, 80) in removed and all(n == 0 for i, n in removed if i != 7)
    mixed = mixing.mix_sources(df.withColumn("source", F.lit(None).cast("string"))).collect()
    assert {r.doc_id for r in mixed} <= {5, 7, 9, None} and all("mix_key" in r for r in mixed)


@pytest.mark.parametrize("texts_out", [False, True])
def test_substrings_of_rows_that_share_an_id(spark, texts_out):
    """Every row keeps its own spans: repeated ids that lose words, equal rows, and rows that lose nothing."""
    rnd = random.Random(9)
    some = lambda n: [rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(n)]
    passage, other = some(60), some(55)
    rows = [(3, passage), (5, ["a"] + passage), (5, ["b", "c"] + passage), (5, ["b", "c"] + passage), (5, some(70)), (5, other), (6, other + passage), (6, passage + other), (7, passage), (7, some(10)), (None, passage), (8, [])]
    want = []
    for i, w in rows:
        starts = {tuple(x[k : k + 50]) for j, x in rows if i is not None and j is not None and j < i for k in range(len(x) - 49)}
        gone = {k + o for k in range(len(w) - 49) if tuple(w[k : k + 50]) in starts for o in range(50)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(gone), kept) if texts_out else (i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = substring_dedup.remove_copied_substrings(df.repartition(3), texts_out=texts_out)
    got = got.select("doc_id", "n_removed", "kept") if texts_out else got
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
