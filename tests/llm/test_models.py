"""Learnt scores and robust verdicts against plain numpy."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import html_text, quality_rules, textscan, toxicity

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string"


def cell(part, salt):
    """The cell of one word (salt 0) or of a stem; stems may end inside a character."""
    column = pa.array([part], pa.binary())
    words = textscan.Words(np.frombuffer(part, np.uint8), np.array([0]), np.array([len(part)]), np.array([0, 1]))
    assert len(column) == 1
    h = words.hashes() if not salt else textscan.mix(words.hashes() + np.uint64(salt))
    return int(h[0] >> np.uint64(64 - toxicity.BITS))


def plain_cells(text):
    found = set()
    for w in WORD.findall((text or "").translate(LOWER)):
        b = w.encode()
        found.add(cell(b, 0))
        found |= {cell(b[:size], k + 1) for k, size in enumerate(toxicity.STEM_BYTES) if len(b) > size}
    return sorted(found)


def test_toxicity_scores_are_the_sum_over_all_pairs(spark):
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefé漢") for _ in range(rnd.randint(1, 9))) for _ in range(80)]
    rows = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 40)))) for i in range(60)]
    rows += [(100, None), (100, ""), (None, "abc"), (7, rows[7][1]), (101, " ".join(vocabulary) * 400), (102, "Ab-aB 9x!")]
    rng = np.random.default_rng(1)
    model = np.zeros((toxicity.BUCKETS, toxicity.FACTORS + 2), np.float32)
    model[:, :-1] = rng.normal(0, 0.2, (toxicity.BUCKETS, toxicity.FACTORS + 1))
    model[:, -1] = (model[:, 1:-1].astype(np.float64) ** 2).sum(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("other") for c in ("score", "cells", "toxic", "held_out")})
    got = sorted(((r.doc_id, r.score) for r in toxicity.score(df, model, -0.7).collect()), key=repr)
    want = []
    for i, text in rows:
        w = model[plain_cells(text)].astype(np.float64)
        z = -0.7 + w[:, 0].sum() + sum(float(w[a, 1:-1] @ w[b, 1:-1]) for a in range(len(w)) for b in range(a)) if len(w) else -0.7
        want.append((i, 1 / (1 + np.exp(-np.clip(z, -30, 30)))))
    for (i, a), (j, b) in zip(got, sorted(want, key=repr), strict=True):
        assert i == j and a == pytest.approx(b, rel=1e-4, abs=1e-7)


# --- robust outliers ------------------------------------------------------------------------


def plain_distances(x):
    """Squared distances by concentration steps on the exact CORE nearest, from the centre of all and from the medians; the least determinant counts."""
    floors = np.array([quality_rules.FLOORS[f] for f in quality_rules.FEATURES])
    h = int(np.ceil(quality_rules.CORE * len(x)))

    def estimate(rows):
        c = np.cov(rows.T, bias=True) * quality_rules.CONSISTENCY + np.diag(floors**2)
        return rows.mean(0), c

    def distance(centre, cov):
        d = x - centre
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)

    best = None
    for centre, cov in ((np.median(x, 0), np.diag(floors**2)), estimate(x)):
        last = np.inf
        while True:
            centre, cov = estimate(x[np.argsort(distance(centre, cov), kind="stable")[:h]])
            det = np.linalg.slogdet(cov)[1]
            if det > last - quality_rules.LEAST_GAIN:
                break
            last = det
        if best is None or det < best[0]:
            best = (det, distance(centre, cov))
    return best[1]


def quality_docs():
    rnd = random.Random(12)
    words = lambda n, lo, hi: [("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(lo, hi)))) for _ in range(n)]
    rows = []
    for i in range(240):
        lang, source = ("en", "hot") if i % 4 else ("de", None)
        rows.append((i, "\n".join(" ".join(words(rnd.randint(8, 20), 2, 9)) for _ in range(rnd.randint(3, 9))), lang, source))
    base = rows[1][1].split("\n")
    rows += [
        (900, " ".join(words(80, 14, 20)), "en", "hot"),  # long words
        (901, " ".join(w + "#$%&" for w in words(80, 2, 9)), "en", "hot"),  # symbols
        (902, "\n".join(x for k in range(8) for x in (" ".join(words(4, 3, 6)), base[0][:20] + " a b c d e f")), "en", "hot"),  # a line again and again
        (903, "", "en", "hot"), (904, None, None, None), (905, " ".join(words(30, 2, 9)), "alone", "x"), (906, rows[1][1], "en", "hot"), (906, rows[1][1], "en", "hot"),
    ]
    return rows


def test_verdicts_equal_those_of_plain_estimates(spark):
    df = spark.createDataFrame(quality_docs(), DOCS).withColumns({c: F.lit("other") for c in ("g", "bin", "n", "limit", "start", "done", "kept")})
    stats = quality_rules.text_statistics(df.select("doc_id", "text", "lang", "source").repartition(3), "text")
    features = {(r.lang, r.source): [] for r in stats.select("lang", "source").distinct().collect()}
    for r in stats.select("doc_id", "lang", "source", "n_words", "n_repeat_words", *[c.alias(k) for k, c in quality_rules._features().items()]).collect():
        if r.n_words >= quality_rules.MIN_WORDS and 100 * r.n_repeat_words <= quality_rules.MAX_REPEAT_PERCENT * r.n_words:
            features[r.lang, r.source].append((r.doc_id, [r[f] for f in quality_rules.FEATURES]))
    want = {}
    for rows in features.values():
        if rows:
            distances = plain_distances(np.array([x for _, x in rows])) if len(rows) > 1 else [0.0]
            want |= {i: d for (i, _), d in zip(rows, distances, strict=True)}
    judged = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert {i for i, r in judged.items() if not r.base_failed} == set(want)
    for i, d in want.items():
        assert judged[i].squared_distance == pytest.approx(d, rel=0.25, abs=0.5), i
        if not 0.75 * quality_rules.CUTOFF < d < 1.25 * quality_rules.CUTOFF:
            assert judged[i].kept == (d <= quality_rules.CUTOFF), i
    assert not judged[900].kept and not judged[901].kept and judged[905].kept and judged[906].kept
    assert sum(r.kept for r in judged.values()) >= 235


# --- pages ----------------------------------------------------------------------------------

LONG = "A sentence of the article that has enough characters to be a surge by itself alone."


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p data-x=it's>hello", "hello"), ("<svg/><p>hello</p>", "hello"), ('<svg a="/>"><text>no</text></svg><p>hello', "hello"), ("<math/>x<p>y", "x\n\ny"),
        ("<svg-icon></svg-icon><p>hello", "hello"), ("<object-list>x</object-list><p>hello", "x\n\nhello"), ("<select-menu>a</select-menu>", "a"), ("<title-x>t</title-x>", "t"),
        ("<title>t</title><p>hello", "hello"), ('<script>"</div>"</script ><p>hello', "hello"), ("<style>p{}</style><p>a</p><noscript>n</noscript>", "a"), ("<textarea>never closed <p>x", ""),
        ('<article class="post has-sidebar comments-open"><p>hello</p></article>', "hello"), ('<div class="ad-free-story">hello</div>', "hello"), ('<div id="sharing-economy">hello</div>', "hello"),
        ('<div class="ad-slot">x</div><p>hello', "hello"), ('<div class="site-header">x</div><p>hello', "hello"), ('<div id="sidebar-2">x</div><p>hello', "hello"), ('<div class="relatedPosts">x</div><p>hello', "hello"),
        ('<div class="post-comments">x</div><p>hello', "hello"), ('<div role="navigation">x</div><p>hello', "hello"), ("<div hidden>x</div><p>hello", "hello"), ('<div style="display: none">x</div><p>hello', "hello"),
        (f"<main><p>An intro.</p></main><div>{f'<p>{LONG}</p>' * 3}</div>", "\n\n".join(["An intro.", *[LONG] * 3])), (f"<div>aside of it</div><article><p>{LONG}</p></article><div>more</div>", LONG),
        ("<p>a&nbsp;&lt;b&gt; &#233;\u00a0 c", "a <b> é c"), ("a<br>b<p>c<b>d</b>e", "a b\n\ncde"), ("<i>x<p>y</i>z", "x\n\nyz"), ("<p>a <a href='x>y'>b</a> c", "a b c"), ("<p>1 < 2 & 3", "1 < 2 & 3"), ("<!-- <p>x --><p>y", "y"), ("<", "<"),
    ],
)
def test_pages_literally(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("part", ["<div>|</p>", "<b>|</i>", "<i><div>|<b>|</i>", '<div class="x', "<svg ", "a='", "<p ='", "<a href=x>|</b>", "<ul><li>|</p>", "</div>", "&#", "<!"])
def test_malformed_pages_take_linear_time(part):
    n = 2_000_000 // len(part)
    page = "".join(x * (n // (part.count("|") + 1)) for x in part.split("|"))
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 20


def test_repeated_pages_and_clashing_columns(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (1, None, "<p>b"), (None, None, None), (2, "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("other") for c in ("text", "n_chars", "line")})
    got = sorted(map(tuple, html_text.extract_main_text(df).collect()), key=repr)
    assert got == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (1, None, "b", 1), (None, None, "", 0), (2, "", "", 0)], key=repr)
