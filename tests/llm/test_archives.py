"""WARC archives, Merkle manifests and the divergence audit against plain versions on small hostile tables."""

import base64
import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import divergence, entries, merkle, sql, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- WARC -----------------------------------------------------------------------------------


def pages():
    rows = [(i, f"http://x.example/{i}", f"<p>page {i % 7}</p>") for i in range(40)]
    rows += [(100, None, None), (101, "http://e.example/", ""), (102, "u", "é" * 9), (103, "a\r\nWARC-Type: x%", "<p>page 3</p>"), (104, "long", "ab\r\n\r\n" * 300_000), (105, "random", "".join(random.Random(5).choices("abcdefgh \n", k=400_000)))]
    rows += [(None, "n", "<p>page 1</p>"), (None, "alone", "only null ids"), (None, "alone", "only null ids"), (39, "again", "<p>page 4</p>"), (39, "again", "<p>page 4</p>")]
    return rows


def plain_pages(rows, least=0):
    leader, n = {}, Counter()
    for i, _, html in rows:
        html = html or ""
        n[html] += 1
        leader[html] = max((x for x in (leader.get(html), i) if x is not None), default=None)
    out = []
    for i, url, html in rows:
        b = (html or "").encode()
        response = len(b) < least or i == leader[html or ""]
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", None if response else leader[html or ""]))
    return sorted(out, key=repr)


def stored(spark, tmp_path, rows, least=0, **more):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("other") for c in ("payload", "n", "shared", "salt", "leader", "mark", "record_type")})
    path = str(tmp_path / "archive")
    warc.write_pages(df, path, least)
    return path


@pytest.mark.parametrize("least", [0, 14])
def test_pages_come_back(spark, tmp_path, least):
    path = stored(spark, tmp_path, pages(), least)
    got = warc.read_pages(spark, path)
    assert sorted((tuple(r)[:1] + tuple(r)[2:] for r in got.collect()), key=repr) == plain_pages(pages(), least)
    urls = {r.page_id: r.url for r in got.where("page_id > 99").collect()}
    assert urls[100] is None and urls[103] == "a%0D%0AWARC-Type: x%"
    html = {r.record_id: r.payload for r in spark.read.format("warc").load(path).where("record_type = 'response'").collect()}
    assert html["urn:page:104"] == b"ab\r\n\r\n" * 300_000 and html["urn:page:102"] == ("é" * 9).encode() and html["urn:page:101"] == b""


def test_salted_leaders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    path = stored(spark, tmp_path, pages())
    assert sorted((tuple(r)[:1] + tuple(r)[2:] for r in warc.read_pages(spark, path).collect()), key=repr) == plain_pages(pages())


def test_empty_pages(spark, tmp_path):
    assert warc.read_pages(spark, stored(spark, tmp_path, [])).collect() == []


def test_sql_agrees(spark, tmp_path):
    rows = pages()
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = entries.op11_warc(spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    rel = db.sql(sql.OP11)
    at = [rel.columns.index(c) for c in got.columns if c != "url"]
    assert sorted((tuple(r[c] for c in got.columns if c != "url") for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_predicates_are_pushed_down(spark, tmp_path):
    path = stored(spark, tmp_path, pages())
    everything = spark.read.format("warc").load(path)
    rows = [r.asDict() for r in everything.collect()]
    for condition, holds in {
        "record_type = 'revisit'": lambda r: r["record_type"] == "revisit",
        "target_uri like 'http://x%'": lambda r: (r["target_uri"] or "").startswith("http://x"),
        "target_uri is null": lambda r: r["target_uri"] is None,
        "not target_uri = 'u'": lambda r: r["target_uri"] is not None and r["target_uri"] != "u",
        "refers_to in ('urn:page:39', 'urn:page:38') and content_length > 10": lambda r: r["refers_to"] in ("urn:page:39", "urn:page:38") and r["content_length"] > 10,
        "record_type = 'response' and payload_length > 100": lambda r: r["record_type"] == "response" and r["payload_length"] > 100,
    }.items():
        df = everything.where(condition)
        assert sorted(r.at for r in df.collect()) == sorted(r["at"] for r in rows if holds(r)), condition
    scan = everything.where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (record_type" not in scan


class Counting(io.BytesIO):
    """A file that counts what is read of it."""

    total = 0

    def size(self):
        return len(self.getvalue())

    def read(self, n=-1):
        got = super().read(n)
        self.total += len(got)
        return got


def test_unwanted_payloads_are_skipped(monkeypatch):
    random_bytes = random.Random(1).randbytes(3 << 20)
    members = [warc.gzip_member(warc.record_bytes({"record_type": t, "record_id": f"r{i}", "payload": random_bytes}, "2024-01-01T00:00:00Z"), 1) for i, t in enumerate(["response", "resource", "response", "metadata"])]
    file = Counting(b"".join(members))
    inflated = []
    monkeypatch.setattr(warc.Member, "read", lambda self, n, f=warc.Member.read: inflated.append(x := f(self, n)) or x)
    found = list(warc.records(file, True, lambda h: h["warc-type"] == "resource", False, lambda h: True))
    assert [r.payload for r in found] == [random_bytes]
    assert sum(map(len, inflated)) < len(random_bytes) + 60_000
    assert file.total < 2 * len(members[0]) + 4 * warc.READ
    # the same records from a writer without skip lengths, and plain ones
    for packed, data in ((True, b"".join(gzip.compress(gzip.decompress(m)) for m in members)), (False, b"".join(map(gzip.decompress, members)))):
        rows = list(warc.records(Counting(data), packed, lambda h: True, True, lambda h: h["warc-type"] == "metadata"))
        assert [r.payload_length for r in rows] == [len(random_bytes)] * 4 and [r.payload is None for r in rows] == [True, True, True, False]


def test_other_writers_archives_and_damage(spark, tmp_path):
    warc.use_warc(spark)
    record = warc.record_bytes({"record_type": "resource", "record_id": "a", "payload": b"text", "content_type": "text/plain"}, "2024-01-01T00:00:00Z")
    (tmp_path / "sub").mkdir()
    (tmp_path / "x.warc").write_bytes(record * 3)
    (tmp_path / "sub" / "y.warc.gz").write_bytes(gzip.compress(record) * 2)
    (tmp_path / "note.txt").write_text("no archive")
    df = spark.read.format("warc").option("verify", "true").load(str(tmp_path))
    assert [(bytes(r.payload), r.content_type) for r in df.collect()] == [(b"text", "text/plain")] * 5
    assert spark.read.format("warc").schema("record_id string").load(str(tmp_path)).count() == 5
    (tmp_path / "x.warc").write_bytes(record.replace(b"text\r\n\r\n", b"tezt\r\n\r\n"))
    with pytest.raises(Exception, match="digest"):
        df.collect()
    (tmp_path / "x.warc").write_bytes(record[:-8])
    with pytest.raises(Exception, match="too early"):
        df.collect()


def test_only_committed_files_are_read(spark, tmp_path):
    path = stored(spark, tmp_path, pages()[:5])
    (tmp_path / "archive" / "part-lost.warc.gz").write_bytes(warc.gzip_member(warc.record_bytes({"record_type": "response", "payload": b"x"}, "d"), 1))
    assert warc.read_pages(spark, path).count() == 5
    warc.write_pages(spark.createDataFrame(pages()[5:7], "page_id long, url string, html string"), path)
    assert warc.read_pages(spark, path).count() == 7


# --- Merkle ---------------------------------------------------------------------------------


def merkle_docs():
    rows = [(i, f"text {i}" * (i % 5), ["en", "de", None, "日本"][min(i % 9, 3)], ["a", None][i % 2], i if i % 4 else None) for i in range(230)]
    rows += [(None, "x", "en", "s", 3), (None, None, "en", "s", 3), (5, "text 5", "en", "a", 1), (5, "text 5", "en", "a", 1), (7, "é" * 50_000, "zz", "", 2**63 - 1), (-3, "", "", "", 0)]
    return rows


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, text, lang, source, n):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def plain_root(level):
    """(root, for each leaf its siblings by level with the side they stand on)"""
    paths = [[] for _ in level]
    at = list(range(len(level)))
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // 2 * 2 : k // 2 * 2 + 2]
            paths[i].append((k % 2, run[1 - k % 2] if len(run) == 2 else None))
        at = [k // 2 for k in at]
        level = [h(*level[k : k + 2]) for k in range(0, len(level), 2)]
    return (level[0] if level else ""), paths


def plain_manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    members = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for x in langs}
    trees = {x: plain_root([leaf(*r) for r in members[x]]) for x in langs}
    root, upper = plain_root([trees[x][0] for x in langs])
    out = []
    for x, above in zip(langs, upper, strict=True):
        for r, path in zip(members[x], trees[x][1], strict=True):
            changed = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf(*r[:4], r[4] + 1) if changed else leaf(*r)
            for side, other in path + above:
                now = h(*[[now], [now, other], [other, now]][0 if other is None else 1 + side])
            out.append((r[0], leaf(*r), trees[x][0], root, h(*[o for _, o in path + above if o]), now, now == root))
    return sorted(out, key=repr)


def asked(df, bits):
    return merkle.digests(merkle.manifest(df, {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, bits))


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_manifest(spark, bits):
    df = spark.createDataFrame(merkle_docs(), DOCS).withColumns({c: F.lit("other") for c in ("key", "pos", "digest", "changed", "block", "root", "chain", "n")})
    got = asked(df.repartition(5), bits)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_manifest(merkle_docs())
    assert not got.where("verified").isEmpty() and not got.where("not verified").isEmpty()


def test_manifest_of_few(spark):
    for rows in ([], merkle_docs()[:1], merkle_docs()[:2], merkle_docs()[2:3] * 3):
        assert sorted(map(tuple, asked(spark.createDataFrame(rows, DOCS), 2).collect()), key=repr) == plain_manifest(rows)


def test_manifest_sql(spark, tmp_path):
    spark.createDataFrame(merkle_docs(), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(db.sql(sql.OP12).fetchall(), key=repr) == plain_manifest(merkle_docs())


def test_versions_share_what_they_do_not_copy(spark):
    rows = [r for r in merkle_docs() if r[2] == "en" and r[0] is not None][:40]
    df = spark.createDataFrame(rows, DOCS)
    got = merkle.manifest(df, {"n_chars": F.lit(-1)}, F.col("doc_id") == rows[7][0], 2).orderBy("pos").collect()
    base = [r for r in got if r.doc_id != rows[7][0]]
    changed = [r for r in got if r.doc_id == rows[7][0]]
    nodes = {x for r in base for x in r.version}
    assert all(len(r.version) == len(r.proof) + 1 for r in got)
    assert all(r.version[-1] == r.root for r in base)
    for r in changed:
        assert not nodes & set(r.version)  # leaf and ancestors are copies
        assert {s[1:] for s in r.proof if s != "-"} <= nodes  # all else is shared


# --- divergence -----------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audit_docs():
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdeéß漢XYZ") for _ in range(n)) for n in [1, 2, 3, 5, 7, 8, 9, 12, 15, 16, 17, 18, 31, 33, 40, 70, 200] for _ in range(4)]
    rows = []
    for i in range(400):
        lang = rnd.choice(["en", "en", "de", None])
        source = rnd.choice(["s0"] * 5 + [f"s{k}" for k in range(7)] + [None])
        words = rnd.choices(vocabulary, k=rnd.randint(0, 30))
        rows.append((i, rnd.choice([" ", "1", "-", "\n"]).join(words), lang, source, None))
    rows += [(None, "solo " * 3, "en", "null ids", None)] * 12 + [(1, None, "fr", "empty", None), (2, "", "fr", "also", None), (3, "rare", "xx", "one", None), (4, " ".join(vocabulary) * 300, "en", "long", None)]
    rows += [(5, "Ab\x00ab 9ab", "de", "", None), (6, "é" * 100_000, "de", "", None)]
    return rows


def plain_audit(rows, min_docs=10, top=10):
    docs = [(lang or "", source or "", [w.translate(LOWER) for w in TERM.findall(text or "")]) for _, text, lang, source, _ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for _, _, w in own for t in set(w))
        kept = sorted(t for t, n in held.items() if n >= min_docs)
        sources = sorted({d[1] for d in own})
        counts = {s: Counter(t for _, x, w in own if x == s for t in w) for s in sources}
        counts[None] = Counter(t for _, _, w in own for t in w)
        total = {s: sum(c[t] for t in kept) for s, c in counts.items()}
        p = {s: {t: 1 + int(Fraction(10**9 * (c[t] + 2), total[s] + 2 * len(kept))) for t in kept} for s, c in counts.items()}
        f = lambda x, y: int(Fraction((x - y) ** 2, x + y))
        for s in sources:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(f(p[s][t], p[None][t]), t) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize("tile, block_rows", [(128, 200_000), (2, 50)])
def test_audit(spark, tile, block_rows):
    df = spark.createDataFrame(audit_docs(), DOCS).withColumns({c: F.lit("other") for c in ("term", "n", "docs", "total", "at", "p", "q", "part", "item", "value", "rank")})
    got = divergence.audit(df.repartition(3), tile=tile, block_rows=block_rows)
    assert sorted(map(tuple, got.collect())) == plain_audit(audit_docs())


def test_audit_sql(spark, tmp_path):
    spark.createDataFrame(audit_docs(), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(db.sql(sql.OP13).fetchall()) == plain_audit(audit_docs())


def test_audit_of_few(spark):
    for rows in ([], audit_docs()[-6:-3], [(1, None, None, None, None)] * 2):
        assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, DOCS)).collect())) == plain_audit(rows)


def test_salted_shares(spark, monkeypatch):
    from ledgerloom.llm import joins

    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(audit_docs(), DOCS)).collect())) == plain_audit(audit_docs())


def test_term_counts_of_any_length():
    rnd = random.Random(2)
    lengths = [*range(1, 40), 64, 65, 500, 20_000]
    terms = ["".join(rnd.choice("ab") for _ in range(n)) for n in lengths]
    texts = [" ".join(rnd.choices(terms, k=60)) for _ in range(30)] + ["", None]
    group = np.array([i % 3 for i in range(len(texts))])
    got, docs = Counter(), Counter()
    for g, term, n, d in divergence.count_terms(pa.array(texts, pa.string()), group):
        for key, a, b in zip(zip(g.tolist(), term.to_pylist(), strict=True), n.tolist(), d.tolist(), strict=True):
            assert key not in got
            got[key], docs[key] = a, b
    assert got == Counter((i % 3, w) for i, t in enumerate(texts) for w in (t or "").split())
    assert docs == Counter((i % 3, w) for i, t in enumerate(texts) for w in set((t or "").split()))
