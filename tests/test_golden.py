"""Small literal cases that random data never hits."""

import io
import json
import zipfile
import unicodedata

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions import variant
from ledgerloom.operators import domain
from ledgerloom.plans import documents, ledger, retrieval, supply
from ledgerloom.sources import files


def test_reorder(spark):
    rules = spark.createDataFrame([(1, 5, 10), (2, 5, 10), (3, 0, 4), (4, 5, 5)], "product_id long, product_min_qty int, product_max_qty int")
    stock = spark.createDataFrame([(2, 8), (3, 0), (4, 5)], "product_id long, on_hand int")
    assert [(r.product_id, int(r.suggested)) for r in supply.reorder(rules, stock).collect()] == [(1, 10)]


def test_rrf_order(spark):
    rows = [(0, 9, 1), (0, 5, 2), (1, 9, 1), (1, 7, 2)]
    ranks = spark.createDataFrame(rows, "channel int, id long, rank long").withColumns({"q": F.lit(1), "score": F.lit(1.0)})
    out = retrieval.fuse(ranks, ["q"]).orderBy("pos").collect()
    assert [r.id for r in out] == [9, 5, 7]
    assert all(r.rrf <= 2 / 61 for r in out)


def test_fold(spark):
    row = spark.range(1).select(T.fold(F.lit("Đèn LED  chống  cận")).alias("x")).first()
    assert row.x == "den led chong can"


def test_composed_and_decomposed_spellings_fold_alike(spark):
    samples = ["Đèn LED  chống  cận", "Straße", "Ångström İ K", "한국어 각", "ｶﾞ が ガ", "\u09cb \u0dde \u1026 \u0344x", "tiếng Việt\u00a0ở\u2003đây\x1f!", "Ǖ ẛ̣ ơ̛", "𝅗𝅥 豈", "plain", "", None]
    forms = [(i, form, unicodedata.normalize(form, t) if t else t) for i, t in enumerate(samples) for form in ("NFC", "NFD", "NFKC", "NFKD")]

    def plain(t):
        t = unicodedata.normalize("NFD", t.replace("đ", "d").replace("Đ", "D"))
        return " ".join("".join(c for c in t if not unicodedata.combining(c)).lower().split())

    got = {(r.i, r.form): r.x for r in spark.createDataFrame(forms, "i long, form string, t string").select("i", "form", T.fold(F.col("t")).alias("x")).collect()}
    assert got == {(i, form): None if t is None else plain(t) for i, form, t in forms}
    for i in range(len(samples)):
        assert got[i, "NFC"] == got[i, "NFD"]


def test_domain(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, s string")
    pick = lambda d: sorted(r.id for r in df.where(domain.compile_domain(d)).collect())
    assert pick(["|", ("s", "=", "a"), ("id", ">", 2)]) == [1, 3]
    assert pick([("s", "not in", ["a"])]) == [2]
    assert pick([("s", "=", None)]) == [3]
    assert pick([("id", ">", domain.SKIP)]) == [1, 2, 3]
    assert pick(["!", ("id", "=", 2), ("s", "ilike", "A")]) == [1]
    with pytest.raises(ValueError):
        domain.compile_domain([("id", "like", "x")])
    with pytest.raises(PermissionError):
        domain.check_call("partner", "unlink")
    assert domain.clamp(None) == domain.clamp(1000) == 100


def test_consecutive_headings_keep_text():
    blocks = [("A", 1), ("B", 1), ("body", None), ("C", 2), ("more", None)]
    assert list(documents.sections(blocks, "t")) == [("A", "B body"), ("A › C", "more")]
    assert list(documents.sections([("only", None)], "title")) == [("title", "only")]


def test_windows_never_split_sentences():
    text = " ".join(f"Sentence number {i} has some words in it." for i in range(200))
    windows = list(documents.sentence_windows(text))
    assert len(windows) > 1 and all(w.endswith(".") for w in windows)
    assert all(w.startswith("Sentence") for w in windows)
    assert windows[1].split(". ")[0] in windows[0]


def test_admission(spark):
    t0 = datetime(2024, 1, 1)
    calls = [(1, t0 + timedelta(seconds=s), i) for i, s in enumerate([0, 1, 2, 30, 61, 62, 63])]
    out = ledger.admit(spark.createDataFrame(calls, "caller long, ts timestamp_ntz, event_id long"), 3, 60)
    assert [r.admitted for r in out.orderBy("event_id").collect()] == [True, True, True, False, True, True, True]


def test_chain_reports_the_row_that_was_changed(spark):
    rows = spark.createDataFrame([(1, i, datetime(2024, 1, 1, 0, 0, i), "call", 7, "t") for i in range(6)], "chain long, id long, ts timestamp_ntz, event_type string, caller long, tool_name string")
    linked = ledger.append_chain(rows)
    assert ledger.verify_chain(linked).first().reason == "OK"
    forged = linked.withColumn("tool_name", F.when(F.col("id") == 3, "x").otherwise(F.col("tool_name")))
    bad = ledger.verify_chain(forged).first()
    assert (bad.broken_at, bad.reason) == (3, "entry_hash")
    cut = linked.where("id <> 2")
    assert (ledger.verify_chain(cut).first().broken_at, ledger.verify_chain(cut).first().reason) == (3, "prev_hash")


def test_args(spark):
    cases = [({"a": 1, "b": [{"c": "X y"}]}, {"a": "1.0", "b": [{"c": "x  Y", "d": 2}], "e": 0}, True), ({"b": [1, 2]}, {"b": [1]}, False), ({"a": 1}, None, False)]
    df = spark.createDataFrame([(json.dumps(a), json.dumps(b), want) for a, b, want in cases], "a string, b string, want boolean")
    assert all(r.matches == r.want for r in variant.matches(df, "a", "b").collect())


def test_empty_fetch_deletes_nothing(spark):
    stored = spark.createDataFrame([(1, "x")], "doc_id long, hash string")
    out = documents.incremental(stored, stored.limit(0)).collect()
    assert [(r.doc_id, r.action) for r in out] == [(1, "unchanged")]


def test_office_files(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    doc = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body </w:t></w:r><w:r><w:t>text</w:t></w:r></w:p><w:p/></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", doc)
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}"><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>name</t></si><si><t>qty</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row/><row><c r="B3"><v>5</v></c></row></sheetData></worksheet>')
    blocks = files.read_docx(spark, str(tmp_path)).orderBy("position").collect()
    assert [(b.text, b.heading_level) for b in blocks] == [("Title", 2), ("Body text", None)]
    rows = files.read_xlsx(spark, str(tmp_path)).collect()
    assert [(r.sheet, r.columns, r.cells) for r in rows] == [("S", ["name", "qty"], [None, "5"])]
    assert io.BytesIO(b"")


def test_upsert(spark, tmp_path):
    p = str(tmp_path / "mirror")
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string").write.parquet(p)
    fresh = spark.createDataFrame([(2, "B"), (3, "c")], "id long, v string")
    v1 = files.upsert(spark, p, fresh, "id")
    assert sorted(map(tuple, spark.read.parquet(v1).select("id", "v").collect())) == [(1, "a"), (2, "B"), (3, "c")]
    v2 = files.upsert(spark, v1, fresh.limit(0), "id", delete_missing=True)
    assert spark.read.parquet(v2).count() == 3
    assert spark.read.parquet(files.upsert(spark, v2, fresh, "id", delete_missing=True)).count() == 2


def test_stream_equals_batch(spark):
    from ledgerloom.streaming import ledgers

    d = "/root/testdata/sf0.001"
    batch = {r.event_id: r.admitted for r in ledger.rate_limit_admit(spark, d).collect()}
    assert {r.event_id: r.admitted for r in ledgers.stream_rate_limit(spark, d).collect()} == batch


def test_consent(spark):
    from ledgerloom.plans import language

    said = {
        "confirm": ["có", "Có", "có!", "yes", "ok", "đồng ý", "xác nhận", "ừ làm đi"],
        "cancel": ["không", "Không", "no", "hủy", "thôi", "đừng", "thôi khỏi"],
        "unclear": ["không đồng ý", "nó sẽ làm gì?", "ừm", "um", "ừm để tôi xem lại đã, chưa chắc lắm"],
    }
    rows = spark.createDataFrame([(v, t) for v, texts in said.items() for t in texts], "want string, text string")
    assert [(r.text, r.got) for r in rows.withColumn("got", language.consent(F.col("text"))).collect() if r.got != r.want] == []
