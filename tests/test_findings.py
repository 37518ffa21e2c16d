"""Cases that the reviews of rounds found."""

import os
import re
import tracemalloc

import duckdb
import numpy as np
import pytest

from ledgerloom.functions import variant
from ledgerloom.operators import entity_index as E
from ledgerloom.operators import text_index
from ledgerloom.operators import vector_index as V
from ledgerloom.plans import commands, model, registry, sales
from ledgerloom.session import saved, shared_dir

SF = "/root/testdata/sf0.001"


def both(spark, tables: dict[str, str], name: str) -> tuple[list, list]:
    """Rows of a query and of its SQL over tables of these files."""
    db = duckdb.connect()
    for t, path in tables.items():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    df = registry.queries()[name](spark, str(tables[next(iter(tables))]).rsplit("/", 1)[0])
    rel = db.sql(registry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in df.columns]
    return sorted((tuple(r) for r in df.collect()), key=repr), sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def written(folder, name: str, sql: str) -> dict[str, str]:
    path = f"{folder}/{name}.parquet"
    duckdb.connect().execute(f"COPY ({sql}) TO '{path}' (FORMAT parquet)")
    return {name: path}


def test_a_class_of_leads_takes_a_row_per_lead(spark):
    leads = [tuple(r) for r in model.lead(spark, SF).select("id", "email_from", "phone").collect()]
    rows = {r.lead_id: r for r in registry.queries()["lead_duplicates"](spark, SF).collect()}
    assert len(rows) == len(leads)
    for i, email, phone in leads[::10]:
        linked = {j for j, e, p in leads if j != i and (e == email or p == phone)}
        assert linked == {j for j, r in rows.items() if j != i and (r.email_class == rows[i].email_class or r.phone_class == rows[i].phone_class)}
        assert len(linked) == rows[i].same_email + rows[i].same_phone - rows[i].same_both


@pytest.mark.parametrize("name", ["chunk_sections", "chunk_windows"])
def test_windows_that_start_alike_keep_their_order(spark, tmp_path, name):
    # the short first sentence is a window by itself, and starts the one of the long sentence as well
    text = "'A short one stands here. ' || repeat('word ', 400) || i || '. And' || chr(160) || 'last' || chr(1) || 'ones.' || chr(160) || 'Here they are.' || chr(160) || chr(10) || chr(9) || 'x y z w'"
    tables = written(tmp_path, "documents", f"SELECT i AS doc_id, {text} AS text FROM range(3000) t(i)")
    got, want = both(spark, tables, name)
    assert got == want


def test_pairs_of_names_are_never_rows(spark):
    stored = spark.range(6000).selectExpr("id", "concat_ws(' ', 'large ring', 'a' || id % 9, 'b' || id div 9 % 9, 'c' || id div 81 % 9, 'd' || id div 729) as text")
    asked = stored.where("id % 15 = 0").selectExpr("id as query_id", "text")
    kept = shared_dir(spark)
    size = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(kept) for f in files)
    before = size()
    got = E.similar(asked, stored, 3).where("rank = 1").collect()
    assert [r.id for r in sorted(got)] == [r.query_id for r in sorted(got)] and len(got) == 400
    assert E.containing(asked, stored.withColumnRenamed("text", "name"), 5).where("id = query_id").count() == 400
    assert size() - before < 1 << 20  # 2.4 million pairs


def test_windows_of_calls_run_along(spark):
    plan = registry.queries()["budget_verdict"](spark, SF)._jdf.queryExecution().executedPlan().toString().lower()
    frames = plan.count("specifiedwindowframe(")
    assert frames and frames == plan.count("specifiedwindowframe(rangeframe, unboundedpreceding")  # none slides at both ends


def test_calls_of_one_instant_and_on_the_edges_of_windows(spark, tmp_path):
    # every second and every hour, twice each: calls lie exactly a minute and exactly a day apart
    at = "TIMESTAMP '2024-01-01' + to_seconds(CASE WHEN i % 3 = 0 THEN i // 2 ELSE i // 2 * 3600 END)"
    tables = written(tmp_path, "events", f"SELECT i AS event_id, {at} AS ts, i % 5 AS user_id, ['click', 'view', 'purchase', 'error'][i % 4 + 1] AS event_type, CASE WHEN i % 11 > 0 THEN i % 90 + 0.5 END AS value, '{{}}' AS props FROM range(900) t(i)")
    got, want = both(spark, tables, "budget_verdict")
    assert got == want


def test_more_lines_take_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(commands, "LINES_PER_TASK", 500)
    assert "hashpartitioning(order_id#" in (plan := registry.queries()["edit_lines_validate"](spark, SF)._jdf.queryExecution().executedPlan().toString())
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert f", {-(-lines // 500)})" in plan and f", {-(-lines // 500)}), REPARTITION_BY_NUM" in plan


def test_scores_of_a_block_take_little_memory():
    rng = np.random.default_rng(1)
    stored, asked = V.unit(rng.normal(size=(10000, 16))), V.unit(rng.normal(size=(500, 16)))
    tracemalloc.start()
    found = sum(len(ids) for _, ids, _ in V.best_of_block(asked, np.arange(500), stored, np.arange(10000), 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 2500 and peak < 32 << 20


def test_payloads_are_not_copied_level_by_level(spark):
    nest = lambda n, x: '{"a": ' + "[" * n + x + "]" * n + "}"
    cases = {
        nest(9, "1"): "ok", nest(10, "1"): "deep", nest(9, "[]"): "ok", nest(9, "[ { } ]"): "deep", nest(8, '{"b": 1}'): "ok", nest(9, '{"b": 1}'): "deep", nest(9, '{"B": {}}'): "deep",
        '{"a": "[[[[[[[[[[[[", "b": "]\\"}{:", "c": "x\\\\"}': "ok", '{"a": {"b c": "x"}}': "key", '{"a": "B\\":"}': "ok", '{"a\\"": 1}': "key", '{"\\u0061b": 1}': "ok", '{"\u00e9": 1}': "key", '{"": 1}': "key", '{"a\\n": 1}': "key",
        '{"a": "\\n", "b" : [ {"Z":1} ]}': "key", "[]": "ok", "[[], {}, [[]]]": "ok", '"a: \\"b\\":"': "ok", "3": "ok", "": "unreadable", '{"a": 1, "a": 2}': "unreadable", "[1": "unreadable", '{"A": ' + "[" * 12 + "1" + "]" * 12 + "}": "deep",
        '{"a": "' + "\\\\x" * 20000 + '"}': "ok", '{"a": 1} {"B": 1}': None,
    }
    rows = spark.createDataFrame([*cases.items(), (None, "unreadable")], "payload string, want string")
    found = variant.payload_verdicts(rows, "payload")
    assert [(r.payload, r.verdict) for r in found.collect() if r.want and r.verdict != r.want] == []
    assert "transform" not in found._jdf.queryExecution().executedPlan().toString().lower()


def test_postings_are_bytes_to_spark(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"common w{i % 40} v{i % 9} Odd\x0bone\x00 x{i}\r\n\t y  {'z ' * (i % 5)}") for i in range(300)], "doc_id long, text string")
    made = []
    monkeypatch.setattr(text_index, "saved", lambda df: made.append(saved(df)) or made[-1])
    index = text_index.build_text_index(docs)
    assert not any("array" in kind for _, kind in made[0].dtypes)  # no value of a posting is a field of Spark's rows
    asked = docs.where("doc_id % 50 = 0").selectExpr("doc_id as query_id", "text")
    got = {(r.query_id, r.doc_id): r.score for r in text_index.conjunctive(index, asked, 20).collect()}
    assert got == {(i, i): len([w for w in re.split("[ \t\n\r]+", t.lower()) if w]) for i, t in asked.collect()}


def test_every_pair_of_linked_leads_is_a_row(spark, monkeypatch):
    # one class larger than a square, leads without an address or a number, an id that stands twice
    leads = [(i, "a@x" if i % 3 else f"{i // 6}@x", f"+{i % 5}") for i in range(40)] + [(50, None, "+1"), (51, "a@x", None), (52, None, None), (50, None, "+1")]
    monkeypatch.setattr(model, "lead", lambda spark, d: spark.createDataFrame(leads, "id long, email_from string, phone string"))
    monkeypatch.setattr(sales, "CLASS_PIECE", 4)
    monkeypatch.setattr(sales, "TASK_PAIRS", 100)
    same = lambda x, y: None if x is None or y is None else x == y
    want = [(i, j, same(e, f), same(p, q)) for i, e, p in leads for j, f, q in leads if i != j and (same(e, f) or same(p, q))]
    got = [(r.lead_id, r.other_id, r.same_email, r.same_phone) for r in sales.lead_duplicates(spark, SF).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_names_and_questions_don_t_pile_up_in_the_driver(spark, monkeypatch):
    # files of this size are broadcast unless a join is told to merge
    plan = registry.queries()["resolve_autopick"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "BroadcastExchange" not in plan
    stored = spark.range(300).selectExpr("id", "concat('ring ', id % 7, ' x', id) as text")
    asked = stored.where("id % 15 = 0").selectExpr("id as query_id", "text")
    names = stored.withColumnRenamed("text", "name")
    found = lambda: [sorted(map(tuple, df.collect())) for df in (E.similar(asked, stored, 3), E.containing(asked, names, 2))]
    want = found()
    monkeypatch.setattr(E, "QUERY_BLOCK", 6)
    # a block is done before the next one's questions come to the driver
    assert all("MapInArrow" not in df._jdf.queryExecution().executedPlan().toString() for df in (E.similar(asked, stored, 3), E.containing(asked, names, 2)))
    assert found() == want and len(want[0]) == 60
