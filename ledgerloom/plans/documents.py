"""Document pipeline: blocks, sections, sentence windows, sheets, incremental ingest, mirrors."""

from __future__ import annotations

import bisect
import difflib
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions import variant
from ledgerloom.operators import model_hook as H
from ledgerloom.operators.ranks import placed
from ledgerloom.plans import model
from ledgerloom.plans.model import oracle
from ledgerloom.plans.registry import register
from ledgerloom.session import new_folder, table
from ledgerloom.sources import office
from ledgerloom.sources.store import ChunkStore, Mirror, sync

CHUNK_TOKENS, OVERLAP_TOKENS, SMALL_TOKENS = 400, 60, 80
SENTENCE_END = re.compile(r"(?<=[.!?…])\s+")
CRUMB = " › "
CHUNK_SCHEMA = "doc_id long, chunk_index long, section_path string, token_count long, chunk_text string"


def size_of(text: str) -> int:
    """Tokens of a text: a quarter of its characters, one at least."""
    return max(1, len(text) // 4)


def heading_starts(blocks: list[tuple[str, int | None]]) -> list[bool]:
    """Which blocks open a section: headings, but for one that follows a bare heading of its own or a lower rank,
    which stays text so that nothing is lost."""
    bare = None  # level of the heading just before, if nothing came after it yet
    starts = []
    for _, level in blocks:
        opens = level is not None and (bare is None or bare < level)
        starts.append(opens)
        bare = level if opens else None
    return starts


def sections(blocks: list[tuple[str, int | None]], title: str) -> Iterator[tuple[str, str]]:
    """(path of headings, body) of each leaf section, in order.

    The heads in force are kept by level; texts between two openings are one body.
    """
    heads: dict[int, str] = {}
    marked = zip(blocks, heading_starts(blocks), strict=True)
    for opens, run in itertools.groupby(marked, key=lambda x: x[1]):
        texts = [(text, level) for (text, level), _ in run]
        if not opens:
            yield CRUMB.join(heads[k] for k in sorted(heads)) or title, " ".join(t for t, _ in texts).strip()
            continue
        for text, level in texts:
            heads = {k: v for k, v in heads.items() if k < level} | {level: text}


def sentence_windows(text: str) -> Iterator[str]:
    """Whole sentences up to CHUNK_TOKENS; each window starts with the last sentences of the one before.

    With running sums over the sentences' sizes, a window's end and the place to carry on from are both found by search.
    """
    sentences = [x for x in SENTENCE_END.split(text.strip()) if x]
    upto = [0, *itertools.accumulate(map(size_of, sentences))]
    begin, done = 0, 0
    while done < len(sentences):
        # sentences that fit from begin on; one new sentence always goes in
        done = max(done + 1, bisect.bisect_right(upto, upto[begin] + CHUNK_TOKENS) - 1)
        yield " ".join(sentences[begin:done])
        begin = bisect.bisect_left(upto, upto[done] - OVERLAP_TOKENS)


def chunk_document(doc_id: int, blocks: list[tuple[str, int | None]], title: str) -> Iterator[tuple]:
    n = 0
    for path, body in sections(blocks, title):
        if not body:
            continue
        for piece in [body] if size_of(body) <= SMALL_TOKENS else sentence_windows(body):
            yield doc_id, n, path, size_of(piece), piece
            n += 1


def text_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, blocks(text, level)): lines of a text; short lines in capitals or of up to three words are headings."""
    line = F.filter(F.transform(F.split(F.replace("text", F.lit("\x00"), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    heading = lambda x: T.is_caps_heading(x) | (F.size(F.split(x, " ")) <= 3)
    blocks = F.transform(line, lambda x: F.struct(x.alias("text"), F.when(heading(x), 2).alias("level")))
    return docs.select("doc_id", blocks.alias("blocks"))


def chunk_documents(docs: DataFrame) -> DataFrame:
    """One row per chunk. A document's fold runs by itself, so documents spread over tasks without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for doc_id, blocks in zip(part["doc_id"], part["blocks"], strict=True):
                pairs = [(b["text"], None if b["level"] is None else int(b["level"])) for b in blocks]
                title = next((t for t, level in pairs if level), f"document {doc_id}")
                rows.extend(chunk_document(doc_id, pairs, title))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "section_path", "token_count", "chunk_text"])

    return text_blocks(docs).mapInPandas(run, CHUNK_SCHEMA)


#: White space as Python has it, for regular expressions of SQL.
_SPACE = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Lines; which of them open a section (of headings in a row every other one); sections' bodies; their sentences with running sums; and windows,
#: each from where at most OVERLAP_TOKENS of the one before are left. Windows go by their last sentence, as several may have one start.
_CHUNKS = rf"""WITH RECURSIVE b AS (SELECT doc_id, i, x, (upper(x) = x AND lower(x) <> x AND length(x) <= 80) OR len(string_split(x, ' ')) <= 3 AS head FROM (
    SELECT doc_id, unnest(t) AS x, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(0), ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS t FROM documents))),
h AS (SELECT *, head AND (i - coalesce(max(CASE WHEN NOT head THEN i END) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 2 = 1 AS opens FROM b),
s AS (SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY doc_id ORDER BY i) AS sec, min(i) FILTER (WHERE head) OVER (PARTITION BY doc_id) AS first FROM h),
p AS (SELECT doc_id, sec, coalesce(max(x) FILTER (WHERE opens), max(title), 'document ' || doc_id) AS path, regexp_replace(string_agg(x, ' ' ORDER BY i) FILTER (WHERE NOT opens), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS body
      FROM (SELECT *, max(CASE WHEN i = first THEN x END) OVER (PARTITION BY doc_id) AS title FROM s) GROUP BY 1, 2),
t AS (SELECT doc_id, sec, path, body, length(body) // 4 <= {SMALL_TOKENS} AS small, list_filter(string_split(regexp_replace(body, '([.!?…]){_SPACE}+', '\1' || chr(0), 'g'), chr(0)), lambda x: x <> '') AS ss FROM p WHERE body <> ''),
u AS (SELECT *, list_transform(range(0, len(ss) + 1), lambda k: coalesce(list_sum(list_transform(ss[1:k], lambda x: greatest(1, length(x) // 4))), 0)::BIGINT) AS upto FROM t),
w AS (SELECT doc_id, sec, 0::BIGINT AS a, greatest(1, len(list_filter(upto, lambda v: v <= {CHUNK_TOKENS})) - 1)::BIGINT AS z FROM u WHERE NOT small
      UNION ALL SELECT doc_id, sec, a, greatest(z + 1, len(list_filter(upto, lambda v: v <= upto[a + 1] + {CHUNK_TOKENS})) - 1)::BIGINT FROM (
          SELECT w.doc_id, w.sec, len(list_filter(upto, lambda v: v < upto[z + 1] - {OVERLAP_TOKENS}))::BIGINT AS a, z, upto FROM w JOIN u USING (doc_id, sec) WHERE z < len(ss))),
c AS (SELECT doc_id, sec, 0 AS z, path, body AS piece FROM u WHERE small UNION ALL SELECT doc_id, sec, z, path, array_to_string(ss[a + 1:z], ' ') FROM w JOIN u USING (doc_id, sec)),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec, z) - 1 AS chunk_index, path AS section_path, greatest(1, length(piece) // 4) AS token_count, piece AS chunk_text FROM c)"""


@register("chunk_sections", f"{_CHUNKS} SELECT doc_id, chunk_index, section_path, token_count, chunk_text FROM chunks")
def chunk_sections(spark: SparkSession, d: str) -> DataFrame:
    return chunk_documents(table(spark, d, "documents"))


@register("chunk_windows", f"{_CHUNKS} SELECT doc_id, chunk_index, token_count, section_path || ' ' || chunk_text AS index_text FROM chunks")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as they are indexed: the path of headings, then the body."""
    c = chunk_documents(table(spark, d, "documents"))
    return c.select("doc_id", "chunk_index", "token_count", F.concat_ws(" ", F.nullif("section_path", F.lit("")), F.nullif("chunk_text", F.lit(""))).alias("index_text"))


@register(
    "sheet_chunks",
    """SELECT id, row_range, chunk_text FROM (SELECT c_mktsegment AS id, 'schema' AS row_range, '[' || c_mktsegment || '] columns: name, balance' AS chunk_text FROM customer GROUP BY 1
    UNION ALL SELECT c_mktsegment, 'row ' || row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey), '[' || c_mktsegment || '] name: ' || c_name || CASE WHEN c_acctbal > 0 THEN ' | balance: ' || c_acctbal::DECIMAL(18,2) ELSE '' END FROM customer)""",
)
def sheet_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A sheet gives one chunk for its columns and one per row; empty cells are left out."""
    c = table(spark, d, "customer").withColumn("sheet", F.col("c_mktsegment"))
    head = F.concat(F.lit("["), F.col("sheet"), F.lit("] "))
    schema = c.select("sheet").distinct().select(F.col("sheet").alias("id"), F.lit("schema").alias("row_range"), F.concat(head, F.lit("columns: name, balance")).alias("chunk_text"))
    cells = F.concat_ws(" | ", F.concat(F.lit("name: "), "c_name"), F.when(F.col("c_acctbal") > 0, F.concat(F.lit("balance: "), F.col("c_acctbal").cast("decimal(18,2)").cast("string"))))
    rows = placed(c.select("sheet", "c_custkey", cells.alias("cells")), "sheet", ["c_custkey"]).withColumn("n", F.col("pos") + 1).select(F.col("sheet").alias("id"), F.concat(F.lit("row "), F.col("n").cast("string")).alias("row_range"), F.concat(head, "cells").alias("chunk_text"))
    return schema.unionByName(rows)


def incremental(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(doc_id, action): by content hash, what is new, changed, unchanged or gone. An empty fetch deletes nothing."""
    a = stored.select(F.col("doc_id").alias("old_id"), F.col("hash").alias("old_hash"))
    b = incoming.select(F.col("doc_id").alias("new_id"), F.col("hash").alias("new_hash"))
    if b.isEmpty():
        return a.select(F.col("old_id").alias("doc_id"), F.lit("unchanged").alias("action"))
    both = a.join(b, F.col("old_id") == F.col("new_id"), "full")
    action = F.when(F.col("old_id").isNull(), "new").when(F.col("new_id").isNull(), "delete").when(F.col("old_hash") != F.col("new_hash"), "replace").otherwise("skip")
    return both.select(F.coalesce("new_id", "old_id").alias("doc_id"), action.alias("action"))


@register(
    "doc_incremental",
    """SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'delete' WHEN o.h <> n.h THEN 'replace' ELSE 'skip' END AS action FROM
    (SELECT doc_id, sha256(regexp_replace(text, '\n[^\n]*$', '')) AS h FROM documents WHERE lang <> 'es') o FULL JOIN (SELECT doc_id, sha256(text) AS h FROM documents WHERE lang <> 'fr') n ON o.doc_id = n.doc_id""",
)
def doc_incremental(spark: SparkSession, d: str) -> DataFrame:
    return incremental(earlier_documents(spark, d).select("doc_id", "hash"), hashed(table(spark, d, "documents").where("lang <> 'fr'")).select("doc_id", "hash"))


def hashed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


def earlier_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents as they were before: without their last lines, and those of one language not yet there."""
    docs = table(spark, d, "documents").where("lang <> 'es'")
    return hashed(docs.withColumn("text", F.regexp_replace("text", r"\n[^\n]*\z", "")))


def line_chunks(docs: DataFrame) -> DataFrame:
    """A chunk per line that isn't empty."""
    return docs.select("doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("chunk_index", "chunk_text"))


@register(
    "doc_replace",
    """SELECT doc_id, i - 1 AS chunk_index, md5(chunk) AS chunk_md5, version FROM (
    SELECT doc_id, unnest(t) AS chunk, unnest(range(1, len(t) + 1)) AS i, CASE WHEN lang <> 'es' AND NOT contains(text, chr(10)) THEN 1 ELSE 2 END AS version
    FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS t FROM documents WHERE lang <> 'fr'))""",
)
def doc_replace(spark: SparkSession, d: str) -> DataFrame:
    """The store after the documents came again: changed ones with new chunks, others with those that they had, and without what is gone."""
    store = ChunkStore(spark, new_folder(spark, "store"))
    store.replace(earlier_documents(spark, d), line_chunks)
    now = hashed(table(spark, d, "documents").where("lang <> 'fr'"))
    store.replace(now, line_chunks)
    store.drop_missing(now)
    return store.chunks().select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5(F.col("chunk_text").cast("binary")).alias("chunk_md5"), "version")


def letter_model() -> H.Model:
    """Stands in for an embedding model: a text's length and how many of its letters are e and n, alike for documents and questions."""
    return lambda texts, role: [[float(len(t)), float(t.count("e")), float(t.count("n"))] for t in texts]


@register(
    "embedded_chunks",
    """SELECT doc_id, i - 1 AS chunk_index, length(c) AS size, length(c) - length(replace(c, 'e', '')) AS n_e, length(c) - length(replace(c, 'n', '')) AS n_n FROM (
    SELECT doc_id, unnest(t) AS c, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS t FROM documents))""",
)
def embedded_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with their vectors, batch by batch, from a model that must answer for every text."""
    chunks = line_chunks(table(spark, d, "documents"))
    rows = H.embedded(chunks, "letters", letter_model, "chunk_text", 3)
    value = lambda i: F.get("embedding", i).cast("long")
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), value(0).alias("size"), value(1).alias("n_e"), value(2).alias("n_n"))


@register("mirror_sync", "SELECT p_partkey AS id, CASE WHEN p_size <= 5 THEN 'delete' WHEN p_size >= 45 THEN 'insert' ELSE 'update' END AS action FROM part")
def mirror_sync(spark: SparkSession, d: str) -> DataFrame:
    """What a second run over the source's pages changes in a mirror: upserts of all it brings, deletes of what it no longer has."""
    base = new_folder(spark, "mirror")
    mirror = Mirror(spark, f"{base}/rows")
    pages = spark.readStream.schema(table(spark, d, "part").schema).option("pathGlobFilter", "part.parquet").parquet(d)
    records = lambda condition: pages.where(condition).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    sync(records("p_size < 45"), mirror, "first", f"{base}/first")
    before = mirror.log.version()
    sync(records("p_size > 5"), mirror, "second", f"{base}/second")
    return mirror.changes(before, mirror.log.version())


#: Customers per office file.
FILE_CUSTOMERS = 500


def write_customer_files(spark: SparkSession, d: str, path: str) -> None:
    """A document and a workbook for each nation's customers, FILE_CUSTOMERS keys to a file."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = table(spark, d, "customer").join(F.broadcast(nations), "c_nationkey")  # nations are few, whatever the customers
    c = c.select("c_nationkey", "n_name", F.floor(F.col("c_custkey") / FILE_CUSTOMERS).alias("part"), "c_custkey", "c_name", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("balance"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("c_custkey")
        store, inner, _ = office.store_at(path)
        name = f"{inner}/{key[0]}-{key[2]}"
        store.create_dir(inner, recursive=True)
        for kind, content in (
            ("docx", office.docx_file([(key[1], 1), *((f"{n} owes {b}" if b else n, None) for n, b in zip(rows["c_name"], rows["balance"], strict=True))])),
            ("xlsx", office.xlsx_file({key[1]: [["name", "balance"], *rows[["c_name", "balance"]].values.tolist()]})),
        ):
            with store.open_output_stream(f"{name}.{kind}", compression=None) as f:
                f.write(content)
        return pd.DataFrame({"name": [name]})

    c.groupBy("c_nationkey", "n_name", "part").applyInPandas(run, "name string").write.format("noop").mode("overwrite").save()


@register(
    "office_files",
    f"""WITH c AS (SELECT c_nationkey || '-' || c_custkey // {FILE_CUSTOMERS} AS file, n_name, c_name, CASE WHEN c_acctbal > 0 THEN c_acctbal::DECIMAL(18,2)::VARCHAR END AS balance,
        row_number() OVER (PARTITION BY c_nationkey, c_custkey // {FILE_CUSTOMERS} ORDER BY c_custkey) AS position FROM customer JOIN nation ON n_nationkey = c_nationkey)
    SELECT file || '.docx' AS file, 0 AS position, n_name AS text, 1 AS heading_level, NULL AS sheet, NULL AS cells FROM c GROUP BY file, n_name
    UNION ALL SELECT file || '.docx', position, c_name || coalesce(' owes ' || balance, ''), NULL, NULL, NULL FROM c
    UNION ALL SELECT file || '.xlsx', position, NULL, NULL, n_name, c_name || coalesce('|' || balance, '') FROM c""",
)
def office_files(spark: SparkSession, d: str) -> DataFrame:
    """A folder of documents and workbooks, read at once by extension."""
    path = new_folder(spark, "office")
    write_customer_files(spark, d, path)
    office.use_office(spark)
    rows = spark.read.format("office").load(path)
    return rows.select(F.substring_index("path", "/", -1).alias("file"), "position", "text", "heading_level", "sheet", F.array_join("cells", "|").alias("cells"))


@register("embedding_guard", "SELECT label, COUNT(*) AS n, MIN(len(embedding)) AS dim, MIN(len(embedding)) = 64 AND MAX(len(embedding)) = 64 AS ok FROM embeddings GROUP BY 1")
def embedding_guard(spark: SparkSession, d: str, dim: int = 64) -> DataFrame:
    """Vectors of another dimension must fail loudly before anything is scored."""
    n = F.size("embedding").cast("long")
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min(n).alias("dim"), ((F.min(n) == dim) & (F.max(n) == dim)).alias("ok"))


@register("document_hashes", "SELECT doc_id, sha256(text) AS hash, substr(sha1(text), 1, 16) AS short_hash FROM documents")
def document_hashes(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("text").cast("binary")
    return table(spark, d, "documents").select("doc_id", F.sha2(b, 256).alias("hash"), F.substring(F.sha1(b), 1, 16).alias("short_hash"))


@register("difflib_ratio")
def difflib_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Ratcliff-Obershelp ratio of each part's name and its type, two decimals."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio(), 2) for x, y in zip(a, b, strict=True)])

    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), ratio("p_name", "p_type").alias("ratio"))


@register(
    "args_match",
    "SELECT event_id, (props::JSON->>'k')::BIGINT = floor(abs(value))::BIGINT % 100 AS matches FROM events",
)
def args_match(spark: SparkSession, d: str) -> DataFrame:
    """Do the arguments of each event hold what is expected: its kind in any spelling, and the number of its properties, also as text?"""
    e = table(spark, d, "events")
    number = F.floor(F.abs("value")).cast("long") % 100
    expected = F.to_json(F.struct(F.upper("event_type").alias("kind"), F.array(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"))).alias("args")))
    got = F.to_json(F.struct(F.concat(F.lit(" "), "event_type").alias("kind"), F.array(F.struct(number.cast("string").alias("k"), F.lit(1).alias("more"))).alias("args"), F.col("user_id").alias("user")))
    return variant.matches(e.select("event_id", expected.alias("expected"), got.alias("got")), "expected", "got").select("event_id", "matches")


@register(
    "payload_check",
    """SELECT doc_id, CASE WHEN n + 1 + (len(w) > 0)::INT > 10 THEN 'deep' WHEN len(list_filter(w, lambda x: NOT regexp_full_match(x, '[a-z_][a-z0-9_]*'))) > 0 THEN 'key' ELSE 'ok' END AS verdict
    FROM (SELECT doc_id, list_distinct(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda w: w <> '')) AS w, least(len(text) - len(replace(text, chr(10), '')), 20) AS n FROM documents)""",
)
def payload_check(spark: SparkSession, d: str) -> DataFrame:
    """Payloads with a document's words as keys, as deep as it has lines (up to twenty): are they ones to take?"""
    words = F.array_distinct(F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda w: w != ""))
    keys = F.to_json(F.map_from_arrays("words", F.transform("words", lambda w: F.lit(1))))
    n = F.least(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(20))
    payload = F.concat(F.lit('{"lines": '), F.repeat(F.lit("["), n), keys, F.repeat(F.lit("]"), n), F.lit("}"))
    docs = table(spark, d, "documents").withColumn("words", words).select("doc_id", payload.alias("payload"))
    return variant.payload_verdicts(docs, "payload").select("doc_id", "verdict")


@register("discontinued_lots", oracle("SELECT q.product_id FROM (SELECT DISTINCT product_id FROM quant) q LEFT JOIN (SELECT DISTINCT product_id FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id WHERE o.date_order >= TIMESTAMP '2001-01-01') l USING (product_id) WHERE l.product_id IS NULL", "quant", "sale_order_line", "sale_order"))
def discontinued_lots(spark: SparkSession, d: str) -> DataFrame:
    """Products in stock that no order of this year asks for."""
    stored = model.quant(spark, d).select("product_id").distinct()
    orders = model.sale_order(spark, d).where("date_order >= timestamp_ntz '2001-01-01'").select(F.col("id").alias("order_id"))
    asked = model.sale_order_line(spark, d).join(orders, "order_id").select("product_id")
    return stored.join(asked, "product_id", "left_anti")
