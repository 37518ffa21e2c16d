"""Smaller semantics: selections, line matching, formats, picks among sources of a number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.plans import model
from ledgerloom.plans.model import oracle
from ledgerloom.plans.registry import register
from ledgerloom.session import table


@register(
    "selection_parse",
    """SELECT conv_id, turn, CASE WHEN number BETWEEN 1 AND len(names) THEN number WHEN list_position(names, r) > 0 THEN list_position(names, r) WHEN len(part) = 1 THEN part[1] END::INT AS picked FROM (
    SELECT *, try_cast(CASE WHEN regexp_full_match(r, '[0-9]+') THEN r END AS INT) AS number, list_filter(range(1, len(names) + 1), lambda i: contains(names[i], r)) AS part FROM (
    SELECT u.conv_id, u.turn, list_filter(string_split(lower(string_split(a.text, chr(10))[1]), ' '), lambda w: w <> '') AS names,
        CASE WHEN length(u.text) % 3 = 0 THEN (length(u.text) % 7)::VARCHAR ELSE rtrim(lower(trim(string_split(u.text, ' ')[-1])), '.') END AS r
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn - 1 WHERE u.role = 'user' AND a.role = 'assistant'))""",
)
def selection_parse(spark: SparkSession, d: str) -> DataFrame:
    """A reply to an answer picks one of the names in its first line: by number, by exact name, or by a part of just one name; else nothing."""
    c = table(spark, d, "conversations")
    offered = c.where("role = 'assistant'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.filter(F.split(F.lower(F.split("text", "\n")[0]), " "), lambda w: w != "").alias("names"))
    last = F.rtrim(F.lower(F.trim(F.element_at(F.split("text", " "), -1))), F.lit("."))
    reply = F.when(F.length("text") % 3 == 0, (F.length("text") % 7).cast("string")).otherwise(last)
    rows = c.where("role = 'user'").select("conv_id", "turn", reply.alias("r")).join(offered, ["conv_id", "turn"])
    number = F.when(F.col("r").rlike("^[0-9]+$"), F.expr("try_cast(r as int)"))
    exact = F.array_position("names", F.col("r"))
    partial = F.filter(F.transform("names", lambda n, i: F.when(F.contains(n, F.col("r")), i + 1)), lambda i: i.isNotNull())
    picked = F.when(number.between(1, F.size("names")), number).when(exact > 0, exact.cast("int")).when(F.size(partial) == 1, F.get(partial, 0))
    return rows.select("conv_id", "turn", picked.alias("picked"))


@register(
    "line_match",
    oracle("SELECT order_id, COUNT(*) FILTER (WHERE contains(p.name, 'red')) AS hits, CASE COUNT(*) FILTER (WHERE contains(p.name, 'red')) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS verdict FROM sale_order_line l JOIN product p ON p.id = l.product_id GROUP BY 1", "sale_order_line", "product"),
)
def line_match(spark: SparkSession, d: str) -> DataFrame:
    p = model.product(spark, d).select(F.col("id").alias("product_id"), "name")
    hits = F.count_if(F.contains("name", F.lit("red")))
    g = model.sale_order_line(spark, d).join(p, "product_id").groupBy("order_id").agg(hits.alias("hits"))
    return g.withColumn("verdict", F.when(F.col("hits") == 0, "none").when(F.col("hits") == 1, "one").otherwise("many"))


@register("usage_pick", "SELECT conv_id, turn, coalesce(nullif(CASE WHEN role = 'assistant' THEN length(text) // 4 END, 0), nullif(CASE WHEN contains(text, ',') THEN len(string_split(text, ',')) END, 0), len(string_split(text, ' ')) + len(string_split(text, chr(10)))) AS tokens FROM conversations")
def usage_pick(spark: SparkSession, d: str) -> DataFrame:
    """The provider's total (of answers), else the reported one (by their commas), else both parts added; 0 counts as missing."""
    parts = lambda mark: F.size(F.split("text", mark)).cast("long")
    given = F.nullif(F.when(F.col("role") == "assistant", F.floor(F.length("text") / 4)), F.lit(0))
    reported = F.nullif(F.when(F.contains("text", F.lit(",")), parts(",")), F.lit(0))
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(given, reported, parts(" ") + parts("\n")).alias("tokens"))


@register("flatten_blocks", "SELECT conv_id, turn, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: ends_with(x, '.') AND NOT contains(x, ',')), '')) AS text_md5 FROM conversations")
def flatten_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Of an answer's blocks, here its lines, only the texts count; thoughts (with a comma) and unknown kinds (without an end) go."""
    kind = lambda x: F.when(F.contains(x, F.lit(",")), "thinking").when(F.endswith(x, F.lit(".")), "text").otherwise("image")
    blocks = F.transform(F.split("text", "\n"), lambda x: F.struct(kind(x).alias("type"), x.alias("text")))
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"])
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(F.array_join(texts, "").cast("binary")).alias("text_md5"))


@register("honorific_strip", "SELECT c_custkey AS id, length(c_name) + CASE WHEN c_acctbal < 0 THEN 4 WHEN c_mktsegment = 'BUILDING' THEN 5 ELSE 0 END AS said, c_name AS name FROM customer")
def honorific_strip(spark: SparkSession, d: str) -> DataFrame:
    """Forms of address before a name don't belong to it."""
    said = F.concat(F.when(F.col("c_acctbal") < 0, "Chị ").when(F.col("c_mktsegment") == "BUILDING", " ông ").otherwise(""), "c_name")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.length(said).cast("long").alias("said"), F.regexp_replace(said, r"(?iu)^\s*(anh|chị|ông|bà|em)\s+", "").alias("name"))


@register("recipients", r"SELECT doc_id, array_to_string(list_concat([source || '@example.org'], regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')), ',') AS recipients FROM documents WHERE source IS NOT NULL")
def recipients(spark: SparkSession, d: str) -> DataFrame:
    """A partner's address and those written in a text, in one list."""
    typed = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), F.lit(0))
    docs = table(spark, d, "documents").where("source is not null")
    return docs.select("doc_id", F.array_join(F.concat(F.array(F.concat("source", F.lit("@example.org"))), typed), ",").alias("recipients"))


@register("draft_total", oracle("SELECT order_id, CASE WHEN bool_or(p.size > 48) THEN NULL ELSE SUM(price_subtotal) END AS total FROM sale_order_line l JOIN product p ON p.id = l.product_id GROUP BY 1", "sale_order_line", "product"))
def draft_total(spark: SparkSession, d: str) -> DataFrame:
    """A draft with a line whose product has no price (the largest ones) has no total."""
    p = model.product(spark, d).select(F.col("id").alias("product_id"), (F.col("size") > 48).alias("unpriced"))
    lines = model.sale_order_line(spark, d).join(p, "product_id")
    return lines.groupBy("order_id").agg(F.when(F.bool_or("unpriced"), F.lit(None)).otherwise(F.sum("price_subtotal")).alias("total"))


@register("reverified_candidates", oracle("SELECT categ, rank, id, name FROM (SELECT *, row_number() OVER (PARTITION BY categ ORDER BY list_price DESC, id) AS rank FROM product) WHERE rank <= 20 AND size > 5", "product"))
def reverified_candidates(spark: SparkSession, d: str) -> DataFrame:
    """An index proposes ids in an order; live rows supply the values, and what they lack drops out."""
    p = model.product(spark, d)
    rank = F.row_number().over(Window.partitionBy("categ").orderBy(F.desc("list_price"), "id"))
    proposed = p.select("categ", "id", rank.cast("long").alias("rank")).where("rank <= 20")
    return proposed.join(p.where("size > 5").select("id", "name"), "id").select("categ", "rank", "id", "name")


@register("expected_ids", oracle("SELECT p.id, COUNT(*) AS n FROM product p JOIN sale_order_line l ON 'P' || l.product_id = p.default_code GROUP BY 1", "product", "sale_order_line"))
def expected_ids(spark: SparkSession, d: str) -> DataFrame:
    """Codes of cases resolved to ids."""
    codes = model.sale_order_line(spark, d).select(F.concat(F.lit("P"), F.col("product_id").cast("string")).alias("code"))
    return model.product(spark, d).select("id", "default_code").join(codes, F.col("code") == F.col("default_code")).groupBy("id").agg(F.count("*").alias("n"))


@register("number_format", "SELECT o_orderkey AS id, format('{:,}', round(o_totalprice)::BIGINT) AS shown FROM orders")
def number_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.format_number(F.round("o_totalprice").cast("long"), 0).alias("shown"))


@register("canonical_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END || '+00:00' AS at FROM events")
def canonical_times(spark: SparkSession, d: str) -> DataFrame:
    """UTC times as they are hashed; whole seconds show no fraction."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")) % 1_000_000
    fraction = F.when(micros == 0, "").otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return table(spark, d, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00")).alias("at"))


@register("source_labels", "SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS base, array_to_string(string_split(regexp_replace(url, '^https?://', ''), '/')[1:2], ' › ') AS crumb FROM pages")
def source_labels(spark: SparkSession, d: str) -> DataFrame:
    """Last part of a path, and a trail of its first parts."""
    base = F.element_at(F.split(F.regexp_replace("url", "[?#].*$", ""), "/"), -1)
    crumb = F.array_join(F.slice(F.split(F.regexp_replace("url", "^https?://", ""), "/"), 1, 2), " › ")
    return table(spark, d, "pages").select("page_id", base.alias("base"), crumb.alias("crumb"))


@register("legacy_resolve", "SELECT c_nationkey AS nation, COUNT(*) AS n, COUNT(*) FILTER (WHERE lower(trim(c_name)) = 'customer#00000001') AS exact, COUNT(*) > 1 AND COUNT(*) FILTER (WHERE lower(trim(c_name)) = 'customer#00000001') <> 1 AS ask FROM customer GROUP BY 1")
def legacy_resolve(spark: SparkSession, d: str, name: str = "customer#00000001") -> DataFrame:
    """Several candidates need a choice, unless exactly one is the name itself."""
    exact = F.count_if(F.lower(F.trim("c_name")) == name)
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), exact.alias("exact"), ((F.count("*") > 1) & (exact != 1)).alias("ask"))


def missing_fields(spark: SparkSession, d: str, named: dict[str, list[str]]) -> list[tuple[str, str]]:
    """Fields that fixtures name but the entities don't have; a check of schemas, which reads no rows."""
    return [(e, f) for e, fields in named.items() for f in fields if f not in model.ENTITIES[e](spark, d).columns]


@register("best_pick", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, value DESC, event_id) AS rn FROM events) WHERE rn = 1")
def best_pick(spark: SparkSession, d: str) -> DataFrame:
    """The exact hit first, else the best."""
    first = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(F.col("event_type") == "purchase"), F.desc("value"), "event_id"))
    return table(spark, d, "events").select("user_id", "event_id", first.alias("rn")).where("rn = 1").drop("rn")
