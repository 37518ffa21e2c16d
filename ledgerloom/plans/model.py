"""The business entities, derived from the given tables; each once as a DataFrame and once as oracle SQL.

Keys start at 0 and line numbers repeat, so lines have no key of their own. No derivation looks at the
current time: every date-relative query takes an explicit as_of.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import table

AS_OF = "2001-06-01"


def money(c: Column | str, scale: int = 2) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal(18,{scale})")


def padded(prefix: str, key: Column) -> Column:
    text = key.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < 5, F.lpad(text, 5, "0")).otherwise(text))


def partner(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_mktsegment", money("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation_id"))


def vendor(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(1).alias("supplier_rank"), F.col("s_nationkey").alias("nation_id"))


def product(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("default_code"),
        F.regexp_extract("p_brand", "([0-9]+)", 1).cast("bigint").alias("product_tmpl_id"),
        F.col("p_type").alias("categ"),
        money("p_retailprice").alias("list_price"),
        F.col("p_size").alias("size"),
    )


def sale_order(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "sale").when(F.col("o_orderstatus") == "F", "done").otherwise("draft")
    return o.select(
        F.col("o_orderkey").alias("id"),
        padded("S", F.col("o_orderkey")).alias("name"),
        F.col("o_custkey").alias("partner_id"),
        F.col("o_orderdate").alias("date_order"),
        state.alias("state"),
        money("o_totalprice").alias("amount_total"),
    )


def sale_order_line(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    return x.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        money("l_quantity").alias("qty"),
        money(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("price_subtotal"),
    )


def purchase_line(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    q = money("l_quantity")
    return x.select(
        (F.col("l_orderkey") * 100000 + F.col("l_suppkey")).alias("order_id"),
        F.col("l_suppkey").alias("partner_id"),
        F.col("l_partkey").alias("product_id"),
        q.alias("product_qty"),
        F.when(F.col("l_linestatus") == "F", q).otherwise(money(F.lit(0))).alias("qty_received"),
        F.when(F.col("l_returnflag") != "N", q).otherwise(money(F.lit(0))).alias("qty_invoiced"),
        F.when(F.col("l_linestatus") == "F", "done").otherwise("purchase").alias("state"),
        F.col("l_shipdate").alias("date_planned"),
        money(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("price_subtotal"),
    )


def invoice(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    total, key = money("o_totalprice"), F.col("o_orderkey")
    residual = F.when(F.col("o_orderstatus") == "F", money(F.lit(0))).when(key % 3 == 0, money(total / 2)).otherwise(total)
    return o.select(
        key.alias("id"),
        F.concat(F.lit("INV/"), F.year("o_orderdate").cast("string"), F.lit("/"), key.cast("string")).alias("name"),
        F.col("o_custkey").alias("partner_id"),
        F.when(key % 10 == 0, "in_invoice").when(key % 10 == 1, "out_refund").otherwise("out_invoice").alias("move_type"),
        F.when(F.col("o_orderstatus") == "P", "draft").otherwise("posted").alias("state"),
        F.col("o_orderdate").alias("invoice_date"),
        (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("invoice_date_due"),
        total.alias("amount_total"),
        residual.alias("amount_residual"),
        F.when(F.col("o_orderstatus") == "F", "paid").when(key % 3 == 0, "partial").otherwise("not_paid").alias("payment_state"),
    )


def quant(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return (
        x.groupBy(F.col("l_partkey").alias("product_id"), (F.col("l_suppkey") % 5).alias("location_id"))
        .agg(F.sum(money("l_quantity")).cast("decimal(18,2)").alias("quantity"))
        .withColumn("usage", F.when(F.col("location_id") == 4, "customer").otherwise("internal"))
    )


def reorder_rule(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("product_id"),
        money(F.col("p_size") * 8).alias("product_min_qty"),
        money(F.col("p_size") * 16).alias("product_max_qty"),
        (F.col("p_partkey") % 10 != 0).alias("active"),
        (F.col("p_partkey") % 3).alias("warehouse_id"),
    )


def bom(spark: SparkSession, d: str) -> DataFrame:
    t = product(spark, d).select("product_tmpl_id").distinct()
    return t.select(
        F.col("product_tmpl_id").alias("id"),
        "product_tmpl_id",
        F.when(F.col("product_tmpl_id") % 5 == 0, "phantom").otherwise("normal").alias("type"),
        (1 + F.col("product_tmpl_id") % 3).alias("batch"),
    )


def bom_line(spark: SparkSession, d: str) -> DataFrame:
    parts = product(spark, d).agg(F.count("*").alias("n_parts"))
    lines = bom(spark, d).select(F.col("id").alias("bom_id"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("j")).join(F.broadcast(parts))
    return lines.select("bom_id", ((F.col("bom_id") * 37 + F.col("j") * 11) % F.col("n_parts")).alias("component_id"), (2 * F.col("j")).cast("bigint").alias("line_qty"))


def lead(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    b = F.col("c_acctbal")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 2 == 0, "lead").otherwise("opportunity").alias("type"),
        F.when(b < 0, "New").when(b < 3000, "Qualified").when(b < 6000, "Proposition").otherwise("Won").alias("stage"),
        F.concat(F.lit("contact"), (F.col("c_custkey") % 400).cast("string"), F.lit("@example.org")).alias("email_from"),
        F.concat(F.lit("+84-"), (F.col("c_custkey") % 700 + 1000).cast("string")).alias("phone"),
    )


def picking(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    k = F.col("l_linenumber")
    grouped = x.groupBy(F.col("l_orderkey").alias("order_id"), k).agg(F.min("l_linestatus").alias("least"), F.max("l_linestatus").alias("most"), F.min("l_shipdate").alias("scheduled_date"))
    state = F.when(F.col("most") == "F", "done").when(k % 3 == 0, "assigned").when(k % 7 == 6, "cancel").otherwise("waiting")
    return grouped.select(
        (F.col("order_id") * 10 + k).alias("id"), "order_id", state.alias("state"), F.when(k % 4 == 0, "incoming").otherwise("outgoing").alias("code"), "scheduled_date"
    )


def production(spark: SparkSession, d: str) -> DataFrame:
    parts = product(spark, d).agg(F.count("*").alias("n_parts"))
    o = table(spark, d, "orders").join(F.broadcast(parts))
    names = F.array(*map(F.lit, ("draft", "confirmed", "progress", "to_close", "done", "cancel")))
    return o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % F.col("n_parts")).alias("product_id"), (1 + F.col("o_orderkey") % 50).alias("product_qty"), F.get(names, (F.col("o_orderkey") % 6).cast("int")).alias("state")
    )


def usage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    provider = F.when(F.col("event_type").isin("click", "view"), "alpha").when(F.col("event_type") == "purchase", "beta").otherwise("gamma")
    return e.select("event_id", "ts", F.col("event_type").alias("alias"), provider.alias("provider"), F.floor(F.abs("value")).cast("bigint").alias("total_tokens"), F.col("user_id").alias("caller"))


ENTITIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (partner, vendor, product, sale_order, sale_order_line, purchase_line, invoice, quant, reorder_rule, bom, bom_line, lead, picking, production, usage)
}

VIEWS = {
    "partner": "SELECT c_custkey AS id, c_name AS name, c_mktsegment, c_acctbal::DECIMAL(18,2) AS balance, c_nationkey AS nation_id FROM customer",
    "vendor": "SELECT s_suppkey AS id, s_name AS name, 1 AS supplier_rank, s_nationkey AS nation_id FROM supplier",
    "product": "SELECT p_partkey AS id, p_name AS name, 'P' || p_partkey AS default_code, regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT AS product_tmpl_id, p_type AS categ, p_retailprice::DECIMAL(18,2) AS list_price, p_size AS size FROM part",
    "sale_order": "SELECT o_orderkey AS id, 'S' || lpad(o_orderkey::VARCHAR, greatest(5, length(o_orderkey::VARCHAR))::INT, '0') AS name, o_custkey AS partner_id, o_orderdate AS date_order, CASE o_orderstatus WHEN 'O' THEN 'sale' WHEN 'F' THEN 'done' ELSE 'draft' END AS state, o_totalprice::DECIMAL(18,2) AS amount_total FROM orders",
    "sale_order_line": "SELECT l_orderkey AS order_id, l_partkey AS product_id, l_quantity::DECIMAL(18,2) AS qty, (l_extendedprice * (1 - l_discount))::DECIMAL(18,4) AS price_subtotal FROM lineitem",
    "purchase_line": "SELECT l_orderkey * 100000 + l_suppkey AS order_id, l_suppkey AS partner_id, l_partkey AS product_id, l_quantity::DECIMAL(18,2) AS product_qty, CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END::DECIMAL(18,2) AS qty_received, CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0 END::DECIMAL(18,2) AS qty_invoiced, CASE WHEN l_linestatus = 'F' THEN 'done' ELSE 'purchase' END AS state, l_shipdate AS date_planned, (l_extendedprice * (1 - l_discount))::DECIMAL(18,4) AS price_subtotal FROM lineitem",
    "invoice": "SELECT o_orderkey AS id, 'INV/' || year(o_orderdate) || '/' || o_orderkey AS name, o_custkey AS partner_id, CASE o_orderkey % 10 WHEN 0 THEN 'in_invoice' WHEN 1 THEN 'out_refund' ELSE 'out_invoice' END AS move_type, CASE WHEN o_orderstatus = 'P' THEN 'draft' ELSE 'posted' END AS state, o_orderdate AS invoice_date, o_orderdate + INTERVAL 30 DAY AS invoice_date_due, o_totalprice::DECIMAL(18,2) AS amount_total, CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderkey % 3 = 0 THEN (o_totalprice::DECIMAL(18,2) * 0.5)::DECIMAL(18,2) ELSE o_totalprice::DECIMAL(18,2) END::DECIMAL(18,2) AS amount_residual, CASE WHEN o_orderstatus = 'F' THEN 'paid' WHEN o_orderkey % 3 = 0 THEN 'partial' ELSE 'not_paid' END AS payment_state FROM orders",
    "quant": "SELECT l_partkey AS product_id, l_suppkey % 5 AS location_id, SUM(l_quantity::DECIMAL(18,2))::DECIMAL(18,2) AS quantity, CASE WHEN l_suppkey % 5 = 4 THEN 'customer' ELSE 'internal' END AS usage FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2, 4",
    "reorder_rule": "SELECT p_partkey AS product_id, (p_size * 8)::DECIMAL(18,2) AS product_min_qty, (p_size * 16)::DECIMAL(18,2) AS product_max_qty, p_partkey % 10 <> 0 AS active, p_partkey % 3 AS warehouse_id FROM part",
    "bom": "SELECT DISTINCT product_tmpl_id AS id, product_tmpl_id, CASE WHEN product_tmpl_id % 5 = 0 THEN 'phantom' ELSE 'normal' END AS type, 1 + product_tmpl_id % 3 AS batch FROM product",
    "bom_line": "SELECT b.id AS bom_id, (b.id * 37 + j * 11) % (SELECT COUNT(*) FROM part) AS component_id, 2 * j AS line_qty FROM bom b, range(1, 4) t(j)",
    "lead": "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'lead' ELSE 'opportunity' END AS type, CASE WHEN c_acctbal < 0 THEN 'New' WHEN c_acctbal < 3000 THEN 'Qualified' WHEN c_acctbal < 6000 THEN 'Proposition' ELSE 'Won' END AS stage, 'contact' || c_custkey % 400 || '@example.org' AS email_from, '+84-' || c_custkey % 700 + 1000 AS phone FROM customer",
    "picking": "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS order_id, CASE WHEN MAX(l_linestatus) = 'F' THEN 'done' WHEN l_linenumber % 3 = 0 THEN 'assigned' WHEN l_linenumber % 7 = 6 THEN 'cancel' ELSE 'waiting' END AS state, CASE WHEN l_linenumber % 4 = 0 THEN 'incoming' ELSE 'outgoing' END AS code, MIN(l_shipdate) AS scheduled_date FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "production": "SELECT o_orderkey AS id, o_custkey % (SELECT COUNT(*) FROM part) AS product_id, 1 + o_orderkey % 50 AS product_qty, ['draft', 'confirmed', 'progress', 'to_close', 'done', 'cancel'][o_orderkey % 6 + 1] AS state FROM orders",
    "usage": "SELECT event_id, ts, event_type AS alias, CASE WHEN event_type IN ('click', 'view') THEN 'alpha' WHEN event_type = 'purchase' THEN 'beta' ELSE 'gamma' END AS provider, floor(abs(value))::BIGINT AS total_tokens, user_id AS caller FROM events",
}
_NEEDS = {"bom": ["product"], "bom_line": ["product", "bom"]}


def oracle(body: str, *views: str) -> str:
    """Oracle SQL: the views it names, then the query."""
    wanted: list[str] = []
    for v in views:
        wanted += [x for x in (*_NEEDS.get(v, ()), v) if x not in wanted]
    if not wanted:
        return body
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in wanted) + "\n" + body
