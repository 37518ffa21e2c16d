"""The predicate, join, aggregate, ordering and set building blocks, each as a query of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators.domain import read_group, search_read
from ledgerloom.plans import model
from ledgerloom.plans.model import AS_OF, oracle
from ledgerloom.operators.ranks import placed, value_at_ranks
from ledgerloom.plans.registry import register
from ledgerloom.plans.sales import day_range, period_start
from ledgerloom.session import table
from ledgerloom.sources.store import numbered_pages


@register("pred_ilike", "SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'red pl')")
def pred_ilike(spark: SparkSession, d: str) -> DataFrame:
    return search_read(spark, d, "product", [("name", "ilike", "Red Pl")], ["id", "name"])


@register("pred_or_prefix", oracle("SELECT id, state FROM sale_order WHERE (state = 'draft' OR amount_total > 400000) AND NOT partner_id = 7", "sale_order"))
def pred_or_prefix(spark: SparkSession, d: str) -> DataFrame:
    return search_read(spark, d, "sale_order", ["|", ("state", "=", "draft"), ("amount_total", ">", 400000), "!", ("partner_id", "=", 7)], ["id", "state"])


@register("pred_dotted_path", oracle("SELECT l.product_id, o.state AS order_id_state, p.name AS product_id_name FROM sale_order_line l LEFT JOIN sale_order o ON o.id = l.order_id LEFT JOIN product p ON p.id = l.product_id WHERE o.state = 'done' AND contains(lower(p.name), 'widget')", "sale_order_line", "sale_order", "product"))
def pred_dotted_path(spark: SparkSession, d: str) -> DataFrame:
    return search_read(spark, d, "sale_order_line", [("order_id.state", "=", "done"), ("product_id.name", "ilike", "widget")], ["product_id", "order_id.state", "product_id.name"])


@register("pred_not_in", oracle("SELECT id, state FROM picking WHERE state NOT IN ('done', 'cancel')", "picking"))
def pred_not_in(spark: SparkSession, d: str) -> DataFrame:
    return search_read(spark, d, "picking", [("state", "not in", ["done", "cancel"])], ["id", "state"])


@register("pred_day_range", oracle("SELECT id FROM sale_order WHERE date_order >= TIMESTAMP '1998-05-01' AND date_order < TIMESTAMP '1998-06-01'", "sale_order"))
def pred_day_range(spark: SparkSession, d: str) -> DataFrame:
    return search_read(spark, d, "sale_order", day_range("date_order", "1998-05-01", "1998-05-31"), ["id"])


@register("period_start", oracle(f"SELECT u AS unit, (SELECT COUNT(*) FROM sale_order WHERE date_order >= date_trunc(u, TIMESTAMP '{AS_OF}')) AS n FROM (VALUES ('month'), ('quarter'), ('year')) t(u)", "sale_order"))
def period_start_counts(spark: SparkSession, d: str) -> DataFrame:
    """One pass: orders since the start of the month, quarter and year."""
    o = model.sale_order(spark, d)
    units = ("month", "quarter", "year")
    wide = o.agg(*[F.count_if(F.col("date_order") >= period_start(u)).alias(u) for u in units])
    return wide.unpivot([], list(units), "unit", "n")


@register("join_left_default", oracle("SELECT p.id, coalesce(q.n, 0) AS n FROM product p LEFT JOIN (SELECT product_id, COUNT(*) AS n FROM quant GROUP BY 1) q ON q.product_id = p.id", "product", "quant"))
def join_left_default(spark: SparkSession, d: str) -> DataFrame:
    q = model.quant(spark, d).groupBy("product_id").agg(F.count("*").alias("n"))
    return model.product(spark, d).select("id").join(q, F.col("id") == F.col("product_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@register("join_semi", oracle("SELECT id FROM partner WHERE id IN (SELECT partner_id FROM sale_order WHERE amount_total > 450000)", "partner", "sale_order"))
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    big = model.sale_order(spark, d).where("amount_total > 450000").select("partner_id")
    return model.partner(spark, d).select("id").join(big, F.col("id") == F.col("partner_id"), "left_semi")


@register("join_anti", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).join(lines, F.col("id") == F.col("l_orderkey"), "left_anti")


@register("join_array_fk", oracle("SELECT p.state, COUNT(*) AS n FROM picking p JOIN sale_order o ON o.id = p.order_id WHERE o.state = 'done' GROUP BY 1", "picking", "sale_order"))
def join_array_fk(spark: SparkSession, d: str) -> DataFrame:
    """Keys held in arrays are exploded and equi-joined."""
    p = model.picking(spark, d)
    arrays = p.groupBy("order_id").agg(F.collect_list("id").alias("ids"))
    asked = model.sale_order(spark, d).where("state = 'done'").join(arrays, F.col("id") == F.col("order_id")).select(F.explode("ids").alias("pid"))
    return asked.join(p, F.col("pid") == p["id"]).groupBy("state").agg(F.count("*").alias("n"))


@register("nested_children", "SELECT l_orderkey AS id, array_to_string(list(l_partkey ORDER BY l_partkey), ',') AS parts, COUNT(*) AS n FROM lineitem GROUP BY 1")
def nested_children(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list("l_partkey")).alias("p"))
    return out.select("id", F.array_join("p", ",").alias("parts"), F.size("p").cast("long").alias("n"))


@register("merge_dedupe_by_id", "SELECT id, MAX(a) AS in_first, MAX(b) AS in_second FROM (SELECT o_custkey AS id, 1 AS a, 0 AS b FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, 0, 1 FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def merge_dedupe_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Two lists merged by id: a union and one aggregation, cheaper than a full outer join."""
    o = table(spark, d, "orders")
    first = o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("id"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    second = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    return first.unionByName(second).groupBy("id").agg(F.max("a").alias("in_first"), F.max("b").alias("in_second"))


@register("set_except", "SELECT l_suppkey AS supplier, COUNT(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A') GROUP BY 1")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    left = x.where("l_returnflag = 'R'").select("l_suppkey", "l_partkey")
    return left.subtract(x.where("l_returnflag = 'A'").select("l_suppkey", "l_partkey")).groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count("*").alias("n"))


@register("set_subset", "SELECT user_id, list_has_all(list(event_type), ['click', 'purchase']) AS has_all FROM events GROUP BY 1")
def set_subset(spark: SparkSession, d: str) -> DataFrame:
    need = F.array(F.lit("click"), F.lit("purchase"))
    seen = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    return seen.select("user_id", (F.size(F.array_except(need, "s")) == 0).alias("has_all"))


@register("set_union_dedupe", "SELECT DISTINCT id FROM (SELECT o_custkey AS id FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal > 9000) ORDER BY id LIMIT 10")
def set_union_dedupe(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("id"))
    b = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("id"))
    return a.union(b).distinct().orderBy("id").limit(10)


@register("agg_group_sum", "SELECT l_suppkey AS supplier, SUM(l_quantity::DECIMAL(18,2)) AS qty FROM lineitem GROUP BY 1")
def agg_group_sum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("qty"))


@register("agg_grand_total", "SELECT c_mktsegment AS segment, SUM(c_acctbal::DECIMAL(18,2)) AS balance FROM customer GROUP BY ROLLUP (c_mktsegment)")
def agg_grand_total(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").rollup(F.col("c_mktsegment").alias("segment")).agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("balance"))


@register("agg_conditional", "SELECT l_returnflag AS flag, COUNT(*) FILTER (WHERE l_discount > 0.05) AS discounted, SUM(CASE WHEN l_linestatus = 'F' THEN l_quantity::DECIMAL(18,2) ELSE 0 END)::DECIMAL(28,2) AS filled FROM lineitem GROUP BY 1")
def agg_conditional(spark: SparkSession, d: str) -> DataFrame:
    filled = F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("decimal(18,2)")).otherwise(F.lit(0))
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.sum(filled).cast("decimal(28,2)").alias("filled"))


@register("agg_bool_fold", "SELECT l_orderkey AS id, bool_and(l_linestatus = 'F') AS every_done, bool_or(l_returnflag = 'R') AS any_returned FROM lineitem GROUP BY 1")
def agg_bool_fold(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    return x.groupBy(F.col("l_orderkey").alias("id")).agg(F.bool_and(F.col("l_linestatus") == "F").alias("every_done"), F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"))


@register("agg_count_distinct", "SELECT l_suppkey AS supplier, COUNT(DISTINCT l_partkey) AS parts, COUNT(*) AS lines FROM lineitem GROUP BY 1")
def agg_count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count_distinct("l_partkey").alias("parts"), F.count("*").alias("lines"))


@register("agg_class_rollup", "SELECT coalesce(event_type, 'TOTAL') AS class, COUNT(*) AS n, COUNT(*) FILTER (WHERE value > 50) AS hits FROM events GROUP BY ROLLUP (event_type)")
def agg_class_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").rollup("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("hits")).select(F.coalesce("event_type", F.lit("TOTAL")).alias("class"), "n", "hits")


@register("pct_nearest_rank", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def pct_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    """The value of rank ceil(q * n)."""
    return value_at_ranks(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95}).drop("n")


@register("pct_index_rule", "SELECT event_type, max(value) FILTER (WHERE rn = n * 90 // 100 + 1) AS p90 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, COUNT(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1")
def pct_index_rule(spark: SparkSession, d: str) -> DataFrame:
    """The value at index int(n * p / 100) of the sorted ones: another rule than the nearest rank."""
    e = table(spark, d, "events").select("event_type", "value", "event_id")
    ranked = placed(e, "event_type", ["value", "event_id"])
    return ranked.groupBy("event_type").agg(F.max(F.when(F.col("pos") == F.expr("of * 90 div 100"), F.col("value"))).alias("p90"))


@register("first_seen_dedupe", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def first_seen_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@register("latest_per_key", "SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "ts").alias("event_type"), F.max("ts").alias("ts"))


@register("topk_gap", "SELECT event_type, top, round(top - second, 6) AS gap FROM (SELECT event_type, value AS top, lead(value) OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS second, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn = 1")
def topk_gap(spark: SparkSession, d: str) -> DataFrame:
    """Best less second best, from two bounded aggregates instead of a window over the whole group."""
    e = table(spark, d, "events")
    best = e.groupBy("event_type").agg(F.max_by(F.struct("value", "event_id"), F.struct("value", -F.col("event_id"))).alias("b"))
    rest = e.join(F.broadcast(best.select(F.col("event_type").alias("t"), F.col("b.event_id").alias("i"))), (F.col("event_type") == F.col("t")) & (F.col("event_id") != F.col("i"))).groupBy("event_type").agg(F.max("value").alias("second"))
    return best.join(rest, "event_type", "left").select("event_type", F.col("b.value").alias("top"), F.round(F.col("b.value") - F.col("second"), 6).alias("gap"))


@register("prev_link", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events")
def prev_link(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("prev"))


@register("sliding_minute", "SELECT event_id, COUNT(*) OVER w AS n, round(SUM(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)")
def sliding_minute(spark: SparkSession, d: str) -> DataFrame:
    over = "over (partition by user_id order by ts range between interval 60 seconds preceding and current row)"
    return table(spark, d, "events").selectExpr("event_id", f"count(*) {over} as n", f"round(sum(value) {over}, 4) as total")


@register("rank_by_enumeration", "SELECT l_suppkey AS supplier, row_number() OVER (ORDER BY SUM(l_quantity) DESC, l_suppkey) AS rank FROM lineitem GROUP BY 1")
def rank_by_enumeration(spark: SparkSession, d: str) -> DataFrame:
    """Ranks over group totals, in ranges of the total."""
    sums = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg((-F.sum("l_quantity")).alias("less"))
    return placed(sums.withColumn("all", F.lit(0)), "all", ["less", "supplier"]).select("supplier", (F.col("pos") + 1).alias("rank"))


@register("display_cap", "SELECT l_partkey AS id, COUNT(*) AS n, (SELECT COUNT(DISTINCT l_partkey) FROM lineitem) AS total FROM lineitem GROUP BY 1 ORDER BY n DESC, id LIMIT 15")
def display_cap(spark: SparkSession, d: str) -> DataFrame:
    """The first fifteen to show, and how many there are."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "id").limit(15).join(F.broadcast(g.agg(F.count("*").alias("total"))))


@register("computed_columns", oracle("SELECT product_id, greatest(product_max_qty - product_min_qty, 0)::DECIMAL(18,2) AS room, product_min_qty >= 200 AS large, ceil(product_min_qty / 7)::BIGINT AS sevens FROM reorder_rule", "reorder_rule"))
def computed_columns(spark: SparkSession, d: str) -> DataFrame:
    room = F.greatest(F.col("product_max_qty") - F.col("product_min_qty"), F.lit(0)).cast("decimal(18,2)")
    return model.reorder_rule(spark, d).select("product_id", room.alias("room"), (F.col("product_min_qty") >= 200).alias("large"), F.ceil(F.col("product_min_qty").cast("double") / 7).alias("sevens"))


@register("group_pushed_down", oracle("SELECT p.c_mktsegment AS partner_id_c_mktsegment, SUM(amount_total) AS total, COUNT(*) AS n FROM sale_order o LEFT JOIN partner p ON p.id = o.partner_id WHERE state IN ('sale', 'done') GROUP BY 1", "sale_order", "partner"))
def group_pushed_down(spark: SparkSession, d: str) -> DataFrame:
    return read_group(spark, d, "sale_order", [("state", "in", ["sale", "done"])], {"total": "amount_total"}, ["partner_id.c_mktsegment"])


@register("keyset_pages", "SELECT n // 500 AS page, COUNT(*) AS n, MIN(p_partkey) AS first, MAX(p_partkey) AS last FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part WHERE p_size > 5) GROUP BY 1")
def keyset_pages(spark: SparkSession, d: str, size: int = 500) -> DataFrame:
    """What paging by key, after the last one seen until a page is empty, would fetch: a partitioned scan needs no loop."""
    return numbered_pages(table(spark, d, "part").where("p_size > 5"), "p_partkey", size).select("page", "n", "first", "last")
