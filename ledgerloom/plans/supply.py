"""Stock, purchasing and manufacturing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators.domain import ilike, search_read
from ledgerloom.plans import model
from ledgerloom.plans.model import AS_OF, oracle
from ledgerloom.plans.registry import register


def on_hand(spark: SparkSession, d: str) -> DataFrame:
    """Stock per product over all internal locations."""
    return model.quant(spark, d).where("usage = 'internal'").groupBy("product_id").agg(F.sum("quantity").cast("decimal(18,2)").alias("on_hand"))


_ON_HAND = "(SELECT product_id, SUM(quantity)::DECIMAL(18,2) AS on_hand FROM quant WHERE usage = 'internal' GROUP BY 1)"


@register("stock_on_hand", oracle("SELECT product_id, p.name AS product_id_name, location_id, quantity FROM quant q LEFT JOIN product p ON p.id = q.product_id WHERE usage = 'internal' AND contains(lower(p.name), 'ring')", "quant", "product"))
def stock_on_hand(spark: SparkSession, d: str) -> DataFrame:
    return search_read(spark, d, "quant", [("usage", "=", "internal"), ("product_id.name", "ilike", "ring")], ["product_id", "product_id.name", "location_id", "quantity"], "product_id, location_id")


@register("lots", oracle("SELECT 'LOT-' || product_id || '-' || location_id AS lot, quantity FROM quant q JOIN product p ON p.id = q.product_id WHERE contains(lower(p.name), 'rod')", "quant", "product"))
def lots(spark: SparkSession, d: str) -> DataFrame:
    q = search_read(spark, d, "quant", [("product_id.name", "ilike", "rod")], ["product_id", "location_id", "quantity"])
    return q.select(F.concat(F.lit("LOT-"), F.col("product_id").cast("string"), F.lit("-"), F.col("location_id").cast("string")).alias("lot"), "quantity")


@register(
    "reorder_needed",
    oracle(
        f"""SELECT r.product_id, coalesce(h.on_hand, 0)::DECIMAL(18,2) AS on_hand, product_min_qty, greatest(product_max_qty - coalesce(h.on_hand, 0), 0)::DECIMAL(18,2) AS suggested
        FROM reorder_rule r LEFT JOIN {_ON_HAND} h USING (product_id) WHERE active AND coalesce(h.on_hand, 0) < product_min_qty""",
        "reorder_rule", "quant",
    ),
)
def reorder_needed(spark: SparkSession, d: str) -> DataFrame:
    """Active rules whose stock is strictly under the minimum (no stock is 0); never a negative suggestion."""
    return reorder(model.reorder_rule(spark, d).where("active"), on_hand(spark, d))


def reorder(rules: DataFrame, stock: DataFrame) -> DataFrame:
    have = F.coalesce("on_hand", F.lit(0)).cast("decimal(18,2)")
    joined = rules.join(stock, "product_id", "left").withColumn("on_hand", have).where("on_hand < product_min_qty")
    gap = F.greatest(F.col("product_max_qty") - F.col("on_hand"), F.lit(0)).cast("decimal(18,2)")
    return joined.select("product_id", "on_hand", "product_min_qty", gap.alias("suggested"))


@register(
    "late_deliveries",
    oracle(
        f"""SELECT id, order_id, scheduled_date, state, COUNT(*) OVER () AS n_late, COUNT(*) OVER () >= 100 AS capped FROM picking
        WHERE code IN ('incoming', 'outgoing') AND state NOT IN ('done', 'cancel') AND scheduled_date < TIMESTAMP '{AS_OF}' ORDER BY scheduled_date, id LIMIT 15""",
        "picking",
    ),
)
def late_deliveries(spark: SparkSession, d: str, as_of: str = AS_OF) -> DataFrame:
    """The fifteen longest overdue, and how many there are in all."""
    late = search_read(
        spark, d, "picking", [("code", "in", ["incoming", "outgoing"]), ("state", "not in", ["done", "cancel"]), ("scheduled_date", "<", F.lit(as_of).cast("timestamp_ntz"))],
        ["id", "order_id", "scheduled_date", "state"],
    )
    n = late.agg(F.count("*").alias("n_late"))
    return late.orderBy("scheduled_date", "id").limit(15).join(F.broadcast(n)).withColumn("capped", F.col("n_late") >= 100)


@register(
    "done_deliveries_for_order",
    oracle("SELECT o.name, p.id AS picking_id, p.scheduled_date FROM sale_order o JOIN picking p ON p.order_id = o.id WHERE o.state = 'sale' AND p.code = 'outgoing' AND p.state = 'done'", "sale_order", "picking"),
)
def done_deliveries_for_order(spark: SparkSession, d: str) -> DataFrame:
    """Orders hold arrays of picking ids; they are unnested and joined."""
    arrays = model.picking(spark, d).groupBy("order_id").agg(F.collect_list("id").alias("picking_ids"))
    orders = model.sale_order(spark, d).where("state = 'sale'").join(arrays, F.col("id") == F.col("order_id")).select("name", F.explode("picking_ids").alias("picking_id"))
    done = model.picking(spark, d).where("code = 'outgoing' and state = 'done'").select(F.col("id").alias("picking_id"), "scheduled_date")
    return orders.join(done, "picking_id").select("name", "picking_id", "scheduled_date")


@register("unique_on_hand", oracle("SELECT product_id, CASE WHEN COUNT(*) = 1 THEN MAX(quantity) END AS available FROM quant WHERE usage = 'internal' GROUP BY 1", "quant"))
def unique_on_hand(spark: SparkSession, d: str) -> DataFrame:
    """Available quantity only where a single stock record holds it."""
    return model.quant(spark, d).where("usage = 'internal'").groupBy("product_id").agg(F.when(F.count("*") == 1, F.max("quantity")).alias("available"))


@register(
    "location_resolve",
    oracle(
        """SELECT id, name, origin FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY origin DESC) AS rn FROM (
        SELECT n_nationkey AS id, n_name AS name, 'warehouse' AS origin FROM nation WHERE contains(lower(n_name), 'a') UNION ALL
        SELECT n_nationkey, r_name || '/' || n_name, 'location' FROM nation JOIN region ON r_regionkey = n_regionkey WHERE contains(lower(r_name || '/' || n_name), 'a'))) WHERE rn = 1"""
    ),
)
def location_resolve(spark: SparkSession, d: str, text: str = "a") -> DataFrame:
    """Warehouses by name and locations by path in one list; an id that both give is taken as the warehouse."""
    n = spark.read.parquet(f"{d}/nation.parquet").join(F.broadcast(spark.read.parquet(f"{d}/region.parquet")), F.col("n_regionkey") == F.col("r_regionkey"))
    houses = n.where(ilike(F.col("n_name"), text)).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("warehouse").alias("origin"))
    path = F.concat("r_name", F.lit("/"), "n_name")
    places = n.where(ilike(path, text)).select(F.col("n_nationkey").alias("id"), path.alias("name"), F.lit("location").alias("origin"))
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("origin")))
    return houses.unionByName(places).withColumn("rn", first).where("rn = 1").drop("rn")


@register(
    "order_pickings_status",
    oracle(
        """SELECT o.id, CASE WHEN COUNT(p.id) FILTER (WHERE p.state NOT IN ('done', 'cancel')) = 0 THEN 'none'
        WHEN COUNT(p.id) FILTER (WHERE p.state = 'assigned') > 0 THEN 'ready' ELSE 'not_ready' END AS status,
        COUNT(p.id) FILTER (WHERE p.state = 'assigned') AS n_ready, coalesce(array_to_string(list_sort(list(DISTINCT p.state) FILTER (WHERE p.state NOT IN ('done', 'cancel'))), ','), '') AS states
        FROM sale_order o LEFT JOIN picking p ON p.order_id = o.id GROUP BY 1""",
        "sale_order", "picking",
    ),
)
def order_pickings_status(spark: SparkSession, d: str) -> DataFrame:
    p = model.picking(spark, d)
    pending = F.when(~F.col("p_state").isin("done", "cancel"), F.col("p_state"))
    joined = model.sale_order(spark, d).select("id").join(p.select(F.col("order_id"), F.col("state").alias("p_state")), F.col("id") == F.col("order_id"), "left")
    out = joined.groupBy("id").agg(F.count(pending).alias("n"), F.count_if(F.col("p_state") == "assigned").alias("n_ready"), F.array_join(F.array_sort(F.collect_set(pending)), ",").alias("states"))
    return out.select("id", F.when(F.col("n") == 0, "none").when(F.col("n_ready") > 0, "ready").otherwise("not_ready").alias("status"), "n_ready", "states")


@register(
    "receipt_count_check",
    oracle("SELECT order_id, SUM(product_qty) AS ordered, SUM(qty_received) AS counted, CASE WHEN SUM(product_qty) = SUM(qty_received) THEN 'continue' ELSE 'flag' END AS verdict FROM purchase_line GROUP BY 1", "purchase_line"),
)
def receipt_count_check(spark: SparkSession, d: str) -> DataFrame:
    out = model.purchase_line(spark, d).groupBy("order_id").agg(F.sum("product_qty").alias("ordered"), F.sum("qty_received").alias("counted"))
    return out.withColumn("verdict", F.when(F.col("ordered") == F.col("counted"), "continue").otherwise("flag"))


@register("list_purchase_orders", oracle("SELECT order_id, partner_id, MIN(date_planned) AS date_order, SUM(price_subtotal) AS amount_total FROM purchase_line WHERE state = 'purchase' GROUP BY 1, 2 HAVING MIN(date_planned) >= TIMESTAMP '2000-01-01' AND MIN(date_planned) < TIMESTAMP '2001-01-01'", "purchase_line"))
def list_purchase_orders(spark: SparkSession, d: str) -> DataFrame:
    p = model.purchase_line(spark, d).where("state = 'purchase'").groupBy("order_id", "partner_id").agg(F.min("date_planned").alias("date_order"), F.sum("price_subtotal").alias("amount_total"))
    return p.where("date_order >= timestamp_ntz '2000-01-01' and date_order < timestamp_ntz '2001-01-01'")


@register("purchase_order_detail", oracle("SELECT order_id, product_id, product_qty, qty_received, qty_invoiced, price_subtotal FROM purchase_line WHERE partner_id = 7", "purchase_line"))
def purchase_order_detail(spark: SparkSession, d: str) -> DataFrame:
    return search_read(spark, d, "purchase_line", [("partner_id", "=", 7)], ["order_id", "product_id", "product_qty", "qty_received", "qty_invoiced", "price_subtotal"])


@register("list_suppliers", oracle("SELECT id, name FROM vendor WHERE supplier_rank > 0", "vendor"))
def list_suppliers(spark: SparkSession, d: str) -> DataFrame:
    return search_read(spark, d, "vendor", [("supplier_rank", ">", 0)], ["id", "name"], "name, id")


@register(
    "product_suppliers",
    oracle(
        """SELECT product_id, partner_id, 'price_list' AS source, MIN((price_subtotal * 10000)::BIGINT // product_qty::BIGINT) AS price_e4, row_number() OVER (PARTITION BY product_id ORDER BY MIN((price_subtotal * 10000)::BIGINT // product_qty::BIGINT), partner_id) AS pos
        FROM purchase_line WHERE state = 'done' GROUP BY 1, 2 UNION ALL
        SELECT product_id, partner_id, 'history', NULL, row_number() OVER (PARTITION BY product_id ORDER BY MIN(order_id)) FROM purchase_line GROUP BY 1, 2""",
        "purchase_line",
    ),
)
def product_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Declared prices, cheapest first, and vendors of past orders in the order they were first seen."""
    p = model.purchase_line(spark, d)
    unit = F.expr("cast(price_subtotal * 10000 as bigint) div cast(product_qty as bigint)")  # whole ten-thousandths
    prices = p.where("state = 'done'").groupBy("product_id", "partner_id").agg(F.min(unit).alias("price_e4"))
    prices = prices.withColumn("pos", F.row_number().over(Window.partitionBy("product_id").orderBy("price_e4", "partner_id"))).withColumn("source", F.lit("price_list"))
    seen = p.groupBy("product_id", "partner_id").agg(F.min("order_id").alias("first"))
    seen = seen.withColumn("pos", F.row_number().over(Window.partitionBy("product_id").orderBy("first"))).drop("first").withColumn("source", F.lit("history"))
    return prices.unionByName(seen, allowMissingColumns=True).select("product_id", "partner_id", "source", "price_e4", F.col("pos").cast("long").alias("pos"))


@register(
    "supplier_detail",
    oracle("SELECT v.id, v.name, n.n_name AS bank, COUNT(DISTINCT p.order_id) AS n_orders FROM vendor v LEFT JOIN nation n ON n.n_nationkey = v.nation_id LEFT JOIN purchase_line p ON p.partner_id = v.id GROUP BY 1, 2, 3", "vendor", "purchase_line"),
)
def supplier_detail(spark: SparkSession, d: str) -> DataFrame:
    orders = model.purchase_line(spark, d).groupBy("partner_id").agg(F.count_distinct("order_id").alias("n"))
    banks = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("bank"))
    v = model.vendor(spark, d).join(banks, "nation_id", "left").join(orders, F.col("id") == F.col("partner_id"), "left")
    return v.select("id", "name", "bank", F.coalesce("n", F.lit(0)).alias("n_orders"))


@register("po_matching", oracle("SELECT order_id, COUNT(*) FILTER (WHERE qty_invoiced > qty_received) AS n_mismatch, COUNT(*) FILTER (WHERE qty_invoiced > qty_received) = 0 AS matched FROM purchase_line GROUP BY 1", "purchase_line"))
def po_matching(spark: SparkSession, d: str) -> DataFrame:
    """A mismatch is more invoiced than received; a partial receipt is none."""
    n = F.count_if(F.col("qty_invoiced") > F.col("qty_received"))
    return model.purchase_line(spark, d).groupBy("order_id").agg(n.alias("n_mismatch"), (n == 0).alias("matched"))


@register("po_mismatches", oracle("SELECT order_id, product_id, qty_received, qty_invoiced, (SELECT COUNT(DISTINCT order_id) FROM purchase_line WHERE qty_invoiced > qty_received) AS n_orders FROM purchase_line WHERE state IN ('purchase', 'done') AND qty_invoiced > 0 AND qty_invoiced > qty_received", "purchase_line"))
def po_mismatches(spark: SparkSession, d: str) -> DataFrame:
    rows = model.purchase_line(spark, d).where("state in ('purchase', 'done') and qty_invoiced > 0 and qty_invoiced > qty_received")
    n = rows.agg(F.count_distinct("order_id").alias("n_orders"))
    return rows.select("order_id", "product_id", "qty_received", "qty_invoiced").join(F.broadcast(n))


@register("vendor_duplicates", oracle("SELECT id, name FROM vendor WHERE contains(lower(name), '00001') OR contains(lower(name), '00005')", "vendor"))
def vendor_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return search_read(spark, d, "vendor", ["|", ("name", "ilike", "00001"), ("name", "ilike", "00005")], ["id", "name"])


@register("boms_for_variant", oracle("SELECT p.id AS product_id, b.id AS bom_id, b.type, b.batch FROM product p JOIN bom b ON b.product_tmpl_id = p.product_tmpl_id", "product", "bom"))
def boms_for_variant(spark: SparkSession, d: str) -> DataFrame:
    """Variants reach recipes by their template, never by their own id."""
    b = model.bom(spark, d).withColumnRenamed("id", "bom_id")
    return model.product(spark, d).select(F.col("id").alias("product_id"), "product_tmpl_id").join(b, "product_tmpl_id").select("product_id", "bom_id", "type", "batch")


@register(
    "bom_availability",
    oracle(
        f"""SELECT b.id AS bom_id, l.component_id, (l.line_qty * 200.0 / b.batch)::DECIMAL(18,4) AS need, coalesce(h.on_hand, 0)::DECIMAL(18,2) AS have, coalesce(h.on_hand, 0) >= l.line_qty * 200.0 / b.batch AS enough,
        bool_and(coalesce(h.on_hand, 0) >= l.line_qty * 200.0 / b.batch) OVER (PARTITION BY b.id) AS all_enough FROM bom b JOIN bom_line l ON l.bom_id = b.id LEFT JOIN {_ON_HAND} h ON h.product_id = l.component_id""",
        "bom", "bom_line", "quant",
    ),
)
def bom_availability(spark: SparkSession, d: str, quantity: int = 200) -> DataFrame:
    """What a batch needs against what is there."""
    lines = model.bom_line(spark, d).join(model.bom(spark, d).select(F.col("id").alias("bom_id"), "batch"), "bom_id")
    rows = lines.join(on_hand(spark, d), F.col("component_id") == F.col("product_id"), "left").withColumn("have", F.coalesce("on_hand", F.lit(0)).cast("decimal(18,2)"))
    need = F.col("line_qty").cast("double") * quantity / F.col("batch")
    rows = rows.withColumn("enough", F.col("have").cast("double") >= need).withColumn("need", need.cast("decimal(18,4)"))
    return rows.select("bom_id", "component_id", "need", "have", "enough", F.bool_and("enough").over(Window.partitionBy("bom_id")).alias("all_enough"))


@register(
    "bom_detail",
    oracle(
        f"""SELECT b.id, b.type, b.batch, array_to_string(list(l.component_id || ':' || l.line_qty || ':' || coalesce(h.on_hand, 0)::DECIMAL(18,2) ORDER BY l.component_id, l.line_qty), ';') AS lines
        FROM bom b LEFT JOIN bom_line l ON l.bom_id = b.id LEFT JOIN {_ON_HAND} h ON h.product_id = l.component_id GROUP BY 1, 2, 3""",
        "bom", "bom_line", "quant",
    ),
)
def bom_detail(spark: SparkSession, d: str) -> DataFrame:
    """Recipes with their lines nested, and the stock of each component."""
    lines = model.bom_line(spark, d).join(on_hand(spark, d), F.col("component_id") == F.col("product_id"), "left")
    line = F.struct("component_id", "line_qty", F.coalesce("on_hand", F.lit(0)).cast("decimal(18,2)").alias("have"))
    nested = lines.groupBy("bom_id").agg(F.array_sort(F.collect_list(line)).alias("x"))
    text = F.array_join(F.transform("x", lambda x: F.concat_ws(":", x["component_id"].cast("string"), x["line_qty"].cast("string"), x["have"].cast("string"))), ";")
    return model.bom(spark, d).join(nested, F.col("id") == F.col("bom_id"), "left").select("id", "type", "batch", text.alias("lines"))


_STATES = {"draft": "Draft", "confirmed": "Confirmed", "progress": "In progress", "to_close": "To close", "done": "Done", "cancel": "Cancelled"}


@register(
    "list_manufacturing_orders",
    oracle(
        "SELECT m.id, p.name AS product, product_qty, CASE state WHEN 'draft' THEN 'Draft' WHEN 'confirmed' THEN 'Confirmed' WHEN 'progress' THEN 'In progress' WHEN 'to_close' THEN 'To close' WHEN 'done' THEN 'Done' ELSE 'Cancelled' END AS label FROM production m LEFT JOIN product p ON p.id = m.product_id WHERE contains(lower(p.name), 'large')",
        "production", "product",
    ),
)
def list_manufacturing_orders(spark: SparkSession, d: str) -> DataFrame:
    m = search_read(spark, d, "production", [("product_id.name", "ilike", "large")], ["id", "product_id.name", "product_qty", "state"])
    labels = F.create_map(*[F.lit(x) for kv in _STATES.items() for x in kv])
    return m.select("id", F.col("product_id_name").alias("product"), "product_qty", labels[F.col("state")].alias("label"))


@register("bom_recipe", oracle("SELECT b.id, l.component_id, l.line_qty, p.name FROM bom b JOIN bom_line l ON l.bom_id = b.id LEFT JOIN product p ON p.id = l.component_id WHERE b.type = 'normal'", "product", "bom", "bom_line"))
def bom_recipe(spark: SparkSession, d: str) -> DataFrame:
    b = model.bom(spark, d).where("type = 'normal'").select("id")
    names = model.product(spark, d).select(F.col("id").alias("component_id"), "name")
    return b.join(model.bom_line(spark, d), F.col("id") == F.col("bom_id")).join(names, "component_id", "left").select("id", "component_id", "line_qty", "name")


@register("open_mo_count", oracle("SELECT COUNT(*) AS n_open, COUNT(*) >= 100 AS capped FROM production WHERE state IN ('draft', 'confirmed', 'progress', 'to_close')", "production"))
def open_mo_count(spark: SparkSession, d: str) -> DataFrame:
    return model.production(spark, d).where(F.col("state").isin("draft", "confirmed", "progress", "to_close")).agg(F.count("*").alias("n_open"), (F.count("*") >= 100).alias("capped"))


@register(
    "pending_kit_orders",
    oracle(
        """SELECT b.id AS bom_id, COUNT(DISTINCT o.id) AS n_orders, COUNT(DISTINCT o.id) FILTER (WHERE r.at_risk) AS n_at_risk
        FROM bom b JOIN product p ON p.product_tmpl_id = b.product_tmpl_id JOIN sale_order_line l ON l.product_id = p.id JOIN sale_order o ON o.id = l.order_id
        LEFT JOIN (SELECT order_id, bool_or(state <> 'done') AS at_risk FROM picking GROUP BY 1) r ON r.order_id = o.id
        WHERE b.type = 'phantom' AND o.state = 'sale' GROUP BY 1""",
        "bom", "product", "sale_order_line", "sale_order", "picking",
    ),
)
def pending_kit_orders(spark: SparkSession, d: str) -> DataFrame:
    """Recipe, variants, order lines, orders, deliveries: an order is at risk if any of its deliveries isn't done."""
    b = model.bom(spark, d).where("type = 'phantom'").select(F.col("id").alias("bom_id"), "product_tmpl_id")
    variants = model.product(spark, d).select(F.col("id").alias("product_id"), "product_tmpl_id").join(b, "product_tmpl_id")
    orders = model.sale_order(spark, d).where("state = 'sale'").select(F.col("id").alias("order_id"))
    pairs = model.sale_order_line(spark, d).select("order_id", "product_id").join(variants, "product_id").join(orders, "order_id").select("bom_id", "order_id").distinct()
    risk = model.picking(spark, d).groupBy("order_id").agg(F.bool_or(F.col("state") != "done").alias("at_risk"))
    return pairs.join(risk, "order_id", "left").groupBy("bom_id").agg(F.count("*").alias("n_orders"), F.count_if("at_risk").alias("n_at_risk"))
