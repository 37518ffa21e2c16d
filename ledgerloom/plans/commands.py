"""State-transition commands as data: a command row and the record it names give a verdict and the next state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import variant
from ledgerloom.plans import language, model
from ledgerloom.plans.model import oracle
from ledgerloom.plans.registry import register
from ledgerloom.session import table

#: Lines of sale orders that one task sorts.
LINES_PER_TASK = 1_000_000

#: The step that follows each tool of a chain.
NEXT_STEPS = {
    "create_quotation": "confirm_sale_order",
    "update_quotation_lines": "confirm_sale_order",
    "confirm_sale_order": "deliver_order",
    "deliver_order": "create_invoice_from_order",
    "create_invoice_from_order": "post_invoice",
    "create_rfq": "confirm_purchase_order",
    "update_rfq_lines": "confirm_purchase_order",
    "confirm_purchase_order": "receive_order",
    "receive_order": "create_bill_from_po",
    "create_bill_from_po": "post_invoice",
    "post_invoice": "register_payment",
    "create_lead": "convert_lead",
    "create_manufacturing_order": "confirm_manufacturing_order",
    "confirm_manufacturing_order": "complete_manufacturing_order",
    "return_order": "validate_picking",
    "create_credit_memo": "post_invoice",
    "create_vendor": "update_vendor_pricing",
}


@register("confirm_order_check", oracle("SELECT id, CASE WHEN state IN ('sale', 'done', 'cancel') THEN 'refused' ELSE 'ok' END AS verdict, CASE WHEN state IN ('sale', 'done', 'cancel') THEN state ELSE 'sale' END AS next_state FROM sale_order", "sale_order"))
def confirm_order_check(spark: SparkSession, d: str) -> DataFrame:
    refused = F.col("state").isin("sale", "done", "cancel")
    return model.sale_order(spark, d).select("id", F.when(refused, "refused").otherwise("ok").alias("verdict"), F.when(refused, F.col("state")).otherwise("sale").alias("next_state"))


@register("deliver_order_check", oracle("SELECT o.id, CASE WHEN o.state NOT IN ('sale', 'done') THEN 'not_confirmed' WHEN COUNT(p.id) FILTER (WHERE p.state = 'assigned') = 0 THEN 'nothing_ready' ELSE 'ok' END AS verdict FROM sale_order o LEFT JOIN picking p ON p.order_id = o.id GROUP BY o.id, o.state", "sale_order", "picking"))
def deliver_order_check(spark: SparkSession, d: str) -> DataFrame:
    ready = model.picking(spark, d).groupBy("order_id").agg(F.count_if(F.col("state") == "assigned").alias("n"))
    o = model.sale_order(spark, d).join(ready, F.col("id") == F.col("order_id"), "left")
    return o.select("id", F.when(~F.col("state").isin("sale", "done"), "not_confirmed").when(F.coalesce("n", F.lit(0)) == 0, "nothing_ready").otherwise("ok").alias("verdict"))


@register(
    "edit_lines_validate",
    oracle(
        """SELECT order_id, product_id, CASE WHEN o.state <> 'draft' THEN 'locked' WHEN l.qty - 25 <= 0 THEN 'bad_quantity' WHEN COUNT(*) OVER (PARTITION BY order_id, product_id) > 1 THEN 'ambiguous' ELSE 'update' END AS op, l.qty - 25 AS new_qty
        FROM sale_order_line l JOIN sale_order o ON o.id = l.order_id""",
        "sale_order_line", "sale_order",
    ),
)
def edit_lines_validate(spark: SparkSession, d: str) -> DataFrame:
    """Edits (25 fewer of each line) checked: drafts only, quantities above 0, one line per product."""
    rows = model.sale_order_line(spark, d).withColumn("new_qty", F.col("qty") - 25).select("order_id", "product_id", "new_qty")
    # dealt once by order, into as many tasks as there are million lines: windows and join sort these only, however many lines there are
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // LINES_PER_TASK))
    lines = rows.repartition(pieces, "order_id")
    several = F.count("*").over(Window.partitionBy("order_id", "product_id")) > 1
    o = model.sale_order(spark, d).select(F.col("id").alias("order_id"), "state")
    op = F.when(F.col("state") != "draft", "locked").when(F.col("new_qty") <= 0, "bad_quantity").when(F.col("several"), "ambiguous").otherwise("update")
    return lines.withColumn("several", several).join(o, "order_id").select("order_id", "product_id", op.alias("op"), "new_qty")


@register(
    "bom_diff",
    oracle(
        """SELECT coalesce(a.bom_id, b.bom_id) AS bom_id, coalesce(a.component_id, b.component_id) AS component_id, CASE WHEN a.bom_id IS NULL THEN 'add' WHEN b.bom_id IS NULL THEN 'remove' WHEN a.q <> b.q THEN 'change' ELSE 'keep' END AS op, b.q AS after
        FROM (SELECT bom_id, component_id, SUM(line_qty)::BIGINT AS q FROM bom_line GROUP BY 1, 2) a FULL JOIN (SELECT bom_id, component_id + CASE WHEN bom_id % 4 = 0 THEN 1 ELSE 0 END AS component_id, SUM(line_qty + bom_id % 2)::BIGINT AS q FROM bom_line GROUP BY 1, 2) b
        ON a.bom_id = b.bom_id AND a.component_id = b.component_id""",
        "product", "bom", "bom_line",
    ),
)
def bom_diff(spark: SparkSession, d: str) -> DataFrame:
    """Before against after by component: added, removed, changed, kept."""
    x = model.bom_line(spark, d)
    before = x.groupBy("bom_id", "component_id").agg(F.sum("line_qty").alias("before"))
    moved = F.col("component_id") + F.when(F.col("bom_id") % 4 == 0, 1).otherwise(0)
    after = x.groupBy("bom_id", moved.alias("component_id")).agg(F.sum(F.col("line_qty") + F.col("bom_id") % 2).alias("after"))
    op = F.when(F.col("before").isNull(), "add").when(F.col("after").isNull(), "remove").when(F.col("before") != F.col("after"), "change").otherwise("keep")
    return before.join(after, ["bom_id", "component_id"], "full").select("bom_id", "component_id", op.alias("op"), "after")


def expand_chains(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """starts(id, first, until) -> (id, steps): the tools after first up to until; null if until can't be reached.

    The edges are one per tool, so a chain is at most as long as the table; each round takes one step, for all of the table.
    """
    depth = edges.count()
    wave = starts.select("id", F.col("first").alias("at"), "until", F.array().cast("array<string>").alias("steps"), F.lit(False).alias("there"))
    hop = F.broadcast(edges.select(F.col("tool").alias("at"), "next"))
    for _ in range(depth):
        moved = wave.join(hop, "at", "left")
        ends = F.col("there") | F.col("next").isNull()
        wave = moved.select(
            "id",
            F.when(F.col("there"), F.col("at")).otherwise(F.col("next")).alias("at"),
            "until",
            F.when(ends, F.col("steps")).otherwise(F.concat("steps", F.array("next"))).alias("steps"),
            (F.col("there") | F.coalesce(F.col("next") == F.col("until"), F.lit(False))).alias("there"),
        )
    return wave.select("id", F.when(F.col("there"), F.array_join("steps", ">")).alias("steps"))


_EDGES = "edge(tool, next) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in NEXT_STEPS.items()) + ")"


_TOOLS = "[" + ", ".join(f"'{t}'" for t in NEXT_STEPS) + "]"
_STEPS = "[" + ", ".join(f"'{t}'" for t in NEXT_STEPS.values()) + "]"


@register(
    "chain_expand",
    f"""WITH RECURSIVE {_EDGES}, s AS (SELECT conv_id, turn, {_TOOLS}[length(text) % {len(NEXT_STEPS)} + 1] AS first, {_STEPS}[len(string_split(text, ' ')) % {len(NEXT_STEPS)} + 1] AS until FROM conversations),
    w AS (SELECT first, next AS at, next AS steps, 1 AS n FROM (SELECT DISTINCT first FROM s) JOIN edge ON tool = first UNION ALL SELECT first, e.next, steps || '>' || e.next, n + 1 FROM w JOIN edge e ON e.tool = w.at WHERE n < 17)
    SELECT s.conv_id, s.turn, w.steps FROM s LEFT JOIN w ON w.first = s.first AND w.at = s.until""",
)
def chain_expand(spark: SparkSession, d: str) -> DataFrame:
    """From the tool that a message names (by its length) to the step that it wants (by its words)."""
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (n % len(NEXT_STEPS)).cast("int"))
    first, until = pick(NEXT_STEPS, F.length("text")), pick(NEXT_STEPS.values(), F.size(F.split("text", " ")))
    starts = table(spark, d, "conversations").select("conv_id", "turn", first.alias("first"), until.alias("until"))
    edges = spark.createDataFrame(list(NEXT_STEPS.items()), "tool string, next string")
    # a pair of tools is expanded once; there are as many as the tools make
    pairs = starts.select("first", "until").distinct()
    chains = expand_chains(edges, pairs.select(F.struct("first", "until").alias("id"), "first", "until"))
    return starts.join(F.broadcast(chains.select("id.*", "steps")), ["first", "until"]).select("conv_id", "turn", "steps")


@register("continuation", f"WITH {_EDGES} SELECT conv_id, turn, next AS suggestion FROM (SELECT conv_id, turn, CASE WHEN contains(text, ',') THEN {_TOOLS}[length(text) % {len(NEXT_STEPS)} + 1] ELSE 'scrap' END AS tool FROM conversations) LEFT JOIN edge USING (tool)")
def continuation(spark: SparkSession, d: str) -> DataFrame:
    """What to offer after a command; the end of a chain offers nothing."""
    named = F.get(F.array(*map(F.lit, NEXT_STEPS)), (F.length("text") % len(NEXT_STEPS)).cast("int"))
    steps = F.create_map(*[F.lit(x) for kv in NEXT_STEPS.items() for x in kv])
    tool = F.when(F.contains("text", F.lit(",")), named).otherwise("scrap")
    return table(spark, d, "conversations").select("conv_id", "turn", F.try_element_at(steps, tool).alias("suggestion"))


@register(
    "vendor_price_upsert",
    oracle("SELECT partner_id, product_tmpl_id, arg_max(price_subtotal, [order_id::DOUBLE, price_subtotal::DOUBLE]) AS price, COUNT(*) AS n FROM purchase_line l JOIN product p ON p.id = l.product_id GROUP BY 1, 2", "purchase_line", "product"),
)
def vendor_price_upsert(spark: SparkSession, d: str) -> DataFrame:
    """One price per vendor and template: the latest one."""
    p = model.product(spark, d).select(F.col("id").alias("product_id"), "product_tmpl_id")
    lines = model.purchase_line(spark, d).join(p, "product_id")
    return lines.groupBy("partner_id", "product_tmpl_id").agg(F.max_by("price_subtotal", F.struct("order_id", "price_subtotal")).alias("price"), F.count("*").alias("n"))


@register("bill_from_po_check", oracle("SELECT order_id, CASE WHEN SUM(qty_received) > SUM(qty_invoiced) THEN 'to_invoice' WHEN SUM(qty_received) = 0 THEN 'not_received' ELSE 'nothing_to_bill' END AS verdict FROM purchase_line GROUP BY 1", "purchase_line"))
def bill_from_po_check(spark: SparkSession, d: str) -> DataFrame:
    g = model.purchase_line(spark, d).groupBy("order_id").agg(F.sum("qty_received").alias("r"), F.sum("qty_invoiced").alias("i"))
    return g.select("order_id", F.when(F.col("r") > F.col("i"), "to_invoice").when(F.col("r") == 0, "not_received").otherwise("nothing_to_bill").alias("verdict"))


@register("payment_check", oracle("SELECT id, CASE WHEN state <> 'posted' THEN 'not_posted' WHEN payment_state = 'paid' THEN 'refused' ELSE 'ok' END AS verdict, CASE WHEN state = 'posted' AND payment_state <> 'paid' THEN amount_residual END AS amount FROM invoice", "invoice"))
def payment_check(spark: SparkSession, d: str) -> DataFrame:
    """Payments always take the whole open amount."""
    ok = (F.col("state") == "posted") & (F.col("payment_state") != "paid")
    verdict = F.when(F.col("state") != "posted", "not_posted").when(F.col("payment_state") == "paid", "refused").otherwise("ok")
    return model.invoice(spark, d).select("id", verdict.alias("verdict"), F.when(ok, F.col("amount_residual")).alias("amount"))


@register("stock_adjust_check", oracle("SELECT product_id, location_id, CASE WHEN quantity - 40 < 0 THEN 'negative' ELSE 'ok' END AS verdict, CASE WHEN location_id = 2 THEN 'same_place' ELSE 'ok' END AS transfer FROM quant", "quant"))
def stock_adjust_check(spark: SparkSession, d: str) -> DataFrame:
    q = model.quant(spark, d)
    return q.select("product_id", "location_id", F.when(F.col("quantity") - 40 < 0, "negative").otherwise("ok").alias("verdict"), F.when(F.col("location_id") == 2, "same_place").otherwise("ok").alias("transfer"))


@register("lead_convert_check", oracle("SELECT id, CASE WHEN type = 'opportunity' THEN 'refused' WHEN stage = 'Won' THEN 'archived' ELSE 'ok' END AS verdict FROM lead", "lead"))
def lead_convert_check(spark: SparkSession, d: str) -> DataFrame:
    return model.lead(spark, d).select("id", F.when(F.col("type") == "opportunity", "refused").when(F.col("stage") == "Won", "archived").otherwise("ok").alias("verdict"))


@register("mo_complete_check", oracle("SELECT m.id, CASE WHEN m.state NOT IN ('confirmed', 'progress', 'to_close') THEN 'wrong_state' WHEN COUNT(b.id) FILTER (WHERE b.type = 'normal') <> 1 THEN 'no_single_recipe' ELSE 'ok' END AS verdict FROM production m LEFT JOIN product p ON p.id = m.product_id LEFT JOIN bom b ON b.product_tmpl_id = p.product_tmpl_id GROUP BY m.id, m.state", "production", "product", "bom"))
def mo_complete_check(spark: SparkSession, d: str) -> DataFrame:
    recipes = model.bom(spark, d).groupBy("product_tmpl_id").agg(F.count_if(F.col("type") == "normal").alias("n"))
    p = model.product(spark, d).select(F.col("id").alias("product_id"), "product_tmpl_id").join(recipes, "product_tmpl_id", "left").drop("product_tmpl_id")
    m = model.production(spark, d).join(p, "product_id", "left")
    verdict = F.when(~F.col("state").isin("confirmed", "progress", "to_close"), "wrong_state").when(F.coalesce("n", F.lit(0)) != 1, "no_single_recipe").otherwise("ok")
    return m.select("id", verdict.alias("verdict"))


#: Methods that a call may name, the last one unknown to the gate.
_METHODS = ("search_read", "unlink", "write", "read_group", "exec", "create")


@register(
    "method_gate",
    f"""SELECT conv_id, turn, CASE WHEN NOT regexp_full_match(model, '[a-zA-Z0-9._]+') THEN 'bad_model' WHEN m IN ('search_read', 'read_group', 'name_search') THEN 'read'
    WHEN m NOT IN ('create', 'write', 'action_confirm') THEN 'deny' WHEN key <> '' AND NOT regexp_full_match(key, '[a-z_][a-z0-9_]*') THEN 'bad_key' WHEN verdict <> 'confirm' THEN 'unconfirmed' ELSE 'write' END AS class
    FROM (SELECT *, {list(_METHODS)}[length(text) % 6 + 1] AS m, string_split(text, ' ')[1] AS model, coalesce(string_split(text, ' ')[2], '') AS key FROM (SELECT *, {language._VERDICT}))""",
)
def method_gate(spark: SparkSession, d: str) -> DataFrame:
    """A call's steps through the gate: the model's name, the method's class, the payload's keys, consent to what writes."""
    words = F.split("text", " ")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", F.get(F.array(*map(F.lit, _METHODS)), (F.length("text") % 6).cast("int")).alias("m"), F.get(words, 0).alias("model"), F.coalesce(F.get(words, 1), F.lit("")).alias("key"))
    bad_key = (F.col("key") != "") & ~F.col("key").rlike(variant.FIELD_KEY)
    verdict = (
        F.when(~F.col("model").rlike(r"^[a-zA-Z0-9._]+\z"), "bad_model")
        .when(F.col("m").isin("search_read", "read_group", "name_search"), "read")
        .when(~F.col("m").isin("create", "write", "action_confirm"), "deny")
        .when(bad_key, "bad_key")
        .when(language.consent(F.col("text")) != "confirm", "unconfirmed")
        .otherwise("write")
    )
    return rows.select("conv_id", "turn", verdict.alias("class"))
