"""More command rules: a command and the records it names give a verdict and what the record becomes. Nothing is changed here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators import domain, guards
from ledgerloom.plans import language, model
from ledgerloom.plans.model import oracle
from ledgerloom.plans.registry import register
from ledgerloom.session import table

#: Kinds of moves that can be posted, vendors that one request for quotation may go to, attempts and failures in a row of a run.
POSTABLE = ("out_invoice", "in_invoice", "out_refund", "in_refund")
MOST_VENDORS = 10
ATTEMPTS, BREAKER = 3, 5


def only_one(n):
    """What a search that must find exactly one record says."""
    return F.when(n == 0, "not_found").when(n > 1, "ambiguous").otherwise("ok")


@register(
    "invoice_post_check",
    oracle(
        f"""SELECT p.id AS partner_id, CASE COUNT(d.id) WHEN 0 THEN 'not_found' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS verdict, CASE WHEN COUNT(d.id) = 1 THEN MIN(d.id) END AS posted_id
        FROM partner p LEFT JOIN (SELECT *, MAX(amount_total) OVER (PARTITION BY partner_id) AS most FROM invoice WHERE state = 'draft' AND move_type IN {POSTABLE}) d
        ON d.partner_id = p.id AND (p.balance <= 0 OR d.amount_total = d.most) GROUP BY 1""",
        "partner", "invoice",
    ),
)
def invoice_post_check(spark: SparkSession, d: str) -> DataFrame:
    """Post a partner's draft, found by name; who owes something also says the amount, that of the largest draft."""
    drafts = model.invoice(spark, d).where(F.col("state") == "draft").where(F.col("move_type").isin(*POSTABLE)).select("id", "partner_id", "amount_total")
    most = drafts.groupBy("partner_id").agg(F.max("amount_total").alias("most"))
    said = model.partner(spark, d).select(F.col("id").alias("partner_id"), "balance").join(most, "partner_id", "left")
    said = said.select("partner_id", F.when(F.col("balance") > 0, F.col("most")).alias("amount"))
    found = drafts.join(said, "partner_id").where(F.col("amount").isNull() | (F.col("amount_total") == F.col("amount")))
    hits = found.groupBy("partner_id").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    rows = said.join(hits, "partner_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("partner_id", only_one(F.col("n")).alias("verdict"), F.when(F.col("n") == 1, F.col("id")).alias("posted_id"))


@register("credit_memo_check", oracle("SELECT id, CASE WHEN move_type <> 'out_invoice' THEN 'not_found' WHEN state <> 'posted' THEN 'not_posted' ELSE 'ok' END AS verdict, CASE WHEN move_type = 'out_invoice' AND state = 'posted' THEN 'draft' END AS memo_state, CASE WHEN move_type = 'out_invoice' AND state = 'posted' THEN amount_total END AS amount FROM invoice", "invoice"))
def credit_memo_check(spark: SparkSession, d: str) -> DataFrame:
    """Only a posted customer invoice gets a credit memo, a draft over its whole amount."""
    verdict = F.when(F.col("move_type") != "out_invoice", "not_found").when(F.col("state") != "posted", "not_posted").otherwise("ok")
    rows = model.invoice(spark, d).withColumn("verdict", verdict)
    ok = F.col("verdict") == "ok"
    return rows.select("id", "verdict", F.when(ok, "draft").alias("memo_state"), F.when(ok, F.col("amount_total")).alias("amount"))


@register(
    "return_check",
    oracle(
        """SELECT k.order_id, k.id AS picking_id, CASE WHEN k.state <> 'done' THEN 'not_done' WHEN COUNT(r.l_partkey) FILTER (WHERE x.product IS NULL) > 0 THEN 'not_delivered' WHEN COUNT(r.l_partkey) = 0 THEN 'all' ELSE 'lines' END AS verdict,
        CASE WHEN COUNT(r.l_partkey) FILTER (WHERE x.product IS NULL) = 0 AND k.state = 'done' THEN coalesce(SUM(r.l_quantity::DECIMAL(18,2)), MAX(w.qty)) END AS qty
        FROM (SELECT * FROM picking QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY id) = 1) k
        LEFT JOIN (SELECT l_orderkey * 10 + l_linenumber AS id, SUM(l_quantity::DECIMAL(18,2)) AS qty FROM lineitem GROUP BY 1) w ON w.id = k.id
        LEFT JOIN lineitem r ON r.l_orderkey = k.order_id AND r.l_returnflag = 'R'
        LEFT JOIN (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id, l_partkey AS product FROM lineitem) x ON x.id = k.id AND x.product = r.l_partkey GROUP BY 1, 2, k.state""",
        "picking",
    ),
)
def return_check(spark: SparkSession, d: str) -> DataFrame:
    """Return an order's first delivery: what is named must have been in it, nothing named means all of it."""
    first = Window.partitionBy("order_id").orderBy("id")
    picking = model.picking(spark, d).select("order_id", F.col("id").alias("picking_id"), "state", F.row_number().over(first).alias("n")).where("n = 1").drop("n")
    lines = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("picking_id"), F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product"), model.money("l_quantity").alias("qty"), "l_returnflag")
    whole = lines.groupBy("picking_id").agg(F.sum("qty").alias("whole"), F.collect_set("product").alias("delivered"))  # the lines of one delivery
    named = lines.where("l_returnflag = 'R'").select("order_id", "product", "qty")
    rows = picking.join(whole, "picking_id", "left").join(named, "order_id", "left")
    missing = F.count_if(F.col("product").isNotNull() & ~F.array_contains("delivered", F.col("product")))
    g = rows.groupBy("order_id", "picking_id", "state").agg(missing.alias("missing"), F.count("product").alias("n"), F.coalesce(F.sum("qty"), F.max("whole")).alias("qty"))
    verdict = F.when(F.col("state") != "done", "not_done").when(F.col("missing") > 0, "not_delivered").when(F.col("n") == 0, "all").otherwise("lines")
    return g.select("order_id", "picking_id", verdict.alias("verdict"), F.when(verdict.isin("all", "lines"), F.col("qty")).alias("qty"))


@register("scrap_check", oracle("SELECT q.product_id, q.location_id, CASE WHEN p.size - 3 <= 0 THEN 'bad_quantity' WHEN q.quantity < p.size - 3 THEN 'insufficient' ELSE 'ok' END AS verdict, CASE WHEN p.size - 3 > 0 AND q.quantity >= p.size - 3 THEN (q.quantity - (p.size - 3))::DECIMAL(18,2) ELSE q.quantity END AS remaining FROM quant q JOIN product p ON p.id = q.product_id", "quant", "product"))
def scrap_check(spark: SparkSession, d: str) -> DataFrame:
    """Scrap some of a product (its size less three): a positive quantity, and no more than lies there."""
    p = model.product(spark, d).select(F.col("id").alias("product_id"), (F.col("size") - 3).alias("scrap"))
    rows = model.quant(spark, d).join(p, "product_id")
    verdict = F.when(F.col("scrap") <= 0, "bad_quantity").when(F.col("quantity") < F.col("scrap"), "insufficient").otherwise("ok")
    left = F.when(verdict == "ok", (F.col("quantity") - F.col("scrap")).cast("decimal(18,2)")).otherwise(F.col("quantity"))
    return rows.select("product_id", "location_id", verdict.alias("verdict"), left.alias("remaining"))


@register("bulk_rfq_check", oracle(f"SELECT p.id AS product_id, COUNT(DISTINCT l.partner_id) AS n_vendors, CASE WHEN COUNT(DISTINCT l.partner_id) = 0 THEN 'no_vendor' WHEN COUNT(DISTINCT l.partner_id) > {MOST_VENDORS} THEN 'too_many' ELSE 'ok' END AS verdict FROM product p LEFT JOIN purchase_line l ON l.product_id = p.id GROUP BY 1", "product", "purchase_line"))
def bulk_rfq_check(spark: SparkSession, d: str) -> DataFrame:
    """One request for quotation to all who ever sold a product."""
    vendors = model.purchase_line(spark, d).select(F.col("product_id").alias("id"), "partner_id").distinct().groupBy("id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    verdict = F.when(n == 0, "no_vendor").when(n > MOST_VENDORS, "too_many").otherwise("ok")
    return model.product(spark, d).select("id").join(vendors, "id", "left").select(F.col("id").alias("product_id"), n.alias("n_vendors"), verdict.alias("verdict"))


@register("confirm_purchase_check", oracle("SELECT order_id, CASE WHEN bool_or(qty_received > 0) THEN 'refused' ELSE 'ok' END AS verdict, CASE WHEN bool_or(qty_received > 0) THEN MIN(state) ELSE 'purchase' END AS next_state FROM purchase_line GROUP BY 1", "purchase_line"))
def confirm_purchase_check(spark: SparkSession, d: str) -> DataFrame:
    """Orders of which nothing has been received are taken as drafts; others are confirmed already and are refused."""
    known = F.bool_or(F.col("qty_received") > 0)
    g = model.purchase_line(spark, d).groupBy("order_id").agg(known.alias("known"), F.min("state").alias("state"))
    return g.select("order_id", F.when(F.col("known"), "refused").otherwise("ok").alias("verdict"), F.when(F.col("known"), F.col("state")).otherwise("purchase").alias("next_state"))


@register(
    "mail_lifecycle",
    f"""SELECT a.conv_id, a.turn, CASE WHEN r.verdict IS NULL OR r.verdict = 'unclear' THEN 'cancel' WHEN r.verdict = 'cancel' THEN 'deleted' WHEN contains(a.text, ',') THEN 'sent' ELSE 'exception' END AS state
    FROM conversations a LEFT JOIN (SELECT conv_id, turn, {language._VERDICT}) r ON r.conv_id = a.conv_id AND r.turn = a.turn + 1 WHERE a.role = 'assistant'""",
)
def mail_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Each answer is a prepared mail, inert ('cancel') from the start: consent in the next message sends it, which fails without a recipient
    (no comma in it), a refusal deletes it, anything else leaves it as it is."""
    c = table(spark, d, "conversations")
    reply = c.select("conv_id", (F.col("turn") - 1).alias("turn"), language.consent(F.col("text")).alias("verdict"))
    rows = c.where("role = 'assistant'").join(reply, ["conv_id", "turn"], "left")
    sent = F.when(F.contains("text", F.lit(",")), "sent").otherwise("exception")
    state = F.when(F.col("verdict") == "confirm", sent).when(F.col("verdict") == "cancel", "deleted").otherwise("cancel")
    return rows.select("conv_id", "turn", state.alias("state"))


@register("clamped_search", oracle(f"SELECT id, name, date_order FROM sale_order WHERE state = 'sale' ORDER BY date_order DESC, id LIMIT {domain.ROW_CAP}", "sale_order"))
def clamped_search(spark: SparkSession, d: str, limit: int | None = 500) -> DataFrame:
    """A record search never gives more rows than the cap, whatever is asked; the cap is the feature."""
    return domain.search_read(spark, d, "sale_order", [("state", "=", "sale")], ["id", "name", "date_order"], "date_order desc, id", domain.clamp(limit))


_RUNS = f"""a AS (SELECT user_id, date_trunc('day', ts)::DATE AS day, value < 40 AS bad, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS attempt FROM events),
c AS (SELECT user_id, day, least(MIN(attempt) FILTER (WHERE NOT bad), COUNT(*)) AS attempts, bool_and(bad) AS failed FROM a WHERE attempt <= {ATTEMPTS} GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i, COUNT(*) FILTER (WHERE NOT failed) OVER (PARTITION BY user_id ORDER BY day) AS island FROM c),
s AS (SELECT *, COUNT(*) FILTER (WHERE failed) OVER (PARTITION BY user_id, island ORDER BY day) AS streak FROM n),
b AS (SELECT *, MIN(i) FILTER (WHERE streak >= {BREAKER}) OVER (PARTITION BY user_id) AS stop FROM s)"""


@register(
    "retried_runs",
    f"""WITH {_RUNS} SELECT user_id, day, CASE WHEN i > stop THEN 'not_run' WHEN failed THEN 'error' ELSE 'ok' END AS outcome, CASE WHEN NOT coalesce(i > stop, false) THEN attempts END AS attempts,
    round(60.0 / 30 * 1.2 * coalesce(SUM(CASE WHEN NOT coalesce(i > stop, false) THEN attempts ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS starts_at FROM b""",
)
def retried_runs(spark: SparkSession, d: str, rpm: int = 30) -> DataFrame:
    """A caller's days are cases: at most two retries each, errors apart from answers, no more cases after five errors in a row, and a
    pace that keeps calls below the quota."""
    order = Window.partitionBy("user_id").orderBy("day")
    a = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", (F.col("value") < 40).alias("bad"))
    a = a.withColumn("attempt", F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id"))).where(F.col("attempt") <= ATTEMPTS)
    c = a.groupBy("user_id", "day").agg(F.least(F.min(F.when(~F.col("bad"), F.col("attempt"))), F.count("*")).alias("attempts"), F.bool_and("bad").alias("failed"))
    c = c.withColumn("i", F.row_number().over(order)).withColumn("island", F.count_if(~F.col("failed")).over(order))
    c = c.withColumn("streak", F.count_if("failed").over(Window.partitionBy("user_id", "island").orderBy("day")))
    c = c.withColumn("stop", F.min(F.when(F.col("streak") >= BREAKER, F.col("i"))).over(Window.partitionBy("user_id")))
    ran = ~F.coalesce(F.col("i") > F.col("stop"), F.lit(False))
    before = F.coalesce(F.sum(F.when(ran, F.col("attempts")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    outcome = F.when(~ran, "not_run").when(F.col("failed"), "error").otherwise("ok")
    return c.select("user_id", "day", outcome.alias("outcome"), F.when(ran, F.col("attempts")).alias("attempts"), F.round(60.0 / rpm * 1.2 * before, 6).alias("starts_at"))


@register("name_guard", oracle(r"SELECT kind, name, regexp_full_match(name, '(S\d{4,6}|P\d{4,6}|WH/(IN|OUT|INT)/\d+|INV/\d{4}/\d+)') AS refused FROM (SELECT 'order' AS kind, name FROM sale_order UNION ALL SELECT 'invoice', name FROM invoice UNION ALL SELECT 'partner', name FROM partner UNION ALL SELECT 'product', default_code FROM product)", "sale_order", "invoice", "partner", "product"))
def name_guard(spark: SparkSession, d: str) -> DataFrame:
    """A value for a name that has the shape of a document's reference is refused; here all names and codes there are."""
    named = lambda kind, df, c="name": df.select(F.lit(kind).alias("kind"), F.col(c).alias("name"))
    rows = named("order", model.sale_order(spark, d)).unionByName(named("invoice", model.invoice(spark, d)))
    rows = rows.unionByName(named("partner", model.partner(spark, d))).unionByName(named("product", model.product(spark, d), "default_code"))
    return rows.select("kind", "name", F.col("name").rlike(guards.REFERENCES.pattern).alias("refused"))


#: Arguments that a call may have.
_ARGUMENTS = ("k", "click", "view")


@register("argument_guard", f"SELECT event_id, array_to_string(list_sort(list_filter(list_distinct(['k', event_type]), lambda x: x NOT IN {_ARGUMENTS})), ',') AS unknown FROM events")
def argument_guard(spark: SparkSession, d: str) -> DataFrame:
    """Arguments of a call that its tool doesn't name, by which it is refused."""
    call = F.to_json(F.map_concat(F.from_json("props", "map<string,string>"), F.create_map("event_type", F.lit("1"))))
    unknown = F.array_except(F.json_object_keys(call), F.array(*map(F.lit, _ARGUMENTS)))
    return table(spark, d, "events").select("event_id", F.array_join(F.array_sort(unknown), ",").alias("unknown"))
