"""Text classification, routing and plan parsing over documents and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.plans.registry import register
from ledgerloom.session import table

#: Words that confirm.
CONFIRM = [
    "có", "co", "yes", "y", "ya", "yeah", "yep", "ừ", "u", "uh",
    "ok", "oke", "okay", "okie", "đúng", "dung", "chuẩn", "chuan", "confirm",
    "đồng ý", "dong y", "xác nhận", "xac nhan", "làm đi", "lam di",
    "tiến hành", "tien hanh", "đồng ý luôn",
]
#: Words that cancel.
CANCEL = [
    "không", "khong", "ko", "no", "n", "nope", "hủy", "huy", "đừng", "dung lai",
    "thôi", "thoi", "cancel", "khoan", "khỏi", "khoi", "dừng", "dừng lại", "stop",
]
#: Marks of a question, accents folded.
QUESTION = ["?", "la gi", "nghia la", "nhu the nao", "the nao", "tai sao", "giai thich", "huong dan", "kiem tra", "tinh trang", "trang thai", "duoc khong"]
INTENTS = ["erp_read", "erp_write", "rag", "mixed", "chitchat"]

_FOLD_SQL = f"trim(regexp_replace(lower(strip_accents(translate(text, 'đĐ', 'dD'))), '[ \\t\\n\\r]+', ' ', 'g'))"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@register("fold_text", f"SELECT doc_id, md5({_FOLD_SQL}) AS folded FROM documents")
def fold_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.fold(F.col("text")).cast("binary")).alias("folded"))


@register("digit_tokens", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[0-9][0-9.,]*'), lambda x: translate(x, '.,', '')))), ' ') AS digits FROM documents")
def digit_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(T.digit_tokens(F.col("text")), " ").alias("digits"))


@register("caps_heading", "SELECT doc_id, list_sum(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN upper(x) = x AND lower(x) <> x AND length(x) <= 80 THEN 1 ELSE 0 END))::BIGINT AS n FROM documents")
def caps_heading(spark: SparkSession, d: str) -> DataFrame:
    heads = F.filter(F.split("text", "\n"), T.is_caps_heading)
    return table(spark, d, "documents").select("doc_id", F.size(heads).cast("long").alias("n"))


#: A reply's words, accents kept, with a space around each.
_SAID = "' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}_]+', ' ', 'g')) || ' '"
_VERDICT = f"""CASE WHEN yes AND NOT no THEN 'confirm' WHEN no AND NOT yes THEN 'cancel' ELSE 'unclear' END AS verdict FROM (
    SELECT *, len(list_filter({_list(CONFIRM)}, lambda w: contains(p, ' ' || w || ' '))) > 0 AS yes, len(list_filter({_list(CANCEL)}, lambda w: contains(p, ' ' || w || ' '))) > 0 AS no
    FROM (SELECT *, {_SAID} AS p FROM conversations))"""


def consent(text: Column) -> Column:
    """confirm, cancel or unclear: whole words and phrases with their accents; only a one-sided reply counts."""
    said = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}_]+", " ")), F.lit(" "))
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(said, F.concat(F.lit(" "), w, F.lit(" "))))
    yes, no = any_of(CONFIRM), any_of(CANCEL)
    return F.when(yes & ~no, "confirm").when(no & ~yes, "cancel").otherwise("unclear")


@register("keyword_confirm", f"SELECT conv_id, turn, {_VERDICT}")
def keyword_confirm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", consent(F.col("text")).alias("verdict"))


@register("question_veto", f"SELECT conv_id, turn, len(list_filter({_list(QUESTION)}, lambda m: contains({_FOLD_SQL}, m))) > 0 AS asks FROM conversations")
def question_veto(spark: SparkSession, d: str) -> DataFrame:
    folded = table(spark, d, "conversations").withColumn("f", T.fold(F.col("text")))
    return folded.select("conv_id", "turn", F.exists(F.array(*map(F.lit, QUESTION)), lambda m: F.contains(F.col("f"), m)).alias("asks"))


def proposals(spark: SparkSession, d: str) -> DataFrame:
    """A router's answers: a message, then the intent, perhaps a procedure, now and then malformed, by how long the message is."""
    n = F.length("text")
    intent = F.get(F.array(*map(F.lit, [*INTENTS, "nonsense"])), (n % 6).cast("int"))
    sop = F.when(n % 4 == 0, "\nSOP: receive_goods").when(n % 4 == 1, "\nsop: made_up").otherwise("")
    answer = F.when(n % 11 == 0, intent).otherwise(F.concat("text", F.lit("\n Intent: "), intent, sop))
    return table(spark, d, "conversations").select("conv_id", "turn", answer.alias("answer"))


_PROPOSALS = f"(SELECT conv_id, turn, CASE WHEN n % 11 = 0 THEN i ELSE text || chr(10) || ' Intent: ' || i || CASE n % 4 WHEN 0 THEN chr(10) || 'SOP: receive_goods' WHEN 1 THEN chr(10) || 'sop: made_up' ELSE '' END END AS answer FROM (SELECT *, length(text) AS n, {_list([*INTENTS, 'nonsense'])}[length(text) % 6 + 1] AS i FROM conversations))"


@register(
    "proposal_parse",
    f"""SELECT conv_id, turn, CASE WHEN list_contains({_list(INTENTS)}, v) THEN v WHEN list_contains({_list(INTENTS)}, lower(trim(answer))) THEN lower(trim(answer)) ELSE 'unknown' END AS intent, CASE WHEN s = 'receive_goods' THEN s END AS sop
    FROM (SELECT *, trim(regexp_extract(lower(answer), '(?m)^\\s*intent:(.*)$', 1)) AS v, trim(regexp_extract(answer, '(?im)^\\s*sop:(.*)$', 1)) AS s FROM {_PROPOSALS})""",
)
def proposal_parse(spark: SparkSession, d: str, sops=("receive_goods",)) -> DataFrame:
    """Unknown intents and made-up procedures are refused; a bare word counts as an intent."""
    value = F.trim(F.regexp_extract(F.lower("answer"), "(?m)^\\s*intent:(.*)$", 1))
    bare = F.lower(F.trim("answer"))
    intent = F.when(value.isin(INTENTS), value).when(bare.isin(INTENTS), bare).otherwise("unknown")
    sop = F.trim(F.regexp_extract("answer", "(?im)^\\s*sop:(.*)$", 1))
    return proposals(spark, d).select("conv_id", "turn", intent.alias("intent"), F.when(sop.isin(list(sops)), sop).alias("sop"))


@register(
    "route_decision",
    f"""SELECT conv_id, turn, CASE WHEN suggested AND verdict = 'confirm' THEN 'erp_write' WHEN sop AND (intent = 'erp_write' OR NOT asks) THEN 'receive_goods' ELSE intent END AS route FROM (
    SELECT c.conv_id, c.turn, coalesce(length(a.text) > 300, false) AS suggested, len(string_split(c.text, chr(10))) >= 3 AS sop, contains(c.text, '?') AS asks, verdict,
        CASE WHEN regexp_matches(c.text, '[0-9]') THEN 'erp_read' WHEN verdict = 'confirm' THEN 'erp_write' WHEN length(c.text) > 400 THEN 'rag' WHEN contains(c.text, ',') THEN 'mixed' ELSE 'chitchat' END AS intent
    FROM (SELECT *, {_VERDICT}) c LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 AND a.role = 'assistant')""",
)
def route_decision(spark: SparkSession, d: str) -> DataFrame:
    """Consent to a suggestion (a long answer just before) comes first, then a procedure (a message of several lines) unless the text asks
    something, then the intent that its words tell."""
    c = table(spark, d, "conversations")
    before = c.where("role = 'assistant'").select("conv_id", (F.col("turn") + 1).alias("turn"), (F.length("text") > 300).alias("suggested"))
    verdict = consent(F.col("text"))
    intent = F.when(F.col("text").rlike("[0-9]"), "erp_read").when(F.col("verdict") == "confirm", "erp_write").when(F.length("text") > 400, "rag").when(F.contains("text", F.lit(",")), "mixed").otherwise("chitchat")
    rows = c.withColumn("verdict", verdict).join(before, ["conv_id", "turn"], "left").withColumn("intent", intent)
    agreed = F.coalesce("suggested", F.lit(False)) & (F.col("verdict") == "confirm")
    take_sop = (F.size(F.split("text", "\n")) >= 3) & ((F.col("intent") == "erp_write") | ~F.contains("text", F.lit("?")))
    return rows.select("conv_id", "turn", F.when(agreed, "erp_write").when(take_sop, "receive_goods").otherwise(F.col("intent")).alias("route"))


@register(
    "plan_parse_tier",
    """SELECT conv_id, turn, CASE WHEN length(text) % 5 = 4 THEN NULL WHEN length(text) % 5 = 0 THEN 'raw' ELSE 'salvage' END AS tier, CASE WHEN length(text) % 5 < 4 THEN md5(text) END AS tool_md5 FROM conversations""",
)
def plan_parse_tier(spark: SparkSession, d: str) -> DataFrame:
    """Plans as a model writes them, with whole messages in them: bare, fenced, after thoughts, or spoilt; parsed raw, then cleaned, else given up."""
    plan = F.to_json(F.struct(F.col("text").alias("tool")))
    kind = F.length("text") % 5
    dressed = (
        F.when(kind == 0, plan)
        .when(kind == 1, F.concat(F.lit("```json\n"), plan, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit('<think>{"tool": 1}</think> '), plan))
        .when(kind == 3, F.concat(F.lit("<think>x</think>\n```\n"), plan, F.lit("\n```")))
        .otherwise(F.concat(F.lit("I would call "), plan, F.lit(" now")))
    )
    raw = table(spark, d, "conversations").select("conv_id", "turn", dressed.alias("answer"))
    schema = "tool string"
    parse = lambda c: F.when(F.trim(c).rlike(r"(?s)\A\{.*\}\z"), F.from_json(F.trim(c), schema)["tool"])
    first, second = parse(F.col("answer")), parse(T.strip_thinking_and_fence(F.col("answer")))
    tier = F.when(first.isNotNull(), "raw").when(second.isNotNull(), "salvage")
    return raw.select("conv_id", "turn", tier.alias("tier"), F.md5(F.coalesce(first, second).cast("binary")).alias("tool_md5"))


#: Names of tools that an answer must not show.
TOOL_NAMES = [
    "receive_order", "flag_order_for_review", "deliver_order",
    "create_discount_quote", "get_purchase_order_detail",
    "get_sale_order_detail", "ask_human(",
]


def leaks(text: Column) -> Column:
    """Names of tools in a text, whatever their case."""
    return F.filter(F.array(*map(F.lit, TOOL_NAMES)), lambda x: F.contains(F.lower(text), x))


@register("tool_leaks", f"SELECT conv_id, turn, array_to_string(list_filter({_list(TOOL_NAMES)}, lambda x: contains(lower(CASE WHEN role = 'assistant' THEN replace(text, ',', ' ' || upper({_list([*TOOL_NAMES, 'list_orders'])}[length(text) % 8 + 1])) ELSE text END), x)), ',') AS leaked FROM conversations")
def tool_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Answers, some of which name a tool where a comma was."""
    c = table(spark, d, "conversations")
    name = F.upper(F.get(F.array(*map(F.lit, [*TOOL_NAMES, "list_orders"])), (F.length("text") % 8).cast("int")))
    said = F.when(F.col("role") == "assistant", F.replace("text", F.lit(","), F.concat(F.lit(" "), name))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", F.array_join(leaks(said), ",").alias("leaked"))


@register("order_refs", "SELECT doc_id, regexp_matches(text || ' S' || length(text), 'S[0-9]{4,6}') AS refers FROM documents")
def order_refs(spark: SparkSession, d: str) -> DataFrame:
    """Texts with values shaped like references don't pass as names."""
    said = F.concat("text", F.lit(" S"), F.length("text").cast("string"))
    return table(spark, d, "documents").select("doc_id", said.rlike("S[0-9]{4,6}").alias("refers"))


@register("resume_decision", f"SELECT conv_id, turn, CASE WHEN role = 'system' OR contains(text, '?') THEN 'restart' WHEN verdict <> 'unclear' THEN 'resume' ELSE 'ask_again' END AS decision FROM (SELECT *, {_VERDICT})")
def resume_decision(spark: SparkSession, d: str) -> DataFrame:
    """A question starts anew, a clear reply goes on, anything else is asked again."""
    c = table(spark, d, "conversations")
    anew = (F.col("role") == "system") | F.contains("text", F.lit("?"))
    return c.select("conv_id", "turn", F.when(anew, "restart").when(consent(F.col("text")) != "unclear", "resume").otherwise("ask_again").alias("decision"))


@register("token_estimate", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@register("thought_strip", "SELECT doc_id, md5(CASE WHEN length(text) % 3 = 1 THEN '' WHEN length(text) % 3 = 0 THEN trim(text) ELSE text END) AS h FROM documents")
def thought_strip(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts: behind a thought block, behind one that never closes, or bare."""
    kind = F.length("text") % 3
    dressed = F.when(kind == 0, F.concat(F.lit("<thought>a\nb</thought>"), "text")).when(kind == 1, F.concat(F.lit(" <thought>never closed "), "text")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(T.strip_thoughts(dressed).cast("binary")).alias("h"))
