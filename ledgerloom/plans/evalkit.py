"""Evaluation: metrics over cases and outcomes, and gates against a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import text as T
from ledgerloom.operators.ranks import value_at_ranks
from ledgerloom.plans.registry import register
from ledgerloom.session import table

#: Predictions that the metrics judge: the label is guessed from the text's length.
_CASES = "cases AS (SELECT l.doc_id, l.quality, l.toxic, d.lang, d.text, d.n_chars, CASE WHEN d.n_chars > 1500 THEN 1 ELSE 0 END AS predicted, d.n_chars % 17 = 0 AS errored FROM labels l JOIN documents d USING (doc_id))"


def cases(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "text", "n_chars")
    joined = table(spark, d, "labels").join(docs, "doc_id")
    return joined.withColumns({"predicted": F.when(F.col("n_chars") > 1500, 1).otherwise(0), "errored": F.col("n_chars") % 17 == 0})


@register("metric_accuracy", f"WITH {_CASES} SELECT lang, COUNT(*) AS n, COUNT(*) FILTER (WHERE errored) AS errors, round(COUNT(*) FILTER (WHERE NOT errored AND predicted = quality) / COUNT(*), 6) AS acc FROM cases GROUP BY 1")
def metric_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """(n - fails - errors) / n."""
    right = F.count_if(~F.col("errored") & (F.col("predicted") == F.col("quality")))
    return cases(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.count_if("errored").alias("errors"), F.round(right / F.count("*"), 6).alias("acc"))


@register("metric_violations", f"WITH {_CASES} SELECT COUNT(*) FILTER (WHERE predicted = 1 AND quality = 0) AS false_confirm, COUNT(*) FILTER (WHERE predicted = 0 AND quality = 1) AS false_cancel, COUNT(*) FILTER (WHERE toxic = 1 AND predicted = 1) AS dangerous, COUNT(*) AS n FROM cases")
def metric_violations(spark: SparkSession, d: str) -> DataFrame:
    p, q = F.col("predicted"), F.col("quality")
    return cases(spark, d).agg(F.count_if((p == 1) & (q == 0)).alias("false_confirm"), F.count_if((p == 0) & (q == 1)).alias("false_cancel"), F.count_if((F.col("toxic") == 1) & (p == 1)).alias("dangerous"), F.count("*").alias("n"))


@register(
    "metric_tool_args",
    """SELECT event_type, round(COUNT(*) FILTER (WHERE tool) / COUNT(*), 6) AS tool_acc, round(COUNT(*) FILTER (WHERE tool AND k >= floor(abs(value))) / COUNT(*), 6) AS args_acc, COUNT(*) FILTER (WHERE k IS NULL) AS parse_fail FROM (
    SELECT event_type, value, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM event_type AS tool, try_cast(CASE WHEN value < 90 THEN props::JSON->>'k' END AS BIGINT) AS k FROM events) GROUP BY 1""",
)
def metric_tool_args(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of event: is it the one that the caller's last event foretells, do its arguments reach its value, and can they be read at all?"""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    k = F.when(F.col("value") < 90, F.get_json_object("props", "$.k")).try_cast("bigint")
    rows = table(spark, d, "events").select("event_type", "value", before.eqNullSafe(F.col("event_type")).alias("tool"), k.alias("k"))
    n = F.count("*")
    right = F.col("tool") & (F.col("k") >= F.floor(F.abs("value")))
    return rows.groupBy("event_type").agg(F.round(F.count_if("tool") / n, 6).alias("tool_acc"), F.round(F.count_if(right) / n, 6).alias("args_acc"), F.count_if(F.col("k").isNull()).alias("parse_fail"))


@register("metric_grounded", f"WITH {_CASES} SELECT doc_id, contains(lower(text), ' the ') OR contains(lower(text), ' der ') OR contains(lower(text), ' les ') AS grounded FROM cases")
def metric_grounded(spark: SparkSession, d: str) -> DataFrame:
    """Grounded if any of the accepted wordings occurs."""
    alternatives = F.array(*map(F.lit, (" the ", " der ", " les ")))
    return cases(spark, d).select("doc_id", F.exists(alternatives, lambda a: F.contains(F.lower("text"), a)).alias("grounded"))


@register("metric_gather", "SELECT user_id, list_has_all(list(event_type), ['click', 'purchase']) AS recalled, round(len(list_intersect(list_distinct(list(event_type)), ['click', 'purchase', 'view'])) / 3, 6) AS coverage FROM events GROUP BY 1")
def metric_gather(spark: SparkSession, d: str) -> DataFrame:
    """Were all required tools called, and what share of the facts was gathered."""
    need, facts = F.array(*map(F.lit, ("click", "purchase"))), F.array(*map(F.lit, ("click", "purchase", "view")))
    g = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    return g.select("user_id", (F.size(F.array_except(need, "s")) == 0).alias("recalled"), F.round(F.size(F.array_intersect("s", facts)) / 3, 6).alias("coverage"))


_DIGITS = "list_distinct(list_transform(regexp_extract_all({}, '[0-9][0-9.,]*'), lambda x: translate(x, '.,', '')))"


#: The sources of an answer: every other line.
_SOURCE = "array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: i % 2 = 1), ' ')"


@register(
    "metric_fusion",
    f"WITH {_CASES} SELECT doc_id, len(list_filter(f, lambda x: NOT list_contains(a, x)))::BIGINT AS fabricated FROM (SELECT doc_id, {_DIGITS.format('text')} AS f, {_DIGITS.format(_SOURCE)} AS a FROM cases)",
)
def metric_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of an answer (the whole text) that its sources (every other line) don't have."""
    source = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: i % 2 == 0), " ")
    made_up = F.array_except(T.digit_tokens(F.col("text")), T.digit_tokens(source))
    return cases(spark, d).select("doc_id", F.size(made_up).cast("long").alias("fabricated"))


@register("metric_latency", "SELECT event_type, COUNT(*) AS n, coalesce(quantile_disc(value, 0.5), 0) AS p50, coalesce(quantile_disc(value, 0.95), 0) AS p95 FROM events GROUP BY 1")
def metric_latency(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    ranks = value_at_ranks(e, "event_type", "value", {"p50": 0.5, "p95": 0.95}).drop("n")
    counts = e.groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.join(ranks, "event_type", "left").select("event_type", "n", F.coalesce("p50", F.lit(0.0)).alias("p50"), F.coalesce("p95", F.lit(0.0)).alias("p95"))


#: Gate, and what a set's result is held against.
BASELINES = [("en", 0.60), ("de", 0.55), ("fr", 0.90), ("es", 0.50)]


@register(
    "gate_eval",
    f"""WITH {_CASES}, base(lang, base) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in BASELINES)})
    SELECT lang, CASE WHEN errors * 10 > n THEN 'INFRA' WHEN dangerous > 200 THEN 'FAIL' WHEN acc >= base - 1.0 / n THEN 'PASS' ELSE 'FAIL' END AS verdict, CASE WHEN errors * 10 > n THEN 2 WHEN dangerous > 200 OR acc < base - 1.0 / n THEN 1 ELSE 0 END AS exit_code FROM (
    SELECT lang, COUNT(*) AS n, COUNT(*) FILTER (WHERE errored) AS errors, COUNT(*) FILTER (WHERE toxic = 1 AND predicted = 1) AS dangerous, COUNT(*) FILTER (WHERE NOT errored AND predicted = quality) / COUNT(*) AS acc FROM cases GROUP BY 1) JOIN base USING (lang)""",
)
def gate_eval(spark: SparkSession, d: str) -> DataFrame:
    """Too many errors say nothing of quality; else the absolute limit, then the baseline less one case."""
    base = spark.createDataFrame(BASELINES, "lang string, base double")
    right = F.count_if(~F.col("errored") & (F.col("predicted") == F.col("quality")))
    g = cases(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.count_if("errored").alias("errors"), F.count_if((F.col("toxic") == 1) & (F.col("predicted") == 1)).alias("dangerous"), (right / F.count("*")).alias("acc"))
    infra, bad = F.col("errors") * 10 > F.col("n"), (F.col("dangerous") > 200) | (F.col("acc") < F.col("base") - 1.0 / F.col("n"))
    return g.join(F.broadcast(base), "lang").select("lang", F.when(infra, "INFRA").when(bad, "FAIL").otherwise("PASS").alias("verdict"), F.when(infra, 2).when(bad, 1).otherwise(0).alias("exit_code"))


@register("metric_pacing", "SELECT event_type, round(60.0 / COUNT(*) * 1.2, 9) AS pace FROM events GROUP BY 1")
def metric_pacing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.lit(60.0) / F.count("*") * 1.2, 9).alias("pace"))


@register("rescore_baseline", f"WITH {_CASES} SELECT doc_id, len(f)::BIGINT AS original, len(list_filter(f, lambda x: length(x) > 2))::BIGINT AS rescored FROM (SELECT doc_id, {_DIGITS.format('text')} AS f FROM cases)")
def rescore_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Findings that turn out to be derived are taken out; the original count stays beside."""
    f = T.digit_tokens(F.col("text"))
    return cases(spark, d).select("doc_id", F.size(f).cast("long").alias("original"), F.size(F.filter(f, lambda x: F.length(x) > 2)).cast("long").alias("rescored"))


@register("entity_in_question", f"WITH {_CASES} SELECT doc_id, NOT contains(lower(text), lang) AS fabricated FROM cases")
def entity_in_question(spark: SparkSession, d: str) -> DataFrame:
    """A value that the question doesn't have is made up."""
    return cases(spark, d).select("doc_id", (~F.contains(F.lower("text"), F.col("lang"))).alias("fabricated"))
