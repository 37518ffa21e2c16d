"""Time-windowed ledgers: usage, quota verdicts, routes, rate limits, confirmations, threads, audit chains."""

from __future__ import annotations

import hashlib
import json
from collections import deque
from collections.abc import Iterator
from datetime import timezone
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.plans import model
from ledgerloom.plans.model import oracle
from ledgerloom.plans.registry import register
from ledgerloom.session import new_folder, table
from ledgerloom.sources.files import append_log, read_fixture, write_job_result

NOW = "2024-01-20 00:00:00"
GENESIS = "0" * 64
RATE_LIMIT_SECONDS = 60
#: Models that a fallback chain may have.
MOST_MODELS = 1000


@register("usage_since", oracle(f"SELECT alias, COUNT(*) AS requests, coalesce(SUM(total_tokens), 0)::BIGINT AS tokens FROM usage WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{NOW}' GROUP BY 1", "usage"))
def usage_since(spark: SparkSession, d: str, now: str = NOW, hours: int = 24) -> DataFrame:
    at = F.lit(now).cast("timestamp_ntz")
    u = model.usage(spark, d).where((F.col("ts") >= at - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("ts") <= at))
    return u.groupBy("alias").agg(F.count("*").alias("requests"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"))


#: Per provider: scope, requests a day, requests a minute, tokens a minute, token multiplier.
QUOTAS = [("alpha", "account", 80, 2, 400, 1.0), ("beta", "model", 40, 3, 150, 2.3), ("gamma", "model", 60, 2, 300, 1.5)]
_QUOTA_SQL = "q(provider, scope, rpd, rpm, tpm, mult) AS (VALUES " + ", ".join(f"('{p}', '{s}', {a}, {b}, {c}, {m})" for p, s, a, b, c, m in QUOTAS) + ")"


@register(
    "budget_verdict",
    oracle(
        """SELECT event_id, scope_key, day_requests, CASE WHEN day_requests >= rpd THEN 'RPD' WHEN minute_requests >= rpm THEN 'RPM'
        WHEN minute_tokens + floor(20 * mult) > tpm THEN 'TPM' ELSE 'OK' END AS verdict FROM (
        SELECT event_id, scope_key, rpd, rpm, tpm, mult,
          COUNT(*) OVER d - 1 AS day_requests, COUNT(*) OVER m - 1 AS minute_requests, (SUM(total_tokens) OVER m - total_tokens) AS minute_tokens
        FROM (SELECT u.*, q.* EXCLUDE (provider), CASE WHEN scope = 'account' THEN u.provider ELSE alias END AS scope_key FROM usage u JOIN (WITH """
        + _QUOTA_SQL
        + """ SELECT * FROM q) q ON q.provider = u.provider)
        WINDOW d AS (PARTITION BY scope_key ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW),
               m AS (PARTITION BY scope_key ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW))""",
        "usage",
    ),
)
def budget_verdict(spark: SparkSession, d: str, base_tokens: int = 20) -> DataFrame:
    """What the quota says of each call, from the calls before it: day, then minute, then tokens a minute.

    An account's models share one window, other models have their own. The call itself isn't in its window.
    """
    quotas = spark.createDataFrame(QUOTAS, "provider string, scope string, rpd int, rpm int, tpm int, mult double")
    scopes = F.broadcast(quotas.select("provider", "scope"))
    u = model.usage(spark, d).join(scopes, "provider").select("event_id", "provider", "ts", "total_tokens", F.when(F.col("scope") == "account", F.col("provider")).otherwise(F.col("alias")).alias("scope_key"))
    # a day of a key is one group, with the day before carried along; so no key's whole history is in one task
    own = F.to_date("ts")
    days = u.withColumn("day", F.explode(F.array(own, F.date_add(own, 1)))).withColumn("event_id", F.when(F.col("day") == own, F.col("event_id")))
    # calls up to now less those before the window: both run along, whereas a window that slides is counted anew for each call
    upto = "over (partition by scope_key, day order by ts range between unbounded preceding and {})"
    now, day, minute = upto.format("current row"), upto.format("interval '24:00:00.000001' hour to second preceding"), upto.format("interval '01:00.000001' minute to second preceding")
    w = days.selectExpr(
        "event_id", "scope_key", "provider", "day = to_date(ts) as own",
        f"count(*) {now} - count(*) {day} - 1 as day_requests", f"count(*) {now} - count(*) {minute} - 1 as minute_requests",
        f"sum(total_tokens) {now} - coalesce(sum(total_tokens) {minute}, 0) - total_tokens as minute_tokens",
    ).where("own").join(F.broadcast(quotas.drop("scope")), "provider")
    verdict = (
        F.when(F.col("day_requests") >= F.col("rpd"), "RPD")
        .when(F.col("minute_requests") >= F.col("rpm"), "RPM")
        .when(F.col("minute_tokens") + F.floor(base_tokens * F.col("mult")) > F.col("tpm"), "TPM")
        .otherwise("OK")
    )
    return w.select("event_id", "scope_key", "day_requests", verdict.alias("verdict"))


@register(
    "cooldown_until",
    oracle("SELECT alias, MAX(ts + CASE WHEN total_tokens % 7 = 0 THEN INTERVAL 60 SECOND ELSE INTERVAL 15 SECOND END) AS until FROM usage WHERE total_tokens % 5 = 0 GROUP BY 1", "usage"),
)
def cooldown_until(spark: SparkSession, d: str) -> DataFrame:
    """Failed calls rest their model: a minute for quota errors, else fifteen seconds."""
    u = model.usage(spark, d).where("total_tokens % 5 = 0")
    until = F.when(F.col("total_tokens") % 7 == 0, F.col("ts") + F.expr("INTERVAL 60 SECONDS")).otherwise(F.col("ts") + F.expr("INTERVAL 15 SECONDS"))
    return u.groupBy("alias").agg(F.max(until).alias("until"))


@register(
    "route_first_ok",
    oracle(
        """SELECT caller, min_by(alias, depth) FILTER (WHERE n < 2) AS chosen, coalesce(array_to_string(list(alias || ':RPD' ORDER BY depth) FILTER (WHERE n >= 2 AND depth < coalesce(first_ok, 99)), ','), '') AS skipped FROM (
        SELECT *, MIN(depth) FILTER (WHERE n < 2) OVER (PARTITION BY caller) AS first_ok FROM (
        SELECT c.caller, a.alias, a.depth, (SELECT COUNT(*) FROM usage u WHERE u.caller = c.caller AND u.alias = a.alias) AS n
        FROM (SELECT DISTINCT caller FROM usage) c, (SELECT alias, row_number() OVER (ORDER BY alias) AS depth FROM (SELECT DISTINCT alias FROM usage)) a)) GROUP BY 1""",
        "usage",
    ),
)
def route_first_ok(spark: SparkSession, d: str, limit: int = 2) -> DataFrame:
    """Per caller the first model of the fallback chain with quota left, and those skipped before it with the reason.

    The chain is a fixed short list; callers are crossed with it by exploding an array, and counts joined.
    """
    u = model.usage(spark, d)
    chain = [r["alias"] for r in u.select("alias").distinct().orderBy("alias").limit(MOST_MODELS + 1).collect()]
    if len(chain) > MOST_MODELS:
        raise ValueError(f"a fallback chain of more than {MOST_MODELS} models")
    links = u.select("caller").distinct().select("caller", F.posexplode(F.array(*map(F.lit, chain))).alias("depth", "alias"))
    counts = u.groupBy("caller", "alias").agg(F.count("*").alias("n"))
    links = links.join(counts, ["caller", "alias"], "left").withColumn("ok", F.coalesce("n", F.lit(0)) < limit)
    links = links.withColumn("first_ok", F.min(F.when(F.col("ok"), F.col("depth"))).over(Window.partitionBy("caller")))
    late = (~F.col("ok")) & (F.col("depth") < F.coalesce("first_ok", F.lit(99)))
    skipped = F.array_sort(F.collect_list(F.when(late, F.struct("depth", F.concat("alias", F.lit(":RPD")).alias("why")))))
    return links.groupBy("caller").agg(F.min_by(F.when(F.col("ok"), F.col("alias")), F.when(F.col("ok"), F.col("depth"))).alias("chosen"), F.array_join(F.transform(skipped, lambda x: x["why"]), ",").alias("skipped"))


def admit(calls: DataFrame, limit: int, seconds: int = RATE_LIMIT_SECONDS) -> DataFrame:
    """calls(caller, ts, event_id) with admitted: fewer than limit admitted calls in the seconds before.

    Denied calls aren't recorded, so each verdict depends on earlier ones. A caller's calls come in order, batch after batch; what is
    kept between them is the admitted calls of the last seconds.
    """
    span = pd.Timedelta(seconds=seconds)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller, recent = None, deque()
        for part in batches:
            verdicts = []
            for c, t in zip(part["caller"], part["ts"], strict=True):
                if c != caller:
                    caller, recent = c, deque()
                while recent and recent[0] <= t - span:
                    recent.popleft()
                verdicts.append(len(recent) < limit)
                if verdicts[-1]:
                    recent.append(t)
            yield part.assign(admitted=verdicts)

    ordered = calls.select("caller", "ts", "event_id").repartition("caller").sortWithinPartitions("caller", "ts", "event_id")
    return ordered.mapInPandas(fold, "caller long, ts timestamp_ntz, event_id long, admitted boolean")


#: Call by call: one is admitted if the second last admitted one lies outside the window.
ADMITTED_SQL = """WITH RECURSIVE n AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT event_id, user_id, ts, i, true AS admitted, ts AS a1, NULL::TIMESTAMP AS a2 FROM n WHERE i = 1
      UNION ALL SELECT event_id, user_id, ts, i, ok, CASE WHEN ok THEN ts ELSE a1 END, CASE WHEN ok THEN a1 ELSE a2 END
      FROM (SELECT n.*, r.a1, r.a2, r.a2 IS NULL OR r.a2 <= n.ts - INTERVAL 1 DAY AS ok FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1))"""


@register("rate_limit_admit", f"{ADMITTED_SQL} SELECT user_id AS caller, ts, event_id, admitted FROM r")
def rate_limit_admit(spark: SparkSession, d: str, limit: int = 2) -> DataFrame:
    return admit(model.usage(spark, d), limit, 86_400)


@register(
    "rate_limit_upper_bound",
    oracle("SELECT event_id, COUNT(*) OVER (PARTITION BY caller ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS calls FROM usage", "usage"),
)
def rate_limit_upper_bound(spark: SparkSession, d: str) -> DataFrame:
    """Calls in the window, denied ones included: what admission can reach at most."""
    return model.usage(spark, d).selectExpr("event_id", "count(*) over (partition by caller order by ts range between interval 1 day preceding and current row) as calls")


@register(
    "confirm_expiry",
    oracle("SELECT event_id, alias, date_diff('second', prev, ts) > 300 AS expired FROM (SELECT *, lag(ts) OVER (PARTITION BY caller ORDER BY ts, event_id) AS prev FROM usage)", "usage"),
)
def confirm_expiry(spark: SparkSession, d: str, seconds: int = 300) -> DataFrame:
    """A reply that comes over five minutes after the question is discarded; a first one has none (null)."""
    before = F.lag("ts").over(Window.partitionBy("caller").orderBy("ts", "event_id"))
    gap = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(before.cast("timestamp"))
    return model.usage(spark, d).select("event_id", "alias", (gap > seconds).alias("expired"))


@register("thread_id", "SELECT conv_id, 't-' || substr(sha1(min_by(text, turn)), 1, 16) AS thread FROM conversations WHERE role = 'user' AND length(trim(text)) > 0 GROUP BY 1")
def thread_id(spark: SparkSession, d: str) -> DataFrame:
    """Without an explicit id, a thread is named after its first user message."""
    c = table(spark, d, "conversations").where("role = 'user' and length(trim(text)) > 0")
    return c.groupBy("conv_id").agg(F.concat(F.lit("t-"), F.substring(F.sha1(F.min_by("text", "turn").cast("binary")), 1, 16)).alias("thread"))


@register("fresh_reset", "SELECT conv_id, COUNT(*) FILTER (WHERE role = 'user') = 1 AS fresh, COUNT(*) AS n_messages FROM conversations WHERE role IN ('user', 'assistant') AND length(trim(text)) > 0 GROUP BY 1")
def fresh_reset(spark: SparkSession, d: str) -> DataFrame:
    """Only user and assistant messages with text count; one user message is a fresh thread."""
    c = table(spark, d, "conversations").where("role in ('user', 'assistant') and length(trim(text)) > 0")
    return c.groupBy("conv_id").agg((F.count_if(F.col("role") == "user") == 1).alias("fresh"), F.count("*").alias("n_messages"))


@register("latest_per_channel", "SELECT conv_id, role, max_by(text, turn) AS text, max(turn) AS turn FROM conversations GROUP BY 1, 2")
def latest_per_channel(spark: SparkSession, d: str) -> DataFrame:
    """Last write wins, per thread and channel."""
    return table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))


@register("flag_anchor", "SELECT conv_id, turn, COUNT(*) OVER (PARTITION BY conv_id) = turn + 2 AS live FROM conversations WHERE role = 'assistant' OR role = 'user'")
def flag_anchor(spark: SparkSession, d: str) -> DataFrame:
    """A flag set at a message holds only while exactly one more message has come."""
    c = table(spark, d, "conversations").where("role in ('assistant', 'user')")
    return c.select("conv_id", "turn", (F.count("*").over(Window.partitionBy("conv_id")) == F.col("turn") + 2).alias("live"))


# --- audit chain ----------------------------------------------------------------------------


def entry_hash(prev: str, row) -> str:
    """sha256 of the JSON array of the link and the fields; times are UTC."""
    at = row.ts.tz_localize(timezone.utc) if row.ts.tzinfo is None else row.ts.tz_convert(timezone.utc)
    fields = [prev, at.to_pydatetime().isoformat(), row.event_type, str(row.caller), row.tool_name]
    return hashlib.sha256(json.dumps(fields, ensure_ascii=False).encode()).hexdigest()


AUDIT = "chain long, id long, ts timestamp_ntz, event_type string, caller long, tool_name string, prev_hash string, entry_hash string"


def audit_rows(events: DataFrame) -> DataFrame:
    """One chain per caller: each chain has a single writer, and chains are linked side by side."""
    return events.select(F.col("user_id").alias("chain"), F.col("event_id").alias("id"), "ts", "event_type", F.col("user_id").alias("caller"), F.concat(F.lit("tool_"), "event_type").alias("tool_name"))


def append_chain(rows: DataFrame) -> DataFrame:
    """Link each chain's rows in id order. They come in order, batch after batch; what is kept between is the last hash."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, prev = None, GENESIS
        for part in batches:
            before, own = [], []
            for row in part.itertuples(index=False):
                if row.chain != chain:
                    chain, prev = row.chain, GENESIS
                before.append(prev)
                prev = entry_hash(prev, row)
                own.append(prev)
            yield part.assign(prev_hash=before, entry_hash=own)

    return rows.repartition("chain").sortWithinPartitions("chain", "id").mapInPandas(fold, AUDIT)


#: What a JSON text has for characters that it can't hold as they are.
_ESCAPES = {'"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_CONTROL = {chr(i): f"\\u{i:04x}" for i in range(32) if chr(i) not in _ESCAPES}


def json_text(c: Column) -> Column:
    """A string as JSON, the way that entry_hash writes it; null as null."""
    put = lambda x, pairs: reduce(lambda y, p: F.replace(y, F.lit(p[0]), F.lit(p[1])), pairs.items(), x)
    plain = put(F.replace(c, F.lit("\\"), F.lit("\\\\")), _ESCAPES)
    escaped = F.when(plain.rlike("[\\x00-\\x1f]"), put(plain, _CONTROL)).otherwise(plain)
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))


def entry_digest() -> Column:
    """entry_hash of a row from its columns, in the JVM."""
    at = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format("ts", "SSSSSS") != "000000", F.date_format("ts", ".SSSSSS")).otherwise(""), F.lit("+00:00"))
    fields = [F.col("prev_hash"), at, F.col("event_type"), F.col("caller").cast("string"), F.col("tool_name")]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *map(json_text, fields)), F.lit("]")).cast("binary"), 256)


def verify_chain(linked: DataFrame) -> DataFrame:
    """(chain, n, broken_at, reason): the first break by id; a wrong link is named before a wrong entry.

    Every row is checked by itself against its own link and its predecessor's hash. Rows without a hash were logged before
    there were chains and are left out.
    """
    order = Window.partitionBy("chain").orderBy("id")
    rows = linked.where("entry_hash is not null").withColumn("expected", entry_digest())
    rows = rows.withColumn("link", F.coalesce(F.lag("entry_hash").over(order), F.lit(GENESIS)))
    why = F.when(F.col("prev_hash") != F.col("link"), "prev_hash").when(F.col("entry_hash") != F.col("expected"), "entry_hash")
    rows = rows.withColumn("why", why)
    bad = F.when(F.col("why").isNotNull(), F.col("id"))
    return rows.groupBy("chain").agg(F.count("*").alias("n"), F.min(bad).alias("broken_at"), F.coalesce(F.min_by("why", bad), F.lit("OK")).alias("reason"))


@register(
    "chain_append",
    f"""WITH RECURSIVE n AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END || '+00:00' AS iso FROM events),
    r AS (SELECT n.*, '{GENESIS}' AS prev_hash, sha256('["{GENESIS}", "' || iso || '", "' || event_type || '", "' || user_id || '", "tool_' || event_type || '"]') AS entry_hash FROM n WHERE i = 1
          UNION ALL SELECT n.*, r.entry_hash, sha256('["' || r.entry_hash || '", "' || n.iso || '", "' || n.event_type || '", "' || n.user_id || '", "tool_' || n.event_type || '"]') FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1)
    SELECT user_id AS chain, event_id AS id, ts, event_type, user_id AS caller, 'tool_' || event_type AS tool_name, prev_hash, entry_hash FROM r""",
)
def chain_append(spark: SparkSession, d: str) -> DataFrame:
    return append_chain(audit_rows(table(spark, d, "events")))


@register("chain_verify", "SELECT user_id AS chain, COUNT(*) AS n, MIN(event_id) FILTER (WHERE event_id % 997 = 5) AS broken_at, CASE WHEN MIN(event_id) FILTER (WHERE event_id % 997 = 5) IS NULL THEN 'OK' ELSE 'entry_hash' END AS reason FROM events GROUP BY 1")
def chain_verify(spark: SparkSession, d: str) -> DataFrame:
    """Verification finds exactly the rows that were tampered with after they were linked."""
    linked = append_chain(audit_rows(table(spark, d, "events")))
    tampered = linked.withColumn("tool_name", F.when(F.col("id") % 997 == 5, F.lit("forged")).otherwise(F.col("tool_name")))
    return verify_chain(tampered)


@register(
    "error_streak",
    "SELECT user_id, MAX(n) AS longest, MAX(n) >= 3 AS broken FROM (SELECT user_id, grp, COUNT(*) FILTER (WHERE bad) AS n FROM (SELECT *, COUNT(*) FILTER (WHERE NOT bad) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM (SELECT *, value < 40 AS bad FROM events)) GROUP BY 1, 2) GROUP BY 1",
)
def error_streak(spark: SparkSession, d: str, threshold: int = 3) -> DataFrame:
    """Longest run of errors per caller: a good outcome starts a new island; the breaker opens at the threshold."""
    e = table(spark, d, "events").withColumn("bad", F.col("value") < 40)
    island = F.count_if(~F.col("bad")).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    runs = e.withColumn("grp", island).groupBy("user_id", "grp").agg(F.count_if("bad").alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").alias("longest"), (F.max("n") >= threshold).alias("broken"))


@register("clipped_audit_text", "SELECT doc_id, length(CASE WHEN length(text) > 10000 THEN substr(text, 1, 10000) || '...' ELSE text END) AS n, length(text) > 10000 AS cut FROM documents")
def clipped_audit_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts in the log end after 10 000 characters with a mark."""
    text = F.when(F.length("text") > 10000, F.concat(F.substring("text", 1, 10000), F.lit("..."))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(text).cast("long").alias("n"), (F.length("text") > 10000).alias("cut"))


@register("friction_counts", "SELECT event_type, COUNT(*) AS n, COUNT(*) FILTER (WHERE value < 40) AS n_failed FROM events GROUP BY 1")
def friction_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") < 40).alias("n_failed"))


@register("usage_log", oracle("SELECT event_id, alias, total_tokens FROM usage WHERE total_tokens > 0", "usage"))
def usage_log(spark: SparkSession, d: str) -> DataFrame:
    """Usage appended to a log provider by provider, each event once, and read back with the fields that are named."""
    path = new_folder(spark, "log")
    rows = model.usage(spark, d).where("total_tokens > 0")
    for provider, _, _, _, _, _ in QUOTAS:
        append_log(rows.where(F.col("provider") == provider), path)
    return read_fixture(spark, path, "event_id long, alias string, total_tokens long", lines=True)


@register("job_result", oracle("SELECT provider, COUNT(*) AS requests, SUM(total_tokens)::BIGINT AS tokens FROM usage GROUP BY 1", "usage"))
def job_result(spark: SparkSession, d: str) -> DataFrame:
    """A run's result, one small file, as a later job reads it."""
    path = new_folder(spark, "result")
    write_job_result(model.usage(spark, d).groupBy("provider").agg(F.count("*").alias("requests"), F.sum("total_tokens").alias("tokens")), path)
    return read_fixture(spark, path, "provider string, requests long, tokens long", lines=True)
