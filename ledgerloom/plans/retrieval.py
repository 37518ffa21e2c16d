"""Retrieval and entity resolution: dense, sparse and trigram ranks fused, floors, citations, picks.

Query sets are fixed rows of the tables (ids divisible by 50), against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import text as T
from ledgerloom.operators import entity_index as E
from ledgerloom.operators import model_hook as H
from ledgerloom.operators import text_index as X
from ledgerloom.operators import vector_index as V
from ledgerloom.plans.registry import register
from ledgerloom.session import saved, table

POOL = 20
RRF_K = 60
FLOOR = 0.35


def dense_ranks(queries: DataFrame, stored: DataFrame, pool: int = POOL) -> DataFrame:
    """queries(query_id, q), stored(vec_id, v) -> (query_id, vec_id, score, rank) of the nearest pool rows, all rows scored."""
    return V.nearest(queries, stored, pool)


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), e


_DENSE = """dense AS (SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank
FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) WHERE rank <= 20)"""


@register("dense_topk", f"WITH {_DENSE} SELECT * FROM dense")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense_ranks(*_vectors(spark, d))


@register("ivf_topk", f"WITH {_DENSE} SELECT * FROM dense")
def ivf_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same neighbours by the inverted file: only lists that may hold one are opened."""
    queries, stored = _vectors(spark, d)
    return V.search_exact(V.build_index(stored), queries, POOL)


_WORDS = "list_filter(string_split_regex(lower(text), '[ \\t\\n\\r]+'), lambda w: w <> '')"
_SPARSE = f"""q AS (SELECT doc_id AS query_id, list_distinct({_WORDS}) AS qt FROM documents WHERE doc_id % 50 = 0),
t AS (SELECT doc_id, w, COUNT(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) GROUP BY 1, 2),
sparse AS (SELECT * FROM (SELECT query_id, doc_id, SUM(tf)::BIGINT AS score, row_number() OVER (PARTITION BY query_id ORDER BY SUM(tf) DESC, doc_id) AS rank
FROM (SELECT query_id, len(qt) AS need, unnest(qt) AS w FROM q) q JOIN t USING (w) GROUP BY query_id, need, doc_id HAVING COUNT(*) = need) WHERE rank <= 20)"""


def sparse_ranks(spark: SparkSession, d: str, pool: int = POOL, segment: X.Segmentation = X.words) -> DataFrame:
    """Whole documents as questions: all of a question's terms must occur; how often they do orders."""
    docs = table(spark, d, "documents")
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return X.conjunctive(X.build_text_index(docs, segment), asked, pool)


@register("sparse_topk", f"WITH {_SPARSE} SELECT query_id, doc_id, score, rank FROM sparse")
def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    return sparse_ranks(spark, d)


#: Neighbouring words that are one term when texts are segmented.
PHRASES = ("of the", "in the", "to the", "de la", "dans la", "en la", "de los", "in der", "an der", "zu den")


@register(
    "segmented_terms",
    f"""SELECT doc_id, len(t)::BIGINT AS n_terms, len(list_filter(t, lambda x: contains(x, ' ')))::BIGINT AS n_compounds FROM (
    SELECT doc_id, regexp_extract_all(array_to_string({_WORDS}, ' ') || ' ', '(?:{"|".join(sorted(PHRASES, key=lambda p: (-len(p), p)))}) |[^ ]+ ').list_transform(lambda x: trim(x)) AS t FROM documents)""",
)
def segmented_terms(spark: SparkSession, d: str) -> DataFrame:
    """How many terms each document has when phrases are kept together, and how many of them are phrases."""
    t = X.compounds(PHRASES)(F.col("text"))
    terms = table(spark, d, "documents").select("doc_id", t.alias("t"))
    return terms.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.size(F.filter("t", lambda x: F.contains(x, F.lit("_")) & ~F.startswith(x, F.lit("_")))).cast("long").alias("n_compounds"))


def fuse(ranks: DataFrame, keys: list[str]) -> DataFrame:
    """ranks(keys..., id, channel, rank, score) -> RRF sum per id, best first; equal sums keep the first channel's order."""
    sums = ranks.groupBy(*keys, "id").agg(
        F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("rrf"),
        F.min(F.struct("channel", "rank")).alias("seen"),
        F.max(F.when(F.col("channel") == 0, F.col("score"))).alias("dense"),
        F.max(F.when(F.col("channel") == 1, F.col("score"))).alias("sparse"),
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("rrf"), "seen.channel", "seen.rank", "id")
    return sums.withColumn("pos", F.row_number().over(order).cast("long"))


def _both(spark: SparkSession, d: str) -> DataFrame:
    dense = dense_topk(spark, d).select("query_id", F.col("vec_id").alias("id"), F.lit(0).alias("channel"), "rank", "score")
    sparse = sparse_topk(spark, d).select("query_id", F.col("doc_id").alias("id"), F.lit(1).alias("channel"), "rank", F.col("score").cast("double").alias("score"))
    return dense.unionByName(sparse)


_FUSED = f"""{_DENSE}, {_SPARSE},
ranks AS (SELECT query_id, vec_id AS id, 0 AS channel, rank, score FROM dense UNION ALL SELECT query_id, doc_id, 1, rank, score::DOUBLE FROM sparse),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, channel, rank, id) AS pos FROM (
SELECT query_id, id, round(SUM(1.0 / (60 + rank)), 9) AS rrf, MIN(channel) AS channel, arg_min(rank, channel) AS rank,
MAX(score) FILTER (WHERE channel = 0) AS dense, MAX(score) FILTER (WHERE channel = 1) AS sparse FROM ranks GROUP BY 1, 2))"""


@register("rrf_fuse", f"WITH {_FUSED} SELECT query_id, id, rrf, pos FROM fused WHERE pos <= 6")
def rrf_fuse(spark: SparkSession, d: str, k: int = 6) -> DataFrame:
    return fuse(_both(spark, d), ["query_id"]).where(F.col("pos") <= k).select("query_id", "id", "rrf", "pos")


@register("rrf_multi_query", f"WITH {_DENSE} SELECT grp, id, rrf FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rrf DESC, id) AS pos FROM (SELECT query_id // 100 AS grp, vec_id AS id, round(SUM(1.0 / (60 + rank)), 9) AS rrf FROM dense GROUP BY 1, 2)) WHERE pos <= 6")
def rrf_multi_query(spark: SparkSession, d: str) -> DataFrame:
    """Several phrasings of one question pool their ranks."""
    grouped = dense_topk(spark, d).groupBy(F.floor(F.col("query_id") / 100).alias("grp"), F.col("vec_id").alias("id")).agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("rrf"))
    pos = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("rrf"), "id"))
    return grouped.withColumn("pos", pos).where("pos <= 6").drop("pos")


@register("retrieval_summary", f"WITH {_FUSED} SELECT query_id, MAX(rrf) FILTER (WHERE pos = 1) AS top_score, COUNT(*) AS total_candidates, CASE WHEN bool_or(sparse IS NOT NULL) THEN 'hybrid' ELSE 'dense' END AS method FROM fused GROUP BY 1")
def retrieval_summary(spark: SparkSession, d: str) -> DataFrame:
    f = fuse(_both(spark, d), ["query_id"])
    return f.groupBy("query_id").agg(F.max(F.when(F.col("pos") == 1, F.col("rrf"))).alias("top_score"), F.count("*").alias("total_candidates"), F.when(F.bool_or(F.col("sparse").isNotNull()), "hybrid").otherwise("dense").alias("method"))


@register("floor_filter", f"WITH {_FUSED} SELECT query_id, bool_or(dense >= 0.35 AND id <> query_id) OR bool_or(sparse IS NOT NULL AND id <> query_id) AS answerable FROM fused WHERE pos <= 6 GROUP BY 1")
def floor_filter(spark: SparkSession, d: str) -> DataFrame:
    """A question is answerable if a vector is near enough or a word search hit; the question's own row doesn't count."""
    f = fuse(_both(spark, d), ["query_id"]).where((F.col("pos") <= 6))
    other = F.col("id") != F.col("query_id")
    near = F.bool_or((F.col("dense") >= FLOOR) & other)
    hit = F.bool_or(F.col("sparse").isNotNull() & other)
    return f.groupBy("query_id").agg((near | hit).alias("answerable"))


def shared_words() -> H.Model:
    """Stands in for a cross-encoder: how many distinct words question and text have in common."""
    return lambda asked, texts: [len(set((a or "").lower().split()) & set((t or "").lower().split())) for a, t in zip(asked, texts, strict=True)]


def missing_model() -> H.Model:
    raise RuntimeError("the model can't be fetched")


def reranked(spark: SparkSession, d: str, name: str, loader: H.Loader, k: int = 6) -> DataFrame:
    """The fused pool, reordered by a model that reads question and text, cut to k only then."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    pool = saved(fuse(_both(spark, d), ["query_id"]).where(F.col("pos") <= POOL).select("query_id", "id", "pos", "rrf"))
    ids = X.few(saved(pool.select(F.col("id").alias("doc_id")).union(pool.select("query_id")).distinct()))
    # equal texts are read once, however many rows of pools have them
    named = saved(docs.join(ids, "doc_id", "left_semi").select("doc_id", F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("same")))
    for row, same in (("id", "text_of"), ("query_id", "asked_of")):
        pool = pool.join(named.select(F.col("doc_id").alias(row), F.col("same").alias(same)), row, "left")
    pool = saved(pool.fillna("", ["text_of", "asked_of"]))  # ids without a document have no text
    pairs = pool.select("text_of", "asked_of").distinct()
    leaders = X.few(saved(named.groupBy("same").agg(F.min("doc_id").alias("doc_id"))))
    texts = saved(docs.join(leaders, "doc_id").select("same", "text"))
    for same, text in (("text_of", "text"), ("asked_of", "asked")):
        pairs = pairs.join(texts.select(F.col("same").alias(same), F.col("text").alias(text)), same, "left")
    scores = saved(H.scored(pairs, name, loader, ["asked", "text"]).select("text_of", "asked_of", "score"))
    scored = pool.join(scores, ["text_of", "asked_of"], "left")
    return H.rerank(scored, k).select("query_id", "id", "place", "method", "top_score")


_SPACED = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''))"


@register(
    "rerank_pool",
    f"""WITH {_FUSED} SELECT query_id, id, place, 'hybrid-rrf+rerank' AS method, max(rrf) FILTER (WHERE place = 1) OVER (PARTITION BY query_id) AS top_score FROM (
    SELECT f.query_id, f.id, f.rrf, row_number() OVER (PARTITION BY f.query_id ORDER BY len(list_intersect({_SPACED.format("a.text")}, {_SPACED.format("t.text")})) DESC, f.pos) AS place
    FROM fused f LEFT JOIN documents t ON t.doc_id = f.id LEFT JOIN documents a ON a.doc_id = f.query_id WHERE f.pos <= 20) QUALIFY place <= 6""",
)
def rerank_pool(spark: SparkSession, d: str) -> DataFrame:
    """The pool is reordered by the model's scores, equal scores keeping their order, and cut only then."""
    return reranked(spark, d, "shared words", shared_words)


@register("rerank_fallback", f"WITH {_FUSED} SELECT query_id, id, pos AS place, 'hybrid-rrf' AS method, max(rrf) FILTER (WHERE pos = 1) OVER (PARTITION BY query_id) AS top_score FROM fused QUALIFY pos <= 6")
def rerank_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A model that can't be loaded leaves the fused order as it is."""
    return reranked(spark, d, "missing model", missing_model)


@register("citation_footer", f"WITH {_DENSE} SELECT query_id, string_agg(label, '; ' ORDER BY first) AS footer FROM (SELECT query_id, 'label ' || label AS label, MIN(rank) AS first FROM dense JOIN embeddings USING (vec_id) GROUP BY 1, 2) GROUP BY 1")
def citation_footer(spark: SparkSession, d: str) -> DataFrame:
    """Each source once, in the order in which it was first seen."""
    labels = table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("label "), F.col("label").cast("string")).alias("label"))
    seen = dense_topk(spark, d).join(labels, "vec_id").groupBy("query_id", "label").agg(F.min("rank").alias("first"))
    listed = seen.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("first", "label"))).alias("x"))
    return listed.select("query_id", F.array_join(F.transform("x", lambda x: x["label"]), "; ").alias("footer"))


@register("context_rendering", f"WITH {_DENSE} SELECT query_id, string_agg('[' || rank || '] label ' || label, chr(10) ORDER BY rank) AS context FROM dense JOIN embeddings USING (vec_id) WHERE rank <= 6 GROUP BY 1")
def context_rendering(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] label "), F.col("label").cast("string"))
    rows = dense_topk(spark, d).where("rank <= 6").join(labels, "vec_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    return rows.select("query_id", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("context"))


@register("used_sources", """SELECT conv_id, turn, array_to_string(CASE WHEN len(used) > 0 THEN used ELSE [1, 2, 3] END, ',') AS used FROM (SELECT conv_id, turn, CASE WHEN contains(text, ',') THEN
    list_filter([1, 2, 3], lambda i: i = len(string_split(text, chr(10))) OR i = len(string_split(text, ' ')) % 5) ELSE [] END AS used FROM conversations WHERE role = 'assistant')""")
def used_sources(spark: SparkSession, d: str) -> DataFrame:
    """Indices that an answer's last line names; a missing or impossible list means all three."""
    size = lambda mark: F.size(F.split("text", mark))
    named = F.concat(F.lit("\nUSED: "), size("\n").cast("string"), F.lit(", "), (size(" ") % 5).cast("string"))
    answer = F.concat("text", F.when(F.contains("text", F.lit(",")), named).otherwise(""))
    marked = F.regexp_extract(answer, "\\n?USED:\\s*([0-9,\\s]*)", 1)
    found = F.transform(F.regexp_extract_all(marked, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    everything = F.array(*map(F.lit, (1, 2, 3)))
    rows = table(spark, d, "conversations").where("role = 'assistant'").withColumn("named", found)
    rows = rows.withColumn("used", F.filter(everything, lambda i: F.array_contains(F.col("named"), i)))
    return rows.select("conv_id", "turn", F.array_join(F.when(F.size("used") > 0, F.col("used")).otherwise(everything).cast("array<string>"), ",").alias("used"))


@register("verdict_filter", "SELECT conv_id, turn, array_to_string(list_filter(range(1, 11), lambda i: i > len(x) OR length(x[i]) % 4 <> 0), ',') AS kept FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS x FROM conversations)")
def verdict_filter(spark: SparkSession, d: str) -> DataFrame:
    """Of ten sources only an explicit no drops one; unknown ones stay. A verdict stands for each line of a message."""
    said = lambda x, i: F.concat((i + 1).cast("string"), F.when(F.length(x) % 4 == 0, F.lit(": No")).when(F.length(x) % 4 == 1, F.lit(": maybe")).otherwise(F.lit(": YES")))
    answer = F.array_join(F.transform(F.split("text", "\n"), said), "\n")
    no = F.regexp_extract_all(F.upper(answer), F.lit("(?m)^([0-9]+): NO$"), F.lit(1))
    kept = F.filter(F.array(*[F.lit(str(i)) for i in range(1, 11)]), lambda i: ~F.array_contains(F.col("no"), i))
    return table(spark, d, "conversations").select("conv_id", "turn", no.alias("no")).select("conv_id", "turn", F.array_join(kept, ",").alias("kept"))


@register("write_suggestion", "SELECT conv_id, turn, length(text) % 3 = 0 AS suggested, md5(text) AS body_md5 FROM conversations")
def write_suggestion(spark: SparkSession, d: str) -> DataFrame:
    """Marker lines are cut out of the body; the first one's value says whether an action is suggested."""
    kind = F.length("text") % 3
    marked = F.concat("text", F.when(kind == 0, "\nSUGGEST: Yes \nSUGGEST: no").when(kind == 1, "\nSUGGEST: no\nSUGGEST: yes").otherwise(""))
    value = F.lower(F.trim(F.regexp_extract("marked", "(?m)^SUGGEST:([^\\n]*)", 1)))
    rows = table(spark, d, "conversations").select("conv_id", "turn", marked.alias("marked"))
    return rows.select("conv_id", "turn", value.isin("yes", "true", "1").alias("suggested"), F.md5(F.regexp_replace("marked", "(?m)\\n?^SUGGEST:[^\\n]*", "").cast("binary")).alias("body_md5"))


# --- entities -------------------------------------------------------------------------------

#: The index has a record's name, code and kind; live is what is still sold, under its name and code.
_GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_ASKED = """asked AS (SELECT p_partkey AS query_id, CASE p_size % 3 WHEN 0 THEN 'control' WHEN 1 THEN 'typo' ELSE 'reordered' END AS class,
CASE p_size % 3 WHEN 0 THEN p_name || ' P' || p_partkey WHEN 1 THEN substr(p_name, 1, 1) || substr(p_name, 3) || ' P' || p_partkey ELSE 'P' || p_partkey || ' ' || p_name END AS text FROM part WHERE p_partkey % 50 = 0)"""
_TRIGRAM = f"""{_ASKED}, x AS (SELECT p_partkey AS id, {_GRAMS.format("p_name || ' P' || p_partkey || ' ' || p_type")} AS g FROM part),
a AS (SELECT query_id, {_GRAMS.format("text")} AS g FROM asked),
tri AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
SELECT query_id, id, round(n / (len(a.g) + len(x.g) - n), 6) AS score FROM (SELECT query_id, id, len(list_intersect(a.g, x.g)) AS n, a.g, x.g FROM a, x) s JOIN a USING (query_id) JOIN x USING (id) WHERE n > 0)) WHERE rank <= {{k}})"""
_NEAR = """near AS (SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank
FROM embeddings q JOIN asked ON query_id = q.vec_id, embeddings e WHERE e.vec_id IN (SELECT p_partkey FROM part)) WHERE rank <= {k})"""
_CANDIDATES = f"""WITH {_TRIGRAM.format(k=8)}, {_NEAR.format(k=8)},
fused AS (SELECT query_id, id, round(SUM(1.0 / (60 + rank)), 9) AS rrf, MIN(channel) AS channel, arg_min(rank, channel) AS rank FROM (SELECT query_id, id, rank, 0 AS channel FROM tri UNION ALL SELECT query_id, id, rank, 1 FROM near) GROUP BY 1, 2),
live AS (SELECT p_partkey AS id, p_name || ' P' || p_partkey AS name FROM part WHERE p_size > 5),
candidates AS (SELECT query_id, id, name, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, channel, rank, id) AS pos FROM fused JOIN live USING (id))"""


def asked_names(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, class, text): names as people type them, whole, with a letter lost, or in another order."""
    p = table(spark, d, "part").where("p_partkey % 50 = 0")
    code = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    kind = F.col("p_size") % 3
    lost = F.concat(F.substring("p_name", 1, 1), F.expr("substring(p_name, 3)"))
    text = F.when(kind == 0, F.concat_ws(" ", "p_name", code)).when(kind == 1, F.concat_ws(" ", lost, code)).otherwise(F.concat_ws(" ", code, "p_name"))
    return p.select(F.col("p_partkey").alias("query_id"), F.when(kind == 0, "control").when(kind == 1, "typo").otherwise("reordered").alias("class"), text.alias("text"))


def trigram_ranks(spark: SparkSession, d: str, k: int) -> DataFrame:
    stored = entity_mirror(spark, d).select("id", F.col("search_text").alias("text"))
    return E.similar(asked_names(spark, d), stored, k)


@register("trigram_topk", f"WITH {_TRIGRAM.format(k=8)} SELECT query_id, id, score, rank FROM tri")
def trigram_topk(spark: SparkSession, d: str) -> DataFrame:
    """Similar names by trigrams, from the rarest on."""
    return trigram_ranks(spark, d, 8)


def live_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").where("p_size > 5")
    return p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.concat(F.lit("P"), F.col("p_partkey").cast("string"))).alias("name"))


def fused_candidates(spark: SparkSession, d: str, k: int = 8) -> DataFrame:
    """Trigram ranks of the texts and ranks of the vectors, fused and held against the live records; at most 2k per question.

    All joins are told to merge: by the size of its files a table of names looks small enough to broadcast when its rows no longer fit the driver.
    """
    mirror = table(spark, d, "part").select(F.col("p_partkey").alias("vec_id"))
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v")).join(mirror.hint("merge"), "vec_id", "left_semi")
    asked = asked_names(spark, d).select("query_id").hint("merge").join(vectors.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    near = V.nearest(saved(asked), vectors, k).select("query_id", F.col("vec_id").alias("id"), "rank")
    return E.verified(E.fused(trigram_ranks(spark, d, k), near), live_names(spark, d))


@register("entity_candidates", f"{_CANDIDATES} SELECT query_id, id, name, rrf, pos FROM candidates")
def entity_candidates(spark: SparkSession, d: str) -> DataFrame:
    return fused_candidates(spark, d).select("query_id", "id", "name", "rrf", "pos")


_SIMILAR = f"round(1 / (1 + exp(-(12 * (len(list_intersect({_GRAMS.format('text')}, {_GRAMS.format('name')})) / len(list_distinct(list_concat({_GRAMS.format('text')}, {_GRAMS.format('name')}))) - 0.5)))), 4)"


@register(
    "resolve_autopick",
    f"""{_CANDIDATES},
    lexical AS (SELECT * FROM (SELECT query_id, id, name, row_number() OVER (PARTITION BY query_id ORDER BY id) AS pos FROM asked, live WHERE contains(lower(name), lower(text))) WHERE pos <= 5),
    joint AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY channel, pos) AS place FROM (SELECT *, 0 AS channel FROM lexical
        UNION ALL SELECT query_id, id, name, pos, 1 FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM lexical l WHERE l.query_id = c.query_id AND l.id = c.id)) QUALIFY place <= 10),
    s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS turn FROM (SELECT b.*, lower(trim(name)) = lower(trim(text)) AS exact, {_SIMILAR} AS score FROM joint b JOIN asked USING (query_id))),
    c AS (SELECT query_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE exact) AS n_exact, MIN(id) FILTER (WHERE exact) AS exact_id, MAX(id) FILTER (WHERE turn = 1) AS best, MAX(score) FILTER (WHERE turn = 1) AS top, MAX(score) FILTER (WHERE turn = 2) AS second FROM s GROUP BY 1)
    SELECT query_id, coalesce(n, 0) AS n, CASE WHEN n_exact = 1 THEN exact_id WHEN top >= 0.6 AND (second IS NULL OR round(top - second, 4) >= 0.15) THEN best END AS picked,
    coalesce(n_exact <> 1 AND NOT (top >= 0.6 AND (second IS NULL OR round(top - second, 4) >= 0.15)), false) AS ask FROM asked LEFT JOIN c USING (query_id)""",
)
def resolve_autopick(spark: SparkSession, d: str) -> DataFrame:
    """Names that contain the question, then fused candidates; an exact name or a clear best one is picked, else one asks."""
    asked, live = asked_names(spark, d), live_names(spark, d)
    score = T.sigmoid(12 * (T.trigram_similarity(T.trigrams(F.col("text")), T.trigrams(F.col("name"))) - 0.5))
    return E.resolve(asked, E.containing(asked, live, E.MOST_LEXICAL), fused_candidates(spark, d), score).withColumnRenamed("needs", "ask")


@register("resolver_quality", f"WITH {_TRIGRAM.format(k=10)} SELECT coalesce(class, 'TOTAL') AS class, COUNT(*) AS n, COUNT(*) FILTER (WHERE pos = 1) AS top1, COUNT(*) FILTER (WHERE pos IS NOT NULL) AS found FROM (SELECT query_id, class, MIN(rank) FILTER (WHERE id = query_id) AS pos FROM asked LEFT JOIN tri USING (query_id) GROUP BY 1, 2) GROUP BY ROLLUP (class)")
def resolver_quality(spark: SparkSession, d: str) -> DataFrame:
    """Per class of case: how many, how many first, how many among the candidates; and the total."""
    own = trigram_ranks(spark, d, 10).where("id = query_id").select("query_id", F.col("rank").alias("pos"))
    cases = asked_names(spark, d).join(own, "query_id", "left")
    return cases.rollup("class").agg(F.count("*").alias("n"), F.count_if(F.col("pos") == 1).alias("top1"), F.count("pos").alias("found")).select(F.coalesce("class", F.lit("TOTAL")).alias("class"), "n", "top1", "found")


@register("entity_mirror", f"SELECT p_partkey AS id, trim(regexp_replace(lower(strip_accents(p_name || ' P' || p_partkey || ' ' || p_type)), '[ \\t\\n\\r]+', ' ', 'g')) AS search_text, p_name || ' P' || p_partkey || ' ' || p_type AS embed_text FROM part")
def entity_mirror(spark: SparkSession, d: str) -> DataFrame:
    """The index's two texts: normalised to search in, natural to embed."""
    natural = F.concat_ws(" ", "p_name", F.concat(F.lit("P"), F.col("p_partkey").cast("string")), "p_type")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.fold(natural).alias("search_text"), natural.alias("embed_text"))
