"""Quality rules: fixed base limits, then robust multivariate outliers, with DataFrame functions only.

Each document has a vector of transformed statistics (FEATURES). For every language and source the
minimum-covariance-determinant estimate is found by concentration steps from several starts: the CORE share of
documents nearest to the present centre gives the next mean and covariance, until the determinant gets no smaller;
the start that ends at the least determinant is taken. Covariances get a floor per statistic (FLOORS), as most documents have none of some
statistic and a plain covariance would be singular. Documents farther than CUTOFF are rejected.

Order statistics come from histograms with bounded numbers of bins, so no group, however large,
meets in one task, and the same data give the same subsets at any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.joins import join_per_key
from ledgerloom.session import cut, saved

SPACE = "[ \\t-\\r]"
SYMBOLS = "[^#*$%&|<>]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Transformed statistics and the least spread that each is given.
FEATURES = ("word_length", "symbols", "dup_lines", "repeats")
FLOORS = {"word_length": 0.35, "symbols": 0.08, "dup_lines": 0.12, "repeats": 0.05}
#: Share of a group's documents that the estimate rests on, the steps taken to find them, and the
#: factor that makes the covariance of the nearest three quarters consistent in four dimensions.
CORE = 0.75
MAX_STEPS = 12
#: Gain in the log determinant under which a start has settled.
LEAST_GAIN = 1e-4
CONSISTENCY = 1.485
#: Squared distance beyond which a document goes: chi-square with 4 degrees exceeds it once in 2e7.
CUTOFF = 40.0
#: Sums are of whole numbers of a floor's GRAIN-th part, so that they don't depend on the order of adding.
GRAIN = 256
#: Quartiles of a normal distribution lie this many standard deviations apart.
NORMAL_QUARTILES = 1.349

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words; the text column goes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    out = docs.withColumns(
        {
            "__words": F.filter(F.split(text, SPACE + "+"), lambda w: w != ""),
            "word_chars": F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long"),
            "__lines": lines,
        }
    ).drop(text_col)
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__h": F.transform("__words", lambda w: F.xxhash64(w)),
        }
    ).drop("__words", "__lines")
    for half in (1, 2, 4):  # hashes of runs of 2, 4 and 8 words
        n = F.greatest(F.size("__h") - half, F.lit(0))
        out = out.withColumn("__h", F.zip_with(F.slice("__h", 1, n), F.slice("__h", half + 1, n), lambda a, b: F.xxhash64(a, b)))
    at = F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    near = F.filter(
        F.col("__s"),
        lambda x, i: F.coalesce((F.get(F.col("__s"), i - 1)["h"] == x["h"]), F.lit(False))
        | F.coalesce((F.get(F.col("__s"), i + 1)["h"] == x["h"]), F.lit(False)),
    )
    again = F.size(F.array_distinct("__h")) < F.size("__h")
    out = out.withColumn("__s", F.when(again, F.array_sort(at))).drop("__h")
    out = out.withColumn("__p", F.when(F.col("__s").isNotNull(), F.array_sort(F.transform(near, lambda x: x["i"])))).drop("__s")
    covered = F.aggregate(
        "__p",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n")),
    )
    return out.withColumn("n_repeat_words", F.coalesce(F.when(F.col("__p").isNotNull(), covered["n"]), F.lit(0)).cast("long")).drop("__p")


def _features() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "word_length": F.col("word_chars") / words,
        "symbols": F.sqrt(F.col("n_symbols") / words),
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
    }


def _at_share(counts: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The smallest bin by which the share of a group is reached: counts(keys, bin, n) -> (keys, bin)."""
    by_bin = Window.partitionBy(*keys).orderBy("bin")
    whole = Window.partitionBy(*keys)
    return (
        counts.withColumns({"upto": F.sum("n").over(by_bin), "all": F.sum("n").over(whole)})
        .where(F.col("upto") >= F.col("all") * share)
        .groupBy(*keys)
        .agg(F.min("bin").alias("bin"))
    )


def _squared_distance() -> Column:
    """By the inverse Cholesky factor in columns i_j (row i, column j) and the centre in m_name."""
    total = F.lit(0.0)
    for i in range(len(FEATURES)):
        row = F.lit(0.0)
        for j in range(i + 1):
            row = row + F.col(f"i{i}_{j}") * (F.col(FEATURES[j]) - F.col(f"m_{FEATURES[j]}"))
        total = total + row * row
    return total


def _sums() -> list[Column]:
    """Count, sums and sums of products of the features in whole units of a floor's GRAIN-th part, which add up exactly."""
    whole = {x: F.round(F.col(x) * (GRAIN / FLOORS[x])).cast("long") for x in FEATURES}
    exact = lambda c: F.sum(c.cast("decimal(28,0)"))
    products = [exact(whole[y] * whole[x]).alias(f"s_{y}_{x}") for i, x in enumerate(FEATURES) for y in FEATURES[: i + 1]]
    return [F.count("*").alias("n"), *[exact(whole[x]).alias(f"s_{x}") for x in FEATURES], *products]


def _estimate(moments: DataFrame) -> DataFrame:
    """moments has _sums(); adds the centre, the inverse of the covariance's factor and the covariance's log determinant."""
    k = len(FEATURES)
    mean = lambda name: F.col(name).cast("double") / F.col("n")
    out = moments.withColumns({f"m_{x}": mean(f"s_{x}") * (FLOORS[x] / GRAIN) for x in FEATURES})
    cov = {}
    for i, x in enumerate(FEATURES):
        for j, y in enumerate(FEATURES[: i + 1]):
            unit = FLOORS[x] / GRAIN * FLOORS[y] / GRAIN
            c = (mean(f"s_{y}_{x}") * unit - F.col(f"m_{x}") * F.col(f"m_{y}")) * CONSISTENCY
            cov[f"c{i}_{j}"] = c + (FLOORS[x] ** 2 if i == j else 0.0)
    out = out.withColumns(cov)
    for i in range(k):  # rows of the factor, then of its inverse
        for j in range(i + 1):
            rest = F.col(f"c{i}_{j}")
            for p in range(j):
                rest = rest - F.col(f"l{i}_{p}") * F.col(f"l{j}_{p}")
            out = out.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}_{j}"))
    for i in range(k):
        for j in range(i + 1):
            if i == j:
                out = out.withColumn(f"i{i}_{j}", 1.0 / F.col(f"l{i}_{i}"))
            else:
                total = F.lit(0.0)
                for p in range(j, i):
                    total = total + F.col(f"l{i}_{p}") * F.col(f"i{p}_{j}")
                out = out.withColumn(f"i{i}_{j}", -total / F.col(f"l{i}_{i}"))
    log_det = F.lit(0.0)
    for i in range(k):
        log_det = log_det + 2 * F.log(F.col(f"l{i}_{i}"))
    return out.withColumn("log_det", log_det)


MODEL = [*(f"m_{x}" for x in FEATURES), *(f"i{i}_{j}" for i in range(len(FEATURES)) for j in range(i + 1))]


def _starts(stats: DataFrame) -> DataFrame:
    """(g, start, MODEL): for each group its medians with the floors as spread (0), its medians with the spread of its
    quartiles (1), and the mean and covariance of all its rows (2)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("f"), F.round(F.col(x) / (FLOORS[x] / 100)).cast("long").alias("bin")) for x in FEATURES]))
    binned = cut(stats.select("g", pairs.alias("p")).groupBy("g", "p.f", "p.bin").agg(F.count("*").alias("n")))
    at = {
        share: _at_share(binned, ["g", "f"], share).groupBy("g").pivot("f", list(FEATURES)).agg(F.first("bin")).select("g", *[(F.col(x) * (FLOORS[x] / 100)).alias(f"q{int(share * 100)}_{x}") for x in FEATURES])
        for share in (0.25, 0.5, 0.75)
    }
    quartiles = at[0.25].join(at[0.5], "g").join(at[0.75], "g")
    medians = [F.col(f"q50_{x}").alias(f"m_{x}") for x in FEATURES]

    def factor(spread: dict[str, Column]) -> list[Column]:
        return [(1.0 / spread[FEATURES[i]] if i == j else F.lit(0.0)).alias(f"i{i}_{j}") for i in range(len(FEATURES)) for j in range(i + 1)]

    floors = {x: F.lit(FLOORS[x]) for x in FEATURES}
    between = {x: (F.col(f"q75_{x}") - F.col(f"q25_{x}")) / NORMAL_QUARTILES + FLOORS[x] for x in FEATURES}
    by_medians = quartiles.select("g", F.lit(0).alias("start"), *medians, *factor(floors)).union(quartiles.select("g", F.lit(1).alias("start"), *medians, *factor(between)))
    return by_medians.union(_estimate(stats.groupBy("g").agg(*_sums())).select("g", F.lit(2).alias("start"), *MODEL))


def robust_distances(stats: DataFrame, keys: list[str]) -> DataFrame:
    """stats(keys, FEATURES, ...) with squared_distance from its group's robust centre.

    The estimate with the least determinant is taken, of those at which the concentration steps from each start
    end. A group of one document, or of equal ones, has distance 0; of estimates with equal determinants
    the one of the first start counts.
    """
    stats = stats.withColumn("g", F.struct(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys]))
    model = cut(_starts(stats).withColumns({"log_det": F.lit(None).cast("double"), "done": F.lit(False)}))
    for _ in range(MAX_STEPS):
        active = model.where("not done")
        near = join_per_key(stats, active.drop("log_det", "done"), ["g"], list(FEATURES)).withColumn("bin", F.floor(F.log(_squared_distance() + 1e-6) * 32))
        limit = cut(_at_share(near.groupBy("g", "start", "bin").agg(F.count("*").alias("n")), ["g", "start"], CORE).withColumnRenamed("bin", "limit"))
        core = join_per_key(near, limit, ["g", "start"], list(FEATURES)).where("bin <= limit")
        found = _estimate(core.groupBy("g", "start").agg(*_sums())).select("g", "start", *MODEL, "log_det")
        # a start is done, with the estimate it has, when a step no longer makes its determinant smaller
        both = active.alias("old").join(found.alias("new"), ["g", "start"])
        better = F.col("old.log_det").isNull() | (F.col("new.log_det") < F.col("old.log_det") - LEAST_GAIN)
        taken = both.select("g", "start", *[F.when(better, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in [*MODEL, "log_det"]], (~better).alias("done"))
        model = cut(model.where("done").union(taken))
        if model.where("not done").isEmpty():
            break
    least = Window.partitionBy("g").orderBy("log_det", "start")
    best = cut(model.withColumn("place", F.row_number().over(least)).where("place = 1").select("g", *MODEL))
    return join_per_key(stats, best, ["g"], list(FEATURES)).withColumn("squared_distance", _squared_distance()).drop("g", *MODEL)


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per row: doc_id, the statistics, base_failed, squared_distance (null where base_failed) and kept.

    Defined results: a null or empty text has no words and fails the base rules; a null language or source
    is a group of its own; repeated rows each count. Other columns are not looked at.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    stats = saved(text_statistics(rows).withColumn("base_failed", failed))
    measured = robust_distances(stats.where("not base_failed").withColumns(_features()), ["lang", "source"])
    columns = ["doc_id", *STATS, "base_failed"]
    passed = measured.select(*columns, "squared_distance", (F.col("squared_distance") <= CUTOFF).alias("kept"))
    rest = stats.where("base_failed").select(*columns, F.lit(None).cast("double").alias("squared_distance"), F.lit(False).alias("kept"))
    return passed.union(rest)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that judge() keeps, all columns; rows that share an id stay only if all of them are kept.

    A row whose id is null can't be told apart and goes, unless the id column is unique and never null.
    """
    id_col = options.get("id_col", "doc_id")
    kept = judge(docs, **options).groupBy("doc_id").agg(F.bool_and("kept").alias("kept")).where("kept").select(F.col("doc_id").alias("__kept"))
    return docs.join(kept, F.col(id_col) == F.col("__kept"), "left_semi")
