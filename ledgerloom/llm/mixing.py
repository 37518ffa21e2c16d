"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Each source has a repetition rate: its target weight's share of the mixture over its own size. Every
document draws its number of copies from a Poisson distribution with that mean, by inverting the
distribution at a number in (0, 1) hashed from the seed and the document's id; copies are exploded
and put in a global order by another hash. The same seed gives the same mixture on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.joins import join_per_key
from ledgerloom.session import cut

#: Means above this are drawn as the sum of several draws, which is exact and keeps exp(-mean) in range.
MAX_MEAN = 32.0
#: Steps of the inverted distribution; a mean of MAX_MEAN passes the last one with probability below 1e-18.
STEPS = 112


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 32 bits of a hash."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def source_rates(docs: DataFrame, *, source_col: str, text_col: str, weights: dict[str, float] | None, power: float, epochs: float) -> DataFrame:
    """(source, chars, rate): rate is the mean number of copies of the source's documents.

    Without weights a source's weight is its size to the given power (1 keeps the proportions, 0 evens
    them out). Sources that weights doesn't name get none; sizes are counted over all documents.
    """
    sizes = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).agg(
        F.sum(F.length(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("chars")
    )
    if weights is None:
        sized = sizes.withColumn("weight", F.pow(F.col("chars").cast("double"), F.lit(power)))
    else:
        given = F.coalesce(*[F.when(F.col("source") == k, F.lit(float(v))) for k, v in weights.items()], F.lit(0.0))
        sized = sizes.withColumn("weight", given)
    total = sized.agg(F.sum("weight").alias("all_weight"), F.sum("chars").alias("all_chars"))
    share = F.col("weight") / F.col("all_weight") * F.col("all_chars") * epochs / F.col("chars")
    return sized.join(F.broadcast(total)).select("source", "chars", F.when((F.col("chars") > 0) & (F.col("all_weight") > 0), share).otherwise(0.0).alias("rate"))


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: dict[str, float] | None = None,
    power: float = 0.5,
    epochs: float = 1.0,
    seed: int = 1,
) -> DataFrame:
    """The mixture: all columns of docs, and mix_rate, mix_copies, mix_copy (from 0) and mix_key (the global order).

    Defined results: a null source is the source ''; empty and null texts have size 0, and a source of
    only such texts gets no copies; a null id draws as the text 'null'; rows that repeat an id draw the same number.
    Columns of docs with the names of the added ones are replaced.
    """
    rates = source_rates(docs, source_col=source_col, text_col=text_col, weights=weights, power=power, epochs=epochs)
    parts = F.greatest(F.ceil(F.col("rate") / MAX_MEAN), F.lit(1))
    first = F.exp(-F.col("rate") / F.col("mix_parts"))
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)),
        F.struct(first.alias("p"), F.array(first).alias("cdf")),
        lambda a, k: F.struct(
            (a["p"] * F.col("rate") / F.col("mix_parts") / k).alias("p"),
            F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * F.col("rate") / F.col("mix_parts") / k)).alias("cdf"),
        ),
    )
    steps = rates.withColumn("mix_parts", parts).withColumn("mix_cdf", step["cdf"]).select(
        F.col("source").alias("mix_source"), F.col("rate").alias("mix_rate"), "mix_parts", "mix_cdf"
    )
    named = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    draws = F.transform(F.sequence(F.lit(1), F.col("mix_parts").cast("int")), lambda part: uniform(F.lit(str(seed)), named, part.cast("string")))
    drawn = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter("mix_cdf", lambda c: c < u)))
    base = docs.drop("mix_rate", "mix_copies", "mix_copy", "mix_key", "mix_source", "mix_parts", "mix_cdf")
    named_source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    joined = join_per_key(base.withColumn("mix_source", named_source), cut(steps), ["mix_source"], [id_col])
    copied = joined.withColumn("mix_copies", drawn).where("mix_copies > 0").drop("mix_source", "mix_parts", "mix_cdf")
    copied = copied.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), named, F.col("mix_copy").cast("string")))
    # keys are evenly spread, so that ranges of a fixed width need no sample of them
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("double") / float(1 << 32) * ranges).cast("int")
    return copied.withColumn("mix_key", key).repartitionById(ranges, place).sortWithinPartitions("mix_key")
