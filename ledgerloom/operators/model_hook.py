"""Models as batched calls inside tasks: scores that fail open, embeddings that fail loudly.

A model is given by a loader, which a Python worker calls once, when its first batch arrives. The loaded model takes the columns of a
batch as lists and returns one value per row.

Failing open (scores): if loading or a call fails, or the number of values isn't the number of rows, the rows of that batch have no
value, and the worker remembers the failure and doesn't try again, so a broken model costs one attempt per worker and
not one per batch. Other workers are not touched. What consumes the values decides per question: see rerank().

Failing loudly (embeddings): the same mishaps raise EmbeddingError, and a value of another dimension does as well, so that nothing is
written from half an answer.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Model = Callable[..., Sequence]
Loader = Callable[[], Model]
BATCH = 64
#: Of this worker, by hook name: the loaded model, or False once it failed.
_loaded: dict[str, Model | bool] = {}


class EmbeddingError(RuntimeError):
    """The embedding model failed or gave something else than one vector per text."""


def values(name: str, loader: Loader, columns: list[list]) -> Sequence | None:
    """One value per row; None if the model fails now or has failed in this worker before."""
    if _loaded.get(name) is False:
        return None
    try:
        if name not in _loaded:
            _loaded[name] = loader()
        found = _loaded[name](*columns)
        if len(found) != len(columns[0]):
            raise ValueError(f"{len(found)} values for {len(columns[0])} rows")
        return found
    except Exception:
        logging.getLogger(__name__).warning("model %s is out of use in this worker", name, exc_info=True)
        _loaded[name] = False
        return None


def in_batches(part: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, part.num_rows, size):
        yield part.slice(at, size)


def scored(df: DataFrame, name: str, loader: Loader, inputs: list[str], output: str = "score", *, enabled: bool = True, batch: int = BATCH) -> DataFrame:
    """df with a double column of the model's values, null where it is switched off or out of use."""
    if not enabled:
        return df.withColumn(output, F.lit(None).cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for rows in in_batches(part, batch):
                found = values(name, loader, [rows.column(c).to_pylist() for c in inputs])
                column = pa.array([None] * rows.num_rows if found is None else [float(x) for x in found], pa.float64())
                yield pa.RecordBatch.from_arrays([*rows.columns, column], names=[*rows.schema.names, output])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kept}, `{output}` double")


def embedded(df: DataFrame, name: str, loader: Loader, text: str, dim: int, output: str = "embedding", *, role: str = "document", batch: int = BATCH) -> DataFrame:
    """df with the vector of each text. role is 'document' or 'query': symmetric models take both alike, others don't."""
    if role not in ("document", "query"):
        raise ValueError(f"unknown role {role!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for rows in in_batches(part, batch):
                texts = rows.column(text).to_pylist()
                try:
                    if name not in _loaded:
                        _loaded[name] = loader()
                    found = _loaded[name](texts, role)
                except Exception as e:
                    _loaded.pop(name, None)
                    raise EmbeddingError(f"{name} failed: {e}") from e
                if len(found) != len(texts):
                    raise EmbeddingError(f"{name} gave {len(found)} vectors for {len(texts)} texts")
                if any(len(v) != dim for v in found):
                    raise EmbeddingError(f"{name} gave a vector of another dimension than {dim}")
                column = pa.array([list(map(float, v)) for v in found], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*rows.columns, column], names=[*rows.schema.names, output])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kept}, `{output}` array<float>")


def rerank(pool: DataFrame, k: int, score: str = "score") -> DataFrame:
    """pool(query_id, pos, rrf, score, ...) -> the first k per question with place, method and top_score.

    A question whose rows all have a score is put in their order, equal scores as before; one with a row that has none keeps its
    own order. The cut to k comes after that. top_score is the fused score of the row that is first then.
    """
    question = Window.partitionBy("query_id")
    complete = F.count(score).over(question) == F.count("*").over(question)
    place = F.row_number().over(question.orderBy(F.desc_nulls_last(F.when(F.col("__complete"), F.col(score))), "pos"))
    rows = pool.withColumn("__complete", complete).withColumn("place", place.cast("long"))
    top = F.max(F.when(F.col("place") == 1, F.col("rrf"))).over(question)
    method = F.when(F.col("__complete"), "hybrid-rrf+rerank").otherwise("hybrid-rrf")
    return rows.withColumn("method", method).withColumn("top_score", top).where(F.col("place") <= k).drop("__complete")
