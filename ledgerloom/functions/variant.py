"""JSON values as VARIANT, in the JVM: shapes of payloads, containment of arguments.

Shapes are read off the value's text, which has no white space and only the escapes that must be. A walk has a bound on its depth, known when the plan is built: one column of nodes per level, each made from the one above. Text that isn't JSON, or
has a key twice in one object, is no value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Deepest value that a payload may have (itself at 0), and what its keys look like.
MAX_DEPTH = 10
FIELD_KEY = "^[a-z_][a-z0-9_]*\\z"
#: In a value's text: a field's key, and any string.
_FIELD = '"[a-z_][a-z0-9_]*+":'
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _node(path: Column, key: Column, value: Column) -> Column:
    return F.struct(path.alias("path"), key.alias("key"), value.alias("value"))


def _inner(n: Column) -> Column:
    """What lies directly in a node: an object's values by key, an array's by place. Keys carry their length, so no two paths are alike."""
    step = lambda e: F.concat(n["path"], F.lit("."), F.length(e["key"]).cast("string"), F.lit(":"), e["key"])
    named = F.transform(F.map_entries(_object(n["value"])), lambda e: _node(step(e), e["key"], e["value"]))
    placed = F.transform(_array(n["value"]), lambda x, i: _node(F.concat(n["path"], F.lit("["), i.cast("string")), F.lit(None).cast("string"), x))
    return F.coalesce(named, placed, F.array().cast("array<struct<path:string,key:string,value:variant>>"))


def levels(df: DataFrame, value: str, name: str, depth: int) -> DataFrame:
    """df with name_0 .. name_depth: the nodes of the VARIANT column by their depth; null where the value is null."""
    root = F.when(F.col(value).isNotNull(), F.array(_node(F.lit(""), F.lit(None).cast("string"), F.col(value))))
    df = df.withColumn(f"{name}_0", root)
    for i in range(depth):
        df = df.withColumn(f"{name}_{i + 1}", F.flatten(F.transform(f"{name}_{i}", _inner)))
    return df


def payload_verdicts(df: DataFrame, text: str, output: str = "verdict") -> DataFrame:
    """df with the verdict on a JSON text: 'unreadable', 'deep' (a value below MAX_DEPTH), 'key' (a key that is no field's), 'ok'."""
    df = df.withColumn("__value", F.try_parse_json(text)).withColumn("__shape", F.to_json("__value"))
    # a key that is no field's leaves its first quote
    bad = F.contains(F.regexp_replace("__shape", f"{_FIELD}|{_STRING}(?!:)", ""), F.lit('"'))
    # brackets around something; a turn takes the innermost off
    around = F.replace(F.replace(F.regexp_replace("__shape", _STRING, ""), F.lit("[]")), F.lit("{}"))
    pairs = F.translate(F.regexp_replace(around, r"[^\[\]{}]+", ""), "{}", "[]")
    for _ in range(MAX_DEPTH):
        pairs = F.replace(pairs, F.lit("[]"))
    verdict = F.when(F.col("__value").isNull(), "unreadable").when(pairs != "", "deep").when(bad, "key").otherwise("ok")
    return df.withColumn(output, verdict).drop("__value", "__shape")


def _norm(v: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(v.cast("string"), F.lit("none"))), "\\s+", " "))


def matches(df: DataFrame, expected: str, got: str, output: str = "matches", depth: int = 4) -> DataFrame:
    """df with: is all of the expected JSON in the other one? Values below depth of the expected one aren't looked at.

    Objects must have the expected keys and may have more, arrays must be of equal length, numbers are compared as doubles (texts of numbers
    too), and all else as text in lower case with single spaces. What can't be read matches nothing.
    """
    df = df.withColumn("__want", F.try_parse_json(expected)).withColumn("__have", F.try_parse_json(got))
    df = levels(levels(df, "__want", "__w", depth), "__have", "__h", depth)
    columns = lambda x: [f"{x}_{i}" for i in range(depth + 1)]
    entries = F.transform(F.flatten(F.array(*columns("__h"))), lambda n: F.struct(n["path"], n["value"]))
    df = df.withColumn("__found", F.map_from_entries(entries))

    def holds(n: Column) -> Column:
        v, other = n["value"], F.element_at("__found", n["path"])
        kind = F.schema_of_variant(v)
        as_object = _object(other).isNotNull()
        as_array = F.coalesce(F.size(_array(other)) == F.size(_array(v)), F.lit(False)) & _array(other).isNotNull()
        as_number = F.coalesce(F.try_variant_get(other, "$", "double") == F.try_variant_get(v, "$", "double"), F.lit(False))
        as_text = _norm(other) == _norm(v)
        found = F.map_contains_key("__found", n["path"])
        return found & F.when(kind.startswith("OBJECT"), as_object).when(kind.startswith("ARRAY"), as_array).when(kind.rlike(_NUMBER), as_number).otherwise(as_text)

    every = F.forall(F.flatten(F.array(*columns("__w"))), holds)
    answer = F.coalesce(F.col("__want").isNotNull() & F.col("__have").isNotNull() & every, F.lit(False))
    return df.withColumn(output, answer).drop("__want", "__have", "__found", *columns("__w"), *columns("__h"))
