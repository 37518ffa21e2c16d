"""Predicate lists compiled to Columns, and record scans over the entities.

A domain is a list of (field, operator, value) terms, joined by AND; "|", "&" and "!" stand before
their operands. A dotted field looks into the parent record: the parent is left-joined once per path,
so rows without a parent stay and compare as null. SQL's three-valued logic holds throughout: a null
field satisfies neither "in" nor "not in". A term whose value is SKIP is left out.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans import model

SKIP = object()
ROW_CAP = 100
READ_METHODS = frozenset({"search_read", "read_group", "name_search"})
DENIED_MODELS = frozenset({"res_users", "ir_config_parameter"})
MODEL_NAME = re.compile(r"[a-zA-Z0-9._]+")
#: field -> entity of the record that it points at
RELATIONS = {
    "sale_order": {"partner_id": "partner"},
    "sale_order_line": {"order_id": "sale_order", "product_id": "product"},
    "purchase_line": {"partner_id": "vendor", "product_id": "product"},
    "invoice": {"partner_id": "partner"},
    "quant": {"product_id": "product"},
    "reorder_rule": {"product_id": "product"},
    "production": {"product_id": "product"},
    "picking": {"order_id": "sale_order"},
}


def check_call(name: str, method: str) -> None:
    """Only known read methods on named, allowed entities; anything else is refused before a plan is built."""
    if method not in READ_METHODS:
        raise PermissionError(f"method {method!r} is not allowed")
    if not MODEL_NAME.fullmatch(name) or name in DENIED_MODELS or name not in model.ENTITIES:
        raise PermissionError(f"model {name!r} is not allowed")


def clamp(limit: int | None, cap: int = ROW_CAP) -> int:
    return min(limit or cap, cap)


def ilike(col: Column, value: str) -> Column:
    """Case-insensitive substring; the value's own wildcards are plain characters."""
    return F.contains(F.lower(col), F.lower(F.lit(value)))


def term(col: Column, op: str, value) -> Column:
    if op == "=":
        return col.isNull() if value is None else col == F.lit(value)
    if op == "!=":
        return col.isNotNull() if value is None else col != F.lit(value)
    if op == "in":
        return col.isin(list(value))
    if op == "not in":
        return ~col.isin(list(value))
    if op == "ilike":
        return ilike(col, value)
    if op in ("<", ">", "<=", ">="):
        other = F.lit(value)
        return {"<": col < other, ">": col > other, "<=": col <= other, ">=": col >= other}[op]
    raise ValueError(f"unknown operator {op!r}")


def compile_domain(domain: Sequence) -> Column:
    """Polish notation, read from the right; what is left on the stack is joined by AND."""
    stack: list[Column] = []
    for item in reversed([x for x in domain if not (isinstance(x, tuple) and x[2] is SKIP)]):
        if item == "!":
            stack.append(~stack.pop())
        elif item in ("|", "&"):
            a, b = stack.pop(), stack.pop()
            stack.append(a | b if item == "|" else a & b)
        else:
            field, op, value = item
            stack.append(term(F.col(f"`{field}`"), op, value))
    return reduce(lambda a, b: a & b, reversed(stack), F.lit(True))


def _with_parents(spark: SparkSession, d: str, name: str, df: DataFrame, fields: Sequence[str]) -> DataFrame:
    wanted: dict[str, set[str]] = {}
    for f in fields:
        if "." in f:
            path, _, column = f.partition(".")
            wanted.setdefault(path, set()).add(column)
    for path, columns in wanted.items():
        parent = model.ENTITIES[RELATIONS[name][path]](spark, d)
        parent = parent.select(F.col("id").alias("__key"), *[F.col(c).alias(f"{path}.{c}") for c in sorted(columns)])
        df = df.join(parent, F.col(path) == F.col("__key"), "left").drop("__key")
    return df


def _matching(spark: SparkSession, d: str, name: str, domain: Sequence, fields: Sequence[str]) -> DataFrame:
    used = [*fields, *[x[0] for x in domain if isinstance(x, tuple) and x[2] is not SKIP]]
    df = _with_parents(spark, d, name, model.ENTITIES[name](spark, d), used)
    return df.where(compile_domain(domain))


def search_read(spark: SparkSession, d: str, name: str, domain: Sequence, fields: Sequence[str], order: str | None = None, limit: int | None = None) -> DataFrame:
    """Records that match; dotted fields come out with "_" for "."; order is SQL text and wants a unique last key."""
    check_call(name, "search_read")
    out = _matching(spark, d, name, domain, fields)
    if order:
        out = out.orderBy(*[_order(x) for x in order.split(",")])
    out = out.select(*[F.col(f"`{f}`").alias(f.replace(".", "_")) for f in fields])
    return out.limit(limit) if limit is not None else out


def _order(text: str) -> Column:
    field, _, way = text.strip().partition(" ")
    return F.col(f"`{field}`").desc_nulls_last() if way.strip().lower() == "desc" else F.col(f"`{field}`").asc_nulls_last()


def read_group(spark: SparkSession, d: str, name: str, domain: Sequence, sums: dict[str, str], by: Sequence[str]) -> DataFrame:
    """Sums (output name -> field) and a row count per group; over all groups."""
    check_call(name, "read_group")
    rows = _matching(spark, d, name, domain, [*by, *sums.values()])
    keys = [F.col(f"`{b}`").alias(b.replace(".", "_")) for b in by]
    return rows.groupBy(*keys).agg(*[F.sum(f"`{f}`").alias(n) for n, f in sums.items()], F.count("*").alias("n"))


def name_search(spark: SparkSession, d: str, name: str, text: str, limit: int | None = None) -> DataFrame:
    """(id, name) of all records by substring, or the limit with the smallest ids; a blank text matches nothing."""
    check_call(name, "name_search")
    df = model.ENTITIES[name](spark, d).select("id", "name")
    if not text.strip():
        return df.limit(0)
    found = df.where(ilike(F.col("name"), text))
    return found if limit is None else found.orderBy("id").limit(limit)
