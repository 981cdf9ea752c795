"""Filters with blank-aware three-valued comparison, funnels and paging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, NumericType, StringType, StructType

OPERATORS = ("=", "!=", ">", ">=", "<", "<=", "is blank", "is not blank")


def is_blank(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name).cast("string") == "")


def condition(field: str, op: str, value: object = None, numeric: bool = False) -> Column:
    """One filter; a blank or, for numbers, a value that isn't finite passes no comparison."""
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op}")
    if op == "is blank":
        return is_blank(field)
    if op == "is not blank":
        return ~is_blank(field)
    left = F.expr(f"try_cast(`{field}` AS double)") if numeric else F.col(field).cast("string")
    right = F.lit(float(value)) if numeric else F.lit(str(value))
    test = {"=": left == right, "!=": left != right, ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]
    finite = ~F.isnan(left) & (F.abs(left) != float("inf")) if numeric else F.lit(True)
    return F.coalesce(~is_blank(field) & finite & test, F.lit(False))


def pushed(schema: StructType, field: str, op: str, value: object = None) -> Column:
    """``condition`` for a column of known type, as comparisons that reach the scan; null where ``condition`` is false.

    Numbers compare as numbers, where values that aren't finite lie beyond one of two bounds,
    and texts as texts; other types go through ``condition``.
    """
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op}")
    column, kind = F.col(f"`{field}`"), schema[field].dataType
    text, inf = isinstance(kind, StringType), float("inf")
    if not text and not isinstance(kind, NumericType):
        return condition(field, op, value)
    if op == "is blank":
        return column.isNull() | (column == "") if text else column.isNull()
    if op == "is not blank":
        return column.isNotNull() & (column != "") if text else column.isNotNull()
    right = F.lit(str(value) if text else value)
    test = {"=": column == right, "!=": column != right, ">": column > right, ">=": column >= right, "<": column < right, "<=": column <= right}[op]
    if text:
        return test if op == "=" and value != "" else test & (column != "")
    if isinstance(kind, FractionalType):  # NaN counts as more than infinity
        test = test & (column < inf) if op in (">", ">=", "!=") else test
        test = test & (column > -inf) if op in ("<", "<=", "!=") else test
    return test


class Search:
    """Filters, columns and a sort field over a table, checked against the fields that may be asked for."""

    def __init__(self, df: DataFrame, allowed: Sequence[str], companions: dict[str, str] | None = None):
        self.df, self.allowed, self.companions = df, set(allowed), companions or {}

    def check(self, filters: Sequence[tuple[str, str, object]], columns: Sequence[str] = (), sort: str | None = None) -> None:
        """An error that names what may not be asked for."""
        for field, op, _ in filters:
            if field not in self.allowed:
                raise ValueError(f"unsupported filter field: {field}")
            if op not in OPERATORS:
                raise ValueError(f"unsupported filter operator: {op}")
        for name in columns:
            if name not in self.allowed:
                raise ValueError(f"unsupported column: {name}")
        if sort is not None and sort not in self.allowed:
            raise ValueError(f"unsupported sort field: {sort}")

    def required(self, filters: Sequence[tuple[str, str, object]]) -> list[str]:
        """The fields that must hold a value: those of all filters but ``is blank``, each once, in order."""
        return list(dict.fromkeys(field for field, op, _ in filters if op != "is blank"))

    def rows(self, filters: Sequence[tuple[str, str, object]], columns: Sequence[str]) -> DataFrame:
        """The rows that pass all filters."""
        self.check(filters, columns)
        return self.df.where(passing([pushed(self.df.schema, *f) for f in filters])).select(*columns)

    def counts(self, filters: Sequence[tuple[str, str, object]]) -> DataFrame:
        """The funnel of the filters, in one aggregate."""
        self.check(filters)
        return funnel(self.df, self.required(filters), [F.coalesce(pushed(self.df.schema, *f), F.lit(False)) for f in filters])

    def companion_counts(self, filters: Sequence[tuple[str, str, object]]) -> DataFrame:
        """One row for each filter on a field with a companion: (field, companion, compared, with_value, with_companion, without_companion).

        Counted among rows that hold all required fields, in one aggregate for all filters.
        """
        self.check(filters)
        has = passing([~is_blank(r) for r in self.required(filters)])
        asked = [(i, f, self.companions[f[0]]) for i, f in enumerate(filters) if f[0] in self.companions]
        counts = [F.struct(F.lit(f[0]).alias("field"), F.lit(c).alias("companion"), F.lit(f[1] in OPERATORS[:6]).alias("compared"),
                           F.count_if(has & ~is_blank(f[0])).alias("with_value"), F.count_if(has & ~is_blank(f[0]) & ~is_blank(c)).alias("with_companion")) for _, f, c in asked]
        one = self.df.agg(F.array(*counts).alias("all")).select(F.inline("all"))
        return one.withColumn("without_companion", F.col("with_value") - F.col("with_companion"))


def passing(filters: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, filters, F.lit(True))


def funnel(df: DataFrame, required: Sequence[str], filters: Sequence[Column]) -> DataFrame:
    """in_scope, with_required, failing and passing in one aggregate."""
    has = passing([~is_blank(r) for r in required])
    ok = has & passing(filters)
    return df.agg(F.count("*").alias("in_scope"), F.count_if(has).alias("with_required"), F.count_if(has & ~ok).alias("failing"), F.count_if(ok).alias("passing"))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of at most 500 rows in a total order."""
    if not 1 <= size <= 500 or number < 1:
        raise ValueError("pages have 1 to 500 rows and count from 1")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def first_reason(reasons: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first condition that holds."""
    out = F.lit(otherwise)
    for test, name in reversed(reasons):
        out = F.when(test, name).otherwise(out)
    return out


def under_policy(df: DataFrame, policies: Mapping[str, Sequence[Column]], role: str) -> DataFrame:
    """The rows that a role may see: those that one of its policies is true for. A role without policies sees none, and a null is no."""
    rules = list(policies.get(role, ()))
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(r, F.lit(False)) for r in rules], F.lit(False)))
