"""Registry of checkable queries: a Spark callable and, where possible, SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.workload.bindings import with_ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, *needs: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_ctes(sql, *needs)
        return fn
    return register


# Added before rounding so that exact decimal halves do not depend on the last bit.
HALF_SHIFT = "1.2345678e-8"


def R(c: Column | str, digits: int = 6) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + float(HALF_SHIFT), digits)


def rounded(df: DataFrame, *keep: str, digits: int = 6, **exprs: Column) -> DataFrame:
    """``keep`` columns as they are, every other double column rounded."""
    cols = []
    for name, dtype in df.dtypes:
        cols.append(R(name, digits).alias(name) if dtype == "double" and name not in keep else F.col(name))
    return df.select(*cols)


def rounded_small(df: DataFrame, digits: int = 6, limit: float | None = None) -> DataFrame:
    """``rounded`` for wide tables of numbers up to a few thousand, in double arithmetic; numbers from ``limit`` on, where they may
    be larger, go through ``round``.

    ``round`` writes every double as decimal text and reads it again, which took much of the time of a table of features. Below
    2**53 the scaled number is whole after ``rint``, and its quotient is the double next to the decimal, the same as ``round`` gives;
    0.0 is added since a decimal has no negative zero. Exact halves, where the two differ, are what the shift keeps away.
    """
    scale = 10.0 ** digits

    def one(name: str) -> Column:
        small = F.rint((F.col(name) + float(HALF_SHIFT)) * scale) / scale + 0.0
        return small if limit is None else F.when(F.abs(F.col(name)) < limit, small).otherwise(R(name, digits))
    return df.select(*[one(name).alias(name) if dtype == "double" else F.col(name) for name, dtype in df.dtypes])


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr} + {HALF_SHIFT}, {digits})"


def rs(names: str | list[str], digits: int = 6) -> str:
    items = names.split() if isinstance(names, str) else names
    return ", ".join(f"{r(n, digits)} as {n}" for n in items)
