"""Exact sums and half-up rounding, so that results do not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def exact_sum(c: str | Column) -> Column:
    """Sum of a double with up to six decimals, by way of decimals."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast("decimal(28,6)")).cast("double")


def round2(c: Column) -> Column:
    """Two decimals, halves up."""
    return F.floor(c * 100 + 0.5) / 100


def share(part: Column, whole: Column) -> Column:
    """Percentage, two decimals; 0 of nothing."""
    return F.when(whole > 0, round2(part * 100.0 / whole)).otherwise(0.0)


def mean2(total: Column, n: Column) -> Column:
    return F.when(n > 0, round2(total / n)).otherwise(0.0)


def sql_round2(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


def sql_share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {sql_round2(f'{part} * CAST(100 AS DOUBLE) / {whole}')} ELSE 0.0 END"


def sql_sum(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(28,6))) AS DOUBLE)"


def sql_mean2(x: str) -> str:
    return f"CASE WHEN count(*) > 0 THEN {sql_round2(f'{sql_sum(x)} / count(*)')} ELSE 0.0 END"
