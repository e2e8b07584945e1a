"""Counting statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The normal 97.5 % point.
Z = 1.959963984540054


def wilson(k, n) -> Column:
    """95 % Wilson interval, clipped to [0, 1]: STRUCT<low, high>; NULL for n = 0."""
    k, n = (F.col(x) if isinstance(x, str) else x for x in (k, n))
    p, zz = k / n, F.lit(Z * Z)
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = Z / (1 + zz / n) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    low, high = F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))
    return F.when(n > 0, F.struct(low.alias("low"), high.alias("high")))


def mc_pvalue(statistic: Column, observed: Column) -> Column:
    """Aggregate: (1 + #{s >= S}) / (B' + 1) over retained draws; ties count; NULL where there are none."""
    return F.when(F.count(statistic) > 0, (1 + F.count_if(statistic >= observed)) / (F.count(statistic) + 1))


def mc_pvalue_sql(statistic: str, observed: str) -> str:
    return f"CASE WHEN count({statistic}) > 0 THEN (1 + count_if({statistic} >= {observed})) / (count({statistic}) + 1.0D) END"


def branch_b(p, upper, d80) -> Column:
    """p > 0.05 and upper < D80; NULL if any is missing."""
    p, upper, d80 = (F.col(x) if isinstance(x, str) else x for x in (p, upper, d80))
    return F.when(p.isNotNull() & upper.isNotNull() & d80.isNotNull(), (p > 0.05) & (upper < d80))
