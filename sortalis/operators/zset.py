"""Bags with signed multiplicities: DataFrames (c0, c1, ..., mult).

Filter, project, apply, union and negate are linear and join is bilinear, so none of them needs its input
consolidated; only ``distinct`` and the reader of a result do.  That keeps plans to one shuffle at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MULT = "mult"


def width(bag: DataFrame) -> int:
    """How many columns the tuples have."""
    return len(bag.columns) - 1


def columns(n: int, start: int = 0) -> list[str]:
    return [f"c{i}" for i in range(start, start + n)]


def bag(frame: DataFrame, source: Sequence[str | Column]) -> DataFrame:
    """Columns of a frame as a bag, each row once."""
    named = [F.col(c) if isinstance(c, str) else c for c in source]
    return frame.select(*[c.alias(n) for c, n in zip(named, columns(len(named)), strict=True)], F.lit(1).cast("long").alias(MULT))


def consolidate(z: DataFrame) -> DataFrame:
    """Adds the multiplicities of equal tuples and drops zeros."""
    return z.groupBy(*columns(width(z))).agg(F.sum(MULT).alias(MULT)).where(F.col(MULT) != 0)


def distinct(z: DataFrame) -> DataFrame:
    """Each tuple of positive multiplicity once; the others go."""
    return consolidate(z).where(F.col(MULT) > 0).withColumn(MULT, F.lit(1).cast("long"))


def negate(z: DataFrame) -> DataFrame:
    return z.withColumn(MULT, -F.col(MULT))


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Multiplicities add."""
    return left.unionByName(right)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return union(left, negate(right))


def project(z: DataFrame, keep: Sequence[int]) -> DataFrame:
    """Selects, reorders or repeats columns; multiplicities of tuples that become equal add."""
    return z.select(*[F.col(f"c{i}").alias(f"c{k}") for k, i in enumerate(keep)], MULT)


def join(left: DataFrame, right: DataFrame, on: Sequence[tuple[int, int]] = ()) -> DataFrame:
    """Concatenates tuples that agree on the column pairs; multiplicities multiply.  Without pairs: all with all."""
    n, m = width(left), width(right)
    other = right.select(*[F.col(f"c{i}").alias(f"c{n + i}") for i in range(m)], F.col(MULT).alias("_m"))
    condition = None
    for i, j in on:
        same = F.col(f"c{i}") == F.col(f"c{n + j}")
        condition = same if condition is None else condition & same
    out = left.crossJoin(other) if condition is None else left.join(other, condition)
    return out.select(*columns(n + m), (F.col(MULT) * F.col("_m")).alias(MULT))


def apply(z: DataFrame, graph: DataFrame, arguments: Sequence[int], results: Sequence[str]) -> DataFrame:
    """Appends function values; tuples at which the function is undefined go."""
    n = width(z)
    g = graph.select(*[F.col(f"a{k}").alias(f"_a{k}") for k in range(len(arguments))], *[F.col(r).alias(f"c{n + k}") for k, r in enumerate(results)])
    condition = F.lit(True)
    for k, i in enumerate(arguments):
        condition = condition & (F.col(f"c{i}") == F.col(f"_a{k}"))
    return z.join(g, condition).select(*columns(n + len(results)), MULT)


def equal(left: DataFrame, right: DataFrame) -> bool:
    """Whether two bags have the same tuples with the same multiplicities."""
    return consolidate(difference(left, right)).isEmpty()
