"""Sparse tensors over a semiring: DataFrames (i0, i1, ..., v), each index tuple once, no zero stored."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sortalis.sources.shared import dealt


@dataclass(frozen=True)
class Semiring:
    """How values add and multiply, and how a signed change is applied."""

    name: str

    def total(self, v: Column) -> Column:
        """The sum of a group."""
        return F.max(v) if self.name == "bool" else F.sum(v)

    def times(self, a: Column, b: Column) -> Column:
        return a * b

    def one(self) -> Column:
        return F.lit(1).cast("long")

    def applied(self, value: Column, delta: Column) -> Column:
        """A value after a change: truth saturates between 0 and 1, naturals at 0."""
        new = value + delta
        if self.name == "bool":
            return F.least(F.greatest(new, F.lit(0)), F.lit(1)).cast("long")
        return F.greatest(new, F.lit(0)).cast("long") if self.name == "nat" else new


BOOL, INT, NAT = Semiring("bool"), Semiring("int"), Semiring("nat")


def indexes(n: int, start: int = 0) -> list[str]:
    return [f"i{k}" for k in range(start, start + n)]


@dataclass
class Tensor:
    frame: DataFrame
    order: int
    ring: Semiring = INT

    def _like(self, frame: DataFrame, order: int) -> Tensor:
        return Tensor(frame.where("v <> 0"), order, self.ring)

    def pattern(self) -> DataFrame:
        """The index tuples that are not zero."""
        return self.frame.select(*indexes(self.order))

    def product(self, other: Tensor) -> Tensor:
        """All pairs of entries, indexes side by side."""
        right = other.frame.select(*[F.col(f"i{k}").alias(f"i{self.order + k}") for k in range(other.order)], F.col("v").alias("w"))
        out = self.frame.crossJoin(right).withColumn("v", self.ring.times(F.col("v"), F.col("w"))).drop("w")
        return self._like(out.select(*indexes(self.order + other.order), "v"), self.order + other.order)

    def sum(self, other: Tensor) -> Tensor:
        """Values at equal indexes add."""
        return self._grouped(self.frame.unionByName(other.frame), self.order)

    def hadamard(self, other: Tensor) -> Tensor:
        """Values at equal indexes multiply."""
        right = other.frame.withColumnRenamed("v", "w")
        joined = self.frame.join(right, indexes(self.order)) if self.order else self.frame.crossJoin(right)
        return self._like(joined.select(*indexes(self.order), self.ring.times(F.col("v"), F.col("w")).alias("v")), self.order)

    def contract(self, groups: Sequence[int], keep: Sequence[int]) -> Tensor:
        """Index k is renamed to groups[k]; entries must agree on equal names; names not kept are summed over."""
        first = {g: k for k, g in reversed(list(enumerate(groups)))}
        frame = self.frame
        for k, g in enumerate(groups):
            if first[g] != k:
                frame = frame.where(F.col(f"i{k}") == F.col(f"i{first[g]}"))
        out = frame.select(*[F.col(f"i{first[g]}").alias(f"o{n}") for n, g in enumerate(keep)], "v")
        return self._grouped(out.toDF(*indexes(len(keep)), "v"), len(keep))

    def joined(self, other: Tensor, on: Sequence[tuple[int, int]], keep: Sequence[int]) -> Tensor:
        """Contraction of the product over index pairs, as one join; keep numbers the product's indexes."""
        right = other.frame.select(*[F.col(f"i{k}").alias(f"i{self.order + k}") for k in range(other.order)], F.col("v").alias("w"))
        condition = reduce(lambda a, b: a & b, [F.col(f"i{a}") == F.col(f"i{self.order + b}") for a, b in on])
        out = self.frame.join(right, condition).withColumn("v", self.ring.times(F.col("v"), F.col("w")))
        return self._grouped(out.select(*[F.col(f"i{k}").alias(f"o{n}") for n, k in enumerate(keep)], "v").toDF(*indexes(len(keep)), "v"), len(keep))

    def project(self, keep: Sequence[int]) -> Tensor:
        return self.contract(range(self.order), keep)

    def diagonal(self, a: int, b: int) -> Tensor:
        """Entries whose indexes a and b agree, with b gone."""
        groups = [a if k == b else k for k in range(self.order)]
        return self.contract(groups, [k for k in range(self.order) if k != b])

    def exists(self, index: int) -> Tensor:
        """Sums over an index."""
        return self.project([k for k in range(self.order) if k != index])

    def applied(self, delta: Tensor) -> Tensor:
        """The tensor after signed changes."""
        right = delta.frame.withColumnRenamed("v", "w")
        both = self.frame.withColumn("_k", F.lit(0)).join(right.withColumn("_k", F.lit(0)), ["_k", *indexes(self.order)], "full")
        new = self.ring.applied(F.coalesce("v", F.lit(0)), F.coalesce("w", F.lit(0)))
        return self._like(both.select(*indexes(self.order), new.alias("v")), self.order)

    def _grouped(self, frame: DataFrame, order: int) -> Tensor:
        grouped = frame.groupBy(*indexes(order)).agg(self.ring.total(F.col("v")).alias("v"))
        return self._like(grouped, order)


def scalar(spark: SparkSession, value: int, ring: Semiring = INT) -> Tensor:
    return Tensor(spark.range(1).select(F.lit(value).cast("long").alias("v")).where("v <> 0"), 0, ring)


def zero(spark: SparkSession, order: int, ring: Semiring = INT) -> Tensor:
    return Tensor(spark.createDataFrame([], ", ".join(f"{c} long" for c in [*indexes(order), "v"])), order, ring)


def from_pattern(frame: DataFrame, columns: Sequence[str], ring: Semiring = INT) -> Tensor:
    """Ones at the distinct rows of some columns."""
    out = frame.select(*[F.col(c).cast("long").alias(i) for c, i in zip(columns, indexes(len(columns)), strict=True)])
    out = dealt(out, out.columns).distinct()
    return Tensor(out.withColumn("v", F.lit(1).cast("long")), len(columns), ring)


def from_entries(frame: DataFrame, columns: Sequence[str], value: str, ring: Semiring = INT) -> Tensor:
    """The sums of a value column by index."""
    out = frame.select(*[F.col(c).cast("long").alias(i) for c, i in zip(columns, indexes(len(columns)), strict=True)], F.col(value).cast("long").alias("v"))
    return Tensor(out, len(columns), ring)._grouped(dealt(out, indexes(len(columns))), len(columns))


def product_all(spark: SparkSession, tensors: Sequence[Tensor], ring: Semiring = INT) -> Tensor:
    return reduce(Tensor.product, tensors, scalar(spark, 1, ring)) if tensors else scalar(spark, 1, ring)


def sum_all(tensors: Sequence[Tensor]) -> Tensor:
    if not tensors:
        raise ValueError("the sum of no tensors has no order")
    first = tensors[0]
    return first._grouped(reduce(DataFrame.unionByName, [t.frame for t in tensors]), first.order) if len(tensors) > 1 else first


@dataclass
class Incremental:
    """A tensor with a signed change, and the change of what is computed from it."""

    value: Tensor
    delta: Tensor

    def settle(self) -> Tensor:
        return self.value.applied(self.delta)

    def _signed(self, t: Tensor) -> Tensor:
        return Tensor(t.frame, t.order, INT)

    def _bilinear(self, other: Incremental, op: Callable[[Tensor, Tensor], Tensor]) -> Incremental:
        """δ(a·b) = δa·b + a·δb + δa·δb, each corner once."""
        a, da, b, db = (self._signed(t) for t in (self.value, self.delta, other.value, other.delta))
        return Incremental(op(self.value, other.value), sum_all([op(da, b), op(a, db), op(da, db)]))

    def joined(self, other: Incremental, on: Sequence[tuple[int, int]], keep: Sequence[int]) -> Incremental:
        """The change of a contraction of a product, each corner as one join on the shared indexes."""
        op = lambda x, y: x.joined(y, on, keep)
        if self.value.ring != INT:
            return self._recomputed(op(self.value, other.value), op(self.settle(), other.settle()))
        return self._bilinear(other, op)

    def product(self, other: Incremental) -> Incremental:
        return self._bilinear(other, Tensor.product)

    def hadamard(self, other: Incremental) -> Incremental:
        return self._bilinear(other, Tensor.hadamard)

    def _recomputed(self, old: Tensor, new: Tensor) -> Incremental:
        """The change as new minus old, where values do not add up like whole numbers."""
        minus = Tensor(old.frame.withColumn("v", -F.col("v")), old.order, INT)
        return Incremental(old, self._signed(new).sum(minus))

    def sum(self, other: Incremental) -> Incremental:
        if self.value.ring != INT:
            return self._recomputed(self.value.sum(other.value), self.settle().sum(other.settle()))
        return Incremental(self.value.sum(other.value), self._signed(self.delta).sum(self._signed(other.delta)))

    def contract(self, groups: Sequence[int], keep: Sequence[int]) -> Incremental:
        if self.value.ring != INT:
            return self._recomputed(self.value.contract(groups, keep), self.settle().contract(groups, keep))
        return Incremental(self.value.contract(groups, keep), self._signed(self.delta).contract(groups, keep))


def pattern_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def pattern_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def pattern_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def pattern_symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).unionByName(b.subtract(a))
