"""Connected components of an edge table, by alternating large and small stars.

Each round is a Spark job over the edges alone, so nothing about single nodes reaches the driver
but two numbers that tell whether a round changed anything.  A node with many neighbours is met by
partial aggregation and by adaptive skew joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortalis.sources.shared import shared_folder


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", most_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for each node that has an edge to another node; root is the least node of its component.

    Nulls, loops and repeated edges are ignored.  Raises RuntimeError if ``most_rounds`` do not suffice.
    """
    shared_folder(edges.sparkSession)
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null and u <> v")
    pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    before = None
    for _ in range(most_rounds):
        pairs = _small_star(_large_star(pairs)).checkpoint()
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components not settled after {most_rounds} rounds")


def _large_star(pairs: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the least of its neighbours and itself."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the least of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


class Equalities:
    """Elements that are held equal: equations wait until ``settle`` works them into the classes."""

    def __init__(self, spark: SparkSession):
        self.classes = spark.createDataFrame([], "node long, root long")
        self.pending = spark.createDataFrame([], "a long, b long")

    def add(self, pairs: DataFrame, left: str = "a", right: str = "b") -> Equalities:
        """Equations that wait."""
        self.pending = self.pending.unionByName(pairs.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b")))
        return self

    def settle(self) -> Equalities:
        """Merges classes by what waits; the least element of a class is its root."""
        known = self.classes.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        self.classes = connected_components(known.unionByName(self.pending))
        self.pending = self.pending.limit(0)
        return self

    def find(self, frame: DataFrame, column: str) -> DataFrame:
        """The frame with each element of a column replaced by its root."""
        found = self.classes.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        joined = frame.join(found, F.col(column) == F.col("_n"), "left")
        return joined.select(*[F.coalesce("_r", column).alias(c) if c == column else F.col(c) for c in frame.columns])

    def are_equal(self, a: int, b: int) -> bool:
        """Whether two elements are in one class."""
        roots = {r.node: r.root for r in self.classes.where(F.col("node").isin(a, b)).collect()}
        return roots.get(a, a) == roots.get(b, b)
