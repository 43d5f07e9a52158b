"""Shards of documents by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations.

Method: every shard has virtual nodes at hashed points of a ring.  A document belongs to the first virtual
node at or after its own point (the hash of its doc_id).  Loads are bounded: a shard takes its share of the
rows, n / shards rounded up or down, and no more.  A shard's bound is dealt to its virtual nodes in
proportion to their own rows.  What overflows a full node continues clockwise to the next nodes with room,
first come first.  So the counts of any two shards differ by one at most, which is the law ``rows``, and
only overflowing rows leave the node that plain consistent hashing gives them.

The walk round the ring is done for counts, not for rows: it runs over the table of virtual nodes, of
shards * replicas rows at most, as window sums.  Its result is a table of segments (the rows of a node from
one rank to another go to this shard, from this slot on) of at most three times that size, which is
broadcast.  The rows themselves are shuffled once, for their ranks within a node.

Defined cases: a null doc_id is a key like any other; a null text has no bytes; rows that repeat lie at the
same point and fill slots of their own; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINTS = 1 << 16  # of the ring
REPLICAS = 64
SHARDS = 40


def _point(key: str) -> str:
    return f"cast(conv(substr(md5({key}), 1, 4), 16, 10) as int)"


def ring(spark: SparkSession, shards: int = SHARDS, replicas: int = REPLICAS) -> DataFrame:
    """Rows (node, point, shard) of the virtual nodes, numbered clockwise; a point taken twice is the lower shard's."""
    nodes = spark.range(shards * replicas).selectExpr(f"cast(id div {replicas} as int) shard", f"id % {replicas} replica")
    nodes = nodes.selectExpr(_point("concat(shard, ':', replica)") + " point", "shard").groupBy("point").agg(F.min("shard").alias("shard"))
    return nodes.select((F.row_number().over(Window.orderBy("point")) - 1).alias("node"), "point", "shard")


def _owners(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """Rows (point, node): for each point of the ring the first node at or after it."""
    points = spark.range(POINTS).selectExpr("cast(id as int) point").join(nodes.select("point", "node"), "point", "left")
    ahead = Window.orderBy(F.desc("point")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return points.select("point", F.coalesce(F.last("node", ignorenulls=True).over(ahead), F.lit(0)).alias("node"))


def _segments(nodes: DataFrame, counts: DataFrame, shards: int) -> DataFrame:
    """Rows (node, low, high, shard, slot): rows of a node with rank from low to below high get the slots from slot on."""
    by_shard, round_ = Window.partitionBy("shard"), Window.orderBy("node")
    running = Window.partitionBy("shard").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = nodes.join(F.broadcast(counts), "node", "left").select("node", "shard", F.coalesce("n", F.lit(0)).alias("n"))
    t = t.withColumn("total", F.sum("n").over(Window.partitionBy())).withColumn("own", F.sum("n").over(by_shard))
    t = t.withColumn("bound", F.expr(f"total div {shards} + if(shard < total % {shards}, 1, 0)"))
    t = t.withColumn("weight", F.expr("if(own = 0, 1, n)"))
    t = t.withColumn("weights", F.sum("weight").over(by_shard)).withColumn("upto", F.sum("weight").over(running))
    big = "cast(bound as decimal(19, 0)) * cast({} as decimal(19, 0)) div weights"
    t = t.withColumn("room", F.expr(f"{big.format('upto')} - {big.format('(upto - weight)')}").cast("long"))
    t = t.withColumn("home", F.least("n", "room")).withColumn("over", F.expr("n - home")).withColumn("free", F.expr("room - home"))
    # Behind the least prefix sum nothing is left to place: the walk starts there.
    t = t.withColumn("level", F.sum(F.expr("over - free")).over(round_.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    t = t.withColumn("cut", F.min(F.struct("level", "node")).over(Window.partitionBy()).getField("node"))
    t = t.withColumn("nodes", F.count("*").over(Window.partitionBy())).withColumn("turn", F.expr("(node - cut - 1 + nodes) % nodes"))
    before = Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("over_at", F.coalesce(F.sum("over").over(before), F.lit(0))).withColumn("free_at", F.coalesce(F.sum("free").over(before), F.lit(0)))
    marks = t.where("over > 0").selectExpr("over_at at", "named_struct('node', node, 'home', home, 'at', over_at) source", "cast(null as struct<node:int,shard:int>) target")
    marks = marks.unionByName(t.where("free > 0").selectExpr("free_at at", "cast(null as struct<node:int,home:bigint,at:bigint>) source", "named_struct('node', node, 'shard', shard) target"))
    marks = marks.groupBy("at").agg(F.max("source").alias("source"), F.max("target").alias("target"))
    upto = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = t.agg(F.coalesce(F.sum("over"), F.lit(0)).alias("end"))
    moved = marks.select("at", F.last("source", True).over(upto).alias("source"), F.last("target", True).over(upto).alias("target"), F.lead("at").over(Window.orderBy("at")).alias("next"))
    moved = moved.join(F.broadcast(ends), F.col("at") < F.col("end")).withColumn("next", F.coalesce("next", "end"))
    moved = moved.selectExpr("source.node node", "source.home + at - source.at low", "source.home + next - source.at high", "target.shard shard", "target.node place")
    parts = t.where("home > 0").selectExpr("node", "cast(0 as bigint) low", "home high", "shard", "node place").unionByName(moved)
    slots = Window.partitionBy("shard").orderBy("place", "node", "low").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("node", "low", "high", "shard", F.coalesce(F.sum(F.expr("high - low")).over(slots), F.lit(0)).alias("slot"))


def sharded(docs: DataFrame, shards: int = SHARDS, replicas: int = REPLICAS) -> DataFrame:
    """One row for each document: size, checksum, shard, and its slot in the shard, gapless from 0."""
    spark = docs.sparkSession
    nodes = ring(spark, shards, replicas)
    owners = F.broadcast(_owners(spark, nodes))
    key = "coalesce(cast(doc_id as string), '')"
    placed = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").selectExpr(
        "doc_id", "coalesce(octet_length(text), 0) + cast(16 as long) size", "crc32(coalesce(text, '')) text_crc32", f"{_point(key)} point", f"cast(conv(substr(md5({key}), 5, 15), 16, 10) as long) place"
    )
    counts = docs.selectExpr(f"{_point(key)} point").join(owners, "point").groupBy("node").agg(F.count("*").alias("n"))
    segments = F.broadcast(_segments(nodes, counts, shards).withColumnRenamed("node", "of_node"))
    order = Window.partitionBy("node").orderBy("point", "place", "doc_id", "text_crc32", "size")
    ranked = placed.join(owners, "point").select("doc_id", "size", "text_crc32", "node", (F.row_number().over(order) - 1).alias("rank"))
    out = ranked.join(segments, (F.col("node") == F.col("of_node")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return out.selectExpr("doc_id", "size", "text_crc32", "'rows' law", "shard", "slot + rank - low slot", "cast(null as int) grown_shard", "node home_node")
