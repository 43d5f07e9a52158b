"""Grouping in parts whose number follows the bytes of the tables."""

import pytest
from oracle import compare, connection
from pyspark.sql import functions as F

from sortalis.operators import tensor
from sortalis.queries import ORACLES, QUERIES
from sortalis.sources import shared


def grouped_in_parts(spark, sf_dir, monkeypatch, name):
    """A query's rows stay and lie in a part for each so many bytes of its tables, none much larger than the others."""
    monkeypatch.setattr(shared, "PART_BYTES", 4000, raising=False)
    got, want = compare(spark, connection(sf_dir), QUERIES[name], ORACLES[name], sf_dir)
    assert got == want
    sizes = [r["count"] for r in QUERIES[name](spark, sf_dir).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 20 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_tensor_sum_all_is_grouped_in_parts(spark, sf_dir, monkeypatch):
    grouped_in_parts(spark, sf_dir, monkeypatch, "tensor_sum_all")


def test_tensor_sum_is_grouped_in_parts(spark, sf_dir, monkeypatch):
    grouped_in_parts(spark, sf_dir, monkeypatch, "tensor_sum")


def test_tensor_hadamard_is_grouped_in_parts(spark, sf_dir, monkeypatch):
    grouped_in_parts(spark, sf_dir, monkeypatch, "tensor_hadamard")


def test_scan_relation_is_grouped_in_parts(spark, sf_dir, monkeypatch):
    grouped_in_parts(spark, sf_dir, monkeypatch, "scan_relation")


def test_a_sum_of_many_is_grouped_once(spark):
    x = tensor.Tensor(spark.range(5).selectExpr("id i0", "id + 1 v"), 1)
    assert str(tensor.sum_all([x] * 4).frame._jdf.queryExecution().optimizedPlan()).count("Aggregate") == 1


@pytest.mark.parametrize("size", [0, 7])
def test_small_and_unknown_tables_are_left_alone(spark, sf_dir, size):
    for frame in (spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.createDataFrame([(i,) for i in range(size)], "l_orderkey long")):
        assert shared.dealt(frame, ["l_orderkey"]) is frame
