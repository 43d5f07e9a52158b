"""Equations of two functions, whose solutions are pairs."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sortalis.lang.ast import App, Eq, Var
from sortalis.operators import formula
from sortalis.sources.structure import Signature, Structure

CONTEXT = {"a": "A", "b": "B"}
HERE = {i: 0 if i % 10 else i % 3 for i in range(400)}
THERE = {i: 0 if i % 7 else i % 4 for i in range(90)}


def model(spark, functional):
    sig = Signature(["A", "B", "V"])
    sig.add_function("f", "A", "V")
    sig.add_function("g", "B", "V")
    m = Structure(spark, sig, closed=True)
    m.define("f", list(HERE.items())).define("g", list(THERE.items()))
    m.functional = functional
    return m


@pytest.mark.parametrize("functional", [True, False])
@pytest.mark.parametrize("cell", [7, 2048])
def test_pairs_of_a_frequent_value(spark, monkeypatch, cell, functional):
    monkeypatch.setattr(formula, "CELL", cell, raising=False)
    e = formula.extent(model(spark, functional), Eq(App("f", Var("a")), App("g", Var("b"))), CONTEXT)
    want = Counter((a, b) for a, x in HERE.items() for b, y in THERE.items() if x == y)
    assert Counter((r.a, r.b) for r in e.columns(["a", "b"]).collect()) == want


def test_pairs_of_a_frequent_value_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(formula, "CELL", 7, raising=False)
    e = formula.extent(model(spark, True), Eq(App("f", Var("a")), App("g", Var("b"))), CONTEXT)
    sizes = [r["count"] for r in e.frame.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 8 and max(sizes) < sum(sizes) / 4


def test_values_of_terms_need_no_distinct_where_functions_have_one_value(spark):
    e = formula.extent(model(spark, True), Eq(App("f", Var("a")), App("g", Var("b"))), CONTEXT)
    assert not any(x.startswith("Aggregate [a#") for x in e.frame._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_a_value_given_twice_yields_an_assignment_once(spark):
    m = model(spark, True).define("f", [(0, 1), (0, 2)])
    e = formula.extent(m, Eq(App("f", Var("a")), App("f", Var("a"))), CONTEXT)
    assert not m.functional and sorted(r.a for r in e.frame.collect()) == sorted(HERE)
