import pytest
from pyspark.sql import functions as F

from sortalis.lang.ast import Exists, Rel, Sequent, Truth, Var, record
from sortalis.operators.components import Equalities, connected_components
from sortalis.sources.store import FACTS, Names, Overlay, Patch, Store, apply_checked, diff, facts, functions_at, initial, model_of, signature_of, symbols
from sortalis.sources.structure import Product, Signature, Structure

SIG = Signature(["A", "B"])
SIG.add_function("f", "A", Product((("l", "B"), ("r", "B"))))
SIG.add_relation("R", [("x", "A"), ("y", "B")])


def base(spark):
    return Structure(spark, SIG).add("A", [1, 2]).add("B", [7, 8]).define("f", [(1, 7, 8)]).assert_("R", [(1, 7), (2, 8)])


def rows(model):
    return sorted((r.kind, r.symbol, tuple(r.tuple)) for r in facts(model).collect())


def test_patches(spark):
    old = base(spark)
    new = base(spark).add("A", [3]).assert_("R", [(3, 7)])
    new.relations["R"] = new.relations["R"].where("c0 <> 2")
    p = diff(old, new)
    assert not p.is_empty() and diff(old, base(spark)).is_empty()
    assert rows(p.applied(old)) == rows(new) and rows(p.inverted().applied(new)) == rows(old)
    assert rows(initial(new).applied(Structure(spark, SIG))) == rows(new) and rows(model_of(facts(new), SIG)) == rows(new)
    assert [r.elem for r in p.new_elements()["A"].collect()] == [3]
    total = Sequent((("x", "A"),), Truth(), Exists("y", "B", Rel("R", record(Var("x"), Var("y")))), "total")
    assert not apply_checked(old, p, [total])[1] and apply_checked(old, diff(old, base(spark).add("B", [9])), [total])[1]


def test_overlay(spark):
    o = Overlay(base(spark))
    o.put("rel", "R", [(1, 8), (1, 7)]).drop("rel", "R", [(1, 7)]).put("elem", "A", [(5,)]).drop("elem", "A", [(5,)])
    assert rows(o.base) == rows(base(spark))
    assert sorted(map(tuple, o.read().relation("R").collect())) == [(1, 8), (2, 8)]
    o.put("rel", "R", [(1, 7)])
    kept = rows(o.commit())
    assert kept == sorted([*rows(base(spark)), ("rel", "R", (1, 8))]) and o.patch.is_empty()
    o.drop("rel", "R", [(1, 8)])
    assert rows(o.rollback()) == kept


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store", SIG)
    assert s.head == 0 and s.versions() == []
    assert s.commit(base(spark), "first") == 1
    with pytest.raises(ValueError):
        s.commit(base(spark))
    new = base(spark).add("A", [3]).assert_("R", [(3, 7)])
    new.relations["R"] = new.relations["R"].where("c0 <> 2")
    derived = spark.createDataFrame([("rel", "R", [3, 7])], "kind string, symbol string, tuple array<bigint>")
    assert s.commit(new, "second", derived) == 2
    assert rows(s.checkout()) == rows(new) and rows(s.checkout(1)) == rows(base(spark))
    assert s.commit(base(spark), "back") == 3 and rows(s.checkout(3)) == rows(base(spark)) and rows(s.checkout(2)) == rows(new)
    assert [v["message"] for v in s.versions()] == ["first", "second", "back"]
    assert [tuple(r.tuple) for r in s.facts_at(2, "idb").collect()] == [(3, 7)]
    assert s.changes_since(1).where("version = 2 and symbol = 'R'").count() == 1
    assert s.checkout_checked([], 1)[1]


def test_what_refers_to_a_gone_element_goes(spark):
    old = base(spark)
    gone = Patch(spark.createDataFrame([("elem", "A", [1])], FACTS), spark.createDataFrame([], FACTS))
    new = gone.applied(old)
    assert rows(new) == [("elem", "A", (2,)), ("elem", "B", (7,)), ("elem", "B", (8,)), ("rel", "R", (2, 8))]
    whole = gone.completed(old)
    assert rows(whole.applied(old)) == rows(new) and rows(whole.inverted().applied(new)) == rows(old)
    assert sorted(map(tuple, whole.tensor("R", 2).frame.collect())) == [(1, 7, -1)] and not whole.grows() and whole.inverted().grows()


def test_edits_of_elements_and_values(spark):
    o = Overlay(base(spark))
    assert list(o.add_elements("A", 3)) == [3, 4, 5] and list(o.add_elements("A")) == [6]
    o.set_values("f", [(1, 8, 8), (3, 7, 7)]).retract_elements("B", [7])
    got = o.read()
    assert sorted(r.elem for r in got.carrier("A").collect()) == [1, 2, 3, 4, 5, 6]
    assert sorted(map(tuple, got.function("f").collect())) == [(1, 8, 8)] and sorted(map(tuple, got.relation("R").collect())) == [(2, 8)]


def test_bindings_and_lost_writers(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store", SIG)
    s.commit(base(spark), "first")
    s.bind("good")
    facts(base(spark).add("A", [77])).withColumn("op", F.lit("come")).withColumn("source", F.lit("edb")).write.partitionBy("source").parquet(f"file://{tmp_path}/store/facts/version=2/batch=lost")
    assert s.head == 1 and rows(s.checkout()) == rows(base(spark))
    s.commit(base(spark).add("A", [3]), "second")
    assert rows(s.checkout()) == rows(base(spark).add("A", [3])) and s.resolve("good") == 1
    s.bind("good")
    assert s.resolve("good") == 2 and s.resolve("good", 1) == 1 and s.resolve("bad") is None


def test_equalities(spark):
    pairs = lambda *p: spark.createDataFrame(list(p), "a long, b long")
    e = Equalities(spark).add(pairs((5, 4), (7, 8)))
    assert not e.are_equal(5, 4) and e.pending.count() == 2
    e.settle().add(pairs((4, 3), (8, 8))).settle()
    assert e.are_equal(5, 3) and e.are_equal(9, 9) and not e.are_equal(5, 7) and e.pending.count() == 0
    assert sorted(r.a for r in e.find(pairs((5, 0), (8, 0), (9, 0)), "a").collect()) == [3, 7, 9]


def test_names(spark):
    n = Names(spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x", "c"]), (3, ["c"])], "id long, path array<string>"))
    assert n.resolve(["c"]) == [3] and n.resolve(["b", "c"]) == [1] and n.resolve(["q"]) == []
    assert sorted(r.id for r in n.suffix(["c"]).collect()) == [1, 2, 3]
    assert symbols(spark, SIG).count() == 2 + 3 + 2
    again = signature_of(symbols(spark, SIG))
    assert (sorted(again.sorts), again.functions, again.relations) == (SIG.sorts, SIG.functions, SIG.relations)
    assert sorted(map(tuple, functions_at(symbols(spark, SIG), "B", "result").collect())) == [("function", "f")]
    assert n.lookup(["c"]) == ("unique", [3]) and n.lookup(["q"]) == ("unknown", []) and Names(n.frame.where("id <> 3")).lookup(["c"]) == ("ambiguous", [1, 2])


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (20, 21), (21, 21), (30, 31), (31, 32), (32, 30), (None, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {5: 3, 4: 3, 3: 3, 9: 3, 20: 20, 21: 20, 30: 30, 31: 30, 32: 30} | {100 + i: 100 for i in range(41)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame(edges, "a long, b long"), most_rounds=1)
