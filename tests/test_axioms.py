"""Programs of the theory language: checks, the chase, and model search."""

import pytest

from sortalis.lang.ast import App, Conj, Disj, Eq, Exists, Falsity, Proj, Rel, Sequent, Truth, Var, record
from sortalis.lang.elaborate import AxiomViolation, DuplicateName, PartialFunction, TypeMismatch, UnknownName, Workspace
from sortalis.lang.lexer import LanguageError, tokens
from sortalis.lang.parser import parse
from sortalis.lang.pretty import show_theory
from sortalis.operators.chase import Chase, MaxIterationsExceeded, chase
from sortalis.operators.check import border, check_theory, interior, new_violations, violations
from sortalis.operators.formula import FormulaError, extent
from sortalis.operators.solver import Budget, Outcome, Status, enumerate_models, solve
from sortalis.session import Session
from sortalis.sources.structure import Product, Signature, Structure

RIVERS = """
theory Rivers { // which place's water passes which other
  Place : Sort;
  runs : [up: Place, down: Place] -> Prop;
  sees : [by: Place, of: Place] -> Prop;
  near : forall p, q : Place. [up: p, down: q] runs |- [by: q, of: p] sees;
  far : forall p, q, r : Place. [by: q, of: p] sees, [up: q, down: r] runs |- [by: r, of: p] sees;
}
instance Brook : Rivers = chase { spring, mill, ford, weir, sea : Place; [up: spring, down: mill] runs; [up: mill, down: ford] runs; [up: ford, down: weir] runs; [weir, sea] runs; }
instance Moat : Rivers = chase { gate, tower : Place; [gate, tower] runs; [tower, gate] runs; }
instance Fork : Rivers = chase { north, south, east, town : Place; [north, town] runs; [south, town] runs; [east, south] runs; }
"""


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_what_is_seen_downstream(spark):
    w = Workspace(spark)
    w.load(RIVERS)
    assert rows(w.instances["Brook"].model.relation("sees")) == [(i, j) for i in range(5) for j in range(i)]
    assert w.instances["Moat"].model.relation("sees").count() == 4
    assert rows(w.instances["Fork"].model.relation("sees")) == [(1, 2), (3, 0), (3, 1), (3, 2)]
    done = w.instances["Brook"].model
    assert chase(done, w.theories["Rivers"].axioms)[1] == 1
    assert w.instances["Brook"].label("Place", 2) == "ford" and w.instances["Brook"].label("Place", 9) == "Place#9"


def test_reflexivity_and_its_rounds(spark):
    w = Workspace(spark)
    w.load("theory P { X : Sort; leq : [lo: X, hi: X] -> Prop; r : forall x : X. |- [lo: x, hi: x] leq; }  instance D : P = chase { a, b, c : X; }")
    assert rows(w.instances["D"].model.relation("leq")) == [(0, 0), (1, 1), (2, 2)] and w.instances["D"].iterations == 2


def test_existential_premise_through_functions(spark):
    w = Workspace(spark)
    w.load("""
    theory G { V : Sort; E : Sort; src : E -> V; tgt : E -> V; reach : [from: V, to: V] -> Prop;
      r : forall x, y : V. exists e : E. e src = x /\\ e tgt = y |- [from: x, to: y] reach; }
    instance I : G = chase { a, b, c : V; e, f : E; e src = a; e tgt = b; f src = b; f tgt = c; }""")
    assert rows(w.instances["I"].model.relation("reach")) == [(0, 1), (1, 2)]


def test_fresh_witnesses(spark):
    w = Workspace(spark)
    w.load("theory T { A : Sort; B : Sort; R : [a: A, b: B] -> Prop; ax : forall x : A. |- exists y : B. [a: x, b: y] R; }  instance I : T = chase { p, q, r : A; k : B; [a: p, b: k] R; }")
    m = w.instances["I"].model
    assert m.carrier("B").count() == 3 and m.relation("R").groupBy("c0").count().where("count <> 1").isEmpty()


def test_equal_elements_merge_and_functions_follow(spark):
    w = Workspace(spark)
    w.load("""
    theory T { A : Sort; B : Sort; f : A -> B; same : [x: A, y: A] -> Prop;
      ax : forall x, y : A. [x: x, y: y] same |- x = y; }
    instance I : T = chase { p, q, r, s : A; k, l, m : B; p f = k; q f = l; r f = m; [x: p, y: q] same; [x: r, y: s] same; }""")
    m = w.instances["I"].model
    assert rows(m.carrier("A")) == [(0,), (2,)] and rows(m.carrier("B")) == [(0,), (2,)]  # f(p) = f(q) follows
    assert rows(m.function("f")) == [(0, 0), (2, 2)] and rows(m.relation("same")) == [(0, 0), (2, 2)]


def test_values_are_defined(spark):
    w = Workspace(spark)
    w.load("theory T { A : Sort; f : A -> A; R : [x: A, y: A] -> Prop; ax : forall x, y : A. [x: x, y: y] R |- x f = y; }  instance I : T = chase { a, b, c : A; [x: a, y: b] R; [x: a, y: c] R; }")
    m = w.instances["I"].model
    assert rows(m.function("f")) == [(0, 1)] and rows(m.carrier("A")) == [(0,), (1,)]


def test_record_existential(spark):
    w = Workspace(spark)
    w.load("theory T { A : Sort; B : Sort; R : Sort; data : R -> [x: A, y: B]; ax : forall a : A, b : B. |- exists r : R. r data = [x: a, y: b]; }  instance I : T = chase { p : A; k, l : B; }")
    m = w.instances["I"].model
    assert m.carrier("R").count() == 2 and sorted(r[1:] for r in rows(m.function("data"))) == [(0, 0), (0, 1)]


def test_laws_of_a_product_domain_are_checked(spark):
    text = """
    theory Monoid { M : Sort; mul : [x: M, y: M] -> M; id : M -> M;
      left : forall e, x : M. e id = e |- [x: e, y: x] mul = x;
      assoc : forall x, y, z : M. |- [x: [x: x, y: y] mul, y: z] mul = [x: x, y: [x: y, y: z] mul] mul; }
    """
    w = Workspace(spark)
    w.load(text + "instance And : Monoid = { t, f : M; t id = t; f id = t; [x: t, y: t] mul = t; [x: t, y: f] mul = f; [x: f, y: t] mul = f; [y: f, x: f] mul = f; }")
    assert w.instances["And"].report and not w.instances["And"].report.skipped
    with pytest.raises(AxiomViolation):
        w.load("instance Bad : Monoid = { t, f : M; t id = t; f id = t; [t, t] mul = f; [t, f] mul = f; [f, t] mul = f; [f, f] mul = t; }")


def test_disjunctive_conclusion(spark):
    text = "theory Lamps { Lamp : Sort; lit : [l: Lamp] -> Prop; dark : [l: Lamp] -> Prop; wired : [from: Lamp, to: Lamp] -> Prop; law : forall a, b : Lamp. [from: a, to: b] wired |- [l: b] lit \\/ [l: a] dark; }"
    w = Workspace(spark)
    w.load(text + " instance Hall : Lamps = { p, q : Lamp; [from: p, to: q] wired; [l: p] dark; }")
    with pytest.raises(AxiomViolation) as e:
        w.load("instance Attic : Lamps = { p, q : Lamp; [from: p, to: q] wired; p lit; }")
    assert list(e.value.report.failed) == ["law"]
    w.load("instance Yard : Lamps = chase { p, q : Lamp; [from: p, to: q] wired; }")
    m = w.instances["Yard"].model
    assert rows(m.relation("lit")) == [(1,)] and rows(m.relation("dark")) == [(0,)]


def test_parameters_nesting_and_extension(spark):
    w = Workspace(spark)
    w.load("""
    namespace demo;
    theory School { Room : Sort; Class : Sort; home : Class -> Room; }
    theory (S : School instance) Tour { guest : Sort; visits : guest -> S/Room; }
    theory (X : Sort) Marked { flag : Sort; on : flag -> X; }
    theory Campus extends School { Gate : Sort; leads : Gate -> Room; }
    instance North : School = { lab, gym : Room; third : Class; third home = lab; }
    instance Monday : North Tour = { ann : guest; ann visits = S/gym; }
    instance Flags : North/Room Marked = { red : flag; red on = lab; }
    query open_day { ? : North Tour instance; }""")
    assert rows(w.instances["Monday"].model.function("visits")) == [(0, 1)]
    assert rows(w.instances["Monday"].model.function("North/home" if "North/home" in w.instances["Monday"].model.functions else "S/home")) == [(0, 0)]
    assert rows(w.instances["Flags"].model.function("on")) == [(0, 0)]
    assert set(w.theories["Campus"].signature.functions) == {"home", "leads"}
    goal = w.goals["open_day"]
    found = enumerate_models(goal.base, goal.theory.axioms, Budget(60, 50))
    assert found.outcome == Outcome.FOUND and sorted(found.model.signature.sorts) == ["S/Class", "S/Room", "guest"]


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("theory T { A : Sort; A : Sort; }", DuplicateName),
        ("theory T { f : A -> A; }", UnknownName),
        ("theory T { A : Sort; B : Sort; f : A -> B; ax : forall x : A. |- x f = x; }", TypeMismatch),
        ("theory T { A : Sort; ax : forall x : A. |- x R; }", UnknownName),
        ("theory T { A : Sort; R : [a: A, a: A] -> Prop; }", LanguageError),
        ("theory T { A : Sort; f : A -> A; } instance I : T = { a : A; }", PartialFunction),
        ("theory T { A : Sort; } instance I : U = { a : A; }", UnknownName),
        ("theory T { A : Sort; } instance I : T = { a : A; a : A; }", DuplicateName),
        ("theory T { A : Sort; B : Sort; f : A -> B; } instance I : T = { a : A; b : B; a f = a; }", TypeMismatch),
        ("theory T { A : Sort; } theory T { }", DuplicateName),
        ("theory { A : Sort; }", LanguageError),
        ("theory T { A : Sort }", LanguageError),
        ("what", LanguageError),
    ],
)
def test_errors(spark, text, error):
    with pytest.raises(error):
        Workspace(spark).load(text)


def test_text_round_trip(spark):
    w = Workspace(spark)
    text = """theory T { A : Sort; B : Sort; f : A -> [l: B, r: B]; R : [x: A, y: B] -> Prop;
      a : forall x : A, y : B. [x: x, y: y] R /\\ x f .l = y |- (exists z : B. [x: x, y: z] R) \\/ false;
      b : forall x : A. true |- x = x; }"""
    first = w.load(text)[0]
    again = Workspace(spark).load(show_theory(first))[0]
    assert again.axioms == first.axioms and again.signature == first.signature
    with pytest.raises(LanguageError) as e:
        tokens("a\n  $")
    assert (e.value.line, e.value.column) == (2, 3)
    assert parse("theory T { A : Sort; ax : forall x : A. |- exists y : A.; }").items[0].items[1].conclusion.parts[2].parts == ()


@pytest.fixture(scope="module")
def tiny(spark):
    sig = Signature(["A", "B"])
    sig.add_function("f", "A", "A")
    sig.add_relation("R", [("x", "A"), ("y", "A")])
    return Structure(spark, sig).add("A", [0, 1, 2]).define("f", [(0, 1), (1, 1)]).assert_("R", [(0, 0), (0, 1), (2, 1)])


X, Y, Z = Var("x"), Var("y"), Var("z")
SORTS = {"x": "A", "y": "A", "z": "A", "b": "B"}


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (Rel("R", record(X, X)), [(0,)]),
        (Rel("R", record(App("f", X), Y)), []),
        (Rel("R", record(X, App("f", Y))), [(0, 0), (0, 1), (2, 0), (2, 1)]),
        (Eq(App("f", App("f", X)), Y), [(0, 1), (1, 1)]),
        (Eq(X, Y), [(0, 0), (1, 1), (2, 2)]),
        (Eq(X, X), [()]),
        (Conj((Rel("R", record(X, Y)), Rel("R", record(Y, Z)))), [(0, 0, 0), (0, 0, 1)]),
        (Disj((Rel("R", record(X, X)), Eq(App("f", Y), Y))), [(0, 0), (0, 1), (0, 2), (1, 1), (2, 1)]),
        (Disj(()), []),
        (Conj(()), [()]),
        (Exists("y", "A", Rel("R", record(X, Y))), [(0,), (2,)]),
        (Exists("b", "B", Rel("R", record(X, Y))), []),
        (Exists("b", "B", Truth()), []),
        (Exists("z", "A", Truth()), [()]),
    ],
)
def test_formulas(tiny, f, want):
    e = extent(tiny, f, SORTS)
    names = sorted(e.vars)
    assert sorted(tuple(r) for r in e.frame.select(*names).collect()) == want if names else e.frame.count() == len(want)


def test_formula_errors(tiny):
    for f in (Rel("Q", X), Eq(App("g", X), Y), Rel("R", X), Rel("R", record(X, Var("nobody")))):
        with pytest.raises(FormulaError):
            extent(tiny, f, SORTS)


def test_checks(spark, tiny):
    total = Sequent((("x", "A"),), Truth(), Exists("y", "A", Rel("R", record(X, Y))), "total")
    assert rows(violations(tiny, total).frame) == [(1,)]
    assert rows(new_violations(tiny, total, {"A": spark.createDataFrame([(1,), (2,)], "elem long")}).frame) == [(1,)]
    assert rows(new_violations(tiny, total, {"A": spark.createDataFrame([(2,)], "elem long")}).frame) == []
    assert violations(tiny, Sequent((), Truth(), Falsity())).frame.count() == 1
    assert violations(tiny, Sequent((("b", "B"),), Truth(), Exists("b", "B", Truth()))).frame.count() == 1
    report = check_theory(tiny, [total, Sequent((), Rel("nothing", X), Truth(), "odd")])
    assert list(report.failed) == ["total"] and list(report.skipped) == ["odd"] and report.examples() == {"total": [{"x": 1}]}
    pairs = extent(tiny, Rel("R", record(X, Y)), SORTS)
    new = {"A": spark.createDataFrame([(2,)], "elem long")}
    assert rows(border(pairs, SORTS, new).frame) == [(2, 1)] and rows(interior(pairs, SORTS, new).frame) == [(0, 0), (0, 1)]


def test_the_chase_may_not_end(spark):
    sig = Signature(["A"])
    sig.add_relation("R", [("x", "A"), ("y", "A")])
    m = Structure(spark, sig).add("A", [0])
    grow = Sequent((("x", "A"),), Truth(), Exists("y", "A", Rel("R", record(X, Y))))
    with pytest.raises(MaxIterationsExceeded):
        chase(m, [grow], 3)
    run = Chase(m, [Sequent((), Truth(), Falsity(), "no")])
    assert not run.step() and list(run.skipped) == ["no"]


SOLVER = {
    "theory T { A : Sort; B : Sort; f : A -> B; }": Outcome.FOUND,
    "theory T { P : Sort; R : [p: P] -> Prop; ax : forall . |- exists x : P. x R; }": Outcome.FOUND,
    "theory T { P : Sort; R : [p: P] -> Prop; ax : forall x : P. |- x R; }": Outcome.FOUND,
    "theory T { P : Sort; ax : forall . |- false; }": Outcome.UNSAT,
    "theory T { P : Sort; Q : [p: P] -> Prop; R : [p: P] -> Prop; a : forall . |- exists x : P. x Q \\/ x R; b : forall x : P. x Q |- false; }": Outcome.FOUND,
    "theory T { P : Sort; Q : [p: P] -> Prop; a : forall . |- exists x : P. x Q; b : forall x : P. x Q |- false; }": Outcome.UNSAT,
}


@pytest.mark.parametrize(("text", "want"), SOLVER.items())
def test_solver(spark, text, want):
    theory = Workspace(spark).load(text)[0]
    result = solve(Structure(spark, theory.signature), theory.axioms, Budget(90, 50))
    assert result.outcome == want
    if want == Outcome.FOUND:
        assert check_theory(result.model, theory.axioms) and result.model.is_total()
        assert result.tree.settled(0) == Status.SOLVED


def test_a_larger_model_is_found(spark):
    sig = Signature(["A", "B"])
    sig.add_relation("bad", [("b", "B")])
    sig.add_function("f", "A", "B")
    base = Structure(spark, sig).add("A", [0]).add("B", [0]).assert_("bad", [(0,)])
    no = Sequent((("x", "A"),), Rel("bad", record(App("f", Var("x")))), Falsity(), "no")
    found = enumerate_models(base, [no], Budget(120, 50))
    assert found.outcome == Outcome.FOUND and rows(found.model.function("f")) == [(0, 1)] and found.model.size("B") == 2
    never = Sequent((("x", "A"), ("b", "B")), Eq(App("f", Var("x")), Var("b")), Falsity(), "never")
    assert enumerate_models(base, [never], Budget(120, 50)).outcome == Outcome.UNSAT


def test_a_record_value_is_found(spark):
    sig = Signature(["A", "B"])
    sig.add_function("f", "A", Product((("l", "B"), ("r", "B"))))
    sig.add_relation("bad", [("b", "B")])
    base = Structure(spark, sig).add("A", [0]).add("B", [0, 1]).assert_("bad", [(0,)])
    no = Sequent((("x", "A"),), Rel("bad", record(Proj(App("f", Var("x")), "l"))), Falsity(), "no")
    found = enumerate_models(base, [no], Budget(120, 50))
    assert found.outcome == Outcome.FOUND and rows(found.model.function("f")) == [(0, 1, 0)]


def test_rows_that_refer_to_no_element_do_not_count(spark):
    sig = Signature(["A"])
    sig.add_relation("R", [("x", "A"), ("y", "A")])
    sig.add_function("g", "A", "A")
    m = Structure(spark, sig).add("A", [0, 1]).assert_("R", [(0, 1), (0, 9)]).define("g", [(0, 1), (1, 7)])
    assert rows(extent(m, Rel("R", record(X, Y)), {"x": "A", "y": "A"}).columns(["x", "y"])) == [(0, 1)]
    assert rows(extent(m, Eq(App("g", X), Y), {"x": "A", "y": "A"}).columns(["x", "y"])) == [(0, 1)]
    frame = spark.createDataFrame([(5, 1), (5, 2), (None, 3)], "k long, v long")
    n = Structure(spark, sig).set_carrier("A", frame, "k").set_function("g", frame, ["k"], ["v"])
    assert rows(n.carrier("A")) == [(5,)] and rows(n.function("g")) == [(5, 1)]


def test_new_elements_in_either_place(spark):
    sig = Signature(["A"])
    sig.add_relation("R", [("x", "A"), ("y", "A")])
    m = Structure(spark, sig).add("A", [0, 1, 2]).assert_("R", [(0, 1), (1, 2), (2, 0), (0, 0), (2, 1)])
    sym = Sequent((("x", "A"), ("y", "A")), Rel("R", record(X, Y)), Rel("R", record(Y, X)), "sym")
    new = {"A": spark.createDataFrame([(2,)], "elem long")}
    want = [r for r in rows(violations(m, sym).columns(["x", "y"])) if 2 in r]
    assert rows(new_violations(m, sym, new).columns(["x", "y"])) == want and want


def test_session(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}")
    assert s.run("theory Roads { Town : Sort; road : [a: Town, b: Town] -> Prop; back : forall a, b : Town. [a: a, b: b] road |- [a: b, b: a] road; }") == "theory Roads"
    assert s.run("instance Vale : Roads = { ash, elm : Town; }") == "instance Vale"
    assert s.run(":ls") == "theory Roads\ninstance Vale : Roads"
    assert s.run(":add Vale oak Town") == "oak : Town" and s.run(":add Vale oak Town").startswith("error")
    assert s.run(":assert Vale road ash oak") == "road(ash, oak)" and s.run(":assert Vale road ash").startswith("error")
    assert s.run(":query Vale Town") == "3 of Town\nash\nelm\noak"
    assert "relation road: 2" in s.run(":chase Vale") and s.run(":explain Vale Town") == "Scan(Town)"
    assert s.run(":compile Vale Town").endswith("3 entries")
    assert s.run(":ci Vale as found") == "version 1" and s.run(":commit Vale").startswith("error")
    assert s.run(":retract Vale oak") and "relation road: 0" in s.run(":inspect Vale")
    assert s.run(":commit Vale less") == "version 2" and s.run(":log Vale") == "1 as found\n2 less"
    assert s.run(":solve Roads 60000").startswith("found") and s.run(":extend Vale Roads 60000").startswith("found")
    assert s.run(":what").startswith("error") and s.run(":query Vale").startswith("error: :query takes") and ":solve" in s.run(":help")
    assert s.run(":reset") == "reset" and s.run(":list") == ""


def test_search_tree_and_budgets(spark):
    m = Structure(spark, Signature(["A"]))
    from sortalis.operators.solver import SearchTree

    t = SearchTree(m)
    a, b = t.branch(0, "a", m, 0.3), t.branch(0, "b", m, 0.6)
    assert [n.id for n in t.frontier(1)] == [b] and t.path_to(a) == [0, a] and t.settled(0) == Status.OPEN
    t.mark(a, Status.UNSAT)
    t.mark(b, Status.UNSAT)
    assert t.settled(0) == Status.UNSAT and t.summary()["unsat"] == 2 and "A: 0" in t.detail(a)
    assert Budget.quick().steps == 100 and Budget.medium().seconds == 1 and not Budget(5, 0).spend()
