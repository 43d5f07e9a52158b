"""Plans against bags in plain Python, on random structures and plans."""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sortalis.functions.predicates import Always, And, ColEqCol, ColEqConst, FuncEq, FuncEqConst, Never, Or
from sortalis.operators import zset
from sortalis.plans.builder import Pattern, Query, filter_project, simple_filter
from sortalis.plans.ops import Apply, ApplyField, Constant, Delay, Distinct, Empty, Filter, Join, JoinWhere, Negate, PlanError, Project, Scan, ScanRelation, StreamContextRequired, Union, arity, execute, explain, optimize
from sortalis.plans.views import View, change
from sortalis.plans.planio import InstantaneousCycle, check_cycles, execute_table, from_table, to_table
from sortalis.sources.store import diff
from sortalis.sources.structure import Product, Signature, Structure


@pytest.fixture(scope="module")
def model(spark):
    sig = Signature()
    for s in ("A", "B", "C"):
        sig.add_sort(s)
    sig.add_function("f", "A", "B")
    sig.add_function("g", "A", Product((("l", "B"), ("r", "A"))))
    sig.add_relation("R", [("x", "A"), ("y", "B")])
    m = Structure(spark, sig)
    m.add("A", [1, 2, 3, 4]).add("B", [2, 3])
    m.define("f", [(1, 2), (2, 3), (3, 3)]).define("g", [(1, 2, 4), (2, 3, 3)]).assert_("R", [(1, 2), (2, 2), (4, 3)])
    return m


DATA = {"A": [1, 2, 3, 4], "B": [2, 3], "C": []}
F_ = {1: 2, 2: 3, 3: 3}
G = {1: (2, 4), 2: (3, 3)}
R = [(1, 2), (2, 2), (4, 3)]


def holds(p, t):
    match p:
        case Always():
            return True
        case Never():
            return False
        case ColEqConst(c, v):
            return t[c] == v
        case ColEqCol(a, b):
            return t[a] == t[b]
        case FuncEq(_, a, r):
            return t[a] in F_ and F_[t[a]] == t[r]
        case FuncEqConst(_, a, v):
            return F_.get(t[a]) == v
        case And(a, b):
            return holds(a, t) and holds(b, t)
        case Or(a, b):
            return holds(a, t) or holds(b, t)


def brute(p):
    out = Counter()
    match p:
        case Scan(s):
            out.update((x,) for x in DATA[s])
        case ScanRelation():
            out.update(R)
        case Constant(v):
            out[v] = 1
        case Filter(x, q):
            out.update({t: m for t, m in brute(x).items() if holds(q, t)})
        case Project(x, cols):
            for t, m in brute(x).items():
                out[tuple(t[c] for c in cols)] += m
        case Join(a, b, on):
            for t, m in brute(a).items():
                for u, n in brute(b).items():
                    if all(t[i] == u[j] for i, j in on):
                        out[t + u] += m * n
        case JoinWhere(a, b, q):
            return brute(Filter(Join(a, b), q))
        case Union(a, b):
            for x in (a, b):
                for t, m in brute(x).items():
                    out[t] += m
        case Distinct(x):
            out.update({t: 1 for t, m in brute(x).items() if m > 0})
        case Negate(x):
            out.update({t: -m for t, m in brute(x).items()})
        case Apply(x, f, c):
            for t, m in brute(x).items():
                if t[c] in (F_ if f == "f" else G):
                    out[t + ((F_[t[c]],) if f == "f" else G[t[c]])] += m
        case ApplyField(x, _, c, n):
            for t, m in brute(x).items():
                if t[c] in G:
                    out[(*t, G[t[c]]["lr".index(n)])] += m
    return Counter({t: m for t, m in out.items() if m})


def bag(frame):
    return Counter({tuple(r)[:-1]: r.mult for r in frame.collect()})


def predicates(n):
    col = st.integers(0, n - 1)
    base = st.one_of(st.just(Always()), st.just(Never()), st.builds(ColEqConst, col, st.integers(1, 4)), st.builds(ColEqCol, col, col), st.builds(FuncEq, st.just("f"), col, col), st.builds(FuncEqConst, st.just("f"), col, st.integers(2, 3)))
    return st.recursive(base, lambda x: st.one_of(st.builds(And, x, x), st.builds(Or, x, x)), max_leaves=3)


@st.composite
def plans(draw, depth=3):
    kind = draw(st.sampled_from(["leaf"] if not depth else ["leaf", "filter", "project", "join", "equi", "union", "distinct", "negate", "apply"]))
    if kind == "leaf":
        return draw(st.sampled_from([Scan("A"), Scan("B"), Scan("C"), Constant((1,)), Empty(1), Constant((2, 3)), ScanRelation("R")]))
    x = draw(plans(depth=depth - 1))
    n = WIDTH(x)
    if kind == "filter":
        return Filter(x, draw(predicates(n)))
    if kind == "project":
        return Project(x, tuple(draw(st.lists(st.integers(0, n - 1), min_size=1, max_size=2))))
    if kind == "distinct":
        return Distinct(x)
    if kind == "negate":
        return Negate(x)
    if kind == "apply":
        return Apply(x, "f", draw(st.integers(0, n - 1)))
    y = draw(plans(depth=depth - 1))
    if kind == "union":
        keep = min(n, WIDTH(y))
        return Union(Project(x, tuple(range(keep))), Project(y, tuple(range(keep))))
    on = ((draw(st.integers(0, n - 1)), draw(st.integers(0, WIDTH(y) - 1))),) if kind == "equi" else ()
    return Join(x, y, on)


def WIDTH(p):  # noqa: N802
    sig = Signature(["A", "B", "C"])
    sig.add_function("f", "A", "B")
    sig.add_relation("R", [("x", "A"), ("y", "B")])
    return arity(p, sig)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(plan=plans())
def test_random_plans(model, plan):
    want = brute(plan)
    assert bag(execute(plan, model)) == want
    assert bag(execute(plan, model, rewrite=False)) == want


@pytest.mark.parametrize(
    "plan",
    [
        Apply(Scan("A"), "g", 0),
        ApplyField(Scan("A"), "g", 0, "r"),
        JoinWhere(Scan("A"), Scan("B"), And(ColEqCol(0, 1), FuncEqConst("f", 0, 3))),
        JoinWhere(Scan("A"), Scan("B"), Or(ColEqCol(0, 1), FuncEq("f", 0, 1))),
        Pattern("A").filter("f", 3).compile(),
        Pattern("A").project_tuple(["f", "f"]).compile(),
        simple_filter("A", "f", 2),
        filter_project("A", "f", 3, "f"),
        Query.scan("A").join_scan("A").join_on_func("f", 0, "f", 1).where_eq(0, 1).compile(),
        Query.scan("A").where_const("f", 0, 3).where_element(0, 2).project_funcs([(0, None), (0, "f")]).compile(),
    ],
)
def test_plans_and_tables(spark, model, plan):
    want = brute(plan)
    assert bag(execute(plan, model)) == want
    table = to_table(plan, spark)
    assert from_table(table) == plan
    assert bag(execute_table(table, model)) == want
    tensor = to_table(plan, spark, "tensor")
    assert bag(execute_table(tensor, model, dialect="tensor")) == Counter({t: 1 for t, m in want.items() if m > 0})


def test_laws(model):
    a, b = Scan("A"), Project(ScanRelation("R"), (1,))
    z = lambda p: execute(p, model)
    assert zset.equal(z(Union(a, b)), z(Union(b, a)))
    assert zset.equal(z(Negate(Negate(b))), z(b))
    assert zset.equal(z(Distinct(Distinct(b))), z(Distinct(b)))
    assert z(Union(b, Negate(b))).isEmpty()
    assert z(Join(a, b)).count() == 4 * 2


def test_rewrites_reach_a_fixpoint(model):
    sig = model.signature
    assert optimize(Distinct(Distinct(Filter(Scan("A"), Always()))), sig) == Distinct(Scan("A"))
    assert optimize(Union(Negate(Negate(Filter(Scan("A"), Never()))), Scan("B")), sig) == Scan("B")
    assert optimize(Join(Filter(Scan("A"), And(Never(), Always())), Scan("B")), sig) == Empty(2)
    assert optimize(Project(Project(ScanRelation("R"), (1, 0)), (1,)), sig) == Project(ScanRelation("R"), (0,))
    once = optimize(Filter(Filter(Scan("A"), ColEqConst(0, 1)), ColEqConst(0, 2)), sig)
    assert once == Filter(Scan("A"), And(ColEqConst(0, 1), ColEqConst(0, 2)))


@pytest.mark.parametrize("plan", [Project(Scan("A"), (1,)), Filter(Scan("A"), ColEqCol(0, 2)), Apply(Scan("A"), "nope", 0), Union(Scan("A"), ScanRelation("R")), ApplyField(Scan("A"), "g", 0, "z"), Join(Scan("A"), Scan("B"), ((1, 0),))])
def test_dangling_references_are_refused(model, plan):
    with pytest.raises(PlanError):
        execute(plan, model)


def test_stream_operators_need_a_context(model):
    with pytest.raises(StreamContextRequired):
        execute(Delay(Scan("A"), "d"), model)
    assert bag(execute_table(to_table(Delay(Scan("A"), "d"), model.spark), model)) == brute(Scan("A"))


def test_cycles():
    assert check_cycles([(0, "Delay", [1]), (1, "Union", [0])]) == [0, 1]
    with pytest.raises(InstantaneousCycle):
        check_cycles([(0, "Negate", [1]), (1, "Union", [0])])


def test_explain_shows_the_tree(model):
    text = explain(Filter(Join(Scan("A"), Scan("B"), ((0, 0),)), Or(ColEqConst(0, 1), FuncEq("f", 0, 1))))
    assert text.splitlines() == ["Filter[(#0 = 1 ∨ f(#0) = #1)]", "  Join[l#0 = r#0]", "    Scan(A)", "    Scan(B)"]
    assert "Scan" in explain(Delay(Scan("A"), "s")) and "z⁻¹" in explain(Delay(Scan("A"), "s"))


def test_unknown_tables_are_empty(model):
    assert execute(Scan("nothing"), model).isEmpty() and execute(ScanRelation("nothing"), model).isEmpty()


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(plan=plans())
def test_views_follow_patches(model, plan):
    new = model.copy().add("A", [5]).define("f", [(4, 2), (5, 3)]).assert_("R", [(5, 3), (3, 3)])
    new.relations["R"] = new.relations["R"].where("c0 <> 2")
    new.functions["f"] = new.functions["f"].where("a0 <> 1")
    moved = change(optimize(plan, model.signature), model, new, diff(model, new))
    got = zset.consolidate(zset.union(execute(plan, model), moved))
    assert bag(got) == bag(execute(plan, new))


def test_a_view_is_kept(model):
    plan = Distinct(Project(Apply(Scan("A"), "f", 0), (1,)))
    view = View(plan, model)
    assert bag(view.frame) == {(2,): 1, (3,): 1}
    patch = diff(model, model.copy().define("f", [(4, 3)]))
    patch.gone = model.spark.createDataFrame([("elem", "A", [1])], patch.gone.schema)
    assert bag(view.follow(patch).frame) == {(3,): 1}


def physical(spark, frame):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        return frame._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["filter_func_eq", "join_predicate", "join_on_func", "query_builder", "tensor_incremental", "check_incremental"])
def test_no_cartesian_products(spark, sf_dir, name):
    from sortalis.queries import QUERIES

    assert "CartesianProduct" not in physical(spark, QUERIES[name](spark, sf_dir))
    assert "NestedLoop" not in physical(spark, QUERIES[name](spark, sf_dir))
