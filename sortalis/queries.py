"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortalis.functions.predicates import Always, And, ColEqCol, ColEqConst, FuncEq, FuncEqConst, Never, Or
from sortalis.lang.ast import App, Conj, Disj, Eq, Exists, Falsity, Proj, Rel, Sequent, Truth, Var, record
from sortalis.lang.elaborate import Workspace
from sortalis.lang.pretty import show_theory
from sortalis.operators import tensor, zset
from sortalis.operators.chase import chase
from sortalis.operators.check import check_theory, new_violations, violations
from sortalis.operators.components import Equalities
from sortalis.operators.formula import extent
from sortalis.operators.solver import Budget, extend, solve
from sortalis.plans.builder import Pattern, Query, filter_project, simple_filter
from sortalis.plans.ops import Apply, ApplyField, Constant, Delay, Diff, Distinct, Empty, Filter, Integrate, Join, JoinWhere, Negate, Plan, Project, Scan, ScanRelation, Union, execute, explain, optimize
from sortalis.plans.planio import execute_table, to_table
from sortalis.plans.views import View
from sortalis.session import Session
from sortalis.sources.shared import new_folder
from sortalis.sources.store import FACTS, Names, Overlay, Patch, Store, facts, functions_at, signature_of, symbols
from sortalis.sources.structure import Signature, Structure, commerce, table
from sortalis.streaming.context import StreamContext

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under a name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def plan(name: str, build: Plan, sql: str) -> None:
    """Registers a plan over the driver's tables."""
    query(name, sql)(lambda spark, sf_dir: execute(build, commerce(spark, sf_dir)))


CN = "(SELECT c_custkey c0, c_nationkey c1 FROM customer)"
LI = "SELECT CAST(l_orderkey AS BIGINT) c0, CAST(l_partkey AS BIGINT) c1, CAST(l_suppkey AS BIGINT) c2 FROM lineitem GROUP BY ALL"

# scans and constants
plan("scan_sort", Scan("Nation"), "SELECT CAST(n_nationkey AS BIGINT) c0, CAST(1 AS BIGINT) mult FROM nation")
plan("scan_relation", ScanRelation("lineitem"), f"SELECT c0, c1, c2, CAST(1 AS BIGINT) mult FROM ({LI})")
plan("constant", Constant((7, 9)), "SELECT CAST(7 AS BIGINT) c0, CAST(9 AS BIGINT) c1, CAST(1 AS BIGINT) mult")
plan("empty", Empty(2), "SELECT CAST(0 AS BIGINT) c0, CAST(0 AS BIGINT) c1, CAST(0 AS BIGINT) mult WHERE false")

# filters
plan("filter_true_false", Union(Filter(Scan("Region"), Always()), Filter(Scan("Nation"), Never())), "SELECT CAST(r_regionkey AS BIGINT) c0, CAST(1 AS BIGINT) mult FROM region")
plan("filter_col_const", Filter(ScanRelation("lineitem"), ColEqConst(2, 3)), f"SELECT c0, c1, c2, CAST(1 AS BIGINT) mult FROM ({LI}) WHERE c2 = 3")
plan("filter_col_col", Filter(ScanRelation("lineitem"), ColEqCol(1, 2)), f"SELECT c0, c1, c2, CAST(1 AS BIGINT) mult FROM ({LI}) WHERE c1 = c2")
plan(
    "filter_func_eq",
    Filter(Join(Scan("Customer"), Scan("Nation")), FuncEq("cust_nation", 0, 1)),
    "SELECT CAST(c_custkey AS BIGINT) c0, CAST(c_nationkey AS BIGINT) c1, CAST(1 AS BIGINT) mult FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
plan("filter_func_const", Filter(Scan("Customer"), FuncEqConst("cust_nation", 0, 3)), "SELECT CAST(c_custkey AS BIGINT) c0, CAST(1 AS BIGINT) mult FROM customer WHERE c_nationkey = 3")
plan(
    "filter_and_or",
    Filter(Scan("Customer"), Or(FuncEqConst("cust_nation", 0, 3), And(FuncEqConst("cust_nation", 0, 4), ColEqConst(0, 10))) | ColEqConst(0, 5)),
    "SELECT CAST(c_custkey AS BIGINT) c0, CAST(1 AS BIGINT) mult FROM customer WHERE c_nationkey = 3 OR (c_nationkey = 4 AND c_custkey = 10) OR c_custkey = 5",
)

# projection and function application
plan("project_bag", Project(ScanRelation("lineitem"), (2,)), f"SELECT c2 c0, CAST(count(*) AS BIGINT) mult FROM ({LI}) GROUP BY c2")
plan("project_repeat", Project(ScanRelation("lineitem"), (2, 2, 1)), f"SELECT c2 c0, c2 c1, c1 c2, CAST(count(*) AS BIGINT) mult FROM ({LI}) GROUP BY ALL")
plan("apply_func", Apply(Scan("Order"), "order_cust", 0), "SELECT CAST(o_orderkey AS BIGINT) c0, CAST(o_custkey AS BIGINT) c1, CAST(1 AS BIGINT) mult FROM orders")
plan("apply_undefined", Project(Apply(Scan("Document"), "label", 0), (1, 2)), "SELECT CAST(quality AS BIGINT) c0, CAST(toxic AS BIGINT) c1, CAST(count(*) AS BIGINT) mult FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL")
plan("apply_field", ApplyField(Scan("Document"), "label", 0, "toxic"), "SELECT CAST(doc_id AS BIGINT) c0, CAST(toxic AS BIGINT) c1, CAST(1 AS BIGINT) mult FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
plan(
    "apply_chain",
    Project(Apply(Apply(Apply(Scan("Order"), "order_cust", 0), "cust_nation", 1), "nation_region", 2), (3,)),
    "SELECT CAST(n_regionkey AS BIGINT) c0, CAST(count(*) AS BIGINT) mult FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
)
plan("pattern_filter_project", Pattern("Nation").filter("nation_region", 2).project("nation_region").compile(), "SELECT CAST(n_regionkey AS BIGINT) c0, CAST(count(*) AS BIGINT) mult FROM nation WHERE n_regionkey = 2 GROUP BY 1")
plan("pattern_tuple", Pattern("Supplier").project_tuple(["supp_nation", "supp_nation"]).compile(), "SELECT CAST(s_nationkey AS BIGINT) c0, CAST(s_nationkey AS BIGINT) c1, CAST(count(*) AS BIGINT) mult FROM supplier GROUP BY ALL")
plan("simple_filter", simple_filter("Supplier", "supp_nation", 6), "SELECT CAST(s_suppkey AS BIGINT) c0, CAST(1 AS BIGINT) mult FROM supplier WHERE s_nationkey = 6")
plan("filter_project", filter_project("Order", "order_cust", 11, "order_cust"), "SELECT CAST(o_custkey AS BIGINT) c0, CAST(count(*) AS BIGINT) mult FROM orders WHERE o_custkey = 11 GROUP BY 1")

# joins
plan("join_cross", Join(Scan("Region"), Scan("Nation")), "SELECT CAST(r_regionkey AS BIGINT) c0, CAST(n_nationkey AS BIGINT) c1, CAST(1 AS BIGINT) mult FROM region, nation")
plan(
    "join_equi",
    Join(Project(Apply(Scan("Supplier"), "supp_nation", 0), (1,)), Project(Apply(Scan("Customer"), "cust_nation", 0), (1,)), ((0, 0),)),
    "SELECT CAST(s_nationkey AS BIGINT) c0, CAST(c_nationkey AS BIGINT) c1, CAST(count(*) AS BIGINT) mult FROM supplier JOIN customer ON s_nationkey = c_nationkey GROUP BY ALL",
)
plan(
    "join_predicate",
    JoinWhere(Scan("Customer"), Scan("Nation"), And(FuncEq("cust_nation", 0, 1), Or(ColEqConst(1, 2), ColEqConst(1, 5)))),
    "SELECT CAST(c_custkey AS BIGINT) c0, CAST(c_nationkey AS BIGINT) c1, CAST(1 AS BIGINT) mult FROM customer WHERE c_nationkey IN (2, 5)",
)
plan(
    "join_on_func",
    Query.scan("Supplier").join_scan("Nation").join_on_func("supp_nation", 0, "nation_region", 1).compile(),
    "SELECT CAST(s_suppkey AS BIGINT) c0, CAST(n_nationkey AS BIGINT) c1, CAST(s_nationkey AS BIGINT) c2, CAST(n_regionkey AS BIGINT) c3, CAST(1 AS BIGINT) mult FROM supplier JOIN nation ON s_nationkey = n_regionkey",
)
plan(
    "query_builder",
    Query.scan("Order").join_scan("Customer").join_on_func("order_cust", 0, "cust_nation", 1).where_const("cust_nation", 1, 7).project_funcs([(1, None), (0, "order_cust")]).compile(),
    "SELECT CAST(c_custkey AS BIGINT) c0, CAST(o_custkey AS BIGINT) c1, CAST(count(*) AS BIGINT) mult FROM orders JOIN customer ON o_custkey = c_nationkey WHERE c_nationkey = 7 GROUP BY ALL",
)

# signed bags
_CUST = Project(Apply(Scan("Customer"), "cust_nation", 0), (1,))
_SUPP = Project(Apply(Scan("Supplier"), "supp_nation", 0), (1,))
_SIGNED = "SELECT CAST(k AS BIGINT) c0, CAST(sum(m) AS BIGINT) mult FROM (SELECT s_nationkey k, {} m FROM supplier UNION ALL SELECT c_nationkey k, {} m FROM customer) GROUP BY 1 HAVING sum(m) <> 0"
plan("union_zset", Union(_SUPP, _CUST), _SIGNED.format(1, 1))
plan("negate", Negate(_CUST), "SELECT CAST(c_nationkey AS BIGINT) c0, CAST(-count(*) AS BIGINT) mult FROM customer GROUP BY 1")
plan("difference_zset", Union(_SUPP, Negate(_CUST)), _SIGNED.format(1, -1))
plan("distinct_zset", Distinct(Union(Join(_SUPP, Constant((1,))), Negate(Join(_CUST, Constant((1,)))))), f"SELECT c0, CAST(1 AS BIGINT) c1, CAST(1 AS BIGINT) mult FROM ({_SIGNED.format(1, -1)}) WHERE mult > 0")
plan("difference_cancels", Union(_CUST, Negate(_CUST)), "SELECT CAST(0 AS BIGINT) c0, CAST(0 AS BIGINT) mult WHERE false")

# patterns and tensors


def _pairs(spark: SparkSession, sf_dir: str, returned: bool) -> DataFrame:
    """(part, supplier) of the lines that came back, or of those that did not."""
    came_back = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").where(came_back if returned else ~came_back).select(F.col("l_partkey").cast("long").alias("c0"), F.col("l_suppkey").cast("long").alias("c1"))


_BACK, _KEPT = ("SELECT DISTINCT CAST(l_partkey AS BIGINT) c0, CAST(l_suppkey AS BIGINT) c1 FROM lineitem WHERE " + w for w in ("l_returnflag = 'R'", "l_returnflag <> 'R'"))
for _name, _op, _sql in (
    ("pattern_union", tensor.pattern_union, f"{_BACK} UNION {_KEPT}"),
    ("pattern_intersect", tensor.pattern_intersection, f"{_BACK} INTERSECT {_KEPT}"),
    ("pattern_difference", tensor.pattern_difference, f"{_BACK} EXCEPT {_KEPT}"),
    ("pattern_symdiff", tensor.pattern_symmetric_difference, f"(({_BACK} EXCEPT {_KEPT}) UNION ({_KEPT} EXCEPT {_BACK}))"),
):
    query(_name, _sql)(lambda spark, sf_dir, op=_op: op(_pairs(spark, sf_dir, True), _pairs(spark, sf_dir, False)))


def _quantities(spark: SparkSession, sf_dir: str) -> tensor.Tensor:
    """(supplier, part): the sum of whole quantities."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.floor("l_quantity").cast("long").alias("q"))
    return tensor.from_entries(rows, ["l_suppkey", "l_partkey"], "q")


def _sizes(spark: SparkSession, sf_dir: str) -> tensor.Tensor:
    return tensor.from_entries(table(spark, sf_dir, "part"), ["p_partkey"], "p_size")


_Q = "SELECT CAST(l_suppkey AS BIGINT) i0, CAST(l_partkey AS BIGINT) i1, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) v FROM lineitem GROUP BY ALL HAVING v <> 0"


@query("tensor_contract_z", f"SELECT i0, CAST(sum(v * p_size) AS BIGINT) v FROM ({_Q}) JOIN part ON i1 = p_partkey GROUP BY i0 HAVING sum(v * p_size) <> 0")
def _contract(spark, sf_dir):
    return _quantities(spark, sf_dir).joined(_sizes(spark, sf_dir), [(1, 0)], [0]).frame


@query("tensor_hadamard", f"SELECT i0, i1, CAST(v * n AS BIGINT) v FROM ({_Q}) JOIN (SELECT l_suppkey s, l_partkey p, count(*) n FROM lineitem GROUP BY ALL) ON i0 = s AND i1 = p")
def _hadamard(spark, sf_dir):
    ones = table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1))
    return _quantities(spark, sf_dir).hadamard(tensor.from_entries(ones, ["l_suppkey", "l_partkey"], "one")).frame


@query("tensor_product", "SELECT CAST(n_nationkey AS BIGINT) i0, CAST(r_regionkey AS BIGINT) i1, CAST((n_nationkey + 1) * (r_regionkey + 2) AS BIGINT) v FROM nation, region")
def _product(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("v", F.col("n_nationkey") + 1)
    r = table(spark, sf_dir, "region").withColumn("v", F.col("r_regionkey") + 2)
    return tensor.from_entries(n, ["n_nationkey"], "v").product(tensor.from_entries(r, ["r_regionkey"], "v")).frame


@query("tensor_sum", f"SELECT i0, i1, CAST(sum(v) AS BIGINT) v FROM (SELECT * FROM ({_Q}) UNION ALL SELECT i0, i1, CAST(-1 AS BIGINT) v FROM ({_Q})) GROUP BY ALL HAVING sum(v) <> 0")
def _sum(spark, sf_dir):
    q = _quantities(spark, sf_dir)
    minus = tensor.Tensor(q.frame.withColumn("v", F.lit(-1).cast("long")), 2)
    return q.sum(minus).frame


@query("tensor_exists_bool", "SELECT DISTINCT CAST(l_suppkey AS BIGINT) i0, CAST(1 AS BIGINT) v FROM lineitem")
def _exists_bool(spark, sf_dir):
    return tensor.from_pattern(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey"], tensor.BOOL).exists(1).frame


@query("tensor_diagonal", f"SELECT i0, v FROM ({_Q}) WHERE i0 = i1")
def _diagonal(spark, sf_dir):
    return _quantities(spark, sf_dir).diagonal(0, 1).frame


@query(
    "tensor_incremental",
    "SELECT CAST(l_suppkey AS BIGINT) i0, CAST(sum(CAST(floor(l_quantity) AS BIGINT) * p_size) AS BIGINT) v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber > 1 GROUP BY 1 HAVING v <> 0",
)
def _incremental(spark, sf_dir):
    """The change of a contraction when lines come in."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber", F.floor("l_quantity").cast("long").alias("q"))
    entries = lambda f: tensor.from_entries(f, ["l_suppkey", "l_partkey"], "q")
    x = tensor.Incremental(entries(rows.where("l_linenumber <= 1")), entries(rows.where("l_linenumber > 1")))
    y = tensor.Incremental(_sizes(spark, sf_dir), tensor.zero(spark, 1))
    return x.joined(y, [(1, 0)], [0]).delta.frame


# streams: a step for each day of events, elements are users


def _days(events: DataFrame) -> list[date]:
    """Each day from the first event's to the last one's; events without a time have none."""
    first, last = events.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    return [first + timedelta(days=d) for d in range((last - first).days + 1)] if first else []


def _steps(spark: SparkSession, sf_dir: str, build: Callable[[Plan], Plan]) -> DataFrame:
    """The results of a plan at each step, with the step's number."""
    sig = Signature()
    sig.add_sort("User")
    sig.add_relation("seen", [("user", "User")])
    context, out = StreamContext(), spark.createDataFrame([], "c0 long, mult long, step long")
    events = table(spark, sf_dir, "events")
    for step, day in enumerate(_days(events)):
        model = Structure(spark, sig).set_relation("seen", events.where(F.to_date("ts") == F.lit(day)), ["user_id"], distinct=False)
        now = context.run(build(ScanRelation("seen")), model).withColumn("step", F.lit(step).cast("long"))
        out = out.unionByName(now)
    return out


_E = "(SELECT CAST(user_id AS BIGINT) c0, CAST(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) AS BIGINT) step FROM events WHERE ts IS NOT NULL)"
_LAST = f"(SELECT max(step) FROM {_E})"
_STEPS = f"(SELECT CAST(unnest(range(0, {_LAST} + 1)) AS BIGINT) step)"


@query("stream_delay", f"SELECT c0, CAST(count(*) AS BIGINT) mult, step + 1 AS step FROM {_E} WHERE step < {_LAST} GROUP BY c0, step")
def _delay(spark, sf_dir):
    return _steps(spark, sf_dir, lambda s: Delay(s, "d"))


_DIFF = f"SELECT c0, CAST(sum(m) AS BIGINT) mult, step FROM (SELECT c0, step, 1 m FROM {_E} UNION ALL SELECT c0, step + 1, -1 FROM {_E} WHERE step < {_LAST}) GROUP BY c0, step HAVING sum(m) <> 0"
_SUM = f"SELECT c0, CAST(count(*) AS BIGINT) mult, s.step step FROM {_E} e JOIN {_STEPS} s ON e.step <= s.step GROUP BY c0, s.step"


@query("stream_diff", _DIFF)
def _diff(spark, sf_dir):
    return _steps(spark, sf_dir, lambda s: Diff(s, "d"))


@query("stream_integrate", _SUM)
def _integrate(spark, sf_dir):
    return _steps(spark, sf_dir, lambda s: Integrate(s, "i"))


@query("stream_filter_diff", f"SELECT * FROM ({_DIFF}) WHERE c0 = 7")
def _filter_diff(spark, sf_dir):
    return _steps(spark, sf_dir, lambda s: Filter(Diff(s, "d"), ColEqConst(0, 7)))


@query("stream_integrate_diff", f"SELECT c0, CAST(count(*) AS BIGINT) mult, step FROM {_E} GROUP BY c0, step")
def _integrate_diff(spark, sf_dir):
    return _steps(spark, sf_dir, lambda s: Integrate(Diff(s, "d"), "i"))


# formulas


def _formula(name: str, f, context: dict[str, str], sql: str) -> None:
    def run(spark, sf_dir):
        e = extent(commerce(spark, sf_dir), f, context)
        return e.columns(sorted(e.vars)) if e.vars else e.frame.agg((F.count("*") > 0).alias("holds"))

    query(name, sql)(run)


_L = lambda o, p, s: Rel("lineitem", record(order=o, part=p, supplier=s))
O, P, S, C, N, R = (Var(x) for x in "opscnr")  # noqa: E741
SORTS = {"o": "Order", "p": "Part", "s": "Supplier", "c": "Customer", "n": "Nation", "r": "Region", "d": "Document", "m": "Nation"}
_formula("formula_atom", _L(O, P, S), SORTS, f"SELECT c0 o, c1 p, c2 s FROM ({LI})")
_formula("formula_exists", Exists("p", "Part", _L(O, P, S)), SORTS, "SELECT DISTINCT CAST(l_orderkey AS BIGINT) o, CAST(l_suppkey AS BIGINT) s FROM lineitem")
_formula("formula_diagonal", Exists("p", "Part", _L(O, P, O)), SORTS, "SELECT DISTINCT CAST(l_orderkey AS BIGINT) o FROM lineitem WHERE l_orderkey = l_suppkey")
_formula("formula_eq_terms", Eq(App("cust_nation", C), App("supp_nation", S)), SORTS, "SELECT CAST(c_custkey AS BIGINT) c, CAST(s_suppkey AS BIGINT) s FROM customer JOIN supplier ON c_nationkey = s_nationkey")
_formula("formula_nested_terms", Eq(App("nation_region", App("cust_nation", App("order_cust", O))), R), SORTS, "SELECT CAST(o_orderkey AS BIGINT) o, CAST(n_regionkey AS BIGINT) r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
_formula(
    "formula_disj",
    Disj((Exists("c", "Customer", Eq(App("cust_nation", C), N)), Conj((Eq(App("nation_region", N), R), Exists("s", "Supplier", Eq(App("supp_nation", S), N)))))),
    SORTS,
    "SELECT DISTINCT CAST(c_nationkey AS BIGINT) n, CAST(r_regionkey AS BIGINT) r FROM customer, region UNION SELECT CAST(n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT) FROM nation JOIN supplier ON s_nationkey = n_nationkey",
)
_formula("formula_record_field", Eq(Proj(App("label", Var("d")), "toxic"), Proj(App("label", Var("d")), "quality")), SORTS, "SELECT CAST(doc_id AS BIGINT) d FROM labels WHERE toxic = quality")
_formula("formula_scalar", Exists("n", "Nation", Eq(App("nation_region", N), App("nation_region", N))), SORTS, "SELECT count(*) > 0 AS holds FROM nation")
_formula("natural_join", Conj((Eq(App("supp_nation", S), N), Exists("o", "Order", _L(O, P, S)))), SORTS, "SELECT DISTINCT CAST(s_nationkey AS BIGINT) n, CAST(l_partkey AS BIGINT) p, CAST(l_suppkey AS BIGINT) s FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")


def _by_name(e) -> DataFrame:
    return e.columns(sorted(e.vars))


@query("check_violations", "SELECT CAST(p_partkey AS BIGINT) p, CAST(s_suppkey AS BIGINT) s FROM part, supplier WHERE p_partkey = s_suppkey AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey)")
def _check(spark, sf_dir):
    """Part and supplier of one number should have a line."""
    model = commerce(spark, sf_dir)
    both = model.carrier("Part").intersect(model.carrier("Supplier"))
    model.signature.add_relation("twin", [("part", "Part"), ("supplier", "Supplier")])
    model.set_relation("twin", both, ["elem", "elem"])
    rule = Sequent((("p", "Part"), ("s", "Supplier")), Rel("twin", record(P, S)), Exists("o", "Order", _L(O, P, S)))
    return _by_name(violations(model, rule))


@query("check_domain", "SELECT CAST(c_custkey AS BIGINT) c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _check_domain(spark, sf_dir):
    """Every customer should have an order: the premise binds no variable."""
    rule = Sequent((("c", "Customer"),), Truth(), Exists("o", "Order", Eq(App("order_cust", O), C)))
    return _by_name(violations(commerce(spark, sf_dir), rule))


@query("check_incremental", "SELECT CAST(c_custkey AS BIGINT) c FROM customer WHERE c_acctbal < 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _check_incremental(spark, sf_dir):
    """The same where the customers in debt are the new ones."""
    model = commerce(spark, sf_dir)
    rule = Sequent((("c", "Customer"),), Truth(), Exists("o", "Order", Eq(App("order_cust", O), C)))
    return _by_name(new_violations(model, rule, {"Customer": table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").cast("long").alias("elem"))}))


# the chase


def _graph(spark: SparkSession, sf_dir: str) -> Structure:
    """The turns of conversations and the step from each to the next."""
    sig = Signature()
    sig.add_sort("Turn")
    for r in ("edge", "path"):
        sig.add_relation(r, [("src", "Turn"), ("tgt", "Turn")])
    turns = table(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn a", "conv_id * 1000 + turn + 1 b")
    edges = turns.join(turns.selectExpr("a as b"), "b").select("a", "b")
    return Structure(spark, sig).set_carrier("Turn", turns.select("a").distinct(), "a").set_relation("edge", edges, ["a", "b"])


X, Y, Z = Var("x"), Var("y"), Var("z")
_T = (("x", "Turn"), ("y", "Turn"), ("z", "Turn"))
CLOSURE = [
    Sequent(_T, Rel("edge", record(X, Y)), Rel("path", record(X, Y)), "base"),
    Sequent(_T, Conj((Rel("path", record(X, Y)), Rel("path", record(Y, Z)))), Rel("path", record(X, Z)), "step"),
]
_TURNS = "(SELECT DISTINCT CAST(conv_id * 1000 + turn AS BIGINT) t FROM conversations)"
_CLOSURE = f"WITH RECURSIVE e AS (SELECT a.t c0, b.t c1 FROM {_TURNS} a JOIN {_TURNS} b ON b.t = a.t + 1), p AS (SELECT c0, c1 FROM e UNION SELECT p.c0, e.c1 FROM p JOIN e ON p.c1 = e.c0)"


@query("chase_closure", f"{_CLOSURE} SELECT c0, c1 FROM p")
def _closure(spark, sf_dir):
    return chase(_graph(spark, sf_dir), CLOSURE)[0].relation("path")


@query("chase_preorder", f"{_CLOSURE} SELECT c0, c1 FROM p UNION SELECT t, t FROM {_TURNS}")
def _preorder(spark, sf_dir):
    reflexive = Sequent((("x", "Turn"),), Truth(), Rel("path", record(X, X)), "reflexive")
    return chase(_graph(spark, sf_dir), [reflexive, *CLOSURE])[0].relation("path")


@query("chase_existential", f"SELECT count(*) AS n_turns, count(*) AS n_notes, count(*) AS n_pairs FROM {_TURNS}")
def _existential(spark, sf_dir):
    """Each turn gets a note of its own; elements are fresh, so counts are compared."""
    model = _graph(spark, sf_dir)
    model.signature.add_sort("Note")
    model.signature.add_relation("noted", [("turn", "Turn"), ("note", "Note")])
    out, _ = chase(model, [Sequent((("x", "Turn"),), Truth(), Exists("n", "Note", Rel("noted", record(X, N))))])
    pairs = out.relation("noted").agg(F.countDistinct("c0").alias("n_turns"), F.countDistinct("c1").alias("n_notes"))
    return pairs.crossJoin(out.relation("noted").agg(F.count("*").alias("n_pairs")))


@query("chase_equality", "SELECT DISTINCT CAST(min(doc_id) OVER (PARTITION BY text) AS BIGINT) elem FROM documents WHERE text IS NOT NULL")
def _equality(spark, sf_dir):
    """Documents with the same text are one."""
    sig = Signature()
    sig.add_sort("Doc")
    sig.add_relation("same", [("a", "Doc"), ("b", "Doc")])
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    pairs = docs.join(first, "h").where("doc_id <> first")
    model = Structure(spark, sig).set_carrier("Doc", docs, "doc_id").set_relation("same", pairs, ["doc_id", "first"])
    rule = Sequent((("x", "Doc"), ("y", "Doc")), Rel("same", record(X, Y)), Eq(X, Y))
    return chase(model, [rule])[0].carrier("Doc")


@query("chase_congruence", "SELECT CAST(min(c_custkey) AS BIGINT) a0, CAST(c_nationkey AS BIGINT) r0 FROM customer GROUP BY c_nationkey")
def _congruence(spark, sf_dir):
    """An injective function: customers of one nation are one, and its table follows."""
    sig = Signature()
    for s in ("Customer", "Nation"):
        sig.add_sort(s)
    sig.add_function("cust_nation", "Customer", "Nation")
    whole = commerce(spark, sf_dir)
    model = Structure(spark, sig)
    model.carriers = {s: whole.carrier(s) for s in sig.sorts}
    least = whole.function("cust_nation").groupBy("r0").agg(F.min("a0").alias("b"))
    sig.add_relation("kin", [("a", "Customer"), ("b", "Customer")])
    model.functions["cust_nation"] = whole.function("cust_nation")
    model.set_relation("kin", whole.function("cust_nation").join(least, "r0"), ["a0", "b"])
    rule = Sequent((("x", "Customer"), ("y", "Customer")), Rel("kin", record(X, Y)), Eq(X, Y))
    return chase(model, [rule])[0].function("cust_nation")


@query("zset_consolidate", "SELECT CAST(l_suppkey AS BIGINT) c0, CAST(count(*) AS BIGINT) mult FROM lineitem GROUP BY 1")
def _consolidate(spark, sf_dir):
    return zset.consolidate(zset.bag(table(spark, sf_dir, "lineitem"), [F.col("l_suppkey").cast("long")]))


# formulas and tensors whose operators the queries above do not reach


def _home(spark: SparkSession, sf_dir: str) -> Structure:
    """The tables with a relation of customers and their nations."""
    model = commerce(spark, sf_dir)
    model.signature.add_relation("home", [("who", "Customer"), ("where", "Nation")])
    return model.set_relation("home", table(spark, sf_dir, "customer"), ["c_custkey", "c_nationkey"], distinct=False)


@query("formula_atom_terms", "SELECT CAST(o_orderkey AS BIGINT) o, CAST(c_nationkey AS BIGINT) n FROM orders JOIN customer ON o_custkey = c_custkey")
def _atom_terms(spark, sf_dir):
    return _by_name(extent(_home(spark, sf_dir), Rel("home", record(App("order_cust", O), N)), SORTS))


_formula("formula_eq_vars", Eq(N, Var("m")), SORTS, "SELECT CAST(n_nationkey AS BIGINT) n, CAST(n_nationkey AS BIGINT) m FROM nation")
_formula("formula_truth", Truth(), SORTS, "SELECT true AS holds")
_formula("formula_falsity", Disj(()), SORTS, "SELECT false AS holds")


@query("formula_dangling", "SELECT CAST(o_orderkey AS BIGINT) o, CAST(o_custkey AS BIGINT) c FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0")
def _dangling(spark, sf_dir):
    """Only customers out of debt are elements; orders of the others do not count."""
    model = commerce(spark, sf_dir)
    model.closed = False
    model.set_carrier("Customer", table(spark, sf_dir, "customer").where("c_acctbal >= 0"), "c_custkey")
    return _by_name(extent(model, Eq(App("order_cust", O), C), SORTS))


_RN = "SELECT CAST(r_regionkey AS BIGINT) i0, CAST(n_nationkey AS BIGINT) i1, CAST(s AS BIGINT) i2, CAST(1 AS BIGINT) v FROM region, nation, (SELECT DISTINCT r_regionkey s FROM region)"


@query("tensor_product_all", _RN)
def _product_all(spark, sf_dir):
    ones = lambda t, k: tensor.from_pattern(table(spark, sf_dir, t), [k])
    return tensor.product_all(spark, [ones("region", "r_regionkey"), ones("nation", "n_nationkey"), ones("region", "r_regionkey")]).frame


@query("tensor_sum_all", f"SELECT i0, i1, CAST(3 * v AS BIGINT) v FROM ({_Q})")
def _sum_all(spark, sf_dir):
    q = _quantities(spark, sf_dir)
    return tensor.sum_all([q, q, q]).frame


@query("model_sizes", " UNION ALL ".join(f"SELECT '{k}' kind, '{n}' AS name, CAST(count(*) AS BIGINT) n FROM {t}" for k, n, t in (
    ("sort", "Region", "region"), ("sort", "Nation", "nation"), ("sort", "Customer", "customer"), ("sort", "Supplier", "supplier"), ("sort", "Part", "part"), ("sort", "Order", "orders"), ("sort", "Event", "events"),
    ("sort", "User", "(SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)"), ("sort", "Document", "documents"), ("sort", "Level", "range(2)"), ("function", "nation_region", "nation"), ("function", "cust_nation", "customer"),
    ("function", "supp_nation", "supplier"), ("function", "order_cust", "orders"), ("function", "event_user", "events"), ("function", "label", "labels WHERE quality IS NOT NULL AND toxic IS NOT NULL"), ("relation", "lineitem", f"({LI})"))))
def _sizes_of(spark, sf_dir):
    return commerce(spark, sf_dir).sizes()


# plans as data

_STORED = Filter(Join(Apply(Scan("Supplier"), "supp_nation", 0), Apply(Scan("Nation"), "nation_region", 0), ((1, 0),)), And(FuncEq("nation_region", 1, 3), Or(ColEqConst(3, 1), ColEqCol(1, 2))))
_STORED_SQL = "SELECT CAST(s_suppkey AS BIGINT) c0, CAST(s_nationkey AS BIGINT) c1, CAST(n_nationkey AS BIGINT) c2, CAST(n_regionkey AS BIGINT) c3, CAST(1 AS BIGINT) mult FROM supplier JOIN nation ON s_nationkey = n_nationkey"


@query("plan_table_relational", _STORED_SQL)
def _plan_table(spark, sf_dir):
    """A plan written as a table of operators, read back and run."""
    return execute_table(to_table(_STORED, spark), commerce(spark, sf_dir))


@query("plan_table_tensor", "SELECT DISTINCT CAST(s_nationkey AS BIGINT) c0, CAST(1 AS BIGINT) mult FROM supplier")
def _plan_tensor(spark, sf_dir):
    return execute_table(to_table(Project(_STORED, (1,)), spark, "tensor"), commerce(spark, sf_dir), dialect="tensor")


@query("plan_table_rows", "SELECT * FROM (VALUES (0, 'Scan', CAST([] AS INTEGER[])), (1, 'Apply', [0]), (2, 'Project', [1]), (3, 'Negate', [2]), (4, 'Union', [2, 3])) t(op, kind, inputs)")
def _plan_rows(spark, sf_dir):
    """Equal subplans are one row."""
    return to_table(Union(_CUST, Negate(_CUST)), spark).select("op", "kind", "inputs")


@query("plan_explain", "SELECT * FROM (VALUES (0, 'Project[0, 2]'), (1, '  Join[l#1 = r#0]'), (2, '    Apply[supp_nation(#0)]'), (3, '      Scan(Supplier)'), (4, '    Scan(Nation)')) t(line, body)")
def _plan_explain(spark, sf_dir):
    """What becomes of a function predicate over a cross join."""
    shown = explain(optimize(Filter(Join(Scan("Supplier"), Scan("Nation")), FuncEq("supp_nation", 0, 1)), commerce(spark, sf_dir).signature))
    return spark.createDataFrame(list(enumerate(shown.split("\n"))), "line int, body string")


@query("stream_batch_reading", "SELECT CAST(user_id AS BIGINT) c0, CAST(count(*) AS BIGINT) mult FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def _batch_reading(spark, sf_dir):
    """Without a stream context, stream operators hand their input on."""
    read = Project(Apply(Scan("Event"), "event_user", 0), (1,))
    return execute_table(to_table(Integrate(Diff(Delay(read, "a"), "b"), "c"), spark), commerce(spark, sf_dir))


# checks and the chase


@query("check_theory", "SELECT * FROM (SELECT 'busy' axiom, count(*) n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'placed', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)) WHERE n > 0")
def _check_theory(spark, sf_dir):
    """The axioms that fail, with the number of counterexamples."""
    busy = Sequent((("c", "Customer"),), Truth(), Exists("o", "Order", Eq(App("order_cust", O), C)), "busy")
    placed = Sequent((("c", "Customer"),), Truth(), Exists("n", "Nation", Eq(App("cust_nation", C), N)), "placed")
    failed = check_theory(commerce(spark, sf_dir), [busy, placed]).failed
    out = spark.createDataFrame([], "axiom string, n long")
    for name, found in failed.items():
        out = out.unionByName(found.frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("axiom"), "n"))
    return out


def _regions(spark: SparkSession, sf_dir: str) -> Structure:
    """Nations and regions, with room for what the chase derives."""
    sig, whole = Signature(), commerce(spark, sf_dir)
    for s in ("Nation", "Region", "Supplier"):
        sig.add_sort(s)
    sig.add_function("nation_region", "Nation", "Region")
    sig.add_function("supp_nation", "Supplier", "Nation")
    sig.add_function("supp_region", "Supplier", "Region")
    for r in ("supplied", "plain"):
        sig.add_relation(r, [("nation", "Nation")])
    model = Structure(spark, sig, closed=True)
    model.carriers = {s: whole.carrier(s) for s in sig.sorts}
    model.functions = {f: whole.function(f) for f in ("nation_region", "supp_nation")}
    return model


@query("chase_function", "SELECT CAST(s_suppkey AS BIGINT) a0, CAST(n_regionkey AS BIGINT) r0 FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _chase_function(spark, sf_dir):
    """A function defined by an axiom: a supplier's region."""
    rule = Sequent((("s", "Supplier"),), Truth(), Eq(App("supp_region", S), App("nation_region", App("supp_nation", S))))
    return chase(_regions(spark, sf_dir), [rule])[0].function("supp_region")


@query("chase_conj_disj", "SELECT 'supplied' relation, CAST(s_nationkey AS BIGINT) c0 FROM supplier GROUP BY ALL UNION ALL SELECT 'plain', CAST(s_nationkey AS BIGINT) FROM supplier GROUP BY ALL")
def _conj_disj(spark, sf_dir):
    """A conclusion with a conjunction, and with a disjunction, all parts of which the chase takes."""
    here = App("supp_nation", S)
    rule = Sequent((("s", "Supplier"),), Truth(), Conj((Rel("supplied", record(here)), Disj((Rel("plain", record(here)), Rel("supplied", record(here)))))))
    out, _ = chase(_regions(spark, sf_dir), [rule])
    return reduce(DataFrame.unionByName, [out.relation(r).select(F.lit(r).alias("relation"), "c0") for r in ("supplied", "plain")])


# models in time


def _nations(spark: SparkSession, sf_dir: str) -> Structure:
    whole = commerce(spark, sf_dir)
    sig = Signature()
    for s in ("Region", "Nation", "Customer"):
        sig.add_sort(s)
    sig.add_function("nation_region", "Nation", "Region")
    sig.add_function("cust_nation", "Customer", "Nation")
    model = Structure(spark, sig, closed=True)
    model.carriers = {s: whole.carrier(s) for s in sig.sorts}
    model.functions = {f: whole.function(f) for f in sig.functions}
    return model


def _without_region(spark: SparkSession, region: int) -> Patch:
    return Patch(spark.createDataFrame([("elem", "Region", [region])], FACTS), spark.createDataFrame([], FACTS))


_LEFT = "SELECT kind, symbol, CAST(count(*) AS BIGINT) n FROM (SELECT 'elem' kind, 'Region' symbol FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 'elem', 'Nation' FROM nation UNION ALL SELECT 'elem', 'Customer' FROM customer UNION ALL SELECT 'func', 'nation_region' FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 'func', 'cust_nation' FROM customer) GROUP BY ALL"


@query("patch_applied", _LEFT)
def _patch(spark, sf_dir):
    """A region goes, and with it the values that are that region."""
    return facts(_without_region(spark, 2).applied(_nations(spark, sf_dir))).groupBy("kind", "symbol").agg(F.count("*").alias("n"))


@query("patch_tensor", "SELECT CAST(n_nationkey AS BIGINT) i0, CAST(n_regionkey AS BIGINT) i1, CAST(-1 AS BIGINT) v FROM nation WHERE n_regionkey = 2")
def _patch_tensor(spark, sf_dir):
    """The same change of a function's graph as a tensor."""
    return _without_region(spark, 2).completed(_nations(spark, sf_dir)).tensor("nation_region", 2).frame


@query("overlay_edits", "SELECT CAST(n_nationkey AS BIGINT) a0, CAST(if(n_nationkey = 3, 0, n_regionkey) AS BIGINT) r0 FROM nation UNION ALL SELECT max(n_nationkey) + 1, 4 FROM nation")
def _overlay(spark, sf_dir):
    """A nation changes its region, and a new one comes."""
    o = Overlay(_nations(spark, sf_dir))
    new = o.add_elements("Nation")[0]
    return o.set_values("nation_region", [(3, 0), (new, 4)]).read().function("nation_region")


_VERSIONS = "SELECT CAST(version AS BIGINT) AS version, symbol, CAST(n AS BIGINT) n FROM (SELECT 1 AS version, 'Region' symbol, (SELECT count(*) FROM region) n UNION ALL SELECT 2, 'Region', (SELECT count(*) FROM region WHERE r_regionkey <> 2) UNION ALL SELECT 1, 'nation_region', (SELECT count(*) FROM nation) UNION ALL SELECT 2, 'nation_region', (SELECT count(*) FROM nation WHERE n_regionkey <> 2))"


def _history(spark: SparkSession, sf_dir: str) -> Store:
    """A store with two versions; what is derived in the second is marked."""
    model = _nations(spark, sf_dir)
    store = Store(spark, new_folder(spark, "store"), model.signature)
    store.commit(model, "all")
    store.bind("whole")
    later = _without_region(spark, 2).applied(model)
    later.add("Region", [99])
    store.commit(later, "without two", spark.createDataFrame([("elem", "Region", [99])], FACTS))
    store.bind("part")
    return store


@query("store_versions", _VERSIONS.replace("WHERE r_regionkey <> 2) UNION", "WHERE r_regionkey <> 2) + 1 UNION"))
def _store(spark, sf_dir):
    """Both versions, by the names that are bound to them."""
    store, out = _history(spark, sf_dir), []
    for name in ("whole", "part"):
        version = store.resolve(name)
        rows = facts(store.checkout(version)).where("symbol in ('Region', 'nation_region')")
        out.append(rows.groupBy("symbol").agg(F.count("*").alias("n")).select(F.lit(version).cast("long").alias("version"), "symbol", "n"))
    return out[0].unionByName(out[1])


@query("store_changes", "SELECT CAST(2 AS BIGINT) AS version, 'edb' source, 'gone' op, CAST(n AS BIGINT) n FROM (SELECT 1 + count(*) n FROM nation WHERE n_regionkey = 2) UNION ALL SELECT 2, 'idb', 'come', 1")
def _changes(spark, sf_dir):
    """What the second version changed, given and derived."""
    return _history(spark, sf_dir).log.where("version = 2").groupBy("version", "source", "op").agg(F.count("*").alias("n"))


@query("names_resolve", "SELECT 'suffix' how, CAST(n_nationkey AS BIGINT) id FROM nation WHERE n_name = (SELECT min(n_name) FROM nation) UNION ALL SELECT 'exact', CAST(n_nationkey AS BIGINT) FROM nation WHERE n_regionkey = 1")
def _names(spark, sf_dir):
    """Nations under their region's name: by the last part alone, and by whole paths."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = nations.select(F.col("n_nationkey").cast("long").alias("id"), F.array("r_name", "n_name").alias("path"), "n_regionkey", "n_name")
    names = Names(rows.select("id", "path"))
    first = rows.agg(F.min("n_name")).first()[0]
    paths = [r.path for r in rows.where("n_regionkey = 1").select("path").collect()]
    out = names.suffix([first]).select(F.lit("suffix").alias("how"), "id")
    return reduce(DataFrame.unionByName, [names.exact(p).select(F.lit("exact").alias("how"), "id") for p in paths], out)


@query("view_follows", "SELECT CAST(n_regionkey AS BIGINT) c0, CAST(count(*) AS BIGINT) mult FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2 GROUP BY 1")
def _view(spark, sf_dir):
    """Customers by region, taken along when a region goes."""
    plan = Project(Apply(Apply(Scan("Customer"), "cust_nation", 0), "nation_region", 1), (2,))
    return View(plan, _nations(spark, sf_dir)).follow(_without_region(spark, 2)).frame


@query("schema_reflected", "SELECT * FROM (VALUES ('function', 'cust_nation'), ('function', 'nation_region')) t(kind, name)")
def _schema(spark, sf_dir):
    """The functions with a nation in them, asked of the schema's own table after a round trip."""
    again = signature_of(symbols(spark, _nations(spark, sf_dir).signature))
    rows = symbols(spark, again)
    return functions_at(rows, "Nation").unionByName(functions_at(rows, "Nation", "result"))


@query("equalities", "SELECT CAST(c_custkey AS BIGINT) c, CAST(min(c_custkey) OVER (PARTITION BY c_nationkey) AS BIGINT) root FROM customer")
def _equalities(spark, sf_dir):
    """Customers of one nation held equal, in two rounds."""
    graph = commerce(spark, sf_dir).function("cust_nation")
    other = graph.groupBy("r0").agg(F.max("a0").alias("b"))
    pairs = graph.join(other, "r0").select(F.col("a0").alias("a"), "b")
    e = Equalities(spark).add(pairs.where("a % 2 = 0")).settle().add(pairs.where("a % 2 = 1")).settle()
    return e.find(graph.select(F.col("a0").alias("c"), F.col("a0").alias("root")), "root")


# model search and the language


@query("solver_forced", "SELECT CAST(r_regionkey AS BIGINT) a0, CAST((r_regionkey + 1) % (SELECT count(*) FROM region) AS BIGINT) r0 FROM region")
def _solver_forced(spark, sf_dir):
    """A total function that an axiom forces."""
    sig, regions = Signature(["Region"]), commerce(spark, sf_dir).carrier("Region")
    sig.add_function("next", "Region", "Region")
    sig.add_relation("after", [("a", "Region"), ("b", "Region")])
    n = regions.count()
    model = Structure(spark, sig).set_carrier("Region", regions, "elem").set_relation("after", regions.selectExpr("elem a", f"(elem + 1) % {n} b"), ["a", "b"])
    rule = Sequent((("x", "Region"), ("y", "Region")), Rel("after", record(X, Y)), Eq(App("next", X), Y), "next")
    return extend(model, [rule], Budget(600, 100)).model.function("next")


@query("solver_fresh", "SELECT CAST(0 AS BIGINT) a0, CAST(max(r_regionkey) + 1 AS BIGINT) r0 FROM region")
def _solver_fresh(spark, sf_dir):
    """No region will do, so the search makes one."""
    sig = Signature(["One", "Region"])
    sig.add_function("pick", "One", "Region")
    sig.add_relation("bad", [("r", "Region")])
    regions = commerce(spark, sf_dir).carrier("Region")
    model = Structure(spark, sig).add("One", [0]).set_carrier("Region", regions, "elem").set_relation("bad", regions, ["elem"])
    rule = Sequent((("x", "One"),), Rel("bad", record(App("pick", X))), Falsity(), "no")
    return extend(model, [rule], Budget(600, 100)).model.function("pick")


@query("solver_refuted", "SELECT 'unsat' outcome")
def _solver_refuted(spark, sf_dir):
    """A witness that may not be."""
    sig = Signature(["Thing"])
    sig.add_relation("odd", [("t", "Thing")])
    some = Sequent((), Truth(), Exists("x", "Thing", Rel("odd", record(X))), "some")
    none = Sequent((("x", "Thing"),), Rel("odd", record(X)), Falsity(), "none")
    return spark.createDataFrame([(solve(Structure(spark, sig), [some, none], Budget(600, 100)).outcome.value,)], "outcome string")


_TEXT = """
theory Trains { Stop : Sort; Line : Sort; from : Line -> Stop; to : Line -> Stop; rides : [a: Stop, b: Stop] -> Prop;
  direct : forall l : Line, a, b : Stop. l from = a /\\ l to = b |- [a: a, b: b] rides;
  change : forall a, b, c : Stop. [a: a, b: b] rides, [a: b, b: c] rides |- [a: a, b: c] rides; }
instance Valley : Trains = chase { w, x, y : Stop; red, blue : Line; red from = w; red to = x; blue from = x; blue to = y; }
"""


@query("language_chase", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(1 AS BIGINT)), (0, 2), (1, 2)) t(c0, c1)")
def _language(spark, sf_dir):
    """A theory and an instance as text, elaborated and chased."""
    w = Workspace(spark)
    w.load(_TEXT)
    return w.instances["Valley"].model.relation("rides")


@query("language_round_trip", "SELECT 'Trains' AS name, 2 sorts, 2 functions, 1 relations, 2 axioms, true same")
def _round_trip(spark, sf_dir):
    """A theory printed and read again."""
    first = Workspace(spark).load(_TEXT)[0]
    again = Workspace(spark).load(show_theory(first))[0]
    sig = again.signature
    same = again.axioms == first.axioms and sig == first.signature
    return spark.createDataFrame([(again.name, len(sig.sorts), len(sig.functions), len(sig.relations), len(again.axioms), same)], "name string, sorts int, functions int, relations int, axioms int, same boolean")


@query("session_commands", "SELECT * FROM (VALUES (0, 'theory Trains, instance Valley'), (1, 'z : Stop'), (2, '4 of Stop, w, x, y, z'), (3, 'x and what refers to it is gone'), (4, 'relation rides: 1')) t(line, answer)")
def _session(spark, sf_dir):
    """Text and commands in a row; the last line of a listing stands for it."""
    s = Session(spark)
    answers = [s.run(x).replace("\n", ", ") for x in (_TEXT, ":add Valley z Stop", ":query Valley Stop", ":retract Valley x", ":inspect Valley")]
    answers[-1] = answers[-1].split(", ")[-1]
    return spark.createDataFrame(list(enumerate(answers)), "line int, answer string")
