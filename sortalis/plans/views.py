"""Materialised views: a plan's result as a table that follows patches of its model.

The change of a result is computed from the changes of what it reads.  Operators that add up hand changes on,
joins and applications combine a change of one side with the other side, and ``distinct`` looks only at tuples
that changed.  A predicate under an ``or`` about functions is compared before and after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortalis.functions.predicates import ColEqCol, ColEqConst, FuncEq, FuncEqConst, conjuncts, function_terms
from sortalis.operators import zset
from sortalis.plans.ops import STREAM, Apply, ApplyField, Constant, Distinct, Empty, Filter, Join, JoinWhere, Negate, Plan, PlanError, Project, Scan, ScanRelation, Union, arity, compiled, filtered, optimize
from sortalis.sources.shared import written
from sortalis.sources.store import Patch, diff
from sortalis.sources.structure import Structure, flat


def change(plan: Plan, old: Structure, new: Structure, patch: Patch) -> DataFrame:
    """The signed bag to add to a plan's old result, not consolidated; the patch leads from the old model to the new."""
    sig = old.signature

    def of(kind: str, symbol: str, width: int) -> DataFrame:
        own = patch.rows().where((F.col("kind") == kind) & (F.col("symbol") == symbol))
        sign = F.when(F.col("op") == "come", 1).otherwise(-1).cast("long").alias(zset.MULT)
        return own.select(*[F.col("tuple")[i].alias(f"c{i}") for i in range(width)], sign)

    def graph(name: str) -> DataFrame:
        symbol = sig.functions[name]
        return of("func", name, len(symbol.columns)).toDF(*symbol.columns, "_m")

    def applied(x: Plan, name: str, col: int, results: list[str]) -> DataFrame:
        n, symbol = arity(x, sig), sig.functions[name]
        moved = zset.apply(go(x), old.function(name), [col], results)
        turned = graph(name).select(F.col("a0").alias("_a"), *[F.col(r).alias(f"c{n + k}") for k, r in enumerate(results)], "_m")
        now = compiled(x, new).join(turned, F.col(f"c{col}") == F.col("_a"))
        width = n + len(results)
        assert len(symbol.arguments) == 1
        return moved.unionByName(now.select(*zset.columns(width), (F.col(zset.MULT) * F.col("_m")).alias(zset.MULT)))

    def go(p: Plan) -> DataFrame:
        match p:
            case Scan(s):
                return of("elem", s, 1)
            case ScanRelation(r):
                return of("rel", r, arity(p, sig))
            case Constant() | Empty():
                return compiled(p, old).limit(0)
            case Project(x, cols):
                return zset.project(go(x), cols)
            case Union(a, b):
                return zset.union(go(a), go(b))
            case Negate(x):
                return zset.negate(go(x))
            case Join(a, b, on):
                return zset.union(zset.join(go(a), compiled(b, old), on), zset.join(compiled(a, new), go(b), on))
            case JoinWhere(a, b, pred):
                return go(Filter(Join(a, b), pred))
            case Apply(x, f, col):
                return applied(x, f, col, sig.functions[f].results)
            case ApplyField(x, f, col, name):
                return applied(x, f, col, [f"r{[k for k, _ in flat(sig.functions[f].codomain)].index(name)}"])
            case Filter(x, pred):
                return wherever(x, pred)
            case Distinct(x):
                before = compiled(x, old)
                moved = zset.consolidate(go(x))
                keys = zset.columns(arity(x, sig))
                same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
                touched = before.join(moved.select(*[F.col(k).alias(f"_{k}") for k in keys]), same, "left_semi")
                sums = zset.consolidate(touched).select(*keys, F.col(zset.MULT).alias("b"), F.lit(0).cast("long").alias("d"))
                sums = sums.unionByName(moved.select(*keys, F.lit(0).cast("long").alias("b"), F.col(zset.MULT).alias("d")))
                both = sums.groupBy(*keys).agg(F.sum("b").alias("b"), F.sum("d").alias("d"))
                step = (F.col("b") + F.col("d") > 0).cast("long") - (F.col("b") > 0).cast("long")
                return both.select(*keys, step.alias(zset.MULT)).where(f"{zset.MULT} <> 0")
        if isinstance(p, STREAM):
            raise PlanError("a view has no steps of its own")
        raise PlanError(f"no such operator: {p}")

    def wherever(x: Plan, pred) -> DataFrame:
        functional = [c for c in conjuncts(pred) if function_terms(c)]
        if not functional:
            return filtered(go(x), pred, old)
        first, n = functional[0], arity(x, sig)
        for c in conjuncts(pred):
            if c is not first:
                x = Filter(x, c)
        if isinstance(first, FuncEq | FuncEqConst):
            test = ColEqCol(n, first.result_col) if isinstance(first, FuncEq) else ColEqConst(n, first.expected)
            return go(Project(Filter(Apply(x, first.func, first.arg_col), test), tuple(range(n))))
        return zset.difference(compiled(Filter(x, first), new), compiled(Filter(x, first), old))

    return go(plan)


class View:
    """A plan's consolidated result, written in the shared folder."""

    def __init__(self, plan: Plan, model: Structure):
        self.plan, self.model = optimize(plan, model.signature), model
        self.frame = written(zset.consolidate(compiled(self.plan, model)), "view")

    def follow(self, patch: Patch) -> View:
        """Takes the view to the model after a patch."""
        new = patch.applied(self.model)
        moved = change(self.plan, self.model, new, diff(self.model, new))
        self.frame = written(zset.consolidate(zset.union(self.frame, moved)), "view")
        self.model = new
        return self
