"""Extents of positive formulas: the assignments of their free variables, as one lazy DataFrame.

An atom becomes one table with a column per variable; terms become further atoms with variables of their
own, which go when the atom is done.  Conjunction is a natural join, disjunction a union after the missing
variables are filled with their carriers, and an existential drops a column.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortalis.lang.ast import App, Conj, Disj, Eq, Exists, Falsity, Formula, Proj, Record, Rel, Term, Truth, Var
from sortalis.sources.structure import Product, Structure, Type, flat

UNIT = "_unit"
#: Rows of either side in a cell of a join of many with many; a merge join holds 4096 rows of a key before it spills.
CELL = 2048


class FormulaError(ValueError):
    """A formula that its signature gives no meaning."""


@dataclass
class Extent:
    """Distinct assignments; without variables: a row if true, none if false."""

    vars: tuple[str, ...]
    frame: DataFrame
    always: bool = False  # no variables, and known to be true

    def columns(self, names) -> DataFrame:
        names = list(names)
        return self.frame.select(*names) if names else self.frame.select(F.lit(0).alias(UNIT))

    def narrowed(self, names) -> Extent:
        """The assignments of some of the variables."""
        wanted = set(names)
        names = tuple(n for n in self.vars if n in wanted)
        return self if names == self.vars else Extent(names, self.columns(names).distinct())


class Compiler:
    """Compiles formulas over a model.

    ``instead`` gives tables for single atoms, by identity; ``within`` gives, for a variable, the elements that it
    may have, to which each atom that it occurs in is cut at once.
    """

    def __init__(self, model: Structure, context: Mapping[str, str], instead: Mapping[int, DataFrame] | None = None, within: Mapping[str, DataFrame] | None = None):
        self.model, self.context, self.instead, self.within = model, dict(context), dict(instead or {}), dict(within or {})
        self._names = count()

    def truth(self, value: bool) -> Extent:
        one = self.model.spark.range(1 if value else 0)
        return Extent((), one.select(F.lit(0).alias(UNIT)), value)

    def sort_of(self, term: Term) -> Type:
        """The type of a term."""
        sig = self.model.signature
        match term:
            case Var(n):
                if n not in self.context:
                    raise FormulaError(f"unknown variable {n}")
                return self.context[n]
            case App(f, _):
                if f not in sig.functions:
                    raise FormulaError(f"unknown function {f}")
                return sig.functions[f].codomain
            case Record(fs):
                return Product(tuple((n, self.sort_of(t)) for n, t in fs))
            case Proj(t, name):
                kind = self.sort_of(t)
                if not isinstance(kind, Product) or name not in kind.names:
                    raise FormulaError(f"no field {name}")
                return dict(kind.fields)[name]

    def aligned(self, term: Term, kind: Type) -> Term:
        """A record with its fields in the order of a type: by name where the names are the type's, else by position."""
        if not isinstance(term, Record) or not isinstance(kind, Product):
            if isinstance(kind, Product) and kind.arity == 1 and isinstance(term, (Var, App, Proj)) and not isinstance(self.sort_of(term), Product):
                return Record(((kind.names[0], term),))
            return term
        given = dict(term.fields)
        if len(given) != len(term.fields) or len(given) != kind.arity:
            raise FormulaError("fields that do not match")
        if set(given) == set(kind.names):
            return Record(tuple((n, given[n]) for n in kind.names))
        return Record(tuple((n, t) for n, (_, t) in zip(kind.names, term.fields, strict=True)))

    def _flatten(self, term: Term, atoms: list[tuple[DataFrame, list[str]]]) -> list[str]:
        """The variables that hold a term's value; atoms that define them are added."""
        match term:
            case Var(n):
                self.sort_of(term)
                return [n]
            case Record(fs):
                return [v for _, t in fs for v in self._flatten(t, atoms)]
            case Proj(t, name):
                kind = self.sort_of(t)
                self.sort_of(term)
                return [self._flatten(t, atoms)[kind.names.index(name)]]
            case App(f, a):
                self.sort_of(term)
                symbol = self.model.signature.functions[f]
                arguments = self._flatten(self.aligned(a, symbol.domain), atoms)
                if len(arguments) != len(flat(symbol.domain)):
                    raise FormulaError(f"{f} takes {len(flat(symbol.domain))} values")
                results = [f"_{next(self._names)}" for _ in flat(symbol.codomain)]
                atoms.append((self.model.function_inside(f), arguments + results))
                return results

    def _joined(self, atoms: list[tuple[DataFrame, list[str]]]) -> Extent:
        out = None
        for frame, names in atoms:
            own = frame.toDF(*[f"_c{i}" for i in range(len(names))])
            first: dict[str, int] = {}
            for i, n in enumerate(names):
                if n in first:
                    own = own.where(F.col(f"_c{i}") == F.col(f"_c{first[n]}"))
                else:
                    first[n] = i
            own = own.select(*[F.col(f"_c{i}").alias(n) for n, i in first.items()])
            if len(first) < len(names):
                own = own.distinct()
            for n in first:
                if n in self.within:
                    own = own.join(self.within[n].select(F.col("elem").alias(n)), n, "left_semi")
            own = Extent(tuple(first), own)
            out = own if out is None else self.both(out, own)
        return self.truth(True) if out is None else out

    def both(self, a: Extent, b: Extent) -> Extent:
        """The natural join of two extents."""
        if a.always or b.always:
            return b if a.always else a
        if not a.vars and not b.vars:
            return Extent((), a.frame.join(b.frame, UNIT))
        shared = [v for v in a.vars if v in b.vars]
        names = a.vars + tuple(v for v in b.vars if v not in a.vars)
        joined = a.frame.join(b.frame, shared) if shared else a.frame.crossJoin(b.frame)
        return Extent(names, joined.select(*names))

    def met(self, a: Extent, b: Extent) -> Extent:
        """The natural join of two extents of which many rows may share a value, as a grid of cells.

        A value with n rows here and m there becomes n/CELL by m/CELL cells, dealt to tasks one by one, so that neither
        one value nor few of them, nor a small table that lies in one file, leave the pairs to few tasks.  A row is copied
        once for each cell of the other side: two copies for CELL pairs.
        """
        shared = [v for v in a.vars if v in b.vars]
        names = a.vars + tuple(v for v in b.vars if v not in a.vars)
        cells = lambda e, n: e.frame.groupBy(*shared).agg(F.ceil(F.count("*") / CELL).alias(n))
        grid = cells(a, "_rows").join(cells(b, "_cols"), shared)
        own = lambda e, n: F.pmod(F.xxhash64(*e.vars), F.col(n))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = a.frame.join(grid, shared).select(*a.vars, own(a, "_rows").alias("_i"), each("_cols").alias("_j"))
        right = b.frame.join(grid, shared).select(*b.vars, each("_rows").alias("_i"), own(b, "_cols").alias("_j"))
        keys, spark = [*shared, "_i", "_j"], self.model.spark
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        return Extent(names, left.repartition(parts, *keys).join(right.hint("merge"), keys).select(*names))

    def domain(self, names) -> Extent:
        """All assignments of variables."""
        parts = [Extent((n,), self.within.get(n, self.model.carrier(self.context[n])).select(F.col("elem").alias(n))) for n in names]
        return reduce(self.both, parts) if parts else self.truth(True)

    def widened(self, e: Extent, names) -> Extent:
        """An extent with further variables, which may have any value."""
        missing = [n for n in names if n not in e.vars]
        return self.both(e, self.domain(missing)) if missing else e

    def compile(self, f: Formula) -> Extent:
        match f:
            case Truth():
                return self.truth(True)
            case Falsity():
                return self.truth(False)
            case Rel(name, t):
                symbol = self.model.signature.relations.get(name)
                if symbol is None:
                    raise FormulaError(f"unknown relation {name}")
                atoms: list[tuple[DataFrame, list[str]]] = []
                arguments = self._flatten(self.aligned(t, symbol.domain), atoms)
                if len(arguments) != symbol.domain.arity:
                    raise FormulaError(f"{name} takes {symbol.domain.arity} values")
                table = self.instead[id(f)] if id(f) in self.instead else self.model.relation_inside(name)
                return self._shown(self._joined([(table, arguments), *atoms]))
            case Eq(a, b):
                return self._equal(a, b)
            case Conj(ps):
                return reduce(self.both, map(self.compile, ps)) if ps else self.truth(True)
            case Disj(ps):
                parts = [self.compile(p) for p in ps]
                names = tuple(dict.fromkeys(v for p in parts for v in p.vars))
                frames = [self.widened(p, names).columns(names) for p in parts]
                return Extent(names, reduce(DataFrame.unionByName, frames).distinct()) if frames else self.truth(False)
            case Exists(v, sort, body):
                inner = Compiler(self.model, {**self.context, v: sort}, self.instead, {k: t for k, t in self.within.items() if k != v})
                inner._names = self._names
                e = inner.compile(body)
                if v in e.vars:
                    return e.narrowed(set(e.vars) - {v})
                some = self.model.carrier(sort).limit(1).select(F.lit(0).alias(UNIT))
                return self.both(e, Extent((), some))
        raise FormulaError(f"no such formula: {f}")

    def _shown(self, e: Extent) -> Extent:
        """An extent without the variables of terms.  Functions fix these, so that no assignment comes twice."""
        names = tuple(v for v in e.vars if not v.startswith("_"))
        return Extent(names, e.columns(names)) if names and self.model.functional else e.narrowed(names)

    def _equal(self, a: Term, b: Term) -> Extent:
        if isinstance(a, Record) and not isinstance(b, Record):
            a = self.aligned(a, self.sort_of(b))
        elif isinstance(b, Record):
            b = self.aligned(b, self.sort_of(a))
        if a == b and isinstance(a, Var):
            return self.truth(True)
        atoms: list[tuple[DataFrame, list[str]]] = []
        left = self._flatten(a, atoms)
        n = len(atoms)
        right = self._flatten(b, atoms)
        if len(left) != len(right):
            raise FormulaError("an equation of values of different widths")
        for x, y in zip(left, right, strict=True):
            if x == y:
                continue
            if x.startswith("_") or y.startswith("_"):
                old, new = (x, y) if x.startswith("_") else (y, x)
                atoms = [(t, [new if n == old else n for n in names]) for t, names in atoms]
                left, right = ([new if n == old else n for n in side] for side in (left, right))
            else:
                carrier = self.within.get(x, self.model.carrier(self.context[x]))
                atoms.append((carrier.select(F.col("elem").alias("l"), F.col("elem").alias("r")), [x, y]))
        here, there = ({v for _, names in part for v in names} for part in (atoms[:n], atoms[n:]))
        if here & there and all(v.startswith("_") for v in here & there):
            return self._shown(self.met(self._joined(atoms[:n]), self._joined(atoms[n:])))
        return self._shown(self._joined(atoms))

    def values(self, bindings: Extent, term: Term) -> tuple[Extent, list[str]]:
        """The bindings at which a term is defined, with the columns that hold its value."""
        atoms: list[tuple[DataFrame, list[str]]] = []
        columns = self._flatten(term, atoms)
        missing = [c for c in columns if not c.startswith("_") and c not in bindings.vars]
        return self.both(self.widened(bindings, missing), self._joined(atoms)), columns


def extent(model: Structure, formula: Formula, context: Mapping[str, str]) -> Extent:
    """The assignments that satisfy a formula."""
    return Compiler(model, context).compile(formula)
