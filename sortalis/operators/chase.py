"""The chase: derives facts from axioms to a fixpoint.

Axioms fire in order, each seeing what the ones before it did.  Horn axioms over relations are evaluated
semi-naively: after the first round a premise is joined only through tuples that are new since the axiom last
fired.  An existential conclusion without a witness makes fresh elements, numbered through partitions
rather than in one task; an equality merges elements, through connected components, and closes under the
functions.  Tables that a round changes are checkpointed, which bounds the lineage.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortalis.lang.ast import App, Conj, Disj, Eq, Exists, Falsity, Formula, Rel, Sequent, Truth, Var
from sortalis.operators.check import unmet
from sortalis.operators.components import connected_components
from sortalis.operators.formula import UNIT, Compiler, Extent, FormulaError
from sortalis.sources.shared import shared_folder
from sortalis.sources.structure import Structure, flat


class MaxIterationsExceeded(RuntimeError):
    """The chase did not end within its rounds."""


class Unsatisfiable(RuntimeError):
    """An axiom concludes falsity from what holds."""


def numbered(frame: DataFrame, offset: int, name: str) -> DataFrame:
    """Adds the numbers offset, offset + 1, ... in the order of the columns, partition by partition."""
    keys = [c for c in frame.columns]
    ordered = frame.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id()).checkpoint()
    sizes = sorted((r["_p"], r["n"]) for r in ordered.groupBy("_p").agg(F.count("*").alias("n")).collect())
    starts, at = [], offset
    for p, n in sizes:
        starts.append((p, at))
        at += n
    bases = frame.sparkSession.createDataFrame(starts, "_p int, _start long")
    inside = ordered.withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return inside.join(F.broadcast(bases), "_p").select(*keys, (F.col("_start") + F.col("_i")).alias(name))


@dataclass
class Chase:
    """A model that grows, and what is known of its growth."""

    model: Structure
    axioms: Sequence[Sequent]
    strict: bool = False  # raise Unsatisfiable where falsity follows, instead of leaving the axiom aside
    skipped: dict[str, str] = field(default_factory=dict)
    iterations: int = 0

    def __post_init__(self) -> None:
        shared_folder(self.model.spark)
        self.model = self.model.copy()
        self._equations: list[tuple[str, DataFrame]] = []
        self._fresh: dict[str, list[DataFrame]] = {}  # tuples of a relation, as they were added
        self._seen: dict[int, dict[str, int]] = {}

    def run(self, max_iterations: int = 100) -> Structure:
        """Rounds until one changes nothing; that one counts too."""
        for self.iterations in range(1, max_iterations + 1):
            if not self.step():
                return self.model
        raise MaxIterationsExceeded(f"no fixpoint within {max_iterations} rounds")

    def step(self) -> bool:
        """Fires each axiom once, then merges what was found equal; tells whether anything changed."""
        changed = False
        for i, axiom in enumerate(self.axioms):
            try:
                changed |= self._fire_axiom(i, axiom)
            except FormulaError as e:
                self.skipped[axiom.name or f"axiom {i}"] = str(e)
        return self._merge() or changed

    # -- one axiom

    def _fire_axiom(self, i: int, axiom: Sequent) -> bool:
        context = dict(axiom.context)
        atoms = _horn(axiom)
        seen = self._seen.get(i)
        self._seen[i] = {r: len(v) for r, v in self._fresh.items()}
        parts = [Compiler(self.model, context)]
        if atoms is not None and seen is not None:
            parts = []
            for atom in atoms:
                new = self._fresh.get(atom.relation, [])[seen.get(atom.relation, 0) : self._seen[i].get(atom.relation, 0)]
                if new:
                    parts.append(Compiler(self.model, context, {id(atom): _union(new)}))
        if not parts:
            return False
        if atoms is not None:
            return self._add(axiom.conclusion.relation, [self._rows(c, c.compile(axiom.premise), axiom.conclusion) for c in parts])
        found = [unmet(c, c.compile(axiom.premise), axiom.conclusion) for c in parts]
        frame = _union([e.columns(found[0].vars) for e in found])
        bindings = Extent(found[0].vars, (frame.distinct() if len(found) > 1 else frame).checkpoint())
        if bindings.frame.isEmpty():
            return False
        return self._fire(Compiler(self.model, context), bindings, axiom.conclusion)

    def _fire(self, compiler: Compiler, bindings: Extent, f: Formula) -> bool:
        match f:
            case Truth():
                return False
            case Falsity():
                if self.strict:
                    raise Unsatisfiable("falsity follows")
                raise FormulaError("concludes falsity")
            case Conj(ps) | Disj(ps):
                return any([self._fire(compiler, bindings, p) for p in ps])
            case Rel():
                return self._insert(compiler, bindings, f)
            case Eq(a, b):
                return self._equate(compiler, bindings, a, b)
            case Exists():
                return self._witness(compiler, bindings, f)
        raise FormulaError(f"no such conclusion: {f}")

    def _rows(self, compiler: Compiler, bindings: Extent, f: Rel) -> DataFrame:
        """The tuples that a relation atom is made true of."""
        symbol = self.model.signature.relations[f.relation]
        at, names = compiler.values(bindings, compiler.aligned(f.argument, symbol.domain))
        return at.frame.select(*[F.col(n).alias(c) for n, c in zip(names, symbol.columns, strict=True)])

    def _insert(self, compiler: Compiler, bindings: Extent, f: Rel) -> bool:
        return self._add(f.relation, [self._rows(compiler, bindings, f)])

    def _add(self, relation: str, frames: list[DataFrame]) -> bool:
        """Adds what is new of some tuples: one job.  The relation stays a union of checkpointed parts, merged now and then."""
        old = self.model.relation(relation)
        new = _union(frames).distinct().join(old, old.columns, "left_anti").checkpoint()
        if new.isEmpty():
            return False
        parts = self._fresh.setdefault(relation, [])
        parts.append(new)
        grown = old.unionByName(new)
        self.model.relations[relation] = grown.checkpoint() if len(parts) % 8 == 0 else grown
        return True

    def _equate(self, compiler: Compiler, bindings: Extent, a, b) -> bool:
        if not isinstance(a, App) and isinstance(b, App):
            a, b = b, a
        if not isinstance(a, App):
            if not (isinstance(a, Var) and isinstance(b, Var)):
                raise FormulaError("an equation that defines nothing")
            pairs = bindings.frame.select(F.col(a.name).alias("a"), F.col(b.name).alias("b")).where("a <> b").distinct()
            return self._note(compiler.context[a.name], pairs)
        symbol = self.model.signature.functions[a.func]
        target = compiler.aligned(b, symbol.codomain)
        at, results = compiler.values(bindings, target)
        at, arguments = compiler.values(at, compiler.aligned(a.argument, symbol.domain))
        wanted = at.frame.select(*[F.col(n).alias(c) for n, c in zip([*arguments, *results], symbol.columns, strict=True)]).distinct()
        return self._define(a.func, wanted)

    def _define(self, name: str, wanted: DataFrame) -> bool:
        """Adds function values; a second value at the same argument becomes an equation of the two."""
        symbol = self.model.signature.functions[name]
        old = self.model.function(name)
        one = wanted.groupBy(*symbol.arguments).agg(F.min(F.struct(*symbol.results)).alias("_r"))
        new = one.join(old, symbol.arguments, "left_anti").select(*symbol.arguments, *[F.col(f"_r.{r}").alias(r) for r in symbol.results]).checkpoint()
        grown = not new.isEmpty()
        if grown:
            self.model.functions[name] = old.unionByName(new).checkpoint()
        return self._clashes(name, wanted) or grown

    def _clashes(self, name: str, wanted: DataFrame) -> bool:
        symbol = self.model.signature.functions[name]
        have = self.model.function(name).select(*symbol.arguments, *[F.col(r).alias(f"_{r}") for r in symbol.results])
        both = wanted.join(have, symbol.arguments)
        noted = [self._note(sort, both.select(F.col(r).alias("a"), F.col(f"_{r}").alias("b")).where("a <> b").distinct()) for r, (_, sort) in zip(symbol.results, flat(symbol.codomain), strict=True)]
        return any(noted)

    def _note(self, sort: str, pairs: DataFrame) -> bool:
        pairs = pairs.checkpoint()
        if pairs.isEmpty():
            return False
        self._equations.append((sort, pairs))
        return True

    def _witness(self, compiler: Compiler, bindings: Extent, f: Exists) -> bool:
        """Bindings that still lack a witness get a fresh element each, of which the body is made true."""
        lacking = unmet(compiler, bindings, f)
        carrier = self.model.carrier(f.sort)
        top = carrier.agg(F.max("elem")).first()[0]
        offset = 0 if top is None else top + 1
        base = lacking.frame if lacking.vars else lacking.frame.select(F.lit(0).cast("long").alias(UNIT))
        made = numbered(base, offset, f.var).checkpoint()
        if made.isEmpty():
            return False
        self.model.carriers[f.sort] = carrier.unionByName(made.select(F.col(f.var).alias("elem"))).checkpoint()
        inner = Compiler(self.model, {**compiler.context, f.var: f.sort})
        names = (*lacking.vars, f.var)
        self._fire(inner, Extent(names, made.select(*names)), f.body)
        return True

    # -- equations

    def _merge(self) -> bool:
        """Replaces equal elements by the least of them everywhere, until functions have one value at each argument."""
        merged = False
        while self._equations:
            merged = True
            by_sort: dict[str, list[DataFrame]] = {}
            for sort, pairs in self._equations:
                by_sort.setdefault(sort, []).append(pairs)
            self._equations = []
            for sort, pairs in by_sort.items():
                self._replace(sort, connected_components(_union(pairs)).checkpoint())
            for name, symbol in self.model.signature.functions.items():
                if name not in self.model.functions or not by_sort.keys() & {s for _, s in [*flat(symbol.domain), *flat(symbol.codomain)]}:
                    continue
                all_values = self.model.functions[name]
                one = all_values.groupBy(*symbol.arguments).agg(F.min(F.struct(*symbol.results)).alias("_r"))
                self.model.functions[name] = one.select(*symbol.arguments, *[F.col(f"_r.{r}").alias(r) for r in symbol.results]).checkpoint()
                self._clashes(name, all_values)
        if merged:  # tuples have changed: no axiom may rely on what was new
            self._fresh, self._seen = {}, {}
        return merged

    def _replace(self, sort: str, roots: DataFrame) -> None:
        gone = roots.where("node <> root")
        m = self.model
        m.carriers[sort] = m.carrier(sort).join(gone.select(F.col("node").alias("elem")), "elem", "left_anti").checkpoint()

        def canonical(frame: DataFrame, kinds: list[tuple[str, str]]) -> DataFrame:
            for column, kind in kinds:
                if kind == sort:
                    to = gone.select(F.col("node").alias(column), F.col("root").alias("_root"))
                    frame = frame.join(to, column, "left").withColumn(column, F.coalesce("_root", column)).drop("_root")
            return frame.select(*[c for c, _ in kinds]).distinct().checkpoint()

        for name, symbol in m.signature.relations.items():
            if name in m.relations and sort in symbol.domain.sorts:
                m.relations[name] = canonical(m.relations[name], list(zip(symbol.columns, symbol.domain.sorts, strict=True)))
        for name, symbol in m.signature.functions.items():
            kinds = [s for _, s in [*flat(symbol.domain), *flat(symbol.codomain)]]
            if name in m.functions and sort in kinds:
                m.functions[name] = canonical(m.functions[name], list(zip(symbol.columns, kinds, strict=True)))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _horn(axiom: Sequent) -> list[Rel] | None:
    """The premise's atoms if it is a conjunction of relation atoms over variables, else None."""
    parts = axiom.premise.parts if isinstance(axiom.premise, Conj) else (axiom.premise,)
    if not isinstance(axiom.conclusion, Rel) or not parts:
        return None
    plain = lambda t: isinstance(t, Var) or (hasattr(t, "fields") and all(isinstance(x, Var) for _, x in t.fields))
    used = set()
    for p in parts:
        if not isinstance(p, Rel) or not plain(p.argument):
            return None
        used |= {p.argument.name} if isinstance(p.argument, Var) else {x.name for _, x in p.argument.fields}
    goal = axiom.conclusion.argument
    inside = {goal.name} if isinstance(goal, Var) else {x.name for _, x in goal.fields} if plain(goal) else {""}
    return list(parts) if plain(goal) and inside <= used else None


def chase(model: Structure, axioms: Sequence[Sequent], max_iterations: int = 100) -> tuple[Structure, int]:
    """The model at the fixpoint of its axioms, and how many rounds that took."""
    run = Chase(model, axioms)
    return run.run(max_iterations), run.iterations
