"""Axiom checks: the assignments that satisfy a premise and not its conclusion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortalis.lang.ast import Formula, Sequent
from sortalis.operators.formula import Compiler, Extent, FormulaError
from sortalis.sources.structure import Structure


def unmet(compiler: Compiler, premise: Extent, conclusion: Formula) -> Extent:
    """The premise's assignments without the conclusion; variables that only it has range over their carriers."""
    met = compiler.compile(conclusion)
    premise = compiler.widened(premise, met.vars)
    if met.vars:
        return Extent(premise.vars, premise.frame.join(met.frame, list(met.vars), "left_anti"))
    return Extent(premise.vars, premise.frame.join(met.frame.select(F.lit(1).alias("_met")), F.lit(True), "left_anti"))


def violations(model: Structure, sequent: Sequent) -> Extent:
    """The counterexamples of an axiom; without variables: one row if it fails."""
    compiler = Compiler(model, dict(sequent.context))
    return unmet(compiler, compiler.compile(sequent.premise), sequent.conclusion)


def new_violations(model: Structure, sequent: Sequent, new: Mapping[str, DataFrame]) -> Extent:
    """The counterexamples that touch a new element; ``new`` has an ``elem`` table for each sort that grew.

    One premise is evaluated for each variable of such a sort, with the variable cut to the new elements.
    """
    context = dict(sequent.context)
    whole = Compiler(model, context)
    used = [*whole.compile(sequent.premise).vars, *whole.compile(sequent.conclusion).vars]
    found = []
    for v in dict.fromkeys(used):
        if context[v] in new:
            compiler = Compiler(model, context, within={v: new[context[v]]})
            found.append(unmet(compiler, compiler.compile(sequent.premise), sequent.conclusion))
    if not found:
        none = unmet(whole, whole.compile(sequent.premise), sequent.conclusion)
        return Extent(none.vars, none.frame.limit(0))
    names = tuple(sorted(found[0].vars))
    return Extent(names, reduce(DataFrame.unionByName, [e.columns(names) for e in found]).distinct())


def border(extent: Extent, sorts: Mapping[str, str], new: Mapping[str, DataFrame]) -> Extent:
    """The assignments with a new element."""
    frame, flags = extent.frame, []
    for v in extent.vars:
        if (grown := new.get(sorts[v])) is not None:
            flags.append(f"_n{len(flags)}")
            frame = frame.join(grown.select(F.col("elem").alias(v), F.lit(True).alias(flags[-1])).distinct(), v, "left")
    condition = F.lit(False)
    for flag in flags:
        condition = condition | F.coalesce(F.col(flag), F.lit(False))
    return Extent(extent.vars, Extent(extent.vars, frame.where(condition)).columns(extent.vars))


def interior(extent: Extent, sorts: Mapping[str, str], new: Mapping[str, DataFrame]) -> Extent:
    """The assignments of old elements only."""
    frame = extent.frame
    for v in extent.vars:
        if (grown := new.get(sorts[v])) is not None:
            frame = frame.join(grown.select(F.col("elem").alias(v)), v, "left_anti")
    return Extent(extent.vars, Extent(extent.vars, frame).columns(extent.vars))


@dataclass
class Report:
    """Which axioms fail, with counterexamples, and which could not be compiled."""

    failed: dict[str, Extent] = field(default_factory=dict)
    skipped: dict[str, str] = field(default_factory=dict)

    def __bool__(self) -> bool:
        return not self.failed

    def examples(self, most: int = 5) -> dict[str, list[dict]]:
        return {k: [r.asDict() for r in e.frame.limit(most).collect()] for k, e in self.failed.items()}


def check_theory(model: Structure, axioms: Sequence[Sequent], new: Mapping[str, DataFrame] | None = None) -> Report:
    """Checks each axiom, in full or where new elements are touched."""
    out = Report()
    for i, a in enumerate(axioms):
        name = a.name or f"axiom {i}"
        try:
            found = violations(model, a) if new is None else new_violations(model, a, new)
        except FormulaError as e:
            out.skipped[name] = str(e)
            continue
        if not found.frame.isEmpty():
            out.failed[name] = found
    return out
