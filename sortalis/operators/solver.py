"""Search for models: a tree of partial models that tactics extend, branch on or refute, within a budget.

The tree is driven from the driver; whether a node is a model, or what it lacks, is asked of Spark.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from enum import Enum
from itertools import product

from pyspark.sql import functions as F

from sortalis.lang.ast import Conj, Disj, Exists, Falsity, Formula, Sequent
from sortalis.operators.chase import Chase, Unsatisfiable
from sortalis.operators.check import Report, check_theory, violations
from sortalis.operators.formula import Compiler, Extent, FormulaError
from sortalis.sources.structure import Structure, flat


class Status(Enum):
    OPEN = "open"
    SOLVED = "solved"
    UNSAT = "unsat"
    PRUNED = "pruned"


class Outcome(Enum):
    FOUND = "found"
    UNSAT = "unsat"
    INCOMPLETE = "incomplete"


@dataclass
class Budget:
    """Limits of a search, in seconds and steps."""

    seconds: float = 5.0
    steps: int = 10_000
    started: float = field(default_factory=time.monotonic)
    used: int = 0

    @staticmethod
    def quick() -> Budget:
        return Budget(0.1, 100)

    @staticmethod
    def medium() -> Budget:
        return Budget(1.0, 1000)

    @staticmethod
    def long() -> Budget:
        return Budget(5.0, 10_000)

    def spend(self) -> bool:
        """Takes a step; false once nothing is left."""
        self.used += 1
        return not self.exhausted

    @property
    def exhausted(self) -> bool:
        return self.used > self.steps or time.monotonic() - self.started > self.seconds


@dataclass
class Node:
    """A partial model in the tree."""

    id: int
    model: Structure
    parent: int | None = None
    label: str = "root"
    status: Status = Status.OPEN
    children: list[int] = field(default_factory=list)
    probability: float = 1.0
    reason: str = ""


class SearchTree:
    """Nodes by number; 0 is the root."""

    def __init__(self, model: Structure):
        self.nodes = [Node(0, model)]

    def branch(self, node: int, label: str, model: Structure, probability: float | None = None) -> int:
        parent = self.nodes[node]
        new = Node(len(self.nodes), model, node, label, probability=parent.probability if probability is None else probability)
        parent.children.append(new.id)
        self.nodes.append(new)
        return new.id

    def mark(self, node: int, status: Status, reason: str = "") -> None:
        self.nodes[node].status, self.nodes[node].reason = status, reason

    def frontier(self, most: int | None = None) -> list[Node]:
        """Open leaves, the most probable first."""
        leaves = [n for n in self.nodes if n.status == Status.OPEN and not n.children]
        return sorted(leaves, key=lambda n: (-n.probability, n.id))[:most]

    def path_to(self, node: int) -> list[int]:
        out = [node]
        while (parent := self.nodes[out[-1]].parent) is not None:
            out.append(parent)
        return out[::-1]

    def settled(self, node: int) -> Status:
        """A node's status, or what its children make of it: solved by one, refuted by all."""
        n = self.nodes[node]
        if n.status != Status.OPEN or not n.children:
            return n.status
        below = [self.settled(c) for c in n.children]
        if Status.SOLVED in below:
            return Status.SOLVED
        return Status.UNSAT if all(s == Status.UNSAT for s in below) else Status.OPEN

    def summary(self) -> dict[str, int]:
        return {s.value: sum(n.status == s for n in self.nodes) for s in Status}

    def detail(self, node: int) -> str:
        n = self.nodes[node]
        sizes = ", ".join(f"{s}: {n.model.carrier(s).count()}" for s in n.model.signature.sorts)
        return f"#{n.id} {n.label} [{n.status.value}] {sizes}"


def check_node(tree: SearchTree, node: int, axioms: Sequence[Sequent]) -> Report:
    """Marks a node as solved if its functions are total and its axioms hold."""
    model = tree.nodes[node].model
    report = check_theory(model, axioms)
    if report and not report.skipped and model.is_total():
        tree.mark(node, Status.SOLVED)
    return report


def _choice(f: Formula) -> Disj | None:
    """The first disjunction with several parts in a conclusion."""
    match f:
        case Disj(ps) if len(ps) > 1:
            return f
        case Conj(ps):
            return next((c for p in ps if (c := _choice(p))), None)
        case Exists(_, _, b):
            return _choice(b)
    return None


def _with(f: Formula, old: Formula, new: Formula) -> Formula:
    if f is old:
        return new
    match f:
        case Conj(ps):
            return Conj(tuple(_with(p, old, new) for p in ps))
        case Exists(v, s, b):
            return Exists(v, s, _with(b, old, new))
    return f


def propagate(tree: SearchTree, node: int, axioms: Sequence[Sequent], budget: Budget, most_rounds: int = 1000) -> None:
    """Forward chaining and merging of equal elements to a fixpoint, over the axioms that leave no choice."""
    plain = [a for a in axioms if not _choice(a.conclusion)]
    run = Chase(tree.nodes[node].model, plain, strict=True)
    try:
        for _ in range(most_rounds):
            if not budget.spend() or not run.step():
                break
    except Unsatisfiable as e:
        tree.mark(node, Status.UNSAT, str(e))
    tree.nodes[node].model = run.model


def branch_on_choice(tree: SearchTree, node: int, axioms: Sequence[Sequent]) -> list[int]:
    """A child for each way to meet one violated disjunctive axiom at one of its counterexamples."""
    model = tree.nodes[node].model
    for a in axioms:
        choice = _choice(a.conclusion)
        if choice is None:
            continue
        found = violations(model, a)
        keys = list(found.vars) or found.frame.columns
        first = found.frame.orderBy(*keys).limit(1).checkpoint()
        if first.isEmpty():
            continue
        made = []
        for k, part in enumerate(choice.parts):
            run = Chase(model, [])
            try:
                run._fire(Compiler(run.model, dict(a.context)), Extent(found.vars, first), _with(a.conclusion, choice, part))
            except FormulaError:
                continue
            run._merge()
            made.append(tree.branch(node, f"{a.name}: part {k}", run.model))
        if made:
            return made
    return []


def branch_on_value(tree: SearchTree, node: int) -> list[int]:
    """A child for each value that the first undefined argument of a function may take.

    Each column of the value is an element there is or a fresh one.  A fresh element stands for any that a larger
    model may have, so if all children are refuted, so is the node.  Those with fewer fresh ones come first.
    """
    model = tree.nodes[node].model
    for name, symbol in model.signature.functions.items():
        at = model.undefined(name).orderBy(*symbol.arguments).limit(1).collect()
        if not at:
            continue
        choices = []
        for _, sort in flat(symbol.codomain):
            have = [r.elem for r in model.carrier(sort).orderBy("elem").toLocalIterator()]
            choices.append([*((sort, e) for e in have), (sort, None)])
        made = []
        for value in sorted(product(*choices), key=lambda v: sum(e is None for _, e in v)):
            child, row, names = model.copy(), list(at[0]), []
            for sort, e in value:
                if e is None:
                    top = child.carrier(sort).agg(F.max("elem")).first()[0]
                    e = 0 if top is None else top + 1
                    child.add(sort, [e])
                    names.append("new")
                else:
                    names.append(str(e))
                row.append(e)
            made.append(tree.branch(node, f"{name}{tuple(at[0])} = {', '.join(names)}", child.define(name, [tuple(row)])))
        return made
    return []


@dataclass
class Result:
    outcome: Outcome
    model: Structure | None
    tree: SearchTree
    steps: int


def enumerate_models(base: Structure, axioms: Sequence[Sequent], budget: Budget | None = None) -> Result:
    """Depth-first search from a base model, until a model is found, all is refuted or the budget ends."""
    budget = budget or Budget.long()
    tree = SearchTree(base.copy())
    if any(isinstance(a.conclusion, Falsity) and not violations(base, a).frame.isEmpty() for a in axioms):
        tree.mark(0, Status.UNSAT, "falsity follows")
        return Result(Outcome.UNSAT, None, tree, budget.used)
    stack = [0]
    while stack:
        if not budget.spend():
            return Result(Outcome.INCOMPLETE, None, tree, budget.used)
        node = stack.pop()
        propagate(tree, node, axioms, budget)
        if tree.nodes[node].status == Status.UNSAT:
            continue
        check_node(tree, node, axioms)
        if tree.nodes[node].status == Status.SOLVED:
            return Result(Outcome.FOUND, tree.nodes[node].model, tree, budget.used)
        children = branch_on_choice(tree, node, axioms) or branch_on_value(tree, node)
        if not children and not budget.exhausted:
            tree.mark(node, Status.PRUNED, "nothing applies")
        stack += reversed(children)
    refuted = tree.settled(0) == Status.UNSAT
    return Result(Outcome.UNSAT if refuted else Outcome.INCOMPLETE, None, tree, budget.used)


def solve(empty: Structure, axioms: Sequence[Sequent], budget: Budget | None = None) -> Result:
    """A model from nothing."""
    return enumerate_models(empty, axioms, budget)


def extend(base: Structure, axioms: Sequence[Sequent], budget: Budget | None = None) -> Result:
    """A model that extends a given one."""
    return enumerate_models(base, axioms, budget)
