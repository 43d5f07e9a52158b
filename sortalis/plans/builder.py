"""Fluent builders of plans: ``Pattern`` over one sort, ``Query`` over several."""

from __future__ import annotations

from dataclasses import dataclass, field

from sortalis.functions.predicates import ColEqCol, ColEqConst, FuncEqConst
from sortalis.plans.ops import Apply, Filter, Join, Plan, Project, Scan


@dataclass(frozen=True)
class Pattern:
    """The elements of a sort with given function values, and what to show of each."""

    sort: str
    constraints: tuple[tuple[str, int], ...] = ()
    shown: tuple[str, ...] | None = None

    def filter(self, func: str, value: int) -> Pattern:
        return Pattern(self.sort, (*self.constraints, (func, value)), self.shown)

    def project(self, func: str) -> Pattern:
        return Pattern(self.sort, self.constraints, (func,))

    def project_tuple(self, funcs: list[str]) -> Pattern:
        """A tuple is dropped unless all of its functions are defined."""
        return Pattern(self.sort, self.constraints, tuple(funcs))

    def compile(self) -> Plan:
        plan: Plan = Scan(self.sort)
        for func, value in self.constraints:
            plan = Filter(plan, FuncEqConst(func, 0, value))
        if self.shown is None:
            return plan
        for func in self.shown:
            plan = Apply(plan, func, 0)
        return Project(plan, tuple(range(1, len(self.shown) + 1)))


@dataclass
class Query:
    """Several scans, joined and filtered by function values.

    Columns are the scans in order, then one helper column for each function that a condition applied.
    """

    sorts: list[str] = field(default_factory=list)
    equal: list[tuple[str, int, str, int]] = field(default_factory=list)
    columns: list[tuple[int, int]] = field(default_factory=list)
    constants: list[tuple[str, int, int]] = field(default_factory=list)
    elements: list[tuple[int, int]] = field(default_factory=list)
    shown: list[tuple[int, str | None]] | None = None

    @staticmethod
    def scan(sort: str) -> Query:
        return Query([sort])

    def join_scan(self, sort: str) -> Query:
        self.sorts.append(sort)
        return self

    def join_on_func(self, left_func: str, left: int, right_func: str, right: int) -> Query:
        """f(column) = g(column)."""
        self.equal.append((left_func, left, right_func, right))
        return self

    def where_eq(self, left: int, right: int) -> Query:
        self.columns.append((left, right))
        return self

    def where_const(self, func: str, col: int, value: int) -> Query:
        self.constants.append((func, col, value))
        return self

    def where_element(self, col: int, value: int) -> Query:
        self.elements.append((col, value))
        return self

    def project(self, columns: list[int]) -> Query:
        self.shown = [(c, None) for c in columns]
        return self

    def project_funcs(self, shown: list[tuple[int, str | None]]) -> Query:
        """(column, function) pairs; without a function the element itself is shown."""
        self.shown = list(shown)
        return self

    def compile(self) -> Plan:
        plan: Plan = Scan(self.sorts[0])
        for sort in self.sorts[1:]:
            plan = Join(plan, Scan(sort))
        width = len(self.sorts)
        for f, a, g, b in self.equal:
            plan = Filter(Apply(Apply(plan, f, a), g, b), ColEqCol(width, width + 1))
            width += 2
        for a, b in self.columns:
            plan = Filter(plan, ColEqCol(a, b))
        for f, a, v in self.constants:
            plan = Filter(plan, FuncEqConst(f, a, v))
        for a, v in self.elements:
            plan = Filter(plan, ColEqConst(a, v))
        if self.shown is None:
            return plan
        keep = []
        for col, func in self.shown:
            if func is None:
                keep.append(col)
            else:
                plan = Apply(plan, func, col)
                keep.append(width)
                width += 1
        return Project(plan, tuple(keep))


def simple_filter(sort: str, func: str, value: int) -> Plan:
    """The elements at which a function has a value."""
    return Pattern(sort).filter(func, value).compile()


def filter_project(sort: str, func: str, value: int, shown: str) -> Plan:
    """The same, showing another function's value of each."""
    return Pattern(sort).filter(func, value).project(shown).compile()
