"""Predicates over the columns of a tuple."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Or(self, other)


@dataclass(frozen=True)
class Always(Predicate):
    def __str__(self) -> str:
        return "⊤"


@dataclass(frozen=True)
class Never(Predicate):
    def __str__(self) -> str:
        return "⊥"


@dataclass(frozen=True)
class ColEqConst(Predicate):
    col: int
    val: int

    def __str__(self) -> str:
        return f"#{self.col} = {self.val}"


@dataclass(frozen=True)
class ColEqCol(Predicate):
    left: int
    right: int

    def __str__(self) -> str:
        return f"#{self.left} = #{self.right}"


@dataclass(frozen=True)
class FuncEq(Predicate):
    """The function is defined at a column and has another column's value."""

    func: str
    arg_col: int
    result_col: int

    def __str__(self) -> str:
        return f"{self.func}(#{self.arg_col}) = #{self.result_col}"


@dataclass(frozen=True)
class FuncEqConst(Predicate):
    """The function is defined at a column and has this value."""

    func: str
    arg_col: int
    expected: int

    def __str__(self) -> str:
        return f"{self.func}(#{self.arg_col}) = {self.expected}"


@dataclass(frozen=True)
class And(Predicate):
    left: Predicate
    right: Predicate

    def __str__(self) -> str:
        return f"({self.left} ∧ {self.right})"


@dataclass(frozen=True)
class Or(Predicate):
    left: Predicate
    right: Predicate

    def __str__(self) -> str:
        return f"({self.left} ∨ {self.right})"


def columns_of(p: Predicate) -> set[int]:
    """The columns that a predicate looks at."""
    match p:
        case ColEqConst(c, _):
            return {c}
        case ColEqCol(a, b):
            return {a, b}
        case FuncEq(_, a, b):
            return {a, b}
        case FuncEqConst(_, a, _):
            return {a}
        case And(a, b) | Or(a, b):
            return columns_of(a) | columns_of(b)
    return set()


def renumbered(p: Predicate, column: Callable[[int], int]) -> Predicate:
    """The predicate over other column numbers."""
    match p:
        case ColEqConst(c, v):
            return ColEqConst(column(c), v)
        case ColEqCol(a, b):
            return ColEqCol(column(a), column(b))
        case FuncEq(f, a, b):
            return FuncEq(f, column(a), column(b))
        case FuncEqConst(f, a, v):
            return FuncEqConst(f, column(a), v)
        case And(a, b):
            return And(renumbered(a, column), renumbered(b, column))
        case Or(a, b):
            return Or(renumbered(a, column), renumbered(b, column))
    return p


def conjuncts(p: Predicate) -> list[Predicate]:
    return conjuncts(p.left) + conjuncts(p.right) if isinstance(p, And) else [p]


def function_terms(p: Predicate) -> set[tuple[str, int]]:
    """(function, argument column) of each function that a predicate applies."""
    match p:
        case FuncEq(f, a, _) | FuncEqConst(f, a, _):
            return {(f, a)}
        case And(a, b) | Or(a, b):
            return function_terms(a) | function_terms(b)
    return set()
