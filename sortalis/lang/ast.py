"""Terms, positive formulas and sequents over a signature."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class App:
    """f(argument); a record argument fills a product domain."""

    func: str
    argument: Term


@dataclass(frozen=True)
class Record:
    fields: tuple[tuple[str, Term], ...]


@dataclass(frozen=True)
class Proj:
    """One field of a record-valued term."""

    term: Term
    field: str


Term = Var | App | Record | Proj


@dataclass(frozen=True)
class Truth:
    pass


@dataclass(frozen=True)
class Falsity:
    pass


@dataclass(frozen=True)
class Rel:
    relation: str
    argument: Term


@dataclass(frozen=True)
class Eq:
    left: Term
    right: Term


@dataclass(frozen=True)
class Conj:
    parts: tuple[Formula, ...]


@dataclass(frozen=True)
class Disj:
    parts: tuple[Formula, ...]


@dataclass(frozen=True)
class Exists:
    var: str
    sort: str
    body: Formula


Formula = Truth | Falsity | Rel | Eq | Conj | Disj | Exists


@dataclass(frozen=True)
class Sequent:
    """For all variables of the context: where the premise holds, so does the conclusion."""

    context: tuple[tuple[str, str], ...]
    premise: Formula
    conclusion: Formula
    name: str = ""


def term_vars(t: Term) -> set[str]:
    match t:
        case Var(n):
            return {n}
        case App(_, a) | Proj(a, _):
            return term_vars(a)
        case Record(fs):
            return set().union(*(term_vars(x) for _, x in fs)) if fs else set()


def free_vars(f: Formula) -> set[str]:
    match f:
        case Rel(_, t):
            return term_vars(t)
        case Eq(a, b):
            return term_vars(a) | term_vars(b)
        case Conj(ps) | Disj(ps):
            return set().union(*map(free_vars, ps)) if ps else set()
        case Exists(v, _, b):
            return free_vars(b) - {v}
    return set()


def record(*terms: Term, **named: Term) -> Record:
    """A record by position ("0", "1", ...) and by name."""
    return Record((*((str(i), t) for i, t in enumerate(terms)), *named.items()))
