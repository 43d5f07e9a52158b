"""Theories and formulas as text that parses to the same."""

from __future__ import annotations

from sortalis.lang.ast import App, Conj, Disj, Eq, Exists, Falsity, Formula, Proj, Record, Rel, Sequent, Term, Truth, Var
from sortalis.sources.structure import Product, Type


def show_type(t: Type) -> str:
    return "[" + ", ".join(f"{n}: {s}" for n, s in t.fields) + "]" if isinstance(t, Product) else t


def show_term(t: Term) -> str:
    match t:
        case Var(n):
            return n
        case App(f, a):
            return f"{show_term(a)} {f}"
        case Proj(a, n):
            return f"{show_term(a)} .{n}"
        case Record(fs):
            return "[" + ", ".join(f"{n}: {show_term(x)}" for n, x in fs) + "]"


def show_formula(f: Formula) -> str:
    match f:
        case Truth():
            return "true"
        case Falsity():
            return "false"
        case Rel(r, t):
            return f"{show_term(t)} {r}"
        case Eq(a, b):
            return f"{show_term(a)} = {show_term(b)}"
        case Conj(ps):
            return "(" + " /\\ ".join(map(show_formula, ps)) + ")" if len(ps) > 1 else show_formula(ps[0])
        case Disj(ps):
            return "(" + " \\/ ".join(map(show_formula, ps)) + ")" if len(ps) > 1 else show_formula(ps[0])
        case Exists(v, s, b):
            return f"(exists {v} : {s}. {show_formula(b)})"


def show_sequent(s: Sequent) -> str:
    head = ", ".join(f"{n} : {sort}" for n, sort in s.context)
    return f"{s.name} : forall {head}. {show_formula(s.premise)} |- {show_formula(s.conclusion)};"


def show_theory(theory) -> str:
    """A theory without parameters, as text."""
    lines = [f"{s} : Sort;" for s in theory.signature.sorts]
    lines += [f"{f.name} : {show_type(f.domain)} -> {show_type(f.codomain)};" for f in theory.signature.functions.values()]
    lines += [f"{r.name} : {show_type(r.domain)} -> Prop;" for r in theory.signature.relations.values()]
    lines += [show_sequent(a) for a in theory.axioms]
    return f"theory {theory.name} {{\n" + "".join(f"  {x}\n" for x in lines) + "}\n"
