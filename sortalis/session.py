"""A session: theory text and commands in, text and tables out.

``Session.run`` takes one line.  A line that begins with a colon is a command, anything else is theory text.
Commands change the session's own models; nothing is stored before ``:commit``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sortalis.lang.elaborate import Instance, UnknownName, Workspace
from sortalis.lang.lexer import LanguageError
from sortalis.lang.pretty import show_theory
from sortalis.operators.chase import MaxIterationsExceeded, chase
from sortalis.operators.solver import Budget, enumerate_models, solve
from sortalis.plans.ops import Scan, execute, explain, optimize
from sortalis.plans.planio import execute_table, to_table
from sortalis.sources.store import Overlay, Store
from sortalis.sources.structure import Structure

SHOWN = 100  # elements that a listing shows; the count is always whole


class CommandError(ValueError):
    """A command that is unknown or lacks an argument."""


class Session:
    """Reads commands and theory text; ``folder`` is where commits go, a folder for each instance."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder
        self.workspace = Workspace(spark)
        self.commands: dict[str, tuple[Callable[..., str], str]] = {
            "help": (self.help, "what there is"),
            "list": (self.list, "[theories|instances]"),
            "inspect": (self.inspect, "<name>"),
            "source": (self.source, "<file>"),
            "reset": (self.reset, "forgets all"),
            "add": (self.add, "<instance> <element> <sort>"),
            "assert": (self.assert_, "<instance> <relation> <element>..."),
            "retract": (self.retract, "<instance> <element>"),
            "query": (self.query, "<instance> <sort>"),
            "explain": (self.explain, "<instance> <sort>"),
            "compile": (self.compile, "<instance> <sort>"),
            "chase": (self.chase, "<instance> [rounds]"),
            "solve": (self.solve, "<theory> [milliseconds]"),
            "extend": (self.extend, "<instance> <theory> [milliseconds]"),
            "commit": (self.commit, "<instance> [message...]"),
            "history": (self.history, "<instance>"),
        }
        self.short = {"h": "help", "?": "help", "l": "list", "ls": "list", "i": "inspect", "show": "inspect", "load": "source", "q": "query", "ci": "commit", "log": "history"}

    def run(self, line: str) -> str:
        """What a line gives; errors of the language and of commands are part of the text."""
        try:
            if not line.strip().startswith(":"):
                return "\n".join(f"{type(x).__name__.lower()} {x.name}" for x in self.workspace.load(line))
            words = line.strip()[1:].split()
            name = self.short.get(words[0], words[0]) if words else "help"
            if name not in self.commands:
                raise CommandError(f"no command {name}")
            return self.commands[name][0](*words[1:])
        except (LanguageError, CommandError, MaxIterationsExceeded, KeyError, ValueError) as e:
            return f"error: {e}"
        except TypeError:
            return f"error: :{name} takes {self.commands[name][1]}"

    def help(self) -> str:
        return "\n".join(f":{name} {what}" for name, (_, what) in self.commands.items())

    def list(self, what: str = "all") -> str:
        out = [f"theory {n}" for n in self.workspace.theories] if what in ("all", "theories") else []
        out += [f"instance {n} : {x.theory.name}" for n, x in self.workspace.instances.items()] if what in ("all", "instances") else []
        return "\n".join(out)

    def inspect(self, name: str) -> str:
        if name in self.workspace.theories:
            return show_theory(self.workspace.theories[name])
        model = self._instance(name).model
        return "\n".join(f"{r.kind} {r.name}: {r.n}" for r in model.sizes().collect())

    def source(self, path: str) -> str:
        with open(path) as f:
            return self.run(f.read())

    def reset(self) -> str:
        self.workspace = Workspace(self.spark)
        return "reset"

    def add(self, instance: str, element: str, sort: str) -> str:
        own = self._instance(instance)
        if sort not in own.theory.signature.sorts:
            raise CommandError(f"no sort {sort}")
        if element in own.names:
            raise CommandError(f"{element} is there already")
        overlay = Overlay(own.model)
        new = overlay.add_elements(sort)[0]
        own.model, own.names[element] = overlay.read(), (sort, new)
        return f"{element} : {sort}"

    def assert_(self, instance: str, relation: str, *elements: str) -> str:
        own = self._instance(instance)
        symbol = own.theory.signature.relations.get(relation)
        if symbol is None or [own.names.get(e, ("", 0))[0] for e in elements] != symbol.domain.sorts:
            raise CommandError(f"{relation} does not take {' '.join(elements)}")
        own.model = Overlay(own.model).put("rel", relation, [tuple(own.names[e][1] for e in elements)]).read()
        return f"{relation}({', '.join(elements)})"

    def retract(self, instance: str, element: str) -> str:
        own = self._instance(instance)
        if element not in own.names:
            raise CommandError(f"no element {element}")
        sort, e = own.names.pop(element)
        own.model = Overlay(own.model).retract_elements(sort, [e]).read()
        return f"{element} and what refers to it is gone"

    def query(self, instance: str, sort: str) -> str:
        own = self._instance(instance)
        rows = execute(Scan(self._sort(own, sort)), own.model)
        shown = [own.label(sort, r.c0) for r in rows.orderBy("c0").limit(SHOWN).collect()]
        return "\n".join([f"{rows.agg(F.count('*')).first()[0]} of {sort}", *shown])

    def explain(self, instance: str, sort: str) -> str:
        own = self._instance(instance)
        return explain(optimize(Scan(self._sort(own, sort)), own.theory.signature))

    def compile(self, instance: str, sort: str) -> str:
        own = self._instance(instance)
        table = to_table(Scan(self._sort(own, sort)), self.spark, "tensor")
        n = execute_table(table, own.model, dialect="tensor").count()
        return "\n".join([*(f"{r.op} {r.kind} {r.arguments}" for r in table.orderBy("op").collect()), f"{n} entries"])

    def chase(self, instance: str, rounds: str = "100") -> str:
        own = self._instance(instance)
        own.model, used = chase(own.model, own.theory.axioms, int(rounds))
        return f"fixpoint after {used} rounds\n{self.inspect(instance)}"

    def solve(self, theory: str, milliseconds: str = "5000") -> str:
        if theory not in self.workspace.theories:
            raise CommandError(f"no theory {theory}")
        own = self.workspace.theories[theory]
        return self._solved(solve(Structure(self.spark, own.signature), own.axioms, Budget(int(milliseconds) / 1000)))

    def extend(self, instance: str, theory: str, milliseconds: str = "5000") -> str:
        own = self._instance(instance)
        if theory not in self.workspace.theories:
            raise CommandError(f"no theory {theory}")
        larger = self.workspace.theories[theory]
        base = own.model.copy()
        base.signature = larger.signature
        return self._solved(enumerate_models(base, larger.axioms, Budget(int(milliseconds) / 1000)))

    def commit(self, instance: str, *message: str) -> str:
        return f"version {self._store(instance).commit(self._instance(instance).model, ' '.join(message))}"

    def history(self, instance: str) -> str:
        return "\n".join(f"{v['version']} {v['message']}" for v in self._store(instance).versions())

    def _store(self, instance: str) -> Store:
        if not self.folder:
            raise CommandError("the session has no folder")
        return Store(self.spark, f"{self.folder}/{instance}", self._instance(instance).theory.signature)

    def _instance(self, name: str) -> Instance:
        if name not in self.workspace.instances:
            raise UnknownName(f"instance {name}")
        return self.workspace.instances[name]

    @staticmethod
    def _sort(own: Instance, sort: str) -> str:
        if sort not in own.theory.signature.sorts:
            raise CommandError(f"no sort {sort}")
        return sort

    @staticmethod
    def _solved(result) -> str:
        head = f"{result.outcome.value} after {result.steps} steps"
        return head if result.model is None else "\n".join([head, *(f"{r.kind} {r.name}: {r.n}" for r in result.model.sizes().collect())])
