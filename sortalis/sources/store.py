"""Versioned models: patches, linear history, overlays, an append-only Parquet store, and names.

A model is written as facts (kind, symbol, tuple).  ``kind`` is ``elem``, ``func`` or ``rel``; the tuple holds the
element, the argument and result values, or the relation's columns.  A patch is the facts that go and those that
come, so that it can be applied, undone and stored alike for every kind.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortalis.operators.check import Report, check_theory
from sortalis.operators.tensor import Tensor
from sortalis.sources.shared import remove_folder
from sortalis.sources.structure import Product, Signature, Structure, Type, flat

FACTS = "kind string, symbol string, tuple array<bigint>"
KEYS = ["kind", "symbol", "tuple"]


def facts(model: Structure) -> DataFrame:
    """All facts of a model."""
    out = model.spark.createDataFrame([], FACTS)
    sig = model.signature
    parts = [("elem", s, ["elem"], model.carriers) for s in sig.sorts]
    parts += [("func", f.name, f.columns, model.functions) for f in sig.functions.values()]
    parts += [("rel", r.name, r.columns, model.relations) for r in sig.relations.values()]
    for kind, symbol, columns, tables in parts:
        if symbol in tables:
            out = out.unionByName(tables[symbol].select(F.lit(kind).alias("kind"), F.lit(symbol).alias("symbol"), F.array(*columns).alias("tuple")))
    return out


def model_of(rows: DataFrame, sig: Signature) -> Structure:
    """The model that has these facts."""
    out = Structure(rows.sparkSession, sig)

    def table(kind: str, symbol: str, columns: list[str]) -> DataFrame:
        own = rows.where((F.col("kind") == kind) & (F.col("symbol") == symbol))
        return own.select(*[F.col("tuple")[i].alias(c) for i, c in enumerate(columns)]).distinct()

    out.carriers.update({s: table("elem", s, ["elem"]) for s in sig.sorts})
    out.functions.update({f.name: table("func", f.name, f.columns) for f in sig.functions.values()})
    out.relations.update({r.name: table("rel", r.name, r.columns) for r in sig.relations.values()})
    return out


@dataclass
class Patch:
    """The facts that a change takes away and those that it brings."""

    gone: DataFrame
    come: DataFrame

    def inverted(self) -> Patch:
        return Patch(self.come, self.gone)

    def is_empty(self) -> bool:
        return self.gone.isEmpty() and self.come.isEmpty()

    def applied(self, model: Structure) -> Structure:
        """The model after the change; what refers to an element that is gone goes too.

        A value that comes takes the place of the function's old one at the same argument.
        """
        sig = model.signature
        widths = [f"when kind = 'func' and symbol = '{f.name}' then slice(tuple, 1, {len(f.arguments)})" for f in sig.functions.values()]
        rows = facts(model).join(self.gone, KEYS, "left_anti")
        if widths:
            at = F.expr(f"case {' '.join(widths)} end").alias("_a")
            new = self.come.select("kind", "symbol", at).distinct()
            rows = rows.select("*", at).join(new, ["kind", "symbol", "_a"], "left_anti").drop("_a")
        out = model_of(rows.unionByName(self.come).distinct(), sig)
        return out if self.gone.where("kind = 'elem'").isEmpty() else out.restricted()

    def completed(self, model: Structure) -> Patch:
        """The patch with all that it takes away from a model, so that its inverse brings it all back."""
        return diff(model, self.applied(model))

    def tensor(self, symbol: str, width: int) -> Tensor:
        """The change of a relation (or of a function's graph) as a sparse tensor: 1 where a tuple comes, -1 where one goes."""
        both = self.rows().where((F.col("kind") != "elem") & (F.col("symbol") == symbol))
        sign = F.when(F.col("op") == "come", 1).otherwise(-1).cast("long").alias("v")
        return Tensor(both.select(*[F.col("tuple")[i].alias(f"i{i}") for i in range(width)], sign), width)

    def grows(self) -> bool:
        """Whether nothing goes, so that what held of old elements and facts still does."""
        return self.gone.isEmpty()

    def new_elements(self) -> dict[str, DataFrame]:
        """By sort, the elements that come."""
        symbols = [r.symbol for r in self.come.where("kind = 'elem'").select("symbol").distinct().collect()]
        return {s: self.come.where((F.col("kind") == "elem") & (F.col("symbol") == s)).select(F.col("tuple")[0].alias("elem")) for s in symbols}

    def rows(self) -> DataFrame:
        return self.gone.withColumn("op", F.lit("gone")).unionByName(self.come.withColumn("op", F.lit("come")))


def diff(old: Structure, new: Structure) -> Patch:
    """The patch from one model to another."""
    a, b = facts(old), facts(new)
    return Patch(a.join(b, KEYS, "left_anti"), b.join(a, KEYS, "left_anti"))


def initial(model: Structure) -> Patch:
    """The patch from nothing."""
    return Patch(model.spark.createDataFrame([], FACTS), facts(model))


def apply_checked(model: Structure, patch: Patch, axioms: list) -> tuple[Structure, Report]:
    """Applies a patch and checks the axioms: at new elements only if nothing but elements and facts came, else in full."""
    out = patch.applied(model)
    new = patch.new_elements() if patch.gone.isEmpty() else None
    old_facts = patch.come.where("kind <> 'elem'").isEmpty()
    return out, check_theory(out, axioms, new if new is not None and old_facts else None)


class Overlay:
    """A base model with uncommitted changes on top; reads see both."""

    def __init__(self, base: Structure):
        self.base, self._facts = base, facts(base)
        self.patch = Patch(base.spark.createDataFrame([], FACTS), base.spark.createDataFrame([], FACTS))

    def _rows(self, kind: str, symbol: str, rows: list[tuple[int, ...]]) -> DataFrame:
        return self.base.spark.createDataFrame([(kind, symbol, list(map(int, r))) for r in rows], FACTS)

    def add_elements(self, sort: str, n: int = 1) -> range:
        """New elements of a sort, numbered from the largest that it has; a batch of any size is one table."""
        have = self.read().carrier(sort).agg(F.max("elem")).first()[0]
        first = 0 if have is None else have + 1
        new = self.base.spark.range(first, first + n).select(F.lit("elem").alias("kind"), F.lit(sort).alias("symbol"), F.array("id").alias("tuple"))
        self.patch = Patch(self.patch.gone, self.patch.come.unionByName(new))
        return range(first, first + n)

    def retract_elements(self, sort: str, elements: list[int]) -> Overlay:
        """Takes elements away, and with them all that refers to them."""
        return self.drop("elem", sort, [(e,) for e in elements])

    def set_values(self, name: str, rows: list[tuple[int, ...]]) -> Overlay:
        """Sets a function's values; an old value at the same argument goes."""
        n = len(self.base.signature.functions[name].arguments)
        own = (F.col("kind") == "func") & (F.col("symbol") == name)
        at = self._rows("func", name, [r[:n] for r in rows]).select(F.col("tuple").alias("_a"))
        same = lambda frame: frame.where(own).join(at, F.slice("tuple", 1, n) == F.col("_a"), "left_semi")
        old = same(self.read_facts()).collect()
        return self.drop("func", name, [tuple(r.tuple) for r in old if tuple(r.tuple) not in set(map(tuple, rows))]).put("func", name, rows)

    def read_facts(self) -> DataFrame:
        return self._facts.join(self.patch.gone, KEYS, "left_anti").unionByName(self.patch.come).distinct()

    def put(self, kind: str, symbol: str, rows: list[tuple[int, ...]]) -> Overlay:
        """Asserts facts; one that the base has is only freed from being retracted."""
        new = self._rows(kind, symbol, rows)
        come = self.patch.come.unionByName(new.join(self._facts, KEYS, "left_anti")).distinct()
        self.patch = Patch(self.patch.gone.join(new, KEYS, "left_anti"), come)
        return self

    def drop(self, kind: str, symbol: str, rows: list[tuple[int, ...]]) -> Overlay:
        """Retracts facts; one that the base lacks is only freed from being asserted."""
        old = self._rows(kind, symbol, rows)
        gone = self.patch.gone.unionByName(old.join(self._facts, KEYS, "left_semi")).distinct()
        self.patch = Patch(gone, self.patch.come.join(old, KEYS, "left_anti"))
        return self

    def read(self) -> Structure:
        return self.patch.applied(self.base)

    def commit(self) -> Structure:
        """The changed model becomes the base."""
        self.__init__(self.read())
        return self.base

    def rollback(self) -> Structure:
        self.__init__(self.base)
        return self.base


COMMITS = "version long, message string, schema string, batch string"
BINDINGS = "name string, version long, at long"


class Store:
    """An append-only folder of Parquet: a patch for each version, facts tagged as given (edb) or derived (idb).

    The facts of a version lie in a folder of their own, which its commit row names.  A version is there once its
    row is; facts that a lost writer left behind are never read.  One writer at a time is assumed.
    """

    def __init__(self, spark: SparkSession, folder: str, sig: Signature):
        self.spark, self.folder, self.signature = spark, folder.rstrip("/"), sig

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        return self.spark.createDataFrame([], schema)

    @property
    def log(self) -> DataFrame:
        """All stored changes: rows (version, source, op, kind, symbol, tuple)."""
        return self._log([(v["version"], v["batch"]) for v in self.versions()])

    def _log(self, versions: list[tuple[int, str]]) -> DataFrame:
        schema = f"{FACTS}, op string, version long, source string"
        paths = [f"{self.folder}/facts/version={v}/batch={b}" for v, b in versions]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, batch string").option("basePath", f"{self.folder}/facts").parquet(*paths).drop("batch")

    def versions(self) -> list[dict]:
        """The commits, oldest first."""
        return [r.asDict() for r in self._table("commits", COMMITS).orderBy("version").collect()]

    @property
    def head(self) -> int:
        last = self._table("commits", COMMITS).agg(F.max("version")).first()[0]
        return 0 if last is None else last

    def commit(self, model: Structure, message: str = "", derived: DataFrame | None = None) -> int:
        """Appends what changed since the last version; an empty change is refused."""
        head = self.head
        current = self.checkout(head) if head else Structure(self.spark, self.signature)
        rows = diff(current, model).rows()
        if derived is None:
            rows = rows.withColumn("source", F.lit("edb"))
        else:
            marks = derived.select(*KEYS).distinct().withColumn("_d", F.lit("idb"))
            rows = rows.join(marks, KEYS, "left").withColumn("source", F.coalesce("_d", F.lit("edb"))).drop("_d")
        version, batch = head + 1, uuid.uuid4().hex
        folder = f"{self.folder}/facts/version={version}/batch={batch}"
        rows.write.partitionBy("source").parquet(folder)
        if self._log([(version, batch)]).isEmpty():
            remove_folder(self.spark, folder)
            raise ValueError("nothing has changed")
        schema = json.dumps({"sorts": self.signature.sorts, "functions": list(self.signature.functions), "relations": list(self.signature.relations)})
        self.spark.createDataFrame([(version, message, schema, batch)], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return version

    def bind(self, name: str, version: int | None = None) -> None:
        """Gives a version a name, from the present version on; the name may be bound anew later."""
        head = self.head
        self.spark.createDataFrame([(name, head if version is None else version, head)], BINDINGS).coalesce(1).write.mode("append").parquet(f"{self.folder}/bindings")

    def resolve(self, name: str, at: int | None = None) -> int | None:
        """The version that a name meant at a version: its last binding up to there."""
        rows = self._table("bindings", BINDINGS).where(F.col("name") == name)
        if at is not None:
            rows = rows.where(F.col("at") <= at)
        return rows.agg(F.max(F.struct("at", "version")).alias("k")).select("k.version").first()[0]

    def facts_at(self, version: int | None = None, source: str | None = None) -> DataFrame:
        """The latest state of each fact at a version, with partition pruning on versions."""
        rows = self._log([(v["version"], v["batch"]) for v in self.versions() if version is None or v["version"] <= version])
        if source:
            rows = rows.where(F.col("source") == source)
        last = rows.groupBy(*KEYS).agg(F.max_by("op", "version").alias("op"))
        return last.where("op = 'come'").select(*KEYS)

    def checkout(self, version: int | None = None) -> Structure:
        return model_of(self.facts_at(version), self.signature)

    def checkout_checked(self, axioms: list, version: int | None = None) -> tuple[Structure, Report]:
        model = self.checkout(version)
        return model, check_theory(model, axioms)

    def changes_since(self, version: int, source: str = "edb") -> DataFrame:
        """What another copy of the store at a version lacks; derived facts are derived there again."""
        return self._log([(v["version"], v["batch"]) for v in self.versions() if v["version"] > version]).where(F.col("source") == source)


class Names:
    """Qualified names: rows (id, path array<string>)."""

    def __init__(self, frame: DataFrame):
        self.frame = frame

    def exact(self, path: list[str]) -> DataFrame:
        return self.frame.where(F.col("path") == F.array(*map(F.lit, path)))

    def suffix(self, path: list[str]) -> DataFrame:
        """The names that end in a path."""
        n = len(path)
        return self.frame.where((F.size("path") >= n) & (F.slice("path", F.lit(-n), F.lit(n)) == F.array(*map(F.lit, path))))

    def lookup(self, path: list[str]) -> tuple[str, list[int]]:
        """("unique", [id]), ("ambiguous", ids) or ("unknown", []) for a path."""
        found = self.resolve(path)
        return ("unknown", "unique", "ambiguous")[min(len(found), 2)], found

    def resolve(self, path: list[str]) -> list[int]:
        """The ids that a path may mean: an exact name alone, else every name that ends in it."""
        found = self.exact(path).select("id").collect() or self.suffix(path).select("id").collect()
        return sorted(r.id for r in found)


def symbols(spark: SparkSession, sig: Signature) -> DataFrame:
    """The declarations of a signature as rows (kind, name, role, column, field, sort); ``role`` is of the column."""
    rows = [("sort", s, "", 0, "", s) for s in sig.sorts]
    for f in sig.functions.values():
        for role, kind in (("argument", f.domain), ("result", f.codomain)):
            rows += [("function", f.name, role, i, n, s) for i, (n, s) in enumerate(flat(kind))]
    for r in sig.relations.values():
        rows += [("relation", r.name, "column", i, n, s) for i, (n, s) in enumerate(r.domain.fields)] or [("relation", r.name, "column", -1, "", "")]
    return spark.createDataFrame(rows, "kind string, name string, role string, column int, field string, sort string")


def signature_of(rows: DataFrame) -> Signature:
    """The signature that has these declarations; the table is metadata, of a row for each column."""
    out = Signature()
    found: dict[tuple[str, str], dict[str, list[tuple[int, str, str]]]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r.kind != "sort", r.name)):
        found.setdefault((r.kind, r.name), {}).setdefault(r.role, []).append((r.column, r.field, r.sort))

    def kind_of(columns: list[tuple[int, str, str]]) -> Type:
        fields = tuple((n, s) for _, n, s in sorted(columns))
        return fields[0][1] if len(fields) == 1 and not fields[0][0] else Product(fields)

    for (kind, name), roles in found.items():
        if kind == "sort":
            out.add_sort(name)
        elif kind == "function":
            out.add_function(name, kind_of(roles.get("argument", [])), kind_of(roles.get("result", [])))
        else:
            out.add_relation(name, [(n, s) for i, n, s in sorted(roles["column"]) if i >= 0])
    return out


def functions_at(declarations: DataFrame, sort: str, role: str = "argument") -> DataFrame:
    """The functions and relations with a column of a sort in a role (``argument``, ``result``, ``column``)."""
    return declarations.where((F.col("sort") == sort) & (F.col("role") == role)).select("kind", "name").distinct()
