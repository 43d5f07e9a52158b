"""Signatures and finite models: sorts, partial functions and relations as DataFrames of BIGINT ids."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortalis.sources.shared import dealt


@dataclass(frozen=True)
class Product:
    """A record type: named fields, each of a sort.  No field: the unit."""

    fields: tuple[tuple[str, str], ...] = ()

    @property
    def arity(self) -> int:
        return len(self.fields)

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.fields]

    @property
    def sorts(self) -> list[str]:
        return [s for _, s in self.fields]


Type = str | Product


def flat(kind: Type) -> list[tuple[str, str]]:
    """(field, sort) of each column of a type; a plain sort has one unnamed column."""
    return list(kind.fields) if isinstance(kind, Product) else [("", kind)]


@dataclass(frozen=True)
class FunctionSymbol:
    """A partial function; an undefined value is an absent row."""

    name: str
    domain: Type
    codomain: Type

    @property
    def arguments(self) -> list[str]:
        return [f"a{i}" for i in range(len(flat(self.domain)))]

    @property
    def results(self) -> list[str]:
        return [f"r{i}" for i in range(len(flat(self.codomain)))]

    @property
    def columns(self) -> list[str]:
        return self.arguments + self.results


@dataclass(frozen=True)
class RelationSymbol:
    """A set of tuples."""

    name: str
    domain: Product

    @property
    def columns(self) -> list[str]:
        return [f"c{i}" for i in range(self.domain.arity)]


@dataclass
class Signature:
    """Declared sorts, functions and relations."""

    sorts: list[str] = field(default_factory=list)
    functions: dict[str, FunctionSymbol] = field(default_factory=dict)
    relations: dict[str, RelationSymbol] = field(default_factory=dict)

    def add_sort(self, name: str) -> None:
        if name in self.sorts:
            raise ValueError(f"sort {name} is declared twice")
        self.sorts.append(name)

    def add_function(self, name: str, domain: Type, codomain: Type) -> FunctionSymbol:
        self._check(name, [*flat(domain), *flat(codomain)])
        self.functions[name] = FunctionSymbol(name, domain, codomain)
        return self.functions[name]

    def add_relation(self, name: str, fields: Sequence[tuple[str, str]]) -> RelationSymbol:
        self._check(name, fields)
        self.relations[name] = RelationSymbol(name, Product(tuple(fields)))
        return self.relations[name]

    def _check(self, name: str, fields: Sequence[tuple[str, str]]) -> None:
        if name in self.functions or name in self.relations:
            raise ValueError(f"{name} is declared twice")
        for _, sort in fields:
            if sort not in self.sorts:
                raise KeyError(f"unknown sort {sort}")

    def copy(self) -> Signature:
        return Signature(list(self.sorts), dict(self.functions), dict(self.relations))


class Tables(dict):
    """Tables by name.  A value may be a function, which is called when the table is first read."""

    def __getitem__(self, name: str) -> DataFrame:
        value = super().__getitem__(name)
        if callable(value) and not isinstance(value, DataFrame):
            self[name] = value = value()
        return value


class Structure:
    """A finite model.  Carriers have the column ``elem``, functions ``a0.. r0..``, relations ``c0..``.

    ``closed`` says that tables refer to elements of the carriers only, as foreign keys do; where it is not known,
    formulas leave out the rows that do not.  ``functional`` vouches that each graph has an argument once; where it is not
    known, formulas drop assignments that come twice.
    """

    def __init__(self, spark: SparkSession, signature: Signature, closed: bool = False, functional: bool = False):
        self.spark, self.signature, self.closed, self.functional = spark, signature, closed, functional
        self.carriers: dict[str, DataFrame] = Tables()
        self.functions: dict[str, DataFrame] = Tables()
        self.relations: dict[str, DataFrame] = Tables()

    def rows(self, columns: Sequence[str], tuples: Sequence[Sequence[int]] = ()) -> DataFrame:
        """A DataFrame of id columns from rows given here."""
        if not columns:
            raise ValueError("a table needs a column")
        return self.spark.createDataFrame([tuple(map(int, t)) for t in tuples], ", ".join(f"{c} long" for c in columns))

    def carrier(self, sort: str) -> DataFrame:
        """The elements of a sort; an unknown or unfilled sort is empty."""
        return self.carriers[sort] if sort in self.carriers else self.rows(["elem"])

    def relation(self, name: str) -> DataFrame:
        """The tuples of a relation; an unknown one is empty and has one column."""
        if name in self.relations:
            return self.relations[name]
        symbol = self.signature.relations.get(name)
        return self.rows(symbol.columns if symbol and symbol.columns else ["c0"])

    def function(self, name: str) -> DataFrame:
        """The graph of a function, each argument once."""
        return self.functions[name] if name in self.functions else self.rows(self.signature.functions[name].columns)

    def inside(self, frame: DataFrame, columns: Sequence[str], sorts: Sequence[str]) -> DataFrame:
        """The rows whose columns are elements of their sorts; all rows of a closed model."""
        if self.closed:
            return frame
        for column, sort in zip(columns, sorts, strict=True):
            frame = frame.join(self.carrier(sort).select(F.col("elem").alias("_e")), F.col(column) == F.col("_e"), "left_semi")
        return frame

    def relation_inside(self, name: str) -> DataFrame:
        """A relation's tuples of elements."""
        symbol = self.signature.relations[name]
        return self.inside(self.relation(name), symbol.columns, symbol.domain.sorts)

    def function_inside(self, name: str) -> DataFrame:
        """A function's graph over elements."""
        symbol = self.signature.functions[name]
        return self.inside(self.function(name), symbol.columns, [s for _, s in [*flat(symbol.domain), *flat(symbol.codomain)]])

    def restricted(self) -> Structure:
        """The model without what refers to an element that it lacks."""
        out = self.copy()
        for name in self.signature.functions:
            out.functions[name] = self.function_inside(name)
        for name in self.signature.relations:
            out.relations[name] = self.relation_inside(name)
        out.closed = True
        return out

    def size(self, sort: str) -> int:
        """How many elements a sort has."""
        return self.carrier(sort).count()

    def sizes(self) -> DataFrame:
        """Rows (kind, name, n): how many elements, values and tuples each sort, function and relation has."""
        parts = [("sort", n, self.carrier(n)) for n in self.signature.sorts]
        parts += [("function", n, self.function(n)) for n in self.signature.functions]
        parts += [("relation", n, self.relation(n)) for n in self.signature.relations]
        counts = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), F.lit(n).alias("name"), "n") for k, n, t in parts]
        return reduce(DataFrame.unionByName, counts) if counts else self.spark.createDataFrame([], "kind string, name string, n long")

    def set_carrier(self, sort: str, frame: DataFrame, column: str) -> Structure:
        """Takes the distinct values of a column as the elements; nulls are none."""
        if sort not in self.signature.sorts:
            raise KeyError(f"unknown sort {sort}")
        self.carriers[sort] = frame.select(F.col(column).cast("long").alias("elem")).dropna().distinct()
        return self

    def set_function(self, name: str, frame: DataFrame, arguments: Sequence[str], results: Sequence[str], unique: bool = False) -> Structure:
        """Takes a function's graph from columns; rows with a null are undefined values and go.

        Of several values at an argument the least stays; ``unique`` vouches that there are none.
        """
        symbol = self.signature.functions[name]
        named = [F.col(c).cast("long").alias(n) for c, n in zip([*arguments, *results], symbol.columns, strict=True)]
        out = frame.select(*named).dropna()
        if not unique:
            least = out.groupBy(*symbol.arguments).agg(F.min(F.struct(*symbol.results)).alias("_r"))
            out = least.select(*symbol.arguments, *[F.col("_r").getField(r).alias(r) for r in symbol.results])
        self.functions[name] = out
        return self

    def set_relation(self, name: str, frame: DataFrame, columns: Sequence[str], distinct: bool = True) -> Structure:
        """Takes a relation's tuples from columns; ``distinct`` says whether repeated tuples must go."""
        symbol = self.signature.relations[name]
        out = frame.select(*[F.col(c).cast("long").alias(n) for c, n in zip(columns, symbol.columns, strict=True)])
        self.relations[name] = dealt(out, symbol.columns).distinct() if distinct else out
        return self

    def add(self, sort: str, elements: Sequence[int]) -> Structure:
        """Adds elements given here."""
        self.carriers[sort] = self.carrier(sort).unionByName(self.rows(["elem"], [(e,) for e in elements])).distinct()
        return self

    def define(self, name: str, rows: Sequence[Sequence[int]]) -> Structure:
        """Adds function values given here."""
        symbol = self.signature.functions[name]
        self.functional = False
        self.functions[name] = self.function(name).unionByName(self.rows(symbol.columns, rows)).distinct()
        return self

    def assert_(self, name: str, rows: Sequence[Sequence[int]]) -> Structure:
        """Adds tuples given here."""
        symbol = self.signature.relations[name]
        self.relations[name] = self.relation(name).unionByName(self.rows(symbol.columns, rows)).distinct()
        return self

    def copy(self) -> Structure:
        out = Structure(self.spark, self.signature, self.closed, self.functional)
        out.carriers, out.functions, out.relations = Tables(self.carriers), Tables(self.functions), Tables(self.relations)
        return out

    def undefined(self, name: str) -> DataFrame:
        """The arguments a0.. at which a function has no value."""
        symbol = self.signature.functions[name]
        domain = None
        for column, (_, sort) in zip(symbol.arguments, flat(symbol.domain), strict=True):
            part = self.carrier(sort).select(F.col("elem").alias(column))
            domain = part if domain is None else domain.crossJoin(part)
        return domain.join(self.function(name), symbol.arguments, "left_anti")

    def is_total(self) -> bool:
        """Whether every function is defined everywhere."""
        return all(self.undefined(f).isEmpty() for f in self.signature.functions)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commerce(spark: SparkSession, sf_dir: str) -> Structure:
    """The driver's tables as a model; their foreign keys hold."""
    sig = Signature()
    for s in ("Region", "Nation", "Customer", "Supplier", "Part", "Order", "Event", "User", "Document", "Level"):
        sig.add_sort(s)
    for name, a, b in (("nation_region", "Nation", "Region"), ("cust_nation", "Customer", "Nation"), ("supp_nation", "Supplier", "Nation"), ("order_cust", "Order", "Customer"), ("event_user", "Event", "User")):
        sig.add_function(name, a, b)
    sig.add_function("label", "Document", Product((("quality", "Level"), ("toxic", "Level"))))
    sig.add_relation("lineitem", [("order", "Order"), ("part", "Part"), ("supplier", "Supplier")])
    m = Structure(spark, sig, closed=True, functional=True)
    for sort, name, key in (("Region", "region", "r_regionkey"), ("Nation", "nation", "n_nationkey"), ("Customer", "customer", "c_custkey"), ("Supplier", "supplier", "s_suppkey"), ("Part", "part", "p_partkey"), ("Order", "orders", "o_orderkey"), ("Event", "events", "event_id"), ("Document", "documents", "doc_id")):
        m.carriers[sort] = lambda name=name, key=key: table(spark, sf_dir, name).select(F.col(key).cast("long").alias("elem"))
    m.carriers["User"] = lambda: table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("elem")).distinct()
    m.carriers["Level"] = lambda: m.rows(["elem"], [(0,), (1,)])
    for name, source, key, values in (("nation_region", "nation", "n_nationkey", ["n_regionkey"]), ("cust_nation", "customer", "c_custkey", ["c_nationkey"]), ("supp_nation", "supplier", "s_suppkey", ["s_nationkey"]), ("order_cust", "orders", "o_orderkey", ["o_custkey"]), ("event_user", "events", "event_id", ["user_id"]), ("label", "labels", "doc_id", ["quality", "toxic"])):
        m.functions[name] = lambda name=name, source=source, key=key, values=values: _graph(m, name, source, key, values, sf_dir)
    m.relations["lineitem"] = lambda: m.copy().set_relation("lineitem", table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"]).relations["lineitem"]
    return m


def _graph(m: Structure, name: str, source: str, key: str, values: list[str], sf_dir: str) -> DataFrame:
    own = Structure(m.spark, m.signature)
    return own.set_function(name, table(m.spark, sf_dir, source), [key], values, unique=True).functions[name]
