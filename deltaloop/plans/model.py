"""Terms, atoms, rules and programs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import DataFrame, SparkSession

    from deltaloop.plans.fixpoint import Result

#: Declared attribute type -> Spark SQL type.
TYPES = {"number": "bigint", "symbol": "string", "float": "double"}
#: The only column of a relation without attributes.
NULLARY = "holds"


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    value: int | str | float


@dataclass(frozen=True)
class Wildcard:
    pass


@dataclass(frozen=True)
class Expr:
    """Arithmetic over terms: op is one of + - * / %."""

    op: str
    left: "Term"
    right: "Term"


Term = Var | Const | Wildcard | Expr


def variables(term: Term) -> set[str]:
    if isinstance(term, Var):
        return {term.name}
    if isinstance(term, Expr):
        return variables(term.left) | variables(term.right)
    return set()


@dataclass(frozen=True)
class Atom:
    relation: str
    terms: tuple[Term, ...]
    negated: bool = False

    def variables(self) -> set[str]:
        return set().union(*(variables(t) for t in self.terms)) if self.terms else set()


@dataclass(frozen=True)
class Compare:
    """op is one of = != < <= > >=."""

    op: str
    left: Term
    right: Term

    def variables(self) -> set[str]:
        return variables(self.left) | variables(self.right)


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Atom | Compare, ...] = ()

    @property
    def positive(self) -> list[Atom]:
        return [b for b in self.body if isinstance(b, Atom) and not b.negated]

    @property
    def negative(self) -> list[Atom]:
        return [b for b in self.body if isinstance(b, Atom) and b.negated]

    @property
    def comparisons(self) -> list[Compare]:
        return [b for b in self.body if isinstance(b, Compare)]


@dataclass
class Decl:
    """columns: (name, type) pairs. keys: functional dependencies, each a tuple of key columns.

    merge tells which row of a key stays: "first" keeps the smallest of the earliest batch,
    "min" and "max" keep improving the dependent columns until nothing gets better.
    """

    name: str
    columns: list[tuple[str, str]]
    keys: list[tuple[str, ...]] = field(default_factory=list)
    merge: str = "first"

    @property
    def names(self) -> list[str]:
        return [c for c, _ in self.columns] or [NULLARY]

    @property
    def types(self) -> list[str]:
        return [TYPES.get(t, t) for _, t in self.columns] or ["boolean"]

    def __post_init__(self) -> None:
        if self.merge not in ("first", "min", "max"):
            raise ValueError(f"{self.name}: unknown merge {self.merge!r}")
        if self.merge != "first" and len(self.keys) != 1:
            raise ValueError(f"{self.name}: merge {self.merge!r} needs exactly one key")
        known = {c for c, _ in self.columns}
        for key in self.keys:
            if not set(key) <= known:
                raise ValueError(f"{self.name}: key {key} names unknown columns")


@dataclass
class Program:
    decls: dict[str, Decl] = field(default_factory=dict)
    rules: list[Rule] = field(default_factory=list)
    inputs: dict[str, dict[str, str]] = field(default_factory=dict)
    outputs: dict[str, dict[str, str]] = field(default_factory=dict)
    printed: list[str] = field(default_factory=list)
    frames: dict[str, "DataFrame"] = field(default_factory=dict)

    def declare(self, name: str, columns: Sequence[str] | Sequence[tuple[str, str]], key: Sequence[str] | None = None, merge: str = "first") -> "Program":
        pairs = [(c, "number") if isinstance(c, str) else tuple(c) for c in columns]
        self.decls[name] = Decl(name, pairs, [tuple(key)] if key else [], merge)
        return self

    def facts(self, name: str, df: "DataFrame", key: Sequence[str] | None = None, merge: str = "first") -> "Program":
        """Binds a DataFrame by position; the relation is declared from its schema if it is not yet."""
        if name not in self.decls:
            self.decls[name] = Decl(name, [(f.name, f.dataType.simpleString()) for f in df.schema.fields], [tuple(key)] if key else [], merge)
        if len(df.columns) != len(self.decls[name].names):
            raise ValueError(f"{name}: {len(df.columns)} columns given, {len(self.decls[name].names)} declared")
        self.frames[name] = df
        return self

    def rule(self, text: str) -> "Program":
        from deltaloop.plans.parser import parse_into

        parse_into(self, text)
        return self

    def check(self) -> None:
        for rule in self.rules:
            for atom in [rule.head, *rule.positive, *rule.negative]:
                if atom.relation not in self.decls:
                    raise ValueError(f"undeclared relation {atom.relation}")
                if len(atom.terms) != len(self.decls[atom.relation].columns):
                    raise ValueError(f"{atom.relation} has {len(self.decls[atom.relation].columns)} attributes, {len(atom.terms)} given")
            bound = set().union(*(a.variables() for a in rule.positive)) if rule.positive else set()
            for part in [rule.head, *rule.comparisons]:
                if not part.variables() <= bound:
                    raise ValueError(f"unbound variables {part.variables() - bound} in a rule of {rule.head.relation}")
            if any(isinstance(t, Wildcard) for t in rule.head.terms):
                raise ValueError(f"wildcard in a head of {rule.head.relation}")

    def run(self, spark: "SparkSession", max_iterations: int | None = None) -> "Result":
        from deltaloop.plans.fixpoint import run_program

        return run_program(spark, self, max_iterations)

    def write(self, result: "Result", directory: str) -> dict[str, int]:
        """Does what the directives ask: a delimited file for every output; every printed size is shown and returned."""
        from deltaloop.sources.sinks import write_delimited

        for name, options in self.outputs.items():
            write_delimited(result[name], f"{directory.rstrip('/')}/{options.get('filename', name + '.csv')}", options.get("delimiter", options.get("deliminator", "\t")))
        sizes = {name: result[name].count() for name in self.printed}
        for name, n in sizes.items():
            print(f"{name}\t{n}")
        return sizes

    def explain(self) -> str:
        """Relations, strata and, for every rule, the join order of each of its semi-naive variants."""
        from deltaloop.plans.explain import explain

        return explain(self)
