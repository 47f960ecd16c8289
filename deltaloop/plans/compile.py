"""Rules -> DataFrames.

A body becomes a chain of joins that starts at the delta atom. Variables are dropped as soon as
nothing needs them, an atom that binds nothing new becomes a left semi join, comparisons are applied
once their variables are bound, and negated atoms become left anti joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloop.functions.columns import col, conjunction
from deltaloop.plans.model import NULLARY, Atom, Compare, Const, Decl, Expr, Rule, Term, Var, Wildcard

_ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "%": lambda a, b: a % b,
}
_COMPARISON: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
_ANY = "_any"


def expression(term: Term) -> Column:
    if isinstance(term, Var):
        return col(term.name)
    if isinstance(term, Const):
        return F.lit(term.value).cast("bigint") if isinstance(term.value, int) else F.lit(term.value)
    if isinstance(term, Expr):
        if term.op == "/":
            return _integer_division(term)
        return _ARITHMETIC[term.op](expression(term.left), expression(term.right))
    raise ValueError("a wildcard has no value")


def _integer_division(term: Expr) -> Column:
    a, b = expression(term.left), expression(term.right)
    return ((a - a % b) / b).cast("bigint")


def comparison(c: Compare) -> Column:
    return _COMPARISON[c.op](expression(c.left), expression(c.right))


def atom_frame(atom: Atom, df: DataFrame, keep: set[str]) -> DataFrame:
    """Columns of a relation renamed to the variables in keep; constants and repetitions filter."""
    bound: dict[str, Column] = {}
    conditions = []
    for name, term in zip(df.columns, atom.terms):
        if isinstance(term, Wildcard):
            continue
        if isinstance(term, Const):
            conditions.append(col(name) == expression(term))
        elif isinstance(term, Var):
            if term.name in bound:
                conditions.append(bound[term.name] == col(name))
            else:
                bound[term.name] = col(name)
        else:
            raise ValueError(f"arithmetic inside a body atom of {atom.relation}: bind it with a comparison")
    if (condition := conjunction(conditions)) is not None:
        df = df.where(condition)
    if not (names := [n for n in bound if n in keep]):
        return df.select(F.lit(True).alias(_ANY)).limit(1)
    return df.select(*[bound[n].alias(n) for n in names])


def _needed(parts: list[Atom | Compare]) -> set[str]:
    return set().union(*(p.variables() for p in parts)) if parts else set()


def join_order(rule: Rule, first: int | None) -> list[int]:
    """The delta atom, then whatever shares a bound variable, in the order written."""
    atoms = rule.positive
    left = list(range(len(atoms)))
    order: list[int] = []
    bound: set[str] = set()
    while left:
        if not order and first is not None:
            k = first
        else:
            k = next((i for i in left if atoms[i].variables() & bound), left[0])
        left.remove(k)
        order.append(k)
        bound |= atoms[k].variables()
    return order


def head_frame(rule: Rule, decl: Decl, df: DataFrame) -> DataFrame:
    if not decl.columns:
        return df.select(F.lit(True).alias(NULLARY)).limit(1)
    return df.select(*[expression(t).cast(kind).alias(n) for t, n, kind in zip(rule.head.terms, decl.names, decl.types)])


def compile_rule(rule: Rule, decl: Decl, read: Callable[[Atom, int], DataFrame], first: int | None = None) -> DataFrame:
    """read gives the DataFrame of the k-th positive atom (or of a negated one, k = -1)."""
    atoms = rule.positive
    waiting: list[Compare | Atom] = [*rule.comparisons, *rule.negative]
    order = join_order(rule, first)
    bound: set[str] = set()
    out: DataFrame | None = None
    for step, k in enumerate(order):
        later = [atoms[i] for i in order[step + 1 :]]
        need = _needed([rule.head, *later, *waiting])
        own = atoms[k].variables()
        side = atom_frame(atoms[k], read(atoms[k], k), need | bound)
        if out is None:
            out = side
        elif shared := sorted(own & bound):
            new = (own - bound) & need
            out = out.join(side, shared, "inner" if new else "left_semi")
        elif own & need:
            out = out.crossJoin(side)
        else:
            out = out.crossJoin(side.drop(*[c for c in side.columns if c != _ANY]).withColumnRenamed(_ANY, f"{_ANY}{k}").limit(1)).drop(f"{_ANY}{k}")
        bound |= own & need
        ready = [w for w in waiting if (w.variables() if isinstance(w, Compare) else w.variables() & _needed(atoms)) <= bound]
        for part in ready:
            waiting.remove(part)
            if isinstance(part, Compare):
                out = out.where(comparison(part))
            else:
                out = _without(out, part, read(part, -1), bound)
        need = _needed([rule.head, *later, *waiting])
        if (keep := [c for c in out.columns if c in need]) and len(keep) < len(out.columns):
            out = out.select(*[col(c) for c in keep])
            bound &= set(keep)
    if out is None:
        raise ValueError("a rule without a positive atom is a fact")
    return head_frame(rule, decl, out)


def _without(df: DataFrame, atom: Atom, other: DataFrame, bound: set[str]) -> DataFrame:
    names = sorted(atom.variables() & bound)
    side = atom_frame(atom, other, set(names))
    return df.join(side, names, "left_anti") if names else df.join(side, F.lit(True), "left_anti")
