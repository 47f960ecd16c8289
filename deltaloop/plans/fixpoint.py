"""The fixpoint driver: strata in order, semi-naive rounds of DataFrame jobs inside each.

Per stratum: rules that do not recurse are evaluated once. Each round then evaluates, for every
recursive atom, the variant that reads this atom's delta and the full relation elsewhere; the union
is deduplicated, rows already known are removed by a left anti join, and the delta is written
to the shared folder. The full relation is a list of disjoint deltas, compacted now and then; a
relation whose dependent columns improve is a list of improvements, resolved when it is read.

Where few rows were made and the full relation is large, the few are broadcast and the full relation
is only scanned, so late rounds do not shuffle it.

A relation whose only recursion composes it with itself is squared instead: pairs exactly 2^k apart are
joined with all pairs, so a pair is derived once per shortest path's vertex at that distance, not once
per vertex between. The rounds find the same rows as the variants would.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloop.functions.columns import col, row_struct
from deltaloop.functions.session import drop, is_stored, shuffle_partitions, stored
from deltaloop.operators.choice import best_per_key, choose
from deltaloop.plans.compile import compile_rule, head_frame
from deltaloop.plans.model import Atom, Decl, Program, Rule, Var
from deltaloop.plans.stratify import strata

T = TypeVar("T")
#: Deltas of a relation that are held apart before they are written together.
COMPACT_EVERY = 8
#: From so many rows on, a full relation is scanned for few new ones (at most so many) instead of shuffled.
LARGE, FEW = 20_000_000, 1_000_000


@dataclass
class IterationStats:
    stratum: int
    iteration: int
    relation: str
    new: int
    full: int
    seconds: float


@dataclass
class Result:
    frames: dict[str, DataFrame]
    stats: list[IterationStats] = field(default_factory=list)

    def __getitem__(self, name: str) -> DataFrame:
        return self.frames[name]

    def iterations(self, relation: str) -> int:
        return max((s.iteration for s in self.stats if s.relation == relation), default=0)

    def show(self, relation: str, n: int = 3000) -> None:
        df = self.frames[relation]
        df.orderBy(*[col(c) for c in df.columns]).show(n, truncate=False)


class _Relation:
    def __init__(self, decl: Decl, base: DataFrame) -> None:
        self.decl = decl
        self.tables = [stored(base)]  # what parts read
        self.parts = list(self.tables)
        self.delta = self.parts[0]
        self.new = self.rows = self.delta.count()
        self.improves = bool(decl.keys) and decl.merge != "first"

    @property
    def full(self) -> DataFrame:
        every = reduce(DataFrame.union, self.parts)
        return best_per_key(every, self.decl.keys[0], self.decl.merge) if self.improves and len(self.parts) > 1 else every

    def unknown(self, made: DataFrame) -> DataFrame:
        """The rows of made that the relation lacks, as its dependencies see it."""
        decl, full = self.decl, self.full
        if not decl.keys:
            return _lacking(made.distinct(), full, decl.names, self.rows > LARGE and self.new <= FEW)
        if decl.merge == "first":
            for key in decl.keys:
                made = made.join(full.select(*[col(k) for k in key]), list(key), "left_anti")
            return choose(made.select(*[col(n) for n in decl.names]), decl.keys)
        key = list(decl.keys[0])
        rest = [n for n in decl.names if n not in key]
        best = best_per_key(made, key, decl.merge)
        old = full.select(*[col(k) for k in key], row_struct(rest).alias("_old"))
        new = row_struct(rest)
        better = new < F.col("_old") if decl.merge == "min" else new > F.col("_old")
        first = F.col("_old").isNull()
        return best.join(old, key, "left").where(first | better).select(*[col(n) for n in decl.names], first.alias("_first"))

    def grow(self, found: DataFrame) -> None:
        """found: a stored result of unknown()."""
        self.delta = found.select(*[col(n) for n in self.decl.names]) if self.improves else found
        self.new = found.count()
        if not self.new:
            return
        self.tables.append(found)
        self.parts.append(self.delta)
        self.rows += found.where("_first").count() if self.improves else self.new
        if len(self.parts) > COMPACT_EVERY:
            old, self.tables = self.tables, [stored(self.full.coalesce(shuffle_partitions(found.sparkSession)))]
            self.parts = list(self.tables)
            drop(*[t for t in old if t is not found])  # the last delta is still read by the next round


def _lacking(made: DataFrame, full: DataFrame, names: list[str], few: bool) -> DataFrame:
    """The rows of made that full lacks. few: made may be small enough to be broadcast; that is tried."""
    if few:
        made = stored(made)
        if made.count() <= FEW:
            return made.join(F.broadcast(full.join(F.broadcast(made), names, "left_semi")), names, "left_anti")
    return made.join(full, names, "left_anti")


def _empty(spark: SparkSession, decl: Decl) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in zip(decl.names, decl.types)))


def _bound(decl: Decl, df: DataFrame) -> DataFrame:
    """A given DataFrame as the relation declares it, a set. NULL never joins: rows with one are left out here, as by all readers."""
    out = df.toDF(*decl.names).select(*[col(n).cast(t).alias(n) for n, t in zip(decl.names, decl.types)])
    return out.dropna(how="any").distinct()


def _once(df: DataFrame) -> DataFrame:
    """A relation that every round reads is written once, not derived again each time."""
    return df if is_stored(df) else stored(df)


def _facts(spark: SparkSession, decl: Decl, rules: list[Rule]) -> list[DataFrame]:
    one = spark.range(1)
    return [head_frame(r, decl, one) for r in rules if not r.body]


def run_program(spark: SparkSession, program: Program, max_iterations: int | None = None) -> Result:
    """Evaluates a program. max_iterations bounds the rounds after the non-recursive base, exactly."""
    program.check()
    known = {name: _bound(program.decls[name], df) for name, df in program.frames.items()}
    derived = {r.head.relation for r in program.rules}
    for name, decl in program.decls.items():
        if name not in known and name not in derived:
            known[name] = _empty(spark, decl)
    stats: list[IterationStats] = []
    for number, stratum in enumerate(strata(program)):
        known.update(_stratum(spark, program, number, stratum, known, stats, max_iterations))
    return Result(known, stats)


def _stratum(spark: SparkSession, program: Program, number: int, names: list[str], known: dict[str, DataFrame], stats: list[IterationStats], most: int | None) -> dict[str, DataFrame]:
    inside = set(names)
    rules = {n: [r for r in program.rules if r.head.relation == n] for n in names}
    recursive = {n: [r for r in rules[n] if any(a.relation in inside for a in r.positive)] for n in names}
    base: dict[str, DataFrame] = {}
    for n in names:
        decl = program.decls[n]
        frames = _facts(spark, decl, rules[n])
        if n in known:
            frames.append(known[n])
        frames += [compile_rule(r, decl, lambda a, k: known[a.relation]) for r in rules[n] if r.body and r not in recursive[n]]
        made = reduce(DataFrame.union, frames) if frames else _empty(spark, decl)
        if not decl.keys:
            base[n] = made.distinct()
        elif decl.merge == "first":
            base[n] = choose(made, decl.keys)
        else:
            base[n] = best_per_key(made, decl.keys[0], decl.merge)
    if not any(recursive.values()):
        return base
    outside = {a.relation for rs in recursive.values() for r in rs for a in [*r.positive, *r.negative]} - inside
    known = known | {n: _once(known[n]) for n in outside}
    if len(names) == 1 and _composes_itself(program.decls[names[0]], recursive[names[0]]):
        return {names[0]: _squared(number, program.decls[names[0]], base[names[0]], stats, most)}
    began = time.time()
    state = {n: _Relation(program.decls[n], base[n]) for n in names}
    stats += [IterationStats(number, 0, n, s.new, s.rows, time.time() - began) for n, s in state.items()]
    iteration = 0
    while any(s.new for s in state.values()) and (most is None or iteration < most):
        iteration += 1
        began = time.time()
        made = {n: [v for r in recursive[n] for v in _variants(r, program.decls[n], inside, state, known)] for n in names}

        def find(n: str) -> DataFrame:
            return stored(state[n].unknown(reduce(DataFrame.union, made[n])))

        found = dict(zip(grown := [n for n in names if made[n]], _together(find, grown)))
        _together(lambda n: state[n].grow(found[n]), grown)
        for n in set(names) - set(grown):
            state[n].new = 0
        stats += [IterationStats(number, iteration, n, s.new, s.rows, time.time() - began) for n, s in state.items()]
    return {n: s.full for n, s in state.items()}


def _composes_itself(decl: Decl, recursive: list[Rule]) -> bool:
    """Whether r(x, z) :- r(x, y), r(y, z) is all the recursion of a relation r without dependencies."""
    if decl.keys or len(recursive) != 1 or len(decl.columns) != 2 or len(set(decl.types)) != 1:
        return False
    rule = recursive[0]
    if len(rule.body) != 2 or [a.relation for a in rule.positive] != [decl.name] * 2 or not all(isinstance(t, Var) for a in (rule.head, *rule.positive) for t in a.terms):
        return False
    x, z = rule.head.terms
    return any(a.terms[0] == x and b.terms[1] == z and a.terms[1] == b.terms[0] and len({x, a.terms[1], z}) == 3 for a, b in (rule.positive, rule.positive[::-1]))


def _squared(number: int, decl: Decl, base: DataFrame, stats: list[IterationStats], most: int | None) -> DataFrame:
    """Closure of base under composition; round k finds the pairs of shortest distance over 2^(k-1), up to 2^k.

    A shortest path of such a length has a vertex 2^(k-1) from its start, so only pairs exactly that far
    apart (the last delta's, by their mark) are joined with all. Where no vertex has two successors, or none
    has two predecessors, a second walk between two vertices takes a cycle, and that shows as a pair
    (x, x) of the same or an earlier round: until one is seen, nothing is made twice.
    """
    pair = ["s", "d"]
    began = time.time()
    loops = F.count_if(F.col("s") == F.col("d"))
    far = edge = stored(base.toDF(*pair))
    new, looped = edge.agg(F.count("*"), loops).first()
    once = not looped and any(not edge.groupBy(c).agg(F.count("*").alias("n")).where("n > 1").head(1) for c in pair)
    parts, last, rows, iteration = [edge], edge.withColumn("far", F.lit(True)), new, 0
    stats.append(IterationStats(number, 0, decl.name, new, rows, time.time() - began))
    while new and (most is None or iteration < most):
        iteration += 1
        began = time.time()
        every = reduce(DataFrame.union, [*[p.withColumn("far", F.lit(False)) for p in parts[:-1]], last])
        made = far.toDF("s", "by").join(every.toDF("by", "d", "far"), "by").select("s", "d", "far")
        if once:
            last = stored(made)
            new, looped = last.agg(F.count("*"), loops).first()
            if looped:
                once = False
                drop(last)
        if not once:
            made = made.groupBy("s", "d").agg(F.bool_and("far").alias("far"))
            last = stored(_lacking(made, reduce(DataFrame.union, parts), pair, rows > LARGE and new <= FEW).select("s", "d", "far"))
            new = last.count()
        rows += new
        parts.append(last.select(*pair))
        stats.append(IterationStats(number, iteration, decl.name, new, rows, time.time() - began))
        old, far = far, stored(last.where("far").select(*pair))
        if old is not edge:
            drop(old)
    return reduce(DataFrame.union, parts).toDF(*decl.names)


def _together(function: Callable[[str], T], names: list[str]) -> list[T]:
    """Jobs of one round that don't read each other's results run side by side."""
    if len(names) < 2:
        return [function(n) for n in names]
    with ThreadPoolExecutor(len(names)) as pool:
        return list(pool.map(function, names))


def _variants(rule: Rule, decl: Decl, inside: set[str], state: dict[str, _Relation], known: dict[str, DataFrame]) -> list[DataFrame]:
    out = []
    for at, atom in enumerate(rule.positive):
        if atom.relation not in inside or not state[atom.relation].new:
            continue

        def read(a: Atom, k: int, at: int = at) -> DataFrame:
            if a.relation not in inside:
                return known[a.relation]
            return state[a.relation].delta if k == at else state[a.relation].full

        out.append(compile_rule(rule, decl, read, at))
    return out
