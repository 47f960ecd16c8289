"""Ready-made recursive queries, most of them as grammars of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloop.functions.columns import col
from deltaloop.functions.session import stored
from deltaloop.operators.choice import choose
from deltaloop.operators.grammar import path_program
from deltaloop.operators.relational import join
from deltaloop.plans.fixpoint import Result
from deltaloop.plans.model import Program


def closure(edge: DataFrame, doubling: bool = False, max_iterations: int | None = None) -> Result:
    """Transitive closure. Doubling squares the path relation each round: for graphs of long diameter."""
    program = path_program(["edge"], "path = edge | path path" if doubling else "path = edge | edge path")
    return program.facts("edge", edge).run(edge.sparkSession, max_iterations)


def reach(edge: DataFrame, source: DataFrame) -> Result:
    """Vertices that a path from a source ends in, sources included."""
    program = Program().declare("edge", ["s", "d"]).declare("source", ["v"]).declare("reach", ["v"])
    program.rule("reach(v) :- source(v). reach(d) :- reach(s), edge(s, d).")
    return program.facts("edge", edge).facts("source", source).run(edge.sparkSession)


def same_generation(edge: DataFrame) -> Result:
    """Pairs at the same depth under a common ancestor; the pairs right under one vertex are different ones."""
    e = edge.toDF("s", "d").distinct()
    sibling = join(e, e, [("s", "s")], {"s": "l.d", "d": "r.d"}, col("s") != col("d"))
    program = path_program(["edge", "sibling"], "sg = sibling | ~edge sg edge").facts("edge", e).facts("sibling", sibling)
    result = program.run(edge.sparkSession)
    result.frames["sg"] = result["sg"].toDF("x", "y")
    return result


def path_length(edge: DataFrame) -> Result:
    """Fewest hops between every connected pair, cycles included: the first round that finds a pair finds its length."""
    program = Program().declare("edge", ["s", "d"]).declare("path", ["s", "d", "l"], key=["s", "d"])
    program.rule("path(s, d, 1) :- edge(s, d). path(s, t, l + 1) :- path(s, d, l), edge(d, t).")
    return program.facts("edge", edge).run(edge.sparkSession)


def alias_analysis(assign: DataFrame, dereference: DataFrame) -> Result:
    """Pointer aliases as paths: after Zheng and Rugina, "Demand-driven alias analysis for C", 2008.

    A value flows along assignments, from the assigned variable to the source, and through memory that
    two expressions share; two expressions have one value if it flows to both of them from the same place or
    from places that share memory; two dereferences share memory if their pointers have one value.
    Every assigned or assigning variable has its own value and memory.

    Values are not part of the recursion, which needs them only where they are dereferenced: a target is what
    a vertex's value is dereferenced to, and targets of one vertex, or of two that share memory, do. A vertex
    with itself is left out of the recursion too, as it would make every row again.
    """
    grammar = """
    flow = assign | flow flow | assign alias
    target = self dereference | flow dereference
    alias = ~target target | ~target alias target
    value_flow = self | flow
    memory_alias = self | alias
    value_alias = ~value_flow value_flow | ~value_flow alias value_flow
    """
    program = path_program(["assign", "dereference"], grammar, reflexive={"self": "assign"})
    return program.facts("assign", assign).facts("dereference", dereference).run(assign.sparkSession)


def spanning_forest(edge: DataFrame, start: DataFrame, root: int) -> Result:
    """A parent for every vertex that is reached from a start, the first one found (of one round the smallest); root is the starts' own."""
    program = Program().declare("edge", ["s", "d"]).declare("start", ["v"]).declare("tree", ["child", "parent"], key=["child"])
    program.rule(f"tree(v, {root}) :- start(v). tree(d, s) :- tree(s, _), edge(s, d).")
    return program.facts("edge", edge).facts("start", start).run(edge.sparkSession)


def matching(edge: DataFrame) -> DataFrame:
    """A maximal set of edges of which no two share a left end (a) or a right end (b)."""
    return choose(edge.toDF("a", "b").dropna(how="any").distinct(), [("a",), ("b",)])


def matching_report(edge: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row: edges, those with an end that is matched, ends matched more than once, chosen rows that are no edge."""
    edge, chosen = edge.toDF("a", "b").dropna(how="any").distinct(), stored(chosen.toDF("a", "b"))
    side = lambda c: chosen.groupBy(c).agg(F.count("*").alias("n"))
    marked = edge.join(side("a").select("a", F.lit(1).alias("left")), "a", "left").join(side("b").select("b", F.lit(1).alias("right")), "b", "left")
    covered = marked.agg(F.count("*").alias("edges"), F.count(F.coalesce("left", "right")).alias("covered"))
    twice = side("a").where("n > 1").select("n").unionAll(side("b").where("n > 1").select("n")).agg(F.count("*").alias("matched_twice"))
    foreign = chosen.join(edge, ["a", "b"], "left_anti").agg(F.count("*").alias("no_edge"))
    return covered.crossJoin(twice).crossJoin(foreign)  # one row each


def ranking(items: DataFrame) -> DataFrame:
    """(item, rank): an order of the items. Each has one rank and each rank one item; ranks follow one another from 1."""
    kind = items.schema.fields[0].dataType.simpleString()
    program = Program().declare("item", [("item", kind)])
    program.decls |= Program().rule(f".decl place(item:{'symbol' if kind == 'string' else 'number'}, rank:number) choice-domain item, rank").decls
    program.rule("place(x, 1) :- item(x). place(y, r + 1) :- place(_, r), item(y).")
    return program.facts("item", items).run(items.sparkSession)["place"]
