"""Registered queries of the relational and recursive operators, with equivalent SQL.

The recursive inputs are graphs of bounded components derived from the tables, so results grow
linearly with the data.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaloop.functions.session import checkpoint_dir
from deltaloop.operators import closure as C
from deltaloop.operators import relational as R
from deltaloop.plans.parser import parse_program
from deltaloop.sources.readers import load_inputs, read_csv, read_edge_list, read_table
from deltaloop.sources.sinks import write_delimited

Query = Callable[[SparkSession, str], DataFrame]

# ---------------------------------------------------------------- inputs


def _part(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey")


def edge_tree(spark: SparkSession, sf: str) -> DataFrame:
    return _part(spark, sf).where("p_partkey % 64 > 1").selectExpr("(p_partkey div 64) * 64 + (p_partkey % 64) div 2 AS s", "p_partkey AS d")


def edge_dag(spark: SparkSession, sf: str) -> DataFrame:
    more = _part(spark, sf).where("p_partkey % 64 > 2").selectExpr("(p_partkey div 64) * 64 + (p_partkey % 64 - 1) div 2 AS s", "p_partkey AS d")
    return R.union(edge_tree(spark, sf), more)


def edge_cyc(spark: SparkSession, sf: str) -> DataFrame:
    back = _part(spark, sf).where("p_partkey % 64 = 40").selectExpr("p_partkey AS s", "(p_partkey div 64) * 64 + 1 AS d")
    return R.union(edge_tree(spark, sf), back)


def edge_week(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("user_id", F.date_trunc("week", "ts")).orderBy("ts", "event_id")
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts")
    return events.select(F.col("event_id").alias("s"), F.lead("event_id").over(by).alias("d")).where("d IS NOT NULL")


def assign(spark: SparkSession, sf: str) -> DataFrame:
    return _part(spark, sf).where("p_partkey % 5 <> 0").selectExpr("p_partkey AS s", "(p_partkey div 16) * 16 + (p_partkey % 16) div 2 AS d")


def dereference(spark: SparkSession, sf: str) -> DataFrame:
    return _part(spark, sf).where("p_partkey % 4 = 0").selectExpr("p_partkey AS s", "(p_partkey div 16) * 16 + (p_partkey * 5 + 1) % 16 AS d")


TREE_SQL = "SELECT (p_partkey // 64) * 64 + (p_partkey % 64) // 2 AS s, p_partkey AS d FROM part WHERE p_partkey % 64 > 1"
DAG_SQL = f"{TREE_SQL} UNION SELECT (p_partkey // 64) * 64 + (p_partkey % 64 - 1) // 2, p_partkey FROM part WHERE p_partkey % 64 > 2"
CYC_SQL = f"{TREE_SQL} UNION SELECT p_partkey, (p_partkey // 64) * 64 + 1 FROM part WHERE p_partkey % 64 = 40"
WEEK_SQL = """SELECT s, d FROM (SELECT event_id AS s, lead(event_id) OVER
 (PARTITION BY user_id, date_trunc('week', ts) ORDER BY ts, event_id) AS d FROM events) WHERE d IS NOT NULL"""
ASSIGN_SQL = "SELECT p_partkey AS s, (p_partkey // 16) * 16 + (p_partkey % 16) // 2 AS d FROM part WHERE p_partkey % 5 <> 0"
DEREF_SQL = "SELECT p_partkey AS s, (p_partkey // 16) * 16 + (p_partkey * 5 + 1) % 16 AS d FROM part WHERE p_partkey % 4 = 0"

# ---------------------------------------------------------------- single-shot operators


def scan_edges(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, f"{sf}/lineitem.parquet", ["l_partkey", "l_suppkey"]).toDF("s", "d")


def project_swap(spark: SparkSession, sf: str) -> DataFrame:
    return R.project(edge_dag(spark, sf), {"a": "d", "b": "s"})


def project_diagonal(spark: SparkSession, sf: str) -> DataFrame:
    return R.project(edge_dag(spark, sf), {"a": "s", "b": "s"})


def project_const(spark: SparkSession, sf: str) -> DataFrame:
    return R.project(edge_dag(spark, sf), {"s": "s", "d": "d", "len": F.lit(1).cast("bigint"), "next": F.col("d") + 1})


def filter_neq(spark: SparkSession, sf: str) -> DataFrame:
    return R.project(dereference(spark, sf), {"s": "s", "d": "d"}, F.col("s") != F.col("d"))


def join_two_hop(spark: SparkSession, sf: str) -> DataFrame:
    edge = edge_week(spark, sf)
    return R.join(edge, edge, [("d", "s")], {"s": "l.s", "d": "r.d"})


def join_self_sibling(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey").where("o_custkey IS NOT NULL")
    return R.join(orders, orders, [("o_custkey", "o_custkey")], {"x": "l.o_orderkey", "y": "r.o_orderkey"}, F.col("x") != F.col("y"))


def join_three_way(spark: SparkSession, sf: str) -> DataFrame:
    edge = edge_dag(spark, sf)
    two = R.join(edge, edge, [("d", "s")], {"s": "l.s", "d": "r.d"}, distinct=False)
    return R.join(two, edge, [("d", "s")], {"s": "l.s", "d": "r.d"})


def union_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return R.union(edge_tree(spark, sf), edge_dag(spark, sf), edge_cyc(spark, sf))


def bag_append(spark: SparkSession, sf: str) -> DataFrame:
    return R.append(edge_tree(spark, sf), edge_cyc(spark, sf)).groupBy("s", "d").agg(F.count("*").alias("n"))


def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    return R.difference(edge_dag(spark, sf), edge_tree(spark, sf))


def anti_join_negation(spark: SparkSession, sf: str) -> DataFrame:
    program = parse_program(".decl edge(s:number, d:number)\n.decl leaf(v:number)\nleaf(y) :- edge(_, y), !edge(y, _).")
    return program.facts("edge", edge_dag(spark, sf)).run(spark)["leaf"]


def cross_join_body(spark: SparkSession, sf: str) -> DataFrame:
    program = parse_program(".decl n(a:symbol)\n.decl r(b:symbol)\n.decl pair(a:symbol, b:symbol)\npair(x, y) :- n(x), r(y).")
    program.facts("n", spark.read.parquet(f"{sf}/nation.parquet").select("n_name"))
    program.facts("r", spark.read.parquet(f"{sf}/region.parquet").select("r_name"))
    return program.run(spark)["pair"]


def semi_naive_step(spark: SparkSession, sf: str) -> DataFrame:
    edge = edge_dag(spark, sf)
    return R.step(edge, edge, edge)


# ---------------------------------------------------------------- recursion


def tc_linear(spark: SparkSession, sf: str) -> DataFrame:
    return C.closure(edge_dag(spark, sf))["path"]


def tc_nonlinear(spark: SparkSession, sf: str) -> DataFrame:
    return C.closure(edge_week(spark, sf), doubling=True)["path"]


def tc_cyclic(spark: SparkSession, sf: str) -> DataFrame:
    return C.closure(edge_cyc(spark, sf), doubling=True)["path"]


def reach_from_source(spark: SparkSession, sf: str) -> DataFrame:
    roots = _part(spark, sf).where("p_partkey % 64 = 3").selectExpr("p_partkey AS v")
    return C.reach(edge_cyc(spark, sf), roots)["reach"]


def sg_init(spark: SparkSession, sf: str) -> DataFrame:
    edge = edge_dag(spark, sf)
    return R.join(edge, edge, [("s", "s")], {"x": "l.d", "y": "r.d"}, F.col("x") != F.col("y"))


def sg(spark: SparkSession, sf: str) -> DataFrame:
    return C.same_generation(edge_tree(spark, sf))["sg"]


def sg_dag(spark: SparkSession, sf: str) -> DataFrame:
    return C.same_generation(edge_dag(spark, sf))["sg"]


def path_length(spark: SparkSession, sf: str) -> DataFrame:
    return C.path_length(edge_dag(spark, sf))["path"]


def path_length_cyclic(spark: SparkSession, sf: str) -> DataFrame:
    return C.path_length(edge_cyc(spark, sf))["path"]


def dependent_min(spark: SparkSession, sf: str) -> DataFrame:
    program = parse_program(".decl edge(s:number, d:number)\n.decl low(v:number, m:number)")
    program.declare("low", ["v", "m"], key=["v"], merge="min")
    program.rule("low(x, y) :- edge(x, y). low(x, m) :- edge(x, y), low(y, m).")
    return program.facts("edge", edge_cyc(spark, sf)).run(spark)["low"]


def _alias(relation: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return C.alias_analysis(assign(spark, sf), dereference(spark, sf))[relation]

    return query


def max_iteration_bound(spark: SparkSession, sf: str) -> DataFrame:
    return C.closure(edge_week(spark, sf), max_iterations=3)["path"]


def spanning_tree(spark: SparkSession, sf: str) -> DataFrame:
    start = _part(spark, sf).where("p_partkey % 64 = 1").selectExpr("p_partkey AS v")
    return C.spanning_forest(edge_dag(spark, sf), start, root=-1)["tree"]


def matching_degrees(spark: SparkSession, sf: str) -> DataFrame:
    """A maximal matching of parts and suppliers, by what it covers."""
    edge = scan_edges(spark, sf)
    return C.matching_report(edge, C.matching(edge))


def ranked_regions(spark: SparkSession, sf: str) -> DataFrame:
    """An order found by two functional dependencies, by its counts."""
    ranks = C.ranking(spark.read.parquet(f"{sf}/region.parquet").select("r_name"))
    return ranks.agg(F.count("*").alias("n"), F.count_distinct("item").alias("items"), F.count_distinct("rank").alias("ranks"), F.min("rank").alias("first"), F.max("rank").alias("last"))


def dependent_max(spark: SparkSession, sf: str) -> DataFrame:
    program = parse_program(".decl edge(s:number, d:number)\n.decl high(v:number, m:number)")
    program.declare("high", ["v", "m"], key=["v"], merge="max")
    program.rule("high(x, y) :- edge(x, y). high(x, m) :- edge(x, y), high(y, m).")
    return program.facts("edge", edge_cyc(spark, sf)).run(spark)["high"]


def nullary_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Whether there is a loop, in a graph with loops."""
    program = parse_program(".decl edge(s:number, d:number)\n.decl loop()\nloop() :- edge(x, x).")
    return program.facts("edge", assign(spark, sf)).run(spark)["loop"].toDF("holds")


def facts_in_text(spark: SparkSession, sf: str) -> DataFrame:
    program = parse_program(".decl next(a:number, b:number)\n.decl later(a:number, b:number)\nnext(1, 2). next(2, 3). next(3, 4).\nlater(a, b) :- next(a, b).\nlater(a, c) :- later(a, b), next(b, c).")
    return program.run(spark)["later"]


def empty_side(spark: SparkSession, sf: str) -> DataFrame:
    """A join with an empty relation gives nothing, and a negated empty one everything."""
    program = parse_program(".decl edge(s:number, d:number)\n.decl none(v:number)\n.decl both(s:number)\n.decl free(s:number)\nboth(x) :- edge(x, y), none(y).\nfree(x) :- edge(x, _), !none(x).")
    got = program.facts("edge", edge_dag(spark, sf)).run(spark)
    return got["both"].agg(F.count("*").alias("joined")).crossJoin(got["free"].agg(F.count("*").alias("free")))


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/deltaloop-files-{uuid.uuid4().hex}"


def text_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges written as text with commas and read again, some lines being none."""
    path = f"{_folder(spark)}/edges.txt"
    edge = edge_dag(spark, sf)
    lines = edge.select(F.concat_ws(",", "s", "d").alias("value"))
    odd = spark.createDataFrame([("17",), ("a,b",), ("",)], "value string")
    lines.union(lines).union(odd).write.text(path)
    return read_edge_list(spark, path)


def facts_directory(spark: SparkSession, sf: str) -> DataFrame:
    """An input directive reads a fact directory, an output directive writes a file, which is read again."""
    folder = _folder(spark)
    write_delimited(edge_dag(spark, sf), f"{folder}/edge.facts")
    program = parse_program(".decl edge(s:number, d:number)\n.input edge\n.decl two(s:number, d:number)\n.output two(filename=\"two.csv\", delimiter=\",\")\n.printsize two\ntwo(x, z) :- edge(x, y), edge(y, z).")
    load_inputs(spark, program, folder)
    program.write(program.run(spark), folder)
    return read_csv(spark, f"{folder}/two.csv", ["s", "d"], ",")


def csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The reader's row limit, and how many rows a whole file has."""
    path = f"{_folder(spark)}/edges.csv"
    write_delimited(edge_dag(spark, sf), path)
    some = read_csv(spark, path, ["s", "d"], rows=10).agg(F.count("*").alias("limited"))
    return some.crossJoin(read_csv(spark, path, ["s", "d"]).agg(F.count("*").alias("every")))


def long_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Closure of one chain of events a user: paths of up to about a hundred hops."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts")
    edge = events.select(F.col("event_id").alias("s"), F.lead("event_id").over(by).alias("d")).where("d IS NOT NULL")
    return C.closure(edge, doubling=True)["path"]


def hub_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Shortest paths where one vertex has an edge to every block: a hub in every round."""
    hub = _part(spark, sf).where("p_partkey % 64 = 1").selectExpr("CAST(-1 AS BIGINT) AS s", "p_partkey AS d")
    return C.path_length(R.union(edge_tree(spark, sf), hub))["path"]


# ---------------------------------------------------------------- SQL


def _closure_sql(edge: str) -> str:
    return f"WITH RECURSIVE e(s, d) AS ({edge}), p(s, d) AS (SELECT s, d FROM e UNION SELECT e.s, p.d FROM e JOIN p ON e.d = p.s) SELECT s, d FROM p"


def _sg_sql(edge: str) -> str:
    return f"""WITH RECURSIVE e(s, d) AS ({edge}), g(x, y) AS (
 SELECT a.d, b.d FROM e a JOIN e b ON a.s = b.s WHERE a.d <> b.d
 UNION SELECT a.d, b.d FROM e a JOIN g ON a.s = g.x JOIN e b ON b.s = g.y) SELECT x, y FROM g"""


def _length_sql(edge: str) -> str:
    return f"""WITH RECURSIVE e(s, d) AS ({edge}), p(s, d, l) USING KEY (s, d) AS (
 SELECT s, d, CAST(1 AS BIGINT) FROM e
 UNION SELECT e.s, p.d, min(p.l + 1) FROM e JOIN p ON e.d = p.s
 WHERE NOT EXISTS (SELECT 1 FROM recurring.p q WHERE q.s = e.s AND q.d = p.d) GROUP BY 1, 2) SELECT s, d, l FROM p"""


def _alias_sql(tag: str) -> str:
    variants = [
        "SELECT 'vf', x.a, y.b FROM r x JOIN recurring.r y ON x.b = y.a WHERE x.t = 'vf' AND y.t = 'vf'",
        "SELECT 'vf', y.a, x.b FROM r x JOIN recurring.r y ON y.b = x.a WHERE x.t = 'vf' AND y.t = 'vf'",
        "SELECT 'vf', z.s, x.b FROM r x JOIN asg z ON z.d = x.a WHERE x.t = 'ma'",
        "SELECT 'va', x.b, y.b FROM r x JOIN recurring.r y ON x.a = y.a WHERE x.t = 'vf' AND y.t = 'vf'",
        "SELECT 'va', y.b, x.b FROM r x JOIN recurring.r y ON x.a = y.a WHERE x.t = 'vf' AND y.t = 'vf'",
        "SELECT 'va', x.b, w.b FROM r x JOIN recurring.r m ON m.a = x.a JOIN recurring.r w ON w.a = m.b WHERE x.t = 'vf' AND m.t = 'ma' AND w.t = 'vf'",
        "SELECT 'va', v.b, w.b FROM r x JOIN recurring.r v ON v.a = x.a JOIN recurring.r w ON w.a = x.b WHERE x.t = 'ma' AND v.t = 'vf' AND w.t = 'vf'",
        "SELECT 'va', v.b, x.b FROM r x JOIN recurring.r m ON m.b = x.a JOIN recurring.r v ON v.a = m.a WHERE x.t = 'vf' AND m.t = 'ma' AND v.t = 'vf'",
        "SELECT 'ma', y.d, z.d FROM r x JOIN der y ON y.s = x.a JOIN der z ON z.s = x.b WHERE x.t = 'va'",
    ]
    made = " UNION ".join(variants)
    return f"""WITH RECURSIVE asg AS ({ASSIGN_SQL}), der AS ({DEREF_SQL}), r(t, a, b) USING KEY (t, a, b) AS (
 SELECT 'vf', s, d FROM asg UNION SELECT 'vf', s, s FROM asg UNION SELECT 'vf', d, d FROM asg
 UNION SELECT 'ma', s, s FROM asg UNION SELECT 'ma', d, d FROM asg
 UNION SELECT n.t, n.a, n.b FROM ({made}) n(t, a, b)
 WHERE NOT EXISTS (SELECT 1 FROM recurring.r o WHERE o.t = n.t AND o.a = n.a AND o.b = n.b))
 SELECT a AS s, b AS d FROM r WHERE t = '{tag}'"""


QUERIES: dict[str, Query] = {
    "scan_edges": scan_edges, "project_swap": project_swap, "project_diagonal": project_diagonal,
    "project_const": project_const, "filter_neq": filter_neq, "join_two_hop": join_two_hop,
    "join_self_sibling": join_self_sibling, "join_three_way": join_three_way, "union_dedup": union_dedup,
    "bag_append": bag_append, "set_difference": set_difference, "anti_join_negation": anti_join_negation,
    "cross_join_body": cross_join_body, "semi_naive_step": semi_naive_step, "tc_linear": tc_linear,
    "tc_nonlinear": tc_nonlinear, "tc_cyclic": tc_cyclic, "reach_from_source": reach_from_source,
    "sg_init": sg_init, "sg": sg, "sg_dag": sg_dag, "path_length": path_length,
    "path_length_cyclic": path_length_cyclic, "dependent_min": dependent_min,
    "cspa_value_flow": _alias("value_flow"), "cspa_memory_alias": _alias("memory_alias"),
    "cspa_value_alias": _alias("value_alias"), "max_iteration_bound": max_iteration_bound,
    "spanning_tree": spanning_tree, "matching_degrees": matching_degrees, "ranked_regions": ranked_regions,
    "dependent_max": dependent_max, "nullary_heads": nullary_heads, "facts_in_text": facts_in_text,
    "empty_side": empty_side, "text_edges": text_edges, "facts_directory": facts_directory, "csv_rows": csv_rows,
    "long_chains": long_chains, "hub_lengths": hub_lengths,
}

ORACLE: dict[str, str] = {
    "scan_edges": "SELECT DISTINCT l_partkey AS s, l_suppkey AS d FROM lineitem",
    "project_swap": f"SELECT DISTINCT d AS a, s AS b FROM ({DAG_SQL})",
    "project_diagonal": f"SELECT DISTINCT s AS a, s AS b FROM ({DAG_SQL})",
    "project_const": f"SELECT DISTINCT s, d, CAST(1 AS BIGINT) AS len, d + 1 AS next FROM ({DAG_SQL})",
    "filter_neq": f"SELECT DISTINCT s, d FROM ({DEREF_SQL}) WHERE s <> d",
    "join_two_hop": f"WITH e AS ({WEEK_SQL}) SELECT DISTINCT a.s, b.d FROM e a JOIN e b ON a.d = b.s",
    "join_self_sibling": "SELECT DISTINCT a.o_orderkey AS x, b.o_orderkey AS y FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderkey <> b.o_orderkey",
    "join_three_way": f"WITH e AS ({DAG_SQL}) SELECT DISTINCT a.s, c.d FROM e a JOIN e b ON a.d = b.s JOIN e c ON b.d = c.s",
    "union_dedup": f"{TREE_SQL} UNION ({DAG_SQL}) UNION ({CYC_SQL})",
    "bag_append": f"SELECT s, d, count(*) AS n FROM (({TREE_SQL}) UNION ALL ({CYC_SQL})) GROUP BY 1, 2",
    "set_difference": f"({DAG_SQL}) EXCEPT ({TREE_SQL})",
    "anti_join_negation": f"WITH e AS ({DAG_SQL}) SELECT DISTINCT d AS v FROM e WHERE d NOT IN (SELECT s FROM e)",
    "cross_join_body": "SELECT DISTINCT n_name AS a, r_name AS b FROM nation, region",
    "semi_naive_step": f"WITH e AS ({DAG_SQL}) SELECT a.s, b.d FROM e a JOIN e b ON a.d = b.s EXCEPT SELECT s, d FROM e",
    "tc_linear": _closure_sql(DAG_SQL),
    "tc_nonlinear": _closure_sql(WEEK_SQL),
    "tc_cyclic": _closure_sql(CYC_SQL),
    "reach_from_source": f"WITH RECURSIVE e(s, d) AS ({CYC_SQL}), r(v) AS (SELECT p_partkey FROM part WHERE p_partkey % 64 = 3 UNION SELECT e.d FROM r JOIN e ON e.s = r.v) SELECT v FROM r",
    "sg_init": f"WITH e AS ({DAG_SQL}) SELECT DISTINCT a.d AS x, b.d AS y FROM e a JOIN e b ON a.s = b.s WHERE a.d <> b.d",
    "sg": _sg_sql(TREE_SQL),
    "sg_dag": _sg_sql(DAG_SQL),
    "path_length": _length_sql(DAG_SQL),
    "path_length_cyclic": _length_sql(CYC_SQL),
    "dependent_min": f"WITH RECURSIVE e(s, d) AS ({CYC_SQL}), p(s, d) AS (SELECT s, d FROM e UNION SELECT e.s, p.d FROM e JOIN p ON e.d = p.s) SELECT s AS v, min(d) AS m FROM p GROUP BY 1",
    "cspa_value_flow": _alias_sql("vf"),
    "cspa_memory_alias": _alias_sql("ma"),
    "cspa_value_alias": _alias_sql("va"),
    "max_iteration_bound": f"WITH RECURSIVE e(s, d) AS ({WEEK_SQL}), p(s, d, n) AS (SELECT s, d, 0 FROM e UNION SELECT e.s, p.d, n + 1 FROM e JOIN p ON e.d = p.s WHERE n < 3) SELECT DISTINCT s, d FROM p",
    "spanning_tree": f"""WITH RECURSIVE e(s, d) AS ({DAG_SQL}), t(child, parent) USING KEY (child) AS (
 SELECT p_partkey, CAST(-1 AS BIGINT) FROM part WHERE p_partkey % 64 = 1
 UNION SELECT e.d, min(e.s) FROM t JOIN e ON e.s = t.child WHERE NOT EXISTS (SELECT 1 FROM recurring.t q WHERE q.child = e.d) GROUP BY e.d) SELECT child, parent FROM t""",
    "matching_degrees": "SELECT count(*) AS edges, count(*) AS covered, CAST(0 AS BIGINT) AS matched_twice, CAST(0 AS BIGINT) AS no_edge FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)",
    "ranked_regions": "SELECT count(*) AS n, count(*) AS items, count(*) AS ranks, CAST(1 AS BIGINT) AS first, count(*) AS last FROM (SELECT DISTINCT r_name FROM region)",
    "dependent_max": f"WITH RECURSIVE e(s, d) AS ({CYC_SQL}), p(s, d) AS (SELECT s, d FROM e UNION SELECT e.s, p.d FROM e JOIN p ON e.d = p.s) SELECT s AS v, max(d) AS m FROM p GROUP BY 1",
    "nullary_heads": f"SELECT true AS holds WHERE EXISTS (SELECT 1 FROM ({ASSIGN_SQL}) WHERE s = d)",
    "facts_in_text": "SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM (VALUES (1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)) v(a, b)",
    "empty_side": f"SELECT CAST(0 AS BIGINT) AS joined, count(DISTINCT s) AS free FROM ({DAG_SQL})",
    "text_edges": DAG_SQL,
    "facts_directory": f"WITH e AS ({DAG_SQL}) SELECT DISTINCT a.s, b.d FROM e a JOIN e b ON a.d = b.s",
    "csv_rows": f"SELECT CAST(10 AS BIGINT) AS limited, count(*) AS every FROM ({DAG_SQL})",
    "long_chains": "WITH o AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT a.event_id AS s, b.event_id AS d FROM o a JOIN o b ON a.user_id = b.user_id AND a.k < b.k",
    "hub_lengths": _length_sql(f"{TREE_SQL} UNION SELECT CAST(-1 AS BIGINT), p_partkey FROM part WHERE p_partkey % 64 = 1"),
}
