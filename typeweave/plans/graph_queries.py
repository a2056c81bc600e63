"""The engine's queries over the driver's tables, each with its SQL.

Nodes are region_<k>, nation_<k>, customer_<k>, supplier_<k>, part_<k>, order_<k>; edges are in_region,
in_nation, based_in, placed_by and contains, the last once for each pair of order and part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from typeweave.api import Graph
from typeweave.functions.types import shown_uid, type_uid
from typeweave.plans.inference import Constant
from typeweave.sources.relational import EdgeTable, NodeTable, graph_from_tables

CONTAINS_ORDER = ("l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")


#: Schemas of files that were read before, so that they are read once.
_SCHEMAS: dict[str, StructType] = {}


def _table(spark: SparkSession, path: str) -> DataFrame:
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def graph(spark: SparkSession, sf_dir: str, constants: list[Constant] | None = None, orders: bool = True) -> Graph:
    """The graph of the tables region, nation, customer, supplier, part, orders and lineitem."""
    table = lambda name: _table(spark, f"{sf_dir}/{name}.parquet")
    kinds = [("region", "region", "r_regionkey"), ("nation", "nation", "n_nationkey"), ("customer", "customer", "c_custkey"), ("supplier", "supplier", "s_suppkey")]
    kinds += [("part", "part", "p_partkey"), ("order", "orders", "o_orderkey")] if orders else []
    nodes = [NodeTable(kind, table(name), key) for kind, name, key in kinds]
    edges = [
        EdgeTable("in_region", "nation", "region", table("nation"), "n_nationkey", "n_regionkey", repeats=False),
        EdgeTable("in_nation", "customer", "nation", table("customer"), "c_custkey", "c_nationkey", repeats=False),
        EdgeTable("based_in", "supplier", "nation", table("supplier"), "s_suppkey", "s_nationkey", repeats=False),
    ]
    if orders:
        lines = table("lineitem").select("l_orderkey", "l_partkey", *CONTAINS_ORDER)
        edges += [EdgeTable("placed_by", "order", "customer", table("orders"), "o_orderkey", "o_custkey", repeats=False), EdgeTable("contains", "order", "part", lines, "l_orderkey", "l_partkey", CONTAINS_ORDER)]
    return graph_from_tables(spark, nodes, edges, constants)


def matched(*patterns: str, **columns: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query of MATCH clauses; columns gives output names their expressions over the variables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        query = graph(spark, sf_dir).query()
        for pattern in patterns:
            query.match(pattern)
        return query.to_df().selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of the nations of one region, with both names' uids."""
    return QUERIES["flagship_path"](spark, sf_dir)


def _var(kind: str, key: str) -> str:
    return f"sha256('var:{kind}_' || {key})"


def _arr(left: str, right: str) -> str:
    return f"sha256('arr:'::BLOB || unhex({left}) || ':'::BLOB || unhex({right}))"


#: SQL of the nodes' uids, and of the edges' ends, constants and properties.
_NODES = " UNION ALL ".join(f"SELECT {_var(k, c)} AS uid, '{k}' AS kind FROM {t}" for k, t, c in (("region", "region", "r_regionkey"), ("nation", "nation", "n_nationkey"), ("customer", "customer", "c_custkey"), ("supplier", "supplier", "s_suppkey"), ("part", "part", "p_partkey"), ("order", "orders", "o_orderkey")))
def _edge(constant: str, a: str, ak: str, b: str, bk: str, table: str) -> str:
    return f"SELECT DISTINCT {_var(a, ak)} AS s, {_var(b, bk)} AS e, '{constant}' AS c FROM {table}"


_IN_REGION = _edge("in_region", "nation", "n_nationkey", "region", "n_regionkey", "nation")
_IN_NATION = _edge("in_nation", "customer", "c_custkey", "nation", "c_nationkey", "customer")
_BASED_IN = _edge("based_in", "supplier", "s_suppkey", "nation", "s_nationkey", "supplier")
_PLACED_BY = _edge("placed_by", "order", "o_orderkey", "customer", "o_custkey", "orders")
_CONTAINS = _edge("contains", "order", "l_orderkey", "part", "l_partkey", "lineitem")
_EDGES = " UNION ALL ".join((_IN_REGION, _IN_NATION, _BASED_IN, _PLACED_BY, _CONTAINS))
_WITH = f"WITH n AS ({_NODES}), e AS ({_EDGES}) "
_N3 = type_uid("nation_3")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = query
    ORACLES[name] = sql


_add("flagship_path", matched("(c { kind: 'customer' })-[e]->(n)-[]->(r { r_name: 'ASIA' })", c_uid="c", n_uid="n"), f"SELECT {_var('customer', 'c_custkey')} AS c_uid, {_var('nation', 'n_nationkey')} AS n_uid FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
_add("node_scan", matched("(n)", uid="n"), _WITH + "SELECT uid FROM n")
_add("node_exact_type", matched("(n:nation_3)", uid="n"), _WITH + f"SELECT uid FROM n WHERE uid = '{_N3}'")
_add("node_type_capture", matched("(n:(X:*))", uid="n", x="X"), _WITH + "SELECT uid, uid AS x FROM n")
_add("node_prop_filter", matched("(n { kind: 'customer', c_mktsegment: 'BUILDING' })", uid="n"), f"SELECT {_var('customer', 'c_custkey')} AS uid FROM customer WHERE c_mktsegment = 'BUILDING'")
_add("node_prop_int", matched("(n { kind: 'part', p_size: 10 })", uid="n"), f"SELECT {_var('part', 'p_partkey')} AS uid FROM part WHERE p_size = 10")
_add("node_prop_float", matched("(n { p_retailprice: 900.0 })", uid="n"), f"SELECT {_var('part', 'p_partkey')} AS uid FROM part WHERE abs(p_retailprice - 900.0) < 2.220446049250313e-16")
_add("node_prop_type_strict", matched("(n { p_retailprice: 900 })", uid="n"), f"SELECT {_var('part', 'p_partkey')} AS uid FROM part WHERE false")
_add("node_prop_null", matched("(n { r_name: null })", uid="n"), f"SELECT {_var('region', 'r_regionkey')} AS uid FROM region WHERE false")
_add("node_prop_missing", matched("(n { no_such_key: 1 })", uid="n"), _WITH + "SELECT uid FROM n WHERE false")
_add("edge_prop_missing", matched("()-[e { no_such_key: 1 }]->()", s="e.start", e="e.end"), _WITH + "SELECT s, e FROM e")
_add("edge_prop_filter", matched("()-[e::@contains() { l_linenumber: 7 }]->()", s="e.start", e="e.end"), f"SELECT {_var('order', 'l_orderkey')} AS s, {_var('part', 'l_partkey')} AS e FROM lineitem GROUP BY l_orderkey, l_partkey HAVING max(l_linenumber) = 7")
_add("edge_scan", matched("(a)-[e]->(b)", a="a", s="e.start", e="e.end", b="b"), _WITH + "SELECT s AS a, s, e, e AS b FROM e")
_add("edge_backward", matched("(b)<-[e]-(a)", a="a", b="b", s="e.start"), _WITH + "SELECT s AS a, e AS b, s FROM e")
_add("edge_undirected", matched("(a)-[e]-(b)", a="a", b="b"), _WITH + "SELECT s AS a, e AS b FROM e UNION ALL SELECT e, s FROM e WHERE s <> e")
_add("edge_type_wildcard", matched("()-[e:*->nation_3]->()", s="e.start"), _WITH + f"SELECT s FROM e WHERE e = '{_N3}'")
_add("edge_type_capture", matched("()-[e:(X:*)->(Y:*)]->()", x="X", y="Y"), _WITH + "SELECT s AS x, e AS y FROM e")
_add("edge_type_whole_capture", matched("()-[e:(T:*)]->()", t="T", s="e.start"), _WITH + f"SELECT {_arr('s', 'e')} AS t, s FROM e")
_add("edge_type_name_never", matched("()-[e:nation_3]->()", s="e.start"), _WITH + "SELECT s FROM e WHERE false")
_add("edge_term_constant", matched("()-[e::@in_nation()]->()", s="e.start", e="e.end"), f"SELECT s, e FROM ({_IN_NATION})")
_add("edge_term_constant_arg", matched("()-[e::@in_nation((X:*), nation_3)]->()", x="X", e="e.end"), f"SELECT s AS x, e FROM ({_IN_NATION}) WHERE e = '{_N3}'")
_add("edge_term_var", matched("()-[e::t]->()", t="t", s="e.start"), _WITH + f"SELECT {_arr('s', 'e')} AS t, s FROM e")
_add("edge_term_wildcard", matched("()-[e::*]->()", s="e.start", e="e.end"), _WITH + "SELECT s, e FROM e")
_add("edge_term_bound", matched("()-[e::t]->()", "()-[f::t]->()", s="e.start", f="f.end"), _WITH + "SELECT s, e AS f FROM e")
_add("path_2hop", matched("(c)-[::@in_nation()]->(n)-[::@in_region()]->(r)", c="c", n="n", r="r"), f"SELECT a.s AS c, a.e AS n, b.e AS r FROM ({_IN_NATION}) a JOIN ({_IN_REGION}) b ON a.e = b.s")
_add("path_3hop", matched("(o)-[::@placed_by()]->(c)-[::@in_nation()]->(n)-[::@in_region()]->(r)", o="o", c="c", n="n", r="r"), f"SELECT o.s AS o, a.s AS c, a.e AS n, b.e AS r FROM ({_PLACED_BY}) o JOIN ({_IN_NATION}) a ON o.e = a.s JOIN ({_IN_REGION}) b ON a.e = b.s")
_add("path_mixed", matched("(a { kind: 'supplier' })-[]->(n)<-[::@based_in()]-(b)", a="a", n="n", b="b"), f"SELECT x.s AS a, x.e AS n, y.s AS b FROM ({_BASED_IN}) x JOIN ({_BASED_IN}) y ON x.e = y.e")
_add("chained_join", matched("(c)-[::@in_nation()]->(n)", "(n)-[::@in_region()]->(r { r_name: 'EUROPE' })", c="c", n="n"), f"SELECT a.s AS c, a.e AS n FROM ({_IN_NATION}) a JOIN ({_IN_REGION}) b ON a.e = b.s JOIN region ON b.e = {_var('region', 'r_regionkey')} WHERE r_name = 'EUROPE'")
_add("chained_cross", matched("(a { kind: 'region' })", "(b { kind: 'nation' })", a="a", b="b"), f"SELECT {_var('region', 'r_regionkey')} AS a, {_var('nation', 'n_nationkey')} AS b FROM region CROSS JOIN nation")
_add("bound_type_node", matched("()-[:(X:*)->region_1]->()", "(n:X)", n="n", x="X"), _WITH + f"SELECT s AS n, s AS x FROM e WHERE e = '{type_uid('region_1')}'")
_add("bound_edge", matched("()-[e::@in_region()]->()", "(a)-[e]->(b)", a="a", b="b"), f"SELECT s AS a, e AS b FROM ({_IN_REGION})")
_add("type_uid", matched("(n { kind: 'order' })", uid="n"), f"SELECT {_var('order', 'o_orderkey')} AS uid FROM orders")


def _arrow_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).frames().edges.where("t_name = 'placed_by'").select(shown_uid(F.col("type_uid")).alias("type_uid"), shown_uid(F.col("start_uid")).alias("start_uid"))


_add("arrow_uid", _arrow_uid, f"SELECT {_arr('s', 'e')} AS type_uid, s AS start_uid FROM ({_PLACED_BY})")


def _where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).query().match("(a)-[e::@in_nation()]->(b)").where(f"b = '{_N3}' OR startswith(a, 'a')").to_df("a", "b")


_add("where_clause", _where, f"SELECT s AS a, e AS b FROM ({_IN_NATION}) WHERE e = '{_N3}' OR starts_with(s, 'a')")


def _where_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    condition = "n.p_size > 40 XOR n.p_brand STARTS WITH 'Brand#1' OR NOT n.p_size >= 3"
    return graph(spark, sf_dir).query().match("(n { kind: 'part' })").where(condition).to_df("n")


_add("where_properties", _where_props, f"SELECT {_var('part', 'p_partkey')} AS n FROM part WHERE ((p_size > 40) <> starts_with(p_brand, 'Brand#1')) OR NOT p_size >= 3")


def _rendered(var: str, pattern: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: graph(spark, sf_dir).query().match(pattern).to_strings(var).withColumnRenamed(var, "shown")


_add("render_node", _rendered("n", "(n { kind: 'nation' })"), """SELECT 'Node(nation_' || n_nationkey || ': {kind: "nation", n_name: "' || n_name || '", n_nationkey: ' || n_nationkey || ', n_regionkey: ' || n_regionkey || '})' AS shown FROM nation""")
_add("render_edge", _rendered("e", "()-[e::@in_nation()]->()"), "SELECT 'Edge((customer_' || c_custkey || ' -> nation_' || c_nationkey || '):in_nation {})' AS shown FROM customer")


# changes


def _create_from_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir, [Constant("has", "(S:*) -> (T:*)")])
    g.query().match("(c:(X:*))-[::@in_nation()]->(n:(Y:*))").create("(n)-[::@has(Y, X) { made: true }]->(c)").execute()
    return g.query().match("(a)-[e::@has()]->(b)").to_df("a", "b")


_add("create_from_match", _create_from_match, f"SELECT e AS a, s AS b FROM ({_IN_NATION})")


def _create_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    g.query().match("(r:(X:*) { kind: 'region' })").match("(n:(Y:*) { kind: 'nation' })").create("(m:X -> Y { made: 1 })").execute()
    return g.query().match("(m:(X:*) -> (Y:*) { made: 1 })").to_df("m", "X", "Y").withColumnsRenamed({"X": "x", "Y": "y"})


_add("create_arrow_nodes", _create_nodes, f"SELECT {_arr('x', 'y')} AS m, x, y FROM (SELECT {_var('region', 'r_regionkey')} AS x FROM region) CROSS JOIN (SELECT {_var('nation', 'n_nationkey')} AS y FROM nation)")


def _create_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    g.query().match("(n:(X:*) { kind: 'nation' })").create("(:X { kind: 'changed' })").execute()
    return g.query().match("(n { kind: 'nation' })").to_df("n")


_add("create_dedup_first", _create_first, f"SELECT {_var('nation', 'n_nationkey')} AS n FROM nation")


def _edge_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).query().match("(a)-[e::@contains()]->(b)").to_table("e").select(F.col("e")["start_uid"].alias("s"), F.col("e")["end_uid"].alias("e"), F.element_at(F.col("e")["props"], "l_linenumber")["i"].alias("line"))


_add("edge_last_wins", _edge_last, f"SELECT {_var('order', 'l_orderkey')} AS s, {_var('part', 'l_partkey')} AS e, max(l_linenumber)::BIGINT AS line FROM lineitem GROUP BY l_orderkey, l_partkey")


def _propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms spread from one seeded supplier and one customer along their out-edges, to a nation and a region."""
    g = graph(spark, sf_dir, [Constant("seed", "customer_7")])
    g.query().match("(c:customer_7)").create("(:customer_7:@seed())").execute()
    return g.query().match("(n::t)").to_table("n").select(F.col("n")["uid"].alias("uid"), F.col("n")["term"].alias("term"))


_add(
    "propagate_terms",
    _propagate,
    _WITH.replace("WITH ", "WITH RECURSIVE ")
    + f", t(uid, term) AS (SELECT '{type_uid('customer_7')}', 'seed' UNION SELECT e.e, '(' || e.c || ' ' || t.term || ')' FROM t JOIN e ON e.s = t.uid) SELECT uid, term FROM t",
)


def _set(overwrite: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = graph(spark, sf_dir)
        g.query().match("(n { kind: 'nation', n_regionkey: 2 })").set("n", {"mark": "yes", "n_name": "?"}, overwrite).execute()
        props = F.col("n")["props"]
        df = g.query().match("(n)").to_table("n").where(F.coalesce(F.element_at(props, "mark")["s"], F.lit("")) == "yes")
        return df.select(F.col("n")["uid"].alias("uid"), F.size(props).cast("bigint").alias("size"), F.element_at(props, "n_name")["s"].alias("n_name"), F.element_at(props, "n_regionkey")["i"].alias("region"))

    return run


_add("set_overwrite", _set(True), f"SELECT {_var('nation', 'n_nationkey')} AS uid, 2::BIGINT AS size, '?' AS n_name, NULL::BIGINT AS region FROM nation WHERE n_regionkey = 2")
_add("set_merge", _set(False), f"SELECT {_var('nation', 'n_nationkey')} AS uid, 5::BIGINT AS size, '?' AS n_name, n_regionkey::BIGINT AS region FROM nation WHERE n_regionkey = 2")


def _set_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    g.query().match("()-[e:*->region_2]->()").set("e", {"mark": 1}).execute()
    return g.query().match("()-[e::@in_region()]->()").to_table("e").where(F.element_at(F.col("e")["props"], "mark")["i"] == 1).select(F.col("e")["start_uid"].alias("s"))


_add("set_edge", _set_edges, f"SELECT {_var('nation', 'n_nationkey')} AS s FROM nation WHERE n_regionkey = 2")


def _bulk_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    g.set_node_properties({type_uid(f"nation_{k}"): {"mark": k} for k in range(5)})
    return g.query().match("(n)").to_table("n").select(F.col("n")["uid"].alias("uid"), F.element_at(F.col("n")["props"], "mark")["i"].alias("mark")).where("mark IS NOT NULL")


_add("bulk_set", _bulk_set, f"SELECT {_var('nation', 'n_nationkey')} AS uid, n_nationkey::BIGINT AS mark FROM nation WHERE n_nationkey < 5")


def _remove_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    g.query().match("(n { kind: 'nation', n_regionkey: 1 })").remove("n").execute()
    nodes = g.query().match("(n)").to_df("n").select(F.lit("node").alias("what"), F.col("n").alias("uid"))
    return nodes.unionByName(g.query().match("()-[e]->()").to_df("e").select(F.lit("edge").alias("what"), F.col("e.start").alias("uid")))


_GONE = f"(SELECT {_var('nation', 'n_nationkey')} FROM nation WHERE n_regionkey = 1)"
_add("remove_node_detach", _remove_node, _WITH + f"SELECT 'node' AS what, uid FROM n WHERE uid NOT IN {_GONE} UNION ALL SELECT 'edge', s FROM e WHERE s NOT IN {_GONE} AND e NOT IN {_GONE}")


def _remove_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    g.query().match("()-[e::@based_in()]->()").remove("e").execute()
    return g.query().match("()-[e]->()").to_df("e").select(F.col("e.start").alias("s"), F.col("e.end").alias("e"))


_add("remove_edge", _remove_edge, _WITH + "SELECT s, e FROM e WHERE c <> 'based_in'")


# terms, inference and merging


SEED = Constant("seed", "(S:*)")


def _seeded(spark: SparkSession, sf_dir: str, kind: str, *constants: Constant) -> Graph:
    """The graph, in which each node of a kind has been given the term seed, which has spread."""
    g = graph(spark, sf_dir, [SEED, *constants])
    g.query().match(f"(n:(X:*) {{ kind: '{kind}' }})").create("(:X:@seed(X))").execute()
    return g


def _terms(g: Graph) -> DataFrame:
    return g.query().match("(n::*)").to_table("n").select(F.col("n")["uid"].alias("uid"), F.col("n")["term"].alias("term"))


_add("seeded_terms", lambda spark, sf_dir: _terms(_seeded(spark, sf_dir, "nation")), f"SELECT {_var('nation', 'n_nationkey')} AS uid, 'seed' AS term FROM nation UNION ALL SELECT DISTINCT e, '(in_region seed)' FROM ({_IN_REGION})")


def _application(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeded(spark, sf_dir, "nation").query().match("(n::f x)").to_df("n", "f", "x")


_add("node_term_application", _application, f"SELECT e AS n, {_arr('s', 'e')} AS f, s AS x FROM (SELECT e, min(s) AS s FROM ({_IN_REGION}) GROUP BY e)")


def _term_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second term for nodes that have one, and for others."""
    g = _seeded(spark, sf_dir, "nation", Constant("other", "(S:*)"))
    for kind in ("nation", "supplier"):
        g.query().match(f"(n:(X:*) {{ kind: '{kind}' }})").create("(:X:@other(X))").execute()
    return g.query().match("(n::@seed())").match("(m::@other())").to_df("n", "m")


_add("node_term_kept", _term_kept, f"SELECT {_var('nation', 'n_nationkey')} AS n, {_var('supplier', 's_suppkey')} AS m FROM nation CROSS JOIN supplier")


def _type_term_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeded(spark, sf_dir, "region").query().match("(n:(X:*):@seed((Y:*)) { r_name: 'ASIA' })").to_df("n", "X", "Y").withColumnsRenamed({"X": "x", "Y": "y"})


_add("node_type_term_props", _type_term_props, f"SELECT {_var('region', 'r_regionkey')} AS n, {_var('region', 'r_regionkey')} AS x, {_var('region', 'r_regionkey')} AS y FROM region WHERE r_name = 'ASIA'")


def _spread_on_new_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New edges from nodes with a term to one that has none: the smallest start gives it its term."""
    g = _seeded(spark, sf_dir, "region", Constant("made_in", "(S:*) -> (T:*)"))
    g.query().match("(r:(X:*) { kind: 'region' })").match("(p:(Y:*) { kind: 'part', p_size: 7 })").create("(r)-[::@made_in(X, Y)]->(p)").execute()
    return g.query().match("(p::f x { kind: 'part' })").to_df("p", "x")


_add("spread_on_new_edge", _spread_on_new_edge, f"SELECT {_var('part', 'p_partkey')} AS p, (SELECT min({_var('region', 'r_regionkey')}) FROM region) AS x FROM part WHERE p_size = 7")


def _inferred(*clauses: tuple[str, str], constants: tuple[Constant, ...] = (), seed: str | None = None, shown: str) -> Callable[[SparkSession, str], DataFrame]:
    """Clauses over the graph, then the ends, term and properties of the edges that a pattern finds."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = _seeded(spark, sf_dir, seed, *constants) if seed else graph(spark, sf_dir, list(constants))
        query = g.query()
        for clause, pattern in clauses:
            getattr(query, clause)(pattern)
        query.execute()
        e = F.col("e")
        return Graph.from_frames(spark, g.frames(), list(g.constants.values()), strict_edge_props=True).query().match(shown).to_table("e").select(e["start_uid"].alias("s"), e["end_uid"].alias("e"), e["term"].alias("term"), F.size(e["props"]).cast("bigint").alias("n_props"))

    return run


_TO = Constant("to", "(S:*) -> (T:*)")
_R1 = type_uid("region_1")
_NATIONS = f"SELECT {_var('nation', 'n_nationkey')} AS s, '{_R1}' AS e, 'to' AS term, 0::BIGINT AS n_props FROM nation"
_add("create_node_term_by_constant", _inferred(("match", "(n:(X:*) { kind: 'nation' })"), ("create", "(:X -> region_1)"), constants=(Constant("to", "(S:*) -> region_1"),), shown="()-[e::@to()]->()"), _NATIONS + " WHERE n_regionkey <> 1")
_add("create_node_type_by_term", _inferred(("match", "(n:(X:*) { kind: 'nation' })"), ("create", "(m::@to(X, region_1))"), constants=(_TO,), shown="()-[e::@to()]->()"), _NATIONS + " WHERE n_regionkey <> 1")
_add("create_nodes_by_edge", _inferred(("match", "(n:(X:*) { kind: 'nation' })"), ("create", "()-[::@to(X, region_1)]->()"), constants=(_TO,), shown="()-[e::@to()]->()"), _NATIONS)
_add("create_edge_by_ends", _inferred(("match", "(n { kind: 'nation' })"), ("create", "(:region_1)<-[]-(n)"), constants=(_TO,), shown="()-[e::@to()]->()"), _NATIONS)
_add("create_edge_term_by_ends", _inferred(("match", "(n { kind: 'nation' })-[]->(r)"), ("create", "(n)-[{ again: 1 }]->(r)"), constants=(_TO,), seed="nation", shown="()-[e { again: 1 }]->()"), f"SELECT s, e, CASE WHEN s = min(s) OVER (PARTITION BY e) THEN 'in_region' ELSE 'seed' END AS term, 1::BIGINT AS n_props FROM ({_IN_REGION})")
_add("create_edge_again", _inferred(("match", "(n:(X:*))-[::@in_nation()]->(m:(Y:*))"), ("create", "(n)-[::@to(X, Y) { again: 1 }]->(m)"), constants=(_TO,), shown="({ kind: 'customer' })-[e]->()"), f"SELECT s, e, 'to' AS term, 1::BIGINT AS n_props FROM ({_IN_NATION})")


def _loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir, [_TO])
    g.query().match("(n:(X:*) { kind: 'supplier' })").create("(n)-[::@to(X, X)]->(n)").execute()
    return g.query().match("(n)-[e]->(n)").to_df("n")


_add("path_cycle", _loops, f"SELECT {_var('supplier', 's_suppkey')} AS n FROM supplier")


def _same_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    g.query().match("(n:(X:*) { kind: 'region' })").match("(m:(Y:*) { kind: 'region' })").create("(:X -> Y)").execute()
    return g.query().match("(n:(T:*) -> T)").to_df("n", "T").withColumnRenamed("T", "t")


_add("node_type_same_sides", _same_sides, f"SELECT {_arr('t', 't')} AS n, t FROM (SELECT {_var('region', 'r_regionkey')} AS t FROM region)")


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists and dicts with floats inside, which are compared within epsilon; truth values."""
    g = graph(spark, sf_dir)
    g.query().match("(n { kind: 'nation', n_regionkey: 1 })").set("n", {"l": [0.1 + 0.2, "x", {"k": [1.5]}], "ok": True}).execute()
    g.query().match("(n { kind: 'nation', n_regionkey: 2 })").set("n", {"l": [0.3, "x", {"k": [1.25]}], "ok": True}).execute()
    return g.query().match("(n { l: [0.3, 'x', { k: [1.5] }], ok: true })").to_df("n")


_add("node_prop_nested", _nested, f"SELECT {_var('nation', 'n_nationkey')} AS n FROM nation WHERE n_regionkey = 1")


def _bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("large", F.col("p_size") > 25)
    return graph_from_tables(spark, [NodeTable("part", parts, "p_partkey")], []).query().match("(n { large: true })").to_df("n")


_add("node_prop_bool", _bool, f"SELECT {_var('part', 'p_partkey')} AS n FROM part WHERE p_size > 25")


def _bulk_set_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    made = {(r["n"], r["r"]): {"mark": 1.5} for r in g.query().match("(n)-[::@in_region()]->(r:region_3)").to_df("n", "r").collect()}
    g.set_edge_properties(made, overwrite=False)
    return g.query().match("()-[e::@in_region()]->()").to_table("e").where(F.element_at(F.col("e")["props"], "mark")["d"] == 1.5).select(F.col("e")["start_uid"].alias("s"))


_add("bulk_set_edges", _bulk_set_edges, f"SELECT {_var('nation', 'n_nationkey')} AS s FROM nation WHERE n_regionkey = 3")


def _single_creates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph made by single CREATEs on the driver, as its elements show themselves."""
    g = Graph([Constant("in", "(S:*) -> (T:*)"), Constant("top", "region_0")], spark)
    for row in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey").collect():
        g.query().create(f"(:nation_{row[0]} {{ key: {row[0]} }})-[::@in(nation_{row[0]}, region_{row[1]}) {{ w: 0.5 }}]->(:region_{row[1]})").execute()
    rows = [(str(x), str(x.type()), str(x.term())) for x in [*g.nodes(), *g.edges()]]
    return spark.createDataFrame(rows, "shown string, type string, term string")


_add(
    "single_creates",
    _single_creates,
    """SELECT 'Node(nation_' || n_nationkey || ': {key: ' || n_nationkey || '})' AS shown, 'nation_' || n_nationkey AS type, 'None' AS term FROM nation
UNION ALL SELECT DISTINCT 'Node(region_' || n_regionkey || ':' || CASE WHEN n_regionkey = 0 THEN 'top' ELSE '' END || ' {})', 'region_' || n_regionkey, CASE WHEN n_regionkey = 0 THEN 'top' ELSE 'None' END FROM nation
UNION ALL SELECT 'Edge((nation_' || n_nationkey || ' -> region_' || n_regionkey || '):in {w: 0.5})', '(nation_' || n_nationkey || ' -> region_' || n_regionkey || ')', 'in' FROM nation""",
)


def _bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of error a clause raises, and that it has changed nothing."""
    rows = []
    for clause, pattern in BAD_CLAUSES:
        g = Graph([Constant("to", "(S:*) -> (T:*)"), Constant("one", "A -> B")], spark)
        try:
            getattr(g.query(), clause)(pattern).execute()
            rows.append((pattern, None, len(g.nodes())))
        except (TypeError, ValueError, KeyError) as error:
            rows.append((pattern, next(k.__name__ for k in (KeyError, TypeError, ValueError) if isinstance(error, k)), len(g.nodes())))
    return spark.createDataFrame(rows, "pattern string, error string, n_nodes bigint")


#: Patterns that can't be read or carried out: brackets, names, paths; wildcards, schemas that don't fit, unknown constants.
BAD_CLAUSES = [("match", p) for p in ("(n", "(n]", "(1n)", "(None)", "(a)(b)", "(a)-[]->", "-[]->(a)", "(a:A:b:c)", "(a { k })", "(a)-[e]=>(b)", "")]
BAD_CLAUSES += [("create", p) for p in ("(:*)", "()", "(:A)-[::@to(A, B)]-(:B)", "(::@to(A))", "(:B)-[::@one()]->(:A)", "(:A)-[:A -> B:@to(B, A)]->(:B)", "(n:A:@one())", "(::@none())", "(:A)-[::t]->(:C)")]
_ERRORS = {"(:B)-[::@one()]->(:A)": "TypeError", "(::@none())": "KeyError", "(:A)-[:A -> B:@to(B, A)]->(:B)": "ValueError"}
_add("clause_errors", _bad, " UNION ALL ".join(f"SELECT '{p}' AS pattern, '{_ERRORS.get(p, 'ValueError')}' AS error, 0::BIGINT AS n_nodes" for _, p in BAD_CLAUSES))


def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of all clauses as text, and the names that the package exports."""
    import typeweave

    q = Graph([], spark).query().match("(n:A)-[e]->(m)").where("n.k > 1").create("(:B { k: 1 })").set("n", {"k": "x", "l": [1, 2.5]}).set("e", {"k": None}, False).remove("n", "e")
    return spark.createDataFrame([(line,) for line in [*str(q).splitlines(), *sorted(typeweave.__all__)]], "line string")


_add("query_text", _text, "SELECT unnest(['MATCH (n:A)-[e]->(m)', 'WHERE n.k > 1', 'CREATE (:B { k: 1 })', 'SET n = {k: \"x\", l: [1, 2.5]}', 'SET e += {k: ()}', 'REMOVE n, e', 'Constant', 'Edge', 'Element', 'Graph', 'Node', 'Query', 'Term', 'Type']) AS line")
