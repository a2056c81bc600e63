"""Graphs in tables: the same results as on the driver, plans, snapshots and the driver's queries."""

import random

import pytest

import __spark_entry__
from typeweave import Constant, Graph
from typeweave.functions.types import apply, base, read_term, read_type, show_term, show_type, type_uid, write_term
from typeweave.plans import graph_queries
from typeweave.plans.inference import match_term, match_type
from typeweave.plans.match import Matcher
from typeweave.plans.patterns import parse_path
from typeweave.sources import relational
from typeweave.streaming.ingest import match_stream

SF = "/root/testdata/sf0.001"
CONSTANTS = [Constant("f", "(A:*)->(B:*)"), Constant("a", "A"), Constant("g", "A -> (A -> B)")]


def shown(graph):
    return sorted(map(str, graph.nodes())), sorted(map(str, graph.edges()))


@pytest.mark.parametrize(
    "steps",
    [
        [("create", "(:A:@a() {p: 1})"), ("create", "(:A -> B)"), ("create", "()-[e::@g()]->()")],
        [("create", "(n:C {x: 'y'})-[e::@f(C, D) {w: 1}]->(m:D)"), ("match", "(k:C)-[e]->(m)"), ("set", "e", {"v": [1, 2]}, False), ("remove", "m")],
    ],
)
def test_tables_do_what_the_driver_does(spark, steps):
    graphs = [Graph(CONSTANTS, spark), Graph(CONSTANTS, spark)]
    graphs[1].to_tables()
    for graph in graphs:
        query = graph.query()
        for name, *args in steps:
            getattr(query, name)(*args)
        query.execute()
    assert shown(graphs[0]) == shown(graphs[1])


def test_rows_of_matches_are_created_in_tables(spark):
    graphs = []
    for tables in (False, True):
        graph = Graph(CONSTANTS[:1], spark)
        for name in "ABC":
            graph.query().create(f"(:{name} {{ n: '{name}' }})").execute()
        graph.query().create("()-[::@f(A, B)]->()").create("()-[::@f(B, C)]->()").execute()
        if tables:
            graph.to_tables()
        found = graph.query().match("(x:(X:*))-[]->(y:(Y:*))").create("(y)-[e::@f(Y, X) { back: true }]->(x)").return_("x", "e", "Y")
        graphs.append((sorted(tuple(map(str, r.values())) for r in found), shown(graph)))
    assert graphs[0] == graphs[1]


def test_a_failed_creation_leaves_tables_alone(spark):
    graph = Graph([Constant("f", "A -> B")], spark)
    graph.query().create("(:A)-[::@f()]->(:B)").execute()
    graph.to_tables()
    before = shown(graph)
    with pytest.raises(Exception, match="not that of its ends"):
        graph.query().match("(n)").create("(:B)-[::@f()]->(:A)").execute()
    assert shown(graph) == before


@pytest.mark.parametrize(
    "match, create",
    [
        ("(x:(X:*))-[]->(y:(Y:*))", "(:Hub)<-[::@k(X, Hub) { of: 1 }]-(x)"),  # several rows make one node and give it terms
        ("(x:(X:*))-[e]->(y:(Y:*))", "(x)-[{ again: true }]->(y)"),  # the term of an edge from the terms of its ends, or a constant
        ("(x::t)", "(::t)"),
        ("(x:(X:*))", "(z:X -> Far)"),  # nodes whose terms are edges, with ends that are made
        ("()-[e::t]->()", "()-[d::t { copy: 1 }]->()"),
        ("(x::f a)", "(p::a)-[::f]->(q)"),
    ],
)
def test_both_stores_take_the_same_of_many_rows(spark, match, create):
    constants = [Constant("s", "T1"), Constant("far", "(P:*) -> Far"), Constant("k", "(A:*) -> (B:*)")]
    graphs = [Graph(constants, spark), Graph(constants, spark)]
    for graph in graphs:
        for a, b in ((1, 2), (2, 3), (1, 4), (4, 3), (3, 5)):
            graph.query().create(f"()-[::@k(T{a}, T{b})]->()").execute()
        graph.query().create("(:T1:@s())").execute()
    graphs[1].to_tables()
    found = []
    for graph in graphs:
        try:
            rows = graph.query().match(match).create(create).to_df()
            found.append(sorted(map(str, rows.collect())))
        except (ValueError, TypeError) as error:
            found.append(str(error))
    assert found[0] == found[1]
    assert shown(graphs[0]) == shown(graphs[1])


def test_terms_spread_along_chains_in_tables(spark):
    graphs = []
    for tables in (False, True):
        graph = Graph([Constant("k", "(A:*) -> (B:*)"), Constant("s", "T0")], spark)
        for n in range(1, 7):
            graph.query().create(f"(:T{n})").create(f"()-[::@k(T{n}, T{n + 1})]->()").execute()
        if tables:
            graph.to_tables()
        graph.query().create("(:T0)").create("()-[::@k(T0, T1)]->()").execute()
        graphs.append(shown(graph))
    assert graphs[0] == graphs[1] and "Node(T7:(k (k (k (k (k (k (k s))))))) {})" in graphs[0][0]


# a brute-force matcher


def brute(store, path, rows):
    """All bindings of a path, by trying every node and edge."""

    def node(p, uid, row):
        row = dict(row)
        if p.var in row:
            if row[p.var] != ("node", uid):
                return None
        if p.type:
            row = match_type(store.types[uid], p.type, row)
            if row is None:
                return None
        if p.term:
            if uid not in store.terms:
                return None
            row = match_term(store.terms[uid], p.term, row, store.constants)
            if row is None:
                return None
        return row | {p.var: ("node", uid)} if p.var else row

    out = []
    for row in rows:
        now = [(uid, got) for uid in store.nodes if (got := node(path.nodes[0], uid, row)) is not None]
        for e, p in zip(path.edges, path.nodes[1:]):
            following = []
            for at, row2 in now:
                for s, t in store.edges:
                    ends = {"forward": {(s, t)}, "backward": {(t, s)}, "any": {(s, t), (t, s)}}[e.direction]
                    for near, far in ends:
                        if near != at:
                            continue
                        got = dict(row2)
                        if e.type:
                            got = match_type((store.types[s], store.types[t]), e.type, got)
                        if got is not None and e.term:
                            got = match_term(store.terms[store.edge_type((s, t))], e.term, got, store.constants)
                        if got is not None and e.var:
                            got = None if got.get(e.var, ("edge", (s, t))) != ("edge", (s, t)) else got | {e.var: ("edge", (s, t))}
                        if got is not None and (got := node(p, far, got)) is not None:
                            following.append((far, got))
            now = following
        out += [row for _, row in now]
    return out


PATTERNS = [
    ["(n:(X:*) -> (Y:*))"],
    ["(n:(X:*) -> X)"],
    ["(n::t)"],
    ["(n::f x)"],
    ["(a)-[e]->(b)-[d]->(c)"],
    ["(a)-[e]-(b)<-[d]-(c)"],
    ["(a:T0)-[e:(X:*) -> *:t]->(b)"],
    ["(a)-[e::@k((X:*), T1)]->(b)"],
    ["(a)-[e]->(a)"],
    ["(a)-[e]->(b)", "(b)-[d]->(a)"],
    ["(:(X:*))", "(n:X -> *)"],
    ["(a)-[e]->(b)", "(c)-[e]-(d)"],
    ["(a:(X:*))", "(b:X)-[e:X -> (Y:*)]->(c)"],
]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_against_brute_force(spark, seed):
    rng = random.Random(seed)
    graph = Graph([Constant("k", "(A:*) -> (B:*)"), Constant("c", "T0")], spark)
    names = ["T0", "T1", "T2", "T0 -> T1", "T1 -> T1", "(T0 -> T1) -> T2"]
    for name in names:
        graph.query().create(f"(:{name})").execute()
    for _ in range(9):
        graph.query().create(f"()-[::@k({rng.choice(names)}, {rng.choice(names)})]->()").execute()
    store = graph.store
    for clauses in PATTERNS:
        query, rows = graph.query(), [{}]
        for text in clauses:
            query.match(text)
            rows = brute(store, parse_path(text), rows)
        plain = lambda kind, v: type_uid(v) if kind == "type" else type_uid(v[-1]) if kind == "term" else v
        wanted = sorted(tuple(sorted((n, str(plain(*kv))) for n, kv in row.items())) for row in rows)
        got = sorted(tuple(sorted((n, str(tuple(v) if hasattr(v, "asDict") else v)) for n, v in r.asDict().items())) for r in query.to_df().collect())
        assert got == wanted, clauses


# plans


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_constants_and_kinds_prune_branches(spark):
    graph = graph_queries.graph(spark, SF)
    plan = plan_of(graph.query().match("(c)-[::@in_nation()]->(n)").to_df("n"))
    assert "c_nationkey" in plan and "l_partkey" not in plan and "o_custkey" not in plan and "s_nationkey" not in plan
    plan = plan_of(graph.query().match("(c { kind: 'customer', c_mktsegment: 'BUILDING' })").to_df())
    assert "c_mktsegment" in plan and "p_name" not in plan and "PushedFilters: [IsNotNull(c_custkey), IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)]" in plan


def test_ground_types_and_known_nodes_need_no_joins(spark, tmp_path):
    relational.save(graph_queries.graph(spark, SF, orders=False), str(tmp_path))
    graph = relational.load(spark, str(tmp_path), graph_queries.graph(spark, SF, orders=False).constants.values())
    plan = plan_of(graph.query().match("(n:nation_3)").to_df())
    assert "Join" not in plan and "EqualTo(uid," in plan and type_uid("nation_3").upper() in plan
    plan = plan_of(graph.query().match("()-[e:nation_3 -> region_1]->()").to_df("e"))
    assert "Join" not in plan and "EqualTo(end_uid," in plan
    plan = plan_of(graph.query().match("(c)-[]->(n)-[]->(r { r_name: 'ASIA' })").to_df())
    assert plan.count("Join") == 2 and plan.count("FileScan") == 3 and "NestedLoop" not in plan
    plan = plan_of(graph.query().match("()-[e::@in_region()]->()").match("(a)-[e]->(b)").to_df())
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    plan = plan_of(graph.query().match("(:nation_3)-[]->(n)").match("(n)-[]->(m)").to_df())
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_strictness_changes_edges_only(spark):
    frames = graph_queries.graph(spark, SF, orders=False).frames()
    rows = Matcher(frames, {}, strict_edge_props=True).match(parse_path("()-[e { no: 1 }]->()"), graph_rows())
    assert rows.df.count() == 0


def graph_rows():
    from typeweave.plans.match import Rows

    return Rows()


# sources


def test_snapshots(spark, tmp_path):
    graph = Graph(CONSTANTS, spark)
    graph.query().create("(:A:@a() { l: [1, { k: 'v' }], n: null })").create("()-[::@g() { w: 0.5 }]->()").execute()
    relational.save(graph, str(tmp_path))
    again = relational.load(spark, str(tmp_path), CONSTANTS)
    assert shown(again) == shown(graph)
    assert again.query().match("(n:A)").return_("n")[0]["n"].properties() == {"l": [1, {"k": "v"}], "n": None}


def test_relational_rows_with_nulls_and_repeats(spark):
    people = spark.createDataFrame([(1, "x", True, 1.5), (2, None, None, None)], "id long, name string, ok boolean, score double")
    knows = spark.createDataFrame([(1, 2, 5), (1, 2, 7), (2, None, 1), (2, 1, 1)], "a long, b long, since int")
    graph = relational.graph_from_tables(spark, [relational.NodeTable("p", people, "id")], [relational.EdgeTable("knows", "p", "p", knows, "a", "b", ("since",))])
    assert sorted(map(str, graph.edges())) == ["Edge((p_1 -> p_2):knows {since: 7})", "Edge((p_2 -> p_1):knows {since: 1})"]
    assert len(graph.query().match("(n { ok: true, score: 1.5, kind: 'p' })").return_("n")) == 1
    assert graph.query().match("(n { name: null })").return_("n") == []


def test_relational_pairs_without_an_order_and_null_keys(spark):
    people = spark.createDataFrame([(1, "x"), (None, "y")], "id long, name string")
    likes = spark.createDataFrame([(1, 1), (1, 1), (None, 1)], "a long, b long")
    node, edge = relational.NodeTable("p", people, "id"), relational.EdgeTable("likes", "p", "p", likes, "a", "b")
    graph = relational.graph_from_tables(spark, [node], [edge])
    assert shown(graph) == (['Node(p_1: {id: 1, kind: "p", name: "x"})'], ["Edge((p_1 -> p_1):likes {})"])
    with pytest.raises(ValueError):
        relational.graph_from_tables(spark, [node], [edge, relational.EdgeTable("hates", "p", "p", likes, "a", "b")])


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, 2), (2, 3)], "a long, b long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a long, b long").parquet(str(tmp_path / "in"))
    got = []

    def graph_of(batch):
        ends = batch.select("a").union(batch.select("b")).distinct()
        return relational.graph_from_tables(batch.sparkSession, [relational.NodeTable("k", ends, "a")], [relational.EdgeTable("next", "k", "k", batch, "a", "b")])

    query = match_stream(stream, graph_of, "(x)-[]->(y)-[]->(z)", ("x", "y", "z"), lambda df, n: got.extend(df.collect()), str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in got] == [tuple(type_uid(f"k_{k}") for k in (1, 2, 3))]


# trees


def test_types_and_terms_survive_writing():
    t = (("A", "B"), ("C", ("D", "A")))
    assert read_type(show_type(t)) == t and show_type(t) == "((A -> B) -> (C -> (D -> A)))"
    term = apply(apply(base("f", ("A", ("B", "C"))), base("a", "A")), base("b", "B"))
    assert read_term(write_term(term)) == term and show_term(term) == "((f a) b)"
    with pytest.raises(TypeError):
        apply(base("f", ("A", "B")), base("c", "C"))


# the driver's contract


def test_every_query_has_sql_and_runs():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)
    assert set(graph_queries.QUERIES) == set(graph_queries.ORACLES) <= set(queries)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 26


@pytest.mark.parametrize("name", ["node_prop_filter", "edge_type_whole_capture", "path_3hop", "path_mixed", "edge_undirected", "set_merge", "remove_node_detach", "propagate_terms"])
def test_queries_against_sql(spark, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    ours = graph_queries.QUERIES[name](spark, SF)
    columns = sorted(ours.columns)
    theirs = con.execute(graph_queries.ORACLES[name]).fetchdf()[columns]
    key = lambda row: tuple(map(str, row))
    got = sorted(map(key, ours.select(*columns).fillna(-1).toPandas().itertuples(index=False)))
    wanted = sorted(map(key, theirs.fillna(-1).astype(ours.select(*columns).fillna(-1).toPandas().dtypes.to_dict()).itertuples(index=False)))
    assert got == wanted



# families of types


def test_families_are_told_alike_by_types_and_columns(spark):
    from pyspark.sql import functions as F

    from typeweave.functions.types import family, family_column

    cases = {"nation_3": "nation", "a_b_-12": "a_b", "Alice": "", "x_": "", ("nation_3", "region_1"): "nation -> region", ("Alice", "region_1"): " -> ", (("a_1", "b_2"), "c_3"): " -> "}
    found = spark.createDataFrame([(show_type(t),) for t in cases], "shown string").select(family_column(F.col("shown"))).collect()
    assert [family(t) for t in cases] == [row[0] for row in found] == list(cases.values())


def read_files(df):
    """The tables that a plan reads."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    own = df._jdf.queryExecution().executedPlan().toString()
    return {name for name in ("customer", "supplier", "part", "orders", "lineitem", "nation", "region") if f"{SF}/{name}.parquet" in plan + own}


@pytest.mark.parametrize("name", ["flagship_path", "path_mixed", "propagate_terms", "create_edge_again", "node_term_kept"])
def test_plans_read_only_tables_of_fitting_families(spark, name):
    found = read_files(__spark_entry__.queries()[name](spark, SF))
    assert not found & {"lineitem", "orders", "part"}


def test_creations_read_only_tables_of_their_families(spark, monkeypatch):
    from typeweave.operators import tables

    read, kept = set(), tables.saved

    def saved(df, name):
        read.update(read_files(df))
        return kept(df, name)

    monkeypatch.setattr(tables, "saved", saved)
    graph = graph_queries.graph(spark, SF, [Constant("to", "(S:*) -> region_1")])
    graph.query().match("(n:(X:*) { kind: 'nation' })").create("(:X -> region_1)").execute()
    assert read and not read & {"lineitem", "orders", "part"}
    changed = graph.frames().parts
    assert set(changed["edges"]) == set(graph_queries.graph(spark, SF).frames().parts["edges"])


def test_paths_against_edges_go_in_pieces(spark, monkeypatch):
    from typeweave.plans import match

    found = []
    for size in (1000, 2):
        monkeypatch.setattr(match, "PIECE", size)
        df = __spark_entry__.queries()["path_mixed"](spark, SF)
        found.append((sorted(df.collect()), "pmod" in df._jdf.queryExecution().executedPlan().toString()))
    assert found[0][0] == found[1][0] and found[0][0] and found[1][1]
