"""Hand-built graphs: patterns, paths, writes, schema, search, concepts, against answers worked out by hand."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalar as S
from graphloom.operators import algorithms as A
from graphloom.operators import find as Find
from graphloom.operators import paths as P
from graphloom.operators import search
from graphloom.operators import traverse as T
from graphloom.operators import write as W
from graphloom.operators.match import Match
from graphloom.plans.concepts import Model, close, trait_violations
from graphloom.plans.graph import Graph, GraphError, prop
from graphloom.plans.session import Session
from graphloom.sources import csv
from graphloom.streaming.ingest import ingest_relationships

EDGES = "id long, src long, dst long, weight double"


@pytest.fixture(scope="module")
def people(spark):
    g = Graph(spark).create_node_type("Person", {"name": "string", "age": "integer", "tags": "string_list"}).create_relationship_type("FRIEND", {"since": "integer"}, "Person", "Person").create_relationship_type("KNOWS", {}, "Person", "Person")
    rows = [(1, "alice", "Alice", 30), (2, "bob", "Bob", 35), (3, "carol", "Carol", None), (4, "dave", "Dave", 30)]
    g = W.insert_nodes(g, "Person", spark.createDataFrame(rows, "id long, key string, name string, age long"))
    g = W.insert_relationships(g, "FRIEND", spark.createDataFrame([(10, 1, 2, 2020), (11, 2, 3, 2021), (12, 3, 1, 2022), (13, 1, 1, 2023), (14, 1, 2, 2024)], "id long, src long, dst long, since long"))
    return W.insert_relationships(g, "KNOWS", spark.createDataFrame([(20, 2, 4), (21, 4, 4)], "id long, src long, dst long"))


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_expand_keeps_parallel_edges_and_lists_a_loop_once(people):
    out = Match(people).node("a", "Person").expand("a", "FRIEND", "b", "Person")
    assert pairs(out.select("a__id", "b__id")) == [(1, 1), (1, 2), (1, 2), (2, 3), (3, 1)]
    both = Match(people).node("a", "Person", name="Alice").expand("a", "FRIEND", "b", "Person", direction="any")
    assert pairs(both.select("b__id")) == [(1,), (2,), (2,), (3,)]


def test_different_edges_and_repeatable_elements(people):
    start = Match(people).node("a", "Person", name="Alice")
    path = lambda m: m.expand("a", "FRIEND", "b", "Person").expand("b", "FRIEND", "c", "Person", direction="in")
    assert pairs(path(start).select("b__id", "c__id")) == [(1, 3), (2, 1), (2, 1)]
    assert path(start.repeat_elements()).rows.count() == 6


def test_optional_exists_and_count(people):
    g = Match(people)
    friends = g.node("a", "Person").expand("a", "FRIEND", "b", "Person", where=F.col("age") > 30)
    assert pairs(g.node("a", "Person").optional(friends).select("a__id", "b__id").na.fill(0)) == [(1, 2), (1, 2), (2, 0), (3, 0), (4, 0)]
    assert pairs(g.node("a", "Person").exists(friends).select("a__id")) == [(1,)]
    assert pairs(g.node("a", "Person").not_exists(friends).select("a__id")) == [(2,), (3,), (4,)]
    assert pairs(g.node("a", "Person").count("n", friends).select("a__id", "n")) == [(1, 2), (2, 0), (3, 0), (4, 0)]
    assert pairs(g.node("a", "Person").flag("f", friends).select("a__id", "f")) == [(1, True), (2, False), (3, False), (4, False)]


def test_missing_properties_and_truth(people):
    g = Match(people).node("a", "Person")
    assert pairs(g.where(prop("a", "age") < 100).select("a__id")) == [(1,), (2,), (4,)]
    assert pairs(g.where(S.not_(prop("a", "age") > 30)).select("a__id")) == [(1,), (3,), (4,)]
    assert g.where(S.any_of(prop("a", "age") > 30, prop("a", "age").isNull())).rows.count() == 2
    assert g.where(S.all_of(prop("a", "age") >= 30, prop("a", "name") != "Bob")).rows.count() == 2


def test_unknown_names_raise(people):
    with pytest.raises(GraphError):
        Match(people).node("a", "Robot")
    with pytest.raises(GraphError):
        people.rel_frame("HATES")
    with pytest.raises(GraphError):
        Match(people).node("a", "Person").expand("z", "FRIEND", "b", "Person")


def test_schema_changes(people, spark):
    g = people.add_property("Person", "score", "double").drop_property("Person", "age")
    assert g.property_types("Person") == {"name": "string", "tags": "string_list", "score": "double"}
    with pytest.raises(GraphError):
        people.add_property("Person", "key", "string")
    with pytest.raises(GraphError):
        people.create_node_type("Person")
    assert people.drop_node_type("Person").rel_frame("FRIEND").count() == 0
    assert "KNOWS" not in people.drop_relationship_type("KNOWS").rels
    assert pairs(people.node_counts()) == [("Person", 4)]
    assert pairs(people.relationship_counts()) == [("FRIEND", 5), ("KNOWS", 2)]
    assert [r.id for r in people.all_nodes("Person", 1, 2).collect()] == [2, 3]


def test_writes_are_checked_and_leave_the_old_graph(people, spark):
    with pytest.raises(GraphError, match="taken"):
        W.insert_nodes(people, "Person", spark.createDataFrame([(9, "bob")], "id long, key string"))
    with pytest.raises(GraphError, match="takes"):
        W.insert_nodes(people, "Person", spark.createDataFrame([(9, "eve", "old")], "id long, key string, age string"))
    adults = people.create_constraint("adult", lambda g: g.nodes["Person"].where("age < 18"))
    with pytest.raises(GraphError, match="adult"):
        W.update_where(adults, "Person", F.col("key") == "bob", age=F.lit(3))
    assert pairs(adults.nodes["Person"].where("key = 'bob'").select("age")) == [(35,)]
    g = W.delete_nodes(people, "Person", spark.createDataFrame([(2,)], "id long"))
    assert pairs(g.rel_frame("FRIEND").select("id")) == [(12,), (13,)] and pairs(g.rel_frame("KNOWS").select("id")) == [(21,)]
    g = W.set_properties(people, "Person", spark.createDataFrame([(1, "Al"), (2, None)], "id long, name string"))
    assert pairs(g.nodes["Person"].select("id", F.coalesce("name", F.lit("-")), "age").where("id < 3")) == [(1, "Al", 30), (2, "-", 35)]
    g = W.set_properties(people, "Person", spark.createDataFrame([(1, "Al")], "id long, name string"), merge=False)
    assert g.nodes["Person"].where("id = 1").first().age is None
    with pytest.raises(GraphError, match="read-only"):
        W.set_properties(people, "Person", spark.createDataFrame([(1, "x")], "id long, key string"))
    with pytest.raises(GraphError, match="contradicting"):
        W.set_properties(people, "Person", spark.createDataFrame([(1, "x"), (1, "y")], "id long, name string"))
    assert W.delete_relationships(people, "FRIEND", spark.createDataFrame([(10,)], "id long")).rel_frame("FRIEND").count() == 4
    assert W.remove_properties(people, "FRIEND", spark.createDataFrame([(10,)], "id long"), "since").rel_frame("FRIEND").where("since IS NULL").count() == 1


def test_view_works_as_a_label(people):
    g = people.create_view("Thirty", lambda g: g.nodes["Person"].where("age = 30"))
    assert pairs(Match(g).node("x", "Thirty").expand("x", "FRIEND", "y", "Person").select("x__id", "y__id")) == [(1, 1), (1, 2), (1, 2)]
    with pytest.raises(GraphError):
        g.create_view("Person", lambda g: g.nodes["Person"])


def test_traversal(people, spark):
    ids = spark.createDataFrame([(1,), (4,)], "id long")
    assert pairs(T.degree(people, ids)) == [(1, 4), (4, 2)]
    assert pairs(T.degree(people, ids, "out", "FRIEND")) == [(1, 3), (4, 0)]
    assert pairs(T.unique_neighbor_ids(people, ids, "out")) == [(1,), (2,), (4,)]
    assert pairs(T.connected(people, 1, 2, "out").select("id")) == [(10,), (14,)] and T.connected(people, 1, 2, "in").count() == 0
    assert T.relationships(people, ids).count() == 6
    assert {r["id"]: r.neighbors for r in T.neighbor_ids(people, ids, "out", "FRIEND").collect()} == {1: [1, 2, 2]}


def test_list_predicates(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, None), (4, [3, 1])], "id long, xs array<long>")
    got = lambda op, v=None: [r[0] for r in pairs(Find.find_ids(df, "xs", op, v))]
    assert got("EQ", [3, 1]) == [4] and got("NEQ", [3, 1]) == [1, 2] and got("GT", [9, 9]) == [1] and got("LTE", [9, 9]) == [2, 4]
    assert got("STARTS_WITH", [1, 2]) == [1] and got("ENDS_WITH", [3]) == [1] and got("CONTAINS", [1, 3]) == [1, 4] and got("IS_NULL") == [3] and got("NOT_IS_NULL") == [1, 2, 4]


# --- paths against plain Python -----------------------------------------------------------------------------------


def random_graph(seed, n=7, m=14):
    rnd = random.Random(seed)
    return [(i, rnd.randrange(n), rnd.randrange(n), float(rnd.randint(1, 5))) for i in range(m)]


def plain_paths(edges, start, low, high, mode):
    out, todo = [], [(start, (), (start,))]
    while todo:
        at, rels, nodes = todo.pop()
        if low <= len(rels) <= high:
            out.append(rels)
        if len(rels) == high or (mode == "simple" and rels and at == start):
            continue
        for i, a, b, _ in edges:
            if a != at or (mode == "trail" and i in rels) or (mode == "acyclic" and b in nodes) or (mode == "simple" and b in nodes[1:]):
                continue
            todo.append((b, (*rels, i), (*nodes, b)))
    return sorted(out)


@pytest.mark.parametrize("mode", ["walk", "trail", "acyclic", "simple"])
def test_var_length_modes(spark, mode):
    for seed in (1, 2):
        edges = random_graph(seed)
        rels = spark.createDataFrame(edges, EDGES)
        starts = spark.createDataFrame([(0,)], "start long")
        assert sorted(tuple(r.rels) for r in P.var_length(rels, starts, 0, 3, mode).collect()) == plain_paths(edges, 0, 0, 3, mode)
    assert sorted(tuple(r.rels) for r in P.var_length(rels, starts, 1, None, "acyclic").collect()) == plain_paths(edges, 0, 1, 99, "acyclic")


def test_an_endless_walk_is_refused(spark):
    with pytest.raises(GraphError):
        P.var_length(spark.createDataFrame([], EDGES), spark.createDataFrame([], "start long"), 1, None, "walk")


def hops(edges, n=7):
    d = {(a, b): 1 for _, a, b, _ in edges}
    for k in range(n):
        for a, b in itertools.product(range(n), repeat=2):
            if (a, k) in d and (k, b) in d:
                d[a, b] = min(d.get((a, b), 99), d[a, k] + d[k, b])
    return d


def test_k_hop_distances_and_shortest(spark):
    edges = random_graph(3)
    rels = spark.createDataFrame(edges, EDGES)
    every = spark.range(7).select(F.col("id").alias("start"))
    want = {k: v for k, v in hops(edges).items() if k[0] != k[1]}
    assert {(r.start, r.node): r.depth for r in P.k_hop(rels, every).collect()} == want
    both = spark.createDataFrame(list(itertools.product(range(7), repeat=2)), "start long, end long")
    assert {(r.start, r.end): r.length for r in P.distances(rels, both).collect()} == hops(edges)
    paths = P.shortest(rels, both.where("start <> end"), "all").collect()
    for (a, b), n in want.items():
        brute = [p for p in plain_paths(edges, a, n, n, "walk") if edges[p[-1]][2] == b]
        assert sorted(tuple(r.rels) for r in paths if (r.start, r.end) == (a, b)) == brute
    assert P.distances(rels, both.where("start = end"), low=0).where("length = 0").count() == 7


def test_cheapest_paths(spark):
    edges = random_graph(5)
    rels = spark.createDataFrame(edges, EDGES)
    pair = spark.createDataFrame([(0, b) for b in range(1, 7)], "start long, end long")
    cost = lambda p: sum(edges[i][3] for i in p)
    brute = {}
    for b in range(1, 7):
        found = sorted((cost(p), p) for p in plain_paths(edges, 0, 1, 9, "acyclic") if edges[p[-1]][2] == b)
        if found:
            brute[b] = found
    got = P.cheapest_paths(rels, pair, "all").collect()
    assert {b: sorted(tuple(r.rels) for r in got if r.end == b) for b in brute} == {b: sorted(p for c, p in x if c == x[0][0]) for b, x in brute.items()}
    best = P.cheapest_paths(rels, pair, "any").collect()
    assert {r.end: r.cost for r in best} == {b: x[0][0] for b, x in brute.items()}
    top = P.cheapest_paths(rels, pair, "k", 2).collect()
    assert sorted((r.end, r.cost) for r in top) == sorted((b, c) for b, x in brute.items() for c, _ in x[:2])


# --- algorithms ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ring(spark):
    """A 4-ring with a chord, and its vertices."""
    return spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (3, 4, 3.0), (4, 1, 4.0), (1, 3, 1.0)], "src long, dst long, weight double"), spark.range(1, 5)


def values(df):
    return {r[0]: pytest.approx(r[1]) for r in df.collect()}


def test_centralities(ring):
    e, v = ring
    assert values(A.degree_centrality(e, v)) == {1: 1.0, 2: 2 / 3, 3: 1.0, 4: 2 / 3}
    ranks = A.pagerank(e, v, iterations=100, tolerance=1e-12)
    assert sum(r.rank for r in ranks.collect()) == pytest.approx(1.0)
    assert values(A.betweenness(e, v)) == {1: 3.0, 2: 0.0, 3: 3.0, 4: 3.0}
    assert values(A.betweenness(e, v, directed=False)) == {1: 0.5, 2: 0.0, 3: 0.5, 4: 0.0}
    x = A.eigenvector(e, v, iterations=50)
    assert sum(r.score**2 for r in x.collect()) == pytest.approx(1.0)


def test_similarity_and_triangles(ring):
    e, v = ring
    assert {(r.u, r.v): round(r.score, 4) for r in A.jaccard(e).collect()} == {(1, 2): 0.25, (1, 3): 0.5, (1, 4): 0.25, (2, 3): 0.25, (2, 4): 1.0, (3, 4): 0.25}
    assert pairs(A.unique_triangles(e)) == [(1, 2, 3), (1, 3, 4)] and A.triangles(e).count() == 12
    assert A.directed_triangle_count(e).first()[0] == 3
    assert values(A.local_clustering(e, v)) == {1: 2 / 3, 2: 1.0, 3: 2 / 3, 4: 1.0}
    assert A.preferential_attachment(e, v).count() == 6


def test_components_against_union_find(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    df = spark.createDataFrame(edges, "src long, dst long")
    assert dict(pairs(A.components(df))) == {x: find(x) for x in list(parent)}


def test_connectivity_and_communities(ring, spark):
    e, v = ring
    assert A.is_connected(e, v).first()[0] and A.is_connected(e.where("false"), v.where("false")).first()[0]
    assert not A.is_connected(e, spark.range(1, 7)).first()[0]
    assert A.reachable(e, v).count() == 12 and tuple(A.diameter(e, v).first()) == (3, 3)
    two = spark.createDataFrame([(a, b, 1.0) for k in (0, 10) for a, b in itertools.combinations(range(k, k + 5), 2)] + [(0, 10, 1.0)], "src long, dst long, weight double")
    nodes = two.selectExpr("explode(array(src, dst)) AS id").distinct()
    for df in (A.louvain(two, nodes), A.label_propagation(two, nodes)):
        groups = dict(pairs(df))
        assert len({groups[i] for i in range(1, 5)}) == 1 and len({groups[i] for i in range(11, 15)}) == 1 and groups[1] != groups[11]
    assert A.weakly_connected(e, spark.range(1, 6)).where("id = 5 AND component = 5").count() == 1


def test_ranks_and_top(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 3), ("b", None), ("b", 2)], "g string, x long")
    assert sorted((r.g, r.rank) for r in A.ranks(df, ["x"], ["g"]).collect()) == [("a", 1), ("a", 1), ("a", 3), ("b", 1), ("b", 2)]
    assert A.ranks(df, ["x"], ["g"], descending=True).where("x IS NULL").first()["rank"] == 2
    assert pairs(A.top(df, 1, ["x"], ["g"])) == [("a", 3), ("b", 2)]


# --- search, sources, concepts, streams ---------------------------------------------------------------------------


def test_search(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox"), (2, "a lazy DOG; dog!"), (3, "nothing here"), (4, None)], "id long, t string")
    index = search.terms(docs, "t")
    assert [r.id for r in search.search(index, docs, "dog fox").collect()] == [2, 1]
    assert [r.id for r in search.search(index, docs, "quack", fuzzy=True).collect()] == [1]
    assert search.search(index, docs, "absent").count() == 0


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "items.csv").write_text("# a comment\nname,weight:IGNORE,age,key\nx,1,5,k1\ny,2,,k2\n")
    (tmp_path / "rels.csv").write_text("start_key:Item,since,end_key:Item\nk1,2020,k2\nk2,,k2\n")
    g = Graph(spark).create_node_type("Item", {"name": "string", "age": "integer"}).create_relationship_type("R", {"since": "integer"})
    g = csv.load_nodes(g, "Item", str(tmp_path / "items.csv"))
    assert sorted((r.key, r.name, r.age) for r in g.nodes["Item"].collect()) == [("k1", "x", 5), ("k2", "y", None)]
    g = csv.load_relationships(g, "R", str(tmp_path / "rels.csv"))
    assert g.rel_frame("R").count() == 2
    csv.save_graph(g, str(tmp_path / "saved"))
    back = csv.restore_graph(g, str(tmp_path / "saved"))
    assert pairs(back.rel_frame("R").select("src", "dst")) == pairs(g.rel_frame("R").select("src", "dst"))
    (tmp_path / "bad.csv").write_text("start_key:Item,end_key:Item\nk1,nobody\n")
    with pytest.raises(GraphError):
        csv.load_relationships(g, "R", str(tmp_path / "bad.csv"))
    (tmp_path / "plain.csv").write_text("name\nz\nw\n")
    numbered = csv.load_nodes(Graph(spark).create_node_type("Item", {"name": "string"}), "Item", str(tmp_path / "plain.csv"))
    assert sorted((r.key, r.name) for r in numbered.nodes["Item"].collect()) == [("1", "z"), ("2", "w")]


def test_concepts(spark):
    m = Model(Graph(spark))
    person, company = m.concept("Person", {"ssn": "integer"}), m.concept("Company", {"name": "string"})
    employee = m.concept("Employee", {"ssn": "integer"}, extends=("Person",))
    assert m.property("{Person} has name {String:name}") == "name" and m.property("{Person} works at {Company:employer}") == "employer"
    m.define(person, spark.createDataFrame([(1, "Ann"), (2, "Bo")], "ssn long, name string"))
    m.define(employee, spark.createDataFrame([(3,)], "ssn long"))
    assert pairs(m.select(person.ssn.alias("s")).over(person).df()) == [(1,), (2,), (3,)]
    assert company.frame().count() == 0
    m.define_rule("Bos", lambda g: g.nodes["Person"].where("name = 'Bo'"))
    assert pairs(m.select(m.concepts["Bos"].ssn.alias("s")).over(m.concepts["Bos"]).df()) == [(2,)]
    m.require("no Ann", lambda g: g.nodes["Person"].where("name = 'Ann'"))
    with pytest.raises(GraphError, match="no Ann"):
        m.select(person.ssn).over(person).df()


def test_traits(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4)], "src long, dst long")
    assert close(e, {"transitive"}).count() == 10
    assert close(e, {"symmetric"}).count() == 7
    assert close(e, {"irreflexive"}).count() == 3
    assert pairs(trait_violations(e.union(spark.createDataFrame([(2, 1)], "src long, dst long")), {"irreflexive", "antisymmetric"})) == [(1, 2, "antisymmetric"), (4, 4, "irreflexive")]


def test_scalar_functions(spark):
    row = spark.range(1).select(S.epoch_millis(F.lit("2024-01-02T03:04:05")).alias("a"), S.epoch_millis(F.lit("2024-01-02")).alias("b"), S.epoch_millis(F.lit("junk")).alias("c"), S.date_to_iso(F.lit(0)).alias("d"), S.int_divide(F.lit(-7), F.lit(2)).alias("e"), S.int_divide(F.lit(1), F.lit(0)).alias("f"), S.divide(F.lit(1.0), F.lit(0.0)).alias("g"), S.split_part(F.lit("a,b"), ",", 1).alias("h"), S.join([F.lit("x"), F.lit("y")], "-").alias("i"), S.date_to_double(F.lit("1970-01-01 00:00:01")).alias("j")).first()
    assert tuple(row) == (1704164645000, 1704153600000, None, "1970-01-01T00:00:00Z", -3, None, None, "b", "x-y", 1.0)


def test_stream_of_relationships(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):
        spark.createDataFrame([(k * 10 + i, i, i + 1) for i in range(3)] + [(k * 10, 0, 1)], "id long, src long, dst long").coalesce(1).write.mode("append").parquet(src)
        ingest_relationships(spark, src, "id long, src long, dst long", out, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(out).count() == 6


def test_joined_patterns_obey_the_different_edges_rule_and_share_relationships(spark):
    g = Graph(spark).create_node_type("N").create_relationship_type("R")
    g = W.insert_nodes(g, "N", spark.createDataFrame([(i, str(i)) for i in (1, 2, 3)], "id long, key string"))
    g = W.insert_relationships(g, "R", spark.createDataFrame([(10, 1, 2), (11, 3, 2)], "id long, src long, dst long"))
    one = lambda a, edge=None: Match(g).node(a, "N").expand(a, "R", "b", "N", edge=edge)
    assert pairs(one("a").join(one("c")).select("a__id", "c__id")) == [(1, 3), (3, 1)]
    assert pairs(one("a", "e").join(one("c", "e")).select("a__id", "c__id")) == [(1, 1), (3, 3)]
    assert one("a").repeat_elements().join(one("c")).rows.count() == 4
    assert pairs(one("a").optional(one("c")).select("a__id", "c__id")) == [(1, 1), (1, 3), (3, 1), (3, 3)]


def test_negated_operations_do_not_match_missing_properties(spark):
    df = spark.createDataFrame([(1, ["a"], "ab"), (2, None, None), (3, ["b"], "cd")], "id long, xs array<string>, s string")
    for op in ("NOT_CONTAINS", "NOT_STARTS_WITH", "NOT_ENDS_WITH"):
        assert pairs(Find.find_ids(df, "xs", op, ["a"])) == [(3,)]
    assert pairs(Find.find_ids(df, "s", "NOT_CONTAINS", "a")) == [(3,)]
    assert pairs(Find.find_ids(df, "xs", "NOT_IS_NULL")) == [(1,), (3,)]


def test_paths_inside_patterns(people, spark):
    start = Match(people).node("a", "Person", name="Alice")
    out = start.path("a", "FRIEND", "b", 2, 3, "Person", name="p")
    want = {(2, (10, 11), 3), (2, (14, 11), 3), (2, (13, 10), 2), (2, (13, 14), 2), (3, (10, 11, 12), 1), (3, (14, 11, 12), 1), (3, (13, 10, 11), 3), (3, (13, 14, 11), 3)}
    assert {(r.p__depth, tuple(r.p__rels), r.b__id) for r in out.rows.collect()} == want
    old = start.path("a", "FRIEND", "b", 1, None, "Person", edge_where=F.col("since") < 2022)
    assert pairs(old.select("b__id")) == [(2,), (3,)]
    allowed = spark.createDataFrame([(2,)], "id long")
    assert pairs(start.path("a", "FRIEND", "b", 2, 2, "Person", inner=allowed).select("b__id")) == [(3,), (3,)]
    both = start.node("b", "Person", name="Carol").path("a", "FRIEND", "b", 1, 4, name="p", shortest="all")
    assert sorted(tuple(r.p__rels) for r in both.rows.collect()) == [(10, 11), (14, 11)]
    assert pairs(start.path("a", "FRIEND", "b", labels="Person", shortest="any").expand("b", "KNOWS", "c", "Person").select("b__id", "c__id")) == [(2, 4)]
    hop = Match(people).node("x", "Person").expand("x", "FRIEND", "y", "Person").expand("y", "KNOWS", "z", "Person").group("x", "z")
    assert {tuple(r.p__rels) for r in Match(people).node("a", "Person").path("a", hop, "b", 1, 2, "Person", name="p").rows.collect()} == {(10, 20), (14, 20)}


def test_relationship_starts_lists_and_label_conjunction(people):
    m = Match(people).relationship("e", "FRIEND", "a", "b", F.col("since") > 2021)
    assert pairs(m.select("a__id", "b__id")) == [(1, 1), (1, 2), (3, 1)]
    assert pairs(people.node("Person", ["bob", "nobody", "dave"]).select("id")) == [(2,), (4,)]
    assert pairs(people.node(None, id=[1, 3]).select("id")) == [(1,), (3,)] and people.relationship("FRIEND", [10, 99]).count() == 1
    g = people.create_view("Old", lambda g: g.nodes["Person"].where("age > 30")).create_view("Bs", lambda g: g.nodes["Person"].where("key LIKE 'b%'"))
    assert pairs(g.node_frame("Person", also=["Old", "Bs"]).select("id")) == [(2,)]
    assert pairs(g.node_frame("Person", exclude=["Old"]).select("id")) == [(1,), (3,), (4,)]


def test_kept_text_index(people):
    kept = people.create_text_index("Person", "name")
    found = lambda g: pairs(search.search(g.text_terms("Person", "name"), g.node_frame("Person"), "alice bob").select("id"))
    assert found(kept) == found(people) == [(1,), (2,)]
    assert kept.show_indexes().count() == 1


def test_directed_triangles_with_loops_and_opposite_edges(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(9), rng.randrange(9)) for _ in range(40)]
    e = set(edges)
    want = sum((a, b) in e and (b, c) in e and (c, a) in e for a in range(9) for b in range(9) for c in range(9))
    assert A.directed_triangle_count(spark.createDataFrame(edges, "src long, dst long")).first().n == want


def test_results_kept_in_the_graph(people):
    edges = A.edge_list(people.rel_frame("FRIEND"))
    g = W.set_result(people, "Person", A.degree_centrality(edges, people.node_frame("Person").select("id")), "score", "degree")
    assert "degree" in g.property_types("Person") and {r.id: r.degree for r in g.nodes["Person"].collect()}[4] == 0.0
    g = W.insert_result(g, "ALIKE", A.jaccard(edges), "u", "v", {"score": "double"})
    assert pairs(Match(g).node("a", "Person").expand("a", "ALIKE", "b", "Person").select("a__id", "b__id")) == [(1, 2), (1, 3), (2, 3)]


def test_requirements_of_concepts_and_fragments_and_data(spark):
    m = Model(Graph(spark))
    person = m.concept("Person", {"ssn": "integer"})
    m.define(person, spark.createDataFrame([(1,), (2,)], "ssn long"))
    found = m.select(person.ssn).over(person)
    assert found.require("positive", person.ssn > 0).df().count() == 2
    with pytest.raises(GraphError, match="large"):
        found.require("large", person.ssn > 1).df()
    extra = m.data([{"city": "Rome", "n": 3}, {"city": "Oslo", "n": 5}, {"city": "Oslo", "n": 5}])
    assert pairs(m.select(extra.city, extra.n).over(extra).where(extra.n > 3).df()) == [("Oslo", 5)]
    person.require("at most one", person.ssn < 2)
    with pytest.raises(GraphError, match="at most one"):
        found.df()


def test_reflexive_closure_of_lone_nodes(spark):
    e = spark.createDataFrame([(1, 2)], "src long, dst long")
    assert pairs(close(e, {"reflexive"}, spark.createDataFrame([(7,)], "id long"))) == [(1, 1), (1, 2), (2, 2), (7, 7)]


def test_rows_without_a_key_are_numbered_in_file_order(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"{i}.csv").write_text("name\n" + "".join(f"n{i}_{j}\n" for j in range(3)))
    g = csv.load_nodes(Graph(spark).create_node_type("N", {"name": "string"}), "N", str(tmp_path))
    rows = {int(r.key): r.name for r in g.nodes["N"].collect()}
    assert sorted(rows) == list(range(1, 13)) and len(set(rows.values())) == 12
    assert all(rows[k][:3] == rows[k - k % 3 + 1 if k % 3 else k - 2][:3] for k in rows)


def test_label_propagation_against_brute_force(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(20), rng.randrange(20), float(rng.randrange(1, 4))) for _ in range(45)]
    near = {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            near[x, y] = near.get((x, y), 0) + w
    label = {i: i for i in range(20)}
    for _ in range(15):
        new = {}
        for i in label:
            votes = {}
            for (x, y), w in near.items():
                if x == i:
                    votes[label[y]] = votes.get(label[y], 0) + w
            new[i] = min(votes, key=lambda c: (-votes[c], c)) if votes else label[i]
        done, label = new == label, new
        if done:
            break
    got = A.label_propagation(spark.createDataFrame(edges, "src long, dst long, weight double"), spark.range(20).select("id"))
    assert {r.id: r.label for r in got.collect()} == label


def test_sessions_allow_what_their_mode_does(people, spark):
    add = lambda g: W.insert_nodes(g, "Person", spark.createDataFrame([(9, "eve", "Eve")], "id long, key string, name string"))
    reader, writer, admin = (Session(people, m) for m in ("ro", "rw", "admin"))
    assert reader.read(lambda g: g.node_frame("Person").count()) == 4
    for forbidden in (lambda: reader.write(add), lambda: writer.administer(Graph.drop_view, "x"), lambda: writer.write(Graph.create_node_type, "Pet"), lambda: writer.write(Graph.add_property, "Person", "size", "double"), lambda: Session(people, "root")):
        with pytest.raises(GraphError):
            forbidden()
    assert writer.graph is people and writer.write(add).node_frame("Person").count() == 5
    admin.administer(Graph.create_node_type, "Pet")
    assert set(admin.graph.nodes) == {"Person", "Pet"} and set(people.nodes) == {"Person"}
    admin.administer(Graph.create_constraint, "adult", lambda g: g.node_frame("Person").where("age < 18"))
    young = lambda g: W.set_properties(g, "Person", spark.createDataFrame([(1, 3)], "id long, age long"))
    before = admin.graph
    with pytest.raises(GraphError):
        admin.write(young)
    assert admin.graph is before


def test_similarity_of_a_hub_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    edges = {(0, v) for v in range(1, 30)} | {(rng.randrange(30), rng.randrange(30)) for _ in range(60)} | {(7, 7)}
    df = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, dst long, weight double")
    near = {v: {b for a, b in edges if a == v and b != v} | {a for a, b in edges if b == v and a != v} for v in range(30)}
    want = {(u, v): len(near[u] & near[v]) / len(near[u] | near[v]) for u, v in itertools.combinations(range(30), 2) if near[u] & near[v]}
    monkeypatch.setattr(A, "BLOCK", 4)
    got = {(r.u, r.v): r.score for r in A.jaccard(df, least=0.0).collect()}
    assert got == pytest.approx(want)


def test_branches_are_counted_apart(people, spark):
    g = Match(people)
    out = lambda m, e, b: m.expand("a", e, b, "Person")
    listed = out(out(g.node("a", "Person"), "FRIEND", "b"), "KNOWS", "c").rows.groupBy("a__id").count()
    found = g.node("a", "Person").counts("n", out(g.node("a", "Person"), "FRIEND", "b"), out(g.node("a", "Person"), "KNOWS", "c"))
    assert pairs(found.select("a__id", "n")) == pairs(listed) == [(2, 1)]
    with pytest.raises(GraphError, match="differ"):
        g.node("a", "Person").counts("n", out(g.node("a", "Person"), "FRIEND", "b"), out(g.node("a", "Person"), "FRIEND", "c"))
    with pytest.raises(GraphError, match="share"):
        g.node("a", "Person").counts("n", out(g.node("a", "Person"), "FRIEND", "b"), out(g.node("a", "Person"), "KNOWS", "b"))


def _star(spark, folder, n):
    """One nation with n customers and n suppliers, of balances 0 to n - 1, and a nation with neither."""
    spark.createDataFrame([(0, "here", 0), (1, "empty", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{folder}/nation.parquet")
    spark.createDataFrame([(0, "r")], "r_regionkey int, r_name string").write.parquet(f"{folder}/region.parquet")
    spark.range(n).selectExpr("id AS c_custkey", "'c' AS c_name", "0 AS c_nationkey", "double(id) AS c_acctbal", "'x' AS c_mktsegment").write.parquet(f"{folder}/customer.parquet")
    spark.range(n).selectExpr("id AS s_suppkey", "'s' AS s_name", "0 AS s_nationkey", "double(id) AS s_acctbal").write.parquet(f"{folder}/supplier.parquet")


def test_star_join_of_many_customers_and_suppliers(spark, tmp_path):
    """Combinations far too many to be listed."""
    from graphloom.queries import queries

    n = 1_000_000
    _star(spark, tmp_path, n)
    assert pairs(queries()["star_join"](spark, str(tmp_path))) == [("here", "r", n * n)]
    assert pairs(queries()["multi_match_join"](spark, str(tmp_path))) == [("here", n * (n - 1) // 2)]


def test_pairs_above_against_brute_force(spark):
    rng, nan = random.Random(5), float("nan")
    draw = lambda values: [(rng.randrange(3), rng.choice(values)) for _ in range(60)]
    for values in ([1.0, 2.0, None], [-5.0, -0.0, 0.0, 3.5, 1e9, None], [7.0], [nan, float("-inf"), float("inf"), 1.0, 2.0]):
        high, low = draw(values), draw(values)
        above = lambda x, y: None not in (x, y) and ((x != x and y == y) or x > y)
        want = {g: sum(above(x, y) for k, x in high for m, y in low if k == m == g) for g in range(3)}
        found = A.pairs_above(*[spark.createDataFrame(rows, "g long, v double") for rows in (high, low)], ["g"])
        assert dict(pairs(found)) == {g: n for g, n in want.items() if n}


def test_ends_of_long_chains(spark):
    """A chain of 3,000 hops, longer than a search by rounds goes, and shorter ones."""
    chains = [0, 1, 2, 7, 8, 9, 3_000]
    edges = [(i * 10_000 + j, i * 10_000 + j, i * 10_000 + j + 1) for i, n in enumerate(chains) for j in range(n)]
    rels = spark.createDataFrame(edges, "id long, src long, dst long")
    starts = spark.createDataFrame([(i * 10_000,) for i in range(len(chains))], "start long")
    found = P.path_ends(rels, starts)
    assert pairs(found.groupBy("start").agg(F.count("*"), F.max("depth"), F.max(F.col("end") - F.col("start")))) == [(i * 10_000, n, n, n) for i, n in enumerate(chains) if n]


def test_path_ends_against_var_length(spark):
    rng = random.Random(4)
    for trial in range(3):
        tree = [(v, rng.randrange(v), v) for v in range(1, 30)]
        circle = [(40, 40, 41), (41, 41, 42), (42, 42, 40), (43, 41, 43)]
        rels = spark.createDataFrame([tree + circle, tree + [(50, 3, 9)], tree][trial], "id long, src long, dst long")
        starts = spark.createDataFrame([[(0,), (99,)], [(0,)], [(0,), (5,), (5,)]][trial], "start long")
        assert pairs(P.path_ends(rels, starts)) == pairs(P.var_length(rels, starts, 1, None).select("start", "end", "depth"))


def test_cheapest_chain_of_many_events(spark, tmp_path):
    """A user with more events than a search by rounds has rounds, one with unknown and negative values, one with one event."""
    from graphloom.queries import queries

    values = [[1.0] * 3_001, [5.0, 2.0, -1.0, 4.0, None, 9.0], [7.0]]
    rows = [(u * 10_000 + i, i, u, v) for u, some in enumerate(values) for i, v in enumerate(some)]
    spark.createDataFrame(rows, "event_id long, s long, user_id long, value double").selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id", "'x' AS event_type", "value", "'' AS props").write.parquet(f"{tmp_path}/events.parquet")
    found = {(start // 10_000, start % 10_000): (n, far) for start, n, far in queries()["cheapest_chain"](spark, str(tmp_path)).collect()}
    assert {i: found.pop((0, i)) for i in range(3_000)} == {i: (3_000 - i, 3_000.0 - i) for i in range(3_000)}
    assert found == {(1, 0): (5, 5.0), (1, 1): (4, 3.0), (1, 2): (3, 4.0), (1, 3): (2, None), (1, 4): (1, 9.0)}


def test_farthest_against_brute_force(spark):
    """Single ways, and circles and forks, of which the ways are searched otherwise."""
    rng = random.Random(6)
    ways = [(v, v, rng.randrange(v + 1, 31), rng.random()) for v in range(30)]
    circle = [(40, 40, 41, 1.0), (41, 41, 42, 2.0), (42, 42, 40, 0.5), (43, 43, 41, 4.0), (44, 44, 44, 1.0)]
    for edges in (ways + circle[3:], ways + circle, ways + [(50, 3, 9, 0.25)]):
        starts = [*range(50), 5, 99]
        want = {}
        for start in starts:
            cost = {start: 0.0}
            for _ in edges:
                for _, a, b, c in edges:
                    if a in cost:
                        cost[b] = min(cost.get(b, cost[a] + c), cost[a] + c)
            if len(cost) > 1:
                want[start] = (len(cost) - 1, pytest.approx(max(c for v, c in cost.items() if v != start)))
        found = P.farthest(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(v,) for v in starts], "start long"))
        assert {s: (n, far) for s, n, far in pairs(found)} == want and found.count() == len(want)
    assert pairs(P.farthest(spark.createDataFrame([], EDGES), spark.createDataFrame([(1,)], "start long"))) == []


def test_closures_compute_their_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long").mapInArrow(counted, "src long, dst long")
    assert len(pairs(close(edges, {"transitive", "reflexive"}))) == 10
    assert seen.value == 3
    assert pairs(trait_violations(edges, {"irreflexive", "antisymmetric"})) == [] and seen.value == 6


def test_partners_are_derived_once(spark):
    from graphloom.sources.tables import table_graph

    files = table_graph(spark, "/root/testdata/sf0.001").rel_frame("PARTNER").inputFiles()
    assert files and not any(f"/{t}.parquet" in f for f in files for t in ("lineitem", "orders", "customer", "supplier"))


def test_similarity_of_given_ends(spark, monkeypatch):
    """Ends by a condition against all pairs, with and without hubs among the vertices in common."""
    rng = random.Random(9)
    edges = spark.createDataFrame([(rng.randrange(20), 100 + rng.randrange(30), 1.0) for _ in range(200)], "src long, dst long, weight double")
    for block in (4, 1_024):
        monkeypatch.setattr(A, "BLOCK", block)
        for measure in (A.jaccard, A.cosine):
            kept = measure(edges, 0.0, lambda c: c < 100)
            assert pairs(kept) == pairs(measure(edges, 0.0).where("v < 100")) != []


def test_similarity_in_shares(spark, monkeypatch):
    """Tasks with bounded numbers of pairs, ends numbered without any order, a part that all suppliers have."""
    rng = random.Random(3)
    edges = {(rng.randrange(40), 100 + rng.randrange(60)) for _ in range(240)} | {(v, 100) for v in range(40)}
    near = {v: {b for a, b in edges if a == v} for v in range(40)}
    want = {(u, v): len(near[u] & near[v]) / len(near[u] | near[v]) for u, v in itertools.combinations(range(40), 2)}
    having = lambda w: sum(w in n for n in near.values())
    heaviest = max(sum(having(w) - 1 for w in n) for n in near.values())
    df = spark.createDataFrame([(a, b, 1.0) for a, b in edges for _ in range(2)], "src long, dst long, weight double")
    for share, tasks in ((20, 20_000), (20, 2)):
        monkeypatch.setattr(A, "SHARE", share)
        monkeypatch.setattr(A, "TASKS", tasks)
        got = A.jaccard(df, 0.0, lambda c: c < 100).withColumn("task", F.spark_partition_id()).collect()
        assert {(r.u, r.v): r.score for r in got} == pytest.approx(want) and len(got) == len(want) == 780
        most = max(sum(r.task == t for r in got) for t in {r.task for r in got})
        assert most <= 2 * share + heaviest if tasks > 2 else most < 780
    assert pairs(A.cosine(df.where("false"))) == []
