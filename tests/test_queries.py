"""Every query with SQL against DuckDB, and the graph rules on small fixtures."""

import random
from functools import cached_property

import harness
import pytest

from knotwork import registry
from knotwork.operators.graph import PropertyGraph
from knotwork.operators.traverse import dfs, shortest_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return harness.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    if sql:
        assert harness.compare(df, con, sql) is None
    else:
        assert df.count() > 0


def graph(spark, edges):
    ids = sorted({x for e in edges for x in e[:2]} - {"ghost"})
    nodes = spark.createDataFrame([(i, i, "code", f"{i}.py", f"{k:03d}") for k, i in enumerate(ids)], "id string, label string, file_type string, source_file string, ord string")
    rows = [(a, b, r, "EXTRACTED", None, "f.py", f"{k:03d}") for k, (a, b, r) in enumerate(edges)]
    return PropertyGraph.build(nodes, spark.createDataFrame(rows, "source string, target string, relation string, confidence string, context string, source_file string, ord string"))


def test_last_edge_wins_loops_and_ghosts(spark):
    g = graph(spark, [("a", "b", "one"), ("b", "a", "two"), ("c", "c", "self"), ("a", "ghost", "gone"), ("A.", "c", "by_norm")])
    got = {(r["source"], r["target"], r["relation"]) for r in g.edges.collect()}
    assert got >= {("b", "a", "two"), ("c", "c", "self")} and not any("ghost" in x for x in got)
    assert {r["id"]: r["degree"] for r in g.degree.collect()}["c"] >= 1


def test_paths(spark):
    g = graph(spark, [("a", "c", "r"), ("a", "b", "r"), ("b", "d", "r"), ("c", "d", "r")])
    assert shortest_path(g, "a", "d") == ["a", "b", "d"]
    assert [r["id"] for r in dfs(g, ["a"], 3).orderBy("place").collect()] == ["a", "b", "d", "c"]


def test_empty_graph(spark):
    g = graph(spark, [("a", "a", "x")])
    none = g.subgraph(g.nodes.where("false"))
    assert none.degree.count() == 0 and none.edges.count() == 0


def test_components_of_the_whole_table(spark, con):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in con.sql("SELECT DISTINCT 'order_' || l_orderkey, 'part_' || l_partkey FROM lineitem").fetchall():
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r["id"]: r["component"] for r in registry.queries()["connected_components"](spark, SF).collect()}
    assert got == {x: find(x) for x in root}


def test_diacritics_of_whole_texts(spark, tmp_path):
    import unicodedata

    texts = [None, "", "\u00c9t\u00e9 " * 500, "x" * 300 + "\u00c5ngstr\u00f6m", "a\u0301" * 201]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["value"] for r in registry.queries()["fn_strip_diacritics"](spark, str(tmp_path)).collect()}
    bare = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
    assert got == {i: None if t is None else bare(t) for i, t in enumerate(texts)}


def test_node_link_save_and_load(spark, tmp_path):
    from knotwork.operators import node_link

    g = graph(spark, [("a", "b", "one"), ("b", "c", "two")])
    node_link.save(g, f"{tmp_path}/g")
    back = node_link.load(spark, f"{tmp_path}/g")
    both = [{(r["source"], r["target"], r["relation"]) for r in x.edges.collect()} for x in (g, back)]
    assert both[0] == both[1] and len(both[0]) == 2
    assert {r["id"] for r in back.nodes.collect()} == {"a", "b", "c"}


def test_paths_of_any_length(spark):
    g = graph(spark, [(f"n{i:02d}", f"n{i + 1:02d}", "r") for i in range(16)])
    assert len(shortest_path(g, "n00", "n16")) == 17 and shortest_path(g, "n00", "elsewhere") is None


def test_labels_are_folded(spark):
    from knotwork.operators.query import score_nodes

    g = graph(spark, [("Café", "b", "r")])
    assert [r["id"] for r in score_nodes(g, ["cafe"]).collect()] == ["Café"]


def test_rebuild_on_change_and_debounced_stream(spark, tmp_path):
    import datetime

    from knotwork.streaming import changes

    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, 0) + datetime.timedelta(seconds=s)
    rows = [("a", at(0), 1, "click"), ("a", at(1), 2, "view"), ("a", at(100), 3, "click"), ("b", at(200), 4, "click")]
    spark.createDataFrame(rows, "path string, mtime timestamp, order_ long, kind string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("path string, mtime timestamp, order_ long, kind string").parquet(f"{tmp_path}/in")
    calls = []
    one = changes.rebuild_on_change(stream(), lambda b: calls.append(("rebuild", b.count())), lambda b: calls.append(("flag", b.count())), code=("click", "view"))
    one.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/one").start().awaitTermination()
    two = changes.rebuild_on_change(stream(), lambda b: calls.append(("rebuild", b.count())), lambda b: calls.append(("flag", b.count())), code=("view",))
    two.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/two").start().awaitTermination()
    assert calls == [("rebuild", 4), ("flag", 4)]
    out = changes.debounce_stream(stream(), "3 seconds", "1 second").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/three")
    out.trigger(availableNow=True).start().awaitTermination()
    got = {(r["path"], r["n"], r["last"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", 2, "view"), ("a", 1, "click")}


def test_file_names_of_articles_are_given_once(spark):
    from knotwork.operators.articles import file_names

    rows = [(1, "a b"), (2, "a b"), (3, "c"), (4, "a b"), (5, "c")]
    got = [r["file"] for r in file_names(spark.createDataFrame(rows, "cid long, label string")).orderBy("cid").collect()]
    assert len(set(got)) == 5 and got[1] == f"{got[0]}_2" and got[3] == f"{got[0]}_3" and got[4] == f"{got[2]}_2"


def test_supertypes_and_import_targets_of_nothing(spark):
    from knotwork.operators import symbols

    rows = spark.createDataFrame([(None, None), ("import_statement", ""), ("import_statement", "import *")], "kind string, s string")
    got = rows.select(symbols.supertypes(rows["s"]).alias("a"), symbols.import_targets(rows["kind"], rows["s"]).alias("b")).collect()
    assert all(r["a"] == [] and r["b"] == [] for r in got)


def test_edges_that_occur_once_are_not_shuffled(spark):
    """F2-F17: single edges pass without a shuffle; repeated ones still collapse, and neighbours need no shuffle."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    g = graph(spark, [("a", "b", "one"), ("b", "c", "two"), ("c", "c", "self")])
    assert "Exchange" not in plan(g.edges) and "Exchange" not in plan(g.neighbours)
    g = graph(spark, [("a", "b", "one"), ("b", "a", "two"), ("c", "c", "self"), ("b", "c", "three"), ("A.", "c", "four"), ("a", "ghost", "gone")])
    want = {("b", "a", "two", "000"), ("c", "c", "self", "002"), ("b", "c", "three", "003"), ("A.", "c", "four", "004")}
    assert {(r["source"], r["target"], r["relation"], r["ord"]) for r in g.edges.collect()} == want


def test_queries_on_nodes_build_no_edges(spark, monkeypatch):
    """tree_rollup reads nodes only."""
    from knotwork.plans import fixtures

    def none(*_):
        raise AssertionError("edges are built")

    monkeypatch.setattr(fixtures, "commerce_edges", none)
    assert registry.queries()["tree_rollup"](spark, "/root/testdata/../testdata/sf0.001").count() > 0


def test_components_of_many_chunks(spark):
    """links become forests in chunks, whose roots are linked; the smallest id of each component is found."""
    from knotwork.operators import components

    assert components.CHUNK
    n = 400
    links = [(f"n{i:03d}", f"n{(i * 7 + 3) % n:03d}") for i in range(n) if i % 5]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    frame = spark.createDataFrame([*links, (None, "n000"), ("alone", "alone")], "a string, b string").repartition(40)
    got = {r["id"]: r["component"] for r in components.components(frame).collect()}
    assert got == {x: find(x) for pair in links if pair[0] != pair[1] for x in pair}


def test_paths_beyond_the_hops_of_the_sql(spark, tmp_path):
    """the only path has more hops than the SQL goes; the operator finds it, the queries answer as their SQL."""
    import shutil

    from knotwork.plans.fixtures import commerce

    shutil.copytree(SF, f"{tmp_path}/in")
    d = f"{tmp_path}/in"
    for name, rule in (("orders", "SELECT * FROM '{0}' WHERE o_custkey <> 1"), ("customer", "SELECT * REPLACE (CASE WHEN c_custkey = 1 THEN (SELECT min(s_nationkey) FROM '{1}/supplier.parquet' WHERE s_nationkey <> (SELECT s_nationkey FROM '{1}/supplier.parquet' WHERE s_suppkey = 1)) ELSE c_nationkey END AS c_nationkey) FROM '{0}'")):
        harness.duckdb.connect().execute(f"COPY ({rule.format(f'{SF}/{name}.parquet', SF)}) TO '{d}/{name}.parquet' (FORMAT parquet)")
    con = harness.connect(d)
    for name in ("shortest_path", "shortest_path_text"):
        assert harness.compare(registry.queries()[name](spark, d), con, registry.oracle_sql()[name]) is None
    assert len(shortest_path(commerce(spark, d), "customer_1", "supplier_1")) > 4


def test_paths_of_all_hops(spark, tmp_path):
    """paths of more than three hops are found, the first by ids, by the queries and their SQL; without a path they agree too."""
    ways = {
        "far": ("o_custkey <> 1", "CASE WHEN c_custkey = 1 THEN (SELECT min(s_nationkey) FROM '{1}/supplier.parquet' WHERE s_nationkey <> (SELECT s_nationkey FROM '{1}/supplier.parquet' WHERE s_suppkey = 1)) ELSE c_nationkey END", "true"),
        "none": ("o_custkey <> 1", "c_nationkey", "c_custkey <> 1"),
    }
    for way, (orders, nation, customers) in ways.items():
        (d := tmp_path / way).mkdir()
        rules = {"orders": f"SELECT * FROM '{{0}}' WHERE {orders}", "customer": f"SELECT * REPLACE ({nation} AS c_nationkey) FROM '{{0}}' WHERE {customers}"}
        for name in ("region", "nation", "supplier", "part", "customer", "orders", "lineitem"):
            rule = rules.get(name, "FROM '{0}'").format(f"{SF}/{name}.parquet", SF)
            harness.duckdb.connect().execute(f"COPY ({rule}) TO '{d}/{name}.parquet' (FORMAT parquet)")
        con = harness.connect(str(d))
        near = {}
        for a, b in con.sql(registry.oracle_sql()["graph_counts"].split("SELECT (SELECT count(*) FROM nodes)")[0] + "SELECT id, nbr FROM sym").fetchall():
            near.setdefault(a, []).append(b)
        paths = [["customer_1"]]  # in order, as in the reference: the first to reach a node is the path that comes first
        seen = {"customer_1"}
        for path in paths:
            fresh = [b for b in sorted(near.get(path[-1], [])) if b not in seen]
            seen.update(fresh)
            paths += [[*path, b] for b in fresh]
        want = [p for p in paths if p[-1] == "supplier_1"]
        assert [len(p) > 4 for p in want] == ([True] if way == "far" else [])
        got = {name: registry.queries()[name](spark, str(d)) for name in ("shortest_path", "shortest_path_text")}
        for name, df in got.items():
            assert harness.compare(df, con, registry.oracle_sql()[name]) is None
        assert [(r["path"], r["hops"]) for r in got["shortest_path"].collect()] == [(" ".join(p), len(p) - 1) for p in want]
        text = got["shortest_path_text"].first()["text"]
        assert text.startswith(f"Shortest path ({len(want[0]) - 1} hops):\n") if want else text is None


def test_paths_meet_from_both_ends(spark):
    """on random graphs the path is the one that ascending discovery finds, whichever end steps."""
    rng = random.Random(4)
    for nodes, edges in ((12, 20), (25, 30)):
        near = {}
        for a, b in {tuple(sorted(rng.sample(range(nodes), 2))) for _ in range(edges)}:
            near.setdefault(f"n{a}", set()).add(f"n{b}")
            near.setdefault(f"n{b}", set()).add(f"n{a}")
        g = graph(spark, [(a, b, "r") for a in near for b in near[a] if a < b])
        for a, b in (rng.sample(sorted(near), 2) for _ in range(2)):
            paths, seen = [[a]], {a}
            for path in paths:
                fresh = [x for x in sorted(near[path[-1]]) if x not in seen]
                seen.update(fresh)
                paths += [[*path, x] for x in fresh]
            assert shortest_path(g, a, b) == next((p for p in paths if p[-1] == b), None)


def _without(spark, monkeypatch, con, name: str, *never: str) -> None:
    """The query answers as its SQL without those properties of graphs, which shuffle all edges or nodes."""

    def fail(*_):
        raise AssertionError("all of the graph is asked for")

    for x in never:
        monkeypatch.setattr(PropertyGraph, x, property(fail) if isinstance(vars(PropertyGraph)[x], cached_property) else fail)
    df, sql = registry.queries()[name](spark, f"{SF}/."), registry.oracle_sql().get(name)
    assert harness.compare(df, con, sql) is None if sql else df.count() > 0


def test_explain_node_counts_edges_of_neighbours_only(spark, con, monkeypatch):
    """F10"""
    _without(spark, monkeypatch, con, "explain_node", "degree")


def test_edges_join_no_inputs_where_no_files_are_asked_for(spark):
    """where bfs_nodes reads edges, no lineitem meets part and no orders customer."""
    from knotwork.plans.fixtures import commerce_edges, commerce_nodes

    nodes = commerce_nodes(spark, SF)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    ends = lambda **x: plan(commerce_edges(spark, SF, nodes, **x).where("relation <> 'references'").select("source", "target"))
    assert "Join" in ends() and "Join" not in ends(checked=True)


def test_edges_of_what_does_not_exist(spark, tmp_path):
    """line items and orders of parts and customers that are missing, negative or null give no edges, as in the SQL."""
    import shutil

    shutil.copytree(SF, f"{tmp_path}/in")
    rules = {
        "lineitem": "SELECT * REPLACE (CASE WHEN l_linenumber = 1 THEN -l_partkey WHEN l_linenumber = 2 THEN l_partkey + 1000000 WHEN l_linenumber = 3 THEN NULL ELSE l_partkey END AS l_partkey) FROM '{0}'",
        "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 5 = 0 THEN -o_custkey WHEN o_orderkey % 5 = 1 THEN NULL ELSE o_custkey END AS o_custkey) FROM '{0}'",
    }
    for name, rule in rules.items():
        harness.duckdb.connect().execute(f"COPY ({rule.format(f'{SF}/{name}.parquet')}) TO '{tmp_path}/in/{name}.parquet' (FORMAT parquet)")
    con = harness.connect(f"{tmp_path}/in")
    for name in ("degree", "confidence_breakdown", "bfs_nodes"):
        assert harness.compare(registry.queries()[name](spark, f"{tmp_path}/in"), con, registry.oracle_sql()[name]) is None


def test_nodes_that_repeat(spark):
    """nodes with one row pass as they are, repeated ones still merge."""
    from knotwork.operators.graph import merge_few, merge_nodes

    rows = [("a", "A", None, "1"), ("a", None, "x", "2"), ("b", "B", "y", "3"), (None, "N", "n", "4"), (None, "M", None, "5")]
    one, many = (spark.createDataFrame(x, "id string, label string, file_type string, ord string") for x in (rows[2:4], rows))
    assert "Exchange" not in merge_few(one)._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, merge_few(many).collect())) == sorted(map(str, merge_nodes(many).collect()))


def test_clustering_leaves_one_table(spark):
    """of what clustering writes only the communities stay; components are dealt out as rows, not as sets."""
    from knotwork.plans import graph_queries
    from knotwork.sources import tables

    d = f"{SF}/../sf0.001"
    graph_queries.commerce(spark, d).edges  # noqa: B018
    before = set(tables._left)
    member = graph_queries._member(spark, d)
    assert len(set(tables._left) - before) == 1 and not member.isEmpty()


def test_surprise_scores_shuffle_no_labels(spark, con, monkeypatch):
    """F13"""
    _without(spark, monkeypatch, con, "surprise_scores", "ends")


def test_questions_shuffle_no_labels(spark, con, monkeypatch):
    """F6"""
    _without(spark, monkeypatch, con, "suggest_questions", "ends")


def test_file_like_nodes_count_edges_of_what_may_be(spark, con, monkeypatch):
    """F12"""
    _without(spark, monkeypatch, con, "file_like_nodes", "degree")


def test_previews_count_edges_of_what_may_be(spark, con, monkeypatch):
    """F8"""
    _without(spark, monkeypatch, con, "community_preview", "degree")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_nodes_get_their_communities_without_a_shuffle(spark, con):
    """where one component holds the nodes, their directory tells the community."""
    df = registry.queries()["apply_communities"](spark, SF)
    assert "hashpartitioning" not in _plan(df) and harness.compare(df, con, registry.oracle_sql()["apply_communities"]) is None


def _plain_communities(files: dict, edges: list) -> dict:
    root = {x: x for x in files}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        if a in files and b in files:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    size = {x: sum(find(y) == x for y in files) for x in files}
    part = {x: (find(x), files[x].split("/")[0] if size[find(x)] > max(10, len(files) // 4) else "") for x in files}
    members = {p: sorted(x for x in files if part[x] == p) for p in part.values()}
    order = sorted(members, key=lambda p: (-len(members[p]), members[p][0].replace("_", " ")))
    return {x: order.index(part[x]) for x in files}


@pytest.mark.parametrize("outside", [0, 6, 60])
def test_communities_inside_and_outside_of_the_largest_component(spark, outside):
    """also where ends are no nodes, which link nothing, edges repeat, and most nodes are outside of any large component."""
    from knotwork.operators.cluster import communities
    from knotwork.operators.graph import LazyGraph, collapse, resolve

    inner, outer = [f"in{i:02d}" for i in range(30)], [f"out{i:02d}" for i in range(outside)]
    files = {x: ("ab"[i % 2] + "/x.py") for i, x in enumerate([*inner, *outer])}
    edges = [*zip(inner, inner[1:], strict=False), (inner[0], inner[1]), (inner[3], inner[3]), *zip(outer[::3], outer[1::3], strict=False)]
    edges += [(inner[0], "ghost"), *(("ghost", x) for x in outer[:1])]
    nodes = spark.createDataFrame([(k, k, "code", v, k) for k, v in files.items()], "id string, label string, file_type string, source_file string, ord string")
    rows = [(a, b, "r", "EXTRACTED", None, "f.py", f"{k:03d}") for k, (a, b) in enumerate(edges)]
    raw = spark.createDataFrame(rows, "source string, target string, relation string, confidence string, context string, source_file string, ord string")
    g = LazyGraph(nodes, lambda: collapse(resolve(raw, nodes, normalise=False)), lambda: raw.select("source", "target"))
    found = communities(g)
    assert bool(found.tops) == (outside < 60) and found.others == (outside if outside < 60 else outside + len(inner))
    assert {r["id"]: r["cid"] for r in found.of(nodes).collect()} == _plain_communities(files, edges)


def test_graphml_has_communities_without_a_shuffle(spark, con):
    """F11"""
    df = registry.queries()["export_graphml"](spark, SF)
    assert "hashpartitioning" not in _plan(df) and harness.compare(df, con, registry.oracle_sql()["export_graphml"]) is None


def test_links_between_communities_join_no_neighbours(spark, con, monkeypatch):
    """F9"""
    _without(spark, monkeypatch, con, "cross_community_links", "neighbours")


@pytest.mark.parametrize("bits", [1 << 20, 8])
def test_communities_that_filters_tell(spark, monkeypatch, bits):
    """what filters tell is right, and what they leave open is given, also where they are so small that most nodes pass them."""
    from knotwork.operators import cluster

    within = cluster.within
    monkeypatch.setattr(cluster, "within", lambda keys: within(keys, bits))
    cid = {f"n{i:04d}": 0 if i < 1000 else 1 if i < 1600 else 2 + i % 5 for i in range(2000)}
    tell, odd = cluster.told(spark.createDataFrame(list(cid.items()), "id string, cid int"))
    ids = spark.createDataFrame([(x,) for x in cid], "id string").select("id", tell("id").alias("cid"))
    got, rest = {r["id"]: r["cid"] for r in ids.collect()}, {r["id"]: r["cid"] for r in odd.collect()}
    assert all(got[x] in (None, c) for x, c in cid.items())
    assert rest == {x: c for x, c in cid.items() if got[x] is None} and (bits == 8 or len(rest) < 600)


def test_questions_shuffle_no_nodes_with_their_labels(spark, con, monkeypatch):
    """hubs are looked up among the highest degrees, and degrees and pairs are counted by keys."""
    from knotwork.operators import analyze

    def fail(*_):
        raise AssertionError("all nodes are asked for with their degrees")

    monkeypatch.setattr(analyze, "attributed", fail)
    _without(spark, monkeypatch, con, "suggest_questions", "ends", "degree", "degree_of")


@pytest.mark.parametrize("near", [0, 10_000])
def test_surprises_that_are_not_among_the_first_edges(spark, con, monkeypatch, near):
    """where the first edges do not do, all edges of a score are gathered; also by ids, where two nodes share a hash."""
    from knotwork.operators import analyze

    d = f"{SF}/./." if near else f"{SF}/././."
    monkeypatch.setattr(analyze, "NEAR", near)
    if near:
        from pyspark.sql import functions as F

        monkeypatch.setattr(PropertyGraph, "key", property(lambda self: F.col))
    for name in ("surprising_connections", "suggest_questions"):
        assert harness.compare(registry.queries()[name](spark, d), con, registry.oracle_sql()[name]) is None
