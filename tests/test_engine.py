"""Operators of the graph engine on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from waymark import schema as S
from waymark.functions import text as X
from waymark.operators import build, inventory, resolve, scopes, traverse, validate

NODE = "id string, kind string, name string, file string, line int, confidence string, provenance string, lang string, package string, node_seq long"
EDGE = "src string, dst string, type string, file string, line int, confidence string, provenance string, edge_seq long"


def nodes(spark, rows):
    return spark.createDataFrame([(i, k, n, f, 1, c, "derived", lang, pkg, s) for s, (i, k, n, f, c, lang, pkg) in enumerate(rows)], NODE)


def edges(spark, rows):
    return spark.createDataFrame([(a, b, t, "x", 1, c, "derived", s) for s, (a, b, t, c) in enumerate(rows)], EDGE)


@pytest.fixture(scope="module")
def graph(spark):
    n = nodes(spark, [
        ("endpoint:GET /a", "endpoint", "GET /a", "api/a.py", "HIGH", "py", None),
        ("py:class:H#go", "method", "H.go", "api/a.py", "HIGH", "py", None),
        ("svc:S", "service", "S", "src/s.py", "HIGH", "py", "com.claims.core.deep"),
        ("table:t", "table", "t", "db/t.sql", "MEDIUM", None, None),
        ("ts:comp:C", "component", "C", "ui/c.ts", "LOW", "ts", None),
        ("ts:comp:D", "component", "D", "ui/d.ts", "HIGH", "ts", None),
        ("file:x", "file", "x", "x", "HIGH", None, None),
    ])
    e = edges(spark, [
        ("endpoint:GET /a", "py:class:H#go", "handled-by", "HIGH"),
        ("py:class:H#go", "svc:S", "calls", "MEDIUM"),
        ("svc:S", "table:t", "reads", "MEDIUM"),
        ("ts:comp:C", "endpoint:GET /a", "consumes", "LOW"),
        ("ts:comp:D", "unresolved:component:C", "navigates", "HIGH"),
        ("svc:S", "table:gone", "writes", "MEDIUM"),
        ("svc:S", "queue:kafka", "publishes", "LOW"),
        ("ts:comp:D", "endpoint:* /a", "consumes", "LOW"),
        ("svc:S", "unresolved:method:H#go", "calls", "MEDIUM"),
        ("svc:S", "unresolved:method:H#no", "calls", "MEDIUM"),
    ])
    return n, e


def test_first_wins_is_idempotent(spark, graph):
    n, _ = graph
    twice = n.unionByName(n.withColumns({"node_seq": F.col("node_seq") + 100, "name": F.lit("later")}))
    once = build.add_nodes(twice)
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in n.collect()}
    assert {tuple(r) for r in build.add_nodes(once).collect()} == {tuple(r) for r in once.collect()}


def test_placeholders(graph):
    n, e = graph
    got = {r["dst"]: (r["dst_exists"], r["placeholder"]) for r in build.with_placeholder(e, n).collect()}
    assert got["table:t"] == (True, False)
    assert got["table:gone"] == (False, True)
    assert got["queue:kafka"] == (False, False)
    assert got["unresolved:component:C"] == (False, True)


def test_schema_errors(spark):
    rows = [("a", "class", "HIGH", "derived"), ("b", "quantum", "HIGH", "derived"), ("c", "capability", None, "asserted"), ("d", "capability", "HIGH", "asserted"), ("e", "class", None, "derived")]
    df = spark.createDataFrame(rows, "id string, kind string, confidence string, provenance string")
    got = {r["id"]: r["e"] for r in df.select("id", build.node_errors().alias("e")).collect()}
    assert got["a"] == [] and got["c"] == []
    assert got["b"] == ["unknown kind"] and got["d"] == ["asserted node with a confidence"] and got["e"] == ["unknown confidence"]
    assert len(S.NODE_KINDS) == 51 and len(S.EDGE_TYPES) == 35


def test_broken_and_validate(graph):
    n, e = graph
    # Besides the queue, the any-method endpoint is no placeholder and has no node.
    assert {r["dst"] for r in validate.broken_edges(e, n).collect()} == {"queue:kafka", "endpoint:* /a"}
    counts = {r["check"]: r["n"] for r in validate.validate(n, e).collect()}
    assert counts["broken_edge"] == 2 and counts["placeholder_edge"] == 4 and counts["unknown_kind"] == 0
    assert validate.verdict(validate.validate(n, e)).first()["status"] == "NEEDS_ATTENTION"


def test_resolution(graph):
    n, e = graph
    out = resolve.resolve(e, n)
    got = {r["edge_seq"]: r for r in out.collect()}
    assert (got[4]["dst"], got[4]["confidence"], got[4]["resolved"]) == ("ts:comp:C", "HIGH", None)
    assert (got[7]["dst"], got[7]["confidence"], got[7]["resolved"]) == ("endpoint:GET /a", "LOW", "any-method-match")
    # The method is registered once under its class and once under its name's last part.
    assert got[8]["dst"] in ("py:class:H#go", "unresolved:method:H#go")
    assert got[9]["confidence"] == "LOW" and got[9]["kept_unresolved"] == "unresolved:method:H#no"
    assert got[0]["dst"] == "py:class:H#go" and got[0]["confidence"] == "HIGH"


def test_resolution_is_ambiguous_with_two(spark):
    n = nodes(spark, [("ts:a:G", "guard", "G", "f", "HIGH", "ts", None), ("ts:b:G", "guard", "G", "f", "HIGH", "ts", None), ("java:class:x.K", "class", "K", "f", "HIGH", "java", None)])
    e = edges(spark, [("a", "unresolved:guard:G", "guarded-by", "MEDIUM"), ("a", "unresolved:class:K", "injects", "HIGH"), ("a", "unresolved:module:m", "imports", "MEDIUM"), ("a", "unresolved:method:K#m", "calls", "MEDIUM")])
    got = {r["edge_seq"]: (r["dst"], r["confidence"], r["resolved"]) for r in resolve.resolve(e, n).collect()}
    assert got[0] == ("unresolved:guard:G", "LOW", None)
    assert got[1] == ("java:class:x.K", "MEDIUM", "name-match")
    assert got[2] == ("unresolved:module:m", "MEDIUM", None)
    assert got[3] == ("java:class:x.K", "MEDIUM", "class-member")
    assert {r["ref"] for r in resolve.unresolved(resolve.resolve(e, n)).collect()} == {"unresolved:guard:G"}


def test_impact(spark, graph):
    n, e = graph
    adj = traverse.adjacency(n, e)
    closure = traverse.impact(adj, spark.createDataFrame([("table:t",)], "target string"))
    assert {(r["node"], r["level"]) for r in closure.collect()} == {("svc:S", 1), ("py:class:H#go", 2), ("endpoint:GET /a", 3), ("ts:comp:C", 4)}
    assert [r["name"] for r in traverse.impact_names(closure, n, S.ENTRY_KINDS).collect()] == ["GET /a"]
    assert {r["name"] for r in traverse.impact_names(closure, n, S.CONSUMER_KINDS).collect()} == {"S", "C"}
    shallow = traverse.impact(adj, spark.createDataFrame([("table:t",)], "target string"), depth=2)
    assert {r["node"] for r in shallow.collect()} < {r["node"] for r in closure.collect()}
    alone = traverse.impact(adj, spark.createDataFrame([("ts:comp:C",)], "target string"))
    assert alone.count() == 0


def test_shortest_path_and_no_path(spark, graph):
    n, e = graph
    adj = traverse.adjacency(n, e)
    seeds = spark.createDataFrame([("ts:comp:C",), ("table:t",), ("file:x",)], "seed string")
    got = {r["seed"]: (r["found"], r["hops"], r["path"]) for r in traverse.shortest_path(adj, seeds, spark.createDataFrame([("table:t",)], "target string")).collect()}
    assert got["ts:comp:C"] == (True, 4, "ts:comp:C > endpoint:GET /a > py:class:H#go > svc:S > table:t")
    assert got["table:t"] == (True, 0, "table:t")
    assert got["file:x"] == (False, -1, "")


def test_flow_candidates_fill_to_eight(spark):
    n = nodes(spark, [("endpoint:E", "endpoint", "E", "f", "HIGH", None, None), ("job:J", "job", "J", "f", "HIGH", None, None)])
    fan = [("h", f"t{i}", "reads", "HIGH") for i in range(12)]
    e = edges(spark, [("endpoint:E", "x", "handled-by", "HIGH"), ("endpoint:E", "h", "handled-by", "HIGH"), *fan, ("t0", "deep", "calls", "HIGH"), ("h", "unresolved:z", "calls", "HIGH")])
    got = {r["seed"]: r["chain"] for r in traverse.flow_candidates(n, e).collect()}
    # Eight after the first level; each later level still adds one node.
    assert got["endpoint:E"] == ["endpoint:E", "h", "t0", "t1", "t2", "t3", "t4", "t5", "deep"]
    assert got["job:J"] == ["job:J"]


def test_reach_and_neighbourhood(spark, graph):
    n, e = graph
    adj = traverse.adjacency(n, e)
    r = traverse.reach(adj, n, spark.createDataFrame([("endpoint:GET /a",), ("table:t",)], "seed string"))
    assert {x["seed"]: x["n_reach"] for x in r.collect()} == {"endpoint:GET /a": 3, "table:t": 0}
    near = traverse.neighbourhood(adj, spark.createDataFrame([("svc:S",)], "node string"), depth=1)
    assert {x["node"] for x in near.collect()} == {"svc:S", "py:class:H#go", "table:t", "queue:kafka"}


def test_deep_chains(spark):
    n = nodes(spark, [(f"n{i}", "class", f"n{i}", "f", "HIGH", "py", None) for i in range(55)])
    adj = traverse.adjacency(n, edges(spark, [(f"n{i}", f"n{i + 1}", "calls", "HIGH") for i in range(54)]))
    seeds = spark.createDataFrame([("n0",), ("n20",)], "seed string")
    got = {r["seed"]: (r["found"], r["hops"], r["path"]) for r in traverse.shortest_path(adj, seeds, spark.createDataFrame([("n15",)], "target string")).collect()}
    assert got == {"n0": (True, 15, " > ".join(f"n{i}" for i in range(16))), "n20": (True, 5, "n20 > n19 > n18 > n17 > n16 > n15")}
    assert {r["seed"]: r["n_reach"] for r in traverse.reach(adj, n, seeds).collect()} == {"n0": 54, "n20": 34}
    assert {r["seed"]: r["n_reach"] for r in traverse.reach(adj, n, seeds, limit=52).collect()} == {"n0": 51, "n20": 34}


def test_grouping(graph):
    n, _ = graph
    got = {r["id"]: r["g"] for r in n.select("id", inventory.group_of().alias("g")).collect()}
    assert got["svc:S"] == "claims.core"
    assert got["ts:comp:C"] == "c"
    assert got["table:t"] == "t"


def test_diff_of_a_graph_with_itself_is_empty(graph):
    n, e = graph
    assert validate.diff_nodes(n, n).count() == 0 and validate.diff_edges(e, e).count() == 0
    new = n.where("id != 'table:t'")
    assert [(r["op"], r["id"]) for r in validate.diff_nodes(n, new).collect()] == [("removed", "table:t")]


def test_freshness(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, sha256 string")
    assert {r["path"]: r["state"] for r in validate.freshness(old, new).collect()} == {"a": "fresh", "b": "stale", "c": "deleted", "d": "new"}


@pytest.mark.parametrize(("raw", "want"), [
    ("/api/x?y=1", "/api/x"), ("/api/x/", "/api/x"), ("/api/12", "/api/{id}"), ("/api/${id}/z", "/api"), ("http://x", None), ("/", "/"), ("/" + "a" * 500, None),
])
def test_norm_url(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "u string").select(X.norm_url(F.col("u"))).first()[0] == want


def test_text_functions(spark):
    df = spark.createDataFrame([("Hello, World of  Big-Data one two three four five", "GET /api/x", "java:class:a.b.C#m")], "t string, m string, i string")
    r = df.select(X.slug(F.col("t")).alias("s"), X.method_path(F.col("m")).alias("m"), X.simple_class(F.col("i")).alias("c"), X.md_cell(F.lit("a|b\nc")).alias("d")).first()
    assert r["s"] == "hello-world-of-big-data-one-two-three" and tuple(r["m"]) == ("GET", "/api/x") and r["c"] == "C" and r["d"] == "a\\|b c"


def test_walk_order(spark):
    rows = spark.createDataFrame([("b/x",), ("a/y/z",), ("c",), ("a/w",), ("a/y/a",)], "p string").withColumn("k", X.walk_key(F.col("p")))
    got = [r["p"] for r in sorted(scopes.global_rank(rows, "k").collect(), key=lambda r: r["rank"])]
    assert got == ["c", "a/w", "a/y/a", "a/y/z", "b/x"]


def test_global_rank_has_no_gaps(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = sorted((r["rank"], r["k"]) for r in scopes.global_rank(rows, "k").collect())
    assert [a for a, _ in got] == list(range(1, 1001)) and [b for _, b in got] == sorted(b for _, b in got)
