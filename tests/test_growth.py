"""What grows with the tables: how files are dealt to tasks, and which edges are joined."""

from __future__ import annotations

import pytest

from waymark.operators import build, detect, inventory, validate
from waymark.sources import extract

NODES = "id string, kind string, name string, file string, line int, confidence string, node_seq long"
EDGES = "src string, dst string, type string, file string, line int, confidence string, edge_seq long"


@pytest.fixture
def graph(spark):
    nodes = [(f"{k}:{i}", k, f"{k}{i}", "f", i, "HIGH", i) for i in range(30) for k in ("service", "table", "file")]
    edges = [(f"service:{i}", f"{to}:{j}", "reads", "f", 1, c, 100 * i + j) for i in range(30) for j, (to, c) in enumerate((("service", "HIGH"), ("table", "MEDIUM"), ("table", "LOW"), ("file", "HIGH")))]
    edges += [("service:1", "table:none", "writes", "f", 1, "LOW", 9001), ("service:1", "unresolved:class:X", "calls", "f", 1, None, 9002), ("gone:1", "gone:2", "calls", "f", 1, "HIGH", 9003)]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_of_one_split_are_dealt_to_all_tasks(spark):
    files = spark.range(40).coalesce(1).selectExpr("concat('a/f', id, '.py') AS path", "encode(concat('class A', id, ':\\n    pass\\n'), 'UTF-8') AS content")
    rows = extract.emissions(files)
    assert rows.rdd.getNumPartitions() >= 4
    assert rows.where("row = 'node'").count() == 80


def test_files_of_no_interest_meet_no_needle(spark):
    files = spark.createDataFrame([("a/b.java", "fastapi"), ("x/requirements-dev.txt", "fastapi"), ("a/My.sln", None)], "path string, text string")
    df = detect.detect(spark, files)
    assert {(r["name"], r["confidence"]) for r in df.collect()} >= {("fastapi", "HIGH"), ("python", "HIGH"), ("csharp", "HIGH"), ("java", "LOW")}
    assert any("Filter" in x and "RLIKE" in x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_edges_are_not_shuffled_to_find_placeholders(spark, graph):
    nodes, edges = graph
    live = build.resolved_edges(edges, nodes)
    assert "SortMergeJoin" not in plan(live) and "Exchange hashpartitioning" not in plan(live)
    assert live.count() == 121
    assert {r["dst"] for r in build.placeholder_edges(edges, nodes).collect()} == {"table:none", "unresolved:class:X"}
    flagged = build.with_placeholder(edges, nodes)
    assert "Exchange hashpartitioning" not in plan(flagged)
    assert {r["dst"] for r in flagged.where("NOT dst_exists").collect()} == {"table:none", "unresolved:class:X", "gone:2"}


def test_broken_edges_join_only_missing_ids(spark, graph):
    nodes, edges = graph
    found = validate.broken_edges(edges, nodes.where("kind != 'file'"))
    assert "Exchange hashpartitioning" not in plan(found)
    assert {(r["src"], r["dst"]) for r in found.collect()} == {("gone:1", "gone:2")} | {(r["src"], r["dst"]) for r in edges.where("dst LIKE 'file:%'").collect()}


@pytest.mark.parametrize(("cap", "joined"), [(20, {"HIGH", "LOW"}), (1200, {"HIGH", "MEDIUM", "LOW", None})])
def test_view_edges_join_no_confidence_below_a_full_share(spark, graph, monkeypatch, cap, joined):
    nodes, edges = graph
    seen, real = set(), inventory.view_edges

    def view(own, of):
        seen.update(r["confidence"] for r in own.collect())
        return real(own, of)

    monkeypatch.setattr(inventory, "view_edges", view)
    got = [(r["src"], r["dst"], r["confidence"]) for r in inventory.capped_view_edges(edges, nodes, cap).collect()]
    assert seen == joined
    ids = {r["id"] for r in nodes.where("kind != 'file'").collect()}
    rows = [r for r in edges.collect() if r["src"] in ids and r["dst"] in ids]
    rank = {"HIGH": 0, "MEDIUM": 1}
    own = sorted((r for r in rows if r["confidence"] != "LOW"), key=lambda r: (rank.get(r["confidence"], 3), r["src"], r["dst"], r["edge_seq"]))
    low = sorted((r for r in rows if r["confidence"] == "LOW"), key=lambda r: (r["src"], r["dst"], r["edge_seq"]))
    main = int(cap * 0.85)
    want = [(r["src"], r["dst"], r["confidence"]) for r in own[:main] + low[: cap - main]]
    assert sorted(got, key=str) == sorted(want, key=str)
