"""What the driver holds: no table of nodes is broadcast because its files are small."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.test_growth import plan
from waymark.operators import build, inventory, traverse, validate
from waymark.plans import lineage

EDGES = "src string, dst string, type string, file string, line int, confidence string, edge_seq long"


@pytest.fixture(scope="module")
def nodes(spark):
    """Many like ids in small files, of which Spark's own estimate is far below its threshold."""
    c = F.col("id").cast("string")
    ids = spark.range(120_000).select(
        F.concat(F.lit("class:"), c).alias("id"), F.when(F.col("id") < 10, "service").otherwise("class").alias("kind"), F.concat(F.lit("C"), c).alias("name"),
        F.lit("f").alias("file"), F.lit(1).alias("line"), F.lit("HIGH").alias("confidence"), F.lit("p.q").alias("package"), F.col("id").alias("node_seq"),
    )
    return lineage.cut(ids, "zstd")


@pytest.fixture(scope="module")
def edges(spark):
    pairs = [("class:1", "class:2"), ("class:3", "class:1"), ("class:70000", "class:70001"), ("gone:1", "class:5"), ("class:5", "gone:2"), ("class:5", "table:x"), ("class:5", "unresolved:class:X"), (None, "class:5")]
    return lineage.cut(spark.createDataFrame([(a, b, "calls", "f", 1, "LOW" if b == "gone:2" else "HIGH", i) for i, (a, b) in enumerate(pairs)], EDGES))


@pytest.fixture
def cuts(monkeypatch):
    """Plans of the tables that the named module writes."""

    def of(module):
        plans, real = [], module.cut
        monkeypatch.setattr(module, "cut", lambda df, *a: (plans.append(plan(df)), real(df, *a))[1])
        return plans

    return of


def ends(df):
    return sorted((r["src"] or "", r["dst"]) for r in df.collect())


# F1
def test_missing_ids_are_found_without_a_broadcast_of_the_nodes(nodes, edges, cuts):
    plans = cuts(build)
    found = validate.broken_edges(edges, nodes)
    assert len(plans) == 1 and "Broadcast" not in plans[0]
    assert ends(found) == [("", "class:5"), ("class:5", "gone:2"), ("gone:1", "class:5")]
    assert ends(validate.broken_edges(edges, nodes.where("kind != 'service'"))) == sorted([*ends(found), ("class:1", "class:2"), ("class:3", "class:1"), ("class:5", "table:x"), ("class:5", "unresolved:class:X")])


# F1
def test_many_missing_ids_are_no_broadcast_either(nodes, edges, monkeypatch):
    monkeypatch.setattr(build, "MISSING_ROWS", 2)
    found = validate.broken_edges(edges, nodes)
    assert "Broadcast" not in plan(found) and len(ends(found)) == 3


# F2
def test_ends_of_view_edges_are_looked_up_without_a_broadcast(nodes, edges, cuts):
    plans = cuts(inventory)
    view = inventory.capped_view_edges(edges, nodes)
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans)
    assert ends(view) == [("class:1", "class:2"), ("class:3", "class:1"), ("class:70000", "class:70001")]


# F3
def test_group_counts_broadcast_only_the_nodes_of_the_view(nodes, edges, cuts):
    plans = cuts(inventory)
    table = inventory.group_table(nodes, inventory.capped_view_edges(edges, nodes))
    assert [tuple(r) for r in inventory.group_counts(table).collect()] == [("p.q", 5, 5, 0, 0, 0)]
    assert ["Broadcast" in p for p in plans] == [False] * 3 + [True]  # two shares, the ids of the view, its nodes


# F4
def test_group_edges_broadcast_only_the_nodes_of_the_view(spark, nodes, edges, cuts):
    plans = cuts(inventory)
    area = F.when(F.col("node_seq") < 50_000, "p.q").otherwise("r.s").alias("package")
    own = lineage.cut(nodes.select(*[c for c in nodes.columns if c != "package"], area), "zstd")
    more = edges.unionByName(spark.createDataFrame([(f"class:{i}", f"class:{60_000 + i}", "calls", "f", 1, "HIGH", 100 + i) for i in range(4)], EDGES))
    view = inventory.capped_view_edges(more, own)
    assert [tuple(r) for r in inventory.group_edges(inventory.group_table(own, view), view).collect()] == [("p.q", "r.s", "calls", "HIGH")]
    assert ["Broadcast" in p for p in plans] == [False] * 3 + [True]


# F5
def test_issues_look_up_missing_ids_once_and_without_a_broadcast_of_the_nodes(nodes, edges, cuts):
    plans = cuts(build)
    found = validate.issues(nodes.where("id != 'class:3'"), edges, edges.where("dst LIKE 'unresolved:%'").select(F.col("dst").alias("ref")))
    assert len(plans) == 1 and "Broadcast" not in plans[0] and "LeftAnti" not in plan(found)
    assert sorted((r["message"], r["id"] or "") for r in found.collect()) == [
        ("LOW-confidence edge calls", "class:5"), ("edge with unknown dst calls", "gone:2"), ("edge with unknown src calls", ""),
        ("edge with unknown src calls", "class:3"), ("edge with unknown src calls", "gone:1"), ("unresolved reference", "unresolved:class:X"),
    ]


# F7
def test_checks_look_up_missing_ids_once_and_without_a_broadcast_of_the_nodes(nodes, edges, cuts):
    plans = cuts(build)
    found = validate.validate(nodes, edges)
    assert len(plans) == 1 and "Broadcast" not in plans[0]
    got = {r["check"]: r["n"] for r in found.collect()}
    assert {k: n for k, n in got.items() if n} == {"broken_edge": 3, "placeholder_edge": 2, "low_confidence": 1}


def broadcast_rows(df) -> list[int]:
    """The rows of each table that a plan broadcasts."""
    of = df.sparkSession._jvm.org.apache.spark.sql.classic.Dataset.ofRows

    def walk(node):
        own = [of(df.sparkSession._jsparkSession, node.child().logicalLink().get()).count()] if node.nodeName() == "BroadcastExchange" else []
        kids = node.children()
        return own + [n for i in range(kids.size()) for n in walk(kids.apply(i))]

    top = df._jdf.queryExecution().executedPlan()
    return walk(top.executedPlan() if top.nodeName() == "AdaptiveSparkPlan" else top)


# F6
def test_reach_broadcasts_no_side_that_was_not_counted(spark, nodes, monkeypatch):
    sizes, real = [], traverse.cut

    class Seen(lineage.Levels):
        def append(self, part):
            sizes.extend(broadcast_rows(part))
            return super().append(part)

    monkeypatch.setattr(traverse, "Levels", Seen)
    monkeypatch.setattr(traverse, "cut", lambda df, *a: (sizes.extend(broadcast_rows(df)), real(df, *a))[1])
    monkeypatch.setattr(build, "cut", lambda df, *a: (sizes.extend(broadcast_rows(df)), real(df, *a))[1])
    # 110,000 nodes lead to a hub of 30; one leads to them, and two lead to each other.
    own = F.col("id").cast("string")
    into = spark.range(100, 110_100).select(F.concat(F.lit("class:"), own).alias("src"), F.lit("class:0").alias("dst"))
    more = [("class:0", f"class:{i}") for i in range(1, 31)] + [("class:50", "class:200"), ("class:60", "class:61"), ("class:61", "class:60"), ("class:61", "gone")]
    adj = lineage.cut(into.unionByName(spark.createDataFrame(more, "src string, dst string")), "zstd")
    got = traverse.reach(adj, nodes, nodes.select(F.col("id").alias("seed")), limit=30)
    assert sizes and max(sizes) <= lineage.BROADCAST_ROWS
    assert {(r["n_reach"], r["n"]) for r in got.groupBy("n_reach").agg(F.count("*").alias("n")).collect()} == {(29, 110_002), (1, 2), (0, 9_996)}
