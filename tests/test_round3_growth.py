"""What the work of a traversal grows with: pairs, levels, repeated walks, sorts of a task."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.test_growth import plan
from waymark.operators import inventory, layers, scopes, traverse, views
from waymark.plans import lineage

NODES = "id string, kind string, name string, file string, line int, confidence string, lang string, node_seq long"
ADJ = "src string, dst string, type string, edge_seq long"


def adj(spark, pairs):
    return spark.createDataFrame([(a, b, "calls", i) for i, (a, b) in enumerate(pairs)], ADJ)


def nodes(spark, kinds):
    return spark.createDataFrame([(i, k, i.upper(), "f", 1, "HIGH", None, s) for s, (i, k) in enumerate(kinds.items())], NODES)


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, -1)
    yield
    spark.conf.set(key, before)


# F5
def test_paths_rank_only_the_nodes_in_question(spark, monkeypatch):
    real, asked = traverse.both_ways, []
    monkeypatch.setattr(traverse, "both_ways", lambda a, cap=None, of=None: (asked.append(of), real(a, cap, of))[1])
    edges = [("s", "a"), ("s", "b"), ("a", "x"), ("b", "x"), ("b", "t"), ("a", "t"), ("x", "y")] + [("t", f"far{i}") for i in range(4)]
    seeds = spark.createDataFrame([("s",), ("y",), ("gone",)], "seed string")
    got = traverse.shortest_path(adj(spark, edges), seeds, spark.createDataFrame([("t",)], "target string"))
    assert {r["seed"]: r["path"] for r in got.collect()} == {"s": "s > a > t", "y": "y > x > a > t", "gone": ""}
    assert asked and all(of is not None for of in asked)
    got = traverse.shortest_path(adj(spark, edges), seeds, spark.createDataFrame([("t",)], "target string"), fanout_cap=1)
    assert {r["seed"]: r["path"] for r in got.collect()} == {"s": "", "y": "", "gone": ""}


# F8
def test_seeds_that_lead_to_a_hub_make_no_pairs(spark, monkeypatch):
    pairs = []

    class Seen(lineage.Levels):
        def append(self, part):
            out = super().append(part)
            pairs.append(self.n_rows if {"seed", "node"} <= set(self.schema.names) else 0)
            return out

    monkeypatch.setattr(traverse, "Levels", Seen)
    edges = [(f"s{i}", f"a{i}") for i in range(50)] + [(f"a{i}", "hub") for i in range(49)] + [("hub", f"n{i}") for i in range(30)] + [("a49", "n1")]
    ids = {x: "class" for x in dict.fromkeys(y for e in edges for y in e)}
    seeds = spark.createDataFrame([(f"s{i}",) for i in range(50)] + [("hub",)], "seed string")
    got = {r["seed"]: r["n_reach"] for r in traverse.reach(adj(spark, [*edges, *edges]), nodes(spark, ids), seeds, limit=30).collect()}
    assert got == {f"s{i}": 29 for i in range(49)} | {"s49": 2, "hub": 29}
    assert sum(pairs) == 3


# F9, F20
def test_what_follows_a_handler_is_walked_once(spark, monkeypatch):
    walked, real = [], traverse._walked
    monkeypatch.setattr(traverse, "_walked", lambda chains, walk, cap: (walked.extend(r["seed"] for r in chains.collect()), real(chains, walk, cap))[1])
    kinds = {f"e{i}": "endpoint" for i in range(20)} | {"h": "service", "bare": "endpoint", "job": "job", "t": "table"}
    rows = [(f"e{i}", "h", "handled-by", i) for i in range(20)] + [("h", "e3", "calls", 30), ("h", "t", "reads", 31), ("job", "e1", "calls", 32)]
    flows = traverse.flow_candidates(nodes(spark, kinds), spark.createDataFrame(rows, ADJ))
    got = {r["seed"]: r["chain"] for r in flows.collect()}
    assert got.pop("job") == ["job", "e1", "h", "e3", "t"] and got.pop("bare") == ["bare"]
    assert got == {f"e{i}": [f"e{i}", "h", "e3", "t"] if i != 3 else ["e3", "h", "t"] for i in range(20)}
    assert sorted(walked) == ["e3", "h", "job"]
    names = {r["seed"]: r["names"] for r in views.flow_names(flows, nodes(spark, kinds).where("id != 't'")).collect()}
    assert names["e5"] == "E5 → H → E3 → t" and names["bare"] == "BARE"


# F10
def test_ranks_need_no_second_sort(spark):
    got = scopes.global_rank(spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k")), "k")
    assert "row_number" not in plan(got)
    assert got.where("rank != k + 1").count() == 0 and got.count() == 5000


# F13
def test_a_closure_is_no_side_of_a_shuffle(spark, no_broadcast):
    closure = spark.createDataFrame([("t", "a", 1), ("t", "b", 2)], "target string, node string, level int")
    got = traverse.impact_names(closure, nodes(spark, {"a": "endpoint", "b": "table"}), ("endpoint",))
    assert "SortMergeJoin" not in plan(got) and [tuple(r) for r in got.collect()] == [("t", "A")]


# F15, F16
def test_modes_are_no_window_over_all_nodes(spark, monkeypatch):
    plans, real = [], inventory.cut
    monkeypatch.setattr(inventory, "cut", lambda df, *a: (plans.append(plan(df)), real(df, *a))[1])
    kinds = {f"e{i}": "endpoint" for i in range(20)} | {f"t{i}": "table" for i in range(20)}
    want, links = inventory.view_modes(nodes(spark, kinds), spark.createDataFrame([(f"e{i}", f"t{i}", "reads", i) for i in range(20)], ADJ), most=6, most_edges=4)
    assert not any("Window" in line and "bit#" in line for p in [*plans, plan(links)] for line in p.splitlines())
    got = {r["mode"]: r["n"] for r in want.groupBy("mode").agg(F.count("*").alias("n")).collect()}
    assert got == dict.fromkeys(inventory.MODES, 6) | {"call-graph": 3, "dependency": 3}  # reads are of neither, so their seeds have no neighbours
    assert links.where("mode = 'database'").count() == 3


# F18
def test_peeling_writes_no_node_again(spark, monkeypatch):
    written, real = [], layers.cut

    def cut(df, *a):
        out = real(df, *a)
        written.append(out.count() if df.columns == ["id"] else 0)
        return out

    monkeypatch.setattr(layers, "cut", cut)
    chain = adj(spark, [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(12)])
    assert {r["id"]: r["steps"] for r in layers.longest_steps(chain, nodes(spark, {"c00": "class"})).collect()} == {f"c{i:02d}": 12 - i for i in range(13)}
    assert sum(written) <= 13


# F19
def test_edges_that_pass_are_not_shuffled_for_few_ids_that_are_off(spark, no_broadcast):
    kinds = {"a": "service", "b": "table", "c": "module"}
    edges = spark.createDataFrame([("a", "b", "reads", "HIGH"), ("c", "b", "reads", "HIGH"), ("a", "c", "reads", "HIGH"), ("a", "none", "reads", "HIGH"), ("a", None, "reads", "HIGH")], "src string, dst string, type string, confidence string")
    got = views.passing_edges(edges, nodes(spark, kinds), ["service", "table"])
    assert "SortMergeJoin" not in plan(got) and [(r["src"], r["dst"]) for r in got.collect()] == [("a", "b")]


# F21
def test_a_task_of_fanout_has_a_bounded_number_of_rows(spark):
    edges = adj(spark, [("hub", f"n{i}") for i in range(300)] + [(f"n{i}", "hub") for i in range(40)])
    got = inventory.fanout(edges, 3, rows=20_000_000)
    assert got.rdd.getNumPartitions() >= 20
    rows = lambda df: {(r["src"], r["dst"], r["pos"]) for r in df.collect()}
    assert rows(got) == rows(inventory.fanout(edges, 3)) and len(rows(got)) == 43
