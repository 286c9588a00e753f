from __future__ import annotations

import pytest

from waymark.operators import bindings

NODE = "id string, kind string, name string, title string, file string, line int, provenance string, source string, author string, node_seq long"
EDGE = "src string, dst string, type string, provenance string, why string, review_reason string, meta map<string,string>"


@pytest.fixture(scope="module")
def graph(spark):
    rows = [
        ("py:save", "function", "save", None, "a.py", 3, "derived"), ("py:save_all", "function", "save_all", None, "a.py", 9, "derived"), ("py:load", "function", "load", None, None, None, "derived"),
        ("intent:slice:one", "slice", "One", "Slice one", "p.md", 1, "asserted"), ("intent:slice:two", "slice", "Two", None, "p.md", 2, "asserted"),
        ("intent:req:keep", "requirement", "Keep claims", "Keep", "r.md", 5, "asserted"), ("intent:dec:db", "decision", "DB", None, "d.md", 1, "asserted"), ("py:two", "class", "two", None, "b.py", 1, "derived"),
    ]
    nodes = spark.createDataFrame([(*r, "doc", "me", i) for i, r in enumerate(rows)], NODE)
    edges = spark.createDataFrame([("py:load", "intent:req:keep", "realizes", "asserted", "old reason", None, {"x": "y"}), ("py:save", "py:load", "calls", "derived", None, None, None)], EDGE)
    return nodes, edges


def run(spark, graph, *asks):
    full = [(i, a.get("slice", "intent:slice:one"), a.get("realizes", "intent:req:keep"), a.get("decision"), a.get("codes", ["py:load"]), a.get("why", "because"), a.get("author"), a.get("declares")) for i, a in enumerate(asks)]
    return bindings.bind_asks(*graph, spark.createDataFrame(full, bindings.ASK))


def test_edges_of_one_ask(spark, graph):
    got = run(spark, graph, {"codes": ["py:save", " py:load ,py:two,"], "decision": "intent:dec:db", "author": "ann", "declares": ["a.py", " "], "why": " it keeps "})
    assert got.problems.count() == 0
    made = {(r["src"], r["dst"], r["type"]): (r["file"], r["line"], r["why"], r["author"], r["meta"]) for r in got.made.collect()}
    note = {"declares_files": '["a.py"]'}
    assert made[("py:save", "intent:req:keep", "realizes")] == ("a.py", 3, "it keeps", "ann", note)
    assert made[("py:load", "intent:slice:one", "delivered-in")] == ("p.md", None, "it keeps", "ann", note)
    assert made[("py:two", "intent:dec:db", "motivated-by")] == ("b.py", 1, "it keeps", "ann", None)
    assert len(made) == 8 and ("py:load", "intent:req:keep", "realizes") not in made
    kept = [r for r in got.edges.collect() if r["src"] == "py:load" and r["type"] == "realizes"]
    assert [(r["why"], r["meta"]) for r in kept] == [("old reason", {"x": "y"} | note)]
    assert got.edges.count() == 10


def test_names_are_resolved_by_role(spark, graph):
    got = run(
        spark, graph, {"slice": "Slice:ONE"}, {"slice": "two"}, {"slice": "intent:slice"}, {"slice": "py:two"}, {"slice": None}, {"realizes": "claims"}, {"realizes": "save"}, {"realizes": "py:save"},
        {"decision": "DB"}, {"decision": "py:load"}, {"codes": ["SAVE"]}, {"codes": ["intent:dec:db"]}, {"codes": ["nope"]}, {"codes": [" ", ","]}, {"why": "  "}, {"codes": None}, {"slice": "zzz", "codes": []}, {"decision": ""},
    )
    problems = {}
    for r in got.problems.collect():
        problems.setdefault(r["ask"], set()).add(r["problem"])
    assert problems == {
        2: {"slice 'intent:slice' is ambiguous: 2 nodes"}, 3: {"slice 'py:two' is a derived node: py:two"}, 4: {"slice '' is unknown"}, 6: {"realizes 'save' is unknown"},
        7: {"realizes 'py:save' is a derived node: py:save"}, 8: {"decision 'DB' is unknown"}, 9: {"decision 'py:load' is a derived node: py:load"}, 11: {"code 'intent:dec:db' is an intent node: intent:dec:db"},
        12: {"code 'nope' is unknown"}, 13: {"no code"}, 14: {"no reason"}, 15: {"no code"}, 16: {"slice 'zzz' is unknown"},
    }
    assert [(r["ask"], r["text"], r["id"]) for r in got.notes.collect()] == [(10, "SAVE", "py:save")]
    assert {(r["src"], r["dst"], r["type"]) for r in got.made.collect()} == {
        ("py:load", "intent:slice:one", "delivered-in"), ("py:load", "intent:slice:two", "delivered-in"), ("py:save", "intent:req:keep", "realizes"), ("py:save", "intent:slice:one", "delivered-in")}


def test_asks_act_in_order(spark, graph):
    got = run(spark, graph, {"codes": ["py:save"], "why": "first", "declares": ["one"]}, {"codes": ["py:save"], "why": "second"}, {"codes": ["py:save"], "why": "third", "declares": ["three"]})
    assert {(r["why"], r["meta"]["declares_files"]) for r in got.made.collect()} == {("first", '["three"]')}
    again = bindings.bind_asks(graph[0], got.edges, spark.createDataFrame([(1, "intent:slice:one", "intent:req:keep", None, ["py:save"], "later", None, None)], bindings.ASK))
    assert again.made.count() == 0 and again.edges.count() == got.edges.count()
    assert {r["meta"]["declares_files"] for r in again.edges.where("src = 'py:save' AND type != 'calls'").collect()} == {'["three"]'}


def test_no_asks(spark, graph):
    got = bindings.bind_asks(*graph, spark.createDataFrame([], bindings.ASK))
    assert [got.made.count(), got.problems.count(), got.edges.count()] == [0, 0, 2]


def test_explanations_come_by_type(spark, graph):
    nodes, _ = graph
    edges = run(spark, graph, {"codes": ["py:save,py:save_all"], "decision": "intent:dec:db"}).edges
    told = bindings.explain(nodes, edges, "a.py").collect()
    assert [(r["type"], r["code"], r["claim"]) for r in told] == [
        ("realizes", "py:save", "Keep"), ("realizes", "py:save_all", "Keep"), ("delivered-in", "py:save", "Slice one"), ("delivered-in", "py:save_all", "Slice one"),
        ("motivated-by", "py:save", "DB"), ("motivated-by", "py:save_all", "DB")]
    assert {r["code"] for r in bindings.explain(nodes, edges, "py:save").collect()} == {"py:save"}
    assert [r["intent"] for r in bindings.explain(nodes, edges, "intent:dec:db").collect()] == ["py:save", "py:save_all"]
    assert bindings.explain(nodes, edges, "nobody").count() == 0
