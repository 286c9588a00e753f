"""Incremental runs against a new scan, snapshots and their log."""

from __future__ import annotations

import hashlib
import threading

import pytest
from pyspark.sql import functions as F

from waymark.plans.full_scan import full_scan
from waymark.plans.lineage import cut
from waymark.samples import SOURCES
from waymark.sources import snapshots, store
from waymark.sources.snapshots import Conflict, Snapshots, create_exclusively
from waymark.streaming import incremental, sync


def tree(spark, texts):
    rows = [(p, t.encode(), hashlib.sha256(t.encode()).hexdigest()) for p, t in sorted(texts.items())]
    return spark.createDataFrame(rows, "path string, content binary, sha256 string")


SERVICE = "package shop;\n\n@Service\npublic class {name} {{\n  private final {other} other;\n  public String load() {{ return other.load(); }}\n}}\n"
A = {"src/main/java/shop/Orders.java": SERVICE.format(name="Orders", other="Repo")}
B = {"src/main/java/shop/Repo.java": SERVICE.format(name="Repo", other="Orders")}
TWIN = {"src/main/java/other/Repo.java": SERVICE.format(name="Repo", other="Orders").replace("package shop", "package other")}
STEPS = [
    SOURCES | A,
    # A target comes, and a second one of the same name; one file is renamed and changed.
    {k: v for k, v in (SOURCES | A | B | TWIN).items() if k != "app/api.py"} | {"app/other.py": SOURCES["app/api.py"].replace("items", "things")},
    SOURCES | A | TWIN,  # the first one goes
]


def rows(graph):
    n = sorted(tuple(r) for r in graph.nodes.select("id", "kind", "name", "file", "line", "confidence", "lang", "package").collect())
    e = sorted((tuple(r) for r in graph.edges.select("src", "dst", "type", "file", "line", "confidence", "resolved").collect()), key=str)
    f = sorted((r["seed"], r["kind"], tuple(r["chain"])) for r in graph.flows.collect())
    return n, e, f, sorted(tuple(r) for r in graph.stack.select("section", "name", "confidence").collect())


def test_every_step_equals_a_new_scan(spark):
    graph = incremental.empty(spark)
    for texts in STEPS:
        files = tree(spark, texts)
        change = incremental.advance(graph, files)
        graph = incremental.Graph(**{t: cut(df) for t, df in change.applied(graph).tables().items()})
        got, wanted = rows(graph), rows(full_scan(spark, files))
        for part, name in enumerate(("nodes", "edges", "flows", "stack")):
            assert got[part] == wanted[part], (name, sorted(texts))
        assert {r["path"] for r in graph.hashes.collect()} == set(texts)


def test_a_change_touches_little(spark):
    texts = SOURCES | {f"lib/m{i}.py": f"class M{i}:\n    pass\n" for i in range(40)}
    none = incremental.empty(spark)
    graph = incremental.Graph(**{t: cut(df) for t, df in incremental.advance(none, tree(spark, texts)).applied(none).tables().items()})
    change = incremental.advance(graph, tree(spark, texts | {"lib/m7.py": "class M7:\n    pass\n\n\nclass More:\n    pass\n"}))
    assert {r["id"] for r in change.rows["nodes"].collect()} == {"file:lib/m7.py", "py:class:M7", "py:class:More"}
    assert {r["file"] for r in change.rows["edges"].collect()} == {"lib/m7.py"} and change.rows["hashes"].count() == 1


def test_a_stored_graph_follows_its_tree(spark, tmp_path):
    folder = f"file://{tmp_path}/map"
    claim = spark.createDataFrame([("cap:x", "capability", "X", "docs/x.md", "asserted")], "id string, kind string, name string, file string, provenance string")
    bind = spark.createDataFrame([("java:class:shop.Repo", "cap:x", "realizes", "asserted", "manual")], "src string, dst string, type string, provenance string, binding string")
    none = spark.createDataFrame([], store.HASHES)
    n, e = store.empty(spark)
    store.save(n.unionByName(claim, allowMissingColumns=True), e.unionByName(bind, allowMissingColumns=True), none, folder)
    for step, texts in enumerate((A, A | B, A)):
        sync.sync_map(spark, folder, tree(spark, texts), f"c{step}", pages=step == 1)
        kept, wanted = store.load(spark, folder), full_scan(spark, tree(spark, texts))
        own = kept.edges.where("provenance = 'derived'")
        pick = lambda df: sorted((tuple(r) for r in df.select("src", "dst", "type", "confidence").collect()), key=str)
        assert pick(own) == pick(wanted.edges)
        assert {(r["seed"], tuple(r["chain"])) for r in kept.flows.collect()} == {(r["seed"], tuple(r["chain"])) for r in wanted.flows.collect()}
        assert kept.nodes.where("id = 'cap:x'").count() == 1
        reason = kept.edges.where("binding = 'manual'").first()["review_reason"]
        assert reason == ("file changed" if step == 1 else "code node vanished") if step < 2 else reason is not None
    second = store.load(spark, folder, seq=3)  # an old snapshot
    assert second.state["last_sync_commit"] == "c1" and second.nodes.where("id = 'java:class:shop.Repo'").count() == 1
    assert kept.nodes.where("id = 'java:class:shop.Repo'").count() == 0
    assert "Repo" in "\n".join(r["value"] for r in spark.read.text(f"{folder}/views/symbols").collect())


def numbers(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id string, v int")


def test_parts_replace_keys_and_are_written_whole_in_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MAX_PARTS", 3)
    store_ = Snapshots(spark, f"file://{tmp_path}/s")
    assert store_.entry() is None and store_.log().count() == 0
    entry = store_.commit(None, {"nodes": numbers(spark, ("a", 1), ("b", 1), ("c", 1))}, version=1)
    wanted = {"a": 1, "b": 1, "c": 1}
    history = {1: dict(wanted)}
    for i in range(2, 8):
        key = "abc"[i % 3]
        gone = i % 5 == 0
        part = numbers(spark) if gone else numbers(spark, (key, i))
        entry = store_.commit(entry, {"nodes": part}, {"nodes": numbers(spark, (key, 0)).select("id")}, version=1)
        wanted = {k: v for k, v in wanted.items() if k != key} | ({} if gone else {key: i})
        history[i] = dict(wanted)
        assert entry["node_count"] == len(wanted) and len(entry["parts"]) <= 3
    for seq, rows_ in history.items():
        assert {r["id"]: r["v"] for r in store_.read("nodes", store_.entry(seq)).collect()} == rows_


def test_of_two_writers_one_fails(spark, tmp_path):
    store_ = Snapshots(spark, f"file://{tmp_path}/s")
    entry = store_.commit(None, {"nodes": numbers(spark, ("a", 1))}, version=1)
    results, gate = [], threading.Barrier(2)

    def write(v):
        gate.wait()
        try:
            store_.commit(entry, {"nodes": numbers(spark, ("a", v))}, {"nodes": numbers(spark, ("a", 0)).select("id")}, version=1)
            results.append(v)
        except Conflict:
            results.append(None)

    threads = [threading.Thread(target=write, args=(v,)) for v in (2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [r for r in results if r is not None]
    assert len(results) == 2 and len(won) == 1
    assert [r["v"] for r in store_.read("nodes", store_.entry()).collect()] == won and store_.entry()["seq"] == 2


def test_a_name_is_made_once(spark, tmp_path):
    path = f"file://{tmp_path}/log/1.json"
    create_exclusively(spark, path, "one")
    with pytest.raises(Conflict):
        create_exclusively(spark, path, "two")
    assert [r["value"] for r in spark.read.text(path).collect()] == ["one"]
    assert spark.read.text(f"file://{tmp_path}/log").where(F.col("value") != "one").count() == 0
