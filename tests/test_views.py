"""Views, the stored graph, incremental runs and configuration files."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tests.test_sources import graph as extracted
from waymark.operators import traverse, views
from waymark.plans import full_scan
from waymark.samples import SOURCES
from waymark.sources import configs, files, store
from waymark.streaming import sync

NODE = "id string, kind string, name string, file string, line int, confidence string, provenance string, lang string, package string, status string, node_seq long"
EDGE = "src string, dst string, type string, file string, line int, confidence string, provenance string, edge_seq long"


def nodes(spark, *rows):
    """(id, kind, name), in order."""
    return spark.createDataFrame([(i, k, n, f"{n}.py", 3, "HIGH", "derived", "py", None, None, s) for s, (i, k, n) in enumerate(rows)], NODE)


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, t, "x.py", 1, "HIGH", "derived", s) for s, (a, b, t) in enumerate(rows)], EDGE)


def source(spark, **texts):
    raw = [(p.replace("__", "/").replace("_py", ".py"), t.encode(), hashlib.sha256(t.encode()).hexdigest()) for p, t in texts.items()]
    return spark.createDataFrame(raw, "path string, content binary, sha256 string")


@pytest.fixture(scope="module")
def small(spark):
    n = nodes(spark, ("e:1", "endpoint", "GET /a"), ("h:1", "handler", "do"), ("table:t", "table", "t"), ("c:1", "component", "page"), ("m:1", "migration", "V1"),
              ("auth:x", "configuration", "x"), ("g:1", "guard", "g"), ("env:K", "environment", "K"))
    e = edges(spark, ("e:1", "h:1", "handled-by"), ("h:1", "table:t", "reads"), ("h:1", "unresolved:call:z", "calls"), ("c:1", "e:1", "consumes"),
              ("m:1", "table:t", "creates"), ("c:1", "g:1", "guarded-by"))
    return n, e


def test_pages(small):
    n, e = small
    row = views.api_map(n, e).first()
    assert (row["handler"], row["downstream"], row["consumers"]) == ("do", ["reads t (HIGH)", "calls unresolved:call:z (HIGH)"], ["page.py"])
    assert [tuple(r) for r in views.migration_page(n, e).collect()] == [("V1", "V1.py", ["creates t"])]
    assert [(r["route"], r["guard"]) for r in views.route_guards(e, n).collect()] == [("page", "g:1")]
    assert {r["name"] for r in views.authentication_page(n).collect()} == {"x", "g"}
    assert [r["caller"] for r in views.call_page(e, n).collect()] == []
    assert views.node_label() is not None and n.select(views.node_label().alias("x")).first()["x"] == "GET /a (endpoint) <py>"


def test_pages_are_written(spark, small, tmp_path):
    n, e = small
    flows = traverse.flow_candidates(n, e)
    names = views.write_views(n, e, flows, f"file://{tmp_path}/map")
    assert {"symbols", "api-map", "database", "configuration"} <= set(names)
    text = "\n".join(r["value"] for r in spark.read.text(f"file://{tmp_path}/map/data-flow").collect())
    assert text.startswith("# Data Flow") and "GET /a → do → t" in text


def test_tables(spark, small):
    n, e = small
    flows = traverse.flow_candidates(n, e).withColumn("curated", F.lit(False))
    got = views.tables(n, e, flows, spark.createDataFrame([("unresolved:call:z",)], "ref string"))
    row = got["endpoints"].first()
    assert (row["method"], row["path"], row["handler"], row["n_consumers"], row["n_reach"]) == ("GET", "/a", "h:1", 1, 2)
    assert got["access"].count() == 2 and got["flows"].where("missing").count() == 0 and got["overview"].first()["total_nodes"] == 8
    assert {r["category"] for r in got["issues"].collect()} == {"unresolved"}


def test_search_and_caps(spark, small):
    n, e = small
    assert [r["id"] for r in views.search(n, "guard PY").collect()] == ["g:1"]
    assert views.search(n, "g").count() == 0
    got = views.cap_view(n, e, ["env:K"], 2)
    assert {(r["id"], r["shown"], r["total"]) for r in got.collect()} == {("env:K", 2, 8), ("h:1", 2, 8)}
    assert [r["id"] for r in views.sorted_rows(n.select("id", "kind"), "id", True, 2).collect()] == ["table:t", "m:1"]
    assert {r["type"] for r in views.passing_edges(e, n, langs=["py"]).collect()} == {"handled-by", "reads", "consumes", "creates", "guarded-by"}
    assert views.passing_edges(e, n, kinds=["handler"]).count() == 0


def test_reachable_names_and_focus(spark, small):
    n, e = small
    adj = traverse.adjacency(n, e)
    assert [r["name"] for r in views.reachable_names(adj, n, "c:1").orderBy("place").collect()] == ["GET /a", "g", "do", "t"]
    assert views.reachable_names(adj, n, "nobody").count() == 0
    assert [r["id"] for r in views.focus_flow(n, e, "page -> table:t").orderBy("pos").collect()] == ["c:1", "e:1", "h:1", "table:t"]
    assert [r["id"] for r in views.focus_flow(n, e, "GET /a").orderBy("pos").collect()] == ["e:1", "h:1"]
    assert views.focus_flow(n, e, "page -> nothing").count() == 0
    assert {r["node"] for r in views.focus_nodes(n, e, "do", 1).collect()} == {"h:1", "e:1", "table:t"}


def test_hygiene(spark):
    n = spark.createDataFrame([
        ("r:1", "requirement", "active", "asserted"), ("r:2", "requirement", "needs-review", "asserted"), ("c:1", "capability", "active", "asserted"),
        ("r:3", "requirement", "active", "asserted"), ("code", "class", None, "derived")], "id string, kind string, status string, provenance string")
    e = spark.createDataFrame([("code", "r:1", "realizes", "asserted"), ("r:1", "c:1", "part-of", "asserted"), ("lost", "r:3", "realizes", "asserted"), ("code", "gone", "denotes", "asserted")],
                              "src string, dst string, type string, provenance string")
    assert {tuple(r) for r in views.hygiene(n, e).collect()} == {("dangling", "lost"), ("dangling", "gone"), ("unbound", "r:2"), ("needs-review", "r:2")}


def test_store_and_versions(spark, small, tmp_path):
    n, e = small
    folder = f"file://{tmp_path}/store"
    with pytest.raises(FileNotFoundError):
        store.load(spark, folder)
    assert store.load_hashes(spark, folder).count() == 0
    hashes = spark.createDataFrame([("a", "1")], "path string, sha256 string")
    store.save(n.withColumn("kind", F.when(F.col("id") == "h:1", "frontend-component").otherwise(F.col("kind"))), e, hashes, folder, "c1", "t1", version=1)
    with pytest.raises(ValueError):
        store.load(spark, folder)
    new = store.load_migrated(spark, folder, keep=True)
    assert new.state["version"] == store.VERSION and new.nodes.where("id = 'h:1'").first()["kind"] == "component"
    again = store.load(spark, folder)
    assert (again.state["seq"], again.state["last_sync_commit"], again.nodes.count(), again.edges.count(), again.hashes.count()) == (2, "c1", 8, 6, 1)


def test_changed_paths_and_records(spark):
    value = lambda *xs: spark.createDataFrame([(x,) for x in xs], "value string")
    got = store.changed_paths(value("app/a.py", "other/b.py", "app/map/x"), value(" M app/c.py", "R  app/o.py -> app/n.py"), "app", ("map",))
    assert {r["path"] for r in got.collect()} == {"a.py", "c.py", "n.py"}
    paths = spark.createDataFrame([("a.py",), ("b.bin",), (".github/workflows/x",), ("Makefile",)], "path string")
    assert {r["path"] for r in sync.relevant(paths).collect()} == {"a.py", ".github/workflows/x", "Makefile"}
    texts = spark.createDataFrame([("c/2024-2.md", "x\n# Second one\n"), ("c/2024-1.md", "no title"), ("c/x.txt", "# no")], "path string, text string")
    assert [tuple(r) for r in store.change_records(texts).collect()] == [("2024-2.md", "Second one"), ("2024-1.md", "2024-1.md")]
    flows = spark.createDataFrame([("f/pay.md", "# Pay\nNode: `e:1`\nnode: h:1\n"), ("f/_candidates.md", "node: x"), ("f/none.md", "")], "path string, text string")
    assert [tuple(r) for r in store.curated_flows(flows).collect()] == [("pay", "curated", ["e:1", "h:1"], "f/pay.md")]
    steps = views.hydrated_flows(store.curated_flows(flows).withColumn("curated", F.lit(True)), nodes(spark, ("e:1", "endpoint", "GET /a"))).orderBy("pos").collect()
    assert [(r["label"], r["missing"], r["complete"]) for r in steps] == [("GET /a", False, False), ("h:1", True, False)]


def test_sync_of_a_stored_map(spark, tmp_path):
    folder = f"file://{tmp_path}/map"
    first = source(spark, a_py="class A:\n    pass\n", b_py="class B:\n    pass\n")
    none = spark.createDataFrame([], "path string, sha256 string")
    store.save(*store.empty(spark), none, folder)
    lines = [r["line"] for r in sync.sync_map(spark, folder, first, "c1").orderBy("section", "place").collect()]
    assert "- `a.py`" in lines and "- `A` (class, `a.py`)" in lines
    assert sync.sync_map(spark, folder, first, "c1").count() == 0  # nothing changed
    lines = [r["line"] for r in sync.sync_map(spark, folder, source(spark, a_py="class A2:\n    pass\n", b_py="class B:\n    pass\n"), "c2").collect()]
    assert "- `A` (class, was `a.py`)" in lines and "- `A2` (class, `a.py`)" in lines and "- `b.py`" not in lines
    assert {r["name"] for r in store.load(spark, folder).nodes.where("kind = 'class'").collect()} == {"A2", "B"}


def test_a_working_copy_becomes_a_map(spark, tmp_path):
    for path, (_, text) in {k: (None, v) for k, v in SOURCES.items()}.items():
        (tmp_path / "repo" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / path).write_text(text)
    kept = full_scan.init_map(spark, str(tmp_path / "repo"), f"file://{tmp_path}/map")
    assert kept.state["last_sync_commit"] is None and kept.hashes.count() == len(SOURCES)
    assert {r["dst"] for r in kept.edges.where("type = 'handled-by'").collect()} == {"py:function:list_items", "java:method:shop.OrderController#open"}
    flows = {r["seed"]: r["chain"] for r in kept.flows.collect()}
    assert flows["endpoint:GET /items"][:2] == ["endpoint:GET /items", "py:function:list_items"]
    assert "GET /items" in "\n".join(r["value"] for r in spark.read.text(f"file://{tmp_path}/map/views/api-map").collect())


def test_malformed_ids_are_purged(spark):
    n = nodes(spark, ("ok", "class", "x"), ("bad\tid", "class", "y"), ("l" * 513, "class", "z"))
    e = edges(spark, ("ok", "bad\tid", "calls"), ("ok", "ok2", "calls"))
    n, e = sync.purge_malformed(n, e)
    assert [r["id"] for r in n.collect()] == ["ok"] and [r["dst"] for r in e.collect()] == ["ok2"]


def test_scan_follows_the_configuration(spark, tmp_path):
    for path, text in {"src/a.py": "a", "gen/b.py": "b", "old/c.py": "c", "map/d.py": "d", "big.py": "x" * 500, ".gitignore": "gen/\n*.log\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "map/config.json").write_text('{"ignore": ["old/"], "max_file_bytes": 100}')
    assert {r["path"] for r in files.scan_tree(spark, str(tmp_path), "map").collect()} == {"src/a.py"}
    assert files.scan_config(spark, str(tmp_path / "nothing.json")) == ([], files.MAX_FILE_BYTES)


@pytest.mark.parametrize(("path", "text", "edge"), [
    ("docker-compose.yml", "services:\n  db:\n    image: x\nvolumes:\n  data:\n", ("config:docker-compose.yml", "external:db", "contains")),
    ("deploy/Dockerfile", "FROM python:3\n", ("config:deploy/Dockerfile", "external:image:python:3", "depends-on")),
    (".github/workflows/ci.yml", "on: push\n", ("file:.github/workflows/ci.yml", "ci:ci.yml", "defines")),
    ("a/.env.example", "# x=1\nKEY=secret\n", ("file:a/.env.example", "env:KEY", "defines")),
    ("keycloak/realm.json", "{}", ("file:keycloak/realm.json", "auth:realm", "defines")),
    ("app.properties", "redis.host=h\n", ("config:app.properties", "external:redis", "depends-on")),
    ("app.properties", "db=jdbc:mysql://x\n", ("config:app.properties", "external:mysql", "depends-on")),
    ("q.yml", "broker: my_kafka\n", ("config:q.yml", "external:kafka", "depends-on")),
    ("package.json", '{"scripts": {"go": "x"}, "dependencies": {"left": "1"}}', ("config:package.json", "unresolved:module:npm:left", "depends-on")),
    ("pom.xml", "<artifactId>core</artifactId>", ("config:pom.xml", "unresolved:module:maven:core", "depends-on")),
    ("requirements.txt", "flask==1\n", ("config:requirements.txt", "unresolved:module:pip:flask", "depends-on")),
])
def test_configuration_files(path, text, edge):
    nodes_, edges_, errors = extracted(path, text)
    assert edge in edges_ and not errors and "secret" not in str(nodes_) + str(edges_)


def test_words_name_whole_systems_only():
    assert configs.system_of("my_kafka") and configs.system_of("s3") and not configs.system_of("assets") and not configs.system_of("sessions")


def test_rarer_constructs():
    n, e, _ = extracted("app/urls.py", "from django.urls import path\nurlpatterns = [path('items/', views.items)]\n")
    assert ("endpoint:GET /items", "unresolved:handler:items", "handled-by") in e
    n, e, _ = extracted("cli.py", "import click\n@click.command()\ndef run():\n    db.get_collection('logs')\n")
    assert "handler:cli.py:2" in n and ("file:cli.py", "collection:logs", "reads") in e
    n, e, errors = extracted("old.py", "from a.b import c\nclass Old:\n    @app.get('/x')\n    def go(self):\n        print 'x'\n")
    assert errors and ("endpoint:GET /x", "py:class:Old#go", "handled-by") in e and ("file:old.py", "unresolved:module:a.b", "imports") in e
    n, e, _ = extracted("A.java", 'package p;\npublic class A {\n  private final Repo repo;\n  private @Value("k.e") String k;\n  public void run() { // @Scheduled(cron = "0")\n    repo.save();\n  }\n}\n')
    assert e["java:method:p.A#run", "unresolved:method:Repo#save", "calls"]["confidence"] == "MEDIUM"
    assert ("java:method:p.A#run", "schedule:cron", "triggered-by") in e and ("java:class:p.A", "config-key:k.e", "configures") in e
    long = "/a" * 300
    n, e, _ = extracted("a.ts", f"const q = useQuery(() => fetch('/u', {{method: 'POST', body: axios.get('/inner')}}));\nfetch('{long}');\n")
    assert dict(n["endpoint:POST /u"]["meta"])["hook"] == "useQuery" and "endpoint:GET /inner" not in n and sum(x.startswith("endpoint:") for x in n) == 1
