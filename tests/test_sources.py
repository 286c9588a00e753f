"""Sources, extractors and incremental maintenance."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from waymark import schema as S
from waymark.operators import validate
from waymark.sources import extract, files
from waymark.streaming.sync import sync


def graph(path, text):
    rows, errors = extract.extract_text(path, text)
    nodes = {r["id"]: r for r in rows if r["row"] == "node"}
    edges = {(r["src"], r["dst"], r["type"]): r for r in rows if r["row"] == "edge"}
    assert all(r["kind"] in S.NODE_KINDS for r in nodes.values()) and all(r["type"] in S.EDGE_TYPES for r in edges.values())
    return nodes, edges, errors


def test_python_routes_calls_and_sql():
    nodes, edges, errors = graph("app/api.py", '''
import os, requests
from .models import User
app = FastAPI()

class Widget(Base):
    __tablename__ = "widget"
    def save(self):
        db.execute(f"INSERT INTO widget (id) VALUES ({self.id})")

@app.get("/api/items")
async def items():
    helper()
    Widget().save()
    db.execute("""SELECT * FROM widget w JOIN owner o ON 1=1""")
    db.execute("SELECT " + cols)

def helper():
    return requests.post("/api/other")
''')
    assert not errors
    assert nodes["endpoint:GET /api/items"]["confidence"] == "HIGH"
    assert ("endpoint:GET /api/items", "py:function:items", "handled-by") in edges
    assert edges["py:function:items", "py:function:helper", "calls"]["confidence"] == "HIGH"
    assert edges["py:function:items", "py:class:Widget#save", "calls"]["confidence"] == "MEDIUM"
    assert ("py:function:items", "table:widget", "reads") in edges and ("py:function:items", "table:owner", "reads") in edges
    assert ("py:class:Widget#save", "table:widget", "writes") in edges
    assert ("py:function:items", "unresolved:query:dynamic", "queries") in edges
    assert ("file:app/api.py", "unresolved:module:requests", "imports") in edges
    assert ("file:app/api.py", "unresolved:module:os", "imports") not in edges
    assert ("file:app/api.py", "endpoint:POST /api/other", "consumes") in edges
    assert nodes["table:widget"]["kind"] == "table" and ("py:class:Widget", "py:class:Widget#save", "defines") in edges


def test_broken_python_is_an_error_row_with_leads():
    nodes, _, errors = graph("old.py", "print 'x'\nclass Legacy:\n    pass\n")
    assert len(errors) == 1 and errors[0].startswith("old.py [PYTHON]")
    assert nodes["fallback:old.py::Legacy"]["confidence"] == "LOW"


def test_sql_migration():
    nodes, edges, _ = graph("db/V1__init.sql", '''CREATE TABLE IF NOT EXISTS public."Claim" (
  id INT PRIMARY KEY, "Name" VARCHAR(20) DEFAULT 'a,b', amount DECIMAL(10,2), CONSTRAINT c UNIQUE (id)
);
CREATE MATERIALIZED VIEW v AS SELECT * FROM claim JOIN owner ON true;
ALTER TABLE claim ADD COLUMN note TEXT;
INSERT INTO claim VALUES (1);
DELETE FROM audit;
DROP TABLE old;
ALTER TABLE old ADD x INT;
CREATE INDEX i ON claim (id);
''')
    assert dict(nodes["table:claim"]["meta"])["columns"] == '["id", "name", "amount", "note"]'
    assert nodes["dbobj:v"]["kind"] == "view" and nodes["migration:V1"]["confidence"] == "HIGH"
    for dst, kind in (("table:claim", "creates"), ("table:claim", "modifies"), ("table:claim", "seeds"), ("table:owner", "reads"), ("table:audit", "reads"), ("table:audit", "writes"), ("table:old", "modifies")):
        assert ("migration:V1", dst, kind) in edges, (dst, kind)
    assert dict(edges["migration:V1", "table:old", "modifies"]["meta"])["op"] == "drop"


def test_go():
    nodes, edges, _ = graph("srv/main.go", '''package srv
import "net/http"
type Store struct { }
func (s *Store) Load(id int) string { return helper(id) }
func helper(id int) string {
    q := "SELECT name FROM widget"; db.Exec("INSERT INTO audit VALUES (1)")
    return q
}
func main() {
    http.HandleFunc("/api/x", h)
    helper(1)
}
''')
    assert nodes["go:method:srv.Store#Load"]["kind"] == "method" and nodes["go:func:srv.main"]["kind"] == "handler"
    assert ("go:method:srv.Store#Load", "go:func:srv.helper", "calls") in edges and ("go:func:srv.main", "go:func:srv.helper", "calls") in edges
    assert ("file:srv/main.go", "endpoint:* /api/x", "exposes") in edges and ("go:type:srv.Store", "go:method:srv.Store#Load", "defines") in edges
    assert edges["file:srv/main.go", "table:widget", "reads"]["confidence"] == "LOW" and ("file:srv/main.go", "table:audit", "writes") in edges


def test_config_stores_names_not_values():
    nodes, edges, _ = graph("app.properties", "# c\nspring.datasource.url=jdbc:postgresql://h/db\nsecret.key=hunter2\nx=${DB_HOST}\n")
    assert ("config:app.properties", "external:postgresql", "depends-on") in edges and ("config:app.properties", "env:DB_HOST", "depends-on") in edges
    assert "config-key:secret.key" in nodes and "hunter2" not in str(nodes) + str(edges)
    nodes, edges, _ = graph("package.json", '{"scripts": {"build": "x"}, "dependencies": {"react": "1"}}')
    assert "handler:npm:build" in nodes and ("file:package.json", "unresolved:module:npm:react", "depends-on") in edges
    assert graph("bad/package.json", "{")[2]


def test_fallback_never_rises_above_low():
    nodes, edges, _ = graph("x.rb", "require 'json'\nclass Foo\nend\nget '/api/users'\nSELECT * FROM widgets\n")
    assert {n["confidence"] for i, n in nodes.items() if not i.startswith("file:")} == {"LOW"} == {e["confidence"] for e in edges.values()}
    assert ("file:x.rb", "unresolved:table-ref:widgets", "references") in edges


@pytest.mark.parametrize(("path", "names"), [("a.py", ["python"]), ("a.sql", ["sql"]), ("a.go", ["go"]), ("Dockerfile", ["config"]), ("a.rb", ["fallback"]), ("q.yml", ["config"])])
def test_dispatch(path, names):
    assert extract.extractors_for(path) == names


def tree(spark, texts):
    rows = [(p, bytearray(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for p, t in texts.items()]
    return spark.createDataFrame(rows, "path string, content binary, sha256 string")


def test_sync_equals_a_new_build(spark):
    old = {"a.py": "def f():\n    pass\n", "b.py": "def g():\n    f()\n", "c.go": "package c\nfunc h() {}\n"}
    new = {"a.py": "def f2():\n    pass\n", "b.py": old["b.py"], "d.sql": "CREATE TABLE t (id INT);"}
    n, e, _ = extract.build(tree(spark, old))
    n2, e2, states = sync(n, e, tree(spark, old).select("path", "sha256"), tree(spark, new))
    want_n, want_e, _ = extract.build(tree(spark, new))
    assert validate.diff_nodes(want_n, n2, significant=False).count() == 0 and validate.diff_edges(want_e, e2).count() == 0
    assert {r["path"]: r["state"] for r in states.collect()} == {"a.py": "stale", "b.py": "fresh", "c.go": "deleted", "d.sql": "new"}


def test_sync_keeps_asserted_rows(spark):
    n, e, _ = extract.build(tree(spark, {"a.py": "def f():\n    pass\n"}))
    claim = n.limit(1).withColumns({"id": F.lit("intent:capability:x"), "kind": F.lit("capability"), "provenance": F.lit("asserted"), "confidence": F.lit(None).cast("string")})
    out, _, _ = sync(n.unionByName(claim), e, tree(spark, {"a.py": "def f():\n    pass\n"}).select("path", "sha256"), tree(spark, {"a.py": "x = 1\n"}))
    assert {r["id"] for r in out.collect()} == {"file:a.py", "intent:capability:x"}


def test_scan(spark, tmp_path):
    for name in ("src/a.py", "node_modules/b.py", ".env", "x.min.js", "keep/c.sql", "skip/d.sql", "e.bin", "package-lock.json"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    got = files.scan(spark, str(tmp_path), patterns=["skip/"])
    assert {r["path"] for r in got.collect()} == {"src/a.py", "keep/c.sql"}


def test_markdown_sections(spark):
    df = spark.createDataFrame([("d.md", "intro\n# A\nx\n```\n# no\n```\n## B c\ny\n")], "path string, text string")
    got = [(r["line"], r["level"], r["title"], r["in_fence"]) for r in files.markdown_sections(df).orderBy("line").collect()]
    assert got == [(1, None, None, False), (2, 1, "A", False), (3, 1, "A", False), (4, 1, "A", True), (5, 1, "A", True), (6, 1, "A", True), (7, 2, "B c", False), (8, 2, "B c", False)]


@pytest.mark.parametrize(("line", "want"), [
    (" M src/a.py", "src/a.py"), ("R  old.py -> new.py", "new.py"), ("?? x y.py", "x y.py"), ('?? "caf\\303\\251.py"', "café.py"), ("M", None), ("MMMx", None),
])
def test_porcelain(spark, line, want):
    assert spark.createDataFrame([(line,)], "l string").select(files.porcelain_path(F.col("l"))).first()[0] == want
