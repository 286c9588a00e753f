"""Queries over the sample sources: extraction, detection and an incremental run, against what the
sources should yield, row by row; and the intent layer over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import detect, intent
from waymark.queries import register
from waymark.samples import SOURCES, sources
from waymark.sources.extract import build
from waymark.streaming.sync import sync
from waymark.view_queries import _INTENT_SQL, _intent

# What each source yields: nodes as (id, kind, confidence), edges as (src, dst, type, confidence).
NODES = {
    "app/api.py": [
        ("file:app/api.py", "file", "HIGH"),
        ("py:class:Item", "class", "HIGH"),
        ("table:items", "table", "HIGH"),
        ("py:class:Item#save", "method", "HIGH"),
        ("py:function:list_items", "function", "HIGH"),
        ("endpoint:GET /items", "endpoint", "HIGH"),
        ("py:function:check", "function", "HIGH"),
        ("endpoint:GET /health", "endpoint", "LOW"),
    ],
    "db/V2__orders.sql": [
        ("file:db/V2__orders.sql", "file", "HIGH"),
        ("migration:V2", "migration", "HIGH"),
        ("table:orders", "table", "HIGH"),
        ("dbobj:open_orders", "view", "HIGH"),
    ],
    "cmd/main.go": [
        ("file:cmd/main.go", "file", "HIGH"),
        ("go:method:main.Server#Serve", "method", "HIGH"),
        ("go:type:main.Server", "class", "HIGH"),
        ("endpoint:* /cart", "endpoint", "MEDIUM"),
    ],
    "src/main/java/shop/OrderController.java": [
        ("file:src/main/java/shop/OrderController.java", "file", "HIGH"),
        ("java:class:shop.OrderController", "controller", "HIGH"),
        ("java:method:shop.OrderController#open", "method", "HIGH"),
        ("stereotype:spring:RestController", "stereotype", "HIGH"),
        ("endpoint:GET /orders/open", "endpoint", "HIGH"),
    ],
    "web/page.ts": [
        ("file:web/page.ts", "file", "HIGH"),
        ("ts:service:PageService", "service", "HIGH"),
        ("ts:class:PageService#load", "method", "HIGH"),
        ("endpoint:GET /orders/open", "endpoint", "LOW"),
        ("endpoint:DELETE /items/{id}", "endpoint", "LOW"),
    ],
    "deploy/docker-compose.yml": [
        ("file:deploy/docker-compose.yml", "file", "HIGH"),
        ("config:deploy/docker-compose.yml", "deployment-unit", "HIGH"),
        ("external:db", "external-service", "MEDIUM"),
        ("external:queue", "external-service", "MEDIUM"),
    ],
    "config/app.properties": [
        ("file:config/app.properties", "file", "HIGH"),
        ("config:config/app.properties", "configuration", "HIGH"),
        ("config-key:store.url", "configuration-key", "HIGH"),
        ("external:postgresql", "external-service", "HIGH"),
        ("config-key:mail.smtp.host", "configuration-key", "HIGH"),
    ],
    "requirements.txt": [
        ("file:requirements.txt", "file", "HIGH"),
        ("config:requirements.txt", "configuration", "MEDIUM"),
    ],
}
EDGES = {
    "app/api.py": [
        ("file:app/api.py", "unresolved:module:requests", "imports", "MEDIUM"),
        ("file:app/api.py", "unresolved:module:fastapi", "imports", "MEDIUM"),
        ("file:app/api.py", "py:class:Item", "defines", "HIGH"),
        ("py:class:Item", "table:items", "writes", "MEDIUM"),
        ("file:app/api.py", "py:class:Item#save", "defines", "HIGH"),
        ("py:class:Item", "py:class:Item#save", "defines", "HIGH"),
        ("py:class:Item#save", "table:items", "writes", "MEDIUM"),
        ("file:app/api.py", "py:function:list_items", "defines", "HIGH"),
        ("endpoint:GET /items", "py:function:list_items", "handled-by", "HIGH"),
        ("py:function:list_items", "py:function:check", "calls", "HIGH"),
        ("py:function:list_items", "table:items", "reads", "MEDIUM"),
        ("py:function:list_items", "table:owners", "reads", "MEDIUM"),
        ("file:app/api.py", "py:function:check", "defines", "HIGH"),
        ("file:app/api.py", "endpoint:GET /health", "consumes", "MEDIUM"),
    ],
    "db/V2__orders.sql": [
        ("file:db/V2__orders.sql", "migration:V2", "defines", "HIGH"),
        ("migration:V2", "table:orders", "creates", "HIGH"),
        ("file:db/V2__orders.sql", "table:orders", "defines", "HIGH"),
        ("migration:V2", "dbobj:open_orders", "creates", "HIGH"),
        ("file:db/V2__orders.sql", "dbobj:open_orders", "defines", "HIGH"),
        ("migration:V2", "table:items", "seeds", "MEDIUM"),
        ("migration:V2", "table:orders", "reads", "MEDIUM"),
    ],
    "cmd/main.go": [
        ("file:cmd/main.go", "go:method:main.Server#Serve", "defines", "HIGH"),
        ("go:type:main.Server", "go:method:main.Server#Serve", "defines", "HIGH"),
        ("file:cmd/main.go", "unresolved:module:example.com/shop/cart", "imports", "MEDIUM"),
        ("file:cmd/main.go", "go:type:main.Server", "defines", "HIGH"),
        ("file:cmd/main.go", "endpoint:* /cart", "exposes", "MEDIUM"),
    ],
    "src/main/java/shop/OrderController.java": [
        ("file:src/main/java/shop/OrderController.java", "java:class:shop.OrderController", "defines", "HIGH"),
        ("file:src/main/java/shop/OrderController.java", "java:method:shop.OrderController#open", "defines", "HIGH"),
        ("java:class:shop.OrderController", "java:method:shop.OrderController#open", "defines", "HIGH"),
        ("java:method:shop.OrderController#open", "unresolved:method:OrderService#open", "calls", "MEDIUM"),
        ("java:class:shop.OrderController", "stereotype:spring:RestController", "references", "HIGH"),
        ("java:class:shop.OrderController", "unresolved:class:OrderService", "injects", "MEDIUM"),
        ("endpoint:GET /orders/open", "java:method:shop.OrderController#open", "handled-by", "HIGH"),
        ("file:src/main/java/shop/OrderController.java", "endpoint:GET /orders/open", "defines", "HIGH"),
    ],
    "web/page.ts": [
        ("file:web/page.ts", "ts:service:PageService", "defines", "HIGH"),
        ("file:web/page.ts", "ts:class:PageService#load", "defines", "HIGH"),
        ("ts:service:PageService", "ts:class:PageService#load", "defines", "HIGH"),
        ("file:web/page.ts", "unresolved:module:./x", "imports", "MEDIUM"),
        ("file:web/page.ts", "endpoint:GET /orders/open", "consumes", "LOW"),
        ("file:web/page.ts", "endpoint:DELETE /items/{id}", "consumes", "LOW"),
    ],
    "deploy/docker-compose.yml": [
        ("file:deploy/docker-compose.yml", "config:deploy/docker-compose.yml", "defines", "HIGH"),
        ("file:deploy/docker-compose.yml", "external:db", "defines", "MEDIUM"),
        ("config:deploy/docker-compose.yml", "external:db", "contains", "MEDIUM"),
        ("file:deploy/docker-compose.yml", "external:queue", "defines", "MEDIUM"),
        ("config:deploy/docker-compose.yml", "external:queue", "contains", "MEDIUM"),
    ],
    "config/app.properties": [
        ("file:config/app.properties", "config:config/app.properties", "defines", "HIGH"),
        ("file:config/app.properties", "config-key:store.url", "defines", "HIGH"),
        ("config:config/app.properties", "config-key:store.url", "configures", "HIGH"),
        ("config:config/app.properties", "external:postgresql", "depends-on", "HIGH"),
        ("config-key:store.url", "env:DB_HOST", "depends-on", "HIGH"),
        ("config:config/app.properties", "env:DB_HOST", "depends-on", "HIGH"),
        ("file:config/app.properties", "config-key:mail.smtp.host", "defines", "HIGH"),
        ("config:config/app.properties", "config-key:mail.smtp.host", "configures", "HIGH"),
    ],
    "requirements.txt": [
        ("file:requirements.txt", "config:requirements.txt", "defines", "MEDIUM"),
        ("config:requirements.txt", "unresolved:module:pip:fastapi", "depends-on", "LOW"),
        ("config:requirements.txt", "unresolved:module:pip:requests", "depends-on", "LOW"),
    ],
}


def _first(rows, key):
    """First wins, in walk order: files before folders, by name."""
    out = {}
    for row in rows:
        out.setdefault(key(row), row)
    return list(out.values())


def _values(rows, columns: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows) + f") t({columns})"


#: Walk order of the sources.
ORDER = (
    "requirements.txt", "app/api.py", "cmd/main.go", "config/app.properties", "db/V2__orders.sql", "deploy/docker-compose.yml",
    "src/main/java/shop/OrderController.java", "web/page.ts",
)
_NODE_ROWS = _first([r for p in ORDER for r in NODES[p]], lambda r: r[0])
_EDGE_ROWS = _first([r for p in ORDER for r in EDGES[p]], lambda r: r[:3])


@register(_values(_NODE_ROWS, "id, kind, confidence"))
def extracted_nodes(spark, d):
    return build(sources(spark))[0].select("id", "kind", "confidence")


@register(_values(_EDGE_ROWS, "src, dst, type, confidence"))
def extracted_edges(spark, d):
    return build(sources(spark))[1].select("src", "dst", "type", "confidence")


# The same tree after a change: the Python file is gone, the Go file has another type, a file is new.
CHANGE = {
    "app/api.py": None,
    "cmd/main.go": "package main\n\ntype Shop struct {}\n",
    "web/new.py": "class New:\n    pass\n",
}
_GONE = {r[0] for r in NODES["app/api.py"]} | {r[0] for r in NODES["cmd/main.go"]}
_KEPT = {r[0] for p in ORDER if p not in CHANGE for r in NODES[p]}
_SYNCED = [r for r in _NODE_ROWS if r[0] not in _GONE or r[0] == "endpoint:GET /orders/open"]
_SYNCED += [("file:cmd/main.go", "file", "HIGH"), ("go:type:main.Shop", "class", "HIGH"), ("file:web/new.py", "file", "HIGH"), ("py:class:New", "class", "HIGH")]


@register(_values(_SYNCED, "id, kind, confidence"))
def synced_nodes(spark, d):
    """The graph after an incremental run; nodes that only gone or changed files told are gone."""
    old = sources(spark)
    n, e, _ = build(old)
    return sync(n, e, old.select("path", "sha256"), sources(spark, CHANGE))[0].select("id", "kind", "confidence")


@register(_values([(p, "deleted" if p == "app/api.py" else "stale" if p == "cmd/main.go" else "fresh") for p in SOURCES] + [("web/new.py", "new")], "path, state"))
def synced_states(spark, d):
    old = sources(spark)
    n, e, _ = build(old)
    return sync(n, e, old.select("path", "sha256"), sources(spark, CHANGE))[2]


STACK = (
    ("infrastructure", "containers", "HIGH"), ("infrastructure", "docker-compose", "HIGH"), ("infrastructure", "pip", "HIGH"),
    ("frameworks", "fastapi", "HIGH"), ("databases", "postgresql", "MEDIUM"), ("languages", "python", "HIGH"),
    ("languages", "go", "LOW"), ("languages", "java", "LOW"), ("languages", "sql", "LOW"), ("languages", "typescript", "LOW"),
)


@register(_values(STACK, "section, name, confidence"))
def detected_stack(spark, d):
    files = sources(spark).select("path", F.col("content").cast("string").alias("text"))
    return detect.detect(spark, files)


@register(f"""WITH {_INTENT_SQL}, scope AS (SELECT id AS cap, id AS m FROM inodes WHERE kind = 'capability' UNION ALL SELECT dst, src FROM iedges WHERE type = 'part-of' AND dst IN (SELECT id FROM inodes WHERE kind = 'capability')),
code AS (SELECT cap, count(DISTINCT e.src) AS n FROM scope JOIN iedges e ON e.type = 'realizes' AND e.dst = m GROUP BY cap),
req AS (SELECT dst AS cap, count(*) AS n FROM iedges WHERE type = 'part-of' AND src IN (SELECT id FROM inodes WHERE kind = 'requirement') GROUP BY dst)
SELECT i.id AS cap, coalesce(req.n, 0) AS n_requirements, coalesce(code.n, 0) AS n_code, CASE WHEN code.n > 0 THEN 'realized' ELSE 'unbound' END AS status
FROM inodes i LEFT JOIN code ON i.id = code.cap LEFT JOIN req ON i.id = req.cap WHERE i.kind = 'capability'""")
def intent_capabilities(spark, d):
    n, e = _intent(spark, d)
    none = F.lit(None).cast("string")
    n = n.withColumns({"title": none, "author": none, "source": none})
    return intent.capabilities(n, e.withColumn("review", none)).select("cap", "n_requirements", F.col("n_code").cast("long").alias("n_code"), "status")


@register(f"""WITH {_INTENT_SQL}, part_of AS (SELECT src AS m FROM iedges WHERE type = 'part-of' AND dst = 'cap:7' UNION SELECT 'cap:7'),
code AS (SELECT DISTINCT src AS id, dst AS via FROM iedges WHERE type = 'realizes' AND dst IN (SELECT m FROM part_of)),
slices AS (SELECT DISTINCT 'slice:' || o_orderpriority AS id, 'endpoint:ORDER ' || o_orderkey AS via FROM orders WHERE 'endpoint:ORDER ' || o_orderkey IN (SELECT id FROM code)),
tests AS (SELECT DISTINCT 'test:' || o_custkey AS id, 'endpoint:ORDER ' || o_orderkey AS via FROM orders WHERE 'endpoint:ORDER ' || o_orderkey IN (SELECT id FROM code))
SELECT 'code' AS what, id, via FROM code UNION ALL SELECT 'slice', id, via FROM slices UNION ALL SELECT 'test', id, via FROM tests""")
def intent_responsibility(spark, d):
    """Code, slices (by priority) and tests (by customer, told in either direction) of one capability."""
    c, lit = F.col, F.lit
    e = _intent(spark, d)[1].select("src", "dst", "type")
    o = spark.read.parquet(f"{d}/orders.parquet")
    order = F.concat(lit("endpoint:ORDER "), c("o_orderkey").cast("string"))
    test = F.concat(lit("test:"), c("o_custkey").cast("string"))
    slices = o.select(order.alias("src"), F.concat(lit("slice:"), c("o_orderpriority")).alias("dst"), lit("delivered-in").alias("type"))
    back = c("o_orderkey") % 2 == 0
    tests = o.select(F.when(back, order).otherwise(test).alias("src"), F.when(back, test).otherwise(order).alias("dst"), lit("tests").alias("type"))
    every = e.unionAll(slices).unionAll(tests).withColumn("review", lit(None).cast("string"))
    return intent.responsibility(every, "cap:7").select("what", "id", "via")
