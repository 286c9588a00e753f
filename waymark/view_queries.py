"""Registered queries of the derived views, the store, incremental maintenance and the intent layer,
with their SQL. Importing this module adds them to waymark.queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from waymark import schema as S
from waymark.functions import text as X
from waymark.operators import traverse, validate, views
from waymark.plans import projection
from waymark.plans.lineage import shared_dir
from waymark.plans.projection import GRAPH_SQL
from waymark.queries import _flow_sql, _in, graph, read, register
from waymark.sources import store
from waymark.streaming import sync

NAMES_SQL = GRAPH_SQL + ", names AS (SELECT id, arg_max(name, node_seq) AS name FROM nodes GROUP BY id)"


@register(f"WITH {GRAPH_SQL} SELECT id, name || ' (' || kind || ')' || CASE WHEN coalesce(lang, '') <> '' THEN ' <' || lang || '>' ELSE '' END AS label FROM nodes")
def node_labels(spark, d):
    return projection.nodes(spark, d).select("id", views.node_label().alias("label"))


@register(f"""WITH {GRAPH_SQL} SELECT kind, name, file || CASE WHEN line > 0 THEN ':' || line ELSE '' END AS location, confidence FROM nodes
WHERE kind NOT IN {_in(views.NO_SYMBOLS)} ORDER BY kind, name, node_seq LIMIT 200""")
def symbol_page(spark, d):
    return views.symbol_page(projection.nodes(spark, d)).drop("node_seq")


@register(f"""WITH {NAMES_SQL}, top AS (SELECT * FROM edges WHERE type IN ('consumes', 'navigates') ORDER BY type, src, edge_seq LIMIT 200)
SELECT type, coalesce(a.name, src) AS from_name, coalesce(b.name, dst) AS to_name, confidence FROM top LEFT JOIN names a ON src = a.id LEFT JOIN names b ON dst = b.id""")
def dependency_page(spark, d):
    """Both ends by name; link targets have no node, so their id stands."""
    n, e = graph(spark, d)
    return views.dependency_page(e, n, ("consumes", "navigates")).drop("edge_seq")


@register(f"""WITH {NAMES_SQL}, top AS (SELECT * FROM edges WHERE type = 'handled-by' AND dst NOT LIKE 'unresolved:%' ORDER BY src, dst, edge_seq LIMIT 200)
SELECT coalesce(a.name, src) AS caller, coalesce(b.name, dst) AS callee, confidence, file || ':' || line AS evidence FROM top LEFT JOIN names a ON src = a.id LEFT JOIN names b ON dst = b.id""")
def call_page(spark, d):
    n, e = graph(spark, d)
    return views.call_page(e, n, ("handled-by",))


@register(f"""WITH {NAMES_SQL}, h AS (SELECT src AS id, arg_max(dst, edge_seq) AS handler_id FROM edges WHERE type = 'handled-by' GROUP BY src),
f AS (SELECT src, type, dst, confidence, row_number() OVER (PARTITION BY src ORDER BY edge_seq) AS pos FROM edges WHERE type IN {_in(views.DOWNSTREAM)} QUALIFY pos <= 12),
down AS (SELECT src, string_agg(type || ' ' || coalesce(name, dst) || ' (' || coalesce(confidence, '') || ')', '|' ORDER BY pos) AS downstream FROM f LEFT JOIN names ON dst = id GROUP BY src),
files AS (SELECT id, arg_max(file, node_seq) AS file FROM nodes GROUP BY id),
uses AS (SELECT DISTINCT e.dst AS id, coalesce(f.file, e.src) AS c FROM edges e LEFT JOIN files f ON e.src = f.id WHERE e.type IN ('consumes', 'exposes')),
con AS (SELECT id, array_to_string(list_sort(list(c))[1:12], '|') AS consumers FROM uses GROUP BY id)
SELECT n.id, n.name, coalesce(names.name, '?') AS handler, n.file, n.line, n.confidence, coalesce(downstream, '') AS downstream, coalesce(consumers, '') AS consumers
FROM nodes n LEFT JOIN h ON n.id = h.id LEFT JOIN names ON names.id = handler_id LEFT JOIN down ON down.src = handler_id LEFT JOIN con ON con.id = n.id WHERE n.kind = 'endpoint'""")
def api_map(spark, d):
    n, e = graph(spark, d)
    joined = lambda c: F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c)
    return views.api_map(n, e).select("id", "name", "handler", "file", "line", "confidence", joined("downstream"), joined("consumers"))


@register(f"WITH {GRAPH_SQL} SELECT DISTINCT 'Tables' AS title, name FROM nodes WHERE kind = 'table' OR id LIKE 'table:%'")
def store_names(spark, d):
    return views.store_names(projection.nodes(spark, d))


@register(f"""WITH {NAMES_SQL} SELECT coalesce(a.name, src) AS actor, type, coalesce(b.name, dst) AS store, confidence FROM edges LEFT JOIN names a ON src = a.id LEFT JOIN names b ON dst = b.id
WHERE type IN ('reads', 'writes', 'queries') AND (dst LIKE 'table:%' OR dst LIKE 'entity:%' OR dst LIKE 'collection:%')""")
def access_page(spark, d):
    n, e = graph(spark, d)
    return views.access_page(e, n)


_AS_KINDS = """pages2 AS (SELECT id, name, file, line, confidence, node_seq, CASE kind WHEN 'service' THEN 'external-service' WHEN 'application' THEN 'deployment-unit'
  WHEN 'module' THEN 'configuration' WHEN 'topic' THEN 'configuration-key' WHEN 'table' THEN 'guard' ELSE kind END AS kind FROM nodes)"""


def _as_kinds(nodes):
    """The projected nodes under kinds that the pages of services, keys, guards and units list."""
    to = {"service": "external-service", "application": "deployment-unit", "module": "configuration", "topic": "configuration-key", "table": "guard"}
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in to.items() for x in kv]), F.col("kind")), F.col("kind"))
    return nodes.withColumn("kind", kind)


@register(f"WITH {GRAPH_SQL}, {_AS_KINDS} SELECT name, id, file, line, confidence FROM pages2 WHERE kind = 'external-service'")
def external_services(spark, d):
    return views.external_page(_as_kinds(projection.nodes(spark, d)))


@register(f"WITH {GRAPH_SQL}, {_AS_KINDS} SELECT name, kind, file, confidence FROM pages2 WHERE kind = 'guard' OR (kind = 'configuration' AND id LIKE '%auth%')")
def authentication_page(spark, d):
    return views.authentication_page(_as_kinds(projection.nodes(spark, d)))


@register(f"WITH {GRAPH_SQL}, {_AS_KINDS} SELECT name, file, line FROM pages2 WHERE kind IN ('configuration-key', 'environment')")
def configuration_page(spark, d):
    return views.configuration_page(_as_kinds(projection.nodes(spark, d)))


@register(f"WITH {GRAPH_SQL}, {_AS_KINDS} SELECT name, kind, file, confidence FROM pages2 WHERE kind IN ('deployment-unit', 'ci-job')")
def deployment_page(spark, d):
    return views.deployment_page(_as_kinds(projection.nodes(spark, d)))


@register(f"""WITH {GRAPH_SQL} SELECT 'total' AS what, 'nodes' AS name, count(*) AS n FROM nodes UNION ALL SELECT 'total', 'edges', count(*) FROM edges
UNION ALL SELECT 'kind', kind, count(*) FROM nodes GROUP BY kind UNION ALL SELECT 'type', type, count(*) FROM edges GROUP BY type""")
def evidence_snapshot(spark, d):
    """One column of each is counted, so the tables are projected instead of the graph being written."""
    return views.evidence_snapshot(projection.nodes(spark, d), projection.edges(spark, d))


@register(_flow_sql().replace("string_agg(node, ' > ' ORDER BY level, pos) AS chain FROM c4 JOIN seeds ON c4.seed = seeds.seed", "string_agg(coalesce(nm.name, node), ' → ' ORDER BY level, pos) AS names FROM c4 JOIN seeds ON c4.seed = seeds.seed LEFT JOIN (SELECT id, arg_max(name, node_seq) AS name FROM nodes GROUP BY id) nm ON nm.id = node"))
def flow_names(spark, d):
    n, e = graph(spark, d)
    return views.flow_names(traverse.flow_candidates(n, e), n)


@register(f"""WITH {GRAPH_SQL}, f AS (SELECT 'order ' || o_orderkey AS seed, o_orderkey % 2 = 0 AS curated, ['customer:' || o_custkey, 'endpoint:ORDER ' || o_orderkey, 'customer:' || (o_custkey + 300)] AS chain FROM orders),
s AS (SELECT seed, curated, unnest(chain) AS id, generate_subscripts(chain, 1) - 1 AS pos FROM f),
own AS (SELECT id, name, kind, file, line FROM nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY node_seq DESC) = 1)
SELECT seed, curated, pos::INT AS pos, s.id, coalesce(name, s.id) AS label, kind, file, line, own.id IS NULL AS missing, bool_and(own.id IS NOT NULL) OVER (PARTITION BY seed, curated) AS complete
FROM s LEFT JOIN own ON s.id = own.id""")
def hydrated_flows(spark, d):
    """Flows customer, order, another customer that may not exist."""
    c = F.col
    customer = lambda k: F.concat(F.lit("customer:"), k.cast("string"))
    flows = read(spark, d, "orders").select(
        F.concat(F.lit("order "), c("o_orderkey").cast("string")).alias("seed"), (c("o_orderkey") % 2 == 0).alias("curated"),
        F.array(customer(c("o_custkey")), F.concat(F.lit("endpoint:ORDER "), c("o_orderkey").cast("string")), customer(c("o_custkey") + 300)).alias("chain"),
    )
    return views.hydrated_flows(flows, graph(spark, d)[0])


@register(f"""WITH {GRAPH_SQL}, h AS (SELECT *, lower(coalesce(name, '') || ' ' || kind || ' ' || coalesce(file, '') || ' ' || coalesce(lang, '') || ' ' || id) AS hay FROM nodes)
SELECT id, name, kind, file FROM h WHERE contains(hay, 'fr doc') OR (contains(hay, 'fr') AND contains(hay, 'doc')) ORDER BY node_seq LIMIT 25""")
def search_box(spark, d):
    return views.search(projection.nodes(spark, d), " FR doc ")


@register("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'build 1') OR (contains(lower(c_name || ' ' || c_mktsegment), 'build') AND contains(lower(c_name || ' ' || c_mktsegment), '1'))")
def filtered_rows(spark, d):
    return views.filtered(read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "build 1", ["c_name", "c_mktsegment"])


@register(f"WITH {GRAPH_SQL} SELECT id, kind, name, coalesce(package, '') AS package FROM nodes ORDER BY package DESC, id, kind, name LIMIT 300")
def sorted_rows(spark, d):
    rows = projection.nodes(spark, d).select("id", "kind", "name", F.coalesce("package", F.lit("")).alias("package"))
    return views.sorted_rows(rows, "package", True)


@register(f"""WITH {GRAPH_SQL}, lit AS (SELECT id FROM nodes WHERE kind IN ('endpoint', 'service', 'table', 'component') AND (lang IS NULL OR lang = '' OR lang LIKE 'E%'))
SELECT src, dst, type, confidence FROM edges WHERE type NOT IN {_in(views.HIDDEN_TYPES)} AND confidence IN {_in(views.SHOWN_CONFIDENCES)} AND src IN (SELECT id FROM lit) AND dst IN (SELECT id FROM lit)""")
def passing_edges(spark, d):
    n, e = graph(spark, d)
    langs = [r["lang"] for r in n.where("lang LIKE 'E%'").select("lang").distinct().collect()]
    return views.passing_edges(e, n, ["endpoint", "service", "table", "component"], langs).select("src", "dst", "type", "confidence")


@register(f"""WITH {GRAPH_SQL}, deg AS (SELECT e, count(*) AS n FROM (SELECT src AS e FROM edges UNION ALL SELECT dst FROM edges) GROUP BY e), t AS (SELECT count(*) AS total FROM nodes),
k AS (SELECT id FROM nodes LEFT JOIN deg ON id = e ORDER BY CASE WHEN id IN ('user:7', 'nation:3') THEN 0 ELSE 1 END, CASE confidence WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END, coalesce(n, 0) DESC, id LIMIT 300)
SELECT id, least(total, 300)::BIGINT AS shown, total FROM k, t""")
def cap_view(spark, d):
    n, e = graph(spark, d)
    return views.cap_view(n, e, ["user:7", "nation:3"]).withColumn("shown", F.col("shown").cast("long"))


@register(f"""WITH {NAMES_SQL} SELECT place, name FROM (SELECT row_number() OVER (ORDER BY edge_seq) AS place, coalesce(name, dst) AS name FROM edges LEFT JOIN names ON dst = id WHERE src = 'nation:3')
WHERE (SELECT count(*) FROM edges WHERE src = 'nation:3') >= 15""")
def reachable_names(spark, d):
    """A nation has more than fifteen neighbours, so the first node served fills the list."""
    n, e = graph(spark, d)
    return views.reachable_names(traverse.adjacency(n, e), n, "nation:3")


@register(f"""WITH {GRAPH_SQL}, deg AS (SELECT e, count(*) AS n FROM (SELECT src AS e FROM edges UNION ALL SELECT dst FROM edges) GROUP BY e)
SELECT id FROM nodes LEFT JOIN deg ON id = e WHERE contains(lower(name), 'supplier') OR contains(lower(id), 'supplier') ORDER BY coalesce(n, 0) DESC, node_seq LIMIT 1""")
def richest_hit(spark, d):
    n, e = graph(spark, d)
    return views.richest_hit(n, e, "Supplier")


_INTENT_SQL = GRAPH_SQL + """, inodes AS (SELECT 'req:' || p_partkey AS id, 'requirement' AS kind, CASE WHEN p_partkey % 7 = 0 THEN 'needs-review' ELSE 'active' END AS status FROM part
  UNION ALL SELECT 'cap:' || s_suppkey, 'capability', 'active' FROM supplier),
iedges AS (SELECT DISTINCT 'endpoint:ORDER ' || l_orderkey AS src, 'req:' || (l_partkey * 2) AS dst, 'realizes' AS type FROM lineitem WHERE l_linenumber = 1
  UNION SELECT DISTINCT 'req:' || l_partkey, 'cap:' || l_suppkey, 'part-of' FROM lineitem WHERE l_linenumber = 2),
every AS (SELECT id, false AS own FROM nodes UNION ALL SELECT id, true FROM inodes), ids AS (SELECT id, bool_or(own) AS own FROM every GROUP BY id)"""


def _intent(spark, d):
    """Parts as requirements and suppliers as capabilities, bound by the lines of orders."""
    c, lit = F.col, F.lit
    named = lambda prefix, key: F.concat(lit(prefix), key.cast("string"))
    li = read(spark, d, "lineitem")
    mark = F.when(c("p_partkey") % 7 == 0, "needs-review").otherwise("active")
    own = read(spark, d, "part").select(named("req:", c("p_partkey")).alias("id"), lit("requirement").alias("kind"), mark.alias("status"), lit("asserted").alias("provenance"))
    own = own.unionByName(read(spark, d, "supplier").select(named("cap:", c("s_suppkey")).alias("id"), lit("capability").alias("kind"), lit("active").alias("status"), lit("asserted").alias("provenance")))
    a = li.where("l_linenumber = 1").select(named("endpoint:ORDER ", c("l_orderkey")).alias("src"), named("req:", c("l_partkey") * 2).alias("dst"), lit("realizes").alias("type"))
    b = li.where("l_linenumber = 2").select(named("req:", c("l_partkey")).alias("src"), named("cap:", c("l_suppkey")).alias("dst"), lit("part-of").alias("type"))
    nodes = own.unionByName(projection.nodes(spark, d).select("id", "kind", "provenance"), allowMissingColumns=True)
    return nodes, a.union(b).distinct().withColumn("provenance", lit("asserted"))


@register(f"""WITH {_INTENT_SQL}, bound AS (SELECT DISTINCT dst AS id FROM iedges WHERE type = 'realizes' AND dst IN (SELECT id FROM ids)),
member AS (SELECT DISTINCT dst AS id FROM iedges WHERE type = 'part-of' AND src IN (SELECT id FROM bound))
SELECT DISTINCT 'dangling' AS finding, CASE WHEN b.own THEN src ELSE dst END AS id FROM iedges LEFT JOIN ids a ON src = a.id LEFT JOIN ids b ON dst = b.id WHERE a.id IS NULL OR b.id IS NULL
UNION ALL SELECT 'unbound', id FROM inodes WHERE id NOT IN (SELECT id FROM bound) AND id NOT IN (SELECT id FROM member)
UNION ALL SELECT 'needs-review', id FROM inodes WHERE status = 'needs-review'""")
def intent_hygiene(spark, d):
    return views.hygiene(*_intent(spark, d))


@register(f"""WITH {GRAPH_SQL} SELECT id, kind, name, file, line, confidence, lang, package FROM nodes WHERE kind = 'service'""")
def stored_graph(spark, d):
    """The graph saved as a snapshot and read back."""
    n, e = graph(spark, d)
    tracked = n.where("kind = 'file'").select(F.col("file").alias("path"), F.sha2("id", 256).alias("sha256"))
    kept = store.save(n, e, tracked, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", "abc", "2024-01-01")
    return kept.nodes.where("kind = 'service'").select("id", "kind", "name", "file", "line", "confidence", "lang", "package")


@register(f"""WITH {GRAPH_SQL} SELECT 2::BIGINT AS seq, 3 AS version, 'two' AS last_sync_commit, (SELECT count(*) FROM nodes WHERE kind <> 'file') AS node_count,
(SELECT count(*) FROM edges) AS edge_count, (SELECT count(*) FROM documents) AS hashes""")
def stored_state(spark, d):
    """The log after two saves; the second one counts."""
    n, e = graph(spark, d)
    folder = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    tracked = n.where("kind = 'file'").select(F.col("file").alias("path"), F.sha2("id", 256).alias("sha256"))
    store.save(n, e, tracked, folder, "one", "2024-01-01", version=1)
    kept = store.save(n.where("kind != 'file'"), e, tracked, folder, "two", "2024-01-02")
    row = store.log_of(spark, folder).where(F.col("seq") == kept.state["seq"])
    n_hashes = kept.hashes.agg(F.count("*").alias("hashes"))
    return row.select("seq", "version", "last_sync_commit", "node_count", "edge_count").join(n_hashes, F.lit(True))


@register("""SELECT DISTINCT p AS path FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN source || '/' || doc_id || '.py' WHEN doc_id % 3 = 1 THEN '.github/workflows/' || doc_id || '.sh'
ELSE source || '/' || doc_id || '.bin' END AS p FROM documents WHERE doc_id % 2 = 0) WHERE p LIKE '%.py' OR p LIKE '.github/workflows/%'""")
def changed_files(spark, d):
    """Status lines and a diff to the changed paths that an extractor may claim."""
    c = F.col
    key = c("doc_id").cast("string")
    path = F.when(c("doc_id") % 3 == 0, F.concat("source", F.lit("/"), key, F.lit(".py"))).when(
        c("doc_id") % 3 == 1, F.concat(F.lit(".github/workflows/"), key, F.lit(".sh"))
    ).otherwise(F.concat("source", F.lit("/"), key, F.lit(".bin")))
    docs = read(spark, d, "documents").where(c("doc_id") % 2 == 0).select("doc_id", F.concat(F.lit("app/"), path).alias("p"))
    status = docs.where(c("doc_id") % 4 == 0).select(F.concat(F.lit("R  app/old -> "), "p").alias("value"))
    diff = docs.select(c("p").alias("value")).unionAll(docs.select(F.concat(F.lit("other/"), "p").alias("value"))).unionAll(docs.select(F.concat(F.lit("app/map/"), "p").alias("value")))
    return sync.relevant(store.changed_paths(diff, status, "app", ("map",)))


@register("""WITH n AS (SELECT CASE WHEN doc_id % 5 = 0 THEN text ELSE 'doc' || doc_id END AS id FROM documents WHERE text IS NOT NULL)
SELECT id FROM n WHERE length(id) <= 512 AND NOT regexp_matches(id, '[\\x00-\\x1F]')""")
def purged_nodes(spark, d):
    docs = read(spark, d, "documents").where("text IS NOT NULL")
    n = docs.select(F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(F.concat(F.lit("doc"), F.col("doc_id").cast("string"))).alias("id"))
    return sync.purge_malformed(n, n.select(F.col("id").alias("src"), F.col("id").alias("dst")))[0]


@register(f"""WITH {GRAPH_SQL}, old AS (SELECT id, kind, name, file FROM nodes), new AS (SELECT * FROM old WHERE kind <> 'service' OR id NOT LIKE '%3'),
gone AS (SELECT * FROM (SELECT * FROM old EXCEPT SELECT * FROM new) WHERE kind IN {_in(S.SIGNIFICANT_KINDS)}), files AS (SELECT DISTINCT file AS path FROM gone)
SELECT '1 files' AS section, '- `' || path || '`' AS line FROM (SELECT path FROM files ORDER BY path LIMIT 30)
UNION ALL SELECT '3 removed', '- `' || name || '` (' || kind || ', was `' || file || '`)' FROM (SELECT * FROM gone ORDER BY id, kind, name, file LIMIT 40)
UNION ALL SELECT '4 relationships', '- `' || src || '` —' || type || '→ `' || dst || '`' FROM (SELECT DISTINCT src, dst, type FROM edges WHERE src = 'nation:3' ORDER BY src, dst, type LIMIT 40)""")
def change_record(spark, d):
    """The record of a run in which some services and one nation's edges went."""
    old, e = graph(spark, d)
    gone = validate.diff_nodes(old, old.where(~((F.col("kind") == "service") & F.col("id").endswith("3"))))
    rows = validate.diff_edges(e, e.where("src != 'nation:3'"))
    return sync.change_record(gone.select(F.col("file").alias("path")).distinct(), gone, rows).select("section", "line")


@register("SELECT o_orderkey, strftime(o_orderdate::TIMESTAMP, '%Y-%m-%d-%H%M') AS stamp, strftime(o_orderdate::TIMESTAMP, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders")
def time_stamps(spark, d):
    time = F.col("o_orderdate").cast("timestamp")
    return read(spark, d, "orders").select("o_orderkey", X.stamp(time).alias("stamp"), X.iso_seconds(time).alias("iso"))
