"""The registered queries of the graph engine and their SQL. Caps in them are part of the operators
(top-k views, fan-out limits, bounded depths)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import schema as S
from waymark.functions import text as X
from waymark.operators import build, inventory, resolve, scopes, traverse, validate
from waymark.plans import projection
from waymark.plans.lineage import cut
from waymark.plans.projection import GRAPH_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Query = Callable[[SparkSession, str], DataFrame]


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_stores: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The persisted graph: built and written once per application and input, then read. Queries
    that touch one column only project the source tables instead."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        _stores[key] = cut(projection.nodes(spark, sf_dir), "zstd"), cut(projection.edges(spark, sf_dir), "zstd")
    return _stores[key]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _rank_sql(col: str, table: dict[str, int], default: int) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


#: Edges that can be walked: every target that is no placeholder.
LIVE_SQL = GRAPH_SQL + f""", flagged AS (
  SELECT e.*, n.id IS NOT NULL AS dst_exists,
         e.dst LIKE 'unresolved:%' OR (n.id IS NULL AND regexp_matches(e.dst, '^({'|'.join(p[:-1] for p in S.PLACEHOLDER_PREFIXES[1:])}):')) AS placeholder
  FROM edges e LEFT JOIN (SELECT DISTINCT id FROM nodes) n ON e.dst = n.id
), live AS (SELECT * FROM flagged WHERE NOT placeholder)"""


@register(f"WITH {GRAPH_SQL} SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def inventory_kind_counts(spark, d):
    return inventory.kinds(projection.nodes(spark, d))


@register(f"WITH {GRAPH_SQL} SELECT type, count(*) AS n FROM edges GROUP BY type")
def edge_type_counts(spark, d):
    return inventory.edges_by_type(projection.edges(spark, d))


@register(f"WITH {GRAPH_SQL} SELECT id, name, kind, lang FROM nodes WHERE kind = 'file' AND (contains(lower(name), 'doc 1') OR contains(lower(id), 'doc 1')) AND lang = 'fr'")
def query_by_kind_name_lang(spark, d):
    return inventory.query(projection.nodes(spark, d), "file", "DOC 1", "fr").select("id", "name", "kind", "lang")


@register(f"WITH {GRAPH_SQL} SELECT id, kind, name FROM nodes WHERE contains(lower(name), 'supplier') OR contains(lower(id), 'supplier') ORDER BY node_seq, id LIMIT 5")
def find_nodes_topk(spark, d):
    return inventory.find_nodes(projection.nodes(spark, d), "Supplier", 5).select("id", "kind", "name")


@register(f"""WITH {LIVE_SQL}, d AS (SELECT e, count(*) AS deg FROM (SELECT src AS e FROM live UNION ALL SELECT dst FROM live) GROUP BY e)
SELECT id, coalesce(deg, 0) AS deg FROM nodes LEFT JOIN d ON id = e WHERE kind <> 'file'""")
def node_degree(spark, d):
    n, e = graph(spark, d)
    return inventory.degree(n, e)


@register(f"""WITH {GRAPH_SQL}, r AS (SELECT coalesce(package, '') AS area, coalesce(lang, '') AS lang, name FROM nodes),
t AS (SELECT area, lang, string_agg(name, '|' ORDER BY name) AS names FROM (
  SELECT *, row_number() OVER (PARTITION BY area, lang ORDER BY name) AS k FROM (SELECT DISTINCT * FROM r)) WHERE k <= 8 GROUP BY ALL)
SELECT r.area, r.lang, count(*) AS n, any_value(t.names) AS names FROM r JOIN t ON r.area = t.area AND r.lang = t.lang GROUP BY r.area, r.lang""")
def modules_rollup(spark, d):
    return inventory.modules(graph(spark, d)[0])


@register(f"WITH {GRAPH_SQL} SELECT id, name, kind, lang, file, line, confidence FROM nodes ORDER BY lower(name), id LIMIT 3000")
def symbols_topk(spark, d):
    return inventory.symbols(projection.nodes(spark, d))


@register(f"WITH {GRAPH_SQL} SELECT type, src, dst, confidence FROM edges WHERE type IN {_in(S.DEP_EDGES)} ORDER BY type, src, dst LIMIT 200")
def dependencies_view(spark, d):
    return inventory.dependencies(projection.edges(spark, d))


@register(f"WITH {GRAPH_SQL} SELECT src AS endpoint, arg_min(dst, edge_seq) AS handler FROM edges WHERE type = 'handled-by' GROUP BY src")
def api_map_handlers_first(spark, d):
    return inventory.handlers(projection.edges(spark, d), "first")


@register(f"WITH {GRAPH_SQL} SELECT src AS endpoint, arg_max(dst, edge_seq) AS handler FROM edges WHERE type = 'handled-by' GROUP BY src")
def api_map_handlers_last(spark, d):
    return inventory.handlers(projection.edges(spark, d), "last")


@register(f"""WITH {GRAPH_SQL} SELECT dst AS endpoint, count(*) AS n_consumers, array_to_string(list_sort(list(src))[1:10], '|') AS consumers
FROM (SELECT DISTINCT dst, src FROM edges WHERE type = 'consumes') GROUP BY dst""")
def endpoint_consumers(spark, d):
    return inventory.consumers(projection.edges(spark, d))


@register(f"""WITH {GRAPH_SQL} SELECT dst AS table_id, type AS op, src AS actor, file, line, confidence FROM edges
WHERE type IN {_in(S.ACCESS_TYPES)} AND dst IN (SELECT id FROM nodes WHERE kind IN {_in(S.STORE_KINDS)})""")
def data_access(spark, d):
    n, e = graph(spark, d)
    return inventory.data_access(e, n)


_CAPPED_SQL = LIVE_SQL + f""", v AS (
  SELECT e.*, {_rank_sql('e.confidence', S.CONF_RANK, 3)} AS c, {_rank_sql('s.kind', S.KIND_RANK, 50)} AS k, e.confidence IN ('LOW', 'UNKNOWN') AS low
  FROM edges e JOIN nodes s ON e.src = s.id AND s.kind <> 'file' JOIN nodes t ON e.dst = t.id AND t.kind <> 'file' WHERE e.type <> 'defines'
), capped AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY low ORDER BY c, k, src, dst, edge_seq) <= CASE WHEN low THEN 180 ELSE 1020 END)"""


@register(f"WITH {_CAPPED_SQL} SELECT src, dst, type, confidence, file, line, edge_seq FROM capped")
def edge_quota_cap(spark, d):
    n, e = graph(spark, d)
    return inventory.capped_view_edges(e, n)


# The area of the projected nodes in SQL: their ids have no dots but for routes, whose last part after the colon is the whole path.
_AREA_SQL = _CAPPED_SQL + """, touched AS (SELECT src AS id FROM capped UNION SELECT dst FROM capped),
own AS (SELECT n.id, n.kind, n.confidence, CASE WHEN package IS NOT NULL AND package <> '' THEN array_to_string(
          list_filter(string_split(replace(package, '/', '.'), '.'), lambda s: s <> '')[1:2], '.') ELSE n.file END AS area
        FROM nodes n JOIN touched USING (id)),
sizes AS (SELECT area, count(*) AS n FROM own GROUP BY area),
folded AS (SELECT id, confidence, CASE WHEN n < 4 OR regexp_matches(area, '^[0-9]+$') THEN CASE kind WHEN 'endpoint' THEN 'endpoints' WHEN 'external-service' THEN 'external' ELSE 'misc' END ELSE area END AS area
           FROM own JOIN sizes USING (area)),
top AS (SELECT area FROM folded GROUP BY area ORDER BY count(*) DESC, area LIMIT 60),
grp AS (SELECT * FROM folded WHERE area IN (SELECT area FROM top))"""


@register(f"""WITH {_AREA_SQL} SELECT area, count(*) AS n, count(*) FILTER (WHERE confidence = 'HIGH') AS n_high, count(*) FILTER (WHERE confidence = 'MEDIUM') AS n_medium,
count(*) FILTER (WHERE confidence = 'LOW') AS n_low, count(*) FILTER (WHERE confidence = 'UNKNOWN') AS n_unknown FROM grp GROUP BY area""")
def group_counts(spark, d):
    n, e = graph(spark, d)
    return inventory.group_counts(inventory.group_table(n, inventory.capped_view_edges(e, n)))


@register(f"""WITH {_AREA_SQL} SELECT a.area AS area_from, b.area AS area_to, type, arg_min(capped.confidence, edge_seq + c * 1000000000000000000) AS confidence
FROM capped JOIN grp a ON src = a.id JOIN grp b ON dst = b.id WHERE a.area <> b.area GROUP BY ALL""")
def group_edges(spark, d):
    n, e = graph(spark, d)
    view = inventory.capped_view_edges(e, n)
    return inventory.group_edges(inventory.group_table(n, view), view)


@register(f"""WITH {LIVE_SQL}, o AS (SELECT src, count(*) AS out FROM live GROUP BY src)
SELECT id, kind, confidence, coalesce(out, 0) AS out, name, node_seq FROM nodes LEFT JOIN o ON id = src
ORDER BY {_rank_sql('confidence', S.CONF_RANK, 3)}, {_rank_sql('kind', S.KIND_RANK, 50)}, coalesce(out, 0) DESC, name, node_seq LIMIT 400""")
def ranked_nodes(spark, d):
    n, e = graph(spark, d)
    return inventory.ranked(n, e, 400)


@register(f"WITH {GRAPH_SQL} SELECT src, dst, type, row_number() OVER (PARTITION BY src ORDER BY edge_seq) AS pos FROM edges QUALIFY pos <= 8")
def fanout_cap(spark, d):
    e = graph(spark, d)[1].select("src", "dst", "type", "edge_seq")
    return inventory.fanout(e, 8, rows=e.count()).select("src", "dst", "type", F.col("pos").cast("long").alias("pos"))


@register(f"""WITH {LIVE_SQL} SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM nodes WHERE confidence = 'LOW') AS low_nodes,
(SELECT count(*) FROM nodes WHERE file IS NULL OR file = '' OR confidence = 'UNKNOWN') AS no_evidence, (SELECT count(*) FROM nodes WHERE kind IN {_in(S.ENTRY_KINDS)}) AS entry_points,
(SELECT count(*) FROM edges) AS total_edges, (SELECT count(*) FROM edges WHERE confidence = 'LOW') AS low_edges,
(SELECT count(*) FROM (SELECT id FROM nodes GROUP BY id HAVING count(*) > 1)) AS dupes""")
def overview_metrics(spark, d):
    n, e = graph(spark, d)
    return inventory.overview(n, e)


@register(f"WITH {LIVE_SQL} SELECT src, dst, type FROM flagged WHERE placeholder")
def placeholder_edges(spark, d):
    n, e = graph(spark, d)
    return build.placeholder_edges(e, n).select("src", "dst", "type")


# Links name a path; a route answers to its last path part, and only a unique one counts.
_HREF_SQL = GRAPH_SQL + """, routes AS (SELECT '/' || regexp_extract(id, '([^/]*)/?$', 1) AS name, id, node_seq FROM nodes WHERE kind = 'route'),
ix AS (SELECT name, count(*) AS n, arg_min(id, node_seq) AS first FROM routes GROUP BY name),
res AS (SELECT e.src, CASE WHEN n = 1 THEN first ELSE dst END AS dst, type, CASE WHEN n = 1 THEN 'HIGH' ELSE 'LOW' END AS confidence,
        CASE WHEN n = 1 THEN NULL ELSE dst END AS kept, edge_seq FROM edges e LEFT JOIN ix ON e.dst = 'unresolved:component:' || ix.name WHERE e.type = 'navigates')"""


def _resolved_links(spark, d):
    n, e = graph(spark, d)
    routes = n.where("kind = 'route'").withColumns({"kind": F.lit("component"), "name": F.concat(F.lit("/"), F.regexp_extract("id", "([^/]*)/?$", 1))})
    return resolve.resolve(e.where("type = 'navigates'"), routes, component_prefixes=())


@register(f"WITH {_HREF_SQL} SELECT src, dst, type, confidence FROM res")
def resolve_hrefs(spark, d):
    return _resolved_links(spark, d).select("src", "dst", "type", "confidence")


@register(f"WITH {_HREF_SQL} SELECT DISTINCT kept AS ref FROM res WHERE kept IS NOT NULL")
def unresolved_refs(spark, d):
    return resolve.unresolved(_resolved_links(spark, d))


@register(f"WITH {LIVE_SQL}, less AS (SELECT * FROM edges) SELECT e.src, e.dst, e.type, e.file, e.line FROM flagged e LEFT JOIN (SELECT id FROM nodes WHERE kind <> 'service') s ON e.src = s.id "
          "LEFT JOIN (SELECT id FROM nodes WHERE kind <> 'service') t ON e.dst = t.id "
          "WHERE s.id IS NULL OR (t.id IS NULL AND NOT (e.dst LIKE 'unresolved:%'))")
def broken_edges(spark, d):
    """Broken edges of the graph after its services were lost."""
    n, e = graph(spark, d)
    return validate.broken_edges(e, n.where("kind != 'service'"))


@register("SELECT o_orderdate::DATE::VARCHAR AS id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    """Ids that two rows claim, when orders are keyed by day."""
    o = read(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("id"))
    return o.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


@register("SELECT 'node' AS what, 'doc:' || text AS id FROM documents WHERE length('doc:' || text) > 512 OR regexp_matches('doc:' || text, '[\\x00-\\x1F]')")
def malformed_ids(spark, d):
    """Ids made of whole texts: too long, or with control characters."""
    n = read(spark, d, "documents").select(F.concat(F.lit("doc:"), "text").alias("id"))
    none = n.where(F.lit(False)).select(F.col("id").alias("src"), F.col("id").alias("dst"))
    return validate.malformed_ids(n, none)


@register(f"""WITH {LIVE_SQL}, u AS (SELECT DISTINCT dst AS ref FROM edges WHERE dst LIKE 'unresolved:component:%')
SELECT severity, category, message, id, coalesce(file, '') AS file, coalesce(line, 0) AS line FROM (SELECT 'LOW' AS severity, 'unresolved' AS category, 'unresolved reference' AS message, ref AS id, NULL::VARCHAR AS file, NULL::INT AS line FROM u
UNION ALL SELECT 'LOW', 'low-confidence', 'LOW-confidence node (lead, not confirmed)', id, file, line FROM nodes WHERE confidence = 'LOW'
UNION ALL SELECT 'LOW', 'low-confidence', 'LOW-confidence edge ' || type, src, file, line FROM edges WHERE confidence = 'LOW'
UNION ALL SELECT 'MEDIUM', 'validation', 'node without evidence', id, file, line FROM nodes WHERE file IS NULL OR file = '' OR confidence = 'UNKNOWN'
UNION ALL SELECT 'HIGH', 'validation', 'edge with unknown dst ' || type, dst, file, line FROM flagged WHERE NOT dst_exists AND NOT placeholder
UNION ALL SELECT 'HIGH', 'validation', 'edge with unknown src ' || type, src, file, line FROM edges WHERE src NOT IN (SELECT id FROM nodes)
UNION ALL SELECT 'HIGH', 'validation', 'duplicate node id', id, NULL, NULL FROM nodes GROUP BY id HAVING count(*) > 1)""")
def issues_table(spark, d):
    n, e = graph(spark, d)
    refs = e.where(F.col("dst").startswith("unresolved:component:")).select(F.col("dst").alias("ref")).distinct()
    return validate.issues(n, e, refs).withColumns({"line": F.coalesce("line", F.lit(0)), "file": F.coalesce("file", F.lit(""))})


@register(f"""WITH {LIVE_SQL} SELECT 'unknown_kind' AS "check", count(*) AS n FROM nodes WHERE kind NOT IN {_in(S.NODE_KINDS)}
UNION ALL SELECT 'unknown_type', count(*) FROM edges WHERE type NOT IN {_in(S.EDGE_TYPES)}
UNION ALL SELECT 'malformed_id', (SELECT count(*) FROM nodes WHERE length(id) > 512 OR regexp_matches(id, '[\\x00-\\x1F]'))
  + (SELECT count(*) FROM edges WHERE length(src) > 512 OR length(dst) > 512 OR regexp_matches(src, '[\\x00-\\x1F]') OR regexp_matches(dst, '[\\x00-\\x1F]'))
UNION ALL SELECT 'duplicate_id', count(*) FROM (SELECT id FROM nodes GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'broken_edge', count(*) FROM flagged WHERE src NOT IN (SELECT id FROM nodes) OR (NOT dst_exists AND NOT placeholder)
UNION ALL SELECT 'no_evidence', count(*) FROM nodes WHERE file IS NULL OR file = '' OR confidence = 'UNKNOWN'
UNION ALL SELECT 'placeholder_edge', count(*) FROM flagged WHERE placeholder
UNION ALL SELECT 'low_confidence', (SELECT count(*) FROM nodes WHERE confidence = 'LOW') + (SELECT count(*) FROM edges WHERE confidence = 'LOW')""")
def validate_metrics(spark, d):
    n, e = graph(spark, d)
    return validate.validate(n, e)


_TARGET = "table:part_7"


def _impact_sql(depth: int = 6) -> str:
    reach = _in(S.REACH_EDGE_TYPES)
    out = [LIVE_SQL, f"f0 AS (SELECT '{_TARGET}' AS node), s0 AS (SELECT NULL::VARCHAR AS node, 0 AS level WHERE false)"]
    for i in range(1, depth + 1):
        out.append(f"l{i} AS MATERIALIZED (SELECT src AS node, {i} AS level, bool_or(type IN {reach}) AS expand FROM live JOIN f{i - 1} ON dst = f{i - 1}.node WHERE src NOT IN (SELECT node FROM s{i - 1} WHERE node IS NOT NULL) GROUP BY src)")
        out.append(f"s{i} AS MATERIALIZED (SELECT * FROM s{i - 1} UNION ALL SELECT node, level FROM l{i}), f{i} AS (SELECT node FROM l{i} WHERE expand)")
    return "WITH " + ", ".join(out)


def _impact(spark, d):
    n, e = graph(spark, d)
    adj = traverse.adjacency(n, e)
    return n, traverse.impact(adj, spark.createDataFrame([(_TARGET,)], "target string"))


@register(_impact_sql() + " SELECT node, level FROM s6")
def impact_closure(spark, d):
    return _impact(spark, d)[1].select("node", "level")


@register(f"WITH {LIVE_SQL} SELECT src AS node, type, edge_seq FROM live WHERE dst = '{_TARGET}' ORDER BY edge_seq LIMIT 20")
def impact_callers(spark, d):
    n, e = graph(spark, d)
    return traverse.callers(build.resolved_edges(e, n), _TARGET)


@register(_impact_sql() + f" SELECT DISTINCT name FROM s6 JOIN nodes ON node = id WHERE kind IN {_in(S.ENTRY_KINDS)} ORDER BY name LIMIT 15")
def impact_entry_points(spark, d):
    n, c = _impact(spark, d)
    return traverse.impact_names(c, n, S.ENTRY_KINDS).select("name")


@register(_impact_sql() + f" SELECT DISTINCT name FROM s6 JOIN nodes ON node = id WHERE kind IN {_in(S.CONSUMER_KINDS)} ORDER BY name LIMIT 15")
def impact_consumers(spark, d):
    n, c = _impact(spark, d)
    return traverse.impact_names(c, n, S.CONSUMER_KINDS).select("name")


_PATH_SEEDS = ("customer:1", "customer:2", "user:1", "topic:click", "nowhere")


def _path_sql(depth: int = 12) -> str:
    seeds = " UNION ALL ".join(f"SELECT '{s}' AS seed" for s in _PATH_SEEDS)
    out = [LIVE_SQL, f"""seeds AS ({seeds}), nb AS MATERIALIZED (SELECT node, nb, pos FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY edge_seq, back) AS pos FROM (
      SELECT src AS node, dst AS nb, edge_seq, 0 AS back FROM live UNION ALL SELECT dst, src, edge_seq, 1 FROM live)) WHERE pos <= 50),
      f0 AS (SELECT seed, seed AS node, []::BIGINT[] AS ord, [seed] AS path FROM seeds), s0 AS (SELECT seed, node FROM f0),
      h0 AS (SELECT seed, arg_min(path, ord) AS path FROM f0 WHERE node = '{_TARGET}' GROUP BY seed)"""]
    for i in range(1, depth + 1):
        p = i - 1
        out.append(f"""f{i} AS MATERIALIZED (SELECT seed, nb AS node, min(o) AS ord, arg_min(pa, o) AS path FROM (
          SELECT f.seed, b.nb, list_append(f.ord, b.pos) AS o, list_append(f.path, b.nb) AS pa FROM f{p} f JOIN nb b ON f.node = b.node
          WHERE f.seed NOT IN (SELECT seed FROM h{p}) AND NOT EXISTS (SELECT 1 FROM s{p} s WHERE s.seed = f.seed AND s.node = b.nb)) GROUP BY seed, nb),
          s{i} AS MATERIALIZED (SELECT * FROM s{p} UNION ALL SELECT seed, node FROM f{i}),
          h{i} AS MATERIALIZED (SELECT * FROM h{p} UNION ALL SELECT seed, arg_min(path, ord) FROM f{i} WHERE node = '{_TARGET}' GROUP BY seed)""")
    return "WITH " + ", ".join(out) + f""" SELECT s.seed, h.path IS NOT NULL AS found, coalesce(len(h.path) - 1, -1)::BIGINT AS hops,
      coalesce(array_to_string(h.path, ' > '), '') AS path FROM seeds s LEFT JOIN h{depth} h ON s.seed = h.seed"""


@register(_path_sql())
def flow_shortest_path(spark, d):
    n, e = graph(spark, d)
    seeds = spark.createDataFrame([(s,) for s in _PATH_SEEDS], "seed string")
    return traverse.shortest_path(traverse.adjacency(n, e), seeds, spark.createDataFrame([(_TARGET,)], "target string"))


@register(f"""WITH {LIVE_SQL}, b AS (
 SELECT src AS node, dst AS nb FROM live QUALIFY row_number() OVER (PARTITION BY src ORDER BY edge_seq) <= 25
 UNION ALL SELECT dst, src FROM live QUALIFY row_number() OVER (PARTITION BY dst ORDER BY edge_seq) <= 25),
 l1 AS (SELECT 'supplier:3' AS node UNION SELECT nb FROM b WHERE node = 'supplier:3'), l2 AS (SELECT node FROM l1 UNION SELECT nb FROM b WHERE node IN (SELECT node FROM l1))
 SELECT node FROM (SELECT node FROM l2 WHERE (SELECT count(*) FROM l1) < 120 UNION SELECT node FROM l1) ORDER BY node LIMIT 120""")
def khop_neighborhood(spark, d):
    n, e = graph(spark, d)
    return traverse.neighbourhood(traverse.adjacency(n, e), spark.createDataFrame([("supplier:3",)], "node string"))


@register(f"""WITH RECURSIVE {LIVE_SQL}, live2 AS (SELECT DISTINCT src, dst FROM live WHERE dst_exists), r(seed, node) AS (
 SELECT id, id FROM nodes WHERE kind = 'supplier' OR kind = 'component' UNION SELECT r.seed, l.dst FROM r JOIN live2 l ON r.node = l.src)
 SELECT seed, least(count(*) - 1, 399)::BIGINT AS n_reach FROM r GROUP BY seed""")
def reach_counts(spark, d):
    n, e = graph(spark, d)
    seeds = n.where("kind = 'component'").select(F.col("id").alias("seed"))
    return traverse.reach(traverse.adjacency(n, e), n, seeds)


def _flow_sql() -> str:
    walk = _in(S.FLOW_WALK_TYPES)
    out = [GRAPH_SQL, f"""walk AS MATERIALIZED (SELECT src, dst, edge_seq FROM edges WHERE type IN {walk} AND dst NOT LIKE 'unresolved:%' AND dst NOT LIKE 'stereotype:%'),
      h AS (SELECT src, arg_max(dst, edge_seq) AS handler FROM edges WHERE type = 'handled-by' GROUP BY src),
      seeds AS MATERIALIZED (SELECT id AS seed, kind, CASE WHEN kind = 'endpoint' THEN handler END AS handler FROM nodes LEFT JOIN h ON id = src WHERE kind IN {_in(('endpoint', *S.FLOW_SEEDS))}),
      c0 AS MATERIALIZED (SELECT seed, seed AS node, 0 AS level, 0::BIGINT AS pos FROM seeds UNION ALL SELECT seed, handler, 0, 1 FROM seeds WHERE handler IS NOT NULL),
      f0 AS (SELECT seed, node, pos FROM c0 WHERE pos = 1 OR seed IN (SELECT seed FROM seeds WHERE kind <> 'endpoint'))"""]
    for i in range(1, 5):
        p = i - 1
        only = " AND f.seed IN (SELECT seed FROM seeds WHERE kind <> 'endpoint')" if i == 4 else ""
        out.append(f"""n{i} AS MATERIALIZED (SELECT * FROM (SELECT seed, node, {i} AS level, row_number() OVER (PARTITION BY seed ORDER BY o, q) AS pos FROM (
          SELECT f.seed, w.dst AS node, min(f.pos) AS o, arg_min(w.edge_seq, f.pos * 100000000000000000::HUGEINT + w.edge_seq) AS q FROM f{p} f JOIN walk w ON f.node = w.src
          WHERE NOT EXISTS (SELECT 1 FROM c{p} c WHERE c.seed = f.seed AND c.node = w.dst){only} GROUP BY f.seed, w.dst)) x
          WHERE pos <= greatest(1, 8 - (SELECT count(*) FROM c{p} c WHERE c.seed = x.seed))),
          c{i} AS MATERIALIZED (SELECT * FROM c{p} UNION ALL SELECT seed, node, level, pos FROM n{i}), f{i} AS (SELECT seed, node, pos FROM n{i})""")
    return "WITH " + ", ".join(out) + " SELECT c4.seed, kind, string_agg(node, ' > ' ORDER BY level, pos) AS chain FROM c4 JOIN seeds ON c4.seed = seeds.seed GROUP BY c4.seed, kind"


@register(_flow_sql())
def flow_candidates(spark, d):
    n, e = graph(spark, d)
    return traverse.flow_candidates(n, e).select("seed", "kind", F.array_join("chain", " > ").alias("chain"))


# A second snapshot: suppliers with key % 10 = 3 are gone, those with key % 10 = 4 have a new name; one nation's edges are gone.
@register(f"""WITH {GRAPH_SQL}, old AS (SELECT id, kind, name, file FROM nodes), new AS (
 SELECT id, kind, CASE WHEN kind = 'service' AND node_seq % 10 = 4 THEN name || ' renamed' ELSE name END AS name, file FROM nodes WHERE NOT (kind = 'service' AND node_seq % 10 = 3))
 SELECT * FROM (SELECT *, 'added' AS op FROM (SELECT * FROM new EXCEPT SELECT * FROM old) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM old EXCEPT SELECT * FROM new)) WHERE kind IN {_in(S.SIGNIFICANT_KINDS)}""")
def snapshot_diff_nodes(spark, d):
    old = graph(spark, d)[0]
    key = F.col("node_seq") % 10
    new = old.where(~((F.col("kind") == "service") & (key == 3))).withColumn(
        "name", F.when((F.col("kind") == "service") & (key == 4), F.concat("name", F.lit(" renamed"))).otherwise(F.col("name"))
    )
    return validate.diff_nodes(old, new)


@register(f"""WITH {GRAPH_SQL}, old AS (SELECT src, dst, type FROM edges), new AS (SELECT src, dst, type FROM edges WHERE src <> 'nation:3')
 SELECT *, 'added' AS op FROM (SELECT * FROM new EXCEPT SELECT * FROM old) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM old EXCEPT SELECT * FROM new)""")
def snapshot_diff_edges(spark, d):
    old = graph(spark, d)[1]
    return validate.diff_edges(old, old.where("src != 'nation:3'"))


_STATE_SQL = """WITH cur AS (SELECT source || '/' || doc_id AS path, sha256(text) AS new, doc_id FROM documents),
 old AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN sha256('x') ELSE new END AS old FROM cur WHERE doc_id % 11 <> 0 UNION ALL SELECT 'gone/' || item_id, sha256(text) FROM benchmark),
 st AS (SELECT coalesce(old.path, cur.path) AS path, CASE WHEN new IS NULL THEN 'deleted' WHEN old IS NULL THEN 'new' WHEN old <> new THEN 'stale' ELSE 'fresh' END AS state
        FROM old FULL OUTER JOIN cur ON old.path = cur.path)"""


def _freshness(spark, d):
    docs = read(spark, d, "documents")
    cur = docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"), "doc_id")
    old = cur.where("doc_id % 11 != 0").select("path", F.when(F.col("doc_id") % 7 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    gone = read(spark, d, "benchmark").select(F.concat(F.lit("gone/"), F.col("item_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))
    return validate.freshness(old.unionByName(gone), cur)


@register(_STATE_SQL + " SELECT path, state FROM st")
def freshness_states(spark, d):
    """Every document against a hash table in which some are missing, changed or gone."""
    return _freshness(spark, d)


@register(_STATE_SQL + " SELECT state, count(*) AS n FROM st GROUP BY state")
def freshness_counts(spark, d):
    return _freshness(spark, d).groupBy("state").agg(F.count("*").alias("n"))


@register("SELECT sha256(text) AS hash, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1")
def document_first_wins(spark, d):
    return read(spark, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


@register("""SELECT user_id, event_id, coalesce(last_value(CASE WHEN event_type = 'login' OR event_type = 'view' THEN event_id END IGNORE NULLS)
 OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS scope_id FROM events""")
def line_locf_scope(spark, d):
    """The latest opening event at or above each event of a user."""
    e = read(spark, d, "events")
    return scopes.enclosing(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type").isin("login", "view"), F.col("event_id"))).select("user_id", "event_id", F.coalesce("scope", F.lit(-1)).alias("scope_id"))


@register("""WITH x AS (SELECT *, CASE WHEN event_type = 'click' THEN event_id END AS note, event_type = 'purchase' AS decl FROM events),
 y AS (SELECT *, coalesce(sum(decl::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM x)
 SELECT user_id, event_id, coalesce(last_value(note IGNORE NULLS) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS note_id FROM y QUALIFY decl""")
def forward_annotation(spark, d):
    """The latest annotation between the previous declaration and this one."""
    e = read(spark, d, "events")
    return scopes.annotated(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "click", F.col("event_id")), F.col("event_type") == "purchase").select("user_id", "event_id", F.coalesce("note", F.lit(-1)).alias("note_id"))


@register("""WITH s AS (SELECT l_orderkey AS k, l_linenumber * 10 AS a, l_linenumber * 10 + CAST(l_quantity AS INT) % 15 AS b FROM lineitem),
 p AS (SELECT l_orderkey AS k, l_linenumber, l_suppkey, l_linenumber * 10 + CAST(l_partkey % 20 AS INT) AS pos FROM lineitem)
 SELECT k, l_linenumber AS line, l_suppkey AS supp, pos FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.k = p.k AND s.a <= p.pos AND p.pos < s.b)""")
def span_anti_join(spark, d):
    """Positions outside all spans of their group."""
    li = read(spark, d, "lineitem")
    s = li.select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 10).alias("a"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int") % 15).alias("b"))
    p = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supp"), (F.col("l_linenumber") * 10 + (F.col("l_partkey") % 20).cast("int")).alias("pos"))
    return scopes.outside_spans(p, s, ["k"], "pos", "a", "b").select("k", "line", "supp", "pos")


@register(f"WITH {GRAPH_SQL} SELECT kind, CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.LAYER_OF.items()) + " ELSE 'services' END AS layer, count(*) AS n FROM nodes GROUP BY ALL")
def layer_of_kind(spark, d):
    return projection.nodes(spark, d).groupBy("kind", S.layer_of(F.col("kind")).alias("layer")).agg(F.count("*").alias("n"))


@register("SELECT p_partkey, CASE WHEN len(w) > 0 THEN array_to_string(w[1:8], '-') ELSE 'item' END AS slug FROM (SELECT p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS w FROM part)")
def slugify(spark, d):
    return read(spark, d, "part").select("p_partkey", X.slug(F.col("p_name")).alias("slug"))


@register(r"""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1) AS raw FROM pages), v AS (SELECT page_id, CASE WHEN starts_with(x, '/') THEN x END AS x FROM (
 SELECT page_id, regexp_replace(raw, '(?s)(\?|\$\{|\{).*$', '') AS x FROM u))
 SELECT page_id, regexp_replace(CASE WHEN rtrim(x, '/') <> '' THEN rtrim(x, '/') ELSE x[1:1] END, '/\d+$', '/{id}') AS path FROM v""")
def norm_url(spark, d):
    raw = F.regexp_extract("url", "^[a-z]+://[^/]*(.*)$", 1)
    return read(spark, d, "pages").select("page_id", X.norm_url(raw).alias("path"))


@register("SELECT path, row_number() OVER (ORDER BY is_dir, a, b) AS place FROM (SELECT DISTINCT source || '/' || lang AS path, 1 AS is_dir, source AS a, lang AS b FROM documents UNION SELECT DISTINCT lang, 0, lang, '' FROM documents)")
def walk_order(spark, d):
    """Paths in walk order: files of a folder before its folders (a few hundred paths)."""
    docs = read(spark, d, "documents")
    paths = docs.select(F.concat("source", F.lit("/"), "lang").alias("path")).union(docs.select("lang")).distinct()
    rows = paths.withColumn("k", X.walk_key(F.col("path")))
    return scopes.global_rank(rows, "k").select("path", F.col("rank").alias("place"))


@register("SELECT lang, CASE WHEN count(*) < 3 THEN 'LOW' ELSE 'MEDIUM' END AS confidence, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def detect_census(spark, d):
    return read(spark, d, "documents").where("lang IS NOT NULL").groupBy("lang").agg(F.when(F.count("*") < 3, "LOW").otherwise("MEDIUM").alias("confidence"), F.count("*").alias("n"))


@register("SELECT n_nationkey AS id, '| ' || n_nationkey || ' | ' || n_name || ' |' AS row FROM nation")
def markdown_table(spark, d):
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), X.md_cell(F.col("n_name")), F.lit(" |")).alias("row"))


@register("""WITH s AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations)
 SELECT role || ' > ' || nxt AS step, count(*) AS n FROM s WHERE nxt IS NOT NULL GROUP BY 1""")
def conversation_steps(spark, d):
    """Role transitions from turn to turn."""
    c = read(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("nxt"))
    return c.join(nxt, ["conv_id", "turn"]).groupBy(F.concat("role", F.lit(" > "), "nxt").alias("step")).agg(F.count("*").alias("n"))


@register("""SELECT d.source, coalesce(sum(CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END), 0)::BIGINT AS n_high, coalesce(sum(CASE WHEN l.quality = 0 THEN 1 ELSE 0 END), 0)::BIGINT AS n_medium, count(*) AS n
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source""")
def label_issues(spark, d):
    """Issues by severity from the labels, per source."""
    j = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("n_high"), F.count_if(F.col("quality") == 0).alias("n_medium"), F.count("*").alias("n"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: blast radius of one table, with the nodes' kinds and names."""
    n, closure = _impact(spark, sf_dir)
    return closure.join(n.select(F.col("id").alias("node"), "kind", "name"), "node", "left").select("target", "node", "level", "kind", "name")
