"""The driver's relational tables as a property graph (nodes, edges), and the same in SQL.

Sequence numbers stand for the insertion order that first-wins, caps and ties depend on; they are
computed from the keys (table ordinal and key), so no global sort is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.build import first_wins

_NODE = ["id", "kind", "name", "file", "line", "confidence", "provenance", "lang", "package", "node_seq"]
_EDGE = ["src", "dst", "type", "file", "line", "confidence", "provenance", "edge_seq"]
_STEP = 1_000_000_000_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_id_of_url(url):
    """route id: host and path, without scheme, query and fragment."""
    return F.concat(F.lit("route:"), F.regexp_replace(F.regexp_replace(url, "^[a-z]+://", ""), "[?#].*$", ""))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: _table(spark, sf_dir, n)

    def rows(df, ordinal, prefix, key, kind, name, file, line, conf="HIGH", lang=None, package=None):
        none = F.lit(None).cast("string")
        return df.select(
            F.concat(F.lit(prefix), key.cast("string")).alias("id"), F.lit(kind).alias("kind"), name.alias("name"),
            F.lit(file).alias("file") if isinstance(file, str) else file.alias("file"), line.cast("int").alias("line"),
            (F.lit(conf) if isinstance(conf, str) else conf).alias("confidence"), F.lit("derived").alias("provenance"),
            (none if lang is None else lang).alias("lang"), (none if package is None else package).alias("package"),
            (F.lit(ordinal * _STEP) + key.cast("long") if ordinal != 7 else F.lit(7 * _STEP).cast("long")).alias("node_seq"),
        )

    c = F.col
    status = F.when(c("o_orderstatus") == "F", "HIGH").when(c("o_orderstatus") == "O", "MEDIUM").otherwise("LOW")
    parts = [
        rows(t("region"), 1, "region:", c("r_regionkey"), "application", c("r_name"), "region", c("r_regionkey") + 1),
        rows(t("nation"), 2, "nation:", c("n_nationkey"), "module", c("n_name"), "nation", c("n_nationkey") + 1),
        rows(t("customer"), 3, "customer:", c("c_custkey"), "component", c("c_name"), "customer", c("c_custkey"), package=c("c_mktsegment")),
        rows(t("orders"), 4, "endpoint:ORDER ", c("o_orderkey"), "endpoint", F.concat(F.lit("ORDER "), c("o_orderkey").cast("string")), "orders", c("o_orderkey"), conf=status),
        rows(t("supplier"), 5, "supplier:", c("s_suppkey"), "service", c("s_name"), "supplier", c("s_suppkey")),
        rows(t("part"), 6, "table:part_", c("p_partkey"), "table", c("p_name"), "part", c("p_partkey"), lang=c("p_type"), package=c("p_brand")),
        rows(t("events").select("event_type").distinct(), 7, "topic:", c("event_type"), "topic", c("event_type"), "events", F.lit(1)),
        rows(t("events").select("user_id").distinct(), 8, "user:", c("user_id"), "function", F.concat(F.lit("user "), c("user_id").cast("string")), "events", F.lit(1), conf="MEDIUM"),
        first_wins(
            rows(t("pages").withColumn("r", page_id_of_url(c("url"))), 9, "", c("page_id"), "route", c("r"), "pages", c("page_id") + 1).withColumn("id", c("name")),
            ["id"], "node_seq"),
        rows(t("documents"), 10, "file:", c("doc_id"), "file", F.concat(F.lit("doc "), c("doc_id").cast("string")), F.concat(c("source"), F.lit("/"), c("doc_id").cast("string")), F.lit(1), lang=c("lang"), package=c("source")),
    ]
    out = parts[0].select(_NODE)
    for p in parts[1:]:
        out = out.unionByName(p.select(_NODE))
    return out


def hrefs(pages: DataFrame) -> DataFrame:
    """(page_id, src, pos, href) of every link of every page."""
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", page_id_of_url(F.col("url")).alias("src"), F.posexplode(found).alias("pos", "href"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: _table(spark, sf_dir, n)
    c = F.col

    def rows(df, ordinal, src, dst, type_, file, line, seq, conf="HIGH"):
        return df.select(
            src.alias("src"), dst.alias("dst"), (F.lit(type_) if isinstance(type_, str) else type_).alias("type"),
            F.lit(file).alias("file"), line.cast("int").alias("line"), F.lit(conf).alias("confidence"),
            F.lit("derived").alias("provenance"), (F.lit(ordinal * _STEP) + seq.cast("long")).alias("edge_seq"),
        )

    named = lambda prefix, key: F.concat(F.lit(prefix), key.cast("string"))
    li = t("lineitem")
    order_supplier = li.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("n"))
    access = li.groupBy("l_suppkey", "l_partkey", (c("l_returnflag") == "R").alias("w")).agg(F.min("l_linenumber").alias("n"))
    parts = [
        rows(t("nation"), 1, named("region:", c("n_regionkey")), named("nation:", c("n_nationkey")), "contains", "nation", c("n_nationkey") + 1, c("n_nationkey")),
        rows(t("customer"), 2, named("nation:", c("c_nationkey")), named("customer:", c("c_custkey")), "contains", "customer", c("c_custkey"), c("c_custkey")),
        rows(t("supplier"), 3, named("nation:", c("s_nationkey")), named("supplier:", c("s_suppkey")), "contains", "supplier", c("s_suppkey"), c("s_suppkey")),
        rows(t("orders"), 4, named("customer:", c("o_custkey")), named("endpoint:ORDER ", c("o_orderkey")), "consumes", "orders", c("o_orderkey"), c("o_orderkey")),
        rows(order_supplier, 5, named("endpoint:ORDER ", c("l_orderkey")), named("supplier:", c("l_suppkey")), "handled-by", "lineitem", c("n"),
             (c("l_orderkey") * 10 + c("n")) * 1_000_000 + c("l_suppkey"), "MEDIUM"),
        rows(access, 6, named("supplier:", c("l_suppkey")), named("table:part_", c("l_partkey")), F.when(c("w"), "writes").otherwise("reads"), "lineitem", c("n"),
             (c("l_suppkey") * 10_000_000 + c("l_partkey")) * 2 + F.when(c("w"), 1).otherwise(0), "MEDIUM"),
        rows(t("events").select("user_id", "event_type").distinct(), 7, named("user:", c("user_id")), named("topic:", c("event_type")), "publishes", "events", F.lit(1),
             c("user_id") * 100_000 + F.ascii("event_type") * 300 + F.ascii(F.substring("event_type", -2, 2)), "MEDIUM"),
        first_wins(
            rows(hrefs(t("pages")), 8, c("src"), F.concat(F.lit("unresolved:component:"), c("href")), "navigates", "pages", c("page_id") + 1, c("page_id") * 10_000 + c("pos"), "HIGH"),
            ["src", "dst", "type"], "edge_seq"),
    ]
    out = parts[0].select(_EDGE)
    for p in parts[1:]:
        out = out.unionByName(p.select(_EDGE))
    return out


#: The same graph as common table expressions.
GRAPH_SQL = f"""
nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'application' AS kind, r_name AS name, 'region' AS file, (r_regionkey + 1)::INT AS line,
         'HIGH' AS confidence, 'derived' AS provenance, NULL::VARCHAR AS lang, NULL::VARCHAR AS package, {1 * _STEP} + r_regionkey AS node_seq FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'module', n_name, 'nation', (n_nationkey + 1)::INT, 'HIGH', 'derived', NULL, NULL, {2 * _STEP} + n_nationkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'component', c_name, 'customer', c_custkey::INT, 'HIGH', 'derived', NULL, c_mktsegment, {3 * _STEP} + c_custkey FROM customer
  UNION ALL SELECT 'endpoint:ORDER ' || o_orderkey, 'endpoint', 'ORDER ' || o_orderkey, 'orders', o_orderkey::INT,
         CASE o_orderstatus WHEN 'F' THEN 'HIGH' WHEN 'O' THEN 'MEDIUM' ELSE 'LOW' END, 'derived', NULL, NULL, {4 * _STEP} + o_orderkey FROM orders
  UNION ALL SELECT 'supplier:' || s_suppkey, 'service', s_name, 'supplier', s_suppkey::INT, 'HIGH', 'derived', NULL, NULL, {5 * _STEP} + s_suppkey FROM supplier
  UNION ALL SELECT 'table:part_' || p_partkey, 'table', p_name, 'part', p_partkey::INT, 'HIGH', 'derived', p_type, p_brand, {6 * _STEP} + p_partkey FROM part
  UNION ALL SELECT DISTINCT 'topic:' || event_type, 'topic', event_type, 'events', 1, 'HIGH', 'derived', NULL, NULL, {7 * _STEP} FROM events
  UNION ALL SELECT DISTINCT 'user:' || user_id, 'function', 'user ' || user_id, 'events', 1, 'MEDIUM', 'derived', NULL, NULL, {8 * _STEP} + user_id FROM events
  UNION ALL SELECT id, 'route', id, 'pages', (page_id + 1)::INT, 'HIGH', 'derived', NULL, NULL, {9 * _STEP} + page_id FROM (
    SELECT 'route:' || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS id, min(page_id) AS page_id FROM pages GROUP BY 1)
  UNION ALL SELECT 'file:' || doc_id, 'file', 'doc ' || doc_id, source || '/' || doc_id, 1, 'HIGH', 'derived', lang, source, {10 * _STEP} + doc_id FROM documents
), raw_links AS (
  SELECT page_id, src, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS pos FROM (
    SELECT page_id, 'route:' || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS src,
           regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)
), edges AS (
  SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'contains' AS type, 'nation' AS file, (n_nationkey + 1)::INT AS line,
         'HIGH' AS confidence, 'derived' AS provenance, {1 * _STEP} + n_nationkey AS edge_seq FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains', 'customer', c_custkey::INT, 'HIGH', 'derived', {2 * _STEP} + c_custkey FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'contains', 'supplier', s_suppkey::INT, 'HIGH', 'derived', {3 * _STEP} + s_suppkey FROM supplier
  UNION ALL SELECT 'customer:' || o_custkey, 'endpoint:ORDER ' || o_orderkey, 'consumes', 'orders', o_orderkey::INT, 'HIGH', 'derived', {4 * _STEP} + o_orderkey FROM orders
  UNION ALL SELECT 'endpoint:ORDER ' || l_orderkey, 'supplier:' || l_suppkey, 'handled-by', 'lineitem', min(l_linenumber)::INT, 'MEDIUM', 'derived',
         {5 * _STEP} + (l_orderkey * 10 + min(l_linenumber)) * 1000000 + l_suppkey FROM lineitem GROUP BY l_orderkey, l_suppkey
  UNION ALL SELECT 'supplier:' || l_suppkey, 'table:part_' || l_partkey, CASE WHEN w THEN 'writes' ELSE 'reads' END, 'lineitem', min(l_linenumber)::INT, 'MEDIUM', 'derived',
         {6 * _STEP} + (l_suppkey * 10000000 + l_partkey) * 2 + CASE WHEN w THEN 1 ELSE 0 END
         FROM (SELECT *, l_returnflag = 'R' AS w FROM lineitem) GROUP BY l_suppkey, l_partkey, w
  UNION ALL SELECT DISTINCT 'user:' || user_id, 'topic:' || event_type, 'publishes', 'events', 1, 'MEDIUM', 'derived', {7 * _STEP} + user_id * 100000 + ascii(event_type) * 300 + ascii(event_type[-2:]) FROM events
  UNION ALL SELECT src, 'unresolved:component:' || href, 'navigates', 'pages', (page_id + 1)::INT, 'HIGH', 'derived', {8 * _STEP} + page_id * 10000 + pos
         FROM raw_links QUALIFY row_number() OVER (PARTITION BY src, href ORDER BY page_id, pos) = 1
)"""
