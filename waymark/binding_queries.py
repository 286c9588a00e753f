"""Registered queries of bindings over the given tables, with their SQL. Importing this module adds them
to waymark.queries: parts are requirements, suppliers capabilities, and each customer asks to bind orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import bindings, intent
from waymark.plans import projection
from waymark.plans.lineage import cut
from waymark.plans.projection import GRAPH_SQL
from waymark.queries import read, register

_BOTH_SQL = GRAPH_SQL + """, every AS MATERIALIZED (SELECT id, kind, name, file, line, false AS own FROM nodes
  UNION ALL SELECT 'req:' || p_partkey, 'requirement', p_name, NULL, NULL, true FROM part UNION ALL SELECT 'cap:' || s_suppkey, 'capability', s_name, 'supplier', NULL, true FROM supplier),
asked AS MATERIALIZED (SELECT c_custkey AS ask, CASE c_custkey % 4 WHEN 0 THEN 'CAP:' || c_custkey % 10 WHEN 1 THEN 'supplier:' || c_custkey % 10 ELSE 'cap:' || c_custkey % 10 END AS slice,
  CASE WHEN c_custkey % 5 = 0 THEN 'Req:' || c_custkey ELSE 'req:' || (c_custkey % 200 + 1) END AS realizes, CASE WHEN c_custkey % 3 = 0 THEN 'cap:1' END AS decision,
  ['endpoint:ORDER ' || c_custkey, 'customer:' || c_custkey, 'Topic:' || CASE WHEN c_custkey % 7 = 0 THEN 'none' ELSE '' END] AS codes, CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE 'as ' || c_name || ' asked' END AS why FROM customer),
named AS MATERIALIZED (SELECT ask, 'slice' AS role, slice AS text, 0 AS pos FROM asked UNION ALL SELECT ask, 'realizes', realizes, 0 FROM asked UNION ALL SELECT ask, 'decision', decision, 0 FROM asked WHERE decision IS NOT NULL
  UNION ALL SELECT ask, 'code', unnest(codes), generate_subscripts(codes, 1) - 1 FROM asked),
texts AS MATERIALIZED (SELECT DISTINCT text FROM named), exact AS MATERIALIZED (SELECT text, bool_or(own) AS own FROM texts JOIN every ON id = text GROUP BY text),
hits AS MATERIALIZED (SELECT text, count(*) AS n, count_if(own) AS n_own, min(id) AS first, arg_min(own, id) AS first_is_own, min(id) FILTER (own) AS first_own
  FROM texts JOIN every ON contains(lower(id), lower(text)) OR contains(lower(coalesce(name, '')), lower(text)) WHERE text NOT IN (SELECT text FROM exact) GROUP BY text),
looked AS MATERIALIZED (SELECT ask, role, n.text, pos, coalesce(n, 0) AS n,
  CASE WHEN e.text IS NOT NULL THEN e.text WHEN role = 'code' OR (role = 'slice' AND n = 1) THEN first WHEN role IN ('slice', 'realizes') AND n_own = 1 THEN first_own END AS id,
  CASE WHEN e.text IS NOT NULL THEN e.own WHEN role = 'code' OR (role = 'slice' AND n = 1) THEN first_is_own WHEN role IN ('slice', 'realizes') AND n_own = 1 THEN true END AS own
  FROM named n LEFT JOIN exact e ON n.text = e.text LEFT JOIN hits h ON n.text = h.text),
told AS MATERIALIZED (SELECT *, role || ' ''' || text || ''' ' || CASE WHEN id IS NULL AND role = 'slice' AND n > 1 THEN 'is ambiguous: ' || n || ' nodes' WHEN id IS NULL THEN 'is unknown'
  WHEN role = 'code' AND own THEN 'is an intent node: ' || id WHEN role <> 'code' AND NOT own THEN 'is a derived node: ' || id END AS problem FROM looked),
problems AS (SELECT ask, problem FROM told WHERE problem IS NOT NULL UNION ALL SELECT ask, 'no reason' FROM asked WHERE trim(why) = ''),
pairs AS (SELECT c.ask, c.pos, c.id AS src, t.id AS dst, CASE t.role WHEN 'slice' THEN 'delivered-in' WHEN 'decision' THEN 'motivated-by' ELSE t.role END AS type
  FROM told c JOIN told t ON c.ask = t.ask AND c.role = 'code' AND t.role <> 'code' WHERE c.ask NOT IN (SELECT ask FROM problems)),
made AS (SELECT src, dst, type, why FROM pairs JOIN asked USING (ask) QUALIFY row_number() OVER (PARTITION BY src, dst, type ORDER BY ask, pos) = 1)"""


def _bound(spark, d) -> tuple:
    c, lit = F.col, F.lit
    text = lambda prefix, key: F.concat(lit(prefix), key.cast("string"))
    derived = projection.nodes(spark, d).select("id", "kind", "name", "file", "line", "provenance")
    own = read(spark, d, "part").select(text("req:", c("p_partkey")).alias("id"), lit("requirement").alias("kind"), c("p_name").alias("name"))
    own = own.unionByName(read(spark, d, "supplier").select(text("cap:", c("s_suppkey")).alias("id"), lit("capability").alias("kind"), c("s_name").alias("name"), lit("supplier").alias("file")), allowMissingColumns=True)
    nodes = cut(derived.unionByName(own.withColumn("provenance", lit("asserted")), allowMissingColumns=True))
    key, tail = c("c_custkey"), c("c_custkey") % 10
    asks = read(spark, d, "customer").select(
        key.cast("long").alias("ask"), F.when(key % 4 == 0, text("CAP:", tail)).when(key % 4 == 1, text("supplier:", tail)).otherwise(text("cap:", tail)).alias("slice"),
        F.when(key % 5 == 0, text("Req:", key)).otherwise(text("req:", key % 200 + 1)).alias("realizes"), F.when(key % 3 == 0, "cap:1").alias("decision"),
        F.array(F.concat(text("endpoint:ORDER ", key), text(",customer:", key)), F.concat(lit("Topic:"), F.when(key % 7 == 0, "none").otherwise(""))).alias("codes"),
        F.when(key % 11 == 0, " ").otherwise(F.concat(lit("as "), "c_name", lit(" asked"))).alias("why"), lit("ann").alias("author"), lit(None).cast("array<string>").alias("declares"),
    )
    none = spark.createDataFrame([], "src string, dst string, type string, provenance string, why string, review string, edge_seq long")
    return nodes, bindings.bind_asks(nodes, none, asks)


@register(f"WITH {_BOTH_SQL} SELECT src, dst, type, why FROM made")
def bound_asks(spark, d):
    """Edges that the asks of all customers make."""
    return _bound(spark, d)[1].made.select("src", "dst", "type", "why")


@register(f"WITH {_BOTH_SQL} SELECT ask, problem FROM problems")
def binding_problems(spark, d):
    return _bound(spark, d)[1].problems


@register(f"""WITH {_BOTH_SQL}, member AS (SELECT DISTINCT 'req:' || l_partkey AS requirement, 'cap:' || l_suppkey AS cap FROM lineitem WHERE l_linenumber = 2),
stale AS (SELECT src AS id FROM made WHERE type = 'realizes' AND dst LIKE '%7' UNION SELECT dst FROM made WHERE type = 'realizes' AND dst LIKE '%7'),
code AS (SELECT dst AS requirement, src AS code, why, name AS label, kind AS code_kind, file, line FROM made JOIN every ON src = id WHERE type = 'realizes')
SELECT 'cap:' || s_suppkey AS cap, s_name AS title, q.requirement, p_name AS requirement_title,
CASE WHEN q.requirement IN (SELECT id FROM stale) THEN 'stale' WHEN code IS NOT NULL THEN 'realized' WHEN q.requirement IS NOT NULL THEN 'unbound' END AS status, code, label, code_kind, file, line, why
FROM supplier LEFT JOIN (member JOIN part ON requirement = 'req:' || p_partkey) q ON q.cap = 'cap:' || s_suppkey LEFT JOIN code ON code.requirement = q.requirement""")
def capability_rows(spark, d):
    """Suppliers as capabilities, with the parts of second order lines and what the customers bound to them."""
    nodes, bound = _bound(spark, d)
    c = F.col
    waits = F.when((c("type") == "realizes") & c("dst").endswith("7"), "needs-review")
    made = bound.made.select("src", "dst", "type", "why", waits.alias("review"), F.lit(0).cast("long").alias("edge_seq"))
    li = read(spark, d, "lineitem").where("l_linenumber = 2")
    part_of = li.select(F.concat(F.lit("req:"), c("l_partkey").cast("string")).alias("src"), F.concat(F.lit("cap:"), c("l_suppkey").cast("string")).alias("dst"), F.lit("part-of").alias("type"))
    return intent.capability_rows(nodes, made.unionByName(part_of, allowMissingColumns=True))
