"""Registered queries of layers, view modes and extraction in SQL, with their SQL. Importing this module
adds them to waymark.queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark import schema as S
from waymark.operators import inventory, layers, traverse
from waymark.plans.lineage import dealt
from waymark.queries import LIVE_SQL, _in, _rank_sql, graph, register
from waymark.sources import table_function
from waymark.table_sources import _PARTS_SQL, parts

_LAYER_CASE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {S.LAYERS.index(v)}" for k, v in S.LAYER_OF.items()) + f" ELSE {layers.MIDDLE} END"


def _layers_sql(most: int = 8) -> str:
    """Longest paths by recursion, then the layer's rule level by level."""
    sql = f"""WITH RECURSIVE {LIVE_SQL}, walk(id, steps) AS (
  SELECT id, 0 FROM (SELECT id FROM nodes UNION SELECT src FROM live UNION SELECT dst FROM live) WHERE id NOT IN (SELECT src FROM live)
  UNION SELECT src, steps + 1 FROM walk JOIN live ON dst = id),
steps AS MATERIALIZED (SELECT id, max(steps)::INT AS steps FROM walk GROUP BY id),
l0 AS MATERIALIZED (SELECT id, {layers.MIDDLE} AS layer FROM steps WHERE steps = 0)"""
    for s in range(1, most + 1):
        sql += f""", l{s} AS MATERIALIZED (SELECT * FROM l{s - 1} UNION ALL SELECT src, least(5, max(1 + layer) // 2)::INT FROM live JOIN steps ON src = steps.id JOIN l{s - 1} ON dst = l{s - 1}.id
  WHERE steps = {s} GROUP BY src)"""
    return sql + f" SELECT id, layer::INT AS layer, steps FROM steps LEFT JOIN l{most} USING (id)"


@register(_layers_sql())
def longest_path_layers(spark, d):
    """Layer and longest path of every node (the projected graph has no cycle)."""
    n, e = graph(spark, d)
    return layers.longest_path_layers(traverse.adjacency(n, e), n).select("id", "layer", "steps")


def _order_sql(columns: tuple[int, ...], sweeps: int = 4) -> str:
    """The sweeps written out, one step each; layers that the projected graph has."""
    sql = f"""WITH {LIVE_SQL}, own AS MATERIALIZED (SELECT id, {_LAYER_CASE} AS layer, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(id, ''), lambda x: ord(x)::BIGINT)),
  lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 997 AS hash FROM nodes WHERE kind <> 'file'),
links AS MATERIALIZED (SELECT src, dst, a.layer AS sl, b.layer AS dl FROM live JOIN own a ON src = a.id JOIN own b ON dst = b.id)"""
    name = {c: f"c{c}_0" for c in columns}
    for c in columns:
        sql += f", c{c}_0 AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM own WHERE layer = {c})"
    for sweep in range(sweeps):
        order = columns if sweep % 2 == 0 else columns[::-1]
        here, there, hl, tl = ("dst", "src", "dl", "sl") if sweep % 2 == 0 else ("src", "dst", "sl", "dl")
        for ref, c in zip(order, order[1:], strict=False):
            sql += f""", c{c}_{sweep + 1} AS MATERIALIZED (SELECT o.id, row_number() OVER (ORDER BY coalesce(mean, hash::DOUBLE / 997 * (SELECT count(*) FROM own WHERE layer = {c})), o.id) - 1 AS place
  FROM own o LEFT JOIN (SELECT {here} AS id, sum(place)::DOUBLE / count(*) AS mean FROM links JOIN {name[ref]} p ON p.id = {there} WHERE {hl} = {c} AND {tl} = {ref} GROUP BY 1) m ON m.id = o.id WHERE layer = {c})"""
            name[c] = f"c{c}_{sweep + 1}"
    return sql + " " + " UNION ALL ".join(f"SELECT id, {c} AS layer, place FROM {name[c]}" for c in columns)


@register(_order_sql((0, 1, 3, 5)))
def layer_order(spark, d):
    """Place of every node in its layer."""
    n, e = graph(spark, d)
    own = n.where("kind != 'file'").select("id", S.layer_of(F.col("kind")).alias("layer"))
    return layers.layer_order(own, traverse.adjacency(n, e))


def _modes_sql(last: str) -> str:
    """Six modes, each by itself: seeds, neighbours, ranks."""
    kinds = ", ".join(f"('{m}', '{k}')" for m, (_, ks) in inventory.MODES.items() for k in ks)
    types = ", ".join(f"('{m}', '{t}')" for m, (ts, _) in inventory.MODES.items() for t in ts or ())
    names = ", ".join(f"('{m}', {str(ts is None).lower()})" for m, (ts, _) in inventory.MODES.items())
    return f"""WITH {LIVE_SQL}, modes(mode, anytype) AS (VALUES {names}), mk(mode, kind) AS (VALUES {kinds}), mt(mode, type) AS (VALUES {types}),
deg AS (SELECT src, count(*) AS n FROM live GROUP BY src),
keep AS MATERIALIZED (SELECT id, kind, row_number() OVER (ORDER BY {_rank_sql("coalesce(confidence, 'UNKNOWN')", S.CONF_RANK, 3)}, {_rank_sql('kind', S.KIND_RANK, 50)}, coalesce(n, 0) DESC, name, node_seq) AS r
  FROM nodes LEFT JOIN deg ON src = id WHERE kind <> 'file'),
own AS (SELECT mode, id, r FROM keep JOIN mk USING (kind)),
cand AS (SELECT * FROM own UNION ALL SELECT mode, id, r FROM modes, keep WHERE mode NOT IN (SELECT mode FROM own)),
seeds AS MATERIALIZED (SELECT mode, id FROM cand QUALIFY row_number() OVER (PARTITION BY mode ORDER BY r) <= 200),
near AS (SELECT mode, src, dst, type FROM seeds JOIN (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY src ORDER BY edge_seq) <= 8) ON src = id
  UNION ALL SELECT mode, src, dst, type FROM seeds JOIN (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY dst ORDER BY edge_seq) <= 8) ON dst = id),
fits AS (SELECT mode, src, dst FROM near JOIN modes USING (mode) WHERE (anytype OR (mode, type) IN (SELECT (mode, type) FROM mt)) AND src IN (SELECT id FROM keep) AND dst IN (SELECT id FROM keep)),
every AS (SELECT mode, id FROM seeds UNION SELECT mode, src FROM fits UNION SELECT mode, dst FROM fits),
want AS MATERIALIZED (SELECT mode, id FROM every JOIN keep USING (id) QUALIFY row_number() OVER (PARTITION BY mode ORDER BY r) <= 400),
among AS (SELECT a.mode, src, dst, type, edge_seq FROM live JOIN want a ON src = a.id JOIN want b ON dst = b.id AND a.mode = b.mode JOIN modes m ON m.mode = a.mode
  WHERE anytype OR (a.mode, type) IN (SELECT (mode, type) FROM mt)),
links AS (SELECT * FROM among QUALIFY row_number() OVER (PARTITION BY mode ORDER BY edge_seq, src, dst, type) <= 1200)
{last}"""


@register(_modes_sql("SELECT mode, id FROM want"))
def view_modes(spark, d):
    """Nodes of all modes, in one traversal."""
    return inventory.view_modes(*graph(spark, d))[0]


@register(_modes_sql("SELECT mode, src, dst, type FROM links"))
def view_mode_edges(spark, d):
    return inventory.view_modes(*graph(spark, d))[1]


@register(f"""WITH {_PARTS_SQL}
SELECT path, 'file:' || path AS id, 'file' AS kind FROM f UNION ALL SELECT path, 'table:part_' || k, 'table' FROM f WHERE sort = 2
UNION ALL SELECT path, 'config:' || path, 'configuration' FROM f WHERE sort IN (0, 1, 3, 6)
UNION ALL SELECT path, 'py:class:Part' || k, 'class' FROM f WHERE sort = 4 UNION ALL SELECT path, 'py:class:Part' || k || '#size', 'method' FROM f WHERE sort = 4
UNION ALL SELECT path, 'fallback:' || path || '::Note' || k, 'class' FROM f WHERE sort = 5
UNION ALL SELECT path, 'migration:schema.sql', 'migration' FROM f WHERE sort = 2""")
def extracted_in_sql(spark, d):
    """What the extractors find in the file of each part, by the table function in a lateral join."""
    table_function.register(spark)
    files = dealt(parts(spark, d), "path")
    return spark.sql("SELECT f.path, e.id, e.kind FROM {files} f, LATERAL extract_rows(f.path, f.content) e WHERE e.row = 'node'", files=files)
