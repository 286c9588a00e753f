"""The graph kept up to date by changes: what a run makes equals a new scan of the tree.

What files say is kept as claims: rows with the file and the place in it. Of the claims of a node (by id)
or of a reference (by source, name asked for and type) the first in walk order counts, the others are
spares that take its place when its file goes. So a change touches the keys that changed files claim or
claimed, and:

* references elsewhere that ask for a name which a touched node has or had: each edge keeps the symbolic
  name (``asked``) beside what it resolved to, and these are looked up again, among the nodes that have the
  names asked for;
* flow candidates whose seed leads to a touched edge, found by walking back from it;
* manual bindings whose code is gone or was scanned again;
* the detected stack, which is small.

Tables that are joined with a change are read, and only rows of touched keys are written. An empty graph
and a whole tree give the first build.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import schema as S
from waymark.functions.text import walk_key
from waymark.operators import detect, intent, resolve, traverse
from waymark.operators.build import first_wins, union_all
from waymark.operators.validate import freshness, malformed_id
from waymark.plans.lineage import cut, small
from waymark.sources.extract import emissions

_AT = "at struct<walk:array<struct<d:int,n:string>>,place:bigint>"
_COMMON = "file string, line int, provenance string, meta map<string,string>"
NODE = f"id string, kind string, name string, {_COMMON}, confidence string, lang string, package string, {_AT}"
EDGE = (
    f"src string, asked string, type string, {_COMMON}, asked_confidence string, binding string, why string, author string, {_AT},"
    " dst string, confidence string, resolved string, review string, review_reason string"
)
SCHEMAS = {
    "nodes": NODE, "spare_nodes": NODE, "edges": EDGE, "spare_edges": EDGE, "hashes": "path string, sha256 string",
    "flows": "seed string, kind string, chain array<string>", "stack": "section string, name string, confidence string",
}
KEYS = {"nodes": ["id"], "spare_nodes": ["id"], "edges": ["src", "asked", "type"], "spare_edges": ["src", "asked", "type"], "hashes": ["path"], "flows": ["seed"], "stack": ["name"]}
NODE_KEY, EDGE_KEY = KEYS["nodes"], KEYS["edges"]
#: Steps from a flow's seed to the last node whose edges count.
FLOW_STEPS = 4


@dataclass
class Graph:
    nodes: DataFrame
    spare_nodes: DataFrame
    edges: DataFrame
    spare_edges: DataFrame
    hashes: DataFrame
    flows: DataFrame
    stack: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def empty(spark: SparkSession) -> Graph:
    return Graph(**{name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()})


@dataclass
class Change:
    """What a run replaces: of each table the keys and their new rows; and the state of changed files."""

    states: DataFrame
    keys: dict[str, DataFrame]
    rows: dict[str, DataFrame]

    def applied(self, old: Graph) -> Graph:
        return Graph(**{n: _replaced(df, self.keys[n], self.rows[n], KEYS[n]) for n, df in old.tables().items()})


def _replaced(df: DataFrame, keys: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    return df.join(small(keys), by, "left_anti").select(df.columns).unionByName(rows.select(df.columns))


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema; null where there is none."""
    wanted = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def asserted(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Curated rows of any graph in this shape."""
    at = F.struct(walk_key(F.coalesce("file", F.lit(""))).alias("walk"), F.lit(1 << 40).alias("place"))
    own = lambda df: df.where("provenance = 'asserted'").withColumn("at", at)
    return _shaped(own(nodes), NODE), _shaped(own(edges).withColumns({"asked": F.col("dst"), "asked_confidence": F.col("confidence")}), EDGE)


def claims(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All node and edge rows that files (path, content) claim, without malformed ids."""
    rows = cut(emissions(files))
    at = F.struct(walk_key(F.col("path")).alias("walk"), F.col("place"))
    rows = rows.withColumns({"file": F.col("path"), "at": at, "provenance": F.lit("derived")})
    nodes = rows.where("row = 'node'").withColumns({"lang": F.col("meta")["lang"], "package": F.col("meta")["package"]})
    edges = rows.where("row = 'edge'").withColumns({"asked": F.col("dst"), "asked_confidence": F.col("confidence")})
    nodes = nodes.where(~F.coalesce(malformed_id(F.col("id")), F.lit(False)))
    edges = edges.where(~F.coalesce(malformed_id(F.col("src")) | malformed_id(F.col("dst")), F.lit(False)))
    return _shaped(nodes, NODE), _shaped(edges, EDGE)


def _contest(winners: DataFrame, spares: DataFrame, new: DataFrame, gone: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(touched keys, their new winners, their new spares) when all claims of the files ``gone`` (path) go
    and ``new`` ones come."""
    old = winners.unionByName(spares)
    path = small(gone).select(F.col("path").alias("__p"))
    leaves = (F.col("provenance") != "asserted") & F.col("__p").isNotNull()
    old = old.join(path, F.col("file") == F.col("__p"), "left").withColumn("leaves", F.coalesce(leaves, F.lit(False))).drop("__p")
    touched = cut(old.where("leaves").select(key).unionByName(new.select(key)).distinct())
    rows = cut(old.join(small(touched), key, "left_semi").where("NOT leaves").select(new.columns).unionByName(new))
    best = cut(first_wins(rows, key, "at"))
    return touched, best, rows.join(best.select(*key, "at"), [*key, "at"], "left_anti").select(new.columns)


def _asks(edges: DataFrame) -> DataFrame:
    """edges with each name (i, key) that they ask for."""
    return edges.withColumn("ask", F.explode(resolve.asked(F.col("asked"))))


def _walk_back(srcs: DataFrame, edges: DataFrame, steps: int) -> DataFrame:
    """(node): the nodes that lead to some of ``srcs`` (node) in so many steps, these included."""
    seen = front = cut(srcs.distinct())
    back = edges.where(F.col("type").isin(*S.FLOW_WALK_TYPES, "handled-by")).select("src", "dst")
    for _ in range(steps):
        step = back.join(small(front.select(F.col("node").alias("dst"))), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti"))
        if not front.limit(1).count():
            break
        seen = cut(seen.unionByName(front))
    return seen


def _renewed(edges: DataFrame) -> DataFrame:
    """Edges as they were extracted."""
    symbolic = F.col("provenance") != "asserted"
    none = F.lit(None).cast("string")
    return edges.withColumns({
        "dst": F.when(symbolic, F.col("asked")).otherwise(F.col("dst")), "resolved": none,
        "confidence": F.when(symbolic, F.col("asked_confidence")).otherwise(F.col("confidence")),
    })


def advance(old: Graph, files: DataFrame, states: DataFrame | None = None) -> Change:
    """What changes when the tree is ``files`` (path, content, sha256; all of it). With ``states`` (path,
    state: deleted or another) the files are only those that changed; the stack, which is told from the
    whole tree, then stays as it was."""
    spark, whole = files.sparkSession, states is None
    states = cut(freshness(old.hashes, files).where("state != 'fresh'") if whole else states.select("path", "state"))
    gone = states.select("path")
    fresh = files.join(small(states.where("state != 'deleted'").select("path")), "path", "left_semi")
    new_nodes, new_edges = claims(fresh)

    ids, nodes, spare_nodes = _contest(old.nodes, old.spare_nodes, new_nodes, gone, NODE_KEY)
    links, edges, spare_edges = _contest(old.edges, old.spare_edges, new_edges, gone, EDGE_KEY)
    was = cut(old.nodes.join(small(ids), NODE_KEY, "left_semi"))
    nodes_now = _replaced(old.nodes, ids, nodes, NODE_KEY)

    # References from anywhere to names that a touched node has or had.
    names = cut(union_all([r.select("i", "key") for df in (was, nodes) for r in [resolve.names(df, "at")]]).distinct())
    other = old.edges.where("provenance != 'asserted'").join(small(links), EDGE_KEY, "left_anti")
    hit = _asks(other).join(small(names.select(F.struct("i", "key").alias("ask"))), "ask", "left_semi").select(*EDGE_KEY).distinct()
    other = cut(other.join(small(cut(hit)), EDGE_KEY, "left_semi"))
    asking = cut(_renewed(edges.select(other.columns).unionByName(other)))
    wanted = cut(_asks(asking).select(F.col("ask.i").alias("i"), F.col("ask.key").alias("key")).distinct())
    held = cut(resolve.names(nodes_now, "at").join(small(wanted), ["i", "key"], "left_semi"))
    edges = cut(_shaped(resolve.resolve(asking, nodes_now, ix=resolve.indexes_of(held)), EDGE))
    links = cut(links.unionByName(other.select(*EDGE_KEY)).distinct())
    edges_now = _replaced(old.edges, links, edges, EDGE_KEY)

    # Manual bindings to code that is gone or was scanned again.
    bound = edges_now.where("binding = 'manual'")
    marked = intent.mark_reviews(bound.drop("review", "review_reason"), nodes_now, gone).where("review IS NOT NULL")
    marked = cut(_shaped(marked, EDGE))
    if marked.limit(1).count():
        edges = _replaced(edges, marked.select(*EDGE_KEY), marked, EDGE_KEY)
        links = cut(links.unionByName(marked.select(*EDGE_KEY)).distinct())
        edges_now = _replaced(old.edges, links, edges, EDGE_KEY)

    # Flows of the seeds that lead to touched edges.
    moved = links.select(F.col("src").alias("node")).unionByName(ids.select(F.col("id").alias("node")))
    walk = old.edges.select("src", "dst", "type").unionByName(edges.select("src", "dst", "type"))
    seeds = _walk_back(moved, walk, FLOW_STEPS).select(F.col("node").alias("seed"))
    flows = traverse.flow_candidates(nodes_now, edges_now.withColumnRenamed("at", "edge_seq"), only=seeds)

    name = F.element_at(F.split("path", "/"), -1)
    texts = files.select("path", F.when(detect.any_of(name, detect.READ), F.decode("content", "UTF-8")).alias("text"))
    stack = cut(detect.detect(spark, texts)) if whole else old.stack
    rows = {
        "nodes": nodes, "spare_nodes": spare_nodes, "edges": edges, "spare_edges": spare_edges, "flows": flows, "stack": stack,
        "hashes": files.select("path", "sha256").join(small(gone), "path", "left_semi"),
    }
    keys = {
        "nodes": ids, "spare_nodes": ids, "edges": links, "spare_edges": links, "flows": seeds, "hashes": gone,
        "stack": old.stack.select("name").unionByName(stack.select("name")).distinct(),
    }
    # Spares of references that were only looked up again stay as they are.
    again = other.select(*EDGE_KEY).unionByName(marked.select(*EDGE_KEY))
    kept = old.spare_edges.join(again, EDGE_KEY, "left_semi").join(spare_edges, [*EDGE_KEY, "at"], "left_anti")
    rows["spare_edges"] = spare_edges.unionByName(kept.select(spare_edges.columns))
    return Change(states, {n: cut(k.select(KEYS[n])) for n, k in keys.items()}, {n: cut(_shaped(r, SCHEMAS[n])) for n, r in rows.items()})
