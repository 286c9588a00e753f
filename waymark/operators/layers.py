"""Layers of a directed graph: longest paths by peeling, and the order of nodes in a layer by
barycentre sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import schema as S
from waymark.operators.scopes import global_rank
from waymark.plans.lineage import Levels, cut, small

#: Layer of what has no target, and of what lies on a cycle.
MIDDLE = 3
#: The order metric moves a node without neighbours by its hash.
BUCKETS = 997


def _peeled(adj: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, steps, cyclic) as longest_steps, (id) of what has an end as a target, and (id) of the cyclic nodes.

    A level reads the edges that are left once: those into what was peeled go, and only their sources
    can be peeled next, if no edge of theirs stays. The nodes themselves are not written again."""
    rest = adj.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    ids = nodes.select("id", F.lit(False).alias("out")).unionAll(rest.select("src", F.lit(True))).unionAll(rest.select("dst", F.lit(False)))
    ends = ids.where("id IS NOT NULL").groupBy("id").agg(F.max("out").alias("out")).where("NOT out")
    peeled = Levels(ends.select("id", F.lit(0).alias("steps")))
    gone, steps, over_ends = peeled.all(), 0, None
    while peeled.n_rows:
        hint = small(gone.select(F.col("id").alias("dst")))
        next_ = cut(rest.join(hint, "dst", "left_semi").select(F.col("src").alias("id")).distinct())
        over_ends = next_ if over_ends is None else over_ends
        rest = cut(rest.join(hint, "dst", "left_anti"), "zstd")
        held = rest.join(small(next_).withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("src").alias("id")).distinct()
        steps += 1
        gone = peeled.append(next_.join(held, "id", "left_anti").withColumn("steps", F.lit(steps)))
    # What is left has a target that is left.
    left = cut(rest.select(F.col("src").alias("id")).distinct())
    upstream = Levels(left.limit(0))
    core = left
    while True:
        gone = upstream.append(core.join(rest.select(F.col("dst").alias("id")).distinct(), "id", "left_anti"))
        if not upstream.n_rows:
            break
        hint = small(gone)
        core = cut(core.join(hint, "id", "left_anti"))
        rest = cut(rest.join(hint.withColumnRenamed("id", "src"), "src", "left_anti"))
    none = F.lit(None).cast("int")
    parts = [(peeled.all(), F.col("steps"), False), (upstream.all(), none, False), (core, none, True)]
    a, b, c = (df.select("id", s.alias("steps"), F.lit(cyclic).alias("cyclic")) for df, s, cyclic in parts)
    return a.unionAll(b).unionAll(c), left.limit(0) if over_ends is None else over_ends, core


def longest_steps(adj: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, steps, cyclic): edges on the longest path from a node to its end, by peeling: what has no
    target left goes, level by level. Nodes that lead to a cycle have null steps; cyclic are those
    that stay when, after that, what has no source left goes as well (the nodes on cycles, and on paths
    from one cycle to another). Repeated edges and ids count once."""
    return _peeled(adj, nodes)[0]


def longest_path_layers(adj: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, layer, steps, cyclic). A node's layer is half of one more than the highest layer of its
    targets, at most 5; without targets, or cyclic, it is the middle.

    Ends and cycles are at 3, so what has one of those as a target is at 2, and all else, whose targets
    are at 2 or below, at 1: the layer needs one join once the cycles are known. Peeling has seen
    already which nodes have an end as a target."""
    known, near, cyclic = _peeled(adj, nodes)
    if cyclic.limit(1).count():
        to = adj.select("src", "dst").join(small(cyclic.select(F.col("id").alias("dst"))), "dst", "left_semi")
        near = cut(near.union(to.select(F.col("src").alias("id"))).where("id IS NOT NULL").distinct())
    near = small(near).withColumn("near", F.lit(True))
    layer = F.when(F.col("cyclic") | (F.coalesce("steps", F.lit(1)) == 0), MIDDLE).when(F.col("near"), 2).otherwise(1)
    return known.join(near, "id", "left").select("id", layer.alias("layer"), "steps", "cyclic")


def name_hash(text: Column) -> Column:
    """Unsigned 32-bit FNV-1a over the characters' codes (below 2^16)."""
    prime, start, word = 16777619, 2166136261, 0xFFFFFFFF
    codes = F.transform(F.filter(F.split(text, ""), lambda ch: ch != ""), lambda ch: F.ascii(ch).cast("long"))
    # Split into halves, so that the product stays below 2^63.
    step = lambda h, c: ((h.bitwiseXOR(c)) * F.lit(prime).cast("long")).bitwiseAND(F.lit(word).cast("long"))
    return F.aggregate(codes, F.lit(start).cast("long"), step)


def layer_order(nodes: DataFrame, edges: DataFrame, sweeps: int = 4) -> DataFrame:
    """(id, layer, place): the order of each layer's nodes after barycentre sweeps, forwards and
    backwards in turn. At first by id; then a node goes to the mean place of its neighbours in the layer
    before (after, when backwards), without any to the place its hash gives; ties by id.

    nodes are (id, layer): the layers' names or any numbers below 1,000; empty layers collapse. edges
    (src, dst) count as often as they stand there. Each step ranks one layer over range partitions, so
    no layer has to fit into a task; means are exact sums over counts. The steps know a node by its place by
    id, a number, which also breaks the ties; names and hashes are needed once."""
    own = nodes.select("id", "layer").where("id IS NOT NULL").groupBy("id").agg(F.min("layer").alias("layer"))
    if dict(nodes.dtypes)["layer"] == "string":
        number = F.element_at(F.create_map(*[F.lit(x) for i, v in enumerate(S.LAYERS) for x in (v, i)]), F.col("layer"))
        own = own.withColumn("layer", F.coalesce(number, F.lit(MIDDLE)))
    own = own.withColumn("layer", F.col("layer").cast("int"))
    ranked = cut(global_rank(own.withColumn("key", F.struct("layer", "id")), "key").select("id", "layer", "rank"), "zstd")
    sizes = {r["layer"]: (r["n"], r["least"]) for r in ranked.groupBy("layer").agg(F.count("*").alias("n"), F.min("rank").alias("least")).orderBy("layer").limit(1000).collect()}
    columns = sorted(sizes)
    alone = (name_hash(F.col("id")) % BUCKETS).cast("double") / float(BUCKETS)
    rows = {c: cut(ranked.where(F.col("layer") == c).select(F.col("rank").alias("no"), alone.alias("alone")), "zstd") for c in columns}
    at = {c: df.select("no", (F.col("no") - sizes[c][1]).alias("place")) for c, df in rows.items()}
    ends = [ranked.select(F.col("id").alias(k), F.col("layer").alias(f"{k}_layer"), F.col("rank").alias(f"{k}_no")) for k in ("src", "dst")]
    links = edges.select("src", "dst").join(ends[0], "src").drop("src").join(ends[1], "dst")
    numbers = {c: i for i, c in enumerate(columns)}
    apart = F.abs(F.element_at(F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv]), F.col("src_layer")) - F.element_at(F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv]), F.col("dst_layer"))) if columns else F.lit(0)
    links = cut(links.where(apart == 1).select("src_layer", "dst_layer", F.col("src_no").alias("src"), F.col("dst_no").alias("dst")), "zstd")
    for sweep in range(sweeps):
        order = columns if sweep % 2 == 0 else columns[::-1]
        here, there = ("dst", "src") if sweep % 2 == 0 else ("src", "dst")
        for ref, layer in zip(order, order[1:], strict=False):
            near = links.where((F.col(f"{here}_layer") == layer) & (F.col(f"{there}_layer") == ref)).select(F.col(here).alias("no"), F.col(there).alias("to"))
            near = near.join(at[ref].withColumnRenamed("no", "to"), "to").groupBy("no").agg((F.sum("place") / F.count("*")).alias("mean"))
            bar = F.coalesce("mean", F.col("alone") * float(sizes[layer][0]))
            row = rows[layer].join(near, "no", "left").select("no", F.struct(bar.alias("bar"), "no").alias("key"))
            at[layer] = cut(global_rank(row, "key").select("no", (F.col("rank") - 1).alias("place")))
    places = ranked.where("false").select(F.col("rank").alias("no"), F.lit(0).cast("long").alias("place"))
    for df in at.values():
        places = places.unionAll(df)
    return ranked.select("id", "layer", F.col("rank").alias("no")).join(places, "no").select("id", "layer", "place")
