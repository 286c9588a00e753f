"""Filters, projections, aggregates and ranked views over the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark import schema as S
from waymark.functions.text import let
from waymark.operators.build import first_wins, last_wins, resolved_edges, union_all
from waymark.plans.lineage import by_shuffle, cut, small, spread


def kinds(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


def edges_by_type(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("n"))


def query(nodes: DataFrame, kind: str | None = None, name: str | None = None, lang: str | None = None) -> DataFrame:
    """Kind equal, name or id contains (without case), language equal."""
    if kind:
        nodes = nodes.where(F.col("kind") == kind)
    if name:
        nodes = nodes.where(matches(name))
    if lang:
        nodes = nodes.where(F.col("lang") == lang)
    return nodes


def matches(text: str) -> Column:
    t = text.lower()
    return F.lower(F.coalesce("name", F.lit(""))).contains(t) | F.lower("id").contains(t)


def find_nodes(nodes: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Nodes whose name or id contains the text, in graph order."""
    hits = nodes.where(matches(text))
    return hits.orderBy("node_seq", "id").limit(limit) if limit else hits


def resolve_code_node(nodes: DataFrame, text: str) -> DataFrame:
    """The exact id, else the first hit by id; ambiguous tells that there were others."""
    hits = nodes.where((F.col("id") == text) | matches(text)).select("id", (F.col("id") != text).alias("far"))
    best = hits.orderBy("far", "id").limit(2).agg(
        F.min_by("id", F.struct("far", "id")).alias("id"), F.count("*").alias("n"), F.min("far").alias("far")
    )
    return best.where("id IS NOT NULL").select("id", (F.col("far") & (F.col("n") > 1)).alias("ambiguous"))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, deg): in and out over resolved edges, of nodes that are no files."""
    live = resolved_edges(edges, nodes)
    ends = live.select(F.col("src").alias("__e")).unionAll(live.select(F.col("dst").alias("__e")))
    count = ends.groupBy("__e").agg(F.count("*").alias("deg"))
    keep = nodes.where("kind != 'file'").select("id")
    return keep.join(count, keep["id"] == count["__e"], "left").select("id", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))


def modules(nodes: DataFrame, sample: int = 8) -> DataFrame:
    """Per (package or namespace, language): nodes, and the first names in order. Only the least
    ``sample`` distinct names are kept while aggregating."""
    area = F.coalesce(F.col("package"), F.lit("")).alias("area")
    rows = nodes.select(area, F.coalesce("lang", F.lit("")).alias("lang"), "name")
    count = rows.groupBy("area", "lang").agg(F.count("*").alias("n"))
    w = Window.partitionBy("area", "lang").orderBy("name")
    names = (
        rows.distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= sample)
        .groupBy(F.col("area").alias("a"), F.col("lang").alias("l")).agg(F.array_join(F.sort_array(F.collect_list("name")), "|").alias("names"))
    )
    return count.join(names, (F.col("area") == F.col("a")) & (F.col("lang") == F.col("l"))).select("area", "lang", "n", "names")


def symbols(nodes: DataFrame, cap: int = 3000) -> DataFrame:
    return nodes.select("id", "name", "kind", "lang", "file", "line", "confidence").orderBy(F.lower("name"), "id").limit(cap)


def dependencies(edges: DataFrame, types: tuple[str, ...] = S.DEP_EDGES, cap: int = 200) -> DataFrame:
    return edges.where(F.col("type").isin(*types)).select("type", "src", "dst", "confidence").orderBy("type", "src", "dst").limit(cap)


def handlers(edges: DataFrame, which: str = "last") -> DataFrame:
    """(endpoint, handler): the last (flows, API map) or the first (tables) handled-by edge."""
    own = edges.where("type = 'handled-by'").select(F.col("src").alias("endpoint"), F.col("dst").alias("handler"), "edge_seq")
    pick = last_wins if which == "last" else first_wins
    return pick(own, ["endpoint"], "edge_seq").drop("edge_seq")


def consumers(edges: DataFrame, cap: int = 10) -> DataFrame:
    """Per endpoint: distinct consumers, and the first ones in order."""
    own = edges.where("type = 'consumes'").select("dst", "src").distinct()
    w = Window.partitionBy("dst").orderBy("src")
    top = own.withColumn("r", F.row_number().over(w)).where(F.col("r") <= cap).groupBy(F.col("dst").alias("d")).agg(
        F.array_join(F.sort_array(F.collect_list("src")), "|").alias("consumers")
    )
    count = own.groupBy("dst").agg(F.count("*").alias("n_consumers"))
    return count.join(top, F.col("dst") == F.col("d")).select(F.col("dst").alias("endpoint"), "n_consumers", "consumers")


def data_access(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Access edges whose target is a store."""
    stores = nodes.where(F.col("kind").isin(*S.STORE_KINDS)).select(F.col("id").alias("dst"))
    return (
        edges.where(F.col("type").isin(*S.ACCESS_TYPES)).join(stores, "dst", "left_semi")
        .select(F.col("dst").alias("table_id"), F.col("type").alias("op"), F.col("src").alias("actor"), "file", "line", "confidence")
    )


def service_dependencies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per external service: manifests and importers of its depends-on and imports edges."""
    services = nodes.where("kind = 'external-service'").select("id", "name")
    own = edges.where("type IN ('depends-on', 'imports')").select("dst", F.coalesce("file", F.lit("")).alias("m"), "src")
    per = own.groupBy("dst").agg(F.sort_array(F.collect_set("m")).alias("manifests"), F.sort_array(F.collect_set("src")).alias("importing"))
    return services.join(per, F.col("id") == F.col("dst"), "left").select(
        "id", "name", F.array_join("manifests", "|").alias("manifests"),
        F.array_join(F.slice("importing", 1, 15), "|").alias("importing"),
        F.coalesce(F.size("importing"), F.lit(0)).cast("long").alias("n_importing"),
    )


# Path parts that name no area, and root parts of dotted names.
SCAFFOLD = (
    "backend", "frontend", "services", "apps", "packages", "src",
    "api", "ui", "server", "client", "db", "migrations",
    "test", "tests", "e2e",
)
NOISE = ("src", "main", "java", "resources", "app", "lib", "com", "org", "io", "net", "ts", "js")
ROOTS = ("com", "org", "io", "net")
FOLD_BY_KIND = {
    "configuration-key": "config", "configuration": "config",
    "environment": "config", "external-service": "external",
    "endpoint": "endpoints", "ci-job": "ci",
}


def _dotted_area(value: Column) -> Column:
    """The first two parts of a dotted or slashed name, without one leading root part."""

    def area(segs: Column) -> Column:
        rooted = F.lower(F.get(segs, F.lit(0))).isin(*ROOTS)
        return F.slice(segs, F.when(rooted, 2).otherwise(1), F.greatest(F.size(segs), F.lit(1)))

    segs = let(F.split(F.replace(value, F.lit("/"), F.lit(".")), "[.]"), area)
    return F.nullif(F.array_join(F.slice(F.filter(segs, lambda s: s != ""), 1, 2), "."), F.lit(""))


def _path_area(file: Column) -> Column:
    """The folder of a plain last part, else the first part, after the scaffold parts are stripped."""

    def stripped(parts: Column) -> Column:
        n = F.size(parts)
        # Leading scaffold parts go while one part remains.
        lead = F.aggregate(
            parts, F.lit(0),
            lambda k, p: F.when((k >= 0) & p.isin(*SCAFFOLD), k + 1).when(k >= 0, -k - 1).otherwise(k),
            lambda k: F.when(k < 0, -k - 1).otherwise(k),
        )
        return F.slice(parts, F.least(lead, F.greatest(n - 1, F.lit(0))) + 1, F.greatest(n, F.lit(1)))

    def pick(rest: Column) -> Column:
        last, first = F.element_at(rest, -1), F.get(rest, F.lit(0))
        return F.when(F.size(rest) >= 2, F.when(last.contains("."), first).otherwise(F.element_at(rest, -2))).when(
            F.size(rest) == 1, F.substring_index(first, ".", 1)
        )

    parts = F.filter(F.split(F.coalesce(file, F.lit("")), "/"), lambda p: (p != "") & (p != "."))
    return let(F.filter(let(parts, stripped), lambda p: ~p.isin(*NOISE)), pick)


def group_of() -> Column:
    """Architecture area: dotted id, package, namespace, else the source path, else the kind."""
    tail = F.substring_index(F.substring_index("id", ":", -1), "#", 1)
    by_id = F.when(F.col("id").contains(":"), let(tail, lambda t: F.when(t.contains("."), _dotted_area(F.regexp_replace(t, r"\.[^.]*$", "")))))
    by_kind = (
        F.when(F.col("kind").isin(*S.ENTRY_KINDS), "endpoints").when(F.col("kind").isin(*S.DATA_KINDS), "data")
        .when(F.col("kind") == "external-service", "external").otherwise("misc")
    )
    return F.coalesce(by_id, _dotted_area(F.coalesce("package", F.lit(""))), _path_area(F.col("file")), by_kind)


def view_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends kept: no files, no defines."""
    keep = by_shuffle(nodes.where("kind != 'file'").select(F.col("id").alias("__id"), F.col("kind").alias("src_kind")))
    kept = edges.where("type != 'defines'").join(keep, F.col("src") == F.col("__id")).drop("__id")
    return kept.join(keep.select(F.col("__id").alias("dst")), "dst", "left_semi")


def capped_view_edges(edges: DataFrame, nodes: DataFrame, cap: int = 1200) -> DataFrame:
    """The view's edges: the first 85 % of ``cap`` for HIGH and MEDIUM, the rest for LOW and UNKNOWN,
    by confidence, kind of the source, source, target. One top-k query a confidence, the best first; it is
    known of an edge before its ends are looked up, so once a share is full the rest are not joined."""
    rows = edges.withColumns({
        "c": S.conf_rank(F.coalesce("confidence", F.lit("UNKNOWN"))),
        "low": F.coalesce(F.col("confidence").isin("LOW", "UNKNOWN"), F.lit(False)),
    })
    main = int(cap * 0.85)
    there = {(r["low"], r["c"]) for r in rows.where("type != 'defines'").select("low", "c").distinct().collect()}
    parts = []
    for low, left in ((False, main), (True, cap - main)):
        for c in sorted(c for is_low, c in there if is_low == low):
            own = view_edges(rows.where((F.col("low") == low) & (F.col("c") == c)), nodes).withColumn("k", S.kind_rank(F.col("src_kind")))
            own = cut(own.orderBy("k", "src", "dst", "edge_seq").limit(left).select("src", "dst", "type", "confidence", "file", "line", "edge_seq"))
            parts.append(own)
            left -= own.count()
            if not left:
                break
    return union_all(parts) if parts else edges.select("src", "dst", "type", "confidence", "file", "line", "edge_seq").limit(0)


def group_table(nodes: DataFrame, view: DataFrame, least: int = 4, groups: int = 60) -> DataFrame:
    """(id, area) of the nodes of capped_view_edges; areas below ``least`` nodes, numeric or empty ones fold into
    kind buckets; only the ``groups`` largest areas stay."""
    touched = view.select(F.col("src").alias("id")).unionAll(view.select(F.col("dst").alias("id"))).distinct()
    own = cut(nodes.join(small(cut(touched)), "id", "left_semi").withColumn("area", group_of()).select("id", "kind", "confidence", "area"))
    sizes = own.groupBy(F.col("area").alias("__a")).agg(F.count("*").alias("__n"))
    fold = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FOLD_BY_KIND.items() for x in kv]), F.col("kind")), F.lit("misc"))
    folded = own.join(sizes, F.col("area") == F.col("__a")).withColumn(
        "area", F.when((F.col("__n") < least) | (F.col("area") == "") | F.col("area").rlike("^[0-9]+$"), fold).otherwise(F.col("area"))
    ).select("id", "area", "confidence")
    top = folded.groupBy("area").agg(F.count("*").alias("__c")).orderBy(F.desc("__c"), "area").limit(groups).select("area")
    return folded.join(F.broadcast(top), "area", "left_semi").select("id", "area", "confidence")


def group_counts(table: DataFrame) -> DataFrame:
    each = [F.count_if(F.coalesce("confidence", F.lit("UNKNOWN")) == c).alias(f"n_{c.lower()}") for c in S.CONFIDENCES]
    return table.groupBy("area").agg(F.count("*").alias("n"), *each)


def group_edges(table: DataFrame, view: DataFrame) -> DataFrame:
    """Distinct (area, area, type) between different areas, with the confidence of the first edge."""
    v = view.withColumn("c", S.conf_rank(F.coalesce("confidence", F.lit("UNKNOWN"))))
    a = table.select(F.col("id").alias("src"), F.col("area").alias("area_from"))
    b = table.select(F.col("id").alias("dst"), F.col("area").alias("area_to"))
    pairs = v.join(a, "src").join(b, "dst").where("area_from != area_to")
    return pairs.groupBy("area_from", "area_to", "type").agg(F.min_by("confidence", F.struct("c", "edge_seq")).alias("confidence"))


def ranked(nodes: DataFrame, edges: DataFrame, cap: int) -> DataFrame:
    """By confidence, kind, out-degree (resolved) and name; the first ``cap``."""
    out = resolved_edges(edges, nodes).groupBy(F.col("src").alias("__s")).agg(F.count("*").alias("out"))
    rows = nodes.join(out, F.col("id") == F.col("__s"), "left").withColumn("out", F.coalesce("out", F.lit(0)).cast("long"))
    order = [S.conf_rank(F.coalesce("confidence", F.lit("UNKNOWN"))), S.kind_rank(F.col("kind")), F.desc("out"), "name", "node_seq"]
    return rows.orderBy(*order).limit(cap).select("id", "kind", "confidence", "out", "name", "node_seq")


#: Into how many shares fanout deals the edges of a node.
SHARES = 64


def fanout(edges: DataFrame, cap: int, key: str = "src", rows: int | None = None) -> DataFrame:
    """The first ``cap`` edges of each node, in edge order (limited before the shuffle). ``rows``: the number
    of edges, where it is known; then no task sorts many more than a million at a time. A node's edges
    are shared out at first, so those of a hub meet only after they were limited."""
    first = lambda df, *keys: df.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("edge_seq"))).where(F.col("pos") <= cap)
    if rows is None:
        return first(edges, key)
    shares = edges.withColumn("__share", F.pmod(F.xxhash64("edge_seq"), F.lit(SHARES)))
    shares = first(spread(shares, rows, key, "__share"), key, "__share").drop("pos", "__share")
    return first(spread(shares, rows, key), key)


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of totals."""
    n = nodes.agg(
        F.count("*").alias("total_nodes"), F.count_if(F.col("confidence") == "LOW").alias("low_nodes"),
        F.count_if(F.col("file").isNull() | (F.col("file") == "") | (F.col("confidence") == "UNKNOWN")).alias("no_evidence"),
        F.count_if(F.col("kind").isin(*S.ENTRY_KINDS)).alias("entry_points"),
    )
    e = edges.agg(F.count("*").alias("total_edges"), F.count_if(F.col("confidence") == "LOW").alias("low_edges"))
    d = nodes.groupBy("id").count().where(F.col("count") > 1).agg(F.count("*").alias("dupes"))
    # Three single rows side by side.
    out = [x.withColumn("__k", F.lit(1)) for x in (n, e, d)]
    return out[0].join(out[1], "__k").join(out[2], "__k").drop("__k")


def entry_points(nodes: DataFrame, cap: int = 40) -> DataFrame:
    return nodes.where(F.col("kind").isin(*S.ENTRY_KINDS)).orderBy("node_seq").limit(cap).select("id", "name", "kind", "file", "line")


def mode(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...] | None, mode_kinds: tuple[str, ...],
         seed_kinds: tuple[str, ...] | None = None, seeds: int = 200, each: int = 8, most: int = 400) -> DataFrame:
    """Nodes of a view mode: ranked seeds and their first neighbours, of the mode's kinds, re-ranked."""
    keep = nodes.where(F.col("kind") != "file")
    live = resolved_edges(edges, nodes)
    if types:
        live = live.where(F.col("type").isin(*types))
    own = ranked(keep.where(F.col("kind").isin(*(seed_kinds or mode_kinds))), live, seeds).select("id")
    out = fanout(live, each, "src").join(own, F.col("src") == own["id"], "left_semi").select(F.col("dst").alias("id"))
    back = fanout(live, each, "dst").join(own, F.col("dst") == own["id"], "left_semi").select(F.col("src").alias("id"))
    ids = union_all([own, out, back]).distinct()
    return ranked(keep.where(F.col("kind").isin(*mode_kinds)).join(ids, "id", "left_semi"), live, most)


#: The explorer's modes: edge types (None: any), kinds of the seeds. Fixed values.
MODES = {
    "dependency": (S.DEP_EDGES, (*S.LOGIC_KINDS, *S.ENTRY_KINDS, "external-service", "configuration", "deployment-unit")),
    "call-graph": (S.CALL_EDGES, (*S.LOGIC_KINDS, *S.ENTRY_KINDS)),
    "data-flow": (S.DATA_EDGES, (*S.LOGIC_KINDS, *S.DATA_KINDS, *S.ENTRY_KINDS, "external-service", "database")),
    "api": (None, S.ENTRY_KINDS),
    "database": (None, (*S.DATA_KINDS, "database")),
    "external": (None, ("external-service",)),
}


def view_modes(nodes: DataFrame, edges: DataFrame, modes: dict = MODES, each: int = 8, most: int = 400, most_edges: int = 1200) -> tuple[DataFrame, DataFrame]:
    """((mode, id), (mode, src, dst, type)) of all modes in one traversal; a mode is a bit of a mask.

    A mode's seeds are the first most / 2 nodes of its kinds by rank (of all kinds where it has none). Of
    the first ``each`` edges out of and into a seed those of the mode's types bring both ends in; the
    first ``most`` by rank stay, with the first ``most_edges`` edges among them in edge order. Files
    are in no mode. Up to 62 modes; ranks per mode are bounded before the shuffle."""
    names = list(modes)
    bits = lambda test: reduce(lambda a, b: a.bitwiseOR(b), [F.when(test(m), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, m in enumerate(names)])
    rank = [S.conf_rank(F.coalesce("confidence", F.lit("UNKNOWN"))).alias("c"), S.kind_rank(F.col("kind")).alias("k"), (-F.coalesce("out", F.lit(0))).alias("o"), F.col("name"), F.col("node_seq")]
    live = cut(resolved_edges(edges, nodes).select("src", "dst", "type", "edge_seq"), "zstd")
    out = live.groupBy(F.col("src").alias("__s")).agg(F.count("*").alias("out"))
    keep = nodes.where("kind != 'file'").join(out, F.col("id") == F.col("__s"), "left")
    keep = cut(keep.select("id", F.struct(*rank).alias("rank"), bits(lambda m: F.col("kind").isin(*modes[m][1])).alias("mask")), "zstd")

    def first(rows: DataFrame, by: str, n: int) -> DataFrame:
        """The first n rows of each mode of the mask, with the mask cut down to that mode. One top-n query a
        mode: a task hands on n rows at most, and nothing is sorted or shuffled whole."""
        has_bit = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i).cast("long")) != 0
        return union_all([rows.where(has_bit(i)).orderBy(by).limit(n).drop("mask").withColumn("bit", F.lit(i)) for i in range(len(names))])

    # One row a mode: which modes have seeds of their own; the others take any node.
    has = keep.agg(F.bit_or("mask")).first()[0] or 0
    missing = sum(1 << i for i in range(len(names)) if not has >> i & 1)
    seeds = first(keep.withColumn("mask", F.col("mask").bitwiseOR(F.lit(missing).cast("long"))), "rank", most // 2)
    mask_of = lambda df: df.groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    seeds = cut(mask_of(seeds))
    typed = live.withColumn("types", bits(lambda m: F.lit(modes[m][0] is None) | F.col("type").isin(*(modes[m][0] or ()))))
    near = []
    for end in ("src", "dst"):
        own = typed.join(small(seeds.withColumnRenamed("id", end)), end)
        near.append(fanout(own, each, end).withColumn("mask", F.col("mask").bitwiseAND(F.col("types"))).where("mask != 0").select("src", "dst", "mask"))
    near = cut(union_all(near))
    # Few ids are looked up in all nodes: the ends of the seeds' edges.
    ends = small(cut(near.select(F.explode(F.array("src", "dst")).alias("id")).distinct()))
    inside = small(cut(keep.join(ends, "id", "left_semi").select(F.col("id").alias("__i"))))
    near = near.join(inside, F.col("src") == F.col("__i"), "left_semi").join(inside, F.col("dst") == F.col("__i"), "left_semi")
    found = cut(union_all([seeds, near.select(F.explode(F.array("src", "dst")).alias("id"), "mask")]).groupBy("id").agg(F.bit_or("mask").alias("mask")))
    want = cut(keep.drop("mask").join(small(found), "id"))
    want = cut(first(want, "rank", most).select("id", "bit"))
    masks = small(cut(mask_of(want)))
    a, b = (masks.select(F.col("id").alias(k), F.col("mask").alias(f"{k}_mask")) for k in ("src", "dst"))
    among = typed.join(a, "src").join(b, "dst").withColumn("mask", F.col("types").bitwiseAND(F.col("src_mask")).bitwiseAND(F.col("dst_mask"))).where("mask != 0")
    among = cut(among.select("src", "dst", "type", "edge_seq", "mask"))
    links = first(among.withColumn("by", F.struct("edge_seq", "src", "dst", "type")), "by", most_edges)
    label = F.element_at(F.array(*[F.lit(m) for m in names]), F.col("bit") + 1).alias("mode")
    return want.select(label, "id"), links.select(label, "src", "dst", "type")
