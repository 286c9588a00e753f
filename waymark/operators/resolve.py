"""Resolution of symbolic references: candidates are aggregated per name, then joined once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import simple_class
from waymark.operators.build import union_all

CLASS_KINDS = ("class", "interface", "controller", "service", "handler", "configuration")
METHOD_KINDS = ("method", "function")
#: Kinds that reach the component index: the class kinds come before it, so services and handlers never do.
COMPONENT_KINDS = ("component", "guard", "interceptor")
COMPONENT_PREFIXES = ("ts:", "py:", "go:", "rs:", "cs:")


def _index(rows: DataFrame, dedupe: bool) -> DataFrame:
    """(key, n, first): candidates of a name, and the first in graph order."""
    if dedupe:
        rows = rows.groupBy("key", "id").agg(F.min("seq").alias("seq"))
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.min_by("id", "seq").alias("first"))


def _names(nodes: DataFrame, component_prefixes: tuple[str, ...], seq: str) -> dict[str, DataFrame]:
    """(key, id, seq) of the names that nodes can be asked for by, for each index."""
    c = F.col
    cls = nodes.where(c("kind").isin(*CLASS_KINDS) & c("id").contains(":"))
    by_class = cls.select(F.explode(F.array(simple_class(c("id")), c("name"))).alias("key"), "id", c(seq).alias("seq"))
    meth = nodes.where(c("kind").isin(*METHOD_KINDS) & c("id").contains("#"))
    name = F.substring_index("id", "#", -1)
    head = F.regexp_replace("id", "#[^#]*$", "")
    keys = F.array(
        F.concat(simple_class(head), F.lit("#"), name), F.concat(F.substring_index("name", ".", -1), F.lit("#"), name)
    )
    by_method = meth.select(F.explode(keys).alias("key"), "id", c(seq).alias("seq"))
    own = F.lit(not component_prefixes)
    for p in component_prefixes:
        own = own | c("id").startswith(p)
    comp = nodes.where(c("kind").isin(*COMPONENT_KINDS) & own).select(c("name").alias("key"), "id", c(seq).alias("seq"))
    ep = nodes.where((c("kind") == "endpoint") & c("id").startswith("endpoint:"))
    verb = F.regexp_extract("id", r"(?s)^endpoint:([^ ]*) ", 1)
    path = F.regexp_extract("id", r"(?s)^endpoint:[^ ]* (.+)$", 1)
    by_path = ep.where((verb != "*") & (path != "")).select(path.alias("key"), "id", c(seq).alias("seq"))
    return {"class": by_class, "method": by_method, "component": comp, "path": by_path}


#: Whether a node counts once for a name that it has twice.
_DEDUPED = {"class": True, "method": False, "component": False, "path": True}


def indexes(nodes: DataFrame, component_prefixes: tuple[str, ...] = COMPONENT_PREFIXES) -> dict[str, DataFrame]:
    return {i: _index(rows, _DEDUPED[i]) for i, rows in _names(nodes, component_prefixes, "node_seq").items()}


def names(nodes: DataFrame, seq: str = "node_seq", component_prefixes: tuple[str, ...] = COMPONENT_PREFIXES) -> DataFrame:
    """(i, key, id, seq): all names of nodes, by index."""
    parts = [rows.select(F.lit(i).alias("i"), "key", "id", "seq") for i, rows in _names(nodes, component_prefixes, seq).items()]
    return union_all(parts)


def indexes_of(rows: DataFrame) -> dict[str, DataFrame]:
    """The indexes of rows of names(), all of each name that is asked for."""
    return {i: _index(rows.where(F.col("i") == i).select("key", "id", "seq"), dedupe) for i, dedupe in _DEDUPED.items()}


def _reference(dst: Column) -> tuple[Column, Column, Column]:
    """(form, index, key) of a symbolic name; null where it is none."""
    key = (
        F.when(dst.startswith("unresolved:handler:"), F.substring_index(F.substring(dst, 20, 1 << 30), ".", -1))
        .when(dst.rlike("^unresolved:(method|class|component|guard):"), F.regexp_extract(dst, r"(?s)^unresolved:[a-z]+:(.*)$", 1))
        .when(dst.startswith("endpoint:* "), F.substring(dst, 12, 1 << 30))
    )
    form = F.regexp_extract(dst, r"^unresolved:(method|class|component|guard|handler):", 1)
    form = F.when(form != "", form).when(dst.startswith("endpoint:* "), "path")
    return form, F.when(form.isin("guard", "handler", "component"), "component").otherwise(form), key


def asked(dst: Column) -> Column:
    """The names (i, key) that a reference is looked up by: its own, and a method's class."""
    form, index, key = _reference(dst)
    own = F.when(form.isNotNull(), F.struct(index.alias("i"), key.alias("key")))
    owner = F.when(form == "method", F.struct(F.lit("class").alias("i"), F.substring_index(key, "#", 1).alias("key")))
    return F.array_compact(F.array(own, owner))


def resolve(edges: DataFrame, nodes: DataFrame, component_prefixes: tuple[str, ...] = COMPONENT_PREFIXES,
            ix: dict[str, DataFrame] | None = None) -> DataFrame:
    """Edges with dst, confidence and resolved rewritten, and kept_unresolved (the old dst of a
    reference that stays). ``ix`` are indexes that have all that these edges ask for."""
    ix = ix or indexes(nodes, component_prefixes)
    c = F.col
    dst = c("dst")
    form, index, key = _reference(dst)
    rows = edges.withColumns({"__form": form, "__key": key, "__index": index})
    cands = None
    for name, df in ix.items():
        part = df.select(F.lit(name).alias("__i"), c("key").alias("__k"), c("n").alias("__n"), c("first").alias("__first"))
        cands = part if cands is None else cands.unionByName(part)
    rows = rows.join(cands, (c("__index") == c("__i")) & (c("__key") == c("__k")), "left")
    owner = ix["class"].select(c("key").alias("__c"), c("first").alias("__class"))
    rows = rows.join(owner, F.when(c("__form") == "method", F.substring_index("__key", "#", 1)) == c("__c"), "left")

    unique = c("__n") == 1
    member = (c("__form") == "method") & ~F.coalesce(unique, F.lit(False)) & c("__class").isNotNull()
    hit = F.coalesce(unique, F.lit(False)) & c("__form").isNotNull()
    symbolic = c("__form").isNotNull() & (c("__form") != "path")
    new_dst = F.when(hit, c("__first")).when(member, c("__class")).otherwise(dst)
    conf = (
        F.when(hit & (c("__form") == "component"), "HIGH").when(hit & (c("__form") == "path"), "LOW")
        .when(hit | member, "MEDIUM").when(symbolic, "LOW").otherwise(c("confidence"))
    )
    how = (
        F.when(hit & (c("__form") == "component"), F.lit(None).cast("string"))
        .when(hit & (c("__form") == "path"), "any-method-match").when(hit, "name-match").when(member, "class-member")
    )
    kept = F.when(symbolic & ~hit & ~member, dst)
    rows = rows.withColumns({"__dst": new_dst, "__conf": conf, "__how": how, "kept_unresolved": kept})
    out = [x for x in edges.columns if x not in ("dst", "confidence", "resolved")]
    return rows.select(*out, c("__dst").alias("dst"), c("__conf").alias("confidence"), c("__how").alias("resolved"), "kept_unresolved")


def unresolved(resolved_rows: DataFrame) -> DataFrame:
    """Distinct references that stay."""
    return resolved_rows.where("kept_unresolved IS NOT NULL").select(F.col("kept_unresolved").alias("ref")).distinct()
