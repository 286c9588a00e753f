"""Manual bindings of code to intent, for a table of asks at once, and what intent a piece of code has.

An ask names nodes by id or by a part of a name or id. All names of all asks are searched in one pass
over the nodes by an automaton, so asks and nodes never meet in a join of all pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.build import first_wins, union_all
from waymark.operators.inventory import matches
from waymark.operators.needles import with_needles
from waymark.plans.lineage import cut

ASK = "ask long, slice string, realizes string, decision string, codes array<string>, why string, author string, declares array<string>"
#: Types of asserted edges in the order in which an explanation tells them.
TOLD = ("realizes", "delivered-in", "motivated-by", "denotes", "part-of")


@dataclass
class Bound:
    """edges: all edges after the asks; made: the new ones among them; problems (ask, problem), none of
    whose asks made any edge; notes (ask, text, id): code names that meant the first of several nodes."""

    edges: DataFrame
    made: DataFrame
    problems: DataFrame
    notes: DataFrame


def _found(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(text, exact, n, n_own, first, first_own): the node of that id, and the nodes whose name or id
    holds the text: how many, how many asserted, the first of each by id. first is (id, own)."""
    own = F.coalesce(F.col("provenance") == "asserted", F.lit(False))
    ids = nodes.select("id", own.alias("own"))
    wanted = cut(texts.where("text != ''").distinct())
    exact = wanted.join(ids, wanted["text"] == ids["id"]).groupBy("text").agg(F.max(F.struct("id", "own")).alias("exact"))
    loose = wanted.join(ids.select(F.col("id").alias("text")), "text", "left_anti")
    hits = with_needles(nodes, loose.select(F.col("text").alias("needle")), "id", "name", "id").join(ids, "id")
    hits = hits.groupBy("needle").agg(
        F.count("*").alias("n"), F.count_if(F.col("own")).alias("n_own"), F.min(F.struct("id", "own")).alias("first"), F.min(F.when(F.col("own"), F.col("id"))).alias("first_own")
    )
    out = wanted.join(exact, "text", "left").withColumn("needle", F.lower("text")).join(hits, "needle", "left").drop("needle")
    return out.withColumns({"n": F.coalesce("n", F.lit(0)), "n_own": F.coalesce("n_own", F.lit(0))})


def _node_and_problem() -> tuple[Column, Column]:
    """The node that a name stands for in its role, and what is wrong with it."""
    c, role = F.col, F.col("role")
    exact, is_own = c("exact.id"), c("exact.own")
    by_slice = F.when(c("n") == 1, F.struct(c("first.id").alias("id"), c("first.own").alias("own"))).when(c("n_own") == 1, F.struct(c("first_own").alias("id"), F.lit(True).alias("own")))
    loose = (
        F.when(role == "slice", by_slice).when((role == "realizes") & (c("n_own") == 1), F.struct(c("first_own").alias("id"), F.lit(True).alias("own"))).when(role == "code", c("first"))
    )
    node = F.when(c("exact").isNotNull(), F.struct(exact.alias("id"), is_own.alias("own"))).otherwise(loose)
    say = lambda *x: F.concat(role, F.lit(" '"), F.coalesce("text", F.lit("")), F.lit("' "), *[y if isinstance(y, Column) else F.lit(y) for y in x])
    problem = (
        F.when(node.isNull() & (role == "slice") & (c("n") > 1), say("is ambiguous: ", c("n").cast("string"), " nodes"))
        .when(node.isNull(), say("is unknown"))
        .when((role == "code") & node["own"], say("is an intent node: ", node["id"]))
        .when((role != "code") & ~node["own"], say("is a derived node: ", node["id"]))
    )
    return node["id"], problem


def bind_asks(nodes: DataFrame, edges: DataFrame, asks: DataFrame) -> Bound:
    """Binds code nodes to a slice, to what they realize and to a decision, for each row of ASK.

    A slice is an exact id, else the only hit, else the only asserted hit; what is realized an exact id,
    else the only asserted hit; a decision an exact id; all three must be asserted. Code is an exact id,
    else the first hit by id, and must not be asserted; an entry may hold several names with commas.
    An ask with any problem (also: no code, no reason) makes nothing. Asks act in the order of ask: an
    edge that is there keeps its reason, and the last non-empty declaration of files is kept on the
    edges to slice and realized node. Null names are unknown, a null or empty decision is none."""
    c = F.col
    one = lambda name: asks.select("ask", F.lit(name).alias("role"), F.trim(c(name)).alias("text"), F.lit(0).alias("pos"))
    entries = F.filter(F.transform(F.flatten(F.transform("codes", lambda x: F.split(x, ","))), lambda x: F.trim(x)), lambda x: x != "")
    codes = asks.select("ask", F.lit("code").alias("role"), F.posexplode(entries).alias("pos", "text")).select("ask", "role", "text", "pos")
    named = cut(union_all([one("slice"), one("realizes"), one("decision").where("text != ''"), codes]))
    node, problem = _node_and_problem()
    found = named.join(_found(nodes, named.select("text")), "text", "left")
    found = cut(found.select("ask", "role", "text", "pos", node.alias("id"), problem.alias("problem"), ((c("role") == "code") & c("exact").isNull() & (c("n") > 1)).alias("ambiguous")))
    per = found.groupBy("ask").agg(
        F.count_if(c("problem").isNotNull()).alias("bad"), F.count_if(c("role") == "code").alias("n_codes"),
        *[F.max(F.when(c("role") == r, c("id"))).alias(f"{r}_id") for r in ("slice", "realizes", "decision")],
    )
    rows = asks.select("ask", F.trim(F.coalesce("why", F.lit(""))).alias("why"), F.coalesce("author", F.lit("agent")).alias("author"), "declares").join(per, "ask")
    files = F.filter(F.transform("declares", lambda x: F.trim(x)), lambda x: x != "")
    rows = cut(rows.withColumns({"declares": F.when(F.size(files) > 0, F.to_json(files)), "no_code": (c("n_codes") == 0) & (c("bad") == 0), "no_why": c("why") == ""}))
    problems = union_all([
        found.where("problem IS NOT NULL").select("ask", "problem"), rows.where("no_code").select("ask", F.lit("no code").alias("problem")),
        rows.where("no_why").select("ask", F.lit("no reason").alias("problem")),
    ])
    sound = rows.where("bad = 0 AND NOT no_code AND NOT no_why")
    targets = F.array_compact(F.array(*[F.when(c(i).isNotNull(), F.struct(F.lit(t).alias("type"), c(i).alias("dst"))) for t, i in (("realizes", "realizes_id"), ("delivered-in", "slice_id"), ("motivated-by", "decision_id"))]))
    code = found.where("role = 'code'").select("ask", "pos", c("id").alias("src"), "text", "ambiguous")
    asked = code.join(sound, "ask").withColumn("t", F.explode(targets)).select("ask", "pos", "src", "t.dst", "t.type", "why", "author", F.when(c("t.type") != "motivated-by", c("declares")).alias("declares"))
    place = nodes.select(c("id").alias("__id"), c("file").alias("__file"), c("line").alias("__line"))
    once = asked.groupBy("src", "dst", "type").agg(
        F.min_by(F.struct("why", "author"), F.struct("ask", "pos")).alias("f"), F.max_by("declares", F.when(c("declares").isNotNull(), F.struct("ask", "pos"))).alias("declares")
    )
    once = cut(once.select("src", "dst", "type", "f.why", "f.author", "declares"))
    has = edges.select("src", "dst", "type").distinct()
    # A target's file stands in where the code has none.
    new = once.join(has, ["src", "dst", "type"], "left_anti").join(place, c("src") == c("__id")).drop("__id")
    new = new.join(place.select("__id", c("__file").alias("__other")), c("dst") == c("__id")).drop("__id")
    meta = F.when(c("declares").isNotNull(), F.create_map(F.lit("declares_files"), c("declares")))
    made = new.select(
        "src", "dst", "type", F.coalesce("__file", "__other").alias("file"), c("__line").cast("int").alias("line"), F.lit("asserted").alias("provenance"),
        F.lit("manual").alias("binding"), "why", "author", meta.alias("meta"),
    )
    old = edges if "meta" in edges.columns else edges.withColumn("meta", F.lit(None).cast("map<string,string>"))
    again = once.where("declares IS NOT NULL").select("src", "dst", "type", c("declares").alias("__d"))
    kept = old.join(again, ["src", "dst", "type"], "left")
    empty = F.create_map().cast("map<string,string>")
    other = F.map_filter(F.coalesce("meta", empty), lambda k, _: k != "declares_files")
    kept = kept.withColumn("meta", F.when(c("__d").isNotNull(), F.map_concat(other, F.create_map(F.lit("declares_files"), c("__d")))).otherwise(c("meta"))).select(old.columns)
    notes = code.where("ambiguous").join(sound.select("ask"), "ask").select("ask", "text", c("src").alias("id"))
    return Bound(kept.unionByName(made, allowMissingColumns=True), made, problems, notes)


def explain(nodes: DataFrame, edges: DataFrame, text: str, cap: int = 8) -> DataFrame:
    """(place, type, code, intent, claim, why, review_reason, source, author): why code is there. The node of
    that id, else those whose name or id holds the text, then derived ones whose file does; the first
    ``cap`` in graph order. Their asserted edges come by type as TOLD has it (other types are not told),
    then by the other end. An explanation is as long as a few nodes have edges."""
    c = F.col
    exact = bool(nodes.where(c("id") == text).limit(1).count())
    hit = (c("id") == text) if exact else matches(text)
    by_file = F.coalesce(F.coalesce("file", F.lit("")).contains(text) & (F.coalesce("provenance", F.lit("")) != "asserted"), F.lit(False))
    targets = nodes.where(hit | by_file).orderBy(F.when(hit, 0).otherwise(1), "node_seq", "id").limit(cap).select(c("id").alias("node"))
    targets = F.broadcast(cut(targets))
    none = lambda name, kind="string": c(name) if name in edges.columns else F.lit(None).cast(kind).alias(name)
    own = edges.where(c("provenance") == "asserted").where(c("type").isin(*TOLD)).select("src", "dst", "type", none("why"), none("review_reason"))
    # An edge between two targets is told once, from its source.
    out = own.join(targets, own["src"] == c("node")).select("type", c("src").alias("code"), c("dst").alias("intent"), "why", "review_reason")
    back = own.join(targets, own["dst"] == c("node")).drop("node").join(targets, own["src"] == c("node"), "left_anti")
    rows = out.unionByName(back.select("type", c("dst").alias("code"), c("src").alias("intent"), "why", "review_reason"))
    at = nodes.select(c("id").alias("__id"), *[c(x).alias(f"__{x}") if x in nodes.columns else F.lit(None).cast("string").alias(f"__{x}") for x in ("title", "name", "source", "author")])
    rows = rows.join(first_wins(at, ["__id"], "__id"), rows["intent"] == c("__id"), "left")
    order = F.array_position(F.array(*[F.lit(t) for t in TOLD]), c("type")).cast("int").alias("place")
    told = rows.select(order, "type", "code", "intent", F.coalesce("__title", "__name", "intent").alias("claim"), "why", "review_reason", c("__source").alias("source"), c("__author").alias("author"))
    return told.orderBy("place", "intent", "code")
