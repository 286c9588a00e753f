"""The intent layer: what people assert about the code, read from Markdown and bound to nodes.

Documents are lines with the heading above them (sources.files.markdown_sections); every rule is an
expression over such lines. Asserted rows never carry a confidence and never mix with derived ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark import schema as S
from waymark.functions.text import slug
from waymark.operators.build import first_wins, union_all
from waymark.sources.files import markdown_sections

AUTHOR = "intent-import(docs)"
DASH = "[—–:-]"
NODE = ["id", "kind", "name", "title", "body", "file", "line"]


def _id(kind: str, tail: Column) -> Column:
    return F.concat(F.lit(f"intent:{kind}:"), tail)


def _lines(docs: DataFrame) -> DataFrame:
    """Lines with heading, the level-2 heading above, file name and the section's body text."""
    rows = markdown_sections(docs)
    upto = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    is_head = (F.col("line") == F.col("heading_line"))
    rows = rows.withColumns({"is_head": F.coalesce(is_head, F.lit(False)), "base": F.substring_index("path", "/", -1)})
    rows = rows.withColumn("l2", F.lower(F.last(F.when(F.col("is_head") & (F.col("level") == 2), F.col("title")), ignorenulls=True).over(upto)))
    body = (
        rows.where(~F.col("is_head") & (F.trim("text") != "")).groupBy(F.col("path").alias("__p"), F.col("heading_line").alias("__h"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("body"))
    )
    out = rows.join(body, (rows["path"] == body["__p"]) & rows["heading_line"].eqNullSafe(body["__h"]), "left").drop("__p", "__h")
    return out.withColumns({
        "s": F.trim("text"),
        "flow": F.regexp_extract(F.coalesce("title", F.lit("")), rf"(?i)^flow\s+(\d+)\s*{DASH}\s*.+$", 1),
    })


def parse(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of docs (path, text); the first id wins."""
    c = F.col
    rows = _lines(docs)
    head = c("is_head")
    title = F.coalesce("title", F.lit(""))

    def node(df: DataFrame, kind: str, id_: Column, name: Column, text: Column, body: Column) -> DataFrame:
        return df.select(id_.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), text.alias("title"), F.coalesce(body, F.lit("")).alias("body"), c("path").alias("file"), "line")

    empty = F.lit("")
    flow_title = F.regexp_extract(title, rf"(?i)^flow\s+\d+\s*{DASH}\s*(.+)$", 1)
    cap_id = _id("capability", F.concat(F.lit("flow-"), c("flow"), F.lit("-"), slug(flow_title)))
    caps_rows = rows.where(head & (c("level") == 3) & (c("flow") != ""))
    caps = node(caps_rows, "capability", cap_id, F.concat(F.lit("Flow "), c("flow"), F.lit(" — "), flow_title), flow_title, c("body"))

    crit = F.regexp_extract("s", r"^-\s*\[[ xX]\]\s*(.+)$", 1)
    reqs_rows = rows.where(~head & (c("level") == 3) & (c("flow") != "") & (crit != ""))
    k = F.row_number().over(Window.partitionBy("path", "heading_line").orderBy("line")).cast("string")
    reqs_rows = reqs_rows.withColumn("rid", _id("requirement", F.concat(F.lit("flow-"), c("flow"), F.lit("-"), k, F.lit("-"), slug(crit))))
    reqs = node(reqs_rows, "requirement", c("rid"), crit, crit, empty)
    part = reqs_rows.select(c("rid").alias("src"), cap_id.alias("dst"), F.lit("part-of").alias("type"), c("path").alias("file"), "line")

    scope = rows.where(~head & (c("level") == 2) & title.rlike("(?i)^(non-?goals|out of scope)") & c("s").startswith("-"))
    pattern = rf"(?i)^-\s*not building:\s*\*{{0,2}}(.+?)\*{{0,2}}\s*{DASH}\s*(.+)$"
    said = F.regexp_extract("s", pattern, 1)
    plain = F.regexp_extract("s", r"^-\s*(.+)$", 1)
    what = F.trim(F.when(said != "", said).otherwise(plain))
    goals = node(scope.where((said != "") | (F.length(plain) >= 8)), "non-goal", _id("non-goal", slug(what)), what, what, F.regexp_extract("s", pattern, 2))

    cell = F.trim(F.regexp_replace(F.regexp_extract("s", r"^\|\s*([^|]+?)\s*\|", 1), r"^\*+|\*+$", ""))
    table = rows.where(~head & (c("base") == "requirements.md") & (c("level") == 2) & (F.lower(title) == "data") & (cell != "") & (F.lower(cell) != "entity") & ~cell.rlike("^:?-+:?$"))
    concepts = node(table, "concept", _id("concept", slug(cell)), cell, cell, empty)
    entry = F.regexp_extract("text", r"^([A-Za-z]\w+)\s*(\(.*\))?\s*$", 1)
    fence = rows.where(~head & c("in_fence") & (c("base") == "plan.md") & (c("level") == 2) & (F.lower(title) == "data model") & (entry != ""))
    model = node(fence, "concept", _id("concept", slug(entry)), entry, entry, F.regexp_extract("text", r"\((.*)\)", 1))

    num = F.regexp_extract(title, rf"(?i)^slice\s+(\d+)\s*{DASH}\s*.+$", 1)
    slice_title = F.regexp_extract(title, rf"(?i)^slice\s+\d+\s*{DASH}\s*(.+)$", 1)
    plan3 = rows.where((c("base") == "plan.md") & (c("level") == 3)).withColumns({"num": num, "sid": _id("slice", F.concat(F.lit("slice-"), num, F.lit("-"), slug(slice_title)))})
    slices = node(plan3.where(head & (c("num") != "")), "slice", c("sid"), F.concat(F.lit("Slice "), c("num"), F.lit(" — "), slice_title), slice_title, c("body"))
    named = plan3.where(~head & (c("num") != "") & F.lower("text").contains("satisfies")).select(
        c("sid").alias("src"), c("path").alias("file"), "line", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"flow\s+(\d+)"), F.lit(1)))).alias("n")
    )
    of = caps.select(c("id").alias("dst"), F.regexp_extract("id", r":flow-(\d+)-", 1).alias("n"))
    satisfies = named.join(of, "n").select("src", "dst", F.lit("part-of").alias("type"), "file", "line")
    forks = node(plan3.where(head & (c("num") == "") & (c("l2") == "resolved forks") & (F.length(title) >= 4)), "concept", _id("concept", F.concat(F.lit("fork-"), slug(title))), title, title, c("body"))

    date, told = F.regexp_extract(title, r"^(\d{4}-\d{2}-\d{2})\s*[—–-]\s*.+$", 1), F.regexp_extract(title, r"^\d{4}-\d{2}-\d{2}\s*[—–-]\s*(.+)$", 1)
    dec = rows.where((c("base") == "decisions.md") & (c("level") == 3) & (date != ""))
    decisions = node(dec.where(head), "decision", _id("decision", F.concat(date, F.lit("-"), slug(told))), told, told, c("body"))
    tail = F.rtrim(F.trim(F.regexp_replace(F.regexp_replace("text", r"^[^:,;]*[:,;]", ""), r"\*+", "")), F.lit("."))
    items = dec.where(~head & F.lower("text").contains("not built")).withColumn("item", F.explode(F.split(tail, ";"))).withColumn("item", F.trim("item"))
    unbuilt = node(items.where(F.length("item") >= 4), "non-goal", _id("non-goal", slug(c("item"))), c("item"), c("item"), empty)

    nodes = union_all([caps, reqs, goals, concepts, model, slices, forks, decisions, unbuilt]).withColumn("seq", F.struct("file", "line"))
    edges = part.unionByName(satisfies).withColumn("seq", F.struct("file", "line"))
    out = first_wins(nodes, ["id"], "seq").drop("seq").withColumns({
        "provenance": F.lit("asserted"), "confidence": F.lit(None).cast("string"), "status": F.lit("active"), "author": F.lit(AUTHOR), "source": c("file"),
    })
    return out, first_wins(edges, ["src", "dst", "type"], "seq").drop("seq").withColumn("provenance", F.lit("asserted"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Existing asserted nodes take the new text and keep their status; unknown ids are added; all
    others stay. Both tables have the columns of parse()'s nodes."""
    text = ["name", "title", "body", "file", "line", "source"]
    fresh = new.select(F.col("id").alias("__id"), *[F.col(x).alias(f"__{x}") for x in text])
    hit = F.col("__id").isNotNull() & (F.col("provenance") == "asserted")
    kept = old.join(fresh, old["id"] == fresh["__id"], "left")
    kept = kept.withColumns({x: F.when(hit, F.col(f"__{x}")).otherwise(F.col(x)) for x in text}).select(old.columns)
    return kept.unionByName(new.join(old.select("id"), "id", "left_anti").select(old.columns))


def insert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds edges that are not there, where both ends exist; an existing edge keeps its reasons."""
    ids = nodes.select("id").distinct()
    sound = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return old.unionByName(sound.join(old.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti"), allowMissingColumns=True)


def bind(code: DataFrame, targets: DataFrame, why: str, author: str = "human") -> DataFrame:
    """Manual binding edges of each row of code (id) to each of targets (id, type): what it realizes, its
    slice and its decision, so three at most. bindings.bind_asks looks names up and binds many at once."""
    few = targets.select("id", "type").limit(4).collect()
    if len(few) > 3:
        raise ValueError("a binding has three targets at most")
    ends = F.array(*[F.struct(F.lit(r["id"]).alias("dst"), F.lit(r["type"]).alias("type")) for r in few]) if few else F.array().cast("array<struct<dst:string,type:string>>")
    pairs = code.select(F.col("id").alias("src"), F.explode(ends).alias("t")).select("src", "t.dst", "t.type")
    return pairs.select("src", "dst", "type", F.lit("asserted").alias("provenance"), F.lit("manual").alias("binding"), F.lit(why).alias("why"), F.lit(author).alias("author"))


def mark_reviews(edges: DataFrame, nodes: DataFrame, rescanned: DataFrame) -> DataFrame:
    """Manual bindings with review and review_reason: the code node is gone, or its file (path) was
    scanned again."""
    own = nodes.where("provenance != 'asserted'").select(F.col("id").alias("__id"), F.col("file").alias("__file"))
    again = rescanned.select(F.col("path").alias("__path")).distinct()
    rows = edges.join(own, F.col("src") == F.col("__id"), "left").join(again, F.col("__file") == F.col("__path"), "left")
    manual = F.col("binding") == "manual"
    reason = F.when(manual & F.col("__id").isNull(), "code node vanished").when(manual & F.col("__path").isNotNull(), "file changed")
    return rows.withColumns({"review_reason": reason, "review": F.when(reason.isNotNull(), "needs-review")}).drop("__id", "__file", "__path")


def why(nodes: DataFrame, edges: DataFrame, text: str, cap: int = 8) -> DataFrame:
    """Asserted edges that touch a node whose id, name or file contains the text."""
    t = text.lower()
    hit = F.lower("id").contains(t) | F.lower(F.coalesce("name", F.lit(""))).contains(t) | F.lower(F.coalesce("file", F.lit(""))).contains(t)
    hits = nodes.where(hit).orderBy("id").limit(cap).select(F.col("id").alias("node"))
    own = edges.where("provenance = 'asserted'")
    out = own.join(hits, own["src"] == hits["node"]).select("node", "type", F.col("dst").alias("other"), F.lit("out").alias("way"))
    back = own.join(hits, own["dst"] == hits["node"]).select("node", "type", F.col("src").alias("other"), F.lit("in").alias("way"))
    return out.unionByName(back)


def capabilities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per capability: requirements, realizing code (direct and by members) and status: stale where a
    binding needs review, else realized where code is bound, else unbound."""
    caps = nodes.where("kind = 'capability'").select(F.col("id").alias("cap"), "title", "author", "source")
    member = edges.where("type = 'part-of'").select(F.col("dst").alias("cap"), F.col("src").alias("m"))
    scope = caps.select("cap", F.col("cap").alias("m")).unionByName(member.join(caps.select("cap"), "cap", "left_semi"))
    real = edges.where("type = 'realizes'").select(F.col("dst").alias("m"), "src", F.coalesce(F.col("review"), F.lit("")).alias("review"))
    per = scope.join(real, "m").groupBy("cap").agg(F.count_distinct("src").alias("n_code"), F.max((F.col("review") == "needs-review").cast("int")).alias("stale"))
    reqs = member.join(nodes.where("kind = 'requirement'").select(F.col("id").alias("m")), "m", "left_semi").groupBy("cap").agg(F.count("*").alias("n_requirements"))
    out = caps.join(per, "cap", "left").join(reqs, "cap", "left")
    status = F.when(F.col("stale") == 1, "stale").when(F.col("n_code") > 0, "realized").otherwise("unbound")
    return out.select("cap", "title", "author", "source", F.coalesce("n_requirements", F.lit(0)).alias("n_requirements"), F.coalesce("n_code", F.lit(0)).alias("n_code"), status.alias("status"))


def capability_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The explorer's table of capabilities: a row for each capability, its requirements and the code that
    realizes them (nulls where there is none), with the reason. A requirement is stale where one of its
    bindings waits for a review, or it is itself the code of one; else realized if code is bound, else unbound."""
    c = F.col
    own = nodes.where(c("kind").isin(*S.INTENT_KINDS) | c("id").startswith("intent:"))
    label = lambda df, i, n: df.select(c("id").alias(i), F.coalesce("name", "id").alias(n))
    caps = label(own.where("kind = 'capability'"), "cap", "title")
    reqs = label(own.where("kind = 'requirement'"), "requirement", "requirement_title")
    member = edges.where("type = 'part-of'").select(c("src").alias("requirement"), c("dst").alias("cap")).distinct()
    real = edges.where("type = 'realizes'").join(own.select(c("id").alias("dst")).distinct(), "dst", "left_semi")
    waits = real.where("review = 'needs-review'")
    stale = waits.select(c("src").alias("requirement")).union(waits.select(c("dst"))).distinct().withColumn("stale", F.lit(True))
    code = real.groupBy(c("dst").alias("requirement"), c("src").alias("code")).agg(F.min_by("why", "edge_seq").alias("why"))
    at = nodes.select(c("id").alias("code"), c("name").alias("label"), c("kind").alias("code_kind"), "file", "line")
    code = code.join(at, "code", "left").withColumn("label", F.coalesce("label", "code"))
    rows = reqs.join(member, "requirement").join(stale, "requirement", "left").join(code, "requirement", "left")
    status = F.when(c("stale"), "stale").when(c("code").isNotNull(), "realized").when(c("requirement").isNotNull(), "unbound").alias("status")
    return caps.join(rows, "cap", "left").select("cap", "title", "requirement", "requirement_title", status, "code", "label", "code_kind", "file", "line", "why")


def responsible_for(edges: DataFrame, capability: str) -> DataFrame:
    """(code, via): code that realizes a capability itself or one of its parts."""
    parts = edges.where((F.col("type") == "part-of") & (F.col("dst") == capability)).select(F.col("src").alias("m"))
    real = edges.where("type = 'realizes'").select(F.col("src").alias("code"), F.col("dst").alias("via"))
    direct = real.where(F.col("via") == capability)
    return direct.unionByName(real.join(parts, real["via"] == parts["m"], "left_semi")).distinct()


def responsibility(edges: DataFrame, target: str) -> DataFrame:
    """(what, id, via, review) for a capability or requirement: code that realizes it or a part of it,
    the slices that code or the target is delivered in, and tests that cover the code (tests edges
    either way). review tells whether a binding waits for one."""
    parts = edges.where((F.col("type") == "part-of") & (F.col("dst") == target)).select(F.col("src").alias("m"))
    own = parts.unionAll(parts.sparkSession.createDataFrame([(target,)], "m string")).distinct()
    real = edges.where("type = 'realizes'").join(own, F.col("dst") == F.col("m"), "left_semi")
    flag = F.max(F.coalesce(F.col("review") == "needs-review", F.lit(False)))
    code = real.groupBy(F.col("src").alias("id"), F.col("dst").alias("via")).agg(flag.alias("review"))
    among = code.select(F.col("id").alias("c")).distinct()
    asked = among.unionAll(own.select(F.col("m").alias("c"))).distinct()
    slices = edges.where("type = 'delivered-in'").join(asked, F.col("src") == F.col("c"), "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("via"))
    tests = edges.where("type = 'tests'")
    tests = tests.select(F.col("src").alias("id"), F.col("dst").alias("via")).unionAll(tests.select(F.col("dst").alias("id"), F.col("src").alias("via")))
    tests = tests.join(among, F.col("via") == F.col("c"), "left_semi").join(among.withColumnRenamed("c", "id"), "id", "left_anti")
    none = F.lit(False).alias("review")
    return union_all([
        code.select(F.lit("code").alias("what"), "id", "via", "review"), slices.distinct().select(F.lit("slice").alias("what"), "id", "via", none),
        tests.distinct().select(F.lit("test").alias("what"), "id", "via", none),
    ])
