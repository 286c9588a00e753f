"""Source files made from the driver's tables, one a row, so that extraction, detection and incremental runs
work over whole tables, and the queries that do so with their SQL.

A customer is a Java service that calls the one with the next key, in a package by market segment. In the
earlier tree customers with a negative balance are missing and those of nation 7 have another method, so
a sync adds targets that others ask for, takes none away twice, and changes files in place. A part is a
manifest or a script of a brand's folder; which, and what it says, depends on its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import detect, needles
from waymark.plans.lineage import cut, dealt
from waymark.queries import read, register
from waymark.sources.extract import build
from waymark.streaming import incremental


def _file(df: DataFrame, path: Column, text: Column) -> DataFrame:
    """Dealt to all tasks before the texts are made: the keys of very many files fit into one split."""
    rows = dealt(df, path).select(path.alias("path"), F.encode(text, "UTF-8").alias("content"))
    return rows.withColumn("sha256", F.sha2("content", 256))


def customers(spark: SparkSession, sf_dir: str, method: Column | None = None) -> DataFrame:
    """(path, content, sha256): a Java service for each customer."""
    key = F.col("c_custkey")
    package = F.lower("c_mktsegment")
    method = F.lit("load") if method is None else method
    text = F.concat(
        F.lit("package shop."), package, F.lit(";\n\n@Service\npublic class Customer"), key, F.lit(" {\n  private final Customer"), key + 1,
        F.lit(" next;\n  public String "), method, F.lit("() { return next.load(); }\n}\n"),
    )
    return _file(read(spark, sf_dir, "customer"), F.concat(F.lit("src/main/java/shop/"), package, F.lit("/Customer"), key, F.lit(".java")), text)


def earlier_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree before: no customers with a negative balance, another method in nation 7, and a file for
    each customer of nation 3 that is gone now."""
    from waymark.operators.build import union_all

    c = read(spark, sf_dir, "customer")
    method = F.when(F.col("c_nationkey") == 7, F.lit("fetch")).otherwise(F.lit("load"))
    here = customers(spark, sf_dir, method).join(_paths(c.where("c_acctbal >= 0")), "path", "left_semi")
    old = c.where("c_nationkey = 3")
    gone = _file(old, F.concat(F.lit("src/main/java/old/Customer"), "c_custkey", F.lit(".java")), F.concat(F.lit("package old;\n\npublic class Customer"), "c_custkey", F.lit(" {\n}\n")))
    return union_all([here, gone])


def _paths(c: DataFrame) -> DataFrame:
    return c.select(F.concat(F.lit("src/main/java/shop/"), F.lower("c_mktsegment"), F.lit("/Customer"), "c_custkey", F.lit(".java")).alias("path"))


_scans: dict[tuple[str, str], incremental.Graph] = {}


def synced(spark: SparkSession, sf_dir: str) -> incremental.Graph:
    """The graph of the earlier tree, brought up to date; made once per application and input."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _scans:
        none = incremental.empty(spark)
        graph = incremental.Graph(**{t: cut(df) for t, df in incremental.advance(none, cut(earlier_customers(spark, sf_dir))).applied(none).tables().items()})
        change = incremental.advance(graph, cut(customers(spark, sf_dir)))
        _scans[key] = incremental.Graph(**{t: cut(df) for t, df in change.applied(graph).tables().items()})
    return _scans[key]


#: What a new scan of the present tree gives.
_SCAN_SQL = """
c AS (SELECT c_custkey AS k, lower(c_mktsegment) AS p, 'src/main/java/shop/' || lower(c_mktsegment) || '/Customer' || c_custkey || '.java' AS path,
             'java:class:shop.' || lower(c_mktsegment) || '.Customer' || c_custkey AS cls, 'java:method:shop.' || lower(c_mktsegment) || '.Customer' || c_custkey || '#load' AS m FROM customer),
t AS (SELECT c.*, n.cls AS next_cls, n.m AS next_m FROM c LEFT JOIN c n ON n.k = c.k + 1)"""


@register(f"""WITH {_SCAN_SQL}
SELECT 'file:' || path AS id, 'file' AS kind, 'HIGH' AS confidence, path AS file FROM t
UNION ALL SELECT cls, 'service', 'HIGH', path FROM t UNION ALL SELECT m, 'method', 'HIGH', path FROM t
UNION ALL SELECT 'stereotype:spring:Service', 'stereotype', 'HIGH', arg_min(path, path) FROM t""")
def synced_tree_nodes(spark, d):
    """Nodes after an incremental run over files of the whole customer table: those of a new scan."""
    return synced(spark, d).nodes.select("id", "kind", "confidence", "file")


@register(f"""WITH {_SCAN_SQL}
SELECT 'file:' || path AS src, cls AS dst, 'defines' AS type, 'HIGH' AS confidence, NULL AS resolved FROM t
UNION ALL SELECT 'file:' || path, m, 'defines', 'HIGH', NULL FROM t UNION ALL SELECT cls, m, 'defines', 'HIGH', NULL FROM t
UNION ALL SELECT cls, 'stereotype:spring:Service', 'references', 'HIGH', NULL FROM t
UNION ALL SELECT cls, coalesce(next_cls, 'unresolved:class:Customer' || k + 1), 'injects', CASE WHEN next_cls IS NULL THEN 'LOW' ELSE 'MEDIUM' END, CASE WHEN next_cls IS NOT NULL THEN 'name-match' END FROM t
UNION ALL SELECT m, coalesce(next_m, 'unresolved:method:Customer' || k + 1 || '#load'), 'calls', CASE WHEN next_m IS NULL THEN 'LOW' ELSE 'MEDIUM' END, CASE WHEN next_m IS NOT NULL THEN 'name-match' END FROM t""")
def synced_tree_edges(spark, d):
    """References after it: targets that came are found by files that did not change, those of changed
    files are renewed."""
    return synced(spark, d).edges.select("src", "dst", "type", "confidence", "resolved")


# --- Detection and extraction


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, sha256): a file for each part, of seven sorts by key."""
    key, c = F.col("p_partkey"), F.col
    folder = F.concat(F.translate(F.lower("p_brand"), " #", "--"), F.lit("/p"), key, F.lit("/"))
    sort = F.pmod(key, F.lit(7))
    pick = lambda *xs: F.element_at(F.array(*xs), (sort + 1).cast("int"))
    name = pick(*[F.lit(x) for x in ("requirements.txt", "package.json", "schema.sql", "go.mod", "app.py", "notes.rb", "pom.xml")])
    text = pick(
        F.concat(F.lit("fastapi==1\nlib"), key, F.lit(">=2\n")), F.concat(F.lit('{"dependencies": {"vue": "^3", "lib'), key, F.lit('": "1"}}')),
        F.concat(F.lit("CREATE TABLE part_"), key, F.lit(" (id INT, size INT);\n")), F.concat(F.lit("module example.com/part"), key, F.lit("\n\ngo 1.21\n")),
        F.concat(F.lit("class Part"), key, F.lit(":\n    def size(self):\n        return "), c("p_size"), F.lit("\n")),
        F.concat(F.lit("class Note"), key, F.lit("\nend\n")), F.lit("<project><dependency><groupId>org.flywaydb</groupId><artifactId>flyway-core</artifactId></dependency></project>"),
    )
    return _file(read(spark, sf_dir, "part"), F.concat(folder, name), text)


_PARTS_SQL = """
s AS (SELECT p_partkey AS k, p_size, translate(lower(p_brand), ' #', '--') || '/p' || p_partkey || '/' AS d, p_partkey % 7 AS sort FROM part),
f AS (SELECT *, d || ['requirements.txt', 'package.json', 'schema.sql', 'go.mod', 'app.py', 'notes.rb', 'pom.xml'][sort + 1] AS path FROM s)"""


@register(f"""WITH {_PARTS_SQL}, hits(sort, section, name, confidence) AS (VALUES
 (0, 'infrastructure', 'pip', 'HIGH'), (0, 'languages', 'python', 'HIGH'), (0, 'frameworks', 'fastapi', 'HIGH'),
 (1, 'infrastructure', 'npm', 'MEDIUM'), (1, 'languages', 'javascript', 'MEDIUM'), (1, 'frameworks', 'vue', 'MEDIUM'),
 (2, 'languages', 'sql', 'c'), (3, 'infrastructure', 'go-modules', 'HIGH'), (3, 'languages', 'go', 'HIGH'),
 (5, 'languages', 'ruby', 'c'), (5, 'unsupported', 'ruby', 'LOW'), (6, 'infrastructure', 'maven', 'HIGH'), (6, 'languages', 'java', 'HIGH'), (6, 'frameworks', 'flyway', 'HIGH'))
SELECT section, name, CASE WHEN any_value(confidence) = 'c' THEN CASE WHEN count(*) < 3 THEN 'LOW' ELSE 'MEDIUM' END ELSE any_value(confidence) END AS confidence
FROM hits JOIN f USING (sort) GROUP BY section, name""")
def detected_part_stack(spark, d):
    """The stack of the files of the whole part table."""
    return detect.detect(spark, parts(spark, d).select("path", F.decode("content", "UTF-8").alias("text")))


@register(f"""WITH {_PARTS_SQL}
SELECT 'file:' || path AS id, 'file' AS kind FROM f UNION ALL SELECT 'table:part_' || k, 'table' FROM f WHERE sort = 2
UNION ALL SELECT 'config:' || path, 'configuration' FROM f WHERE sort IN (0, 1, 3, 6)
UNION ALL SELECT 'py:class:Part' || k, 'class' FROM f WHERE sort = 4 UNION ALL SELECT 'py:class:Part' || k || '#size', 'method' FROM f WHERE sort = 4
UNION ALL SELECT 'fallback:' || path || '::Note' || k, 'class' FROM f WHERE sort = 5
UNION ALL SELECT DISTINCT 'migration:schema.sql', 'migration' FROM f WHERE sort = 2""")
def extracted_part_nodes(spark, d):
    """Nodes that the extractors find in the files of the whole part table."""
    return build(cut(parts(spark, d)))[0].select("id", "kind")


# --- Many needles


@register("""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS needle FROM benchmark)
SELECT needle, count(*) AS n_docs FROM documents, n WHERE contains(lower(text), needle) GROUP BY needle""")
def needle_counts(spark, d):
    """Of each longer word of the benchmark the documents that contain it, in words or across them."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"), F.lit(1)))
    own = read(spark, d, "benchmark").select(words.alias("needle"))
    found = needles.occurrences(read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text")), own)
    return found.groupBy("needle").agg(F.count("*").alias("n_docs"))
