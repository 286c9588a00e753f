"""URL filters, with DataFrame functions only: rules first, gradient-boosted trees for the rest.

A rule `host/path` fits its host and all subdomains if the URL's path starts with the rule's; the
longest wins. URLs that a rule judges are the labelled ones: trees are trained (by Spark's own
GBTClassifier) on at most SAMPLE of them, drawn by a hash of the URL, over lexical features: length,
depth, digit ratio, entropy, parameter counts and statistics of the suffix (share of all URLs and
smoothed block rate, counted over all rows). The fitted trees are turned into one SQL expression, so
scoring stays in generated code.

Cases: a null URL or one without :// has empty host and path, no rule, and features of an empty
text; without labelled URLs all others are allowed; with one class of labels they get that class;
repeated rows are judged alike; extra columns are carried, same-named result columns replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, table

#: The rules of the contract.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
SAMPLE, TREES, DEPTH, STEP, SMOOTH = 10_000, 12, 3, 0.2, 20.0
FEATURES = ("length", "depth", "digit_ratio", "entropy", "n_params", "suffix_share", "suffix_block_rate", "ext_length", "host_labels")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, or null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""

    def of(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        # Runs of the sorted characters: a run ends where the next character differs.
        runs = F.aggregate(
            F.array_sort(chars),
            F.struct(F.lit("").alias("c"), F.lit(0.0).alias("n"), F.lit(0.0).alias("s")),
            lambda a, c: F.when(a["c"] == c, F.struct(c.alias("c"), (a["n"] + 1).alias("n"), a["s"].alias("s"))).otherwise(
                F.struct(c.alias("c"), F.lit(1.0).alias("n"), (a["s"] + F.when(a["n"] > 0, a["n"] * F.log2(a["n"])).otherwise(0.0)).alias("s"))
            ),
            lambda a: a["s"] + F.when(a["n"] > 0, a["n"] * F.log2(a["n"])).otherwise(0.0),
        )
        return F.when(n > 0, F.log2(n) - runs / n).otherwise(0.0)

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.get(F.transform(F.array(chars), of), F.lit(0))


def lexical(pages: DataFrame) -> DataFrame:
    """Adds host, path, suffix and the features that need no statistics."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query_part = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    size = F.length(url)
    pages = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return pages.withColumns(
        {
            "__suffix": F.substring_index("host", ".", -1),
            "__length": size.cast("double"),
            "__depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double"),
            "__digit_ratio": F.when(size > 0, F.regexp_count(url, F.lit("[0-9]")) / size).otherwise(0.0),
            "__entropy": entropy(url),
            "__n_params": F.when(query_part == "", 0).otherwise(F.size(F.split(query_part, "&"))).cast("double"),
            "__ext_length": F.length(F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1)).cast("double"),
            "__host_labels": F.size(F.split("host", "[.]")).cast("double"),
        }
    )


def _tree(node) -> Column:
    """One fitted regression tree as nested CASE expressions."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    test = F.col(f"__{FEATURES[split.featureIndex()]}") <= F.lit(float(split.threshold()))
    return F.when(test, _tree(node.leftChild())).otherwise(_tree(node.rightChild()))


def train(rows: DataFrame, sample: int = SAMPLE) -> Column:
    """An expression over the features: the score, above 0 for block."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    known = rows.where("__rule IS NOT NULL").select(
        "url", *[f"__{c}" for c in FEATURES], (F.col("__rule.verdict") == "block").cast("double").alias("label")
    )
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return F.lit(1.0 if 1.0 in counts else -1.0)
    share = min(1.0, 0.95 * sample / sum(counts.values()))
    draw = F.pmod(F.xxhash64(F.lit("url"), "url"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # One ordered partition of bounded size, so that sums and thus the trees are the same each time.
    drawn = materialise(known.where(draw < share).limit(2 * sample).coalesce(1).sortWithinPartitions("url", "label"))
    vector = VectorAssembler(inputCols=[f"__{c}" for c in FEATURES], outputCol="features").transform(drawn.coalesce(1))
    if drawn.select("label").distinct().count() < 2:
        return F.lit(1.0 if counts.get(1.0, 0) > counts.get(0.0, 0) else -1.0)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7, cacheNodeIds=False).fit(vector)
    trees = [_tree(t._java_obj.rootNode()) * F.lit(float(w)) for t, w in zip(model.trees, model.treeWeights, strict=True)]
    return reduce(lambda a, b: a + b, trees)


def url_filter(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score (of the trees, above 0: block)."""
    rows = lexical(pages).withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    small = lexical(pages.select("url")).withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    stats = materialise(
        small.groupBy("__suffix").agg(
            F.count("*").alias("n"), F.count("__rule").alias("labelled"),
            F.count_if(F.col("__rule.verdict") == "block").alias("blocked"),
        )
    )
    total = stats.agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b")).first()
    base = (total["b"] or 0) / max(total["l"] or 0, 1)
    stats = stats.select(
        F.col("__suffix").alias("__s"),
        (F.col("n") / F.lit(float(max(total["n"] or 0, 1)))).alias("__suffix_share"),
        ((F.col("blocked") + F.lit(SMOOTH * base)) / (F.col("labelled") + F.lit(SMOOTH))).alias("__suffix_block_rate"),
    )
    stats = broadcast_if_small(stats)

    def full(df: DataFrame) -> DataFrame:
        return df.join(stats, F.col("__suffix") == F.col("__s"), "left")

    score = train(full(small), sample)
    hidden = ["__suffix", "__s", "__rule", *[f"__{c}" for c in FEATURES]]
    return (
        full(rows)
        .withColumns({"rule": F.col("__rule.rule"), "score": score})
        .withColumn("verdict", F.coalesce("__rule.verdict", F.when(F.col("score") > 0, "block").otherwise("allow")))
        .drop(*hidden)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
