"""Mixing sources to target weights, with DataFrame functions only.

Token counts per (source, language, topic) cell are raked by iterative proportional fitting until
the weights' marginals meet the targets; a document is then sampled with the calibrated probability
of its cell, by a uniform number hashed from its doc_id (so a rerun gives the same sample).

A target is a temperature (share proportional to tokens ** temperature) or a table {value: weight}.
Cells without tokens or target get weight 0. Cases: null source or language is a value of its own;
a null or empty text has no tokens, topic 'empty' and probability 0; repeated rows count again and
get the same draw; a null doc_id draws as the text 'null'; result columns replace same-named ones.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, materialise

DIMS = ("source", "lang", "topic")
#: Production parameters: temperatures of the targets, sweeps of the fitting, sampled share of all tokens.
TARGETS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
SWEEPS, FRACTION, SEED = 12, 0.5, "mix-1"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A format topic, by counts over the whole text: empty, markup, data or prose."""
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]"))
    digits = F.regexp_count(text, F.lit(r"[0-9]"))
    return (
        F.when(F.coalesce(tokens, F.lit(0)) == 0, "empty")
        .when(symbols * 5 >= tokens, "markup")
        .when(digits * 2 >= tokens, "data")
        .otherwise("prose")
    )


def _targets(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]]) -> DataFrame:
    """Adds a column __t_<dim> with the target share of the cell's value."""
    for d, target in targets.items():
        per_value = Window.partitionBy(d)
        margin = F.sum("__tokens").over(per_value)
        if isinstance(target, Mapping):
            total = float(sum(target.values()))
            known = F.create_map(*[F.lit(x) for k, v in target.items() for x in (k, v / total)])
            share = F.coalesce(F.element_at(known, F.col(d)), F.lit(0.0))
            cells = cells.withColumn(f"__t_{d}", share)
            continue
        cells = cells.withColumn("__m", margin)
        sums = cells.groupBy(d).agg(F.max("__m").alias("__m")).agg(
            F.sum(F.when(F.col("__m") > 0, F.pow(F.col("__m"), F.lit(float(target)))).otherwise(0.0)).alias("__s")
        )
        total = sums.first()["__s"] or 1.0
        share = F.when(F.col("__m") > 0, F.pow(F.col("__m"), F.lit(float(target))) / F.lit(total)).otherwise(0.0)
        cells = cells.withColumn(f"__t_{d}", share).drop("__m")
    return cells


def rake(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]], sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (the dimensions and __tokens) with __w, the fitted share of the mixture per cell.
    All work is on the cell table, with one window per dimension and sweep; lineage is cut every
    fourth sweep."""
    cells = materialise(_targets(cells, targets))
    total = cells.agg(F.sum("__tokens")).first()[0] or 1
    cells = cells.withColumn("__w", F.col("__tokens") / F.lit(float(total)))
    for sweep in range(1, sweeps + 1):
        for d in targets:
            margin = F.sum("__w").over(Window.partitionBy(d))
            cells = cells.withColumn(
                "__w", F.when(margin > 0, F.col("__w") * F.col(f"__t_{d}") / margin).otherwise(0.0)
            )
        if sweep % 4 == 0 or sweep == sweeps:
            cells = materialise(cells)
    return cells


def mix(
    docs: DataFrame,
    targets: Mapping[str, float | Mapping[str, float]] = TARGETS,
    fraction: float = FRACTION,
    sweeps: int = SWEEPS,
    seed: str = SEED,
) -> DataFrame:
    """``docs`` with topic, n_tokens, weight (share of the mixture per token of the document's cell,
    relative to its share of the corpus), prob and sampled. ``fraction`` of all tokens is expected,
    as far as no cell runs out (prob 1)."""
    docs = docs.withColumn("n_tokens", n_tokens(F.col("text")))
    docs = docs.withColumn("topic", topic_of(F.col("text"), F.col("n_tokens")))
    cells = materialise(docs.groupBy(*DIMS).agg(F.sum("n_tokens").alias("__tokens")))
    total = float(cells.agg(F.sum("__tokens")).first()[0] or 1)
    fitted = rake(cells, {d: targets[d] for d in DIMS}, sweeps).select(
        *[F.col(d).alias(f"__{d}") for d in DIMS],
        F.when(F.col("__tokens") > 0, F.col("__w") * F.lit(total) / F.col("__tokens")).otherwise(0.0).alias("__ratio"),
    )
    fitted = broadcast_if_small(fitted)
    same = [docs[d].eqNullSafe(fitted[f"__{d}"]) for d in DIMS]
    drawn = F.conv(
        F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 8),
        16, 10,
    ).cast("double") / F.lit(4294967296.0)
    weight = F.round("__ratio", 6)
    prob = F.least(F.lit(1.0), F.round(F.lit(float(fraction)) * weight, 6))
    return (
        docs.join(fitted, same[0] & same[1] & same[2], "left")
        .withColumn("weight", weight)
        .withColumn("prob", prob)
        .withColumn("sampled", drawn < F.col("prob"))
        .drop(*[f"__{d}" for d in DIMS], "__ratio")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "lang", "topic", "n_tokens", "weight", "prob", "sampled"
    )


def _sql() -> str:
    out = [
        """
WITH d AS (
  SELECT doc_id, source, lang,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS symbols,
         len(regexp_extract_all(coalesce(text, ''), '[0-9]'))::BIGINT AS digits
  FROM documents
), s AS (
  SELECT doc_id, source, lang, n_tokens,
         CASE WHEN n_tokens = 0 THEN 'empty' WHEN symbols * 5 >= n_tokens THEN 'markup'
              WHEN digits * 2 >= n_tokens THEN 'data' ELSE 'prose' END AS topic
  FROM d
), cells AS (
  SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM s GROUP BY ALL
)"""
    ]
    for dim in DIMS:
        out.append(f"""
m_{dim} AS (
  SELECT v, CASE WHEN m > 0 THEN pow(m, {TARGETS[dim]}) ELSE 0 END
            / sum(CASE WHEN m > 0 THEN pow(m, {TARGETS[dim]}) ELSE 0 END) OVER () AS t
  FROM (SELECT {dim} AS v, sum(tokens) AS m FROM cells GROUP BY {dim}))""")
    out.append("""
w0 AS (
  SELECT c.*, a.t AS t_source, b.t AS t_lang, e.t AS t_topic, tokens / sum(tokens) OVER () AS w
  FROM cells c JOIN m_source a ON c.source IS NOT DISTINCT FROM a.v
  JOIN m_lang b ON c.lang IS NOT DISTINCT FROM b.v JOIN m_topic e ON c.topic IS NOT DISTINCT FROM e.v)""")
    k = 0
    for _ in range(SWEEPS):
        for dim in DIMS:
            k += 1
            out.append(f"""
w{k} AS MATERIALIZED (
  SELECT source, lang, topic, tokens, t_source, t_lang, t_topic,
         CASE WHEN m > 0 THEN w * t_{dim} / m ELSE 0 END AS w
  FROM (SELECT *, sum(w) OVER (PARTITION BY {dim}) AS m FROM w{k - 1}))""")
    last = f"""
SELECT doc_id, source, lang, topic, n_tokens, weight, prob,
       ('0x' || substr(md5('{SEED}:' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < prob AS sampled
FROM (SELECT s.*, round(ratio, 6) AS weight, least(1.0, round({FRACTION} * round(ratio, 6), 6)) AS prob
      FROM s JOIN (SELECT source, lang, topic,
                          CASE WHEN tokens > 0 THEN w * sum(tokens) OVER () / tokens ELSE 0 END AS ratio FROM w{k}) f
        ON s.source IS NOT DISTINCT FROM f.source AND s.lang IS NOT DISTINCT FROM f.lang AND s.topic = f.topic)
"""
    return ",".join(out) + last


SQL = _sql()
