"""Line dedup, with DataFrame functions only.

Lines are exploded with their positions, normalised and hashed (128 bits); a hash that occurs in
``min_docs`` documents or more loses all its lines; each text is put together again from the
positions that remain. Only hashes and positions go through the count and the join on the hash;
the text itself is shuffled once, by its row key, without a sort.

Cases: a null or empty text is one empty line and stays; a key shorter than ``min_chars`` code
points is never dropped; documents are told by their doc_id, so repeated rows count once, and each row
without one counts; input columns named like a result column give way to it, and names that start with
two underscores are this operator's own; a text of any length is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, materialise


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(text: Column, min_chars: int) -> Column:
    """One struct of two 64-bit hashes per line, null where the key is too short to be dropped."""

    def one(line: Column) -> Column:
        key = line_key(line)
        return F.when(
            F.length(key) >= min_chars,
            F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b")),
        )

    return F.transform(_lines(text), one)


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rebuilt from the lines that stay, and n_lines (before) and n_dropped."""
    row = [F.col("doc_id"), F.xxhash64(F.col(text)).alias("__t")]
    hashed = materialise(docs.select(*row, _hashes(F.col(text), min_chars).alias("hashes")))

    # Documents of a hash: a line that very many share is counted in two steps, the first by document, too.
    held = hashed.select("doc_id", F.explode(F.array_distinct("hashes")).alias("h")).where("h IS NOT NULL")
    each = held.groupBy("h.a", "h.b", "doc_id").agg(F.count("*").alias("n"))
    n_docs = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(1))
    often = each.groupBy("a", "b").agg(n_docs.alias("n")).where(F.col("n") >= min_docs).select("a", "b")
    often = materialise(often)
    lines = (
        hashed.select("doc_id", "__t", F.posexplode("hashes").alias("pos", "h"))
        .where("h IS NOT NULL")
        .select("doc_id", "__t", "pos", "h.a", "h.b")
    )
    drops = (
        lines.join(often, ["a", "b"], "left_semi")
        .groupBy(F.col("doc_id").alias("__d"), F.col("__t").alias("__u"))
        .agg(F.collect_set("pos").alias("__drop"))
    )
    keyed = docs.withColumn("__t", F.xxhash64(F.col(text)))
    joined = keyed.join(
        drops.hint("shuffle_hash"), keyed["doc_id"].eqNullSafe(drops["__d"]) & (keyed["__t"] == drops["__u"]), "left"
    )
    n_lines = F.size(_lines(F.col(text)))
    drop = F.coalesce("__drop", F.array().cast("array<int>"))

    # One-element arrays bind the lines and the kept positions once, for the inner lambdas.
    def rebuilt(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
        return F.array_join(F.transform(kept, lambda p: F.get(lines, p)), "\n")

    whole = F.coalesce(F.col(text), F.lit(""))
    kept = F.when(F.col("__drop").isNull(), whole).otherwise(
        F.get(F.transform(F.array(_lines(F.col(text))), rebuilt), F.lit(0))
    )
    return joined.withColumns(
        {"n_lines": n_lines.cast("long"), "n_dropped": F.size(drop).cast("long"), "__kept": kept}
    ).withColumn(text, F.col("__kept")).drop("__t", "__d", "__u", "__drop", "__kept")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, l.i AS pos, l.line,
         translate(trim(l.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)),
                                             lambda x, i: {'i': i, 'line': x})) AS l
        FROM documents)
), often AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines,
       count(*) FILTER (WHERE key IN (SELECT key FROM often))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
                       FILTER (WHERE key NOT IN (SELECT key FROM often)), '')) AS kept_sha256
FROM lines GROUP BY doc_id
"""
