"""Many needles in many texts: which text contains which needle, for sets of both."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.build import union_all
from waymark.plans.lineage import cut

#: Bytes of needles that one automaton holds; more of them take further passes over the texts.
PASS_BYTES = 4 << 20


def occurrences(texts: DataFrame, needles: DataFrame, id_: str = "id", text: str = "text", most: int = PASS_BYTES) -> DataFrame:
    """(id, needle): each needle (column needle) that a row's text contains, once.

    The needles go into an automaton, so a text is read once whatever their number, and nothing is joined.
    An automaton holds ``most`` bytes of needles at most: with more, the needles are dealt to passes by
    hash, and each pass reads the texts again. Null texts and null or empty needles match nothing."""
    own = cut(needles.select("needle").where("needle != ''").distinct())
    size = own.agg(F.coalesce(F.sum(F.octet_length("needle") + 8), F.lit(0))).first()[0]
    passes = max(1, -(-size * 2 // most)) if size > most else 1
    kind = dict(texts.dtypes)[id_]
    rows = texts.where(F.col(text).isNotNull()).select(F.col(id_).alias("id"), F.col(text).alias("text"))
    parts = []
    for p in range(passes):
        words = [r["needle"] for r in own.where(F.pmod(F.xxhash64("needle"), F.lit(passes)) == p).collect()]
        if words or p == 0:
            parts.append(rows.mapInArrow(_search(words), f"id {kind}, needle string"))
    return union_all(parts)


def _search(words: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for b in batches:
            at, found = [], []
            for i, text in enumerate(b.column(1)):
                own = {w for _, w in automaton.iter(text.as_py())} if words else ()
                at += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(found, pa.string())], names=["id", "needle"])

    return run


def with_needles(rows: DataFrame, needles: DataFrame, id_: str, *columns: str) -> DataFrame:
    """(id, needle) for rows that contain a needle in any of some columns, in lower case: what the query
    and intent layers ask for one word, for a set of words."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    texts = union_all([rows.select(F.col(id_).alias("id"), low(c).alias("text")) for c in columns])
    return occurrences(texts, needles.select(F.lower("needle").alias("needle"))).distinct()


def signals(files: DataFrame, table: DataFrame, name: Column) -> DataFrame:
    """(path, needle, ...): rows of a table of signals (needle and more) found in the texts of the files
    (path, text) that ``name`` picks."""
    found = occurrences(files.where(name).select(F.col("path").alias("id"), F.lower("text").alias("text")), table)
    return found.join(table, "needle").withColumnRenamed("id", "path")
