"""Extraction as a table function, for use in SQL:

    register(spark)
    SELECT f.path, e.* FROM files f, LATERAL extract_rows(f.path, f.content) e

A language is added with its extractor; it needs no module of the library."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from waymark.plans.ship import ship
from waymark.sources.extract import EMISSIONS, Added, extract_text

#: The columns of a row of emissions but the path, which the caller has.
RETURNS = EMISSIONS.split(", ", 1)[1]


def register(spark: SparkSession, name: str = "extract_rows", added: tuple[Added, ...] = ()) -> None:
    """Registers ``name``(path, content binary). Rows come in the order of place; an extractor that fails
    gives a row 'error' after what the others found. A null path gives no rows, null content is empty."""
    columns = [c.split()[0] for c in RETURNS.split(", ")]
    ship(spark)

    class ExtractRows:
        def eval(self, path: str, content: bytes) -> Iterator[tuple]:
            if path is None:
                return
            rows, errors = extract_text(path, bytes(content or b"").decode("utf-8", "replace"), added)
            rows = rows + [{"row": "error", "error": e} for e in errors]
            for i, r in enumerate(rows):
                r = r | {"place": i, "meta": dict(r["meta"]) if r.get("meta") is not None else None}
                yield tuple(r.get(c) for c in columns)

    spark.udtf.register(name, udtf(ExtractRows, returnType=RETURNS))
