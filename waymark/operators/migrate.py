"""Schema migration of stored graphs and export of views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import md_cell

# Names of the first schema version and their successors.
KIND_V1 = {
    "record": "class", "entity": "class", "repository": "class", "configuration": "configuration",
    "configuration-key": "configuration-key", "environment-variable": "environment", "frontend-component": "component",
    "frontend-service": "service", "frontend-route": "route", "frontend-guard": "guard",
    "frontend-interceptor": "interceptor", "ts-class": "class", "test-case": "test-case", "database-table": "table",
    "database-view": "view", "database-procedure": "procedure", "database-sequence": "sequence",
    "external-service": "external-service", "authentication": "configuration", "deployment": "deployment-unit",
    "ci-job": "ci-job", "migration": "migration", "file": "file",
}
TYPE_V1 = {"stereotyped-as": "references", "instantiates": "references", "creates": "creates", "modifies": "modifies", "seeds": "seeds"}


def migrate(nodes: DataFrame, edges: DataFrame, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """Old kind and type names of a graph of the first version to the present ones; rows without
    provenance are derived. Asserted rows stay. Running it again changes nothing. From version 2 on
    names stay, as entity and repository are kinds there."""
    look = lambda names, c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col(c)), F.col(c)) if version < 2 else F.col(c)
    origin = F.coalesce("provenance", F.lit("derived"))
    return nodes.withColumns({"kind": look(KIND_V1, "kind"), "provenance": origin}), edges.withColumns({"type": look(TYPE_V1, "type"), "provenance": origin})


def markdown_rows(df: DataFrame, columns: list[str], order: list[str], cap: int = 60) -> DataFrame:
    """(place, row): a Markdown table's rows, the first ``cap`` in order and a row that tells how many
    more there are."""
    n = df.count()
    row = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    top = df.orderBy(*order).limit(cap).select(*columns).withColumn("place", F.monotonically_increasing_id() + 2)
    spark = df.sparkSession
    head = spark.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + " --- |" * len(columns))], "place long, row string")
    out = head.unionByName(top.select("place", row([md_cell(F.col(c).cast("string")) for c in columns]).alias("row")))
    if n > cap:
        out = out.unionByName(spark.createDataFrame([(1 << 60, f"| …and {n - cap} more |" + "  |" * (len(columns) - 1))], "place long, row string"))
    return out
