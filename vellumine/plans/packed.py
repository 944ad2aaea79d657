"""Queries over packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumine.operators.multivalue import explode_packed
from vellumine.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, run, pos, author) of every author list with two or more authors."""
    meta = table(spark, sf_dir, "meta").select("doc_id", "run", "authors").where("authors is not null")
    rows = explode_packed(meta, "authors", "author", "pos", at_least=2)
    return rows.select("doc_id", "run", "pos", "author").distinct()


QUERIES = {"p3_found": p3_found}
SQL: dict[str, str] = {}
