"""Every query of the core: against its SQL in DuckDB, or that it runs."""

import decimal
import math

import pytest

import __spark_entry__ as entry
from vellumine.plans import filters, layout, library, narration, packed, sources, streams, text

CORE = {n: q for m in (packed, text, layout, narration, library, streams, sources, filters) for n, q in m.QUERIES.items()}
SQL = {n: s for m in (packed, text, layout, narration, library, streams, sources, filters) for n, s in m.SQL.items()}


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(name, spark, data, duck):
    df = CORE[name](spark, data)
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    if name in SQL:
        got = duck.execute(SQL[name])
        names = [x[0] for x in got.description]
        assert sorted(names) == cols
        want = sorted(repr(tuple(norm(dict(zip(names, r))[c]) for c in cols)) for r in got.fetchall())
        assert rows == want


def test_entry_runs(spark):
    assert entry.entry(spark).schema.names == ["doc_id", "run", "pos", "author"]
    assert set(CORE) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_same_result_at_any_partitioning(partitions, spark, data):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for name in ("reading_order", "narration_timeline", "line_clusters", "p3_found"):
            rows = sorted(map(repr, CORE[name](spark, data).collect()))
            test_same_result_at_any_partitioning.seen = getattr(test_same_result_at_any_partitioning, "seen", {})
            assert test_same_result_at_any_partitioning.seen.setdefault(name, rows) == rows
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
