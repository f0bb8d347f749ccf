import glob
import math
import os

import duckdb
import pytest

from partwise.plans import catalog


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    found = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_retries_judge_every_dead_letter(spark, data):
    judged = {(r["p"], r["off"]) for r in catalog.QUERIES["route_retries_all_partitions"](spark, data).collect()}
    letters = {(r["p"], r["off"]) for r in catalog.QUERIES["dead_letter_headers"](spark, data).collect()}
    assert judged == letters and len({p for p, _ in judged}) == 6


def test_blocks_change_nothing(spark, data):
    """Small blocks give the rows of one."""
    from partwise.operators import health, sequence
    from partwise.sources import streams

    v = streams.stream_view(spark.read.parquet(f"{data}/events.parquet")).persist()
    forms = {
        "rates": lambda span: health.sliding_rates(v, 20, span),
        "percentiles": lambda span: health.sliding_percentiles(v, 20, span),
        "throughput": lambda span: health.sliding_throughput(v, 20, span),
        "errors": lambda span: health.error_signals(v, 3, 10, 20, span),
        "transitions": lambda span: health.transitions(v, 3, 10, 20, span),
        "latency": lambda span: health.latency_signals(v, 200.0, 20, span),
        "depth": lambda span: sequence.depth(v, span),
        "pressure": lambda span: sequence.backpressure(v, 40, 0.8, span),
    }
    for name, form in forms.items():
        one, many = (sorted(map(tuple, form(span).collect()), key=repr) for span in (4096, 24))
        assert one and one == many, name
    with pytest.raises(ValueError):
        health.sliding_rates(v, 60, 50)
