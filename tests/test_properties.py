"""Relations that hold whatever the data."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orbweave.operators import catalog as C
from orbweave.operators import metrics
from orbweave.operators import network as N

steps = st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(0, 4))), min_size=1, max_size=25)
few = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, rows):
    return spark.createDataFrame([(t, i, c, float(i)) for i, (t, c) in enumerate(rows)], "trackid long, seq long, coord_idx long, mean_ivt double")


@few
@given(steps)
def test_weights_add_up(spark, rows):
    df = frame(spark, rows)
    total = N.transport_matrix(C.pairs(df)).agg(F.sum("cnt")).first()[0] or 0
    size = {}
    for t, c in rows:
        if c is not None:
            size[t] = size.get(t, 0) + 1
    assert total == sum(n - 1 for n in size.values())


@few
@given(steps)
def test_node_balances(spark, rows):
    df = frame(spark, rows)
    edges = N.build_edges(N.transport_matrix(C.pairs(df)), eps=1)
    nodes = spark.createDataFrame([(i,) for i in range(5)], "coord_id long")
    assert metrics.divergence(nodes, edges).agg(F.sum("divergence")).first()[0] == pytest.approx(0)
    p = N.normalize_outgoing(edges).groupBy("orig").agg(F.sum("probability").alias("p")).collect()
    assert all(r.p == pytest.approx(1) for r in p)
    assert metrics.pagerank(nodes, edges, steps=10).agg(F.sum("pagerank")).first()[0] == pytest.approx(1)


@few
@given(steps)
def test_dedup_twice_is_once(spark, rows):
    df = frame(spark, rows).where("coord_idx IS NOT NULL")
    once = C.run_dedup(df)
    assert sorted(map(tuple, C.run_dedup(once).collect())) == sorted(map(tuple, once.collect()))
    region = spark.createDataFrame([(2,)], "cell long")
    assert {tuple(r) for r in C.to_entry_region(df, region, False).collect()} <= {tuple(r) for r in C.to_entry_region(df, region, True).collect()}
