"""Plans of queries on pairs of records."""

from tidewell.operators import graph
from tidewell.plans import library


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_bodies_and_pairs_are_not_broadcast(spark):
    plan = _plan(library.shown_duplicates(spark, "/root/testdata/sf0.01"))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_shown_pairs_are_not_broadcast_but_judged(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "a")], "a string, b string")
    judged = spark.createDataFrame([("a:b", "h1", 0.9), ("b:c", "old", 0.9), ("a:d", "h3", 0.1)], "key string, hash string, different double")
    hashes = spark.createDataFrame([("a:b", "h1"), ("b:c", "h2"), ("a:d", "h3")], "key string, hash string")
    shown = graph.shown_pairs(pairs, judged, hashes, 0.6)
    assert sorted((r.a, r.b) for r in shown.collect()) == [("b", "c"), ("d", "a")] and "Broadcast" not in _plan(shown)
