"""What the pipeline's stages cost the driver: memory of training, and jobs for the components of a few links."""

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tidewell.llm import components, line_dedup, toxicity


def _roots(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("few", [True, False])
def test_components_of_blocks(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(components, "is_few", lambda df: False)
        monkeypatch.setattr(components, "NODES", 16)
    pick = random.Random(3)
    links = [(pick.randrange(-300, 300), pick.randrange(-300, 300)) for _ in range(330)] + [(1000 + k, 1001 + k) for k in range(60)]
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    want = _roots([(a, b) for a, b in links if a != b])
    got = components.connected_components(df, contract=True).collect()
    assert len(got) == len(want) and {r.node: r.root for r in got} == want
    node = lambda c: F.struct(F.floor(F.col(c) / 7).alias("d1"), F.pmod(F.col(c), F.lit(7)).cast("long").alias("d2"))
    rows = components.connected_components(df.select(node("a").alias("a"), node("b").alias("b")), contract=True).collect()
    assert len(rows) == len(want) and {r.node.d1 * 7 + r.node.d2: r.root.d1 * 7 + r.root.d2 for r in rows} == want


def test_few_links_take_no_rounds(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(400)], "a long, b long")
    sc = spark.sparkContext
    sc.setJobGroup("few links", "")
    try:
        assert {r.root for r in components.connected_components(df, contract=True).collect()} == {0}
        assert len(sc.statusTracker().getJobIdsForGroup("few links")) <= 12
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_training_holds_little_beside_the_corpus():
    pick = random.Random(5)
    texts = [" ".join(f"w{pick.randrange(500)}" for _ in range(2000)) for _ in range(400)]
    labels = [k % 3 == 0 for k in range(400)]
    tracemalloc.start()
    try:
        toxicity.train(texts, [int(y) for y in labels], [k % 4 == 0 for k in range(400)], toxicity.Settings(rounds=1, steps=1))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 50e6, peak


def test_line_dedup_runs_no_python(spark, monkeypatch):
    monkeypatch.setattr(components, "_contracted", lambda *_: pytest.fail("Python on executors"))
    df = spark.createDataFrame([(1, "the very same line stands here"), (2, "the very same line stands hera")], "doc_id long, text string")
    assert [r.text for r in line_dedup.line_dedup(df).orderBy("doc_id").collect()] == ["the very same line stands here", ""]
