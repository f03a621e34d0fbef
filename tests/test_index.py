"""The kept index against the ranking that scores every record."""

import random

import pytest
from pyspark.sql import functions as F
from tidewell.operators import index, search


def _library(spark, seed, n):
    pick = random.Random(seed)
    words = [f"w{int(pick.paretovariate(0.7)) % 300}" for _ in range(4000)] + ["v1.2.3", "HTTPServer", "foo_bar", "the", "étoile"]
    line = lambda most: " ".join(pick.choice(words) for _ in range(pick.randint(0, most)))
    rows = [(k, f"t{k % 7}", line(pick.choice([3, 30, 300])), None if k % 5 else line(3)) for k in range(n)] + [(n, None, None, None), (n + 1, "", "", "")]
    queries = [(q, line(pick.choice([1, 3, 8]))) for q in range(40)] + [(90, ""), (91, None), (92, "nowhere"), (93, "w1 w1 w2"), (94, "htpserver étolie w7")]
    return spark.createDataFrame(rows, "id long, title string, body string, tags string"), spark.createDataFrame(queries, "query_id long, text string")


def _rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("expand", [False, True])
def test_same_rows_as_the_whole_ranking(spark, tmp_path, monkeypatch, expand):
    monkeypatch.setattr(index, "BLOCK_RECORDS", 50)
    records, queries = _library(spark, 11, 400)
    held = index.build(records, str(tmp_path / "index"))
    for k in (1, 10) if expand else (3,):
        want = _rows(search.rank(records, queries, limit=k, expand=expand))
        assert len(want) > 30 and _rows(index.top_k(held, queries, k, expand=expand)) == want
    if expand:
        return
    monkeypatch.setattr(index, "MOST_NAMED", 3)  # joined instead of named
    assert _rows(index.top_k(held, queries, 3, expand=expand)) == _rows(search.rank(records, queries, limit=3, expand=expand))


def test_reads_own_terms_only_and_skips_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_RECORDS", 20)
    records, _ = _library(spark, 12, 500)
    held = index.build(records, str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "w1 w250 w2")], "query_id int, text string")
    lists, blocks = index.search_plan(held, queries, 3, expand=False)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan
    assert {r.term for r in blocks.select("term").distinct().collect()} <= {"w1", "w250", "w2"}
    lead = lists.where("essential").join(blocks, "term")
    total, looked = lists.join(blocks, "term").count(), lead.where("w * top + others >= mark").count()
    assert 0 < looked < total / 2


def test_kept_until_content_changes(spark):
    records, queries = _library(spark, 13, 60)
    first = index.kept(records)
    before = [r for r in first.table("stats").inputFiles()]
    again = index.kept(records.repartition(5))
    assert again.folder == first.folder and again.table("stats").inputFiles() == before
    changed = records.withColumn("body", F.when(F.col("id") == 3, "w1 w1 w1").otherwise(F.col("body")))
    other = index.kept(changed)
    assert other.folder != first.folder and _rows(index.top_k(other, queries, 5, expand=False)) == _rows(search.rank(changed, queries, limit=5, expand=False))


def test_no_records_and_no_queries(spark, tmp_path):
    records, queries = _library(spark, 14, 5)
    empty = index.build(records.where("false"), str(tmp_path / "a"))
    assert index.top_k(empty, queries, 5).collect() == []
    assert index.top_k(index.build(records, str(tmp_path / "b")), queries.where("false"), 5).collect() == []


def test_terms_are_counted_in_place(spark):
    records = spark.createDataFrame([(1, "w1 w2", "w2 w3 w2"), (2, None, "w1")], "id long, title string, body string")
    counts = index.term_counts(records)
    assert sorted(tuple(r) for r in counts.collect()) == [(1, 5, "w1", 3.0), (1, 5, "w2", 5.0), (1, 5, "w3", 1.0), (2, 1, "w1", 1.0)]
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
