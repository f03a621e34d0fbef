"""Records are worked on by all cores, and their bodies are taken apart once."""

import duckdb

from tidewell.plans import library


def _part(spark, tmp_path):
    path = str(tmp_path / "part.parquet")
    duckdb.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.001/part.parquet') TO '{path}' (FORMAT parquet)")
    return str(tmp_path)


def test_records_are_dealt_to_all_cores(spark, tmp_path):
    assert library.records(spark, _part(spark, tmp_path)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_bodies_are_taken_apart_once(spark, tmp_path):
    sf = _part(spark, tmp_path)
    for made in (library.self_queries(spark, sf).where("text IS NOT NULL"), library.record_links(spark, sf)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") <= 2, plan[:2000]  # units of a body, links of a line
