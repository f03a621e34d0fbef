"""The plan of the highest inner products."""

from pyspark.sql import functions as F
from tidewell.llm import topk


def test_pairs_of_blocks_are_not_broadcast(spark):
    # few rows, so the planner takes both sides for small, however large their blocks would be
    vectors = spark.range(300).select(F.col("id").alias("vec_id"), F.array(*[(F.col("id") * (i + 3) % 17).cast("double") / 256 for i in range(4)]).alias("embedding"))
    found = topk.top_k(vectors, vectors.where("vec_id % 10 = 0"), 5, query_block=8, candidate_block=32)
    assert found.count() == 150
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
