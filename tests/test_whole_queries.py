"""Registered queries on small tables that hold what a restricted query would miss."""

from brute import swap_distance
from tidewell.plans import library, queries


def _write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_held_back_follows_every_order(spark, tmp_path):
    # 10 customers, so order k links to customer k % 10 + 1; the chain 2 -> 3 -> 4 -> 1 needs keys 12, 13 and 20
    _write(spark, tmp_path, "customer", [(k, -900.0 if k == 1 else 0.0) for k in range(1, 11)], "c_custkey long, c_acctbal double")
    _write(spark, tmp_path, "orders", [(12, 2), (13, 3), (20, 4), (27, 5)], "o_orderkey long, o_custkey long")
    assert sorted(r.id for r in queries.held_back(spark, str(tmp_path)).collect()) == [1, 2, 3, 4]


def test_typo_expansion_has_every_alphabet(spark, tmp_path):
    _write(spark, tmp_path, "benchmark", [(1, "größe straßen2 naïveté łódź9 plainword")], "item_id long, text string")
    words = ["größe", "straßen2", "naïveté", "łódź9", "plainword", "größer", "plainwort", "naïvetés"]
    _write(spark, tmp_path, "documents", [(k, w) for k, w in enumerate(words)], "doc_id long, text string")
    want = []
    for t in ["größe", "straßen2", "naïveté", "łódź9", "plainword"]:
        term = t[0] + t[2] + t[1] + t[3:]
        near = sorted((swap_distance(term, w), w) for w in words if swap_distance(term, w) <= (1 if len(term) <= 7 else 2))
        want += [(term, w, d, k) for k, (d, w) in enumerate(near[:3], 1)]
    assert sorted((r.term, r.close, r.d, r.place) for r in queries.typo_expansion(spark, str(tmp_path)).collect()) == sorted(want)


def test_similar_to_new_reads_whole_vectors(spark, tmp_path):
    # 1 and 2 agree in their first four entries and differ after them; 1 and 3 agree only after them
    rows = [(1, [0.5] * 4 + [0.5] * 4, 1), (2, [0.5] * 4 + [-0.5] * 4, 0), (3, [0.5, -0.5, 0.5, -0.5] + [0.5] * 4, 0)]
    _write(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>, label int")
    assert {(r.a, r.b): r.similarity for r in library.similar_to_new(spark, str(tmp_path)).collect()} == {(1, 3): 1.0}
