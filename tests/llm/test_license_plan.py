"""The plan of the license scan doesn't grow with the lengths of its templates."""

from tidewell.llm import license_scan


def _windows(spark, templates):
    df = spark.createDataFrame([(1, "one two\nthree four")], "doc_id long, text string")
    made = license_scan.rules({w: k for k, w in enumerate(sorted({w for t in templates for w in t.split()}))}, {"x": templates}, 0.8)
    texts = df.selectExpr("doc_id AS k1", "doc_id AS k2", "text")
    ranks = {w: k for k, w in enumerate(sorted({w for r in made for w in r.words}))}
    found = license_scan.text_blocks(texts, made, ranks)
    return found._jdf.queryExecution().optimizedPlan().toString().count("Window ["), found


def test_windows_of_all_spans_share_one_frame(spark):
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    few, _ = _windows(spark, [" ".join(words[:4])])
    many, found = _windows(spark, [" ".join(words[:n]) for n in range(1, 12)])
    assert many == few == 1
    rows = {(r.block, round(r.containment, 3)) for r in found.collect()}
    assert (0, 1.0) in rows and max(b for b, _ in rows) == 0  # broken over lines, it is found where it begins
