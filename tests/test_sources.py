import json

from tidewell.operators import sessions as batch
from tidewell.sources import readers
from tidewell.streaming import sessions as stream

GOOD = "---\nschema: 1\nid: 0123456789\ntype: pitfall\nstatus: active\ntags: [a, b]\nwhen:\n  os: linux\n---\n# Title\nbody\n"


def test_lessons(spark, tmp_path):
    for rel, text in {"general/git/a.md": GOOD, "projects/p/t/b.md": GOOD.replace("schema: 1", "odd: 1"), "general/git/README.md": "x", "general/.x/c.md": GOOD, "general/git/d.md": "no"}.items():
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(text)
    good, bad = readers.lessons(spark, str(tmp_path), "kb")
    row = good.first()
    assert good.count() == 1 and (row.topic, row.qualified_id, row.tags, row.body_line) == ("git", "kb:0123456789", ["a", "b"], 10)
    assert row["when"] == {"os": ["linux"]} and row.body.startswith("# Title")
    assert {r.path for r in bad.collect()} == {"projects/p/t/b.md", "general/git/d.md"}


def test_usage(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"time":"t","id":"a","event":"worked"}\nnot json\n{"time":"t","id":"b","result":"failed"}\n')
    assert {(r.id, r.event) for r in readers.usage(spark, str(tmp_path)).collect()} == {("a", "worked"), ("b", "failed")}


def test_transcript(spark):
    m = lambda role, *blocks: json.dumps({"type": role, "message": {"role": role, "content": list(blocks)}})
    lines = [
        m("user", {"type": "text", "text": "build it"}),
        m("assistant", {"type": "tool_use", "id": "c1", "name": "Bash", "input": {"command": "make"}}),
        "broken",
        m("user", {"type": "tool_result", "tool_use_id": "c1", "is_error": True, "content": "no rule"}),
    ]
    df = spark.createDataFrame([("s", k, x) for k, x in enumerate(lines)], "session string, seq long, line string")
    got = [(r.kind, r.text, r.command, r.ok, r.output) for r in readers.transcript_steps(df).orderBy("step").collect()]
    assert got == [("prompt", "build it", None, None, None), ("command", None, "make", False, "no rule")]


def test_stream_equals_batch(spark, tmp_path):
    kinds = ["failed", "injected", "ok", "ok", "failed", "failed", "ok", "injected"]
    rows = [{"session": s, "seq": k, "kind": kind, "program": p, "id": k, "ts": "2026-01-01T00:00:00"} for s in "ab" for p in "xy" for k, kind in enumerate(kinds)]
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(0, 8, 4):  # sequence numbers rise from file to file
        (folder / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in rows if k <= r["seq"] < k + 4))
    found = stream.fixes(stream.read_records(spark, str(folder), 1))
    q = found.writeStream.format("memory").queryName("fixed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120), "the stream doesn't end"
    finally:
        q.stop()
    got = {tuple(r) for r in spark.table("fixed").collect()}
    want = batch.fixes(spark.read.schema(stream.RECORDS).json(str(folder))).where("fixed").select("session", "program", "seq", "island")
    assert got == {tuple(r) for r in want.collect()} and len(got) == 8
