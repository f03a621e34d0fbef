"""The gates as streams against the batch operators on the same rows, in several splits of files."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tidewell.operators import hooks
from tidewell.streaming import gates


def _events(seed, n):
    pick = random.Random(seed)
    kinds = ["failed"] * 6 + ["ok"] * 5 + ["prompt"] * 3 + ["remember", "correction", "offered", "asked", "nudged", "extracted", "stop", "stop", "end"]
    seqs, uptos, rows, start = {}, {}, [], datetime(2026, 1, 1)
    for k in range(n):
        s, kind = pick.choice("abcdef"), pick.choice(kinds)
        seqs[s] = seqs.get(s, 0) + 1
        row = {"session": s, "seq": seqs[s], "kind": kind, "ts": (start + timedelta(minutes=k)).isoformat()}
        if kind in ("failed", "ok"):
            row["program"] = pick.choice(["make", "cargo", "git", None])
        if kind == "failed":
            row |= {"seen": pick.choice([True, False, None]), "answered": pick.choice([True, False])}
        if kind in ("failed", "prompt") and pick.random() < 0.7:
            row |= {"id": f"r{pick.randint(0, 5)}", "tier": pick.choice(["proven", "candidate", "archive"]), "eligible": pick.choice([True, True, False, None])}
        if kind == "offered":
            uptos[s] = row["upto"] = max(uptos.get(s, 0), seqs[s] - pick.randint(0, 6))
        rows.append(row)
    return rows


def _write(folder, rows, cuts):
    folder.mkdir()
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        (folder / f"{k:03d}.json").write_text("".join(json.dumps(r) + "\n" for r in rows[a:b]))
        os.utime(folder / f"{k:03d}.json", (1e9 + k, 1e9 + k))  # files are read in the order of their times


def _plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("cuts", [[], [90, 200], list(range(40, 300, 40))])
def test_session_gates_equal_batch(spark, tmp_path, cuts):
    rows = _events(21, 300)
    _write(tmp_path / "in", rows, cuts)
    stream = spark.readStream.schema(gates.EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = gates.run_to_end(gates.session_gates(stream), str(tmp_path / "out"))
    want = hooks.session_gates(spark.read.schema(gates.EVENTS).json(str(tmp_path / "in")))
    assert got.dtypes == [(c, t) for c, t in want.select(got.columns).dtypes]
    found = _plain(want.select(got.columns).collect())
    assert _plain(got.collect()) == found
    assert {r[2] for r in found} == {"fixed", "repeat", "nohit", "inferred", "push", "stop", "capture"} and {r[7] for r in found} >= {"block", "nudge", None}


def test_seen_before_equals_batch(spark, tmp_path):
    pick = random.Random(22)
    rows, time = [], 0
    for k in range(400):
        time += pick.choice([0, 3600, 86_400 * 5])
        rows.append({"sig": f"g{pick.randint(0, 8)}", "session": pick.choice("xyz"), "seq": k, "time": time})
    _write(tmp_path / "in", rows, [70, 71, 250])
    schema = "sig string, session string, seq long, time long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = gates.run_to_end(gates.seen_before(stream), str(tmp_path / "out"))
    want = hooks.seen_before(spark.read.schema(schema).json(str(tmp_path / "in"))).withColumn("seen", F.coalesce("seen", F.lit(False)))
    assert _plain(got.collect()) == _plain(want.select(got.columns).collect()) and {r.seen for r in got.collect()} == {True, False}


def test_a_session_is_forgotten_after_14_days(spark, tmp_path):
    start = datetime(2026, 1, 1)
    at = lambda days: (start + timedelta(days=days)).isoformat()
    rows = [{"session": "a", "seq": 1, "kind": "failed", "program": "make", "ts": at(0)}, {"session": "b", "seq": 1, "kind": "prompt", "ts": at(20)}, {"session": "b", "seq": 2, "kind": "prompt", "ts": at(21)}]
    rows += [{"session": "a", "seq": 2, "kind": "ok", "program": "make", "ts": at(22)}, {"session": "a", "seq": 3, "kind": "failed", "program": "make", "ts": at(23)}, {"session": "a", "seq": 4, "kind": "ok", "program": "make", "ts": at(24)}]
    _write(tmp_path / "in", rows, [1, 2, 3])
    stream = spark.readStream.schema(gates.EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = gates.run_to_end(gates.session_gates(stream), str(tmp_path / "out")).where("gate = 'fixed'").collect()
    assert [(r.session, r.seq) for r in got] == [("a", 4)]


def test_query_equals_batch(spark):
    from tidewell.plans import library

    sf = "/root/testdata/sf0.001"
    got = library.session_gates_streamed(spark, sf)
    want = hooks.session_gates(library.logged(spark, sf).selectExpr(*library.GATED)).select(got.columns)
    found = _plain(got.collect())
    assert found == _plain(want.collect()) and len({r[2] for r in found}) == 7
