"""Line dedup against brute force: random lines, templates with numbers, short lines; and many lines of one template."""

import random
import time
from collections import Counter

import pytest
from tidewell.llm import line_dedup, queries


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def _expected(rows, errors=2):
    """``id, line_no`` of all lines that go."""
    lines = sorted({x for _, t in rows for x in (t or "").split("\n") if x.strip(" ")})
    root, bags = {x: x for x in lines}, {x: Counter(x) for x in lines}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(lines):
        for b in lines[k + 1 :]:
            allowed = min(errors, max(len(a), len(b)) // 10)
            if abs(len(a) - len(b)) > allowed or top(a) == top(b) or (bags[a] - bags[b]).total() > allowed or (bags[b] - bags[a]).total() > allowed:
                continue  # an edit takes one character away at most, and adds one at most
            if _distance(a, b) <= allowed:
                root[top(a)] = top(b)
    first, gone = {}, set()
    for i, t in sorted(rows):
        for n, x in enumerate((t or "").split("\n")):
            if x.strip(" "):
                if top(x) in first:
                    gone.add((i, n))
                first.setdefault(top(x), (i, n))
    return gone


def _got(spark, rows, errors=2):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {(r.doc_id, x.line_no) for r in line_dedup.line_dedup(df, errors=errors).collect() for x in r.removed}


def _random_rows(seed, n):
    pick = random.Random(seed)
    stems = ["".join(pick.choices("abc dé", k=pick.choice([3, 8, 9, 10, 11, 15, 18, 19, 20, 21, 22, 29, 30, 45]))) for _ in range(n // 4)]

    def varied(x):
        for _ in range(pick.randint(0, 3)):
            k = pick.randrange(len(x) + 1)
            x = pick.choice([x[:k] + x[k + 1 :], x[:k] + pick.choice("xé") + x[k:], x[:k] + "y" + x[k + 1 :]])
        return x

    return [(i, "\n".join(varied(pick.choice(stems)) for _ in range(4))) for i in range(n // 4)]


@pytest.mark.parametrize("errors", [1, 2])
def test_random_lines_equal_brute_force(spark, errors, monkeypatch):
    rows = _random_rows(errors, 400)
    want = _expected(rows, errors)
    assert len(want) > 50
    if errors == 1:
        assert _got(spark, rows, errors) == want
        return
    monkeypatch.setattr(line_dedup, "CROWDED", 3)  # nearly all keys are crowded then
    assert _got(spark, rows, errors) == want


def test_templates_equal_brute_force(spark):
    pick = random.Random(9)
    number = lambda digits: str(pick.randrange(10**digits))
    lines = [f"2026-01-01 request {number(6)} was served in good time" for _ in range(250)]
    lines += [f"{number(5)} connections were opened by worker {number(4)} since start, {number(6)} bytes" for _ in range(150)]
    lines += [f"item {number(3)} of the list of all items" for _ in range(60)] + [f"code {number(8)}" for _ in range(60)]
    rows = [(i, "\n".join(lines[i::40])) for i in range(40)]
    want = _expected(rows)
    assert len(want) > 20 and _got(spark, rows) == want


def test_many_lines_of_one_template(spark):
    pick = random.Random(10)
    rows = [(i, "\n".join(f"GET /static/item/{pick.randrange(10**9):09d}/view.html answered with 200 by the front end" for _ in range(40))) for i in range(100)]
    began = time.time()
    gone = _got(spark, rows)
    took = time.time() - began
    assert took < 120 and len(gone) < 4000  # all pairs took longer


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op10_line_dedup(spark, sf).collect()
    assert len(got) == len(rows) and all(r.n_removed == len(r.removed) for r in got)
    assert {(r.doc_id, x.line_no) for r in got for x in r.removed} == _expected(rows)
