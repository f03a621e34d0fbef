"""Items of one large group of shared signatures."""

import random

import pyarrow as pa
import pytest
from tidewell.operators import digest


def _items(n):
    pick = random.Random(11)
    places = pick.sample(range(n), n)
    return [(k, places[k], [f"g{pick.randint(0, n // 3)}" for _ in range(pick.randint(0, 4))]) for k in range(n)]


def _kept(items):
    seen, kept = set(), set()
    for item, _, signatures in sorted(items, key=lambda x: x[1]):
        new = next((s for s in signatures if s not in seen), None)
        if not signatures or new:
            kept.add(item)
            seen |= {new} - {None}
    return kept


@pytest.mark.parametrize("at_once", [1 << 17, 10])
def test_representatives_need_no_group_of_all_items(spark, monkeypatch, at_once):
    items = _items(300)
    df = spark.createDataFrame(items, "item int, place int, signatures array<string>").repartition(5)
    monkeypatch.setattr(digest, "CHOSEN", at_once)
    found = digest.representatives(df)
    assert {r.item for r in found.collect()} == _kept(items)
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()


def test_choosing_is_begun_anew(monkeypatch):
    items = [x for x in _items(300) if x[2]]
    monkeypatch.setattr(digest, "CHOSEN", 20)
    batches = [pa.RecordBatch.from_pydict(dict(zip(("item", "place", "signatures"), zip(*items[k : k + 15])))) for k in range(0, len(items), 15)]
    some = [r for batch in digest._choosing(batches) for r in batch.to_pylist()]
    assert len(some) < len(items) and _kept([tuple(r.values()) for r in some]) == _kept(items)
