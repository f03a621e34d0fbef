"""Connected components of a link table, in parallel (alternating large-star and small-star rounds)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, is_few, mapped

#: Nodes that a task contracts at once where links are many.
NODES = 1 << 16


def _least(pairs: DataFrame) -> DataFrame:
    """The least of each ``a`` and its partners, as ``m``; pre-aggregated in each task."""
    return pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def _values(column: pa.Array) -> list:
    """Values that compare as Spark compares them; rows of fields as tuples."""
    return list(zip(*[x.to_pylist() for x in column.flatten()])) if pa.types.is_struct(column.type) else column.to_pylist()


def _column(values: list, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_struct(kind):
        return pa.array(values, kind)
    return pa.StructArray.from_arrays([pa.array([v[k] for v in values], f.type) for k, f in enumerate(kind)], fields=list(kind))


def _contracted(links: DataFrame, most: int | None) -> DataFrame:
    """The links ``a, b`` of each partition as stars around least nodes, for about ``most`` nodes at once (None: all)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent, kinds = {}, []

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        def stars() -> pa.RecordBatch:
            ends = [(x, root(x)) for x in list(parent)]
            ends = [e for e in ends if e[0] != e[1]]
            return pa.RecordBatch.from_arrays([_column([e[k] for e in ends], kinds[k]) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            kinds = [c.type for c in batch.columns]
            for a, b in zip(_values(batch.column(0)), _values(batch.column(1))):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if most is not None and len(parent) >= most:
                yield stars()
                parent.clear()
        if parent:
            yield stars()

    return mapped(links, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in links.schema))


def connected_components(links: DataFrame, most_rounds: int = 60, contract: bool = False) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a`` and ``b``, numbers or rows of numbers); the root is the
    least node.

    Each round is two joins on a node's number and leaves at most as many links as before, so no component is ever
    gathered; rounds grow with the logarithm of the links. A few links (some MB) are worked through in one partition,
    without exchanges. Loops and repeated links are harmless; no links, no rows.

    With ``contract``, for operators that run Python on executors anyhow, each task first contracts its links, block by
    block, to stars with the same components. A few links are one block, so they are done with that; rounds over them
    would cost the driver more, in plans and compiled code, than all their work. Of many, the stars go on in rounds.
    """
    # what the planner knows of a checkpoint may name columns of the plan that was cut, which a union doesn't bear; a
    # limit on partitions that is never met lets through only what is known of the columns that are there
    bare = lambda df: df.coalesce(1 << 20)
    held = bare(durable(links.select("a", "b").where("a != b").distinct()))
    alone = is_few(held)
    if contract and alone:
        return _rooted(durable(_contracted(held.coalesce(1), None)).coalesce(1)).coalesce(1)
    stars = bare(durable(_contracted(held, NODES))) if contract else held
    seen = None
    for _ in range(most_rounds):
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both.coalesce(1) if alone else both
        large = (
            both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        )
        down = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b"))))
        small = large.join(_least(large), "a").select(down.alias("x")).select("x.*").where("a != b").distinct()
        stars = bare(durable(small))
        mark = tuple(stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"no fixed point in {most_rounds} rounds")
    return _rooted(stars).coalesce(1) if alone else _rooted(stars)


def _rooted(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select("b", "b").distinct())
