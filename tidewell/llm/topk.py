"""Exact top-k by inner product: distributed histogram selection.

Vectors are dealt to blocks, queries and candidates alike, and every pair of a query block and a candidate block is
scored by one matrix product. Instead of sending scores, each pass sends histograms: for every query, how many scores
fall into each bin of the query's current range. Added up over all blocks they tell in which bin the k-th highest
score lies and how many lie above it; the next pass looks at that bin only, with finer bins, until a bin is one score
wide. The last pass sends the candidates at or over the k-th score, and ties are broken by the smaller id.

A block never needs to report bins under its own k-th score (the global one can't be lower), nor more than k
candidates in order of score and id, so what a block sends is bounded by k for each query however many scores tie.
Both sides are joined on block numbers by merging, so neither is broadcast and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Bins of a histogram; two passes settle ranges of about a million scores.
BINS = 1024


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """``id, v`` with floor(scale * x) of each component; rows without id, null vectors and vectors with null or
    non-finite components are left out."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & fine).withColumn("v", F.transform(v, lambda x: F.floor(x * scale).cast("double")))


def _pack(prefix: str, width: int, extra: tuple[str, ...] = ()):
    """Rows of a partition into blocks of at most ``width`` rows: ids and extras as int64, vectors as a padded matrix."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), width):
                part = frame.iloc[k : k + width]
                dim = max((len(x) for x in part["v"]), default=0)
                m = np.zeros((len(part), dim))
                for i, x in enumerate(part["v"]):
                    m[i, : len(x)] = x
                out = {f"{prefix}_block": [int(part["block"].iloc[0])], f"{prefix}_ids": [part["id"].to_numpy(np.int64).tobytes()], f"{prefix}_m": [m.tobytes()]}
                out |= {f"{prefix}_{x}": [part[x].to_numpy(np.int64).tobytes()] for x in extra}
                yield pd.DataFrame(out)

    return run


def _blocks(rows: DataFrame, prefix: str, blocks: int, width: int, extra: tuple[str, ...] = ()) -> DataFrame:
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    schema = f"{prefix}_block int, {prefix}_ids binary, {prefix}_m binary" + "".join(f", {prefix}_{x} binary" for x in extra)
    # rows of a block stand together, so packs are full
    return dealt.groupBy("block").applyInPandas(lambda frame: pd.concat([*_pack(prefix, width, extra)([frame])]), schema)


def _scores(row, exact_float: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q_ids, c_ids = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.c_ids, np.int64)
    q, c = np.frombuffer(row.q_m).reshape(len(q_ids), -1), np.frombuffer(row.c_m).reshape(len(c_ids), -1)
    dim = min(q.shape[1], c.shape[1])
    if exact_float:  # all sums are integers under 2**53
        s = (q[:, :dim] @ c[:, :dim].T).astype(np.int64)
    else:
        s = q[:, :dim].astype(np.int64) @ c[:, :dim].astype(np.int64).T
    return q_ids, c_ids, s


def _histograms(k: int, exact_float: bool):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                q_ids, c_ids, s = _scores(row, exact_float)
                low, width = np.frombuffer(row.q_low, np.int64), np.frombuffer(row.q_width, np.int64)
                need, span = np.frombuffer(row.q_need, np.int64), np.frombuffer(row.q_span, np.int64)
                numbers = np.frombuffer(row.q_q, np.int64)
                out = []
                for i in range(len(q_ids)):
                    x = s[i][c_ids != q_ids[i]] - low[i]
                    x = x[(x >= 0) & (x < span[i])]
                    if not len(x):
                        continue
                    if len(x) > need[i]:  # what is under this block's own k-th score needn't be sorted
                        x = x[x >= np.partition(x, -need[i])[-need[i]]]
                    bins, n = np.unique(x // width[i], return_counts=True)
                    above = n[::-1].cumsum()[::-1] - n  # scores of this block over each bin
                    keep = above < need[i]
                    out.append((np.full(keep.sum(), numbers[i]), bins[keep], n[keep]))
                if out:
                    yield pd.DataFrame(dict(zip(("q", "bin", "n"), map(np.concatenate, zip(*out)))))

    return run


def _winners(k: int, exact_float: bool):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                q_ids, c_ids, s = _scores(row, exact_float)
                low, numbers, out = np.frombuffer(row.q_low, np.int64), np.frombuffer(row.q_q, np.int64), []
                for i in range(len(q_ids)):
                    at = np.nonzero((s[i] >= low[i]) & (c_ids != q_ids[i]))[0]
                    at = at[np.lexsort((c_ids[at], -s[i][at]))[:k]]
                    out.append((np.full(len(at), numbers[i]), np.full(len(at), q_ids[i]), c_ids[at], s[i][at]))
                if out:
                    yield pd.DataFrame(dict(zip(("q", "query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    return run


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_block: int = 1024,
    candidate_block: int = 4096,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest integer inner products of each query row with other rows.

    A query never meets rows of its own id. Candidates that repeat an id are vectors of their own, and so are queries:
    each repeated query row gets its own k rows. Vectors that can't take part (see ``quantised``) are neither queries nor candidates. Vectors of different
    lengths are compared over the shorter one. Queries with fewer than k candidates get all. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    candidates = quantised(vectors, id_col, vector_col)
    wanted = durable(quantised(queries, id_col, vector_col).withColumn("q", F.monotonically_increasing_id()))
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    facts = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.max(square(F.col("v"))).alias("square"), F.max(F.size("v")).alias("dim")).first()
    c, q = facts(candidates), facts(wanted)
    bound = int(np.sqrt(c["square"] or 0.0) * np.sqrt(q["square"] or 0.0) * (1 + 1e-9)) + 2  # Cauchy-Schwarz
    if bound >= 2**62:
        raise ValueError("scores don't fit 64-bit integers")
    exact = bound < 2**52
    q_blocks, c_blocks = max(1, -(-q["n"] // query_block)), max(1, -(-c["n"] // candidate_block))
    packed = durable(_blocks(candidates, "c", c_blocks, candidate_block))
    first = int(-(-(2 * bound + 1) // BINS))
    state = wanted.select(
        "q", "id", "v", F.lit(-bound).cast("long").alias("low"), F.lit(first).cast("long").alias("width"), F.lit(k).cast("long").alias("need"), F.lit(first * BINS).cast("long").alias("span")
    )
    widths = [first]
    while widths[-1] > 1:
        widths.append(-(-widths[-1] // BINS))
    grid = F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))

    def paired(state: DataFrame) -> DataFrame:
        blocks = _blocks(state, "q", q_blocks, query_block, ("q", "low", "width", "need", "span")).withColumn("c_block", grid)
        # a block's size isn't known to the planner, which would broadcast all pairs of blocks through the driver
        return blocks.join(packed.hint("merge"), "c_block")

    for width, finer in zip(widths, [*widths[1:], 0]):
        counts = paired(state).mapInPandas(_histograms(k, exact), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.desc("bin"))
        ranked = counts.withColumn("upto", F.sum("n").over(down))
        place = ranked.join(state.select("q", "need"), "q")
        # the highest bin by which the need is met; with fewer scores than needed the range stays, and all are taken
        met = F.col("upto") >= F.col("need")
        chosen = place.where(met).groupBy("q").agg(F.max(F.struct("bin", (F.col("upto") - F.col("n")).alias("over"))).alias("hit"))
        state = durable(
            state.join(chosen, "q", "left").select(
                "q",
                "id",
                "v",
                (F.col("low") + F.coalesce("hit.bin", F.lit(0)) * width).alias("low"),
                F.lit(max(1, finer)).cast("long").alias("width"),
                (F.col("need") - F.coalesce("hit.over", F.lit(0))).alias("need"),
                F.lit(width).cast("long").alias("span"),
            )
        )
    found = paired(state).mapInPandas(_winners(k, exact), "q long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
