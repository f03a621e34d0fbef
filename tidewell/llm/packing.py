"""Best-fit packing of tokenized documents, after Martello-Toth dominance reduction.

Documents are tokenized once, in parallel, into pieces of at most ``capacity`` tokens; only the lengths matter for the
packing, and there are at most ``capacity`` distinct ones, so the instance is a histogram of bounded size. The driver

1. applies the dominance rules to it: a set of items that fits one sequence and dominates every other set that holds
   its largest item (each of the others can be exchanged for a part of it) is fixed for good;
2. packs what is left by best fit, longest first, handling equal items and equal sequences together.

The outcome is a list of runs: "items number a to b of this length lie at this offset of the sequences from s on".
Pieces find their run by their number among the pieces of equal length. Those numbers are counted in two levels
(length and bucket) and looked up in blocks, both of bounded size, so a length that a third of all pieces share is no
single task.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import shared_encoder
from .common import durable, mapped

#: Ranks that are looked up in one window.
BLOCK_RANKS = 512


@dataclass
class Plan:
    """Runs (length, first rank, count, first sequence, offset); ``sequences`` is how many are used."""

    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    reduced: int = 0  # sequences fixed by dominance
    used: dict[int, int] = field(default_factory=dict)

    def put(self, length: int, n: int, sequence: int, offset: int) -> None:
        at = self.used.get(length, 0)
        self.runs.append((length, at, n, sequence, offset))
        self.used[length] = at + n

    def fix(self, lengths: list[int], n: int) -> None:
        """``n`` new sequences, each with one item of each length."""
        offset = 0
        for x in lengths:
            self.put(x, n, self.sequences, offset)
            offset += x
        self.sequences += n
        self.reduced += n


def _smallest(left: dict[int, int], order: list[int], without: int, how_many: int, above: int = 0) -> list[int]:
    """The smallest lengths over ``above`` that are left, one item of ``without`` taken away; repeats count."""
    found = []
    for x in order[bisect_left(order, above + 1) :]:
        found += [x] * min(how_many - len(found), left[x] - (x == without))
        if len(found) >= how_many:
            break
    return found


def _largest(left: dict[int, int], order: list[int], room: int, taken: list[int]) -> int | None:
    """The largest length up to ``room`` of which an item is left beside those taken."""
    for k in range(bisect_left(order, room + 1) - 1, -1, -1):
        if left[order[k]] > taken.count(order[k]):
            return order[k]
    return None


def reduce_by_dominance(counts: dict[int, int], capacity: int, plan: Plan) -> dict[int, int]:
    """Fix dominating sets of one, two or three items; returns what is left of ``counts``."""
    left = {x: n for x, n in counts.items() if n}
    order = sorted(left)
    for item in sorted(left, reverse=True):
        while left[item] > 0:
            room = capacity - item
            few = _smallest(left, order, item, 3)
            partner = _largest(left, order, room, [item])
            if partner is None:  # nothing fits beside it
                chosen = [item]
            elif partner == room or sum(few[:2]) > room or len(few) < 2:
                chosen = [item, partner]  # fills the sequence, or no two others fit
            else:
                chosen = []
                third = _largest(left, order, room - partner, [item, partner])
                if third is not None and (len(few) < 3 or sum(few[:3]) > room):  # at most two others fit
                    larger = _smallest(left, order, item, 2, above=third)
                    if len(larger) < 2 or sum(larger) > room:  # no pair has its smaller part over the third
                        chosen = [item, partner, third]
            if not chosen:
                break
            n = min(left[x] // chosen.count(x) for x in chosen)
            if len(chosen) > 1 and partner != room:
                # the argument looks at the items that are left, so it is made anew when they may have changed
                n = min(n, max(1, left[item] // 2)) if chosen.count(item) == 1 and len(chosen) == 2 else 1
            plan.fix(chosen, n)
            for x in chosen:
                left[x] -= n
    return {x: n for x, n in left.items() if n}


def best_fit(counts: dict[int, int], capacity: int, plan: Plan) -> None:
    """Best fit, longest first. ``open_`` maps the room that is left to groups (first sequence, count) of sequences."""
    open_: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []  # sorted keys of open_

    def add(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in open_:
                rooms.insert(bisect_left(rooms, room), room)
                open_[room] = []
            open_[room].append((first, n))

    for x in sorted(counts, reverse=True):
        m = counts[x]
        while m:
            k = bisect_left(rooms, x)
            if k < len(rooms):
                room = rooms[k]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(k)
                take = min(m, n)
                plan.put(x, take, first, capacity - room)
                add(room - x, first, take)
                add(room, first + take, n - take)
                m -= take
            else:  # a new sequence takes as many as fit, for its room is then the smallest that fits
                each = capacity // x
                full, rest = divmod(m, each)
                for j in range(each if full else 0):
                    plan.put(x, full, plan.sequences, j * x)
                add(capacity - each * x, plan.sequences, full)
                plan.sequences += full
                for j in range(rest):
                    plan.put(x, 1, plan.sequences, j * x)
                if rest:
                    add(capacity - rest * x, plan.sequences, 1)
                    plan.sequences += 1
                m = 0


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    plan = Plan()
    best_fit(reduce_by_dominance(counts, capacity, plan), capacity, plan)
    return plan


def token_pieces(docs: DataFrame, vocabulary_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, piece, start, length, ids_crc32`` of every piece; a null text is an empty one, which holds the end id."""
    with open(vocabulary_path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("__text"))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(shipped.value, None, "tiktoken", 200_000)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.encode(text or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]  # the first piece is the short one
                for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(k)
                    piece.append(j)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=[id_col, "piece", "start", "length", "ids_crc32"],
            )

    kind = rows.schema[0].dataType.simpleString()
    return mapped(rows, run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (any columns, with a ``length`` of 1 to ``capacity``) with ``sequence_id, offset`` added.

    Repeated rows are pieces of their own. Columns of these two names are replaced; all others pass through, whatever
    their names. Lengths that are null or out of range raise an error. An empty table stays empty.
    """
    spark = pieces.sparkSession
    given = pieces.drop("sequence_id", "offset")
    names = [f"c{k}" for k in range(len(given.columns))]
    rows = durable(given.toDF(*names).withColumn("length", F.col(names[given.columns.index("length")]).cast("long")))
    buckets = math.isqrt(rows.count()) + 1  # as many as the pieces of one that all had the same length
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int"))
    in_bucket = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = in_bucket.withColumn("from", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counts = {r["length"]: r["n"] for r in in_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if any(x is None or not 0 < x <= capacity for x in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    plan = plan_packing(counts, capacity)
    number = Window.partitionBy("length", "bucket").orderBy(*names)
    ranked = rows.join(starts, ["length", "bucket"]).withColumn("rank", F.col("from") + F.row_number().over(number) - 1)
    # a piece lies in the last run of its length that begins at or before its rank. Runs are cut where blocks of ranks
    # begin, so each block holds all that its pieces need, and pieces and runs are read together, once
    block = lambda rank: F.floor(rank / BLOCK_RANKS).cast("long")
    runs = spark.createDataFrame(plan.runs, "length long, first long, count long, sequence long, at long")
    last = block(F.col("first") + F.col("count") - 1)
    cut = runs.withColumn("block", F.explode(F.sequence(block(F.col("first")), last)))
    cut = cut.withColumn("rank", F.greatest("first", F.col("block") * BLOCK_RANKS))
    run = F.struct((F.col("sequence") - F.col("first")).alias("shift"), "at")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name in names]
    both = ranked.select("length", "rank", block(F.col("rank")).alias("block"), F.lit(True).alias("piece"), *names, F.lit(None).cast("struct<shift:bigint,at:bigint>").alias("run"))
    both = both.union(cut.select("length", "rank", "block", F.lit(False), *nothing, run))
    upto = Window.partitionBy("length", "block").orderBy("rank", "piece").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("in", F.last("run", ignorenulls=True).over(upto)).where("piece")
    return met.select(*[F.col(n).alias(c) for n, c in zip(names, given.columns)], (F.col("rank") + F.col("in.shift")).alias("sequence_id"), F.col("in.at").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize and pack whole documents: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``."""
    return pack(token_pieces(docs, vocabulary_path, capacity, end_id, id_col, text_col), capacity)
