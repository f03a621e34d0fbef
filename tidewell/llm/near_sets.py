"""Near-duplicates by exact similarity of word shingles, for which SimHash links are the first candidates.

Two texts link if the Jaccard similarity of their sets of shingles (64-bit hashes) is at least ``percent``. The method
loses no link, up to collisions of the hashes.

1. Texts with equal sets are one set. Sets whose fingerprints link (``simhash.links``: Golay keys, two bits) are verified
   first, so copies with small changes are in components before anything else is joined.
2. Shingles are put in an order that has the common ones last. Of ``n`` shingles in order, sets at the threshold share
   one of the ``n - ceil(threshold * n) + 1`` first ones (the prefix), so sets meet under these. Any fixed order serves;
   this one keeps passages that many texts hold out of the prefixes. What is common is read from a table of bounded size:
   counts, over all texts, of shingles by 18 bits of their hash, of which the highest are kept.
3. Of a pair that reaches the threshold, the one whose prefix ends first has at most so many shingles in it that the
   other lacks; so both prefixes share at least the rest. Pairs that share fewer aren't looked at, which leaves out texts
   that have no more than a passage in common.
4. Each set is first compared with the one that is the least under most of its keys, in some rounds. Only sets that are
   then in different components are paired, under all of their keys: a group of copies makes no pair for each two.
5. Sets that meet are kept if their sizes allow the threshold, and the parities of their hashes in 256 cells: cells that
   differ are no more than the hashes that only one has.
6. Pairs that are left are verified by intersecting the sets, as 32 bits of each shingle's hash: two texts of n words
   share n * n / 2**32 of them by chance.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import durable, gathered, mapped, released, small, steps, summed
from .components import connected_components

#: Words of the parity bitmap.
CELLS = 4
#: Bits of a shingle's hash by which common shingles are counted, and how many counts are kept.
COMMON_BITS, MOST_COMMON = 18, 1 << 15
#: Times that sets are compared with a few others before any are paired.
ROUNDS = 2


def shingle_set(hashes: list[int]) -> np.ndarray:
    """The distinct ones of a text's shingle hashes, in order."""
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def parities(found: np.ndarray, words: int = CELLS) -> np.ndarray:
    bits = np.bincount((found.view(np.uint64) >> np.uint64(5)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _cell(found: np.ndarray) -> np.ndarray:
    return (found.view(np.uint64) >> np.uint64(64 - COMMON_BITS)).astype(np.int64)


def common_cells(rows: DataFrame, width: int) -> np.ndarray:
    """For each cell how common its shingles are: a count over all texts for the ``MOST_COMMON`` highest, else 0.

    A task hands on the cells that it finds more than twice as often as the mean.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COMMON_BITS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = [_cell(shingle_set(simhash.shingle_hashes(t.as_py(), width))) for t in batch.column(0).slice(at, 512)]
                total += np.bincount(np.concatenate(found), minlength=len(total))
        at = np.nonzero(total > 2 * total.mean() + 2)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    found = mapped(rows.select("text"), run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(1 << COMMON_BITS, np.int64)
    for r in found.orderBy(F.desc("n"), "cell").limit(MOST_COMMON).collect():
        out[r["cell"]] = r["n"]
    return out


def prefix(found: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, of which sets at the threshold share one; in order of the hash."""
    if not len(found):
        return found
    order = np.argsort(common[_cell(found)], kind="stable")  # equal counts stay in order of the hash
    return np.sort(found[order[: len(found) + (-percent * len(found) // 100) + 1]])


def _sets(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """``rows`` (``doc, text``) as ``doc, sid, n, fp, p0.., prefix``."""
    doc_type = rows.schema["doc"].dataType.simpleString()
    columns = [f"p{k}" for k in range(CELLS)]
    shipped = rows.sparkSession.sparkContext.broadcast(common_cells(rows, width))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                hashes = [simhash.shingle_hashes(t.as_py(), width) for t in part.column(1)]
                found = [shingle_set(h) for h in hashes]
                sid = np.array([xxhash.xxh64_intdigest(f.tobytes(), 7) for f in found], np.uint64).view(np.int64)
                size = np.array([len(f) for f in found], np.int64)
                fps = np.array([simhash.majority(h) for h in hashes], np.uint64).view(np.int64)
                cells = np.array([parities(f) for f in found]).reshape(-1, CELLS)
                lists = pa.array([steps(prefix(f, shipped.value, percent).view(np.uint64)) for f in found], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sid), pa.array(size), pa.array(fps), *[pa.array(cells[:, k].copy()) for k in range(CELLS)], lists],
                    names=["doc", "sid", "n", "fp", *columns, "prefix"],
                )

    listed = "".join(f", {c} long" for c in columns)
    return mapped(rows, run, f"doc {doc_type}, sid long, n long, fp long{listed}, prefix binary")


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [summed(p.as_py(), np.uint64).view(np.int64) for p in batch.column(1)]
        sid = np.repeat(batch.column(0).to_numpy(), [len(f) for f in found])
        yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], names=["sid", "key"])


def _shared_at_least(x: str, y: str, percent: int) -> Column:
    """How many shingles the prefixes of two sets at the threshold share at least, of the sizes ``x`` and ``y``."""
    a, b = F.col(x), F.col(y)
    need = F.ceil((a + b) * percent / (100 + percent))
    first = lambda n: n - F.ceil(n * percent / 100) + 1 - (n - need)
    return F.greatest(F.least(first(a), first(b)), F.lit(1))


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether sizes and parities of two sets allow the threshold; ``x`` and ``y`` are patterns of their columns' names."""
    a, b = F.col(x.format("n")), F.col(y.format("n"))
    apart = reduce(lambda p, q: p + q, [F.bit_count(F.col(x.format(f"p{k}")).bitwiseXOR(F.col(y.format(f"p{k}")))) for k in range(CELLS)])
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (apart * (100 + percent) <= (a + b) * (100 - percent))


#: Bytes of a table that is sent to all executors here. The tables of pairs and links are far smaller than that of sets,
#: so they are what is sent.
MOST_SENT = 8 << 20


def _possible(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that sizes and parities allow."""
    x, y = (facts.withColumnsRenamed({c: p if c == "sid" else f"{c}_{p}" for c in facts.columns}) for p in "ab")
    met = y.join(small(durable(x.join(small(durable(pairs), MOST_SENT), "a")), MOST_SENT), "b")
    return met.where(_may_link("{}_a", "{}_b", percent)).select("a", "b")


def _verified(pairs: DataFrame, rows: DataFrame, known: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` of sets that reach the threshold. ``known`` has ``sid, least``, a document with the set's text."""
    # few bytes, much work: spread over all tasks
    pairs = durable(pairs.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b"))
    asked = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted = small(durable(known.join(small(durable(asked), MOST_SENT), "sid").select("sid", F.col("least").alias("doc"))), MOST_SENT)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [np.unique((shingle_set(simhash.shingle_hashes(t.as_py(), width)) >> 32).astype(np.int32)) for t in part.column(1)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["sid", "found"])

    sets = small(durable(mapped(rows.join(wanted, "doc").select("sid", "text"), run, "sid long, found array<int>")), MOST_SENT)
    side = lambda p: sets.select(F.col("sid").alias(p), F.col("found").alias(f"of_{p}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    enough = met.where(shared * (100 + percent) >= percent * (F.size("of_a") + F.size("of_b")))
    links = gathered(enough.select("a", "b").distinct())  # documents may repeat
    del sets, met, enough, asked, wanted, pairs
    released(rows.sparkSession)
    return links


def _roots(links: DataFrame) -> DataFrame:
    roots = gathered(connected_components(links, contract=True))
    released(links.sparkSession)
    return roots


def near_sets(docs: DataFrame, doc_col: str, text_col: str = "text", width: int = 5, percent: int = 80, rounds: int = ROUNDS) -> DataFrame:
    """``doc_col, fp, component_id`` for each row: its fingerprint and the least ``doc_col`` that links reach, its own
    included.

    ``doc_col`` must tell texts apart: rows that repeat it have one text. Texts of fewer words than ``width`` are one
    shingle; a null text counts as empty, and texts without words are copies of each other. An empty table stays empty.
    """
    rows = docs.select(F.col(doc_col).alias("doc"), F.col(text_col).cast("string").cast("binary").alias("text"))
    made = durable(_sets(rows, width, percent))
    cells = [f"p{k}" for k in range(CELLS)]
    known = gathered(made.groupBy("sid").agg(F.min("doc").alias("least"), F.first("prefix").alias("prefix"), *[F.max(c).alias(c) for c in ["n", "fp", *cells]]))
    facts = known.select("sid", "n", *cells)
    verified = lambda pairs: _verified(_possible(pairs, facts, percent), rows, known, width, percent)
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    # fingerprints first: sets of one fingerprint with the least of them, and those of linked fingerprints with each other
    of_fp = known.groupBy("fp").agg(F.min("sid").alias("sid"))
    same = known.select("fp", "sid").join(of_fp.withColumnRenamed("sid", "first"), "fp").where("sid != first").select(*pair("sid", "first"))
    ends = of_fp.withColumnsRenamed({"fp": "a", "sid": "x"}), of_fp.withColumnsRenamed({"fp": "b", "sid": "y"})
    linked = simhash.links(of_fp.select("fp")).join(ends[0], "a").join(ends[1], "b").select(*pair("x", "y"))
    links = verified(same.union(linked).distinct())
    del of_fp, same, ends, linked
    roots = _roots(links)

    keys = mapped(known.select("sid", "prefix"), _keys, "sid long, key long").repartition("key")  # both sides read this exchange
    several = keys.groupBy("key").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low != high").select("key")
    keys = gathered(keys.join(several, "key").distinct())
    released(docs.sparkSession)
    size = known.select("sid", "n")

    def apart() -> DataFrame:
        """Sets under keys whose sets are in different components still."""
        root = small(roots.withColumnRenamed("node", "sid"), MOST_SENT)
        at = keys.join(root, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        mixed = at.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
        return at.join(mixed, "key", "left_semi")

    def enough(counted: DataFrame) -> DataFrame:
        """The pairs ``a, b, shared`` of which the prefixes share as many as they must."""
        of_a = size.withColumnsRenamed({"sid": "a", "n": "na"}).join(small(durable(counted), MOST_SENT), "a")
        sizes = size.withColumnsRenamed({"sid": "b", "n": "nb"}).join(small(durable(of_a), MOST_SENT), "b")
        return sizes.where(F.col("shared") >= _shared_at_least("na", "nb", percent)).select("a", "b")

    for k in range(rounds):
        left = apart()
        pivots = left.groupBy("key").agg(F.min_by("sid", F.xxhash64(F.lit(k), "sid")).alias("pivot"))
        met = left.join(pivots, "key").where("sid != pivot").groupBy("sid", "pivot").agg(F.count(F.lit(1)).alias("shared"))
        nearest = met.groupBy("sid").agg(F.max_by(F.struct("pivot", "shared"), F.struct("shared", "pivot")).alias("m"))
        spokes = enough(nearest.select(*pair("sid", "m.pivot"), "m.shared")).distinct()
        links = links.union(verified(spokes))
        roots = _roots(links)
    left = apart().join(facts, "sid")
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.sid") < F.col("y.sid")) & (F.col("x.root") != F.col("y.root"))
    cross = left.alias("x").join(left.alias("y"), met & _may_link("x.{}", "y.{}", percent)).groupBy(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"))
    links = links.union(_verified(enough(cross.agg(F.count(F.lit(1)).alias("shared"))), rows, known, width, percent))
    roots = _roots(links)
    rooted = known.select("sid", "least").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = small(durable(rooted.select("sid", "root").join(groups, "root").select("sid", "component_id")), MOST_SENT)
    return made.select("doc", "sid", "fp").join(of_set, "sid").select(F.col("doc").alias(doc_col), "fp", "component_id")
