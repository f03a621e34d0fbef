"""SimHash near-duplicates with Golay-code fuzzy hashing.

Fingerprints have 64 bits: a bit is 1 if it is set in over half the hashes of the text's word shingles. They are
reduced to distinct ones before anything is joined. Two of them link if they differ in at most two bits.

A fingerprint is cut into segments of 23, 23 and 18 bits. Two errors spread over three segments leave one intact (the
pigeonhole), and any other segment then has two errors at most. The binary Golay code is perfect: each 23-bit word
has exactly one codeword within three bits, whose twelve message bits are its index. Two words at distance two or less
have a common neighbour at distance one or zero from both, so the index sets of their radius-one balls meet. Each
fingerprint therefore gets, for every segment, keys made of the intact segment and each index of the next one, about
six a segment; linked fingerprints share a key. Pairs under a key are verified on all 64 bits.

A key that many distinct fingerprints share would make a pair for each two of them. Above ``most_in_bucket`` such
keys' fingerprints are linked through their radius-one neighbours instead: two words are at distance two or less
exactly if a word lies within one bit of both, and at most 65 words are that close to it. The components are the same,
and the rows grow in proportion.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, mapped
from .components import connected_components

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the code. Fixed value.
GENERATOR = 0b110001110101
LENGTH, CHECK = 23, 11


def shingle_hashes(text: bytes | None, width: int, seed: int = 42) -> list[int]:
    """The hashes of a text's word shingles, in order; of all words if they are fewer, none if there is no word."""
    words = (text or b"").lower().split()  # both of ASCII only
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-width]))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist())]


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, as an unsigned number; 0 if it has no words."""
    return majority(shingle_hashes(text, width, seed))


def majority(hashes: list[int]) -> int:
    """The bits that over half of the hashes have."""
    if not hashes:
        return 0
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = np.array(hashes[k : k + 65_536], np.uint64).view(np.uint8)
        total += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id_col, fp`` (as a signed 64-bit number) for each row. A null text counts as empty."""
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").cast("binary").alias("__text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=[id_col, "fp"])

    return mapped(rows, run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, fp long")


def _syndrome(v: np.ndarray) -> np.ndarray:
    """The remainder of polynomials of up to 23 bits by the generator."""
    v = v.astype(np.int64)
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        v = np.where(v >> bit & 1, v ^ (GENERATOR << (bit - CHECK)), v)
    return v


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The error pattern of each syndrome, and the radius-one flips."""
    errors = np.array([sum(1 << b for b in c) for n in range(4) for c in combinations(range(LENGTH), n)], np.int64)
    table = np.zeros(1 << CHECK, np.int64)
    table[_syndrome(errors)] = errors  # one for each syndrome, for the code is perfect
    return table, np.array([0, *[1 << b for b in range(LENGTH)]], np.int64)


def golay_indices(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word the index of the codeword nearest to each word of its radius-one ball (n x 24)."""
    table, flips = _tables()
    near = words.astype(np.int64)[:, None] ^ flips[None, :]
    return (near ^ table[_syndrome(near)]) >> CHECK


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of fingerprints (unsigned)."""
    bits = fps.astype(np.uint64)
    segments = [(bits & np.uint64(0x7FFFFF)).astype(np.int64), ((bits >> np.uint64(23)) & np.uint64(0x7FFFFF)).astype(np.int64), (bits >> np.uint64(46)).astype(np.int64)]
    rows, keys = [], []
    for k in range(3):
        index = np.sort(golay_indices(segments[(k + 1) % 3]), axis=1)
        first = np.ones(index.shape, bool)
        first[:, 1:] = index[:, 1:] != index[:, :-1]
        at = np.nonzero(first)[0]
        rows.append(at)
        keys.append((np.int64(k) << 35) | (segments[k][at] << 12) | index[first])
    return np.concatenate(rows), np.concatenate(keys)


def _key_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for k in range(0, len(fps), 8192):
            part = fps[k : k + 8192]
            rows, keys = fuzzy_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])


def links(distinct: DataFrame, most_in_bucket: int = 64) -> DataFrame:
    """``a, b``: links whose components are those of all pairs of fingerprints at distance two or less.

    ``distinct`` has one column ``fp`` without repeats or nulls.
    """
    keys = durable(distinct.mapInArrow(_key_rows, "key long, fp long"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = durable(keys.join(shared, "key"))
    small = met.where(F.col("n") <= most_in_bucket).select("key", "fp")
    pairs = (
        small.alias("x")
        .join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= 2))
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )
    crowded = met.where(F.col("n") > most_in_bucket).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), k) for k in range(64)])
    near = crowded.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("mid"))
    met_there = near.groupBy("mid").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    through = met_there.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a != b")
    return pairs.union(through)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int | None = None) -> DataFrame:
    """``id_col, fp, component_id`` for each row: its fingerprint and the least id that links reach, its own included.

    Fingerprints link at two or fewer differing bits. With ``percent``, texts link instead if the Jaccard similarity of
    their shingles reaches it; linked fingerprints are then only the first candidates, and ``near_sets`` finds the rest
    (similar texts mostly differ in more bits); ids must then tell texts apart.

    Rows repeat as they are given; a null id never is the least unless all ids of a component are null. Texts without
    words have fingerprint zero and link like any other. Other columns are ignored; an empty table stays empty.
    """
    if percent is not None:
        from .near_sets import near_sets

        return near_sets(docs, id_col, text_col, width, percent)
    rows = durable(fingerprints(docs, id_col, text_col, width).withColumnRenamed(id_col, "__id"))
    known = rows.groupBy("fp").agg(F.min("__id").alias("least"))
    roots = connected_components(links(known.select("fp")))
    placed = known.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = placed.select("fp", "root").join(groups, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(F.col("__id").alias(id_col), "fp", "component_id")
