"""Language-model scoring with a log-frequency Bloom filter.

Texts are read once, in place, and turned into chunks: packed token numbers of a bounded amount of text, with the
64-bit hashes of the chunk's distinct words. Everything else works on chunks.

1. Each chunk asks for its words: its distinct words go, by ranges of their hashes, to where all chunks' counts of a word
   are added up, and the sums go back to the chunks. Counts of words are exact (up to collisions of 64-bit hashes, about
   one word in a corpus of a billion distinct ones).
2. Each chunk hands on the distinct word pairs of its training texts, with their counts, by segments of their hashes.
   A pair seen c times is entered in its segment's Bloom filter at the levels 1 .. 1 + floor(log_base(c)), so its count
   can be read back, quantised, by probing level after level until a probe misses. What is read is the least count of
   its level, never more than c but for false positives.
3. Chunks probe their pairs in the filter, which is broadcast.

There are as many ranges and segments as words and training tokens need, so each is of bounded size whatever the corpus.
What a chunk sends to one of them is a packed block; empty blocks aren't sent, so blocks are never more than words or pairs.

The probability of a word after another interpolates the quantised pair count with the word's own add-one probability:
P(w|h) = (q(h,w) + m P(w)) / (c(h) + m), where c(h) is how often the history was followed by anything in training,
which is its exact own count. As the q of a history add up to c(h) at most, the P of a history add up to one at most,
but for false positives of the filter, whose rate its size fixes.

What is broadcast is bounded: segments are sent in shares of at most ``most_broadcast`` bytes, and each share scores
the pairs of its segments in a pass of its own over the packed chunks, without a shuffle; the passes' sums are added up.
The outcome doesn't depend on how many shares there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, id_fold, mapped, packed, steps, summed, unpacked

END = b"\n"  # no word holds white space
START = b"\r"


@dataclass(frozen=True)
class Settings:
    chunk_bytes: int = 4 << 20
    range_words: int = 1 << 20  # words that chunks ask for, for each range
    segment_pairs: int = 1 << 20  # training tokens for each segment of the filter
    base: float = 2.0  # of the quantised counts
    bits_each: int = 12  # bits of the filter for each entry
    probes: int = 4
    top_level: int = 60
    mix: float = 2.0  # weight of the word's own probability
    most_broadcast: int = 128 << 20


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text after lower-casing A-Z, then the end."""
    return [*(text or b"").lower().split(), END]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def pair_hashes(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mixed(history * np.uint64(0x9E3779B97F4A7C15) + word)


def _part(half: np.ndarray, parts: int) -> np.ndarray:
    """The part of 32-bit numbers when their range is divided evenly."""
    return (half.astype(np.uint64) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class Chunk:
    """Texts as token numbers: ``hashes`` of the distinct words in order of first sight (number 0 is the start), ``ids``
    and the ``sizes`` of the texts."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray):
        self.hashes, self.ids, self.sizes = hashes, ids, sizes.astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.before = np.empty_like(ids)
        if len(ids):
            self.before[1:] = ids[:-1]
            self.before[self.starts] = 0

    @classmethod
    def of(cls, texts: Iterable[bytes | None]) -> Chunk:
        numbers: dict[bytes, int] = {START: 0}
        put, ids, sizes = numbers.setdefault, [], []
        for text in texts:
            row = np.fromiter((put(w, len(numbers)) for w in tokens(text)), np.uint32)
            sizes.append(len(row))
            ids.append(row)
        return cls(word_hashes(list(numbers)), np.concatenate(ids or [np.zeros(0, np.uint32)]), np.array(sizes, np.uint32))

    @classmethod
    def read(cls, row: dict) -> Chunk:
        return cls(np.frombuffer(row["hashes"], np.uint64), unpacked(row["tokens"], np.uint32), unpacked(row["sizes"], np.uint32))

    def pairs(self, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        return pair_hashes(self.hashes[self.before[of]], self.hashes[self.ids[of]])

    def counts(self, train: np.ndarray) -> np.ndarray:
        """How often each word is a token of the training texts; of the start, how many training texts there are."""
        found = np.bincount(self.ids[np.repeat(train, self.sizes)], minlength=len(self.hashes))
        found[0] = train.sum()
        return found


def _schema(id_type: str) -> str:
    return f"chunk long, ids array<{id_type}>, train binary, sizes binary, tokens binary, hashes binary, counts binary, n_words long, n_train long"


def _chunked(rows: DataFrame, s: Settings) -> DataFrame:
    """``rows`` (id, text, train) as chunks of about ``chunk_bytes`` of text, or one longer text; nothing is shuffled."""
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, first = 0, TaskContext.get().partitionId() << 32
        ids, texts, train, size = [], [], [], 0

        def emit() -> pa.RecordBatch:
            c, learnt = Chunk.of(texts), np.array(train, bool)
            counts = c.counts(learnt).astype(np.uint32)
            columns = [
                pa.array([first + made]), pa.array([ids], pa.list_(kind)), pa.array([learnt.tobytes()]), pa.array([packed(c.sizes.astype(np.uint32))]),
                pa.array([packed(c.ids)]), pa.array([c.hashes.tobytes()]), pa.array([packed(counts)]), pa.array([len(c.hashes)]), pa.array([int(counts[1:].sum())]),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "train", "sizes", "tokens", "hashes", "counts", "n_words", "n_train"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for i, t, learnt in zip(batch.column(0), batch.column(1), batch.column(2)):
                ids.append(i.as_py())
                texts.append(t.as_py())
                train.append(learnt.as_py())
                size += len(texts[-1]) + 64
                if size >= s.chunk_bytes:
                    yield emit()
                    made, ids, texts, train, size = made + 1, [], [], [], 0
        if ids:
            yield emit()

    return mapped(rows, run, _schema(id_type))


def _one_by_one(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _blocks(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The parts that sorted part numbers name, with their places."""
    edges = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(part)]):
        yield int(part[a]), slice(a, b)


def _asked(ranges: int):
    """Blocks of a chunk's words, in order of their hashes, with their counts in its training texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(batches):
            hashes, counts = np.frombuffer(row["hashes"], np.uint64), unpacked(row["counts"], np.uint32)
            order = np.argsort(hashes)
            hashes, counts = hashes[order], counts[order]
            found = [(r, steps(hashes[at]), packed(counts[at])) for r, at in _blocks(_part(hashes >> np.uint64(32), ranges))]
            r, words, n = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array([row["chunk"]] * len(r)), pa.array(words, pa.binary()), pa.array(n, pa.binary())], names=["range", "chunk", "words", "n"])

    return run


def _added(key: tuple, blocks: pa.Table) -> pa.Table:
    """For each block of a range the counts of its words in all training texts; ``types``: how many words have any."""
    words = [summed(x, np.uint64) for x in blocks.column("words").to_pylist()]
    sizes = np.cumsum([0, *map(len, words)])
    every, at = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(at, np.concatenate([unpacked(x, np.uint32) for x in blocks.column("n").to_pylist()]), len(every)).astype(np.uint64)
    start = word_hashes([START])[0]
    types = int(((total > 0) & (every != start)).sum())
    counts = [packed(total[at[a:b]]) for a, b in zip(sizes[:-1], sizes[1:])]
    return pa.table({"range": blocks.column("range"), "chunk": blocks.column("chunk"), "sums": pa.array(counts, pa.binary()), "types": pa.array([types] + [0] * (len(words) - 1))})


def _answered(key: tuple, chunks: pa.Table, sums: pa.Table) -> pa.Table:
    """A chunk with its words' counts in all training texts in place of its own."""
    order = np.argsort(np.frombuffer(chunks.column("hashes")[0].as_py(), np.uint64))
    total = np.empty(len(order), np.uint64)
    total[order] = np.concatenate([unpacked(x, np.uint64) for x in sums.sort_by("range").column("sums").to_pylist()])
    return chunks.set_column(chunks.column_names.index("counts"), "counts", pa.array([packed(total)], pa.binary()))


def _paired(segments: int):
    """Blocks of a chunk's training pairs: the segment is told by the lower half of the hash, the upper one is sent."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(batches):
            c = Chunk.read(row)
            pairs, n = np.unique(c.pairs(np.repeat(np.frombuffer(row["train"], bool), c.sizes)), return_counts=True)
            part, upper = _part(pairs & np.uint64(0xFFFFFFFF), segments), (pairs >> np.uint64(32)).astype(np.uint32)
            order = np.lexsort((upper, part))
            part, upper, n = part[order], upper[order], n[order].astype(np.uint32)
            found = [(r, steps(upper[at]), packed(n[at])) for r, at in _blocks(part)] if len(part) else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.int32(), pa.binary(), pa.binary()))], names=["segment", "pairs", "n"])

    return run


def _levels(counts: np.ndarray, s: Settings) -> np.ndarray:
    return np.minimum(s.top_level, 1 + np.floor(np.log(counts) / math.log(s.base) + 1e-9)).astype(np.int64)


def _positions(hashes: np.ndarray, level: int, probe: int, bits: np.ndarray | int) -> np.ndarray:
    """The bit of each hash for one level and probe; an odd multiplier each keeps levels and probes apart."""
    salt = np.uint64((level * 0x632BE59BD9B4E019 + (probe + 1) * 0xD6E8FEB86659FD93) & (2**64 - 1))
    return (_mixed(hashes ^ salt) >> np.uint64(32)) * np.asarray(bits).astype(np.uint64) >> np.uint64(32)


class Segment:
    """The part of the filter for the pairs of one remainder of hashes."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits, self.data = bits, np.zeros((bits + 7) // 8, np.uint8) if data is None else data

    def enter(self, hashes: np.ndarray, level: int, s: Settings) -> None:
        for probe in range(s.probes):
            at = _positions(hashes, level, probe, self.bits)
            np.bitwise_or.at(self.data, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.int64)).astype(np.uint8))


def probe_counts(hashes: np.ndarray, data: np.ndarray, base_bit: np.ndarray, bits: np.ndarray, s: Settings) -> np.ndarray:
    """The quantised count of each hash: the least count of its level, 0 if the first level misses."""
    level, alive = np.zeros(len(hashes), np.int64), np.arange(len(hashes))
    for k in range(1, s.top_level + 1):
        for probe in range(s.probes):
            at = _positions(hashes[alive], k, probe, bits[alive]) + base_bit[alive]
            hit = (data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            alive = alive[hit == 1]
            if not len(alive):
                break
        level[alive] = k
        if not len(alive):
            break
    return np.where(level == 0, 0.0, np.ceil(np.power(s.base, level - 1.0) - 1e-9))


def _segment(s: Settings):
    """The filter's segment for all pairs of a group."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        upper = np.concatenate([summed(x, np.uint32) for x in rows.column("pairs").to_pylist()])
        pairs, at = np.unique(upper, return_inverse=True)
        sums = np.bincount(at, np.concatenate([unpacked(x, np.uint32) for x in rows.column("n").to_pylist()]), len(pairs))
        level, pairs = _levels(sums, s), pairs.astype(np.uint64)
        segment = Segment(max(64, int(level.sum()) * s.bits_each))
        for k in range(1, int(level.max(initial=0)) + 1):
            segment.enter(pairs[level >= k], k, s)
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([segment.bits]), "data": pa.array([segment.data.tobytes()], pa.binary())})

    return run


def _scored(segments: int, n_tokens: int, n_types: int, shipped, first: bool, s: Settings):
    """Sums for each text of a chunk: exact base figures (in the first pass) and the model's log-probability of the
    pairs in the broadcast share."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, first_bit, bits, low, high = shipped.value
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                c = Chunk.read(row)
                counts = unpacked(row["counts"], np.uint64).astype(np.float64)
                own = (counts + 1) / (n_tokens + n_types + 1)
                pairs, at = np.unique(c.pairs(), return_inverse=True)
                part = _part(pairs & np.uint64(0xFFFFFFFF), segments) - low
                mine = (part >= 0) & (part < high - low)
                found = np.zeros(len(pairs))
                found[mine] = probe_counts(pairs[mine] >> np.uint64(32), data, first_bit[part[mine]], bits[part[mine]], s)
                seen = counts[c.before]
                p = np.log10((np.minimum(found[at], seen) + s.mix * own[c.ids]) / (seen + s.mix))
                p[~mine[at]] = 0.0
                total = lambda x: np.add.reduceat(x, c.starts) if len(c.starts) else np.zeros(0)
                none = np.zeros(len(c.sizes))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(c.sizes), row["chunk"], np.int64)),
                        pa.array(np.arange(len(c.sizes), dtype=np.int32)),
                        pa.array(row["ids"], kind),
                        pa.array(c.sizes if first else none.astype(np.int64)),
                        pa.array(total((counts > 0).astype(np.int64)[c.ids]) if first else none.astype(np.int64)),
                        pa.array(total(np.log10(own)[c.ids]) if first else none),
                        pa.array(total(p)),
                    ],
                    names=["chunk", "place", "id", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def _both(rate):
    """Answer and rate a chunk in one worker; where one share holds the whole filter, nothing is kept in between."""

    def run(key: tuple, chunks: pa.Table, sums: pa.Table) -> pa.Table:
        return pa.Table.from_batches(rate(_answered(key, chunks, sums).to_batches()))

    return run


def score_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_folds: int = 7, held_out: int = 2, s: Settings = Settings()
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from rows whose crc32 of the id as text, modulo ``train_folds``, isn't ``held_out``; all rows are
    scored, repeated ones each on its own. Scores are base-10 logarithms. Null texts are empty ones and hold the end
    alone. Rows with a null id learn and are scored like others (their fold is that of an empty text). Other columns are
    ignored, so their names can't clash. An empty table gives no rows; without training rows every word is unknown.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), (id_fold(F.col(id_col), train_folds) != held_out).alias("train"))
    id_type = rows.schema["id"].dataType.simpleString()
    chunks = durable(_chunked(rows, s))
    n_tokens = chunks.agg(F.sum("n_train")).first()[0] or 0
    ranges = (chunks.agg(F.sum("n_words")).first()[0] or 0) // s.range_words + 1
    asked = mapped(chunks.select("chunk", "hashes", "counts"), _asked(ranges), "range int, chunk long, words binary, n binary")
    sums = durable(asked.groupBy("range").applyInArrow(_added, "range int, chunk long, sums binary, types long"))
    n_types = sums.agg(F.sum("types")).first()[0] or 0
    segments = n_tokens // s.segment_pairs + 1
    pairs = mapped(chunks.select("hashes", "tokens", "sizes", "train"), _paired(segments), "segment int, pairs binary, n binary")
    filled = durable(pairs.groupBy("segment").applyInArrow(_segment(s), "segment int, bits long, data binary"))
    size = {r["segment"]: r["bits"] for r in filled.select("segment", "bits").collect()}
    shares, at = [], 0
    while at < segments:  # segments of at most so many bytes together, one at least
        end, total = at, 0
        while end < segments and (end == at or total + size.get(end, 0) // 8 + 1 <= s.most_broadcast):
            total += size.get(end, 0) // 8 + 1
            end += 1
        shares.append((at, end))
        at = end
    wanted = chunks.select("chunk", "ids", "sizes", "tokens", "hashes", "counts")
    met = wanted.groupBy("chunk").cogroup(sums.select("chunk", "range", "sums").groupBy("chunk"))
    if len(shares) > 1:
        ready = durable(met.applyInArrow(_answered, f"chunk long, ids array<{id_type}>, sizes binary, tokens binary, hashes binary, counts binary"))
    schema = f"chunk long, place int, id {id_type}, n_tokens long, n_known long, base_score double, score double"
    partial = None
    for low, high in shares:
        data, first_bit, bits, offset = [], np.zeros(high - low, np.uint64), np.ones(high - low, np.uint64), 0
        for r in filled.where((F.col("segment") >= low) & (F.col("segment") < high)).toLocalIterator():
            first_bit[r["segment"] - low], bits[r["segment"] - low] = offset, r["bits"]
            data.append(np.frombuffer(r["data"], np.uint8))
            offset += 8 * len(data[-1])
        shipped = spark.sparkContext.broadcast((np.concatenate(data) if data else np.zeros(8, np.uint8), first_bit, bits, low, high))
        rate = _scored(segments, n_tokens, n_types, shipped, low == 0, s)
        scored = mapped(ready, rate, schema) if len(shares) > 1 else met.applyInArrow(_both(rate), schema)
        partial = scored if partial is None else partial.unionByName(scored)
    if len(shares) > 1:
        partial = partial.groupBy("chunk", "place", "id").agg(*[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")])
    return partial.select(
        F.col("id").alias(id_col),
        (id_fold(F.col("id"), train_folds) == held_out).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
