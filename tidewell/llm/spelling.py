"""Spelling variant grouping: distance-one Levenshtein automata walked over compact trie shards.

Words are counted over all texts, sorted by length and spelling and cut into shards. A shard is a trie in arrays: nodes
level by level, so that the children of a node stand together; one byte a label, one number a node. A word meets the
shards of its own length and of those one shorter and one longer. Its automaton goes over such a shard depth-first:
along the word itself as far as the shard goes, and from each node there once off it, by each edit, after which the rest
has to fit. Of each word and shard only the number of neighbours and the best one come back, so pairs are never shuffled.

The shards are broadcast where a look at all of them shows that they are small, and joined by their number otherwise.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, lower_ascii, mapped, small

#: Letters of words: those of ASCII and Latin-1 from U+00C0 on, so a letter is one byte of Latin-1.
LETTERS = "[a-zÀ-ÿ]+"
#: Words of a shard at most.
SHARD_WORDS = 1 << 14


def without(word: Column, place: Column) -> Column:
    """``word`` without its code point at ``place`` (from 0)."""
    return F.concat(word.substr(F.lit(1), place), word.substr(place + 2, F.char_length(word)))


def word_counts(docs: DataFrame, shortest: int = 5, least: int = 3, noise: int = 97) -> DataFrame:
    """``word, n``: lower-cased runs of letters, of ``shortest`` code points and ``least`` occurrences at least.

    A run in whose document the crc32 of ``<doc_id>:<run>`` is divided by ``noise`` loses a code point first. Null texts
    have no words; a null id is written as nothing.
    """
    run = F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(LETTERS), F.lit(0)))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run")).where(F.char_length("run") >= shortest)
    hashed = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    word = F.when(F.col("h") % noise == 0, without(F.col("run"), (F.col("h") % F.char_length("run")).cast("int"))).otherwise(F.col("run"))
    counts = hashed.select(word.alias("word")).where(F.char_length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least)


class Trie:
    """A shard of words of one length, sorted, with their counts."""

    def __init__(self, size: int, labels: bytes, starts: np.ndarray, counts: np.ndarray):
        self.size, self.labels, self.counts = size, labels, counts.tolist()
        self.starts = starts.tolist()  # of node v the children are starts[v] up to starts[v + 1]; the last level has none
        self.first = len(labels) - len(self.counts)  # node of the first word
        self.roots = self.starts[0] if size > 1 else len(labels)

    @staticmethod
    def packed(words: np.ndarray, counts: np.ndarray) -> bytes:
        """Bytes of the trie of a matrix of sorted, distinct words, a row each."""
        n, size = words.shape
        changes = words[1:] != words[:-1]
        first = changes.argmax(1) if n > 1 else np.zeros(0, np.int64)  # where a word leaves the one before
        levels = [np.concatenate(([0], np.nonzero(first <= d)[0] + 1)) for d in range(size)]
        ends = np.cumsum([len(x) for x in levels])
        labels = np.concatenate([words[rows, d] for d, rows in enumerate(levels)])
        starts = [ends[d] + np.searchsorted(levels[d + 1], levels[d]) for d in range(size - 1)]
        starts = np.concatenate([*starts, [ends[-1]]]).astype(np.uint32)
        return struct.pack("<III", size, len(labels), n) + labels.tobytes() + starts.tobytes() + counts.astype(np.int64).tobytes()

    @staticmethod
    def unpacked(data: bytes) -> Trie:
        size, nodes, n = struct.unpack_from("<III", data)
        at = 12 + nodes
        many = nodes - n + 1
        return Trie(size, data[12:at], np.frombuffer(data, np.uint32, many, at), np.frombuffer(data, np.int64, n, at + 4 * many))

    def near(self, word: bytes) -> dict[int, bytes]:
        """The shard's words at one edit from ``word``, by their place in the shard."""
        found: dict[int, bytes] = {}
        find, starts, first, size, long = self.labels.find, self.starts, self.first, self.size, len(word)
        kind = size - long  # the only edit that leads to this length
        if not -1 <= kind <= 1:
            return found
        node, low, high = -1, 0, self.roots
        for i in range(long + 1):
            # the word's first i letters were met on the way to ``node``, whose children are low up to high
            if kind == -1:
                v, a, b = node, low, high
                for k in range(i + 1, long):
                    v = find(word[k], a, b)
                    if v < 0:
                        break
                    if v < first:
                        a, b = starts[v], starts[v + 1]
                else:
                    if v >= first:
                        found[v - first] = word[:i] + word[i + 1 :]
            else:
                if kind == 0 and i == long:
                    break
                own = word[i] if kind == 0 else -1
                after = i + 1 if kind == 0 else i
                for child in range(low, high):
                    label = self.labels[child]
                    if label == own:
                        continue
                    v = child
                    for k in range(after, long):
                        v = find(word[k], starts[v], starts[v + 1])
                        if v < 0:
                            break
                    else:
                        found[v - first] = word[:i] + bytes((label,)) + word[after:]
            if i == long:
                break
            node = find(word[i], low, high)
            if node >= first and kind == -1:  # all but the last letter
                found[node - first] = word[: i + 1]
            if node < 0 or node >= first:
                break
            low, high = starts[node], starts[node + 1]
        return found

    def common(self) -> bytes:
        """The first letters that all words share."""
        out, low, high = b"", 0, self.roots
        while high - low == 1:
            out += self.labels[low : low + 1]
            if low >= self.first:
                break
            low, high = self.starts[low], self.starts[low + 1]
        return out


def _matrix(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def shards(words: DataFrame) -> DataFrame:
    """``shard, size, words, trie`` from ``word, n`` with distinct words; ``words`` are a shard's words one after another."""
    parts = max(1, -(-words.count() // SHARD_WORDS))
    ordered = words.select(F.char_length("word").alias("size"), "word", "n").repartitionByRange(parts, "size", "word")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[str] = []
        counts: list[int] = []

        def packed() -> pa.RecordBatch:
            m = _matrix(kept)
            return pa.RecordBatch.from_pydict({"size": pa.array([m.shape[1]], pa.int32()), "words": [m.tobytes()], "trie": [Trie.packed(m, np.array(counts, np.int64))]})

        for batch in batches:
            for word, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if kept and (len(kept) == SHARD_WORDS or len(kept[0]) != len(word)):
                    yield packed()
                    kept, counts = [], []
                kept.append(word)
                counts.append(n)
        if kept:
            yield packed()

    made = mapped(ordered.sortWithinPartitions("size", "word"), run, "size int, words binary, trie binary")
    return durable(made.withColumn("shard", F.monotonically_increasing_id()))


def neighbours(made: DataFrame) -> DataFrame:
    """``word, n_near, best, best_n`` for each word and shard that has neighbours of it: their number and, of those that
    occur most, the first in code-point order."""
    places = F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))
    asked = made.select("words", F.col("size").alias("own"), places.alias("size"))
    meets = asked.join(F.broadcast(made.select("size", "shard")), "size")  # two numbers a shard of thousands of words
    pairs = meets.join(small(made.select("shard", "trie")), "shard").select("words", "own", "trie")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, long, packed in zip(*(c.to_pylist() for c in batch.columns)):
                trie = Trie.unpacked(packed)
                m = np.frombuffer(data, np.uint8).reshape(-1, long)
                common = trie.common()
                alive = np.arange(len(m))
                if len(common) > 1:  # of the first two letters an edit leaves one, here or one place on
                    a, b = common[0], common[1]
                    alive = np.nonzero((m[:, 0] == a) | (m[:, 1] == b) | (m[:, 0] == b) | (m[:, 1] == a))[0]
                out: list[tuple[str, int, str, int]] = []
                for k in alive.tolist():
                    word = data[k * long : (k + 1) * long]
                    near = trie.near(word)
                    if near:
                        counts = trie.counts
                        best = min(near, key=lambda r: (-counts[r], r))
                        out.append((word.decode("latin-1"), len(near), near[best].decode("latin-1"), counts[best]))
                if out:
                    w, n, best, best_n = zip(*out)
                    yield pa.RecordBatch.from_pydict({"word": w, "n_near": pa.array(n, pa.int64()), "best": best, "best_n": pa.array(best_n, pa.int64())})

    return mapped(pairs, run, "word string, n_near long, best string, best_n long")


def roots(links: DataFrame, most_n: int) -> DataFrame:
    """``word, root`` for each row of ``word, form``: the end of its chain of forms.

    A form occurs twice as often as its word at least, so chains are no longer than the binary logarithm of ``most_n``;
    each round doubles the way that is known.
    """
    jumps = links.select("word", F.col("form").alias("root"))
    for _ in range(max(1, most_n).bit_length().bit_length()):
        on = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumps = durable(jumps.join(small(on), "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return jumps


def spelling_variants(docs: DataFrame, shortest: int = 5, least: int = 3, noise: int = 97, times: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``word_counts``.

    ``form`` is the neighbour with most occurrences (of ties the first in code-point order) if it occurs ``times`` times
    as often as the word at least, else null; ``root`` the end of the chain of forms, the word itself if it has none.
    Only ``doc_id`` and ``text`` are read. Rows that repeat count as often as they are there; tables without words give no
    rows.
    """
    words = durable(word_counts(docs.select("doc_id", "text"), shortest, least, noise))
    found = neighbours(shards(words))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("form")))
    reduced = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    joined = words.join(reduced, "word", "left").withColumn("taken", -F.col("best.less") >= F.col("n") * times)
    formed = durable(
        joined.select("word", F.when(F.col("taken"), F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("taken"), -F.col("best.less")).alias("form_n"))
    )
    most_n = words.agg(F.max("n")).first()[0] or 0
    ends = roots(formed.where("form IS NOT NULL"), most_n)
    return formed.join(small(ends), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
