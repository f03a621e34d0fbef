"""Byte-level BPE encoding and decoding with a minimal acyclic transducer lexicon.

The frequent words of a corpus are compiled, with their ids as outputs, into a minimal acyclic subsequential
transducer: states that accept the same suffixes with the same outputs are shared, and outputs stand as early on
the path as they can. Its arrays are laid out in one byte string which each worker writes to a file of its own and
maps into memory. A word that the transducer doesn't accept is merged exactly, pair by pair.

Text is cut in two steps. A space that stands before a character other than white space always begins a new word of
the pre-tokenizer's pattern, so texts are split there first and the pieces (few of them distinct) are remembered in a
cache of bounded size. A piece that isn't in the cache is put together from the parts that are words whatever stands
around them (a word of letters, the marks at its end, what follows a line break), which are remembered themselves; only
other pieces are cut by the pattern and looked up word by word.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import string
import struct
import tempfile
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, mapped

#: Cuts text into words. Fixed value of the byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORDS = regex.compile(PATTERN)
#: Marks that may end a piece: after a letter, any run of them is one word.
MARKS = string.punctuation
#: A space after which the text can't simply be cut.
ODD_SPACE = re.compile(r" (?:\s|\Z)")
#: A line break that isn't a word of its own.
ODD_BREAK = re.compile(r"\s\n|\n\s")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, and that byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a ``tokenizers`` JSON file of a byte-level BPE model."""

    def __init__(self, text: bytes):
        spec = json.loads(text)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: raw(t) for t, i in ids.items() if t not in self.special}
        self.of_byte = [0] * 256
        for i, b in self.bytes_of.items():
            if len(b) == 1:
                self.of_byte[b[0]] = i
        self.rank: dict[int, int] = {}  # of a pair of ids, as one number
        self.made: list[int] = []
        for pair in spec["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[ids[a] << 32 | ids[b]] = len(self.made)
            self.made.append(ids[a + b])
        self.none = len(self.made)  # the rank of pairs that don't merge

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word, by repeatedly joining the adjacent pair of least rank (of several, the leftmost)."""
        parts, rank, none = [*map(self.of_byte.__getitem__, word)], self.rank.get, self.none
        if len(parts) > 64:
            return self._merge_long(parts)
        ranks = [rank(a << 32 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != none:
            k = ranks.index(best)
            parts[k : k + 2] = [self.made[best]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank(parts[k - 1] << 32 | parts[k], none)
            if k < len(ranks):
                ranks[k] = rank(parts[k] << 32 | parts[k + 1], none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        left, right = [*range(-1, n - 1)], [*range(1, n + 1)]
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and (found := self.rank.get(parts[i] << 32 | parts[j], self.none)) != self.none:
                heapq.heappush(queue, (found, i, parts[i], parts[j]))

        for i in range(n):
            offer(i)
        while queue:
            found, i, a, b = heapq.heappop(queue)
            j = right[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j], right[i] = self.made[found], -1, right[j]
            if right[i] < n:
                left[right[i]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [p for p in parts if p >= 0]


class _State:
    __slots__ = ("arcs", "final", "last")

    def __init__(self):
        self.arcs: dict[int, list] = {}  # label -> [target, outputs]
        self.final: tuple | None = None
        self.last = -1

    def key(self) -> tuple:
        return (self.final, *((b, id(t), o) for b, (t, o) in self.arcs.items()))


def compile_lexicon(entries: dict[bytes, tuple[int, ...]]) -> bytes:
    """A minimal acyclic subsequential transducer from words to id sequences, as one byte string.

    Words are added in order; when a word leaves the path of the one before, the states below the fork can't change
    any more and are replaced by equal ones that exist.
    """
    root, register = _State(), {}
    path: list[tuple[_State, int]] = []  # (state, label) from the root along the last word

    def freeze(down_to: int) -> None:
        while len(path) > down_to:
            state, label = path.pop()
            arc = state.arcs[label]
            arc[0] = register.setdefault(arc[0].key(), arc[0])

    before = b""
    for word in sorted(w for w in entries if w):
        out, shared = tuple(entries[word]), 0
        while shared < min(len(before), len(word)) and before[shared] == word[shared]:
            shared += 1
        freeze(shared)
        state = root
        for b in word[:shared]:  # outputs that this word doesn't begin with move on to the next arcs
            arc = state.arcs[b]
            n = 0
            while n < min(len(arc[1]), len(out)) and arc[1][n] == out[n]:
                n += 1
            if rest := arc[1][n:]:
                arc[1] = arc[1][:n]
                for later in arc[0].arcs.values():
                    later[1] = rest + later[1]
                if arc[0].final is not None:
                    arc[0].final = rest + arc[0].final
            out, state = out[n:], arc[0]
        for b in word[shared:]:
            new = _State()
            state.arcs[b] = [new, out]
            out = ()
            path.append((state, b))
            state = new
        state.final = out
        before = word
    freeze(0)

    order, numbers, todo = [], {}, [root]
    while todo:
        state = todo.pop()
        if id(state) not in numbers:
            numbers[id(state)] = len(order)
            order.append(state)
            todo.extend(t for t, _ in state.arcs.values())
    pool, places = array("I"), {}

    def place(ids: tuple) -> tuple[int, int]:
        if ids not in places:
            places[ids] = len(pool)
            pool.extend(ids)
        return places[ids], len(ids)

    first, labels, target = array("I", [0]), bytearray(), array("I")
    arc_at, arc_n, end_at, end_n = array("I"), array("I"), array("I"), array("I")
    for state in order:
        for b, (t, ids) in sorted(state.arcs.items()):
            labels.append(b)
            target.append(numbers[id(t)])
            at, n = place(ids)
            arc_at.append(at)
            arc_n.append(n)
        first.append(len(labels))
        at, n = (0, 0) if state.final is None else place(state.final)
        end_at.append(at)
        end_n.append(n + 1 if state.final is not None else 0)
    labels.extend(b"\0" * (-len(labels) % 4))
    blocks = [first, target, arc_at, arc_n, end_at, end_n, pool]
    head = struct.pack("<8I", *[len(x) for x in blocks], len(labels))
    return head + b"".join(x.tobytes() for x in blocks) + bytes(labels)


class Lexicon:
    """A compiled lexicon, mapped into memory from a nameless file of this machine."""

    def __init__(self, compiled: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(compiled)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = struct.unpack_from("<8I", self.map)
        view, at, parts = memoryview(self.map), 32, []
        for n in sizes[:7]:
            parts.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.target, self.arc_at, self.arc_n, self.end_at, self.end_n, _ = parts
        self.pool, self.labels, self.states, self.arcs = at - 4 * sizes[6], at, sizes[4], sizes[1]

    def ids(self, word: bytes) -> bytes | None:
        """The ids of a word as little-endian 32-bit integers, or None if the lexicon doesn't hold it."""
        state, out, find, base, pool = 0, [], self.map.find, self.labels, self.pool
        for k in range(len(word)):
            arc = find(word[k : k + 1], base + self.first[state], base + self.first[state + 1]) - base
            if arc < 0:
                return None
            if n := self.arc_n[arc]:
                at = pool + 4 * self.arc_at[arc]
                out.append(self.map[at : at + 4 * n])
            state = self.target[arc]
        n = self.end_n[state]
        if not n:
            return None
        at = pool + 4 * self.end_at[state]
        out.append(self.map[at : at + 4 * (n - 1)])
        return b"".join(out)


class _Pieces(dict):
    """Ids of pieces of text, as bytes. A piece begins with a space, which is left out, or with a line break."""

    def __init__(self, encoder: Encoder, most: int):
        self.encoder, self.most = encoder, most

    def __missing__(self, piece: str) -> bytes:
        lines = piece.split("\n")
        if len(lines) > 1 and piece[0] != "\n" and "" not in lines and not ODD_BREAK.search(piece):
            # not remembered as a whole: ends and starts of lines seldom meet twice
            return self[lines[0]] + b"".join([self["\n" + line] for line in lines[1:]])
        word = piece.rstrip(MARKS)
        if word.isalpha():  # a word of letters
            ids = self.encoder.encode_word(" " + word) if word is piece else self[word] + self._marks(piece[len(word) :])
        elif word[:1] == "\n" and word[1:].isalpha():  # one at the start of a line, where no space belongs to it
            ids = self.encoder.line_break + self.encoder.encode_word(word[1:]) if word is piece else self[word] + self._marks(piece[len(word) :])
        elif piece[:1] == "\n":
            ids = self.encoder.encode_run(piece)
        else:
            ids = self.encoder.encode_run(" " + piece)
        self._keep(piece, ids)
        return ids

    def _marks(self, marks: str) -> bytes:
        key = "\n\n" + marks  # no piece begins so
        ids = self.get(key)
        if ids is None:
            ids = self.encoder.encode_word(marks)
            self._keep(key, ids)
        return ids

    def _keep(self, key: str, ids: bytes) -> None:
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = ids


class Encoder:
    """Encodes and decodes whole texts. ``cache`` bounds the pieces that are remembered."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None, cache: int = 500_000):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.pieces = _Pieces(self, cache)
        self.line_break = struct.pack("<I", vocabulary.of_byte[ord("\n")])
        self.special = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.token_bytes = vocabulary.bytes_of | {i: t.encode() for t, i in vocabulary.special.items()}

    def encode_word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "replace")
        found = self.lexicon.ids(raw) if self.lexicon else None
        if found is None:
            ids = self.vocabulary.merge(raw)
            found = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def encode_run(self, text: str) -> bytes:
        return b"".join(map(self.encode_word, WORDS.findall(text)))

    def _encode(self, text: str) -> bytes:
        if ODD_SPACE.search(text):
            cuts = regex.split(r" (?=\S)", text)
        else:
            cuts = text.split(" ")
        head = self.encode_run(cuts[0]) if cuts[0] else b""
        return head + b"".join(map(self.pieces.__getitem__, cuts[1:]))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Special tokens' strings become their ids."""
        if self.special is None or not self.special.search(text):
            return self._encode(text)
        known = self.vocabulary.special
        return b"".join(struct.pack("<I", known[x]) if x in known else self._encode(x) for x in self.special.split(text) if x)

    def decode(self, ids: bytes) -> str:
        """The text of all ids, special ones too; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, array("I", ids))).decode("utf-8", "replace")


class TiktokenEncoder(Encoder):
    """The same ids; words that aren't in the cache are merged by the ``tiktoken`` library."""

    def __init__(self, vocabulary: Vocabulary, cache: int = 500_000):
        super().__init__(vocabulary, None, cache)
        import tiktoken

        ranks = {b: i for i, b in vocabulary.bytes_of.items()}
        assert vocabulary.made == sorted(vocabulary.made), "ids must stand in the order of merges"
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def encode_run(self, text: str) -> bytes:
        ids = self.core.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    encode_word = encode_run


def shared_encoder(vocabulary: bytes, lexicon: bytes | None, kind: str = "own", cache: int = 1_000_000) -> Encoder:
    """One encoder for a worker process, so that tasks after the first find its cache filled. ``cache`` bounds it; a full
    one of a million pieces takes some 200 MB."""

    def make() -> Encoder:
        v = Vocabulary(vocabulary)
        return TiktokenEncoder(v, cache) if kind == "tiktoken" else Encoder(v, Lexicon(lexicon) if lexicon else None, cache)

    return kept((kind, hashlib.md5(vocabulary).digest(), hashlib.md5(lexicon or b"").digest()), make)


def _count_words(most: int, at_once: int = 300_000):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, words = Counter(), Counter()

        def settle() -> None:
            for piece, n in pieces.items():
                if n > 1:  # what is met once among so many pieces is no frequent word
                    for w in WORDS.findall(" " + piece):
                        words[w] += n
            pieces.clear()
            if len(words) > at_once:  # the rarest words of a task can't be frequent words of the corpus
                kept = words.most_common(at_once // 2)
                words.clear()
                words.update(dict(kept))

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    pieces.update(text.split(" "))
                    if len(pieces) > at_once:
                        settle()
        settle()
        top = words.most_common(most)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"]
        )

    return run


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = 32_768) -> list[str]:
    """The most frequent words of all rows, in order. Which words are chosen changes speed only, never ids.

    Each task counts all its texts and hands on at most ``most`` words, so the result is bounded.
    """
    counted = mapped(docs.select(F.col(text_col).cast("string")), _count_words(most), "word string, n long")
    return [r["word"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most).collect()]


def lexicon_for(words: Iterable[str], vocabulary: Vocabulary) -> bytes:
    return compile_lexicon({w.encode("utf-8", "replace"): tuple(vocabulary.merge(w.encode("utf-8", "replace"))) for w in words})


def encode_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = 32_768) -> DataFrame:
    """One row per document: ``id_col, ids (array<int>), decoded``.

    Null texts count as empty, which have no ids; rows may repeat, and an empty table gives no rows; other columns are
    ignored. The vocabulary and the lexicon are of
    bounded size and travel to the workers as broadcast variables.
    """
    return _mapped(docs, vocabulary_path, id_col, text_col, lexicon_words, _ids_and_text, "ids array<int>, decoded string")


def encode_digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = 32_768) -> DataFrame:
    """As ``encode_decode``, but ``id_col, n_tokens, ids_sha256, decoded_sha256`` in place of ids and text."""
    return _mapped(docs, vocabulary_path, id_col, text_col, lexicon_words, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _ids_and_text(encoder: Encoder, texts: list) -> list[pa.Array]:
    ids = [encoder.encode(t or "") for t in texts]
    return [pa.array([array("I", x).tolist() for x in ids], pa.list_(pa.int32())), pa.array([encoder.decode(x) for x in ids], pa.string())]


def _digests(encoder: Encoder, texts: list) -> list[pa.Array]:
    ids = [encoder.encode(t or "") for t in texts]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return [
        pa.array([len(x) // 4 for x in ids], pa.int64()),
        pa.array([sha(x) for x in ids], pa.string()),
        pa.array([sha(encoder.decode(x).encode()) for x in ids], pa.string()),
    ]


def _mapped(docs: DataFrame, vocabulary_path: str, id_col: str, text_col: str, lexicon_words: int, make, schema: str) -> DataFrame:
    with open(vocabulary_path, "rb") as f:
        spec = f.read()
    vocabulary = Vocabulary(spec)
    lexicon = lexicon_for(frequent_words(docs, text_col, lexicon_words), vocabulary)
    shipped = docs.sparkSession.sparkContext.broadcast((spec, lexicon))
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("__text"))
    names = [id_col, *[x.split()[0] for x in schema.split(", ")]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(*shipped.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *make(encoder, batch.column(1).to_pylist())], names=names)

    return mapped(rows, run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, {schema}")
