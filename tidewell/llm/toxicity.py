"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams (hashed) and of the word itself; a window of words is
the mean of its words; a linear softmax over the window gives the two classes. Embeddings and softmax are trained
together. Because n-grams are shared, misspelt or inflected words that were never seen get the vectors of their parts.

A text is as toxic as its worst windows, one in a hundred words' worth of them and one at least: a few bad words aren't
averaged away, and one odd word doesn't condemn a long text. Only texts are labelled, so training alternates between
choosing windows (of toxic texts those that score highest, of clean ones the highest and some others) and fitting on
them. Last, a slope and an offset are fitted on texts held back from the rounds, from a text's pooled windows to the
label, so that 0.5 is the place to cut.

For scoring, the softmax is multiplied into the embeddings: one number for each n-gram bucket and a bias, a few hundred
KB, are broadcast.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_fold, kept, mapped, py_fold, tidy

PARTS = re.compile(r"[^\W_]+")
EDGES = ".,;:!?\"'()[]{}<>*%&$#…«»¿¡"


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17
    dimensions: int = 8
    shortest: int = 3
    longest: int = 6
    window: int = 2  # words at least; windows are dealt evenly
    share: float = 0.01  # of a text's words, as many of its windows are pooled
    train_rows: int = 4_000  # at most so many labelled rows are learnt from
    train_chars: int = 65_536  # longer texts aren't learnt from; all are scored
    rounds: int = 6
    steps: int = 15
    rate: float = 0.04
    decay: float = 2e-4
    least_texts: int = 5  # n-grams in fewer labelled texts carry no weight
    seed: int = 17


@dataclass(frozen=True)
class Model:
    """What scoring needs; ``slope`` and ``offset`` turn pooled windows into log-odds."""

    settings: Settings
    weights: np.ndarray  # of each bucket
    bias: float
    slope: float
    offset: float

    def probability(self, highest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * highest + self.offset, -60, 60)))


#: Runs of more characters than ``LONGEST_WORD`` are read as pieces of ``PIECE`` characters, one every ``STEP``. The
#: overlap is longer than any n-gram, so no n-gram of a run is missed.
LONGEST_WORD, PIECE, STEP = 62, 16, 8


def pieces(run: str) -> list[str]:
    """The words of a long run, where letters and digits are joined by other characters, and overlapping pieces of all of it."""
    found = [run[k : k + PIECE] for k in range(0, len(run) - PIECE + STEP, STEP)]
    parts = PARTS.findall(run)
    if len(parts) > 1 or parts and len(parts[0]) < len(run):
        found += [w for w in parts if len(w) <= LONGEST_WORD]  # longer ones lie in the pieces
    return found


def tokens(text: str | None) -> list[str]:
    """The words of a text, long runs without a space as their pieces."""
    words = (text or "").lower().split()
    if not words or max(map(len, words)) <= LONGEST_WORD:
        return words
    return [p for w in words for p in ([w] if len(w) <= LONGEST_WORD else pieces(w))]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


#: Odd multipliers, one for each place in a word.
POWERS = np.cumprod(np.full(80, 0x9E3779B97F4A7C15, np.uint64))


#: Words whose n-grams are worked out at once.
BLOCK = 1 << 14

#: Windows that training scores and chooses from at once.
WINDOWS = 1 << 15


def bags(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every n-gram of every word (as ``tokens`` gives them) and of the words themselves, in
    order of the words."""
    found = [_bags(words[k : k + BLOCK], s) for k in range(0, len(words), BLOCK)] or [_bags([], s)]
    return np.concatenate([o + np.int32(k * BLOCK) for k, (o, _) in enumerate(found)]), np.concatenate([b for _, b in found])


def _bags(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    marked = [f"<{w.strip(EDGES) or w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    owner, starts = np.repeat(np.arange(len(marked)), sizes), np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - starts[owner]
    left = sizes[owner] - place
    owners, buckets = [], []
    for k in range(s.shortest, s.longest + 1):
        at = np.nonzero(left >= k)[0]
        h = np.full(len(at), k, np.uint64)
        for j in range(k):
            h += (codes[at + j] + np.uint64(1)) * POWERS[j]
        owners.append(owner[at])
        buckets.append((_mixed(h) % np.uint64(s.buckets)).astype(np.int32))
    if len(marked):
        owners.append(np.arange(len(marked)))
        buckets.append((_mixed(np.add.reduceat((codes + np.uint64(1)) * POWERS[place + 8], starts)) % np.uint64(s.buckets)).astype(np.int32))
    every = np.concatenate(owners or [np.zeros(0, np.int64)]).astype(np.int32)
    order = np.argsort(every, kind="stable")
    return every[order], np.concatenate(buckets or [np.zeros(0, np.int32)]).astype(np.int32)[order]


def window_ends(n: int, size: int) -> np.ndarray:
    """Starts of the windows over ``n`` words, evenly dealt."""
    k = max(1, n // size)
    return (np.arange(k) * n) // k


def pooled(scores: np.ndarray, words: int, share: float) -> float:
    """The mean of the highest windows, one for each ``1 / share`` words."""
    m = min(len(scores), max(1, int(words * share)))
    return float(scores.max()) if m == 1 else float(np.partition(scores, len(scores) - m)[-m:].mean())


class _Corpus:
    """Labelled texts as windows of word numbers, words as bags of buckets."""

    def __init__(self, texts: list[str], s: Settings):
        numbers: dict[str, int] = {}
        ids, sizes, owner = array("i"), array("i"), array("i")
        for d, text in enumerate(texts):
            row = [numbers.setdefault(w, len(numbers)) for w in tokens(text)]
            if not row:
                continue
            starts = window_ends(len(row), s.window)
            ids.extend(row)
            sizes.extend(np.diff(np.append(starts, len(row))).tolist())
            owner.extend([d] * len(starts))
        words, sizes_of, buckets = list(numbers), [np.zeros(0, np.int64)], array("i")
        del numbers
        for k in range(0, len(words), BLOCK):
            part = words[k : k + BLOCK]
            owner_of, found = _bags(part, s)
            sizes_of.append(np.bincount(owner_of, minlength=len(part)))
            buckets.frombytes(found.tobytes())
        self.words, self.sizes, self.owner = np.asarray(ids), np.asarray(sizes), np.asarray(owner)  # not copied
        self.starts = (np.cumsum(self.sizes, dtype=np.int64) - self.sizes).astype(np.int32)  # words are fewer than 2**31
        self.bag_sizes, self.bags = np.concatenate(sizes_of), np.asarray(buckets)
        self.bag_starts = np.cumsum(self.bag_sizes) - self.bag_sizes

    def log_odds(self, y: np.ndarray, own: np.ndarray, buckets: int, least: int) -> np.ndarray:
        """Of each bucket: how much more often toxic texts hold it than clean ones; 0 for those in few texts."""
        counts = np.zeros((2, buckets))
        edges = np.append(self.starts, len(self.words))[self.edges(len(y))]
        for d in np.nonzero(own)[0]:
            words = np.unique(self.words[edges[d] : edges[d + 1]])
            counts[y[d], np.unique(self.bags[_ranges(self.bag_starts[words], self.bag_sizes[words])])] += 1
        n0, n1 = max(1, ((y == 0) & own).sum()), max(1, ((y == 1) & own).sum())
        odds = np.log((counts[1] + 0.5) / (n1 + 1)) - np.log((counts[0] + 0.5) / (n0 + 1))
        return np.where(counts.sum(0) >= least, odds, 0.0)

    def edges(self, texts: int) -> np.ndarray:
        """The first window of each text and the end; windows of a text stand together."""
        return np.searchsorted(self.owner, np.arange(texts + 1))

    def parts(self, texts: int) -> Iterator[slice]:
        """The windows of consecutive texts, some ten thousands at a time, so that what is worked out for each window
        doesn't lie in the driver for all at once."""
        edges, first = self.edges(texts), 0
        for d in range(1, texts + 1):
            if edges[d] - edges[first] >= WINDOWS or d == texts and edges[d] > edges[first]:
                yield slice(int(edges[first]), int(edges[d]))
                first = d

    def word_means(self, weights: np.ndarray) -> np.ndarray:
        """The mean of each word, for one weight a bucket."""
        if not len(self.bag_sizes):
            return np.zeros(0)
        light, out = weights.astype(np.float32), []
        for k in range(0, len(self.bag_sizes), BLOCK):
            sizes, starts = self.bag_sizes[k : k + BLOCK], self.bag_starts[k : k + BLOCK]
            out.append(np.add.reduceat(light[self.bags[starts[0] : starts[-1] + sizes[-1]]], starts - starts[0]) / sizes)
        return np.concatenate(out)

    def scores(self, means: np.ndarray, at: slice) -> np.ndarray:
        """The mean of each window of ``at``, for one number a word."""
        first, last = self.starts[at.start], self.starts[at.stop - 1] + self.sizes[at.stop - 1]
        return np.add.reduceat(means[self.words[first:last]], self.starts[at] - first) / self.sizes[at]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the given ranges, one after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _fit(c: _Corpus, chosen: np.ndarray, y: np.ndarray, e: np.ndarray, w: np.ndarray, b: np.ndarray, s: Settings) -> None:
    """Descent with momentum on all chosen windows at once; embeddings ``e``, softmax ``w`` and ``b`` change in place."""
    sizes = c.sizes[chosen]
    words = c.words[_ranges(c.starts[chosen], sizes)]
    used, at = np.unique(words, return_inverse=True)
    bag_sizes = c.bag_sizes[used]
    bags = c.bags[_ranges(c.bag_starts[used], bag_sizes)]
    rows, bag_at = np.unique(bags, return_inverse=True)
    firsts, bag_firsts = np.cumsum(sizes) - sizes, np.cumsum(bag_sizes) - bag_sizes
    blocks = [(slice(k, k + BLOCK // 8), int(bag_firsts[k]), int((bag_firsts + bag_sizes)[k : k + BLOCK // 8][-1])) for k in range(0, len(used), BLOCK // 8)]
    live = (e[rows] != 0).any(1)[:, None]
    of_window, of_word = np.repeat(np.arange(len(chosen)), sizes), np.repeat(np.arange(len(used)), bag_sizes)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    params = [e[rows], w, b]
    speeds = [np.zeros_like(p) for p in params]
    for step in range(1, s.steps + 1):
        emb = params[0]
        word = np.concatenate([np.add.reduceat(emb[bag_at[a:z]], bag_firsts[at_once] - a, axis=0) for at_once, a, z in blocks]) / bag_sizes[:, None]
        x = np.add.reduceat(word[at], firsts, axis=0) / sizes[:, None]
        z = x @ params[1].T + params[2]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= weight[:, None]
        g_x = (p @ params[1]) / sizes[:, None]
        g_emb = np.empty_like(emb)
        for d in range(emb.shape[1]):
            g_word = np.bincount(at, g_x[of_window, d], len(used)) / bag_sizes
            g_emb[:, d] = np.bincount(bag_at, g_word[of_word], len(rows))
        grads = [g_emb * live, p.T @ x + s.decay * params[1], p.sum(0)]
        for k, g in enumerate(grads):  # in proportion to the gradient, so what few windows hold hardly moves
            speeds[k] = 0.9 * speeds[k] - s.rate * g / (np.abs(g).max() + 1e-12)
            params[k] += speeds[k]
    e[rows], w[:], b[:] = params[0], params[1], params[2]


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit by Newton's method, with a weak pull to zero; the slope stays positive."""
    scale = max(1e-9, float(np.std(x)) if len(x) else 1.0)
    z, theta = x / scale, np.array([1.0, 0.0])
    a = np.stack([z, np.ones_like(z)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + np.eye(2) * 1e-2
        theta = theta - np.clip(np.linalg.solve(h, a.T @ (p - y) + 1e-2 * theta), -2, 2)
    return max(float(theta[0]), 1e-3) / scale, float(theta[1])


def _runs(owner: np.ndarray) -> list[tuple[int, int]]:
    """Where each text's windows begin and end."""
    firsts = np.nonzero(np.diff(owner, prepend=-1))[0]
    return list(zip(firsts.tolist(), [*firsts[1:].tolist(), len(owner)]))


def _chosen(c: _Corpus, score: np.ndarray, at: slice, y: np.ndarray, own: np.ndarray, rng: np.random.Generator, s: Settings) -> np.ndarray:
    """The windows of ``at`` to fit on next: of toxic texts those that score highest, of clean ones the highest and some others."""
    owner = c.owner[at] - c.owner[at.start]
    order = np.lexsort((-score, owner))
    firsts = np.r_[True, np.diff(owner[order]) != 0]
    place = np.empty(len(score), np.int64)  # of a window in its text, by score
    place[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(firsts, np.arange(len(order)), 0))
    per_text, words = np.bincount(owner)[owner], np.bincount(owner, c.sizes[at])[owner]
    take = np.where(y[c.owner[at]] == 1, place < np.maximum(1, words * s.share), (place < np.maximum(2, words * s.share)) | (rng.random(len(score)) < 1.0 / per_text))
    return at.start + np.nonzero(take & own[c.owner[at]])[0]


def train(texts: list[str], labels: list[int], held_back: list[bool], s: Settings = Settings()) -> Model:
    """Fit on the texts; those held back serve the calibration only. Without both classes, all texts score alike."""
    rng = np.random.default_rng(s.seed)
    y = np.array(labels, np.int64).reshape(-1)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.01
        return Model(s, np.zeros(s.buckets, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    c, n = _Corpus(texts, s), len(texts)
    tidy()
    own = ~np.array(held_back, bool)
    # embeddings begin as noise around the log-odds of their n-gram along one direction, which the softmax reads
    odds = c.log_odds(y, own, s.buckets, s.least_texts)
    u = rng.normal(0, 1, s.dimensions)
    u /= np.linalg.norm(u)
    e = (odds[:, None] * u + rng.normal(0, 0.02, (s.buckets, s.dimensions))) * (odds != 0)[:, None]
    w, b = np.stack([-u, u]), np.zeros(2)
    for r in range(s.rounds):
        means = c.word_means(e @ (w[1] - w[0]))
        chosen = np.concatenate([np.zeros(0, np.int64), *[_chosen(c, c.scores(means, at), at, y, own, rng, s) for at in c.parts(n)]])
        if len(chosen):
            _fit(c, chosen, y[c.owner[chosen]], e, w, b, s)
        tidy()
    weights, bias = e @ (w[1] - w[0]), float(b[1] - b[0])
    means = c.word_means(weights)
    highest = np.full(n, bias)
    for at in c.parts(n):
        score, owner, sizes = c.scores(means, at) + bias, c.owner[at], c.sizes[at]
        for first, last in _runs(owner):
            highest[owner[first]] = pooled(score[first:last], int(sizes[first:last].sum()), s.share)
    fit = ~own if len(set(y[~own].tolist())) == 2 else np.ones(len(y), bool)
    slope, offset = _calibrate(highest[fit], y[fit])
    return Model(s, weights.astype(np.float32), bias, slope, offset)


class Scorer:
    """The pooled windows of texts; scores of words are remembered up to a bound."""

    def __init__(self, model: Model, most: int = 100_000):
        self.model, self.most, self.words = model, most, {}

    def learn(self, words: set[str]) -> None:
        """Work out the scores of words that aren't known yet, all at once."""
        if len(self.words) + len(words) > self.most:
            self.words.clear()
        new = [w for w in words if w not in self.words]
        for k in range(0, len(new), BLOCK):
            part = new[k : k + BLOCK]
            owner, buckets = bags(part, self.model.settings)
            sums = np.bincount(owner, self.model.weights[buckets], len(part)) / np.maximum(1, np.bincount(owner, minlength=len(part)))
            self.words.update(zip(part, sums.tolist()))

    def all_highest(self, texts: list) -> list[float]:
        """Of each text, in groups of bounded size."""
        out, k = [], 0
        while k < len(texts):
            group, chars = [], 0
            while k < len(texts) and (not group or chars < 1 << 21):
                group.append(tokens(texts[k]))
                chars += len(texts[k] or "")
                k += 1
            self.learn({w for row in group for w in row})
            out += [self._pooled(row) for row in group]
        return out

    def highest(self, text: str | None) -> float:
        return self.all_highest([text])[0]

    def _pooled(self, found: list[str]) -> float:
        if not found:
            return self.model.bias
        scores = np.fromiter(map(self.words.__getitem__, found), np.float64, len(found))
        starts = window_ends(len(found), self.model.settings.window)
        sizes = np.diff(np.append(starts, len(found)))
        return pooled(np.add.reduceat(scores, starts) / sizes, len(found), self.model.settings.share) + self.model.bias


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", held_out_fold: int = 5, s: Settings = Settings()) -> Model:
    """Learn from labelled rows outside the held-out fold (crc32 of the id as text, modulo ``held_out_fold``, is not 0).

    At most ``train_rows`` rows are drawn, by a hash of the id, of texts up to ``train_chars``; both are bounds of what
    is sent to the driver. Rows without an id or label aren't drawn. If an id has several labels, the largest counts.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    known = known.where(id_fold(F.col("id"), held_out_fold) != 0).groupBy("id").agg(F.max("y").alias("y"))
    drawn = known.orderBy(F.xxhash64("id"), "id").limit(s.train_rows)
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = texts.where(F.char_length("text") <= s.train_chars).join(F.broadcast(drawn), "id").orderBy(F.xxhash64("id"), "id", "text")
    rows = rows.limit(s.train_rows).collect()
    labelled, back = [int(r["y"] > 0) for r in rows], [py_fold(f"back{r['id']}", 4) == 0 for r in rows]
    rows[:] = [r["text"] for r in rows]
    model = train(rows, labelled, back, s)
    tidy()  # the driver stays for all that follows
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score reaches the threshold) added.

    Null and empty texts have a score too, that of no words. Columns of these two names are replaced; only ``text`` is
    read. Rows may repeat.
    """
    shipped, mark = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    rows = docs.drop("score", "predicted")
    names = [f"c{k}" for k in range(len(rows.columns))]
    at = rows.columns.index("text")
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, rows.schema)) + ", score double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(("toxicity", mark), lambda: Scorer(shipped.value))
        for batch in batches:
            highest = np.array(scorer.all_highest(batch.column(at).to_pylist()), np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scorer.model.probability(highest))], names=[*names, "score"])

    scored = mapped(rows.toDF(*names), run, schema).toDF(*rows.columns, "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
