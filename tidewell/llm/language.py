"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

A text becomes its runs of letters, lower-cased and set apart by single spaces; its n-grams of one to three characters
are hashed to buckets. Document frequencies are counted over all texts that may be learnt from. The regression is
fitted by follow-the-regularised-leader with elastic-net penalties, one learning rate a weight, on a bounded sample of
labelled rows drawn evenly from the languages; most weights end at zero. A temperature is fitted last, on rows of the
sample that were held back, so that scores are probabilities.

Workers send sampled rows as counts of buckets, so no text goes to the driver.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_fold, kept, mapped, packed, py_fold, unpacked

#: What a text without letters, or without anything learnt, is said to be.
UNKNOWN = "und"
GAPS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    longest: int = 3  # characters of an n-gram
    train_rows: int = 6_000  # at most so many labelled rows are learnt from
    train_chars: int = 16_384  # longer texts aren't learnt from; their n-grams count for the frequencies, and all are scored
    passes: int = 4
    batch: int = 32
    alpha: float = 0.5  # FTRL: rates are alpha / (beta + root of the squared gradients so far)
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.01
    seed: int = 23


@dataclass(frozen=True)
class Model:
    settings: Settings
    languages: list[str]
    idf: np.ndarray  # of each bucket
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def n_grams(texts: list[str | None], s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text its buckets, rising, and how often each occurs."""
    cleaned = [GAPS.sub(" ", f" {(t or '').lower()} ") for t in texts]
    sizes = np.fromiter(map(len, cleaned), np.int64, len(cleaned))
    codes = np.frombuffer("".join(cleaned).encode("utf-32-le", "replace"), np.uint32)
    edges = np.concatenate(([0], np.cumsum(sizes)))
    h = np.zeros(len(codes), np.uint32)
    hashes = []
    for k in range(s.longest):  # an n-gram's hash goes on from that of the one a character shorter
        h = (h[: len(codes) - k] ^ (codes[k:] + np.uint32(k + 1))) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        hashes.append((h * np.uint32(0x85EBCA77) >> np.uint32(7)) % np.uint32(s.buckets))
    for a, b in zip(edges[:-1], edges[1:]):
        found = np.concatenate([x[a : max(a, b - k)] for k, x in enumerate(hashes)])
        if len(found) < s.buckets >> 4:
            yield np.unique(found, return_counts=True)
        else:
            counts = np.bincount(found, minlength=s.buckets)
            at = np.nonzero(counts)[0]
            yield at, counts[at]


def grouped(texts: list[str | None], s: Settings, chars: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``n_grams`` of all texts, worked out for a bounded number of characters at once (or one text)."""
    k = 0
    while k < len(texts):
        end, total = k, 0
        while end < len(texts) and (end == k or total + len(texts[end] or "") <= chars):
            total += len(texts[end] or "")
            end += 1
        yield from n_grams(texts[k:end], s)
        k = end


def weighted(buckets: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length, frequencies damped by their logarithm."""
    x = (1 + np.log(counts)) * idf[buckets]
    return x / max(1e-12, float(np.sqrt(x @ x)))


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader: a weight is what minimises all gradients so far with the elastic-net penalty."""

    def __init__(self, features: int, classes: int, s: Settings):
        self.s = s
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))

    def weights(self, rows: np.ndarray) -> np.ndarray:
        z, s = self.z[rows], self.s
        step = (s.beta + np.sqrt(self.n[rows])) / s.alpha + s.l2
        return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / step)

    def learn(self, rows: np.ndarray, weights: np.ndarray, gradient: np.ndarray) -> None:
        more = self.n[rows] + gradient**2
        self.z[rows] += gradient - (np.sqrt(more) - np.sqrt(self.n[rows])) / self.s.alpha * weights
        self.n[rows] = more


def train(samples: list[tuple[np.ndarray, np.ndarray]], labels: list[str], held_back: list[bool], frequency: np.ndarray, documents: int, s: Settings = Settings()) -> Model:
    """Fit on the samples (buckets and counts); those held back serve the temperature only, if they can."""
    languages = sorted(set(labels))
    idf = np.log((1 + documents) / (1 + frequency)) + 1
    if not languages:
        return Model(s, [], idf, np.zeros((s.buckets, 0)), np.zeros(0), 1.0)
    number = {x: k for k, x in enumerate(languages)}
    y = np.array([number[x] for x in labels])
    vectors = [weighted(b, c, idf) for b, c in samples]
    back = np.array(held_back, bool)
    learnt = np.nonzero(~back)[0] if (~back).any() else np.arange(len(y))
    # the bias is one more bucket, always 1
    model, rng = Ftrl(s.buckets + 1, len(languages), s), np.random.default_rng(s.seed)
    for _ in range(s.passes):
        order = rng.permutation(learnt)
        for k in range(0, len(order), s.batch):
            part = order[k : k + s.batch]
            sizes = [len(samples[d][0]) + 1 for d in part]
            owner = np.repeat(np.arange(len(part)), sizes)
            at = np.concatenate([np.append(samples[d][0], s.buckets) for d in part])
            x = np.concatenate([np.append(vectors[d], 1.0) for d in part])
            rows, place = np.unique(at, return_inverse=True)
            w = model.weights(rows)
            starts = np.cumsum(sizes) - sizes
            p = _softmax(np.add.reduceat(w[place] * x[:, None], starts, axis=0))
            p[np.arange(len(part)), y[part]] -= 1
            gradient = np.stack([np.bincount(place, x * p[owner, c], len(rows)) for c in range(len(languages))], 1)
            model.learn(rows, w, gradient)
    w = model.weights(np.arange(s.buckets + 1))
    weights, bias = w[:-1].astype(np.float32), w[-1]
    judged = np.nonzero(back)[0] if back.any() else np.arange(len(y))
    logits = np.array([x @ weights[b] + bias for (b, _), x in ((samples[d], vectors[d]) for d in judged)])
    return Model(s, languages, idf, weights, bias, temperature(logits, y[judged]))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """What logits are divided by so that the labels are likeliest; between a twentieth and twenty.

    The square of its logarithm counts as one more label's loss, for logits that are never wrong would take any sharpening.
    """

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        top = z.max(1)
        return float((np.log(np.exp(z - top[:, None]).sum(1)) + top - z[np.arange(len(y)), y]).sum()) + log_t**2

    low, high = -np.log(20), np.log(20)
    shrink = (np.sqrt(5) - 1) / 2
    for _ in range(60):  # golden section
        a, b = high - shrink * (high - low), low + shrink * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def frequencies(docs: DataFrame, s: Settings) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts."""
    most, texts = s.buckets, docs.select("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(most, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for buckets, _ in grouped(batch.column(0).to_pylist(), s):
                counts[buckets] += 1
        at = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], rows))], names=["bucket", "n"])

    found = np.zeros(most + 1, np.int64)
    for row in mapped(texts, run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one a bucket at most
        found[row["bucket"]] = row["n"]
    return found[:-1], int(found[-1])


def fit(docs: DataFrame, label_col: str = "lang", held_out: Column | None = None, s: Settings = Settings()) -> Model:
    """Learn from rows with a label, outside those for which ``held_out`` is true.

    Frequencies count every such text. At most ``train_rows`` rows are drawn for the regression, of texts up to
    ``train_chars``, evenly from the languages: of each as many rows as go round, by a hash of id and text. Rows that
    repeat are drawn as often as they are there.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col(label_col).cast("string").alias("y"), F.coalesce(held_out, F.lit(False)).alias("out") if held_out is not None else F.lit(False).alias("out"))
    known = rows.where(F.col("y").isNotNull() & ~F.col("out") & has_letter(F.col("text"))).select("doc_id", "text", "y")
    frequency, documents = frequencies(known, s)
    short = known.where(F.char_length("text") <= s.train_chars)
    held = short.groupBy("y").count().orderBy(F.desc("count"), "y").limit(s.train_rows).collect()
    share = {r["y"]: min(1.0, 1.3 * s.train_rows / len(held) / r["count"]) for r in held}
    if not share:
        return train([], [], [], frequency, documents, s)
    # a hash under a language's share of its range lets through about as many rows as wanted; the sort takes those only
    limits = docs.sparkSession.createDataFrame([(y, x) for y, x in share.items()], "y string, share double")
    hashed = short.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(limits), "y")  # train_rows rows at most
    drawn = hashed.where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30)).drop("share").orderBy("h", "doc_id", "y").limit(s.train_rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [(packed(b.astype(np.int32)), packed(c.astype(np.int32))) for b, c in grouped(batch.column(1).to_pylist(), s)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([b for b, _ in counted], pa.binary()), pa.array([c for _, c in counted], pa.binary())], names=["h", "y", "buckets", "counts"])

    sent = sorted(mapped(drawn.select("h", "text", "y"), run, "h long, y string, buckets binary, counts binary").collect(), key=lambda r: (r["h"], r["y"]))
    samples = [(unpacked(r["buckets"], np.int32), unpacked(r["counts"], np.int32)) for r in sent]
    return train(samples, [r["y"] for r in sent], [py_fold(f"back{r['h']}", 5) == 0 for r in sent], frequency, documents, s)


class Guesser:
    def __init__(self, model: Model):
        self.model = model
        self.weights = model.weights / model.temperature
        self.bias = model.bias / model.temperature

    def guess(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for buckets, counts in grouped(texts, self.model.settings):
            p = _softmax(weighted(buckets, counts, self.model.idf) @ self.weights[buckets] + self.bias)
            k = int(p.argmax())
            names.append(self.model.languages[k])
            scores.append(float(p[k]))
        return names, scores


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the probability of that language.

    Texts that are null or have no letter are ``und`` with score 0, and so are all if nothing was learnt. Columns of
    these two names are replaced; only ``text`` is read. Rows may repeat.
    """
    rows = docs.drop("lang_pred", "score")
    if not model.languages:
        return rows.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shipped, mark = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    names = [f"c{k}" for k in range(len(rows.columns))]
    at = rows.columns.index("text")
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, rows.schema)) + ", known boolean, lang_pred string, score double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = kept(("language", mark), lambda: Guesser(shipped.value))
        for batch in batches:
            languages, scores = guesser.guess(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(languages), pa.array(scores)], names=[*names, "known", "lang_pred", "score"])

    found = mapped(rows.toDF(*names).withColumn("known", has_letter(F.col(names[at]))), run, schema)
    known = F.col("known")
    return found.select(
        *[F.col(n).alias(c) for n, c in zip(names, rows.columns)],
        F.when(known, F.col("lang_pred")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(known, F.col("score")).otherwise(F.lit(0.0)).alias("score"),
    )


def in_fold(folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text, modulo ``folds``, is ``fold``."""
    return id_fold(F.col("doc_id"), folds) == fold
