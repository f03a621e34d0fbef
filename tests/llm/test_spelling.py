"""Spelling variants against brute force: words at one edit by comparing all, chains by following them."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from tidewell.llm import spelling


def _at_one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def _expected(docs, shortest=5, least=3, noise=97):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if len(run) >= shortest and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if k >= least and len(w) >= shortest}
    near = {w: [x for x in n if _at_one_edit(w, x)] for w in n}
    form = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: x for w, x in form.items() if n[x] >= 2 * n[w]}

    def end(w):
        return end(form[w]) if w in form else w

    return sorted((w, form.get(w), end(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def _rows(made):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in made.collect())


def _random_docs(seed):
    pick = random.Random(seed)
    stems = ["".join(pick.choice("abé÷ÿ") for _ in range(pick.randint(4, 7))) for _ in range(40)]
    def word():
        w = pick.choice(stems)
        k = pick.randrange(len(w))
        return pick.choice([w, w, w[:k] + w[k + 1 :], w[:k] + pick.choice("abÉ") + w[k:], w[:k] + "B" + w[k + 1 :]])
    docs = [(i, pick.choice([" ", "-", "1", "\u0178", "\U0001f600"]).join(word() for _ in range(60))) for i in range(40)]
    return docs + [(None, "Aabab aabab"), (3, docs[3][1]), (50, None), (51, ""), (52, "abab"), (53, "\n"), (55, "zzzzzx " * 3 + "zzzzxx " * 6 + "zzzxxx " * 12 + "zzxxxx " * 24 + "zxxxxx " * 48), (54, " ".join(["long" * 400] * 4 + ["x" * 70000]))]


def test_equals_brute_force(spark, monkeypatch):
    docs = _random_docs(5)
    table = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n long")
    want = _expected(docs)
    assert len(want) > 150 and sum(x[1] is not None for x in want) > 50 and any(x[1] not in (None, x[2]) for x in want)
    assert _rows(spelling.spelling_variants(table)) == want
    monkeypatch.setattr(spelling, "SHARD_WORDS", 7)  # many shards, also such that share their first letters
    monkeypatch.setattr(spelling, "small", lambda df: df)  # joined by number instead of broadcast
    assert _rows(spelling.spelling_variants(table)) == want


def test_noise_takes_a_letter(spark):
    docs = _random_docs(6)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert _rows(spelling.spelling_variants(table, noise=3)) == _expected(docs, noise=3)


def test_no_words(spark):
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")).collect() == []


def test_trie_finds_all_at_one_edit():
    pick = random.Random(7)
    for size in (1, 2, 4, 6):
        words = sorted({"".join(pick.choice("abc") for _ in range(size)) for _ in range(40)})
        m = np.frombuffer("".join(words).encode(), np.uint8).reshape(len(words), size)
        trie = spelling.Trie.unpacked(spelling.Trie.packed(m, np.arange(len(words))))
        for _ in range(200):
            w = "".join(pick.choice("abc") for _ in range(max(1, size + pick.randint(-2, 2))))
            assert {r: x.decode() for r, x in trie.near(w.encode()).items()} == {r: x for r, x in enumerate(words) if _at_one_edit(w, x)}
        shared = trie.common().decode()
        assert all(w.startswith(shared) for w in words)
