"""Operators of the llm subpackage against brute force, with nulls, empties, ties, repeats, clashing columns."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tidewell.llm import bpe, chat, components, exact_dedup, license_scan, line_dedup, lm, packing, simhash, topk, toxicity
from tidewell.llm.queries import vocabulary

TEXTS = [
    (1, "The MIT License is here."), (2, "the mit LICENSE is here."), (3, None), (4, ""), (5, "Öl und É"), (6, "öl und É"), (5, "Öl und É"),
    (None, "The MIT License is here."), (7, "x " * 4000), (8, "a\n\nb\n"), (9, "  two  spaces <|endoftext|> and 'tis 123\t!"),
]


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in TEXTS], "doc_id long, text string, kept string, id string")


@pytest.fixture(scope="module")
def spec():
    with open(vocabulary(), "rb") as f:
        return f.read()


def test_bpe_equals_the_library(docs, spec):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode_decode(docs, vocabulary()).collect())
    want = Counter((i, tuple(e := t.encode(x or "", add_special_tokens=False).ids), t.decode(e, skip_special_tokens=False)) for i, x in TEXTS)
    assert got == want
    v = bpe.Vocabulary(spec)
    encoders = [bpe.Encoder(v, bpe.Lexicon(bpe.lexicon_for([" the", "ab", "abab", "a"], v))), bpe.TiktokenEncoder(v)]
    pick = random.Random(1)
    alphabet = ["a", "b", " ", "  ", "\n", "'s", "1", "é", "日", "🙂", "<|endoftext|>", "\x1c", "\x85", "the", ".", ","]
    for _ in range(500):
        s = "".join(pick.choice(alphabet) for _ in range(pick.randint(0, 12)))
        want = t.encode(s, add_special_tokens=False).ids
        for e in encoders:
            assert list(struct.unpack(f"<{len(want)}I", e.encode(s))) == want


def test_lexicon_shares_suffixes(spec):
    entries = {w.encode(): (k, 7) for k, w in enumerate(["walked", "talked", "walking", "talking", "walk"])} | {b"talk": (1, 2, 3)}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(entries))
    for w, ids in entries.items():
        assert lexicon.ids(w) == struct.pack(f"<{len(ids)}I", *ids)
    assert lexicon.ids(b"wal") is None and lexicon.ids(b"x") is None and lexicon.ids(b"") is None
    assert lexicon.states < sum(map(len, entries))


def test_chat_reads_back(spark):
    own = "</s>[INST] ok [/INST]"
    rows = [
        (1, 0, "user", own), (1, 1, "assistant", own), (2, 1, "assistant", "a & <s> &lt; b"), (2, 0, "system", "<<SYS>>\n"), (2, 0, "system", "<<SYS>>\n"),
        (3, None, None, None), (3, 1, "tool<s>", "<</TURN>"), (3, 2, "user", ""), (None, 0, "user", "x\n"),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    made = chat.format_chats(df)
    got = {r.conv_id: [(t.role, t.text) for t in r.t] for r in made.select("conv_id", chat.read_back(F.col("formatted")).alias("t")).collect()}
    want = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] or -1, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got == want
    valid = {r.conv_id: r.valid for r in made.collect()}
    assert valid == {1: True, 2: False, 3: False, None: False}
    assert chat.format_chats(df.where("false")).collect() == []


@pytest.mark.parametrize("k", [1, 5, 50])
def test_top_k(spark, k):
    rng = np.random.default_rng(k)
    rows = [(i, [float(x) for x in rng.integers(-300, 300, 4) / 256]) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(20)] + [(200, None), (201, [float("nan")] * 4), (202, [None] * 4), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 20 = 0"), k, query_block=2, candidate_block=16).collect()}
    good = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q in good:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)[:k]
            want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(scored)}
    assert got == want
    assert topk.top_k(df.where("false"), df.where("false"), k).collect() == []
    # queries that repeat an id each get rows of their own
    twice = df.where("vec_id % 20 = 0").union(df.where("vec_id = 20"))
    again = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, twice, k, query_block=2, candidate_block=16).collect())
    assert again == Counter({(q, n, *want[q, n]): 2 if q == 20 else 1 for q, n in want})


def _best(lengths, capacity):
    best = [len(lengths)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b + lengths[k] <= capacity}:
            j = bins.index(room)
            bins[j] += lengths[k]
            go(k + 1, bins)
            bins[j] -= lengths[k]
        go(k + 1, [*bins, lengths[k]])

    go(0, [])
    return best[0]


def test_dominance_keeps_the_optimum():
    pick = random.Random(4)
    for _ in range(200):
        lengths = sorted((pick.randint(2, 20) for _ in range(pick.randint(1, 9))), reverse=True)
        plan = packing.Plan()
        left = packing.reduce_by_dominance(Counter(lengths), 20, plan)
        rest = sorted((x for x, n in left.items() for _ in range(n)), reverse=True)
        assert plan.sequences + _best(rest, 20) == _best(lengths, 20)


def test_packing_is_whole(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    rows = packing.pack_documents(docs, vocabulary(), capacity=64).collect()
    ids = Counter((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 2])) for i, x in TEXTS)
    want = Counter()
    for (i, x), n in ids.items():
        cuts = [0, *range(len(x) % 64 or 64, len(x) + 1, 64)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, p, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *x[a:b]))] += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(docs.where("false"), vocabulary()).collect() == []


def test_packing_of_many_blocks(spark, monkeypatch):
    """Small blocks, repeated rows, and columns with the names that are used inside."""
    monkeypatch.setattr(packing, "BLOCK_RANKS", 3)
    pick = random.Random(6)
    rows = [(pick.choice([1024, 1024, 700, 324, 300, 24, 5, 5, 1]), k // 2, "b", -1) for k in range(400)]
    df = spark.createDataFrame(rows, "length long, rank long, bucket string, sequence_id long")
    made = packing.pack(df, 1024)
    assert made.columns == ["length", "rank", "bucket", "sequence_id", "offset"]
    got = made.collect()
    assert Counter((r.length, r["rank"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= -(-sum(r[0] for r in rows) // 1024) + 1
    with pytest.raises(ValueError):
        packing.pack(df.withColumn("length", F.lit(2000)), 1024)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(docs, keep):
    got = exact_dedup.exact_dedup(docs, keep=keep).collect()
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(lower(t), []).append(i)
    pick = max if keep == "largest" else min
    for r in got:
        members = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert (r.keep_id, r.group_size) == (pick(x for x in members if x is not None), len(members))
    assert sum(r.kept for r in got) == len(groups) and len(got) == len(TEXTS)
    assert exact_dedup.exact_dedup(docs.where("false")).collect() == []


def test_toxicity_generalises():
    pick = random.Random(2)
    words = ["".join(pick.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    def text(bad):
        return " ".join(pick.choice(words) if not bad or pick.random() > 0.1 else "zorg" + pick.choice(["ling", "lets", "master", "ness"]) for _ in range(60)) + bad * " zorgen"
    y = [k % 4 == 0 for k in range(240)]
    model = toxicity.train([text(b) for b in y], [int(b) for b in y], [k % 5 == 0 for k in range(240)])
    scorer = toxicity.Scorer(model)
    score = lambda t: float(model.probability(np.array([scorer.highest(t)]))[0])
    clean = " ".join(words[:60])
    assert score(clean + " zorgish zorgant") > 0.5 > score(clean) and score(None) == score("") < 0.5
    assert 0 <= toxicity.Scorer(toxicity.train([], [], [])).highest("x") <= 1


def test_toxicity_reads_long_runs_whole():
    pick = random.Random(5)
    words = ["".join(pick.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    def text(bad):
        return " ".join(pick.choice(words) if not bad or pick.random() > 0.1 else "zorg" + pick.choice(["ling", "lets", "master", "ness"]) for _ in range(60)) + bad * " zorgen"
    y = [k % 4 == 0 for k in range(240)]
    model = toxicity.train([text(b) for b in y], [int(b) for b in y], [k % 5 == 0 for k in range(240)])
    scorer = toxicity.Scorer(model)
    score = lambda t: float(model.probability(np.array([scorer.highest(t)]))[0])
    for joint in ["-", "_", "/", "\u2026", "\u200b", ""]:
        clean, bad = words[:40], [*words[:20], "zorgling", "zorgmaster", *words[20:40]]
        assert score(joint.join(bad)) > 0.5 > score(joint.join(clean)), joint
    # every n-gram of a run lies in a piece, at any length
    for n in range(63, 120):
        run = "".join(pick.choice("abcdefgh") for _ in range(n))
        found = toxicity.tokens(f"x {run} y")
        assert found[0] == "x" and found[-1] == "y" and all(any(run[k : k + 9] in p for p in found) for k in range(n - 8))


def test_toxicity_scores_all_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    rows = toxicity.score(docs.withColumn("score", F.lit("old")), toxicity.fit(docs, labels)).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)


def test_golay_balls_meet():
    pick = random.Random(3)
    a = np.array([pick.getrandbits(23) for _ in range(300)])
    for flips in range(3):
        b = np.array([x ^ sum(1 << k for k in pick.sample(range(23), flips)) for x in a.tolist()])
        for x, y in zip(simhash.golay_indices(a), simhash.golay_indices(b)):
            assert set(x) & set(y)


@pytest.mark.parametrize("most", [0, 64])
def test_links_lose_none(spark, most):
    pick = random.Random(most)
    fps = {pick.getrandbits(64) for _ in range(30)}
    for f in list(fps):
        for _ in range(6):
            f ^= sum(1 << k for k in pick.sample(range(64), pick.randint(1, 3)))
            fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    parent = {f: f for f in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in signed:
        for y in signed:
            if ((x ^ y) & (2**64 - 1)).bit_count() <= 2:
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in components.connected_components(simhash.links(df, most)).collect()}
    assert {f: roots.get(f, f) for f in signed} == {f: find(f) for f in signed}


def test_fingerprints(docs):
    def brute(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(t)) if x]
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    got = Counter((r.doc_id, r.fp & (2**64 - 1)) for r in simhash.near_duplicates(docs).collect())
    assert got == Counter((i, brute(t)) for i, t in TEXTS)
    assert simhash.near_duplicates(docs.where("false")).collect() == []


@pytest.mark.parametrize("bound", [1 << 30, 64])
def test_lm(docs, bound):
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    words = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    c = Counter(w for i, t in TEXTS if not fold(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    got = lm.score_texts(docs, s=lm.Settings(most_broadcast=bound)).collect()
    want = Counter((i, fold(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t in TEXTS)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 0 for r in got)
    if bound == 64:  # shares change nothing
        one = Counter((r.doc_id, round(r.score, 6)) for r in lm.score_texts(docs).collect())
        assert Counter((r.doc_id, round(r.score, 6)) for r in got) == one


def test_counts_come_back_quantised():
    s = lm.Settings()
    hashes = lm.word_hashes([str(k).encode() for k in range(2000)])
    counts = np.array([1 + k % 9 for k in range(1000)])
    segment = lm.Segment(200_000)
    level = lm._levels(counts, s)
    for k in range(1, level.max() + 1):
        segment.enter(hashes[:1000][level >= k], k, s)
    read = lm.probe_counts(hashes, segment.data, np.zeros(2000, np.uint64), np.full(2000, 200_000, np.uint64), s)
    assert (read[:1000] >= 2.0 ** (level - 1)).all() and (read[1000:] > 0).mean() < 0.02 and (read[:1000] > counts).mean() < 0.02


@pytest.mark.parametrize("chunk,bound", [(1 << 22, 1 << 30), (300, 200)])
def test_lm_scores_are_probabilities(spark, chunk, bound):
    """The model's score is the brute-force one but for false positives, and a history's words share out one at most."""
    pick = random.Random(3)
    rows = [(k, " ".join(pick.choices("the a of cat dog sat ran ünder Mat mat".split(), [9, 8, 7, 3, 3, 2, 2, 1, 1, 1], k=pick.randint(0, 40)))) for k in range(120)]
    rows += [rows[5], rows[5], (None, None), (None, "the cat " * 500), (998, "")]
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    words = lambda t: [*(t or "").encode().lower().split(), "end"]
    own, after, seen = Counter(), Counter(), Counter()
    for i, t in rows:
        if not fold(i):
            w = words(t)
            own.update(w)
            after.update(zip(["start", *w], w))
            seen.update(["start", *w[:-1]])
    n, v = sum(own.values()), len(own)
    q = lambda c: 2 ** int(math.log2(c)) if c else 0
    p = lambda h, w: (q(after[h, w]) + 2.0 * (own[w] + 1) / (n + v + 1)) / (seen[h] + 2.0)
    for h in seen:
        assert sum(p(h, w) for w in own) <= 1 + 1e-9
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int").repartition(3)
    got = lm.score_texts(df, s=lm.Settings(chunk_bytes=chunk, most_broadcast=bound, segment_pairs=500, bits_each=24)).collect()
    want = Counter((i, round(sum(math.log10(p(h, w)) for h, w in zip(["start", *words(t)], words(t))), 6)) for i, t in rows)
    same = sum((Counter((r.doc_id, round(r.score, 6)) for r in got) & want).values())
    assert len(got) == len(rows) and same >= 0.9 * len(rows)
    assert lm.score_texts(df.where("false")).collect() == []


def test_license_scan(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    rows = [(1, "MIT\nLicense and the mit license-MIT LICENSE"), (2, notice.replace("the ", "")), (3, "licensed apache"), (4, None), (5, ""), (6, "general public public license"), (7, "smit license mit licenses")]
    df = spark.createDataFrame([(i, t, "p") for i, t in rows], "doc_id long, text string, places string")
    got = {r.doc_id: r for r in license_scan.license_scan(df).collect()}
    assert [(p.start, p.label) for p in got[1].places] == [(0, "mit"), (4, "mit"), (6, "mit")] and got[1].n_words == 8
    assert [(b.block, b.label) for b in got[2].blocks] == [(0, "apache")] and abs(got[2].blocks[0].containment - 7 / 8) < 1e-9
    assert [(p.start, p.label) for p in got[2].places] == [(2, "apache")]
    assert all(got[k].places == [] for k in (3, 4, 5, 6, 7)) and got[4].n_words == got[5].n_words == 0
    repeated = spark.createDataFrame([(1, "a a a b a a")], "doc_id long, text string")
    assert [p.start for p in license_scan.license_scan(repeated, templates={}, phrases={"a a": "x"}).first().places] == [0, 1, 4]


def _brute_blocks(t, ranks, threshold=0.8):
    out = set()
    lines = [license_scan._words(x) for x in (t or "").split("\n")]
    words = [(n, w) for n, x in enumerate(lines) for w in x]
    for r in license_scan.rules(ranks, license_scan.TEMPLATES, threshold):
        size = len(r.words)
        whole = {n: len(set(x) & set(r.words)) for n, x in enumerate(lines) if len(set(x) & set(r.words)) >= r.need}
        out |= {(n, r.label, round(c / size, 9)) for n, c in whole.items()}
        hits = [(k, n, w) for k, (n, w) in enumerate(words) if w in r.words and n not in whole]
        if len(set(w for _, w in words) & set(r.words)) >= r.need:
            best = {}
            for k, n, _ in hits:
                c = len({w for j, _, w in hits if k <= j < k + r.span})
                if c >= r.need:
                    best[n] = max(c, best.get(n, 0))
            out |= {(n, r.label, round(c / size, 9)) for n, c in best.items()}
    return out


def test_license_blocks_are_those_of_brute_force(spark):
    pick = random.Random(4)
    sentences = [license_scan._words(t) for ts in license_scan.TEMPLATES.values() for t in ts]
    texts = [None, "", "\n\n"]
    for _ in range(60):
        words = []
        for _ in range(pick.randint(1, 3)):
            s = [w for w in pick.choice(sentences) if pick.random() < 0.93]
            words += s + pick.choices("lorem ipsum the of and software license".split(), k=pick.randint(0, 12))
        texts.append("".join(w + pick.choice([" ", " ", " ", " ", "\n", ", ", "\n# "]) for w in words))
    texts += texts[5:8]
    df = spark.createDataFrame([(k, t, "a", "b") for k, t in enumerate(texts)], "doc_id long, text string, canon string, blocks string")
    vocabulary = {w for s in sentences for w in s} | {w for p in license_scan.PHRASES for w in license_scan._words(p)}
    ranks = license_scan.word_ranks(df, "text", vocabulary)
    found = license_scan.license_scan(df)
    assert found.columns == ["doc_id", "text", "canon", "n_words", "places", "blocks"]
    got = {r.doc_id: {(b.block, b.label, round(b.containment, 9)) for b in r.blocks} for r in found.collect()}
    assert got == {k: _brute_blocks(t, ranks) for k, t in enumerate(texts)}
    assert sum(map(bool, got.values())) > 40
    assert license_scan.license_scan(df.where("false")).collect() == []


def test_license_scan_reads_wrapped_notices(spark):
    bsd = "Redistribution and use in source and binary forms, with or without"
    rows = [
        (1, f"x\n# {bsd}\n# modification, are permitted"),
        (2, "under the terms of the GNU General Public License as published by\n * the Free Software Foundation"),
        (3, "\n".join(f"{bsd} modification are permitted".split())),
        (4, f"{bsd}\n" + "other words " * 20 + "\nmodification are permitted"),
        (5, f"{bsd}\n\n{bsd} modification are permitted"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(b.block, b.label, round(b.containment, 3)) for b in r.blocks] for r in license_scan.license_scan(df).collect()}
    assert got == {1: [(1, "bsd", 1.0)], 2: [(0, "gpl", 1.0)], 3: [(0, "bsd", 1.0), (1, "bsd", 0.923), (2, "bsd", 0.923), (3, "bsd", 0.846)], 4: [], 5: [(2, "bsd", 1.0)]}


def _distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


@pytest.mark.parametrize("errors", [1, 2, 3])
def test_bit_parallel_distance(spark, errors):
    pick, pairs = random.Random(errors), []
    while len(pairs) < 300:
        a = [pick.choice("abc é🙂") for _ in range(pick.randint(errors + 1, 25))]
        b = list(a)
        for _ in range(pick.randint(0, errors + 2)):
            k = pick.randint(0, len(b))
            if pick.random() < 0.5:
                b.insert(k, pick.choice("abz"))
            elif k < len(b):
                b.pop(k)
        a, b = sorted(("".join(a), "".join(b)), key=len, reverse=True)
        if len(a) - len(b) <= errors < len(b):
            pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", line_dedup.within(F.col("a"), F.col("b"), errors).alias("w")).collect():
        assert r.w == (_distance(r.a, r.b) <= errors), r


def test_line_dedup(spark):
    base = "the quick brown fox jumps over it"
    rows = [(2, f"{base}\nshort\n\nunique line that nothing else holds"), (1, base.replace("quick", "quikc")), (3, f"short\n{base}s\nshorty"), (4, None), (5, ""), (6, base[2:]), (6, base[2:]), (None, "alone and here only once")]
    df = spark.createDataFrame([(i, t, "r") for i, t in rows], "doc_id long, text string, removed string")
    got = Counter((r.doc_id, r.text) for r in line_dedup.line_dedup(df).collect())
    want = Counter({(1, rows[1][1]): 1, (2, "short\n\nunique line that nothing else holds"): 1, (3, "shorty"): 1, (4, ""): 1, (5, ""): 1, (6, ""): 2, (None, "alone and here only once"): 1})
    assert got == want
    assert line_dedup.line_dedup(df.where("false")).collect() == []


def test_components(spark):
    chain = [(k, k + 1) for k in range(50)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(51)} | {100: 100, 101: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_very_long_texts_and_empty_tables(spark):
    pick = random.Random(7)
    words = ["".join(pick.choices("abcdefghé", k=pick.randint(1, 9))) for _ in range(3000)]
    long = "\n".join(" ".join(pick.choices(words, k=12)) for _ in range(30_000))  # some 2 MB in many lines
    flat = " ".join(pick.choices(words, k=300_000))  # and in one
    run = "ab-" * 500_000  # one word
    df = spark.createDataFrame([(1, long), (2, flat), (3, run), (4, "short")], "doc_id long, text string")
    none = df.where("false")
    e = bpe.encode_digests(df, vocabulary())
    assert {r.doc_id: r.decoded_sha256 for r in e.collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in [(1, long), (2, flat), (3, run), (4, "short")]}
    assert bpe.encode_digests(none, vocabulary()).collect() == []
    pieces = packing.pack_documents(df, vocabulary()).collect()
    assert {r.doc_id: sum(x.length for x in pieces if x.doc_id == r.doc_id) - 1 for r in pieces} == {r.doc_id: r.n_tokens for r in e.collect()}
    model = toxicity.train(["good day", "bad slur here"] * 20, [0, 1] * 20, [False] * 40)
    assert all(0 <= r.score <= 1 for r in toxicity.score(df, model).collect()) and toxicity.score(none, model).collect() == []
    assert len(simhash.near_duplicates(df).collect()) == 4
    assert {r.component_id for r in simhash.near_duplicates(df, width=5, percent=80).collect()} == {1, 2, 3, 4}
    assert {r.doc_id: r.n_tokens for r in lm.score_texts(df).collect()} == {i: len(t.split()) + 1 for i, t in [(1, long), (2, flat), (3, run), (4, "short")]}
    assert {r.doc_id: r.n_words for r in license_scan.license_scan(df).collect()} == {i: len(license_scan._words(t)) for i, t in [(1, long), (2, flat), (3, run), (4, "short")]}
    assert {r.doc_id: r.n_lines for r in line_dedup.line_dedup(df).collect()} == {1: 30_000, 2: 1, 3: 1, 4: 1}
    assert len(exact_dedup.exact_dedup(df).collect()) == 4
    chats = spark.createDataFrame([(1, 0, "user", flat), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    (made,) = chat.format_chats(chats).select(chat.read_back(F.col("formatted")).alias("t")).collect()
    assert [t.text for t in made.t] == [flat, long]
