"""The pipeline's own stages."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tidewell.llm import near_sets


def _kept(spark, rows):
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()), key=repr)


def test_near_duplicates_go_by_row_not_by_id(spark):
    pick = random.Random(8)
    a, b, c, d = (" ".join(f"w{pick.random()}" for _ in range(60)) for _ in range(4))
    # a copy without an id, a copy under an id that another text has too, copies without any id
    rows = [(1, a), (None, a), (None, b), (2, c), (3, c), (3, d), (None, b.upper())]
    kept = _kept(spark, rows)
    assert [(i, t) for i, t in kept if t.lower() != b] == sorted([(1, a), (2, c), (3, d)], key=repr)
    assert len(kept) == 4


def _shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def _linked(a, b):
    x, y = _shingles(a), _shingles(b)
    return x == y or 10 * len(x & y) >= 8 * len(x | y) > 0


@pytest.mark.parametrize("rounds", [0, 2])
def test_near_sets_are_those_of_brute_force(spark, rounds):
    pick = random.Random(9)
    texts = [None, "", " ", "one two", "One two", "two one"]
    for _ in range(12):
        words = [f"w{pick.randint(0, 999)}" for _ in range(pick.randint(5, 150))]
        for _ in range(6):
            w = list(words)
            for _ in range(pick.randint(0, 4)):
                w[pick.randrange(len(w))] = "other"
            texts.append(" ".join(w))
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if _linked(texts[i], texts[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    got = {r.doc: r.component_id for r in near_sets.near_sets(df, "doc", rounds=rounds).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) < len(texts)


def test_near_duplicates_at_four_fifths_go(spark):
    words = [f"w{k}" for k in range(200)]
    near = words[:40] + ["x"] + words[41:120] + ["y"] + words[121:]
    assert _linked(" ".join(words), " ".join(near))
    assert _kept(spark, [(1, " ".join(words)), (2, " ".join(near))]) == [(1, " ".join(words))]


def _distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def _without_repeated_lines(rows):
    """Brute force: classes of lines within two edits and a tenth of the longer, the first of each stays."""
    lines = sorted({line for _, t in rows for line in (t or "").split("\n") if line.strip(" ")})
    root = {x: x for x in lines}
    for a in lines:
        for b in lines:
            allowed = min(2, max(len(a), len(b)) // 10)
            if a < b and abs(len(a) - len(b)) <= allowed and root[a] != root[b] and _distance(a, b) <= allowed:
                keep, gone = root[a], root[b]
                root = {k: keep if v == gone else v for k, v in root.items()}
    first = {}
    for i, t in sorted(rows):
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                first.setdefault(root[line], (i, k))
    return [(i, "\n".join(x for k, x in enumerate((t or "").split("\n")) if not x.strip(" ") or first[root[x]] == (i, k))) for i, t in rows]


def test_the_whole_run_equals_brute_force(spark, tmp_path):
    import struct
    import zlib

    from tidewell.llm.queries import vocabulary
    from tokenizers import Tokenizer

    pick = random.Random(12)
    word = lambda: "".join(pick.choices("abcdefgh", k=pick.randint(2, 8)))
    sentence = lambda: " ".join(word() for _ in range(pick.randint(5, 30)))
    rows = [(0, None), (1, ""), (2, "one\n\ntwo")]
    shared = [sentence() for _ in range(4)]
    for k in range(3, 40):
        rows.append((k, "\n".join(pick.choice([sentence(), sentence(), pick.choice(shared), pick.choice(shared)[:-1] + "é"]) for _ in range(pick.randint(1, 5)))))
    rows += [(50 + k, " ".join(("x" if pick.random() < 0.02 else w) for w in t.replace("\n", " ").split())) for k, (_, t) in enumerate(rows[5:15])]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 0, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = _without_repeated_lines(rows)
    stays = {i: t for i, t in kept}
    root = {i: i for i in stays}
    for a in stays:
        for b in stays:
            if a < b and root[a] != root[b] and _linked(stays[a], stays[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    t = Tokenizer.from_file(vocabulary())
    want = set()
    for i in (i for i in stays if root[i] == i):
        ids = [*t.encode(stays[i], add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want |= {(i, p, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    assert len({root[i] for i in root}) < len(root) and sum(t != (dict(rows)[i] or "") for i, t in kept) > 5


def test_stages_on_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []
    odd = spark.createDataFrame([(1, "a b", "k", 0.5, None), (None, None, None, None, 3), (1, "a b", "k", 0.5, None)], "doc_id long, text string, k1 string, score double, n_chars long").withColumn("removed", F.col("score"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        odd = stage(spark, odd, str(tmp_path))
        assert odd.columns == ["doc_id", "text", "k1", "score", "n_chars", "removed"]
    assert sorted(((r.doc_id, r.text, r.k1, r.score, r.removed) for r in odd.collect()), key=repr) == [(1, "a b", "k", 0.5, 0.5)] * 2 + [(None, "", None, None, None)]
