"""The registered queries on the smallest tables, against their SQL or brute force."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import duckdb
import pytest
import xxhash
from tidewell.llm import queries

SF = "/root/testdata/sf0.001"
lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


def _rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    with duckdb.connect() as db:
        for t in ("documents", "embeddings", "conversations"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        made = db.execute(queries.SQL[name])
        at = [[d[0] for d in made.description].index(c) for c in columns]
        want = sorted(repr([r[k] for k in at]) for r in made.fetchall())
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == want


def test_op1_equals_the_library(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for i, x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.add((i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(t.decode(ids, skip_special_tokens=False).encode())))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in _rows(spark, "op1_bpe")} == want


def test_op4_packs_every_piece_without_gaps(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    want, total = set(), 0
    for i, x in texts:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want |= {(i, p, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    rows = _rows(spark, "op4_packing")
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in places.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 1024
    assert len(places) <= -(-total // 1024) + 2


def test_op6_scores_every_text_and_learns(spark, texts):
    rows = _rows(spark, "op6_toxicity")
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_op7_links_all_near_fingerprints(spark, texts):
    def mark(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(t)) if x]
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    marks = {i: mark(t) for i, t in texts}
    root = {i: i for i in marks}
    for a in marks:
        for b in marks:
            if a < b and (marks[a] ^ marks[b]).bit_count() <= 2 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in _rows(spark, "op7_simhash")} == {(i, f"{m:016x}", root[i]) for i, m in marks.items()}


def test_op8_base_columns(spark, texts):
    fold = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    words = {i: [*[w for w in re.split(rb"[\x20\x09-\x0D]+", lower(t).encode()) if w], b"\n"] for i, t in texts}
    c = Counter(w for i, ws in words.items() if not fold(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = {i: (fold(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in words.items()}
    for r in _rows(spark, "op8_lm"):
        held_out, tokens, known, total, base = want.pop(r.doc_id)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out, tokens, known, total) and abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score <= 0
    assert not want


def test_op9_base_columns(spark, texts):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for r in _rows(spark, "op9_license_scan"):
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(dict(texts)[r.doc_id])) if x]
        found = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in found]
        want = (len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_op10_removes_exact_copies(spark, texts):
    rows = {r.doc_id: r for r in _rows(spark, "op10_line_dedup")}
    assert set(rows) == {i for i, _ in texts}
    first = {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                if line in first:
                    assert k in {x.line_no for x in rows[i].removed}
                first.setdefault(line, (i, k))


def test_op6_knows_held_out_texts(spark):
    rows = {r.doc_id: r for r in queries.op6_toxicity(spark, "/root/testdata/sf0.1").collect()}
    known = duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.1/labels.parquet'").fetchall()
    held = [(rows[i].predicted, y) for i, y in known if i in rows and rows[i].held_out]
    toxic = [p for p, y in held if y]
    assert len(held) > 500 and sum(p == y for p, y in held) >= 0.97 * len(held) and sum(toxic) >= 0.85 * len(toxic)
