from pyspark.sql import functions as F
from tidewell.operators import conditions, evaluation, leaks, search, sessions, similarity, triage, usage

DOCS = [
    (1, "HDF5 old API fails", "HDF5 old API fails\nH5Fopen needs a compat macro in 1.14.2"),
    (2, "CMake cache is stale", "CMake cache is stale\nremove the cache folder and configure again"),
    (3, "Git rebase conflict", "Git rebase conflict\nabort the rebase and merge"),
]


def docs(spark):
    return spark.createDataFrame(DOCS, "id long, title string, body string")


def test_rank_finds_and_expands_typos(spark):
    q = spark.createDataFrame([(1, "compat macro"), (2, "cmkae cahce"), (3, "nothingatall zzzz"), (4, None)], "query_id long, text string")
    rows = search.rank(docs(spark), q, limit=3).collect()
    assert {(r.query_id, r.id) for r in rows if r["rank"] == 1} == {(1, 1), (2, 2)}


def test_rank_on_nothing(spark):
    empty = docs(spark).where("false")
    q = spark.createDataFrame([(1, "macro")], "query_id long, text string")
    assert search.rank(empty, q).collect() == []


def test_find(spark):
    names = docs(spark).select("id", "title", F.col("title").alias("name"))
    q = spark.createDataFrame([(1, "git reb"), (2, "cmkae"), (3, "hdf5 old"), (4, "qqqq")], "query_id long, text string")
    got = {r.query_id: (r.id, r.score) for r in search.find(names, q).where("rank = 1").collect()}
    assert got[1][0] == 3 and got[2] == (2, 55.0) and got[3][0] == 1 and 4 not in got


def _name_score(query, name):
    import re

    from brute import swap_distance

    q, c = query.strip().lower(), name.lower()
    words = lambda t: [w for w in re.split(r"[\W_]+", t) if w]
    if q and q in c:
        return 100.0 - min(len(c.encode()) / 100, 1.0)
    cost = 0
    for w in words(q):
        near = [0 if x.startswith(w) else min(swap_distance(w, x), swap_distance(w, x[: len(w)])) for x in words(c)]
        if not q or not near or min(near) > (1 if len(w) <= 4 else 2):
            return 0.0
        cost += min(near)
    return 80.0 if cost == 0 else 60.0 - 5.0 * cost


def test_find_equals_brute_force(spark):
    import random

    pick = random.Random(2)
    words = "cmake cache stale rebase git hdf5 old api fails größe conflict re cak".split()
    names = [(k, " ".join(pick.choices(words, k=pick.randint(1, 4)))) for k in range(60)]

    def bent(t):
        k = pick.randrange(max(1, len(t) - 1))
        return pick.choice([t, t[:k] + t[k + 1 : k + 2] + t[k : k + 1] + t[k + 2 :], t[:k] + t[k + 1 :], t[: k + 1], t + "z", t.upper()])

    asked = [(k, bent(pick.choice(names)[1])) for k in range(40)]
    n = spark.createDataFrame([(i, t, t) for i, t in names], "id int, title string, name string")
    found = search.find(n, spark.createDataFrame(asked, "query_id int, text string"), 100).collect()
    want = {(q, i): round(_name_score(t, c), 6) for q, t in asked if t.strip() for i, c in names}
    assert {(r.query_id, r.id): r.score for r in found} == {k: v for k, v in want.items() if v > 0}


def test_pairs_equal_brute_force(spark):
    import random

    pick = random.Random(3)
    rows = []
    for d in range(60):
        ws = {pick.choice("abcdefghijklmnopqrstuvwxyz" if pick.random() < 0.5 else "abcd"): pick.random() + 0.1 for _ in range(8)}
        norm = sum(w * w for w in ws.values()) ** 0.5
        rows += [(d, t, w / norm) for t, w in ws.items()]
    of = {}
    for d, t, w in rows:
        of.setdefault(d, {})[t] = w
    df = spark.createDataFrame(rows, "id int, term string, w double")
    dot = lambda a, b: min(1.0, round(sum(w * of[b].get(t, 0) for t, w in of[a].items()), 6))
    for least in (0.2, 0.6):
        want = {(a, b): dot(a, b) for a in of for b in of if a < b and dot(a, b) >= least}
        assert {(r.a, r.b): r.similarity for r in similarity.pairs(df, least).collect()} == want
        few = spark.createDataFrame([(k,) for k in range(0, 60, 7)], "id int")
        assert {(r.a, r.b): r.similarity for r in similarity.pairs(df, least, few).collect()} == {k: v for k, v in want.items() if k[0] % 7 == 0 or k[1] % 7 == 0}


def test_rerank_keeps_unrated_places(spark):
    hits = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (1, 4, 13)], "query_id long, rank int, id long")
    scores = spark.createDataFrame([(1, 10, 0.1), (1, 12, 0.9), (1, 13, 0.5)], "query_id long, id long, relevance double")
    assert [r.id for r in search.rerank(hits, scores).orderBy("rank").collect()] == [12, 11, 13, 10]


def test_first_match_counts_lines(spark):
    assert [tuple(r) for r in search.first_match(docs(spark), "macro", "id", "body", literal=True).collect()] == [(1, 2, "H5Fopen needs a compat macro in 1.14.2")]


def test_usage(spark):
    rows = [("a", 1, "2026-01-01T00", "worked"), ("a", 2, "2026-01-02T00", "irrelevant"), ("a", 3, "2026-01-03T00", "restored"), ("b", 4, "2026-01-01T00", "failed"), ("b", 5, "2026-01-02T00", "failed"), ("b", 6, "2026-01-02T00", "odd")]
    r = spark.createDataFrame(rows, "id string, seq long, time string, event string")
    c = usage.counts(r).withColumn("f", usage.factor()).withColumn("t", usage.tier(F.lit(True))).withColumn("d", usage.demotion())
    got = {x.id: x for x in c.collect()}
    assert got["a"].worked == 1 and got["a"].last_any == "2026-01-03" and got["a"].t == "proven" and got["a"].d is None
    assert got["b"].failed == 2 and got["b"].t == "candidate" and got["b"].d == "more harmful than helpful" and 0.9 <= got["b"].f < 1
    assert {x.id: x.n for x in usage.irrelevant_since_worked(r).collect()} == {"a": 0, "b": 0}
    assert usage.since_restored(r).where("id = 'a'").count() == 0


def test_similarity(spark):
    more = DOCS + [(4, "HDF5 old API fails", "HDF5 old API fails\nH5Fopen needs the compat macro in 1.14.2")]
    df = spark.createDataFrame(more, "id long, title string, body string")
    pairs = similarity.pairs(similarity.vectors(df), 0.4)
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 4)]
    assert {(r.id, r.cluster) for r in similarity.clusters(pairs).collect()} == {(1, 1), (4, 1)}
    assert {r.id for r in similarity.orphans(df, pairs).collect()} == {2, 3}


def test_clusters_of_a_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {r.cluster for r in similarity.clusters(chain).collect()} == {0}


def test_three_values(spark):
    records = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    wanted = spark.createDataFrame([(1, "os", "linux"), (1, "os", "mac"), (2, "tool", "hdf5@1.12:"), (3, "os", "mac"), (3, "host", "x")], "id long, key string, value string")
    facts = spark.createDataFrame([("os", "linux"), ("tool", "hdf5@1.10")], "key string, fact string")
    got, _ = conditions.verdicts(records, wanted, facts)
    assert {r.id: (r.applies, r.no_keys) for r in got.collect()} == {1: (True, []), 2: (False, ["tool"]), 3: (False, ["os"]), 4: (True, [])}


def test_labels(spark):
    r = spark.createDataFrame([(1, "general/git/a.md", {"team": "x"}), (2, "general/git/b.md", {})], "id long, path string, labels map<string,string>")
    notes = spark.createDataFrame([("general", {"team": "far"}), ("general/git", {"team": "near"})], "folder string, labels map<string,string>")
    got = {(x.id, x.key): x.value for x in conditions.effective_labels(r, notes, {"sensitivity": "internal"}).collect()}
    assert got == {(1, "team"): "x", (2, "team"): "near", (1, "sensitivity"): "internal", (2, "sensitivity"): "internal"}


def test_metrics_without_denominator(spark):
    rows = spark.createDataFrame([(True, False, "silent", False, 1)], "expects boolean, ranked boolean, decision string, correct_top boolean, rank int")
    m = evaluation.reviewed_metrics(rows).first()
    assert m.eligible == 0 and m.precision is None and m.coverage is None


def test_sessions(spark):
    kinds = ["failed", "failed", "failed", "injected", "ok", "ok"]
    r = spark.createDataFrame([("s", k, kind, "make", 7) for k, kind in enumerate(kinds)], "session string, seq long, kind string, program string, id long")
    assert [x.seq for x in sessions.fixes(r).where("fixed").collect()] == [4]  # the injection between doesn't count, nor the second success
    r2 = spark.createDataFrame([("s", k, kind, "make", 7) for k, kind in enumerate(["failed", "injected", "failed", "failed", "ok"])], "session string, seq long, kind string, program string, id long")
    assert [x.seq for x in sessions.fixes(r2).where("fixed").collect()] == [4]
    assert [x.id for x in sessions.inferred(r2).collect()] == [7]
    worth = sessions.worth(r2.withColumn("kind", F.when(F.col("kind") == "ok", "fixed").otherwise(F.col("kind"))))
    assert worth.first().score == 2


def test_triage(spark):
    c = spark.createDataFrame(
        [("todo: finish", "note", []), ("Always pin the compiler", "note", ["remember"]), ("x", "transcript", ["fixed ls"]), ("x", "transcript", ["fixed cmake"])],
        "text string, kind string, signals array<string>",
    )
    assert [r.x for r in c.select(triage.rule(F.col("text"), F.col("kind"), F.col("signals")).alias("x")).collect()] == ["drop", "keep", "drop", None]


def test_leaks(spark):
    d = spark.createDataFrame([(1, "mail bob@x.org\nsee /home/bob/a and /scratch/$USER/x"), (2, "git@host.org:x job_id = 12"), (3, None), (4, "")], "id long, t string")
    got = {(r.id, r.line_no, r.rule, r.found) for r in leaks.scan(d, "id", "t").collect()}
    assert got == {(1, 1, "leak/email", "bob@x.org"), (1, 2, "leak/path", "/home/bob/a"), (2, 1, "leak/job-id", "job_id = 12")}
    clean = {r.id: r.x for r in d.select("id", leaks.redact(F.col("t"), home="/home/bob").alias("x")).collect()}
    assert clean[1] == "mail <email>\nsee ~/a and /scratch/$USER/x" and clean[3] is None


def test_order_of_pairs(spark):
    rows = [("b", "c", 0.5), ("a", "d", 0.5), ("a", "c", 0.5), ("c", "d", 1.0), ("a", "b", 0.25)]
    got = similarity.in_order(spark.createDataFrame(rows, "a string, b string, similarity double").repartition(3))
    placed = {(r["a"], r["b"]): r["place"] for r in got.collect()}
    assert placed == {("c", "d"): 1, ("a", "c"): 2, ("a", "d"): 3, ("b", "c"): 4, ("a", "b"): 5}
    assert similarity.in_order(spark.createDataFrame([], "a string, b string, similarity double")).collect() == []


def test_places_equal_a_window(spark):
    from pyspark.sql import Window
    from tidewell.operators import ranks

    rows = spark.range(500).select(((F.col("id") * 37) % 101).alias("a"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id")).alias("b"), "id")
    order = [F.desc("a"), F.asc_nulls_first("b"), "id"]
    w = Window.orderBy(*order)
    want = rows.select("id", F.row_number().over(w).alias("place"), F.sum("id").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("place_total"))
    got = ranks.placed(rows.repartition(7), *order, total=F.col("id"))
    assert sorted(map(tuple, got.select("id", "place", "place_total").collect())) == sorted(map(tuple, want.collect()))
    assert got.columns == ["a", "b", "id", "place", "place_total"] and ranks.placed(rows.where("false"), "a").collect() == []


def test_pairs_over_blocks_and_what_hangs_on_them(spark, monkeypatch):
    """Blocks of a few records, sums of a few cells: the same pairs, without rows for the products between."""
    import random

    pick = random.Random(5)
    rows = [(f"r{d:02d}", t, pick.random() + 0.1) for d in range(40) for t in pick.sample("abcdefghijklmnop", 4)]
    of = {}
    for d, t, w in rows:
        of.setdefault(d, {})[t] = w
    dot = lambda a, b: min(1.0, round(sum(w * of[b].get(t, 0) for t, w in of[a].items()), 6))
    want = {(a, b): dot(a, b) for a in of for b in of if a < b and dot(a, b) >= 0.5}
    for name, size in (("BLOCK_RECORDS", 7), ("CELLS", 20), ("PRODUCTS", 5), ("JOINED", 3)):
        monkeypatch.setattr(similarity, name, size)
    vecs = spark.createDataFrame(rows, "id string, term string, w double")
    found = similarity.pairs(vecs, 0.5)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.a, r.b): r.similarity for r in found.collect()} == want
    few = spark.createDataFrame([(f"r{k:02d}",) for k in range(0, 40, 3)], "id string")
    mine = {x[0] for x in few.collect()}
    assert {(r.a, r.b): r.similarity for r in similarity.pairs(vecs, 0.5, few).collect()} == {k: v for k, v in want.items() if mine & set(k)}
    label = {x: x for pair in want for x in pair}
    for a, b in list(want) * len(label):
        label[a] = label[b] = min(label[a], label[b])
    assert {(r.id, r.cluster) for r in similarity.clusters(found).collect()} == set(label.items())
    best = {(r.a, r.b) for r in similarity.nearest(found, 2).collect()}
    by = {x: sorted((v for k, v in want.items() if x in k), reverse=True)[:2] for x in label}
    assert best == {k for k, v in want.items() if any(v >= by[x][-1] for x in k)}


def test_holding_meets_by_inner_pieces(spark):
    texts = ["a long word here", "along word here", "long wordy here", "x a long word", "ends long", "  two  spaces ", None, "word", "a word a word a"]
    asked = ["g word h", "long word", "a long word", "word", "two  sp", " ", "  ", "", None, "word a word", "d a w"]
    r = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, q string")
    want = sorted((k, i) for k, x in enumerate(asked) for i, t in enumerate(texts) if x is not None and t is not None and x in t)
    got = search.holding(r, "t", q, ["id"])
    assert sorted((x.query_id, x.id) for x in got.collect()) == want
    plain = search.holding(r, "t", q.where("query_id IN (0, 2)"), ["id"])
    assert "NestedLoop" not in plain._jdf.queryExecution().executedPlan().toString()
