import functools
import random

from pyspark.sql import functions as F
from tidewell.functions import edits, text, versions


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string'}" for k in values)).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    cases = {
        "The H5Fopen call": ["h5fopen", "h5", "fopen", "call"],
        "use v1.14.2-rc1!": ["use", "v1.14.2-rc1"],
        "HTTPServer": ["httpserver", "http", "server"],
        "foo_bar/baz": ["foo_bar/baz", "foo", "bar", "baz"],
        "a I x": [],
        "": [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for row in df.select("t", text.tokens(F.col("t")).alias("x")).collect():
        assert row.x == cases[row.t], row.t
    assert spark.createDataFrame([(None,)], "t string").select(text.tokens(F.col("t")).alias("x")).first().x is None


def swap_distance(a, b):
    """By trying: the least over all ways to go on from the ends of both."""

    @functools.cache
    def of(i, j):
        if not i or not j:
            return i + j
        ways = [of(i - 1, j) + 1, of(i, j - 1) + 1, of(i - 1, j - 1) + (a[i - 1] != b[j - 1])]
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            ways.append(of(i - 2, j - 2) + 1)
        return min(ways)

    return of(len(a), len(b))


def _random_words(seed, n):
    pick = random.Random(seed)
    return ["", "cmkae", "cmake", "abc", "ca", "é🙂a", *["".join(pick.choice("abcé") for _ in range(pick.randint(0, 10))) for _ in range(n)]]


def test_swap_distance(spark):
    assert (swap_distance("cmkae", "cmake"), swap_distance("ca", "abc")) == (1, 3)
    words = _random_words(41, 40)
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in df.select("a", "b", edits.distance(F.col("a"), F.col("b")).alias("d")).collect():
        assert r.d == swap_distance(r.a, r.b), r
    assert one(spark, edits.distance(F.col("a"), F.lit("x")), a=None) is None
    plan = df.select(edits.distance(F.col("a"), F.col("b")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_near_words_equal_brute_force(spark):
    from tidewell.operators import search

    words, terms = sorted(set(_random_words(42, 600))), sorted(set(_random_words(43, 80)))
    reach = lambda t: 0 if len(t) <= 3 else 1 if len(t) <= 7 else 2
    want = {(t, w, d) for t in terms if reach(t) for w in words if len(w) >= 1 and (d := swap_distance(t, w)) <= reach(t)}
    table = lambda x: spark.createDataFrame([(w,) for w in x], "term string")
    found = search.near_words(table(terms), table(words)).collect()
    assert len(want) > 100 and len(found) == len(want) and {tuple(r) for r in found} == want
    assert search.near_candidates(table(terms), table(words)).count() <= 10 * len(want)


def test_program_and_key_lines(spark):
    assert one(spark, text.program(F.col("c")), c="A=1 ('/usr/bin/cmake' -S .") == "cmake"
    assert one(spark, text.key_lines(F.col("e")), e="one\ntwo error here\nthree") == ["two error here"]
    assert one(spark, text.key_lines(F.col("e")), e="Exit code 1\na\nb\nc\nd") == ["b", "c", "d"]


def test_signature_ignores_numbers_and_paths(spark):
    sig = text.signature(F.col("c"), F.col("e"))
    a = one(spark, sig, c="make", e="fatal error at line 12 in /home/x/a.c")
    assert a == one(spark, sig, c="make", e="fatal error at line 99 in /tmp/b.c")
    assert a != one(spark, sig, c="ninja", e="fatal error at line 12 in /home/x/a.c")


def test_error_query_stops_at_its_bound(spark):
    words = " ".join(f"word{k}x" for k in range(60))
    q = one(spark, text.error_query(F.col("c"), F.col("e")), c="make all", e="error " + words)
    assert q.startswith("make error") and one(spark, F.size(text.tokens(F.col("q"))), q=q) <= 40


def test_signals_and_typed_text(spark):
    s = one(spark, text.prompt_signals(F.col("p")), p="No, use the other one. Do you remember? i don't see it")
    assert s.correction and not s.remember
    assert one(spark, text.typed_text(F.col("p")), p="hi <system-reminder>x\ny</system-reminder> there") == "hi  there"


def test_slug_and_jaccard(spark):
    assert one(spark, text.slug(F.col("t")), t="Old API: needs a Compat macro!") == "old-api-needs-a-compat-macro"
    words = lambda c: F.split(c, " ")
    assert one(spark, text.jaccard(words(F.col("a")), words(F.col("b"))), a="a b c", b="b c d") == 0.5


def test_versions_sort(spark):
    rising = ["1.14.0-rc1", "1.14.0", "1.14.0.1", "1.14.1", "1.15", "v2", "develop"]
    df = spark.createDataFrame([(v,) for v in reversed(rising)], "v string")
    assert [r.v for r in df.orderBy(versions.key(F.col("v"))).collect()] == rising


def test_ranges(spark):
    cases = [("1.12.3", ":1.12", True), ("1.13", ":1.12", False), ("1.12.3", "1.12", True), ("1.1", "1.2:", False), ("1.2", "1.2:1.4", True), ("1.4.9", "1.2:1.4", True), ("?", "1:", None)]
    for v, spec, expected in cases:
        assert one(spark, versions.in_range(F.col("v"), F.col("s")), v=v, s=spec) == expected, (v, spec)
