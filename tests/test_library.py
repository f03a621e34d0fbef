"""Operators of the record library that have no SQL, and the readers and writers beside them."""

import json
import random
import subprocess

import pytest
from pyspark.sql import functions as F
from tidewell.functions import markdown
from tidewell.operators import digest, full_search, graph, hooks, lint, reports, writes
from tidewell.sources import readers, writers

BODY = """# A title #

intro with `src/io/reader.rs` and `deadbee1` and `../up.rs`
## Symptom
See [a](b%20c.md#part), ![pic](x.assets/p.png "t") and `[no](link.md)`.

```sh
# not a title
[x](in-fence.md)
```
- item

    still in the list
## Fix ##

    indented code
~~~~
```
~~~~
"""


def _one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(column).first()[0]


def test_structure(spark):
    s = _one(spark, markdown.structure(F.col("c0")), BODY)
    assert [(t.line, t.text) for t in s.titles] == [(1, "A title")] and s.first == 1
    assert [(x.heading, x.line, x.filled, x.fences) for x in s.sections] == [("Symptom", 4, True, [0]), ("Fix", 14, True, [1])]
    assert [(f.line, f.lang) for f in s.fences] == [(7, "sh"), (17, "")] and s.code == [16]
    assert [(x.line, x.target, x.image) for x in s.links] == [(5, "b%20c.md#part", False), (5, "x.assets/p.png", True)]
    assert [(a.kind, a.name) for a in s.anchors] == [("path", "src/io/reader.rs"), ("commit", "deadbee1")]
    empty = _one(spark, markdown.structure(F.col("c0")), None)
    assert empty.titles == [] and empty.first is None


@pytest.mark.parametrize(
    "source,target,want",
    [
        ("general/t/a.md", "b%20c.md#x", (True, "general/t/b c.md")), ("general/t/a.md", "../u/./b.md?q", (True, "general/u/b.md")), ("general/t/a.md", "../../../b.md", (True, None)),
        ("general/t/a.md", "https://x.y/z", (False, None)), ("general/t/a.md", "#part", (False, None)), ("general/t/a.md", "/abs.md", (False, None)), ("a.md", "b.md", (True, "b.md")), ("a.md", "mailto:x", (False, None)),
    ],
)
def test_resolve(spark, source, target, want):
    assert tuple(_one(spark, markdown.resolve(F.col("c0"), F.col("c1")), source, target)) == want


def test_small_text_functions(spark):
    assert _one(spark, markdown.relative(F.col("c0"), F.col("c1")), "general/t/a.md", "general/u/x/b.md") == "../u/x/b.md"
    assert _one(spark, markdown.relative(F.col("c0"), F.col("c1")), "general/t/a.md", "general/t/b.md") == "b.md"
    for url, want in [("git@Host.org:a/b.git", "host.org/a/b"), ("https://u@h.org:8/a/b/", "h.org/a/b"), ("ssh://git@h/a.git", "h/a"), ("/srv/x.git/", "srv/x"), ("h.org/a", "h.org/a")]:
        assert _one(spark, markdown.address(F.col("c0")), url) == want
    globbed = F.rlike(F.col("c1"), markdown.glob(F.col("c0")))
    assert _one(spark, globbed, "tuo*[12].x", "tuolumne1.x") and not _one(spark, globbed, "a?c", "abbc") and _one(spark, globbed, "src/**/x.?", "src/a/b/x.c")
    assert _one(spark, markdown.without_reminders(F.col("c0")), "a<system-reminder>x</system-reminder>b<system-reminder>y") == "ab"
    assert _one(spark, markdown.quotes_match(F.array("c0"), F.col("c1")), "a  b", "x a\nb y") and not _one(spark, markdown.quotes_match(F.array("c0"), F.col("c1")), "a c", "x a b")
    assert _one(spark, markdown.quotes_error(F.col("c0"), F.col("c1")), "fatal: No rule to make it!", "see `no rule to make` here")
    assert not _one(spark, markdown.quotes_error(F.col("c0"), F.col("c1")), "no rules to make", "see `no rule to make` here")
    assert _one(spark, markdown.preview(F.col("c0")), "# t\n[3 lines cut]\n[user] <x>\n[user] build it\n") == "build it"
    assert _one(spark, markdown.preview(F.col("c0")), "- 2026-01-02 [high] (fact; general) uses v2") == "fact: uses v2"
    assert _one(spark, markdown.description(F.col("c0"), 30), "You set the tool up again") == "Load before you you set the"
    assert _one(spark, markdown.pair_hash(F.col("c0"), F.col("c1"), F.col("c2"), F.col("c3")), "b", "tb", "a", "ta") == _one(spark, markdown.pair_hash(F.col("c0"), F.col("c1"), F.col("c2"), F.col("c3")), "a", "ta", "b", "tb")


def test_injected_block(spark):
    lessons = [("1", "a <note>x", "sum", "2026-01-01", "ran", "yes", "proven", ["n"]), ("2", "t" * 400, "", "d", "h", "a", "candidate", []), ("3", "z" * 900, "z" * 900, "d", "h", "a", "proven", ["y" * 900])]
    df = spark.createDataFrame([(lessons,)], "l array<struct<id:string,title:string,summary:string,verified:string,how:string,applies:string,tier:string,notes:array<string>>>")
    out = df.select(markdown.injected(F.col("l"), "note", "Intro.", "show")).first()[0]
    assert out.startswith('Intro.\n<note id="1" verified="2026-01-01" how="ran" applies="yes">\na [note>x - sum\nn\nRead it with `show 1`.\n</note>')
    assert '<note id="2">' + "t" * 299 + "… - `show 2`</note>" in out and 'id="3"' not in out


def test_digest_parts_and_representatives_equal_loops(spark):
    pick = random.Random(5)
    sizes = [(s, k, pick.choice([10, 25_000, 59_990, 70_000])) for s in "ab" for k in range(40)]
    df = spark.createDataFrame(sizes, "session string, step int, n int").select("session", "step", F.array(F.repeat(F.lit("x"), F.col("n"))).alias("lines"))
    want = {}
    for s in "ab":
        part = size = 0
        for _, k, n in (x for x in sizes if x[0] == s):
            n = min(n, 59_999)
            if size and size + 1 + n > 60_000:
                part, size = part + 1, 0
            size += n + (1 if size else 0)
            want[s, k] = part
    assert {(r.session, r.step): r.part for r in digest.digest_parts(df).collect()} == want
    items = [(k, pick.randint(0, 5), [f"g{pick.randint(0, 60)}" for _ in range(pick.randint(0, 3))]) for k in range(80)]
    seen, kept = set(), set()
    for item, _, sigs in sorted(items, key=lambda x: (x[1], x[0])):
        new = next((g for g in sigs if g not in seen), None)
        if not sigs or new:
            kept.add(item)
            seen |= {new} - {None}
    places = {x[0]: n for n, x in enumerate(sorted(items, key=lambda x: (x[1], x[0])))}
    df = spark.createDataFrame([(i, places[i], s) for i, _, s in items], "item int, place int, signatures array<string>")
    assert {r.item for r in digest.representatives(df).collect()} == kept


def test_answers(spark):
    said = spark.createDataFrame([(1, "- [3] keep: it is new"), (2, "3 drop late"), (3, "nothing"), (4, "4) DROP")], "line_no int, line string")
    assert {tuple(r) for r in digest.answers(said).collect()} == {(3, "keep", "it is new"), (4, "drop", "")}


def _transcript(spark, lines, reader):
    df = spark.createDataFrame([("s", k, json.dumps(x)) for k, x in enumerate(lines)], "session string, seq long, line string")
    return [(r.kind, r.text, r.command, r.ok, r.output, r.name) for r in reader(df).orderBy("step").collect()]


def test_message_dialect(spark):
    at = "2026-01-01T10:00:00Z"
    lines = [
        {"type": "message", "timestamp": at, "message": {"role": "user", "content": [{"type": "text", "text": "build"}]}},
        {"type": "message", "timestamp": at, "message": {"role": "assistant", "content": [{"type": "toolCall", "id": "1", "name": "bash", "arguments": {"command": "make"}}, {"type": "toolCall", "id": "2", "name": "Read", "arguments": {"path": "f.c"}}]}},
        {"type": "message", "timestamp": at, "message": {"role": "toolResult", "toolCallId": "1", "isError": True, "content": "no rule\nCommand exited with code 2\n"}},
        {"type": "other"},
    ]
    assert _transcript(spark, lines, readers.message_steps) == [
        ("time", "2026-01-01 10:00", None, None, None, None), ("prompt", "build", None, None, None, None), ("tool", "f.c", None, None, None, "read"), ("command", None, "make", False, "Exit code 2\nno rule", None),
    ]


def test_files_and_logs(spark, tmp_path):
    for rel, content in {"general/t/a.md": "x", "general/t/build/b.md": "x", "general/t/a.assets/p.png": "x", ".hid/c.md": "x", "kb.toml": "#", "other/d.md": "x"}.items():
        (tmp_path / "kb" / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "kb" / rel).write_text(content)
    found = readers.files(spark, str(tmp_path / "kb"), ["build/", "# no", "*.png", "!p.png"])
    assert {r.path for r in found.collect()} == {"general/t/a.md", "general/t/a.assets/p.png", "kb.toml"}
    roles = spark.createDataFrame([("general/README.md",), ("projects/p/README.md",), ("general/t/README.md",), ("systems/s/t/README.md",), ("general/a/b/README.md",)], "p string")
    assert [r[0] for r in roles.select(readers.note_role(F.col("p"))).collect()] == ["scope", "project", "topic", "topic", "misplaced"]
    (tmp_path / "w.jsonl").write_text('{"time":100,"id":"a","session":"s"}\nbad\n{"time":900000,"id":"b","session":"s","kind":"edit"}\n{"time":900000,"id":"c","session":"s","kind":"add"}\n')
    assert {r.id for r in readers.log(spark, "written", str(tmp_path / "w.jsonl"), 900_000, 1).collect()} == {"c"}
    writers.append(spark.createDataFrame([(1, "a")], "time long, id string"), str(tmp_path / "log"))
    writers.append(spark.createDataFrame([(2, "b")], "time long, id string"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_git_index(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.md").write_text("staged\n")
    run("add", "a.md")
    (tmp_path / "a.md").write_text("changed\n")
    assert [(r.path, bytes(r.content)) for r in readers.staged(spark, str(tmp_path)).collect()] == [("a.md", b"staged\n")]


def test_notes_imports_settings_manifests(spark):
    files = spark.createDataFrame([("m/a.md", "---\nname: N\nmetadata:\n  type: user\ndescription: D\n---\nbody\n"), ("m/MEMORY.md", "x"), ("m/b.md", "plain")], "path string, text string")
    assert {tuple(r) for r in readers.memory_notes(files).collect()} == {("m/a.md", "From memory (user): N\nD\n\nbody"), ("m/b.md", "From memory (note): b\n\nplain")}
    parts = spark.createDataFrame([("C.md", "# Top\nx\n## One\na\n## Two\nb\n")], "path string, text string")
    assert [r.source for r in readers.sectioned_notes(parts).collect()] == ["C.md#Top", "C.md#One", "C.md#Two"]
    rows = spark.createDataFrame([("t/a.md", bytearray(b"ok")), ("t/README.md", bytearray(b"x")), ("a.md", bytearray(b"x")), ("t/c.md", bytearray(b"\xff\xfe"))], "path string, content binary")
    good, bad = readers.import_folder(rows)
    assert [tuple(r) for r in good.collect()] == [("t/a.md", "t", "ok")] and {r.source for r in bad.collect()} == {"t/README.md", "a.md", "t/c.md"}
    s = readers.settings('[labels]\nsensitivity = ["public", "internal"]\n[sinks.site]\nallow = { sensitivity = ["public"] }\n[dupes]\nmin = 0.5\n')
    assert s.sinks == {"site": {"sensitivity": ["public"]}} and s.tables == {"dupes": {"min": 0.5}} and s.order(spark).count() == 2
    q = readers.manifest(spark, '[[query]]\ntext = "a"\nexpect = ["x"]\n[[query]]\ntext = "b"\nexpect = []\nmode = "literal"\n')
    assert [(r.text, r.mode, r.expect) for r in q.collect()] == [("a", "search", ["x"]), ("b", "literal", [])]
    with pytest.raises(ValueError):
        readers.manifest(spark, '[[query]]\ntext = "a"\nodd = 1\n')
    fresh, seen = readers.new_messages(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "msg_id string, time long"), spark.createDataFrame([("b", 0)], "msg_id string, time long"), 1)
    assert [(r.msg_id, r.time) for r in fresh.collect()] == [("a", 1)] and [r.msg_id for r in seen.collect()] == ["a"]


def test_records_are_written_as_they_are_read(spark, tmp_path):
    text = "---\nschema: 1\nid: 0123456789\ntype: pitfall\nstatus: active\nwhen:\n  os: linux\n  cuda:\n  - '11'\n  - '12'\nverified: '2026-01-01'\ntags:\n- a\nqueries:\n- 'no: rule'\nlabels:\n  sensitivity: public\n---\n# T\nbody\n"
    (tmp_path / "general/git").mkdir(parents=True)
    (tmp_path / "general/git/a.md").write_text(text.replace("id: 0123456789", "id: '0123456789'"))
    good, _ = readers.lessons(spark, str(tmp_path))
    out = tmp_path / "out/general/git"
    out.mkdir(parents=True)
    (row,) = writers.as_files(good).collect()
    (out / "a.md").write_text(row.content)
    again, _ = readers.lessons(spark, str(tmp_path / "out"))
    assert [r.asDict() for r in again.drop("body_line").collect()] == [r.asDict() for r in good.drop("body_line").collect()] and row.content.endswith("---\n# T\nbody\n")
    both, _ = readers.knowledge_bases(spark, {"": str(tmp_path / "general"), "x": str(tmp_path / "out")})
    assert {r.qualified_id for r in both.where("kb = 'x'").collect()} == {"x:0123456789"}


def test_moved_links_keep_their_forms(spark):
    rows = [("1", "general/t/a.md", "x [l](b.md) [m](<b.md>) [n](b.md \"t\") `[c](b.md)` [o](other.md#z)"), ("2", "general/t/b.md", "[up](a.md#p) [web](https://b.md)"), ("3", "general/u/c.md", "[x](../t/b.md)")]
    df = spark.createDataFrame(rows, "id string, path string, body string")
    moves = spark.createDataFrame([("general/t/b.md", "projects/p/t/b.md")], "path string, to string")
    got = {r.id: (r.path, r.body) for r in writes.moved(df, moves).collect()}
    to = "../../projects/p/t/b.md"
    assert got["3"] == ("general/u/c.md", f"[x]({to})") and got["2"] == ("projects/p/t/b.md", "[up](../../../general/t/a.md#p) [web](https://b.md)")
    assert f"[l]({to})" in got["1"][1] and f"(<{to}>)" in got["1"][1] and f'({to} "t")' in got["1"][1] and "`[c](b.md)` [o](other.md#z)" in got["1"][1]


def test_added_records_find_free_names(spark):
    old = spark.createDataFrame([("o1", "general/t/a-b.md", "A b"), ("o2", "general/t/a-b-2.md", "A b"), ("o3", "general/t/x.md", "One two three four")], "id string, path string, title string")
    new = spark.createDataFrame([("n1", "al", {}, "A b"), ("n2", "t", {}, "A b!"), ("n3", "t", {"project": ["p"]}, "A b"), ("n4", "t", {}, "one two three five")], "id string, topic string, when map<string,array<string>>, title string")
    made = writes.added(new, old, "2026-01-01", spark.createDataFrame([("al", "t")], "alias string, topic string"))
    assert {r.id: r.path for r in made.collect()} == {"n1": "general/t/a-b-3.md", "n2": "general/t/a-b-4.md", "n3": "projects/p/t/a-b.md", "n4": "general/t/one-two-three-five.md"}
    assert {(r.id, r.other) for r in writes.similar_titles(made, old).collect()} == {("n1", "o1"), ("n1", "o2"), ("n2", "o1"), ("n2", "o2"), ("n4", "o3")}


def test_rerank_chain_and_guard(spark):
    hits = spark.createDataFrame([(1, "q", 1, "a", "text a"), (1, "q", 2, "b", "mail me@x.org"), (2, "write to me@x.org", 1, "a", "text a")], "query_id int, query string, rank int, id string, item string")
    broken = lambda q, items: [0.5]
    good = lambda q, items: [len(i) / 100 for i in items]
    rows = full_search.rerank_chain(hits, {"one": broken, "two": good}, ["one", "two", "bm25"]).collect()
    assert {(r.query_id, r.id, r.backend) for r in rows if r.query_id == 1} == {(1, "a", "two"), (1, "b", "two")} and rows[0].skipped in (["one: returned 1 scores for 2 items"], [])
    plain = full_search.rerank_chain(hits, {"two": good}, ["two", "bm25"], {"two": "not allowed"}).collect()
    assert {(r.backend, r.relevance, tuple(r.skipped)) for r in plain} == {("bm25", None, ("two: not allowed",))}
    labels = spark.createDataFrame([("a", {"sensitivity": "public"}), ("b", {"sensitivity": "public"})], "id string, labels map<string,string>")
    sent = {(r.query_id, r.id): r.sent for r in full_search.may_be_sent(hits, labels, {"sensitivity": ["public"]}).collect()}
    assert sent == {(1, "a"): True, (1, "b"): False, (2, "a"): False}
    assert [(r.id, r.relevance) for r in full_search.novelty(spark.createDataFrame(rows)).where("query_id = 1").collect()] == [("b", 0.13)]


def test_unmatched_looks_both_ways(spark):
    records = spark.createDataFrame([("a", ["No  Rule"]), ("b", ["xx no rule here yy"]), ("c", ["other"]), ("d", ["r"]), ("e", [])], "id string, queries array<string>")
    log = spark.createDataFrame([("make: no rule here",), (" no rule",)], "query string")
    assert {r.id for r in reports.unmatched(records, log).collect()} == {"c"}
    assert reports.unmatched(records, log.where("false")).collect() == []


def test_probes_and_tiers_decide(spark):
    found = spark.createDataFrame([(1, "a", 3.0, 1), (1, "b", 2.0, 2), (1, "c", 1.0, 3)], "query_id int, id string, score double, place int")
    records = spark.createDataFrame([("a", "active", "2020-01-01"), ("b", "active", None), ("c", "archived", None)], "id string, status string, expires string")
    queries = spark.createDataFrame([(1, False)], "query_id int, everywhere boolean")
    wanted = spark.createDataFrame([("b", "os", "linux")], "id string, key string, value string")
    facts = spark.createDataFrame([(1, "os", "mac")], "query_id int, key string, fact string")
    counts = spark.createDataFrame([("b", 2)], "id string, worked long")
    probes = spark.createDataFrame([("a", False), ("b", True)], "id string, passed boolean")
    hits, hidden = full_search.results(found, records, queries, wanted, facts, counts, "2026-01-01", 5)
    assert [(r.id, r["rank"], r.status, r.tier, r.expired) for r in hits.orderBy("rank").collect()] == [("a", 1, "stale", "candidate", True), ("c", 2, "archived", "archive", False)]
    assert [(r.key, r.n) for r in hidden.collect()] == [("os", 1)]
    hits, hidden = full_search.results(found, records, queries, wanted, facts, counts, "2026-01-01", 5, probes)
    assert [r.id for r in hits.orderBy("rank").collect()] == ["c"] and {(r.key, r.n) for r in hidden.collect()} == {("probe", 1), ("os", 1)}


def test_hooks_strength(spark):
    hit = [(1, 1, "a", "pitfall", "active", None, "proven", None, "use `make -j4 all` when no rule applies to target x")]
    hits = spark.createDataFrame(hit, "event int, rank int, id string, type string, status string, applies boolean, tier string, relevance double, body string")
    asked = spark.createDataFrame([(1, "s", "error: make -j4 all failed, no rule applies to target")], "event int, session string, text string")
    none = spark.createDataFrame([], "session string, id string")
    misses = spark.createDataFrame([], "id string, n long")
    push = lambda **k: [r.id for r in hooks.pushed(hits, asked, none, misses, none, **k).collect()]
    assert push() == ["a"] and push(g=hooks.Strength(quoted=True)) == ["a"] and push(recall=True) == [] and push(g=hooks.Strength(coverage=1.1)) == []
    assert hooks.pushed(hits, asked, none, spark.createDataFrame([("a", 3)], "id string, n long"), none).collect() == []


def test_findings_are_ordered(spark):
    rows = spark.createDataFrame([("b", 2, "error", "r", "m"), ("a", 3, "warning", "r", "m"), ("a", None, "warning", "z", "m"), ("a", 3, "error", "r", "m")], "path string, line int, severity string, rule string, message string")
    assert [(r.path, r.line, r.severity) for r in lint.ordered(rows).orderBy("place").collect()] == [("a", None, "warning"), ("a", 3, "error"), ("a", 3, "warning"), ("b", 2, "error")]
    names = graph.cluster_order(spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (9, 9)], "id int, cluster int"))
    assert [(r.place, r.cluster, r.size) for r in names.collect()] == [(1, 3, 3), (2, 1, 2)]


def test_commits_and_paths_decide(spark):
    records = spark.createDataFrame([(k,) for k in range(6)], "id int")
    wanted = spark.createDataFrame([(0, "since", "a"), (1, "until", "a"), (2, "since", "zz"), (3, "path", "src/*.c"), (4, "path", "doc/*")], "id int, key string, value string")
    facts = spark.createDataFrame([("path", "src/x/y.c")], "key string, fact string")
    known = spark.createDataFrame([("a", True)], "commit string, is_ancestor boolean")
    from tidewell.operators import conditions

    got = lambda *more: {r.id: r.applies for r in conditions.verdicts(records, wanted, facts, *more)[0].collect()}
    assert got(known) == {0: True, 1: False, 2: None, 3: True, 4: False, 5: True}
    assert got() == {0: None, 1: None, 2: None, 3: True, 4: False, 5: True}


def test_literal_places_once_for_each_scope(spark):
    from tidewell.operators import full_search

    r = spark.createDataFrame([(k, f"t{k % 3}", "x here" if k % 2 else "none", ["general", "projects", "systems"][k % 3], f"o{k % 2}") for k in range(24)], "id int, title string, text string, scope string, owner string")
    q = spark.createDataFrame([(k, [None, "o1"][k % 2], [None, "o0", "o1"][k % 3], k % 5 == 0) for k in range(30)], "query_id int, project string, system string, everywhere boolean")
    got = full_search.literal(r, q, "here")
    want = set()
    for k in q.collect():
        rows = []
        for x in r.where("text LIKE '%here'").collect():
            rank = 0 if x.scope == "projects" and x.owner == k.project else 1 if x.scope == "systems" and x.owner == k.system else 2
            if k.everywhere or x.scope == "general" or rank < 2:
                rows.append((rank, x.title, x.id))
        want |= {(k.query_id, n, x[2]) for n, x in enumerate(sorted(rows), 1)}
    assert {(x.query_id, x.place, x.id) for x in got.collect()} == want and got.count() == len(want)
    # places are numbered for scopes, not for queries
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") > plan.index("Repartition") > plan.index("Join")


def test_shared_keys_meets_classes(spark):
    r = spark.createDataFrame([(k, ["active", "stale", "archived"][k % 3], [f"b{k % 4}", "all"] if k % 5 else [], {f"o{k % 2}": "x"} if k % 3 else None) for k in range(30)], "id int, status string, tags array<string>, when map<string,string>")
    from tidewell.operators import graph

    keys = {x.id: (x.status, {f"tag:{t}" for t in x.tags} | {f"when:{t}" for t in x.when or {}}) for x in r.collect()}
    want = {(a, b, tuple(sorted(keys[a][1] & keys[b][1]))) for a in keys for b in keys if a != b and keys[b][0] != "archived" and keys[a][1] & keys[b][1]}
    assert {(x.a, x.b, tuple(x.shared)) for x in graph.shared_keys(r).collect()} == want
    few = spark.createDataFrame([(3,), (4,)], "id int")
    assert {(x.a, x.b, tuple(x.shared)) for x in graph.shared_keys(r, few).collect()} == {w for w in want if w[0] in (3, 4)}
    plan = graph.shared_keys(r)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") > plan.index("Join")  # nothing is grouped after the pairs of records
