"""Bodies of a random grammar: what a line is, said by its definition, against the columns that find it out."""

import random
import re

from pyspark.sql import functions as F
from tidewell.functions import markdown
from tidewell.operators import digest, writes

LINES = [
    "", "", "  ", "text", "more text", "- item", "  12. item", "*no item", "    set in", "\tset in too", "     - set in", "```", "```sh", "````", "~~~ a b", "   ```", "    ```", "``` x", "~~~~",
    "# Title", "## Fix", "## Fix ##", "### Sub", "#none", "##", "## ", "See [a](x/y.md) and ![b](<p.png> \"t\").", "`[no](z.md)` [`c`](d.md#e) `src/a.py`", "`3f9a1c0d2e` and ``./b.sh`` `v1.2` `../c.md`", "[x](a b) [y]( q.md )", "text\r",
]
LINK = re.compile(r'(!?)\[[^\]]*\]\(\s*<?([^)\s>]+)>?(?:\s+"[^"]*")?\s*\)')


def _kinds(lines):
    """Each line's kind; a line looks back over all lines before it for what it needs."""
    kinds = []
    for line in lines:
        marks = re.match(" {0,3}(`{3,}|~{3,})", line)
        opened = next((k for k in range(len(kinds) - 1, -1, -1) if kinds[k] in ("open", "close")), None)
        if opened is not None and kinds[opened] == "open":
            fence = re.match(" {0,3}(`+|~+)", lines[opened])[1]
            closes = re.fullmatch(rf" {{0,3}}{fence}{fence[0]}*\s*", line)
            kinds.append("close" if closes else "inside")
            continue
        if marks:
            kinds.append("open")
            continue
        if not line.strip():
            kinds.append("blank")
            continue
        before = kinds[-1] if kinds else "blank"
        if re.match("    |\t", line):
            text = next((k for k in reversed(kinds) if k in ("item", "text")), "text")
            kinds.append("code" if text == "text" and before in ("blank", "code") else "set in")
        else:
            kinds.append("item" if re.match(r" {0,3}([-*+]|\d+[.)])(\s|$)", line) else "text")
    return kinds


def _expected(body):
    lines = body.split("\n")[: -1 if body.endswith("\n") else None] if body else []
    kinds = _kinds([x.removesuffix("\r") for x in lines])
    prose = [(n, x.removesuffix("\r")) for n, (x, k) in enumerate(zip(lines, kinds), 1) if k in ("item", "text", "set in")]
    heads = [(n, m) for n, x in prose if (m := re.match(r"(#{1,2})(?!#)(?:[ \t](.*))?$", x))]
    words = lambda m: (m[2] or "").strip().rstrip("#").strip()
    fences = [n for n, k in enumerate(kinds, 1) if k == "open"]
    starts = [n for n, m in heads if len(m[1]) == 2]
    counting = [n for n, k in enumerate(kinds, 1) if k in ("item", "text", "set in", "open")]
    names = []
    for n, (x, k) in enumerate(zip(lines, kinds), 1):
        for span in re.findall("`+[^`]*`+", x) if k in ("item", "text", "set in", "code") else []:
            name = span.strip("`").strip()
            if re.fullmatch("[0-9a-f]{7,40}", name) and re.search(r"\d", name):
                found = ("commit", name)
            elif re.fullmatch(r"(\./|\w)[\w./-]*", name, re.A) and ".." not in name and ("/" in name or re.search(r"\.[\w-]{0,4}[A-Za-z][\w-]{0,4}$", name) and len(name.rsplit(".", 1)[1]) <= 5):
                found = ("path", re.sub(r"^(\./)+", "", name))
            else:
                continue
            names += [found] if found not in names else []
    return {
        "first": next((n for n, k in enumerate(kinds, 1) if k != "blank"), None),
        "titles": [(n, words(m)) for n, m in heads if len(m[1]) == 1],
        "sections": [(words(m), n, any(c > n for c in counting), [j for j, f in enumerate(fences) if n < f < next((s for s in starts if s > n), 1 << 30)]) for n, m in heads if len(m[1]) == 2],
        "fences": [(n, (re.sub("^ *[`~]+", "", lines[n - 1]).split() or [""])[0]) for n in fences],
        "code": [n for n, k in enumerate(kinds, 1) if k == "code"],
        "links": [(n, m[2], bool(m[1])) for n, x in prose for m in LINK.finditer(re.sub("`+[^`]*`+", "", x))],
        "anchors": names,
    }


def _bodies(n, seed=3):
    pick = random.Random(seed)
    return ["", "\n", "a", *["\n".join(pick.choice(LINES) for _ in range(pick.randint(1, 14))) + pick.choice(["", "\n"]) for _ in range(n)]]


def test_structure_of_random_bodies(spark):
    bodies = _bodies(600)
    df = spark.createDataFrame(list(enumerate(bodies)), "k int, body string").select("k", markdown.structure(F.col("body")).alias("s"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    plain = lambda v: [tuple(x) if isinstance(x, tuple) else x for x in v] if isinstance(v, list) else v
    for r in df.collect():
        assert {p: plain(r.s[p]) for p in markdown.PARTS} == _expected(bodies[r.k]), repr(bodies[r.k])


def test_long_bodies_and_single_parts(spark):
    body = "# T\n```\n" + "x\n" * 60_000 + "```\n" + "- a\n    b\n\n" * 20_000 + "[l](m.md)\n"
    s = spark.createDataFrame([(body,)], "body string").select(markdown.structure(F.col("body"), "links", "code").alias("s")).first().s
    assert set(s.asDict()) == {"links", "code"} and s.code == [] and [tuple(x) for x in s.links] == [(1 + 60_002 + 60_000 + 1, "m.md", False)]


def test_rewritten_links_of_random_bodies(spark):
    bodies = _bodies(200, 4)
    made = []
    for k, body in enumerate(bodies):
        made.append((k, body, {f"{n} {t}": f"new/{t}" for n, t, _ in _expected(body)["links"]} or None))
    df = spark.createDataFrame(made, "k int, body string, links map<string,string>").select("k", markdown.rewritten(F.col("body"), F.col("links")).alias("to"))
    for r in df.collect():
        before, after = _expected(bodies[r.k]), _expected(r.to)
        assert after["links"] == [(n, f"new/{t}", i) for n, t, i in before["links"]] and re.sub("new/", "", r.to) == bodies[r.k]
        assert after["anchors"] == before["anchors"]


def test_moved_records_keep_their_links(spark):
    records = spark.createDataFrame([("a", "t/a.md", "See [b](b.md#x), [c](../u/c.md)\n```\n[b](b.md)\n```\n"), ("b", "t/b.md", "[a](a.md)"), ("c", "u/c.md", "no link")], "id string, path string, body string")
    moves = spark.createDataFrame([("t/b.md", "v/w/b.md")], "path string, to string")
    got = {r.id: (r.path, r.body) for r in writes.moved(records, moves).collect()}
    assert got == {"a": ("t/a.md", "See [b](../v/w/b.md#x), [c](../u/c.md)\n```\n[b](b.md)\n```\n"), "b": ("v/w/b.md", "[a](../../t/a.md)"), "c": ("u/c.md", "no link")}


def _view(body, most, at=None):
    """By trying: lines are asked for one by one, and the view with the next one is written out to see whether it fits."""
    lines = body.split("\n")[: -1 if body.endswith("\n") else None]
    if len(lines) <= most:
        return body
    core = []
    for k, line in enumerate(lines):
        owner = next((x for x in reversed(lines[: k + 1]) if not x.startswith("  ")), "")
        core.append(line.startswith(("[command failed", "[command worked]", "[tool output]")) or (line.startswith("  ") and owner.startswith("[tool output]")))
    near = [k for k in range(len(lines)) if any(core[max(0, k - 2) : k + 3])] or list(range(len(lines) - most, len(lines)))
    asked = [k for k in range(len(lines)) if at and 1 <= at <= len(lines) and abs(k + 1 - at) <= 5]

    def written(kept):
        return "\n".join(("[...]\n" if i and sorted(kept)[i - 1] != k - 1 else "") + lines[k] for i, k in enumerate(sorted(kept)))

    kept = []
    for k in [*reversed(asked), *[k for k in reversed(near) if k not in asked]]:
        if written([*kept, k]).count("\n") + 1 > most:
            break
        kept.append(k)
    return written(kept)


def test_focus_views_of_random_items(spark):
    pick, kinds = random.Random(8), ["plain", "plain", "plain", "  set in", "[command failed, exit 1] x", "[command worked] y", "[tool output]", ""]
    items = [(k, "\n".join(f"{pick.choice(kinds if k % 3 else kinds[:3])} " + str(j) for j in range(pick.randint(1, 60))) + pick.choice(["", "\n"]), pick.choice([None, 0, 3, 30, 99])) for k in range(150)]
    for most in (1, 4, 11, 40):
        got = {r.id: r.view for r in digest.focus_views(spark.createDataFrame(items, "id int, body string, at int"), most).collect()}
        assert got == {i: _view(b, most, at) for i, b, at in items}
    assert digest.focus_views(spark.createDataFrame([(1, None), (2, "a\nb")], "id int, body string"), 1).orderBy("id").collect() == [(1, None), (2, "b")]
