"""Rules that records, folders and assets must meet. A finding is ``path, line, severity, rule, message``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.config import CURRENT, IMAGES, MOST_IMAGE_BYTES, MOST_QUERIES, MOST_QUERY_CHARS, REQUIRED_HEADINGS, STATUS_HEADINGS, Gates
from tidewell.functions import markdown, text, versions
from tidewell.operators import graph, leaks, reports
from tidewell.operators.ranks import placed

FINDING = "array<struct<line:int,severity:string,rule:string,message:string>>"
ID, FOLDER, DAY = r"^[0-9a-f]{10}$", r"^[a-z0-9]+(-[a-z0-9]+)*$", r"^\d{4}-\d{2}-\d{2}$"


def _finding(rule: str, severity: str, message: Column | str, line: Column | None = None) -> Column:
    said = F.lit(message) if isinstance(message, str) else message
    at = F.lit(None).cast("int") if line is None else line.cast("int")
    return F.struct(at.alias("line"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), said.alias("message"))


def _error(rule: str, message: Column | str, line: Column | None = None) -> Column:
    return _finding(rule, "error", message, line)


def _if(condition: Column, finding: Column) -> Column:
    return F.filter(F.array(F.when(condition, finding)), lambda x: x.isNotNull()).cast(FINDING)


def fields(status: Column) -> list[Column]:
    """Rules of single fields: schema, id, what a status needs, tags, queries, the day of expiry."""
    reason, by = F.col("stale_reason"), F.col("superseded_by")
    bad_tag = lambda t: (t == "") | (t != F.lower(t)) | t.rlike(r"\s")
    tags, queries = (F.coalesce(c, F.array().cast("array<string>")) for c in ("tags", "queries"))
    seen = F.transform(queries, lambda q: F.trim(q))
    query_problem = lambda q, k: F.when(F.trim(q) == "", "a query is empty").when(F.char_length(q) > MOST_QUERY_CHARS, "a query is too long").when(F.array_contains(F.slice(seen, F.lit(1), k), F.trim(q)), "a query is listed twice")
    return [
        _if(F.col("schema") != 1, _error("format/schema", "the schema is not supported")),
        _if(~F.col("id").rlike(ID), _error("format/id", "an id has 10 lowercase hex characters")),
        _if((status == "superseded") & by.isNull(), _error("format/superseded_by", "a superseded record needs `superseded_by`")),
        _if((status == "superseded") & ~by.rlike(ID), _error("format/superseded_by", "`superseded_by` is not an id")),
        _if((status != "superseded") & by.isNotNull(), _error("format/superseded_by", "only a superseded record has `superseded_by`")),
        _if((status == "stale") & reason.isNull(), _error("format/stale_reason", "a stale record needs `stale_reason`")),
        _if((status == "stale") & (F.trim(reason) == ""), _error("format/stale_reason", "`stale_reason` is empty")),
        _if((status != "stale") & reason.isNotNull(), _error("format/stale_reason", "only a stale record has `stale_reason`")),
        _if(F.col("expires").isNotNull() & (~F.col("expires").rlike(DAY) | F.col("expires").try_cast("date").isNull()), _error("format/expires", "`expires` is not a day")),
        F.transform(F.filter(tags, bad_tag), lambda t: _error("format/tags", F.concat(F.lit("tag `"), t, F.lit("` must be lowercase without spaces")))).cast(FINDING),
        _if(F.size(queries) > MOST_QUERIES, _error("format/queries", "too many queries")),
        F.transform(F.filter(F.transform(queries, query_problem), lambda p: p.isNotNull()), lambda p: _error("format/queries", p)).cast(FINDING),
    ]


def conditions(when: str = "when") -> list[Column]:
    """Values of conditions that can't be read: empty ones, and ranges of which an end isn't a version."""
    entries = F.flatten(F.transform(F.map_entries(F.coalesce(when, F.create_map().cast("map<string,array<string>>"))), lambda e: F.transform(e["value"], lambda v: F.struct(e["key"].alias("key"), v.alias("value")))))
    spec = lambda v: F.when(v.contains("@"), F.substring_index(v, "@", -1)).otherwise(v)
    bad = lambda x: (F.trim(x["value"]) == "") | (spec(x["value"]).contains(":") & F.exists(F.split(spec(x["value"]), ":"), lambda p: (F.trim(p) != "") & versions.parts(p).isNull()))
    plain = F.filter(entries, lambda x: ~x["key"].isin("path", "since", "until") & bad(x))
    return [F.transform(plain, lambda x: _error("when/invalid", F.concat(x["key"], F.lit(": `"), x["value"], F.lit("` can't be read")))).cast(FINDING)]


def body(offset: Column) -> list[Column]:
    """Rules of a body, from its structure in ``s``; ``offset`` is added to line numbers."""
    s, at = F.col("s"), lambda n: n + offset
    title = F.get(s["titles"], F.lit(0))
    needed = lambda names: F.array(*[F.lit(n) for n in names])
    required = F.create_map(*[x for k, v in REQUIRED_HEADINGS.items() for x in (F.lit(k), needed(v))])[F.col("type")]
    extra = F.create_map(*[F.lit(x) for kv in STATUS_HEADINGS.items() for x in kv])[F.col("status")]
    wanted = F.concat(F.coalesce(required, F.array().cast("array<string>")), F.array_compact(F.array(extra)))
    named = lambda n: F.filter(s["sections"], lambda x: x["heading"] == n)
    places = F.filter(F.transform(required, lambda n: F.struct(n.alias("n"), F.when(F.size(named(n)) == 1, F.get(named(n), F.lit(0))["line"]).alias("line"))), lambda p: p["line"].isNotNull())
    early = F.filter(F.transform(places, lambda p, k: F.struct(p["n"].alias("n"), p["line"].alias("line"), F.get(places, F.greatest(k - 1, F.lit(0)))["line"].alias("before"))), lambda p: p["line"] < p["before"])
    script = F.filter(s["sections"], lambda x: x["heading"].isin("Check", "Probe") & ~((F.size(x["fences"]) == 1) & F.coalesce(F.get(s["fences"], F.get(x["fences"], F.lit(0)))["lang"].isin("sh", "bash"), F.lit(False))))
    each = lambda xs, f: F.transform(xs, f).cast(FINDING)
    return [
        _if(F.size(s["titles"]) == 0, _error("body/title", "the body must start with one title", at(F.lit(1)))),
        _if((F.size(s["titles"]) == 1) & (title["line"] != s["first"]), _error("body/title", "the title must be the first line", at(title["line"]))),
        _if(F.size(s["titles"]) > 1, _error("body/title", "the body has more than one title", at(F.get(s["titles"], F.lit(1))["line"]))),
        each(F.filter(wanted, lambda n: F.size(named(n)) == 0), lambda n: _error("body/headings", F.concat(F.lit("missing heading "), n))),
        each(F.filter(wanted, lambda n: F.size(named(n)) > 1), lambda n: _error("body/headings", F.concat(n, F.lit(" appears twice")), at(F.get(named(n), F.lit(1))["line"]))),
        each(F.filter(wanted, lambda n: (F.size(named(n)) == 1) & ~F.get(named(n), F.lit(0))["filled"]), lambda n: _error("body/empty-section", F.concat(n, F.lit(" is empty")), at(F.get(named(n), F.lit(0))["line"]))),
        each(early, lambda p: _error("body/heading-order", F.concat(p["n"], F.lit(" comes too early")), at(p["line"]))),
        each(F.filter(s["fences"], lambda x: x["lang"] == ""), lambda x: _error("body/fence-lang", "a fenced block needs a language", at(x["line"]))),
        each(s["code"], lambda n: _error("body/indented-code", "use a fenced block", at(n))),
        each(script, lambda x: _error("body/script", F.concat(x["heading"], F.lit(" must hold exactly one fenced sh or bash block")), at(x["line"]))),
    ]


def quality(offset: Column) -> list[Column]:
    """Warnings about records too weak to act on."""
    s, b = F.col("s"), F.col("body")
    warn = lambda rule, message: _finding(rule, "warning", message)
    evidence, title = markdown.section(b, s, "Evidence"), F.get(s["titles"], F.lit(0))["text"]
    words = F.size(F.filter(F.split(title, r"\s+"), lambda w: w != ""))
    lines = offset + F.size(F.split(F.regexp_replace(b, r"\n$", ""), "\n", -1))
    short = [_if(F.char_length(text.trimmed(markdown.section(b, s, h))) < 20, warn("quality/fix", f"{h} is too short to follow")) for h in ("Fix", "Steps")]
    return [
        _if(lines > Gates.lesson_lines, warn("size/lesson-lines", "a long record is often two")),
        _if(~evidence.rlike(r"[`/\"\p{Nd}]"), warn("quality/evidence", "the evidence names no command, path, number or quote")),
        _if(words < 4, warn("quality/title", "the title has fewer than four words")),
        *short,
    ]


def records(rows: DataFrame) -> DataFrame:
    """Findings of each record by itself: all rules in one pass over the bodies. ``rows``: the columns of
    ``readers.lessons``."""
    offset = F.coalesce("body_line", F.lit(1)) - 1
    marked = rows.withColumn("s", markdown.structure(F.col("body")))
    parts = F.split("path", "/", -1)
    one = lambda k: F.when(F.size(F.col("when")[k]) == 1, F.get(F.col("when")[k], F.lit(0)))
    folder = F.get(parts, F.lit(1))
    depth = F.when(parts[0] == "general", 3).otherwise(4)
    wrong = (
        F.when(parts[0] == "projects", one("project") != folder)
        .when(parts[0] == "systems", one("system") != folder)
        .otherwise(one("project").isNotNull() | one("system").isNotNull())
    )
    layout = [
        _if(F.size(parts) != depth, _error("layout/depth", "a record is at scope, (name,) topic and file")),
        _if(F.coalesce(wrong, F.lit(False)), _error("layout/scope", "the conditions name another folder")),
    ]
    every = reduce(F.concat, [*fields(F.col("status")), *conditions(), *layout, *body(offset), *quality(offset)])
    return marked.select("path", F.explode(every).alias("f")).select("path", "f.*")


def folders(paths: DataFrame) -> DataFrame:
    """Folders whose names aren't lowercase words joined by hyphens. ``paths`` has ``path`` of all files."""
    parts = F.split("path", "/", -1)
    under = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    dirs = paths.where((F.size(parts) > 2) & ~F.col("path").rlike(r"[^/]*\.assets/")).select(F.explode(under).alias("path")).distinct()
    bad = ~F.substring_index("path", "/", -1).rlike(FOLDER)
    return dirs.where(bad).select("path", F.lit(None).cast("int").alias("line"), F.lit("error").alias("severity"), F.lit("layout/folder-name").alias("rule"), F.lit("the name must be lowercase letters, digits and hyphens").alias("message"))


def assets(files: DataFrame) -> DataFrame:
    """Files of asset folders (``path, size``) that aren't images or are too large."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    found = F.concat(_if(~ext.isin(*IMAGES), _error("assets/type", "only images are allowed")), _if(F.col("size") > MOST_IMAGE_BYTES, _error("assets/size", "the image is too large")))
    return files.where(F.col("path").rlike(r"(^|/)[^/]*\.assets/")).select("path", F.explode(found).alias("f")).select("path", "f.*")


def across(rows: DataFrame, files: DataFrame, pairs: DataFrame, aliases: DataFrame, labels: DataFrame) -> DataFrame:
    """Findings that need other records or files: broken links, assets that nothing links to, ids and aliases claimed
    twice, near duplicates, labels that aren't defined. ``labels`` are ``writes.label_problems`` with ``path``."""
    none = F.lit(None).cast("int")
    out = lambda df, rule, message, line=none, severity="error": df.select("path", line.cast("int").alias("line"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), message.alias("message"))
    twice = reports.claimed_twice(rows, "id", "path")
    paths = rows.select(F.col("id").alias("a"), F.col("path").alias("pa")), rows.select(F.col("id").alias("b"), F.col("path").alias("pb"))
    near = pairs.join(paths[0], "a").join(paths[1], "b").select(F.least("pa", "pb").alias("path"), F.greatest("pa", "pb").alias("other"), "similarity")
    claimed = reports.claimed_twice(aliases, "alias", "topic").join(aliases.select("alias", "path"), "alias")
    return reduce(
        DataFrame.unionByName,
        [
            out(graph.broken_links(rows, files), "links/broken", F.concat(F.lit("no file at "), "target"), F.col("line")),
            out(graph.unlinked(rows, files), "assets/unlinked", F.lit("no record links to this file")),
            out(twice.select(F.explode("owners").alias("path"), "id"), "format/duplicate-id", F.concat(F.lit("another file has id "), "id")),
            out(claimed, "layout/alias", F.concat(F.lit("alias "), "alias", F.lit(" is claimed by "), F.array_join("owners", ", "))),
            out(near, "content/near-duplicate", F.format_string("similarity %.2f with %s", "similarity", "other"), severity="warning"),
            out(labels, "labels/unknown", F.concat("key", F.lit(": "), "problem")),
        ],
    )


def leaked(rows: DataFrame, usernames: tuple[str, ...] = ()) -> DataFrame:
    """What the leak scan finds in the bodies."""
    found = leaks.scan(rows, "path", "body", usernames)
    return found.select(F.col("id").alias("path"), F.col("line_no").cast("int").alias("line"), F.lit("error").alias("severity"), "rule", F.col("found").alias("message"))


def ordered(findings: DataFrame) -> DataFrame:
    """``place`` by path, line (none first), severity, rule and message."""
    rank = F.when(F.col("severity") == "error", 0).otherwise(1)
    return placed(findings, "path", F.asc_nulls_first("line"), rank, "rule", "message")


def current(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status").isin(*CURRENT))
