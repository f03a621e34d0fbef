"""Readers of record trees, logs and transcripts. Parse errors never stop a scan: they go to a table of their own."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators.joins import small

USAGE = "time string, id string, event string, result string, session string, reason string, agent string"
FIELDS = (
    "schema int, id string, type string, status string, superseded_by string, stale_reason string, `when` map<string,array<string>>, "
    "verified string, expires string, verified_how string, tags array<string>, queries array<string>, labels map<string,string>, meta string"
)
LESSON = f"path string, {FIELDS}, body string, body_line int, error string"
KNOWN = {"schema", "id", "type", "status", "superseded_by", "stale_reason", "when", "verified", "expires", "verified_how", "tags", "queries", "labels", "meta"}


def relative(path: Column, root: str) -> Column:
    return F.substring_index(path, root.rstrip("/") + "/", -1)


def is_lesson(rel: Column) -> Column:
    """``general/<topic>/<file>.md`` or ``{projects,systems}/<name>/<topic>/<file>.md``, no folder note, nothing hidden."""
    parts = F.split(rel, "/")
    deep = ((parts[0] == "general") & (F.size(parts) == 3)) | (parts[0].isin("projects", "systems") & (F.size(parts) == 4))
    return deep & ~rel.rlike(r"(^|/)\.") & rel.endswith(".md") & (F.element_at(parts, -1) != "README.md")


def folder_chain(rel: Column) -> Column:
    """The notes of a path's folders, the nearest first."""
    parts = F.split(rel, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/README.md")))


def _listed(value) -> list[str] | None:
    if value is None:
        return None
    return [str(v) for v in value] if isinstance(value, list) else [str(value)]


def _parse(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import json

    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading record files needs PyYAML") from e
    columns = [c.split()[0].strip("`") for c in ("path", "schema", "id", "type", "status", "superseded_by", "stale_reason", "when", "verified", "expires", "verified_how", "tags", "queries", "labels", "meta", "body", "body_line", "error")]
    for frame in frames:
        out = []
        for path, text in zip(frame["path"], frame["text"]):
            row = dict.fromkeys(columns) | {"path": path}
            try:
                lines = (text or "").replace("\r\n", "\n").split("\n")
                if lines[0].strip() != "---" or "---" not in lines[1:]:
                    raise ValueError("no frontmatter between two lines of ---")
                end = lines.index("---", 1)
                front = yaml.safe_load("\n".join(lines[1:end])) or {}
                if extra := set(front) - KNOWN:
                    raise ValueError(f"unknown key {min(extra)}")
                row |= {k: (None if front.get(k) is None else str(front[k])) for k in ("id", "type", "status", "superseded_by", "stale_reason", "verified", "expires", "verified_how")}
                row |= {"schema": front.get("schema"), "tags": _listed(front.get("tags")), "queries": _listed(front.get("queries"))}
                row["when"] = {str(k): _listed(v) for k, v in (front.get("when") or {}).items()}
                row["labels"] = {str(k): str(v) for k, v in (front.get("labels") or {}).items()}
                row["meta"] = json.dumps(front["meta"], default=str) if front.get("meta") is not None else None
                row |= {"body": "\n".join(lines[end + 1 :]), "body_line": end + 2}
            except Exception as e:  # any text can be in a file; it is reported with its path
                row |= {"error": str(e).split("\n")[0]}
            out.append(row)
        yield pd.DataFrame(out, columns=columns)


def lessons(spark: SparkSession, root: str, kb: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)`` of a tree: parsed records with scope, owner and topic from their path; paths with their error."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").format("binaryFile").load(root)
    found = files.select(relative(F.col("path"), root).alias("path"), F.decode("content", "UTF-8").alias("text")).where(is_lesson(F.col("path")))
    parsed = found.mapInPandas(_parse, LESSON)
    parts = F.split("path", "/")
    placed = parsed.withColumns(
        {
            "scope": parts[0],
            "owner": F.when(parts[0] != "general", parts[1]),
            "topic": F.element_at(parts, -2),
            "qualified_id": F.concat_ws(":", F.lit(kb), "id") if kb else F.col("id"),
        }
    )
    return placed.where("error IS NULL").drop("error"), parsed.where("error IS NOT NULL").select("path", F.col("error").alias("message"))


def knowledge_bases(spark: SparkSession, roots: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)`` of several trees as one table each, with ``kb``; "" names the main one, whose ids stay bare."""
    read = [(kb, lessons(spark, root, kb or None)) for kb, root in roots.items()]
    marked = lambda k: reduce(DataFrame.unionByName, [part[k].withColumn("kb", F.lit(kb)) for kb, part in read])
    return marked(0), marked(1)


def file_kind(rel: Column) -> Column:
    """What a path is: ``config``, ``note`` (of a folder), ``lesson``, ``asset`` or ``other``."""
    parts = F.split(rel, "/", -1)
    name = F.element_at(parts, -1)
    inside = F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.endswith(".assets"))
    scoped = (F.size(parts) >= 2) & parts[0].isin("general", "projects", "systems")
    return F.when(rel == "kb.toml", "config").when(~scoped, "other").when(inside, "asset").when(name == "README.md", "note").when(name.endswith(".md"), "lesson").otherwise("other")


def note_role(rel: Column) -> Column:
    """What a folder's note describes, from where it lies."""
    parts = F.split(rel, "/", -1)
    n, scope = F.size(parts), parts[0]
    owned = scope.isin("projects", "systems")
    return (
        F.when(n == 2, "scope").when((scope == "projects") & (n == 3), "project").when((scope == "systems") & (n == 3), "system")
        .when(((scope == "general") & (n == 3)) | (owned & (n == 4)), "topic").otherwise("misplaced")
    )


def ignored(rel: Column, rules: list[str]) -> Column:
    """Whether the lines of an ignore file leave a path out. A later line overrides an earlier one, ``!`` takes back, a
    slash at the end means folders, one elsewhere ties the pattern to the root."""
    out = F.lit(False)
    for rule in rules:
        rule = rule.rstrip()
        if not rule or rule.startswith("#"):
            continue
        back = rule.startswith("!")
        rule = rule.lstrip("!")
        folder, tied = rule.endswith("/"), "/" in rule.rstrip("/")
        body = re.escape(rule.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        pattern = ("^" if tied else "(^|.*/)") + body + ("/.*$" if folder else "(/.*)?$")
        out = F.when(rel.rlike(pattern), not back).otherwise(out)
    return out


def files(spark: SparkSession, root: str, rules: list[str] | None = None, folders: list[str] | None = None) -> DataFrame:
    """``path, size, content`` of a tree's files that aren't hidden, ignored or unknown. With ``folders`` only those are
    listed at all."""
    base = root.rstrip("/")
    found = spark.read.option("recursiveFileLookup", "true").format("binaryFile").load([f"{base}/{f}" for f in folders] if folders else base)
    rel = found.select(relative(F.col("path"), root).alias("path"), F.col("length").alias("size"), "content")
    return rel.where(~F.col("path").rlike(r"(^|/)\.") & (file_kind(F.col("path")) != "other") & ~ignored(F.col("path"), rules or []))


def staged(spark: SparkSession, root: str) -> DataFrame:
    """``path, content`` of the files in a git index, read on the driver: an index is a file of one machine."""
    run = lambda args, data=None: subprocess.run(["git", "-C", root, *args], input=data, capture_output=True, check=True).stdout
    listed = [x.split(b"\t", 1) for x in run(["ls-files", "-s", "-z"]).split(b"\0") if x]
    names, out, at, rows = [(a.split()[1], p.decode()) for a, p in listed], b"", 0, []
    if names:
        out = run(["cat-file", "--batch"], b"".join(sha + b"\n" for sha, _ in names))
    for _, path in names:
        end = out.index(b"\n", at)
        size = int(out[at:end].split()[2])
        rows.append((path, bytearray(out[end + 1 : end + 1 + size])))
        at = end + 2 + size
    return spark.createDataFrame(rows, "path string, content binary")


def usage(spark: SparkSession, path: str) -> DataFrame:
    """Usage records of one or more machines, in file order (``machine, seq``); malformed lines are left out. The event
    may stand under its older name ``result``."""
    rows = in_file_order(spark.read.schema(USAGE).option("mode", "DROPMALFORMED").json(path))
    named = rows.withColumn("event", F.coalesce("event", "result")).drop("result").where("id IS NOT NULL AND event IS NOT NULL")
    return named.withColumnRenamed("file", "machine")


def in_file_order(rows: DataFrame) -> DataFrame:
    """``rows`` as read from files, with ``file`` and ``seq``, which rises with the names of files and within them.

    Spark deals files to tasks by size, so numbers of tasks say nothing. A file's place among all, the byte where a task's
    piece of it begins and the row's number in the task make the number; a task has fewer rows than its first piece has
    bytes, unless that is the file's last.
    """
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    names = rows.sparkSession.createDataFrame([(n, k) for k, n in enumerate(sorted(rows.inputFiles()))], "__name string, __place long")
    placed = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__start"))
    placed = placed.withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    joined = placed.join(small(names.withColumn("__name", plain("__name"))), plain("file") == F.col("__name"), "left")
    return joined.withColumn("seq", F.shiftleft("__place", 44) + F.col("__start") + F.col("__row")).drop("__name", "__place", "__start", "__row")


#: The logs of a machine and their columns.
LOGS = {
    "sessions": "session string, kind string, program string, id string, hook string, explore boolean, time long, upto long, offset long",
    "replays": "time long, session string, project string, system string, query string, injected string",
    "rankings": "time long, hook string, backend string, skipped array<string>, ids array<string>, ms long",
    "written": "time long, id string, session string, kind string",
    "signatures": "time long, sig string, session string, done boolean",
    "triage": "time long, item string, index int, verdict string, reason string, score double, kind string, durable double, general double, mistake double, preference double, not_a_lesson double, outcome string, lesson string",
    "promotions": "time long, item string, model string, input_tokens long, output_tokens long, action string, reason string, lesson string",
}


def log(spark: SparkSession, name: str, path: str, now: int | None = None, days: int | None = None) -> DataFrame:
    """A log by its name, malformed lines left out, with ``seq`` in file order; with ``now`` and ``days`` only rows of
    that age. Of ``written`` only additions count; a row of an old file without a kind is one."""
    rows = in_file_order(spark.read.schema(LOGS[name]).option("mode", "DROPMALFORMED").json(path)).drop("file")
    if name == "written":
        rows = rows.where("kind IS NULL OR kind = 'add'")
    return rows if now is None else recent(rows, now, days)


def recent(log: DataFrame, now: int, days: int) -> DataFrame:
    """Rows of a log whose ``time`` (seconds) is at most ``days`` old."""
    return log.where(F.col("time") >= now - days * 86_400)


def new_messages(messages: DataFrame, seen: DataFrame, most: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Messages (``msg_id, time``) that weren't seen, each once, and the ids to remember: the last ``most``."""
    fresh = messages.join(seen.select("msg_id"), "msg_id", "left_anti").withColumn("__k", F.row_number().over(Window.partitionBy("msg_id").orderBy("time"))).where("__k = 1").drop("__k")
    every = seen.select("msg_id", "time").union(fresh.select("msg_id", "time"))
    kept = every.groupBy("msg_id").agg(F.max("time").alias("time")).withColumn("__k", F.row_number().over(Window.orderBy(F.desc("time"), "msg_id"))).where(F.col("__k") <= most)
    return fresh, kept.drop("__k")


ARGS = ("command", "file_path", "path", "pattern", "url", "query", "description", "prompt")
STEPS = ["session", "seq", "k", "kind", "text", "command", "ok", "output", "name"]


def _in_blocks(content: Column) -> Column:
    """Whether a message's content is an array of blocks, not a text."""
    return content.rlike(r"^\[\s*[{\]]")


def _said(content: Column) -> Column:
    """The text of a message's content, which is a text or an array of blocks."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")
    return F.when(_in_blocks(content), joined).otherwise(content)


def _steps(said: DataFrame, calls: DataFrame, answers: DataFrame, times: DataFrame, runner: str) -> DataFrame:
    """Prompts and texts, commands with what they gave (at the place of the answer, a call is answered once), other
    calls with their main argument, and times where they change."""
    none = lambda kind="string": F.lit(None).cast(kind)
    first = F.row_number().over(Window.partitionBy("session", "call").orderBy("seq", "k"))
    answer = answers.withColumn("n", first).where("n = 1")
    asked = calls.where(F.lower("name") == runner).where(F.col("input")["command"].isNotNull()).select("session", "call", F.col("input")["command"].alias("command")).dropDuplicates(["session", "call"])
    ran = answer.join(asked, ["session", "call"]).select("session", "seq", "k", F.lit("command").alias("kind"), none().alias("text"), "command", "ok", "output", none().alias("name"))
    arg = F.coalesce(*[F.col("input")[a] for a in ARGS], F.lit(""))
    other = calls.where(F.lower("name") != runner).select("session", "seq", "k", F.lit("tool"), arg, none(), none("boolean"), none(), F.lower("name"))
    spoken = said.select("session", "seq", "k", "kind", "text", none(), none("boolean"), none(), none())
    stamp = F.translate(F.substring("time", 1, 16), "T", " ")
    before = F.lag("stamp").over(Window.partitionBy("session").orderBy("seq"))
    clock = times.where(F.char_length("time") >= 16).select("session", "seq", stamp.alias("stamp")).withColumn("b", before).where("b IS NULL OR b != stamp")
    clock = clock.select("session", "seq", F.lit(-1), F.lit("time"), "stamp", none(), none("boolean"), none(), none())
    every = ran.union(other).union(spoken).union(clock).toDF(*STEPS)
    return every.withColumn("step", F.row_number().over(Window.partitionBy("session").orderBy("seq", "k"))).drop("k")


def transcript_steps(lines: DataFrame) -> DataFrame:
    """Steps of sessions from lines of JSON (``session, seq, line``) of the dialect whose content holds ``tool_use`` and
    ``tool_result`` blocks: ``kind`` is prompt, text, command, tool or time. Lines that aren't JSON give nothing; those
    marked as meta hold no prompts."""
    block = "struct<type:string,text:string,id:string,name:string,input:map<string,string>,tool_use_id:string,is_error:boolean,content:string>"
    parsed = lines.withColumn("m", F.from_json("line", "struct<type:string,isMeta:boolean,timestamp:string,message:struct<content:string>>")).where("m.type IN ('user', 'assistant')")
    content = F.col("m.message.content")
    rows = parsed.select("session", "seq", F.col("m.type").alias("type"), F.coalesce("m.isMeta", F.lit(False)).alias("meta"), F.col("m.timestamp").alias("time"), content.alias("content"))
    plain = rows.where("type = 'user' AND NOT meta").where(~_in_blocks(F.col("content"))).select("session", "seq", F.lit(0).alias("k"), F.lit("prompt").alias("kind"), F.col("content").alias("text"))
    blocks = rows.where(_in_blocks(F.col("content"))).select("session", "seq", "type", "meta", F.posexplode(F.from_json("content", f"array<{block}>")).alias("k", "b"))
    said = blocks.where("b.type = 'text' AND b.text IS NOT NULL AND (type = 'assistant' OR NOT meta)").select(
        "session", "seq", "k", F.when(F.col("type") == "user", "prompt").otherwise("text").alias("kind"), F.col("b.text").alias("text")
    )
    calls = blocks.where("type = 'assistant' AND b.type = 'tool_use'").select("session", "seq", "k", F.col("b.id").alias("call"), F.coalesce("b.name", F.lit("")).alias("name"), F.col("b.input").alias("input"))
    answers = blocks.where("type = 'user' AND NOT meta AND b.type = 'tool_result'").select(
        "session", "seq", "k", F.col("b.tool_use_id").alias("call"), (~F.coalesce("b.is_error", F.lit(False))).alias("ok"), _said(F.coalesce("b.content", F.lit(""))).alias("output")
    )
    return _steps(plain.union(said), calls, answers, rows.select("session", "seq", "time"), "bash")


def message_steps(lines: DataFrame) -> DataFrame:
    """The same steps from the dialect of ``message`` lines with ``toolCall`` blocks and ``toolResult`` messages, whose
    output ends with the code of a command that failed; that becomes its first line."""
    block = "struct<type:string,text:string,id:string,name:string,arguments:map<string,string>>"
    parsed = lines.withColumn("m", F.from_json("line", "struct<type:string,timestamp:string,message:struct<role:string,content:string,toolCallId:string,isError:boolean>>")).where("m.type = 'message'")
    rows = parsed.select("session", "seq", F.col("m.timestamp").alias("time"), "m.message.*")
    said = rows.where("role = 'user'").select("session", "seq", F.lit(0).alias("k"), F.lit("prompt").alias("kind"), F.coalesce(_said(F.col("content")), F.lit("")).alias("text"))
    blocks = rows.where("role = 'assistant'").select("session", "seq", F.posexplode(F.from_json("content", f"array<{block}>")).alias("k", "b"))
    texts = blocks.where("b.type = 'text' AND b.text IS NOT NULL").select("session", "seq", "k", F.lit("text"), F.col("b.text"))
    calls = blocks.where("b.type = 'toolCall'").select("session", "seq", "k", F.col("b.id").alias("call"), F.coalesce("b.name", F.lit("")).alias("name"), F.col("b.arguments").alias("input"))
    output = F.regexp_replace(F.coalesce(_said(F.col("content")), F.lit("")), r"\s+$", "")
    code = F.regexp_extract(output, r"\nCommand exited with code ([^\n]*)$", 1)
    body = F.regexp_replace(F.regexp_replace(output, r"\nCommand exited with code [^\n]*$", ""), r"\s+$", "")
    headed = F.when(code != "", F.concat(F.lit("Exit code "), F.trim(code), F.lit("\n"), body)).otherwise(output)
    answers = rows.where("role = 'toolResult'").select("session", "seq", F.lit(0).alias("k"), F.col("toolCallId").alias("call"), (~F.coalesce("isError", F.lit(False))).alias("ok"), headed.alias("output"))
    return _steps(said.union(texts), calls, answers, rows.select("session", "seq", "time"), "bash")


def memory_notes(records: DataFrame) -> DataFrame:
    """``source, text``: a note from each memory file (``path, text``) but the index; its frontmatter names it."""
    front = F.regexp_extract("text", r"(?s)^---\n(.*?)\n---\n", 1)
    body = F.regexp_replace("text", r"(?s)^---\n.*?\n---\n", "")
    field = lambda k: F.nullif(F.trim(F.regexp_extract(front, rf"(?m)^\s*{k}:[ \t]*(.*)$", 1)), F.lit(""))
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    head = F.concat(F.lit("From memory ("), F.coalesce(field("type"), F.lit("note")), F.lit("): "), F.coalesce(field("name"), stem))
    told = F.coalesce(F.concat(F.lit("\n"), field("description")), F.lit(""))
    kept = records.where(F.col("path").endswith(".md") & ~F.col("path").rlike(r"(^|/)MEMORY\.md$"))
    return kept.select(F.col("path").alias("source"), F.concat(head, told, F.lit("\n\n"), F.regexp_replace(body, r"^\s+|\s+$", "")).alias("text"))


def sectioned_notes(records: DataFrame) -> DataFrame:
    """``source, text``: a note from each section (`` ## ``) of files (``path, text``), and from what stands before."""
    parts = records.select("path", F.explode(F.split("text", r"(?m)^(?=## )", -1)).alias("t")).withColumn("t", F.regexp_replace("t", r"^\s+|\s+$", "")).where("t != ''")
    heading = F.trim(F.regexp_replace(F.substring_index("t", "\n", 1), r"^#+", ""))
    return parts.select(F.concat("path", F.lit("#"), heading).alias("source"), F.concat(F.lit("From "), "path", F.lit(": "), heading, F.lit("\n\n"), "t").alias("text"))


def import_folder(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(source, topic, text)`` of files (``path, content``) at ``<topic>/<name>.md``, and ``(source, reason)`` of others.
    An import goes on only if nothing is refused."""
    parts = F.split("path", "/", -1)
    content = F.expr("is_valid_utf8(CAST(content AS STRING))")
    found = rows.where(F.col("path").endswith(".md") & ~F.col("path").rlike(r"(^|/)\."))
    reason = (
        F.when((F.size(parts) == 2) & (parts[1] == "README.md"), "folder notes are not imported; put records at <topic>/<name>.md")
        .when(F.size(parts) != 2, "put each record at <topic>/<name>.md inside the import folder")
        .when(~content, "the file is not UTF-8")
    )
    judged = found.select(F.col("path").alias("source"), parts[0].alias("topic"), F.decode("content", "UTF-8").alias("text"), reason.alias("reason"))
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL").select("source", "reason")


@dataclass(frozen=True)
class Settings:
    """What a configuration file says: labels with their values in order, sinks, and the numbers of other tables."""

    labels: dict[str, list[str]] = field(default_factory=dict)
    sinks: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    tables: dict[str, dict] = field(default_factory=dict)

    def order(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, v, n) for k, values in self.labels.items() for n, v in enumerate(values)], "key string, value string, pos int")


def settings(text: str) -> Settings:
    """A configuration in TOML; a table that isn't one is an error."""
    import tomllib

    read = tomllib.loads(text)
    bad = [k for k, v in read.items() if not isinstance(v, dict)]
    if bad:
        raise ValueError(f"not a table: {', '.join(bad)}")
    sinks = {k: dict(v.get("allow", {})) for k, v in read.get("sinks", {}).items()}
    return Settings(dict(read.get("labels", {})), sinks, {k: v for k, v in read.items() if k not in ("labels", "sinks")})


def manifest(spark: SparkSession, text: str) -> DataFrame:
    """Queries (``[[query]]``) or reviewed events (``[[event]]``) of a manifest in TOML; unknown keys are an error."""
    import tomllib

    read = tomllib.loads(text)
    if "event" in read:
        if read.get("version") != 1 or not str(read.get("kb_revision", "")).strip() or not str(read.get("source_fingerprint", "")).strip():
            raise ValueError("a reviewed set needs version = 1, kb_revision and source_fingerprint")
        schema = "key string, path string, text string, error string, command string, project string, system string, expect array<string>, near_miss array<string>, source string, rationale string, worked string, paraphrase boolean"
        rows, empty = read["event"], {"expect": [], "near_miss": [], "paraphrase": False}
    else:
        schema = "query_id long, text string, expect array<string>, mode string, `with` map<string,string>, project string, system string"
        rows, empty = [{"query_id": n, **q} for n, q in enumerate(read.get("query", []))], {"mode": "search", "with": {}, "expect": []}
    names = [c.strip("` ").split()[0].strip("`") for c in re.split(r", (?![^<]*>)", schema)]
    for row in rows:
        if extra := set(row) - set(names):
            raise ValueError(f"unknown key {min(extra)}")
    return spark.createDataFrame([tuple({**empty, **row}.get(c) for c in names) for row in rows], schema)
