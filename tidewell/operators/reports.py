"""Reports over records and logs: tiers, topics, signals, costs, health, changes, the inbox."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.config import CURRENT
from tidewell.functions import edits, markdown, text
from tidewell.operators import usage
from tidewell.operators.ranks import placed
from tidewell.operators.joins import small

#: Ways by which a hook adds a record; the first part of an injection's reason. Fixed values.
WAYS = ("tool-failed", "recall", "explore")
NEW_DAYS, MOST_ITEMS, SKILL_SESSIONS, DIGEST_CHARS = 30, 500, 3, 1200
#: Outcomes that mean that a kept candidate became a record. Fixed values.
BECAME = ("add", "update", "supersede")
BAD_QUOTE = "the quote is not in the item"


def tiers(records: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(tier, n)`` and the proven records as ``place, id, helpful, harmful``, the most helpful first."""
    each = records.join(counts, "id", "left").withColumn("tier", usage.tier(F.col("status").isin(*CURRENT)))
    n = lambda c: F.coalesce(c, F.lit(0.0))
    proven = each.where("tier = 'proven'").select("id", n(usage.helpful()).alias("helpful"), n(usage.harmful()).alias("harmful"))
    return each.groupBy("tier").agg(F.count(F.lit(1)).alias("n")), placed(proven, F.desc("helpful"), "harmful", "id").select("place", "id", "helpful", "harmful")


def topic_view(records: DataFrame) -> DataFrame:
    """``folder, part, tag, place, id, title``: the current records of each folder by their first tag, untagged ones
    after them, retired ones apart; titles in order whatever their case."""
    current = F.col("status").isin(*CURRENT)
    tag = F.when(current, F.get("tags", F.lit(0)))
    part = F.when(~current, "retired").when(tag.isNull(), "untagged").otherwise("tagged")
    rows = records.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), part.alias("part"), tag.alias("tag"), "id", "title")
    order = Window.partitionBy("folder", "part", "tag").orderBy(F.lower("title"), "title", "id")
    return rows.withColumn("place", F.row_number().over(order))


def folder_labels(records: DataFrame, effective: DataFrame) -> DataFrame:
    """``folder, key, value, n``: how many current records under each folder have a label. ``effective``: ``id, key, value``."""
    parts = F.split("path", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    under = records.where(F.col("status").isin(*CURRENT)).select("id", F.explode(above).alias("folder"))
    return under.join(effective, "id").groupBy("folder", "key", "value").agg(F.count(F.lit(1)).alias("n"))


def signals(sessions: DataFrame, records: DataFrame) -> DataFrame:
    """One row: sessions, those with a failure, fix, correction or wish to remember, extracts, injections and how many
    then helped. ``sessions``: ``session, kind, id``; ``records``: use records ``session, id, event``."""
    has = lambda k: F.max(F.col("kind") == k).cast("int")
    each = sessions.groupBy("session").agg(
        has("failed").alias("f"), has("fixed").alias("x"), has("correction").alias("c"), has("remember").alias("r"), F.count_if(F.col("kind") == "extracted").alias("e")
    )
    total = each.agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("f").alias("with_failed"), F.sum("x").alias("with_fixed"), F.sum("c").alias("with_correction"),
        F.sum("r").alias("with_remember"), F.sum("e").alias("extracts"),
    )
    good = sessions.where("kind = 'inferred'").select("session", "id").union(records.where("event = 'worked'").select("session", "id")).distinct().withColumn("good", F.lit(True))
    shown = sessions.where("kind = 'injected' AND id IS NOT NULL").join(good, ["session", "id"], "left")
    return total.crossJoin(shown.agg(F.count(F.lit(1)).alias("injected"), F.count_if("good").alias("injected_then_helped")))


def ways(records: DataFrame, sessions: DataFrame) -> DataFrame:
    """``way, injected, helped, irrelevant``: of the injections in known sessions, how many were followed by a report of
    the same session and record. The usual ways are listed even without any."""
    prefix = F.substring_index(F.coalesce("reason", F.lit("")), ",", 1)
    known = records.join(sessions.select("session").distinct(), "session", "left_semi")
    after = known.groupBy("session", "id").agg(F.max(F.col("event").isin("worked", "inferred")).alias("helped"), F.max(F.col("event") == "irrelevant").alias("irrelevant"))
    shown = known.where("event = 'injected'").select("session", "id", F.when(prefix.isin(*WAYS), prefix).otherwise("other").alias("way"))
    seen = shown.join(after, ["session", "id"]).select("way", F.lit(1).alias("n"), F.col("helped").cast("int").alias("h"), F.col("irrelevant").cast("int").alias("i"))
    none = records.sparkSession.createDataFrame([(w, 0, 0, 0) for w in WAYS], "way string, n int, h int, i int")
    return seen.union(none).groupBy("way").agg(F.sum("n").alias("injected"), F.sum("h").alias("helped"), F.sum("i").alias("irrelevant"))


def worked_sessions(records: DataFrame) -> DataFrame:
    """``id, sessions``: how many sessions reported that a record worked; a report without one counts by its day."""
    origin = F.coalesce(F.nullif("session", F.lit("")), F.substring("time", 1, 10))
    return records.where("event = 'worked'").groupBy("id").agg(F.count_distinct(origin).alias("sessions"))


def skills(recipes: DataFrame, records: DataFrame, least: int = SKILL_SESSIONS) -> DataFrame:
    """``place, id, sessions``: active recipes that worked in enough sessions, the most first."""
    found = recipes.where("type = 'recipe' AND status = 'active'").join(worked_sessions(records).where(F.col("sessions") >= least), "id")
    return placed(found, F.desc("sessions"), "id").select("place", "id", "sessions")


def new_records(records: DataFrame, added: DataFrame, counts: DataFrame, today: str, days: int = NEW_DAYS) -> DataFrame:
    """One row ``added, injected``: records whose file was added (``path, day``, the latest counts) in the last ``days``,
    and how many of them were injected at least once."""
    last = added.groupBy("path").agg(F.max("day").alias("day"))
    new = records.join(last, "path").where(F.to_date("day") >= F.date_sub(F.to_date(F.lit(today)), days)).join(counts.select("id", "injected"), "id", "left")
    return new.agg(F.count(F.lit(1)).alias("added"), F.count_if(F.coalesce("injected", F.lit(0)) > 0).alias("injected"))


def promotion_cost(log: DataFrame) -> DataFrame:
    """One row ``accepted, tokens, each``: calls that wrote something, all tokens, and tokens for each of the former."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = log.agg(F.count_if(F.col("action").isin("add", "update", "used")).alias("accepted"), F.coalesce(F.sum(n("input_tokens") + n("output_tokens")), F.lit(0)).alias("tokens"))
    return total.withColumn("each", F.when(F.col("accepted") > 0, F.floor(F.col("tokens") / F.col("accepted"))))


def promoted(log: DataFrame) -> DataFrame:
    """``lesson, time``: the latest write of each promoted record."""
    return log.where("lesson != ''").groupBy("lesson").agg(F.max(F.coalesce("time", F.lit(0))).alias("time"))


def ranking_health(log: DataFrame, plain: str = "bm25") -> DataFrame:
    """One row ``total, fallbacks, timeouts, p50, p90, warn``: rankings (``backend, skipped, ms``), those for which a
    backend was skipped, nearest-rank times of the others, and whether over a quarter of ten or more fell back."""
    late = F.exists("skipped", lambda r: r.contains(": timeout"))
    base = log.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size("skipped") > 0).alias("fallbacks"), F.count_if(late).alias("timeouts"))
    times = log.where((F.col("backend") != plain) & F.col("ms").isNotNull()).groupBy("ms").agg(F.count(F.lit(1)).alias("c"))  # one row a millisecond
    upto = F.sum("c").over(Window.orderBy("ms"))
    n = F.sum("c").over(Window.partitionBy())
    ranked = times.select("ms", upto.alias("upto"), n.alias("n"))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1), F.col("ms")))
    return base.crossJoin(ranked.agg(at(50).alias("p50"), at(90).alias("p90"))).withColumn("warn", (F.col("total") >= 10) & (F.col("fallbacks") * 4 > F.col("total")))


def last_verdicts(log: DataFrame) -> DataFrame:
    """``item, index, verdict, outcome``: of each candidate the last verdict and the last outcome in the log."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return log.groupBy("item", "index").agg(last("verdict").alias("verdict"), last("outcome").alias("outcome")).where("verdict IS NOT NULL")


def triage_health(log: DataFrame) -> DataFrame:
    """One row ``total, unsure, kept, became, warning``: over 30 percent unsure, or twenty kept of which under half
    became records."""
    v = last_verdicts(log).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("verdict") == "unsure").alias("unsure"), F.count_if(F.col("verdict") == "keep").alias("kept"),
        F.count_if((F.col("verdict") == "keep") & F.substring_index("outcome", ":", 1).isin(*BECAME)).alias("became"),
    )
    many = F.when(F.col("unsure") * 10 > F.col("total") * 3, "unsure").when((F.col("kept") >= 20) & (F.col("became") * 2 < F.col("kept")), "few became records")
    return v.withColumn("warning", many)


def triage_counts(candidates: DataFrame) -> DataFrame:
    """``item, keep, known, unsure, drop`` of each item's candidates."""
    return candidates.groupBy("item").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("keep", "known", "unsure", "drop")])


def claimed_twice(rows: DataFrame, value: str, owner: str) -> DataFrame:
    """``value, owners``: values that several owners claim: ids of several files, aliases of several topics."""
    return rows.groupBy(value).agg(F.sort_array(F.collect_set(owner)).alias("owners")).where(F.size("owners") > 1)


def groups(records: DataFrame) -> DataFrame:
    """``kind, name, ids``: published records by topic, project, system and tag."""
    entry = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    own = F.array(entry("topics", F.col("topic")), F.when(F.col("scope") == "projects", entry("projects", F.col("owner"))), F.when(F.col("scope") == "systems", entry("systems", F.col("owner"))))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.struct(F.lit("tags").alias("kind"), t.alias("name")))
    rows = records.select("id", F.explode(F.concat(F.array_compact(own), tags)).alias("g")).select("id", "g.kind", "g.name")
    return rows.groupBy("kind", "name").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def callers(log: DataFrame) -> DataFrame:
    """One row ``by_mod, both``: sessions that a mod served, and those that a command hook served as well."""
    each = log.groupBy("session").agg(F.max(F.col("caller") == "mod").alias("m"), F.max(F.col("caller") == "command").alias("c"))
    return each.agg(F.count_if("m").alias("by_mod"), F.count_if(F.col("m") & F.col("c")).alias("both"))


def inbox_order(items: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """``place`` of each item: by priority, then age. Beyond ``most`` items the oldest are dropped."""
    old = items.orderBy(F.desc("time"), F.desc("item")).limit(most)
    return old.withColumn("place", F.row_number().over(Window.orderBy(F.desc("priority"), "time", "item")))


def priorities(items: DataFrame) -> DataFrame:
    return items.groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


def inbox_search(items: DataFrame, queries: DataFrame, most: int = 2, chars: int = 160) -> DataFrame:
    """``query_id, place, item, terms, line_no, line``: for each query the items that hold at least half of its terms,
    most terms first, then the newest, with the first line that holds the most."""
    asked = queries.select("query_id", F.array_distinct(text.tokens(F.col("text"))).alias("ts")).where(F.size("ts") > 0)
    wanted = asked.select("query_id", F.size("ts").alias("need"), F.explode("ts").alias("term"))
    lines = items.select("item", "time", F.posexplode(F.split("body", "\n", -1)).alias("n", "line")).withColumn("ts", F.array_distinct(text.tokens(F.col("line"))))
    held = lines.select("item", "time", "n", F.explode("ts").alias("term")).join(small(wanted), "term")
    whole = held.groupBy("query_id", "item", "time", "need").agg(F.count_distinct("term").alias("terms")).where(F.col("terms") >= F.ceil(F.col("need") / 2))
    by_line = held.groupBy("query_id", "item", "n").agg(F.count_distinct("term").alias("c"))
    best = by_line.groupBy("query_id", "item").agg(F.max_by("n", F.struct("c", -F.col("n"))).alias("n"))
    order = Window.partitionBy("query_id").orderBy(F.desc("terms"), F.desc("time"), "item")
    top = whole.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).join(best, ["query_id", "item"])
    at = lines.select("item", "n", F.substring(text.trimmed(F.col("line")), 1, chars).alias("line"))
    return top.join(at, ["item", "n"]).select("query_id", "place", "item", "terms", (F.col("n") + 1).alias("line_no"), "line")


def ready(items: DataFrame, seen: DataFrame, done: DataFrame, worked: DataFrame, calls: DataFrame) -> DataFrame:
    """``place, item``: items to promote: those reported as worked first, then those of which a signature came in two
    sessions and isn't answered, the oldest first. A worked item whose quotes failed twice counts as others do.

    ``items``: ``item, time, signatures``; ``seen``: ``sig, session``; ``done``: ``sig``; ``worked``: ``item``; ``calls``:
    ``item, reason``.
    """
    failed = calls.where(F.col("reason") == BAD_QUOTE).groupBy("item").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    first = worked.select("item").distinct().join(failed, "item", "left_anti").withColumn("worked", F.lit(True))
    twice = seen.groupBy("sig").agg(F.count_distinct("session").alias("n")).where("n >= 2").join(done, "sig", "left_anti")
    again = items.select("item", F.explode("signatures").alias("sig")).join(twice, "sig", "left_semi").select("item").distinct().withColumn("again", F.lit(True))
    found = items.join(first, "item", "left").join(again, "item", "left").where("worked OR again")
    return placed(found, F.col("worked").isNull(), "time", "item").select("place", "item")


def health(records: DataFrame, orphaned: DataFrame, replays: DataFrame, today: str, old_days: int = 365) -> DataFrame:
    """``id, reasons``: current records that are orphans, pitfalls none of whose queries meets a logged one, or were
    verified over a year ago. ``records``: ``id, type, status, verified, queries``."""
    current = records.where(F.col("status").isin(*CURRENT))
    lost = unmatched(current.where("type = 'pitfall'"), replays).withColumn("unmatched", F.lit(True))
    lone = orphaned.select("id").withColumn("orphan", F.lit(True))
    rows = current.join(lone, "id", "left").join(lost, "id", "left")
    old = F.to_date("verified") < F.date_sub(F.to_date(F.lit(today)), old_days)
    reasons = F.array_compact(F.array(F.when(F.col("orphan"), "orphan"), F.when(F.col("unmatched"), "unmatched"), F.when(old, "old")))
    return rows.select("id", reasons.alias("reasons")).where(F.size("reasons") > 0)


def unmatched(records: DataFrame, replays: DataFrame) -> DataFrame:
    """``id``: records none of whose queries holds a logged query or is held by one, whatever case and white space; none
    without a log.

    A query that holds another holds its first word at one of its own words, or inside one; so both sides meet under the
    first three characters of words before they are compared.
    """
    fold = lambda c: F.lower(markdown.flat(c))
    own = records.select("id", F.explode("queries").alias("q")).select("id", fold(F.col("q")).alias("q")).where("q != ''")
    logged = replays.select(fold(F.col("query")).alias("r")).where("r != ''").distinct()
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c) - 2, F.lit(1))), lambda k: F.substring(c, k, F.lit(3))))
    head = lambda c: F.substring(c, 1, 3)
    short = lambda c: F.char_length(c) < 3
    held = own.select("q").distinct()
    # the shorter one's first three characters stand somewhere in the longer one
    inner = held.select("q", head(F.col("q")).alias("g")).join(logged.select("r", F.explode(grams(F.col("r"))).alias("g")), "g").where(F.col("r").contains(F.col("q")))
    outer = logged.select("r", head(F.col("r")).alias("g")).join(held.select("q", F.explode(grams(F.col("q"))).alias("g")), "g").where(F.col("q").contains(F.col("r")))
    # texts of one or two characters are few
    tiny = small(held.where(short(F.col("q"))).distinct()).join(logged, F.col("r").contains(F.col("q")))
    tiny_log = small(logged.where(short(F.col("r")))).join(held, F.col("q").contains(F.col("r")))
    met = inner.select("q").union(outer.select("q")).union(tiny.select("q")).union(tiny_log.select("q")).distinct()
    alone = own.select("id").distinct().join(own.join(met, "q", "left_semi").select("id").distinct(), "id", "left_anti")
    return _if_any(alone, logged)


def _if_any(rows: DataFrame, other: DataFrame) -> DataFrame:
    """``rows`` if ``other`` has any row, else none."""
    return rows.crossJoin(F.broadcast(other.agg((F.count(F.lit(1)) > 0).alias("__any")))).where("__any").drop("__any")


def retired(records: DataFrame, scopes: DataFrame) -> DataFrame:
    """``id, folder``: records under retired folders (``folder``), by the folders above a path."""
    parts = F.split("path", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return records.select("id", F.explode(above).alias("folder")).join(scopes.select("folder").distinct(), "folder", "left_semi").select("id", "folder")


def preference_digest(records: DataFrame, counts: DataFrame, chars: int = DIGEST_CHARS) -> DataFrame:
    """``place, id, line``: standing preferences (``id, rule``) as lines, the most helpful first, while they fit."""
    lines = records.select("id", markdown.flat(F.col("rule")).alias("line")).where("line != ''").join(counts.select("id", "worked"), "id", "left").withColumn("worked", F.coalesce("worked", F.lit(0)))
    ranked = placed(lines, F.desc("worked"), "id", total=F.char_length("line") + 1)
    return ranked.where(F.col("place_total") <= chars + 1).select("place", "id", "line")


def changes(commits: DataFrame) -> DataFrame:
    """``commit, date, kind, folder, title, id``: what the subjects of commits say that follow the form
    ``kind(folder): title [id]``; the id may lack."""
    form = r"^([a-z]+)\(([^)]*)\): (.*?)(?: \[([0-9a-f]{10})\])?$"
    part = lambda k: F.regexp_extract("subject", form, k)
    return commits.where(F.col("subject").rlike(form)).select("commit", "date", part(1).alias("kind"), part(2).alias("folder"), part(3).alias("title"), part(4).alias("id"))


def closest(asked: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """``asked, place, name``: the nearest names by edits for each character of the longer one. Both tables are small
    lists of folders."""
    share = edits.distance(F.col("asked"), F.col("name")) / F.greatest(F.octet_length("asked"), F.octet_length("name"), F.lit(1))
    met = asked.crossJoin(F.broadcast(names)).withColumn("share", share)
    order = Window.partitionBy("asked").orderBy("share", "name")
    return met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("asked", "place", "name")


def replay_report(replays: DataFrame, hits: DataFrame, written: DataFrame, pushed: DataFrame, irrelevant: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row ``failures, sessions, sessions_with_lesson, found, would_inject, irrelevant``, and ``program, n, example``
    of failures that nothing answered, the most frequent first.

    ``replays``: ``event, seq, session, query``; ``hits``: ``event, rank, id``; ``written``: ``session, id`` (what a
    session wrote, after replacements); ``pushed``: ``event, id``; ``irrelevant``: ``session, id``. A session counts as
    found if one of the first five hits of one of its failures is a record that it wrote.
    """
    wrote = written.select("session").distinct()
    found = replays.join(hits.where("rank <= 5"), "event").join(written, ["session", "id"], "left_semi").select("session").distinct()
    would = replays.join(pushed, "event")
    bad = would.join(irrelevant.select("session", "id").distinct(), ["session", "id"], "left_semi")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    own = replays.select("session").distinct()
    total = replays.agg(F.count(F.lit(1)).alias("failures"), F.count_distinct("session").alias("sessions"))
    for df, name in ((own.join(wrote, "session", "left_semi"), "sessions_with_lesson"), (found, "found"), (would, "would_inject"), (bad, "irrelevant")):
        total = total.crossJoin(n(df, name))
    open_ = replays.join(pushed, "event", "left_anti").join(wrote, "session", "left_anti")
    program = F.coalesce(F.nullif(F.regexp_extract("query", r"(\S+)", 1), F.lit("")), F.lit("?"))
    by = open_.groupBy(program.alias("program")).agg(F.count(F.lit(1)).alias("n"), F.min_by("query", "seq").alias("example"))
    return total, placed(by, F.desc("n"), "program").select("place", "program", "n", "example")


def first_stage(events: DataFrame, expected: DataFrame, hits: DataFrame) -> DataFrame:
    """``grp, answerable, misses, rate``: of events (``event, path, paraphrase``) that expect a record, those with none
    of theirs among the hits; paraphrases count in their path and as a group of their own."""
    wants = expected.select("event").distinct().withColumn("answerable", F.lit(True))
    hit = hits.join(expected, ["event", "id"], "left_semi").select("event").distinct().withColumn("hit", F.lit(True))
    rows = events.join(wants, "event", "left").join(hit, "event", "left")
    both = rows.select("*", F.explode(F.array_compact(F.array(F.col("path"), F.when(F.col("paraphrase"), "paraphrase")))).alias("grp"))
    counted = both.groupBy("grp").agg(F.count_if("answerable").alias("answerable"), F.count_if(F.col("answerable") & F.col("hit").isNull()).alias("misses"))
    return counted.withColumn("rate", F.round(F.col("misses") / F.nullif("answerable", F.lit(0)), 3))


def draft(replays: DataFrame, reports: DataFrame) -> DataFrame:
    """``key, text, command, error, expect, worked, source``: a reviewed set from logged injections that have a later
    report of their session: a worked one names the record, an irrelevant one means that there is no answer."""
    shown = replays.where("injected IS NOT NULL").select("session", F.col("injected").alias("id"), "seq", "query")
    firsts = usage.first_report_after(shown.select("session", "id", "seq"), reports.where("event IN ('worked', 'irrelevant')"))
    met = shown.join(firsts.where("report IS NOT NULL"), ["session", "id", "seq"])
    met, place = placed(met, "seq"), F.col("place")
    good = F.col("report") == "worked"
    return met.select(
        F.concat(F.lit("replay-"), place).alias("key"), F.col("query").alias("text"), F.substring_index("query", " ", 1).alias("command"),
        F.when(F.col("query").contains(" "), F.regexp_replace("query", r"(?s)^[^ ]* ", "")).otherwise("").alias("error"),
        F.when(good, F.array("id")).otherwise(F.array().cast("array<string>")).alias("expect"),
        F.when(good, F.concat(F.lit("worked in session "), "session")).alias("worked"), F.concat(F.lit("replay "), "session").alias("source"),
    )


def manifest_problems(events: DataFrame, active: DataFrame) -> DataFrame:
    """``key, problem`` of reviewed events (``key, path, text, error, command, expect, near_miss, source, rationale,
    worked``) that break a rule; ``active`` has the ids that may be named."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    none = F.size("expect") == 0
    listed = F.array_compact(
        F.array(
            F.when(blank("key"), "empty key"),
            F.when(F.col("__same") > 1, "duplicate key"),
            F.when(blank("text") | blank("source") | blank("rationale"), "needs text, source and rationale"),
            F.when((F.col("path") == "prompt") & (F.col("error").isNotNull() | F.col("command").isNotNull()), "prompt cannot have error"),
            F.when((F.col("path") == "failure") & (F.col("error").isNull() != F.col("command").isNull()), "error and command must occur together"),
            F.when((none & F.col("worked").isNotNull()) | (~none & blank("worked")), "positives need a worked reference; negatives cannot have one"),
            F.when(F.arrays_overlap("near_miss", "expect"), "a near miss cannot be expected"),
        )
    )
    same = F.count(F.lit(1)).over(Window.partitionBy("key"))
    ruled = events.withColumn("__same", same).select("key", F.explode(listed).alias("problem"))
    named = events.select("key", F.explode(F.array_union("expect", "near_miss")).alias("id")).join(active.select("id"), "id", "left_anti")
    return ruled.union(named.select("key", F.concat(F.lit("names unknown or inactive record "), "id")))


def dropped_transcripts(items: DataFrame, seen: DataFrame, done: DataFrame, worked: DataFrame, now: int, days: int = 14) -> DataFrame:
    """``item``: transcripts that triage dropped or that are older than ``days``, unless they worked or one of their
    signatures came in two sessions and isn't answered. ``items``: ``item, kind, time, dropped, signatures``."""
    twice = seen.groupBy("sig").agg(F.count_distinct("session").alias("n")).where("n >= 2").join(done, "sig", "left_anti")
    kept = items.select("item", F.explode("signatures").alias("sig")).join(twice, "sig", "left_semi").select("item").union(worked.select("item")).distinct()
    old = F.lit(now) - F.col("time") > days * 86_400
    return items.where((F.col("kind") == "transcript") & (F.col("dropped") | old)).join(kept, "item", "left_anti").select("item")
