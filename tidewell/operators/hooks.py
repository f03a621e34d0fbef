"""What a session's events lead to: repeats, which record is pushed, recall, the question at the end, captures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.config import Gates
from tidewell.functions import markdown, text
from tidewell.operators import sessions

#: Reports of irrelevance that mute a record; days that a signature is remembered; points that ask; notes a session gets.
MUTED, REMEMBERED_DAYS, ASKED_POINTS, MOST_NUDGES = 3, 90, 3, 2
CAPTURED = ("fixed", "correction", "remember")


@dataclass(frozen=True)
class Strength:
    """What a pushed record needs: relevance and lead if a model ranked, else coverage; or a quoted error alone."""

    relevance: float = Gates.failure_relevance
    margin: float = Gates.failure_margin
    coverage: float = Gates.coverage
    quoted: bool = False


RECALL = Strength(Gates.recall_relevance, Gates.recall_margin)
#: Of a model whose scores part right from wrong lower down. Fixed values.
LOWER = Strength(0.75, 0.05)


def seen_before(failures: DataFrame, days: int = REMEMBERED_DAYS) -> DataFrame:
    """``failures`` (``sig, session, seq, time`` in seconds) with ``seen``: another session had the signature before, in
    the last ``days``.

    The latest earlier row of another session is the last one before the current run of rows of one session, so one
    window over each signature is enough.
    """
    order = Window.partitionBy("sig").orderBy("time", "seq")
    started = F.lag("session").over(order).isNull() | (F.lag("session").over(order) != F.col("session"))
    marked = failures.withColumn("__before", F.when(started, F.coalesce(F.lag("time").over(order), F.lit(-(1 << 60)))))
    other = F.last("__before", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("seen", other >= F.col("time") - days * 86_400).drop("__before")


def once_records(failures: DataFrame) -> DataFrame:
    """``session, program, kind, seq``: ``repeat`` for a program's first failure that was seen before, ``nohit`` for its
    first that no record answered; each once a session. ``failures`` has ``seen, answered``."""
    kinds = F.array_compact(F.array(F.when(F.col("seen"), "repeat"), F.when(~F.col("answered"), "nohit")))
    return failures.select("session", "program", "seq", F.explode(kinds).alias("kind")).groupBy("session", "program", "kind").agg(F.min("seq").alias("seq"))


def strong(g: Strength, relevance: Column, following: Column, coverage: Column, quotes: Column | None = None) -> Column:
    """``following`` is the relevance of the next hit, 0 if there is none."""
    if g.quoted:
        return quotes
    lead = (relevance >= g.relevance) & (F.round(relevance - following, 9) >= g.margin)
    return F.when(relevance.isNotNull(), lead).otherwise(coverage >= g.coverage)


def pushed(
    hits: DataFrame, asked: DataFrame, told: DataFrame, misses: DataFrame, explored: DataFrame, g: Strength = Strength(), recall: bool = False
) -> DataFrame:
    """``event, session, id, explore``: the record that each event adds to its session's context, if any.

    ``hits``: ``event, rank, id, type, status, applies, tier, relevance, body``; ``asked``: ``event, session, text`` (the
    error, or the prompt for ``recall``); ``told``: ``session, id`` that the session had already; ``misses``: ``id, n``
    irrelevant reports since the last good one; ``explored``: sessions that have had their one candidate.

    Only the first hit counts: active, not known to be out of place, a pitfall (recall takes any type, but needs a
    model's relevance and a prompt of three words that isn't a command), strong enough, new to the session, not muted;
    proven, or a candidate as the session's one exploration.
    """
    w = Window.partitionBy("event").orderBy("rank")
    first = hits.withColumn("following", F.coalesce(F.lead("relevance").over(w), F.lit(0.0))).withColumn("k", F.row_number().over(w)).where("k = 1")
    met = first.join(asked, "event")
    fine = (F.col("status") == "active") & F.coalesce(F.col("applies"), F.lit(True))
    if recall:
        words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
        fine = fine & F.col("relevance").isNotNull() & (words >= 3) & ~F.ltrim("text").startswith("/")
    else:
        fine = fine & (F.col("type") == "pitfall")
    enough = strong(g, F.col("relevance"), F.col("following"), text.coverage(F.col("text"), F.col("body")), markdown.quotes_error(F.col("text"), F.col("body")))
    chosen = met.where(fine & enough).join(told.select("session", "id"), ["session", "id"], "left_anti")
    chosen = chosen.join(misses.where(F.col("n") >= MUTED).select("id"), "id", "left_anti")
    used = explored.select("session").distinct().withColumn("used", F.lit(True))
    return (
        chosen.join(used, "session", "left")
        .where((F.col("tier") == "proven") | ((F.col("tier") == "candidate") & F.col("used").isNull()))
        .select("event", "session", "id", (F.col("tier") == "candidate").alias("explore"))
    )


def replay_query(replays: DataFrame) -> DataFrame:
    """``session, id, query``: the last logged query of a session that pushed the record."""
    known = replays.where("injected IS NOT NULL AND query IS NOT NULL")
    return known.groupBy("session", F.col("injected").alias("id")).agg(F.max_by("query", "seq").alias("query"))


def stop_decision(records: DataFrame) -> DataFrame:
    """``session, score, decision``: what happens when a session stops: ``block`` with a question once, a ``nudge`` twice
    at most, else nothing (null).

    Only records after the last ``offered`` one (``upto`` is how many it had seen) count, and only if the user corrected
    or asked to remember. ``records``: ``session, seq`` (from 1), ``kind, program, upto``.
    """
    all_of = Window.partitionBy("session")
    upto = F.max_by("upto", F.when(F.col("kind") == "offered", F.col("seq"))).over(all_of)
    failures = F.count_if(F.col("kind") == "failed").over(Window.partitionBy("session", "program"))
    rows = records.withColumn("__from", F.coalesce(upto, F.lit(0))).withColumn("__failures", failures)
    new = F.col("seq") > F.col("__from")
    points = F.when(F.col("kind") == "fixed", F.when(F.col("__failures") >= 3, 2).otherwise(1))
    for kind, n in sessions.WORTH.items():
        points = points.when(F.col("kind") == kind, n)
    each = rows.groupBy("session").agg(
        F.sum(F.when(new, points).otherwise(0)).alias("score"),
        F.max(new & F.col("kind").isin("remember", "correction")).alias("own"),
        F.max(F.col("kind") == "asked").alias("asked"),
        F.count_if(F.col("kind") == "nudged").alias("nudged"),
    )
    decision = F.when(~F.col("own") | (F.col("score") == 0), None).when((F.col("score") >= ASKED_POINTS) & ~F.col("asked"), "block").when(F.col("nudged") < MOST_NUDGES, "nudge")
    return each.select("session", F.coalesce("score", F.lit(0)).cast("long").alias("score"), decision.alias("decision"))


def captures(records: DataFrame, found: DataFrame, done: DataFrame) -> DataFrame:
    """``session, signals, signatures, priority``: the item that each session's new signals become.

    Signals are fixes, corrections and wishes to remember after the last ``extracted`` record. ``found``: ``session,
    sig`` of its failures; those in ``done`` (``sig``) are answered, and a session all of whose failures are is left
    out. The priority is the score of the new records, from 1 to 3.
    """
    new = sessions.after_last(records, F.col("kind") == "extracted")
    failures = records.groupBy("session", "program").agg(F.count_if(F.col("kind") == "failed").alias("__failures"))
    points = F.when(F.col("kind") == "fixed", F.when(F.col("__failures") >= 3, 2).otherwise(1))
    for kind, n in sessions.WORTH.items():
        points = points.when(F.col("kind") == kind, n)
    names = F.when(F.col("kind").isin(*CAPTURED), F.concat_ws(" ", "kind", "program"))
    each = new.join(failures, ["session", "program"], "left").groupBy("session").agg(
        F.sort_array(F.collect_set(names)).alias("signals"), F.sum(points.otherwise(0)).alias("score")
    )
    pending = found.select("session", "sig").distinct().join(done.select("sig", F.lit(True).alias("__done")).distinct(), "sig", "left")
    left = pending.groupBy("session").agg(F.sort_array(F.collect_set(F.when(F.col("__done").isNull(), F.col("sig")))).alias("signatures"))
    kept = each.where(F.size("signals") > 0).join(left, "session", "left").where("signatures IS NULL OR size(signatures) > 0")
    priority = F.greatest(F.lit(1), F.least(F.lit(3), F.col("score"))).cast("int")
    return kept.select("session", "signals", F.coalesce("signatures", F.array().cast("array<string>")).alias("signatures"), priority.alias("priority"))


def pushes_in_order(events: DataFrame) -> DataFrame:
    """``session, seq, id, explore``: what is pushed when a session's ``eligible`` hits (``session, seq, id, tier``) come
    one after another: a record once, and one candidate.

    The candidate is the session's first whose record no proven hit came before; a proven hit is pushed if it is its
    record's first and the candidate wasn't that record.
    """
    rows = events.where("eligible AND id IS NOT NULL AND tier IN ('proven', 'candidate')")
    proven = F.col("tier") == "proven"
    first = rows.withColumn("first", F.min(F.when(proven, F.col("seq"))).over(Window.partitionBy("session", "id")))
    open_ = ~proven & (F.col("first").isNull() | (F.col("first") > F.col("seq")))
    chosen = first.withColumn("chosen", F.min(F.when(open_, F.struct("seq", "id"))).over(Window.partitionBy("session")))
    explore = ~proven & (F.col("chosen.seq") == F.col("seq"))
    told = (F.col("chosen.id") == F.col("id")) & (F.col("chosen.seq") < F.col("seq"))
    kept = chosen.where(F.coalesce(explore, F.lit(False)) | (proven & (F.col("seq") == F.col("first")) & ~F.coalesce(told, F.lit(False))))
    return kept.select("session", "seq", "id", (~proven).alias("explore"))


def session_gates(events: DataFrame) -> DataFrame:
    """``session, seq, gate, program, id, explore, score, decision, signals``: all gates of finished logs of sessions, as
    ``streaming.gates`` gives them event by event. ``events``: the columns of its ``EVENTS``; sequence numbers of a
    session are distinct, from 1."""
    fixed = sessions.fixes(events.where("program IS NOT NULL")).where("fixed").select("session", "program", "seq", "island")
    once = once_records(events.where("kind = 'failed' AND program IS NOT NULL").withColumns({"seen": F.coalesce("seen", F.lit(False)), "answered": F.coalesce("answered", F.lit(True))}))
    push = pushes_in_order(events).join(events.select("session", "seq", "program"), ["session", "seq"])
    # a pushed record waits for the next fix of its program; the first such fix infers it
    waits = push.where("program IS NOT NULL").join(fixed.select("session", "program", F.col("seq").alias("at")), ["session", "program"]).where("at > seq")
    inferred = waits.groupBy("session", "program", "id", "seq").agg(F.min("at").alias("at")).groupBy("session", "id").agg(F.min(F.struct("at", "program")).alias("x"))
    log = events.select("session", "seq", "kind", "program", "upto").union(fixed.select("session", "seq", F.lit("fixed"), "program", F.lit(None).cast("long")))
    log = log.union(once.select("session", "seq", "kind", "program", F.lit(None).cast("long")))
    asof = lambda kind: (
        events.where(F.col("kind") == kind).select("session", F.col("seq").alias("at")).join(log, "session").where("seq <= at").withColumn("session", F.struct("session", "at"))
    )
    stop = stop_decision(asof("stop"))
    none = asof("end").select("session", F.lit(None).cast("string").alias("sig")).where("false")
    captured = captures(asof("end"), none, none.select("sig"))
    text_, long_, flag = F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("boolean")
    list_ = F.lit(None).cast("array<string>")
    found = fixed.select("session", "seq", F.lit("fixed").alias("gate"), "program", text_.alias("id"), flag.alias("explore"), long_.alias("score"), text_.alias("decision"), list_.alias("signals"))
    found = found.union(once.select("session", "seq", "kind", "program", text_, flag, long_, text_, list_))
    found = found.union(inferred.select("session", "x.at", F.lit("inferred"), "x.program", "id", flag, long_, text_, list_))
    found = found.union(push.select("session", "seq", F.lit("push"), "program", "id", "explore", long_, text_, list_))
    found = found.union(stop.select("session.session", "session.at", F.lit("stop"), text_, text_, flag, "score", "decision", list_))
    return found.union(captured.select("session.session", "session.at", F.lit("capture"), text_, text_, flag, F.col("priority").cast("long"), text_, "signals"))
