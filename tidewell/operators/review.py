"""Review reasons, expiry and fading of records, and the write actions as functions of the record table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import versions

#: Days. Fixed values.
LONG_STALE, OLD_VERIFIED, UNUSED, FADE, TRANSCRIPT = 90, 365, 180, 30, 14
#: Counts. Fixed values.
FAILED, INJECTED, IRRELEVANT = 2, 5, 3


def age(day: str | Column, today: str) -> Column:
    return F.datediff(F.to_date(F.lit(today)), F.to_date(F.col(day) if isinstance(day, str) else day))


def expired(today: str) -> Column:
    return F.coalesce(F.to_date(F.lit(today)) >= F.to_date("expires"), F.lit(False))


def acts_as(today: str) -> Column:
    """The status that counts in search: an expired active record is stale."""
    return F.when((F.col("status") == "active") & expired(today), "stale").otherwise(F.col("status"))


def reasons(records: DataFrame, use: DataFrame, today: str, folders: DataFrame | None = None, oldest: dict[str, str] | None = None, commits: DataFrame | None = None) -> DataFrame:
    """``id, reasons`` for current records that have any.

    ``records``: ``id, status, verified, expires`` and, where known, ``path, when, stale_since``; ``use``: use records
    ``id, event, time``. ``folders`` (``folder``) are retired; ``oldest`` names the oldest version of a fact that is still
    supported; ``commits`` (``project, commit``) are those in the checkouts at hand, for projects that have one.
    """
    from tidewell.operators import reports, usage

    rows = records.where(F.col("status").isin("active", "stale"))
    since = F.to_date(F.lit(today)) - F.expr(f"INTERVAL {UNUSED} DAYS")
    log = use.join(rows.select("id", "verified"), "id")
    own = log.groupBy("id").agg(
        F.count_if((F.col("event") == "failed") & (F.col("time") >= F.col("verified"))).alias("__failed"), F.max(F.to_date(F.substring("time", 1, 10)) >= since).alias("__recent")
    )
    joined = rows.join(usage.counts(use), "id", "left").join(own, "id", "left")
    listed = []
    if folders is not None:
        out = reports.retired(rows, folders).select("id", F.lit(True).alias("__retired")).distinct()
        joined = joined.join(out, "id", "left")
        listed.append(F.when(F.col("__retired"), "retired"))
    for fact, version in (oldest or {}).items():
        values = F.col("when")[fact]
        listed.append(F.when((F.size(values) > 0) & F.forall(values, _before(version)), f"unsupported {fact}"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    helped = n("worked") + n("inferred")
    stale = "stale_since" if "stale_since" in records.columns else "verified"
    listed += [F.when(expired(today), "expired"), F.when((F.col("status") == "stale") & (age(stale, today) > LONG_STALE), "long stale")]
    if commits is not None:
        project = F.regexp_extract("path", "^projects/([^/]+)/", 1)
        named = rows.select("id", project.alias("project"), F.explode(F.array_compact(F.array(*[F.get(F.col("when")[k], F.lit(0)) for k in ("since", "until")]))).alias("commit"))
        gone = named.join(commits.select("project").distinct(), "project", "left_semi").join(commits, ["project", "commit"], "left_anti")
        joined = joined.join(gone.select("id", F.lit(True).alias("__gone")).distinct(), "id", "left")
        listed.append(F.when(F.col("__gone"), "missing commit"))
    listed += [
        F.when(n("__failed") >= FAILED, "failed since verified"),
        F.when((n("injected") >= INJECTED) & (helped == 0), "never helped"),
        F.when((n("irrelevant") >= IRRELEVANT) & (n("irrelevant") >= helped), "often irrelevant"),
        F.when((F.to_date("verified") < since) & ~F.coalesce("__recent", F.lit(False)), "unused"),
    ]
    return joined.select("id", F.array_compact(F.array(*listed)).alias("reasons")).where(F.size("reasons") > 0)


def _before(version: str):
    return lambda spec: F.coalesce(versions.older_than(spec, F.lit(version)), F.lit(False))


def fades(records: DataFrame, counts: DataFrame, promoted: DataFrame, today: str) -> DataFrame:
    """Ids of promoted records (``id, day``) that were never used in 30 days; preferences and decisions don't fade."""
    quiet = records.where(~F.col("type").isin("preference", "decision")).join(promoted.where(age("day", today) > FADE), "id", "left_semi")
    return quiet.join(counts.where("worked > 0"), "id", "left_anti").select("id")


def flag(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Records with those of ``ids`` (``id, reason``) stale for that reason."""
    hit = records.join(ids, "id", "left")
    mark = F.col("reason").isNotNull()
    return hit.withColumns({"status": F.when(mark, "stale").otherwise(F.col("status")), "stale_reason": F.when(mark, F.col("reason")).otherwise(F.col("stale_reason"))}).drop("reason")


def supersede(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """Records with ``pairs`` (``id, by``) superseded; only where both are current and differ."""
    current = records.where(F.col("status").isin("active", "stale")).select("id")
    valid = pairs.where("id != `by`").join(current, "id", "left_semi").join(current.withColumnRenamed("id", "by"), "by", "left_semi")
    hit = records.join(valid, "id", "left")
    return hit.withColumns({"status": F.when(F.col("by").isNotNull(), "superseded").otherwise(F.col("status")), "superseded_by": F.coalesce("by", "superseded_by")}).drop("by")


def archive(records: DataFrame, folder: str) -> DataFrame:
    """Records under a folder archived."""
    return records.withColumn("status", F.when(F.col("path").startswith(folder.rstrip("/") + "/"), "archived").otherwise(F.col("status")))


def verify(records: DataFrame, results: DataFrame, today: str, refresh_days: int = 30) -> DataFrame:
    """Apply check results (``id, passed``): a failure makes stale; a pass makes active, and renews ``verified`` if the
    record was stale or verified over ``refresh_days`` ago."""
    hit = records.join(results, "id", "left")
    ok, bad = F.coalesce("passed", F.lit(False)), F.coalesce(~F.col("passed"), F.lit(False))
    renew = ok & ((F.col("status") == "stale") | (age("verified", today) > refresh_days))
    return hit.withColumns(
        {
            "status": F.when(bad, "stale").when(ok & (F.col("status") == "stale"), "active").otherwise(F.col("status")),
            "stale_reason": F.when(bad, "check failed").when(ok, None).otherwise(F.col("stale_reason")),
            "verified": F.when(renew, F.lit(today)).otherwise(F.col("verified")),
        }
    ).drop("passed")


def learn_query(records: DataFrame, learnt: DataFrame, most: int = 8, chars: int = 200) -> DataFrame:
    """Append ``learnt`` (``id, query``, one an id) to the records' queries unless one equals it, whatever the case."""
    hit = records.join(learnt, "id", "left")
    old = F.coalesce("queries", F.array().cast("array<string>"))
    new = F.substring("query", 1, chars)
    wanted = F.col("query").isNotNull() & (F.size(old) < most) & ~F.exists(old, lambda q: F.lower(q) == F.lower(new))
    return hit.withColumn("queries", F.when(wanted, F.array_append(old, new)).otherwise(F.col("queries"))).drop("query")


def held_back(links: DataFrame, held: DataFrame) -> DataFrame:
    """Ids that can't be published: the held ones and all that link to them, over any number of links.

    ``links`` has ``src, dst``. Rounds stop when one adds nothing; each is checkpointed.
    """
    from tidewell.plans.lineage import durable

    back = durable(links.select("src", "dst").distinct())
    found = durable(held.select("id").distinct())
    new = found
    while new.limit(1).count():
        near = back.join(new.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
        new = durable(near.join(found, "id", "left_anti"))
        found = durable(found.union(new))
    return found
