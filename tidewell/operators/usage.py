"""Usage records: counts, ranking factor, tiers, demotion, resets, look-backs and rate guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENTS = ("worked", "failed", "injected", "inferred", "irrelevant")


def counts(records: DataFrame) -> DataFrame:
    """Per id: a count of each event and the last dates. Other events than the known ones are left out; ``restored``
    only moves the last date. ``records`` has ``id, event, time`` (text that sorts by time)."""
    day = F.substring("time", 1, 10)
    known = records.where(F.col("event").isin(*EVENTS, "restored"))
    return known.groupBy("id").agg(
        *[F.count_if(F.col("event") == e).alias(e) for e in EVENTS],
        *[F.max(F.when(F.col("event") == e, day)).alias(f"last_{e}") for e in EVENTS[:3]],
        F.max(day).alias("last_any"),
    )


def helpful() -> Column:
    return F.col("worked") + 0.5 * F.col("inferred")


def harmful() -> Column:
    return (F.col("failed") + F.col("irrelevant")).cast("double")


def factor() -> Column:
    """What a record's use does to its rank: 0.9 to 1.1."""
    raw = 1 + 0.05 * F.log(1 + helpful()) - 0.1 * F.least(harmful(), F.lit(3.0)) / 3
    return F.greatest(F.lit(0.9), F.least(F.lit(1.1), raw))


def tier(current: Column) -> Column:
    return F.when(~current, "archive").when(F.coalesce("worked", F.lit(0)) > 0, "proven").otherwise("candidate")


def demotion() -> Column:
    """Why a record goes to the archive, or null."""
    bad = F.col("failed") + F.col("irrelevant")
    return F.when((harmful() == 0) | ((F.col("worked") == 0) & (bad < 2)), None).when(harmful() > helpful(), "more harmful than helpful").when(
        F.col("worked") == 0, "reported irrelevant or failed twice with no worked report"
    )


def since_restored(records: DataFrame) -> DataFrame:
    """The records after the last restoration of their id, by time as text."""
    last = F.max(F.when(F.col("event") == "restored", F.col("time"))).over(Window.partitionBy("id"))
    return records.withColumn("__last", last).where("__last IS NULL OR time > __last").drop("__last")


def irrelevant_since_worked(records: DataFrame) -> DataFrame:
    """``id, n``: irrelevant reports after the last worked or restored one; equal times keep the order of ``seq``."""
    order = Window.partitionBy("id").orderBy("time", "seq")
    place = records.withColumn("n", F.row_number().over(order))
    reset = F.max(F.when(F.col("event").isin("worked", "restored"), F.col("n"))).over(Window.partitionBy("id"))
    return place.withColumn("reset", F.coalesce(reset, F.lit(0))).groupBy("id").agg(
        F.count_if((F.col("event") == "irrelevant") & (F.col("n") > F.col("reset"))).alias("n")
    )


def first_report_after(shown: DataFrame, reports: DataFrame) -> DataFrame:
    """Each shown record with the first later report of the same session and id in file order (``seq``), if any.

    The union of both sides is scanned once by a window; no pair of the two is formed that isn't wanted.
    """
    both = shown.select("session", "id", "seq", F.lit(None).cast("string").alias("report")).union(
        reports.select("session", "id", "seq", F.col("event"))
    )
    after = Window.partitionBy("session", "id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col("report").isNotNull(), F.struct("seq", "report")), ignorenulls=True).over(after)
    return both.withColumn("next", nxt).where("report IS NULL").select(
        "session", "id", "seq", F.col("next.seq").alias("report_seq"), F.col("next.report").alias("report")
    )


def _seconds(ts: str) -> Column:
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def last_within(rows: DataFrame, mark: Column, keys: list[str], ts: str, seconds: int, value: str) -> Column:
    """The value of the last marked row of the same keys in the ``seconds`` before each row, itself not included."""
    w = Window.partitionBy(*keys).orderBy(_seconds(ts)).rangeBetween(-seconds, -1)
    return F.max(F.when(mark, F.struct(F.col(ts), F.col(value)))).over(w)[value]


def too_many(rows: DataFrame, keys: list[str], ts: str, seconds: int, most: int) -> DataFrame:
    """Rows by which more than ``most`` of the same keys fall within ``seconds``, with the count as ``n``."""
    w = Window.partitionBy(*keys).orderBy(_seconds(ts)).rangeBetween(-seconds, Window.currentRow)
    return rows.withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") > most)


def nearest_ranks(rows: DataFrame, key: str, value: str, percents: tuple[int, ...], buckets: int = 1024) -> DataFrame:
    """``key, n, p..``: for each percent the value at index ``n * percent / 100`` of the key's sorted values, the last at
    most; nulls don't count.

    Equal values are counted first. Counts by ranges of values then tell which range holds each rank, and only values of
    these ranges are put in order, so a key that most rows share is no single task.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    edges = counted.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.sum("c").alias("n"))
    share = (F.col(value) - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0).cast("double"))
    placed = counted.join(F.broadcast(edges), key).withColumn("b", F.least(F.floor(F.coalesce(share, F.lit(0.0)) * buckets), F.lit(buckets - 1)).cast("int"))
    by_range = placed.groupBy(key, "n", "b").agg(F.sum("c").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(key).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1).alias("at")) for p in percents]))
    held = by_range.withColumn("before", before).select("*", wanted.alias("w")).where((F.col("w.at") >= F.col("before")) & (F.col("w.at") < F.col("before") + F.col("c")))
    inside = placed.select(key, "b", value, F.col("c").alias("own")).join(F.broadcast(held.select(key, "b", "n", "before", "w.p", "w.at")), [key, "b"])
    upto = F.col("before") + F.sum("own").over(Window.partitionBy(key, "p").orderBy(value))
    found = inside.withColumn("upto", upto).where(F.col("upto") > F.col("at")).groupBy(key, "n").pivot("p", list(percents)).agg(F.min(value))
    return found.select(key, "n", *[F.col(str(p)).alias(f"p{p}") for p in percents])
