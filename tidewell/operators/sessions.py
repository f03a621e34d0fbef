"""Session state machines as windows: fixes, inferred help, repeats, worth of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORTH = {"remember": 3, "correction": 2, "repeat": 2, "nohit": 1}


def fixes(records: DataFrame) -> DataFrame:
    """``records`` (``session, seq, kind, program``) with ``fixed`` (a success right after a failure of its program) and
    ``island`` (how many fixes of the program came before)."""
    w = Window.partitionBy("session", "program").orderBy("seq")
    outcome = F.when(F.col("kind").isin("failed", "ok"), F.col("kind"))  # other records don't come between
    marked = records.withColumn("__last", F.last(outcome, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    fixed = (F.col("kind") == "ok") & F.coalesce(F.col("__last") == "failed", F.lit(False))
    before = F.sum(F.col("fixed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return marked.withColumn("fixed", fixed).withColumn("island", F.coalesce(before, F.lit(0)).cast("long")).drop("__last")


def inferred(records: DataFrame) -> DataFrame:
    """``session, id``: what was injected between a program's previous fix and the next, once a session."""
    out = fixes(records)
    done = out.where("fixed").select("session", "program", "island")
    return out.where("kind = 'injected'").join(done, ["session", "program", "island"], "left_semi").select("session", "id").distinct()


def worth(records: DataFrame) -> DataFrame:
    """``session, score``: how much a session's records say that it is worth a lesson; a fix counts 2 if its program
    failed at least three times in the session."""
    failures = F.count_if(F.col("kind") == "failed").over(Window.partitionBy("session", "program"))
    points: Column = F.when(F.col("kind") == "fixed", F.when(F.col("__failures") >= 3, 2).otherwise(1))
    for kind, n in WORTH.items():
        points = points.when(F.col("kind") == kind, n)
    return records.withColumn("__failures", failures).groupBy("session").agg(F.sum(points.otherwise(0)).alias("score"))


def after_last(records: DataFrame, mark: Column) -> DataFrame:
    """The records after the last marked one of their session; all if none is marked."""
    last = F.max(F.when(mark, F.col("seq"))).over(Window.partitionBy("session"))
    return records.withColumn("__last", last).where("__last IS NULL OR seq > __last").drop("__last")


def repeated_signatures(records: DataFrame) -> DataFrame:
    """``sig, sessions, second``: signatures of two or more sessions and the session that met it second."""
    seen = records.groupBy("sig", "session").agg(F.min("seq").alias("seq"))
    k = F.row_number().over(Window.partitionBy("sig").orderBy("seq", "session"))
    return (
        seen.withColumn("k", k).groupBy("sig").agg(F.count(F.lit(1)).alias("sessions"), F.max(F.when(F.col("k") == 2, F.col("session"))).alias("second")).where("sessions > 1")
    )


def collapse_runs(lines: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal neighbours as one row: the keys, the first ``order``, the value and the run's length ``n``."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    runs = lines.withColumn("__run", F.sum(new.cast("int")).over(w))
    return runs.groupBy(*keys, "__run").agg(F.min(order).alias(order), F.first(value).alias(value), F.count(F.lit(1)).alias("n")).drop("__run")


def within_budget(rows: DataFrame, keys: list[str], order: list, size: Column, budget: int) -> DataFrame:
    """Rows while the running total of their sizes stays within the budget; the total also counts rows left out."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("total", F.sum(size).over(w)).where(F.col("total") <= budget)
