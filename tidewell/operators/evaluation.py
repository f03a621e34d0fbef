"""Evaluation of retrieval: ranks, recall and MRR, reviewed metrics, threshold sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_expected(hits: DataFrame, expected: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, rank``: the first place of an expected id; null if none was found. Only queries that expect some."""
    answerable = queries.select("query_id").join(expected.select("query_id").distinct(), "query_id", "left_semi")
    found = hits.join(expected, ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return answerable.join(found, "query_id", "left")


def recall_mrr(ranks: DataFrame, k: int = 5) -> DataFrame:
    """One row ``n, recall, mrr``; both 0 without answerable queries."""
    return ranks.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.coalesce(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), F.lit(0.0)), 6).alias("recall"),
        F.round(F.coalesce(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), F.lit(0.0)), 6).alias("mrr"),
    )


def _ratio(num: Column, den: Column) -> Column:
    return F.round(num / F.nullif(den, F.lit(0)), 6)


def reviewed_metrics(rows: DataFrame, by: list[str] | None = None, cube: bool = False, k: int = 5) -> DataFrame:
    """Metrics over reviewed decisions: ``expects, ranked, decision (injected, silent, unavailable), correct_top, rank``.

    ``ranked`` false rows are skipped, ranked rows without a decision are unknown; the rest are eligible. A ratio with
    denominator zero is null. ``recall`` looks at the first ``k`` places, ``recall_at_1`` at the first; ``risk`` is the share
    of injections that are wrong. ``by`` groups; ``cube`` adds all subtotals.
    """
    ranked, decided = F.col("ranked"), F.col("decision") != "unavailable"
    injected = ranked & (F.col("decision") == "injected")
    c = lambda x: F.count_if(x)
    n, skipped, unknown = F.count(F.lit(1)), c(~ranked), c(ranked & ~decided)
    answerable, no_answer = c(F.col("expects") & ranked), c(~F.col("expects") & ranked & decided)
    injections, correct = c(injected), c(injected & F.col("correct_top"))
    found, false = c(F.col("expects") & ranked & (F.col("rank") <= k)), c(injected & ~F.col("expects"))
    eligible, silent = n - skipped - unknown, ranked & (F.col("decision") == "silent")
    first = c(F.col("expects") & ranked & (F.col("rank") == 1))
    aggs = [
        n.alias("n"), skipped.alias("skipped"), unknown.alias("unknown"), eligible.alias("eligible"), answerable.alias("answerable"),
        no_answer.alias("no_answer"), injections.alias("injections"), correct.alias("correct"), (injections - correct).alias("wrong"),
        _ratio(found, answerable).alias("recall"), _ratio(correct, injections).alias("precision"),
        _ratio(false, no_answer).alias("false_injection"), _ratio(injections, eligible).alias("coverage"),
        _ratio(injections - correct, injections).alias("risk"), unknown.alias("unavailable"),
        c(silent & F.col("expects")).alias("silent_positive"), c(silent & ~F.col("expects")).alias("silent_negative"),
        _ratio(first, answerable).alias("recall_at_1"), _ratio(injections, eligible).alias("injection_rate"),
    ]
    if not by:
        return rows.agg(*aggs)
    return (rows.cube(*by) if cube else rows.groupBy(*by)).agg(*aggs)


def top_two(scored: DataFrame) -> DataFrame:
    """``query_id, id, top, next``: the best hit of each query, with the relevance of the second (0 if none)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id")
    both = scored.withColumn("next", F.lead("relevance", 1, 0.0).over(w)).withColumn("k", F.row_number().over(w))
    return both.where("k = 1").select("query_id", "id", F.col("relevance").alias("top"), "next")


def sweep(tops: DataFrame, expected: DataFrame, minima: list[float], margins: list[float]) -> DataFrame:
    """``least, margin, right, wrong, silent`` for every point of a grid of thresholds (a few dozen rows)."""
    judged = tops.join(expected.withColumn("right", F.lit(True)), ["query_id", "id"], "left").withColumn("right", F.coalesce("right", F.lit(False)))
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("least"), F.lit(b).alias("margin")) for a in minima for b in margins]))
    points = judged.withColumn("g", grid).select("g.*", "right", ((F.col("top") >= F.col("g.least")) & (F.round(F.col("top") - F.col("next"), 9) >= F.col("g.margin"))).alias("shown"))
    return points.groupBy("least", "margin").agg(
        F.count_if(F.col("shown") & F.col("right")).alias("right"),
        F.count_if(F.col("shown") & ~F.col("right")).alias("wrong"),
        F.count_if(~F.col("shown")).alias("silent"),
    )


def pick(points: DataFrame, precision: float) -> DataFrame:
    """The grid point of most coverage among those precise enough; of equal ones the lowest thresholds."""
    shown = F.col("right") + F.col("wrong")
    enough = points.where((shown > 0) & (F.col("right") >= precision * shown))
    return enough.orderBy(F.desc(shown), "least", "margin").limit(1)
