"""Triage of candidates: rules, novelty, judgement and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.config import TRIVIAL_PROGRAMS, VOLATILE, VOLATILE_MAX_WORDS, Gates

NOTE = r"^- \d{4}-\d{2}-\d{2} \[\w+\] \(\w+; *\w+\) +\S"


def candidates(items: DataFrame) -> DataFrame:
    """``item, index, line, text, kind, signals``: a candidate for each note line of an observed item, else one."""
    lines = F.filter(F.transform(F.split("body", r"\r?\n", -1), lambda x, k: F.struct(k.alias("line"), F.trim(x).alias("text"))), lambda s: s["text"].rlike(NOTE))
    whole = F.array(F.struct(F.lit(None).cast("int").alias("line"), F.col("body").alias("text")))
    picked = F.when(F.col("kind") == "observed", lines).otherwise(whole)
    return items.select("item", "kind", "signals", F.posexplode(picked).alias("index", "c")).select("item", "index", "c.line", "c.text", "kind", "signals")


def volatile(text: Column) -> Column:
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return text.rlike(VOLATILE) & (words <= VOLATILE_MAX_WORDS)


def rule(text: Column, kind: Column, signals: Column) -> Column:
    """keep, drop or null: what needs no model."""
    teaches = F.exists(signals, lambda s: (s == "correction") | (s.startswith("fixed ") & ~F.substring(s, 7, 1000).isin(*TRIVIAL_PROGRAMS)))
    return F.when(F.array_contains(signals, "remember"), "keep").when(volatile(text), "drop").when((kind == "transcript") & ~teaches, "drop")


def judge(durable: Column, general: Column, preference: Column, not_a_lesson: Column, g: Gates = Gates()) -> Column:
    score = F.greatest(durable * general, preference)
    return F.when(not_a_lesson >= g.triage_keep, "drop").when(score >= g.triage_keep, "keep").when(score <= g.triage_drop, "drop").otherwise("unsure")


def verdict(ruled: Column, novelty: Column, judged: Column, g: Gates = Gates()) -> Column:
    """The cascade: rules first, then known knowledge, then the judgement (unsure without one)."""
    return F.coalesce(ruled, F.when(novelty >= g.triage_known, "known"), judged, F.lit("unsure"))


def finished(decided: DataFrame) -> DataFrame:
    """Items whose every candidate that isn't dropped has an outcome."""
    open_ = (F.col("verdict") != "drop") & F.col("outcome").isNull()
    return decided.groupBy("item").agg(F.count_if(open_).alias("open")).where("open = 0").select("item")
