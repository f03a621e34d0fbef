"""Three-valued applicability: yes, no, or unknown (null)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import markdown, versions


def matches(wanted: Column, fact: Column, key: Column | None = None) -> Column:
    """Whether a fact's value meets one wanted value: of the key ``path`` a shell pattern; of others ``name@range`` (equal names, then the range; unknown if the fact
    has no version), a range with a colon, or an equal text. A missing fact is unknown."""
    named, name, spec = wanted.contains("@"), F.substring_index(wanted, "@", 1), F.substring_index(wanted, "@", -1)
    fact_name, fact_version = F.substring_index(fact, "@", 1), F.substring_index(fact, "@", -1)
    with_name = F.when(fact_name != name, False).when(fact.contains("@"), versions.in_range(fact_version, spec))
    met = F.when(fact.isNull(), None)
    if key is not None:
        met = met.when(key == "path", F.rlike(fact, markdown.glob(wanted)))
    return met.when(named, with_name).when(wanted.contains(":"), versions.in_range(fact, wanted)).otherwise(fact == wanted)


def any_of(verdict: Column) -> Column:
    """OR over a group: yes if any is, else unknown if any is, else no (the built-in skips nulls)."""
    return F.when(F.max(F.coalesce(verdict, F.lit(False))), True).when(F.max(verdict.isNull()), None).otherwise(False)


def all_of(verdict: Column) -> Column:
    """AND over a group: no if any is, else unknown if any is, else yes."""
    return F.when(F.max(~F.coalesce(verdict, F.lit(True))), False).when(F.max(verdict.isNull()), None).otherwise(True)


def verdicts(records: DataFrame, conditions: DataFrame, facts: DataFrame, ancestry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(id, applies, no_keys)`` for every record, and ``(id, key, verdict)`` for every key.

    ``conditions`` has ``id, key, value``: values of a key are alternatives, keys must all hold, a record without keys
    applies. ``facts`` has ``key, fact``. ``no_keys`` lists the keys that decided against it. ``since`` and ``until`` ask
    whether a commit is an ancestor (``ancestry``: ``commit, is_ancestor``), which is unknown without a checkout.
    """
    met = conditions.join(facts, "key", "left")
    dated = F.col("key").isin("since", "until")
    if ancestry is not None:
        met = met.join(ancestry.withColumnsRenamed({"commit": "value", "is_ancestor": "__is"}), "value", "left")
        met = met.withColumn("v", F.when(dated, F.col("__is") == (F.col("key") == "since")).otherwise(matches(F.col("value"), F.col("fact"), F.col("key"))))
    else:
        met = met.withColumn("v", F.when(~dated, matches(F.col("value"), F.col("fact"), F.col("key"))))
    by_key = met.groupBy("id", "key").agg(any_of(F.col("v")).alias("verdict"))
    by_id = by_key.groupBy("id").agg(
        all_of(F.col("verdict")).alias("applies"), F.sort_array(F.collect_list(F.when(~F.col("verdict"), F.col("key")))).alias("no_keys")
    )
    ids = records.select("id").join(by_id, "id", "left")
    applies = F.when(F.col("no_keys").isNull(), True).otherwise(F.col("applies"))
    return ids.select("id", applies.alias("applies"), F.coalesce("no_keys", F.array().cast("array<string>")).alias("no_keys")), by_key


def hidden_by(applied: DataFrame) -> DataFrame:
    """How many records each deciding key hides."""
    return applied.select(F.explode("no_keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def effective_labels(records: DataFrame, notes: DataFrame, default: dict[str, str]) -> DataFrame:
    """``id, key, value``: a record's own label, else that of its nearest folder, else the default.

    ``records`` has ``id, path, labels`` (map); ``notes`` has ``folder, labels``. The folders above a path are exploded
    and joined by equality.
    """
    parts = F.split("path", "/")
    chain = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("folder"), k.alias("depth")))
    above = records.select("id", F.explode(chain).alias("c")).select("id", "c.folder", "c.depth")
    from_notes = above.join(notes, "folder").select("id", "depth", F.explode("labels").alias("key", "value"))
    own = records.select("id", F.lit(1 << 20).alias("depth"), F.explode("labels").alias("key", "value"))
    fixed = F.create_map(*[F.lit(x) for kv in default.items() for x in kv])
    base = records.select("id", F.lit(-1).alias("depth"), F.explode(fixed).alias("key", "value"))
    return own.union(from_notes).union(base).groupBy("id", "key").agg(F.max_by("value", "depth").alias("value"))


def allowed(labels: Column, allow: dict[str, list[str]]) -> Column:
    """Whether a label map passes a sink: every key must hold an allowed value; no keys, nothing passes."""
    if not allow:
        return F.lit(False)
    out = F.lit(True)
    for key, values in allow.items():
        out = out & F.coalesce(F.get(F.array(labels[key]), F.lit(0)).isin(*values), F.lit(False))
    return out
