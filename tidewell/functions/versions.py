"""Versions and ranges as sortable keys; all comparisons are plain array comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts sort as: word < end of the version < number.
WORD, END, NUMBER = 0, 1, 2
TOP_WORDS = ("develop", "main", "master", "head")


def _bare(version: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(version)), r"^v(?=[0-9])", "")


def parts(version: Column) -> Column:
    """array of struct(rank, num, word), or null if the text isn't a version."""
    runs = F.regexp_extract_all(_bare(version), F.lit(r"[0-9]+|\p{L}+"), F.lit(0))
    number = lambda p: p.rlike("^[0-9]+$")
    keyed = F.transform(
        runs,
        lambda p: F.struct(
            F.when(number(p), NUMBER).otherwise(WORD).alias("rank"),
            F.when(number(p), p.try_cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)")).alias("num"),
            F.when(number(p), F.lit("")).otherwise(p).alias("word"),
        ),
    )
    return F.when(_bare(version).rlike(r"^[0-9\p{L}._-]+$") & (F.size(runs) > 0), keyed)


def key(version: Column) -> Column:
    """struct(top, parts with an end mark): sorts as versions do."""
    p = parts(version)
    end = F.struct(F.lit(END).alias("rank"), F.lit(0).cast("decimal(20,0)").alias("num"), F.lit("").alias("word"))
    top = F.get(p, F.lit(0))["word"].isin(*TOP_WORDS)
    return F.when(p.isNotNull(), F.struct(top.cast("int").alias("top"), F.concat(p, F.array(end)).alias("parts")))


def has_prefix(version: Column, prefix: Column) -> Column:
    a, b = parts(version), parts(prefix)
    return F.slice(a, F.lit(1), F.greatest(F.size(b), F.lit(1))) == b


def in_range(version: Column, spec: Column) -> Column:
    """Whether a version lies in ``low:high`` (either may be missing, both are included by prefix) or, without a colon,
    has the given prefix. Null if one of them isn't a version."""
    ranged = spec.contains(":")
    low = F.when(ranged, F.substring_index(spec, ":", 1)).otherwise(spec)
    high = F.when(ranged, F.substring_index(spec, ":", -1)).otherwise(spec)
    open_low, open_high = F.trim(low) == "", F.trim(high) == ""
    above = open_low | (key(version) >= key(low)) | has_prefix(version, low)
    below = open_high | (key(version) <= key(high)) | has_prefix(version, high)
    return F.when(parts(version).isNotNull(), above & below)


def older_than(spec: Column, version: Column) -> Column:
    """Whether all versions of a range (see ``in_range``) lie before a version. An open end never does."""
    high = F.when(spec.contains(":"), F.substring_index(spec, ":", -1)).otherwise(spec)
    return (F.trim(high) != "") & (key(high) < key(version)) & ~has_prefix(version, high)
