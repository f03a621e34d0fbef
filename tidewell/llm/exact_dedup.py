"""Exact deduplication by a tree merge of sorted digest runs (DataFrame operations only).

Rows are dealt to ranges by the leading bits of their digest, and within a range to ``2 ** rounds`` leaves by the
partition that they were read in, so copies of one text, however many, are spread over all leaves. Each leaf is reduced
to a run: one row for each digest, in order. Then partitions exchange runs in binomial rounds: in round r the run of a
leaf with bit r set goes to the leaf without it, and both are merged in order of the digest: equal digests stand next to
each other, their counts are added and the winning identifier is kept. After the last round one run is left in each
range. A merge only joins rows whose SHA-256, 64-bit hash and byte length all agree, which is the verification that each
level does. Ranges are as many as the session's shuffle partitions, so no run holds more than a range's distinct digests.

The way back down is the same tree: the winner of a digest is first joined with the digest's rows of each leaf (at most
one a leaf) and only then with documents by (digest, leaf), so a text with very many copies is never one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, lower_ascii

KEY = ["digest", "check", "octets"]
PLACE = ["range", "leaf"]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 4, keep: str = "largest") -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Null texts count as empty ones; empty texts are copies of each other. The row with the largest id of each group
    stays (or the smallest, with ``keep="smallest"``); a null id loses to any other. If several rows of a group
    repeat the winning id, one of them stays. Other columns are ignored, so their names can't clash. An empty table
    gives an empty result.
    """
    pick = F.max if keep == "largest" else F.min
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    ranges = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hashed = docs.select(F.col(id_col).alias("id"), text.alias("t")).select(
        "id",
        F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"),
        F.xxhash64("t").alias("check"),
        F.octet_length("t").alias("octets"),
        F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().alias("leaf"),
    )
    leading = F.conv(F.substring(F.hex("digest"), 1, 7), 16, 10).cast("long")
    rows = durable(hashed.withColumns({"range": F.shiftright(leading * ranges, 28).cast("int"), "leaf": F.pmod("leaf", F.lit(1 << rounds)).cast("int")}))
    # struct order: a null id sorts first, so the largest wins over it; for the smallest it is put last
    mark = F.struct(F.col("id").isNotNull().alias("named") if keep == "largest" else F.col("id").isNull().alias("named"), "id", "row")
    leaves = rows.groupBy(*PLACE, *KEY).agg(pick(mark).alias("best"), F.count(F.lit(1)).alias("n"))
    merged = leaves
    for r in range(rounds):
        sent = merged.withColumn("leaf", F.col("leaf").bitwiseAND(F.lit(~(1 << r))))
        in_order = sent.repartition(*PLACE).sortWithinPartitions(*PLACE, *KEY)
        merged = in_order.groupBy(*PLACE, *KEY).agg(pick("best").alias("best"), F.sum("n").alias("n"))
    winners = merged.select("range", *KEY, F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("n").alias("group_size"))
    in_leaves = leaves.select(*PLACE, *KEY).join(winners, ["range", *KEY])
    return rows.join(in_leaves, [*PLACE, *KEY]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
