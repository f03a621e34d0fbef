"""From raw documents to packed training sequences: toxicity, line dedup, near-dedup by five-word shingles, best-fit packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import line_dedup, packing, simhash, toxicity
from tidewell.llm.common import durable, shared_folder, small, table
from tidewell.llm.queries import vocabulary


# All stages: a null text counts as empty, a null id is an id like others, repeated rows are rows of their own unless a
# stage says otherwise, columns beside those that it reads pass through whatever their names, and an empty table gives one.


def _aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns of those names under others, and the columns that bring all back."""
    moved = {n: f"__own_{n}" for n in names if n in docs.columns}
    return docs.withColumnsRenamed(moved), [F.col(f"`{moved.get(c, c)}`").alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. Empty texts are scored too; without labels of both classes none goes."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    rows, kept = _aside(docs, ("score", "predicted"))
    return toxicity.score(rows, model).where("predicted = 0").select(*kept)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occurred in an earlier document or line go; documents stay, also those left without text. Null texts
    become empty. Rows that repeat both id and text keep the same lines."""
    rows, kept = _aside(docs, ("n_lines", "removed"))
    made = line_dedup.line_dedup(rows)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return made.select(*kept)


def row_keys() -> dict[str, Column]:
    """128 bits of a document's id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return {"__k1": F.xxhash64("doc_id", text), "__k2": F.xxhash64(F.lit(5), text, F.col("doc_id"))}


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (0.8 of their five-word shingles at least, over any number of links) the document with the least id stays; one without an id only if none has any.

    A document is an id with a text, so that others of its id, or without one, aren't touched; rows that repeat both
    count as one document.
    """
    rows = docs.withColumns(row_keys())
    keyed = rows.select(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "__k1", "__k2").alias("doc"), "text")
    found = simhash.near_duplicates(keyed, "doc", "text", width=5, percent=80)
    gone = durable(found.where(F.col("doc") != F.col("component_id")).select("doc.__k1", "doc.__k2").distinct())
    return rows.join(small(gone), ["__k1", "__k2"], "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as pieces packed into sequences of 1024 tokens; an empty text is the end token alone."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: The trained model, the shingles of byte strings and the packing have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet in the shared folder and read again. The last table is read by what is
    returned; the others stay there too, for a lost executor's tasks may read them again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
