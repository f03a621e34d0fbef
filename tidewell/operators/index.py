"""A kept search index: impact-ordered postings by term, and the best results of many queries by pruning blocks.

A term's postings are dealt to blocks by what they can add to a score (levels, the highest first) and by a hash of the
record, so that no block holds more than some ten thousands of postings however common its term is. A block carries the
most that any of its postings adds. The table is partitioned by a hash of the term, so queries read the folders of their
own terms only.

A search first looks at the first level of each of its terms. The sums that it finds there are less than the scores, so
the k-th of them, or the cut under the best one, is a score that results must reach. With it, terms whose most adds up to
less are left for later, and blocks (then postings) that can't reach it together with all other terms are skipped; what
remains is summed up over all terms.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.config import FIELD_WEIGHTS, Ranking
from tidewell.functions import text
from tidewell.operators import search
from tidewell.operators.joins import small
from tidewell.plans.lineage import durable, shared_folder

LEVELS = 16
#: Records whose postings may share a block, and postings of a folder.
BLOCK_RECORDS, FOLDER_POSTINGS = 1 << 16, 1 << 21
#: Terms up to which a search names them in the scan's filter; with more it joins.
MOST_NAMED = 4096
#: Scores are compared after rounding to six places, so what misses the mark by less isn't skipped.
SLACK = 1e-6


@dataclass(frozen=True)
class Index:
    """Where an index lies, and how it was made."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    @property
    def stats(self):
        return self.table("stats").first()


def _impact(r: Ranking) -> Column:
    return F.col("tf") * (r.k1 + 1) / (F.col("tf") + r.k1 * (1 - r.b + r.b * F.col("len") / F.col("avg_len")))


def term_counts(records: DataFrame, id_col: str = "id") -> DataFrame:
    """``id, len, term, tf``: the weighted number of times that each record has a term, and the terms of the record. A
    record is one row, so its terms are counted in place and nothing is shuffled."""
    weights = {k: w for k, w in FIELD_WEIGHTS.items() if k in records.columns}
    none = F.array().cast("array<string>")
    listed = records.select(F.col(id_col).alias("id"), *[F.coalesce(text.tokens(F.col(k).cast("string")), none).alias(f"__{k}") for k in weights])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch[f"__{k}"] for k in weights]
            sizes = [np.diff(x.offsets.to_numpy()) for x in lists]
            rows = np.concatenate([np.repeat(np.arange(batch.num_rows), n) for n in sizes])
            w = np.concatenate([np.full(n.sum(), float(v)) for n, v in zip(sizes, weights.values())])
            t = pa.table({"row": rows, "term": pa.concat_arrays([x.flatten() for x in lists]), "w": w})
            met = t.group_by(["row", "term"], use_threads=False).aggregate([("w", "sum")]).combine_chunks()
            row = met["row"].to_numpy()
            length = sum(sizes).astype(np.int64)[row]
            made = pa.table({"id": batch["id"].take(pa.array(row)), "len": length, "term": met["term"], "tf": met["w_sum"]})
            yield from made.to_batches()

    return listed.mapInArrow(run, f"id {listed.schema['id'].dataType.simpleString()}, len long, term string, tf double")


def build(records: DataFrame, folder: str, id_col: str = "id", tie: str = "title", r: Ranking = Ranking()) -> Index:
    """Write the index of ``records`` (distinct ids; the fields of ``FIELD_WEIGHTS`` that there are) to ``folder``.

    Null fields are empty. ``stats`` is written last: an index without it isn't whole.
    """
    spark = records.sparkSession
    # as a columnar file, which takes a fraction of a checkpoint of the same rows
    term_counts(records, id_col).write.mode("overwrite").parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    lens = counts.select("id", "len").distinct()
    names = records.select(F.col(id_col).alias("id"), (F.col(tie) if tie in records.columns else F.lit("")).alias("tie"))
    docs = durable(names.join(lens, "id", "left").select("id", "tie", F.coalesce("len", F.lit(0)).alias("len")))
    whole = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.greatest(F.avg("len"), F.lit(1.0)).alias("avg_len")).first()
    n_docs, avg_len = whole["n_docs"], whole["avg_len"] or 1.0
    any_terms = counts.count()
    buckets, salts = max(16, -(-any_terms // FOLDER_POSTINGS)), max(1, -(-n_docs // BLOCK_RECORDS))
    found = counts.withColumn("avg_len", F.lit(avg_len)).withColumn("impact", _impact(r))
    level = F.least(F.floor((1 - F.col("impact") / (r.k1 + 1)) * LEVELS), F.lit(LEVELS - 1)).cast("int")
    place = {"bucket": F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"), "level": level, "salt": F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")}
    # postings move once: to where their block is put together and written
    parts = found.withColumns(place).select("bucket", (F.col("salt") % 16).alias("part"), "term", "level", "salt", "id", "impact").repartition(buckets * min(16, salts), "bucket", "part")
    keyed = parts.groupBy("bucket", "part", "term", "level", "salt")
    blocks = keyed.agg(F.max("impact").alias("top"), F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("id", "impact")).alias("items"))
    dealt = blocks.drop("part").sortWithinPartitions("bucket", "term", "level")
    # without rows there would be no folder and no schema, so the folders are left out
    written = lambda df, name: df.write.mode("overwrite").partitionBy(*["bucket"] if any_terms else []).parquet(f"{folder}/{name}")
    written(dealt, "blocks")
    made = spark.read.parquet(f"{folder}/blocks")
    terms = made.groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.max("top").alias("top"), F.min("level").alias("first"))
    written(terms.sortWithinPartitions("bucket", "term"), "terms")
    docs.select("id", "tie").write.mode("overwrite").parquet(f"{folder}/docs")
    facts = f"{n_docs}L AS n_docs, cast('{avg_len!r}' AS double) AS avg_len, {buckets} AS buckets, '{r!r}' AS ranking"
    spark.range(1).selectExpr(*facts.split(", ", 3)).write.mode("overwrite").parquet(f"{folder}/stats")
    return Index(spark, folder)


def kept(records: DataFrame, id_col: str = "id", tie: str = "title", r: Ranking = Ranking()) -> Index:
    """The index of these records in the shared folder, made only if there is none of records with the same content."""
    row = F.xxhash64(*[F.col(c).cast("string") for c in sorted(records.columns)])
    mark = records.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("s")).first()
    settings = f"{sorted(records.columns)} {id_col} {tie} {r!r} {LEVELS} {BLOCK_RECORDS}"
    name = records.sparkSession.range(1).select(F.hex(F.xxhash64(F.lit(f"{tuple(mark)} {settings}")))).first()[0]
    found = Index(records.sparkSession, f"{shared_folder(records.sparkSession)}/index-{name}")
    try:
        found.stats
    except AnalysisException:  # no such folder
        build(records, found.folder, id_col, tie, r)
    return found


def _of_terms(table: DataFrame, named: list[str] | None, wanted: DataFrame, buckets: int) -> DataFrame:
    """The rows of wanted terms; with few of them their folders and names reach the scan."""
    if named is None:
        return table.join(small(wanted), "term", "left_semi")
    spark = table.sparkSession
    at = spark.createDataFrame([(t,) for t in named], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("b")).distinct().collect()
    return table.where(F.col("bucket").isin([r["b"] for r in at]) & F.col("term").isin(named))


def search_plan(index: Index, queries: DataFrame, k: int, r: Ranking = Ranking(), expand: bool = True) -> tuple[DataFrame, DataFrame]:
    """(``query_id, term, w, bound, others, mark, essential``, blocks of the queries' terms): what each term adds at most,
    what all others add, the score to reach, and whether records are looked for under the term."""
    stats = index.stats
    asked = durable(search.query_terms(queries).select("term").distinct())
    close = None
    if expand:
        vocabulary = index.table("terms").select("term")
        missing = asked.join(vocabulary, "term", "left_anti").where(~text.is_version(F.col("term")))
        close = durable(search.typo_expansions(missing, vocabulary, r))
        asked = durable(asked.union(close.select(F.col("close").alias("term"))).distinct())
    few = asked.limit(MOST_NAMED + 1).collect()
    named = sorted(x["term"] for x in few) if len(few) <= MOST_NAMED else None
    known = durable(_of_terms(index.table("terms"), named, asked, stats["buckets"]))
    weights = search.weights_of(queries, known, close, r)
    idf = F.log(1 + (stats["n_docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    lists = durable(weights.join(small(known), "term").withColumn("w", F.col("weight") * idf).withColumn("bound", F.col("w") * F.col("top")))
    blocks = _of_terms(index.table("blocks"), named, asked, stats["buckets"])
    seeds = blocks.join(small(lists.select("query_id", "term", "w", F.col("first").alias("level"))), ["term", "level"])
    sums = seeds.select("query_id", "w", F.explode("items").alias("x")).groupBy("query_id", F.col("x.id").alias("id")).agg(F.sum(F.col("w") * F.col("x.impact")).alias("part"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("part")))
    first = sums.withColumn("place", place).where(F.col("place") <= k)
    marks = first.groupBy("query_id").agg(F.greatest(F.max("part") * r.relative_cut, F.coalesce(F.max(F.when(F.col("place") == k, F.col("part"))), F.lit(0.0))).alias("mark"))
    every, rising = Window.partitionBy("query_id"), Window.partitionBy("query_id").orderBy("bound", "term")
    planned = lists.join(marks, "query_id", "left").withColumn("mark", F.coalesce("mark", F.lit(0.0)) - SLACK)
    planned = planned.withColumn("others", F.sum("bound").over(every) - F.col("bound")).withColumn("essential", F.sum("bound").over(rising) >= F.col("mark"))
    return durable(planned.select("query_id", "term", "w", "bound", "others", "mark", "essential")), blocks


def top_k(index: Index, queries: DataFrame, k: int = 10, r: Ranking = Ranking(), expand: bool = True) -> DataFrame:
    """``query_id, rank, id, score``: what ``search.rank`` gives with ``limit=k``, from the kept index.

    Queries without a known term have no rows. Records that tie are ordered by the index's tie column, then by id.
    """
    lists, blocks = search_plan(index, queries, k, r, expand)
    lead = lists.where("essential").select("query_id", "term", "w", "others", "mark")
    reach = lambda most: F.col("w") * most + F.col("others") >= F.col("mark")
    open_blocks = blocks.join(small(lead), "term").where(reach(F.col("top")))
    met = open_blocks.select("query_id", "w", "others", "mark", F.explode("items").alias("x")).where(reach(F.col("x.impact")))
    candidates = durable(met.select("query_id", F.col("x.id").alias("id")).distinct())
    added = blocks.join(small(lists.select("query_id", "term", "w")), "term").select("query_id", "w", F.explode("items").alias("x")).select("query_id", F.col("x.id").alias("id"), (F.col("w") * F.col("x.impact")).alias("part"))
    total = added.join(small(candidates), ["query_id", "id"]).groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score")).where("score > 0")
    best = F.max("score").over(Window.partitionBy("query_id"))
    cut = total.withColumn("best", best).where(F.col("score") >= F.round(F.col("best") * r.relative_cut, 6))
    named = index.table("docs").join(cut.select("query_id", "id", "score"), "id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "tie", "id"))
    return named.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
