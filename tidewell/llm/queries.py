"""The registered queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, language, license_scan, line_dedup, lm, packing, simhash, spelling, topk, toxicity, whitening
from .common import id_fold, table


def vocabulary() -> str:
    """The path of the tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary())


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    made = chat.format_chats(turns.unionByName(extra))
    turn = F.transform(chat.read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"]))
    return made.withColumn("turns", turn).withColumn("learnt", F.array_join(loss, "")).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
    )


#: What the template adds to a turn of each role, in characters, and the strings whose first character is escaped.
_MARKS = {"system": 8 + 10, "user": 7 + 8, "assistant": 3 + 4}
_CONTROL = ("<s>", "</s>", "<SYS>>", "</SYS>>", "<<SYS>>", "<</SYS>>", "<TURN>", "</TURN>", "[INST]", "[/INST]")
_ESCAPES = " + ".join(f"(len(text) - len(replace(text, '{c}', ''))) // {len(c)} * 3" for c in _CONTROL)

OP2_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, string_agg(role, ' ' ORDER BY turn, role, text) AS roles,
    sum(len(text) + (len(text) - len(replace(text, '&', ''))) * 4 + {_ESCAPES} + CASE role {' '.join(f"WHEN '{r}' THEN {n}" for r, n in _MARKS.items())} END) AS chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(len(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars,
  regexp_full_match(roles, '(system )?user assistant( user assistant)*') AS valid FROM g
"""


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


OP3_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP5_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", (id_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = license_scan.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    best = F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))
    return made.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.col("places.label"), F.col("blocks.label"))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id",
        "n_lines",
        F.size("removed").cast("long").alias("n_removed"),
        F.sha2("text", 256).alias("text_sha256"),
        "removed",
    )


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


#: crc32 by its table of 256 numbers; words at one edit share what is left without a letter, or with a hole for it.
OP11_SQL = """
WITH RECURSIVE tab AS (
  SELECT list(x ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS x FROM (SELECT unnest(range(256)) AS i))),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE len(run) >= 5 GROUP BY ALL),
hashed AS (
  SELECT run, k, xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split(key, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END)),
    lambda a, b: xor(a // 256, t[1 + xor(a, b) % 256]))) AS h FROM runs, tab),
w AS MATERIALIZED (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, k FROM hashed)
  WHERE len(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT word, n, i, left(word, i - 1) || '?' || substr(word, i + 1) AS hole, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, len(word) + 1)) AS i FROM w)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
pick AS (SELECT word, n_near, m, min(other) AS other FROM best JOIN near USING (word, m) GROUP BY ALL),
f AS MATERIALIZED (SELECT w.word, CASE WHEN m >= 2 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN m END AS form_n FROM w LEFT JOIN pick USING (word)),
chain AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.*, root FROM f JOIN chain USING (word) JOIN f AS g ON g.word = chain.root WHERE g.form IS NULL
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening(table(spark, sf_dir, "embeddings"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, held_out=language.in_fold())
    return language.predict(docs, model).select("doc_id", language.in_fold().alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_chat_format": op2_chat_format,
    "op3_topk": op3_topk,
    "op4_packing": op4_packing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_lm": op8_lm,
    "op9_license_scan": op9_license_scan,
    "op10_line_dedup": op10_line_dedup,
    "op11_spelling": op11_spelling,
    "op12_whitening": op12_whitening,
    "op13_language": op13_language,
}
SQL = {"op2_chat_format": OP2_SQL, "op3_topk": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op11_spelling": OP11_SQL}
