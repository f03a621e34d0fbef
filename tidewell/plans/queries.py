"""The registered queries of the engine over the driver's tables, each with the SQL that it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.config import REMEMBER, STOP_WORDS, VOLATILE, VOLATILE_MAX_WORDS
from tidewell.functions import text, versions
from tidewell.operators import conditions, evaluation, index, leaks, review, search, sessions, similarity, triage, usage
from tidewell.plans.lineage import durable
from tidewell.plans.registry import QUERIES, SQL, query, table

def lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: the first line is the title, the source the topic, the language the tag."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), text.first_line(F.col("text")).alias("title"), F.col("text").alias("body"), "source", "lang")


# --- SQL building blocks -------------------------------------------------------------------------------------------

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def sql_tokens(x: str) -> str:
    """The terms of a text, as ``text.tokens`` gives them."""
    kept = f"len({{0}}) >= 2 AND {{0}} NOT IN ({STOPS})"
    whole = f"CASE WHEN {kept.format('lower(w)')} THEN [lower(w)] ELSE [] END"
    humps = r"regexp_replace(regexp_replace(w, '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), '([\p{Ll}0-9])(\p{Lu})', '\1 \2', 'g')"
    parts = f"list_filter(list_transform(regexp_split_to_array({humps}, '[_./:@ -]'), lambda p: lower(p)), lambda p: {kept.format('p')})"
    return (
        f"flatten(list_transform(list_filter(list_transform(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_./:@-]+'), "
        r"lambda r: regexp_replace(r, '^[_./:@-]+|[_./:@-]+$', '', 'g')), lambda r: r <> ''), "
        rf"lambda w: CASE WHEN regexp_matches(w, '^[A-Za-z0-9][a-z0-9]*$') THEN {whole} "
        rf"WHEN regexp_matches(w, '^[vV]?[0-9][A-Za-z0-9._-]*$') AND regexp_matches(w, '[._-]') THEN [lower(w)] "
        rf"WHEN len({parts}) > 1 OR (len({parts}) = 1 AND ({parts})[1] <> lower(w)) THEN list_concat({whole}, {parts}) ELSE {whole} END))"
    )


LESSONS = "l AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS body, source, lang FROM documents)"
#: Usage records made from events: what each event type stands for. Fixed values.
EVENT_NAMES = {"purchase": "worked", "error": "failed", "view": "injected", "click": "inferred", "signup": "restored"}
SQL_EVENT = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_NAMES.items()) + " END"
#: An error of a small value is a report that something was irrelevant.
IRRELEVANT_BELOW = 20
USAGE = f"""u AS (SELECT user_id AS id, event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS time, ts,
  CASE WHEN event_type = 'error' AND value < {IRRELEVANT_BELOW} THEN 'irrelevant' ELSE {SQL_EVENT} END AS event, value FROM events)"""


def usage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    named = None
    for k, v in EVENT_NAMES.items():
        named = F.when(F.col("event_type") == k, v) if named is None else named.when(F.col("event_type") == k, v)
    event = F.when((F.col("event_type") == "error") & (F.col("value") < IRRELEVANT_BELOW), "irrelevant").otherwise(named)
    return e.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), "ts", event.alias("event"), "value")


# --- text ----------------------------------------------------------------------------------------------------------


@query(
    "term_frequencies",
    f"""WITH t AS (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents)
    SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM t GROUP BY term""",
)
def term_frequencies(spark, sf_dir):
    terms = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.tokens(F.col("text"))).alias("term"))
    per = terms.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("records"))


@query(
    "titles_and_sentences",
    r"""WITH l AS (SELECT doc_id, text, trim(split_part(text, chr(10), 1), ' ') AS title, regexp_replace(regexp_extract(text, '(?m)^[ \t]*(\S.*)$', 1), '^[-* ]+', '') AS line FROM documents)
    SELECT doc_id, title, trim(CASE WHEN regexp_matches(line, '[.?!] ') THEN regexp_extract(line, '^(.*?[.?!]) ', 1) ELSE line END, ' ') AS sentence, len(text) AS chars FROM l""",
)
def titles_and_sentences(spark, sf_dir):
    t = F.col("text")
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.trim(text.first_line(t)).alias("title"), text.first_sentence(t).alias("sentence"), F.char_length(t).cast("long").alias("chars"))


@query(
    "prompt_signals",
    r"""WITH s AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^.!?\n]*[.!?\n]|[^.!?\n]+$')) AS s FROM conversations WHERE role = 'user'),
    k AS (SELECT conv_id, turn, trim(s, ' ') AS s FROM s WHERE NOT ends_with(s, '?')),
    g AS (SELECT conv_id, turn, bool_or(regexp_matches(s, '(?i)^(no,\s*(use|it)\b|actually\b|that''?s wrong|that is wrong|don''?t\b|do not\b|stop doing\b|instead\b)')) AS correction,
      bool_or(regexp_matches(s, '(?i)\b(remember|note that|keep in mind|don''?t forget)\b')) AS remember FROM k GROUP BY conv_id, turn)
    SELECT c.conv_id, c.turn, coalesce(correction, false) AS correction, coalesce(remember, false) AS remember FROM conversations c LEFT JOIN g USING (conv_id, turn) WHERE role = 'user'""",
)
def prompt_signals(spark, sf_dir):
    said = text.prompt_signals(F.col("text"))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", said["correction"].alias("correction"), said["remember"].alias("remember"))


@query(
    "content_hashes",
    """SELECT doc_id, substr(sha256(text), 1, 12) AS hash, octet_length(encode(text)) AS bytes, len(string_split(text, chr(10))) AS lines FROM documents""",
)
def content_hashes(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.content_hash(t).alias("hash"), F.octet_length(t).cast("long").alias("bytes"), F.size(F.split(t, "\n", -1)).cast("long").alias("lines")
    )


# --- search --------------------------------------------------------------------------------------------------------

BM25 = f"""
tt AS (SELECT id, {sql_tokens('title')} AS a, {sql_tokens('body')} AS b FROM l),
lens AS (SELECT id, len(a) + len(b) AS n FROM tt),
st AS (SELECT count(*) AS docs, greatest(avg(n), 1.0) AS avg_len FROM lens),
occ AS (SELECT id, unnest(a) AS term, 3.0 AS w FROM tt UNION ALL SELECT id, unnest(b), 1.0 FROM tt),
qp AS (SELECT query_id, i AS p, {sql_tokens('words[i]')} AS ts FROM (SELECT query_id, words, unnest(range(1, len(words) + 1)) AS i FROM
  (SELECT item_id AS query_id, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') AS words FROM benchmark))),
qt AS (SELECT query_id, p, ts[1] AS whole, unnest(ts) AS term, unnest(range(len(ts))) AS j FROM qp WHERE len(ts) > 0),
tf AS (SELECT term, id, sum(w) AS tf FROM occ WHERE term IN (SELECT term FROM qt) GROUP BY term, id),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qw AS (SELECT query_id, term, CASE WHEN j > 0 AND whole IN (SELECT term FROM df) THEN 0.5 ELSE 1.0 END AS weight
  FROM qt WHERE term IN (SELECT term FROM df) QUALIFY row_number() OVER (PARTITION BY query_id, term ORDER BY p, j) = 1),
sc AS (SELECT query_id, tf.id, round(sum(weight * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len))), 6) AS score
  FROM qw JOIN df USING (term) JOIN tf USING (term) JOIN lens ON lens.id = tf.id CROSS JOIN st GROUP BY query_id, tf.id),
cut AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM sc WHERE score > 0),
rk AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, cut.id) AS INTEGER) AS rank, cut.id, score
  FROM cut JOIN l ON l.id = cut.id WHERE score >= round(best * 0.3, 6))
"""


def _benchmark(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("ranked_search", f"WITH {LESSONS}, {BM25} SELECT query_id, rank, id, score FROM rk WHERE rank <= 10")
def ranked_search(spark, sf_dir):
    held = index.kept(lessons(spark, sf_dir).select("id", "title", "body"))
    return index.top_k(held, _benchmark(spark, sf_dir), k=10, expand=False)


@query(
    "retrieval_quality",
    f"""WITH {LESSONS}, {BM25},
    ex AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)),
    r AS (SELECT query_id, min(rank) FILTER (WHERE rk.id IS NOT NULL) AS rank FROM ex LEFT JOIN (SELECT * FROM rk WHERE rank <= 10) rk USING (query_id, id) GROUP BY query_id)
    SELECT count(*) AS n, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr FROM r""",
)
def retrieval_quality(spark, sf_dir):
    queries = _benchmark(spark, sf_dir)
    hits = ranked_search(spark, sf_dir)
    expected = search.holding(table(spark, sf_dir, "documents"), "text", queries.withColumnRenamed("text", "q"), ["doc_id"]).withColumnRenamed("doc_id", "id")
    return evaluation.recall_mrr(evaluation.first_expected(hits, expected, queries))


@query(
    "literal_search",
    r"""WITH s AS (SELECT doc_id AS id, string_split(text, chr(10)) AS ls FROM documents WHERE contains(text, 'License')),
    m AS (SELECT id, ls, unnest(range(1, len(ls) + 1)) AS n FROM s)
    SELECT id, min(n) AS line_no, trim(arg_min(ls[n], n), ' ') AS line FROM m WHERE contains(ls[n], 'License') GROUP BY id""",
)
def literal_search(spark, sf_dir):
    return search.first_match(table(spark, sf_dir, "documents"), "License", "doc_id", "text", literal=True)


@query(
    "pattern_search",
    r"""WITH s AS (SELECT doc_id AS id, string_split(text, chr(10)) AS ls FROM documents),
    m AS (SELECT id, ls, unnest(range(1, len(ls) + 1)) AS n FROM s)
    SELECT id, min(n) AS line_no, trim(arg_min(ls[n], n), ' ') AS line FROM m WHERE regexp_matches(ls[n], '[0-9]{3,}') GROUP BY id""",
)
def pattern_search(spark, sf_dir):
    return search.first_match(table(spark, sf_dir, "documents"), "[0-9]{3,}", "doc_id", "text")


def _misspelt(spark, sf_dir):
    """Every term of the passages with its second and third letters swapped."""
    terms = _benchmark(spark, sf_dir).select(F.explode(text.tokens(F.col("text"))).alias("t")).distinct()
    t = F.col("t")
    swapped = F.concat(F.substring(t, 1, 1), F.substring(t, 3, 1), F.substring(t, 2, 1), F.expr("substring(t, 4)"))
    return terms.where(F.char_length(t) >= 3).select(swapped.alias("term")).distinct()


# no SQL: DuckDB's distance counts bytes and lets a swapped pair be edited again, ours doesn't; tests compare with brute force
@query("typo_expansion")
def typo_expansion(spark, sf_dir):
    words = durable(table(spark, sf_dir, "documents").select(F.explode(text.tokens(F.col("text"))).alias("term")).distinct())
    return search.typo_expansions(_misspelt(spark, sf_dir).join(words, "term", "left_anti"), words)


# no SQL: DuckDB has no distance with swaps that are edited once; tests compare with brute force
@query("fuzzy_names")
def fuzzy_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.explode(F.array("p_name", "p_brand", F.concat_ws(" ", "p_type", "p_name"))).alias("name"))
    # every distinct name with its second and third letters swapped, and its beginning
    known = part.select(F.col("p_name").alias("t")).distinct()
    swapped = F.concat(F.substring("t", 1, 1), F.substring("t", 3, 1), F.substring("t", 2, 1), F.expr("substring(t, 4)"))
    asked = known.select(F.explode(F.array(swapped, F.substring("t", 1, 6))).alias("text")).distinct()
    return search.find(names, asked.withColumn("query_id", F.xxhash64("text")), 10)


@query(
    "rerank_by_relevance",
    """WITH h AS (SELECT label AS query_id, vec_id AS id, CAST(row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS INTEGER) AS rank, CAST(embedding[2] AS DOUBLE) AS rel FROM embeddings),
    t AS (SELECT * FROM h WHERE rank <= 20), r AS (SELECT * FROM t WHERE id % 3 <> 0),
    s AS (SELECT query_id, rank AS slot, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM r),
    o AS (SELECT query_id, id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS k FROM r)
    SELECT query_id, slot AS rank, id, round(rel, 6) AS relevance FROM o JOIN s USING (query_id, k)
    UNION ALL SELECT query_id, rank, id, NULL FROM t WHERE id % 3 = 0""",
)
def rerank_by_relevance(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    w = Window.partitionBy("label").orderBy(F.desc(F.get("embedding", F.lit(0))), "vec_id")
    hits = e.select(F.col("label").alias("query_id"), F.col("vec_id").alias("id"), F.row_number().over(w).alias("rank"), F.get("embedding", F.lit(1)).cast("double").alias("relevance")).where("rank <= 20")
    scores = hits.where("id % 3 != 0").select("query_id", "id", "relevance")
    return search.rerank(hits.select("query_id", "rank", "id"), scores).withColumn("relevance", F.round("relevance", 6))


# --- usage ---------------------------------------------------------------------------------------------------------

COUNTS = """c AS (SELECT id, count_if(event = 'worked') AS worked, count_if(event = 'failed') AS failed, count_if(event = 'injected') AS injected,
  count_if(event = 'inferred') AS inferred, count_if(event = 'irrelevant') AS irrelevant,
  max(substr(time, 1, 10)) FILTER (WHERE event = 'worked') AS last_worked, max(substr(time, 1, 10)) FILTER (WHERE event = 'failed') AS last_failed,
  max(substr(time, 1, 10)) FILTER (WHERE event = 'injected') AS last_injected, max(substr(time, 1, 10)) AS last_any
  FROM {0} WHERE event IS NOT NULL GROUP BY id)"""


@query("usage_counts", f"WITH {USAGE}, {COUNTS.format('u')} SELECT * FROM c")
def usage_counts(spark, sf_dir):
    return usage.counts(usage_records(spark, sf_dir))


@query(
    "usage_factor_and_tier",
    f"""WITH {USAGE}, {COUNTS.format('u')}, f AS (SELECT *, worked + 0.5 * inferred AS helpful, CAST(failed + irrelevant AS DOUBLE) AS harmful FROM c)
    SELECT id, round(greatest(0.9, least(1.1, 1 + 0.05 * ln(1 + helpful) - 0.1 * least(harmful, 3.0) / 3)), 6) AS factor,
    CASE WHEN id % 10 = 0 THEN 'archive' WHEN worked > 0 THEN 'proven' ELSE 'candidate' END AS tier,
    CASE WHEN harmful = 0 OR (worked = 0 AND failed + irrelevant < 2) THEN NULL WHEN harmful > helpful THEN 'more harmful than helpful'
      WHEN worked = 0 THEN 'reported irrelevant or failed twice with no worked report' END AS demotion FROM f""",
)
def usage_factor_and_tier(spark, sf_dir):
    c = usage.counts(usage_records(spark, sf_dir))
    return c.select("id", F.round(usage.factor(), 6).alias("factor"), usage.tier(F.col("id") % 10 != 0).alias("tier"), usage.demotion().alias("demotion"))


@query(
    "counts_since_restored",
    f"""WITH {USAGE}, m AS (SELECT id, max(time) AS last FROM u WHERE event = 'restored' GROUP BY id),
    s AS (SELECT u.* FROM u LEFT JOIN m USING (id) WHERE last IS NULL OR time > last), {COUNTS.format('s')} SELECT * FROM c""",
)
def counts_since_restored(spark, sf_dir):
    return usage.counts(usage.since_restored(usage_records(spark, sf_dir)))


@query(
    "irrelevant_since_worked",
    f"""WITH {USAGE}, p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY time, seq) AS n FROM u),
    r AS (SELECT *, coalesce(max(n) FILTER (WHERE event IN ('worked', 'restored')) OVER (PARTITION BY id), 0) AS reset FROM p)
    SELECT id, count_if(event = 'irrelevant' AND n > reset) AS n FROM r GROUP BY id""",
)
def irrelevant_since_worked(spark, sf_dir):
    return usage.irrelevant_since_worked(usage_records(spark, sf_dir))


@query(
    "first_report_after",
    f"""WITH {USAGE}, a AS (SELECT id % 7 AS session, id, seq FROM u WHERE event = 'injected'), b AS (SELECT id % 7 AS session, id, seq, event FROM u WHERE event IN ('worked', 'irrelevant'))
    SELECT a.session, a.id, a.seq, b.seq AS report_seq, b.event AS report FROM a ASOF LEFT JOIN b ON a.session = b.session AND a.id = b.id AND a.seq < b.seq""",
)
def first_report_after(spark, sf_dir):
    u = usage_records(spark, sf_dir).withColumn("session", F.col("id") % 7)
    return usage.first_report_after(u.where("event = 'injected'"), u.where("event IN ('worked', 'irrelevant')"))


@query(
    "recent_injection",
    f"""WITH {USAGE} SELECT w.id, w.seq, (SELECT max((i.ts, i.seq)) FROM u i WHERE i.id = w.id AND i.event = 'injected'
      AND epoch_us(i.ts) // 1000000 BETWEEN epoch_us(w.ts) // 1000000 - 21600 AND epoch_us(w.ts) // 1000000 - 1)[2] AS shown FROM u w WHERE w.event = 'worked'""",
)
def recent_injection(spark, sf_dir):
    u = usage_records(spark, sf_dir)
    shown = usage.last_within(u, F.col("event") == "injected", ["id"], "ts", 6 * 3600, "seq")
    return u.withColumn("shown", shown).where("event = 'worked'").select("id", "seq", "shown")


SQL["recent_injection"] = f"""WITH {USAGE}, x AS (SELECT w.id, w.seq, i.ts AS its, i.seq AS iseq FROM u w LEFT JOIN u i ON i.id = w.id AND i.event = 'injected'
  AND epoch_us(i.ts) // 1000000 BETWEEN epoch_us(w.ts) // 1000000 - 21600 AND epoch_us(w.ts) // 1000000 - 1 WHERE w.event = 'worked'),
  r AS (SELECT *, row_number() OVER (PARTITION BY id, seq ORDER BY its DESC NULLS LAST, iseq DESC) AS k FROM x) SELECT id, seq, iseq AS shown FROM r WHERE k = 1"""


@query(
    "write_bursts",
    f"""WITH {USAGE}, n AS (SELECT id, seq, count(*) OVER (PARTITION BY id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM u)
    SELECT * FROM n WHERE n > 2""",
)
def write_bursts(spark, sf_dir):
    return usage.too_many(usage_records(spark, sf_dir), ["id"], "ts", 3600, 2).select("id", "seq", "n")


@query(
    "nearest_rank_percentiles",
    """WITH v AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)
    SELECT event_type, len(v) AS n, v[least(len(v) * 50 // 100, len(v) - 1) + 1] AS p50, v[least(len(v) * 90 // 100, len(v) - 1) + 1] AS p90 FROM v""",
)
def nearest_rank_percentiles(spark, sf_dir):
    return usage.nearest_ranks(table(spark, sf_dir, "events"), "event_type", "value", (50, 90))


@query(
    "overview_rollup",
    """SELECT source, lang, CAST(grouping_id(source, lang) AS BIGINT) AS level, count(*) AS lessons, count_if(n_chars > 5000) AS long_ones FROM documents GROUP BY ROLLUP (source, lang)""",
)
def overview_rollup(spark, sf_dir):
    return table(spark, sf_dir, "documents").rollup("source", "lang").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("lessons"), F.count_if(F.col("n_chars") > 5000).alias("long_ones")
    )


# --- similarity ----------------------------------------------------------------------------------------------------

VECTORS = f"""
tt AS (SELECT id, {sql_tokens('title')} AS a, {sql_tokens('lang')} AS g, {sql_tokens('body')} AS b FROM l),
occ AS (SELECT id, unnest(a) AS term, 3.0 AS w FROM tt UNION ALL SELECT id, unnest(g), 2.5 FROM tt UNION ALL SELECT id, unnest(b), 1.0 FROM tt),
tf AS (SELECT id, term, sum(w) AS tf FROM occ GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT id, term, round((1 + ln(tf)) * ln((1 + (SELECT count(*) FROM l)) / (1 + df)), 9) AS w FROM tf JOIN df USING (term)),
k AS (SELECT * FROM w WHERE w > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, term) <= 64),
v AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM k),
pairs AS (SELECT x.id AS a, y.id AS b, least(round(sum(x.w * y.w), 6), 1.0) AS similarity FROM v x JOIN v y ON x.term = y.term AND x.id < y.id GROUP BY x.id, y.id)
"""


def _pairs(spark, sf_dir, least):
    records = lessons(spark, sf_dir).select("id", "title", F.col("lang").alias("tags"), "body")
    return similarity.pairs(similarity.vectors(records), least)


@query("similar_pairs", f"WITH {LESSONS}, {VECTORS} SELECT * FROM pairs WHERE similarity >= 0.4")
def similar_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir, 0.4)


@query(
    "ordered_pairs",
    f"WITH {LESSONS}, {VECTORS} SELECT *, CAST(row_number() OVER (ORDER BY similarity DESC, a, b) AS INTEGER) AS place FROM pairs WHERE similarity >= 0.4",
)
def ordered_pairs(spark, sf_dir):
    return similarity.in_order(_pairs(spark, sf_dir, 0.4))


@query("orphans", f"WITH {LESSONS}, {VECTORS} SELECT id FROM l WHERE id NOT IN (SELECT a FROM pairs WHERE similarity >= 0.2 UNION SELECT b FROM pairs WHERE similarity >= 0.2)")
def orphans(spark, sf_dir):
    return similarity.orphans(lessons(spark, sf_dir).select("id"), _pairs(spark, sf_dir, 0.2))


@query(
    "clusters",
    f"""WITH RECURSIVE {LESSONS}, {VECTORS}, e AS (SELECT a, b FROM pairs WHERE similarity >= 0.4 UNION SELECT b, a FROM pairs WHERE similarity >= 0.4),
    reach(id, to_id) AS (SELECT a, a FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.to_id)
    SELECT id, min(to_id) AS cluster FROM reach GROUP BY id""",
)
def clusters(spark, sf_dir):
    return similarity.clusters(_pairs(spark, sf_dir, 0.4))


@query(
    "related",
    f"""WITH {LESSONS}, {VECTORS}, s AS (SELECT * FROM pairs WHERE similarity >= 0.2), o AS (SELECT a AS id, b AS other, similarity FROM s UNION ALL SELECT b, a, similarity FROM s),
    j AS (SELECT o.id, other, false AS strong, similarity, CAST(x.source = y.source AS BIGINT) AS shared FROM o JOIN l x ON x.id = o.id JOIN l y ON y.id = other)
    SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY similarity DESC, shared DESC, other) AS INTEGER) AS place FROM j QUALIFY place <= 5""",
)
def related(spark, sf_dir):
    source = lessons(spark, sf_dir).select("id", "source")
    # strong edges aside, a record's places go by similarity first
    best = durable(similarity.nearest(_pairs(spark, sf_dir, 0.2), 5))
    edges = best.join(source.withColumnsRenamed({"id": "a", "source": "sa"}), "a").join(source.withColumnsRenamed({"id": "b", "source": "sb"}), "b")
    same = F.when(F.col("sa") == F.col("sb"), F.array(F.concat(F.lit("topic:"), F.col("sa"))))
    return similarity.related(edges.select("a", "b", F.lit("similar").alias("kind"), "similarity", same.alias("shared")))


# --- versions and conditions ---------------------------------------------------------------------------------------

PART_VERSION = "CAST(p_size % 4 AS VARCHAR) || '.' || CAST(p_partkey % 20 AS VARCHAR) || CASE p_partkey % 5 WHEN 0 THEN '-rc1' WHEN 1 THEN '.2' ELSE '' END"


def _part_versions(spark, sf_dir):
    tail = F.expr("CASE p_partkey % 5 WHEN 0 THEN '-rc1' WHEN 1 THEN '.2' ELSE '' END")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.expr("CAST(p_size % 4 AS STRING)"), F.lit("."), F.expr("CAST(p_partkey % 20 AS STRING)"), tail).alias("version"))


def sql_key(x: str) -> str:
    """Version text as a sortable list: words 0, the end 1, numbers 2."""
    return (
        f"list_concat(list_transform(regexp_extract_all(lower({x}), '[0-9]+|[a-z]+'), lambda p: {{'r': CASE WHEN regexp_matches(p, '^[0-9]+$') THEN 2 ELSE 0 END, "
        f"'n': coalesce(TRY_CAST(p AS BIGINT), 0), 'w': CASE WHEN regexp_matches(p, '^[0-9]+$') THEN '' ELSE p END}}), [{{'r': 1, 'n': 0, 'w': ''}}])"
    )


@query(
    "version_order",
    f"""WITH v AS (SELECT DISTINCT {PART_VERSION} AS version FROM part) SELECT version, CAST(row_number() OVER (ORDER BY {sql_key('version')}, version) AS INTEGER) AS place FROM v""",
)
def version_order(spark, sf_dir):
    # at most 4 * 20 * 3 distinct versions, so one partition
    distinct = _part_versions(spark, sf_dir).select("version").distinct()
    return distinct.select("version", F.row_number().over(Window.orderBy(versions.key(F.col("version")), "version")).alias("place"))


@query(
    "version_ranges",
    f"""WITH v AS (SELECT p_partkey, {PART_VERSION} AS version FROM part), k AS (SELECT *, {sql_key('version')} AS k FROM v)
    SELECT p_partkey, version, (k >= {sql_key("'1.12'")} OR k[1:2] = {sql_key("'1.12'")}[1:2]) AND (k <= {sql_key("'2.5'")} OR k[1:2] = {sql_key("'2.5'")}[1:2]) AS between_both,
    k <= {sql_key("'1.14'")} OR k[1:2] = {sql_key("'1.14'")}[1:2] AS up_to, k[1:1] = {sql_key("'3'")}[1:1] AS by_prefix FROM k""",
)
def version_ranges(spark, sf_dir):
    v = F.col("version")
    r = lambda spec: versions.in_range(v, F.lit(spec))
    return _part_versions(spark, sf_dir).select("p_partkey", "version", r("1.12:2.5").alias("between_both"), r(":1.14").alias("up_to"), r("3").alias("by_prefix"))


@query(
    "applicability",
    """WITH c AS (SELECT doc_id AS id, 'lang' AS key, lang AS value FROM documents UNION ALL SELECT doc_id, 'lang', 'en' FROM documents WHERE doc_id % 3 = 0
      UNION ALL SELECT doc_id, 'source', source FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'host', 'h1' FROM documents WHERE doc_id % 5 = 0),
    f AS (SELECT * FROM (VALUES ('lang', 'en'), ('source', 'src0')) t(key, fact)),
    m AS (SELECT id, key, CASE WHEN fact IS NULL THEN NULL ELSE fact = value END AS v FROM c LEFT JOIN f USING (key)),
    k AS (SELECT id, key, CASE WHEN bool_or(coalesce(v, false)) THEN true WHEN bool_or(v IS NULL) THEN NULL ELSE false END AS v FROM m GROUP BY id, key)
    SELECT id, CASE WHEN bool_or(NOT coalesce(v, true)) THEN false WHEN bool_or(v IS NULL) THEN NULL ELSE true END AS applies,
    coalesce(string_agg(key, ',' ORDER BY key) FILTER (WHERE NOT v), '') AS no_keys FROM k GROUP BY id""",
)
def applicability(spark, sf_dir):
    return _applied(spark, sf_dir).withColumn("no_keys", F.array_join("no_keys", ","))


def _applied(spark, sf_dir):
    docs = lessons(spark, sf_dir)
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    i = F.col("id")
    listed = F.array_compact(
        F.array(pair("lang", F.col("lang")), F.when(i % 3 == 0, pair("lang", F.lit("en"))), F.when(i % 2 == 0, pair("source", F.col("source"))), F.when(i % 5 == 0, pair("host", F.lit("h1"))))
    )
    wanted = docs.select("id", F.explode(listed).alias("c")).select("id", "c.key", "c.value")
    facts = spark.createDataFrame([("lang", "en"), ("source", "src0")], "key string, fact string")
    return conditions.verdicts(docs, wanted, F.broadcast(facts))[0]


@query(
    "hidden_by_key",
    "WITH a AS (" + SQL["applicability"] + ") SELECT key, count(*) AS n FROM (SELECT unnest(string_split(no_keys, ',')) AS key FROM a WHERE no_keys <> '') GROUP BY key",
)
def hidden_by_key(spark, sf_dir):
    return conditions.hidden_by(_applied(spark, sf_dir))


# --- evaluation ----------------------------------------------------------------------------------------------------

REVIEWED = """r AS (SELECT doc_id, quality = 1 AS expects, doc_id % 11 <> 0 AS ranked,
  CASE WHEN doc_id % 7 = 0 THEN 'unavailable' WHEN toxic = 1 OR doc_id % 2 = 0 THEN 'injected' ELSE 'silent' END AS decision,
  quality = 1 AND doc_id % 3 <> 0 AS correct_top, doc_id % 8 + 1 AS rank, source, lang FROM labels JOIN documents USING (doc_id))"""
METRICS = """count(*) AS n, count_if(NOT ranked) AS skipped, count_if(ranked AND decision = 'unavailable') AS unknown,
  count_if(ranked AND decision <> 'unavailable') AS eligible, count_if(expects AND ranked) AS answerable, count_if(NOT expects AND ranked AND decision <> 'unavailable') AS no_answer,
  count_if(ranked AND decision = 'injected') AS injections, count_if(ranked AND decision = 'injected' AND correct_top) AS correct,
  count_if(ranked AND decision = 'injected' AND NOT correct_top) AS wrong,
  round(count_if(expects AND ranked AND rank <= 5) / nullif(count_if(expects AND ranked), 0), 6) AS recall,
  round(count_if(ranked AND decision = 'injected' AND correct_top) / nullif(count_if(ranked AND decision = 'injected'), 0), 6) AS precision,
  round(count_if(ranked AND decision = 'injected' AND NOT expects) / nullif(count_if(NOT expects AND ranked AND decision <> 'unavailable'), 0), 6) AS false_injection,
  round(count_if(ranked AND decision = 'injected') / nullif(count_if(ranked AND decision <> 'unavailable'), 0), 6) AS coverage,
  round(count_if(ranked AND decision = 'injected' AND NOT correct_top) / nullif(count_if(ranked AND decision = 'injected'), 0), 6) AS risk,
  count_if(ranked AND decision = 'unavailable') AS unavailable, count_if(ranked AND decision = 'silent' AND expects) AS silent_positive, count_if(ranked AND decision = 'silent' AND NOT expects) AS silent_negative,
  round(count_if(expects AND ranked AND rank = 1) / nullif(count_if(expects AND ranked), 0), 6) AS recall_at_1,
  round(count_if(ranked AND decision = 'injected') / nullif(count_if(ranked AND decision <> 'unavailable'), 0), 6) AS injection_rate"""


def _reviewed(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    return rows.selectExpr(
        "doc_id", "quality = 1 AS expects", "doc_id % 11 != 0 AS ranked",
        "CASE WHEN doc_id % 7 = 0 THEN 'unavailable' WHEN toxic = 1 OR doc_id % 2 = 0 THEN 'injected' ELSE 'silent' END AS decision",
        "quality = 1 AND doc_id % 3 != 0 AS correct_top", "doc_id % 8 + 1 AS rank", "source", "lang",
    )


@query("reviewed_metrics", f"WITH {REVIEWED} SELECT {METRICS} FROM r")
def reviewed_metrics(spark, sf_dir):
    return evaluation.reviewed_metrics(_reviewed(spark, sf_dir))


@query("reviewed_slices", f"WITH {REVIEWED} SELECT source, lang, {METRICS} FROM r GROUP BY CUBE (source, lang)")
def reviewed_slices(spark, sf_dir):
    return evaluation.reviewed_metrics(_reviewed(spark, sf_dir), ["source", "lang"], cube=True)


SWEEP = """s AS (SELECT label AS query_id, vec_id AS id, round(abs(embedding[1]) * 3, 6) AS relevance FROM embeddings),
  b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS k, lead(relevance, 1, 0.0) OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS next FROM s),
  t AS (SELECT query_id, id, relevance AS top, next, id % 2 = 0 AS r FROM b WHERE k = 1),
  p AS (SELECT least, margin, r, top >= least AND round(top - next, 9) >= margin AS shown FROM t CROSS JOIN (SELECT unnest([0.7, 0.75, 0.8, 0.85, 0.9, 0.95]) AS least) CROSS JOIN (SELECT unnest([0.0, 0.05, 0.1, 0.15]) AS margin)),
  g AS (SELECT CAST(least AS DOUBLE) AS least, CAST(margin AS DOUBLE) AS margin, count_if(shown AND r) AS "right", count_if(shown AND NOT r) AS wrong, count_if(NOT shown) AS silent FROM p GROUP BY ALL)"""


def _points(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    scored = e.select(F.col("label").alias("query_id"), F.col("vec_id").alias("id"), F.round(F.abs(F.get("embedding", F.lit(0))) * 3, 6).cast("double").alias("relevance"))
    expected = scored.where("id % 2 = 0").select("query_id", "id")
    return evaluation.sweep(evaluation.top_two(scored), expected, [0.7, 0.75, 0.8, 0.85, 0.9, 0.95], [0.0, 0.05, 0.1, 0.15])


@query("threshold_sweep", f"WITH {SWEEP} SELECT * FROM g")
def threshold_sweep(spark, sf_dir):
    return _points(spark, sf_dir)


@query("threshold_pick", f"""WITH {SWEEP} SELECT * FROM g WHERE "right" + wrong > 0 AND "right" >= 0.3 * ("right" + wrong) ORDER BY "right" + wrong DESC, least, margin LIMIT 1""")
def threshold_pick(spark, sf_dir):
    return evaluation.pick(_points(spark, sf_dir), 0.3)


# --- sessions and triage -------------------------------------------------------------------------------------------

SESSIONS = """r AS (SELECT user_id AS session, event_id AS seq, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'ok' WHEN 'view' THEN 'injected' WHEN 'click' THEN 'nohit' ELSE 'remember' END AS kind,
  'p' || CAST(CAST(floor(coalesce(value, 0)) AS BIGINT) % 3 AS VARCHAR) AS program, CAST(floor(coalesce(value, 0)) AS BIGINT) % 17 AS id FROM events)"""
FIXES = """f AS (SELECT *, kind = 'ok' AND coalesce(last_value(CASE WHEN kind IN ('failed', 'ok') THEN kind END IGNORE NULLS) OVER (PARTITION BY session, program ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'failed', false) AS fixed FROM r),
  i AS (SELECT *, CAST(coalesce(sum(CAST(fixed AS INTEGER)) OVER (PARTITION BY session, program ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS island FROM f)"""


def _session_records(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS session", "event_id AS seq",
        "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'ok' WHEN 'view' THEN 'injected' WHEN 'click' THEN 'nohit' ELSE 'remember' END AS kind",
        "concat('p', CAST(CAST(floor(coalesce(value, 0)) AS BIGINT) % 3 AS STRING)) AS program", "CAST(floor(coalesce(value, 0)) AS BIGINT) % 17 AS id",
    )


@query("session_fixes", f"WITH {SESSIONS}, {FIXES} SELECT session, seq, program, island FROM i WHERE fixed")
def session_fixes(spark, sf_dir):
    return sessions.fixes(_session_records(spark, sf_dir)).where("fixed").select("session", "seq", "program", "island")


@query("inferred_help", f"WITH {SESSIONS}, {FIXES} SELECT DISTINCT session, id FROM i WHERE kind = 'injected' AND (session, program, island) IN (SELECT (session, program, island) FROM i WHERE fixed)")
def inferred_help(spark, sf_dir):
    return sessions.inferred(_session_records(spark, sf_dir))


@query(
    "session_worth",
    f"""WITH {SESSIONS}, {FIXES}, k AS (SELECT session, program, CASE WHEN fixed THEN 'fixed' ELSE kind END AS kind FROM i), n AS (SELECT *, count_if(kind = 'failed') OVER (PARTITION BY session, program) AS n FROM k)
    SELECT session, CAST(sum(CASE kind WHEN 'remember' THEN 3 WHEN 'fixed' THEN CASE WHEN n >= 3 THEN 2 ELSE 1 END WHEN 'nohit' THEN 1 ELSE 0 END) AS BIGINT) AS score FROM n GROUP BY session""",
)
def session_worth(spark, sf_dir):
    marked = sessions.fixes(_session_records(spark, sf_dir)).withColumn("kind", F.when(F.col("fixed"), "fixed").otherwise(F.col("kind")))
    return sessions.worth(marked.select("session", "seq", "kind", "program"))


@query(
    "repeated_signatures",
    """WITH d AS (SELECT doc_id AS seq, source AS session, substr(sha256(text), 1, 24) AS sig FROM documents),
    s AS (SELECT sig, session, min(seq) AS seq FROM d GROUP BY sig, session), k AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY seq, session) AS k FROM s)
    SELECT sig, count(*) AS sessions, max(session) FILTER (WHERE k = 2) AS second FROM k GROUP BY sig HAVING count(*) > 1""",
)
def repeated_signatures(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("source").alias("session"), F.substring(F.sha2("text", 256), 1, 24).alias("sig"))
    return sessions.repeated_signatures(d)


@query(
    "collapsed_runs",
    """WITH r AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM r)
    SELECT user_id, min(event_id) AS event_id, min(event_type) AS event_type, count(*) AS n FROM g GROUP BY user_id, run""",
)
def collapsed_runs(spark, sf_dir):
    return sessions.collapse_runs(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


@query(
    "digest_budget",
    """WITH t AS (SELECT source, doc_id, sum(n_chars + 1) OVER (PARTITION BY source ORDER BY doc_id) AS total FROM documents) SELECT source, doc_id, CAST(total AS BIGINT) AS total FROM t WHERE total <= 60000""",
)
def digest_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return sessions.within_budget(d, ["source"], ["doc_id"], F.col("n_chars") + 1, 60_000).select("source", "doc_id", "total")


@query(
    "triage_verdicts",
    rf"""WITH s AS (SELECT conv_id, turn, role, text, list_filter(regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n]|[^.!?\n]+$'), lambda x: NOT ends_with(x, '?') AND regexp_matches(x, '{REMEMBER.replace("'", "''")}')) AS r FROM conversations),
    i AS (SELECT conv_id AS item, string_agg(coalesce(text, ''), chr(10) ORDER BY turn, text) AS body, bool_or(len(r) > 0) AS remember, bool_or(len(r) = 0 AND role = 'system') AS correction FROM s GROUP BY conv_id),
    v AS (SELECT item, CASE WHEN remember THEN 'keep' WHEN regexp_matches(body, '{VOLATILE}') AND len(list_filter(regexp_split_to_array(body, '\s+'), lambda w: w <> '')) <= {VOLATILE_MAX_WORDS} THEN 'drop' WHEN NOT correction THEN 'drop' END AS ruled FROM i)
    SELECT item, 0 AS index, ruled, coalesce(ruled, 'unsure') AS verdict FROM v""",
)
def triage_verdicts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    items = turns.groupBy(F.col("conv_id").alias("item")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: F.coalesce(t["text"], F.lit(""))), "\n").alias("body"),
        F.lit("transcript").alias("kind"),
        F.array_distinct(F.collect_list(F.when(text.prompt_signals(F.col("text"))["remember"], "remember").when(F.col("role") == "system", "correction"))).alias("signals"),
    )
    c = triage.candidates(items)
    return c.select("item", "index", triage.rule(F.col("text"), F.col("kind"), F.col("signals")).alias("ruled")).withColumn("verdict", triage.verdict(F.col("ruled"), F.lit(0.0), F.lit(None).cast("string")))


@query(
    "worth_judgement",
    """WITH e AS (SELECT vec_id, abs(embedding[1]) * 4 AS d, abs(embedding[2]) * 4 AS g, abs(embedding[3]) * 4 AS p, abs(embedding[4]) * 4 AS x FROM embeddings)
    SELECT vec_id, CASE WHEN x >= 0.6 THEN 'drop' WHEN greatest(d * g, p) >= 0.6 THEN 'keep' WHEN greatest(d * g, p) <= 0.3 THEN 'drop' ELSE 'unsure' END AS verdict FROM e""",
)
def worth_judgement(spark, sf_dir):
    at = lambda k: F.abs(F.get("embedding", F.lit(k))) * 4
    return table(spark, sf_dir, "embeddings").select("vec_id", triage.judge(at(0), at(1), at(2), at(3)).alias("verdict"))


@query(
    "leak_scan",
    r"""WITH s AS (SELECT doc_id AS id, string_split(text, chr(10)) AS ls FROM documents), n AS (SELECT id, ls, unnest(range(1, len(ls) + 1)) AS n FROM s),
    e AS (SELECT id, n AS line_no, 'leak/email' AS rule, unnest(regexp_extract_all(ls[n], '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b')) AS found FROM n),
    p AS (SELECT id, n, 'leak/path', unnest(regexp_extract_all(ls[n], '(?:^|[^A-Za-z0-9_$./~-])((?:/home/|/Users/|/g/g|/p/lustre|/p/vast|/usr/workspace/|/scratch/|/lustre/)[^\s"''`)\]>,;]+)', 1)) FROM n),
    j AS (SELECT id, n, 'leak/job-id', unnest(regexp_extract_all(ls[n], '(?i:\bjob[_ ]?id\s*[=:]\s*\d+|\bsubmitted batch job \d+|\bSLURM_JOB_ID=\d+)|ƒ[1-9A-HJ-NP-Za-km-z]{4,}')) FROM n),
    f AS (SELECT id, n, 'leak/job-id', unnest(list_filter(regexp_extract_all(ls[n], '\bf[1-9A-HJ-NP-Za-km-z]{6,12}\b'), lambda m: regexp_matches(substr(m, 2), '[0-9]') AND regexp_matches(substr(m, 2), '[A-Z]'))) FROM n)
    SELECT * FROM e WHERE NOT starts_with(found, 'git@') UNION ALL SELECT * FROM p UNION ALL SELECT * FROM j UNION ALL SELECT * FROM f""",
)
def leak_scan(spark, sf_dir):
    return leaks.scan(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("redacted_texts")
def redacted_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(leaks.redact(F.col("text")), 256).alias("sha256"))


# --- links ---------------------------------------------------------------------------------------------------------


@query(
    "page_links",
    r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"#?]+)', 1)) AS target FROM pages)
    SELECT lower(target) AS target, count(*) AS links, count(DISTINCT page_id) AS pages FROM a GROUP BY lower(target)""",
)
def page_links(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"#?]+)'), F.lit(1))).alias("target"))
    per = found.groupBy(F.lower("target").alias("target"), "page_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("target").agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("pages"))


@query(
    "page_hosts",
    r"""SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, lower(regexp_extract(url, '^https?://([^?#]+)', 1)) AS address, len(string_split(split_part(split_part(url, '?', 1), '#', 1), '/')) - 3 AS depth FROM pages""",
)
def page_hosts(spark, sf_dir):
    bare = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1)).alias("host"),
        F.lower(F.regexp_extract("url", "^https?://([^?#]+)", 1)).alias("address"),
        (F.size(F.split(bare, "/", -1)) - 3).cast("long").alias("depth"),
    )


@query(
    "lint_findings",
    """WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents)
    SELECT doc_id, 'size/lesson-lines' AS rule, 'warning' AS severity FROM t WHERE len(ls) > 150
    UNION ALL SELECT doc_id, 'body/title', 'error' FROM t WHERE trim(ls[1], ' ') = '' OR NOT regexp_matches(ls[1], '^[\\p{L}\\p{N}]')
    UNION ALL SELECT doc_id, 'body/empty-section', 'warning' FROM t WHERE trim(text, ' ' || chr(10)) = ''
    UNION ALL SELECT doc_id, 'quality/title', 'info' FROM t WHERE len(ls[1]) > 120""".replace("\\\\", "\\"),
)
def lint_findings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", text.first_line(F.col("text")).alias("first"))
    finding = lambda rule, severity: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))
    # one pass over the texts for all rules
    found = F.array_compact(
        F.array(
            F.when(F.size(F.split("text", "\n", -1)) > 150, finding("size/lesson-lines", "warning")),
            F.when((F.trim("first") == "") | ~F.col("first").rlike(r"^[\p{L}\p{N}]"), finding("body/title", "error")),
            F.when(F.regexp_replace("text", r"[ \n]", "") == "", finding("body/empty-section", "warning")),
            F.when(F.char_length("first") > 120, finding("quality/title", "info")),
        )
    )
    return docs.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.rule", "f.severity")


# --- review --------------------------------------------------------------------------------------------------------

TODAY = "2024-02-10"
KEPT = """k AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN 'stale' WHEN c_custkey % 13 = 0 THEN 'archived' ELSE 'active' END AS status,
  strftime(DATE '2024-02-10' - CAST(c_custkey * 3 % 500 AS INTEGER), '%Y-%m-%d') AS verified, CASE WHEN c_custkey % 20 = 0 THEN '2024-02-01' WHEN c_custkey % 21 = 0 THEN '2024-03-01' END AS expires FROM customer)"""


def _kept(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "CASE WHEN c_custkey % 9 = 0 THEN 'stale' WHEN c_custkey % 13 = 0 THEN 'archived' ELSE 'active' END AS status",
        "date_format(date_sub(DATE '2024-02-10', CAST(c_custkey * 3 % 500 AS INT)), 'yyyy-MM-dd') AS verified",
        "CASE WHEN c_custkey % 20 = 0 THEN '2024-02-01' WHEN c_custkey % 21 = 0 THEN '2024-03-01' END AS expires",
    )


@query(
    "review_reasons",
    f"""WITH {USAGE}, {COUNTS.format('u')}, {KEPT}, o AS (SELECT k.id, count_if(event = 'failed' AND time >= verified) AS bad, bool_or(CAST(substr(time, 1, 10) AS DATE) >= DATE '{TODAY}' - 180) AS recent FROM k JOIN u ON u.id = k.id GROUP BY k.id),
    j AS (SELECT k.id, status, verified, expires, coalesce(bad, 0) AS bad, coalesce(recent, false) AS recent, coalesce(worked, 0) AS worked, coalesce(injected, 0) AS injected, coalesce(inferred, 0) AS inferred, coalesce(irrelevant, 0) AS irrelevant
      FROM k LEFT JOIN c ON c.id = k.id LEFT JOIN o ON o.id = k.id WHERE status IN ('active', 'stale')),
    r AS (SELECT id, concat_ws('; ', CASE WHEN id % 6 = 1 THEN 'retired' END, CASE WHEN id % 8 IN (1, 2) THEN 'unsupported cuda' END, CASE WHEN expires <= '{TODAY}' THEN 'expired' END, CASE WHEN status = 'stale' AND date_diff('day', CAST(verified AS DATE), DATE '{TODAY}') > 90 THEN 'long stale' END,
      CASE WHEN id % 6 IN (1, 4) AND id % 8 = 3 THEN 'missing commit' END, CASE WHEN bad >= 2 THEN 'failed since verified' END, CASE WHEN injected >= 5 AND worked + inferred = 0 THEN 'never helped' END,
      CASE WHEN irrelevant >= 3 AND irrelevant >= worked + inferred THEN 'often irrelevant' END, CASE WHEN CAST(verified AS DATE) < DATE '{TODAY}' - 180 AND NOT recent THEN 'unused' END) AS reasons FROM j)
    SELECT * FROM r WHERE reasons <> ''""",
)
def review_reasons(spark, sf_dir):
    kept = _kept(spark, sf_dir)
    none = F.create_map().cast("map<string,array<string>>")
    value = F.expr("CASE id % 8 WHEN 1 THEN array('11', ':11.4') WHEN 2 THEN array('10:11.9') WHEN 4 THEN array('11', '12:') ELSE array('12.1') END")
    when = F.when(F.col("id") % 8 == 3, F.create_map(F.lit("since"), F.array(F.lit("abc")))).when(F.col("id") % 8 < 6, F.create_map(F.lit("cuda"), value)).otherwise(none)
    placed = kept.withColumns({"path": F.expr("concat('projects/p', CAST(id % 6 AS STRING), '/t/', CAST(id AS STRING), '.md')"), "when": when})
    # the checkouts of two projects are at hand; neither has the commit
    commits = spark.createDataFrame([("p1", "def"), ("p4", "def")], "project string, commit string")
    found = review.reasons(placed, usage_records(spark, sf_dir), TODAY, spark.createDataFrame([("projects/p1",)], "folder string"), {"cuda": "12"}, commits)
    return found.select("id", F.array_join("reasons", "; ").alias("reasons"))


@query(
    "verified_records",
    f"""WITH {KEPT}, p AS (SELECT o_custkey AS id, bool_and(o_orderstatus <> 'P') AS passed FROM orders GROUP BY o_custkey)
    SELECT k.id, CASE WHEN NOT passed THEN 'stale' WHEN passed AND status = 'stale' THEN 'active' ELSE status END AS status,
    CASE WHEN passed AND (status = 'stale' OR date_diff('day', CAST(verified AS DATE), DATE '{TODAY}') > 30) THEN '{TODAY}' ELSE verified END AS verified FROM k LEFT JOIN p ON p.id = k.id""",
)
def verified_records(spark, sf_dir):
    results = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.bool_and(F.col("o_orderstatus") != "P").alias("passed"))
    kept = _kept(spark, sf_dir).withColumn("stale_reason", F.lit(None).cast("string"))
    return review.verify(kept, results, TODAY).select("id", "status", "verified")


#: Customers that owe more than this hold back all that link to them. Fixed value.
DEEP_IN_DEBT = -800


@query(
    "held_back",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS src, o_orderkey % (SELECT count(*) FROM customer) + 1 AS dst FROM orders),
    h(id) AS (SELECT c_custkey FROM customer WHERE c_acctbal < {DEEP_IN_DEBT} UNION SELECT e.src FROM e JOIN h ON e.dst = h.id) SELECT id FROM h""",
)
def held_back(spark, sf_dir):
    n = table(spark, sf_dir, "customer").count()
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % n + 1).alias("dst"))
    return review.held_back(links, table(spark, sf_dir, "customer").where(F.col("c_acctbal") < DEEP_IN_DEBT).select(F.col("c_custkey").alias("id")))
