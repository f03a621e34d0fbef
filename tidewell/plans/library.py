"""Registered queries over records, links, logs and write actions. Parts are read as records with Markdown bodies, events
as session and use logs; the expressions that say so are the same in Spark and in the SQL that results are checked against."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.config import Ranking
from tidewell.functions import markdown, text
from tidewell.operators import conditions, digest, full_search, graph, hooks, lint, reports, sessions, similarity, triage, usage, writes
from tidewell.plans.queries import COUNTS
from tidewell.plans.lineage import shared_folder
from tidewell.plans.registry import QUERIES, SQL, query, stream, table
from tidewell.sources import tails
from tidewell.streaming import gates

__all__ = ["QUERIES", "SQL"]

#: The day of all reports, and the second of the last event. Fixed values.
TODAY = "2026-06-30"
#: Records that others name: links and reports lead to the first ones, which all tables have.
FIRST = 200


def ident(n: str) -> str:
    return f"lpad(CAST({n} AS STRING), 10, '0')"


def home(n: str) -> str:
    topic, owner = f"CAST(({n}) % 7 AS STRING)", f"CAST(({n}) % 5 AS STRING)"
    return f"CASE ({n}) % 3 WHEN 0 THEN concat('general/t', {topic}) WHEN 1 THEN concat('projects/o', {owner}, '/t', {topic}) ELSE concat('systems/o', {owner}, '/t', {topic}) END"


def file(n: str) -> str:
    return f"concat({home(n)}, '/l', CAST({n} AS STRING), '.md')"


def case(n: str, modulus: int, names: list[str]) -> str:
    return f"CASE {n} % {modulus} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(names)) + " END"


K = "p_partkey"
NL = "chr(10)"
TYPES, LEADS = ["pitfall", "recipe", "fact", "decision", "preference"], ["Symptom", "When to use", "Statement", "Decision", "Rule"]
LINKED = f"(({K} * 5 + 1) % {FIRST})"
TITLE = f"concat(p_name, ' of ', p_brand, ' no ', CAST({K} AS STRING))"
UP = f"CASE WHEN {K} % 3 = 0 THEN '../../' ELSE '../../../' END"
BODY = (
    f"concat('# ', {TITLE}, {NL}, {NL}, '## ', {case(K, 5, LEADS)}, {NL}, 'See [a](', {UP}, {file(LINKED)}, CASE WHEN {K} % 4 = 0 THEN '#part' ELSE '' END, "
    f"') and `src/f', CAST({K} AS STRING), '.py`. Second [web](https://example.org/x).', {NL}, "
    f"CASE WHEN {K} % 6 = 0 THEN concat('```sh', {NL}, '## Fix', {NL}, '[x](gone.md)', {NL}, '```', {NL}) ELSE '' END, "
    f"CASE WHEN {K} % 9 = 0 THEN concat('Broken [b](nothere', CAST({K} AS STRING), '.md)', {NL}) ELSE '' END, "
    f"CASE WHEN {K} % 2 = 0 THEN concat('## Fix', {NL}, 'Run the tool ', CAST({K} AS STRING), {NL}) ELSE '' END, CASE WHEN {K} % 8 = 0 THEN concat('# Another', {NL}) ELSE '' END)"
)
STATUS = f"CASE WHEN {K} % 11 = 5 THEN 'stale' WHEN {K} % 13 = 6 THEN 'superseded' WHEN {K} % 17 = 8 THEN 'archived' ELSE 'active' END"
RECORD = [
    f"{K} AS n", f"{ident(K)} AS id", f"{file(K)} AS path", f"{case(K, 3, ['general', 'projects', 'systems'])} AS scope",
    f"CASE WHEN {K} % 3 = 0 THEN NULL ELSE concat('o', CAST({K} % 5 AS STRING)) END AS owner", f"concat('t', CAST({K} % 7 AS STRING)) AS topic", f"{case(K, 5, TYPES)} AS type",
    f"{STATUS} AS status", f"CASE WHEN {STATUS} = 'superseded' THEN {ident(f'(({K} * 3 + 1) % {FIRST})')} END AS superseded_by", f"{TITLE} AS title",
    f"CASE WHEN {K} % 10 = 0 THEN '' ELSE concat(lower(p_brand), ',s', CAST(p_size AS STRING)) END AS tag_text",
    f"{case(K, 4, ['2026-06-01', '2026-02-01', '2025-03-01', '2026-06-20'])} AS verified", f"CASE WHEN {K} % 20 = 3 THEN '2026-06-01' WHEN {K} % 21 = 4 THEN '2026-07-01' END AS expires",
    f"{BODY} AS body",
]
#: Events as records of use and of sessions: which record, session and kind they stand for.
E_ID, E_SESSION = ident(f"((event_id * 7 + user_id) % {FIRST})"), "concat('s', CAST(user_id % 40 AS STRING))"
USE = [
    "event_id AS seq", f"{E_ID} AS id", f"{E_SESSION} AS session", "event_id * 600 AS secs", "CAST(CAST(ts AS DATE) AS STRING) AS time",
    "CASE event_type WHEN 'purchase' THEN 'worked' WHEN 'view' THEN 'injected' WHEN 'click' THEN 'inferred' WHEN 'signup' THEN 'restored' ELSE CASE event_id % 2 WHEN 0 THEN 'irrelevant' ELSE 'failed' END END AS event",
    f"{case('event_id', 5, ['tool-failed, m', 'recall, m', 'explore, m', 'odd', 'recall'])} AS reason",
]
SESSION = [
    "event_id AS seq", f"{E_SESSION} AS session", "event_id * 600 AS time", "concat('p', CAST(event_id % 3 AS STRING)) AS program", f"{E_ID} AS id", f"concat('g', CAST((event_id * 11 + user_id) % 300 AS STRING)) AS sig",
    "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'fixed' WHEN 'view' THEN 'injected' WHEN 'click' THEN CASE WHEN event_id % 97 = 0 THEN 'extracted' ELSE 'inferred' END "
    "ELSE CASE event_id % 7 WHEN 0 THEN 'remember' WHEN 1 THEN 'correction' WHEN 2 THEN 'offered' WHEN 3 THEN 'asked' ELSE 'nudged' END END AS kind",
]


def sql_view(name: str, columns: list[str], source: str) -> str:
    return f"{name} AS (SELECT {', '.join(columns)} FROM {source})"


LIB, USED, LOGGED = sql_view("r", RECORD, "part"), sql_view("u", USE, "events"), sql_view("s", SESSION, "events")
USE_COUNTS = COUNTS.format("u")
CURRENT = "status IN ('active', 'stale')"


def records(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(*RECORD).withColumn("tags", F.when(F.col("tag_text") == "", F.array().cast("array<string>")).otherwise(F.split("tag_text", ",")))


def used(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(*USE)


def logged(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(*SESSION)


def counted(spark, sf_dir):
    return usage.counts(used(spark, sf_dir))


# --- bodies and links ----------------------------------------------------------------------------------------------


@query(
    "body_structures",
    f"""WITH {LIB} SELECT id, title, 1 + CAST(n % 8 = 0 AS INTEGER) AS titles, 1 + CAST(n % 2 = 0 AS INTEGER) AS sections, CAST(n % 6 = 0 AS INTEGER) AS fences, 2 + CAST(n % 9 = 0 AS INTEGER) AS links,
    concat('src/f', CAST(n AS STRING), '.py') AS anchor, CASE WHEN n % 2 = 0 THEN concat('Run the tool ', CAST(n AS STRING), CASE WHEN n % 8 = 0 THEN concat({NL}, '# Another') ELSE '' END) END AS fix,
    concat({case('n', 5, LEADS)}, CASE WHEN n % 6 = 0 THEN ' Fix' ELSE '' END, CASE WHEN n % 2 = 0 THEN ' Fix' ELSE '' END) AS headings,
    concat('See [a](', {UP.replace(K, 'n')}, {file(LINKED.replace(K, 'n'))}, CASE WHEN n % 4 = 0 THEN '#part' ELSE '' END, ') and `src/f', CAST(n AS STRING), '.py`.') AS summary FROM r""",
)
def body_structures(spark, sf_dir):
    b, s = F.col("body"), F.col("s")
    rows = records(spark, sf_dir).withColumn("s", markdown.structure(b))
    return rows.select(
        "id", markdown.title(s, F.col("path")).alias("title"), F.size(s["titles"]).alias("titles"), F.size(s["sections"]).alias("sections"), F.size(s["fences"]).alias("fences"), F.size(s["links"]).alias("links"),
        F.get(s["anchors"], F.lit(0))["name"].alias("anchor"), markdown.section(b, s, "Fix").alias("fix"), markdown.headings(b).alias("headings"), markdown.summary(b, s, F.col("type")).alias("summary"),
    )


LINKS = f"k AS (SELECT id AS a, {ident(f'(n * 5 + 1) % {FIRST}')} AS b FROM r WHERE (n * 5 + 1) % {FIRST} <> n)"


@query("record_links", f"WITH {LIB}, {LINKS} SELECT * FROM k")
def record_links(spark, sf_dir):
    return graph.links(records(spark, sf_dir))


@query(
    "broken_links",
    f"WITH {LIB} SELECT path, CAST(5 + CASE WHEN n % 6 = 0 THEN 4 ELSE 0 END AS INTEGER) AS line, concat('nothere', CAST(n AS STRING), '.md') AS target FROM r WHERE n % 9 = 0",
)
def broken_links(spark, sf_dir):
    r = records(spark, sf_dir)
    return graph.broken_links(r, r.select("path"))


ASSETS = f"f AS (SELECT concat({home('n')}, '/l', CAST(n AS STRING), '.assets/pic.', CASE n % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'PNG' ELSE 'gif' END) AS path, n * 5000 AS size FROM r)"


def _assets(spark, sf_dir):
    return records(spark, sf_dir).selectExpr(f"concat({home('n')}, '/l', CAST(n AS STRING), '.assets/pic.', CASE n % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'PNG' ELSE 'gif' END) AS path", "n * 5000 AS size")


@query("unlinked_assets", f"WITH {LIB}, {ASSETS} SELECT path FROM f")
def unlinked_assets(spark, sf_dir):
    r = records(spark, sf_dir)
    return graph.unlinked(r, r.select("path").union(_assets(spark, sf_dir).select("path")))


@query(
    "asset_findings",
    f"WITH {LIB}, {ASSETS} SELECT path, 'assets/type' AS rule FROM f WHERE ends_with(path, '.gif') UNION ALL SELECT path, 'assets/size' FROM f WHERE size > 1048576",
)
def asset_findings(spark, sf_dir):
    return lint.assets(_assets(spark, sf_dir)).select("path", "rule")


@query(
    "superseded_chains",
    f"""WITH RECURSIVE {LIB}, step AS (SELECT id AS a, superseded_by AS b FROM r WHERE status = 'superseded'), f(id, now, hop) AS (SELECT id, id, 0 FROM r UNION ALL SELECT f.id, step.b, hop + 1 FROM f JOIN step ON step.a = f.now WHERE hop < 10)
    SELECT id, now FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hop DESC) AS k FROM f) WHERE k = 1 AND now IN (SELECT id FROM r WHERE {CURRENT})""",
)
def superseded_chains(spark, sf_dir):
    r = records(spark, sf_dir)
    return graph.follow(r, r.select("id"))


PAIRS = "p AS (SELECT x.id AS a, y.id AS b, CAST(x.n * 7 % 100 AS DOUBLE) / 100 AS similarity FROM r x JOIN r y ON y.n = x.n + 1 WHERE x.n * 7 % 100 >= 20)"


def _pairs(r):
    # records are made of a few bytes, so the planner takes them for small and would broadcast all of them
    y = r.select((F.col("n") - 1).alias("n"), F.col("id").alias("b"))
    return r.select("n", F.col("id").alias("a")).join(y.hint("merge"), "n").select("a", "b", ((F.col("n") * 7 % 100).cast("double") / 100).alias("similarity")).where("similarity >= 0.2")


def _edges(r):
    return graph.edges(graph.links(r), graph.replaced(r), _pairs(r))


@query(
    "graph_counts",
    f"""WITH {LIB}, {LINKS}, {PAIRS}, t AS (SELECT a FROM k UNION SELECT b FROM k UNION SELECT id FROM r WHERE superseded_by IS NOT NULL UNION SELECT superseded_by FROM r UNION SELECT a FROM p UNION SELECT b FROM p)
    SELECT (SELECT count(*) FROM r) AS records, (SELECT count(*) FROM k) AS links, (SELECT count(*) FROM r WHERE superseded_by IS NOT NULL) AS supersedes, (SELECT count(*) FROM p) AS similar,
    (SELECT count(*) FROM p WHERE similarity >= 0.4) AS likely_duplicates, (SELECT count(DISTINCT topic) FROM r) AS clusters, (SELECT count(*) FROM r WHERE id NOT IN (SELECT a FROM t WHERE a IS NOT NULL)) AS orphans""",
)
def graph_counts(spark, sf_dir):
    r = records(spark, sf_dir)
    e = _edges(r)
    return graph.counts(r, e, r.select("id", F.col("topic").alias("cluster")), similarity.orphans(r.select("id"), e.select("a", "b")))


@query(
    "graph_export",
    f"""WITH {LIB}, {LINKS}, {PAIRS} SELECT 1 AS part, id AS a, '' AS b, concat('  "', id, '" [label="', title, '"];') AS line FROM r
    UNION ALL SELECT 2, a, b, concat('  "', a, '" -> "', b, '";') FROM k
    UNION ALL SELECT 3, id, superseded_by, concat('  "', id, '" -> "', superseded_by, '" [style=dashed, label="superseded by"];') FROM r WHERE superseded_by IS NOT NULL
    UNION ALL SELECT 4, a, b, concat('  "', a, '" -> "', b, '" [dir=none, style=dotted, label="', printf('%.2f', similarity), '"];') FROM p""",
)
def graph_export(spark, sf_dir):
    r = records(spark, sf_dir)
    return graph.exported(r, _edges(r))


@query(
    "shared_keys",
    f"""WITH {LIB}, w AS (SELECT id, status, unnest(list_concat(CASE WHEN tag_text = '' THEN [] ELSE list_transform(string_split(tag_text, ','), lambda t: 'tag:' || t) END, CASE WHEN owner IS NULL THEN [] ELSE ['when:' || owner] END)) AS key FROM r)
    SELECT x.id AS a, y.id AS b, string_agg(DISTINCT x.key, ' ' ORDER BY x.key) AS shared FROM w x JOIN w y ON x.key = y.key AND x.id <> y.id WHERE y.{CURRENT} GROUP BY x.id, y.id""",
)
def shared_keys(spark, sf_dir):
    when = F.when(F.col("owner").isNotNull(), F.create_map("owner", F.array(F.lit("x")))).otherwise(F.create_map().cast("map<string,array<string>>"))
    return graph.shared_keys(records(spark, sf_dir).withColumn("when", when), text=" ")


@query("published_referrers", f"WITH {LIB}, {LINKS} SELECT a, b FROM k WHERE a IN (SELECT id FROM r WHERE status = 'active') AND b NOT IN (SELECT id FROM r WHERE status = 'active')")
def published_referrers(spark, sf_dir):
    r = records(spark, sf_dir)
    return graph.referrers(graph.links(r), r.where("status = 'active'"))


@query(
    "shown_duplicates",
    f"""WITH {LIB}, {PAIRS} SELECT p.* FROM p JOIN r x ON x.id = a JOIN r y ON y.id = b
    WHERE NOT (x.n % 3 = 0 AND CAST(x.n % 10 AS DOUBLE) / 10 >= 0.6)""",
)
def shown_duplicates(spark, sf_dir):
    r = records(spark, sf_dir)
    body = lambda c: r.select(F.col("id").alias(c), F.col("body").alias(f"t{c}"), F.col("n").alias(f"n{c}")).hint("merge")
    met = _pairs(r).join(body("a"), "a").join(body("b"), "b")
    keyed = met.select(markdown.pair_key(F.col("a"), F.col("b")).alias("key"), markdown.pair_hash(F.col("a"), F.col("ta"), F.col("b"), F.col("tb")).alias("hash"), "na")
    # every third pair was judged; others were judged when their texts differed
    judged = keyed.select("key", F.when(F.col("na") % 3 == 0, F.col("hash")).otherwise("old").alias("hash"), ((F.col("na") % 10).cast("double") / 10).alias("different"))
    return graph.shown_pairs(_pairs(r), judged, keyed.select("key", "hash"), 0.6)


@query(
    "similar_to_new",
    """WITH a AS (SELECT vec_id AS id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS term FROM embeddings), v AS (SELECT id, term, CAST(x AS DOUBLE) AS w FROM a),
    p AS (SELECT x.id AS i, y.id AS j, least(round(sum(x.w * y.w), 6), 1.0) AS similarity FROM v x JOIN v y ON x.term = y.term AND x.id < y.id GROUP BY x.id, y.id)
    SELECT i AS a, j AS b, similarity FROM p WHERE similarity >= 0.05 AND (i IN (SELECT vec_id FROM embeddings WHERE label = 1) OR j IN (SELECT vec_id FROM embeddings WHERE label = 1))""",
)
def similar_to_new(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    vecs = e.select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("term", "w")).withColumn("w", F.col("w").cast("double"))
    return similarity.pairs(vecs, 0.05, e.where("label = 1").select(F.col("vec_id").alias("id")))


#: Recipes with the Fix before the rest, and their lines outside fences that are headings; DuckDB parses the same bodies.
SWAPPED_SQL = r"""b AS (SELECT id, regexp_extract(body, '(?s)\n(## Fix\nRun.*)$', 1) || chr(10) || regexp_replace(body, '(?s)\n## Fix\nRun.*$', chr(10)) AS body FROM r WHERE type = 'recipe'),
x AS (SELECT id, unnest(string_split(body, chr(10))) AS line, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS k FROM b),
f AS (SELECT *, count(*) FILTER (WHERE starts_with(line, '```')) OVER (PARTITION BY id ORDER BY k) AS fences FROM x),
l AS (SELECT id, k AS line, trim(substr(line, 4)) AS heading FROM f WHERE starts_with(line, '## ') AND fences % 2 = 0)"""


@query(
    "heading_disorder",
    f"""WITH {LIB}, {SWAPPED_SQL}, h AS (SELECT id, heading, min(line) AS line FROM l WHERE heading IN ('Fix', 'When to use') GROUP BY id, heading HAVING count(*) = 1)
    SELECT a.id, a.heading, b.heading AS before FROM h a JOIN h b USING (id) WHERE a.heading = 'Fix' AND b.heading = 'When to use' AND a.line < b.line""",
)
def heading_disorder(spark, sf_dir):
    # bodies hold a Fix only in even records; it is put before the lead here, so every recipe that has one is out of order
    required = spark.createDataFrame([("recipe", "Fix", 2), ("recipe", "When to use", 1)], "type string, heading string, pos int")
    swapped = records(spark, sf_dir).withColumn("body", F.concat(F.regexp_extract("body", r"(?s)\n(## Fix\nRun.*)$", 1), F.lit("\n"), F.regexp_replace("body", r"(?s)\n## Fix\nRun.*$", "\n")))
    return digest.heading_order(swapped, required)


# --- reports -------------------------------------------------------------------------------------------------------

TIERS = f"""t AS (SELECT r.id, CASE WHEN NOT {CURRENT} THEN 'archive' WHEN coalesce(worked, 0) > 0 THEN 'proven' ELSE 'candidate' END AS tier, coalesce(worked + 0.5 * inferred, 0) AS helpful, coalesce(CAST(failed + irrelevant AS DOUBLE), 0) AS harmful FROM r LEFT JOIN c ON c.id = r.id)"""


@query("tier_report", f"WITH {LIB}, {USED}, {USE_COUNTS}, {TIERS} SELECT tier, count(*) AS n FROM t GROUP BY tier")
def tier_report(spark, sf_dir):
    return reports.tiers(records(spark, sf_dir), counted(spark, sf_dir))[0]


@query("proven_records", f"WITH {LIB}, {USED}, {USE_COUNTS}, {TIERS} SELECT CAST(row_number() OVER (ORDER BY helpful DESC, harmful, id) AS INTEGER) AS place, id, CAST(helpful AS DOUBLE) AS helpful, harmful FROM t WHERE tier = 'proven'")
def proven_records(spark, sf_dir):
    return reports.tiers(records(spark, sf_dir), counted(spark, sf_dir))[1]


@query(
    "topic_view",
    f"""WITH {LIB}, v AS (SELECT {home('n')} AS folder, CASE WHEN NOT {CURRENT} THEN 'retired' WHEN tag_text = '' THEN 'untagged' ELSE 'tagged' END AS part, CASE WHEN {CURRENT} AND tag_text <> '' THEN split_part(tag_text, ',', 1) END AS tag, id, title FROM r)
    SELECT *, CAST(row_number() OVER (PARTITION BY folder, part, tag ORDER BY lower(title), title, id) AS INTEGER) AS place FROM v""",
)
def topic_view(spark, sf_dir):
    return reports.topic_view(records(spark, sf_dir))


LABELS = """l AS (SELECT id, 'sensitivity' AS key, CASE WHEN n % 10 = 0 THEN 'secret' WHEN n % 7 = 3 THEN 'public' ELSE 'internal' END AS value FROM r UNION ALL SELECT id, 'team', 'a' FROM r WHERE scope = 'projects')"""


def _labels(r):
    notes = r.sparkSession.createDataFrame([("projects", {"team": "a"})], "folder string, labels map<string,string>")
    own = F.when(F.col("n") % 10 == 0, F.create_map(F.lit("sensitivity"), F.lit("secret"))).when(F.col("n") % 7 == 3, F.create_map(F.lit("sensitivity"), F.lit("public"))).otherwise(F.create_map().cast("map<string,string>"))
    return conditions.effective_labels(r.withColumn("labels", own), notes, {"sensitivity": "internal"})


@query(
    "folder_labels",
    f"""WITH {LIB}, {LABELS}, p AS (SELECT id, string_split(path, '/') AS ps FROM r WHERE {CURRENT}), f AS (SELECT id, unnest(list_transform(range(1, len(ps)), lambda i: array_to_string(ps[1:i], '/'))) AS folder FROM p)
    SELECT folder, key, value, count(*) AS n FROM f JOIN l USING (id) GROUP BY folder, key, value""",
)
def folder_labels(spark, sf_dir):
    r = records(spark, sf_dir)
    return reports.folder_labels(r, _labels(r))


@query("effective_labels", f"WITH {LIB}, {LABELS} SELECT * FROM l")
def effective_labels(spark, sf_dir):
    return _labels(records(spark, sf_dir))


@query(
    "site_groups",
    f"""WITH {LIB}, g AS (SELECT id, 'topics' AS kind, topic AS name FROM r UNION ALL SELECT id, scope, owner FROM r WHERE scope <> 'general' UNION ALL SELECT id, 'tags', unnest(string_split(tag_text, ',')) FROM r WHERE tag_text <> '')
    SELECT kind, name, string_agg(id, ' ' ORDER BY id) AS ids FROM g GROUP BY kind, name""",
)
def site_groups(spark, sf_dir):
    return reports.groups(records(spark, sf_dir)).withColumn("ids", F.array_join("ids", " "))


@query("claimed_aliases", f"WITH {LIB} SELECT type, string_agg(DISTINCT topic, ' ' ORDER BY topic) AS owners FROM r GROUP BY type HAVING count(DISTINCT topic) > 1")
def claimed_aliases(spark, sf_dir):
    return reports.claimed_twice(records(spark, sf_dir), "type", "topic").withColumn("owners", F.array_join("owners", " "))


@query(
    "session_signals",
    f"""WITH {USED}, {LOGGED}, e AS (SELECT session, max(CAST(kind = 'failed' AS INTEGER)) AS f, max(CAST(kind = 'fixed' AS INTEGER)) AS x, max(CAST(kind = 'correction' AS INTEGER)) AS c, max(CAST(kind = 'remember' AS INTEGER)) AS m, count_if(kind = 'extracted') AS e FROM s GROUP BY session),
    g AS (SELECT DISTINCT session, id FROM (SELECT session, id FROM s WHERE kind = 'inferred' UNION ALL SELECT session, id FROM u WHERE event = 'worked'))
    SELECT count(*) AS sessions, CAST(sum(f) AS BIGINT) AS with_failed, CAST(sum(x) AS BIGINT) AS with_fixed, CAST(sum(c) AS BIGINT) AS with_correction, CAST(sum(m) AS BIGINT) AS with_remember, CAST(sum(e) AS BIGINT) AS extracts,
    (SELECT count(*) FROM s WHERE kind = 'injected') AS injected, (SELECT count(*) FROM s JOIN g USING (session, id) WHERE kind = 'injected') AS injected_then_helped FROM e""",
)
def session_signals(spark, sf_dir):
    return reports.signals(logged(spark, sf_dir), used(spark, sf_dir))


@query(
    "injection_ways",
    f"""WITH {USED}, w AS (SELECT session, id, max(CAST(event IN ('worked', 'inferred') AS INTEGER)) AS h, max(CAST(event = 'irrelevant' AS INTEGER)) AS i FROM u GROUP BY session, id)
    SELECT CASE WHEN split_part(reason, ',', 1) IN ('tool-failed', 'recall', 'explore') THEN split_part(reason, ',', 1) ELSE 'other' END AS way, count(*) AS injected, CAST(sum(h) AS BIGINT) AS helped, CAST(sum(i) AS BIGINT) AS irrelevant FROM u JOIN w USING (session, id) WHERE event = 'injected' GROUP BY way""",
)
def injection_ways(spark, sf_dir):
    return reports.ways(used(spark, sf_dir), logged(spark, sf_dir))


@query(
    "skill_candidates",
    f"""WITH {LIB}, {USED}, w AS (SELECT id, count(DISTINCT session) AS sessions FROM u WHERE event = 'worked' GROUP BY id HAVING count(DISTINCT session) >= 3)
    SELECT CAST(row_number() OVER (ORDER BY sessions DESC, id) AS INTEGER) AS place, id, sessions FROM r JOIN w USING (id) WHERE type = 'recipe' AND status = 'active'""",
)
def skill_candidates(spark, sf_dir):
    return reports.skills(records(spark, sf_dir), used(spark, sf_dir))


@query(
    "new_records",
    f"""WITH {LIB}, {USED}, {USE_COUNTS} SELECT count(*) AS added, count_if(coalesce(injected, 0) > 0) AS injected FROM r LEFT JOIN c ON c.id = r.id WHERE verified >= '2026-05-31'""",
)
def new_records(spark, sf_dir):
    r = records(spark, sf_dir)
    added = r.select("path", F.col("verified").alias("day")).union(r.select("path", F.lit("2020-01-01")))
    return reports.new_records(r, added, counted(spark, sf_dir), TODAY)


PROMOTED = [
    "o_orderkey AS seq", "o_orderkey * 60 AS time", "concat('i', CAST(o_custkey AS STRING)) AS item", "o_custkey % 900 AS input_tokens", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 70 END AS output_tokens",
    f"{case('o_orderkey', 5, ['add', 'update', 'used', 'noop', 'odd'])} AS action", f"CASE WHEN o_orderkey % 4 = 0 THEN {ident('o_custkey')} WHEN o_orderkey % 4 = 1 THEN '' END AS lesson",
    "CASE WHEN o_orderkey % 3 = 0 THEN 'the quote is not in the item' END AS reason",
]
CALLS = sql_view("o", PROMOTED, "orders")


def _calls(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(*PROMOTED)


@query(
    "promotion_cost",
    f"""WITH {CALLS}, t AS (SELECT count_if(action IN ('add', 'update', 'used')) AS accepted, CAST(sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) AS BIGINT) AS tokens FROM o) SELECT *, CAST(tokens // accepted AS BIGINT) AS "each" FROM t""",
)
def promotion_cost(spark, sf_dir):
    return reports.promotion_cost(_calls(spark, sf_dir))


@query("promoted_records", f"WITH {CALLS} SELECT lesson, max(time) AS time FROM o WHERE lesson <> '' GROUP BY lesson")
def promoted_records(spark, sf_dir):
    return reports.promoted(_calls(spark, sf_dir))


@query(
    "ranking_health",
    """WITH l AS (SELECT CASE WHEN o_orderkey % 6 = 0 THEN 'bm25' ELSE 'm' END AS backend, o_orderkey % 4 AS f, CAST(o_totalprice AS BIGINT) AS ms FROM orders), m AS (SELECT list_sort(list(ms)) AS v FROM l WHERE backend <> 'bm25')
    SELECT count(*) AS total, count_if(f IN (1, 2)) AS fallbacks, count_if(f = 1) AS timeouts, (SELECT v[least(len(v) * 50 // 100, len(v) - 1) + 1] FROM m) AS p50, (SELECT v[least(len(v) * 90 // 100, len(v) - 1) + 1] FROM m) AS p90, count(*) >= 10 AND count_if(f IN (1, 2)) * 4 > count(*) AS warn FROM l""",
)
def ranking_health(spark, sf_dir):
    skipped = F.expr("CASE o_orderkey % 4 WHEN 1 THEN array('m: timeout after 500 ms') WHEN 2 THEN array('m: down') ELSE cast(array() AS array<string>) END")
    log = table(spark, sf_dir, "orders").select(F.expr("CASE WHEN o_orderkey % 6 = 0 THEN 'bm25' ELSE 'm' END AS backend"), skipped.alias("skipped"), F.expr("CAST(round(o_totalprice) AS BIGINT) AS ms"))
    return reports.ranking_health(log)


SQL["ranking_health"] = SQL["ranking_health"].replace("CAST(o_totalprice AS BIGINT)", "CAST(round(o_totalprice) AS BIGINT)")

VERDICTS = [
    "event_id AS seq", "concat('i', CAST(user_id AS STRING)) AS item", "CAST(event_id % 4 AS INTEGER) AS index", f"CASE WHEN event_id % 3 = 0 THEN NULL ELSE {case('event_id', 4, ['keep', 'drop', 'unsure', 'keep'])} END AS verdict",
    f"CASE WHEN event_id % 3 = 0 THEN {case('event_id', 5, ['add:x', 'noop', 'update:y', 'used:z', 'supersede:w'])} END AS outcome",
]
JUDGED = sql_view("j", VERDICTS, "events")
LAST = "v AS (SELECT item, index, arg_max(verdict, seq) FILTER (WHERE verdict IS NOT NULL) AS verdict, arg_max(outcome, seq) FILTER (WHERE outcome IS NOT NULL) AS outcome FROM j GROUP BY item, index HAVING count(verdict) > 0)"


def _verdicts(spark, sf_dir):
    return reports.last_verdicts(table(spark, sf_dir, "events").selectExpr(*VERDICTS))


@query("last_verdicts", f"WITH {JUDGED}, {LAST} SELECT * FROM v")
def last_verdicts(spark, sf_dir):
    return _verdicts(spark, sf_dir)


@query(
    "triage_health",
    f"""WITH {JUDGED}, {LAST}, h AS (SELECT count(*) AS total, count_if(verdict = 'unsure') AS unsure, count_if(verdict = 'keep') AS kept, count_if(verdict = 'keep' AND split_part(outcome, ':', 1) IN ('add', 'update', 'supersede')) AS became FROM v)
    SELECT *, CASE WHEN unsure * 10 > total * 3 THEN 'unsure' WHEN kept >= 20 AND became * 2 < kept THEN 'few became records' END AS warning FROM h""",
)
def triage_health(spark, sf_dir):
    return reports.triage_health(table(spark, sf_dir, "events").selectExpr(*VERDICTS))


@query("triage_counts", f"""WITH {JUDGED}, {LAST} SELECT item, count_if(verdict = 'keep') AS keep, count_if(verdict = 'known') AS known, count_if(verdict = 'unsure') AS unsure, count_if(verdict = 'drop') AS "drop" FROM v GROUP BY item""")
def triage_counts(spark, sf_dir):
    return reports.triage_counts(_verdicts(spark, sf_dir))


@query("finished_items", f"WITH {JUDGED}, {LAST} SELECT item FROM v GROUP BY item HAVING count_if(verdict <> 'drop' AND outcome IS NULL) = 0")
def finished_items(spark, sf_dir):
    return triage.finished(_verdicts(spark, sf_dir))


@query(
    "session_callers",
    f"""WITH {LOGGED}, e AS (SELECT session, bool_or(program = 'p0') AS m, bool_or(program = 'p1') AS c FROM s WHERE kind = 'nudged' GROUP BY session) SELECT count_if(m) AS by_mod, count_if(m AND c) AS both FROM e""",
)
def session_callers(spark, sf_dir):
    caller = F.when(F.col("program") == "p0", "mod").when(F.col("program") == "p1", "command").otherwise("other")
    return reports.callers(logged(spark, sf_dir).where("kind = 'nudged'").select("session", caller.alias("caller")))


ITEM = ["c_custkey AS item", "c_custkey * 37 % 1000 AS time", "CAST(c_nationkey % 3 + 1 AS INTEGER) AS priority", "CASE WHEN c_custkey % 2 = 0 THEN 'transcript' ELSE 'note' END AS kind", "c_custkey % 10 = 0 AS dropped", "concat('g', CAST(c_custkey % 300 AS STRING)) AS sig"]
ITEMS = sql_view("i", ITEM, "customer")


def _items(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(*ITEM).withColumn("signatures", F.when(F.col("item") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("sig")))


@query(
    "inbox_order",
    f"""WITH {ITEMS}, k AS (SELECT *, row_number() OVER (ORDER BY time DESC, item DESC) AS age FROM i) SELECT CAST(row_number() OVER (ORDER BY priority DESC, time, item) AS INTEGER) AS place, item, priority FROM k WHERE age <= 500""",
)
def inbox_order(spark, sf_dir):
    return reports.inbox_order(_items(spark, sf_dir)).select("place", "item", "priority")


@query("inbox_priorities", f"WITH {ITEMS} SELECT priority, count(*) AS n FROM i GROUP BY priority")
def inbox_priorities(spark, sf_dir):
    return reports.priorities(_items(spark, sf_dir))


TWICE = "w AS (SELECT sig FROM s GROUP BY sig HAVING count(DISTINCT session) >= 2)"


@query(
    "ready_items",
    f"""WITH {LOGGED}, {ITEMS}, {CALLS}, {TWICE}, d AS (SELECT DISTINCT sig FROM s WHERE kind = 'asked'), x AS (SELECT item FROM o WHERE reason IS NOT NULL GROUP BY item HAVING count(*) >= 2),
    f AS (SELECT i.*, item % 9 = 0 AND concat('i', CAST(item AS STRING)) NOT IN (SELECT item FROM x) AS worked, item % 4 <> 0 AND sig IN (SELECT sig FROM w) AND sig NOT IN (SELECT sig FROM d) AS again FROM i)
    SELECT CAST(row_number() OVER (ORDER BY NOT worked, time, item) AS INTEGER) AS place, item FROM f WHERE worked OR again""",
)
def ready_items(spark, sf_dir):
    i, s = _items(spark, sf_dir), logged(spark, sf_dir)
    calls = _calls(spark, sf_dir).select(F.substring("item", 2, 20).cast("long").alias("item"), "reason")
    return reports.ready(i, s.select("sig", "session"), s.where("kind = 'asked'").select("sig").distinct(), i.where("item % 9 = 0").select("item"), calls)


@query(
    "expired_transcripts",
    f"""WITH {LOGGED}, {ITEMS}, {TWICE}, d AS (SELECT DISTINCT sig FROM s WHERE kind = 'asked') SELECT item FROM i
    WHERE kind = 'transcript' AND (dropped OR 2000000 - time > 14 * 86400) AND item % 9 <> 0 AND NOT (item % 4 <> 0 AND sig IN (SELECT sig FROM w) AND sig NOT IN (SELECT sig FROM d))""",
)
def expired_transcripts(spark, sf_dir):
    i, s = _items(spark, sf_dir), logged(spark, sf_dir)
    return reports.dropped_transcripts(i, s.select("sig", "session"), s.where("kind = 'asked'").select("sig").distinct(), i.where("item % 9 = 0").select("item"), 2_000_000)


@query(
    "record_health",
    f"""WITH {LIB}, {LINKS}, t AS (SELECT a FROM k UNION SELECT b FROM k), q AS (SELECT id, concat('fix ', lower(p_type)) AS q FROM part JOIN r ON r.n = part.p_partkey WHERE type = 'pitfall' AND {CURRENT}),
    m AS (SELECT id FROM q WHERE NOT contains('fix economy case', q) AND NOT contains(q, 'fix economy case') AND NOT contains('my fix promo', q) AND NOT contains(q, 'my fix promo') AND NOT contains('fix sm', q) AND NOT contains(q, 'fix sm'))
    SELECT id, concat_ws(' ', CASE WHEN id NOT IN (SELECT a FROM t) THEN 'orphan' END, CASE WHEN id IN (SELECT id FROM m) THEN 'unmatched' END, CASE WHEN verified < '2025-06-30' THEN 'old' END) AS reasons
    FROM r WHERE {CURRENT} AND (id NOT IN (SELECT a FROM t) OR id IN (SELECT id FROM m) OR verified < '2025-06-30')""",
)
def record_health(spark, sf_dir):
    r = records(spark, sf_dir)
    types = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), F.array(F.concat(F.lit("Fix  "), F.initcap("p_type"))).alias("queries"))
    replays = spark.createDataFrame([("fix economy  case",), ("My fix PROMO",), ("fix sm",)], "query string")
    found = reports.health(r.join(types, "n"), similarity.orphans(r.where(F.col("status").isin("active", "stale")).select("id"), graph.links(r)), replays, TODAY)
    return found.withColumn("reasons", F.array_join("reasons", " "))


@query(
    "preference_digest",
    f"""WITH {LIB}, {USED}, {USE_COUNTS}, p AS (SELECT r.id, concat('Keep ', title) AS line, coalesce(worked, 0) AS worked FROM r LEFT JOIN c ON c.id = r.id WHERE type = 'preference' AND status = 'active'),
    t AS (SELECT *, row_number() OVER (ORDER BY worked DESC, id) AS place, sum(len(line) + 1) OVER (ORDER BY worked DESC, id ROWS UNBOUNDED PRECEDING) AS total FROM p) SELECT CAST(place AS INTEGER) AS place, id, line FROM t WHERE total <= 1201""",
)
def preference_digest(spark, sf_dir):
    rules = records(spark, sf_dir).where("type = 'preference' AND status = 'active'").select("id", F.concat(F.lit(" Keep\n  "), "title").alias("rule"))
    return reports.preference_digest(rules, counted(spark, sf_dir))


@query(
    "record_changes",
    f"""WITH c AS (SELECT o_orderkey AS "commit", concat({case('o_orderkey', 3, ['flag', 'archive', 'Merge'])}, '(', o_orderstatus, '): ', o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN ' [00000000af]' ELSE '' END) AS subject FROM orders)
    SELECT "commit", regexp_extract(subject, '^([a-z]+)', 1) AS kind, regexp_extract(subject, '\\(([^)]*)\\)', 1) AS folder, regexp_replace(regexp_extract(subject, '\\): (.*)$', 1), ' \\[00000000af\\]$', '') AS title, regexp_extract(subject, '\\[([0-9a-f]{{10}})\\]$', 1) AS id FROM c WHERE NOT starts_with(subject, 'Merge')""",
)
def record_changes(spark, sf_dir):
    subject = f"concat({case('o_orderkey', 3, ['flag', 'archive', 'Merge'])}, '(', o_orderstatus, '): ', o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN ' [00000000af]' ELSE '' END) AS subject"
    return reports.changes(table(spark, sf_dir, "orders").selectExpr("o_orderkey AS commit", "o_orderdate AS date", subject)).drop("date")


@query("retired_records", f"WITH {LIB} SELECT id, concat(scope, '/', owner) AS folder FROM r WHERE owner = 'o3'")
def retired_records(spark, sf_dir):
    return reports.retired(records(spark, sf_dir), spark.createDataFrame([("projects/o3",), ("systems/o3",)], "folder string"))


@query(
    "reviewed_draft",
    f"""WITH {USED}, x AS (SELECT session, id, seq FROM u WHERE event = 'injected'), b AS (SELECT session, id, seq, event FROM u WHERE event IN ('worked', 'irrelevant')),
    m AS (SELECT x.session, x.id, x.seq, b.event FROM x ASOF JOIN b ON x.session = b.session AND x.id = b.id AND x.seq < b.seq)
    SELECT 'replay-' || CAST(row_number() OVER (ORDER BY seq) AS STRING) AS key, concat('make of ', id) AS text, 'make' AS command, concat('of ', id) AS error, CASE WHEN event = 'worked' THEN id ELSE '' END AS expect, CASE WHEN event = 'worked' THEN concat('worked in session ', session) END AS worked, concat('replay ', session) AS source FROM m""",
)
def reviewed_draft(spark, sf_dir):
    u = used(spark, sf_dir)
    replays = u.where("event = 'injected'").select("session", F.col("id").alias("injected"), "seq", F.concat(F.lit("make of "), "id").alias("query"))
    return reports.draft(replays, u).withColumn("expect", F.array_join("expect", " "))


@query(
    "manifest_problems",
    f"""WITH {LIB}, e AS (SELECT n, concat('k', CAST(n // 2 * 2 + CASE WHEN n % 20 = 1 THEN 0 ELSE n % 2 END AS STRING)) AS key, n % 7 = 0 AS blank, CASE n % 2 WHEN 0 THEN 'failure' ELSE 'prompt' END AS path, n % 5 = 0 AS error, id, status FROM r),
    d AS (SELECT key FROM e GROUP BY key HAVING count(*) > 1)
    SELECT key, 'duplicate key' AS problem FROM e WHERE key IN (SELECT key FROM d) UNION ALL SELECT key, 'needs text, source and rationale' FROM e WHERE blank
    UNION ALL SELECT key, 'prompt cannot have error' FROM e WHERE path = 'prompt' AND error UNION ALL SELECT key, 'error and command must occur together' FROM e WHERE path = 'failure' AND error
    UNION ALL SELECT key, 'names unknown or inactive record ' || id FROM e WHERE status <> 'active'""",
)
def manifest_problems(spark, sf_dir):
    r = records(spark, sf_dir)
    none = F.lit(None).cast("string")
    key = F.concat(F.lit("k"), (F.floor(F.col("n") / 2) * 2 + F.when(F.col("n") % 20 == 1, 0).otherwise(F.col("n") % 2)).cast("string"))
    events = r.select(
        key.alias("key"), F.when(F.col("n") % 7 == 0, "  ").otherwise("t").alias("text"), F.when(F.col("n") % 2 == 0, "failure").otherwise("prompt").alias("path"), F.when(F.col("n") % 5 == 0, "e").alias("error"),
        none.alias("command"), F.array("id").alias("expect"), F.array().cast("array<string>").alias("near_miss"), F.lit("s").alias("source"), F.lit("r").alias("rationale"), F.lit("w").alias("worked"),
    )
    return reports.manifest_problems(events, r.where("status = 'active'"))


STAGE = "f AS (SELECT n AS event, CASE n % 2 WHEN 0 THEN 'failure' ELSE 'prompt' END AS path, n % 3 = 0 AS paraphrase, n % 4 <> 0 AS wants, n % 5 = 0 AS hit FROM r)"


@query(
    "first_stage_misses",
    f"""WITH {LIB}, {STAGE}, g AS (SELECT path AS grp, wants, hit FROM f UNION ALL SELECT 'paraphrase', wants, hit FROM f WHERE paraphrase)
    SELECT grp, count_if(wants) AS answerable, count_if(wants AND NOT hit) AS misses, round(count_if(wants AND NOT hit) / count_if(wants), 3) AS rate FROM g GROUP BY grp""",
)
def first_stage_misses(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("event", F.col("n"))
    events = r.select("event", F.when(F.col("n") % 2 == 0, "failure").otherwise("prompt").alias("path"), (F.col("n") % 3 == 0).alias("paraphrase"))
    expected = r.where("n % 4 != 0").select("event", "id")
    hits = r.select("event", F.when(F.col("n") % 5 == 0, F.col("id")).otherwise("other").alias("id"))
    return reports.first_stage(events, expected, hits)


REPLAYED = "y AS (SELECT seq AS event, seq, session, concat(program, ' broke') AS query, id FROM s WHERE kind = 'failed')"


def _replayed(spark, sf_dir):
    s = logged(spark, sf_dir).where("kind = 'failed'").select(F.col("seq").alias("event"), "seq", "session", F.concat("program", F.lit(" broke")).alias("query"), "id")
    written = s.where("event % 50 = 0").select("session", "id").distinct()
    return s, written, s.where("event % 4 = 1").select("event", "id")


@query(
    "replay_report",
    f"""WITH {LOGGED}, {REPLAYED}, w AS (SELECT DISTINCT session, id FROM y WHERE event % 50 = 0) SELECT count(*) AS failures, count(DISTINCT session) AS sessions, (SELECT count(DISTINCT session) FROM w) AS sessions_with_lesson,
    (SELECT count(DISTINCT session) FROM y JOIN w USING (session, id)) AS found, count_if(event % 4 = 1) AS would_inject, (SELECT count(*) FROM y WHERE event % 4 = 1 AND (session, id) IN (SELECT (session, id) FROM s WHERE kind = 'nudged')) AS irrelevant FROM y""",
)
def replay_report(spark, sf_dir):
    y, written, pushed = _replayed(spark, sf_dir)
    bad = logged(spark, sf_dir).where("kind = 'nudged'").select("session", "id")
    return reports.replay_report(y.drop("id"), y.select("event", F.lit(1).alias("rank"), "id"), written, pushed, bad)[0]


@query(
    "uncovered_failures",
    f"""WITH {LOGGED}, {REPLAYED}, w AS (SELECT DISTINCT session FROM y WHERE event % 50 = 0), z AS (SELECT split_part(query, ' ', 1) AS program, count(*) AS n, arg_min(query, seq) AS example FROM y WHERE event % 4 <> 1 AND session NOT IN (SELECT session FROM w) GROUP BY program)
    SELECT CAST(row_number() OVER (ORDER BY n DESC, program) AS INTEGER) AS place, * FROM z""",
)
def uncovered_failures(spark, sf_dir):
    y, written, pushed = _replayed(spark, sf_dir)
    none = y.select("session", "id").where("false")
    return reports.replay_report(y.drop("id"), y.select("event", F.lit(1).alias("rank"), "id"), written, pushed, none)[1]


# --- hooks ---------------------------------------------------------------------------------------------------------

SEEN = """b AS (SELECT x.*, EXISTS (SELECT 1 FROM s y WHERE y.kind = 'failed' AND y.sig = x.sig AND y.session <> x.session AND y.seq < x.seq AND y.time >= x.time - 90 * 86400) AS seen FROM s x WHERE x.kind = 'failed')"""


def _failures(spark, sf_dir):
    return hooks.seen_before(logged(spark, sf_dir).where("kind = 'failed'"))


@query("seen_before", f"WITH {LOGGED}, {SEEN} SELECT seq, seen FROM b")
def seen_before(spark, sf_dir):
    return _failures(spark, sf_dir).select("seq", "seen")


@query("seen_before_streamed", f"WITH {LOGGED}, {SEEN} SELECT seq, seen FROM b")
def seen_before_streamed(spark, sf_dir):
    rows = stream(spark, sf_dir, "events").selectExpr(*SESSION).where("kind = 'failed'")
    return gates.run_to_end(gates.seen_before(rows), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}").select("seq", "seen")


#: Logged events as what the gates read: fixes as successes, injections as prompts with a hit.
GATED = [
    "session", "seq + 1 AS seq", "CASE kind WHEN 'fixed' THEN 'ok' WHEN 'injected' THEN 'prompt' WHEN 'inferred' THEN 'stop' WHEN 'nudged' THEN CASE WHEN seq % 2 = 0 THEN 'end' ELSE kind END ELSE kind END AS kind", "CASE WHEN kind IN ('failed', 'fixed') THEN program END AS program",
    "CASE WHEN kind IN ('failed', 'injected') THEN id END AS id", "CASE seq % 3 WHEN 0 THEN 'proven' WHEN 1 THEN 'candidate' ELSE 'archive' END AS tier", "seq % 4 <> 0 AS eligible", "seq % 5 = 0 AS seen",
    "seq % 4 = 1 AS answered", "CASE WHEN kind = 'offered' THEN seq - 40 END AS upto", "timestamp_seconds(1700000000 + time) AS ts",
]


@query("tailed_events", "SELECT event_id, event_type FROM events")
def tailed_events(spark, sf_dir):
    folder = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "event_type")).alias("value")).write.text(folder)
    lines = tails.tail(spark, folder, suffix=".txt")
    return lines.select(F.from_json("line", "event_id long, event_type string").alias("e")).select("e.*")


# no SQL: the question at each stop looks at all that came before; a test compares with the batch operators
@query("session_gates_streamed")
def session_gates_streamed(spark, sf_dir):
    rows = stream(spark, sf_dir, "events").selectExpr(*SESSION).selectExpr(*GATED)
    return gates.run_to_end(gates.session_gates(rows), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")


@query(
    "repeats_and_nohits",
    f"""WITH {LOGGED}, {SEEN}, k AS (SELECT session, program, 'repeat' AS kind, seq FROM b WHERE seen UNION ALL SELECT session, program, 'nohit', seq FROM b WHERE seq % 4 <> 1) SELECT session, program, kind, min(seq) AS seq FROM k GROUP BY ALL""",
)
def repeats_and_nohits(spark, sf_dir):
    return hooks.once_records(_failures(spark, sf_dir).withColumn("answered", F.col("seq") % 4 == 1))


HITS = f"""h AS (SELECT s.seq AS event, k AS rank, {ident(f'((s.seq + k * 17) % {FIRST})')} AS id, s.session, CASE WHEN (s.seq + k) % 10 = 0 THEN NULL ELSE CAST((s.seq * k * 13) % 100 AS DOUBLE) / 100 END AS relevance, CASE WHEN (s.seq + k) % 9 = 0 THEN false END AS applies
  FROM s CROSS JOIN (VALUES (1), (2)) t(k) WHERE s.kind = 'failed'),
  top AS (SELECT h.*, r.type, r.status, coalesce(lead(relevance) OVER (PARTITION BY event ORDER BY rank), 0.0) AS following, CASE WHEN NOT {CURRENT} THEN 'archive' WHEN coalesce(worked, 0) > 0 THEN 'proven' ELSE 'candidate' END AS tier FROM h JOIN r USING (id) LEFT JOIN c ON c.id = r.id),
  mute AS (SELECT id FROM u GROUP BY id HAVING count_if(event = 'irrelevant') >= 3),
  told AS (SELECT DISTINCT session, id FROM s WHERE kind = 'injected'), gone AS (SELECT DISTINCT session FROM s WHERE kind = 'asked'),
  pick AS (SELECT top.* FROM top WHERE rank = 1 AND status = 'active' AND applies IS DISTINCT FROM false AND (session, id) NOT IN (SELECT (session, id) FROM told) AND id NOT IN (SELECT id FROM mute)
    AND (tier = 'proven' OR tier = 'candidate' AND session NOT IN (SELECT session FROM gone)))"""


def _hits(spark, sf_dir):
    s, r = logged(spark, sf_dir), records(spark, sf_dir)
    k = F.explode(F.array(F.lit(1), F.lit(2)))
    rows = s.where("kind = 'failed'").select(F.col("seq").alias("event"), "session", k.alias("rank"))
    rows = rows.withColumns(
        {
            "id": F.expr(ident(f"((event + rank * 17) % {FIRST})")), "applies": F.expr("CASE WHEN (event + rank) % 9 = 0 THEN false END"),
            "relevance": F.expr("CASE WHEN (event + rank) % 10 = 0 THEN NULL ELSE CAST((event * rank * 13) % 100 AS DOUBLE) / 100 END"),
        }
    )
    tier = r.join(counted(spark, sf_dir), "id", "left").select("id", "type", "status", "body", usage.tier(F.col("status").isin("active", "stale")).alias("tier"))
    u = used(spark, sf_dir)
    misses = u.groupBy("id").agg(F.count_if(F.col("event") == "irrelevant").alias("n"))
    asked = s.where("kind = 'failed'").select(F.col("seq").alias("event"), "session", F.lit("see the second web page\nerror: nothing fits").alias("text"))
    return rows.drop("session").join(tier, "id"), asked, s.where("kind = 'injected'"), misses, s.where("kind = 'asked'")


@query(
    "failure_pushes",
    f"""WITH {LIB}, {USED}, {USE_COUNTS}, {LOGGED}, {HITS} SELECT event, session, id, tier = 'candidate' AS explore FROM pick WHERE type = 'pitfall' AND relevance >= 0.8 AND round(relevance - following, 9) >= 0.1""",
)
def failure_pushes(spark, sf_dir):
    return hooks.pushed(*_hits(spark, sf_dir))


@query(
    "recall_pushes",
    f"""WITH {LIB}, {USED}, {USE_COUNTS}, {LOGGED}, {HITS} SELECT event, session, id, tier = 'candidate' AS explore FROM pick WHERE relevance >= 0.75 AND round(relevance - following, 9) >= 0.05""",
)
def recall_pushes(spark, sf_dir):
    return hooks.pushed(*_hits(spark, sf_dir), g=hooks.LOWER, recall=True)


@query("replay_queries", f"WITH {USED} SELECT session, id, arg_max(concat('make ', reason), seq) AS query FROM u WHERE event = 'injected' GROUP BY session, id")
def replay_queries(spark, sf_dir):
    replays = used(spark, sf_dir).where("event = 'injected'").select("session", F.col("id").alias("injected"), "seq", F.concat(F.lit("make "), "reason").alias("query"))
    return hooks.replay_query(replays)


STOPS = """w AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS k, count_if(kind = 'failed') OVER (PARTITION BY session, program) AS f FROM s),
  o AS (SELECT session, max(k) FILTER (WHERE kind = 'offered') AS upto FROM w GROUP BY session),
  p AS (SELECT session, CAST(coalesce(sum(CASE WHEN k > coalesce(upto, 0) THEN CASE kind WHEN 'remember' THEN 3 WHEN 'correction' THEN 2 WHEN 'fixed' THEN CASE WHEN f >= 3 THEN 2 ELSE 1 END ELSE 0 END ELSE 0 END), 0) AS BIGINT) AS score,
    bool_or(k > coalesce(upto, 0) AND kind IN ('remember', 'correction')) AS own, bool_or(kind = 'asked') AS asked, count_if(kind = 'nudged') AS nudged FROM w JOIN o USING (session) GROUP BY session)"""


@query("stop_decisions", f"WITH {LOGGED}, {STOPS} SELECT session, score, CASE WHEN NOT own OR score = 0 THEN NULL WHEN score >= 3 AND NOT asked THEN 'block' WHEN nudged < 2 THEN 'nudge' END AS decision FROM p")
def stop_decisions(spark, sf_dir):
    w = Window.partitionBy("session").orderBy("seq")
    placed = logged(spark, sf_dir).withColumn("seq", F.row_number().over(w)).withColumn("upto", F.when(F.col("kind") == "offered", F.col("seq")))
    return hooks.stop_decision(placed)


@query(
    "session_captures",
    f"""WITH {LOGGED}, l AS (SELECT session, max(seq) FILTER (WHERE kind = 'extracted') AS last FROM s GROUP BY session), n AS (SELECT s.*, count_if(kind = 'failed') OVER (PARTITION BY s.session, program) AS f FROM s),
    g AS (SELECT n.session, string_agg(DISTINCT concat(kind, ' ', program), ',' ORDER BY concat(kind, ' ', program)) FILTER (WHERE kind IN ('fixed', 'correction', 'remember')) AS signals,
      sum(CASE kind WHEN 'remember' THEN 3 WHEN 'correction' THEN 2 WHEN 'fixed' THEN CASE WHEN f >= 3 THEN 2 ELSE 1 END ELSE 0 END) AS score FROM n JOIN l USING (session) WHERE last IS NULL OR seq > last GROUP BY n.session),
    d AS (SELECT DISTINCT sig FROM s WHERE kind = 'asked'), p AS (SELECT session, count(*) AS every, string_agg(DISTINCT sig, ',' ORDER BY sig) FILTER (WHERE sig NOT IN (SELECT sig FROM d)) AS sigs FROM s WHERE kind = 'failed' GROUP BY session)
    SELECT session, signals, coalesce(sigs, '') AS signatures, CAST(greatest(1, least(3, score)) AS INTEGER) AS priority FROM g LEFT JOIN p USING (session) WHERE signals IS NOT NULL AND (every IS NULL OR sigs IS NOT NULL)""",
)
def session_captures(spark, sf_dir):
    s = logged(spark, sf_dir)
    found = hooks.captures(s, s.where("kind = 'failed'").select("session", "sig"), s.where("kind = 'asked'").select("sig"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("signals", "signatures")})


@query(
    "failure_signatures",
    """WITH e AS (SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'cmake' ELSE 'make' END AS program FROM events) SELECT event_id, substr(sha256(concat(program, chr(10), program, ' error: no rule for #')), 1, 24) AS sig FROM e""",
)
def failure_signatures(spark, sf_dir):
    command = F.expr("concat(CASE event_id % 2 WHEN 0 THEN 'CC=x /usr/bin/cmake -B b' ELSE 'make -j' END, CAST(event_id AS STRING))")
    error = F.expr("concat('Exit code 2', chr(10), 'error: no rule for x', CAST(event_id % 3 AS STRING), chr(10), 'see line 12')")
    return table(spark, sf_dir, "events").select("event_id", text.signature(command, error).alias("sig"))


SQL["failure_signatures"] = SQL["failure_signatures"].replace("for #", "for x#")


# --- sessions' texts -----------------------------------------------------------------------------------------------

STEP = [
    "user_id AS session", "event_id AS step", "CASE event_type WHEN 'view' THEN 'prompt' WHEN 'click' THEN 'text' WHEN 'signup' THEN 'time' ELSE 'command' END AS kind",
    "CASE event_type WHEN 'signup' THEN CAST(CAST(ts AS DATE) AS STRING) ELSE concat('words ', CAST(event_id % 4 AS STRING)) END AS text", "concat(CASE event_id % 2 WHEN 0 THEN 'make' ELSE 'git' END, ' go') AS command", "event_type = 'purchase' AS ok",
    "CASE WHEN event_type = 'error' THEN concat('Exit code 1', chr(10), 'ok so far', chr(10), 'error: bad') ELSE 'fine' END AS output", "'x' AS name",
]
STEPS = sql_view("t", STEP, "events")
OUT = """q AS (SELECT *, coalesce(lag(ok) OVER (PARTITION BY session, kind, command ORDER BY step), true) AS before FROM t),
  e AS (SELECT session, step, CASE kind WHEN 'prompt' THEN ['[user] ' || text] WHEN 'text' THEN ['[agent] ' || text] WHEN 'command' THEN CASE WHEN NOT ok THEN ['[command failed, exit 1] ' || command, '[tool output]', '  error: bad'] WHEN NOT before THEN ['[command worked] ' || command] ELSE [] END ELSE [] END AS ls FROM q)"""


def _steps(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(*STEP)


@query(
    "session_extracts",
    f"""WITH {STEPS}, {OUT}, f AS (SELECT session, unnest(ls) AS line, row_number() OVER (PARTITION BY session ORDER BY step, k) AS place, count(*) OVER (PARTITION BY session) AS total FROM (SELECT session, step, unnest(range(len(ls))) AS k, [ls[unnest(range(len(ls))) + 1]] AS ls FROM e)),
    c AS (SELECT *, CASE WHEN total > 60 THEN total - 59 ELSE 0 END AS cut FROM f)
    SELECT session, CAST(place - cut + CASE WHEN cut > 0 THEN 1 ELSE 0 END AS INTEGER) AS line_no, line FROM c WHERE place > cut UNION ALL SELECT DISTINCT session, 1, concat('[', CAST(cut AS STRING), ' earlier lines cut]') FROM c WHERE cut > 0""",
)
def session_extracts(spark, sf_dir):
    return digest.extracts(_steps(spark, sf_dir), 60)


@query(
    "digest_entries",
    f"""WITH {STEPS} SELECT session, step, CASE kind WHEN 'prompt' THEN '[user] ' || text WHEN 'text' THEN '[agent] ' || text WHEN 'time' THEN '[' || text || ']' ELSE CASE WHEN ok THEN '[tool] bash: ' || command ELSE concat('[command failed, exit 1] ', command, '|[tool output]|  error: bad') END END AS lines FROM t""",
)
def digest_entries(spark, sf_dir):
    return digest.entries(_steps(spark, sf_dir), digest=True).withColumn("lines", F.array_join("lines", "|"))


# no SQL: where a part ends depends on all entries before; tests compare with a loop
@query("digest_parts")
def digest_parts(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("source").alias("session"), F.col("doc_id").alias("step"), F.split("text", "\n", -1).alias("lines"))
    return digest.digest_parts(lines).select("session", "step", "part", F.char_length("text").alias("chars"))


@query(
    "changed_times",
    f"""WITH {STEPS}, l AS (SELECT *, lag(text) OVER (PARTITION BY session ORDER BY step) AS before FROM t WHERE kind = 'time') SELECT session, step FROM t WHERE kind <> 'time' UNION ALL SELECT session, step FROM l WHERE before IS NULL OR before <> text""",
)
def changed_times(spark, sf_dir):
    return digest.changed_times(_steps(spark, sf_dir)).select("session", "step")


# no SQL: which item stands for others depends on those kept before; tests compare with a loop
@query("representative_items")
def representative_items(spark, sf_dir):
    items = _items(spark, sf_dir)
    pair = F.when(F.size("signatures") > 0, F.array("sig", F.concat(F.lit("h"), (F.col("item") % 77).cast("string")))).otherwise(F.col("signatures"))
    return digest.representatives(items.select("item", F.col("item").alias("place"), pair.alias("signatures")))


@query("asked_candidates", f"WITH {JUDGED}, {LAST} SELECT CAST(row_number() OVER (ORDER BY item, index) - 1 AS INTEGER) AS entry, item, index FROM v WHERE verdict = 'unsure' QUALIFY entry < 20")
def asked_candidates(spark, sf_dir):
    c = _verdicts(spark, sf_dir).withColumn("place", F.col("item")).withColumn("text", F.lit("x"))
    return digest.ask_batch(c).select("entry", "item", "index")


# --- full search ---------------------------------------------------------------------------------------------------

ASKED = [
    "p_partkey AS query_id", "concat(p_name, ' ', p_type, ' tool') AS text", "CASE WHEN p_partkey % 3 = 1 THEN concat('o', CAST(p_partkey % 5 AS STRING)) END AS project", "CASE WHEN p_partkey % 4 = 1 THEN 'o2' END AS system", "p_partkey % 10 = 0 AS everywhere",
]


def _asked(spark, sf_dir):
    """A stated set of queries, one for each supplier's number, against all records."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey")).join(table(spark, sf_dir, "part"), "p_partkey").selectExpr(*ASKED)


def _shown(spark, sf_dir):
    r = records(spark, sf_dir).where(F.col("status").isin("active", "stale"))
    shown = r.select("id", "scope", "owner", "title", "expires", F.array_join("tags", " ").alias("tags"), F.concat_ws(" ", "type", "topic").alias("when"), F.lit(" ").alias("headings"), F.concat(F.lit("tool "), "title").alias("body"))
    return shown, r


def _sql_search() -> str:
    from tidewell.plans.queries import sql_tokens

    rank = Ranking()
    return f"""{LIB}, {USED}, {USE_COUNTS}, a AS (SELECT {', '.join(ASKED)} FROM part WHERE p_partkey IN (SELECT s_suppkey FROM supplier)),
    d AS (SELECT id, CASE WHEN scope = 'general' THEN 'general' ELSE concat(scope, '/', owner) END AS grp, title, expires, {sql_tokens('title')} AS t1, {sql_tokens("replace(tag_text, ',', ' ')")} AS t2, {sql_tokens("concat_ws(' ', type, topic)")} AS t3, {sql_tokens("concat('tool ', title)")} AS t5 FROM r WHERE {CURRENT}),
    ln AS (SELECT id, grp, len(t1) + len(t2) + len(t3) + len(t5) AS n FROM d),
    oc AS (SELECT id, grp, unnest(t1) AS term, 3.0 AS w FROM d UNION ALL SELECT id, grp, unnest(t2), 2.5 FROM d UNION ALL SELECT id, grp, unnest(t3), 1.5 FROM d UNION ALL SELECT id, grp, unnest(t5), 1.0 FROM d),
    tf AS (SELECT id, grp, term, sum(w) AS tf FROM oc GROUP BY ALL),
    pl AS (SELECT query_id, grp FROM a, (SELECT DISTINCT grp FROM d) WHERE everywhere OR grp = 'general' OR grp = concat('projects/', project) OR grp = concat('systems/', system)),
    st AS (SELECT query_id, count(*) AS docs, greatest(avg(n), 1.0) AS avg_len FROM pl JOIN ln USING (grp) GROUP BY query_id),
    qp AS (SELECT query_id, i AS p, {sql_tokens('ws[i]')} AS ts FROM (SELECT query_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT query_id, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') AS ws FROM a))),
    qt AS (SELECT query_id, p, ts[1] AS whole, unnest(ts) AS term, unnest(range(len(ts))) AS j FROM qp WHERE len(ts) > 0),
    df AS (SELECT query_id, term, count(*) AS df FROM tf JOIN pl USING (grp) GROUP BY ALL),
    qw AS (SELECT qt.query_id, qt.term, CASE WHEN j > 0 AND (qt.query_id, whole) IN (SELECT (query_id, term) FROM df) THEN 0.5 ELSE 1.0 END AS weight FROM qt JOIN df ON df.query_id = qt.query_id AND df.term = qt.term QUALIFY row_number() OVER (PARTITION BY qt.query_id, qt.term ORDER BY p, j) = 1),
    sc AS (SELECT qw.query_id, tf.id, tf.grp, sum(weight * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len))) AS s FROM qw JOIN df USING (query_id, term) JOIN tf USING (term) JOIN pl ON pl.query_id = qw.query_id AND pl.grp = tf.grp JOIN ln ON ln.id = tf.id JOIN st ON st.query_id = qw.query_id GROUP BY qw.query_id, tf.id, tf.grp),
    bo AS (SELECT sc.query_id, sc.id, d.title, round(s * CASE WHEN sc.grp = concat('projects/', project) THEN {rank.project_boost} WHEN sc.grp = concat('systems/', system) THEN {rank.system_boost} ELSE 1.0 END
      * CASE WHEN c.id IS NULL THEN 1.0 ELSE greatest(0.9, least(1.1, 1 + 0.05 * ln(1 + worked + 0.5 * inferred) - 0.1 * least(CAST(failed + irrelevant AS DOUBLE), 3.0) / 3)) END * CASE WHEN expires <= '{TODAY}' THEN {rank.expired_factor} ELSE 1.0 END, 6) AS score
      FROM sc JOIN a USING (query_id) JOIN d ON d.id = sc.id LEFT JOIN c ON c.id = sc.id),
    rk AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, id) AS place FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM bo WHERE score > 0) WHERE score >= round(best * 0.3, 6)),
    fact AS (SELECT query_id, 'lang' AS key, {case('query_id', 2, ['x', 'y'])} AS fact FROM a),
    wn AS (SELECT id, 'lang' AS key, {case('n', 3, ['x', 'y', 'z'])} AS value FROM r WHERE n % 2 = 0 UNION ALL SELECT id, 'host', 'h' FROM r WHERE n % 5 = 0),
    vd AS (SELECT rk.query_id, rk.id, bool_or(coalesce(fact <> value, false)) AS no, bool_or(fact IS NULL) AS unknown, string_agg(wn.key, ',') FILTER (WHERE fact <> value) AS no_keys FROM rk JOIN wn ON wn.id = rk.id LEFT JOIN fact ON fact.query_id = rk.query_id AND fact.key = wn.key GROUP BY rk.query_id, rk.id),
    ap AS (SELECT rk.*, a.everywhere, CASE WHEN no THEN false WHEN unknown THEN NULL ELSE true END AS applies, no_keys, CASE WHEN r.status = 'active' AND r.expires <= '{TODAY}' THEN 'stale' ELSE r.status END AS status, coalesce(r.expires <= '{TODAY}', false) AS expired, coalesce(c.worked, 0) AS worked
      FROM rk JOIN r ON r.id = rk.id JOIN a ON a.query_id = rk.query_id LEFT JOIN c ON c.id = rk.id LEFT JOIN vd ON vd.query_id = rk.query_id AND vd.id = rk.id),
    sh AS (SELECT *, applies IS NOT DISTINCT FROM false AND NOT everywhere AS hidden, sum(CASE WHEN applies IS NOT DISTINCT FROM false AND NOT everywhere THEN 0 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS shown FROM ap)"""


def _results(spark, sf_dir):
    shown, r = _shown(spark, sf_dir)
    q = _asked(spark, sf_dir)
    wanted = r.where("n % 2 = 0").selectExpr("id", "'lang' AS key", f"{case('n', 3, ['x', 'y', 'z'])} AS value").union(r.where("n % 5 = 0").selectExpr("id", "'host'", "'h'"))
    facts = q.selectExpr("query_id", "'lang' AS key", f"{case('query_id', 2, ['x', 'y'])} AS fact")
    return full_search.searched(shown, q, r, wanted, facts, counted(spark, sf_dir), TODAY, 10)


@query("full_search", f"WITH {_sql_search()} SELECT query_id, CAST(shown AS INTEGER) AS rank, id, score, status, applies, CASE WHEN worked > 0 THEN 'proven' ELSE 'candidate' END AS tier, expired FROM sh WHERE NOT hidden AND shown <= 10")
def full_search_hits(spark, sf_dir):
    return _results(spark, sf_dir)[0]


@query("full_search_hidden", f"WITH {_sql_search()} SELECT query_id, key, count(*) AS n FROM (SELECT query_id, unnest(string_split(no_keys, ',')) AS key FROM sh WHERE hidden AND shown < 10) GROUP BY query_id, key")
def full_search_hidden(spark, sf_dir):
    return _results(spark, sf_dir)[1]


@query(
    "literal_in_scope",
    f"""WITH {LIB}, a AS (SELECT {', '.join(ASKED)} FROM part WHERE p_partkey IN (SELECT s_suppkey FROM supplier)), m AS (SELECT id, title, CASE WHEN scope = 'general' THEN 'general' ELSE concat(scope, '/', owner) END AS grp FROM r WHERE n % 9 = 0),
    x AS (SELECT query_id, id, title, CASE WHEN grp = concat('projects/', project) THEN 0 WHEN grp = concat('systems/', system) THEN 1 ELSE 2 END AS o FROM a, m WHERE everywhere OR grp = 'general' OR grp = concat('projects/', project) OR grp = concat('systems/', system))
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o, title, id) AS INTEGER) AS place, id FROM x""",
)
def literal_in_scope(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("text", F.col("body"))
    return full_search.literal(r, _asked(spark, sf_dir), "Broken [b]").select("query_id", "place", "id")


@query(
    "self_queries",
    f"""WITH {LIB} SELECT id AS query_id, concat('See [a](', {UP.replace(K, 'n')}, {file(LINKED.replace(K, 'n'))}, CASE WHEN n % 4 = 0 THEN '#part' ELSE '' END, ') and `src/f', CAST(n AS STRING), '.py`. Second [web](https://example.org/x).') AS text, id AS expect,
    CASE WHEN scope = 'projects' THEN owner END AS project, CASE WHEN scope = 'systems' THEN owner END AS system FROM r WHERE {CURRENT} AND type IN ('pitfall', 'fact')""",
)
def self_queries(spark, sf_dir):
    return full_search.self_queries(records(spark, sf_dir)).withColumn("expect", F.array_join("expect", " "))


# --- writes --------------------------------------------------------------------------------------------------------


@query(
    "added_records",
    f"""WITH {LIB}, t AS (SELECT n AS id, {home('n')} AS folder, lower(replace(split_part(title, ' of ', 1), ' ', '-')) AS stem FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY id) AS k FROM t)
    SELECT id, concat(folder, '/', stem, CASE WHEN k = 1 THEN '' ELSE concat('-', CAST(k AS STRING)) END, '.md') AS path FROM k""",
)
def added_records(spark, sf_dir):
    r = records(spark, sf_dir)
    when = F.when(F.col("scope") == "projects", F.create_map(F.lit("project"), F.array("owner"))).when(F.col("scope") == "systems", F.create_map(F.lit("system"), F.array("owner"))).otherwise(F.create_map().cast("map<string,array<string>>"))
    new = r.select(F.col("n").alias("id"), "topic", when.alias("when"), F.substring_index("title", " of ", 1).alias("title"))
    return writes.added(new, r.where("false"), TODAY).select("id", "path")


@query(
    "edited_records",
    f"""WITH {LIB} SELECT id, CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN 'conflict' WHEN 2 THEN 'unchanged' ELSE 'edited' END AS result, CASE WHEN n % 4 = 3 AND status = 'stale' AND n % 2 = 1 THEN 'active' ELSE status END AS status, CASE WHEN n % 4 = 3 THEN concat(body, 'more') ELSE body END AS text FROM r""",
)
def edited_records(spark, sf_dir):
    r = records(spark, sf_dir).select("n", "id", F.col("body").alias("text"), "status", F.lit("why").alias("stale_reason"), F.lit("seen").alias("evidence"))
    base = F.when(F.col("n") % 4 == 1, "000000000000").otherwise(text.content_hash(F.col("text")))
    changes = r.where("n % 4 != 0").select("id", base.alias("base"), F.when(F.col("n") % 4 == 2, F.col("text")).otherwise(F.concat("text", F.lit("more"))).alias("text"), F.lit("other").alias("evidence"))
    return writes.edited(r, changes).select("id", "result", "status", "text")


@query(
    "moved_records",
    f"""WITH {LIB}, m AS (SELECT *, topic = 't3' AS goes, (n * 5 + 1) % {FIRST} AS t FROM r), x AS (SELECT *, CASE WHEN t % 7 = 3 THEN concat('archive/moved/l', CAST(t AS STRING), '.md') ELSE {file('t')} END AS leads FROM m)
    SELECT id, CASE WHEN goes THEN concat('archive/moved/l', CAST(n AS STRING), '.md') ELSE path END AS path, t % 7 = 3 AS leads_there FROM x""",
)
def moved_records(spark, sf_dir):
    r = records(spark, sf_dir)
    moves = r.where("topic = 't3'").select("path", F.concat(F.lit("archive/moved/l"), F.col("n").cast("string"), F.lit(".md")).alias("to"))
    done = writes.moved(r, moves)
    # after a move every link leads to the new place of the record that it led to before
    led = graph.found_links(done.select("id", "path", "body")).where("checked AND line = 4").select("id", F.col("to").startswith("archive/moved/").alias("leads_there"))
    return done.select("id", "path").join(led, "id")


ORDER = [("sensitivity", "public", 0), ("sensitivity", "internal", 1), ("sensitivity", "secret", 2)]


@query(
    "loosened_labels",
    f"""WITH {LIB}, {LABELS}, b AS (SELECT * FROM l WHERE key = 'sensitivity'), x AS (SELECT b.id, value AS was, CASE WHEN n % 3 = 0 THEN 'public' ELSE value END AS now FROM b JOIN r ON r.id = b.id) SELECT id, 'sensitivity' AS key, was, now FROM x WHERE now <> was""",
)
def loosened_labels(spark, sf_dir):
    r = records(spark, sf_dir)
    before = _labels(r)
    after = before.join(r.select("id", "n"), "id").select("id", "key", F.when((F.col("key") == "sensitivity") & (F.col("n") % 3 == 0), "public").otherwise(F.col("value")).alias("value"))
    return writes.loosened(before, after, spark.createDataFrame(ORDER, "key string, value string, pos int"))


@query("label_problems", f"WITH {LIB}, {LABELS} SELECT id, key, value, 'unknown key' AS problem FROM l WHERE key = 'team'")
def label_problems(spark, sf_dir):
    return writes.label_problems(_labels(records(spark, sf_dir)), spark.createDataFrame(ORDER, "key string, value string, pos int"))


@query(
    "imported_notes",
    """WITH n AS (SELECT doc_id AS source, text, substr(sha256(text), 1, 24) AS hash FROM documents) SELECT min(source) AS source, hash FROM n GROUP BY hash HAVING hash NOT IN (SELECT substr(sha256(text), 1, 24) FROM documents WHERE lang = 'de')""",
)
def imported_notes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    log = d.where("lang = 'de'").select(F.substring(F.sha2("text", 256), 1, 24).alias("hash")).distinct()
    return writes.imported(d.select(F.col("doc_id").alias("source"), "text"), log).select("source", "hash")


GROUPED = "CASE WHEN n % 4 = 0 THEN 'team' WHEN n % 4 = 1 THEN '' END"


@query(
    "publication",
    f"""WITH {LIB} SELECT id, CASE WHEN n % 3 = 0 AND n % 4 > 1 THEN 'public' ELSE 'protected' END AS kind, {GROUPED} AS grp FROM r WHERE {CURRENT} AND (n % 3 = 0 AND n % 4 > 1 OR (n % 3 = 0 OR n % 3 = 1) AND ({GROUPED} = 'team' OR coalesce({GROUPED}, '') = ''))""",
)
def publication(spark, sf_dir):
    return _kinds(records(spark, sf_dir))


def _kinds(r):
    return writes.publication(r, F.col("n") % 3 == 0, F.col("n") % 3 == 1, F.expr(GROUPED), ["", "team"])


@query(
    "pending_publication",
    f"""WITH {LIB}, x AS (SELECT id, n, {GROUPED} AS grp FROM r) SELECT id, grp FROM x WHERE n % 5 <> 0 OR CASE WHEN n % 10 = 0 THEN 'old' ELSE grp END IS DISTINCT FROM grp""",
)
def pending_publication(spark, sf_dir):
    r = records(spark, sf_dir).select("id", "n", F.expr(GROUPED).alias("grp"))
    done = r.where("n % 5 = 0").select("id", F.when(F.col("n") % 10 == 0, "old").otherwise(F.col("grp")).alias("grp"))
    return writes.pending(r, done)


@query("merged_publication", f"WITH {LIB}, x AS (SELECT id, n, {GROUPED} AS grp FROM r) SELECT id, CASE WHEN n % 2 = 0 THEN coalesce(grp, 'none') ELSE 'later' END AS grp FROM x WHERE n % 2 = 0 OR n % 3 = 0")
def merged_publication(spark, sf_dir):
    r = records(spark, sf_dir).select("id", "n", F.coalesce(F.expr(GROUPED), F.lit("none")).alias("grp"))
    return writes.merged(r.where("n % 2 = 0"), r.where("n % 3 = 0").withColumn("grp", F.lit("later")))


@query(
    "site_index",
    f"""WITH {LIB}, {LINKS}, {PAIRS}, z AS ({SQL['publication'].removeprefix(f'WITH {LIB} ')}),
    o AS (SELECT a AS id, string_agg(DISTINCT b, ' ' ORDER BY b) AS links FROM k WHERE b IN (SELECT id FROM z) GROUP BY a),
    w AS (SELECT k.b AS id, string_agg(DISTINCT k.a, ' ' ORDER BY k.a) AS backlinks FROM k JOIN z x ON x.id = k.b JOIN z y ON y.id = k.a WHERE y.kind = 'public' OR (x.kind = 'protected' AND y.grp IS NOT DISTINCT FROM x.grp) GROUP BY k.b),
    n AS (SELECT p.a AS id, p.b AS other FROM p JOIN z x ON x.id = p.a JOIN z y ON y.id = p.b WHERE y.kind = 'public' OR (x.kind = 'protected' AND y.grp IS NOT DISTINCT FROM x.grp))
    SELECT z.id, z.kind, CASE WHEN z.kind = 'public' THEN concat('/', replace(path, '.md', ''), '/') ELSE concat('/protected/', z.id, '/') END AS url, coalesce(links, '') AS links, coalesce(backlinks, '') AS backlinks, coalesce(other, '') AS related
    FROM z JOIN r ON r.id = z.id LEFT JOIN o ON o.id = z.id LEFT JOIN w ON w.id = z.id LEFT JOIN n ON n.id = z.id""",
)
def site_index(spark, sf_dir):
    r = records(spark, sf_dir)
    near = _pairs(r).select(F.col("a").alias("id"), F.col("b").alias("other"), F.lit(1).alias("place"))
    made = writes.site_index(r, _kinds(r), graph.links(r), near)
    return made.withColumns({c: F.array_join(c, " ") for c in ("links", "backlinks", "related")})


@query(
    "archived_records",
    f"""WITH {LIB} SELECT id, CASE WHEN n % 3 = 0 AND {CURRENT} THEN 'archived' ELSE status END AS status, CASE WHEN n % 3 = 0 AND {CURRENT} THEN concat(rtrim(body, {NL}), {NL}, {NL}, '## Why archived', {NL}, 'unused', {NL}) ELSE body END AS body FROM r""",
)
def archived_records(spark, sf_dir):
    r = records(spark, sf_dir)
    return writes.archived(r, r.where("n % 3 = 0"), "unused").select("id", "status", "body")


@query(
    "inbox_search",
    """WITH q AS (SELECT item_id AS query_id FROM benchmark) SELECT query_id, 1 AS place, query_id AS item FROM q""",
)
def inbox_search(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    items = b.select(F.col("item_id").alias("item"), F.col("item_id").alias("time"), F.col("text").alias("body"))
    # each passage holds all of its own terms, so it comes first among the items that hold half of them
    return reports.inbox_search(items, b.select(F.col("item_id").alias("query_id"), "text"), most=1).select("query_id", "place", "item")


@query(
    "closest_topics",
    """WITH n AS (SELECT DISTINCT r_name AS name FROM region), x AS (SELECT DISTINCT concat(substr(r_name, 1, 1), substr(r_name, 3)) AS asked FROM region), d AS (SELECT asked, name, levenshtein(asked, name) / greatest(len(asked), len(name)) AS share FROM x, n)
    SELECT asked, CAST(row_number() OVER (PARTITION BY asked ORDER BY share, name) AS INTEGER) AS place, name FROM d QUALIFY place <= 1""",
)
def closest_topics(spark, sf_dir):
    names = table(spark, sf_dir, "region").select(F.col("r_name").alias("name")).distinct()
    asked = names.select(F.concat(F.substring("name", 1, 1), F.expr("substring(name, 3)")).alias("asked")).distinct()
    return reports.closest(asked, names, 1)


def _frontmatter(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.withColumns(
        {
            "schema": F.when(F.col("n") % 12 == 1, 2).otherwise(1), "stale_reason": F.when((F.col("status") == "stale") & (F.col("n") % 2 == 0), "why"), "queries": F.when(F.col("n") % 14 == 2, F.array(F.lit("q"), F.lit(" q "))).otherwise(F.array().cast("array<string>")),
            "when": F.when(F.col("n") % 15 == 3, F.create_map(F.lit("os"), F.array(F.lit("1:x/y")))).otherwise(F.create_map().cast("map<string,array<string>>")), "body_line": F.lit(10),
        }
    )


@query(
    "record_findings",
    f"""WITH {LIB}, x AS (SELECT *, 'error' AS e FROM r)
    SELECT path, 'format/schema' AS rule, CAST(NULL AS INTEGER) AS line FROM x WHERE n % 12 = 1 UNION ALL SELECT path, 'format/stale_reason', NULL FROM x WHERE status = 'stale' AND n % 2 = 1
    UNION ALL SELECT path, 'format/tags', NULL FROM x WHERE false UNION ALL SELECT path, 'format/queries', NULL FROM x WHERE n % 14 = 2 UNION ALL SELECT path, 'when/invalid', NULL FROM x WHERE n % 15 = 3
    UNION ALL SELECT path, 'body/title', 9 + 4 + 1 + CASE WHEN n % 6 = 0 THEN 4 ELSE 0 END + CASE WHEN n % 9 = 0 THEN 1 ELSE 0 END + 2 FROM x WHERE n % 8 = 0
    UNION ALL SELECT path, 'body/headings', NULL FROM x, (VALUES ('pitfall', 'Cause'), ('pitfall', 'Fix'), ('pitfall', 'Evidence'), ('recipe', 'Steps'), ('recipe', 'Evidence'), ('fact', 'Evidence'), ('decision', 'Context'), ('decision', 'Why'), ('decision', 'Rejected options'), ('preference', 'Why'), ('preference', 'How to apply')) h(t, name)
      WHERE type = t AND NOT (name = 'Fix' AND n % 2 = 0) UNION ALL SELECT path, 'body/headings', NULL FROM x WHERE status IN ('superseded', 'archived')
    UNION ALL SELECT path, 'quality/fix', NULL FROM x WHERE n % 2 = 0 AND len(concat('Run the tool ', CAST(n AS STRING), CASE WHEN n % 8 = 0 THEN '1# Another' ELSE '' END)) < 20""",
)
def record_findings(spark, sf_dir):
    return lint.records(_frontmatter(spark, sf_dir)).select("path", "rule", "line")


@query("folder_findings", f"WITH {LIB} SELECT DISTINCT concat({home('n')}, '/Bad_', CAST(n % 4 AS STRING)) AS path FROM r WHERE scope = 'general'")
def folder_findings(spark, sf_dir):
    paths = records(spark, sf_dir).where("scope = 'general'").selectExpr(f"concat({home('n')}, '/Bad_', CAST(n % 4 AS STRING), '/x.md') AS path")
    return lint.folders(paths).select("path")


@query("budgeted_sessions", f"WITH {LOGGED}, c AS (SELECT session, program, seq, sum(len(sig) + 1) OVER (PARTITION BY session, program ORDER BY seq) AS total FROM s) SELECT session, program, seq FROM c WHERE total <= 60")
def budgeted_sessions(spark, sf_dir):
    return sessions.within_budget(logged(spark, sf_dir), ["session", "program"], ["seq"], F.char_length("sig") + 1, 60).select("session", "program", "seq")
