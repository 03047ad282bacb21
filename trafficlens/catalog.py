"""The registered queries of the log analysis, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import match
from .operators import profiles as prof
from .operators import robots
from .operators import sessions as sess
from .plans import derived, digest, report
from .plans import sql as sql_plan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NOW, DAYS = datetime(2024, 1, 20), 12


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def on_log(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(derived.log(spark, d))


def on_profiles(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(prof.profiles(derived.log(spark, d), robots.published_rules(spark)))


def on_sessions(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(sess.sessions(derived.log(spark, d)))


def text(*names: str) -> Callable[[DataFrame], DataFrame]:
    """Selects columns; arrays as comma-joined text."""

    def select(df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        return df.select(*(F.array_join(n, ",").alias(n) if kinds[n].startswith("array") else F.col(n) for n in names))

    return select


LOG = derived.LOG_SQL

# One row per client, in DuckDB.  What robots.txt forbids is typed by hand for the log's agents and paths.
PROFILE_SQL = LOG + """,
fetched AS (SELECT client_ua, client_claimed, path, (ts, event_id) AS pos FROM log WHERE kind = 'request' AND status = 200
  AND resource NOT IN ('policy', 'not_found') AND (ua_k < 4 OR path IN ('/docs/restricted/index.html', '/internal/exports/quarterly.html'))),
first_read AS (SELECT client_ua, client_claimed, min((ts, event_id)) AS first_pos FROM log WHERE kind IN ('policy_read', 'trap_hit')
  AND standard IN ('robots', 'robots_wellknown') GROUP BY ALL),
broken AS (SELECT client_ua, client_claimed, path, coalesce(bool_or(pos > first_pos), false) AS defied FROM fetched LEFT JOIN first_read USING (client_ua, client_claimed) GROUP BY ALL),
broken_sets AS (SELECT client_ua, client_claimed, list_sort(list(path)) AS disallowed_fetched, list_sort(coalesce(list(path) FILTER (defied), [])) AS defied FROM broken GROUP BY ALL),
page_runs AS (SELECT client_ua, client_claimed, path, conditional, row_number() OVER (PARTITION BY client_ua, client_claimed, path ORDER BY ts, event_id) AS k
  FROM log WHERE kind = 'request' AND status IN (200, 304) AND resource IN ('page', 'index', 'docs_index', 'project_index')),
again AS (SELECT client_ua, client_claimed, count(*) FILTER (k > 1) AS repeat_fetches, count(*) FILTER (k > 1 AND NOT conditional) AS wasteful_refetches,
  count(*) FILTER (conditional) AS conditional_requests FROM page_runs GROUP BY ALL),
hashed AS (SELECT client_ua, client_claimed, count(*) - count(DISTINCT content_hash) AS duplicate_content_fetches FROM log WHERE kind = 'request' AND content_hash IS NOT NULL GROUP BY ALL),
kinds(standard, what) AS (VALUES ('robots','prohibition'),('robots_wellknown','prohibition'),('llms','prohibition'),('ai','prohibition'),('tdm_root','prohibition'),
  ('sitemap','invitation'),('humans','invitation'),('meta_noai','capability'),('nofollow','capability'),('hidden_link','capability'),('js_beacon','capability'),
  ('css_beacon','capability'),('control_allow','control')),
base AS (SELECT client_ua, client_claimed, count(*) FILTER (kind = 'request') AS requests, coalesce(sum(bytes), 0)::BIGINT AS bytes_served,
  list_sort(coalesce(list(DISTINCT ip) FILTER (kind IN ('request','policy_read','trap_hit','hunt')), [])) AS addresses,
  list_sort(coalesce(list(DISTINCT standard) FILTER (kind = 'policy_read' OR kind = 'trap_hit' AND what IN ('prohibition','invitation')), [])) AS standards_read,
  list_sort(coalesce(list(DISTINCT standard) FILTER (kind = 'trap_hit' AND what = 'prohibition'), [])) AS standards_mined,
  coalesce(bool_or(kind = 'trap_hit' AND standard = 'js_beacon'), false) AS executes_js, coalesce(bool_or(kind = 'trap_hit' AND standard = 'css_beacon'), false) AS loads_css,
  coalesce(bool_or(kind = 'trap_hit' AND standard = 'hidden_link'), false) AS follows_hidden, coalesce(bool_or(kind = 'trap_hit' AND standard = 'nofollow'), false) AS follows_nofollow,
  coalesce(bool_or(kind = 'trap_hit' AND standard = 'meta_noai'), false) AS ignores_meta_noai, coalesce(bool_or(kind = 'trap_hit' AND standard = 'control_allow'), false) AS respects_specificity,
  count(*) FILTER (split_fleet) AS split_fleet_hits, coalesce(max(delay_seconds), 0.0)::DOUBLE AS max_read_to_fetch_delay,
  max(operator) AS operator, list_sort(coalesce(list(DISTINCT ja4) FILTER (ja4 IS NOT NULL), [])) AS ja4, count(*) FILTER (kind = 'hunt') AS hunt_probes,
  list_sort(coalesce(list(DISTINCT family) FILTER (family IS NOT NULL), [])) AS hunt_families, list_sort(coalesce(list(DISTINCT category) FILTER (category IS NOT NULL), [])) AS hunt_categories,
  list_sort(list_distinct(coalesce(flatten(list(mitre) FILTER (mitre IS NOT NULL)), []))) AS mitre, count(*) FILTER (kind = 'credential') AS credential_attempts
  FROM log LEFT JOIN kinds USING (standard) GROUP BY ALL),
prof AS (SELECT *, CASE WHEN len(standards_mined) > 0 THEN 'miner' WHEN len(defied) > 0 THEN 'defiant' WHEN len(disallowed_fetched) > 0 THEN 'ignorant'
    WHEN len(standards_read) > 0 THEN 'compliant' ELSE 'indeterminate' END AS state, len(addresses) AS fleet_size, hunt_probes > 0 AS is_hunter,
    CASE WHEN repeat_fetches > 0 THEN wasteful_refetches::DOUBLE / repeat_fetches ELSE 0.0::DOUBLE END AS waste_ratio,
    CASE WHEN client_claimed = '-' THEN client_ua ELSE client_claimed END AS client
  FROM (SELECT base.*, coalesce(disallowed_fetched, []) AS disallowed_fetched, coalesce(defied, []) AS defied, coalesce(repeat_fetches, 0) AS repeat_fetches,
    coalesce(wasteful_refetches, 0) AS wasteful_refetches, coalesce(conditional_requests, 0) AS conditional_requests, coalesce(duplicate_content_fetches, 0) AS duplicate_content_fetches
    FROM base LEFT JOIN broken_sets USING (client_ua, client_claimed) LEFT JOIN again USING (client_ua, client_claimed) LEFT JOIN hashed USING (client_ua, client_claimed)))
"""


def profile_sql(*names: str, lists: tuple[str, ...] = ()) -> str:
    return f"{PROFILE_SQL} SELECT client_ua, client_claimed, {', '.join([*names, *(f'''array_to_string({x}, ',') AS {x}''' for x in lists)])} FROM prof"


def profile(name: str, *columns: str, lists: tuple[str, ...] = ()) -> None:
    add(name, on_profiles(text(*prof.KEY, *columns, *lists)), profile_sql(*columns, lists=lists))


# -- expressions over the log (2B, 2C)
add("B1_client_key", on_log(lambda log: prof.with_client(log).groupBy(*prof.KEY).agg(F.count("*").alias("events"))), LOG + "SELECT client_ua, client_claimed, count(*) AS events FROM log GROUP BY ALL")
add("B2_judged", on_log(lambda log: log.where("kind = 'request'").groupBy(match.is_judged(F.col("resource")).alias("judged")).agg(F.count("*").alias("n"))), LOG + "SELECT resource NOT IN ('policy', 'not_found') AS judged, count(*) AS n FROM log WHERE kind = 'request' GROUP BY ALL")
add("B3_page", on_log(lambda log: log.where("kind = 'request'").groupBy(match.is_page(F.col("status"), F.col("resource")).alias("page")).agg(F.count("*").alias("n"))), LOG + "SELECT status IN (200, 304) AND resource IN ('page', 'index', 'docs_index') AS page, count(*) AS n FROM log WHERE kind = 'request' GROUP BY ALL")
add("B10_display_name", on_log(lambda log: log.select(match.display_name(F.col("claimed_crawler"), F.col("ua"), 12).alias("name")).groupBy("name").agg(F.count("*").alias("n"))), LOG + "SELECT substr(coalesce(claimed_crawler, ua), 1, 12) AS name, count(*) AS n FROM log GROUP BY ALL")
add("B12_step_tag", on_log(lambda log: log.select(match.tag(*map(F.col, ("web_attack", "standard", "family", "resource", "scheme"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))), LOG + "SELECT coalesce(web_attack, standard, family, resource, scheme) AS tag, count(*) AS n FROM log GROUP BY ALL")
add("C1_crawler", on_log(lambda log: log.select(match.crawler(F.col("ua")).alias("c")).groupBy("c.name", "c.operator", "c.method").agg(F.count("*").alias("n"))), LOG + "SELECT c_name AS name, c_op AS operator, c_method AS method, count(*) AS n FROM derived LEFT JOIN crawler_dim ON c_k = user_id % 11 GROUP BY ALL")
add("C2_browser_claim", on_log(lambda log: log.groupBy(match.claims_browser(F.col("ua")).alias("browser"), match.admits_headless(F.col("ua")).alias("headless")).agg(F.count("*").alias("n"))), LOG + "SELECT ua_k = 5 AS browser, false AS headless, count(*) AS n FROM log GROUP BY ALL")
add("C7_probe", on_log(lambda log: log.where("kind = 'hunt'").select(match.probe(F.col("path")).alias("p")).groupBy("p.family", "p.category", F.array_join("p.mitre", ",").alias("mitre")).agg(F.count("*").alias("n"))), LOG + "SELECT p_family AS family, p_category AS category, array_to_string(p_mitre, ',') AS mitre, count(*) AS n FROM derived JOIN probe_dim ON pk = event_id % 8 WHERE kind = 'hunt' GROUP BY ALL")
add("C8_probe_scoped", on_log(lambda log: log.where("kind = 'hunt'").select(match.probe_scoped(F.col("path"), F.lit("ray"))["family"].alias("family")).groupBy("family").agg(F.count("*").alias("n"))), LOG + "SELECT CASE WHEN event_id % 8 = 2 THEN 'ray' END AS family, count(*) AS n FROM log WHERE kind = 'hunt' GROUP BY ALL")
add("C10_stage_step", on_log(lambda log: log.where("kind = 'hunt'").select(match.stage_step(F.lit("POST"), F.col("path"), F.lit("ray"))["step"].alias("step")).groupBy("step").agg(F.count("*").alias("n"))), LOG + "SELECT CASE WHEN event_id % 8 = 2 THEN 'submit' END AS step, count(*) AS n FROM log WHERE kind = 'hunt' GROUP BY ALL")
add("C13_policy_standard", on_log(lambda log: log.select(match.policy_standard(F.col("path")).alias("standard")).groupBy("standard").agg(F.count("*").alias("n"))), LOG + "SELECT CASE WHEN path = '/llms.txt' THEN 'llms' END AS standard, count(*) AS n FROM log GROUP BY ALL")
add("C14_standard_kind", on_log(lambda log: log.where("standard is not null").select(match.standard_kind(F.col("standard")).alias("what")).groupBy("what").agg(F.count("*").alias("n"))), PROFILE_SQL + "SELECT what, count(*) AS n FROM log JOIN kinds USING (standard) GROUP BY ALL")
add("C18_stable_trap", on_log(lambda log: log.where("kind = 'request'").select(match.stable_trap(F.col("path")).alias("trap")).groupBy("trap").agg(F.count("*").alias("n"))), LOG + "SELECT CASE WHEN path_k = 7 THEN 'stable_disallow_unlinked' END AS trap, count(*) AS n FROM log WHERE kind = 'request' GROUP BY ALL")


def duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text is not null")
    return docs.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


add("C9_duplicate_content", duplicate_texts, "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")


def page_targets(spark: SparkSession, d: str) -> DataFrame:
    path, query = match.split_target(F.col("url"))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", path.alias("path"), query.alias("query"))


add("B9_split_target", page_targets, "SELECT page_id, CASE WHEN instr(url, '?') > 0 THEN substr(url, 1, instr(url, '?') - 1) ELSE url END AS path, CASE WHEN instr(url, '?') > 0 THEN substr(url, instr(url, '?') + 1) END AS query FROM pages")


def page_faces(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    faces = spark.read.parquet(f"{d}/pages.parquet").select(F.regexp_extract(host, r"([a-z]+\.[a-z]+)$", 1).alias("site"), match.face(host, ["www.example.com"]).alias("face"))
    return faces.groupBy("site", "face").agg(F.count("*").alias("n"))


add("B7_face", page_faces, "SELECT regexp_extract(h, '([a-z]+[.][a-z]+)$', 1) AS site, CASE WHEN lower(h) = 'www.example.com' THEN 'docs' ELSE 'attack' END AS face, count(*) AS n FROM (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS h FROM pages) GROUP BY ALL")


def robots_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return robots.disallowed(derived.log(spark, d).where("kind = 'request'"), robots.published_rules(spark))


add("F5_disallowed", robots_verdicts, LOG + "SELECT DISTINCT ua, path, ua_k < 4 OR path IN ('/docs/restricted/index.html', '/internal/exports/quarterly.html') AS disallowed FROM log WHERE kind = 'request'")
add("F3_agent_groups", lambda spark, d: robots.agent_groups(derived.log(spark, d), robots.published_rules(spark)), LOG + "SELECT DISTINCT ua, CASE ua_k WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 6 ELSE 1 END AS group_id FROM log")

# -- profiles (2H)
profile("H1_clients", "requests", "bytes_served", "fleet_size", lists=("addresses",))
profile("H2_standards_read", lists=("standards_read",))
profile("H3_standards_mined", lists=("standards_mined",))
profile("H4_disallowed", lists=("disallowed_fetched",))
profile("H5_defied", lists=("defied",))
profile("H6_state", "state")
profile("H7_capability", "executes_js", "loads_css", "follows_hidden", "follows_nofollow", "ignores_meta_noai")
profile("H8_specificity", "respects_specificity")
profile("H9_split_fleet", "split_fleet_hits", "max_read_to_fetch_delay")
profile("H10_refetch", "repeat_fetches", "wasteful_refetches", "conditional_requests", "waste_ratio")
profile("H11_duplicate_content", "duplicate_content_fetches")
profile("H12_operator", "operator")
profile("H13_ja4", lists=("ja4",))
profile("H14_hunt", "hunt_probes", "is_hunter", lists=("hunt_families", "hunt_categories", "mitre"))
profile("H18_credentials", "credential_attempts")
MATRIX_SQL = PROFILE_SQL + ", m AS (SELECT substr(client, 1, 40) AS client, standard, count(*) AS profiles FROM (SELECT client, unnest(standards_read) AS standard FROM prof) JOIN kinds USING (standard) WHERE what IN ('prohibition', 'invitation') GROUP BY ALL)"
add("H19_standard_matrix", on_profiles(prof.standard_matrix), MATRIX_SQL + " SELECT * FROM m")

# -- report (2K)
add("K1_totals", lambda spark, d: report.totals(log := derived.log(spark, d), prof.profiles(log, robots.published_rules(spark))), PROFILE_SQL + "SELECT (SELECT count(*) FROM log) AS events, (SELECT count(*) FROM log WHERE kind = 'policy_read') AS policy_reads, (SELECT count(*) FROM log WHERE kind = 'trap_hit') AS trap_hits, (SELECT count(*) FROM prof) AS clients")
add("K1_kinds", on_log(report.kinds), LOG + "SELECT kind, count(*) AS events FROM log GROUP BY kind")
add("K2_compliance", on_profiles(report.compliance), PROFILE_SQL + "SELECT place, s.state, count(prof.state) AS clients, count(prof.state)::DOUBLE / (SELECT count(*) FROM prof) AS share FROM (VALUES (0,'compliant'),(1,'ignorant'),(2,'defiant'),(3,'miner'),(4,'indeterminate')) s(place, state) LEFT JOIN prof USING (state) GROUP BY ALL")
_READ = ("robots", "robots_wellknown", "llms", "llms_full", "ai", "ai_wellknown", "tdm_wellknown", "tdm_root", "sitemap", "sitemap_index", "security", "security_root", "humans", "ai_plugin", "dnt_policy", "gpc", "ads", "noai_file")
add("K3_standards", on_profiles(report.standards), MATRIX_SQL + " SELECT client, " + ", ".join(f"coalesce(sum(profiles) FILTER (standard = '{s}'), 0)::BIGINT AS {s}" for s in _READ) + ", sum(profiles)::BIGINT AS total FROM m GROUP BY client")
add("K4_identity", on_profiles(report.identity), PROFILE_SQL + "SELECT 'unchecked' AS verdict, count(*) AS clients FROM prof")
add("K5_split_fleets", on_profiles(report.split_fleets), PROFILE_SQL + "SELECT substr(client, 1, 44) AS client, split_fleet_hits, fleet_size FROM prof WHERE split_fleet_hits > 0")
add("K6_waste", on_profiles(report.waste), PROFILE_SQL + "SELECT substr(client, 1, 40) AS client, repeat_fetches, wasteful_refetches, waste_ratio, duplicate_content_fetches FROM prof WHERE repeat_fetches > 0 ORDER BY wasteful_refetches DESC, 1 LIMIT 15")
add("K7_capability", on_profiles(report.capability), PROFILE_SQL + "SELECT substr(client, 1, 40) AS client, requests, executes_js, loads_css, follows_hidden, follows_nofollow, ignores_meta_noai FROM prof ORDER BY requests DESC, 1 LIMIT 20")
add("K8_hunt_totals", on_profiles(report.hunt_totals), PROFILE_SQL + "SELECT count(*) AS hunters, sum(hunt_probes)::BIGINT AS probes FROM prof WHERE is_hunter")
add("K8_hunt_categories", on_profiles(report.hunt_categories), PROFILE_SQL + "SELECT category, count(*) AS clients FROM (SELECT unnest(hunt_categories) AS category FROM prof) GROUP BY 1")
add("K8_hunt_families", on_log(report.hunt_families), LOG + "SELECT family, count(*) AS probes FROM log WHERE kind = 'hunt' GROUP BY 1 ORDER BY probes DESC, family LIMIT 10")
add("K8_hunters", on_profiles(report.hunters), PROFILE_SQL + "SELECT substr(client, 1, 32) AS client, hunt_probes, array_to_string(hunt_categories, ',') AS categories FROM prof WHERE is_hunter ORDER BY hunt_probes DESC, 1 LIMIT 12")
add("K10_credential_totals", on_log(report.credential_totals), LOG + "SELECT count(*) AS attempts, count(DISTINCT ip) AS addresses FROM log WHERE kind = 'credential'")
add("K10_credential_personas", on_log(report.credential_personas), LOG + "SELECT persona, count(*) AS attempts FROM log WHERE kind = 'credential' GROUP BY 1 ORDER BY attempts DESC, persona LIMIT 8")
add("K10_credential_top", on_log(report.credential_top), LOG + 'SELECT scheme, "user", password, count(*) AS attempts FROM log WHERE kind = \'credential\' GROUP BY ALL ORDER BY attempts DESC, scheme, "user", password LIMIT 10')
add("K17_ja4", on_profiles(lambda p: text("fingerprint", "clients", "shared", "claimants")(report.ja4(p))), PROFILE_SQL + ", j AS (SELECT unnest(ja4) AS fingerprint, substr(client, 1, 30) AS name FROM prof), k AS (SELECT fingerprint, count(*) AS clients, list_sort(list(DISTINCT name)) AS names FROM j GROUP BY 1) SELECT fingerprint, clients, len(names) > 1 AS shared, CASE WHEN len(names) > 1 THEN array_to_string(names[1:6], ',') ELSE '' END AS claimants FROM k ORDER BY clients DESC, fingerprint LIMIT 12")
add("K18_top_clients", on_profiles(report.top_clients), PROFILE_SQL + "SELECT substr(client, 1, 36) AS client, requests, state, fleet_size, is_hunter FROM prof ORDER BY requests DESC, 1 LIMIT 15")

# -- sessions (2I)
_SET = "list_sort(coalesce(list(DISTINCT {0}) FILTER ({1}), [])) AS {2}"
SESSION_SQL = LOG + """,
sess0 AS (SELECT actor, arg_min(actor_basis, (ts, event_id)) AS actor_basis, count(*) AS event_count, count(*) FILTER (kind = 'request') AS request_count,
  min(ts) AS first_seen, max(ts) AS last_seen, """ + ", ".join(_SET.format(c, f"{c} IS NOT NULL AND {c} <> ''", n) for c, n in (("ip", "ips"), ("ja4", "ja4s"), ("ua", "user_agents"), ("operator", "operators"), ("claimed_crawler", "claimed_crawlers"), ("face", "faces"), ("sensor", "sensors"), ("family", "families"), ("category", "hunt_categories"), ("web_attack", "web_attacks"))) + ", " + _SET.format("standard", "kind = 'policy_read'", "standards_read") + ", " + _SET.format("standard", "kind = 'trap_hit' AND disallowed", "standards_mined") + """,
  coalesce(bool_or(decoy_served), false) AS decoy_served, coalesce(bool_or(stage), false) AS walked_multistage,
  list_sort(list_distinct(coalesce(flatten(list(mitre) FILTER (mitre IS NOT NULL)), []))) AS mitre, count(*) FILTER (kind = 'credential') AS credential_attempts
  FROM log WHERE actor IS NOT NULL GROUP BY actor),
sess AS (SELECT *, credential_attempts > 0 OR list_contains(web_attacks, 'sqli') AS has_payload,
  CASE WHEN credential_attempts > 0 OR list_contains(web_attacks, 'sqli') THEN 'payload' WHEN walked_multistage THEN 'followup' WHEN decoy_served THEN 'decoy_served'
    WHEN len(families) > 0 OR len(web_attacks) > 0 THEN 'probed' ELSE 'seen' END AS stage_reached,
  (epoch_us(last_seen) - epoch_us(first_seen))::DOUBLE / 1e6::DOUBLE AS duration_s FROM sess0),
ranks(stage_reached, rank) AS (VALUES ('seen',0),('probed',1),('decoy_served',2),('followup',3),('payload',4))
"""


def session(name: str, *columns: str, lists: tuple[str, ...] = ()) -> None:
    names = [*columns, *(f"array_to_string({x}, ',') AS {x}" for x in lists)]
    add(name, on_sessions(text("actor", *columns, *lists)), f"{SESSION_SQL} SELECT actor, {', '.join(names)} FROM sess")


session("I1_sessions", "actor_basis", "event_count", "request_count", lists=("ips", "ja4s", "user_agents", "operators", "claimed_crawlers", "faces", "sensors"))
session("I2_times", "first_seen", "last_seen", "duration_s")
session("I3_standards", lists=("standards_read", "standards_mined"))
session("I4_hunt", "decoy_served", "walked_multistage", lists=("families", "hunt_categories", "web_attacks"))
session("I9_mitre", lists=("mitre",))
session("I10_has_payload", "has_payload", "credential_attempts")
session("I11_stage", "stage_reached")
add("I8_credential_pairs", on_log(lambda log: sess.credential_pairs(log, sess.PAIRS).select("actor", "user", "password")), LOG + 'SELECT actor, "user", password FROM (SELECT actor, "user", password, row_number() OVER (PARTITION BY actor ORDER BY min((ts, event_id))) AS k FROM log WHERE kind = \'credential\' AND actor IS NOT NULL GROUP BY 1, 2, 3) WHERE k <= 100')
add("I12_timeline", on_log(lambda log: sess.timeline(log).select("actor", F.col("seq.event_id").alias("event_id"), "ts", "kind", "face", "method", "path", "tag")), LOG + "SELECT actor, event_id, ts, kind, face, method, path, coalesce(web_attack, standard, family, resource, scheme) AS tag FROM log WHERE actor IS NOT NULL")
add("I13_ranked", on_sessions(lambda s: sess.rank_sessions(s).select("actor", "stage_reached", "event_count").limit(50)), SESSION_SQL + "SELECT actor, stage_reached, event_count FROM sess JOIN ranks USING (stage_reached) ORDER BY rank DESC, event_count DESC, actor LIMIT 50")
add("I14_by_stage", on_sessions(sess.by_stage), SESSION_SQL + "SELECT ranks.stage_reached AS stage, count(actor) AS sessions FROM ranks LEFT JOIN sess USING (stage_reached) GROUP BY 1")
add("B4_filter", on_sessions(lambda s: sess.filter_sessions(s, has_payload=True, min_stage="followup", since="2024-01-05 00:00:00").select("actor", "stage_reached")), SESSION_SQL + "SELECT actor, stage_reached FROM sess WHERE has_payload AND last_seen >= TIMESTAMP '2024-01-05 00:00:00'")
add("B5_min_requests", on_profiles(lambda p: p.where("requests >= 100").select(*prof.KEY, "requests")), PROFILE_SQL + "SELECT client_ua, client_claimed, requests FROM prof WHERE requests >= 100")

# -- digest (2L)
WINDOW_SQL = SESSION_SQL + f", w AS (SELECT * FROM sess WHERE last_seen >= TIMESTAMP '{NOW}' - INTERVAL {DAYS} DAY)"


def on_window(f: Callable[[DataFrame], DataFrame]) -> Query:
    return on_sessions(lambda s: f(digest.in_window(s, NOW, DAYS)))


add("B6_window", on_window(lambda w: w.select("actor", "last_seen")), WINDOW_SQL + " SELECT actor, last_seen FROM w")
add("L1_totals", on_window(digest.totals), WINDOW_SQL + " SELECT count(*) AS actor_sessions, coalesce(sum(event_count), 0)::BIGINT AS events, coalesce(sum(request_count), 0)::BIGINT AS requests, coalesce(sum(credential_attempts), 0)::BIGINT AS credential_attempts FROM w")
add("L2_by_stage", on_window(digest.by_stage), WINDOW_SQL + " SELECT stage_reached AS stage, count(*) AS sessions FROM w GROUP BY 1")
add("L2_by_face", on_window(digest.by_face), WINDOW_SQL + " SELECT face, count(*) AS sessions FROM (SELECT unnest(faces) AS face FROM w) GROUP BY 1")
add("L3_families", on_window(digest.families), WINDOW_SQL + " SELECT family, count(*) AS sessions FROM (SELECT unnest(families) AS family FROM w) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
add("L3_web_attacks", on_window(digest.web_attacks), WINDOW_SQL + " SELECT web_attack, count(*) AS sessions FROM (SELECT unnest(web_attacks) AS web_attack FROM w) GROUP BY 1")
add("L4_indicators", on_window(digest.indicators), WINDOW_SQL + " SELECT DISTINCT 'mitre' AS type, unnest(mitre) AS value FROM w")
add("L5_follow_up", on_window(lambda w: text("actor", "stage", "basis", "ips", "families", "web_attacks", "indicators", "credential_attempts", "first_seen", "last_seen", "user_agents")(digest.follow_up(w))), WINDOW_SQL + " SELECT actor, stage_reached AS stage, actor_basis AS basis, array_to_string(ips, ',') AS ips, array_to_string(families, ',') AS families, array_to_string(web_attacks, ',') AS web_attacks, false AS indicators, credential_attempts, first_seen, last_seen, array_to_string(user_agents[1:3], ',') AS user_agents FROM w JOIN ranks USING (stage_reached) WHERE rank >= 2 ORDER BY rank DESC, event_count DESC, actor LIMIT 15")

# -- SQL surface (2M)
for _id, _name in (("M1", "kinds"), ("M2", "faces"), ("M3", "families"), ("M4", "web_attacks"), ("M5", "actors")):
    add(f"{_id}_{_name}", on_log(lambda log, name=_name: sql_plan.overview(log)[name]), LOG + sql_plan.OVERVIEW[_name].replace("FROM events", "FROM log"))


def adhoc(spark: SparkSession, d: str) -> DataFrame:
    log = derived.log(spark, d)
    sql_plan.register_views(log, sessions=sess.sessions(log))
    return sql_plan.query(spark, "SELECT s.stage_reached, count(*) AS events FROM events e JOIN sessions s ON e.actor = s.actor GROUP BY s.stage_reached")


add("M6_adhoc", adhoc, SESSION_SQL + "SELECT stage_reached, count(*) AS events FROM log JOIN sess USING (actor) GROUP BY 1")
add("M7_read_fetch", on_log(sql_plan.read_fetch_counts), LOG + "SELECT token, r.standard AS read_standard, count(*) AS pairs, count(*) FILTER (r.ip <> h.ip) AS split FROM log r JOIN log h USING (token) WHERE r.kind = 'policy_read' AND h.kind = 'trap_hit' GROUP BY ALL")
