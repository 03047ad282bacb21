"""Registered queries of whole jobs: files written from the events, read, published, packed and read back, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import DAYS, LOG, NOW, SESSION_SQL, WINDOW_SQL, add
from .catalog_payloads import LABELS, materialise_stream, requests, stream_log
from .operators import actors, families, robots, sessions
from .plans import derived, digest, publish
from .plans import sql as sql_plan
from .shared import materialise, shared_dir
from .sources import log as source
from .sources import sinks
from .streaming import live

#: Lines of a landed chunk, so that every day has several.
CHUNK = 200


def folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def landed(spark: SparkSession, d: str) -> str:
    """The log as day files: requests with headers and a body, credentials, and lines that are no JSON or no object."""
    none = F.lit(None).cast("string")
    log = derived.log(spark, d).where("kind <> 'request'").withColumns({"rid": F.col("event_id").cast("string"), "raw_path": F.col("path"), "headers": F.lit(None).cast("array<array<string>>"), "body": none, "body_encoding": none})
    asked = requests(spark, d).withColumns({"headers": F.array(F.array(F.lit("User-Agent"), F.col("ua")), F.array(F.lit("Cookie"), F.concat(F.lit("c"), "rid")), F.array(F.lit("X-Real-IP"), F.col("ip"))), "body": F.lit("b"), "body_encoding": F.lit("utf-8")})
    fields = ["kind", "rid", "ts", "ip", "ua", "path", "raw_path", "raw_query", "status", "headers", "body", "body_encoding", "user", "password", "actor"]
    line = F.when(F.col("event_id") % 50 == 0, "not json").when(F.col("event_id") % 50 == 1, "[1]").otherwise(F.to_json(F.struct(*fields)))
    lines = log.unionByName(asked, allowMissingColumns=True).select(F.lit("events").alias("stream"), F.date_format("ts", "yyyy-MM-dd").alias("day"), line.alias("line"))
    root = folder(spark)
    source.land_days(lines, root, CHUNK)
    return root


# -- the daily job (2N)
def published(spark: SparkSession, d: str) -> DataFrame:
    """A run is lost before its commit, is found and discarded; the next one publishes; a third one has nothing to do."""
    src, dst = f"{landed(spark, d)}/*.jsonl*", folder(spark)
    key, salt = b"k" * 32, "salt"
    publish.publish(spark, src, f"{dst}/runs/lost", publish.committed(spark, dst), key, salt, NOW)
    for run in publish.unfinished(spark, dst):
        publish.discard(spark, dst, run)
    publish.publish_run(spark, src, dst, "first", key, salt, NOW)
    manifest = publish.publish_run(spark, src, dst, "second", key, salt, NOW)
    events = publish.read_published(spark, dst, "kind string, ip string, password string, headers array<array<string>>, body string, attacks array<struct<cls string>>")
    seen = events.groupBy("stream", "day").agg(
        F.count("*").alias("read_back"),
        F.count_if(F.size("attacks") > 0).alias("attacks"),
        F.count_if(F.col("headers")[1][1] == "[redacted]").alias("cookies_hidden"),
        F.count_if((F.col("kind") == "request") & F.col("body").isNull()).alias("bodies_hidden"),
        F.count_if(F.col("password") == "[redacted]").alias("passwords_hidden"),
        F.count_if(~F.col("ip").startswith("anon_")).alias("addresses_shown"),
        F.countDistinct("ip").alias("addresses"),
    )
    entries = manifest.select("stream", "day", "rows", "dropped", "malformed", (F.length("sha256") == 64).alias("hashed"), F.regexp_extract("path", "/runs/([^/]*)/", 1).alias("run"))
    return entries.join(seen, ["stream", "day"], "left")


add("N12_publish_job", published, LABELS + f""",
attacked AS (SELECT DISTINCT event_id, true AS hit FROM hits),
lines AS (SELECT log.*, coalesce(hit, false) AS hit, event_id % 50 > 1 AS good, strftime(ts, '%Y-%m-%d') AS day FROM log LEFT JOIN attacked USING (event_id))
SELECT 'events' AS stream, day, count(*) FILTER (good) AS rows, count(*) FILTER (event_id % 50 = 1) AS dropped, count(*) FILTER (event_id % 50 = 0) AS malformed, true AS hashed, 'first' AS run,
  count(*) FILTER (good) AS read_back, count(*) FILTER (good AND hit) AS attacks, count(*) FILTER (good AND kind = 'request' AND NOT hit) AS cookies_hidden, count(*) FILTER (good AND kind = 'request' AND NOT hit) AS bodies_hidden,
  count(*) FILTER (good AND kind = 'credential') AS passwords_hidden, 0::BIGINT AS addresses_shown, count(DISTINCT ip) FILTER (good) AS addresses
FROM lines WHERE day::DATE + INTERVAL 25 HOUR <= TIMESTAMP '{NOW}' GROUP BY day""")


# -- files (2A)
def viewed(spark: SparkSession, d: str) -> DataFrame:
    """SQL over the log's files by a view; `resource` is in no line, `actor` in some."""
    name = f"events_{uuid.uuid4().hex}"
    sql_plan.register_events_view(spark, f"{landed(spark, d)}/*.jsonl*", name)
    return sql_plan.query(spark, f"SELECT kind, day, count(*) AS n, count(status) AS with_status, count(resource) AS with_resource, count(variant_get(raw, '$.actor', 'string')) AS with_actor FROM {name} GROUP BY kind, day")


add("A3_events_view", viewed, LOG + "SELECT kind, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(status) AS with_status, 0::BIGINT AS with_resource, count(actor) AS with_actor FROM log WHERE event_id % 50 > 1 GROUP BY 1, 2")


def packed(spark: SparkSession, d: str) -> DataFrame:
    """A silver table of many small files; its finished days are packed, the others stay as they are."""
    silver = folder(spark)
    log = derived.log(spark, d).withColumns({"day": F.date_format("ts", "yyyy-MM-dd"), "line": F.lit(None).cast("string")})
    source.to_silver(log.repartition(6), silver)
    days = [r["day"] for r in log.where(F.to_timestamp("day") + F.expr("INTERVAL 25 HOURS") <= F.lit(NOW)).select("day").distinct().collect()]
    source.compact_days(spark, silver, days)
    table = spark.read.parquet(silver).where(F.col("day").cast("string").isin(days))
    return table.groupBy("kind", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("events"), F.sum("event_id").alias("ids"), F.countDistinct("_metadata.file_path").alias("files"))


add("A11_compaction", packed, LOG + f"SELECT kind, strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, sum(event_id)::BIGINT AS ids, 1::BIGINT AS files FROM log WHERE date_trunc('day', ts) + INTERVAL 25 HOUR <= TIMESTAMP '{NOW}' GROUP BY 1, 2")


def actor_lines(spark: SparkSession, d: str) -> DataFrame:
    """Records of the actors that reached a payload, written as JSON lines and read back."""
    path, log = folder(spark), derived.log(spark, d)
    s = materialise(sessions.sessions(log))
    sinks.write_actors(actors.actor_records(s, actors.indicators(s, sessions.credential_pairs(log))), path, payload_only=True)
    read = spark.read.schema("schema string, actor string, events bigint, reached_payload boolean, sensor struct<type string, id string>, fingerprints array<struct<type string, value string>>, detail struct<stage string, requests bigint>, first_seen string").json(path)
    return read.select("schema", "actor", "events", "reached_payload", F.col("sensor.id").alias("sensor"), F.size("fingerprints").alias("fingerprints"), "detail.stage", "detail.requests", "first_seen")


add("A14_actor_lines", actor_lines, SESSION_SQL + "SELECT 'actor/1' AS schema, actor, event_count AS events, true AS reached_payload, sensors[1] AS sensor, len(ja4s)::INT AS fingerprints, stage_reached AS stage, request_count AS requests, strftime(first_seen, '%Y-%m-%dT%H:%M:%SZ') AS first_seen FROM sess WHERE has_payload")


def digest_document(spark: SparkSession, d: str) -> DataFrame:
    """The digest written as one JSON document and read back: section, name, value."""
    path = folder(spark)
    s = materialise(sessions.sessions(derived.log(spark, d)))
    sinks.write_digest(digest.digest(digest.in_window(s, NOW, DAYS), NOW, DAYS), path)
    doc = spark.read.schema("totals map<string,bigint>, by_stage array<struct<stage string, sessions bigint>>, by_face array<struct<face string, sessions bigint>>, hunt_families array<struct<family string, sessions bigint>>, web_attacks array<struct<web_attack string, sessions bigint>>, window_days bigint").json(path)
    parts = [doc.select(F.lit("totals").alias("section"), F.explode("totals").alias("name", "value")), doc.select(F.lit("window").alias("section"), F.lit("days").alias("name"), F.col("window_days").alias("value"))]
    for section, name in (("by_stage", "stage"), ("by_face", "face"), ("hunt_families", "family"), ("web_attacks", "web_attack")):
        parts.append(doc.select(F.explode(section).alias("x")).select(F.lit(section).alias("section"), F.col(f"x.{name}").alias("name"), F.col("x.sessions").alias("value")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


add("A15_digest_document", digest_document, WINDOW_SQL + f""",
t AS (SELECT count(*) AS actor_sessions, coalesce(sum(event_count), 0)::BIGINT AS events, coalesce(sum(request_count), 0)::BIGINT AS requests, coalesce(sum(credential_attempts), 0)::BIGINT AS credential_attempts FROM w)
SELECT 'totals' AS section, name, value FROM (UNPIVOT t ON actor_sessions, events, requests, credential_attempts INTO NAME name VALUE value)
UNION ALL SELECT 'window', 'days', {DAYS}
UNION ALL SELECT 'by_stage', stage_reached, count(*) FROM w GROUP BY 2
UNION ALL SELECT 'by_face', f, count(*) FROM (SELECT unnest(faces) AS f FROM w) GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'hunt_families', f, count(*) FROM (SELECT unnest(families) AS f FROM w) GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT {digest.TOP})
UNION ALL SELECT 'web_attacks', f, count(*) FROM (SELECT unnest(web_attacks) AS f FROM w) GROUP BY 2""")


# -- families of forked content (2C)
def forks(spark: SparkSession, d: str) -> DataFrame:
    """For half of the users, what the log calls p005 is a fork of p001 with one page changed."""
    log = derived.log(spark, d)
    forked = (F.col("user_id") % 2 == 0) & F.col("path").startswith("/docs/p005/")
    log = log.withColumns({"fork_of": F.when(forked, "p001"), "content_hash": F.when(forked & (F.col("event_id") % 3 > 0), "h2").otherwise(F.col("content_hash"))})
    return families.fork_families(log)


add("C9_fork_families", forks, LOG + """, f AS (SELECT ts, event_id, bytes, path[7:10] AS project, path LIKE '/docs/p005/%' AND user_id % 2 = 0 AS forked, content_hash AS h FROM log WHERE kind = 'request' AND content_hash IS NOT NULL),
g AS (SELECT *, CASE WHEN forked THEN 'p001' ELSE project END AS family, CASE WHEN forked AND event_id % 3 > 0 THEN 'h2' ELSE h END AS c FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY family, c ORDER BY ts, event_id) AS k FROM g),
m AS (SELECT family, count(*) AS forked_contents FROM (SELECT family, c FROM g GROUP BY 1, 2 HAVING count(DISTINCT project) > 1) GROUP BY 1)
SELECT family, count(*) AS fetches, count(DISTINCT project) AS projects, count(DISTINCT c) AS contents, count(*) FILTER (k > 1) AS copies, coalesce(sum(bytes) FILTER (k > 1), 0)::BIGINT AS copied_bytes, coalesce(any_value(forked_contents), 0) AS forked_contents FROM r LEFT JOIN m USING (family) GROUP BY family""")


# -- published rules and whom they govern (2F)
def governed(spark: SparkSession, d: str) -> DataFrame:
    """Every published rule with the requests of its group's crawler; the others fall to `*`."""
    rules = robots.published_rules(spark)
    named = rules.select(F.col("agent").alias("claimed_crawler")).distinct().where("claimed_crawler <> '*'").withColumn("agent", F.col("claimed_crawler"))
    asked = derived.log(spark, d).where("kind = 'request'").groupBy("claimed_crawler").agg(F.count("*").alias("n")).join(named, "claimed_crawler", "left")
    counts = asked.groupBy(F.coalesce("agent", F.lit("*")).alias("agent")).agg(F.sum("n").alias("requests"))
    return rules.join(counts, "agent", "left").select("group_id", "agent", "directive", "pattern", F.coalesce("requests", F.lit(0)).alias("requests"))


add("F2_published_rules", governed, LOG + """, groups(group_id, agent) AS (VALUES (1, '*'), (2, 'GPTBot'), (3, 'ClaudeBot'), (4, 'CCBot'), (5, 'Google-Extended'), (6, 'Bytespider'), (7, 'PerplexityBot')),
stars(directive, pattern) AS (VALUES ('disallow', '/internal/'), ('disallow', '/private/'), ('disallow', '/reserved/'), ('disallow', '/docs/restricted/'), ('disallow', '/internal/notes/*/handover.html'),
  ('disallow', '/internal/wk/*/index.html'), ('disallow', '/internal/exports/quarterly.html'), ('disallow', '/docs/restricted/index.html'), ('allow', '/public/'), ('allow', '/public/allowed/index.html'), ('allow', '/internal/allowed/*/notice.html')),
r AS (SELECT 1 AS group_id, '*' AS agent, directive, pattern FROM stars UNION ALL SELECT group_id, agent, 'disallow', '/' FROM groups WHERE group_id > 1),
n AS (SELECT coalesce(g.agent, '*') AS agent, count(*) AS n FROM log LEFT JOIN groups g ON g.agent = claimed_crawler WHERE kind = 'request' GROUP BY 1)
SELECT group_id, agent, directive, pattern, coalesce(n, 0)::BIGINT AS requests FROM r LEFT JOIN n USING (agent)""")


# -- planted tokens of a session (2I)
def planted(spark: SparkSession, d: str) -> DataFrame:
    """Hunts are given tokens, of which some come back in requests, one of them twice, one without its text."""
    log = derived.log(spark, d)
    kind = F.element_at(F.array(*map(F.lit, ("aws", "git", "db"))), (F.col("event_id") % 3 + 1).cast("int"))
    token = F.concat(F.lit("T"), (F.col("event_id") % 7).cast("string"))
    issued = F.when((F.col("kind") == "hunt") & (F.col("event_id") % 4 > 0), F.array(F.struct(kind.alias("kind"), token.alias("token"))))
    used = F.when((F.col("kind") == "request") & (F.col("event_id") % 5 == 0), F.array(F.struct(kind.alias("kind"), token.alias("token")), F.struct(F.lit("again").alias("kind"), token.alias("token")), F.struct(F.lit("bare").alias("kind"), F.lit(None).cast("string").alias("token"))))
    s = sessions.sessions(log.withColumns({"honeytokens_issued": issued, "honeytokens": used}))
    return s.select("actor", *(F.array_join(c, ",").alias(c) for c in ("honeytokens_issued", "honeytokens_used", "honeytoken_tokens")), "has_payload")


add("I6_planted_tokens", planted, SESSION_SQL + """, k AS (SELECT actor, kind, event_id, ['aws', 'git', 'db'][event_id % 3 + 1] AS what FROM log WHERE actor IS NOT NULL),
u AS (SELECT actor, array_to_string(list_sort(list(DISTINCT what) FILTER (kind = 'hunt' AND event_id % 4 > 0)), ',') AS issued,
  array_to_string(list_sort(list_distinct(list(what) FILTER (kind = 'request' AND event_id % 5 = 0) || ['again', 'bare'])), ',') AS used, array_to_string(list_sort(list(DISTINCT 'T' || (event_id % 7)) FILTER (kind = 'request' AND event_id % 5 = 0)), ',') AS tokens,
  count(*) FILTER (kind = 'request' AND event_id % 5 = 0) AS n FROM k GROUP BY actor)
SELECT actor, coalesce(issued, '') AS honeytokens_issued, CASE WHEN n > 0 THEN used ELSE '' END AS honeytokens_used, coalesce(tokens, '') AS honeytoken_tokens, has_payload OR n > 0 AS has_payload FROM sess JOIN u USING (actor)""")


# -- days as sketches, and what came late (2S)
def sketched(spark: SparkSession, d: str) -> DataFrame:
    """Windows of three days merged from the sketches of closed days, their count of actors beside the exact one."""
    log = derived.log(spark, d)
    closed = materialise_stream(live.day_sketches(stream_log(spark, d)))
    merged = live.merge_days(closed, 3)
    day = F.date_trunc("day", "ts")
    span = F.sequence(day + F.expr("INTERVAL 1 DAY"), day + F.expr("INTERVAL 3 DAYS"), F.expr("INTERVAL 1 DAY"))
    once = log.select("actor", day.alias("ts")).distinct().join(closed.select(F.col("day").alias("ts")), "ts").select("actor", F.explode(span).alias("until"))
    exact = once.distinct().groupBy("until").agg(F.count("actor").alias("exact"))
    near = F.abs(F.col("actors") - F.col("exact")) <= F.lit(0.08) * F.col("exact")
    return merged.join(exact, "until").where(F.col("since").isNotNull()).select("since", "until", "events", "requests", "credential_attempts", near.alias("near"))


add("S3_day_sketches", sketched, LOG + """, c AS (SELECT kind, date_trunc('day', ts) AS day FROM log WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM log) - INTERVAL 60 MINUTE)
SELECT (u - INTERVAL 3 DAY)::TIMESTAMP AS since, u::TIMESTAMP AS until, count(*) AS events, count(*) FILTER (kind = 'request') AS requests, count(*) FILTER (kind = 'credential') AS credential_attempts, true AS near
FROM (SELECT kind, unnest([day + INTERVAL 1 DAY, day + INTERVAL 2 DAY, day + INTERVAL 3 DAY]) AS u FROM c) GROUP BY u""")


def late_days(spark: SparkSession, d: str) -> DataFrame:
    """Per day the events that come in a later micro-batch than the one that closed the day.

    The log lands in four deliveries by day of month, some events one or two deliveries late.
    """
    root = folder(spark)
    due = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3))
    delivery = F.least(due + F.when(F.col("event_id") % 9 == 0, 1).when(F.col("event_id") % 23 == 0, 2).otherwise(0), F.lit(3)).cast("int")
    log = materialise(derived.log(spark, d).select("ts", delivery.alias("delivery")))
    for n in range(4):
        log.where(F.col("delivery") == n).drop("delivery").coalesce(1).write.mode("append").parquet(f"{root}/in")
        # Each delivery is a micro-batch by itself: the stream is started on what has come.
        stream = spark.readStream.schema("ts timestamp").parquet(f"{root}/in")
        live.count_late(stream, f"{root}/late", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    counts = spark.read.parquet(f"{root}/late").where("day is not null")
    return counts.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.sum("late").alias("late"))


add("S2_late_events", late_days, LOG + """, t AS (SELECT ts, least(least((day(ts) - 1) // 8, 3) + CASE WHEN event_id % 9 = 0 THEN 1 WHEN event_id % 23 = 0 THEN 2 ELSE 0 END, 3) AS b FROM log),
h AS (SELECT b, max(max(ts)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM t GROUP BY b)
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS late FROM t JOIN h USING (b) WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= seen - INTERVAL 60 MINUTE GROUP BY 1""")
