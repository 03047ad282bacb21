"""One row per actor: how far it came, from first contact to payload."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import rules as fixed
from ..functions import match
from .profiles import truthy

#: Pairs of an actor that a short list of them shows.
PAIRS = 100


def stage_rank(stage: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, fixed.STAGES)), stage) - 1


def with_time(log: DataFrame) -> DataFrame:
    """ts as a timestamp; what can't be read is null."""
    return log if dict(log.dtypes)["ts"] == "timestamp" else log.withColumn("ts", F.try_to_timestamp("ts"))


def sessions(log: DataFrame) -> DataFrame:
    """One row per actor; events without an actor are skipped.  Fields that the log lacks count as null."""
    log = with_time(log).where("actor is not null and actor <> ''")
    has = set(log.columns)
    col = lambda name, kind="string": F.col(name) if name in has else F.lit(None).cast(kind)
    kind = F.col("kind")
    hunt, request = kind == "hunt", kind == "request"
    values = lambda name, when=F.lit(True): F.array_sort(F.collect_set(F.when(when, F.nullif(col(name), F.lit("")))))
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    yes = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    base = log.groupBy("actor").agg(
        F.min_by(col("actor_basis"), F.when(col("actor_basis").isNotNull(), F.col("seq"))).alias("actor_basis"),
        F.count("*").alias("event_count"),
        F.count_if(request).alias("request_count"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        *(values(c).alias(n) for c, n in (("ip", "ips"), ("ja4", "ja4s"), ("ua", "user_agents"), ("operator", "operators"), ("claimed_crawler", "claimed_crawlers"), ("face", "faces"), ("sensor", "sensors"), ("header_order_hash", "header_orders"))),
        values("standard", kind == "policy_read").alias("standards_read"),
        values("standard", (kind == "trap_hit") & col("disallowed", "boolean")).alias("standards_mined"),
        values("family", hunt).alias("families"),
        values("category", hunt).alias("hunt_categories"),
        values("web_attack", hunt).alias("web_attacks"),
        yes(hunt & col("decoy_served", "boolean")).alias("decoy_served"),
        yes(hunt & col("stage", "boolean")).alias("walked_multistage"),
        every(col("mitre", "array<string>")).alias("mitre"),
        F.count_if(kind == "credential").alias("credential_attempts"),
    )
    parts = [base]
    if "honeytokens_issued" in has:
        parts.append(log.groupBy("actor").agg(every(F.when(hunt, F.transform("honeytokens_issued", lambda h: h["kind"]))).alias("honeytokens_issued"), every(F.when(request, F.transform("honeytokens", lambda h: h["kind"]))).alias("honeytokens_used"), every(F.when(request, F.filter(F.transform("honeytokens", lambda h: h["token"]), lambda t: t.isNotNull()))).alias("honeytoken_tokens")))
    if "attacks" in has:
        requests = log.where(request)
        classes = requests.select("actor", F.explode(F.array_distinct(F.transform("attacks", lambda a: a["cls"]))).alias("k")).groupBy("actor", "k").agg(F.count("*").alias("n"))
        parts.append(classes.groupBy("actor").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("attack_classes")))
        parts.append(requests.groupBy("actor").agg(every(F.filter(F.transform("attacks", lambda a: a["cve"]), lambda c: c.isNotNull())).alias("cves"), every(F.transform("tools", lambda t: t["name"])).alias("tools"), every("oast").alias("oast"), F.array_sort(F.collect_set(F.when(F.size("attacks") > 0, F.col("body_sha256")))).alias("attack_body_hashes")))
    if "indicators" in has:
        told = log.where(request | hunt)
        flags = F.filter(F.array(F.when(truthy("indicators.jndi"), "log4shell"), F.when(F.col("indicators.shellshock"), "shellshock"), F.when(F.col("indicators.metadata_ssrf"), "metadata_ssrf")), lambda e: e.isNotNull())
        parts.append(told.groupBy("actor").agg(every("indicators.pools").alias("pools"), every("indicators.urls").alias("payload_urls"), every("indicators.miners").alias("miners"), every(flags).alias("exploits")))
        wallets = told.select("actor", F.explode("indicators.wallets").alias("chain", "found")).groupBy("actor", "chain").agg(every("found").alias("found"))
        parts.append(wallets.groupBy("actor").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chain", "found")))).alias("wallets")))
    # All parts have a row per actor and are dealt by actor already; by the size of a written log's files Spark would send them.
    out = reduce(lambda a, b: a.join(b.hint("merge"), "actor", "left"), parts)
    blank = {"attack_classes": "map<string,bigint>", "wallets": "map<string,array<string>>"} | dict.fromkeys(("cves", "tools", "oast", "attack_body_hashes", "pools", "payload_urls", "miners", "exploits", "honeytokens_issued", "honeytokens_used", "honeytoken_tokens"), "array<string>")
    for name, shape in blank.items():
        nothing = F.create_map().cast(shape) if shape.startswith("map") else F.array().cast(shape)
        out = out.withColumn(name, F.coalesce(name, nothing) if name in out.columns else nothing)
    some = lambda *names: reduce(Column.__or__, (F.size(n) > 0 for n in names))
    payload = some("wallets", "pools", "payload_urls", "miners", "attack_classes", "honeytokens_used") | (F.col("credential_attempts") > 0) | F.arrays_overlap("web_attacks", F.array(F.lit("sqli"), F.lit("php_rce_attempt")))
    stage = F.when(F.col("has_payload"), "payload").when(F.col("walked_multistage"), "followup").when(F.col("decoy_served"), "decoy_served").when(some("families", "web_attacks"), "probed").otherwise("seen")
    seconds = (F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 1e6
    return out.withColumn("has_payload", payload).withColumns({"stage_reached": stage, "duration_s": F.coalesce(seconds, F.lit(0.0))})


def credential_pairs(log: DataFrame, most: int | None = None) -> DataFrame:
    """actor, user, password, first: the distinct pairs that an actor tried; with `most` the first ones in log order."""
    tried = log.where("kind = 'credential' and actor is not null and actor <> ''").groupBy("actor", "user", "password").agg(F.min("seq").alias("first"))
    return tried if most is None else tried.withColumn("k", F.row_number().over(W.partitionBy("actor").orderBy("first"))).where(F.col("k") <= most).drop("k")


def timeline(log: DataFrame, actor: str | None = None) -> DataFrame:
    """actor, seq, ts, kind, face, method, path, tag: one step per event, to be sorted by (actor, seq)."""
    log = log.where("actor is not null and actor <> ''") if actor is None else log.where(F.col("actor") == actor)
    has = set(log.columns)
    col = lambda name: F.col(name) if name in has else F.lit(None).cast("string")
    step = match.tag(col("web_attack"), col("standard"), col("family"), col("resource"), col("scheme"))
    return log.select("actor", "seq", "ts", "kind", col("face").alias("face"), col("method").alias("method"), "path", step.alias("tag"))


def filter_sessions(s: DataFrame, actor: str | None = None, has_payload: bool = False, min_stage: str | None = None, since: str | None = None) -> DataFrame:
    if actor is not None:
        s = s.where(F.col("actor") == actor)
    if has_payload:
        s = s.where("has_payload")
    if min_stage is not None:
        s = s.where(stage_rank(F.col("stage_reached")) >= fixed.STAGES.index(min_stage))
    return s if since is None else s.where(F.col("last_seen") >= F.to_timestamp(F.lit(since)))


def rank_sessions(s: DataFrame) -> DataFrame:
    return s.orderBy(stage_rank(F.col("stage_reached")).desc(), F.col("event_count").desc(), "actor")


def by_stage(s: DataFrame) -> DataFrame:
    """stage, sessions; stages that nobody reached have 0."""
    spark: SparkSession = s.sparkSession
    stages = spark.createDataFrame([(x,) for x in fixed.STAGES], "stage string")
    return stages.join(s.select(F.col("stage_reached").alias("stage"), "actor"), "stage", "left").groupBy("stage").agg(F.count("actor").alias("sessions"))


def sessions_json(s: DataFrame, log: DataFrame) -> DataFrame:
    """One JSON document per actor, with its timeline in log order; for actors of bounded length."""
    steps = timeline(log).groupBy("actor").agg(F.array_sort(F.collect_list(F.struct("seq", "ts", "kind", "face", "method", "path", "tag"))).alias("t"))
    steps = steps.select("actor", F.transform("t", lambda x: x.dropFields("seq")).alias("timeline"))
    whole = s.withColumn("duration_s", F.round("duration_s", 1)).join(steps, "actor", "left")
    return whole.select("actor", F.to_json(F.struct(*whole.columns), {"ignoreNullFields": "false"}).alias("json"))
