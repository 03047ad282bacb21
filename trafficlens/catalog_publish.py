"""Registered queries of publication (2N) and of the files it writes (2A), on typed events dealt over the table `events`."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import LOG, PROFILE_SQL, SESSION_SQL, add, on_profiles
from .catalog_cases import KEY, PLANTED_AWS, PLANTED_GIT, TRAP_ROBOTS, Case, cases
from .operators import profiles as prof
from .operators import sessions as sess
from .plans import derived, publish
from .shared import materialise, shared_dir
from .sources import sinks

FIELDS = "kind string, path string, raw_query string, headers array<array<string>>, body string, body_encoding string, ip string, user string, password string, verdict string, rdns string, attacked boolean, token string"


def event(kind: str = "request", path: str = "/", query: str | None = None, headers: tuple = (), body: str | None = None, encoding: str = "utf-8", ip: str = "1.1.1.1", user: str | None = None, password: str | None = None, verdict: str | None = None, rdns: str | None = None, attacked: bool = False, token: str | None = None) -> tuple:
    return kind, path, query, [list(h) for h in headers], body, encoding if body is not None else None, ip, user, password, verdict, rdns, attacked, token


def logged(df: DataFrame) -> DataFrame:
    """The dealt events with the fields that publication reads; `attacked` ones carry an attack."""
    attack = F.struct(*(F.lit(x).cast(t).alias(c) for c, x, t in (("cls", "sqli", "string"), ("location", "query", "string"), ("evidence", "x", "string"), ("decoded", False, "boolean"), ("sig", None, "string"), ("cve", None, "string"))))
    return df.withColumns({"seq": F.col("rid").cast("long"), "attacks": F.when(F.col("attacked"), F.array(attack)), "body_sha256": F.sha2("body", 256), "stream": F.lit("events"), "day": F.date_format("ts", "yyyy-MM-dd")})


def on_events(name: str, columns: str, typed: list[Case], find: Callable[[DataFrame], DataFrame]) -> None:
    cases(name, FIELDS, columns, typed, lambda df: find(logged(df)))


def value(k: int = 0) -> Column:
    return F.try_element_at("headers", F.lit(k + 1))[1]


def safe(df: DataFrame) -> DataFrame:
    return publish.sanitize(df, KEY)[0]


def bared(df: DataFrame) -> DataFrame:
    issued = F.array(F.struct(F.lit("api_key").alias("kind"), F.col("token").alias("token")))
    out = publish.drop_token_fields(df.withColumns({"extra_tokens": F.array("token"), "honeytokens_issued": issued, "honeytokens": issued}))
    return out.select("kind", F.to_json("honeytokens_issued").alias("issued"), F.to_json("honeytokens").alias("replayed"), F.lit("token" in out.columns or "extra_tokens" in out.columns).alias("has_token"))


# Planted texts in the shape in which they were served, and pseudonyms under the salt `salt`.
GIT, AWS, SECRET = f"ghp_{PLANTED_GIT.lower()}{'A' * 20}", f"AKIA{PLANTED_AWS}", "XitAS20AaBV2/5nihoSGVrxZGzhMojCRB03Ee4CS"
BASIC, BASIC_HIDDEN = "Basic dTpnaHBfaWFhZnd2MzVucWNuN3djakFBQUFBQUFBQUFBQUFBQUFBQUFB", "Basic dTpbaG9uZXl0b2tlbl0="
BODY, BODY_HIDDEN = "AGdocF9pYWFmd3YzNW5xY243d2NqQUFBQUFBQUFBQUFBQUFBQUFBQUE=", "AFtob25leXRva2VuXQ=="
ANON = {"1.1.1.1": "anon_c58aa3967ab38ccc", "9.9.9.9": "anon_de6887fa099d1066", "2001:db8::1": "anon_1e0ea4cca84be5e5"}
TRAP_PATH, FORGED = f"/internal/notes/{TRAP_ROBOTS}/handover.html", f"ghp_{PLANTED_GIT.lower()[:-1]}b{'A' * 20}"

on_events("N1_drop_tokens", "kind VARCHAR, issued VARCHAR, replayed VARCHAR, has_token BOOLEAN", [(event(token="t1"), [("request", '[{"kind":"api_key"}]', '[{"kind":"api_key"}]', False)]), (event("hunt"), [("hunt", '[{"kind":"api_key"}]', '[{"kind":"api_key"}]', False)])], bared)
on_events("N2_candidates", "found VARCHAR, mark VARCHAR", [
    (event(path=TRAP_PATH), [(TRAP_ROBOTS, "[beacon]")]),
    (event(headers=(("Authorization", BASIC),)), [(GIT, "[honeytoken]")]),
    (event(body=BODY, encoding="base64"), [(GIT, "[honeytoken]")]),
    (event(query=FORGED), []),
], lambda df: publish.issued_tokens(publish._texts(df), KEY))
on_events("N3_redact", "path VARCHAR, raw_query VARCHAR, header VARCHAR, body VARCHAR", [
    (event(path=TRAP_PATH), [("/internal/notes/[beacon]/handover.html", None, None, None)]),
    (event(query=f"k={GIT}", headers=(("Authorization", BASIC),)), [("/", "k=[honeytoken]", BASIC_HIDDEN, None)]),
    (event(body=BODY, encoding="base64"), [("/", None, None, BODY_HIDDEN)]),
    (event(query=FORGED, headers=(("X", "B" * 26),)), [("/", FORGED, "B" * 26, None)]),
], lambda df: safe(df).select("path", "raw_query", value().alias("header"), "body"))
on_events("N4_paired_secret", "raw_query VARCHAR, body VARCHAR", [
    (event(query=f"id={AWS}", body=f"secret={SECRET}"), [("id=[honeytoken]", "secret=[honeytoken]")]),
    (event(body=f"secret={SECRET}"), [(None, f"secret={SECRET}")]),
], lambda df: safe(df).select("raw_query", "body"))
on_events("N5_fail_closed", "path VARCHAR", [(event(path=f"/%67{GIT[1:]}"), []), (event(path=f"/{GIT}"), [("/[honeytoken]",)]), (event(path=f"/%67{FORGED[1:]}"), [(f"/%67{FORGED[1:]}",)])], lambda df: safe(df).select("path"))
on_events("N6_pseudonyms", "ip VARCHAR", [(event(ip=ip), [(anon,)]) for ip, anon in ANON.items()], lambda df: publish.anonymize(df, "salt").select("ip"))
on_events("N7_forwarded", "header VARCHAR", [
    (event(headers=(("X-Forwarded-For", "9.9.9.9, unknown, 1.1.1.1"),)), [(f"{ANON['9.9.9.9']}, unknown, {ANON['1.1.1.1']}",)]),
    (event(headers=(("X-Real-IP", "2001:db8::1"),)), [(ANON["2001:db8::1"],)]),
    (event(headers=(("X-Other", "9.9.9.9"),)), [("9.9.9.9",)]),
    (event(headers=(("CF-Connecting-IP", "999.1.1.1"),)), [("999.1.1.1",)]),
], lambda df: publish.anonymize(df, "salt").select(value().alias("header")))
on_events("N8_private_requests", "header VARCHAR, body VARCHAR, hashed BOOLEAN", [
    (event(headers=(("Cookie", "c=1"),), body="b"), [("[redacted]", None, False)]),
    (event(headers=(("Cookie", "c=1"),), body="b", attacked=True), [("c=1", "b", True)]),
    (event(headers=(("Accept", "x"),)), [("x", None, False)]),
], lambda df: publish.anonymize(df, "salt").select(value().alias("header"), "body", F.col("body_sha256").isNotNull().alias("hashed")))


def shared_ids(df: DataFrame) -> DataFrame:
    """Each event's credential belongs to the request of the same rid, an attack or none."""
    asked = df.withColumns({"kind": F.lit("request"), "seq": -F.col("seq") - 1})
    out = publish.anonymize(df.withColumn("attacks", F.lit(None).cast(df.schema["attacks"].dataType)).unionByName(asked), "salt")
    return out.where("kind = 'credential'").select(F.col("user").alias("account"), "password")


on_events("N10_private_credentials", "account VARCHAR, password VARCHAR", [
    (event("credential", user="u", password="p"), [("[redacted]", "[redacted]")]),
    (event("credential", user="u", password="p", attacked=True), [("u", "p")]),
    (event("credential", password="p"), [(None, "[redacted]")]),
], shared_ids)
on_events("N11_reverse_names", "verdict VARCHAR, rdns VARCHAR", [(event("identity", verdict=v, rdns="home.test"), [(v, "home.test" if v == "verified" else None)]) for v in ("verified", "impersonating", "unverifiable")], lambda df: publish.anonymize(df, "salt").select("verdict", "rdns"))


# -- files (2A)
def days(spark: SparkSession, d: str) -> DataFrame:
    return derived.log(spark, d).select("event_id", "kind", "status", F.lit("events").alias("stream"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


def written(spark: SparkSession, d: str) -> str:
    root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    sinks.write_published(days(spark, d), root)
    return root


def published(spark: SparkSession, d: str) -> DataFrame:
    read = spark.read.schema("event_id bigint, kind string, status int, stream string, day string").json(written(spark, d))
    return read.groupBy("stream", "day", "kind").agg(F.count("*").alias("n"), F.count("status").alias("with_status"))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """One entry a day: its rows, and whether its files were found and hashed."""
    root, rows = written(spark, d), materialise(days(spark, d).groupBy("stream", "day").agg(F.count("*").alias("rows")))
    found = sinks.published_days(spark, root, [(r["stream"], r["day"]) for r in rows.collect()])
    new = rows.join(found, ["stream", "day"], "left").withColumns({"malformed": F.lit(0), "dropped": F.lit(0)})
    out = sinks.update_manifest(spark.createDataFrame([], sinks.MANIFEST), new, datetime(2024, 1, 20))
    return out.select("stream", "day", F.col("rows").cast("long").alias("rows"), ((F.col("bytes") > 0) & (F.length("sha256") == 64)).alias("hashed"))


add("A8_published_days", published, LOG + "SELECT 'events' AS stream, strftime(ts, '%Y-%m-%d') AS day, kind, count(*) AS n, count(status) AS with_status FROM log GROUP BY ALL")
add("A9_manifest", manifest, LOG + "SELECT 'events' AS stream, strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows, true AS hashed FROM log GROUP BY ALL")
of = lambda name, kind: F.get_json_object("json", f"$.{name}").cast(kind).alias(name)
add("A12_profiles_json", on_profiles(lambda p: prof.profiles_json(p).select("client_ua", "client_claimed", of("requests", "long"), of("state", "string"))), PROFILE_SQL + "SELECT client_ua, client_claimed, requests, state FROM prof")


def session_documents(spark: SparkSession, d: str) -> DataFrame:
    log = derived.log(spark, d)
    return sess.sessions_json(sess.sessions(log), log).select("actor", of("event_count", "long"), of("stage_reached", "string"))


add("A13_sessions_json", session_documents, SESSION_SQL + "SELECT actor, event_count, stage_reached FROM sess")
