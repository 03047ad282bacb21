"""The digest: what the sessions of the last days show."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sessions import stage_rank

TOP = 15


def in_window(s: DataFrame, now: datetime, days: int) -> DataFrame:
    """Sessions last seen within the days before now; the moment itself counts."""
    return s.where(F.col("last_seen") >= F.lit(now) - F.make_dt_interval(F.lit(days)))


def totals(w: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return w.agg(F.count("*").alias("actor_sessions"), total("event_count").alias("events"), total("request_count").alias("requests"), total("credential_attempts").alias("credential_attempts"))


def by_stage(w: DataFrame) -> DataFrame:
    return w.groupBy(F.col("stage_reached").alias("stage")).agg(F.count("*").alias("sessions"))


def _counted(w: DataFrame, c: str, name: str) -> DataFrame:
    return w.select(F.explode(c).alias(name)).groupBy(name).agg(F.count("*").alias("sessions"))


def by_face(w: DataFrame) -> DataFrame:
    return _counted(w, "faces", "face")


def families(w: DataFrame) -> DataFrame:
    return _counted(w, "families", "family").orderBy(F.col("sessions").desc(), "family").limit(TOP)


def web_attacks(w: DataFrame) -> DataFrame:
    return _counted(w, "web_attacks", "web_attack")


def indicators(w: DataFrame) -> DataFrame:
    """type, value: the union over the window; the first payload URLs only."""
    long = lambda c, kind: w.select(F.lit(kind).alias("type"), F.explode(c).alias("value")).distinct()
    wallets = w.select(F.explode("wallets").alias("chain", "found")).select(F.concat_ws(":", F.lit("wallet"), "chain").alias("type"), F.explode("found").alias("value")).distinct()
    urls = long("payload_urls", "url").orderBy("value").limit(TOP)
    return wallets.unionByName(long("pools", "pool")).unionByName(urls).unionByName(long("miners", "miner")).unionByName(long("mitre", "mitre"))


def follow_up(w: DataFrame) -> DataFrame:
    """The furthest sessions beyond plain reconnaissance."""
    hard = (F.size("wallets") > 0) | (F.size("pools") > 0) | (F.size("payload_urls") > 0) | (F.size("miners") > 0)
    far = w.where(stage_rank(F.col("stage_reached")) >= 2).orderBy(stage_rank(F.col("stage_reached")).desc(), F.col("event_count").desc(), "actor").limit(TOP)
    return far.select("actor", F.col("stage_reached").alias("stage"), F.col("actor_basis").alias("basis"), "ips", "families", "web_attacks", hard.alias("indicators"), "credential_attempts", "first_seen", "last_seen", F.slice("user_agents", 1, 3).alias("user_agents"))


def digest(w: DataFrame, now: datetime, days: int) -> DataFrame:
    """One row with the sections as columns, to be written as one JSON document."""
    out = totals(w).select(F.struct("*").alias("totals"))
    for name, part in (("by_stage", by_stage(w)), ("by_face", by_face(w)), ("hunt_families", families(w)), ("web_attacks", web_attacks(w)), ("indicators", indicators(w)), ("follow_up", follow_up(w))):
        out = out.crossJoin(part.agg(F.array_sort(F.collect_list(F.struct("*"))).alias(name)))
    return out.withColumns({"generated_at": F.lit(now.isoformat()), "window_days": F.lit(days)})
