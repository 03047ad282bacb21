"""The public copy of the log: planted tokens out, people hidden, days written once."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as fixed
from ..functions import keyed
from ..functions.decode import latin1, url_layers
from ..operators import attacks
from ..shared import materialise, sized
from ..sources import log as source
from ..sources import sinks

ADDRESS = r"[0-9A-Fa-f:.]{3,45}"
IPV4 = r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def drop_token_fields(log: DataFrame) -> DataFrame:
    """Without tokens: issued ones keep their kind only, replays lose the token."""
    out = log.drop("token", "extra_tokens")
    if "honeytokens_issued" in log.columns:
        out = out.withColumn("honeytokens_issued", F.transform("honeytokens_issued", lambda h: F.struct(h["kind"].alias("kind"))))
    if "honeytokens" in log.columns:
        out = out.withColumn("honeytokens", F.transform("honeytokens", lambda h: h.dropFields("token")))
    return out


def _basic(value: Column) -> Column:
    """The credentials of a Basic value, else null."""
    return F.when(F.lower(value).startswith("basic "), latin1(F.try_to_binary(F.trim(F.substr(value, F.lit(7))), F.lit("base64"))))


def _body(log: DataFrame) -> Column:
    return F.when(F.col("body_encoding") == "base64", latin1(F.try_to_binary("body", F.lit("base64"))))


def _fields(log: DataFrame) -> list[str]:
    return [c for c in log.columns if c not in ("seq", "raw", "line")]


def _texts(log: DataFrame) -> DataFrame:
    """seq, text: the event as JSON, and what its encoded parts say."""
    fields = _fields(log)
    basic = F.coalesce(F.filter(F.transform("headers", lambda h: _basic(h[1])), lambda t: t.isNotNull()), F.array().cast("array<string>"))
    return log.select("seq", F.explode(F.concat(F.array(F.to_json(F.struct(*fields)), F.coalesce(_body(log), F.lit(""))), basic)).alias("text"))


def issued_tokens(texts: DataFrame, key: bytes) -> DataFrame:
    """(seq, text) -> seq, found, mark: each planted string of the texts, verified under the key.

    Only distinct candidates are verified; the secret that was served beside an access-key id counts wherever its id is.
    """
    traps = F.transform(F.regexp_extract_all("text", F.lit(fixed.TRAP_TOKEN), F.lit(1)), lambda f: F.struct(F.lit(True).alias("trap"), f.alias("found")))
    shape = lambda p, literal: F.when(F.col("text").contains(literal), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>"))
    shapes = F.transform(F.flatten(F.array(*map(shape, fixed.PLANTED, fixed.PLANTED_LITERALS))), lambda f: F.struct(F.lit(False).alias("trap"), f.alias("found")))
    # The texts are read once; what follows goes by the candidates that were written.
    each = materialise(texts.select("seq", F.explode(F.array_distinct(F.concat(traps, shapes))).alias("c")).select("seq", "c.trap", "c.found"))
    minted = each.where("trap").select("found").distinct().withColumn("t", keyed.verify_trap(key)("found")).where("t.standard is not null")
    minted = minted.select(F.lit(True).alias("trap"), "found", F.lit(fixed.TRAP_MARK).alias("mark"), F.lit(None).cast("string").alias("secret"))
    payload = F.coalesce(*(F.nullif(F.regexp_extract("found", p, 1), F.lit("")) for p in fixed.PLANTED))
    known = each.where("not trap").select("found").distinct().withColumn("t", keyed.verify_planted(key)(payload)).where("t.kind is not null")
    known = known.select(F.lit(False).alias("trap"), "found", F.lit(fixed.PLANTED_MARK).alias("mark"), "t.secret")
    verified = materialise(minted.union(known))
    hits = each.join(sized(verified, "found"), ["trap", "found"])
    told = F.filter(F.array("found", "secret"), lambda f: f.isNotNull())
    return hits.select("seq", F.explode(told).alias("found"), "mark").distinct()


def token_lists(tokens: DataFrame) -> DataFrame:
    """A written table: seq and all its tokens with their marks."""
    return materialise(tokens.groupBy("seq").agg(F.collect_list(F.struct("found", "mark")).alias("__t")))


def redact(log: DataFrame, lists: DataFrame) -> DataFrame:
    """Replaces each event's tokens (token_lists()) everywhere: in plain strings, inside Basic values and inside base64
    bodies, which are encoded again.  Look-alikes that were not minted stay."""
    both = log.join(sized(lists), "seq", "left")
    clean = lambda text: F.aggregate("__t", text, lambda acc, t: F.replace(acc, t["found"], t["mark"]))
    again = lambda text: F.base64(F.encode(text, "ISO-8859-1"))
    has = F.col("__t").isNotNull()

    def pair(h: Column) -> Column:
        plain = _basic(h[1])
        return F.when(plain.isNotNull() & (clean(plain) != plain), F.array(h[0], F.concat(F.lit("Basic "), again(clean(plain))))).otherwise(h)

    plain = _body(log)
    both = both.withColumn("headers", F.when(has, F.transform("headers", pair)).otherwise(F.col("headers")))
    both = both.withColumn("body", F.when(has & plain.isNotNull() & (clean(plain) != plain), again(clean(plain))).otherwise(F.col("body")))
    fields = _fields(log)
    # The rest of the event is plain strings: replaced in its JSON, which is read back in the same types.
    doc = F.when(has, F.from_json(clean(F.to_json(F.struct(*fields))), log.select(*fields).schema))
    both = both.withColumn("__d", doc)
    return both.select("seq", *(F.when(has, F.col(f"__d.{c}")).otherwise(F.col(c)).alias(c) for c in fields))


def drop_leaks(log: DataFrame, key: bytes, redacted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, leaks): an event of which any percent-decoded layer still holds a planted token is left out.

    `redacted` (a written table of seq) tells the events that were changed since their texts were searched; of the others
    only what decoding makes of the texts is searched, as the texts themselves held nothing.
    """
    texts = _texts(log).where("text <> ''")
    layers = url_layers(F.col("text"))
    if redacted is not None:
        texts = texts.join(sized(redacted.select("seq", F.lit(True).alias("changed"))), "seq", "left")
        layers = F.when(F.col("changed"), layers).when(F.col("text").contains("%"), F.slice(layers, F.lit(2), F.size(layers))).otherwise(F.array().cast("array<string>"))
    layers = texts.select("seq", F.explode(layers).alias("text"))
    leaks = materialise(issued_tokens(layers, key).select("seq").distinct())
    return log.join(sized(leaks), "seq", "left_anti"), leaks


def anonymize(log: DataFrame, salt: str) -> DataFrame:
    """Addresses become pseudonyms, also in forwarding headers.  A request that is no attack loses its credentials and
    body; a credential event that belongs to no attack loses user and password; reverse names stay only if verified."""
    name = keyed.address_pseudonym(salt)
    attack = log.where((F.col("kind") == "request") & (F.size("attacks") > 0) & F.col("rid").isNotNull()).select(F.col("rid").alias("r")).distinct()
    both = log.join(attack.withColumn("__attack", F.lit(True)), F.col("rid") == F.col("r"), "left").drop("r")
    request, credential = F.col("kind") == "request", F.col("kind") == "credential"
    private = (request & ~F.coalesce(F.size("attacks") > 0, F.lit(False))) | (credential & F.col("__attack").isNull())
    both = both.withColumn("__private", F.coalesce(private, F.lit(False)))

    # Addresses in forwarding headers: distinct ones are named once, then replaced per event.
    forwarding = lambda h: F.lower(h[0]).isin(*fixed.ADDRESS_HEADERS)
    each = both.select("seq", F.explode(F.filter("headers", forwarding)).alias("h")).select("seq", F.explode(F.regexp_extract_all(F.col("h")[1], F.lit(ADDRESS), F.lit(0))).alias("ip")).distinct()
    is_address = F.col("ip").rlike(f"^{IPV4}$") | (F.col("ip").contains(":") & F.try_parse_url(F.concat(F.lit("http://["), "ip", F.lit("]/")), F.lit("HOST")).isNotNull())
    named = each.select("ip").distinct().where(is_address).withColumn("anon", name("ip"))
    maps = each.join(named, "ip").groupBy("seq").agg(F.map_from_entries(F.collect_list(F.struct("ip", "anon"))).alias("__names"))
    both = both.join(maps, "seq", "left")

    def rename(value: Column) -> Column:
        tokens = F.regexp_extract_all(value, F.lit(ADDRESS), F.lit(0))
        gaps = F.split(value, ADDRESS, -1)
        shown = F.transform(tokens, lambda t: F.coalesce(F.try_element_at("__names", t), t))
        return F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(tokens)), shown, lambda g, t: F.concat(g, t)), ""), F.element_at(gaps, -1))

    def hide(h: Column) -> Column:
        value = F.when(forwarding(h), F.when(F.col("__names").isNotNull(), rename(h[1])).otherwise(h[1])).when(F.col("__private") & F.lower(h[0]).isin(*fixed.PRIVATE_HEADERS), F.lit(fixed.REDACTED)).otherwise(h[1])
        return F.array(h[0], value)

    gone = lambda c: F.when(F.col("__private") & request, F.lit(None)).otherwise(F.col(c))
    secret = lambda c: F.when(F.col("__private") & credential & F.col(c).isNotNull(), F.lit(fixed.REDACTED)).otherwise(F.col(c))
    rdns = F.when((F.col("kind") == "identity") & ~F.coalesce(F.col("verdict") == "verified", F.lit(False)), F.lit(None)).otherwise(F.col("rdns"))
    out = both.withColumns({"ip": name("ip"), "headers": F.transform("headers", hide), "rdns": rdns, "user": secret("user"), "password": secret("password")} | {c: gone(c) for c in ("body", "body_sha256", "body_encoding")})
    return out.drop("__attack", "__private", "__names")


def sanitize(log: DataFrame, key: bytes) -> tuple[DataFrame, DataFrame]:
    """(safe events, leaks)."""
    bare = materialise(drop_token_fields(log))
    lists = token_lists(issued_tokens(_texts(bare), key))
    # Events without tokens stay as they are; if none has any, they are not written again.
    clean = bare.select("seq", *_fields(bare)) if lists.isEmpty() else materialise(redact(bare, lists))
    return drop_leaks(clean, key, lists)


def publish(spark: SparkSession, src: str, dst: str, manifest: DataFrame, key: bytes, salt: str, now: datetime, lag_minutes: int = 60, opened: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Publishes the finished days of src that the manifest lacks, and returns the new manifest (to be written last).

    `opened` may look at the events before they are hidden.  Days are known by stream and day; running twice publishes
    nothing twice, also after a run that was lost between its data and its manifest: a day's folder is replaced whole.
    A day of which no event is left has an entry without a path.  The archive's earlier days are not read, nor are lines of
    other days parsed.
    """
    files = materialise(source.pending_days(source.day_files(spark, src), manifest, now, lag_minutes))
    if files.isEmpty():
        return manifest.orderBy("stream", "day")
    raw = F.col("raw")
    every = source.parse(source.lines_of(spark, src, files))
    every = materialise(every.withColumns({"__missing": source.lacks(raw, "attacks"), "__event": source.is_event(raw), "__malformed": source.is_malformed(raw, F.col("line"))}).drop("raw", "line"))
    bad = every.where("not __event").groupBy("seq.file").agg(F.count_if("__malformed").alias("malformed"), F.count_if(~F.col("__malformed")).alias("not_events"))
    log = every.where("__event").drop("__event", "__malformed")
    log = attacks.backfill(log, F.col("__missing")).drop("__missing")
    if opened is not None:
        log = opened(log)
    safe, leaks = sanitize(log, key)
    public = materialise(anonymize(safe, salt))
    sinks.write_published(public.drop("seq"), dst)
    rows = public.groupBy("stream", "day").agg(F.count("*").alias("rows"))
    lost = leaks.select(F.col("seq.file").alias("file")).groupBy("file").agg(F.count("*").alias("leaked"))
    counts = files.join(bad, "file", "left").join(lost, "file", "left").groupBy("stream", "day").agg(F.coalesce(F.sum("malformed"), F.lit(0)).alias("malformed"), (F.coalesce(F.sum("leaked"), F.lit(0)) + F.coalesce(F.sum("not_events"), F.lit(0))).alias("dropped"))
    rows = materialise(rows)
    days = [(r["stream"], r["day"]) for r in rows.select("stream", "day").collect()]
    new = counts.join(rows, ["stream", "day"], "left").join(sinks.published_days(spark, dst, days), ["stream", "day"], "left").fillna(0, ["rows", "bytes"])
    return sinks.update_manifest(manifest, new, now)


def publish_run(spark: SparkSession, src: str, dst: str, run: str, key: bytes, salt: str, now: datetime, lag_minutes: int = 60) -> DataFrame:
    """The daily job in two phases: the days that no earlier run has committed go to dst/runs/<run>, then the run's entries
    of the manifest to dst/commits/<run>, which makes them public.  Returns the manifest.

    A run that is lost before its commit has published nothing: its folder is no one's (`unfinished`), and the days come
    with the next run.  A run repeated under its own name replaces its folder, but a committed run is not run again.
    """
    known = materialise(committed(spark, dst))
    if not _exists(spark, f"{dst}/commits/{run}/_SUCCESS"):
        entries = publish(spark, src, f"{dst}/runs/{run}", known, key, salt, now, lag_minutes)
        commit_run(entries.join(known.select("stream", "day"), ["stream", "day"], "left_anti"), dst, run)
    return committed(spark, dst)


def commit_run(entries: DataFrame, dst: str, run: str) -> None:
    """The second phase: one file of a line per stream and day, in its place by one rename."""
    entries.coalesce(1).sortWithinPartitions("stream", "day").write.mode("overwrite").option("ignoreNullFields", "false").json(f"{dst}/commits/{run}")


def committed(spark: SparkSession, dst: str) -> DataFrame:
    """The manifest: the entries of all runs that were committed."""
    runs = [r for r in _children(spark, f"{dst}/commits") if _exists(spark, f"{dst}/commits/{r}/_SUCCESS")]
    reader = spark.read.schema(sinks.MANIFEST)
    return reader.json([f"{dst}/commits/{r}" for r in runs]) if runs else spark.createDataFrame([], sinks.MANIFEST)


def read_published(spark: SparkSession, dst: str, schema: str) -> DataFrame:
    """The public events, with stream and day: of committed runs alone, and of these the folders that the manifest names."""
    folders = [r["path"] for r in committed(spark, dst).where("path is not null").select("path").collect()]
    whole = f"{schema}, stream string, day string"
    # The folders lie under several runs, so the partition columns are read off the path.
    place = lambda name: F.regexp_extract(F.col("_metadata.file_path"), f"/{name}=([^/]*)/", 1).alias(name)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(folders).select("*", place("stream"), place("day")) if folders else spark.createDataFrame([], whole)


def unfinished(spark: SparkSession, dst: str) -> list[str]:
    """Runs that left data and no commit: lost, or still going on."""
    return [r for r in _children(spark, f"{dst}/runs") if not _exists(spark, f"{dst}/commits/{r}/_SUCCESS")]


def discard(spark: SparkSession, dst: str, run: str) -> None:
    """Deletes the data of a run that was lost before its commit."""
    if run not in unfinished(spark, dst):
        raise ValueError(f"{run} is no unfinished run")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{dst}/runs/{run}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of one entry a run; none if there is no such folder."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(there)) if fs.exists(there) else []
