"""Operator 4: URL filters.

Pattern rules are indexed by their rarest literal token; the tokens of a URL fetch candidate rules, and only those run
their regular expression.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: The index is sent to every executor up to this many rules; beyond it, it is joined by shuffle.
BROADCAST_RULES = 20_000
#: A URL of at least so many pages, or one in so many of all, is hot: at most HOT_SHARE URLs are.
HOT_PAGES, HOT_SHARE = 100_000, 10_000


@dataclass(frozen=True)
class Rule:
    """Fits `host` and its subdomains where the URL's path starts with `path`; `*` in the path stands for any run."""

    action: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        host = rf"(?:[^/]*\.)?{re.escape(self.host)}" if self.host else "[^/]*"
        return f"^{host}{'.*'.join(map(re.escape, self.path.split('*')))}"

    @property
    def tokens(self) -> list[str]:
        """Literals that every fitting URL holds as whole tokens: host labels, and path segments that end in the rule."""
        whole = self.path.split("/")[1:-1] if self.path.startswith("/") else []
        return [f"h:{x}" for x in self.host.split(".") if x] + [f"p:{x}" for x in whole if x and "*" not in x]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty when the URL is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(F.array(F.lit("")), labels, segments))


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url", hot_pages: int = HOT_PAGES) -> DataFrame:
    """One row per page: id, host, path, rule, verdict.  The longest fitting rule wins (ties: the smaller name); without
    one, rule is null and the verdict is `default`, as this method has no opinion on a URL that no pattern fits.

    Nulls: a null URL or one without `://` has an empty host and path, which only rules with neither can fit.  Repeated
    rows are each judged.  An empty table gives an empty result.  Other columns of the input are not read, whatever their
    names.  A URL of any length is read whole.  Rules meet distinct URLs; the verdicts of hot URLs (such as the empty one
    of all null and scheme-less URLs) are sent to all executors, the others' are joined by URL.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col))
    pages = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    urls = pages.groupBy("host", "path").agg(F.count("*").alias("n"))
    tokens = urls.select("host", "path", "n", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))

    known = sorted({t for r in rules for t in r.tokens})
    seen = {t: 0 for t in known}
    if known:  # as many rows come back as the rules have tokens
        wanted = spark.createDataFrame([(t,) for t in known], "token string")
        wanted = F.broadcast(wanted) if len(rules) <= BROADCAST_RULES else wanted
        seen |= {r["token"]: r["n"] for r in tokens.join(wanted, "token").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    rows = [(min(r.tokens, key=lambda t: (seen[t], t), default=""), r.name, r.action, r.pattern, len(r.name)) for r in rules]
    index = spark.createDataFrame(rows, "token string, rule string, action string, pattern string, length int")
    if len(rows) <= BROADCAST_RULES:
        index = F.broadcast(index)

    found = (
        tokens.join(index, "token")
        .where(F.expr("concat(host, path) rlike pattern"))
        .groupBy("host", "path")
        .agg(F.min_by(F.struct("rule", "action"), F.struct(-F.col("length"), F.col("rule"))).alias("hit"))
    )
    keys, n = ["host", "path"], pages.count()
    hot = F.broadcast(materialise(urls.where(F.col("n") >= max(hot_pages, n // HOT_SHARE)).drop("n").join(found, keys, "left")))
    judged = pages.join(hot, keys).unionByName(pages.join(hot.drop("hit"), keys, "left_anti").join(found, keys, "left"))
    return judged.select(id_col, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.action", F.lit(default)).alias("verdict"))


#: The rules of the registered query (fixed values).
RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


OP4_SQL = r"""
WITH r(action, host, path) AS (VALUES ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'),
  ('block','net','/es/'), ('block','net','/fr/')),
a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS k FROM a),
f AS (SELECT k, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(action, length(r.host || r.path)) AS action
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN f USING (k)
"""
