"""Content that is fetched more than once under other names: copies by hash, and families of forked projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The project of a page's path.
PROJECT = r"^/docs/(p\d+)/"


def project_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, PROJECT, 1), F.lit(""))


def family_of(path: Column, fork_of: Column) -> Column:
    """A fork belongs to the project that it was forked from, any other page to its own."""
    return F.coalesce(F.nullif(fork_of, F.lit("")), project_of(path))


def fork_families(log: DataFrame) -> DataFrame:
    """family, fetches, projects, contents, copies, copied_bytes, forked_contents over the page requests that carry a hash.

    `copies` are fetches of a content that the family had given before, `copied_bytes` theirs; `forked_contents` are contents
    that came under more than one project of the family.  Requests without hash or project are left out; missing bytes
    count as 0.  A content is first added up by itself, so a family that is half of the log is no hot group.
    """
    pages = log.where("kind = 'request' and content_hash is not null")
    each = pages.select(family_of(F.col("path"), F.col("fork_of")).alias("family"), project_of(F.col("path")).alias("project"), "content_hash", F.coalesce("bytes", F.lit(0)).alias("bytes"), "seq").where("family is not null")
    by_project = each.groupBy("family", "content_hash", "project").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min(F.struct("seq", "bytes")).alias("first"))
    by_content = by_project.groupBy("family", "content_hash").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.min("first")["bytes"].alias("once"), F.count("project").alias("projects"))
    projects = by_project.select("family", "project").distinct().groupBy("family").agg(F.count("project").alias("projects"))
    out = by_content.groupBy("family").agg(F.sum("n").alias("fetches"), F.count("*").alias("contents"), F.sum(F.col("n") - 1).alias("copies"), F.sum(F.col("bytes") - F.col("once")).alias("copied_bytes"), F.count_if(F.col("projects") > 1).alias("forked_contents"))
    return out.join(projects, "family").select("family", "fetches", "projects", "contents", "copies", "copied_bytes", "forked_contents")
