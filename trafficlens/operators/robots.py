"""Robots rules: parsing, matching, and the verdict on each (user agent, path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import rules as fixed

RULES = "file_id string, group_id int, agent string, directive string, pattern string"


def parse_robots(texts: DataFrame) -> DataFrame:
    """(file_id, text) -> one row per agent and rule of a group; a group without rules has a null directive.

    Consecutive user-agent lines open a group, and a rule line closes its list of agents.  Comments, other keys and
    rules before any agent are ignored.  A file is one partition of the window: robots files are short.
    """
    lines = texts.select("file_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("n", "raw"))
    line = F.trim(F.substring_index("raw", "#", 1))
    lines = lines.withColumn("line", line).where(F.col("line").contains(":"))
    key, value = F.lower(F.trim(F.substring_index("line", ":", 1))), F.trim(F.expr("substr(line, instr(line, ':') + 1)"))
    lines = lines.select("file_id", "n", key.alias("key"), value.alias("value")).where("key in ('user-agent', 'allow', 'disallow')")
    order = W.partitionBy("file_id").orderBy("n")
    opens = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    lines = lines.withColumn("group_id", F.sum(opens.cast("int")).over(order)).where("group_id > 0")
    agents = lines.where("key = 'user-agent'").select("file_id", "group_id", F.col("value").alias("agent"))
    found = lines.where("key <> 'user-agent'").select("file_id", "group_id", F.col("key").alias("directive"), F.col("value").alias("pattern"))
    return agents.join(found, ["file_id", "group_id"], "left").select("file_id", F.col("group_id").cast("int"), "agent", "directive", "pattern")


def published_rules(spark: SparkSession) -> DataFrame:
    rows = [("published", i, agent, directive, pattern) for i, (agent, group) in enumerate(fixed.ROBOTS, 1) for directive, pattern in group]
    return spark.createDataFrame(rows, RULES)


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")


def _words(text: Column) -> Column:
    """The runs of letters, digits, `_` and `-`, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9_-]+"), lambda w: w != ""))


def agent_groups(agents: DataFrame, rules: DataFrame) -> DataFrame:
    """(ua) -> (ua, group_id): all groups that name the agent as a whole word, else the groups of `*`.

    A named agent stands under its longest word, and agents fetch the names of their own words; only names of several
    words are then searched for in the text."""
    agents = agents.select("ua").distinct()
    named = rules.where("agent <> '*'").select("group_id", "agent").distinct().withColumn("words", _words(F.col("agent")))
    word = F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    token = F.concat(F.lit("(?iu)(?<![A-Za-z0-9_-])"), _escaped(F.col("agent")), F.lit("(?![A-Za-z0-9_-])"))
    named = named.withColumns({"word": word, "token": F.when(F.lower("agent") != word, token)})
    asked = agents.withColumn("word", F.explode(_words(F.col("ua"))))
    own = asked.join(named.where("word is not null"), "word").where(F.col("token").isNull() | F.expr("ua rlike token")).select("ua", "group_id")
    signs = named.where("word is null").select("group_id", F.lower("agent").alias("sign")).where("sign <> ''")  # names without a word: rare, so few
    own = own.union(agents.join(F.broadcast(signs), F.expr("contains(lower(ua), sign)")).where(F.expr("ua rlike concat('(?i)(?<![A-Za-z0-9_-])\\\\Q', sign, '\\\\E(?![A-Za-z0-9_-])')")).select("ua", "group_id")).distinct()
    rest = agents.join(own.select("ua").distinct(), "ua", "left_anti")
    return own.unionByName(rest.crossJoin(rules.where("agent = '*'").select("group_id").distinct()))


def pattern_regex(pattern: Column) -> Column:
    """A rule's pattern as a regular expression: a prefix, `*` any run, a final `$` the end."""
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.expr("left(pattern, length(pattern) - 1)")).otherwise(pattern)
    parts = F.transform(F.split(body, r"\*", -1), _escaped)
    return F.concat(F.lit("(?d)^"), F.array_join(parts, ".*"), F.when(anchored, F.lit("$")).otherwise(F.lit("")))


def _next(path: Column, part: Column, at: Column) -> Column:
    """Where the path goes on behind the first occurrence of part from `at` on, 0 if there is none."""
    found = F.call_function("locate", part, path, at)
    return F.when(found == 0, 0).otherwise(found + F.length(part))


def _follows(path: Column, parts: Column, anchored: Column) -> Column:
    """Whether the path, which begins with parts[0], goes on with the others in order, `*` between them; anchored: up to the
    end.  Leftmost occurrences leave most room, so one pass decides."""
    last = F.element_at(parts, -1)
    middle = F.when(anchored, F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))).otherwise(F.slice(parts, F.lit(2), F.size(parts) - 1))
    at = F.aggregate(middle, F.length(F.element_at(parts, 1)) + 1, lambda at, part: F.when(at == 0, 0).otherwise(_next(path, part, at)))
    ends = F.when(F.size(parts) == 1, path == last).otherwise(path.endswith(last) & (F.length(path) - F.length(last) + 1 >= at))
    return (at > 0) & (~anchored | ends)


def prefix_index(rules: DataFrame) -> DataFrame:
    """Rules by the literal text that they begin with: group_id, prefix, directive, size, parts, anchored.  `parts` is null
    where the prefix is the whole pattern; rules with an empty pattern say nothing."""
    own = rules.where("pattern <> ''").select("group_id", "directive", "pattern").distinct()
    anchored = F.col("pattern").endswith("$")
    body = F.when(anchored, F.expr("left(pattern, length(pattern) - 1)")).otherwise(F.col("pattern"))
    parts = F.split(body, r"\*", -1)
    own = own.select("group_id", "directive", F.length("pattern").alias("size"), parts.alias("parts"), anchored.alias("anchored"))
    return own.select("group_id", F.element_at("parts", 1).alias("prefix"), "directive", "size", F.when(F.col("anchored") | (F.size("parts") > 1), F.col("parts")).alias("parts"), "anchored")


def disallowed(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """(ua, path) -> (ua, path, disallowed) for each distinct pair: the longest pattern wins, allow wins a tie, no match
    allows, and /robots.txt is always allowed.

    Rules lie under (group, literal prefix).  A path asks for those of its own prefixes whose lengths its group uses, so it
    meets the rules that begin like it and no others, however many a group has; only `*` and `$` ask for more.  Agents of
    one group share the answer for a path.
    """
    pairs = pairs.select("ua", "path").where("ua is not null and path is not null").distinct()
    index = prefix_index(rules)
    sizes = index.groupBy("group_id").agg(F.collect_set(F.length("prefix")).alias("sizes"))
    groups = agent_groups(pairs, rules)
    asked = pairs.join(groups, "ua").select("group_id", "path").distinct().join(sizes, "group_id")
    asked = asked.select("group_id", "path", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))).alias("n"))
    asked = asked.select("group_id", "path", F.expr("left(path, n)").alias("prefix"))
    hits = asked.join(index, ["group_id", "prefix"]).where(F.col("parts").isNull() | _follows(F.col("path"), F.col("parts"), F.col("anchored")))
    best = hits.groupBy("group_id", "path").agg(F.max(F.struct("size", (F.col("directive") == "allow").alias("allow"))).alias("best"))
    of_agent = pairs.join(groups, "ua").join(best, ["group_id", "path"]).groupBy("ua", "path").agg(F.max("best")["allow"].alias("allow"))
    verdict = ~F.coalesce(F.col("allow"), F.lit(True)) & (F.col("path") != "/robots.txt")
    return pairs.join(of_agent, ["ua", "path"], "left").select("ua", "path", verdict.alias("disallowed"))
