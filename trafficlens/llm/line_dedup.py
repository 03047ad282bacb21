"""Operator 6 [native]: fuzzy line deduplication by MinHash.

Every line has character shingles (those of five characters at every position).  Their hashes, sorted, are a ring; what
follows a mark on the ring is a band, and lines that share a band are candidates, verified by the exact Jaccard similarity
of their shingle sets.  Components of the verified links come from distributed union-find, and the first line of each
component stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialise, sent, table

#: Characters of a shingle.  Shingles start at every character, in all scripts; a shorter line is one shingle.
SHINGLE = 5
#: Marks on the ring of hashes, evenly spaced.  A band is the BAND entries that follow a mark, a value of the signature the
#: first of them: one order of the shingles serves all.  Entries may be marks themselves, so a short line has fewer hashes
#: a band.  By simulation, a pair at similarity 0.8 shares no band with a probability of 0.005 with 1,000 shingles, 0.003
#: with 330, below 0.001 up to 160.
BANDS, BAND = 17, 6
ORDERS = BANDS
_MARKS = [(k << 32) // BANDS - (1 << 31) for k in range(BANDS)]
#: Fewest equal values of a signature with which a candidate is verified: a pair at similarity 0.8 has fewer with a
#: probability below 0.001, by the same simulation.
LEAST_EQUAL = 8
THRESHOLD = 0.8
#: Buckets of up to so many lines give all their pairs.  Larger ones link their lines to LEADERS of them, the first in as
#: many random orders of all lines (so that a family has about the same leaders in all its buckets).
SMALL, LEADERS = 24, 6
#: 64-bit words of the bitmap of a line's shingles, one bit a shingle.
WORDS = 16
#: Members of a large bucket that one salt holds.
SALTED = 256
SALTS = 16
#: Pairs of lines that a task verifies, about, and the most tasks over which they are spread.
PAIRS_A_TASK, MOST_TASKS = 4000, 20_000
#: Pairs of members of large buckets that a task compares, about.
COMPARED_A_TASK = 500_000
#: Rounding that a comparison of shares allows.
SLACK = 1e-9

def line_of(raw: Column) -> Column:
    return F.lower(F.trim(raw))


def starts(line: Column) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.length(line) - SHINGLE, F.lit(0)))


def characters(line: Column) -> Column:
    """Four bytes a character, so that a shingle is found without counting from the line's start."""
    return F.encode(line, "UTF-32")


def shingle_at(wide: Column, start: Column) -> Column:
    return F.xxhash64(F.substring(wide, start * 4 + 1, F.lit(4 * SHINGLE)))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once a row: inlined in a lambda, it would be computed for each element."""
    return F.element_at(F.transform(F.array(x), f), 1)


def each_shingle(line: Column, hashed: Callable[..., Column]) -> Column:
    """The hashes of the line's shingles.  Lambdas are interpreted, so they hold as little as can be."""
    last = lambda wide: F.greatest(F.octet_length(wide) - 4 * SHINGLE + 1, F.lit(1))
    return once(characters(line), lambda wide: F.transform(F.sequence(F.lit(1), last(wide), F.lit(4)), lambda at: hashed(F.substring(wide, at, F.lit(4 * SHINGLE)))))


def shingle_hashes(line: Column) -> Column:
    return each_shingle(line, F.xxhash64)


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, dk (key of the document's row), no, line, fp (64-bit key of the line); lines without text left out."""
    split = docs.where("text is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("dk"), F.posexplode(F.split("text", "\n")).alias("no", "raw"))
    # Blank ones go before lower() and the key, which would else be computed for the filter too.
    filled = split.withColumn("raw", F.trim("raw")).where("raw <> ''")
    return filled.select("doc_id", "dk", "no", F.lower("raw").alias("line")).withColumn("fp", F.xxhash64("line"))


def shingles(texts: DataFrame) -> DataFrame:
    """texts: fp, line -> fp, i, h: a row per shingle and its place, so that all that is computed of it is compiled."""
    wide = texts.select("fp", characters(F.col("line")).alias("wide"), starts(F.col("line")).alias("starts"))
    return wide.select("fp", "wide", F.explode("starts").alias("i")).select("fp", "i", shingle_at(F.col("wide"), F.col("i")).alias("h"))


def rings(texts: DataFrame) -> DataFrame:
    """texts: line, ... -> without line, with m (the size of the line's shingle set, by 32-bit hashes), s0.. (its signature)
    and bands (64-bit keys).  All is made of the row alone: nothing is grouped or shuffled by line."""
    others = [c for c in texts.columns if c != "line"]
    # A step for each array that several columns read, so that it is computed once.
    hashes = each_shingle(F.col("line"), F.hash)
    made = texts.select(*others, F.sort_array(F.array_distinct(F.concat(hashes, F.array(*map(F.lit, _MARKS))))).alias("ring"))
    made = made.select(*others, (F.size("ring") - BANDS).alias("m"), F.concat("ring", F.slice("ring", 1, BAND)).alias("ring"))
    # Projections that hold a lambda are compiled in pieces; without one, all of the places or bands would be one method, too
    # large to be compiled at all.
    places = F.array(*(F.array_position("ring", F.lit(mark)).cast("int") for mark in _MARKS))
    made = made.select(*others, "m", "ring", F.transform(places, lambda at: at + 1).alias("after"))
    bands = F.array(*(F.xxhash64(F.lit(k), F.slice("ring", F.element_at("after", k + 1), F.lit(BAND))) for k in range(BANDS)))
    made = made.select(*others, "m", F.transform("after", lambda at: F.element_at("ring", at)).alias("first"), bands.alias("bands"))
    return made.select(*others, "m", *(F.element_at("first", k + 1).alias(f"s{k}") for k in range(BANDS)), "bands")


def signatures(docs: DataFrame) -> DataFrame:
    """fp, m, s0.. of each distinct line."""
    return rings(lines(docs).select("fp", "line").dropDuplicates(["fp"])).drop("bands")


def occurrences(docs: DataFrame) -> DataFrame:
    """A row for each line of each document: id (its own), doc_id, dk, no, fp, m, p0.. (packed signature), bands."""
    signed = rings(lines(docs))
    return signed.select(F.monotonically_increasing_id().alias("id"), "doc_id", "dk", "no", "fp", "m", *packed_values(), "bands")


def buckets(unique: DataFrame) -> tuple[DataFrame, DataFrame]:
    """unique: fp, bands -> the pairs a < b of the buckets of two lines; fp, bucket, size of the members of larger ones."""
    members = unique.select("fp", F.explode("bands").alias("bucket"))
    # Most buckets hold one line, most others two: these are counted and paired by themselves, and only the lines of larger
    # ones are gathered.
    shared = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("size > 1")
    shared = materialise(shared)
    crowded = materialise(shared.where("size > 2").select("bucket", "size"))
    return shared.where("size = 2").select("a", "b"), materialise(members.join(sent(crowded), "bucket"))


def inside(small: DataFrame) -> DataFrame:
    """All pairs a < b of small buckets."""
    return small.select("bucket", F.col("fp").alias("a")).join(small.select("bucket", F.col("fp").alias("b")), "bucket").where("a < b").select("a", "b")


def led(members: DataFrame) -> DataFrame:
    """members: fp, bucket -> each member with the leaders of its buckets, each pair once."""
    leaders = members.groupBy("bucket").agg(*(F.min_by("fp", F.xxhash64("fp", F.lit(k))).alias(f"l{k}") for k in range(LEADERS)))
    leaders = materialise(leaders.select("bucket", F.array_distinct(F.array(*(f"l{k}" for k in range(LEADERS)))).alias("leaders")))
    # Sent or shuffled by its size: one row per large bucket.
    # A family has about the same leaders in all its buckets, so a line gathers them before each gets a row: BANDS times
    # LEADERS of them at most.
    own = members.join(sent(leaders), "bucket").groupBy("fp").agg(F.array_distinct(F.flatten(F.collect_set("leaders"))).alias("leaders"))
    each = own.select("fp", F.explode("leaders").alias("l")).where("fp <> l")
    return each.select(F.least("fp", "l").alias("a"), F.greatest("fp", "l").alias("b")).distinct()


def apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of the buckets whose members the links so far leave in different components, with their root and
    whether they stand outside their bucket's most frequent component; `stray`: how many of the bucket do."""
    rooted = materialise(members.select("fp", "bucket", "size").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    counted = rooted.groupBy("bucket", "root").count().groupBy("bucket").agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.max("count").alias("within"))
    # One row per large bucket, as in led().
    open_ = rooted.join(sent(materialise(counted)), "bucket").where("within < size")
    return materialise(open_.select("fp", "bucket", "size", "root", (F.col("root") != F.col("most")).alias("outside"), (F.col("size") - F.col("within")).alias("stray")))


def across(members: DataFrame, unique: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs a, b of members of one bucket that have different roots and may be alike, each in one of the buckets that
    both are in: those outside the bucket's most frequent component meet all.  Both sides are cut into parts, and each part
    of the one meets each part of the other."""
    keys = ["bucket", "part_a", "part_b"]
    parts = {"a": F.ceil(F.col("stray") / SALTED), "b": F.ceil(F.col("size") / (16 * SALTED))}
    # A line is in BANDS buckets at most.
    own = members.groupBy("fp").agg(F.collect_list("bucket").alias("own"))
    facts = materialise(unique.select("fp", *PACKED).join(own, "fp").join(texts.drop("line"), "fp"))
    rows = materialise(members.join(facts, "fp"))

    def side(rows: DataFrame, x: str, y: str) -> DataFrame:
        part, other = F.pmod(F.xxhash64("fp"), parts[x]), F.explode(F.sequence(F.lit(0).cast("long"), parts[y] - 1))
        facts = [F.col(c).alias(f"{c}_{x}") for c in ("root", "outside", "own", *PACKED, *BITMAP)]
        return rows.select("bucket", part.alias(f"part_{x}"), other.alias(f"part_{y}"), F.col("fp").alias(x), *facts)

    # Dealt by the pairs to compare, not by bytes.
    work = members.where("outside").agg(F.sum("size")).first()[0] or 0
    tasks = min(MOST_TASKS, 1 + work // COMPARED_A_TASK)
    left, right = (side(r, *xy).repartition(tasks, *keys) for r, xy in ((rows.where("outside"), "ab"), (rows, "ba")))
    right = right.withColumnsRenamed({k: f"{k}2" for k in keys})
    on = (F.col("root_a") != F.col("root_b")) & (~F.col("outside_b") | (F.col("a") < F.col("b"))) & (equal_values() >= LEAST_EQUAL) & may_be_alike(threshold)
    on = on & (F.array_min(F.array_intersect("own_a", "own_b")) == F.col("bucket"))
    for k in reversed(keys):
        on = (F.col(k) == F.col(f"{k}2")) & on
    return left.join(right, on).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


#: A packed signature has five values a word, the lower eleven bits of each with a free bit above them.
LANE, LANES = 12, 5
PACKED = [f"p{k}" for k in range(-(-ORDERS // LANES))]
_FULL = sum(((1 << LANE - 1) - 1) << LANE * k for k in range(LANES))
_FREE = sum((1 << LANE - 1) << LANE * k for k in range(LANES))
#: Columns of a bitmap: the size of the set, how many bits it sets, and the words.
BITMAP = ["m", "bits", *(f"w{k}" for k in range(WORDS))]


def packed_values() -> list[Column]:
    """p0.. : a signature that a few instructions compare (few enough to be compiled; a test of each value isn't)."""
    words = [F.lit(0).cast("long") for _ in PACKED]
    for k in range(ORDERS):
        low = F.col(f"s{k}").cast("long").bitwiseAND(F.lit((1 << LANE - 1) - 1))
        words[k // LANES] = words[k // LANES].bitwiseOR(F.shiftleft(low, LANE * (k % LANES)))
    return [w.alias(p) for w, p in zip(words, PACKED, strict=True)]


def packed(unique: DataFrame) -> DataFrame:
    """fp, p0.. of signatures."""
    return unique.select("fp", *packed_values())


def equal_values() -> Column:
    """In how many values (eleven bits of each) the signatures p0_a.. and p0_b.. agree."""
    # Adding ones to what differs carries into the free bit.
    unequal = (F.bit_count((F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b")) + F.lit(_FULL)).bitwiseAND(F.lit(_FREE))) for p in PACKED)
    return F.lit(ORDERS) - sum(unequal, F.lit(0))


def may_be_alike(threshold: float) -> Column:
    """Whether the bitmaps allow a similarity of the threshold: a bit that one line sets alone stands for at least one
    shingle of that line alone.  No pair at the threshold is lost, whatever shingles share their bits."""
    both = sum((F.bit_count(F.col(f"w{k}_a").bitwiseAND(F.col(f"w{k}_b"))) for k in range(WORDS)), F.lit(0))
    return F.least(F.col("m_a") - F.col("bits_a"), F.col("m_b") - F.col("bits_b")) + both >= least_common(threshold)


def least_common(threshold: float) -> Column:
    """With c common shingles, c / (m_a + m_b - c) reaches the threshold."""
    return (F.col("m_a") + F.col("m_b")) * (threshold / (1 + threshold)) - SLACK


def both_sides(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """pairs a, b with the columns of facts (fp, ...) for either."""
    for x in "ab":
        pairs = pairs.join(facts.withColumnsRenamed({c: x if c == "fp" else f"{c}_{x}" for c in facts.columns}), x)
    return pairs


def alike(pairs: DataFrame, unique: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose set sizes allow the threshold and whose signatures agree in LEAST_EQUAL values; equal: in how many."""
    pairs = materialise(pairs)
    nodes = sent(materialise(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()))
    signed = materialise(unique.select("fp", "m", *PACKED).join(nodes, "fp", "left_semi"))
    # Sizes by 32-bit hashes may be a little too small.
    sizes = F.least("m_a", "m_b") + 1 >= F.greatest("m_a", "m_b") * (threshold * 0.99)
    return both_sides(pairs, signed).withColumn("equal", equal_values()).where(sizes & (F.col("equal") >= LEAST_EQUAL)).select("a", "b", "equal")


def with_sizes(texts: DataFrame) -> DataFrame:
    """texts: fp, line -> with m, the size of the line's shingle set."""
    return texts.withColumn("m", F.size(F.array_distinct(shingle_hashes(F.col("line")))))


def with_bitmaps(texts: DataFrame) -> DataFrame:
    """texts: fp, line -> with m, the size of the line's shingle set, and w0.., a bitmap of it."""
    words = [F.expr(f"bit_or(IF((h & {WORDS - 1}) = {k}, shiftleft(1L, CAST(shiftrightunsigned(h, 8) & 63 AS INT)), 0L))").alias(f"w{k}") for k in range(WORDS)]
    sized = with_sizes(texts)
    bits = sum((F.bit_count(f"w{k}") for k in range(WORDS)), F.lit(0))
    return sized.join(shingles(texts).groupBy("fp").agg(*words).withColumn("bits", bits), "fp")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs a, b whose shingle sets have a Jaccard similarity of at least the threshold.  `pairs` is a written table,
    texts: fp, line.  Pairs are few bytes and much work, so they are dealt by their number."""
    tasks = min(MOST_TASKS, max(1, -(-pairs.count() // PAIRS_A_TASK)))
    both = both_sides(pairs, texts.select("fp", "line")).repartition(tasks, "a", "b")
    sets = F.struct(*(shingle_hashes(F.col(f"line_{x}")).alias(x * 2) for x in "ab"))
    # Generated, not selected: the filter would else be moved before the dealing, and hash each line for each of its uses.
    hashed = both.select("a", "b", F.inline(F.array(sets)))
    common, either = F.size(F.array_intersect("aa", "bb")), F.size(F.array_union("aa", "bb"))
    return hashed.where(common >= either * F.lit(threshold) - SLACK).select("a", "b")


def joined(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """node, root of the components of the pairs that reach the threshold.  pairs: a, b, equal.  Each line is first held
    against the one whose signature is most like its own; of the other pairs only those need verifying that this leaves in
    different components."""
    tree = materialise(pairs.groupBy("b").agg(F.max_by("a", F.struct("equal", "a")).alias("a")).select("a", "b"))
    roots = components(materialise(verified(tree, texts, threshold)))
    rest = pairs.join(tree, ["a", "b"], "left_anti")
    for x in "ab":
        rest = rest.join(sent(roots).select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x, "left")
    rest = materialise(rest.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"))
    return linked(roots, materialise(verified(rest, texts, threshold)))


def linked(roots: DataFrame, links: DataFrame) -> DataFrame:
    """node, root when links a, b (a written table) join components."""
    if links.isEmpty():
        return roots
    return components(materialise(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links)))


def near_roots(unique: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """node, root of the components of lines at the threshold.  unique: fp, m, p0.., bands of each distinct line.

    Small buckets give all their pairs, large ones the pairs with their leaders; the members of a large bucket
    that these links leave outside its most frequent component are then compared with all of it.  So no bucket is cut, and a
    family that the links have joined is no square of pairs; lines of a large bucket that stay apart are."""
    twos, members = buckets(unique)
    large = materialise(members.where(F.col("size") > SMALL))
    pairs = twos.union(inside(members.where(F.col("size") <= SMALL))).union(led(large)).distinct()
    pairs = materialise(alike(pairs, unique, threshold))
    wanted = large.select("fp").union(pairs.select("a")).union(pairs.select("b")).distinct()
    texts = lines(docs).join(sent(materialise(wanted)), "fp").select("fp", "line").dropDuplicates(["fp"])
    texts = materialise(texts)
    roots = joined(pairs, texts, threshold)
    large = apart(large, roots)
    if large.isEmpty():
        return roots
    crowd = sent(materialise(large.select("fp").distinct()))
    mapped = materialise(with_bitmaps(texts.join(crowd, "fp", "left_semi")))
    new = materialise(across(large, unique, mapped, threshold).join(pairs, ["a", "b"], "left_anti"))
    return linked(roots, materialise(verified(new, texts, threshold)))


def classes(found: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """fp, root: for every line that has a copy or a near copy, the key of its component.  found: the docs' occurrences."""
    copied = found.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1").select("fp", "first")
    copied = materialise(copied)
    # The first occurrence of each line stands for all.
    unique = found.join(sent(copied), "fp", "left").where("first is null or first = id").select("fp", "m", *PACKED, "bands")
    roots = near_roots(unique, docs, threshold)
    return copied.select("fp").join(roots.withColumnRenamed("node", "fp"), "fp", "full").select("fp", F.coalesce("root", "fp").alias("root"))


def dropped_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, dk, drop: of each document that loses lines, their numbers."""
    every = materialise(occurrences(docs))
    roots = sent(materialise(classes(every, docs, threshold)))
    # Each occurrence of a line of a class; a hot line is spread by salt.
    found = every.select("doc_id", "dk", "no", "fp").join(roots, "fp").drop("fp")
    found = materialise(found.withColumn("salt", F.pmod(F.xxhash64("dk", "no"), F.lit(SALTS)).cast("int")))
    place = F.struct("doc_id", "dk", "no")
    first = found.groupBy("root", "salt").agg(F.min(place).alias("first")).groupBy("root").agg(F.min("first").alias("first"))
    first = first.select(F.col("root").alias("r"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    later = found.join(first, (F.col("root") == F.col("r")) & (F.col("salt") == F.col("s"))).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "dk").agg(F.collect_set("no").alias("drop"))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of docs with `text` rid of the dropped lines, and n_lines, n_kept (lines with text, before and after).

    Lines are compared without case and outer blanks.  Of each component of equal or similar lines the first stays: the
    one of the smallest (doc_id, line number).  Lines without text are left in place and belong to no component.  A null
    text stays null, an empty one empty; a document may lose all its lines.  Rows that repeat a doc_id and its text are
    one document: each copy keeps the same lines.  A line of any length is shingled whole.  An empty table gives an
    empty result.  Columns of the input named n_lines or n_kept are replaced; other columns pass through, whatever their
    names.  Two different lines share a 64-bit key with a probability of n squared / 2**65.
    """
    drops = materialise(dropped_lines(docs, threshold))
    # Sent by the cells that the rows hold, not by the rows: a document's list of numbers may be long.
    drops = sent(drops, drops.agg(F.sum(F.size("drop"))).first()[0] or 0)
    others = [c for c in docs.columns if c.lower() not in ("n_lines", "n_kept")]
    rows = docs.select(F.struct(*others).alias("row"))
    text = F.col("row.text")
    joined = rows.join(drops, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.doc_id", "row.text") == F.col("dk")), "left")
    split = F.split(text, "\n")
    kept = F.filter(split, lambda x, i: ~F.coalesce(F.array_contains("drop", i), F.lit(False)))
    n = F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.filter(split, lambda x: F.trim(x) != "")))
    new = F.when(F.col("drop").isNull(), text).otherwise(F.array_join(kept, "\n"))
    columns = [(new if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in others]
    return joined.select(*columns, n.alias("n_lines"), (n - F.when(F.col("drop").isNull(), F.lit(0)).otherwise(F.size("drop"))).alias("n_kept"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_kept", F.md5("text").alias("text_md5"))
