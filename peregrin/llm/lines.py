"""Operator 3, line dedup: deletion-neighbourhood join, in DataFrame functions only.

Two lines within one edit (a character put in, taken out or replaced) share a variant: the line itself or the line
with one character deleted. Emitting a key for every character of every line would multiply the corpus, so variants are
emitted from coarse to fine, each level only for what shared a key at the level before:

1. exact lines are gathered first, with their earliest place (partial aggregation: hot lines cost a row a task);
2. halves: the variant without its first or its second half, for the lengths n (both sides' shorter length) that apply;
3. blocks: the variant without one block of at most 64 characters of that half;
4. characters: within the block, deletion of one character.

A key of level 4 that two lines reach by deleting at the same place is a replacement, by deleting and not deleting an
insertion: groups are then cliques, so the earliest line of the group serves as everybody's partner and no pairs within
a group are ever formed, however hot the key. The partner found is verified by the edit distance.
Each level is an aggregation by a hashed key; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, fresh_path, scratch, staged, texts, write

SPAN, LEAST_CHARS = 64, 24
#: Lines with more than this share of all occurrences are hot: there are fewer than its inverse of them.
HOT = 1 / 20_000
_NULL = -(2**63)
ID, PLACE = ["a", "b"], ["doc_id", "line_no"]


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    d = texts(docs, key, text)
    return d.select(F.coalesce("doc_id", F.lit(_NULL)).alias("doc_id"), "text", F.xxhash64("text").alias("t"))


def _hashed(line: str = "line") -> list[Column]:
    """128 bits stand for a line."""
    return [F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b")]


def _occurrences(docs: DataFrame) -> DataFrame:
    """The lines with a word: where they stand, and what stands for them."""
    lines = docs.select("doc_id", "t", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.length(F.btrim("line", F.lit(WHITE))) > 0)


def _half(line: Column, n: Column, first: bool) -> Column:
    """What stays of a line when its first (or second) half is deleted; halves are cut for the shorter length n."""
    h = F.floor(n / 2).cast("int")
    return F.substring(line, F.length(line) - (n - h) + 1, n - h) if first else F.substring(line, F.lit(1), h)


_SIDES = [(first, less) for first in (True, False) for less in (0, 1)]


def _half_keys(line: Column) -> list[Column]:
    n = lambda less: F.length(line) - less
    return [F.xxhash64(F.lit(first), n(less), _half(line, n(less), first)).alias(f"k{i}") for i, (first, less) in enumerate(_SIDES)]


def near_lines(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """The distinct lines (a, b) that have an earlier line within one edit.

    distinct: a, b, doc_id, line_no (earliest place), len, k0 to k3. docs: where the texts of candidates are.
    """
    sides = F.array(*[F.struct(F.lit(first).alias("first"), (F.col("len") - less).cast("int").alias("n"), F.col(f"k{i}").alias("key")) for i, (first, less) in enumerate(_SIDES)])
    keyed = distinct.where(F.col("len") >= LEAST_CHARS).select(*ID, *PLACE, F.explode(sides).alias("s")).select(*ID, *PLACE, "s.*")
    several = lambda d: d.groupBy("key").agg(F.min("a").alias("x"), F.max("a").alias("y")).where("x < y").select("key")
    halves = staged(keyed.join(several(keyed), "key", "left_semi").select(*ID, *PLACE, "first", "n"), "halves")

    wanted = halves.groupBy("doc_id").agg(F.collect_set("line_no").alias("nos"))  # of one document
    numbered = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line_no"), x.alias("line"))), lambda x: F.array_contains("nos", x["line_no"]))
    found = docs.join(wanted, "doc_id").select("doc_id", F.explode(numbered).alias("x")).select("doc_id", "x.*")
    found = staged(found.select(*_hashed(), *PLACE, "line").dropDuplicates([*ID, *PLACE]), "near-lines")

    # within the deleted half: blocks, placed from the start up to the block and from the end after it
    h = F.floor(F.col("n") / 2).cast("int")
    low, high = F.when(F.col("first"), 0).otherwise(h), F.when(F.col("first"), h).otherwise(F.col("n"))
    blocks = halves.join(found, [*ID, *PLACE]).withColumn("len", F.length("line"))
    blocks = blocks.select(*ID, *PLACE, "line", "len", "n", high.alias("high"), F.explode(F.sequence(low, F.greatest(low, high - 1), F.lit(SPAN))).alias("from"))
    blocks = blocks.withColumn("to", F.least(F.col("from") + SPAN, "high"))
    rest = F.col("n") - F.col("to")
    head, tail = F.substring("line", F.lit(1), F.col("from")), F.substring(F.col("line"), F.col("len") - rest + 1, rest)
    middle = F.substring(F.col("line"), F.col("from") + 1, F.col("len") - rest - F.col("from"))
    blocks = blocks.select(*ID, *PLACE, F.xxhash64("n", "from", "to", head, tail).alias("key"), middle.alias("middle"), (F.col("len") - F.col("n")).alias("more"))
    blocks = staged(blocks.join(several(blocks), "key", "left_semi"), "blocks")

    size = F.length("middle")
    without = lambda i: F.concat(F.substring(F.col("middle"), F.lit(1), i - 1), F.substring(F.col("middle"), i + 1, size))
    deleted = F.when(size > 0, F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(i.alias("at"), F.xxhash64(without(i)).alias("v"))))
    whole = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64("middle").alias("v")))
    entries = blocks.select(*ID, *PLACE, "key", "more", F.explode(F.concat(whole, F.coalesce(deleted, F.array().cast("array<struct<at:int,v:bigint>>")))).alias("e"))
    me = F.struct(*PLACE, *ID)
    # a replacement: both lines lose the character at the same place
    swaps = entries.where("more = 0 and e.at > 0").select(*ID, *PLACE, F.xxhash64("key", F.lit(0), "e.at", "e.v").alias("variant"))
    low_ = swaps.groupBy("variant").agg(F.min(me).alias("twin"), F.count("*").alias("k")).where("k > 1").select("variant", "twin")
    pairs = swaps.join(low_, "variant").select(*ID, *PLACE, "twin")
    # an insertion: the longer line loses a character, the shorter one stays as it is, so a group has one shorter line
    gaps = entries.where("(more = 0 and e.at = 0) or (more = 1 and e.at > 0)").select(*ID, *PLACE, "more", F.xxhash64("key", F.lit(1), F.lit(0), "e.v").alias("variant"))
    both = gaps.groupBy("variant").agg(F.min(F.when(F.col("more") == 0, me)).alias("short"), F.min(F.when(F.col("more") == 1, me)).alias("long")).where("short is not null and long is not null")
    pairs = pairs.unionByName(gaps.join(both, "variant").select(*ID, *PLACE, F.when(F.col("more") == 0, F.col("long")).otherwise(F.col("short")).alias("twin")))
    first = pairs.where(F.struct("twin.doc_id", "twin.line_no") < F.struct(*PLACE)).groupBy(*ID, *PLACE).agg(F.min("twin").alias("twin")).select(*ID, *PLACE, *[F.col(f"twin.{c}").alias(f"twin_{c}") for c in (*ID, *PLACE)])
    mine, theirs = found, found.select(*[F.col(c).alias(f"twin_{c}") for c in found.columns])
    verified = first.join(mine, [*ID, *PLACE]).join(theirs, [f"twin_{c}" for c in (*ID, *PLACE)])
    return verified.where(F.levenshtein("line", "twin_line", 1).between(0, 1)).select(*ID).distinct()


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Return doc_id, t (hash of the text), n_lines (with a word), removed (numbers of lines that go), for each document with such a line.

    Lines are what \\n splits. A line with a word goes if an equal line stands at an earlier place (doc_id, then number of the line),
    or, from LEAST_CHARS characters on, one within one edit; earlier lines count even if they go themselves. Lines without a
    word have no repeats. Null texts are empty; null ids come first. Equal lines of rows that share a doc_id, as of
    repeated rows, are at one place if at the same number, and neither goes for the other. An empty table gives no rows.
    """
    d = _documents(docs, key, text)
    occurrences = _occurrences(d)
    keys = occurrences.select(*_hashed(), F.struct(*PLACE).alias("place"), F.length("line").alias("len"), *_half_keys(F.col("line")))
    distinct = keys.groupBy(*ID).agg(F.min("place").alias("place"), F.count("*").alias("k"), *[F.min(c).alias(c) for c in ("len", "k0", "k1", "k2", "k3")])
    distinct = staged(distinct.select(*ID, "place.*", "k", "len", "k0", "k1", "k2", "k3"), "distinct-lines")
    path = fresh_path(d.sparkSession, "near")
    with scratch(d.sparkSession):
        write(near_lines(distinct, d), path)
    near = d.sparkSession.read.schema("a long, b long").parquet(path).withColumn("near", F.lit(True))
    known = distinct.select(*ID, "k", F.struct(*PLACE).alias("first")).join(near, ID, "left").select(*ID, "k", "first", F.coalesce("near", F.lit(False)).alias("near"))
    most = F.lit((distinct.agg(F.sum("k")).first()[0] or 0) * HOT)
    hot = known.where(F.col("k") > most).select(*ID, F.col("first").alias("hot_first"), F.col("near").alias("hot_near"))  # fewer than 1 / HOT rows
    rest = known.where(F.col("k") <= most).select(F.col("a").alias("ra"), F.col("b").alias("rb"), "first", "near")
    at = occurrences.select("doc_id", "t", "line_no", *_hashed()).join(F.broadcast(hot), ID, "left")
    # occurrences of hot lines know all by now: they go anywhere
    at = at.join(rest, (F.when(F.col("hot_first").isNull(), F.col("a")).otherwise(F.xxhash64(*PLACE)) == F.col("ra")) & (F.when(F.col("hot_first").isNull(), F.col("b")).otherwise(F.xxhash64("line_no", "doc_id")) == F.col("rb")), "left")
    gone = F.coalesce("hot_near", "near") | (F.coalesce("hot_first", "first") < F.struct(*PLACE))
    return at.groupBy("doc_id", "t").agg(F.count_distinct("line_no").alias("n_lines"), F.sort_array(F.collect_set(F.when(gone, F.col("line_no")))).alias("removed"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the lines that repeated_lines removes; a text all of whose lines with a word went is null."""
    flags = repeated_lines(docs, key, text).where(F.size("removed") > 0)
    own = [F.col(c) for c in docs.columns if c != text]
    d = docs.withColumn("__k", F.coalesce(F.col(key).cast("long"), F.lit(_NULL))).withColumn("__t", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    f = flags.select(F.col("doc_id").alias("__k"), F.col("t").alias("__t"), F.col("n_lines").alias("__n"), F.col("removed").alias("__gone"))
    stay = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    new = F.when(F.col("__gone").isNull(), F.col(text)).when(F.size("__gone") < F.col("__n"), stay)
    out = d.join(f, ["__k", "__t"], "left").select(*own, new.alias(text))
    return out.select(*docs.columns)


def op3_deletion_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    flags = repeated_lines(docs)
    out = docs.select(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")).join(flags, ["doc_id", "t"], "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), F.array_join(removed, ",").alias("removed"))


#: Lines within one edit agree in a half; what is left is one edit if, after the common start, the rest agrees less a character on either side or both.
OP3_SQL = r"""
WITH docs AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), occ AS (
  SELECT * FROM (SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), known AS (
  SELECT line, min(row(doc_id, line_no)) AS first FROM occ GROUP BY line
), long AS (
  SELECT line, first, length(line) AS len FROM known WHERE length(line) >= 24
), halves AS (
  SELECT line, first, len, n, unnest([left(line, (n // 2)::BIGINT) || chr(10) || 'left', right(line, (n - n // 2)::BIGINT) || chr(10) || 'right']) AS half FROM (SELECT *, unnest([len, len - 1]) AS n FROM long)
), pairs AS (
  SELECT DISTINCT a.line AS earlier, b.line AS later FROM halves a JOIN halves b ON a.n = b.n AND a.half = b.half AND a.first < b.first WHERE a.n = least(a.len, b.len)
), near AS (
  SELECT DISTINCT later AS line FROM pairs WHERE len(list_filter(range(least(length(earlier), length(later)) + 1), lambda i: left(earlier, i) = left(later, i) AND (
    substr(earlier, i + 2) = substr(later, i + 2) OR substr(earlier, i + 2) = substr(later, i + 1) OR substr(earlier, i + 1) = substr(later, i + 2)))) > 0
), judged AS (
  SELECT doc_id, line_no, row(doc_id, line_no) > first OR near.line IS NOT NULL AS gone FROM occ JOIN known USING (line) LEFT JOIN near USING (line)
), flags AS (
  SELECT doc_id, count(*) AS n_lines, coalesce(list(line_no ORDER BY line_no) FILTER (WHERE gone), []) AS removed FROM judged GROUP BY doc_id
)
SELECT docs.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, len(coalesce(removed, []))::BIGINT AS n_removed, array_to_string(coalesce(removed, []), ',') AS removed FROM docs LEFT JOIN flags USING (doc_id)
"""
