"""Operator 7, quality rules: distribution divergence, in DataFrame functions only.

Base counts come first. Then each document's histogram of character classes and of its language's common words is held
against the language's reference, by the Jensen-Shannon distance (base 2, so 0 to 1). References are pooled over all
documents of the language that pass the base rules. Short documents have no verdict of that kind: guards ask for enough
characters and words.

One pass computes the counts of a document within its own row (arrays and higher-order functions, nothing is
exploded), and stages them as a few dozen numbers a document. References are one row a language of the fixed
list below, so they can be broadcast. No step groups by anything but the language, with partial sums before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, staged

#: Common words of each language.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he are this at from or had".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus sur avec il au ce pas se".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
}
WORDS = 24
#: Classes of characters, taken out in this order; what is left is the last class.
CLASSES = ("[a-z]+", "[A-Z]+", "[0-9]+", r"[.,;:!?'\"()\-]+", "[#*$%&|<>]+", r"[^\x00-\x7F]+")
_WS = r"[\x20\x09-\x0D]+"
#: Distances above these reject; lengths below these give no verdict.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_WORDS = 0.3, 0.3, 300, 80


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column, n: Column) -> Column:
    """Words that stand in a 3-word window found twice or more in the text."""

    def by_sort(tri: Column) -> Column:
        pairs = F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda p: F.sort_array(F.transform(F.filter(F.transform(p, lambda x, j: F.struct(x["i"].alias("i"), (F.coalesce(F.get(p, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, j + 1)["h"] == x["h"], F.lit(False))).alias("again"))), lambda x: x["again"]), lambda x: x["i"])))

    def positions(tri: Column, twice: Column) -> Column:
        found = F.filter(F.transform(tri, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda i: i.isNotNull())
        return F.when(F.size(twice) == 0, F.array().cast("array<int>")).when(F.size(twice) <= 16, found).otherwise(by_sort(tri))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(at, start, lambda s, i: F.struct((s["n"] + i + 3 - F.greatest(s["end"], i)).alias("n"), (i + 3).alias("end")), lambda s: s["n"])

    tri = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    twice = lambda t: let(F.sort_array(t), lambda s: F.array_distinct(F.filter(s, lambda h, i: (i > 0) & (F.get(s, i - 1) == h))))
    return F.when(n < 4, 0).otherwise(let(tri, lambda t: let(twice(t), lambda d: covered(positions(t, d))))).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, classes (array of counts) and common (counts of the language's common words, then all other words)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "lang", "text", F.btrim("text", F.lit(WHITE)).alias("trimmed"), F.translate("text", WHITE, "").alias("s0"))
    for i, kind in enumerate(CLASSES):
        d = d.withColumn(f"s{i + 1}", F.regexp_replace(f"s{i}", kind, ""))
    sizes = [F.length(f"s{i}") - F.length(f"s{i + 1}") for i in range(len(CLASSES))] + [F.length(f"s{len(CLASSES)}")]
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    d = d.select("doc_id", "lang", F.length("s0").cast("long").alias("word_chars"), F.array(*sizes).alias("classes"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.when(F.length("trimmed") > 0, F.split("trimmed", _WS)).otherwise(F.array().cast("array<string>")).alias("words"))
    listed = sorted({v for w in COMMON.values() for x in w for v in (x, x.capitalize(), x.upper())})
    of = F.lit(None).cast("array<string>")
    for lang, words in COMMON.items():
        of = F.when(F.col("lang") == lang, F.array(*[F.lit(w) for w in words])).otherwise(of)
    found = F.transform(F.filter("words", lambda w: w.isin(*listed)), lambda w: F.lower(w))
    common = let(found, lambda f: F.transform(of, lambda c: F.size(F.filter(f, lambda w: w == c))))
    n = F.size("words")
    return d.select("doc_id", "lang", n.cast("long").alias("n_words"), "word_chars", F.col("classes")[4].cast("long").alias("n_symbols"), "n_dup_lines", repeat_words(F.col("words"), n).alias("n_repeat_words"), "classes", common.alias("common"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms (arrays of counts, of equal length), base 2; null if either is empty."""
    share = lambda a: let(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), lambda t: F.when(t > 0, F.transform(a, lambda x: x / t)))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    both = let(F.struct(share(p).alias("p"), share(q).alias("q")), lambda s: F.aggregate(F.zip_with(s["p"], s["q"], lambda x, y: let((x + y) / 2, lambda m: part(x, m) + part(y, m))), F.lit(0.0), lambda t, x: t + x))
    return let(both, lambda b: F.when(b.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), b) / 2)))


def quality(docs: DataFrame, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """Return per row doc_id, the base counts, base_failed, class_distance, word_distance, kept.

    A null text counts as empty (and fails the base rules). A null or unlisted language has no reference: the base
    rules alone decide. Repeated rows and ids are judged row by row. An empty table gives no rows.
    """
    f = staged(features(docs), "quality")
    f = f.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    n_classes = len(CLASSES) + 1
    sums = [F.sum(F.col("classes")[i].cast("long")).alias(f"c{i}") for i in range(n_classes)] + [F.sum(F.col("common")[i].cast("long")).alias(f"w{i}") for i in range(WORDS)]
    known = f.where(F.col("lang").isin(*COMMON) & ~F.col("base_failed"))
    refs = known.groupBy("lang").agg(*sums, F.sum("n_words").alias("all_words"))
    refs = refs.select("lang", F.array(*[f"c{i}" for i in range(n_classes)]).alias("ref_classes"), let(F.array(*[f"w{i}" for i in range(WORDS)]), lambda w: F.concat(w, F.array(F.col("all_words") - F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s + x)))).alias("ref_words"))
    j = f.join(F.broadcast(refs), "lang", "left")  # a row for each listed language at most
    own = F.concat(F.transform("common", lambda x: x.cast("long")), F.array(F.col("n_words") - F.aggregate("common", F.lit(0).cast("long"), lambda s, x: s + x)))
    j = j.withColumn("class_distance", F.when(F.col("word_chars") >= min_chars, js_distance(F.transform("classes", lambda x: x.cast("long")), F.col("ref_classes"))))
    j = j.withColumn("word_distance", F.when(F.col("n_words") >= min_words, js_distance(own, F.col("ref_words"))))
    far = (F.coalesce("class_distance", F.lit(0.0)) > max_class) | (F.coalesce("word_distance", F.lit(0.0)) > max_word)
    return j.withColumn("kept", ~F.col("base_failed") & ~far)


def op7_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *[F.round(c, 9).alias(c) for c in ("class_distance", "word_distance")])


#: Words by position, bins a row each; a distance from shares of bins.
OP7_SQL = (
    r"""
WITH common(lang, i, word) AS (VALUES """ + ", ".join(f"('{lang}', {i}, '{w}')" for lang, words in COMMON.items() for i, w in enumerate(words)) + r"""), forms AS (
  SELECT DISTINCT lang, i, unnest([word, upper(left(word, 1)) || substr(word, 2), upper(word)]) AS form FROM common
), d AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS chars FROM documents
), w AS (
  SELECT doc_id, lang, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS three FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, three) AS k FROM windows) WHERE k > 1
), again AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id
), base AS (
  SELECT d.doc_id, d.lang, len(words) AS n_words, length(chars) AS word_chars, length(regexp_replace(chars, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words
  FROM d JOIN w USING (doc_id) LEFT JOIN again USING (doc_id)
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
), kinds AS (
  SELECT doc_id, lang, 'class' AS of, unnest(range(7)) AS i, unnest(counts || [length(chars) - list_sum(counts)::BIGINT]) AS n FROM (
    SELECT doc_id, lang, chars, list_transform(['[^a-z]+', '[^A-Z]+', '[^0-9]+', '[^.,;:!?''"()\-]+', '[^#*$%&|<>]+', '[\x00-\x7F]+'], lambda c: length(regexp_replace(chars, c, '', 'g'))) AS counts FROM d)
), named AS (
  SELECT w.doc_id, f.i, count(*) AS n FROM (SELECT doc_id, lang, unnest(words) AS word FROM w) w JOIN forms f ON f.lang = w.lang AND f.form = w.word GROUP BY w.doc_id, f.i
), bins AS (
  SELECT doc_id, lang, of, i, n FROM kinds
  UNION ALL SELECT b.doc_id, b.lang, 'word', c.i, coalesce(n.n, 0) FROM base b JOIN common c USING (lang) LEFT JOIN named n ON n.doc_id = b.doc_id AND n.i = c.i
  UNION ALL SELECT b.doc_id, b.lang, 'word', 24, any_value(b.n_words) - coalesce(sum(n.n), 0) FROM base b LEFT JOIN named n USING (doc_id) GROUP BY b.doc_id, b.lang
), reference AS (
  SELECT bins.lang, of, i, sum(n) AS n FROM bins JOIN failed USING (doc_id) WHERE NOT base_failed AND bins.lang IN (SELECT lang FROM common) GROUP BY bins.lang, of, i
), shares AS (
  SELECT b.doc_id, b.of, b.n / nullif(sum(b.n) OVER (PARTITION BY b.doc_id, b.of), 0) AS p, r.n / nullif(sum(r.n) OVER (PARTITION BY b.doc_id, b.of), 0) AS q FROM bins b JOIN reference r USING (lang, of, i)
), mixed AS (
  SELECT doc_id, of, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)) / 2) AS distance
  FROM shares WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY doc_id, of
), far AS (
  SELECT f.*, CASE WHEN word_chars >= 300 THEN c.distance END AS class_distance, CASE WHEN n_words >= 80 THEN v.distance END AS word_distance
  FROM failed f LEFT JOIN mixed c ON c.doc_id = f.doc_id AND c.of = 'class' LEFT JOIN mixed v ON v.doc_id = f.doc_id AND v.of = 'word'
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(class_distance, 0) <= 0.3 AND coalesce(word_distance, 0) <= 0.3 AS kept, round(class_distance, 9) AS class_distance, round(word_distance, 9) AS word_distance FROM far
"""
)
