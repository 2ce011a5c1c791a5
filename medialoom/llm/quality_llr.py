"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions alone.

Two multinomials over hashed words and pairs of words are counted: one over the trusted target (documents that every
label calls good and none toxic), one over all documents. A document's score is the mean log ratio of the two over its
n-grams; below `threshold` it is not kept, and neither is one that fails the base rules.

The ratios of all buckets are one string of a byte each (so wide as BUCKETS, whatever the corpus), which is a constant
of the scoring expression; a document is scored in its row, so texts are never exploded over a shuffle. Counting shuffles
a number per bucket and task.

Defined results: a null text has no words; a document of no n-gram has score 0; unlabelled corpora, where there is no
target, score 0 throughout; repeated rows get a row each and count each; a document with several labels is trusted if all
of them say so. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialoom.llm.shared import let

BUCKETS = 1 << 20
HALF = BUCKETS // 2
#: Counts that both multinomials are given beforehand, in proportion to the raw one: what is rare says little, so that a
#: clean document that nobody labelled is not held against its own rare words.
SMOOTH = 3.0
#: A byte b from 1 to 127 stands for a log ratio of (b - ZERO) * STEP.
ZERO, STEP = 64, 0.1
THRESHOLD = -0.3
LABELS_BROADCAST = 2_000_000
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def pair(u: Column, i: Column) -> Column:
    return F.xxhash64(F.get(u, i), F.get(u, i + 1))


def upto(n: Column) -> Column:
    """0 to n - 1, or nothing."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def repeated(u: Column, width: int = 3) -> Column:
    """Words that lie in a run of three words found twice or more; u: the words' hashes."""
    runs = F.transform(upto(F.size(u) - (width - 1)), lambda i: F.xxhash64(*(F.get(u, i + k) for k in range(width))))

    def covered(p: Column) -> Column:
        return F.aggregate(upto(F.size(p)), F.lit(0), lambda a, i: a + F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - F.get(p, i), F.lit(width))))

    def found(s: Column) -> Column:
        twin = lambda i: F.coalesce(F.get(s, i)["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(F.get(s, i)["h"] == F.get(s, i + 1)["h"], F.lit(False))
        return let(F.sort_array(F.transform(F.filter(upto(F.size(s)), twin), lambda i: F.get(s, i)["i"])), covered)

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), found))

    return let(runs, count)


def grams(u: Column) -> Column:
    """The buckets of a text's words and pairs of words."""
    one = F.transform(u, lambda x: F.pmod(x, F.lit(HALF)).cast("int"))
    two = F.transform(upto(F.size(u) - 1), lambda i: (F.pmod(pair(u, i), F.lit(HALF)) + HALF).cast("int"))
    return F.concat(one, two)


def ratio_table(docs: DataFrame, labels: DataFrame) -> bytes:
    """A byte for each bucket."""
    trusted = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1), F.lit(False)).cast("int")).alias("t")).where("t = 1").select("doc_id", F.lit(1).alias("trusted"))
    trusted = F.broadcast(trusted) if labels.count() <= LABELS_BROADCAST else trusted
    rows = docs.select("doc_id", "text").join(trusted, "doc_id", "left").select("trusted", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("u"))
    rows = rows.select("trusted", F.explode(let(F.col("u"), grams)).alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
    spark = docs.sparkSession
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    chunk = 1 << 10
    parts = every.groupBy(F.floor(F.col("bucket") / chunk).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("all")).persist()
    sums = parts.select(F.explode("all").alias("x")).agg(F.sum("x.raw").alias("raw"), F.sum("x.target").alias("target")).first()
    if not sums["raw"] or not sums["target"]:
        parts.unpersist()
        return bytes([ZERO]) * BUCKETS
    share = sums["target"] / sums["raw"]
    ratio = lambda x: F.log((x["target"] + SMOOTH) / (x["raw"] * share + SMOOTH))
    letter = lambda x: F.char(F.greatest(F.lit(1), F.least(F.lit(127), F.round(ratio(x) / STEP).cast("int") + ZERO)))
    said = parts.select("chunk", F.array_join(F.transform("all", letter), "").alias("said")).collect()  # BUCKETS characters
    parts.unpersist()
    return "".join(r["said"] for r in sorted(said, key=lambda r: r["chunk"])).encode()


def scored(docs: DataFrame, table: bytes, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: doc_id, the base figures, base_failed, score and kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    of = F.lit(bytearray(table))
    value = lambda bucket: F.ascii(F.substring(of, bucket + 1, F.lit(1)).cast("string")) - ZERO

    def total(u: Column) -> Column:
        one = F.aggregate(u, F.lit(0), lambda a, x: a + value(F.pmod(x, F.lit(HALF)).cast("int")))
        two = F.aggregate(upto(F.size(u) - 1), F.lit(0), lambda a, i: a + value((F.pmod(pair(u, i), F.lit(HALF)) + HALF).cast("int")))
        return one + two

    def of_words(w: Column) -> Column:
        return let(F.transform(w, lambda x: F.xxhash64(x)), lambda u: F.struct(F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("chars"), repeated(u).alias("repeated"), total(u).alias("total")))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select("doc_id", let(words(F.col("text")), of_words).alias("f"), F.regexp_count(text, F.lit(SYMBOLS)).alias("symbols"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("lines"))
    n = F.col("f")["n"]
    rows = rows.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.col("f")["chars"].cast("long").alias("word_chars"),
        F.col("symbols").cast("long").alias("n_symbols"),
        F.col("lines").cast("long").alias("n_dup_lines"),
        F.col("f")["repeated"].cast("long").alias("n_repeat_words"),
        ((n < 50) | (100 * F.col("f")["repeated"] > 50 * n)).alias("base_failed"),
        F.when(n > 0, F.col("f")["total"] * STEP / (2 * n - 1)).otherwise(0.0).alias("score"),
    )
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored(docs, ratio_table(docs, labels), threshold)
