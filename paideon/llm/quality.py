"""Quality rules and a target-against-corpus likelihood ratio, with DataFrame functions only.

Word n-grams (one and two words) are hashed into buckets. Two smoothed multinomials over the
buckets are counted from whole texts, one over all documents (raw corpus), one over the trusted
documents; the gain of a bucket is the log ratio of the two in thousandths. A document is kept
if it passes the base rules and the mean gain of its n-grams is at least a fixed threshold; sums
are whole numbers, so the verdict does not depend on the order of rows or tasks.

The gains are one array of `BUCKETS` numbers, so scoring a document is arithmetic on its own
row, without a shuffle.

Defined cases: a null, empty or blank text has no words and fails the base rules; an id that is null or
is labelled both ways is not trusted; all rows of a trusted id are; without trusted words every gain is 0,
so the base rules decide alone; a mean gain equal to the threshold is kept; repeated rows are counted
and judged one by one; texts of any length are judged whole; an empty table gives no row; further
columns are not read by `report` and pass through `kept_documents` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paideon.llm.common import row_key, whole_text, without
from paideon.session import stage

BUCKETS = 1 << 16
PAIR_FACTOR = 31  # hash of two words: first * PAIR_FACTOR + second
LEAST_WORDS = 20
WINDOW_WORDS = 8
REPEAT_PERCENT = 30
LEAST_MEAN_GAIN = -100  # thousandths per n-gram; set on labelled rows, see README
SYMBOLS = "#*$%&|<>"
SPACES = r"[\x20\x09-\x0D]+"
_GAINS = "array<int>"


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def word_hashes(w: str) -> Column:
    """crc32 of each word."""
    return F.transform(w, lambda x: F.crc32(x.cast("binary")))


def after(h: str) -> Column:
    """The hash of the next word at the place of each word, null at the last."""
    return F.slice(h, F.lit(2), F.size(h))


def pair_hash(a: Column, b: Column) -> Column:
    return a * PAIR_FACTOR + b


def bucket_counts(docs: DataFrame, count: int = BUCKETS) -> DataFrame:
    """bucket, n over all n-grams of whole texts."""
    hashed = docs.select(words(whole_text()).alias("w")).select(word_hashes("w").alias("h"))
    gram = F.explode(F.concat("h", F.zip_with("h", after("h"), pair_hash))).alias("gram")
    return (hashed.select(gram).filter("gram is not null")
            .groupBy((F.col("gram") % count).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n")))


def trusted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows whose id is labelled good and nowhere labelled otherwise."""
    ids = labels.groupBy("doc_id").agg(F.min("quality").alias("least"), F.max("quality").alias("most")).filter(
        "doc_id is not null and least = 1 and most = 1").select(F.col("doc_id").alias("trusted_id"))
    # The ids grow with the documents, so they are shuffled at every size.
    return docs.select("doc_id", whole_text().alias("text")).join(ids.hint("merge"), F.col("doc_id") == F.col("trusted_id"), "left_semi")


def gains(docs: DataFrame, trusted: DataFrame, count: int = BUCKETS) -> list[int]:
    """Gain of every bucket; `count` rows reach the driver."""
    both = bucket_counts(docs, count).withColumnRenamed("n", "s").join(
        bucket_counts(trusted, count).withColumnRenamed("n", "t"), "bucket", "full").select(
        "bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    counted = stage(both, "buckets")
    total = counted.agg(F.sum("s"), F.sum("t")).first()
    if not total[1]:
        return [0] * count

    def gain(s: Column, t: Column) -> Column:
        ratio = (t + 1) * F.lit(float(total[0] + count)) / ((s + 1) * F.lit(float(total[1] + count)))
        return F.floor(1000 * F.log(ratio)).cast("int")

    absent = counted.sparkSession.range(1).select(gain(F.lit(0.0), F.lit(0.0))).first()[0]
    found = [absent] * count
    for r in counted.select("bucket", gain(F.col("s").cast("double"), F.col("t").cast("double")).alias("gain")).collect():
        found[r.bucket] = r.gain
    return found


def repeated_words(w: str, h: str) -> tuple[Column, Column, Column]:
    """Steps to the number of words inside windows that occur twice or more in the text.

    Windows with their places, sorted, of texts in which two windows agree in their word hashes;
    places of the windows that occur twice; words that these cover.
    """
    size = WINDOW_WORDS
    starts = F.sequence(F.lit(0), F.size(w) - size)
    screen = F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)]))
    placed = F.sort_array(F.transform(starts, lambda i: F.struct(F.xxhash64(F.slice(w, i + 1, size)).alias("k"), i.alias("i"))))
    found = F.when(F.when(F.size(w) >= size, F.size(F.array_distinct(screen)) < F.size(w) - size + 1), placed).otherwise(
        F.array().cast("array<struct<k:bigint,i:int>>"))
    twice = F.filter("placed", lambda x, j: (
        F.coalesce(F.get("placed", j - 1)["k"] == x["k"], F.lit(False)) | F.coalesce(F.get("placed", j + 1)["k"] == x["k"], F.lit(False))))
    at = F.sort_array(F.transform(twice, lambda x: x["i"]))
    fresh = F.transform("at", lambda i, j: F.least(F.lit(size), F.coalesce(F.get("at", j + 1) - i, F.lit(size))).cast("long"))
    return found, at, F.aggregate(fresh, F.lit(0).cast("long"), lambda a, b: a + b)


def symbols(text: Column) -> Column:
    rest = text
    for c in SYMBOLS:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.octet_length(text) - F.octet_length(rest)).cast("long")


def report(docs: DataFrame, trusted: DataFrame, least_gain: int = LEAST_MEAN_GAIN, count: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, base features, base_failed, n_grams, weight, kept, text_hash of every row."""
    # A literal that Spark folds into one array on the driver: 65,536 ints at any size of the corpus.
    gain = F.split(F.lit(",".join(map(str, gains(docs, trusted, count)))), ",").cast(_GAINS)
    placed, at, repeats = repeated_words("w", "h")
    text = whole_text()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    zero = F.lit(0).cast("long")
    read = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), words(text).alias("w"), lines.alias("lines"),
                       symbols(text).alias("n_symbols"))
    hashed = read.select(
        "doc_id", "text_hash", "n_symbols", F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "w", word_hashes("w").alias("h"))
    near = hashed.select("*", placed.alias("placed"))
    covered = near.select("*", at.alias("at"))
    gained = F.zip_with("h", after("h"), lambda a, b: F.get(gain, (a % count).cast("int")) + F.coalesce(
        F.get(gain, (pair_hash(a, b) % count).cast("int")), F.lit(0)))
    scored = covered.select(
        "doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats.alias("n_repeat_words"),
        F.greatest(2 * F.col("n_words") - 1, zero).alias("n_grams"),
        F.aggregate(gained, zero, lambda a, b: a + b).alias("weight"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    # Written, as a filter of the caller would else be pushed down into every lambda above.
    return stage(scored, "quality").withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("weight") >= least_gain * F.col("n_grams")))


def kept_documents(docs: DataFrame, trusted: DataFrame, **parameters) -> DataFrame:
    """The documents that are kept, every column as it came."""
    gone = report(docs, trusted, **parameters).filter("not kept").select(*row_key()).distinct()
    return without(docs, gone)
