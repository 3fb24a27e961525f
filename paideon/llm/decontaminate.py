"""Benchmark decontamination with DataFrame functions only.

Benchmark texts become normalised word windows. A bit table of the hashes of their first words, of
at most TABLE_BITS whatever their number, goes to all tasks; every position of a document is screened against it
(no window can fail the screen), and positions that pass are joined with the windows in full, word for word.
The join is broadcast only where Spark finds the windows small.
Hit positions become covered spans, counts and, by the rule of the caller, documents that go.

Defined cases: a null text has no words; an item without words has no windows and one with
fewer words than a window is one window; a null item_id counts as no item but its windows
hit; equal items are all named; repeated rows are judged one by one; an empty benchmark
hits nothing; texts of any length are scanned whole; exactly a twentieth of the words is contaminated; further columns of any name pass through `clean_documents` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paideon.llm.common import row_key, whole_text, without
from paideon.session import stage

WINDOW_WORDS = 13
SCREEN_WORDS = 3
TABLE_BITS = 1 << 25  # 4 MB; 64 bits for each start of a window until then, fewer beyond
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), NOT_WORD), lambda w: w != "")


def key_at(array: str, at: Column, size: int) -> Column:
    """`size` words of the array from the index on, as text."""
    return F.concat_ws(" ", *[F.get(array, at + j) for j in range(size)])


def screen_hash(array: str, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(array, at + j) for j in range(size)])


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """item_id, n (words of the window), key, screen (hash of its first words)."""
    items = benchmark.select("item_id", words(whole_text()).alias("w")).filter(F.size("w") > 0)
    shorter = F.least(F.size("w"), F.lit(size))

    def one(i: Column) -> Column:
        key = F.array_join(F.slice("w", i + 1, shorter), " ")
        screen = F.lit(None).cast("long")
        for q in range(1, SCREEN_WORDS + 1):
            fits = shorter == q if q < SCREEN_WORDS else shorter >= q
            screen = F.when(fits, screen_hash("w", i, q)).otherwise(screen)
        return F.struct(shorter.alias("n"), key.alias("key"), screen.alias("screen"))

    starts = F.sequence(F.lit(0), F.size("w") - shorter)
    return items.select("item_id", F.inline(F.transform(starts, one))).distinct()


def _screen(windows: DataFrame, most_bits: int) -> dict[int, tuple[Column, int]]:
    """Bit table (as 64-bit numbers) and its size by the number of first words; at most `most_bits` / 64 rows reach the driver."""
    starts = windows.select(F.least("n", F.lit(SCREEN_WORDS)).alias("q"), "screen").distinct()
    tables = {}
    for q, count in starts.groupBy("q").count().collect():
        bits = 1 << 12
        while bits < 64 * count and bits < most_bits:
            bits *= 2
        slot = F.pmod("screen", F.lit(bits))
        filled = starts.filter(F.col("q") == q).select(F.shiftright(slot, 6).alias("at"), slot.bitwiseAND(63).alias("bit")).distinct()
        numbers = [0] * (bits >> 6)
        for r in filled.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("number")).collect():
            numbers[r["at"]] = r["number"]
        # Spark folds this into one array on the driver.
        tables[q] = F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>"), bits
    return tables


def _passes(screen: dict[int, tuple[Column, int]]):
    def passes(i: Column) -> Column:
        ok = F.lit(False)
        for q, (table, bits) in sorted(screen.items(), reverse=True):
            slot = F.pmod(screen_hash("w", i, q), F.lit(bits))
            hit = F.getbit(F.get(table, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(63).cast("int")) == 1
            ok = ok | ((i + q <= F.size("w")) & hit)
        return ok

    return passes


def scan(docs: DataFrame, windows: DataFrame, sizes: list[int], screen: dict[int, tuple[Column, int]]) -> DataFrame:
    """row_no, doc_id, text_hash, n_words and the candidate windows (at, n, key) of every row."""
    listed = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_hash"), words(whole_text()).alias("w"))
    # `w` is used many times below, which keeps it a column of its own.
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), _passes(screen))
    found = listed.select(
        "doc_id", "text_hash", F.size("w").alias("n_words"), "w",
        F.when((F.size("w") > 0) & F.lit(bool(sizes)), at).otherwise(F.array().cast("array<int>")).alias("starts"))
    tried = F.flatten(F.transform("starts", lambda i: F.array(*[
        F.struct(i.alias("at"), F.lit(n).alias("n"),
                 F.when(i + n <= F.size("w"), key_at("w", i, n)).alias("key")) for n in sizes or [1]])))
    return found.select(
        F.monotonically_increasing_id().alias("row_no"), "doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"),
        F.filter(tried, lambda c: c["key"].isNotNull()).alias("tried"))


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS,
         most_bits: int = TABLE_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scanned rows, hits (row_no, at, n, key) and windows by item."""
    windows = stage(benchmark_windows(benchmark, size), "windows")
    sizes = sorted(r[0] for r in windows.select("n").distinct().collect())  # `size` values at most
    scanned = stage(scan(docs, windows, sizes, _screen(windows, most_bits)), "scanned")
    tried = scanned.filter(F.size("tried") > 0).select("row_no", F.inline("tried"))
    return scanned, stage(tried.join(windows.select("key").distinct(), "key", "left_semi"), "hits"), windows


def covered(hit: DataFrame) -> DataFrame:
    """row_no and n_hit: words inside any hit, each counted once."""
    w = Window.partitionBy("row_no").orderBy("at")
    before = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = hit.groupBy("row_no", "at").agg((F.max("n") + F.col("at")).alias("end"))
    fresh = spans.withColumn("fresh", F.greatest(F.col("end") - F.greatest(F.col("at"), before), F.lit(0)))
    return fresh.groupBy("row_no").agg(F.sum("fresh").alias("n_hit"))


def hit_items(hit: DataFrame, windows: DataFrame) -> DataFrame:
    """row_no, n_items, items: the items of which a window occurs."""
    pairs = hit.select("row_no", "key").distinct().join(
        windows.filter("item_id is not null").select("item_id", "key"), "key").select("row_no", "item_id").distinct()
    return pairs.groupBy("row_no").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS,
           most_bits: int = TABLE_BITS) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, text_hash."""
    scanned, hit, windows = hits(docs, benchmark, size, most_bits)
    n_hit = F.coalesce("n_hit", F.lit(0))
    return (scanned.select("row_no", "doc_id", "text_hash", "n_words")
            .join(covered(hit), "row_no", "left").join(hit_items(hit, windows), "row_no", "left")
            .select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
                    F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
                    ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "text_hash"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents of which less than a twentieth of the words is benchmark text."""
    gone = report(docs, benchmark).filter("contaminated").select(*row_key()).distinct()
    return without(docs, stage(gone, "contaminated"))


def without_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and the words outside every hit, for callers that cut spans instead of documents.

    Spans are named by id and text: rows equal in both have the same spans.
    """
    scanned, hit, _ = hits(docs, benchmark)
    of_row = scanned.select("row_no", *row_key())
    spans = hit.join(of_row, "row_no").groupBy("key_id", "key_hash").agg(F.collect_set(F.struct("at", "n")).alias("spans"))
    texts = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_hash"), words(whole_text()).alias("w"))
    same = F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("text_hash") == F.col("key_hash"))
    left = F.filter(F.col("w"), lambda x, i: ~F.exists(
        F.coalesce("spans", F.array().cast("array<struct<at:int,n:int>>")), lambda s: (i >= s["at"]) & (i < s["at"] + s["n"])))
    return texts.join(spans, same, "left").select("doc_id", F.array_join(left, " ").alias("text"))
