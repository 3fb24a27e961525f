"""Language of texts by sparse multinomial logistic regression on TF-IDF character n-grams.

Character n-grams (as bytes, 1 to 4, of the lower-cased text) fall into hashed features.
Document frequencies come from all rows that may be learned from. The regression is fitted
on a bounded sample of them by follow-the-regularised-leader with L1 and L2 penalties, which
leaves most weights exactly zero; a softmax temperature is then fitted on sample rows that
took no part. The score is the calibrated probability of the predicted language. Every
language of a learnable row is a class: the bound is on the rows of each language, and a
language with few texts up to SAMPLE_CHARS also gives whole longer ones.

Defined cases: a null text and one without any letter is `und` with score 1; null languages
are not learned from; without any language to learn every text is `und` with score 0;
repeated rows are predicted one by one; an empty table gives an empty result; texts of any length are
scored whole; of languages with equal scores the first in order is given; further
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paideon.llm.common import crc_of_id, ids_and_texts, map_batches, type_of
from paideon.llm.textblocks import LOWER_ASCII, row_groups, text_bytes
from paideon.session import stage

FEATURES = 1 << 14
SIZES = (1, 2, 3, 4)
SAMPLE_ROWS = 1500  # rows of each language that the weights are fitted on, at most
SAMPLE_CHARS = 20_000  # longer texts come into the sample only where a language has too few shorter ones
LONG_ROWS = 100  # of these, whole texts of each language, at most
FITTED_ROWS = 96_000  # rows of all languages together: with more than 64 languages each gives fewer
LEAST_ROWS = 20  # rows of each language, however many languages there are
SHARES = 1 << 40
EPOCHS = 2
L1, L2, ALPHA, BETA = 0.02, 0.1, 0.5, 1.0
UNDETERMINED = "und"

_values = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_steps = [np.uint64(0xD1B54A32D192ED03 ** (i + 1) % (1 << 64) | 1) for i in range(max(SIZES))]
# Digits, signs and white space say nothing about the language: one value for all of them.
_code = np.arange(256)
_plain = np.where((_code >= 0x80) | ((_code >= 0x61) & (_code <= 0x7A)), _code, 0x20).astype(np.uint8)


def feature_counts(column: pa.Array, a: int, b: int):
    """(row, feature, count) of the rows, sorted by row and feature."""
    data, offsets = text_bytes(column, a, b)
    text = _plain[LOWER_ASCII[data]]
    row = np.repeat(np.arange(b - a, dtype=np.int64), np.diff(offsets))
    value, h, keys = _values[text], np.zeros(len(text), np.uint64), []
    for n in range(1, max(SIZES) + 1):
        reach = len(text) - n + 1
        if reach <= 0:
            break
        h = h[:reach] + value[n - 1:] * _steps[n - 1]
        if n in SIZES:
            inside = row[:reach] == row[n - 1:]
            x = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
            feature = (x >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64)
            keys.append((row[:reach] * FEATURES + feature)[inside])
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    if (b - a) * FEATURES <= 1 << 24:
        table = np.bincount(key, minlength=(b - a) * FEATURES)
        key = np.flatnonzero(table)
        count = table[key]
    else:
        key, count = np.unique(key, return_counts=True)
    return key // FEATURES, key % FEATURES, count


def _groups(column: pa.Array):
    """Row ranges small enough for a dense table of counts."""
    for a, b in row_groups(column, 1 << 21):
        for c in range(a, b, 512):
            yield c, min(c + 512, b)


def _frequencies(batches):
    seen, rows = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for a, b in _groups(batch.column(0)):
            _, feature, _ = feature_counts(batch.column(0), a, b)
            seen += np.bincount(feature, minlength=FEATURES)
        rows += batch.num_rows
    if rows:
        feature = np.append(np.flatnonzero(seen), -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(feature, pa.int32()), pa.array(np.append(seen[feature[:-1]], rows))], ["feature", "documents"])


def inverse_frequencies(learned: DataFrame) -> np.ndarray:
    """log of rows over rows with the feature, from all rows; the result has FEATURES numbers."""
    counts = map_batches(learned.select("text"), _frequencies, [("feature", T.IntegerType()), ("documents", T.LongType())])
    found = dict(counts.groupBy("feature").agg(F.sum("documents")).collect())
    rows = found.pop(-1, 0)
    out = np.full(FEATURES, np.log(1.0 + rows) + 1)
    for feature, n in found.items():
        out[feature] = np.log((1 + rows) / (1 + n)) + 1
    return out


def tf_idf(row, feature, count, idf: np.ndarray, rows: int) -> np.ndarray:
    """Values of unit length in every row."""
    value = (1 + np.log(count)) * idf[feature]
    return value / np.sqrt(np.maximum(np.bincount(row, value ** 2, rows), 1e-12))[row]


def ftrl(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal weights (features + 1 x classes); the last feature is the intercept."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))
    order = np.random.default_rng(11)

    def weights(at):
        zi, ni = z[at], n[at]
        penalty = np.where(at == FEATURES, 0.0, L1)[:, None]
        return np.where(np.abs(zi) <= penalty, 0.0,
                        -(zi - np.sign(zi) * penalty) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for i in order.permutation(len(examples)).tolist():
            at, x = examples[i]
            w = weights(at)
            score = x @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    out = np.empty_like(z)
    for a in range(0, FEATURES + 1, 1024):
        at = np.arange(a, min(a + 1024, FEATURES + 1))
        out[at] = weights(at)
    return out


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """Divisor of the scores that makes the labels of kept-out rows likeliest."""
    if not len(labels):
        return 1.0

    def loss(t):
        s = scores / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(labels)), labels]).mean())

    low, high, golden = np.log(0.02), np.log(50.0), (5 ** 0.5 - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(np.exp(a)) <= loss(np.exp(b)) else (a, high)
    return float(np.exp((low + high) / 2))


def _bags(batches):
    """Feature counts of whole texts, packed, so that their length does not reach the driver."""
    for batch in batches:
        at, n = [], []
        for a, b in _groups(batch.column(2)):
            row, feature, count = feature_counts(batch.column(2), a, b)
            cuts = np.searchsorted(row, np.arange(b - a + 1))
            at += [feature[i:j].astype(np.int16).tobytes() for i, j in zip(cuts, cuts[1:])]
            n += [count[i:j].astype(np.int32).tobytes() for i, j in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary()), pa.array(n, pa.binary())],
                                         ["lang", "key", "features", "counts"])


def _sample(learned: DataFrame, sizes: dict, wanted: dict) -> DataFrame:
    """lang, long, key, text, n of the rows with the smallest keys; equal rows are one with their number n."""
    spark, lang = learned.sparkSession, learned.schema["lang"].dataType
    kinds = [T.StructField("lang", lang), T.StructField("long", T.BooleanType())]
    # Thin by hash to about twice the bound, then cut to it: the margin makes it next to impossible to fall short.
    shares = [(*k, min(SHARES, math.ceil((2 * n + 50) / sizes[k] * SHARES))) for k, n in wanted.items() if n > 0]
    shares = spark.createDataFrame(shares, T.StructType([*kinds, T.StructField("share", T.LongType())]))
    thin = learned.join(F.broadcast(shares), ["lang", "long"]).filter(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(SHARES)) < F.col("share"))
    thin = stage(thin.groupBy("lang", "long", "key").agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("n")), "language-sample")
    keys = {}
    for r in thin.select("lang", "long", "key", "n").collect():
        keys.setdefault((r[0], r[1]), []).append((r[2], r[3]))
    last = []
    for kind, listed in keys.items():
        listed.sort()
        rows = np.cumsum([n for _, n in listed])
        last.append((*kind, listed[min(int(np.searchsorted(rows, wanted[kind])), len(listed) - 1)][0]))
    last = spark.createDataFrame(last, T.StructType([*kinds, T.StructField("last", T.LongType())]))
    return thin.join(F.broadcast(last), ["lang", "long"]).filter("key <= last").drop("last")


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> dict:
    """Model from the rows with a language whose crc32(id) mod 3 is not 1."""
    learned = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.pmod(crc_of_id(), F.lit(3)) != 1))
    keyed = learned.select("lang", "text", F.xxhash64("doc_id", "text").alias("key"), (F.length("text") > sample_chars).alias("long"))
    # Different rows: a row that is repeated counts once where the sample is thinned.
    sizes = {(r[0], r[1]): max(r[2], 1) for r in keyed.groupBy("lang", "long").agg(F.approx_count_distinct("key")).collect()}
    names = sorted({lang for lang, _ in sizes})
    if not names:
        return {"names": [], "idf": np.zeros(FEATURES), "weights": np.zeros((FEATURES + 1, 0)), "temperature": 1.0}
    idf = inverse_frequencies(learned)
    rows = min(sample_rows, max(LEAST_ROWS, FITTED_ROWS // len(names)))
    wanted = {(lang, long): min(LONG_ROWS, max(rows - sizes.get((lang, False), 0), 0)) if long else rows for lang, long in sizes}
    sample = _sample(keyed, sizes, wanted)
    texts = sample.filter("not long").select("lang", "key", "text", "n").collect()
    texts.sort(key=lambda r: (names.index(r[0]), r[1]))
    # Equal rows come as one; each is an example until the bound of its language is met.
    labels, column, met = [], [], Counter()
    for lang, _, text, n in texts:
        n = min(n, rows - met[lang])
        met[lang] += n
        labels += [names.index(lang)] * n
        column += [text] * n
    column = pa.array(column, pa.string())
    examples = []

    def add(row, feature, count, n):
        value = tf_idf(row, feature, count, idf, n)
        cuts = np.searchsorted(row, np.arange(n + 1))
        for i in range(n):
            part = slice(cuts[i], cuts[i + 1])
            examples.append((np.append(feature[part], FEATURES), np.append(value[part], 1.0)))

    for a, b in _groups(column):
        add(*feature_counts(column, a, b), b - a)
    if any(long and n for (_, long), n in wanted.items()):
        bags = map_batches(sample.filter("long").select("lang", "key", "text"), _bags, [
            ("lang", type_of(docs, "lang")), ("key", T.LongType()), ("features", T.BinaryType()), ("counts", T.BinaryType())])
        for lang, _, feature, count in sorted(bags.collect(), key=lambda r: (names.index(r[0]), r[1])):
            feature = np.frombuffer(feature, np.int16).astype(np.int64)
            labels.append(names.index(lang))
            add(np.zeros(len(feature), np.int64), feature, np.frombuffer(count, np.int32), 1)
    labels = np.array(labels, np.int64)
    # Every fifth row of a language, never its first: a language of few rows is fitted too.
    met, kept = Counter(), np.zeros(len(labels), bool)
    for i, label in enumerate(labels.tolist()):
        met[label] += 1
        kept[i] = met[label] % 5 == 0
    fitted, judge = np.flatnonzero(~kept), np.flatnonzero(kept)
    weights = ftrl([examples[i] for i in fitted], labels[fitted], len(names))
    scores = np.array([examples[i][1] @ weights[examples[i][0]] for i in judge]).reshape(len(judge), len(names))
    return {"names": names, "idf": idf, "weights": weights, "temperature": temperature(scores, labels[judge])}


def _predict(model: dict):
    def predict(batches):
        names, idf, weights = [*model["names"], UNDETERMINED], model["idf"], model["weights"]
        classes = len(names) - 1
        for batch in batches:
            texts = batch.column(1)
            best, top = np.full(len(texts), classes, np.int64), np.full(len(texts), 1.0 if classes else 0.0)
            letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            for a, b in _groups(texts) if classes else ():
                row, feature, count = feature_counts(texts, a, b)
                value = tf_idf(row, feature, count, idf, b - a)
                scores = np.stack([np.bincount(row, value * weights[feature, c], b - a) for c in range(classes)], 1)
                scores = (scores + weights[FEATURES]) / model["temperature"]
                p = np.exp(scores - scores.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                known = letters[a:b]
                best[a:b][known] = p.argmax(1)[known]
                top[a:b][known] = p.max(1)[known]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()).take(pa.array(best)), pa.array(np.minimum(top, 1.0))],
                ["doc_id", "lang_pred", "score"])

    return predict


def predict(docs: DataFrame, model: dict) -> DataFrame:
    return map_batches(ids_and_texts(docs), _predict(model), [
        ("doc_id", type_of(docs, "doc_id")), ("lang_pred", T.StringType()), ("score", T.DoubleType())])


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    return predict(docs, fit(docs)).select(
        "doc_id", F.coalesce(F.pmod(crc_of_id(), F.lit(3)) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
