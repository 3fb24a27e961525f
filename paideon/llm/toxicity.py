"""Toxicity from subword bags: embeddings of character n-grams, averaged, into a softmax.

A word is the bag of its byte n-grams (3 to 5, with word edges), a segment of a few words
the average of its words, and a document is scored by its most toxic segment, so one
insult in a long text is not averaged away and an unseen misspelling shares most n-grams
with the words it comes from. Embeddings and softmax are trained together in numpy on a
bounded sample of labelled rows; a last logistic fit on rows kept out of that training sets
slope and bias of the score.

After training the model is linear below the pooling, so every n-gram is one number: scoring
is a lookup and three running sums over the bytes of a text.

Defined cases: a null or empty text scores the share of toxic rows among the labels; a document without
label is scored like any other; labels that are null, or that contradict each other for one
id, are not learned from; a score of exactly one half is toxic; repeated rows are scored one by one; without labels of both
classes every score is the sigmoid of -30, about 1e-13; texts of any length are learned from and scored whole; rows equal in
id and text are one row of the sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paideon.llm.common import crc_of_id, ids_and_texts, map_batches, type_of, whole_text
from paideon.llm.textblocks import LOWER_ASCII, NOT_ALPHANUMERIC, row_groups, text_bytes
from paideon.session import stage

SAMPLE_ROWS = 800  # labelled rows of either class that are learned from, at most
SAMPLE_CHARS = 6_000_000  # and their characters; rows are taken whole, short ones first, the first one in any case
SHORT_CHARS = 20_000
BUCKETS = 1 << 18
DIMENSIONS = 8
SEGMENT_WORDS = 8
EPOCHS = 14
LEARNED_MODS = (1, 2, 3, 4)  # crc32(id) mod 5 of rows that may be learned from

_values = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_steps = [np.uint64(0x9E3779B97F4A7C15 ** (i + 1) % (1 << 64) | 1) for i in range(5)]
_edge = np.uint8(0x20)


class Grams:
    """n-gram buckets of rows of text, each with the word and segment that it belongs to."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        # One edge byte before each row and one after the last keep words of rows apart.
        size = len(data) + len(offsets)
        place = np.arange(len(data)) + np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
        text = np.full(size, _edge)
        text[place] = LOWER_ASCII[data]
        text[NOT_ALPHANUMERIC[text]] = _edge
        inside = text != _edge
        begin = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        row_edge = offsets + np.arange(len(offsets))
        first = np.searchsorted(begin, row_edge)
        self.words_of_row = np.diff(first)
        n_words = len(begin)
        # Segments restart in every row.
        in_row = np.arange(n_words) - np.repeat(first[:-1], self.words_of_row)
        self.segments_of_row = -(-self.words_of_row // SEGMENT_WORDS)
        base = np.concatenate([[0], np.cumsum(self.segments_of_row)])
        self.segment_of_word = np.repeat(base[:-1], self.words_of_row) + in_row // SEGMENT_WORDS
        self.words_in_segment = np.bincount(self.segment_of_word, minlength=int(base[-1]))
        self.text, self.begin, self.end = text, begin, end

    def sizes(self):
        """(bucket, word) of every n-gram, one size after the other, then of whole short words."""
        value = _values[self.text]
        h = np.zeros(len(value), np.uint64)
        length = self.end - self.begin + 2  # with both edges
        for n in range(1, 6):
            reach = len(value) - n + 1
            if reach <= 0:
                return
            h = h[:reach] + value[n - 1:] * _steps[n - 1]
            if n < 3:
                continue
            grams = np.maximum(length - n + 1, 0)
            word = np.repeat(np.arange(len(grams)), grams)
            at = np.arange(len(word)) - np.repeat(np.cumsum(grams) - grams, grams) + (self.begin - 1)[word]
            x = h[at]
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            yield (x >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), word

    def gram_counts(self) -> np.ndarray:
        length = self.end - self.begin + 2
        return sum(np.maximum(length - n + 1, 0) for n in (3, 4, 5))


def row_scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Largest segment logit of each row, NaN without words; `weights` has one number per bucket."""
    grams = Grams(data, offsets)
    total = np.zeros(len(grams.begin))
    for bucket, word in grams.sizes():
        total += np.bincount(word, weights[bucket], len(total))
    word_score = total / np.maximum(grams.gram_counts(), 1)
    segments = len(grams.words_in_segment)
    logit = np.bincount(grams.segment_of_word, word_score, segments) / np.maximum(grams.words_in_segment, 1) + bias
    out = np.full(len(grams.segments_of_row), np.nan)
    has = grams.segments_of_row > 0
    if has.any():
        begin = np.cumsum(grams.segments_of_row) - grams.segments_of_row
        out[has] = np.maximum.reduceat(logit, begin[has])
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Sample:
    """Labelled texts as segments of words of n-gram buckets."""

    def __init__(self, texts: list[str]):
        column = pa.array(texts, pa.string())
        bucket, per_word, segment, per_segment, row = [], [], [], [], []
        segments = 0
        for a, b in row_groups(column, 1 << 18):
            grams = Grams(*text_bytes(column, a, b))
            parts = list(grams.sizes())
            if parts:
                word = np.concatenate([w for _, w in parts])
                order = np.argsort(word, kind="stable")
                bucket.append(np.concatenate([x for x, _ in parts])[order].astype(np.int32))
            per_word.append(grams.gram_counts().astype(np.int32))
            segment.append((grams.segment_of_word + segments).astype(np.int32))
            per_segment.append(grams.words_in_segment)
            row.append(np.repeat(np.arange(a, b), grams.segments_of_row))
            segments += len(grams.words_in_segment)
        self.bucket = np.concatenate(bucket) if bucket else np.zeros(0, np.int32)
        self.per_word = np.concatenate(per_word)
        self.word_first = np.concatenate([[0], np.cumsum(self.per_word, dtype=np.int64)])
        self.segment_of_word = np.concatenate(segment)
        self.per_segment = np.concatenate(per_segment)
        self.row = np.concatenate(row)
        self.segments = segments
        self.segment_first = np.searchsorted(self.segment_of_word, np.arange(segments + 1, dtype=np.int32))

    def logits(self, weights: np.ndarray) -> np.ndarray:
        score = np.zeros(len(self.per_word))
        for a in range(0, len(score), 1 << 16):  # a slice of words at a time keeps the driver small
            size = self.per_word[a:a + (1 << 16)]
            values = weights[self.bucket[self.word_first[a]:self.word_first[a + len(size)]]]
            score[a:a + len(size)] = np.bincount(np.repeat(np.arange(len(size)), size), values, len(size)) / np.maximum(size, 1)
        return np.bincount(self.segment_of_word, score, self.segments) / np.maximum(self.per_segment, 1)

    def items(self, segments: np.ndarray):
        """Buckets, weights and segment position of every n-gram of the segments."""
        words = _ranges(self.segment_first[segments], self.segment_first[segments + 1])
        position = np.repeat(np.arange(len(segments)), self.segment_first[segments + 1] - self.segment_first[segments])
        grams = _ranges(self.word_first[words], self.word_first[words + 1])
        of = np.repeat(np.arange(len(words)), self.word_first[words + 1] - self.word_first[words])
        share = 1 / (np.maximum(self.per_word[words], 1) * self.per_segment[segments][position])
        return self.bucket[grams], share[of], position[of]


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - begin
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5):
    """(number per bucket, bias): Adagrad on embeddings and softmax over chosen segments.

    First every segment of a toxic text stands for it, later only its most toxic ones;
    of other texts the most toxic segments and random ones.
    """
    rng = np.random.default_rng(seed)
    sample, labels = _Sample(texts), np.asarray(labels)
    table = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    top = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    table_sq, top_sq = np.full(BUCKETS, 1e-6, np.float32), np.full((DIMENSIONS, 2), 1e-6, np.float32)
    toxic = labels[sample.row] == 1
    every = np.arange(sample.segments)
    for epoch in range(epochs):
        if epoch < 2:
            other = every[~toxic]
            chosen = [every[toxic], rng.choice(other, min(len(other), int(toxic.sum())), replace=False)]
        else:
            logit = sample.logits(table @ (top[:, 1] - top[:, 0]))
            best = np.lexsort((-logit, sample.row))
            rank = np.arange(len(best)) - np.searchsorted(sample.row[best], sample.row[best])
            other = every[~toxic]
            chosen = [best[(rank < 2) & ~toxic[best]], rng.choice(other, min(len(other), len(labels)), replace=False),
                      best[(rank == 0) & toxic[best]], best[(rank == 0) & toxic[best]],
                      best[(rank > 0) & (rank < 4) & toxic[best] & (logit[best] + bias[1] - bias[0] > 1)]]
        chosen = rng.permutation(np.concatenate(chosen))
        rate = 0.4 if epoch < 2 else 0.25
        for at in range(0, len(chosen), 512):
            part = chosen[at:at + 512]
            bucket, share, position = sample.items(part)
            near, inverse = np.unique(bucket, return_inverse=True)
            mean = np.zeros((len(part), DIMENSIONS), np.float32)
            rows = table[bucket] * share[:, None].astype(np.float32)
            first = np.searchsorted(position, np.arange(len(part)))
            filled = np.diff(np.append(first, len(position))) > 0
            if filled.any():
                mean[filled] = np.add.reduceat(rows, first[filled])
            z = mean @ top + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), toxic[part].astype(int)] -= 1
            weight = np.float32(0.05) if epoch < 2 else np.float32(1)
            p *= weight
            grad_top = mean.T @ p / len(part) ** 0.5
            grad_mean = p @ top.T
            grad = np.empty((len(near), DIMENSIONS), np.float32)
            pull = grad_mean[position] * share[:, None]
            for d in range(DIMENSIONS):
                grad[:, d] = np.bincount(inverse, pull[:, d], len(near))
            table_sq[near] += (grad ** 2).mean(1)
            table[near] -= rate * grad / np.sqrt(table_sq[near])[:, None]
            top_sq += grad_top ** 2
            top -= 0.1 * grad_top / np.sqrt(top_sq)
            bias -= 0.05 * p.sum(0) / len(part)
    return (table @ (top[:, 1] - top[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def scored(logit: np.ndarray, model: dict) -> np.ndarray:
    """Calibrated scores; a text without words gets the share of toxic rows."""
    return np.where(np.isnan(logit), model["prior"], _sigmoid(model["slope"] * logit + model["intercept"]))


def calibrate(logit: np.ndarray, label: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and intercept of a logistic fit by Newton steps, lightly held back.

    Rows are weighted so that the toxic ones have the share `prior`.
    """
    words = ~np.isnan(logit)
    logit, label = logit[words], label[words]
    if len(set(label.tolist())) < 2:
        return 1.0, 0.0
    weight = np.where(label == 1, prior / label.mean(), (1 - prior) / (1 - label.mean()))
    centre, scale = float(np.mean(logit)), float(np.std(logit)) or 1.0
    x = np.stack([(logit - centre) / scale, np.ones(len(logit))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ w)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([0.05, 1e-6])
        step = np.linalg.solve(h, x.T @ (weight * (p - label)) + np.array([0.05 * w[0], 0.0]))
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    slope = max(w[0], 1e-3) / scale
    return slope, float(w[1] - slope * centre)


def sampled(docs: DataFrame, labels: DataFrame, rows: int, chars: int) -> tuple[DataFrame, float]:
    """text, toxic of the rows that are learned from, and the share of toxic rows among the labels."""
    known = (labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()
                           & F.pmod(crc_of_id(), F.lit(5)).isin(*LEARNED_MODS))
             .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
             .filter("toxic = other").select(F.col("doc_id").alias("label_id"), "toxic"))
    prior = float(known.agg(F.avg("toxic")).first()[0] or 0.0)
    # Only ids, hashes and lengths of the labelled rows move, and only rows that exist are counted.
    sizes = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_hash"), F.char_length(whole_text()).alias("size")).distinct()
    there = stage(sizes.join(known, F.col("doc_id") == F.col("label_id")).select("doc_id", "text_hash", "size", "toxic"), "labelled")
    order = [F.col("size") > SHORT_CHARS, F.xxhash64("doc_id"), F.col("doc_id"), F.col("text_hash")]
    wanted = []
    for label, most in ((1, rows), (0, 2 * rows)):
        total = 0
        for r in there.filter(F.col("toxic") == label).orderBy(*order).limit(most).collect():
            if total and total + r["size"] > chars:
                continue
            total += r["size"]
            wanted.append((r["doc_id"], r["text_hash"], label))
    kind = T.StructType([T.StructField("key_id", type_of(docs, "doc_id")), T.StructField("key_hash", T.LongType()), T.StructField("toxic", T.IntegerType())])
    # 3 x rows ids at most, so the broadcast side is bounded by the parameter.
    keys = F.broadcast(docs.sparkSession.createDataFrame(wanted, kind))
    texts = docs.select("doc_id", whole_text().alias("text")).join(
        keys, (F.col("doc_id") == F.col("key_id")) & (F.xxhash64("text") == F.col("key_hash")))
    return texts.groupBy("key_id", "key_hash").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")), prior


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict:
    """Model from at most `rows` toxic and 2 x `rows` other rows that may be learned from, of `chars` characters each."""
    sample, prior = sampled(docs, labels, rows, chars)
    found = sample.orderBy(F.xxhash64("key_id"), "key_id", "key_hash").select("text", "toxic").collect()
    texts, toxic = [r[0] for r in found], np.array([r[1] for r in found], np.int64)
    if len(set(toxic.tolist())) < 2:
        return {"weights": np.zeros(BUCKETS, np.float32), "bias": 0.0, "slope": 1.0, "intercept": -30.0, "prior": 0.0}
    kept = np.arange(len(texts)) % 5 == 0
    if len(set(toxic[kept].tolist())) < 2 or len(set(toxic[~kept].tolist())) < 2:
        kept = np.zeros(len(texts), bool)
    weights, bias = train([t for t, k in zip(texts, kept) if not k], toxic[~kept])
    judge = np.flatnonzero(kept) if kept.any() else np.arange(len(texts))
    column = pa.array([texts[i] for i in judge], pa.string())
    logit = row_scores(*text_bytes(column, 0, len(judge)), weights, bias)
    slope, intercept = calibrate(logit, toxic[judge].astype(float), prior)
    return {"weights": weights.astype(np.float32), "bias": bias, "slope": slope, "intercept": intercept, "prior": prior}


def _score(model: dict):
    def score(batches):
        weights = model["weights"].astype(np.float64)
        for batch in batches:
            parts = []
            for a, b in row_groups(batch.column(1), 1 << 20):
                logit = row_scores(*text_bytes(batch.column(1), a, b), weights, model["bias"])
                parts.append(scored(logit, model))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], ["doc_id", "score"])

    return score


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every whole text."""
    return map_batches(ids_and_texts(docs), _score(model), [("doc_id", type_of(docs, "doc_id")), ("score", T.DoubleType())])


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return scores(docs, fit(docs, labels)).select(
        "doc_id", F.coalesce(F.pmod(crc_of_id(), F.lit(5)) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, model: dict) -> DataFrame:
    """Documents scored under one half, with all their columns; texts are read and scored once."""
    names = docs.columns
    lined = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), whole_text().alias("text"))

    def keep(batches):
        weights = model["weights"].astype(np.float64)
        for batch in batches:
            parts = [row_scores(*text_bytes(batch.column(1), a, b), weights, model["bias"])
                     for a, b in row_groups(batch.column(1), 1 << 20)]
            logit = np.concatenate(parts) if parts else np.zeros(0)
            clean = scored(logit, model) < 0.5
            rows = batch.column(0).filter(pa.array(clean))
            yield pa.RecordBatch.from_arrays([rows], ["row"])

    return map_batches(lined, keep, [("row", lined.schema["row"].dataType)]).select("row.*")
