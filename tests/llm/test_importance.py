"""Importance resampling against a plain version with zlib."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paideon.llm import importance

SCHEMA = "doc_id long, text string, rank int, row string, key_id long"


@given(st.lists(st.binary(min_size=1, max_size=700), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_codes_are_those_of_zlib(parts):
    data = np.frombuffer(b"".join(parts), np.uint8)
    end = np.cumsum([len(p) for p in parts])
    got = importance.span_codes(data, end - [len(p) for p in parts], end)
    assert got.tolist() == [zlib.crc32(p) for p in parts]


def test_code_of_a_very_long_span():
    data = np.frombuffer(random.Random(5).randbytes(200_001), np.uint8)
    got = importance.span_codes(data, np.array([0, 1]), np.array([200_001, 4]))
    assert got.tolist() == [zlib.crc32(data), zlib.crc32(data[1:4])]


def plain(docs, target, percent=5, least=20):
    def words(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    def features(w):
        return Counter(zlib.crc32(" ".join(w[i:i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1))

    listed = [(i, words(t)) for i, t in docs]
    found = [features(w) for _, w in listed]
    s, t = sum(found, Counter()), sum((features(words(x)) for x in target), Counter())
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000.0) / ((s[b] + 1.0) * (T + 10000.0)))) for b in range(10000)]
    out = []
    for (i, w), f in zip(listed, found):
        weight = sum(gain[b] * n for b, n in f.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[:percent * len(able) // 100])}
    return Counter((r[0], r[2], r[3], r[4], rank.get(id(r))) for r in out)


def rows():
    rng = random.Random(3)
    vocabulary = ["and", "the", "Ärger", "été", "x1", "日本", "Zebra", "q" * 150, "tail" * 40]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 19, 20, 60]))) for _ in range(150)]
    texts += [None, "", "  -- !! ", "one", "the,and;THE" * 30, "the " * 60_000, texts[0], "w" * 5_000 + " end"]
    return list(enumerate(texts)) + [(0, texts[0]), (None, "the and " * 20)]


TARGET = ["the Zebra and the été", "THE and", None, "日本 x1 x1"]


@pytest.mark.parametrize("docs", [rows(), []], ids=["odd", "none"])
def test_ranked(spark, docs):
    df = spark.createDataFrame([(i, t, 1, "r", 9) for i, t in docs], SCHEMA).repartition(5)
    target = spark.createDataFrame([(k, t) for k, t in enumerate(TARGET)], "item_id long, text string")
    out = importance.ranked(df, target)
    got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()]
    assert Counter(got) == plain(docs, TARGET)
    drawn = importance.sample(df, target)
    assert drawn.columns == df.columns
    taken = {g[0] for g in got if g[4]}
    assert {r.doc_id for r in drawn.collect()} == taken


def test_empty_target(spark):
    docs = rows()[:60]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = importance.ranked(df, spark.createDataFrame([], "text string"))
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()) == plain(docs, [])
