"""Quality rules and likelihood ratio against a plain version."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from paideon.llm import quality

SCHEMA = "doc_id long, text string, `key_id` string, `row` int, `w` string, `a.b` int"
M = quality.BUCKETS


def grams(w):
    h = [zlib.crc32(x.encode()) for x in w]
    return Counter([x % M for x in h] + [(a * 31 + b) % M for a, b in zip(h, h[1:])])


def plain(docs, good):
    listed = [(i, t or "", re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    s = sum((grams(w) for _, _, w in listed), Counter())
    t = sum((grams(w) for i, _, w in listed if i in good), Counter())
    S, T = sum(s.values()), sum(t.values())
    out = Counter()
    for i, text, w in listed:
        windows = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if windows[tuple(w[k:k + 8])] > 1 for j in range(8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        weight = sum(n * math.floor(1000 * math.log((t[b] + 1) * float(S + M) / ((s[b] + 1) * float(T + M)))) for b, n in grams(w).items()) if T else 0
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        out[(i, len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered), weight, failed,
             not failed and weight >= quality.LEAST_MEAN_GAIN * max(2 * len(w) - 1, 0))] += 1
    return out


def rows():
    rng = random.Random(11)
    clean, junk = ["the", "été", "Größe", "and", "日本", "x"], ["the&&&", "|", "#", "AND!!"]
    texts = [" ".join(rng.choices(clean, k=rng.choice([5, 20, 40, 200]))) for _ in range(40)]
    texts += [" ".join(rng.choices(junk, k=30)) for _ in range(15)]
    unique = " ".join(f"w{k}" for k in range(25))
    texts += [None, "", " \t\n", unique, unique + "\n" + unique, "a b c d e f g h a b c d e f g h " + unique, "same line\n\nsame line\n same line\nx\r\nx\r",
              "the " * 30_000, "a" * 300_000, "1 2 3 4 5 6 7 8 " * 2 + unique * 2, texts[0], texts[-1]]
    return list(enumerate(texts)) + [(0, texts[1]), (None, texts[2]), (None, None)]


LABELS = [(k, int(k < 40), 0) for k in range(50)] + [(3, 0, None), (4, None, 1), (5, 1, 1), (None, 1, 0), (900, 1, 0)]


@pytest.mark.parametrize("docs,labels", [(rows(), LABELS), (rows()[:50], []), ([], LABELS)], ids=["odd", "no label", "none"])
def test_report(spark, docs, labels):
    df = spark.createDataFrame([(i, t, "k", 1, "w", 2) for i, t in docs], SCHEMA).repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    trusted = quality.trusted_documents(df, lab)
    marks = {i: {q for j, q, _ in labels if j == i and q is not None} for i, _, _ in labels}
    good = {i for i, q in marks.items() if q == {1} and i is not None}
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.weight, r.base_failed, r.kept)
                  for r in quality.report(df, trusted).collect())
    assert got == plain(docs, good)
    kept = quality.kept_documents(df, trusted)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in got.elements() if r[-1])


def test_no_python_on_the_path(spark):
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    plan = quality.report(df, quality.trusted_documents(df, lab))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
