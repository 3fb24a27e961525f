"""Prefix trie against a plain one over dictionaries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from paideon.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k string, `a.b` int"


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}


def opened(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = abs(c) // 100 * 100 * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain(convs):
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[:d - 1])].add(tuple(turns[:d]))
    leaves, saved = Counter(), Counter()
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
    out = Counter()
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(node))
        out[(min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), leaves[node], saved[node],
             hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def rows(seed, n=150, longest=9, words=3):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        c = rng.choice([c, c, c + 1000, -c])
        for t in range(rng.choice([1, 2, longest])):
            out.append((c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.3 else "user", "é" * rng.randrange(words)))
    return out


def long_rows():
    """Conversations of several blocks that part inside, at and after the edges of blocks."""
    out = []
    for c, (same, other) in enumerate([(300, 0), (300, 0), (64, 5), (64, 0), (63, 70), (65, 1), (128, 64), (128, 0), (200, 100), (0, 130), (0, 130)]):
        out += [(c, t, "user", f"same {t % 7}") for t in range(same)] + [(c, same + t, "user", f"other {t}") for t in range(other)]
    return out


ODD = [(None, 1, "user", "lost"), (5, None, None, None), (5, None, "", ""), (5, 1, "user", "x" * 200_000), (6, None, None, None), (5, 2, None, "tie"),
       (5, 2, "a", "tie"), (5, 2, "a", "tie"), (7, 0, "b", "only"), (105, 0, "user", "z"), (100, 0, "user", "z"), (-7, 3, "user", "neg")]


def read(df):
    return Counter(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def frame(spark, data):
    return spark.createDataFrame([(*r, 1, "k", 2) for r in data], SCHEMA).repartition(5)


@pytest.mark.parametrize("data", [rows(1), rows(2, 400, 30, 2), long_rows(), ODD, []], ids=["short", "many", "long", "odd", "none"])
def test_trie(spark, data):
    df = frame(spark, data)
    assert read(prefix_trie.prefix_trie(df)) == plain(ordered(data))
    assert read(prefix_trie.rebuilt_trie(df)) == plain(opened(ordered(data)))


def test_small_runs_and_many_ranges(spark, monkeypatch):
    """Every edge of runs, ranges and levels of merging at once."""
    monkeypatch.setattr(prefix_trie, "RUN_ROWS", 3)
    monkeypatch.setattr(prefix_trie, "FAN_IN", 3)
    data = rows(3, 300, 12, 2) + [(5000 + c, t, "user", "é") for c in range(60) for t in range(4)]
    assert read(prefix_trie.prefix_trie(frame(spark, data))) == plain(ordered(data))


@pytest.mark.parametrize("seed", range(20))
def test_contraction_keeps_the_trie(seed):
    """Forests of cut runs, merged in levels, give the nodes of one forest."""
    rng = random.Random(seed)
    paths = sorted({tuple(rng.randrange(2) for _ in range(rng.randrange(7))) for _ in range(40)})
    made = [[(0, 0, 0), 0, [v for t, x in enumerate(p) for v in (hash((t, x)) & 0xFFFF, x, x + 1)], 1, i, 0, i, 1, 0, 0] for i, p in enumerate(paths)]
    copy = lambda some: [[*r] for r in some]
    whole = prefix_trie.Forest(copy(made)).nodes
    found, runs, at = [], [], 0
    while at < len(made):
        n = rng.randrange(1, 6)
        run = copy(made[at:at + n])
        run[0][9] |= 1
        run[-1][9] |= 2
        forest = prefix_trie.Forest(run)
        found += forest.nodes
        runs.append(forest.short)
        at += n
    while len(runs) > 1:
        joined = [prefix_trie._joined(runs[i:i + 2], 0 if len(runs) <= 2 else 3) for i in range(0, len(runs), 2)]
        found += [n for f in joined for n in f.nodes]
        runs = [f.short for f in joined]
    if at and found and runs and runs[0]:  # one run only
        found += prefix_trie._joined(runs, 0).nodes
    assert sorted(found) == sorted(whole)
