from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import substrings


def brute(rows):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words:
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        left = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.setdefault(i, set()).add((len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


def world(seed=5, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "c", "dé", "efg", "h", "ij", "kl"]) + str(rng.randrange(30))
    passages = [[word() for _ in range(k)] for k in (12, 13, 14, 40, 200)]
    rows = []
    for i in range(n):
        text = [word() for _ in range(rng.randrange(60))]
        for p in rng.choices(passages, k=rng.randrange(4)):
            at = rng.randrange(len(text) + 1)
            text[at:at] = p
        rows.append((i * 3, rng.choice([" ", "\n", "  "]).join(text)))
    return rows + [(1000, "For " * 3000), (1001, "for " * 3000), (1002, "For " * 20), (1003, None), (1004, ""), (1005, rows[7][1]), (1006, "\x1cx " * 14), (1006, "\x1cx " * 14), (2, "a b c")]


@pytest.mark.parametrize("hot", [3, 200])
def test_like_brute_force(spark, documents, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    rows = world()
    got = {}
    for r in substrings.dedup_documents(documents(rows)).collect():
        got.setdefault(r.doc_id, set()).add((r.n_words, r.n_removed, r.kept_sha256))
    assert got == brute(rows)


def test_empty_table(documents):
    assert substrings.dedup_documents(documents([]).limit(0)).count() == 0


def test_words_with_equal_polynomial_hashes_are_kept(documents):
    x, y = ("".join(pair[bin(i).count("1") % 2] for i in range(1024)) for pair in ("ab", "ba"))
    rows = [(1, " ".join([x] * 13)), (2, " ".join([y] * 13)), (3, " ".join([x] * 14))]
    got = {r.doc_id: {(r.n_words, r.n_removed, r.kept_sha256)} for r in substrings.dedup_documents(documents(rows)).collect()}
    assert got == brute(rows) and {i: n for i, x in got.items() for _, n, _ in x} == {1: 0, 2: 0, 3: 14}


def test_wavelet_like_a_scan():
    rng = np.random.default_rng(2)
    symbols = rng.integers(0, 11, 300)
    tree = substrings.Wavelet(symbols, 11)
    for _ in range(200):
        a, b = sorted(rng.integers(0, 301, 2).tolist())
        c = int(rng.integers(0, 11))
        assert tree.rank(np.array([c]), np.array([b]))[0] == (symbols[:b] == c).sum()
        assert a == b or tree.least(np.array([a]), np.array([b]))[0] == symbols[a:b].min()


def test_matching_statistics_like_a_scan():
    rng = np.random.default_rng(0)
    texts = [list(map(str, rng.integers(0, 3, n))) for n in (13, 40, 60, 13, 200)] + [["7"] * 40, ["7"] * 30]
    ranks = np.array([3, 1, 1, 0, 4, 2, 5], dtype=np.int32)
    symbols = np.concatenate([[int(x) + 1 for x in w] + [0] for w in texts]).astype(np.int32)
    begin = np.cumsum([len(w) + 1 for w in texts]) - [len(w) + 1 for w in texts]
    index = substrings.Index(symbols, 10, np.repeat(ranks, [len(w) + 1 for w in texts]))
    for k, w in enumerate(texts):
        ends = begin[k] + np.arange(len(w))
        got = index.statistics(symbols, ends, np.full(len(w), begin[k]), np.full(len(w), ranks[k]), 4, 1000)[0]
        smaller = [" " + " ".join(v) + " " for v, r in zip(texts, ranks) if r < ranks[k]]
        for e in range(len(w)):
            longest = max((n for n in range(1, e + 2) if any(" " + " ".join(w[e + 1 - n : e + 1]) + " " in v for v in smaller)), default=0)
            assert got[e] == (longest if longest >= 4 else 0)


def test_shards_report_intervals_of_smaller_documents():
    words = pa.array([" ".join(map(str, range(20))), " ".join(map(str, range(5, 25))), " ".join(map(str, range(20)))])
    own, skip, length = substrings.repeated_intervals(words, np.array([9, 4, 4]), np.array([True, False, False]))
    assert (own.tolist(), skip.tolist(), length.tolist()) == ([0], [0], [20])
