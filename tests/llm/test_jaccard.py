from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import jaccard
from tidemark.llm.shared import Words, mixed


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {(i, len(s), find(i)) for i, s in sets}


def world(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(60))
    passage = [word() for _ in range(50)]
    rows, bases = [], [[word() for _ in range(rng.choice([6, 20, 60, 150]))] for _ in range(8)]
    for i in range(n):
        text = list(rng.choice(bases)) if rng.random() < 0.7 else [word() for _ in range(rng.randrange(1, 60))]
        if rng.random() < 0.3:
            text = passage + text[: rng.randrange(14)]
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):  # near the threshold on either side
            text[rng.randrange(len(text))] = word()
        rows.append((5 * i + rng.randrange(5), " ".join(text)))
    return rows + [(9000, None), (9001, ""), (9002, "one Two three"), (9003, "ONE two three"), (9004, "one two"), (9005, rows[3][1].upper()), (9006, "x " * 4000), (9007, "x " * 3000), (9008, rows[3][1]), (9008, rows[3][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(documents, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "CHUNK", 5)
    rows = world(seed, 220)
    assert {tuple(r) for r in jaccard.join_documents(documents(rows)).collect()} == brute(rows)


def test_empty_and_unlinked(documents):
    assert jaccard.join_documents(documents([]).limit(0)).count() == 0
    rows = [(1, "a b c d e f"), (2, "g h i j k l"), (3, None)]
    assert {tuple(r) for r in jaccard.join_documents(documents(rows)).collect()} == brute(rows)


def test_trie_like_all_pairs():
    rng = np.random.default_rng(4)
    base = rng.permutation(60)
    sets = [np.sort(rng.choice(base, rng.integers(20, 50), replace=False)) for _ in range(30)]
    sets += [np.delete(sets[k], rng.integers(0, len(sets[k]), 3)) for k in range(10)] + [sets[0].copy()]
    sizes = [len(s) + int(rng.integers(0, 4)) for s in sets]
    trie = jaccard.Trie(sets, sizes)
    for s, n in zip(sets, sizes):
        mask = np.zeros(60, dtype=np.int64)
        mask[s] = 1
        expected = [j for j, t in enumerate(sets) if 9 * len(np.intersect1d(s, t)) >= 4 * (n + sizes[j])]
        assert sorted(trie.probe(mask, n, len(s))) == expected


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)], "a long, b long")
    got = {r.id: r.component for r in jaccard.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def twins():
    """Two different words that a polynomial hash modulo 2**64 can't tell apart: a Thue-Morse word and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_with_equal_polynomial_hashes_do_not_link(documents):
    x, y = twins()
    rows = [(1, x), (2, y), (3, x), (4, x[:48]), (5, y[:48])]
    assert {tuple(r) for r in jaccard.join_documents(documents(rows)).collect()} == {(1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 1, 4), (5, 1, 5)}


def test_words_steered_to_one_hash_do_not_link(documents):
    """Two words of sixteen bytes that the mixer without a key gives one hash."""
    x, y = "abcdefghijklmnop", "yhxmqfzrr&'tq%.."
    rows = [(1, f"{x} q1 q2 q3 q4"), (2, f"{y} q1 q2 q3 q4"), (3, f"{x} q1 q2 q3 q4")]
    assert {tuple(r) for r in jaccard.join_documents(documents(rows)).collect()} == {(1, 1, 1), (2, 1, 2), (3, 1, 1)}


def test_a_secret_key_parts_words_that_collide_without_one():
    """Undoing the public mixer gives sixteen bytes with the hash of any others; under a key they differ."""
    state = lambda lane: mixed(mixed(np.array([16], np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ lane)[0]
    lane = lambda raw: np.frombuffer(raw, "<u8")[0]
    x = b"abcdefghijklmnop"
    for first in range(100_000):
        other = b"word%04x" % first
        y = other + (state(lane(x[:8])) ^ lane(x[8:]) ^ state(lane(other))).tobytes()
        if not set(y) & {9, 10, 11, 12, 13, 32} and y.isascii():
            break
    w = Words(pa.array([x.decode(), y.decode()]))
    assert len(set(w.hashes().tolist())) == 1
    for key in (1, 2, 2**63 + 5):
        assert len(set(w.hashes(key=key).tolist())) == 2


def test_four_of_five_shingles_link(documents):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, "a b c d e f g"), (4, "a b c d e f g h j")]
    got = {tuple(r) for r in jaccard.join_documents(documents(rows)).collect()}
    assert got == brute(rows) and {r[2] for r in got} == {1, 3}


def test_hashes_of_words_of_every_length():
    rng = np.random.default_rng(1)
    words = sorted({"".join(map(chr, rng.integers(97, 99, n))) for n in [*range(1, 130)] * 20} | {"é" * k for k in range(1, 40)})
    w = Words(pa.array([" ".join(words), " ".join(words[::-1])]))
    for seed in (0, 1):
        h = w.hashes(seed)
        assert len(set(h.tolist())) == len(words) and (h[: len(words)] == h[len(words) :][::-1]).all()


def test_a_large_group_of_near_copies_is_one_component(documents, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 4)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):  # each differs from the base, so many pairs are below the threshold
        text = list(base)
        for _ in range(rng.randrange(3)):
            text[rng.randrange(80)] = f"x{rng.randrange(12)}"
        rows.append((i, " ".join(text)))
    assert {tuple(r) for r in jaccard.join_documents(documents(rows)).collect()} == brute(rows)
