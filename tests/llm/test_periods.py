from __future__ import annotations

import hashlib
import random
import zlib

from tidemark.llm import periods


def brute(t):
    """Every period of every stretch, by definition."""
    n, found = len(t), set()
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if t[i] != t[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and t[j] == t[j + p]:
                j += 1
            length = j + p - i
            part = t[i : i + length]
            if length >= max(6, 4 * p) and not any(all(part[k] == part[k + q] for k in range(length - q)) for q in range(1, p)):
                found.add((i, length, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def listed(t):
    return [(r.start, r.length, r.period) for r in periods.runs_of(t)]


def test_runs_equal_the_definition():
    rng = random.Random(5)
    for _ in range(3000):
        t = [rng.randrange(rng.choice((1, 2, 2, 3, 4))) for _ in range(rng.randrange(40))]
        assert listed(t) == brute(t), t


def test_runs_of_nested_and_planted_periods():
    rng = random.Random(6)
    for _ in range(400):
        t = [rng.randrange(3) for _ in range(rng.randrange(1, 6))]
        for _ in range(rng.randrange(1, 4)):  # powers of powers with noise between
            t = t * rng.randrange(1, 6) + [rng.randrange(3) for _ in range(rng.randrange(3))]
        t = t[:150]
        assert listed(t) == brute(t), t
        numbers = periods.numbered([str(x).encode() for x in t])
        assert listed(numbers) == brute(t)


class Counted(int):
    """A number that counts how often it is compared."""

    n = 0

    def __eq__(self, other):
        Counted.n += 1
        return int(self) == int(other)

    __hash__ = int.__hash__


def test_comparisons_are_linear():
    fibonacci = [0], [0, 1]
    while len(fibonacci[1]) < 6000:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    n = 6000
    for t in ([0] * n, [0, 1] * (n // 2), fibonacci[1][:n], ([0] * 50 + [1]) * (n // 51), ([1] * 50 + [0]) * (n // 51), [0] * (n // 2) + [1] + [0] * (n // 2)):
        for sign in (1, -1):
            Counted.n = 0
            periods.lyndon([Counted(sign * x) for x in t])
            assert Counted.n <= 4 * len(t), (t[:60], Counted.n)


def test_a_word_repeated_many_times_is_one_run():
    assert listed([0] * 200_000) == [(0, 200_000, 1)]


def test_strongest_is_exact_and_ties_go_to_the_first():
    run = periods.Run
    assert periods.strongest([]) is None
    assert periods.strongest([run(5, 8, 2), run(9, 12, 3), run(20, 9, 2)]) == run(20, 9, 2)
    assert periods.strongest([run(0, 12, 3), run(0, 40, 10), run(1, 4 * 10**18, 10**18)]) == run(0, 12, 3)


def test_find_runs(spark, documents):
    long = "ab cd " * 30_000
    docs = documents([(0, None), (1, ""), (2, "x y z"), (3, "a a a a a a b"), (3, "a a a a a a b"), (4, "q " + "u v w " * 5 + "end"), (5, long), (None, "k " * 7), (7, "\u00a0 " * 6)])
    rows = sorted((tuple(r) for r in periods.find_runs(docs, listed=True).drop("runs_sha256", "collapsed_sha256").collect()), key=lambda r: (r[0] is None, r[0] or 0))
    got = [(r[0], r[1], r[2], r[3], r[4], r[5], [tuple(x) for x in r[6]], r[7]) for r in rows]
    none = (None, None, None, None, [])
    assert got[0] == (0, 0, *none, "") and got[1] == (1, 0, *none, "") and got[2] == (2, 0, *none, "x y z")
    assert got[3] == got[4] == (3, 1, 0, 6, 1, 6000, [(0, 6, 1)], "a b")
    assert got[5] == (4, 1, 1, 15, 3, 5000, [(1, 15, 3)], "q u v w end")
    assert got[6][1:6] == (1, 0, 60_000, 2, 30_000_000) and got[6][7] == "ab cd"
    assert got[7] == (7, 1, 0, 6, 1, 6000, [(0, 6, 1)], "\u00a0")  # only ASCII white space parts words
    assert got[8][0] is None and got[8][7] == "k"
    assert periods.find_runs(documents([]).limit(0)).count() == 0


def test_query_against_the_definition(spark, tmp_path, documents):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(90)))) for i in range(300)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for doc_id, text in rows:
        words = text.split()
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        gone = {k for s, length, p in runs for k in range(s + p, s + length)}
        best = sorted(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))[:1]
        first = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
        want[doc_id] = (doc_id, len(runs), *first, hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest(), hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest())
    got = {r[0]: tuple(r) for r in periods.op13(spark, str(tmp_path)).collect()}
    assert got == want and sum(r[1] > 0 for r in got.values()) >= 10
