from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import quality, toxicity
from tidemark.llm.labelled import held_out


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices(["lo", "ra", "mi", "te", "su", "ne"], k=3)) for _ in range(80)]
    rows, labels = [], []
    for i in range(500):
        text = rng.choices(words, k=rng.randint(30, 60))
        toxic = i % 5 == 0
        junk = i % 7 == 3
        if toxic:
            for _ in range(4):
                text[rng.randrange(len(text))] = "grumpfel" + rng.choice(["", "ig", "ung", "en", "ster"])
        rows.append((i, " ".join(w + "%%%" for w in text) if junk else " ".join(text)))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, rows[3][1]), (1003, "word " * 30_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0.5) for i, t in rows], "doc_id long, text string, lang string, source string, score double")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), len(rows), {a: (b, c) for a, b, c in labels}


@pytest.mark.parametrize("module, place", [(toxicity, 1), (quality, 0)])
def test_held_out_accuracy_and_cases(spark, world, module, place):
    docs, labels, n, truth = world
    rows = {r.doc_id: r for r in module.score_documents(docs, labels).collect()}
    assert len(rows) == n and all(0 <= r.score <= 1 for r in rows.values())
    assert rows[3].score == rows[1002].score and rows[1000].score == rows[1001].score
    away = [r for i, r in rows.items() if r.held_out and i in truth]
    assert sum(r.predicted == truth[r.doc_id][place] for r in away) / len(away) > 0.95
    expected = {r.doc_id for r in docs.where(held_out(docs.doc_id)).collect()}
    assert {i for i, r in rows.items() if r.held_out} == expected


@pytest.mark.parametrize("module, prior", [(toxicity, 0.0), (quality, 1.0)])
def test_no_labels_and_empty_table(world, module, prior):
    docs, labels, n, _ = world
    none = module.score_documents(docs, labels.limit(0))
    assert {r.score for r in none.collect()} == {prior}
    assert module.score_documents(docs.limit(0), labels).count() == 0


def one_by_one(text, lexicon):
    """The features by definition, word by word."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(toxicity.FEATURES)
    exact = starts = obfuscated = hidden = shouted = 0
    total = strongest = 0.0
    distinct, at, second = set(), [], []
    for i, w in enumerate(words):
        shouted += w.isupper()
        w = w.lower()
        if not w.isalpha():
            w = toxicity._EDGE.sub("", w)
            plain = w.translate(toxicity._LEET)
            if len(w) > 2 and not w.isalpha() and not w.isdigit() and plain != w and plain.isalpha():
                obfuscated += 1
                if plain in lexicon.words:
                    hidden, w = hidden + 1, plain
        second += [i] * (w in toxicity.SECOND_PERSON)
        exact += w in lexicon.words
        odds = max([lexicon.words.get(w, 0.0)] + [lexicon.starts.get(w[:k], 0.0) for k in range(3, min(8, len(w) - 1) + 1)])
        if odds:
            starts, total, strongest = starts + 1, total + odds, max(strongest, odds)
            distinct.add(w)
            at.append(i)
    near = sum(any(abs(i - j) <= 3 for j in second) for i in at)
    count = lambda marks: sum(text.count(c) for c in marks)
    return [100 * exact / n, 100 * starts / n, 100 * total / n, strongest, len(distinct), 100 * near / n, 100 * len(second) / n, count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / len(text), shouted / n, count("!?.,;:") / len(text), 100 * count("!") / n, 100 * obfuscated / n, 100 * hidden / n, np.log1p(n)]


def test_features_by_array_equal_those_word_by_word():
    rng = random.Random(5)
    lexicon = toxicity.Lexicon({"grumpfel": 4.0, "blarg": 3.5, "élan": 3.2}, {"snor": 5.0, "grum": 3.1})
    pool = ["you", "Dich", "GRUMPFEL", "gr0mpfel", "grumpfe1", "gr*mpfel", "bl@rg!", "snorting", "snor", "Snork,", "élan", "...", "12", "a1b2", "word", "VOUS", "x!", "grumpf-el", "ß", "İ"]
    texts = ["", "   ", "you", " you grumpfel ", "grumpfel"] + [rng.choice([" ", "\n", "  "]).join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(300)]
    got = toxicity.describe(pa.array(texts), lexicon)
    assert np.allclose(got, np.array([one_by_one(t, lexicon) for t in texts], dtype=float), rtol=0, atol=1e-9)
    assert toxicity.describe(pa.array([], pa.string()), lexicon).shape == (0, len(toxicity.FEATURES))


def test_machine_is_the_pairwise_sum():
    rng = np.random.default_rng(0)
    k, size = len(quality.STRUCTURE), len(quality.STRUCTURE) + (1 << quality.BITS)
    m = quality.Machine(0.5, np.zeros(k), np.ones(k), 0.1, rng.normal(0, 0.1, size), rng.normal(0, 0.3, (size, quality.RANK)))
    column = pa.array(["one two two three", "", "four!"])
    stats, owner, word, value = quality.describe(column)
    for d in range(3):
        x = np.zeros(size)
        x[:k] = np.clip(stats[d], -4, 4)
        x[k + word[owner == d]] = value[owner == d]
        on = np.flatnonzero(x)
        z = m.bias + m.weights @ x + sum(m.factors[i] @ m.factors[j] * x[i] * x[j] for a, i in enumerate(on) for j in on[a + 1 :])
        assert m.score(column)[d] == pytest.approx(1 / (1 + np.exp(-z)))


def test_quality_scores_do_not_depend_on_the_batch():
    rng = random.Random(5)
    texts = [" ".join(rng.choices("la le li lo lu ## %% A1 !".split(), k=rng.randrange(1, 90))) for _ in range(64)]
    state = np.random.default_rng(1)
    k, size = len(quality.STRUCTURE), len(quality.STRUCTURE) + (1 << quality.BITS)
    m = quality.Machine(0.5, np.zeros(k), np.ones(k), 0.1, state.normal(0, 0.1, size), state.normal(0, 0.3, (size, quality.RANK)))
    whole = m.score(pa.array(texts)).tolist()
    for step in (1, 3, 7, 31):
        assert [x for i in range(0, 64, step) for x in m.score(pa.array(texts[i : i + step])).tolist()] == whole


def test_toxic_features():
    lexicon = toxicity.Lexicon({"idiot": 5.0}, {"grump": 4.0})
    f = dict(zip(toxicity.FEATURES, toxicity.describe(pa.array(["you 1d1ot! GRUMPfels and idiot far away from all of them"]), lexicon)[0]))
    assert f["obfuscated_hits"] > 0 and f["distinct_hits"] == 2 and f["near_second_person"] == pytest.approx(100 * 2 / 11)
    assert toxicity.describe(pa.array([""]), lexicon)[0].tolist() == [0.0] * len(toxicity.FEATURES)
