from __future__ import annotations

import random
import re
from itertools import permutations

import numpy as np

from tidemark.llm import audit


def brute(rows, labels):
    """The contract, one document, order and step at a time."""
    first, says = {}, {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    for doc_id, quality, toxic in labels:
        q, t = says.get(doc_id, (0, 0))
        says[doc_id] = (max(q, quality or 0), max(t, toxic or 0))
    out = {}
    orders = ["".join(p) for p in permutations("ABCDE")]
    for lang in {r[2] or "" for r in rows}:
        for order in orders:
            for step in range(1, 6):
                out[lang, order, step] = [0] * 7
    for doc_id, text, lang in rows:
        text, lang = text or "", lang or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = set()
        if len(words) < 200:
            bad.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            bad.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            bad.add("C")
        if re.search("[#$%&*|]", text):
            bad.add("D")
        if doc_id is not None and first[text] < doc_id:
            bad.add("E")
        quality, toxic = says.get(doc_id, (0, 0)) if doc_id is not None else (0, 0)
        for order in orders:
            out_at = next((k for k, f in enumerate(order, 1) if f in bad), 6)
            for step, f in enumerate(order, 1):
                row = out[lang, order, step]
                row[0] += out_at > step
                row[1] += out_at == step
                row[2] += f in bad and out_at < step
                row[3] += bad == {f}
                row[4] += out_at == step and quality == 1
                row[5] += out_at == step and toxic == 1
    for lang, order, step in out:
        out[lang, order, step][6] = sum(out[lang, o, o.index(order[step - 1]) + 1][1] for o in orders)
    return {k: tuple(v) for k, v in out.items()}


def tables(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, lang, "s", 0, 3, "x") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, mask int, part string")
    return docs, spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string")


def found(spark, rows, labels):
    return {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in audit.interactions(audit.judged(*tables(spark, rows, labels))).collect()}


def test_table_of_first_failures():
    table = audit.first_failures()
    assert table.shape == (32, 120)
    assert (table[0] == 5).all() and (table[31] == 0).all()
    for mask in (1, 6, 20):
        for o, order in enumerate(audit.ORDERS):
            steps = [k for k, f in enumerate(order) if mask >> "ABCDE".index(f) & 1]
            assert table[mask, o] == steps[0]


def test_audit_equals_brute_force(spark):
    rng = random.Random(3)
    make = lambda: " ".join(rng.choice(("word", "Two", "$", "x%d")) + str(rng.randrange(200)) for _ in range(rng.choice((3, 150, 260))))
    texts = [make() for _ in range(40)]
    rows = [(i, rng.choice(texts), rng.choice(("en", "de", None, ""))) for i in range(150)]
    rows += [(3, rows[3][1], "en"), (4, texts[0], "de"), (None, texts[1], "en"), (None, texts[1], None), (200, None, "fr"), (201, "", "fr"), (202, "A" * 300, "zz")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1))) for i in range(0, 205, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1)]
    assert found(spark, rows, labels) == brute(rows, labels)


def test_more_parts_than_a_task_holds(spark):
    rows = [(i, f"a b {i}", f"part{i % 700}") for i in range(900)]
    got = found(spark, rows, [])
    assert len(got) == 700 * 600 and all(got["part0", o, 1][0] + got["part0", o, 1][1] == 2 for o in ("ABCDE", "EDCBA"))
    assert got["part5", "ABCDE", 1] == (0, 2, 0, 2, 0, 0, 240)


def test_empty_table(spark):
    docs, labels = tables(spark, [], [])
    assert audit.interactions(audit.judged(docs, labels)).count() == 0


def test_long_texts_are_counted_in_blocks(monkeypatch):
    rng = random.Random(4)
    for _ in range(300):
        raw = bytes(rng.choice(b"ab \n\t\x0b\xc3\xa0") for _ in range(rng.randrange(60)))
        want = len(raw.split()), len(set(raw.split()))
        monkeypatch.setattr(audit, "BLOCK", rng.randrange(1, 9))
        assert audit.vocabulary(raw) == want


def test_partial_arrays_add_up():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, (2, 3, 32, 4))
    table = audit.first_failures()
    one, other, both = (audit.partial(["x", "y", "z"], h, table) for h in (a, b, a + b))
    for name in audit.FIGURES:
        assert (one.column(name).to_numpy() + other.column(name).to_numpy() == both.column(name).to_numpy()).all()
