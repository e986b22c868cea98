from __future__ import annotations

import random
import re

import pytest

import corpus_pipeline
from tests.llm.test_bpe_pack import Tokenizer, bpe
from tests.llm.test_jaccard import brute as components
from tests.llm.test_substrings import brute as stripped


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices(["lo", "ra", "mi", "te", "su", "ne"], k=3))
    passage = " ".join(word() for _ in range(30))
    rows, labels = [], []
    for i in range(300):
        text = [word() for _ in range(rng.randint(30, 60))]
        if i % 5 == 0:
            for _ in range(6):
                text[rng.randrange(len(text))] = "grumpfel"
        if i % 11 == 1:
            text.insert(5, passage)
        if i % 13 == 2:
            text.insert(3, f"token={i:020x}")
        rows.append((i, " ".join(text), "en", f"s{i % 3}", 1))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(400 + i, rows[i][1] + " end", "en", "s", 1) for i in range(20)]
    rows += [(500, None, "en", "s", 1), (501, "", None, None, None), (502, passage, "en", "s", 1), (503, passage, "en", "s", 1), (503, passage, "en", "s", 1)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_like_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    seen = [sorted(map(tuple, docs.collect()), key=repr)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        seen.append(sorted(map(tuple, docs.collect()), key=repr))
    start, calm, single, cut, masked = seen
    assert {r[0] for r in start} - {r[0] for r in calm} == {r[0] for r in start if "grumpfel" in (r[1] or "")}
    assert all(r in start for r in calm)
    heads = {c for _, _, c in components([r[:2] for r in calm])}
    assert {r[0] for r in single} == heads and len(single) == len(heads) and all(r in calm for r in single)
    brute = stripped([r[:2] for r in single])
    for r in single:
        ((n, gone, _),) = brute[r[0]]
        left = [x for x in cut if x[0] == r[0]]
        assert len(left) == (0 if n and gone == n else 1)
        if left:
            assert left[0] == r if not gone else len(left[0][1].split()) == n - gone
    assert sorted(r[0] for r in masked) == sorted(r[0] for r in cut)
    for a, b in zip(cut, masked):
        assert b[1] == (None if a[1] is None else re.sub(r"token=[0-9a-f]{20}", "[SECRET]", a[1]))
    exact = Tokenizer.from_file(bpe.vocabulary_path())
    ids = {r[0]: len(exact.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in masked}
    out = corpus_pipeline.run(spark, folder).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r[0]: r[1] for r in out} == ids


def test_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
