from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import textindex, vecindex

WORDS = ["tide", "wave", "net", "sea", "port", "Fog", "rain"]


def density(words, terms):
    """Smallest stretches that hold every term, by trying all."""
    places = [i for i, w in enumerate(words) if w in terms]
    covers = [(a, b) for a in places for b in places if a <= b and set(terms) <= set(words[a : b + 1])]
    small = [(a, b) for a, b in covers if not any((x, y) != (a, b) and a <= x and y <= b for x, y in covers)]
    return sum(0.1 / (1 + sum(w not in terms for w in words[a : b + 1])) for a, b in small)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    texts = {i * 37: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(25))) for i in range(300)}
    texts |= {20_000: None, 20_001: "", 20_002: "tide, WAVE. tide-wave", 99_999_999_999: "wave tide"}
    rows = list(texts.items()) + [(None, "tide wave")]
    return texts, spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def index(corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "text")
    textindex.write_index(corpus[1], "doc_id", "text", path, buckets=16, block=512)
    return path


@pytest.mark.parametrize(("terms", "phrases"), [(("tide", "wave"), ()), (("fog",), ()), (("net", "port", "sea"), ()), (("rain",), (("tide", "wave"),)), ((), (("wave", "tide", "wave"),)), (("unheard", "sea"), ())])
def test_search_equals_scan_and_definition(spark, corpus, index, terms, phrases):
    texts, docs = corpus
    wanted = sorted({*terms, *(w for p in phrases for w in p)})
    want = []
    for doc, text in texts.items():
        words = re.findall(r"[a-z]+", (text or "").lower())
        if set(wanted) <= set(words) and all(list(p) in [words[i : i + len(p)] for i in range(len(words))] for p in phrases):
            want.append((doc, int(density(words, wanted) * 1e6 + 0.5)))
    want = sorted(want, key=lambda r: (-r[1], r[0]))[:50]
    found = [(r.doc, r.density_millionths) for r in textindex.search(spark, index, terms, phrases, buckets=16).orderBy("rank").collect()]
    assert found == [(r.doc, r.density_millionths) for r in textindex.scan(docs, "doc_id", "text", terms, phrases).orderBy("rank").collect()]
    assert len(found) == len(want) and [d for d, _ in found] == [d for d, _ in want] and all(abs(a[1] - b[1]) <= 1 for a, b in zip(found, want))


def test_words_are_grouped_where_the_text_is(spark):
    """Against a fold over the words; one row a term and block leaves the batch."""
    rows = [(5, ["a", "b", "a"]), (4, ["a"]), (4100, ["b", "b"]), (7, ["c"]), (-3, ["a", "c"])]
    batch = pa.RecordBatch.from_pydict({"doc": [r[0] for r in rows], "t": [r[1] for r in rows]}, pa.schema([("doc", pa.int64()), ("t", pa.list_(pa.string()))]))
    (made,) = textindex.partial([batch], 4096)
    got = {(r["term"], r["block"]): [(e["doc"], e["p"]) for e in r["e"]] for r in made.to_pylist()}
    assert got == {("a", -1): [(-3, [0])], ("a", 0): [(4, [0]), (5, [0, 2])], ("b", 0): [(5, [1])], ("b", 1): [(4100, [0, 1])], ("c", -1): [(-3, [1])], ("c", 0): [(7, [0])]}
    assert made.num_rows == len(got)


def test_a_search_reads_only_its_terms_buckets(spark, index):
    rows = textindex.postings(spark, index, ["tide", "net"], 16)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    known = spark.range(1).select(*[textindex.bucket_of(F.lit(w), 16).alias(w) for w in ("tide", "net")]).first()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(term" in plan.split("PushedFilters: [")[1]
    whole = spark.read.parquet(f"{index}/postings")
    assert set(r.bucket for r in whole.select("bucket").distinct().collect()) > {known.tide, known.net}
    files = [r[0] for r in spark.read.parquet(f"{index}/postings").where(F.col("bucket").isin(known.tide, known.net)).select(F.input_file_name()).distinct().collect()]
    assert {int(re.search(r"bucket=(\d+)", f)[1]) for f in files} == {known.tide, known.net}


def test_postings_are_gaps_in_blocks(spark, index, corpus):
    raw = spark.read.parquet(f"{index}/postings").where("term = 'tide'").orderBy("block").collect()
    assert len(raw) > 10 and all(len(r.docs) <= 512 and all(x > 0 for x in r.docs[1:]) for r in raw)
    docs = [d for r in raw for d in np.cumsum(r.docs).tolist()]
    assert docs == sorted(d for d, t in corpus[0].items() if "tide" in re.findall("[a-z]+", (t or "").lower()))
    assert spark.read.parquet(f"{index}/lengths").count() == len(corpus[0])


def test_empty_index(spark, tmp_path, corpus):
    textindex.write_index(corpus[1].limit(0), "doc_id", "text", str(tmp_path / "x"))
    assert textindex.search(spark, str(tmp_path / "x"), ["tide"]).count() == 0


def test_vector_search_is_exact_and_skips_cells(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 6
    x = (centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16))).astype(np.float32)
    x[:500] = x[0]  # a third of all rows are one vector
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)], "vec_id long, embedding array<float>").repartition(5)
    path = str(tmp_path / "vectors")
    old = vecindex.BLOCK, vecindex.PART, vecindex.CHUNK
    vecindex.BLOCK, vecindex.PART, vecindex.CHUNK = 64, 2, 3
    try:
        vecindex.write_index(rows, "vec_id", "embedding", path, cells=24)
        queries = rows.where("vec_id % 100 = 0")
        got = {}
        for r in vecindex.search(spark, path, queries, "vec_id", "embedding", 7).collect():
            got.setdefault(r.query, {})[r.rank] = r.id
        share = vecindex.read_share(spark, path, queries, "vec_id", "embedding", 7)
    finally:
        vecindex.BLOCK, vecindex.PART, vecindex.CHUNK = old
    d = x.astype(np.float64)
    assert set(got) == set(range(0, 1500, 100))
    for q, found in got.items():
        scores = np.zeros(len(d))
        for j in range(16):
            scores += d[:, j] * d[q, j]
        assert [found[k] for k in range(1, 8)] == np.lexsort((np.arange(len(d)), -scores))[:7].tolist()
    assert share < 0.6
    stored = spark.read.parquet(f"{path}/blocks")
    assert stored.agg(F.max("size")).first()[0] <= 80 and stored.agg(F.sum("size")).first()[0] == 1500


def test_fewer_vectors_than_asked_for(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    vecindex.write_index(rows, "vec_id", "embedding", str(tmp_path / "v"))
    got = sorted((r.query, r.rank, r.id) for r in vecindex.search(spark, str(tmp_path / "v"), rows, "vec_id", "embedding", 10).collect())
    assert got == [(q, k + 1, i) for q in range(5) for k, i in enumerate(range(5) if q == 0 else (4, 3, 2, 1, 0))]


def test_blocks_meet_queries_a_few_at_a_time(spark, tmp_path, monkeypatch):
    """Blocks are large: they are not batched by the session's rows, which stay as they were, and are met once."""
    from tidemark.operators import vecindex

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    seen, before = [], spark.conf.get(key)
    keep = vecindex.stored

    def stored(df, name):
        seen.append((name, int(spark.conf.get(key))))
        return keep(df, name)

    monkeypatch.setattr(vecindex, "stored", stored)
    rows = spark.createDataFrame([(i, [float((i * k) % 7) for k in range(1, 5)]) for i in range(200)], "id long, v array<double>")
    vecindex.write_index(rows, "id", "v", str(tmp_path / "x"))
    found = vecindex.search(spark, str(tmp_path / "x"), rows.where("id % 50 = 0"), "id", "v", 3)
    assert found.count() == 12 and spark.conf.get(key) == before
    assert [n for name, n in seen if name == "chunks"] == [int(before)] * 2
    assert [n for name, n in seen if name == "met"] == [vecindex.PAIRS] * 2 and vecindex.PAIRS * vecindex.BLOCK <= 20_000


def test_queries_are_sent_once_to_a_tile(spark, tmp_path, monkeypatch):
    """Vectors without clusters: each query looks into nearly all cells, but isn't copied for each of them."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 12))
    x[300:320] = x[40]  # ties
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    asked = rows.where("id % 20 = 0")
    sent, keep = [], vecindex.stored

    def stored(df, name):
        table = keep(df, name)
        if name == "chunks":
            sent.append(table.agg(F.sum(F.size("queries")), F.max(F.size("queries"))).first())
        return table

    monkeypatch.setattr(vecindex, "stored", stored)
    monkeypatch.setattr(vecindex, "CHUNK", 8)
    vecindex.write_index(rows, "id", "v", str(tmp_path / "x"), cells=24)
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    found = vecindex.search(spark, str(tmp_path / "x"), asked, "id", "v", 7).orderBy("query", "rank").collect()
    assert spark.conf.get(key) == before
    assert len(sent) == 2 and all(copies <= 30 and most <= 8 for copies, most in sent)  # one tile holds all cells
    want = []
    for q in range(0, 600, 20):
        scores = sum(x[:, j] * x[q, j] for j in range(12))
        want += [(q, int(i)) for i in np.lexsort((np.arange(600), -scores))[:7]]
    assert [(r.query, r.id) for r in found] == want


def test_nearest_takes_few_products_at_a_time(monkeypatch):
    """A slice of rows at a time against all products; equal scores go by id, `least` itself is reached."""
    rng = np.random.default_rng(9)
    x, q, ids = rng.normal(size=(90, 5)), rng.normal(size=(40, 5)) * 1e3, rng.permutation(90)
    x[10:30] = x[5]
    scores = sum(q[:, j, None] * x[None, :, j] for j in range(5))
    least = np.where(np.arange(40) % 3 == 0, -np.inf, np.sort(scores, axis=1)[:, 70])
    monkeypatch.setattr(vecindex, "STEP", 200)
    assert [(s.start, s.stop) for s in vecindex.slices(5, 90)] == [(0, 2), (2, 4), (4, 6)]
    row, found, score = vecindex.nearest(q, least, ids, x, 12)
    want = [(r, ids[c], scores[r, c]) for r in range(40) for c in np.lexsort((ids, -scores[r]))[:12] if scores[r, c] >= least[r]]
    assert list(zip(row, found, score)) == want


def test_tiles_hold_small_cells_and_parts_of_large_ones():
    size, parts = np.array([1000, 900, 500, 300_000, 10, 2000]), np.array([1, 1, 1, 3, 1, 1])
    assert vecindex.tiles_of(size[:3], parts[:3]).tolist() == [0, 0, 1]
    assert vecindex.tiles_of(size, parts).tolist() == [0, 0, 0, 1, 4, 4]
