from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, pack

TEXTS = ["", None, "a", "It's the end\n\n  of  x's''s 're don't\t\t", "naïve Ünïcödé 東京 🙂🙂 12345 ½", "<|endoftext|> in <|endoftext|>text", "ab" * 3000, "x" * 4000 + " " * 500 + "\n", "same", "same", "hello world " * 900, "   　z"]


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(bpe.vocabulary_path())


def test_codec_is_the_library(spark, documents, exact):
    got = {r.doc_id: r for r in bpe.encode_documents(documents(TEXTS), ids=True).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        ids = exact.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids, text
        assert got[i].n_tokens == len(ids)
        assert got[i].decoded == exact.decode(ids, skip_special_tokens=False)
        assert got[i].decoded_sha256 == hashlib.sha256(got[i].decoded.encode()).hexdigest()
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_speculation_alone_would_fail_somewhere():
    own = bpe.codec(bpe.vocabulary_path())
    words = [w.encode() for w in (" thndinging", " reationer", "Inhe", " ofthouly", "undesirability", " hesitationally", "aaaaaaaaaaaaaaaaaaaaaaaaaaab")]
    assert own.encode_words(words) == [own.exact(w) for w in words]


def test_empty_table(spark, documents):
    assert bpe.encode_documents(documents([]).limit(0)).count() == 0
    assert pack.pack_documents(documents([]).limit(0)).count() == 0


def test_pack_covers_each_id_once(spark, documents, exact):
    rows = [r.asDict() for r in pack.pack_documents(documents(TEXTS)).collect()]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, text in enumerate(TEXTS):
        ids = [*exact.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= pack.WINDOW


def test_little_padding():
    lengths = np.random.default_rng(1).integers(1, 1024, 4000)
    sequence, offset = pack.lay_out(lengths)
    n = len(set(sequence.tolist()))
    assert lengths.sum() / (n * pack.WINDOW) > 0.97
    ends = np.zeros(sequence.max() + 1, int)
    for s, o, v in sorted(zip(sequence.tolist(), offset.tolist(), lengths.tolist())):
        assert ends[s] == o
        ends[s] += v
    assert ends.max() <= pack.WINDOW


def test_repeat_counts_solve_an_exact_case():
    histogram = np.zeros(1025, int)
    histogram[[300, 724, 512]] = [5, 5, 8]
    combos = pack.combinations(histogram, 1024)
    x = repeat = pack.repeat_counts(combos, histogram, 2000)
    assert {tuple(c): round(v) for c, v in zip(combos.tolist(), x) if v > 0.5} == {(0, 300, 724): 5, (0, 512, 512): 4}
    assert (repeat >= 0).all()


def test_rows_without_a_doc_id_and_repeated_ones(documents, exact):
    rows = [(None, "some words"), (None, "other words here"), (7, "x y"), (7, "x y"), (8, None)]
    coded = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in bpe.encode_documents(documents(rows)).collect())
    n = lambda text: len(exact.encode(text, add_special_tokens=False).ids)
    assert coded == sorted([(True, 0, n("some words")), (True, 0, n("other words here")), (False, 7, n("x y")), (False, 7, n("x y")), (False, 8, 0)])
    pieces = pack.pack_documents(documents(rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.length) for r in pieces) == sorted((a, b, c + 1) for a, b, c in coded)  # all are short: a piece each
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(rows)
