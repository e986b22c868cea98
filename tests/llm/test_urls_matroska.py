from __future__ import annotations

import hashlib
import re
import zlib

import pytest

from tidemark.llm import matroska, urls

URLS = [None, "", "no scheme", "http://", "http://A.COM", "http://a.com/", "https://x.example.com/en/1", "https://www.example.com/en/1", "http://b.www.example.com/en/", "http://q.net/es/1", "http://q.net/ess", "http://net/fr/?x", "ftp://u.org/casino-win", "http://casinowin.org/", "http://free.org/poker", "http://free.org/free", "http://x.org?adult=1#win", "http://notcom/", "http://é.org/free/bet", "http://h.org/spam/spam"]


def brute(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(r), r, v) for r, v in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    words = re.split("[^a-z0-9]", url.lower())
    n, soft = sum(w in urls.STRICT for w in words), {w for w in words if w in urls.SOFT}
    _, rule, verdict = max(fits, default=(0, None, "block" if n or len(soft) >= 2 else "allow"))
    return host, path, rule, verdict, n, ",".join(sorted(soft))


def test_urls_like_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: tuple(r)[1:] for r in urls.filter_urls(pages).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS)}
    assert urls.filter_urls(pages.limit(0)).count() == 0


def test_urls_sql_agrees(spark):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("pages", pd.DataFrame({"page_id": range(len(URLS)), "url": URLS}))
    got = {r[0]: r[1:] for r in con.sql(urls.SQL["op5_url_vocabulary"]).fetchall()}
    assert got == {i: brute(u) for i, u in enumerate(URLS)}


@pytest.mark.parametrize("n", [1, 192, 193, 255, 256, 510, 1536, 1537, 5000, 200_000])
def test_matroska_round_trip(n):
    payload = bytes(i * 7 % 251 for i in range(n))
    stored = matroska.mux(payload)
    media = matroska.parse(stored)
    assert matroska.samples(stored, media) == payload
    assert [place for _, _, place in media.cues] == media.clusters
    assert media.codecs == {1: "A_PCM/INT/LIT"} and media.depths == {1: 8}
    stamps = [t for _, t, *_ in media.packets]
    assert stamps == sorted(stamps)


def test_lacings_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 10, b"c" * 255, b"d"]
    for lacing in (1, 3):
        body = matroska.laced(frames, lacing)
        assert [body[o : o + n] for o, n in matroska.frames_of(body, 0, len(body), lacing)] == frames
    block = matroska.element(matroska.SIMPLE, b"\x81\x00\x05\x80xyz")
    live = bytes.fromhex("18538067") + b"\x01" + b"\xff" * 7 + bytes.fromhex("1F43B675") + b"\xff" + matroska.number(matroska.TIME, 7) + block
    assert [p[:2] for p in matroska.parse(live).packets] == [(1, 12)]
    with pytest.raises(ValueError):
        matroska.parse(matroska.mux(b"z" * 400)[:-3])


def test_documents(spark, documents):
    texts = ["", None, "é" * 100, "same", "same", "z" * 100_000]
    files = matroska.store_documents(documents(texts), media_column=True)
    rows = {r.doc_id: r for r in files.collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.media_bytes == len(r.media)
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest()
    assert rows[3].media == rows[4].media
    table = matroska.packet_table(files)
    assert {r.doc_id: r.n for r in table.groupBy("doc_id").agg({"bytes": "sum"}).withColumnRenamed("sum(bytes)", "n").collect()} == {i: r.payload_bytes for i, r in rows.items()}
    assert matroska.store_documents(documents([]).limit(0)).count() == 0


def test_stored_rows_without_a_doc_id_and_the_applications(documents):
    rows = matroska.store_documents(documents([(None, "a"), (None, "a"), (3, "a"), (3, None)]), media_column=True).collect()
    assert sorted((r.doc_id is None, r.n_bytes) for r in rows) == [(False, 0), (False, 1), (True, 1), (True, 1)]
    assert len({r.media_sha256 for r in rows if r.n_bytes}) == 1
    muxed = bytes(rows[0].media)
    assert muxed.count(matroska.APP) == 2 and all(muxed.count(x) == 1 for x in (b"\x4d\x80", b"\x57\x41"))
