"""Operator 9, Matroska media columns.

A small muxer stores bytes as an 8-bit PCM track (EBML header, segment, info, tracks, clusters of simple blocks with all
four kinds of lacing, cues); the parser reads variable-length elements back into a packet table of track, timestamp and
byte range. Each row is its own file, so nothing is shuffled.

Cases: null and empty texts are one padded unit; very long texts become many clusters; equal texts give equal files;
ties can't be; rows without doc_id are stored like others; an empty table gives an empty result; broken media raise ValueError in parse(); only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.shared import texts

# fixed values of the format: element ids
EBML, DOC_TYPE, SEGMENT, INFO, SCALE, TRACKS, ENTRY, NUMBER, UID, KIND, CODEC, AUDIO, RATE, CHANNELS, DEPTH, CLUSTER, TIME, SIMPLE, GROUP, BLOCK, CUES, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER, MUXER, WRITER = (
    0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0x4D80, 0x5741,
)
MASTERS = {EBML, SEGMENT, INFO, TRACKS, ENTRY, AUDIO, CLUSTER, GROUP, CUES, POINT, POSITIONS}
FRAME, FRAMES, BLOCKS, HERTZ = 192, 8, 32, 8000  # bytes a frame, frames a block, blocks a cluster, samples a second
UNIT = 192
APP = b"tidemark"  # the muxing and the writing application, which the format asks for


def vint(n: int) -> bytes:
    """An EBML size of the least length."""
    for length in range(1, 9):
        if n < (1 << (7 * length)) - 1:
            return (n | 1 << (7 * length)).to_bytes(length, "big")
    raise ValueError("too large")


def signed_vint(n: int) -> bytes:
    for length in range(1, 9):
        half = (1 << (7 * length - 1)) - 1
        if -half < n < half:
            return (n + half | 1 << (7 * length)).to_bytes(length, "big")
    raise ValueError("too large")


def read_vint(data: bytes, at: int, marker: bool = False) -> tuple[int, int, int]:
    """Value, place after it, length; -1 if all bits are set (unknown size)."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length number at {at}")
    length = 9 - data[at].bit_length()
    if at + length > len(data):
        raise ValueError("cut off")
    value = int.from_bytes(data[at : at + length], "big")
    if not marker:
        value ^= 1 << (7 * length)
        if value == (1 << (7 * length)) - 1:
            value = -1
    return value, at + length, length


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: int) -> bytes:
    """Frames of one block after its header: 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    if lacing == 0:
        return frames[0]
    head = bytearray([len(frames) - 1])
    if lacing == 1:
        for f in frames[:-1]:
            head += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif lacing == 3 and len(frames) > 1:
        head += vint(len(frames[0]))
        for a, b in zip(frames, frames[1:-1]):
            head += signed_vint(len(b) - len(a))
    return bytes(head) + b"".join(frames)


def mux(payload: bytes, track: int = 1) -> bytes:
    """A Matroska file of payload as 8-bit samples. The kind of lacing goes round from block to block."""
    audio = element(AUDIO, element(RATE, struct.pack(">d", HERTZ)) + number(CHANNELS, 1) + number(DEPTH, 8))
    entry = element(ENTRY, number(NUMBER, track) + number(UID, track) + number(KIND, 2) + element(CODEC, b"A_PCM/INT/LIT") + audio)
    body = [element(INFO, number(SCALE, 1_000_000) + element(MUXER, APP) + element(WRITER, APP)), element(TRACKS, entry)]
    place, cues = sum(map(len, body)), []
    per_block = FRAME * FRAMES
    for base in range(0, len(payload), per_block * BLOCKS):
        began = base * 1000 // HERTZ
        parts = [number(TIME, began)]
        for k, at in enumerate(range(base, min(len(payload), base + per_block * BLOCKS), per_block)):
            block = payload[at : at + per_block]
            lacing = k % 4
            if lacing == 1:  # unequal frames: the first takes a third more
                first = min(len(block), FRAME * 4 // 3)
                frames = [block[:first], *(block[i : i + FRAME] for i in range(first, len(block), FRAME))]
            else:
                frames = [block] if lacing == 0 else [block[i : i + FRAME] for i in range(0, len(block), FRAME)]
            lacing = lacing if len(frames) > 1 else 0
            parts.append(element(SIMPLE, vint(track) + struct.pack(">hB", at * 1000 // HERTZ - began, 0x80 | lacing << 1) + laced(frames, lacing)))
        cues.append(element(POINT, number(CUE_TIME, began) + element(POSITIONS, number(CUE_TRACK, track) + number(CUE_CLUSTER, place))))
        body.append(element(CLUSTER, b"".join(parts)))
        place += len(body[-1])
    body.append(element(CUES, b"".join(cues)))
    return element(EBML, element(DOC_TYPE, b"matroska")) + element(SEGMENT, b"".join(body))


@dataclass
class Media:
    packets: list[tuple[int, int, int, int, int]]  # track, block timestamp in ms, place in block, byte offset, bytes
    cues: list[tuple[int, int, int]]  # time, track, place of a cluster in the segment
    clusters: list[int]  # places of clusters in the segment
    codecs: dict[int, str]
    depths: dict[int, int]
    rates: dict[int, float]


def frames_of(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte offset and length of each frame of a block's body."""
    if lacing == 0:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % count:
            raise ValueError("fixed lacing doesn't divide the block")
        sizes = [(end - at) // count] * count
    else:
        for k in range(count - 1):
            if lacing == 1:
                size = 0
                while (b := data[at]) == 255:
                    size, at = size + 255, at + 1
                size, at = size + b, at + 1
            elif k == 0:
                size, at, _ = read_vint(data, at)
            else:
                value, at, length = read_vint(data, at)
                size = sizes[-1] + value - ((1 << (7 * length - 1)) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("frames are longer than their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> Media:
    """Read all elements; unknown ones are passed over, masters of unknown size end where their parent does."""
    media = Media([], [], [], {}, {}, {})
    state = {"segment": 0, "time": 0, "scale": 1_000_000, "track": 0, "cue": [0, 0, 0]}

    def whole(a: int, b: int) -> int:
        return int.from_bytes(data[a:b], "big")

    def walk(at: int, end: int) -> None:
        while at < end:
            began = at
            name, at, _ = read_vint(data, at, marker=True)
            size, at, _ = read_vint(data, at)
            to = end if size < 0 else at + size
            if to > end:
                raise ValueError("an element is longer than its parent")
            if name in MASTERS:
                if name == SEGMENT:
                    state["segment"] = at
                elif name == CLUSTER:
                    media.clusters.append(began - state["segment"])
                elif name == POINT:
                    state["cue"] = [0, 0, 0]
                walk(at, to)
                if name == POINT:
                    media.cues.append(tuple(state["cue"]))
            elif name in (SIMPLE, BLOCK):
                track, body, _ = read_vint(data, at)
                relative, flags = struct.unpack_from(">hB", data, body)
                stamp = (state["time"] + relative) * state["scale"] // 1_000_000
                for k, (offset, length) in enumerate(frames_of(data, body + 3, to, flags >> 1 & 3)):
                    media.packets.append((track, stamp, k, offset, length))
            elif name == TIME:
                state["time"] = whole(at, to)
            elif name == SCALE:
                state["scale"] = whole(at, to)
            elif name == NUMBER:
                state["track"] = whole(at, to)
            elif name == CODEC:
                media.codecs[state["track"]] = data[at:to].decode()
            elif name == DEPTH:
                media.depths[state["track"]] = whole(at, to)
            elif name == RATE:
                media.rates[state["track"]] = struct.unpack(">d" if size == 8 else ">f", data[at:to])[0]
            elif name == CUE_TIME:
                state["cue"][0] = whole(at, to)
            elif name == CUE_TRACK:
                state["cue"][1] = whole(at, to)
            elif name == CUE_CLUSTER:
                state["cue"][2] = whole(at, to)
            at = to

    walk(0, len(data))
    return media


def samples(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join([data[o : o + n] for t, _, _, o, n in media.packets if t == track])


def feature(media: Media, payload: bytes) -> str:
    """Counts of the packet table and simple statistics of the samples, as fixed text."""
    x = np.frombuffer(payload, dtype=np.uint8)
    seekable = sum(place in media.clusters for _, _, place in media.cues)
    return f"tracks={len(media.codecs)};packets={len(media.packets)};clusters={len(media.clusters)};cues={seekable};ms={len(x) * 1000 // HERTZ};mean={int(x.sum(dtype=np.int64)) * 1000 // len(x)};range={int(x.min())}-{int(x.max())};changes={int(np.count_nonzero(x[1:] != x[:-1]))}"


OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_documents(docs: DataFrame, media_column: bool = False) -> DataFrame:
    """Store each text as Matroska, read it back and describe it. media_column adds the file itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * media_column
        names = [x.split()[0] for x in OUT.split(", ")] + ["media"] * media_column
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py().encode()
                payload = raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")
                stored = mux(payload)
                media = parse(stored)
                back = samples(stored, media)
                rows.append((doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(media, back)) + ((stored,) if media_column else ()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds, strict=True)], names=names)

    return texts(docs).mapInArrow(run, OUT + (", media binary" if media_column else ""))


def packet_table(files: DataFrame, column: str = "media") -> DataFrame:
    """One row a packet of each file: doc_id, track, timestamp_ms, lace, offset, bytes. Null files have no packets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if data.is_valid and (packets := parse(data.as_py()).packets):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([doc] * len(packets), *zip(*packets))], names=["doc_id", "track", "timestamp_ms", "lace", "offset", "bytes"])

    return files.select("doc_id", column).mapInArrow(run, "doc_id long, track long, timestamp_ms long, lace long, offset long, bytes long")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_matroska": op9}
SQL: dict[str, str] = {}
