"""Operator 7, BPE encoding and decoding by speculation and verification.

Greedy longest match proposes a token sequence for each pre-token. A sequence is the one that exact merging
gives if and only if each token stands for itself and each adjacent pair is stable (merging the joined bytes of the
pair gives the pair back), so numpy looks up all adjacent pairs of a batch of new words at once; only words with an
unstable pair are merged exactly. Pair verdicts and finished words are kept per Python worker, bounded in number.

Cases: null text counts as empty; empty text has no tokens; very long texts are encoded whole; ties can't be; rows without
doc_id are encoded like others; repeated rows give equal rows; an empty table gives an
empty result; the only input columns read are doc_id and text, so others may be named anything. The special token's
string in a text becomes its id, as the tokenizers library does by default.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.shared import slices, texts

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value of the vocabulary
MOST_WORDS = 300_000  # words kept by a worker before it starts afresh
MOST_CHARS = 100_000_000  # characters of words seen until then


def byte_alphabet() -> dict[str, int]:
    """The printable character by which a byte-level vocabulary writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoding and decoding by one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_alphabet()
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.specials}
        self.ids = {bytes(letters[c] for c in k): v for k, v in vocab.items()}
        self.bytes_of: dict[int, bytes] = {v: k for k, v in self.ids.items()} | {v: k.encode() for k, v in self.specials.items()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.longest = max(map(len, self.ids))
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.split = regex.compile(PRETOKEN).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        # a token that merging doesn't give back can't be proposed
        self.proposed = {k: v for k, v in self.ids.items() if len(k) == 1 or self.exact(k) == [v]}
        self.pairs = np.zeros(0, dtype=np.int64)  # sorted pair keys with a verdict
        self.stable = np.zeros(0, dtype=bool)
        self.words: dict[str, tuple[str, int, bytes]] = {}
        self.chars = 0

    def exact(self, word: bytes) -> list[int]:
        """Merge by rank until no pair merges."""
        import heapq

        ids = [self.single[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = to, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := self.merge.get((to, ids[k])):
                    heapq.heappush(heap, (m[0], i, to, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := self.merge.get((ids[h], to))):
                heapq.heappush(heap, (m[0], h, ids[h], to, m[1]))
        return [x for x in ids if x >= 0]

    def greedy(self, word: bytes) -> list[int]:
        """The longest proposed token at each place."""
        out, at, n = [], 0, len(word)
        if (got := self.proposed.get(word)) is not None:
            return [got]
        while at < n:
            for to in range(min(n, at + self.longest), at, -1):
                if (got := self.proposed.get(word[at:to])) is not None:
                    out.append(got)
                    at = to
                    break
        return out

    def verdicts(self, keys: np.ndarray) -> np.ndarray:
        """Whether each pair key (left << 32 | right) is stable."""
        wanted = np.unique(keys)
        new = wanted[~np.isin(wanted, self.pairs, assume_unique=True)]
        if len(new):
            if len(self.pairs) > 4 * MOST_WORDS:
                self.pairs, self.stable, new = self.pairs[:0], self.stable[:0], wanted
            fresh = np.array([self.exact(self.bytes_of[k >> 32] + self.bytes_of[k & 0xFFFFFFFF]) == [k >> 32, k & 0xFFFFFFFF] for k in new.tolist()], dtype=bool)
            both, verdict = np.concatenate([self.pairs, new]), np.concatenate([self.stable, fresh])
            order = np.argsort(both, kind="stable")
            self.pairs, self.stable = both[order], verdict[order]
        return self.stable[np.searchsorted(self.pairs, keys)]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Speculate on all words, verify all adjacent pairs at once, merge exactly where a pair fails."""
        got = [self.greedy(w) for w in words]
        lengths = np.array([len(x) for x in got], dtype=np.int64)
        flat = np.fromiter((t for x in got for t in x), dtype=np.int64, count=int(lengths.sum()))
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(got)), lengths)
            inside = owner[1:] == owner[:-1]
            ok = self.verdicts((flat[:-1][inside] << 32) | flat[1:][inside])
            for i in np.unique(owner[1:][inside][~ok]).tolist():
                got[i] = self.exact(words[i])
        return got

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and special tokens in order."""
        if self.cut is None or not any(s in text for s in self.specials):
            return self.split(text)
        return [w for part in self.cut.split(text) if part for w in ([part] if part in self.specials else self.split(part))]

    def learn(self, words: set[str]) -> None:
        """Add what words encode to, and decode to again, to the kept words; start afresh when those are many or long."""
        self.chars += sum(map(len, words))
        if len(self.words) > MOST_WORDS or self.chars > MOST_CHARS:
            self.words.clear()
            self.chars = 0
        todo = [w for w in words if w not in self.words]
        plain = [w for w in todo if w not in self.specials]
        for w, ids in zip(plain, self.encode_words([w.encode() for w in plain]), strict=True):
            self.words[w] = self.entry(ids)
        for w in self.specials.keys() & set(todo):
            self.words[w] = self.entry([self.specials[w]])

    def entry(self, ids: list[int]) -> tuple[str, int, bytes]:
        return ",".join(map(str, ids)), len(ids), self.decode_bytes(ids)

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def encode(self, text: str) -> list[int]:
        words = self.pieces(text)
        kept = {w: x for w, x in zip(words, self.encode_words([w.encode() for w in words]), strict=True) if w not in self.specials}
        return [i for w in words for i in (kept[w] if w in kept else [self.specials[w]])]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """Where this machine has the vocabulary; looked up where it is read, as executors may have it elsewhere."""
    return name if "/" in name else public_tokenizers.path(name)


OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, ids: bool = False) -> DataFrame:
    """Encode and decode each text. ids adds the token ids (array<int>) and the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary_path(vocabulary))
        for part in (x for batch in batches for x in slices(batch, most=1 << 20)):
            rows: list[list] = [[] for _ in range(6 if ids else 4)]
            split = [own.pieces(text) for text in part.column(1).to_pylist()]
            own.learn({w for words in split for w in words})
            known = own.words
            for doc, words in zip(part.column(0).to_pylist(), split, strict=True):
                found = [known[w] for w in words]
                listed = ",".join([x[0] for x in found])
                decoded = b"".join([x[2] for x in found]).decode("utf-8", "replace")
                values = [doc, sum([x[1] for x in found]), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                if ids:
                    values += [[int(x) for x in listed.split(",")] if listed else [], decoded]
                for to, value in zip(rows, values, strict=True):
                    to.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=False)], names=names[: len(rows)])

    return texts(docs).mapInArrow(run, OUT + (", ids array<int>, decoded string" if ids else ""))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_bpe_codec": op7}
SQL: dict[str, str] = {}
