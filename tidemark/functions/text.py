"""Text measures: tokens, script shares, numbers, names, chunks, hashed embeddings."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

SCRIPTS = {"TAMIL": "ta", "DEVANAGARI": "hi", "BENGALI": "bn", "TELUGU": "te", "KANNADA": "kn", "MALAYALAM": "ml", "GUJARATI": "gu"}
DOMINANT, MIXED, FEW_LETTERS = 0.5, 0.2, 8
MAX_CHUNK, MIN_CHUNK, DIMENSIONS = 1200, 80, 1024
SIGNED = r"(?<![0-9.])-?[0-9]+(?:\.[0-9]+)?"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def letters_of(text: Column, script: str | None = None) -> Column:
    """Letters of a script, or all letters."""
    kind = r"\p{L}" if script is None else rf"\p{{L}}&&[\p{{Is{script.title()}}}]"
    return F.length(F.regexp_replace(text, rf"[^{kind}]+" if script is None else rf"[^[{kind}]]+", "")).cast("long")


def indic(text: Column) -> Column:
    """Only the characters of the scripts of SCRIPTS."""
    return F.regexp_replace(text, "[^" + "".join(rf"\p{{Is{s.title()}}}" for s in SCRIPTS) + "]+", "")


def script_shares(text: Column) -> Column:
    """map of script to share; letters of no known Indic script count as LATIN; no letters, no entries."""
    n = letters_of(text)
    counts = {s: letters_of(text, s) for s in SCRIPTS}
    rest = n
    for c in counts.values():
        rest = rest - c
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), (v / n).alias("value")) for k, v in [*counts.items(), ("LATIN", rest)]])
    return F.when(n > 0, F.map_from_entries(F.filter(pairs, lambda x: x["value"] > 0)))


def numbers(text: Column) -> Column:
    """Numbers with their sign; a hyphen after a digit or full stop is no sign."""
    return F.regexp_extract_all(text, F.lit(SIGNED), F.lit(0))


def allowance(length: Column) -> Column:
    """Edits that a name of so many letters may be off."""
    return F.when(length <= 5, 0).when(length <= 8, 1).otherwise(2)


@F.pandas_udf(StringType())
def normal_name(names: pd.Series) -> pd.Series:
    """Decomposed, without marks and everything that is neither letter nor digit, case-folded."""
    return names.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if c.isalnum()).casefold())


def sentences(text: Column, longest: int) -> Column:
    """array<struct<part, first>>: paragraphs in one spacing, those above `longest` as sentences; first opens a paragraph."""
    tidy = F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"[\s\x1c-\x1f\x85\p{Z}]+", " ")))
    cut = lambda p: F.when(F.length(p) <= longest, F.array(p)).otherwise(F.split(p, r"(?<=[.!?]) "))
    return F.flatten(F.transform(F.filter(tidy, lambda p: p != ""), lambda p: F.transform(cut(p), lambda x, i: F.struct(x.alias("part"), (i == 0).alias("first")))))


def chunks(text: Column, longest: int = MAX_CHUNK, shortest: int = MIN_CHUNK) -> Column:
    """Paragraphs, long ones filled up sentence by sentence; a chunk under `shortest` joins the one before it.

    Sentences are numbered by a fold over their lengths: a sentence opens a chunk where a paragraph begins or where it
    doesn't fit any more. Equal numbers are then joined, and short chunks joined to their predecessors by a second fold.
    """
    zero = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"))

    def put(acc: Column, x: Column) -> Column:
        size = F.length(x["part"])
        opens = x["first"] | (acc["used"] + 1 + size > longest)
        grown = F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(F.concat_ws(" ", F.element_at(acc["out"], -1), x["part"])))
        return F.struct(F.when(opens, size).otherwise(acc["used"] + 1 + size).alias("used"), F.when(opens, F.concat(acc["out"], F.array(x["part"]))).otherwise(grown).alias("out"))

    def close(out: Column, piece: Column) -> Column:
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat_ws(" ", F.element_at(out, -1), piece)))
        return F.when((F.size(out) > 0) & (F.length(piece) < shortest), joined).otherwise(F.concat(out, F.array(piece)))

    filled = F.aggregate(sentences(F.coalesce(text, F.lit("")), longest), zero, put, lambda acc: acc["out"])
    return F.aggregate(filled, F.array().cast("array<string>"), close)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def hashed(words: list[str], size: int = DIMENSIONS) -> np.ndarray:
    """Signed counts of hashed words, of unit length if there are any."""
    v = np.zeros(size)
    for w in words:
        d = hashlib.sha256(w.encode()).digest()
        v[int.from_bytes(d[:4], "big") % size] += 1.0 if d[4] % 2 == 0 else -1.0
    n = float(np.sqrt((v * v).sum()))
    return v / n if n else v


@F.pandas_udf(ArrayType(FloatType()))
def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield texts.map(lambda t: hashed(re.findall(r"[^\W\d_]+", (t or "").lower())).astype("float32"))


def bucket(word: Column, size: int = DIMENSIONS) -> tuple[Column, Column]:
    """Bucket and sign of a word, as expressions."""
    digest = F.sha2(word, 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % size, F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)


def headline(text: Column, most: int = 160) -> Column:
    """Up to the first full stop, at most 160 characters."""
    return F.substring(F.trim(F.substring_index(text, ".", 1)), 1, most)


def expand_decimals(text: Column, word: str = "point") -> Column:
    return F.regexp_replace(text, r"([0-9]+)\.([0-9]+)", f"$1 {word} $2")


def format_duration(seconds: Column) -> Column:
    return F.when(seconds < 90, F.format_string("%.0f s", seconds)).when(seconds < 5400, F.format_string("%.0f min", seconds / 60)).otherwise(F.format_string("%.1f h", seconds / 3600))


def fill_slots(template: Column, slots: Column) -> Column:
    """Replace {name} by the slot's value for every entry of a map; a missing slot leaves its braces."""
    return F.aggregate(F.map_entries(slots), template, lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def unfilled(text: Column) -> Column:
    return text.rlike(r"\{[A-Za-z_]+\}")
