"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from tidemark.llm import audit, blocks, bpe, jaccard, matroska, oracles, pack, periods, quality, rules, secrets, substrings, toxicity, urls

MODULES = (jaccard, secrets, toxicity, quality, urls, pack, bpe, rules, matroska, substrings, blocks, audit, periods)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in (*MODULES, oracles) for k, v in m.SQL.items()}
