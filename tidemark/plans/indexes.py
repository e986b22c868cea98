"""Queries over stored indexes, beside the SQL of the scans that they equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import textindex, vecindex
from tidemark.plans.catalogue import _TOKENS, query
from tidemark.sources.store import new_path
from tidemark.sources.views import view

TERMS = ("and", "the", "thing")
PHRASE = ("of", "the")


def _density_sql(terms: tuple[str, ...], phrase: tuple[str, ...] = ()) -> str:
    """Smallest covers by running places of each term."""
    wanted = sorted({*terms, *phrase})
    asked = "[" + ", ".join(f"'{w}'" for w in wanted) + "]"
    lasts = ", ".join(f"max(CASE WHEN w = '{w}' THEN {x} END) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS {x}{k}" for k, w in enumerate(wanted) for x in ("pos", "n"))
    least = lambda x: "least(" + ", ".join(f"{x}{k}" for k in range(len(wanted))) + ")"
    all_ = " AND ".join(f"pos{k} IS NOT NULL" for k in range(len(wanted)))
    where = f"len(list_intersect(list_distinct(t), {asked})) = {len(wanted)}"
    if phrase:
        where += f" AND contains(concat(' ', array_to_string(t, ' '), ' '), ' {' '.join(phrase)} ')"
    return f"""WITH d AS (SELECT doc_id AS doc, {_TOKENS} AS t FROM documents), m AS (SELECT * FROM d WHERE {where}),
 u AS (SELECT doc, unnest(t) AS w, unnest(range(len(t))) AS pos FROM m), e AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS n FROM u WHERE list_contains({asked}, w)),
 l AS (SELECT doc, pos, n, {lasts} FROM e), c AS (SELECT doc, pos, n, {least('pos')} AS s, {least('n')} AS i FROM l WHERE {all_}),
 g AS (SELECT *, lag(s) OVER (PARTITION BY doc ORDER BY pos) AS before FROM c),
 f AS (SELECT doc, CAST(floor(sum(0.1::DOUBLE / (1 + (pos - s) - (n - i))) * 1e6 + 0.5) AS BIGINT) AS density_millionths FROM g WHERE before IS NULL OR s > before GROUP BY doc)
 SELECT doc, density_millionths, row_number() OVER (ORDER BY density_millionths DESC, doc) AS rank FROM f QUALIFY rank <= 50"""


def _text_index(spark: SparkSession, d: str) -> str:
    path = new_path(spark, "text-index")
    textindex.write_index(view(spark, d, "documents"), "doc_id", "text", path)
    return path


@query("text_index_topk", _density_sql(TERMS))
def text_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """Index all documents, then search them by cover density."""
    return textindex.search(spark, _text_index(spark, d), TERMS)


@query("text_index_phrase", _density_sql(("thing",), PHRASE))
def text_index_phrase(spark: SparkSession, d: str) -> DataFrame:
    return textindex.search(spark, _text_index(spark, d), ("thing",), [PHRASE])


@query("text_scan_topk", _density_sql(TERMS))
def text_scan_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same ranking without an index."""
    return textindex.scan(view(spark, d, "documents"), "doc_id", "text", TERMS)


@query("vector_index_topk", """WITH q AS (SELECT vec_id AS query, embedding AS q FROM embeddings WHERE vec_id % 100 = 0 AND embedding IS NOT NULL),
 s AS (SELECT query, vec_id AS id, list_sum(list_transform(range(1, len(q) + 1), lambda i: CAST(q[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE))) AS score FROM q, embeddings WHERE embedding IS NOT NULL)
 SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10""")  # fmt: skip
def vector_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """Index all vectors, then find the ten nearest of every hundredth one among all."""
    rows = view(spark, d, "embeddings")
    path = new_path(spark, "vector-index")
    vecindex.write_index(rows, "vec_id", "embedding", path)
    return vecindex.search(spark, path, rows.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding", 10).select("query", "id", "rank")
