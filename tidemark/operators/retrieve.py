"""Gated lexical and vector retrieval, fused by reciprocal rank; place names; language."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T

RRF_K, CANDIDATES, LIMIT = 60, 50, 8
MOST_SENT = 100_000  # names that are broadcast, some 10 MB


@dataclass(frozen=True)
class Gate:
    """What may be retrieved: known at as_of, not expired, and (where given) recent, of a kind, of a region."""

    as_of: Column
    min_issued: Column | None = None
    kinds: frozenset[str] = field(default_factory=frozenset)
    regions: frozenset[str] = field(default_factory=frozenset)

    def predicate(self, region: str = "region") -> Column:
        """Documents without a region are for all; empty sets ask nothing."""
        p = (F.col("issued_time") <= self.as_of) & (F.col("valid_until").isNull() | (F.col("valid_until") > self.as_of))
        if self.min_issued is not None:
            p = p & (F.col("issued_time") >= self.min_issued)
        if self.kinds:
            p = p & F.col("kind").isin(sorted(self.kinds))
        if self.regions:
            p = p & (F.col(region).isNull() | F.col(region).isin(sorted(self.regions)))
        return p


def lexical(docs: DataFrame, id_: str, words: Sequence[str], most: int = CANDIDATES, every: bool = False, phrases: Sequence[str] = (), without: Sequence[str] = ()) -> DataFrame:
    """Documents with any (or every) query word, each phrase and none of the words left out: by distinct words found, then
    occurrences, then id."""
    asked = F.array(*map(F.lit, sorted(set(words))))
    t = T.tokens(F.col("text"))
    rows = docs.select(id_, t.alias("_t"))
    if without:
        rows = rows.where(~F.arrays_overlap("_t", F.array(*map(F.lit, sorted(set(without))))))
    for p in phrases:
        rows = rows.where(F.concat(F.lit(" "), F.array_join("_t", " "), F.lit(" ")).contains(f" {p} "))
    found = rows.select(id_, F.size(F.array_intersect(asked, "_t")).alias("matched"), F.size(F.filter("_t", lambda w: F.array_contains(asked, w))).alias("total"))
    top = found.where(f"matched >= {len(set(words)) if every else 1}").orderBy(F.desc("matched"), F.desc("total"), id_).limit(most)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("matched"), F.desc("total"), id_)).cast("long"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest_vectors(rows: DataFrame, id_: str, vector: str, query: Sequence[float], most: int = CANDIDATES) -> DataFrame:
    """Exact top-k by cosine of unit vectors; null vectors stand out of it."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.where(F.col(vector).isNotNull()).select(id_, dot(F.col(vector), q).alias("score"))
    top = scored.orderBy(F.desc("score"), id_).limit(most)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), id_)).cast("long"))


def fuse(rankings: dict[str, DataFrame], id_: str, k: int = RRF_K, most: int = LIMIT) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (k + rank); mode names the lists that held a document."""
    parts = [r.select(id_, "rank", F.lit(name).alias("list")) for name, r in sorted(rankings.items())]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    score = F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank")))
    fused = every.groupBy(id_).agg(score.alias("score"), F.when(F.count("*") > 1, "hybrid").otherwise(F.min("list")).alias("mode"))
    return fused.orderBy(F.desc("score"), id_).limit(most)


def resolve_places(queries: DataFrame, places: DataFrame) -> DataFrame:
    """Each query name against place names: exact first, else the closest within the allowance; several closest are ambiguous.

    queries: query; places: place_id, name, both already normalised. Fuzzy pairs meet by deletion neighbourhoods (all ways
    to drop up to two letters), so no cross join is made.
    """
    exact = queries.join(places, queries.query == places.name).groupBy("query").agg(F.count("*").alias("n"), F.min("place_id").alias("place_id"))
    rest = queries.join(exact.select("query"), "query", "left_anti")
    q = rest.select("query", T.allowance(F.length("query")).alias("allowed")).select("query", "allowed", F.explode(shortened(F.col("query"), F.col("allowed"))).alias("stub"))
    p = places.select("place_id", "name", F.explode(shortened(F.col("name"), F.lit(2))).alias("stub"))
    pairs = q.join(p, "stub").select("query", "allowed", "place_id", "name").distinct()
    near = pairs.withColumn("distance", F.levenshtein("query", "name")).where("distance <= allowed")
    best = near.groupBy("query").agg(F.min(F.struct("distance", "place_id")).alias("m"), F.collect_list("distance").alias("d"))
    fuzzy = best.select("query", F.size(F.filter("d", lambda x: x == F.col("m.distance"))).alias("n"), F.col("m.place_id").alias("place_id"), F.col("m.distance").alias("distance"))
    found = exact.select("query", "n", "place_id", F.lit(0).alias("distance")).unionByName(fuzzy)
    out = queries.select("query").distinct().join(found, "query", "left")
    status = F.when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    return out.select("query", status.alias("status"), F.when(F.col("n") == 1, F.col("place_id")).alias("place_id"), F.col("distance").cast("long").alias("distance"))


def places_in(texts: DataFrame, id_: str, text: str, aliases: DataFrame, normal: Callable[[Column], Column] = T.normal_name, longest: int = 3) -> DataFrame:
    """Places named in texts: id, ordinal, phrase, kind (exact or ambiguous), place_id (null if ambiguous).

    aliases(alias, place_id) are normalised names. Phrases of up to `longest` words meet them in an equi-join, to which up
    to MOST_SENT names are broadcast; from left to right the longest phrase at a word wins and its words are used up. A place, or an ambiguous phrase, is named once.
    """
    names = aliases.groupBy("alias").agg(F.count_distinct("place_id").alias("_n"), F.min("place_id").alias("_p"))
    if names.limit(MOST_SENT + 1).count() <= MOST_SENT:  # then phrases stay where they are made; Spark's size check doesn't know
        names = F.broadcast(names)
    words = F.filter(F.split(F.regexp_replace(F.col(text), "[,.]", " "), r"\s+"), lambda w: w != "")
    n = F.size("_w")
    starts = F.when(n > 0, F.sequence(F.lit(1), n))
    sizes = lambda s: F.sequence(F.lit(1), F.least(F.lit(longest), n - s + 1))
    phrases = F.flatten(F.transform(starts, lambda s: F.transform(sizes(s), lambda k: F.struct(s.alias("s"), k.alias("k"), F.array_join(F.slice("_w", s, k), " ").alias("phrase")))))
    sized = texts.select(F.col(id_), words.alias("_w")).select(id_, F.explode(phrases).alias("_x"))
    met = sized.select(id_, F.col("_x.s").alias("_s"), "_x.k", "_x.phrase", normal(F.col("_x.phrase")).alias("alias")).where("alias <> ''").join(names, "alias")
    match = F.struct(F.col("_s").alias("s"), (-F.col("k")).alias("k"), "phrase", F.when(F.col("_n") == 1, F.col("_p")).alias("place"))
    lists = met.groupBy(id_).agg(F.sort_array(F.collect_list(match)).alias("_m"))
    kind = lists.schema["_m"].dataType.simpleString()
    zero = F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("out"))

    def put(acc: Column, x: Column) -> Column:
        known = F.exists(acc["out"], lambda y: (y["place"] == x["place"]) | (y["place"].isNull() & x["place"].isNull() & (y["phrase"] == x["phrase"])))
        grown = F.when(F.coalesce(known, F.lit(False)), acc["out"]).otherwise(F.concat(acc["out"], F.array(x)))
        return F.when(x["s"] <= acc["end"], acc).otherwise(F.struct((x["s"] - x["k"] - 1).alias("end"), grown.alias("out")))

    taken = lists.select(id_, F.posexplode(F.aggregate("_m", zero, put, lambda acc: acc["out"])).alias("ordinal", "_y"))
    return taken.select(id_, "ordinal", "_y.phrase", F.when(F.col("_y.place").isNull(), "ambiguous").otherwise("exact").alias("kind"), F.col("_y.place").alias("place_id"))


def shortened(name: Column, edits: Column) -> Column:
    """A name and all it becomes by dropping up to `edits` (at most two) letters."""
    drop = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    once = F.when(edits >= 1, drop(name)).otherwise(F.array().cast("array<string>"))
    twice = F.when(edits >= 2, F.flatten(F.transform(drop(name), drop))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(name), once, twice))


def detect_language(rows: DataFrame, text: str, markers: dict[str, Sequence[str]], preference: Column | None = None) -> DataFrame:
    """Add language, method and code_mixed: a dominant Indic script, else the romanised lexicon, else preference or English."""
    preference = F.lit(None).cast("string") if preference is None else preference
    # each pass over a text is a column of its own and made once; the scripts are told apart in what is left of the text
    met = [F.size(F.array_intersect("_t", F.array(*map(F.lit, words)))) for _, words in sorted(markers.items())]
    counts = F.array(*[F.struct(T.letters_of(F.col("_indic"), s).alias("n"), F.lit(code).alias("code")) for s, code in T.SCRIPTS.items()])
    hits = F.array(*[F.struct(F.get("_met", i).alias("n"), F.lit(code).alias("code")) for i, code in enumerate(sorted(markers))])
    out = rows.withColumn("_n", T.letters_of(F.col(text))).withColumn("_indic", T.indic(F.col(text))).withColumn("_t", F.array_distinct(T.tokens(F.col(text))))
    out = out.withColumn("_counts", counts).withColumn("_met", F.array(*met)).drop("_indic", "_t")
    out = out.withColumn("_top", F.array_max("_counts")).withColumn("_hits", F.array_max(hits)).withColumn("_tied", F.size(F.filter("_met", lambda x: x == F.array_max("_met"))) > 1)
    script = (F.col("_n") > 0) & (F.col("_top.n") >= T.DOMINANT * F.col("_n"))
    nothing = (F.col("_n") == 0) | ((F.col("_hits.n") == 0) & (F.col("_n") < T.FEW_LETTERS))
    fallback = F.coalesce(preference, F.lit("en"))
    named = F.when(preference.isNotNull(), "preference").otherwise("default")
    language = F.when(script, F.col("_top.code")).when(nothing, fallback).when(F.col("_hits.n") == 0, "en").when(F.col("_tied"), fallback).otherwise(F.col("_hits.code"))
    method = F.when(script, "script").when(nothing, named).when(F.col("_hits.n") == 0, "romanized_lexicon").when(F.col("_tied"), named).otherwise("romanized_lexicon")
    latin = F.col("_n") - F.aggregate("_counts", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    mixed = F.when(script, latin >= T.MIXED * F.col("_n")).otherwise(~nothing & (F.col("_hits.n") > 0))
    return out.withColumn("language", language).withColumn("method", method).withColumn("code_mixed", F.coalesce(mixed, F.lit(False))).drop("_n", "_counts", "_met", "_top", "_hits", "_tied")
