"""Operator 3, toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learnt from labelled rows: words and beginnings of words that mark label 1 and stand in many
different contexts (so copies of one text can't fill it). Features are its densities, hits near a second-person word,
capitals, punctuation and obfuscation rates. Trees (Spark ML) learn from three quarters of a bounded sample
(MOST_ROWS labelled rows, in hash order), and so does the lexicon; the isotonic step learns from the rest. Every whole
text is scored. If the rows that grow the trees hold no toxic one, all rows grow them (the isotonic step then sees rows
that the trees have learnt from).

Cases: null and empty texts have all-zero densities and get a score like any other; a very long text is scored whole;
repeated rows get equal scores; rows without doc_id are scored, but never learnt from; ties in the sample go to the
smaller doc_id;
without labelled rows of both labels every score is the share of label 1 (0 if there are none); an empty table gives an
empty result; only doc_id and text are read, so other columns may be named anything.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.labelled import held_out, sample
from tidemark.llm.shared import slices, texts, written

MOST_ROWS = 10_000
MIN_SUPPORT, SUPPORT_SHARE, MIN_ODDS = 4, 0.02, 3.0
STARTS = (3, 8)  # letters of the beginnings learnt
SECOND_PERSON = frozenset("you your yours yourself youre u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
FEATURES = ["word_density", "start_density", "odds_density", "strongest", "distinct_hits", "near_second_person", "second_person", "capitals", "shouting", "punctuation", "exclamation", "obfuscated", "obfuscated_hits", "log_words"]
CAPITALS, MARKS = bytes(range(65, 91)), b"!?.,;:"
NEAR = 3  # words between a hit and a second-person word, at most
_EDGE = re.compile(r"^[^\w@$*]+|[^\w@$*]+$")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "*": "", ".": "", "-": "", "_": ""})


@dataclass
class Lexicon:
    words: dict[str, float]
    starts: dict[str, float]

    def __post_init__(self):
        self.heads = {s[: STARTS[0]] for s in self.starts}


def learn_lexicon(train: DataFrame) -> Lexicon:
    """Terms with high log-odds of label 1 that follow many different words.

    A term stands in SUPPORT_SHARE of the toxic texts at least, so there are at most 1 / SUPPORT_SHARE times as many as a
    toxic text has on average, however many rows are learnt from.
    """
    n = train.agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).first()
    na, nb = n["a"] or 0, n["b"] or 0
    least = max(MIN_SUPPORT, SUPPORT_SHARE * na)
    word = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}'@$*]+"), lambda w: F.length(w) > 2)
    split = train.select("doc_id", "label", word.alias("w"))
    starts = lambda w: F.transform(F.sequence(F.lit(STARTS[0]), F.least(F.lit(STARTS[1]), F.length(w) - 1)), lambda k: F.concat(F.lit("^"), F.substring(w, F.lit(1), k)))
    terms = lambda w: F.concat(F.array(w), F.when(F.length(w) > STARTS[0], starts(w)).otherwise(F.array().cast("array<string>")))
    per_doc = split.select("label", F.explode(F.array_distinct(F.flatten(F.transform(F.array_distinct("w"), terms)))).alias("term"))
    odds = F.log((F.col("a") + 0.5) / (na + 1.0)) - F.log((F.col("b") + 0.5) / (nb + 1.0))
    counted = per_doc.groupBy("term").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).where(F.col("a") >= least).withColumn("odds", odds).where(F.col("odds") >= MIN_ODDS)
    marks = written(counted.select("term", "odds"), "toxic-terms")
    at = split.where("label = 1").select("w", F.posexplode("w").alias("i", "word"))
    before = F.when(F.col("i") > 0, F.col("w")[F.col("i") - 1]).otherwise("")
    uses = at.select(before.alias("before"), F.explode(terms(F.col("word"))).alias("term")).join(F.broadcast(marks), "term")
    contexts = uses.groupBy("term", "odds").agg(F.approx_count_distinct("before").alias("contexts")).where(F.col("contexts") >= least)
    found = {r.term: r.odds for r in contexts.orderBy("term").collect()}
    return Lexicon({t: x for t, x in found.items() if t[0] != "^"}, {t[1:]: x for t, x in found.items() if t[0] == "^"})


def word_traits(words: list[str], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: flags (shouted, second person, in the lexicon, obfuscated, obfuscated word of the lexicon), its largest
    odds, and its number as it counts for distinct hits. The one place where Python looks at single words; a slice of texts
    gives it each distinct word once."""
    by_word, by_start, heads = lexicon.words, lexicon.starts, lexicon.heads
    flags, best, plain_of = np.zeros((len(words), 5), dtype=bool), np.zeros(len(words)), np.zeros(len(words), dtype=np.int64)
    number: dict[str, int] = {}
    for i, w in enumerate(words):
        shouted, w = w.isupper(), w.lower()
        obfuscated = hidden = False
        if not w.isalpha():
            w = _EDGE.sub("", w)
            if len(w) > 2 and not w.isalpha() and not w.isdigit():
                plain = w.translate(_LEET)
                if plain != w and plain.isalpha():
                    obfuscated = True
                    if plain in by_word:
                        hidden, w = True, plain
        odds = by_word.get(w, 0.0)
        flags[i] = shouted, w in SECOND_PERSON, w in by_word, obfuscated, hidden
        if w[: STARTS[0]] in heads:
            odds = max(odds, *(by_start.get(w[:k], 0.0) for k in range(STARTS[0], min(STARTS[1], len(w) - 1) + 1)), 0.0)
        best[i], plain_of[i] = odds, number.setdefault(w, len(number))
    return flags, best, plain_of


def describe(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """The features of each text, in the order of FEATURES: words are split and numbered by Arrow, looked at once each, and
    summed up by text."""
    n = len(column)
    split = pc.utf8_split_whitespace(column.cast(pa.large_string()))
    flat, count = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(n), count)
    coded = flat.dictionary_encode()
    listed, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    solid = np.array([bool(w) for w in listed], dtype=bool)[code] if len(code) else np.zeros(0, dtype=bool)  # white space at an end leaves an empty word
    doc, code = doc[solid], code[solid]
    flags, odds, plain = word_traits(listed, lexicon)
    words = np.bincount(doc, minlength=n)
    sums = [np.bincount(doc, flags[code, k], n) for k in range(5)]
    shouted, second, exact, obfuscated, hidden = sums
    hit = np.flatnonzero(odds[code] > 0)
    at, power = doc[hit], odds[code[hit]]
    strongest = np.zeros(n)
    np.maximum.at(strongest, at, power)
    pairs = np.unique(at * (len(listed) + 1) + plain[code[hit]])
    distinct = np.bincount(pairs // (len(listed) + 1), minlength=n)
    own = np.flatnonzero(flags[code, 1])
    near = np.zeros(len(hit), dtype=bool)
    if len(own):
        after = np.minimum(np.searchsorted(own, hit), len(own) - 1)
        for k in (after, np.maximum(after - 1, 0)):
            near |= (np.abs(own[k] - hit) <= NEAR) & (doc[own[k]] == at)
    raw = [x.encode() for x in column.to_pylist()]
    chars = np.maximum(1, pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    lost = lambda gone: np.array([len(x) - len(x.translate(None, gone)) for x in raw], dtype=float)
    per = 100 / np.maximum(1, words)
    features = [exact * per, np.bincount(at, minlength=n) * per, np.bincount(at, power, n) * per, strongest, distinct, np.bincount(at[near], minlength=n) * per, second * per, lost(CAPITALS) / chars, shouted * per / 100, lost(MARKS) / chars, lost(b"!") * per, obfuscated * per, hidden * per, np.log1p(words)]
    out = np.column_stack(features).astype(float)
    out[words == 0] = 0.0
    return out


def described(lexicon: Lexicon):
    """The features as a function of columns of text."""

    @F.arrow_udf(", ".join(f"{f} double" for f in FEATURES))
    def run(text: pa.Array) -> pa.Array:
        made = [np.zeros((0, len(FEATURES)))]
        for part in slices(pa.RecordBatch.from_arrays([text], names=["text"])):
            made.append(describe(part.column(0), lexicon))
        return pa.StructArray.from_arrays([pa.array(x) for x in np.concatenate(made).T], names=FEATURES)

    return run


def featured(rows: DataFrame, lexicon: Lexicon, *keep: str) -> DataFrame:
    return rows.select("doc_id", *keep, described(lexicon)("text").alias("_f")).select("doc_id", *keep, "_f.*")


@dataclass
class Model:
    lexicon: Lexicon
    trees: object | None
    curve: tuple[list[float], list[float]]  # boundaries and predictions of the isotonic step
    prior: float

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id and score of every text."""
        if self.trees is None:
            return docs.select("doc_id", F.lit(self.prior).alias("score"))
        return self.calibrated(featured(texts(docs), self.lexicon), "doc_id")

    def kept(self, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
        """The documents that score below threshold. The text travels along with its features, so nothing is joined."""
        if self.trees is None:
            return docs if self.prior < threshold else docs.limit(0)
        rows = docs.select(F.struct("*").alias("_doc"), described(self.lexicon)(F.coalesce("text", F.lit(""))).alias("_f")).select("_doc", "_f.*")
        return self.calibrated(rows, "_doc").where(F.col("score") < threshold).select("_doc.*")

    def calibrated(self, rows: DataFrame, keep: str) -> DataFrame:
        """Scores on the isotonic curve; a fiftieth of the raw score keeps texts on one step of it in order."""
        rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
        raw = self.trees.transform(rows).select(keep, vector_to_array("probability")[1].alias("raw"))
        return raw.select(keep, (0.98 * interpolated(F.col("raw"), *self.curve) + 0.02 * F.col("raw")).alias("score"))


def interpolated(x: Column, xs: list[float], ys: list[float]) -> Column:
    """The isotonic curve as a column expression: constant beyond its ends, linear between its steps."""
    out = F.lit(ys[-1])
    for a, b, u, v in reversed(list(zip(xs, xs[1:], ys, ys[1:]))):
        inside = F.lit(u) if u == v or a == b else F.lit(u) + (x - a) * ((v - u) / (b - a))
        out = F.when(x < b, inside).otherwise(out)
    return F.when(x <= xs[0], F.lit(ys[0])).otherwise(out)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Model:
    train = written(sample(docs, labels, "toxic", most), "toxic-train")
    n = train.agg(F.count("*").alias("n"), F.sum("label").alias("a")).first()
    if not n["a"] or n["a"] == n["n"]:
        return Model(Lexicon({}, {}), None, ([], []), (n["a"] or 0) / max(1, n["n"]))
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4))
    lexicon = learn_lexicon(train.where(part > 0))  # calibration must not see terms learnt from its own rows
    rows = written(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured(train, lexicon, "label")).select("doc_id", "label", "features"), "toxic-features")
    grow, tune = rows.where(part > 0), rows.where(part == 0)
    trees = GBTClassifier(labelCol="label", maxIter=10, maxDepth=3, stepSize=0.3, seed=1, cacheNodeIds=False).fit(grow if 0 < (grow.agg(F.sum("label")).first()[0] or 0) else rows)
    scored = trees.transform(tune).select(vector_to_array("probability")[1].alias("raw"), F.col("label").cast("double").alias("label"))
    if scored.isEmpty():
        return Model(lexicon, trees, ([0.0, 1.0], [0.0, 1.0]), n["a"] / n["n"])
    step = IsotonicRegression(featuresCol="raw", labelCol="label").fit(scored)
    return Model(lexicon, trees, (step.boundaries.toArray().tolist(), step.predictions.toArray().tolist()), n["a"] / n["n"])


def score_documents(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, threshold: float = 0.5) -> DataFrame:
    scored = fit(docs, labels, most).score(docs)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op3_toxicity_trees": op3}
SQL: dict[str, str] = {}
