"""Toxicity by gradient-boosted trees over dense features.

A lexicon of words and word beginnings is learnt from labelled rows: units whose
documents are toxic far more often than others. A text is described by lexicon
densities, the distance of lexicon words to the second person, capitals,
punctuation, repetition and obfuscation; boosted trees score the features and an
isotonic map turns margins into probabilities. Each half of the sample is
described with the lexicon of the other half, trees and calibration are fitted on
separate rows, and near copies of a text are one example.

The fit uses at most about SAMPLE_ROWS labelled rows, chosen by a hash of the
id; scores cover every whole text. Labels, language, source and id are no
features.

Defined results: null and empty texts have features of zero and are scored like
others; rows without a label are not learnt from; an id labelled twice is toxic
if one label says so; where the sample lacks one of the two classes, every text
scores the share of toxic rows (0 without any); other columns are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .boosting import Isotonic, Trees, fit_isotonic, fit_trees
from .common import held_out, materialize, read, text_of

SAMPLE_ROWS = 20_000
LEXICON_SIZE = 1_000
LEAST_Z = 4.5
THRESHOLD = 0.7
BEGINNINGS = (3, 4, 5, 6)
NEAR_WORDS = 5
# Second-person words of English, French, German and Spanish.
SECOND_PERSON = frozenset("""you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen
    deiner ihr euch euer sie ti tus usted ustedes vosotros""".split())
# Figures and signs written for letters.
WRITTEN_FOR = str.maketrans("013457@$!", "oieastasi")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
MIXED = re.compile(r"[^\W\d_][\d@$*!]+[^\W\d_]")
LONG_RUN = re.compile(r"([^\W\d_])\1{2,}")
CAPITALS = bytes(range(0x41, 0x5B))
DIGITS = bytes(range(0x30, 0x3A))
MARKS = b".,;:!?\"'()-"
SIGNS = b"#$%&*@^~<>|{}[]\\/_+="
N_FEATURES = 16
KNOWN_TOKENS = 200_000


def units(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


def spelled(token: str) -> str:
    """A token without marks around it, with signs inside read as letters."""
    word = EDGES.sub("", token)
    return word if word.isalpha() else re.sub(r"[\W\d_]+", "", word.translate(WRITTEN_FOR))


def judged(token: str, lexicon: dict[str, float], known: dict) -> tuple[float, bool, bool]:
    """(lexicon weight, whether signs are mixed in, whether a letter is drawn out) of a token.
    ``known`` keeps what was judged before, of at most KNOWN_TOKENS tokens."""
    found = known.get(token)
    if found is None:
        plain = token.isalpha()
        word = token if plain else spelled(token)
        weight = max(map(lexicon.get, units(word), [0.0] * 5)) if word else 0.0
        found = weight, not plain and MIXED.search(token) is not None, LONG_RUN.search(token) is not None
        if len(known) >= KNOWN_TOKENS:
            known.clear()
        known[token] = found
    return found


def features(text: str, lexicon: dict[str, float], known: dict | None = None) -> list[float]:
    """The dense features of one text."""
    known = {} if known is None else known
    if not text:
        return [0.0] * N_FEATURES
    tokens = text.lower().split()
    n = max(len(tokens), 1)
    counts = Counter(tokens)
    strong = hidden = mixed = runs = 0
    total, most, distinct = 0.0, 0.0, 0
    bad = set()
    for token, times in counts.items():
        weight, odd, drawn = judged(token, lexicon, known)
        if odd:
            mixed += times
        if drawn:
            runs += times
        if weight > 0:
            bad.add(token)
            strong += times
            hidden += times * odd
            distinct += 1
            total += weight * times
            most = max(most, weight)
    close = 0.0
    if bad:
        hits = [i for i, t in enumerate(tokens) if t in bad]
        you = np.array([i for i, t in enumerate(tokens) if t.strip(".,!?") in SECOND_PERSON])
        if len(you):
            at = np.searchsorted(you, hits)
            gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - hits), np.abs(you[np.maximum(at - 1, 0)] - hits))
            close = float((gap <= NEAR_WORDS).sum())
    raw = text.encode()
    size = len(raw)
    share = lambda chars: (size - len(raw.translate(None, chars))) / size
    return [math.log1p(n), strong, strong / n, total / n, most, distinct, distinct / n, close / n, close, hidden / n,
            mixed / n, runs / n, share(CAPITALS), share(MARKS), share(SIGNS), len(counts) / n]


@dataclass
class Model:
    lexicon: dict
    trees: Trees | None
    calibrate: Isotonic | None
    share: float

    def score(self, texts, known: dict | None = None) -> np.ndarray:
        known = {} if known is None else known
        if self.trees is None:
            return np.full(len(texts), self.share)
        x = np.array([features(t, self.lexicon, known) for t in texts], float).reshape(-1, N_FEATURES)
        return np.clip(self.calibrate(self.trees.margin(x)), 0.0, 1.0)


def _count_units(batches: Iterator[pa.RecordBatch]):
    """(text, toxic) to the number of toxic and other texts of each unit, summed over a batch."""
    for batch in batches:
        seen = (Counter(), Counter())
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = {spelled(t) for t in set(text.lower().split())}
            seen[toxic].update({u for w in words if w for u in units(w)})
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][u] for u in names], pa.int64()),
                                          pa.array([seen[0][u] for u in names], pa.int64())], names=["unit", "bad", "good"])


def near_key(text: str) -> int:
    """A number that near copies mostly share: the least hash of five words in a row."""
    words = text.lower().encode().split()
    grams = zip(*(words[i:] for i in range(min(5, len(words) or 1)))) if words else [(b"",)]
    return min(xxhash.xxh3_64_intdigest(b" ".join(g)) for g in grams) >> 1


def _with_key(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        keys = [near_key(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, "near"])


def lexicon_of(sample: DataFrame, size: int = LEXICON_SIZE) -> dict[str, float]:
    """Units with their weights (log odds) learnt from ``sample`` (text, toxic): at most ``size`` of them."""
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return {}
    q = bad / (bad + good)
    counts = sample.select("text", "toxic").mapInArrow(_count_units, "unit string, bad bigint, good bigint")
    counts = counts.groupBy("unit").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).filter("bad > 2")
    both = F.col("bad") + F.col("good")
    z = (F.col("bad") - both * q) / F.sqrt(both * q * (1 - q))
    weight = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    rows = (counts.select("unit", z.alias("z"), weight.alias("weight")).filter((F.col("z") >= LEAST_Z) & (F.col("weight") >= 2))
            .orderBy(F.desc("z"), "unit").limit(size).collect())
    return {r["unit"]: r["weight"] for r in rows}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the labelled rows of ``docs`` that are not held out (crc32 of the id modulo 3 not 1)."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, 3, 1))
    known = materialize(known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic")), "labelled")
    total = known.count()
    place = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_000)) / 1_000_000
    known = known.filter(place < (sample_rows / total if total else 0)).withColumn(
        "part", F.pmod(F.crc32(F.concat(F.lit("part:"), F.col("id").cast("string")).cast("binary")), F.lit(20)).cast("int"))
    sample = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(known, "id")
    id_type = sample.schema["id"].dataType.simpleString()
    sample = sample.mapInArrow(_with_key, f"id {id_type}, text string, toxic int, part int, near bigint")
    # near copies are one example, and of one part: the part of the first id
    sample = materialize(sample, "toxicity-sample")
    first = sample.groupBy("near").agg(F.min("id").alias("id"))
    sample = materialize(sample.join(first, ["near", "id"]).dropDuplicates(["near"]), "toxicity-examples")
    halves = [sample.filter("part < 10"), sample.filter("part >= 10")]
    described = [half.mapInArrow(_described(lexicon_of(other)), f"id {id_type}, part int, toxic int, x array<double>")
                 for half, other in zip(halves, halves[::-1])]
    rows = described[0].unionByName(described[1]).orderBy("id").collect()      # N_FEATURES numbers for each sample row
    x = np.array([r["x"] for r in rows], float).reshape(-1, N_FEATURES)
    y, part = np.array([r["toxic"] for r in rows], float), np.array([r["part"] for r in rows], int)
    share = float(y.mean()) if len(y) else 0.0
    fitting = part % 4 != 3
    if not all(0 < y[m].sum() < m.sum() for m in (fitting, ~fitting)):
        return Model({}, None, None, share)
    trees = fit_trees(x[fitting], y[fitting])
    return Model(lexicon_of(sample), trees, fit_isotonic(trees.margin(x[~fitting]), y[~fitting]), share)


def _described(lexicon: dict):
    def run(batches: Iterator[pa.RecordBatch]):
        known: dict = {}
        for batch in batches:
            x = [features(t, lexicon, known) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"),
                                              batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))],
                                             names=["id", "part", "toxic", "x"])

    return run


def toxicity(model: Model, text_col: str = "text") -> Column:
    """Probability that a text is toxic."""
    @F.pandas_udf(DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict = {}
        for texts in batches:
            yield pd.Series(model.score(texts.tolist(), known))

    return scored(text_of(text_col))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``, with all their columns."""
    return docs.filter(toxicity(fit(docs, labels, id_col, text_col), text_col) < threshold)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), toxicity(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
