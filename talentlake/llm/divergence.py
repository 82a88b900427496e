"""Source divergence audit: how far each source's use of a language's words lies from the others'.

A language keeps the terms that at least LEAST_DOCS of its documents hold. Kept
terms are sorted over ranges, and each range becomes minimal acyclic transducers
of SHARD_TERMS terms, built in tasks; a term's ordinal is its shard's offset plus
the transducer's number. The texts are then streamed through the transducers, in
bundles of BUNDLE_BYTES that go to every task, one pass over the texts for each
bundle, so that a task's memory is bounded whatever the vocabulary. From there on
terms are integers: counts, blocks of terms, and ties are by ordinal.

Shares are parts of 10^9, floored, of counts plus one; the divergence of p from q
sums floor((p - q)^2 / q), q being another source or the language as a whole. All
arithmetic is exact in 64 bits, while a group has fewer than 9 * 10^13 terms.

Sums over all kept terms of all pairs of a language's sources are taken block by
block: a block holds the counts of some terms for all sources as a matrix of at
most BLOCK_CELLS cells (a term's row at least), and only sums leave it.

Defined results: null text, language and source count as empty; a group without
terms has N = 0; a language without kept terms gives value 0 for each pair and no
term rows; repeated rows each count; an empty table gives no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read, shuffle_partitions, text_of
from .transducer import NO_WORD, Transducer

TERM = re.compile(rb"[A-Za-z\x80-\xff]+")      # of UTF-8: every character from U+0080 on, and the ASCII letters
LEAST_DOCS = 3
SCALE = 1_000_000_000
SHARD_TERMS = 1 << 16
BUNDLE_BYTES = 64 << 20
BLOCK_CELLS = 1 << 18
TOP_TERMS = 200
FLUSH_TERMS = 1 << 19                          # distinct terms that a task holds before it passes their counts on


def terms_of(text: bytes) -> list[bytes]:
    """The terms of UTF-8 text; only A-Z are lower-cased."""
    return TERM.findall(text.lower())


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, body) to (lang, term, n): documents that hold the term, summed while they fit in a task."""
    found: dict[str, Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(counts.keys(), pa.binary()).cast(pa.string()),
                                              pa.array(counts.values(), pa.int64())], names=["lang", "term", "n"])
        found.clear()

    for batch in batches:
        for lang, body in zip(batch.column("lang").to_pylist(), batch.column("body").to_pylist()):
            found[lang].update(set(terms_of(body)))
            if sum(map(len, found.values())) > FLUSH_TERMS:
                yield from flush()
    yield from flush()


def kept_terms(rows: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """A written table (lang, term) of the terms that at least ``least`` documents of the language hold."""
    partial = rows.select("lang", "body").mapInArrow(_document_counts, "lang string, term string, n bigint")
    return materialize(partial.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term"),
                       "kept-terms")


def _build(shard_terms: int):
    """Sorted (lang, term) to (lang, first, n, packed), a transducer for ``shard_terms`` terms at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, words = None, []

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([words[0].decode()]), pa.array([len(words)], pa.int64()),
                                               pa.array([Transducer.build(words).pack()], pa.binary())], names=["lang", "first", "n", "packed"])

        for batch in batches:
            for k, term in zip(batch.column("lang").to_pylist(), batch.column("term").to_pylist()):
                if words and (k != lang or len(words) >= shard_terms):
                    yield shard()
                    words = []
                lang = k
                words.append(term.encode())
        if words:
            yield shard()

    return run


def vocabulary(kept: DataFrame, shard_terms: int = SHARD_TERMS, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """A written table (lang, first, n, offset, bundle, packed): the transducers of each language's sorted terms.
    A term's ordinal is ``offset`` plus its number in the shard; a bundle has ``bundle_bytes``, or one shard more."""
    spark = kept.sparkSession
    ranges = kept.repartitionByRange(shuffle_partitions(spark), "lang", "term").sortWithinPartitions("lang", "term")
    shards = materialize(ranges.mapInArrow(_build(shard_terms), "lang string, first string, n bigint, packed binary"), "shards")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # windows over a row for 65,536 terms
    size = F.sum(F.octet_length("packed").cast("bigint")).over(before(Window.orderBy("lang", "first")))
    places = shards.select("lang", "first", F.coalesce(F.sum("n").over(before(Window.partitionBy("lang").orderBy("first"))), F.lit(0)).alias("offset"),
                           F.floor(F.coalesce(size, F.lit(0)) / bundle_bytes).alias("bundle"))
    return materialize(shards.join(places, ["lang", "first"]), "vocabulary")


class _Shards:
    """The transducers of a bundle, by language."""

    def __init__(self, rows: list[tuple]):
        self.of = defaultdict(list)
        for lang, first, n, offset, packed in rows:               # ascending
            self.of[lang].append((first.encode(), n, offset, Transducer.unpack(packed)))

    def ordinals(self, lang: str, words: list[bytes]) -> np.ndarray:
        """The ordinals of ``words`` in the language, NO_WORD where the bundle has none."""
        out, shards = np.full(len(words), NO_WORD, np.int64), self.of.get(lang, [])
        starts, parts = [s[0] for s in shards], defaultdict(list)
        for i, w in enumerate(words):
            parts[bisect_right(starts, w) - 1].append(i)
        for s, at in parts.items():
            if s >= 0:
                found = shards[s][3].ordinals([words[i] for i in at])
                out[at] = np.where(found == NO_WORD, NO_WORD, found + shards[s][2])
        return out

    def word(self, lang: str, ordinal: int) -> str | None:
        for _, n, offset, transducer in self.of.get(lang, []):
            if offset <= ordinal < offset + n:
                return transducer.word(ordinal - offset).decode()


def _bundles(shards: DataFrame) -> Iterator[Broadcast]:
    """Each bundle of a vocabulary, sent to every task and taken back when the next is asked for."""
    for i in sorted(r["bundle"] for r in shards.select("bundle").distinct().collect()):
        rows = shards.filter(F.col("bundle") == i).orderBy("lang", "first").select("lang", "first", "n", "offset", "packed").collect()
        sent = shards.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])
        yield sent
        sent.unpersist()


def _recount(bundle: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, held = _Shards(bundle.value), defaultdict(dict)          # language: source: counts

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, of in held.items():
                words = list(set().union(*of.values()))
                number = dict(zip(words, shards.ordinals(lang, words).tolist()))
                for source, counts in of.items():
                    at = np.fromiter(map(number.__getitem__, counts), np.int64, len(counts))
                    kept = at != NO_WORD
                    at, n = at[kept], np.fromiter(counts.values(), np.int64, len(counts))[kept]
                    yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.string()).take(pa.array(np.zeros(len(at), np.int32))) for x in (lang, source)),
                                                      pa.array(at), pa.array(n)], names=["lang", "source", "ordinal", "n"])
            held.clear()

        for batch in batches:
            for lang, source, body in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "body"))):
                if lang in shards.of:
                    held[lang].setdefault(source, Counter()).update(terms_of(body))
            if sum(len(c) for of in held.values() for c in of.values()) > FLUSH_TERMS:
                yield from flush()
        yield from flush()

    return run


def recount(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """(lang, source, ordinal, n): occurrences of kept terms, by streaming the texts through each bundle's transducers."""
    out = rows.sparkSession.createDataFrame([], "lang string, source string, ordinal bigint, n bigint")
    for sent in _bundles(shards):
        counted = rows.select("lang", "source", "body").mapInArrow(_recount(sent), out.schema)
        out = out.unionByName(materialize(counted.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "recount"))
    return out


def _spell(bundle: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(bundle.value)
        for batch in batches:
            words = [shards.word(*x) for x in zip(batch.column("lang").to_pylist(), batch.column("ordinal").to_pylist())]
            spelled = pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.string())], names=[*batch.schema.names, "item"])
            yield spelled.filter(spelled.column("item").is_valid())

    return run


def spelled(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """``rows`` (lang, ordinal, ...) with the terms of their ordinals as ``item``."""
    out = rows.sparkSession.createDataFrame([], f"{', '.join(f'`{c}` {t}' for c, t in rows.dtypes)}, item string")
    for sent in _bundles(shards):
        out = out.unionByName(materialize(rows.mapInArrow(_spell(sent), out.schema), "spelled"))
    return out


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (counts + 1) / total), without leaving 64 bits while total < 9 * 10^13."""
    whole, rest = np.divmod(counts + 1, total)
    high, rest = np.divmod(rest * 10**4, total)
    return 1 + whole * SCALE + high * 10**5 + rest * 10**5 // total


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)."""
    return (p - q) ** 2 // q


def _audit_block(top: int):
    """One block of one language: rows (number, ordinal, n), a row of ordinal -1 and n = N for every source, and in each row
    the block's first ordinal ``low`` and number of ``terms``, the language's N as ``whole`` and number of kept terms as
    ``vocabulary``. Gives (lang, part, number, item, value): sums for each pair of sources, item the other's number, and
    each source's ``top`` terms of the block, item the ordinal."""
    def run(block: pa.Table) -> pa.Table:
        number, ordinal, n = (block.column(c).to_numpy() for c in ("number", "ordinal", "n"))
        lang, low, width, whole, kept = (block.column(c)[0].as_py() for c in ("lang", "low", "terms", "whole", "vocabulary"))
        head = ordinal < 0
        of, first = np.unique(number[head], return_index=True)
        counts = np.zeros((len(of), width), np.int64)
        counts[np.searchsorted(of, number[~head]), ordinal[~head] - low] = n[~head]
        p = shares(counts, (n[head][first] + kept)[:, None])
        q = shares(counts.sum(axis=0), np.int64(whole + kept))
        one, other = np.nonzero(~np.eye(len(of), dtype=bool))
        sums = np.stack([divergences(row, p).sum(axis=1) for row in p])[one, other]
        source, term = np.nonzero((counts > 0) & (p > q))
        value = divergences(p[source, term], q[term])
        order = np.lexsort((term, -value, source))
        source, term, value = source[order], term[order], value[order]
        rank = np.arange(len(source)) - np.searchsorted(source, source)
        source, term, value = (x[rank < top] for x in (source, term, value))
        rows = len(one) + len(source)
        return pa.table({"lang": pa.array([lang] * rows, pa.string()), "part": pa.array(["pair"] * len(one) + ["term"] * len(source), pa.string()),
                         "number": pa.array(np.concatenate([of[one], of[source]])), "item": pa.array(np.concatenate([of[other], term + low])),
                         "value": pa.array(np.concatenate([sums, value]))})

    return run


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST_DOCS,
          top: int = TOP_TERMS, shard_terms: int = SHARD_TERMS, bundle_bytes: int = BUNDLE_BYTES, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: how far the source lies from each other source of
    the language. Part ``term``: its ``top`` terms of greatest divergence above the language's share."""
    rows = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).cast("binary").alias("body"))
    kept = kept_terms(rows, least)
    shards = vocabulary(kept, shard_terms, bundle_bytes)
    counts = recount(rows, shards)
    sizes = shards.groupBy("lang").agg(F.sum("n").alias("vocabulary"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.groupBy("lang", "source").count().drop("count").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    # sources are numbered in their order
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint")
    groups = materialize(groups.select("lang", "source", number.alias("number"), F.coalesce("total", F.lit(0)).alias("total"),
                                       F.coalesce("vocabulary", F.lit(0)).alias("vocabulary")), "groups")
    langs = groups.groupBy("lang").agg(F.max("number").alias("sources"), F.sum("total").alias("whole"), F.max("vocabulary").alias("vocabulary"))
    langs = materialize(langs.withColumn("step", F.greatest(F.lit(1), F.floor(F.lit(block_cells) / F.col("sources")))), "langs")

    # blocks of terms, each with every source's N
    cells = counts.join(groups.select("lang", "source", "number"), ["lang", "source"]).join(langs.select("lang", "step"), "lang").select(
        "lang", F.floor(F.col("ordinal") / F.col("step")).alias("block"), "number", "ordinal", "n")
    blocks = langs.filter("vocabulary > 0").select("lang", F.explode(F.sequence(F.lit(0), F.floor((F.col("vocabulary") - 1) / F.col("step"))))
                                                   .alias("block"))
    heads = blocks.join(groups, "lang").select("lang", "block", "number", F.lit(-1).cast("bigint").alias("ordinal"), F.col("total").alias("n"))
    low = F.col("block") * F.col("step")
    whole = cells.unionByName(heads).join(langs.select("lang", "step", "whole", "vocabulary"), "lang").withColumns(
        {"low": low, "terms": F.least(F.col("step"), F.col("vocabulary") - low)})
    found = materialize(whole.groupBy("lang", "block").applyInArrow(
        _audit_block(top), "lang string, part string, number bigint, item bigint, value bigint"), "audited-blocks")

    by_value = Window.partitionBy("lang", "number").orderBy(F.desc("value"), "item")
    none = groups.filter("vocabulary = 0").select("lang", "number")
    zero = none.join(none.withColumnRenamed("number", "item"), "lang").filter("number <> item").withColumn("value", F.lit(0).cast("bigint"))
    pairs = found.filter("part = 'pair'").select("lang", "number", "item", "value").unionByName(zero)
    pairs = pairs.groupBy("lang", "number", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(by_value))
    other = groups.select("lang", F.col("number").alias("item"), F.col("source").alias("other"))
    pairs = pairs.join(other, ["lang", "item"]).drop("item").withColumnRenamed("other", "item")

    terms = found.filter("part = 'term'").select("lang", "number", "item", "value").withColumn("rank", F.row_number().over(by_value))
    terms = materialize(terms.filter(F.col("rank") <= top).withColumnRenamed("item", "ordinal"), "top-terms")
    terms = spelled(terms, shards).drop("ordinal")
    out = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return out.join(groups.select("lang", "number", "source"), ["lang", "number"]).select("lang", "source", "part", "item", "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS i,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
w AS (SELECT lang, source, i, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT i) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM g) LEFT JOIN kept USING (lang) GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n,
        1 + ({SCALE}::HUGEINT * (coalesce(n, 0) + 1)) // (total + v) AS p
      FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term) JOIN total USING (lang, source) JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (sum(n) + 1)) // (max(t) + max(v)) AS q
      FROM c JOIN (SELECT lang, sum(total) AS t FROM total GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
        CAST(coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // y.p) FROM p x JOIN p y USING (lang, term)
                       WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value
      FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
