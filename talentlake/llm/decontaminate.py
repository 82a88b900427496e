"""Benchmark decontamination by winnowing.

Every text is cut into words; of the hashes of its k-grams, the least of each
sliding window of w grams is kept, so that two texts sharing a span of at least
``k + w - 1 = WINDOW`` words share a kept hash. Document and benchmark hashes are
joined; the words of the pairs that collide are then compared, extending each
hit to both sides, and a run of WINDOW words or more counts. Items shorter than
a window count as one window of their own length: for these k is the item's
length and every gram of a document is kept (w = 1).

What a document holds depends on its text alone, so copies are compared once,
under the text's SHA-256.

Defined results: null and wordless texts have no words and are never hit;
wordless items match nothing; items with equal texts are compared once and all
counted; a null item id is not counted or listed; without hits the list of items
is empty (and its hash that of the empty string); an empty benchmark leaves
every document clean; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach_left, materialize, read, text_key, text_of

WINDOW = 10
GRAM = 5
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

# Bytes that are no part of a word become spaces, A-Z become a-z.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else 32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b
               for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-cased words of UTF-8 text: runs of digits, letters and all characters beyond ASCII."""
    return text.translate(_TABLE).split()


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def gram_hashes(hashed: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashed[:n].copy()
    for j in range(1, k):
        out *= MULTIPLIER
        out += hashed[j:j + n]
    out ^= out >> np.uint64(29)
    out *= MULTIPLIER
    out ^= out >> np.uint64(32)
    return out + np.uint64(k)


def window_minima(grams: np.ndarray, w: int) -> np.ndarray:
    """The least hash of each window of w grams."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = grams[:n].copy()
    for j in range(1, w):
        np.minimum(out, grams[j:j + n], out=out)
    return out


def kept_hashes(hashed: np.ndarray, families: list[tuple[int, int]]) -> np.ndarray:
    """The hashes kept of one text, for each (k, w), once each."""
    parts = [window_minima(gram_hashes(hashed, k), w) for k, w in families]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def family_of(n_words: int) -> tuple[int, int]:
    """(k, w) that finds an item of that many words."""
    return (GRAM, WINDOW - GRAM + 1) if n_words >= WINDOW else (n_words, 1)


def _arrays(column: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in column])]).astype(np.int32)
    values = np.concatenate(column) if column else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def fingerprints(rows: DataFrame, families: list[tuple[int, int]] | None) -> DataFrame:
    """``rows`` (key, body, ...) without the body, with n_words and the kept hashes.
    families: None takes the one that fits each text's own length."""
    keep = [c for c in rows.columns if c != "body"]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            counts, kept = [], []
            for body in batch.column("body").to_pylist():
                tokens = words(body)
                counts.append(len(tokens))
                fitting = ([family_of(len(tokens))] if tokens else []) if families is None else families
                kept.append(kept_hashes(word_hashes(tokens), fitting) if fitting else np.empty(0, np.uint64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(counts, pa.int64()), _arrays(kept)],
                                             names=[*keep, "n_words", "kept"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    return rows.mapInArrow(run, f"{schema}, n_words bigint, kept array<bigint>")


def item_runs(tokens: list[bytes], hashed: np.ndarray, item: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs (start, end) of ``tokens`` that hold a window of ``item``: shared grams, extended while words agree."""
    k, w = family_of(len(item))
    grams, own = gram_hashes(hashed, k), gram_hashes(word_hashes(item), k)
    at: dict[int, list[int]] = {}
    for s, least in enumerate(window_minima(own, w)):       # one place for each of the item's windows
        place = s + int(np.argmax(own[s:s + w] == least))
        if place not in at.setdefault(int(least), []):
            at[int(least)].append(place)
    hits = np.flatnonzero(np.isin(grams, np.fromiter(at, np.uint64, len(at))))
    done: dict[int, int] = {}                                # by diagonal: where its last run ended
    need = min(WINDOW, len(item))
    for p in hits.tolist():
        for q in at[int(grams[p])]:
            if done.get(p - q, -1) > p:
                continue
            a, b = p, q
            while a > 0 and b > 0 and tokens[a - 1] == item[b - 1]:
                a, b = a - 1, b - 1
            e, f = p, q
            while e < len(tokens) and f < len(item) and tokens[e] == item[f]:
                e, f = e + 1, f + 1
            done[p - q] = e
            if e - a >= need:
                yield a, e


def _compare(batches: Iterator[pa.RecordBatch]):
    """(key, body, items: [(item, body)]) to (key, n_hit, items found)."""
    for batch in batches:
        keys, counts, found = [], [], []
        for key, body, items in zip(*(batch.column(c).to_pylist() for c in ("key", "body", "items"))):
            tokens = words(body)
            hashed, hit, held = word_hashes(tokens), np.zeros(len(tokens), bool), []
            for item in items:
                runs = list(item_runs(tokens, hashed, words(item["item_body"])))
                for a, e in runs:
                    hit[a:e] = True
                if runs:
                    held.append(item["item"])
            keys.append(key)
            counts.append(int(hit.sum()))
            found.append(held)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int64()),
                                          pa.array(found, pa.list_(pa.binary()))], names=["key", "n_hit", "found"])


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text",
                       extra: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hits, items): per row of ``docs`` the text's key, n_words and the ``extra`` columns; per contaminated
    text key, n_hit and the item keys ``found``; and the benchmark's item keys and texts."""
    body = lambda c: text_of(c).cast("binary")
    items = benchmark.select(text_key(item_text_col).alias("item"), body(item_text_col).alias("item_body"))
    items = items.groupBy("item").agg(F.first("item_body").alias("item_body"))
    tests = materialize(fingerprints(items.select("item", F.col("item_body").alias("body")), None), "test-hashes")
    lengths = [r[0] for r in tests.filter("n_words > 0").select(F.least("n_words", F.lit(WINDOW)).alias("n")).distinct()
               .orderBy("n").collect()]                      # at most WINDOW numbers
    rows = fingerprints(docs.select(*[c.alias(n) for n, c in (extra or {}).items()], text_key(text_col).alias("key"),
                                    body(text_col).alias("body")), [family_of(n) for n in lengths])
    rows = materialize(rows, "document-hashes")
    pairs = (rows.select("key", F.explode("kept").alias("h")).join(tests.select("item", F.explode("kept").alias("h")), "h")
             .select("key", "item").distinct())
    lists = materialize(pairs.join(items, "item").groupBy("key").agg(
        F.collect_list(F.struct("item", "item_body")).alias("items")), "candidates")
    texts = docs.select(text_key(text_col).alias("key"), body(text_col).alias("body"))
    texts = texts.join(lists.select("key"), "key", "left_semi").groupBy("key").agg(F.first("body").alias("body"))
    hits = texts.join(lists, "key").select("key", "body", "items").mapInArrow(
        _compare, "key binary, n_hit bigint, found array<binary>").filter("n_hit > 0")
    return rows.drop("kept"), materialize(hits, "contaminated"), items


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, with all their columns."""
    _, hits, _ = contaminated_texts(docs, benchmark, text_col, item_text_col)
    return docs.join(hits.select("key"), text_key(text_col) == hits["key"], "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    rows, hits, _ = contaminated_texts(docs, benchmark, extra={"doc_id": F.col("doc_id")})
    ids = benchmark.select(text_key("text").alias("item"), F.col("item_id").cast("string").alias("item_id")).distinct()
    listed = hits.select("key", "n_hit", F.explode("found").alias("item")).join(ids, "item").groupBy("key").agg(
        F.collect_set("item_id").alias("ids"))
    marked = hits.select("key", "n_hit").join(listed, "key", "left")
    ids = F.coalesce(F.array_sort("ids"), F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return attach_left(rows.select("doc_id", "n_words", "key"), marked, "key").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(10, len(w)) AS l FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, CAST(len(w) - l + 2 AS BIGINT))) AS i FROM bl)),
dl AS (SELECT d.doc_id, d.w, s.l FROM d, (SELECT DISTINCT l FROM bw) s WHERE len(d.w) >= s.l),
dw AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, CAST(len(w) - l + 2 AS BIGINT))) AS i FROM dl)),
hits AS (SELECT DISTINCT dw.doc_id, dw.i, dw.l, bw.item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.g = bw.g),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, i + unnest(range(l)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit,
       CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN found USING (doc_id)
"""
