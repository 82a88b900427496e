"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints link when at most RADIUS = 3 bits differ. Every distinct
fingerprint emits variants within half the radius, one and two flipped bits, and
fingerprints that meet on a variant are linked after their distance is checked:

* at distance 1 or 2, both emit the variant on the way, one flip from each;
* at distance 3 the parities of their bit counts differ. The fingerprint of odd
  parity also emits the variants of two flips within the same 32 bits (of three
  differing bits two lie in the same half), the other meets it with one.

That is 1 + 64 variants for an even fingerprint and 992 more for an odd one.
On a variant, all members one flip away are within 2 of each other, and within 3
of members two flips away: linking each to the least of the former yields the
same components as all pairs would, without listing pairs. A variant has at most
2081 members, as fingerprints are distinct: copies are counted once before.

Variants move in packed blocks (10 bytes each), one row per task and bucket;
the number of buckets grows with the fingerprints, so a bucket stays near
BUCKET_VARIANTS.

Defined results: a null or wordless text has fingerprint zero and links like any
other; of fewer words than a shingle, the whole sequence is one; rows with a null
id belong to their component but never name it (a component of null ids only has
none); rows repeating an id are each returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach_by_key, materialize, read, text_key, text_of
from .components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
BUCKET_VARIANTS = 2_000_000
EMITTED = 561                  # mean number of variants of a fingerprint

_ONE = np.uint64(1) << np.arange(64, dtype=np.uint64)
_PAIRS = np.array([_ONE[i] | _ONE[j] for half in (0, 32) for i in range(half, half + 32)
                   for j in range(i + 1, half + 32)], np.uint64)
MASKS = np.concatenate([np.zeros(1, np.uint64), _ONE, _PAIRS])     # no flip, one flip, two flips
NEAR = 1 + 64                  # masks of at most one flip


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """SimHash of UTF-8 text: a bit is set if it is in more than half the shingles' hashes."""
    words = text.lower().split()            # ASCII case and white space only, as bytes
    if not words:
        return 0
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(size)))]
    n = len(hashes)
    bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    ones = np.add.reduce(bits, axis=0, dtype=np.int64) * 2 > n
    return int(np.packbits(ones, bitorder="little").view(np.uint64)[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keep = [c for c in batch.schema.names if c != "body"]
            f = np.array([fingerprint(b, size) for b in batch.column("body").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(f)], names=[*keep, "fp"])

    return run


def _mixed(v: np.ndarray) -> np.ndarray:
    """Spread variants evenly over buckets."""
    v = (v ^ (v >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return v ^ (v >> np.uint64(29))


def _emit(buckets: int):
    """Fingerprints to (bucket, variants, masks): packed arrays of 8 and 2 bytes a variant."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            odd = np.bitwise_count(fps) % 2 == 1
            for f, masks in ((fps[~odd], np.arange(NEAR)), (fps[odd], np.arange(len(MASKS)))):
                for at in range(0, len(f), 2000):
                    part = f[at:at + 2000]
                    variants = (part[:, None] ^ MASKS[masks][None, :]).ravel()
                    flips = np.tile(masks.astype(np.uint16), len(part))
                    bucket = (_mixed(variants) % np.uint64(buckets)).astype(np.int32)
                    order = np.argsort(bucket, kind="stable")
                    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
                    variants, flips = variants[order], flips[order]
                    rows = [(b, s, e) for b, (s, e) in enumerate(zip([0, *ends[:-1]], ends)) if e > s]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b for b, _, _ in rows], pa.int32()),
                         pa.array([variants[s:e].tobytes() for _, s, e in rows], pa.binary()),
                         pa.array([flips[s:e].tobytes() for _, s, e in rows], pa.binary())],
                        names=["bucket", "variants", "masks"])

    return run


def _meet(table: pa.Table) -> pa.Table:
    """The links of one bucket: fingerprints on the same variant, each with the least one a flip away at most."""
    variants = np.concatenate([np.frombuffer(b, np.uint64) for b in table.column("variants").to_pylist()])
    masks = np.concatenate([np.frombuffer(b, np.uint16) for b in table.column("masks").to_pylist()])
    order = np.argsort(variants, kind="stable")
    variants, masks = variants[order], masks[order]
    same = variants[1:] == variants[:-1]
    met = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    variants, masks = variants[met], masks[met]
    fps = variants ^ MASKS[masks]
    near = masks < NEAR
    start = np.flatnonzero(np.concatenate([[True], variants[1:] != variants[:-1]])) if len(variants) else np.empty(0, int)
    a, b = np.empty(0, np.uint64), np.empty(0, np.uint64)
    if len(start):
        centre = np.minimum.reduceat(np.where(near, fps, np.uint64(2**64 - 1)), start)
        centred = np.logical_or.reduceat(near, start)
        sizes = np.diff(np.append(start, len(variants)))
        b, ok = np.repeat(centre, sizes), np.repeat(centred, sizes)
        ok &= (fps != b) & (np.bitwise_count(fps ^ b) <= RADIUS)
        pairs = np.unique(np.stack([fps[ok], b[ok]], axis=1), axis=0) if ok.any() else np.empty((0, 2), np.uint64)
        a, b = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])
    return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})


def linked(distinct: DataFrame, count: int) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` within RADIUS."""
    buckets = max(1, math.ceil(count * EMITTED / BUCKET_VARIANTS))
    blocks = distinct.select("fp").mapInArrow(_emit(buckets), "bucket int, variants binary, masks binary")
    return blocks.groupBy("bucket").applyInArrow(_meet, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """Per row of ``docs``: id, key (the text's SHA-256), fp, component_id (least id of the component)
    and kept_key (the least key among that id's texts in the component)."""
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), text_of(text_col).cast("binary").alias("body"))
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = materialize(rows.mapInArrow(_fingerprints(size), f"id {id_type}, key binary, fp bigint"), "fingerprints")
    # ids that are null come last: a named row speaks for a fingerprint where there is one
    named = F.when(F.col("id").isNotNull(), F.struct("id", "key"))
    distinct = materialize(rows.groupBy("fp").agg(F.min(named).alias("least"), F.count("*").alias("n")), "distinct-fps")
    roots = components(linked(distinct, distinct.count()))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    placed = materialize(placed, "rooted")
    of = placed.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("n"))
    of = materialize(of, "component-ids")
    stats = attach_by_key(placed.drop("n", "least"), of, "root", "n", distinct.count()).select("fp", "first")
    stats = materialize(stats.join(distinct.select("fp", "n"), "fp"), "fp-components")
    return attach_by_key(rows, stats, "fp", "n", rows.count()).select(
        F.col("id").alias(id_col), "key", "fp", F.col("first.id").alias("component_id"), F.col("first.key").alias("kept_key"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the one with the least id
    (rows without an id, which can speak for none, go with a component that has one and stay otherwise)."""
    found = near_duplicates(docs, id_col, text_col, size)
    out = found.filter(F.col("component_id").isNotNull()
                       & ~(F.col(id_col).eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("kept_key"))))
    out = materialize(out.select(F.col(id_col).alias("__id"), F.col("key").alias("__key")).distinct(), "near-copies")
    return docs.join(out, docs[id_col].eqNullSafe(out["__id"]) & (text_key(text_col) == out["__key"]), "left_anti")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
