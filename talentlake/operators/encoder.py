"""A learned dense encoder (M-01): inverse document frequencies and a truncated SVD of the corpus itself.

Texts are token counts in ``dims`` hash buckets, weighted by ln((1 + N) / (1 + df)) + 1 and
brought to unit length; these rows form a sparse matrix A. Its first right singular vectors
are found by block power iteration: in each round every task multiplies its own rows,
Z = A' (A V), and the tasks' sums are added in a tree. The model has ``dims`` x (rank +
OVERSAMPLE) numbers (10 MB by default) whatever the corpus, so it is what goes to the tasks
and comes back to the driver, which only makes its columns orthogonal. A text's vector is its
row times V; texts that share no token can be near when their tokens keep the same company.

Null and empty texts give zero vectors; a corpus without tokens a model of zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .similarity import _counts, encode

DIMS = 1 << 15
RANK = 32
OVERSAMPLE = 8
ROUNDS = 4
SEED = 20
FAN_IN = 64                    # partial sums that one task adds up
BLOCKS = 64                    # the model moves in so many pieces
CELLS = 1 << 21                # numbers of a product held together
DENSE = 0.005                  # a bucket is multiplied densely if more than this share of the rows hold it


def _weighted(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket lists as (row, bucket, weight) by row, rows of unit length."""
    rows, buckets, times, _ = _counts(column)
    weights = times * idf[buckets]
    length = np.sqrt(np.bincount(rows, weights * weights, len(column)))
    return rows, buckets, weights / length[rows]


def _grouped_sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` summed by ``at``, which ascends, into n rows."""
    out = np.zeros((n, values.shape[1]))
    if len(at):
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out[at[first]] = np.add.reduceat(values, first, axis=0)
    return out


def _times(column: pa.Array, idf: np.ndarray, v: np.ndarray) -> Iterator[np.ndarray]:
    """The rows' products with ``v``, some rows at a time; equal rows have equal ones, wherever they stand."""
    rows, buckets, weights = _weighted(column, idf)
    ends = np.searchsorted(rows, np.arange(len(column) + 1))
    step = max(1, CELLS // v.shape[1])
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + step, "right")) - 1)
        y = np.zeros((b - a, v.shape[1]))
        for s in range(ends[a], ends[b], step):             # a single row may be longer than a step
            some = slice(s, min(s + step, ends[b]))
            y += _grouped_sums(rows[some] - a, weights[some, None] * v[buckets[some]], b - a)
        yield y
        a = b


def _add_product(column: pa.Array, idf: np.ndarray, v: np.ndarray, total: np.ndarray) -> None:
    """Adds A' (A ``v``) of the column's rows A to ``total``: buckets that many of the rows hold as a dense matrix, the
    others one by one."""
    rows, buckets, weights = _weighted(column, idf)
    ends = np.searchsorted(rows, np.arange(len(column) + 1))
    head = np.flatnonzero(np.bincount(buckets, minlength=len(idf)) > DENSE * len(column))
    place = np.full(len(idf), -1)
    place[head] = np.arange(len(head))
    right = v[head]
    head_total = np.zeros_like(right)
    sortable = np.uint16 if len(idf) <= 1 << 16 else np.int64             # the shorter kind is sorted by its digits
    step = max(1, CELLS // v.shape[1])
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + step, "right")) - 1)
        part = slice(ends[a], ends[b])
        row, bucket, weight, at = rows[part] - a, buckets[part], weights[part], place[buckets[part]]
        dense = at >= 0
        left = np.zeros((b - a, len(head)))
        left[row[dense], at[dense]] = weight[dense]
        y = left @ right
        row, bucket, weight = row[~dense], bucket[~dense], weight[~dense]
        for s in range(0, len(row), step):                                 # a single row may be longer than a step
            some = slice(s, s + step)
            y += _grouped_sums(row[some], weight[some, None] * v[bucket[some]], b - a)
        head_total += left.T @ y
        order = np.argsort(bucket.astype(sortable), kind="stable")
        for s in range(0, len(order), step):
            some = order[s:s + step]
            first = np.flatnonzero(np.append(True, bucket[some][1:] != bucket[some][:-1]))
            total[bucket[some][first]] += np.add.reduceat(weight[some, None] * y[row[some]], first, axis=0)
        a = b
    total[head] += head_total


def _tree_sum(coded: DataFrame, partial: Callable[[Iterator[pa.Array]], np.ndarray], dims: int) -> np.ndarray:
    """The sum over tasks of ``partial``, an array of ``dims`` rows: added in a tree of FAN_IN, in BLOCKS pieces.
    Only rows that are not zero move, so a task of few texts sends little."""
    size = -(-dims // BLOCKS)

    def packed(block: int, at: np.ndarray, values: np.ndarray) -> list:
        return [pa.array([block], pa.int32()), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = partial(b.column(0) for b in batches)
        for block in range(BLOCKS):
            piece = total[block * size:(block + 1) * size]
            at = np.flatnonzero(piece.any(axis=1))
            if len(at):
                yield pa.RecordBatch.from_arrays(packed(block, at, piece[at]), names=["block", "at", "packed"])

    def add(table: pa.Table) -> pa.Table:
        total = None
        for at, values in zip(table.column("at").to_pylist(), table.column("packed").to_pylist()):
            at = np.frombuffer(at, np.int32)
            values = np.frombuffer(values).reshape(len(at), -1)
            total = np.zeros((size, values.shape[1])) if total is None else total
            total[at] += values
        at = np.flatnonzero(total.any(axis=1))
        columns = packed(table.column("block")[0].as_py(), at, total[at])
        return pa.table([columns[0], table.column("task").combine_chunks()[:1], *columns[1:]], names=["block", "task", "at", "packed"])

    tasks = coded.rdd.getNumPartitions()
    parts = coded.select("vec").mapInArrow(run, "block int, at binary, packed binary").withColumn("task", F.spark_partition_id())
    while True:
        tasks = -(-tasks // FAN_IN)
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("block", "task").applyInArrow(
            add, "block int, task int, at binary, packed binary")
        if tasks <= 1:
            break
    out = None
    for r in parts.select("block", "at", "packed").collect():            # BLOCKS rows at most
        at = np.frombuffer(r["at"], np.int32)
        values = np.frombuffer(r["packed"]).reshape(len(at), -1)
        out = np.zeros((size * BLOCKS, values.shape[1])) if out is None else out
        out[r["block"] * size + at] = values
    return np.zeros((dims, 2)) if out is None else out[:dims]


class LearnedEncoder:
    """``idf`` of each bucket, the right singular ``vectors`` (dims x rank) and ``singular`` values of a corpus."""

    def __init__(self, idf: np.ndarray, vectors: np.ndarray, singular: np.ndarray):
        self.idf, self.vectors, self.singular = idf, vectors, singular

    @classmethod
    def fit(cls, corpus: DataFrame, text_col: str, dims: int = DIMS, rank: int = RANK, rounds: int = ROUNDS, seed: int = SEED) -> LearnedEncoder:
        return cls.fit_coded(materialize(encode(corpus, text_col, "vec", dims).select("vec"), "coded-corpus"), dims, rank, rounds, seed)

    @classmethod
    def fit_coded(cls, coded: DataFrame, dims: int = DIMS, rank: int = RANK, rounds: int = ROUNDS, seed: int = SEED) -> LearnedEncoder:
        """From a written table with the bucket lists ``vec`` of :func:`similarity.encode`; it is read once a round."""
        context = coded.sparkSession.sparkContext

        def holding(columns: Iterator[pa.Array]) -> np.ndarray:
            total = np.zeros((dims, 2))                                # rows with the bucket; rows, in the first cell
            for c in columns:
                total[:, 0] += np.bincount(_counts(c)[1], minlength=dims)
                total[0, 1] += len(c)
            return total

        held = _tree_sum(coded, holding, dims)
        n = held[0, 1]
        idf = np.log((1 + n) / (1 + held[:, 0])) + 1
        width = min(rank + OVERSAMPLE, dims)
        v = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0]
        for i in range(rounds):
            sent = context.broadcast((idf, v))

            def product(columns: Iterator[pa.Array], sent=sent) -> np.ndarray:
                idf, v = sent.value
                total = np.zeros_like(v)
                for c in columns:
                    _add_product(c, idf, v, total)
                return total

            z = _tree_sum(coded, product, dims)
            sent.unpersist()
            if not z.any():
                return cls(idf, np.zeros((dims, rank)), np.zeros(rank))
            if i == rounds - 1:                                        # directions within the space found
                values, turn = np.linalg.eigh(v.T @ z)
                best = np.argsort(-values)[:rank]
                return cls(idf, v @ turn[:, best], np.sqrt(np.maximum(values[best], 0)))
            v = np.linalg.qr(z)[0]
        raise ValueError("rounds must be positive")

    def vectors_of(self, rows: DataFrame, key_col: str, text_col: str, out: str = "embedding") -> DataFrame:
        """(key, vector) of each row: its weighted counts times the singular vectors."""
        coded = encode(rows.select(key_col, text_col), text_col, "vec", len(self.idf)).select(key_col, "vec")
        return self.vectors_of_coded(coded, key_col, out)

    def vectors_of_coded(self, coded: DataFrame, key_col: str, out: str = "embedding") -> DataFrame:
        """:meth:`vectors_of` over (key, ``vec``), the bucket lists of :func:`similarity.encode`."""
        kind, rows = coded.schema[key_col].dataType.simpleString(), coded.select(key_col, "vec")
        sent = rows.sparkSession.sparkContext.broadcast((self.idf, self.vectors))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, v = sent.value
            for batch in batches:
                y = np.concatenate([np.zeros((0, v.shape[1])), *_times(batch.column(1), idf, v)])
                ends = pa.array(np.arange(len(y) + 1) * v.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], names=[key_col, out])

        return rows.mapInArrow(run, f"`{key_col}` {kind}, `{out}` array<double>")
