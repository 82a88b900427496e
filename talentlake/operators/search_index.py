"""A stored corpus that requests search: inverted index and exact pruned top-k (S-17, J-07, M-03, O-01).

Layout, four Parquet tables in one folder, written once and only read by searches:

* ``vectors``: (key, buckets, counts, length, block, row); rows are numbered, in the order of
  their keys, inside blocks of BLOCK_ROWS at most, of some batch of the writing job each;
* ``blocks``: (block, keys, lengths), the same rows without their buckets, a block a row;
* ``postings``: (bucket, block, rows, counts, size, top), the rows of a block that hold a token
  bucket, with their counts; partitioned by ``slot`` (the high bits of the bucket),
  range-partitioned and sorted by bucket within a slot, so that a request reads the
  files of its own buckets' slots, and of those the matching pages;
* ``lists``: (bucket, size, top), how many rows hold the bucket and the greatest weight
  n / length among them, by the same slots.

Search, for all queries at once. Lists meet the queries that ask for them by a join on the
bucket and are shuffled by block, so that the pairs of queries and rows are multiplied
where a block is, and only the best of a block for each query leave it:

1. the shortest lists of each query give seeds; SEEDS of them, by their part of the
   score, are scored in full, and the k-th best score is a bound that the result reaches;
2. a query's longest lists are set aside as long as together they cannot reach the bound
   (the lesser of the sum of weight times ``top`` and, by Cauchy and Schwarz, the length
   of the query's part): a row that is in none of the other lists cannot be a result;
3. the other lists give each block's best parts of a score; where these and what the lists set
   aside can add stay below the bound, the block has no result of the query. The other
   blocks are scored in full, which reads the lists set aside there and only there, and the
   k best of each are ranked.

So scores, ties and ranks are those of scoring every row. Dot products are sums of whole
numbers, the same in any order. Rows that share no bucket with a query have score 0 and
fill its ranks in the order of their keys where fewer than k rows share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..session import materialize
from .similarity import DEFAULT_DIMS, PAIRS, SCORE_DECIMALS, SLICE_LISTS, _best, _counts, check_request, encode, gate_queries

SLOT_BITS = 4                  # 16 slots; more where requests are few and the corpus large
SEEDS = 64                     # rows per query scored in full for the bound, and k at least
SEED_POSTINGS = 1 << 14        # a query's shortest lists, up to so many rows together, give its seeds
BEST = max(SEEDS, V.TOP_K_MAX)   # parts of a score that a block gives for a query
BLOCK_ROWS = 1 << 14
SLACK = 1e-9                   # bounds are sums of floating point numbers; results are compared to 12 decimals


def _vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, buckets with repeats) to (key, distinct buckets, counts, length, block, row), by key in each block."""
    task, n = TaskContext.get().partitionId(), 0
    for whole in batches:
        for a in range(0, len(whole), BLOCK_ROWS):
            batch = whole.slice(a, BLOCK_ROWS)
            batch = batch.take(pc.sort_indices(batch.column(0)))
            rows, buckets, times, length = _counts(batch.column(1))
            ends = pa.array(np.searchsorted(rows, np.arange(len(batch) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (buckets, times)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *lists, pa.array(length), pa.array(np.full(len(batch), task << 32 | n)),
                 pa.array(np.arange(len(batch), dtype=np.int32))], names=["key", "buckets", "counts", "length", "block", "row"])
            n += 1


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, row, length, buckets, counts) to the lists of each block; a block may come in several batches."""
    for batch in batches:
        each = np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column("buckets")).to_numpy())
        block, row = (batch.column(c).to_numpy()[each] for c in ("block", "row"))
        buckets, times = (batch.column(c).flatten().to_numpy() for c in ("buckets", "counts"))
        order = np.lexsort((row, buckets, block))
        block, row, buckets, times = block[order], row[order], buckets[order], times[order]
        first = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (buckets[1:] != buckets[:-1]))[:len(block)])
        weights = times / batch.column("length").to_numpy()[each[order]]
        ends = pa.array(np.append(first, len(block)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(buckets[first]), pa.array(block[first]), pa.ListArray.from_arrays(ends, pa.array(row)),
             pa.ListArray.from_arrays(ends, pa.array(times)), pa.array(np.diff(np.append(first, len(block))), pa.int32()),
             pa.array(np.maximum.reduceat(weights, first) if len(first) else weights)],
            names=["bucket", "block", "rows", "counts", "size", "top"])


def _leaders(best: int):
    """The lists of a block that queries ask for, and its rows, to the ``best`` rows of each query by the product over these
    lists; ``wanted`` names the queries, all if it is null."""
    def run(lists: pa.Table, block: pa.Table) -> pa.Table:
        schema = pa.schema([("qno", pa.int64()), ("block", pa.int64()), ("key", block.schema.field("keys").type.value_type),
                            ("dot", pa.int64()), ("length", pa.float64()), ("q_length", pa.float64())])
        if not lists.num_rows or not block.num_rows:
            return schema.empty_table()
        rows, counts, asked = (lists.column(c).combine_chunks() for c in ("rows", "counts", "asked"))
        size = pc.list_value_length(rows).to_numpy()
        start = np.cumsum(size) - size
        rows, counts = rows.flatten().to_numpy(), counts.flatten().to_numpy()
        of = np.repeat(np.arange(len(size)), pc.list_value_length(asked).to_numpy())     # the list that is asked for
        asked = asked.flatten()
        qno, times, norms = (pc.struct_field(asked, c).to_numpy() for c in ("qno", "q_n", "q_length"))
        wanted = block.column("wanted").combine_chunks()
        if wanted.null_count == 0:
            some = np.flatnonzero(np.isin(qno, wanted.flatten().to_numpy()))
            of, qno, times, norms = of[some], qno[some], times[some], norms[some]
        order = np.argsort(qno, kind="stable")
        of, qno, times, norms = of[order], qno[order], times[order], norms[order]
        names, first, number = np.unique(qno, return_index=True, return_inverse=True)
        keys, lengths = (block.column(c).combine_chunks().flatten() for c in ("keys", "lengths"))
        lengths = lengths.to_numpy()
        n, places, out = len(lengths), np.arange(len(lengths)), []
        step = max(1, PAIRS // n)
        done = np.append(0, np.cumsum(size[of], dtype=np.int64))
        for a in range(0, len(names), step):
            own = norms[first[a:a + step], None]
            dots = np.zeros(len(own) * n)
            at, end = np.searchsorted(number, [a, a + step])
            while at < end:                                                  # some PAIRS products at a time
                to = min(end, max(at + 1, int(np.searchsorted(done, done[at] + PAIRS, "right")) - 1))
                m = size[of[at:to]]
                place = np.arange(m.sum()) + np.repeat(start[of[at:to]] - (np.cumsum(m) - m), m)
                dots += np.bincount(np.repeat((number[at:to] - a) * n, m) + rows[place],
                                    counts[place] * np.repeat(times[at:to].astype(np.float64), m), len(dots))
                at = to
            dots = dots.reshape(-1, n)
            scores = np.divide(dots, lengths * own, out=np.full(dots.shape, -1.0), where=dots > 0)
            leading, at = _best(np.round(scores, SCORE_DECIMALS), places, best)
            i, j = np.nonzero(leading >= 0)
            at = at[i, j]
            out.append(pa.table([pa.array(names[a + i]), pa.array(np.full(len(i), block.column("block")[0].as_py())), keys.take(pa.array(at)),
                                 pa.array(dots[i, at].astype(np.int64)), pa.array(lengths[at]), pa.array(own[i, 0])], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def _vectors(rows: DataFrame, key: str, text: str, dims: int) -> DataFrame:
    coded = encode(rows.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", "vec", dims).select("key", "vec")
    kind = coded.schema["key"].dataType.simpleString()
    return coded.mapInArrow(_vector, f"key {kind}, buckets array<int>, counts array<int>, length double, block bigint, row int")


def _exploded(vectors: DataFrame) -> DataFrame:
    return vectors.select("key", "length", F.explode(F.arrays_zip("buckets", "counts")).alias("x")).select(
        "key", F.col("x.buckets").alias("bucket"), F.col("x.counts").alias("n"), "length")


class SearchIndex:
    """The index of a corpus at ``path``, in 2^``slot_bits`` slots. ``dims`` is the encoder's width; both are the
    same whenever the index is opened."""

    def __init__(self, spark: SparkSession, path: str, dims: int = DEFAULT_DIMS, slot_bits: int = SLOT_BITS):
        self.spark, self.path, self.dims, self.slots = spark, path.rstrip("/"), dims, 1 << slot_bits

    def _slot(self) -> Column:
        """The slot of a bucket: its high bits."""
        return F.floor(F.col("bucket") / -(-self.dims // self.slots)).cast("int")

    def save(self, corpus: DataFrame, key_col: str, text_col: str) -> SearchIndex:
        """Write the index of ``corpus``, one row for each key; rows without a key are left out."""
        rows = corpus.where(F.col(key_col).isNotNull())
        _vectors(rows, key_col, text_col, self.dims).write.mode("overwrite").parquet(f"{self.path}/vectors")
        rows = F.sort_array(F.collect_list(F.struct("row", "key", "length")))
        blocks = self.vectors().groupBy("block").agg(rows.alias("rows"))
        blocks.select("block", F.col("rows.key").alias("keys"), F.col("rows.length").alias("lengths")).write.mode("overwrite").parquet(
            f"{self.path}/blocks")
        each = self.vectors().select("block", "row", "length", "buckets", "counts").mapInArrow(
            _inverted, "bucket int, block bigint, rows array<int>, counts array<int>, size int, top double").withColumn("slot", self._slot())
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        each.repartitionByRange(parts, "bucket", "block").sortWithinPartitions("slot", "bucket", "block") \
            .write.mode("overwrite").partitionBy("slot").parquet(f"{self.path}/postings")
        lists = self.postings().groupBy("slot", "bucket").agg(F.sum("size").alias("size"), F.max("top").alias("top"))
        lists.repartitionByRange(parts, "bucket").sortWithinPartitions("slot", "bucket") \
            .write.mode("overwrite").partitionBy("slot").parquet(f"{self.path}/lists")
        return self

    def _read(self, name: str, schema: str) -> DataFrame:
        kind = self.spark.read.parquet(f"{self.path}/vectors").schema["key"].dataType.simpleString()
        return self.spark.read.schema(schema.format(key=kind)).parquet(f"{self.path}/{name}")

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def postings(self) -> DataFrame:
        return self._read("postings", "bucket int, block bigint, rows array<int>, counts array<int>, size int, top double, slot int")

    def blocks(self) -> DataFrame:
        return self._read("blocks", "block bigint, keys array<{key}>, lengths array<double>")

    def lists(self) -> DataFrame:
        return self._read("lists", "bucket int, size bigint, top double, slot int")

    def touched(self, table: DataFrame, wanted: DataFrame) -> DataFrame:
        """The rows of ``table`` in the slots of ``wanted`` (bucket): other slots' files are not opened."""
        slots = [r["slot"] for r in wanted.select(self._slot().alias("slot")).distinct().collect()]
        return table.where(F.col("slot").isin(slots))

    def search(self, queries: DataFrame, k: int, query_key: str, text_col: str) -> DataFrame:
        """(query_id, key, score, rank): the k rows of greatest cosine for each query, ties by key."""
        q = materialize(_vectors(queries, query_key, text_col, self.dims).withColumnsRenamed({"key": "query_id", "length": "q_length"})
                        .select("query_id", F.monotonically_increasing_id().alias("qno"), "buckets", "counts", "q_length"), "search-queries")
        named = q.where(F.col("query_id").isNotNull())
        parts = max(1, -(-named.count() // SLICE_LISTS))              # queries that meet a block together are one of so many parts
        words = named.select("qno", "q_length", F.explode(F.arrays_zip("buckets", "counts")).alias("x")).select(
            "qno", F.col("x.buckets").alias("bucket"), F.col("x.counts").alias("q_n"), "q_length",
            F.pmod(F.xxhash64("qno"), F.lit(parts)).cast("int").alias("part"))
        words = words.withColumn("w", F.col("q_n") / F.col("q_length"))
        lists = self.touched(self.lists(), words).drop("slot")
        words = materialize(words.join(lists, "bucket"), "search-words")

        # 1. seeds from the shortest lists, and the bound
        longer = Window.partitionBy("qno").orderBy("size", "bucket")
        first = words.withColumn("so_far", F.sum("size").over(longer)).withColumn("place", F.row_number().over(longer))
        first = first.where((F.col("so_far") <= SEED_POSTINGS) | (F.col("place") == 1))
        best_part = Window.partitionBy("qno").orderBy(F.desc("score"), "key")
        seeds = self._parts(first).select("qno", "key", "score").groupBy("qno", "key").agg(F.max("score").alias("score"))
        seeds = seeds.withColumn("r", F.row_number().over(best_part)).where(F.col("r") <= max(SEEDS, k)).select("qno", "key")
        ranked = Window.partitionBy("qno").orderBy(F.desc("score"), "key")
        kth = self._scored(seeds, named).withColumn("r", F.row_number().over(ranked)).where(F.col("r") == k).select("qno", F.col("score").alias("bound"))

        # 2. the longest lists that cannot reach the bound together
        aside = Window.partitionBy("qno").orderBy(F.desc("size"), "bucket").rowsBetween(Window.unboundedPreceding, 0)
        reach = F.least(F.sum(F.col("w") * F.col("top")).over(aside), F.sqrt(F.sum(F.col("w") * F.col("w")).over(aside)))
        placed = words.join(kth, "qno", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)) - SLACK).withColumn("reach", reach)
        placed = materialize(placed.withColumn("aside", F.col("reach") < F.col("bound")), "search-lists")
        most = placed.groupBy("qno", "part").agg(F.max("bound").alias("bound"), F.coalesce(F.max(F.when(F.col("aside"), F.col("reach"))), F.lit(0.0)).alias("rest"))

        # 3. blocks with candidates of the other lists, and the k best of each
        near = self._parts(placed.where(~F.col("aside"))).join(most, "qno").where(F.col("score") + F.col("rest") >= F.col("bound"))
        near = materialize(near.groupBy("block", "part").agg(F.collect_set("qno").alias("wanted")), "search-blocks")
        found = self._led(words, near.join(self.blocks(), "block"), k).join(named.select("qno", "query_id"), "qno")
        ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
        best = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        best = materialize(best.select("query_id", "key", "score", "rank"), "search-top-k")
        return best.unionByName(self._filled(best, q, k))

    def _parts(self, words: DataFrame) -> DataFrame:
        """(qno, block, key, score): the best rows of each block in the lists of ``words``, by what these add to the score."""
        every = self.blocks().crossJoin(words.select((F.col("part") + 0).alias("part")).distinct()).withColumn("wanted", F.lit(None).cast("array<bigint>"))
        return self._led(words, every, BEST)

    def _led(self, words: DataFrame, blocks: DataFrame, best: int) -> DataFrame:
        """(qno, block, key, score): the ``best`` rows of each of ``blocks`` (block, part, keys, lengths, wanted) for each query."""
        asked = words.groupBy("bucket", "part").agg(F.collect_list(F.struct("qno", "q_n", "q_length")).alias("asked"))
        rows = self.touched(self.postings(), words).select("bucket", "block", "rows", "counts").join(asked, "bucket")
        rows = rows.join(blocks.select("block", "part"), ["block", "part"], "left_semi")
        kind = blocks.schema["keys"].dataType.elementType
        led = rows.groupBy("block", "part").cogroup(blocks.groupBy("block", "part")).applyInArrow(
            _leaders(best), f"qno bigint, block bigint, key {kind.simpleString()}, dot bigint, length double, q_length double")
        return led.select("qno", "block", "key", F.round(F.col("dot") / (F.col("length") * F.col("q_length")), SCORE_DECIMALS).alias("score"))

    def _scored(self, pairs: DataFrame, q: DataFrame) -> DataFrame:
        """(qno, key, score) of ``pairs``, from the whole vectors."""
        both = pairs.join(self.vectors(), "key").join(
            q.select("qno", F.map_from_arrays("buckets", "counts").alias("own"), "q_length"), "qno")
        dot = F.aggregate(F.zip_with("buckets", "counts", lambda b, n: F.coalesce(F.try_element_at("own", b), F.lit(0)).cast("bigint") * n),
                          F.lit(0).cast("bigint"), lambda a, x: a + x)
        return both.select("qno", "key", F.round(dot / (F.col("length") * F.col("q_length")), SCORE_DECIMALS).alias("score"))

    def _filled(self, best: DataFrame, q: DataFrame, k: int) -> DataFrame:
        """Rows of score 0 for queries that fewer than k rows share a bucket with, in the order of the keys."""
        short = q.select("query_id").join(best.groupBy("query_id").agg(F.count("*").alias("had")), "query_id", "left") \
            .select("query_id", F.coalesce("had", F.lit(0)).alias("had")).where(F.col("had") < k)
        # among the 2 k least keys are k that a query has not, whichever it has
        least = self.vectors().select("key").orderBy("key").limit(2 * k).agg(F.collect_list("key")).first()[0]
        kind = best.schema["key"].dataType
        free = short.withColumn("key", F.explode(F.array(*[F.lit(x).cast(kind) for x in least]).cast(f"array<{kind.simpleString()}>")))
        free = free.join(best.select("query_id", "key"), ["query_id", "key"], "left_anti")
        rank = F.col("had") + F.row_number().over(Window.partitionBy("query_id").orderBy("key"))
        return free.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "key", F.lit(0.0).alias("score"), "rank")


def recommend_indexed(index: SearchIndex, corpus: DataFrame, queries: DataFrame, key_col: str = "hash_id", text_col: str = "text",
                      top_k: int = V.TOP_K_DEFAULT, min_score: float = V.MIN_SCORE_DEFAULT, query_key: str = "query_id",
                      min_chars: int = 1, project: list[str] | None = None) -> DataFrame:
    """The request of :func:`similarity.recommend` against a stored index; ``corpus`` gives the result columns (F-10)."""
    check_request(top_k, min_score)
    hits = index.search(gate_queries(queries, text_col, min_chars), top_k, query_key, text_col)
    hits = materialize(hits.where(F.col("score") >= min_score).withColumnRenamed("key", key_col), "indexed-hits")
    cols = [c for c in (project if project is not None else V.RESULT_COLUMNS) if c not in ("score", key_col)]
    return corpus.select(key_col, *cols).join(hits, key_col).select("query_id", "rank", key_col, *cols, "score")
