"""Cross-tokenizer alignment: which tokens of one tokenizer cover the same bytes as which of another.

A text is encoded by both. For each side a dictionary leads from every
cumulative byte end to the index behind it; the intersection of the two key sets
are the offsets where tokens of both end, and the sorted common keys slice both
id lists into groups. Within a group every A token is linked with every B token.

A pair of ids counts in how many documents it is linked. Tasks keep each text's
distinct pairs with their number of links in a written table, from which the
counts are one partial aggregation. To read the counts back, the pairs of the
most documents (DICTIONARY at most, whatever the corpus) go to every task as two
sorted arrays; the occurrences of all others are joined by pair, and none of
those is a hot key, as more than DICTIONARY / 2 pairs would have to be about as
frequent. Nothing is dropped on either way.

Defined results: null and empty texts, and texts that a tokenizer does not give
back byte for byte, have no tokens: zeros, and an empty digest; a group of many
tokens (a long run of one sign) is linked by distinct ids and their numbers, so
its links are counted without being listed; rows with equal or null ids are each
returned and each a document of its own; an empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read, text_of

TOKENIZERS = "/opt/tokenizers"
TOKENIZER_A = f"{TOKENIZERS}/byte_bpe_50k.json"
TOKENIZER_B = f"{TOKENIZERS}/piece_bpe_32k.model"
DICTIONARY = 1 << 19           # pairs that every task knows: 16 bytes each
CHARS = 1 << 19                # characters encoded together, or one longer text
WIDE_GROUP = 256               # links above which a group is counted by distinct ids

COLUMNS = ("n_a", "n_b", "n_groups", "n_links")


# Fixed value: how byte-level BPE of this kind splits a text before merging.
SPLITTER = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """A byte-level BPE vocabulary file whose ids follow its merges, so that they are the merges' ranks; a space is
    put before the text. Special tokens are no part of it: their strings in a text are ordinary text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, splitter = file["model"], file["pre_tokenizer"]
        ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if file["normalizer"] or splitter["type"] != "ByteLevel" or splitter["add_prefix_space"] or ids != sorted(ids):
            raise ValueError(f"{path} is no byte-level BPE with ids in the order of its merges")
        # the byte-level alphabet: printable Latin-1 stands for itself, the other bytes for 256, 257, ...
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        special = {x["id"] for x in file["added_tokens"]}
        ranks = {bytes(map(byte.__getitem__, name)): i for name, i in model["vocab"].items() if i not in special}
        self.bytes = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        self.model = tiktoken.Encoding("byte-level", pat_str=SPLITTER, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.model.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """A SentencePiece model, which puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        piece = self.model.id_to_piece
        self.bytes = [bytes([int(piece(i)[1:-1], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode()
                      for i in range(self.model.get_piece_size())]
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> ByteLevel | Pieces:
    """The tokenizer of a vocabulary file, loaded once per Python worker."""
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


def groups(ids_a: np.ndarray, ids_b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices behind each group's last token, in ``ids_a`` and in ``ids_b``."""
    ends_a = dict(zip(np.cumsum(sizes_a[ids_a]).tolist(), range(1, len(ids_a) + 1)))
    ends_b = dict(zip(np.cumsum(sizes_b[ids_b]).tolist(), range(1, len(ids_b) + 1)))
    # a dictionary's keys stand in ascending order, so this is their sorted intersection
    common = list(filter(ends_b.__contains__, ends_a))
    return tuple(np.fromiter(map(ends.__getitem__, common), np.int64, len(common)) for ends in (ends_a, ends_b))


def links(a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct linked pairs (a * width + b) of groups up to ``to_a`` and ``to_b``, ascending, and the number of links of each."""
    a, b, to_a, to_b = (np.asarray(x, np.int64) for x in (a, b, to_a, to_b))
    from_a, from_b = np.append(0, to_a[:-1]), np.append(0, to_b[:-1])
    n_a, n_b = to_a - from_a, to_b - from_b
    per = n_a * n_b
    codes, times = [], []
    wide = per > WIDE_GROUP
    for g in np.flatnonzero(wide):
        (x, nx), (y, ny) = (np.unique(i[s:e], return_counts=True) for i, s, e in ((a, from_a[g], to_a[g]), (b, from_b[g], to_b[g])))
        codes.append((x[:, None] * width + y).ravel())
        times.append((nx[:, None] * ny).ravel())
    single = per == 1
    codes.append(a[from_a[single]] * width + b[from_b[single]])
    several = ~(wide | single)
    per, n_b, from_a, from_b = per[several], n_b[several], from_a[several], from_b[several]
    size = np.repeat(n_b, per)
    place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    codes.append(a[np.repeat(from_a, per) + place // size] * width + b[np.repeat(from_b, per) + place % size])
    if not wide.any():
        return np.unique(np.concatenate(codes), return_counts=True)
    times += [np.ones(len(x), np.int64) for x in codes[-2:]]
    pairs, at = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, at, np.concatenate(times))
    return pairs, total


def _signs(size_a: int, size_b: int) -> list[str]:
    """The ids of A followed by a comma, of A by a bar, of B by a comma, of B by a semicolon."""
    return [f"{i}{sign}" for size, sign in ((size_a, ","), (size_a, "|"), (size_b, ","), (size_b, ";")) for i in range(size)]


def spelled(a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, signs: list[str], size_a: int, size_b: int) -> str:
    """The groups up to ``to_a`` and ``to_b`` as ``a1,a2|b1;a3|b2,b3``, from ``signs`` of :func:`_signs`.

    Each id stands behind those before it on its side and those of all groups before (for B, with its own) on the other."""
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[to_a - 1], last_b[to_b - 1] = size_a, size_b
    from_b = np.append(0, to_b[:-1])
    sign = np.empty(len(a) + len(b), np.int64)
    sign[np.arange(len(a)) + np.repeat(from_b, np.diff(to_a, prepend=0))] = a + last_a
    sign[np.arange(len(b)) + np.repeat(to_a, to_b - from_b)] = b + last_b + 2 * size_a
    return "".join(map(signs.__getitem__, sign.tolist()))[:-1]


def _parts(texts: list[str]) -> Iterator[list[str]]:
    """``texts`` in runs of about CHARS characters."""
    part, n = [], 0
    for t in texts:
        if part and n + len(t) > CHARS:
            yield part
            part, n = [], 0
        part.append(t)
        n += len(t)
    if part:
        yield part


def _align(path_a: str, path_b: str):
    none = (np.empty(0, np.int64), np.empty(0, np.int64))

    def one(text: str, ids_a: list[int], ids_b: list[int], a: ByteLevel | Pieces, b: ByteLevel | Pieces, signs: list[str]):
        body = b" " + text.encode()
        if not text or any(b"".join(map(t.bytes.__getitem__, ids)) != body for t, ids in ((a, ids_a), (b, ids_b))):
            return (0, 0, 0, 0, ""), none
        both = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        cuts = groups(*both, a.sizes, b.sizes)
        pairs, times = links(*both, *cuts, len(b.bytes))
        shown = spelled(*both, *cuts, signs, len(a.bytes), len(b.bytes))
        digest = hashlib.sha256(shown.encode()).hexdigest()
        return (len(ids_a), len(ids_b), len(cuts[0]), int(times.sum()), digest), (pairs, times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizer(path_a), tokenizer(path_b)
        signs = _signs(len(a.bytes), len(b.bytes))
        for batch in batches:
            done = 0
            for part in _parts(batch.column("body").to_pylist()):
                rows = [one(*x, a, b, signs) for x in zip(part, a.encode(part), b.encode(part))]
                ends = pa.array(np.cumsum([0, *(len(p) for _, (p, _) in rows)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[i] for _, x in rows]))) for i in (0, 1)]
                stats = list(zip(*(s for s, _ in rows)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(done, len(part)), *(pa.array(s, pa.int64()) for s in stats[:4]),
                     pa.array(stats[4], pa.string()), *lists], names=["id", *COLUMNS, "groups_sha256", "pairs", "times"])
                done += len(part)

    return run


def aligned(docs: DataFrame, path_a: str = TOKENIZER_A, path_b: str = TOKENIZER_B, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """A written table with one row per document: row, id, n_a, n_b, n_groups, n_links, groups_sha256, and
    its distinct linked ``pairs`` (a * B's vocabulary size + b) with the number of links in ``times``."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_align(path_a, path_b), f"id {kind}, {', '.join(f'{c} bigint' for c in COLUMNS)}, "
                          "groups_sha256 string, pairs array<bigint>, times array<bigint>")
    return materialize(out.withColumn("row", F.monotonically_increasing_id()), "aligned")


def link_counts(table: DataFrame, path_b: str = TOKENIZER_B) -> DataFrame:
    """A written table of the id pairs of :func:`aligned`: pair, a, b, n_docs, and whether no other pair of
    its A id is linked in more documents."""
    width = len(tokenizer(path_b).bytes)
    counts = table.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    counts = counts.withColumns({"a": F.floor(F.col("pair") / width), "b": F.col("pair") % width})
    best = F.max("n_docs").over(Window.partitionBy("a"))           # at most a row for each B id
    return materialize(counts.withColumn("best", F.col("n_docs") == best), "link-counts")


def _known(counts: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The number of documents from which a pair is in the dictionary, and its pairs, counts and best flags."""
    power = F.floor(F.log2("n_docs")).cast("int")
    cut, total = 0, 0
    for r in counts.groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect():     # 63 rows at most
        total += r["count"]
        if total > DICTIONARY:
            cut = 1 << (r["power"] + 1)
            break
    known = counts.filter(F.col("n_docs") >= cut).select("pair", "n_docs", "best").toArrow()      # DICTIONARY rows at most
    pairs, n, best = (known.column(c).to_numpy() for c in known.column_names)
    order = np.argsort(pairs)
    return cut, pairs[order].astype(np.int64), n[order].astype(np.int64), best[order].astype(bool)


def _look_up(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n_docs, best = known.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            own, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
            hit = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
            sums = [np.diff(np.append(0, np.cumsum(np.where(hit, x, 0)))[ends]) for x in
                    ((n_docs[at] * times, best[at] * times) if len(pairs) else (times, times))]
            left = pa.array(np.append(0, np.cumsum(~hit))[ends], pa.int32())
            rest = [pa.ListArray.from_arrays(left, pa.array(x[~hit])) for x in (own, times)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(s.astype(np.int64)) for s in sums), *rest],
                                             names=["row", "count_sum", "n_best", "pairs", "times"])

    return run


def with_link_counts(table: DataFrame, counts: DataFrame) -> DataFrame:
    """:func:`aligned`'s rows without the pairs, with ``count_sum`` (the counts of all links) and ``n_best``
    (the links whose pair is a best one)."""
    cut, *arrays = _known(counts)
    known = table.sparkSession.sparkContext.broadcast(tuple(arrays))
    looked = materialize(table.select("row", "pairs", "times").mapInArrow(
        _look_up(known), "row bigint, count_sum bigint, n_best bigint, pairs array<bigint>, times array<bigint>"), "looked-up")
    rare = looked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.*").withColumnRenamed("pairs", "pair")
    rare = rare.join(counts.filter(F.col("n_docs") < cut).select("pair", "n_docs", "best"), "pair").select(
        "row", (F.col("times") * F.col("n_docs")).alias("count_sum"), F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"))
    sums = looked.select("row", "count_sum", "n_best").unionByName(rare).groupBy("row").agg(
        F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    return table.drop("pairs", "times").join(sums, "row").drop("row")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = aligned(read(spark, sf_dir, "documents"))
    return with_link_counts(table, link_counts(table)).select(
        F.col("id").alias("doc_id"), *COLUMNS, "n_best", "count_sum", "groups_sha256")
