import hashlib
from collections import Counter, defaultdict

import talentlake.llm.alignment as al
from talentlake.llm.alignment import TOKENIZER_A, TOKENIZER_B, aligned, link_counts, op11_token_alignment, tokenizer, with_link_counts

from ..conftest import SF_SMALL

SCHEMA = "doc_id bigint, text string, row string, pairs string, id string, n_docs int"


def spans(ids, names):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(names[i])))
        at += len(names[i])
    return out


def brute(texts):
    """Group boundaries by scanning offsets, links by comparing groups of byte offsets, counts by whole documents."""
    a, b = tokenizer(TOKENIZER_A), tokenizer(TOKENIZER_B)
    seen, docs = [], Counter()
    for t in texts:
        body = b" " + (t or "").encode()
        ids = [x.encode([t or ""])[0] for x in (a, b)]
        if not t or any(b"".join(x.bytes[i] for i in y) != body for x, y in zip((a, b), ids)):
            seen.append(None)
            continue
        both = [spans(y, x.bytes) for x, y in zip((a, b), ids)]
        ends = sorted({e for _, e in both[0]} & {e for _, e in both[1]})
        groups, start = [], 0
        for end in ends:
            groups.append([[i for i, (s, e) in zip(y, z) if s >= start and e <= end] for y, z in zip(ids, both)])
            start = end
        pairs = Counter()
        for x, y in groups:
            for i, n in Counter(x).items():
                for j, m in Counter(y).items():
                    pairs[i, j] += n * m
        docs.update(pairs.keys())
        seen.append((ids, groups, pairs))
    best = defaultdict(int)
    for (i, _), n in docs.items():
        best[i] = max(best[i], n)
    out = []
    for x in seen:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ids, groups, pairs = x
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((len(ids[0]), len(ids[1]), len(groups), sum(pairs.values()), sum(n for (i, j), n in pairs.items() if docs[i, j] == best[i]),
                    sum(n * docs[p] for p, n in pairs.items()), hashlib.sha256(shown.encode()).hexdigest()))
    return out


def columns(r):
    return tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))


TEXTS = [None, "", " ", "\n", "a", "the cat sat", "the cat sat", "The <|endoftext|> of <s> and <unk> <0x41>", "lower▁one eighth", "▁", "  two  spaces ",
         "naïve café — élan 😀👩‍👩‍👧 日本語 ﷺ ́", "x" * 900, "=" * 1401 + "a" + "-" * 700, "\x00\x01 tabs\tand\r\nlines", "1234567890 3.14159 +33 1",
         "ﬁ ① ㎏ ​﻿", "word " * 900]


def test_alignment_by_brute_force(spark):
    docs = spark.createDataFrame([(i if i % 5 else None, t, "x", "y", "z", 1) for i, t in enumerate(TEXTS)], SCHEMA)
    table = aligned(docs)
    assert table.count() == len(TEXTS)
    got = with_link_counts(table, link_counts(table)).collect()
    assert sorted(map(columns, got)) == sorted(brute(TEXTS))


def test_pairs_beyond_the_dictionary_are_joined(spark, monkeypatch):
    monkeypatch.setattr(al, "DICTIONARY", 5)
    docs = spark.createDataFrame([(i, t, "x", "y", "z", 1) for i, t in enumerate(TEXTS * 2)], SCHEMA)
    table = aligned(docs)
    got = with_link_counts(table, link_counts(table)).collect()
    want = brute(TEXTS * 2)
    assert {r.id: columns(r) for r in got} == dict(enumerate(want))
    monkeypatch.setattr(al, "DICTIONARY", 0)
    assert sorted(map(columns, with_link_counts(table, link_counts(table)).collect())) == sorted(want)


def test_a_long_run_is_counted_without_listing_its_links():
    a, b = [1] * 40_000 + [2], [7] * 30_000 + [8]
    pairs, times = al.links(a, b, [len(a)], [len(b)], 100)
    assert dict(zip(pairs.tolist(), times.tolist())) == {107: 40_000 * 30_000, 108: 40_000, 207: 30_000, 208: 1}


def test_empty_table_and_registered_query(spark):
    docs = spark.createDataFrame([], SCHEMA)
    table = aligned(docs)
    assert with_link_counts(table, link_counts(table)).count() == 0
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = op11_token_alignment(spark, SF_SMALL)
    assert dict(got.dtypes)["count_sum"] == "bigint" and dict(got.dtypes)["n_best"] == "bigint"
    assert {r.doc_id: columns(r) for r in got.collect()} == dict(zip([r.doc_id for r in rows], brute([r.text for r in rows])))


def test_ids_are_those_of_the_vocabulary_files_own_library(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(TOKENIZER_A)
    model.encode_special_tokens = True
    texts = [t or "" for t in TEXTS] + [r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect()]
    texts += ["".join(map(chr, range(a, a + 256))) for a in (*range(0, 0xD800, 256), *range(0xE000, 0x20000, 256))]
    texts += [f"a{chr(c)}b {chr(c)}1 {chr(c)} " for c in range(0x3000)]
    want = model.encode_batch([" " + t for t in texts], add_special_tokens=False)
    assert [e.ids for e in want] == tokenizer(TOKENIZER_A).encode(texts)
