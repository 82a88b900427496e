import hashlib

from talentlake.llm.exact_dedup import DigestIndex, dedup_decisions, drop_exact_copies, new_index

SCHEMA = "doc_id bigint, text string, digest string, n int, kept string"
ROWS = [(1, "a", "x", 1, "y"), (2, "a", None, None, None), (3, "b", "x", 1, "y"), (4, None, "x", 1, "y"), (5, "", "x", 2, "y"),
        (None, "b", "x", 1, "y"), (None, "c", "x", 1, "y"), (7, "A", "x", 1, "y"), (8, "a ", "x", 1, "y"), (9, "z" * 200_000, "", 0, ""),
        (10, "z" * 200_000, "", 0, ""), (2, "a", None, None, None)]


def brute(rows):
    out = []
    for i, t, *_ in rows:
        same = [j for j, u, *_ in rows if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        out.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_decisions(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = dedup_decisions(docs, new_index(docs)).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in got], key=repr) == brute(ROWS)


def test_kept_rows_have_all_their_columns(spark):
    got = [tuple(r) for r in drop_exact_copies(spark.createDataFrame(ROWS, SCHEMA)).collect()]
    want = {r for r, d in zip(ROWS, [next(b for b in brute(ROWS) if b[0] == r[0] and b[4] == hashlib.sha256((r[1] or "").encode()).hexdigest())
                                     for r in ROWS]) if d[3]}
    assert sorted(got, key=repr) == sorted(want, key=repr)      # (2, "a") is there twice and stays once


def test_index_drops_what_an_earlier_batch_brought(spark, tmpdir_path):
    index = DigestIndex(spark, f"file:{tmpdir_path}/index", 4)
    a = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    b = spark.createDataFrame([(3, "a"), (4, "c"), (5, "c")], "doc_id bigint, text string")
    assert {(r.doc_id, r.kept) for r in dedup_decisions(a, index).collect()} == {(1, True), (2, True)}
    assert {(r.doc_id, r.keep_id, r.kept) for r in dedup_decisions(b, index).collect()} == {(3, 1, False), (4, 5, False), (5, 5, True)}
    assert index.read().count() == 3
    dedup_decisions(b, index)                                    # a rerun appends nothing
    assert index.read().count() == 3
    again = DigestIndex(spark, f"file:{tmpdir_path}/index", 4)
    assert again.read().count() == 3


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert dedup_decisions(docs, new_index(docs)).count() == 0 and drop_exact_copies(docs).columns == docs.columns
