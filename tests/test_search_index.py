import math
import random
import re
from collections import Counter

import pytest

import talentlake.operators.search_index as si
from talentlake.operators.search_index import SearchIndex, recommend_indexed

SCHEMA = "id bigint, text string, titre string, entreprise string, lieu string, contrat string, remote string, tags string, lien string"


def brute(corpus, queries, k):
    """Every query against every row by plain token counts; ties by key."""
    bag = lambda t: Counter(re.findall(r"\w+", (t or "").lower()))
    length = lambda b: math.sqrt(sum(n * n for n in b.values()))
    rows = [(i, bag(t)) for i, t in corpus if i is not None]
    out = []
    for q, text in queries:
        own = bag(text)
        scores = []
        for i, b in rows:
            dot = sum(n * b[w] for w, n in own.items())
            scores.append((-round(dot / (length(b) * length(own)), 12) if dot else 0.0, i))
        out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def made(n, seed):
    rng = random.Random(seed)
    words = ["the", "of", "and"] * 30 + ["data", "sql", "spark"] * 5 + [f"w{i}" for i in range(300)]
    return [" ".join(rng.choices(words, k=rng.randrange(0, 40))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "t", "e", "l", "c", "r", "g", "x") for i, t in rows], SCHEMA)


def found(df):
    return sorted((r.query_id, r.key, r.score, r.rank) for r in df.collect())


@pytest.mark.parametrize("seed_postings", [1 << 14, 5])
def test_search_equals_scoring_every_row(spark, tmpdir_path, monkeypatch, seed_postings):
    monkeypatch.setattr(si, "SEED_POSTINGS", seed_postings)
    texts = made(400, 1)
    corpus = list(enumerate(texts + texts[:50] + [None, "", "the", "the the", "zebra"])) + [(None, "the data")]
    queries = list(enumerate(made(25, 2) + ["", None, "unseen words only", "zebra", "the", "the of and"], 1000))
    SearchIndex(spark, tmpdir_path).save(frame(spark, corpus).repartition(4), "id", "text")
    q = spark.createDataFrame(queries, "query_id bigint, text string")
    assert found(SearchIndex(spark, tmpdir_path).search(q, 7, "query_id", "text")) == brute(corpus, queries, 7)


def test_common_lists_are_set_aside(spark, tmpdir_path):
    """A request whose rare words decide does not read the rows of its common words."""
    corpus = [(i, "the of and") for i in range(300)] + [(1000, "the rare unique gem stone"), (1001, "rare unique gem stone here")]
    index = SearchIndex(spark, tmpdir_path).save(frame(spark, corpus), "id", "text")
    asked = []
    parts = index._parts
    index._parts = lambda words: asked.append(words) or parts(words)
    q = spark.createDataFrame([(1, "the rare unique gem stone")], "query_id bigint, text string")
    assert [r[1] for r in found(index.search(q, 1, "query_id", "text"))] == [1000]
    read = asked[1].collect()
    assert read and max(r["size"] for r in read) <= 2


def test_only_seeds_are_looked_up_and_blocks_give_their_best(spark, tmpdir_path, monkeypatch):
    """Rows that tie by thousands are ranked where their block is: neither scored pair by pair nor shuffled."""
    monkeypatch.setattr(si, "BLOCK_ROWS", 700)
    corpus = [(i, "the of and data") for i in range(3000)] + [(5000, "the of data"), (5001, "and so on")]
    index = SearchIndex(spark, tmpdir_path).save(frame(spark, corpus).coalesce(1), "id", "text")
    pairs, scored = [], index._scored
    index._scored = lambda p, q: pairs.append(p.count()) or scored(p, q)
    queries = [(1, "the of and data here"), (2, "data and more")]
    q = spark.createDataFrame(queries, "query_id bigint, text string")
    assert found(index.search(q, 7, "query_id", "text")) == brute(corpus, queries, 7)
    assert sum(pairs) <= len(queries) * si.SEEDS


def test_repeated_keys_and_queries_without_one(spark, tmpdir_path):
    corpus = frame(spark, [(1, "data engineer"), (1, "data engineer"), (2, "data cook")])
    index = SearchIndex(spark, tmpdir_path).save(corpus, "id", "text")
    q = spark.createDataFrame([("a", "data engineer"), ("a", "data engineer"), (None, "data")], "query_id string, text string")
    got = index.search(q, 5, "query_id", "text").collect()
    assert sorted((r.key, r.rank) for r in got if r.query_id) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 5)]
    assert {r.score for r in got if r.query_id is None} == {0.0}


def test_a_request_opens_only_its_slots(spark, tmpdir_path):
    index = SearchIndex(spark, tmpdir_path).save(frame(spark, list(enumerate(made(200, 3)))), "id", "text")
    bucket = si._exploded(si._vectors(spark.createDataFrame([(1, "spark")], "k int, t string"), "k", "t", index.dims)).select("bucket")
    every, own = set(index.postings().inputFiles()), set(index.touched(index.postings(), bucket).inputFiles())
    plan = index.touched(index.postings(), bucket)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan
    assert own <= every and len({re.search(r"slot=(\d+)", f).group(1) for f in every}) == 16
    assert {r.slot for r in index.touched(index.postings(), bucket).select("slot").distinct().collect()} == {
        r.s for r in bucket.select(index._slot().alias("s")).collect()}


def test_result_columns_and_bounds(spark, tmpdir_path):
    corpus = frame(spark, [(1, "data engineer python"), (2, "cook"), (3, "data analyst")])
    index = SearchIndex(spark, tmpdir_path).save(corpus, "id", "text")
    q = spark.createDataFrame([("a", "data python"), ("b", "  ")], "query_id string, text string")
    hits = recommend_indexed(index, corpus, q, "id", min_score=0.2)
    assert hits.columns == ["query_id", "rank", "id", "titre", "entreprise", "lieu", "contrat", "remote", "tags", "lien", "score"]
    assert [(r.query_id, r.id) for r in hits.orderBy("rank").collect()] == [("a", 1), ("a", 3)]
    with pytest.raises(ValueError):
        recommend_indexed(index, corpus, q, "id", top_k=0)
    empty = SearchIndex(spark, tmpdir_path + "/none").save(corpus.limit(0), "id", "text")
    assert empty.search(q, 3, "query_id", "text").count() == 0
