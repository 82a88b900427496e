"""End to end: landed CSVs -> merge -> transform -> keyed table; streaming ingest idempotence; corpus store."""

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talentlake.functions.coerce import to_date_or

from talentlake.operators import similarity as M
from talentlake.plans import catalog
from talentlake.plans.pipeline import run_connectors, run_daily
from talentlake.plans.stages import merge_stage
from talentlake.sources import testdata as TD
from talentlake.sources.landing import load_sources, read_csv, write_csv
from talentlake.streaming.ingest import ingest_available

from .conftest import SF_SMALL


def test_run_daily_end_to_end(spark, tmpdir_path):
    postings = TD.postings(spark, SF_SMALL).drop("hash_id")   # the merge backfills missing hashes
    paths = {}
    for src in ["france_travail", "themuse", "serpapi", "kaggle_linkedin"]:
        p = os.path.join(tmpdir_path, "landing", src)
        write_csv(postings.where(F.col("source") == src).orderBy("ingest_seq").coalesce(1), p)
        paths[src] = p
    paths["remotive"] = os.path.join(tmpdir_path, "landing", "absent")
    table = os.path.join(tmpdir_path, "table")
    out = run_daily(spark, paths, os.path.join(tmpdir_path, "run1"), table, run_date="2000-01-01")
    rep = out["report"]
    assert rep[("raw", "remotive")] == 0 and rep[("raw", "themuse")] > 0
    assert rep[("raw_total", None)] == sum(v for (st, _), v in rep.items() if st == "raw")
    assert out["sink"]["inserted"] == out["sink"]["total"] > 0
    again = run_daily(spark, paths, os.path.join(tmpdir_path, "run2"), table, run_date="2000-01-01")
    assert again["sink"]["inserted"] == 0 and again["sink"]["total"] == out["sink"]["total"]
    t = spark.read.parquet(table)
    assert {"hash_id", "titre_normalise", "competences", "pays"} <= set(t.columns)
    assert t.where(F.col("salaire_annuel_estime").isNull()).count() == 0


def test_stream_ingest_replay_adds_nothing(spark, tmpdir_path):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    landing = os.path.join(tmpdir_path, "landing")
    events.where("event_id % 2 = 0").write.parquet(os.path.join(landing, "a"))
    events.write.parquet(os.path.join(landing, "b"))         # overlaps the first drop entirely
    table = os.path.join(tmpdir_path, "events_table")
    ckpt = os.path.join(tmpdir_path, "ckpt")
    out = ingest_available(spark, landing + "/*", table, events.schema, key=["event_id"], order_by=["event_id"],
                           checkpoint=ckpt, max_files_per_trigger=1)
    assert out.count() == events.count()
    again = ingest_available(spark, landing + "/*", table, events.schema, key=["event_id"],
                             order_by=["event_id"], checkpoint=ckpt)
    assert again.count() == events.count()


def test_corpus_round_trip_and_recommend_bounds(spark, tmpdir_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    enc = M.encode(docs, "text", dims=64)
    path = os.path.join(tmpdir_path, "corpus")
    M.save_corpus(enc, path, key_col="doc_id")
    back = M.load_corpus(spark, path)
    assert back.count() == docs.count() and dict(back.dtypes)["embedding"] == "array<float>"
    import pytest
    with pytest.raises(ValueError):
        M.check_request(0, 0.5)
    with pytest.raises(ValueError):
        M.check_request(10, 1.5)


def test_cosine_golden_and_min_score(spark):
    emb = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = emb.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    top = M.top_k_similar(emb, q, 10, "vec_id").orderBy("rank").collect()
    assert (top[0].vec_id, round(top[0].score, 6)) == (0, 1.0)
    assert (top[1].vec_id, round(top[1].score, 6)) == (365, 0.369994)
    fourth = top[3].score
    kept = [r for r in top if r.score >= fourth + 1e-12]
    assert len(kept) == 3


def test_every_query_has_whole_table_sql(spark):
    # singular vectors cannot be expressed in SQL; test_encoder.py compares them with a dense SVD
    assert set(catalog.QUERIES) == set(catalog.SQL) | {"learned_recommend"}


def test_partition_emits_at_most_k_rows_per_query_whatever_ties(spark):
    class Slice:
        value = (pa.array([7, 8]), np.array([[0.0, 0.0], [1.0, 0.0]]))

    keys = np.arange(5000) * 7919 % 5000
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:a + 700]), pa.array([[1, 1]] * len(keys[a:a + 700]), pa.list_(pa.int32()))],
                                          names=["key", "vec"]) for a in range(0, 5000, 700)]
    out = [r for b in M._local_topk_fn(Slice, 5, 2)(iter(batches)) for r in b.to_pylist()]
    assert sorted((r["query_id"], r["key"]) for r in out) == [(q, k) for q in (7, 8) for k in range(5)]
    assert list(M._local_topk_fn(Slice, 5, 2)(iter([]))) == []


def test_queries_without_tokens_rank_by_key(spark):
    docs = spark.createDataFrame([(i, f"word{i} text") for i in range(300)] + [(None, "text"), (301, None)], "doc_id int, text string")
    asked = spark.createDataFrame([("a", "!!! ???"), ("b", "text"), ("c", "  "), ("d", "word7")], "query_id string, text string")
    got = {}
    for r in M.recommend(asked, docs, key_col="doc_id", top_k=3, project=["doc_id"]).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, round(r.score, 6)))
    assert sorted(got["a"]) == [(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0)] and "c" not in got
    assert [k for _, k, _ in sorted(got["b"])] == [0, 1, 2] and sorted(got["d"])[0][1] == 7


def test_slices_give_the_same_answer(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    q = emb.where("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    rows = lambda n: sorted(map(tuple, M.top_k_similar(emb, q, 4, "vec_id", slice_rows=n).select("query_id", "vec_id", "rank").collect()))
    assert rows(1000) == rows(3)


def test_landed_json_lines_and_single_documents(spark, tmpdir_path):
    one = lambda i: json.dumps({"jobs": [{"title": f"Data Engineer {i}", "company_name": f"c{i}", "url": f"u{i}"}]})
    lines, docs = os.path.join(tmpdir_path, "lines"), os.path.join(tmpdir_path, "docs")
    os.makedirs(lines), os.makedirs(docs)
    open(os.path.join(lines, "all.json"), "w").write("\n".join(one(i) for i in range(5)))
    for i in range(3):
        open(os.path.join(docs, f"{i}.json"), "w").write(json.dumps(json.loads(one(i)), indent=2))
    count = lambda out: read_csv(spark, out["remotive"]).count()
    assert count(run_connectors(spark, {"remotive": lines}, f"{tmpdir_path}/a", "2026-04-26", json_lines={"remotive"})) == 5
    assert count(run_connectors(spark, {"remotive": docs}, f"{tmpdir_path}/b", "2026-04-26")) == 3
    with pytest.raises(ValueError, match="several documents"):
        run_connectors(spark, {"remotive": lines}, f"{tmpdir_path}/c", "2026-04-26")


def test_connector_files_keep_landing_order(spark, tmpdir_path):
    """40 link-less results of one title: the merge keeps the one that was crawled first."""
    path = os.path.join(tmpdir_path, "serp")
    os.makedirs(path)
    for page in range(4):
        jobs = [{"title": "Data Engineer", "company_name": f"C{page * 10 + i:03d}", "location": "Paris"} for i in range(10)]
        open(os.path.join(path, f"p{page}.json"), "w").write(json.dumps({"jobs_results": jobs}))
    csvs = run_connectors(spark, {"serpapi": path}, f"{tmpdir_path}/out", "2026-04-26")
    assert [r.entreprise for r in merge_stage(load_sources(spark, csvs, "2000-01-01")).collect()] == ["C000"]


def test_missing_cells_are_null_before_hash_and_dedup(spark, tmpdir_path):
    head = "titre,entreprise,lien,salaire_min,salaire_max\n"
    ft, arb = os.path.join(tmpdir_path, "ft.csv"), os.path.join(tmpdir_path, "arb.csv")
    open(ft, "w").write(head + "Data Engineer,Acme,N/A,nan,40000\n")
    open(arb, "w").write(head + "Data Engineer,Beta,,1,2\nData Analyst,NULL,N/A,NaN,NaN\nBig Data,None,null,,\n")
    got = {r.titre: r for r in merge_stage(load_sources(spark, {"france_travail": ft, "arbeitnow": arb}, "2000-01-01")).collect()}
    assert set(got) == {"Data Engineer", "Data Analyst", "Big Data"} and got["Data Engineer"].entreprise == "Acme"
    assert got["Data Engineer"].salaire_min is None and got["Data Engineer"].salaire_annuel_estime == 40000.0
    assert got["Data Analyst"].entreprise == got["Big Data"].entreprise == "Non spécifiée"
    assert got["Data Analyst"].salaire_annuel_estime is None
    assert got["Data Analyst"].hash_id == hashlib.sha1(b"Data Analyst|nan|nan").hexdigest()[:16]


def test_failing_jobs_fail_the_run_and_bad_files_are_skipped(spark, tmpdir_path, monkeypatch):
    good, bad = os.path.join(tmpdir_path, "good.csv"), os.path.join(tmpdir_path, "bad.csv.gz")
    open(good, "w").write("titre,lien\nData Engineer,x\n")
    open(bad, "wb").write(b"\x1f\x8b\x08broken")
    assert load_sources(spark, {"themuse": good, "remotive": bad, "serpapi": "/none"}, "2000-01-01").count() == 1

    def lost(self):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(type(spark.range(1)), "isEmpty", lost)
    with pytest.raises(RuntimeError):
        load_sources(spark, {"themuse": good}, "2000-01-01")


def test_a_broken_file_loses_only_itself(spark, tmpdir_path, monkeypatch):
    import gzip

    from talentlake.plans.pipeline import run_report
    from talentlake.sources import landing

    folder = os.path.join(tmpdir_path, "re motive")
    os.makedirs(folder)
    for i in range(7):
        with gzip.open(os.path.join(folder, f"part-{i}.csv.gz"), "wt") as f:
            f.write("titre,lien\n" + "".join(f"Data Engineer {i},{i}-{j}\n" for j in range(3000)))
    broken = [os.path.join(folder, f"part-{i}.csv.gz") for i in (0, 4)]
    for path in broken:                                  # the first one at its start, the other in the middle
        data = open(path, "rb").read()
        open(path, "wb").write(b"\x1f\x8b\x08broken" if path == broken[0] else data[:len(data) // 2])
    skipped = []
    df = load_sources(spark, {"remotive": folder, "serpapi": "/none"}, "2000-01-01", skipped)
    assert df.groupBy("titre").count().orderBy("titre").collect() == [(f"Data Engineer {i}", 3000) for i in (1, 2, 3, 5, 6)]
    assert [(s, f.removeprefix("file:").replace("//", "")) for s, f, _ in skipped] == [("remotive", f) for f in broken] + [("serpapi", "/none")]
    assert all(error for _, _, error in skipped)
    report = {(r.stage, r.source): r.n for r in run_report(df, df, df, skipped).collect()}
    assert report["skipped", "remotive"] == 2 and report["raw", "remotive"] == 15000

    def lost(df, name):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(landing, "materialize", lost)
    with pytest.raises(RuntimeError):
        load_sources(spark, {"remotive": folder}, "2000-01-01")


def test_loaded_table_follows_its_input(spark, tmpdir_path):
    sf = os.path.join(tmpdir_path, "sf")
    spark.read.parquet(f"{SF_SMALL}/customer.parquet").write.parquet(f"{sf}/customer.parquet")
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    orders.where("o_orderkey % 2 = 0").write.parquet(f"{sf}/orders.parquet")
    before = catalog.QUERIES["total_count"](spark, sf).first()[0]
    assert catalog.QUERIES["total_count"](spark, sf).first()[0] == before
    orders.write.mode("overwrite").parquet(f"{sf}/orders.parquet")
    assert catalog.QUERIES["total_count"](spark, sf).first()[0] > before


def test_dates_and_timestamps(spark):
    texts = {"2026-04-02": "2026-04-02", "2026-04-02T10:11:12": "2026-04-02", "2026-04-02 23:59:59.5": "2026-04-02", "soon": "2026-04-26",
             "": "2026-04-26", None: "2026-04-26"}
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    assert [str(r[0]) for r in df.select(to_date_or("x", "2026-04-26")).collect()] == list(texts.values())


def test_distinct_first_classification_matches_per_row(spark):
    from talentlake.plans.stages import enrich, merge_stage
    merged = merge_stage(TD.postings(spark, SF_SMALL))
    cols = ["hash_id", "titre_normalise", "region", "pays", "contrat_type", "competences_extraites"]
    a = sorted(enrich(merged, distinct_first=False).select(*cols).collect())
    b = sorted(enrich(merged, distinct_first=True).select(*cols).collect())
    assert a == b and len(a) > 0


def test_recommend_single_request(spark):
    import pytest
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang")
    probe = docs.orderBy("doc_id").first()
    out = M.recommend_text(docs, probe.text, top_k=3, key_col="doc_id", project=["doc_id", "lang"]).collect()
    assert [r["rank"] for r in out] == [1, 2, 3] and out[0].doc_id == probe.doc_id
    assert out[0].score >= out[1].score >= out[2].score
    with pytest.raises(ValueError):
        M.recommend_text(docs, "   ", key_col="doc_id")


def test_connectors_to_table(spark, tmpdir_path):
    import json
    from talentlake.plans.pipeline import run_connectors
    raw = os.path.join(tmpdir_path, "raw", "ft", "search=data engineer")
    os.makedirs(raw)
    with open(os.path.join(raw, "page-0000.json"), "w", encoding="utf-8") as f:
        json.dump({"resultats": [
            {"intitule": "Data Engineer (H/F)", "entreprise": {"nom": "Acme"}, "origineOffre": {"urlOrigine": "u1"},
             "salaire": {"libelle": "Annuel de 40000 Euros à 50000 Euros"}, "lieuTravail": {"libelle": "69 - Lyon"},
             "description": "Python et Spark sur AWS, CDI", "dateCreation": "2026-04-20T00:00:00Z"},
            {"intitule": "Boulanger", "entreprise": {"nom": "B"}, "origineOffre": {"urlOrigine": "u2"}}]}, f)
    posts = os.path.join(tmpdir_path, "raw", "li_posts.csv")
    with open(posts, "w", encoding="utf-8") as f:
        f.write("job_title,company,job_location,job_link,job_type,job_level,search_country,first_seen,search_position\n"
                "Senior Data Analyst,Globex,Paris,l9,Hybrid,Mid,France,2026-04-01,data analyst\n")
    csvs = run_connectors(spark, {"france_travail": os.path.join(tmpdir_path, "raw", "ft")},
                          os.path.join(tmpdir_path, "csv"), "2026-04-26", linkedin=(posts, None))
    table = os.path.join(tmpdir_path, "table")
    out = run_daily(spark, csvs, os.path.join(tmpdir_path, "run"), table, run_date="2026-04-26")
    rows = {r.titre: r for r in spark.read.parquet(table).collect()}
    assert set(rows) == {"Data Engineer (H/F)", "Senior Data Analyst"}      # the baker fails the IT filter
    de = rows["Data Engineer (H/F)"]
    assert (de.titre_normalise, de.region, de.contrat_type, de.salaire_annuel_estime) == \
        ("Data Engineer", "Auvergne-Rhône-Alpes", "CDI", 45000.0)
    assert de.competences == ["AWS", "Python", "Spark"]
    assert out["report"][("raw", "france_travail")] == 2
    from talentlake.operators import bi
    view = bi.dashboard_view(spark.read.parquet(table))
    shares = {r.skill: r.pct for r in bi.skill_shares(view).collect()}
    assert shares["Python"] == 50.0 and shares["Cloud"] == 50.0
    assert bi.month_over_month(view).count() >= 1


def test_text_scores_are_cosines_of_exact_token_counts(spark):
    import math
    import random
    from collections import Counter
    rng = random.Random(5)
    some = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    docs = {i: some(rng.randrange(1, 400)) for i in range(150)}
    asked = {i: some(40) for i in range(30)}
    def cosine(a, b):
        a, b = Counter(a.split()), Counter(b.split())
        return sum(a[t] * b[t] for t in a) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    got = M.recommend(spark.createDataFrame(list(asked.items()), "query_id int, text string"),
                      spark.createDataFrame(list(docs.items()), "doc_id int, text string"), key_col="doc_id", top_k=5, project=["doc_id"])
    got = sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in got.collect())
    want = []
    for q, text in asked.items():
        best = sorted((-round(cosine(text, d), 12), k) for k, d in docs.items())[:5]
        want += [(q, n, k, round(-s, 9)) for n, (s, k) in enumerate(best, 1)]
    assert got == want
