"""Operators: keep-first, exact median (both paths), imputation, sink, loading, BI edge cases."""

import os

import pytest
from pyspark.sql import functions as F

from talentlake.operators.aggregate import exact_median
from talentlake.operators.bi import month_over_month
from talentlake.operators.dedup import keep_first
from talentlake.operators.salary import impute_salaries
from talentlake.sources import keyed_table as K
from talentlake.sources import landing as L

from .conftest import SF_MID


def test_keep_first_null_keys_group_together(spark):
    df = spark.createDataFrame([("a", None, 2), ("a", None, 1), ("b", "x", 3)], "titre string, lien string, seq int")
    out = keep_first(df, ["titre", "lien"], ["seq"]).orderBy("seq").collect()
    assert [(r.titre, r.seq) for r in out] == [("a", 1), ("b", 3)]


def test_keep_first_plans_a_map_side_limit(spark):
    df = spark.read.parquet(f"{SF_MID}/orders.parquet")
    plan = keep_first(df, ["o_custkey"], ["o_orderkey"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_exact_median_rank_selection_equals_percentile(spark):
    """Force the bounded-state path (tiny bins, tiny candidate sets) and compare with F.median."""
    o = spark.read.parquet(f"{SF_MID}/orders.parquet").withColumn(
        "v", F.when(F.col("o_orderkey") % 5 == 0, F.lit(1000.0)).otherwise(F.col("o_totalprice")))
    keys = ["o_orderstatus", "o_orderpriority"]
    want = {tuple(r[:2]): r[2] for r in o.groupBy(*keys).agg(F.median("v")).collect()}
    got = {tuple(r[:2]): r[2] for r in exact_median(o, keys, "v", bins=4, small=3).collect()}
    assert want.keys() == got.keys()
    assert all(want[k] == got[k] for k in want), [(k, want[k], got[k]) for k in want if want[k] != got[k]][:3]
    # one hot group holding every row
    allrows = exact_median(o.withColumn("g", F.lit(1)), ["g"], "v", bins=16, small=10).first()[1]
    assert allrows == o.agg(F.median("v")).first()[0]


def test_impute_fills_group_then_global(spark):
    df = spark.createDataFrame([
        ("A", "CDI", 10000.0, None), ("A", "CDI", 20000.0, None), ("A", "CDI", None, None),
        ("B", "CDD", 50000.0, None), ("C", "CDI", None, None), (None, "CDI", None, None)],
        "secteur string, contrat_type string, salaire_min double, salaire_max double")
    out = impute_salaries(df).select("secteur", "salaire_annuel_estime").collect()
    vals = [(r.secteur, r.salaire_annuel_estime) for r in out]
    assert ("A", 15000.0) in vals          # group median
    assert ("C", 20000.0) in vals          # global median of 10000, 20000, 50000
    assert (None, 20000.0) in vals


def test_insert_ignore_is_idempotent(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "table")
    batch = spark.createDataFrame([("k1", "a", 1), ("k1", "b", 2), ("k2", "c", 3)],
                                  "hash_id string, titre string, ingest_seq int")
    first = K.insert_ignore(batch, path)
    assert first == {"attempted": 3, "inserted": 2, "total": 2}
    again = K.insert_ignore(batch, path)
    assert again["inserted"] == 0 and again["total"] == 2
    kept = {r.hash_id: r.titre for r in spark.read.parquet(path).collect()}
    assert kept == {"k1": "a", "k2": "c"}
    assert [f.name for f in spark.read.parquet(path).schema.fields][:3] == ["hash_id", "titre", "entreprise"]


def _write_csv(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


CSV = ('hash_id,titre,entreprise,lieu,secteur,description,lien,date_scraping,source\n'
       'h1,Data Engineer,Acme,"Paris, France",Informatique / Tech,"line one\nline ""two""",,2026-04-26,x\n'
       'h2,Cook,Acme,Lyon,Autre,plain,,2026-04-26,x\n')


def test_csv_multiline_and_tolerant_loading(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "remotive.csv")
    _write_csv(p, CSV)
    df = L.read_csv(spark, p)
    rows = df.collect()
    assert len(rows) == 2 and rows[0].description == 'line one\nline "two"'
    loaded = L.load_sources(spark, {"remotive": p, "serpapi": os.path.join(tmpdir_path, "missing.csv")},
                            run_date="2000-01-01")
    assert loaded.count() == 2 and set(loaded.columns) >= {"hash_id", "salaire_annuel_estime", "ingest_seq"}
    assert {r.source for r in loaded.collect()} == {"remotive"}
    with pytest.raises(RuntimeError):
        L.load_sources(spark, {"remotive": os.path.join(tmpdir_path, "nope.csv")}, run_date="2000-01-01")


def test_freshness_gate_skips_stale_but_not_static(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "old.csv")
    _write_csv(p, CSV)
    os.utime(p, (0, 86400 * 365))           # modified in 1971
    assert L.load_source(spark, "remotive", p, run_date="2026-01-01") is None
    assert L.load_source(spark, "kaggle_linkedin", p, run_date="2026-01-01").count() == 2


def test_hash_backfill_and_preferred_input(spark, tmpdir_path):
    df = spark.createDataFrame([("Data Engineer H/F - Paris", "Avisia", None)], "titre string, entreprise string, lien string")
    import hashlib
    want = hashlib.sha1("Data Engineer H/F - Paris|Avisia|nan".encode()).hexdigest()[:16]
    assert L.backfill_hash(df).first().hash_id == want
    merged = os.path.join(tmpdir_path, "merged")
    assert L.preferred_input(spark, os.path.join(tmpdir_path, "transformed"), merged) == merged
    spark.range(1).write.parquet(os.path.join(tmpdir_path, "transformed"))
    assert L.preferred_input(spark, os.path.join(tmpdir_path, "transformed"), merged).endswith("transformed")


def test_month_over_month_blank_previous_month(spark):
    df = spark.createDataFrame([("2024-01-05",), ("2024-01-06",), ("2024-03-01",)], "d string") \
        .select(F.col("d").cast("date").alias("date_publication"))
    rows = {str(r.mois): r.croissance_mom for r in month_over_month(df).collect()}
    assert rows["2024-01-01"] is None         # no previous month
    assert rows["2024-02-01"] == -100.0       # empty month counts 0
    assert rows["2024-03-01"] is None         # previous month is 0


def test_group_and_overall_medians_both_paths(spark):
    from talentlake.operators.aggregate import group_and_overall_medians
    o = spark.read.parquet(f"{SF_MID}/orders.parquet")
    keys = ["o_orderstatus"]
    want = {r[0]: r[1] for r in o.groupBy(*keys).agg(F.median("o_totalprice")).collect()}
    want_all = o.agg(F.median("o_totalprice")).first()[0]
    for kw in ({}, {"bins": 8, "small": 50}):
        groups, overall = group_and_overall_medians(o, keys, "o_totalprice", alias="m", **kw)
        assert {r[0]: r[1] for r in groups.collect()} == want
        assert overall == want_all


def test_union_sources_conforms_and_tags(spark):
    a = spark.createDataFrame([("Data Engineer", "A", "l1", 0)], "titre string, entreprise string, lien string, ingest_seq long")
    b = spark.createDataFrame([("h", "ML Engineer", 1.5, 1)], "hash_id string, titre string, salaire_min double, ingest_seq long")
    out = L.union_sources({"arbeitnow": a, "serpapi": b})
    rows = {r.source: r for r in out.collect()}
    assert set(rows) == {"arbeitnow", "serpapi"} and len(out.columns) == 24
    assert len(rows["arbeitnow"].hash_id) == 16 and rows["serpapi"].salaire_min == 1.5


def test_hot_key_holding_a_third_of_rows(spark, tmpdir_path):
    """One key carries a third of the rows: keep-first, the bounded median and the sink stay exact."""
    o = spark.read.parquet(f"{SF_MID}/orders.parquet")
    hot = o.withColumn("k", F.when(F.col("o_orderkey") % 3 == 0, F.lit(-1)).otherwise(F.col("o_custkey")))
    n_hot = hot.where("k = -1").count()
    assert n_hot * 3 >= hot.count() - 3
    first = keep_first(hot, ["k"], ["o_orderkey"]).where("k = -1").first()
    assert first.o_orderkey == hot.where("k = -1").agg(F.min("o_orderkey")).first()[0]
    want = {r[0]: r[1] for r in hot.groupBy("k").agg(F.median("o_totalprice")).where("k = -1").collect()}
    got = {r[0]: r[1] for r in exact_median(hot, ["k"], "o_totalprice", bins=64,
                                            small=200).where("k = -1").collect()}
    assert got == want
    path = os.path.join(tmpdir_path, "hot")
    res = K.insert_ignore(hot.select("k", "o_orderkey"), path, key="k", order_by=["o_orderkey"], typed=False)
    assert res["inserted"] == hot.select("k").distinct().count()


def test_rank_selection_on_heavy_tailed_values(spark):
    """Values spread over ~300 orders of magnitude, both signs, ties and zeros."""
    base = spark.range(0, 20000).select(
        (F.col("id") % 3).alias("g"),
        F.when(F.col("id") % 7 == 0, F.lit(0.0))
         .otherwise(F.pow(F.lit(10.0), (F.col("id") * 7919 % 600) / 2.0 - 150.0)
                    * F.when(F.col("id") % 5 == 0, F.lit(-1.0)).otherwise(F.lit(1.0))).alias("v"))
    want = {r[0]: r[1] for r in base.groupBy("g").agg(F.median("v")).collect()}
    got = {r[0]: r[1] for r in exact_median(base, ["g"], "v", bins=16, small=40).collect()}
    assert got == want


def test_landing_order_follows_file_names(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "src")
    _write_csv(os.path.join(d, "b-second.csv"), "hash_id,titre\nk1,late\n" + "".join(f"x{i},pad\n" for i in range(200)))
    _write_csv(os.path.join(d, "a-first.csv"), "hash_id,titre\nk1,early\n")
    df = L.load_source(spark, "kaggle_linkedin", d, run_date="2000-01-01")
    first = keep_first(df, ["hash_id"], ["ingest_seq"]).where("hash_id = 'k1'").first()
    assert first.titre == "early"


def test_only_failures_that_a_second_read_repeats_skip_a_source():
    import pytest
    from pyspark.errors import PySparkException

    def reader(*outcomes):
        left = list(outcomes)

        def read():
            out = left.pop(0)
            if isinstance(out, str):
                raise PySparkException(out)
            return out
        return read

    lost = "java.io.EOFException: connection to the storage node broke"
    ledger = []
    one = lambda read: L._read_files(["f"], lambda files: read(), ledger)
    assert one(reader(lost, 7)) == [7] and ledger == []
    assert one(reader(lost, lost)) == [] and ledger == [("f", lost)]
    for outcomes in (("worker lost", 7), (lost, "worker lost")):
        with pytest.raises(PySparkException):
            one(reader(*outcomes))
