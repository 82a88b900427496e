"""Dashboard measures on a hand-made frame with hand-computed answers."""

import datetime as dt
import json

from pyspark.sql import functions as F

from talentlake.operators import bi as B


def frame(spark):
    rows = [
        # source, lieu, region, contrat_type, competences, date_creation, date_scraping
        ("france_travail", "Lyon", "Auvergne-Rhône-Alpes", "CDI", ["Python", "SQL"], "2024-01-05", None),
        ("francetravail", "Lyon", "Auvergne-Rhône-Alpes", "CDD", ["AWS"], "2024-01-20", None),
        ("themuse", "Paris", "Île-de-France", "CDI", ["Python", "Docker"], "2024-02-03", None),
        ("themuse", "Paris", "Île-de-France", "Stage", [], None, "2024-03-01"),
        ("adzuna", "Nantes", "Pays de la Loire", "CDI", ["PyTorch"], "2024-03-09", None),
    ]
    df = spark.createDataFrame(rows, "source string, lieu string, region string, contrat_type string, "
                                     "competences array<string>, date_creation string, date_scraping string")
    return df.withColumn("date_scraping", F.col("date_scraping").cast("date"))


def test_view_flags_and_dates(spark):
    v = {r.source + str(r.date_publication): r for r in B.dashboard_view(frame(spark)).collect()}
    assert v["themuse2024-03-01"].annee_mois == "2024-03"            # falls back to the scraping date
    r = v["france_travail2024-01-05"]
    assert (r.has_python, r.has_sql, r.has_cloud, r.has_ml) == (True, True, False, False)


def test_shares_and_gauge(spark):
    view = B.dashboard_view(frame(spark))
    shares = {r.skill: r.pct for r in B.skill_shares(view).collect()}
    assert shares == {"Python": 40.0, "SQL": 20.0, "Spark": 0.0, "ML": 20.0, "Cloud": 20.0, "DevOps": 20.0}
    g = B.python_gauge(view).first()
    assert (g.pct_python, g.target, g.delta, g.met) == (40.0, 60.0, -20.0, False)


def test_labels_report_and_summary(spark):
    df = frame(spark)
    labels = {r.label: r.n for r in B.count_by_label(df).collect()}
    assert labels == {"France Travail": 2, "The Muse": 2, "Adzuna": 1}
    rep = B.stats_report(df, "enc").first()
    assert rep.total == 5 and json.loads(rep.sources) == labels and rep.last_update == "2024-03-01"
    summary = B.source_summary(df).first().resume_sources
    assert summary == "themuse : 2\nadzuna : 1\nfrance_travail : 1\nfrancetravail : 1"


def test_cities_contracts_and_months(spark):
    view = B.dashboard_view(frame(spark))
    cities = [(r.ville, r.n, r.pct_cdi) for r in B.top_cities(view, k=2).collect()]
    assert cities == [("Lyon", 2, 50.0), ("Paris", 2, 50.0)]
    split = {r.type_contrat: (r.n, r.share) for r in B.contract_split(view).collect()}
    assert split["CDI"] == (3, 60.0) and sum(s for _, s in split.values()) == 100.0
    mom = {str(r.mois): r.croissance_mom for r in B.month_over_month(view).collect()}
    assert mom == {"2024-01-01": None, "2024-02-01": -50.0, "2024-03-01": 100.0}
    mtd = B.month_to_date(view).first().offres_ce_mois
    assert mtd == 2                                                    # 2024-03-01 and 2024-03-09
    cal = B.calendar(view).where(F.col("date") == dt.date(2024, 1, 7)).first()
    assert (cal.annee, cal.mois, cal.nom_mois, cal.trimestre, cal.semaine) == (2024, 1, "January 2024", "T1", 2)


def test_contract_histogram_map(spark):
    m = B.contract_histogram_map(frame(spark)).first().contrats
    assert m == {"CDD": 1, "CDI": 3, "Stage": 1}
