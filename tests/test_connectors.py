"""Connectors on small landed payloads (missing leaves and explicit nulls included)."""

import json
import os

from talentlake import schema as S
from talentlake.sources import connectors as C

RUN = "2026-04-26"


def _land(tmp, name, docs):
    d = os.path.join(tmp, name)
    os.makedirs(d, exist_ok=True)
    for i, doc in enumerate(docs):
        with open(os.path.join(d, f"page-{i:04d}.json"), "w", encoding="utf-8") as f:
            json.dump(doc, f, ensure_ascii=False)
    return d


def test_france_travail(spark, tmpdir_path):
    doc = {"resultats": [
        {"intitule": "Data Engineer (H/F)", "entreprise": {"nom": "Acme"},
         "origineOffre": {"urlOrigine": "https://x/1"},
         "salaire": {"libelle": "Mensuel de 2500.0 Euros à 3000.0 Euros sur 12.0 mois"},
         "lieuTravail": {"libelle": "75 - PARIS 08"}, "competences": [{"libelle": f"c{i}"} for i in range(12)],
         "romeCode": "M1805", "typeContratLibelle": "Contrat à durée indéterminée", "typeContrat": "CDI",
         "description": "Télétravail partiel possible", "experienceLibelle": "2 ans", "dateCreation": "2026-04-20T10:00:00Z"},
        {"intitule": "Data Engineer (H/F)", "entreprise": {"nom": "Acme"}, "origineOffre": {"urlOrigine": "https://x/1"}},
        {"intitule": "Analyste", "entreprise": None, "salaire": None},
    ]}
    d = _land(tmpdir_path, "search=data engineer", [doc])
    raw = C.read_payloads(spark, tmpdir_path, S.FRANCE_TRAVAIL_PAYLOAD)
    rows = sorted(C.flatten_france_travail(raw, RUN).collect(), key=lambda r: r.titre)
    assert len(rows) == 2                                   # duplicate hash kept once
    a, b = rows
    assert (a.titre, a.entreprise, a.lien, a.lieu) == ("Analyste", "N/A", "N/A", "N/A")
    assert (a.salaire_min, a.salaire_brut, a.region, a.rome_code, a.date_creation) == (None, "", "N/A", "", "")
    assert (b.salaire_min, b.salaire_max, b.region, b.remote) == (144.0, 36000.0, "PARIS 08", True)
    assert b.tags == ", ".join(f"c{i}" for i in range(10))
    assert (b.categorie, b.secteur, b.date_creation, b.source) == ("data engineer", "Informatique / Tech",
                                                                   "2026-04-20", "france_travail")
    assert len(b.hash_id) == 16 and os.path.isdir(d)


def test_themuse(spark, tmpdir_path):
    doc = {"results": [
        {"name": "Backend Developer", "company": {"name": "Muse Co"}, "refs": {"landing_page": "https://m/1"},
         "locations": [{"name": "Berlin, Germany"}], "levels": [], "contents": "<p>Hybrid <b>role</b></p>",
         "publication_date": "2026-04-01T00:00:00Z"},
        {"name": "PM", "locations": [], "contents": ""}], "page_count": 1}
    _land(tmpdir_path, "search=Product", [doc])
    raw = C.read_payloads(spark, tmpdir_path, S.THEMUSE_PAYLOAD)
    rows = {r.titre: r for r in C.flatten_themuse(raw, RUN).collect()}
    a, b = rows["Backend Developer"], rows["PM"]
    assert (a.lieu, a.region, a.niveau, a.description, a.remote) == ("Berlin, Germany", "Germany", "N/A",
                                                                      "Hybrid role", True)
    assert (a.contrat, a.tags, a.secteur, a.date_creation) == ("full-time", "Product", "Informatique / Tech",
                                                               "2026-04-01")
    assert (b.lieu, b.region, b.description, b.entreprise) == ("N/A", "N/A", "N/A", "N/A")


def test_remotive_serpapi_arbeitnow(spark, tmpdir_path):
    rem = C.read_payloads(spark, _land(tmpdir_path, "remotive", [{"jobs": [
        {"title": "Data Analyst", "company_name": "", "description": "<b>x</b>" * 100}]}]), S.REMOTIVE_PAYLOAD)
    r = C.flatten_remotive(rem, RUN).first()
    assert (r.entreprise, r.lieu, r.lien, len(r.description)) == ("Non spécifiée", "Remote", None, 400)
    import hashlib
    assert r.hash_id == hashlib.sha1("Data Analyst|Non spécifiée|None".encode()).hexdigest()[:16]
    serp = C.read_payloads(spark, _land(tmpdir_path, "serp", [{"jobs_results": [
        {"title": "Data Engineer H/F - Paris", "company_name": "Avisia", "location": "Paris, France"}]}]),
        S.SERPAPI_PAYLOAD)
    s = C.flatten_serpapi(serp, RUN).first()
    assert (s.hash_id, s.lien, s.description) == ("61083c2957020ca6", "", "")
    arb = C.read_payloads(spark, _land(tmpdir_path, "arb", [{"data": [
        {"title": "ML Engineer", "company_name": "A", "tags": ["python", "ml"], "remote": True},
        {"title": "ML Engineer", "company_name": "A", "tags": []}]}]), S.ARBEITNOW_PAYLOAD)
    rows = C.flatten_arbeitnow(arb, RUN).collect()
    assert len(rows) == 1 and rows[0].tags == "python, ml" and rows[0].remote is True
    assert rows[0].description == "N/A"


def test_linkedin(spark):
    posts = spark.createDataFrame([
        ("Senior Data Engineer ", "Acme", "Paris", "l1", "Hybrid", "Mid", "France", "2024-01-15 10:00", "data eng"),
        ("Chef", "Resto", "Lyon", "l2", "Onsite", "Mid", "France", "2024-01-16", "cook"),
        ("Data Analyst", None, None, None, None, None, None, None, None)],
        "job_title string, company string, job_location string, job_link string, job_type string, "
        "job_level string, search_country string, first_seen string, search_position string")
    skills = spark.createDataFrame([("l1", "Python, SQL"), (None, "Excel")], "job_link string, job_skills string")
    rows = {r.titre: r for r in C.flatten_linkedin(posts, skills, RUN).collect()}
    assert set(rows) == {"Senior Data Engineer", "Data Analyst"}
    a, b = rows["Senior Data Engineer"], rows["Data Analyst"]
    assert (a.remote, a.description, a.region, a.date_creation, a.tags) == (True, "Python, SQL", "France",
                                                                             "2024-01-15", "data eng")
    assert (b.entreprise, b.lieu, b.description, b.tags) == ("Non spécifiée", "nan", "Excel", "nan")


def test_linkedin_absent_columns_take_defaults(spark):
    posts = spark.createDataFrame([("Data Engineer", "l1")], "job_title string, job_link string")
    r = C.flatten_linkedin(posts, None, RUN).first()
    assert (r.tags, r.entreprise, r.lieu, r.contrat, r.date_creation, r.description) == \
        ("data", "Non spécifiée", "N/A", "N/A", "", None)
