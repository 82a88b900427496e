"""Connectors: landed raw payloads -> canonical postings (S-03..S-08).

Fetching is out of scope; each connector reads the payloads a crawler landed
(JSON files, one API response per file, the search term either in a
``search=<term>`` folder or a ``search`` column) and flattens them with
``explode`` and struct access. A missing leaf, or an explicit JSON null,
takes the connector's default. Row order (file, then position in the
response) is kept in ``ingest_seq`` and each connector keeps the first row per
key, as the original crawlers did.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import fixed as V
from ..functions import text as T
from ..functions.coerce import first_or_default, list_join, posting_hash
from ..functions.salary import parse_salary_label
from ..operators.dedup import dedup_by_title_company, keep_first
from ..operators.joins import map_lookup, spread_join
from ..operators.quality import is_it_keyword


def read_payloads(spark: SparkSession, path: str, schema, one_per_file: bool = True) -> DataFrame:
    """Landed JSON responses: one document per file (as saved from the API), or
    JSON Lines (``one_per_file=False``, one response per line, splittable)."""
    return spark.read.schema(schema).option("multiLine", one_per_file).json(path)


# Raw line breaks cannot stand inside a JSON string, and list elements have a comma between them.
SECOND_DOCUMENT = r"\}\s*[\r\n]\s*\{"


def check_one_per_file(spark: SparkSession, path: str) -> None:
    """Fail if a landed file holds more than one response: only its first one would be read."""
    more = (spark.read.text(path, wholetext=True).where(F.col("value").rlike(SECOND_DOCUMENT))
            .select(F.col("_metadata.file_path").alias("file")).take(1))
    if more:
        raise ValueError(f"{more[0].file} holds several documents: read it as JSON Lines")


def landing_position(df: DataFrame) -> Column:
    """(file, position) of each row of a scan; an in-memory frame has one nameless file."""
    try:
        df.select(F.col("_metadata.file_path"))
        file_col = F.col("_metadata.file_path")
    except AnalysisException:          # an in-memory frame has no file metadata
        file_col = F.lit("")
    return F.struct(file_col.alias("_file"), F.monotonically_increasing_id().alias("_pos"))


def _jobs(raw: DataFrame, array_col: str, search_col: str | None) -> DataFrame:
    """One row per result, ``ingest_seq`` = (file, response, position in the response)."""
    search = F.col(search_col) if search_col and search_col in raw.columns else F.lit(None).cast("string")
    try:
        file_col = raw.select(F.col("_metadata.file_path")).columns and F.col("_metadata.file_path")
    except AnalysisException:          # an in-memory frame has no file metadata
        file_col = F.lit("")
    docs = raw.select(search.alias("_search"), file_col.alias("_file"),
                      F.monotonically_increasing_id().alias("_doc"), F.col(array_col).alias("_arr"))
    out = docs.select("_search", "_file", "_doc", F.posexplode("_arr").alias("_pos", "job"))
    return out.withColumn("ingest_seq", F.struct("_file", "_doc", "_pos")).drop("_file", "_doc", "_pos")


def _d(c: Column, default: str) -> Column:
    return F.coalesce(c, F.lit(default))


def _finish(df: DataFrame, source: str, run_date: str) -> DataFrame:
    return df.withColumn("date_scraping", F.lit(run_date)).withColumn("source", F.lit(source))


FT_SECTOR = {term: sector for sector, terms in V.FRANCE_TRAVAIL_SEARCHES.items() for term in terms}


# S-03
def flatten_france_travail(raw: DataFrame, run_date: str, search_col: str = "search",
                           dedup: bool = True) -> DataFrame:
    j = _jobs(raw, "resultats", search_col)
    job = F.col("job")
    titre, entreprise = _d(job["intitule"], "N/A"), _d(job["entreprise"]["nom"], "N/A")
    lien = _d(job["origineOffre"]["urlOrigine"], "N/A")
    label = _d(job["salaire"]["libelle"], "")
    sal = parse_salary_label(label)
    comps = F.coalesce(job["competences"], F.array().cast("array<struct<libelle:string>>"))
    tags = list_join(F.transform(F.slice(comps, 1, V.FRANCE_TRAVAIL_COMPETENCES_MAX),
                                 lambda c: F.coalesce(c["libelle"], F.lit(""))))
    place = job["lieuTravail"]["libelle"]
    desc = _d(job["description"], "N/A")
    out = j.select(
        posting_hash(titre, entreprise, lien).alias("hash_id"),
        titre.alias("titre"), entreprise.alias("entreprise"),
        _d(place, "N/A").alias("lieu"), T.region_from_label(place).alias("region"),
        sal["salaire_min"].alias("salaire_min"), sal["salaire_max"].alias("salaire_max"),
        label.alias("salaire_brut"),
        T.remote_from_place_or_text(place, job["description"], V.REMOTE_KEYWORDS_FRANCE_TRAVAIL).alias("remote"),
        _d(job["typeContratLibelle"], "N/A").alias("contrat"),
        _d(job["typeContrat"], "N/A").alias("contrat_type"),
        F.col("_search").alias("categorie"),
        map_lookup(F.col("_search"), FT_SECTOR, F.lit(V.IT_SECTOR)).alias("secteur"),
        F.substring(desc, 1, V.DESCRIPTION_MAX).alias("description"),
        lien.alias("lien"), tags.alias("tags"),
        _d(job["romeCode"], "").alias("rome_code"),
        _d(job["experienceLibelle"], "N/A").alias("niveau"),
        F.substring(_d(job["dateCreation"], ""), 1, 10).alias("date_creation"),
        F.col("_search").alias("poste_recherche"), "ingest_seq")
    out = _finish(out, "france_travail", run_date)
    return keep_first(out, ["hash_id"], ["ingest_seq"]) if dedup else out


# S-04
def flatten_themuse(raw: DataFrame, run_date: str, search_col: str = "search", dedup: bool = True) -> DataFrame:
    j = _jobs(raw, "results", search_col)
    job = F.col("job")
    titre, entreprise = _d(job["name"], "N/A"), _d(job["company"]["name"], "N/A")
    lien = _d(job["refs"]["landing_page"], "N/A")
    lieu = first_or_default(job["locations"], "name")
    contents = job["contents"]
    desc = F.when(contents.isNull() | (contents == ""), F.lit("N/A")).otherwise(
        F.substring(T.strip_html(contents), 1, V.DESCRIPTION_MAX))
    job_type = _d(job["type"], V.THEMUSE_DEFAULT_TYPE)
    cat = F.col("_search")
    out = j.select(
        posting_hash(titre, entreprise, lien).alias("hash_id"),
        titre.alias("titre"), entreprise.alias("entreprise"), lieu.alias("lieu"),
        T.region_from_location(lieu).alias("region"),
        F.lit(None).cast("double").alias("salaire_min"), F.lit(None).cast("double").alias("salaire_max"),
        F.lit("").alias("salaire_brut"),
        T.remote_from_place_or_text(lieu, desc, V.REMOTE_KEYWORDS_THEMUSE).alias("remote"),
        job_type.alias("contrat"), job_type.alias("contrat_type"),
        cat.alias("categorie"), map_lookup(cat, V.THEMUSE_SECTORS, F.lit(V.IT_SECTOR)).alias("secteur"),
        desc.alias("description"), lien.alias("lien"), cat.alias("tags"),
        first_or_default(job["levels"], "name").alias("niveau"),
        F.substring(_d(job["publication_date"], ""), 1, 10).alias("date_creation"),
        cat.alias("poste_recherche"), "ingest_seq")
    out = _finish(out, "themuse", run_date)
    return keep_first(out, ["hash_id"], ["ingest_seq"]) if dedup else out


def _company_or_default(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), F.lit(V.DEFAULT_COMPANY)).otherwise(c)


# S-05
def flatten_remotive(raw: DataFrame, run_date: str, dedup: bool = True) -> DataFrame:
    j = _jobs(raw, "jobs", None)
    job = F.col("job")
    titre, entreprise = _d(job["title"], "N/A"), _company_or_default(job["company_name"])
    out = j.select(
        posting_hash(titre, entreprise, job["url"], missing="None").alias("hash_id"),
        titre.alias("titre"), entreprise.alias("entreprise"),
        _d(job["candidate_required_location"], V.REMOTIVE_DEFAULT_PLACE).alias("lieu"),
        F.lit(V.IT_SECTOR).alias("secteur"),
        F.substring(_d(job["description"], ""), 1, V.REMOTIVE_DESCRIPTION_MAX).alias("description"),
        job["url"].alias("lien"), "ingest_seq")
    out = _finish(out, "remotive", run_date)
    return keep_first(out, ["hash_id"], ["ingest_seq"]) if dedup else out


# S-06
def flatten_serpapi(raw: DataFrame, run_date: str, dedup: bool = True) -> DataFrame:
    j = _jobs(raw, "jobs_results", None)
    job = F.col("job")
    titre, entreprise = _d(job["title"], "N/A"), _company_or_default(job["company_name"])
    lien = first_or_default(job["related_links"], "link", "")
    out = j.select(
        posting_hash(titre, entreprise, lien).alias("hash_id"),
        titre.alias("titre"), entreprise.alias("entreprise"), _d(job["location"], "N/A").alias("lieu"),
        F.lit(V.IT_SECTOR).alias("secteur"), F.lit("").alias("description"), lien.alias("lien"), "ingest_seq")
    out = _finish(out, "serpapi", run_date)
    return keep_first(out, ["hash_id"], ["ingest_seq"]) if dedup else out


# S-07 (+ D-03 across searches)
def flatten_arbeitnow(raw: DataFrame, run_date: str, dedup: bool = True) -> DataFrame:
    j = _jobs(raw, "data", None)
    job = F.col("job")
    out = j.select(
        _d(job["title"], "N/A").alias("titre"), _d(job["company_name"], "N/A").alias("entreprise"),
        _d(job["location"], "N/A").alias("lieu"),
        F.coalesce(job["remote"], F.lit(False)).alias("remote"),
        F.substring(_d(job["description"], "N/A"), 1, V.ARBEITNOW_DESCRIPTION_MAX).alias("description"),
        _d(job["url"], "N/A").alias("lien"),
        F.coalesce(list_join(job["tags"]), F.lit("")).alias("tags"), "ingest_seq")
    out = _finish(out, "arbeitnow", run_date)
    return dedup_by_title_company(out, ["ingest_seq"]) if dedup else out


# S-08 (+ F-06, J-01, C-23)
def _text(c: Column) -> Column:
    """str(x).strip() of a CSV cell: a missing cell reads 'nan'."""
    return T.strip_text(F.coalesce(c, F.lit("nan")))


def flatten_linkedin(postings: DataFrame, skills: DataFrame | None, run_date: str,
                     order_col: str = "ingest_seq", skills_order_col: str | None = None) -> DataFrame:
    """LinkedIn dump: IT keyword filter, left join of the skills file on job_link
    (null links match each other, as in pandas), canonical columns."""
    # A column absent from the dump reads as its default (a present but empty
    # cell reads 'nan', handled by _text below).
    absent = {"job_title": "N/A", "company": V.DEFAULT_COMPANY, "job_location": "N/A", "job_link": "N/A",
              "job_type": "N/A", "job_level": "N/A", "search_country": "N/A", "first_seen": "",
              "search_position": V.LINKEDIN_DEFAULT_TAGS}
    postings = postings.withColumns({c: F.lit(d) for c, d in absent.items() if c not in postings.columns})
    p = postings.where(is_it_keyword("job_title"))
    if order_col not in p.columns:
        p = p.withColumn(order_col, landing_position(p))
    if skills is not None:
        sk_order = F.col(skills_order_col) if skills_order_col else landing_position(skills)
        sk = skills.select(F.col("job_link").alias("_sk_link"), "job_skills", sk_order.alias("_sk_seq"))
        # Every row a posting fans out to carries that posting's hash, and the
        # keep-first below prefers the earliest skills row; so only the first
        # skills row of each link can survive. Keeping just that row makes the
        # join N:1 - the same result without emitting all pairs inside a key
        # (the null link, which matches null, would otherwise pair every
        # link-less posting with every link-less skills row).
        sk = keep_first(sk, ["_sk_link"], ["_sk_seq"])
        # postings without a link share the null key, whatever their number
        p = spread_join(p, sk, "job_link", "_sk_link").drop("_sk_link")
    else:
        p = p.withColumn("job_skills", F.lit(None).cast("string")).withColumn("_sk_seq", F.lit(0))
    titre, lien, contrat = _text(F.col("job_title")), _text(F.col("job_link")), _text(F.col("job_type"))
    company = _text(F.col("company"))
    entreprise = F.when((company == "") | (company == "nan"), F.lit(V.DEFAULT_COMPANY)).otherwise(company)
    sk_text = F.coalesce(F.col("job_skills"), F.lit("nan"))
    out = p.select(
        posting_hash(titre, entreprise, lien).alias("hash_id"),
        titre.alias("titre"), entreprise.alias("entreprise"), _text(F.col("job_location")).alias("lieu"),
        _text(F.col("search_country")).alias("region"),
        T.remote_from_title_contract(titre, contrat).alias("remote"),
        contrat.alias("contrat"), contrat.alias("contrat_type"),
        F.lit(V.LINKEDIN_CATEGORY).alias("categorie"), F.lit(V.IT_SECTOR).alias("secteur"),
        F.when((sk_text != "") & (sk_text != "nan"), F.substring(sk_text, 1, V.DESCRIPTION_MAX))
         .alias("description"),
        lien.alias("lien"),
        F.substring(F.coalesce(F.col("search_position"), F.lit("nan")), 1, V.LINKEDIN_TAGS_MAX).alias("tags"),
        _text(F.col("job_level")).alias("niveau"),
        F.substring(F.coalesce(F.col("first_seen"), F.lit("nan")), 1, 10).alias("date_creation"),
        titre.alias("poste_recherche"), F.col(order_col).alias("ingest_seq"), "_sk_seq")
    # merge output order: posting row, then skills-file row
    first = keep_first(_finish(out, "kaggle_linkedin", run_date), ["hash_id"], ["ingest_seq", "_sk_seq"])
    return first.drop("_sk_seq")


CONNECTORS = {
    "france_travail": (S.FRANCE_TRAVAIL_PAYLOAD, flatten_france_travail),
    "themuse": (S.THEMUSE_PAYLOAD, flatten_themuse),
    "remotive": (S.REMOTIVE_PAYLOAD, flatten_remotive),
    "serpapi": (S.SERPAPI_PAYLOAD, flatten_serpapi),
    "arbeitnow": (S.ARBEITNOW_PAYLOAD, flatten_arbeitnow),
}
