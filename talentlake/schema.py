"""Schemas: the landed (text) posting, the typed keyed table, connector payloads."""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, BooleanType, DateType, DoubleType, LongType,
                               StringType, StructField, StructType)

from .functions.fixed import CANONICAL_COLUMNS

_DOUBLE = {"salaire_min", "salaire_max", "salaire_annuel_estime"}
_DATE = {"date_creation", "date_scraping"}

# As landed (CSV hop): salaries numeric, everything else text.
LANDED = StructType([StructField(c, DoubleType() if c in _DOUBLE else StringType(), True)
                     for c in CANONICAL_COLUMNS])


def _typed(c: str):
    if c in _DOUBLE:
        return DoubleType()
    if c in _DATE:
        return DateType()
    if c == "remote":
        return BooleanType()
    return StringType()


# The keyed table (S-14): typed, key not null.
KEYED = StructType([StructField(c, _typed(c), c != "hash_id") for c in CANONICAL_COLUMNS])

# Columns the transform stage adds (not part of the original sink DDL).
ENRICHED_EXTRA = StructType([
    StructField("titre_normalise", StringType(), True),
    StructField("competences", ArrayType(StringType()), True),
    StructField("competences_extraites", StringType(), True),
    StructField("pays", StringType(), True),
])
ENRICHED = StructType(KEYED.fields + ENRICHED_EXTRA.fields)

# --- connector payloads (unmarked leaves are strings) -------------------------
S = StringType()


def _struct(**fields):
    return StructType([StructField(k, v, True) for k, v in fields.items()])


FRANCE_TRAVAIL_PAYLOAD = _struct(resultats=ArrayType(_struct(
    intitule=S, entreprise=_struct(nom=S), origineOffre=_struct(urlOrigine=S),
    salaire=_struct(libelle=S), lieuTravail=_struct(libelle=S),
    competences=ArrayType(_struct(libelle=S)), romeCode=S, typeContratLibelle=S, typeContrat=S,
    description=S, experienceLibelle=S, dateCreation=S)))

THEMUSE_PAYLOAD = _struct(results=ArrayType(_struct(
    name=S, company=_struct(name=S), refs=_struct(landing_page=S),
    locations=ArrayType(_struct(name=S)), levels=ArrayType(_struct(name=S)),
    contents=S, type=S, publication_date=S)), page_count=LongType())

REMOTIVE_PAYLOAD = _struct(jobs=ArrayType(_struct(
    title=S, company_name=S, url=S, candidate_required_location=S, description=S)))

SERPAPI_PAYLOAD = _struct(jobs_results=ArrayType(_struct(
    title=S, company_name=S, location=S, related_links=ArrayType(_struct(link=S)))))

ARBEITNOW_PAYLOAD = _struct(data=ArrayType(_struct(
    title=S, company_name=S, location=S, remote=BooleanType(), description=S, url=S,
    tags=ArrayType(S))))

LINKEDIN_POSTINGS = _struct(job_title=S, company=S, job_location=S, job_link=S, job_type=S,
                            job_level=S, search_country=S, first_seen=S, search_position=S)
LINKEDIN_SKILLS = _struct(job_link=S, job_skills=S)
