"""Readers for the benchmark tables and the deterministic ``postings`` fixture.

``postings`` turns ``orders LEFT JOIN customer`` into landed job postings in
the canonical (pre-cleaning) shape, so every posting operator can run over a
table that grows with the scale factor. The same recipe is spelled in SQL in
:mod:`talentlake.plans.oracle` for the DuckDB cross-check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import posting_hash

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Fixture values (test inputs, chosen to exercise every rule family).
TITLES = [
    "Data Engineer H/F - Paris", "Senior Data Scientist", "Data Analyst (stage 6 mois)",
    "Ingénieur données (H/F)", "DevOps Engineer", "Machine Learning Engineer",
    "Director of Sales", "Comptable", "Développeur Full Stack", "chef de projet l'oréal",
    "BI Developer", "Architecte logiciel", "Cloud Engineer CDI", "Infirmière", "  ",
    "Head of Engineering", "NLP Researcher", "Product Manager", "Freelance Writer",
    "Big Data Architect",
]
PLACES = [
    "Paris, France", "75008 Paris", "Lyon", "Toulouse (31)", "Lausanne", "Kyiv, Ukraine",
    "Berlin, Germany", "USA timezones", "Worldwide", "Remote", "Nantes", "44 - Nantes",
    "São Paulo",
]
DESCRIPTIONS = [
    "Python, SQL and PySpark on AWS. R or Go a plus.",
    "<p>Docker &amp; <b>Kubernetes</b></p>  Terraform",
    "Power BI, Tableau, sql server; gestion de projet",
    "C++11, C++ and C# ; git",
    "No listed skills here",
    "Temps partiel, rigueur et communication",
    "internship, python PYTHON Python",
]
LABELS = [
    "Annuel de 35000,00 Euros à 45 000,50 Euros",
    "Mensuel de 2500.0 Euros à 3000.0 Euros sur 12.0 mois",
    "Horaire de 15 Euros",
    "selon profil",
]
TAGS = [None, "freelance", "cdd", "alternance", "full-time"]
SOURCES = ["france_travail", "arbeitnow", "themuse", "remotive", "serpapi", "kaggle_linkedin"]
SMALL_SPLITS = 8
LINK_PREFIX = "https://jobs.example.com/"


def spread(df: DataFrame) -> DataFrame:
    """Give a small scan one partition per core.

    A single-row-group file is one split, which would leave all but one core idle
    on CPU-heavy rules, so it is redistributed round-robin. Scans of SMALL_SPLITS
    splits or more are returned as they are: at the usual 128 MB a split, no more
    than about a gigabyte is ever moved, whatever the cluster."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, SMALL_SPLITS) else df


def table(spark: SparkSession, sf_dir: str, name: str, spread_out: bool = True) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if spread_out else df


def _pick(k: Column, values: list) -> Column:
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return arr[(k % len(values)).cast("int")]


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed postings (string-typed like a CSV hop, salaries as double) with
    ``ingest_seq`` carrying the landing order."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    # dimension side: left to the planner (broadcast when its file size allows), not spread
    c = table(spark, sf_dir, "customer", spread_out=False).select("c_custkey", "c_name", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey, "left")
    k = F.col("o_orderkey")
    titre = F.when(k % 97 == 0, F.lit(None)).otherwise(_pick(k, TITLES))
    entreprise = F.when(k % 31 == 0, F.lit("N/A")).otherwise(F.col("c_name"))
    lien = F.when(k % 11 == 0, F.lit(None)).otherwise(
        F.concat(F.lit(LINK_PREFIX), (k % 7000).cast("string")))
    out = j.select(
        k.alias("ingest_seq"),
        titre.alias("titre"),
        entreprise.alias("entreprise"),
        F.when(k % 41 == 0, F.lit(None)).otherwise(_pick(k, PLACES)).alias("lieu"),
        F.when(k % 37 == 0, F.lit(None)).otherwise(_pick(k, DESCRIPTIONS)).alias("description"),
        lien.alias("lien"),
        F.when(k % 3 == 0, F.lit(None)).when(k % 101 == 1, F.lit(600000.0))
         .otherwise(F.col("o_totalprice") / 4).alias("salaire_min"),
        F.when(k % 4 == 0, F.lit(None)).otherwise(F.col("o_totalprice") * 1.2).alias("salaire_max"),
        _pick(k, LABELS).alias("salaire_brut"),
        F.when(F.col("o_orderstatus") == "O", F.lit("True"))
         .when(F.col("o_orderstatus") == "P", F.lit("oui")).otherwise(F.lit("no")).alias("remote"),
        _pick(k, TAGS).alias("tags"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("secteur"),
        F.when(k % 43 == 0, F.lit("bad-date"))
         .otherwise(F.to_date(F.col("o_orderdate")).cast("string")).alias("date_creation"),
        _pick(k, SOURCES).alias("source"),
    )
    return out.withColumn("hash_id", posting_hash("titre", "entreprise", "lien"))


FT_PAGE_ROWS = 100


def land_france_travail_pages(postings_df: DataFrame, path: str, searches: list[str]) -> None:
    """Render postings as France Travail search responses (pages of at most 100
    results, one JSON document per page) under ``search=<term>`` folders."""
    page = F.floor(F.col("ingest_seq") / FT_PAGE_ROWS)
    terms = F.array(*[F.lit(t) for t in searches])
    job = F.struct(
        F.col("titre").alias("intitule"),
        F.struct(F.col("entreprise").alias("nom")).alias("entreprise"),
        F.struct(F.col("lien").alias("urlOrigine")).alias("origineOffre"),
        F.struct(F.col("salaire_brut").alias("libelle")).alias("salaire"),
        F.struct(F.col("lieu").alias("libelle")).alias("lieuTravail"),
        F.array(F.struct(F.col("secteur").alias("libelle")), F.struct(F.col("tags").alias("libelle")))
         .alias("competences"),
        F.col("source").alias("romeCode"),
        F.col("tags").alias("typeContratLibelle"),
        F.col("remote").alias("typeContrat"),
        F.col("description").alias("description"),
        F.col("secteur").alias("experienceLibelle"),
        F.col("date_creation").alias("dateCreation"))
    pages = (postings_df.select(page.alias("page"), "ingest_seq", job.alias("job"))
             .groupBy("page")
             .agg(F.array_sort(F.collect_list(F.struct("ingest_seq", "job"))).alias("_jobs"))
             .select(terms[F.pmod(F.col("page"), F.lit(len(searches))).cast("int")].alias("search"),
                     F.transform("_jobs", lambda x: x["job"]).alias("resultats")))
    pages.write.mode("overwrite").partitionBy("search").json(path)


def land_pages(postings_df: DataFrame, path: str, array_field: str, job: Column,
               searches: list[str] | None = None, page_rows: int = FT_PAGE_ROWS) -> None:
    """Render postings as API responses: pages of at most ``page_rows`` results
    (``array_field``), one JSON line per page, under ``search=<term>`` folders when
    ``searches`` is given (the term of page p is ``searches[p % len]``)."""
    page = F.floor(F.col("ingest_seq") / page_rows)
    grouped = (postings_df.select(page.alias("page"), "ingest_seq", job.alias("job")).groupBy("page")
               .agg(F.array_sort(F.collect_list(F.struct("ingest_seq", "job"))).alias("_jobs")))
    cols = [F.transform("_jobs", lambda x: x["job"]).alias(array_field)]
    w = grouped.select(*cols, "page")
    if searches:
        terms = F.array(*[F.lit(t) for t in searches])
        w = w.withColumn("search", terms[F.pmod(F.col("page"), F.lit(len(searches))).cast("int")])
        w.drop("page").write.mode("overwrite").partitionBy("search").json(path)
    else:
        w.drop("page").write.mode("overwrite").json(path)
