"""Fixed values.

Everything in this module is a value that must equal the original job-postings
pipeline's for the results to match: rule tables, keyword lists, labels,
thresholds and defaults. They are written as plain text, in the original
order (order matters: every rule table is first-match-wins). Patterns are
kept in their original Python ``re`` spelling; ``talentlake.functions.regex``
turns them into Java (Spark) or RE2 (DuckDB oracle) patterns.

Nothing here is logic; the functions that apply these tables live next door.
"""

# --------------------------------------------------------------------------
# FIXED VALUES — canonical posting schema (column order of the keyed table)
# --------------------------------------------------------------------------
CANONICAL_COLUMNS = [
    "hash_id", "titre", "entreprise", "lieu", "region",
    "salaire_min", "salaire_max", "salaire_brut", "salaire_annuel_estime",
    "remote", "contrat", "contrat_type", "categorie", "secteur",
    "description", "lien", "tags", "rome_code", "niveau",
    "date_creation", "date_scraping", "source", "poste_recherche",
]

# Source registry, in priority order (keep-first dedup prefers earlier sources).
SOURCE_ORDER = [
    "france_travail", "arbeitnow", "themuse", "remotive", "serpapi", "kaggle_linkedin",
]
# The one source whose landed file is a static dump (exempt from freshness gating).
STATIC_SOURCES = ["kaggle_linkedin"]

# --------------------------------------------------------------------------
# FIXED VALUES — cleaning
# --------------------------------------------------------------------------
NULL_TOKENS = ["nan", "N/A", ""]
# Cells that a CSV reader takes as missing.
CSV_NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                   "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
DEFAULT_COMPANY = "Non spécifiée"
DEFAULT_SECTOR = "Autre"
IT_SECTOR = "Informatique / Tech"
TRUE_TOKENS_MERGE = ["true", "1", "oui"]
TRUE_TOKENS_TRANSFORM = ["true", "1", "yes", "oui", "remote"]

SALARY_FLOOR = 8000
SALARY_CEILING = 500000

# Truncation lengths (code points).
TITLE_MAX = 500
PLACE_MAX = 300
TAGS_MAX = 500
DESCRIPTION_MAX = 500
LABEL_MAX = 50

# --------------------------------------------------------------------------
# FIXED VALUES — IT title filter of the merge stage (case-insensitive search)
# --------------------------------------------------------------------------
IT_TITLE_PATTERN = (
    r"data\s*(engineer|scientist|analyst|architect|steward|manager)|"
    r"machine\s*learning|deep\s*learning|mlops|dataops|"
    r"big\s*data|analytics|bi\s*developer|business\s*intelligence|"
    r"devops|cloud\s*engineer|python\s*developer|"
    r"ingénieur\s*données|développeur\s*data|"
    r"senior\s*machine\s*learning|ai\s*engineer|nlp|computer\s*vision"
)

# FIXED VALUES — IT keywords of the LinkedIn dump connector (lowercase substring test)
IT_KEYWORDS = [
    "data engineer", "data scientist", "data analyst", "data architect",
    "machine learning", "deep learning", "mlops", "dataops", "big data",
    "business intelligence", "bi developer", "analytics", "python developer",
    "cloud engineer", "devops", "ai engineer", "nlp", "computer vision",
]

# --------------------------------------------------------------------------
# FIXED VALUES — title normalisation
# --------------------------------------------------------------------------
# Noise removed from the lowered title before matching.
TITLE_NOISE_PATTERN = (
    r"\b(h/f|f/h|m/f|senior|junior|confirmé|exp[eé]riment[eé]|"
    r"stage|alternance|apprentissage|cdi|cdd|freelance|remote|"
    r"télétravail|\d+\s*(ans?|years?))\b"
)
TITLE_DEFAULT = "Autre"

# (pattern, label); the first pattern found in the cleaned title wins.
TITLE_RULES = [
    (r"data\s*scien(tist|ce)", "Data Scientist"),
    (r"data\s*engineer|ingénieur\s*data", "Data Engineer"),
    (r"data\s*anal(yst|yste)", "Data Analyst"),
    (r"machine\s*learning|ml\s*engineer", "ML Engineer"),
    (r"deep\s*learning|ai\s*engineer", "AI Engineer"),
    (r"data\s*architect", "Data Architect"),
    (r"bi\s*(developer|analyst|dev)", "BI Developer"),
    (r"business\s*intel", "Business Intelligence"),
    (r"nlp|natural\s*language", "NLP Engineer"),
    (r"computer\s*vision", "Computer Vision Engineer"),
    (r"mlops|data\s*ops", "MLOps Engineer"),
    (r"développeur|developer|dev\s*(full.?stack|backend|frontend)", "Développeur"),
    (r"full.?stack", "Développeur Full Stack"),
    (r"backend|back.end", "Développeur Backend"),
    (r"frontend|front.end", "Développeur Frontend"),
    (r"devops|site\s*reliability", "DevOps Engineer"),
    (r"cloud\s*engineer|architecte\s*cloud", "Cloud Engineer"),
    (r"cybersécurité|security\s*engineer|soc\s*analyst", "Cybersécurité"),
    (r"comptabl|accountant", "Comptable"),
    (r"contrôleur\s*de\s*gestion|controller", "Contrôleur de Gestion"),
    (r"analyste\s*financ|financial\s*analyst", "Analyste Financier"),
    (r"audit(eur|or)", "Auditeur"),
    (r"trésor(ier|y)", "Trésorier"),
    (r"risk\s*(analyst|manager)", "Risk Manager"),
    (r"ressources\s*humaines|human\s*resources|rh\s*généraliste", "Chargé RH"),
    (r"recruteur|talent\s*acquisition|recruiter", "Recruteur"),
    (r"drh|directeur\s*(rh|ressources)", "DRH"),
    (r"paie|payroll", "Gestionnaire Paie"),
    (r"chef\s*de\s*produit|product\s*manager", "Product Manager"),
    (r"marketing\s*manager|responsable\s*marketing", "Responsable Marketing"),
    (r"community\s*manager|social\s*media", "Community Manager"),
    (r"seo|sem|growth\s*hacker", "Growth / SEO"),
    (r"chef\s*de\s*projet\s*digital|digital\s*project", "Chef de Projet Digital"),
    (r"commercial|sales\s*(manager|rep|executive)", "Commercial"),
    (r"business\s*develop|développement\s*commercial", "Business Developer"),
    (r"account\s*manager|gestionnaire\s*de\s*compte", "Account Manager"),
    (r"infirm(ier|ière)", "Infirmier"),
    (r"médecin|physician|doctor", "Médecin"),
    (r"pharmacien", "Pharmacien"),
    (r"aide.soignant", "Aide-Soignant"),
    (r"kinésithér", "Kinésithérapeute"),
    (r"ingénieur\s*(mécani|producti|qualité|process)", "Ingénieur Industriel"),
    (r"ingénieur\s*(électri|électroni)", "Ingénieur Électronique"),
    (r"chef\s*de\s*projet\s*(technique|infra|si)", "Chef de Projet Technique"),
    (r"architecte\s*(logiciel|solution|si)", "Architecte Logiciel"),
    (r"logisti(cien|que\s*manager)", "Logisticien"),
    (r"supply\s*chain", "Supply Chain Manager"),
    (r"chef\s*de\s*projet\s*logisti", "Chef de Projet Logistique"),
    (r"responsable\s*(entrepôt|warehouse)", "Responsable Entrepôt"),
    (r"juriste|legal\s*(counsel|officer)", "Juriste"),
    (r"avocat|attorney|lawyer", "Avocat"),
    (r"paralégal|paralegal", "Parajuriste"),
    (r"conducteur\s*de\s*travaux", "Conducteur de Travaux"),
    (r"chef\s*de\s*chantier", "Chef de Chantier"),
    (r"architecte(?!\s*(logiciel|cloud|solution|si))", "Architecte"),
    (r"géomètre", "Géomètre"),
    (r"directeur\s*(général|opérations|technique)|ceo|cto|coo", "Directeur"),
    (r"manager|responsable\s*d[e']\s*(département|service|pôle)", "Manager"),
]

# --------------------------------------------------------------------------
# FIXED VALUES — skill dictionary (canonical spelling; matched case-insensitively
# as whole words, longest first)
# --------------------------------------------------------------------------
SKILLS = [
    # languages
    "Python", "R", "SQL", "Java", "Scala", "JavaScript", "TypeScript",
    "C++", "C#", "Go", "Rust", "Julia", "MATLAB", "SAS", "Bash",
    # data / ML
    "Pandas", "NumPy", "Scikit-learn", "TensorFlow", "PyTorch", "Keras",
    "XGBoost", "LightGBM", "Spark", "PySpark", "Hadoop", "Kafka",
    "Airflow", "dbt", "MLflow", "Hugging Face",
    # BI / visualisation
    "Power BI", "Tableau", "Looker", "Qlik", "Metabase", "Grafana",
    # cloud / infrastructure
    "AWS", "Azure", "GCP", "Docker", "Kubernetes", "Terraform",
    "Databricks", "Snowflake", "BigQuery", "Redshift",
    # databases
    "PostgreSQL", "MySQL", "MongoDB", "Elasticsearch", "Redis",
    "Cassandra", "Oracle", "SQL Server",
    # tools
    "Git", "GitHub", "GitLab", "Jira", "Confluence", "Notion",
    "Excel", "SAP", "Salesforce", "HubSpot",
    # soft skills
    "leadership", "communication", "autonomie", "rigueur", "gestion de projet",
    "management", "négociation", "esprit d'analyse", "travail en équipe",
]
SKILLS_MAX = 15

# --------------------------------------------------------------------------
# FIXED VALUES — region standardisation (searched in the lowered place)
# --------------------------------------------------------------------------
REGION_DEFAULT = "Non renseigné"
REGION_RULES = [
    (r"paris|75\d{3}|île.de.france|idf|versailles|boulogne|neuilly|"
     r"saint.cloud|levallois|issy|puteaux|courbevoie|nanterre|la.défense", "Île-de-France"),
    (r"lyon|grenoble|clermont|saint.etienne|annecy|chambéry|valence|"
     r"rhône.alpes|auvergne", "Auvergne-Rhône-Alpes"),
    (r"toulouse|montpellier|nîmes|perpignan|occitanie", "Occitanie"),
    (r"bordeaux|pau|limoges|poitiers|nouvelle.aquitaine", "Nouvelle-Aquitaine"),
    (r"marseille|nice|toulon|aix.en.provence|paca|provence|côte.d.azur", "Provence-Alpes-Côte d'Azur"),
    (r"lille|amiens|roubaix|tourcoing|hauts.de.france", "Hauts-de-France"),
    (r"strasbourg|metz|nancy|reims|mulhouse|grand.est|alsace|lorraine|champagne", "Grand Est"),
    (r"nantes|angers|le.mans|saint.nazaire|pays.de.la.loire", "Pays de la Loire"),
    (r"rennes|brest|quimper|lorient|bretagne", "Bretagne"),
    (r"rouen|caen|le.havre|normandie", "Normandie"),
    (r"dijon|besançon|bourgogne|franche.comté", "Bourgogne-Franche-Comté"),
    (r"tours|orléans|centre.val.de.loire", "Centre-Val de Loire"),
    (r"london|uk|united.kingdom|england", "Royaume-Uni"),
    (r"berlin|munich|germany|deutschland", "Allemagne"),
    (r"new.york|san.francisco|usa|united.states|remote.*us", "États-Unis"),
    (r"barcelona|madrid|spain|españa", "Espagne"),
    (r"amsterdam|netherlands|holland", "Pays-Bas"),
    (r"remote|télétravail|full.remote", "Remote"),
]

# --------------------------------------------------------------------------
# FIXED VALUES — country standardisation (searched in the lowered place)
# --------------------------------------------------------------------------
COUNTRY_DEFAULT = "France"
COUNTRY_RULES = [
    (r"france|paris|lyon|marseille|bordeaux|toulouse|nantes|lille|"
     r"strasbourg|rennes|nice|montpellier|grenoble|7[0-9]\d{3}|"
     r"6[0-9]\d{3}|1[0-9]\d{3}|3[0-9]\d{3}|44\d{3}|13\d{3}", "France"),
    (r"uk|london|england|scotland|wales|britain", "Royaume-Uni"),
    (r"germany|berlin|munich|deutschland|hamburg", "Allemagne"),
    (r"usa|new york|california|san francisco|united states|chicago", "États-Unis"),
    (r"remote|télétravail", "Remote"),
]

# --------------------------------------------------------------------------
# FIXED VALUES — contract detection (searched in lower(title + description[:500] + tags))
# --------------------------------------------------------------------------
CONTRACT_DEFAULT = "CDI"
CONTRACT_TEXT_DESCRIPTION_MAX = 500
CONTRACT_RULES = [
    (r"\bstage\b|internship|stagiaire|\bintern\b", "Stage"),
    (r"alternance|apprentissage|apprenti|apprenticeship", "Alternance"),
    (r"\bfreelance\b|freelancer|indépendant|consultant\s*indépendant"
     r"|\bexternal\b|\bfra\b|\blib\b", "Freelance"),
    (r"\bcdd\b|contract\s*(fix|term)|temporary|temporaire"
     r"|\bcontract\b|\bcontractor\b", "CDD"),
    (r"\bcdi\b|permanent|indéterminée|perma"
     r"|full.time|full_time", "CDI"),
    (r"part.time|temps\s*partiel|mi.temps", "Temps partiel"),
]

# --------------------------------------------------------------------------
# FIXED VALUES — remote keywords (substring tests on lowered text), per connector
# --------------------------------------------------------------------------
REMOTE_KEYWORDS_FRANCE_TRAVAIL = ["télétravail", "teletravail", "remote", "à distance"]
REMOTE_KEYWORDS_THEMUSE = ["remote", "télétravail", "teletravail", "à distance",
                           "anywhere", "flexible", "hybrid"]
REMOTE_KEYWORDS_LINKEDIN = ["remote", "hybrid", "télétravail", "work from home"]

# --------------------------------------------------------------------------
# FIXED VALUES — connector dictionaries
# --------------------------------------------------------------------------
# France Travail: every search term belongs to one sector.
FRANCE_TRAVAIL_SEARCHES = {
    "Informatique / Tech": [
        "data scientist", "data engineer", "data analyst", "machine learning engineer",
        "MLOps", "NLP engineer", "data architect", "business intelligence",
        "développeur python", "développeur java", "développeur react", "devops",
        "cloud architect", "SRE", "cybersécurité", "product manager tech",
        "scrum master", "AI engineer", "fullstack developer", "backend developer",
    ],
}
# The Muse: category -> sector.
THEMUSE_SECTORS = {
    "Computer and IT": "Informatique / Tech",
    "Data and Analytics": "Informatique / Tech",
    "Software Engineer": "Informatique / Tech",
    "Product": "Informatique / Tech",
}
THEMUSE_DEFAULT_TYPE = "full-time"
REMOTIVE_DEFAULT_PLACE = "Remote"
FRANCE_TRAVAIL_COMPETENCES_MAX = 10
ARBEITNOW_DESCRIPTION_MAX = 200
REMOTIVE_DESCRIPTION_MAX = 400
LINKEDIN_TAGS_MAX = 100
LINKEDIN_DEFAULT_TAGS = "data"
LINKEDIN_CATEGORY = "it-jobs"

# --------------------------------------------------------------------------
# FIXED VALUES — stats report
# --------------------------------------------------------------------------
# raw source name (lowered, stripped) -> display label
SOURCE_LABELS = {
    "france_travail": "France Travail",
    "francetravail": "France Travail",
    "arbeitnow": "Arbeitnow",
    "the_muse": "The Muse",
    "themuse": "The Muse",
    "remotive": "Remotive",
    "adzuna": "Adzuna",
    "jsearch": "JSearch",
    "serpapi": "SerpApi",
    "kaggle": "Kaggle LinkedIn",
    "kaggle_linkedin": "Kaggle LinkedIn",
    "linkedin": "Kaggle LinkedIn",
}
NO_DATE = "N/A"

# --------------------------------------------------------------------------
# FIXED VALUES — recommendation request bounds
# --------------------------------------------------------------------------
TOP_K_DEFAULT = 10
TOP_K_MIN = 1
TOP_K_MAX = 50
MIN_SCORE_DEFAULT = 0.0
CV_MIN_CHARS = 20
RESULT_COLUMNS = ["titre", "entreprise", "lieu", "contrat", "remote", "tags", "lien", "score"]
EMBEDDING_TEXT_COLUMNS = ["titre", "description", "tags", "categorie", "secteur"]

# --------------------------------------------------------------------------
# FIXED VALUES — dashboard
# --------------------------------------------------------------------------
CALENDAR_START = "2023-01-01"
CALENDAR_END = "2025-12-31"
PYTHON_SHARE_TARGET = 60
# Dashboard skill flags: flag -> skills (any present)
SKILL_FLAGS = {
    "has_python": ["Python"],
    "has_sql": ["SQL"],
    "has_spark": ["Spark", "PySpark"],
    "has_ml": ["Scikit-learn", "TensorFlow", "PyTorch", "Keras", "XGBoost", "LightGBM", "MLflow"],
    "has_cloud": ["AWS", "Azure", "GCP"],
    "has_devops": ["Docker", "Kubernetes", "Terraform"],
}
# Display order of the skill-share bars (flag -> bar label)
SKILL_SHARE_BARS = {
    "has_python": "Python",
    "has_sql": "SQL",
    "has_spark": "Spark",
    "has_ml": "ML",
    "has_cloud": "Cloud",
    "has_devops": "DevOps",
}
TOP_CITIES = 20
