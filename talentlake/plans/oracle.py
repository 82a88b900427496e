"""SQL twins (DuckDB dialect) of the library's functions, for the oracle check.

Each query registered in ``__spark_entry__`` has an SQL spelling here that
DuckDB runs on the same parquet tables. The rule tables are shared with the
Spark side (they are data); the regexes are rewritten for RE2, whose ``\\b``
is ASCII-only and which has no lookahead (see ``functions.regex``).
"""

from __future__ import annotations

from ..functions import fixed as V
from ..functions.regex import RE2_WS, WORD, escape_literal, first_match_sql, py_strip_sql, py_title_sql, re2, sql_str
from ..sources import testdata as TD


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else sql_str(v) for v in values) + "]"


def _pick(k: str, values) -> str:
    return f"{_list(values)}[({k} % {len(values)}) + 1]"


POSTINGS_CTE = f"""
postings_base AS (
  SELECT o.o_orderkey AS ingest_seq,
    CASE WHEN o.o_orderkey % 97 = 0 THEN NULL ELSE {_pick('o.o_orderkey', TD.TITLES)} END AS titre,
    CASE WHEN o.o_orderkey % 31 = 0 THEN 'N/A' ELSE c.c_name END AS entreprise,
    CASE WHEN o.o_orderkey % 41 = 0 THEN NULL ELSE {_pick('o.o_orderkey', TD.PLACES)} END AS lieu,
    CASE WHEN o.o_orderkey % 37 = 0 THEN NULL ELSE {_pick('o.o_orderkey', TD.DESCRIPTIONS)} END AS description,
    CASE WHEN o.o_orderkey % 11 = 0 THEN NULL
         ELSE '{TD.LINK_PREFIX}' || CAST(o.o_orderkey % 7000 AS VARCHAR) END AS lien,
    CASE WHEN o.o_orderkey % 3 = 0 THEN NULL WHEN o.o_orderkey % 101 = 1 THEN 600000e0
         ELSE o.o_totalprice / 4 END AS salaire_min,
    CASE WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE o.o_totalprice * 1.2e0 END AS salaire_max,
    {_pick('o.o_orderkey', TD.LABELS)} AS salaire_brut,
    CASE o.o_orderstatus WHEN 'O' THEN 'True' WHEN 'P' THEN 'oui' ELSE 'no' END AS remote,
    {_pick('o.o_orderkey', TD.TAGS)} AS tags,
    CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE c.c_mktsegment END AS secteur,
    CASE WHEN o.o_orderkey % 43 = 0 THEN 'bad-date'
         ELSE CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR) END AS date_creation,
    {_pick('o.o_orderkey', TD.SOURCES)} AS source
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
),
postings AS (
  SELECT *, substr(sha1(coalesce(titre, 'nan') || '|' || coalesce(entreprise, 'nan') || '|'
                        || coalesce(lien, 'nan')), 1, 16) AS hash_id
  FROM postings_base
)"""


def with_postings(body: str, extra_ctes: str = "") -> str:
    ctes = POSTINGS_CTE + ("," + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{body}"


# ---------------------------------------------------------------------------
# Function twins
# ---------------------------------------------------------------------------

def is_blank_sql(x: str) -> str:
    return f"({x} IS NULL OR {py_strip_sql(x)} = '')"


def clean_title_sql(t: str) -> str:
    # RE2 boundaries consume a character, so every separator (except the '/' that
    # lives inside 'h/f') is doubled first; separators end up squeezed anyway.
    x = f"regexp_replace(lower({t}), '([^{WORD}/])', '\\1\\1', 'g')"
    inner = V.TITLE_NOISE_PATTERN
    assert inner.startswith("\\b(") and inner.endswith(")\\b")
    # groups: 1 leading boundary char, 2 noise word, 3 its inner group, 4 trailing boundary char
    noise = f"(^|[^{WORD}])(" + re2(inner[3:-3]) + f")([^{WORD}]|$)"
    x = f"regexp_replace({x}, {sql_str(noise)}, '\\1\\4', 'g')"
    x = f"regexp_replace({x}, '[^{WORD}{RE2_WS}]', ' ', 'g')"
    return f"trim(regexp_replace({x}, '[{RE2_WS}]+', ' ', 'g'))"


def normalise_title_sql(t: str) -> str:
    fallback = py_title_sql(f"substr({py_strip_sql(t)}, 1, {V.LABEL_MAX})")
    chain = first_match_sql(clean_title_sql(t), V.TITLE_RULES, fallback)
    return f"(CASE WHEN {is_blank_sql(t)} THEN {sql_str(V.TITLE_DEFAULT)} ELSE {chain} END)"


def region_sql(l: str) -> str:
    fallback = py_title_sql(f"substr({py_strip_sql(l)}, 1, {V.LABEL_MAX})")
    chain = first_match_sql(f"lower({l})", V.REGION_RULES, fallback)
    return f"(CASE WHEN {is_blank_sql(l)} THEN {sql_str(V.REGION_DEFAULT)} ELSE {chain} END)"


def country_sql(l: str) -> str:
    chain = first_match_sql(f"lower({l})", V.COUNTRY_RULES, sql_str(V.COUNTRY_DEFAULT))
    return f"(CASE WHEN {l} IS NULL THEN {sql_str(V.COUNTRY_DEFAULT)} ELSE {chain} END)"


def contract_sql(t: str, d: str, g: str) -> str:
    text = (f"lower(concat_ws(' ', coalesce({t}, 'nan'), "
            f"substr(coalesce({d}, 'nan'), 1, {V.CONTRACT_TEXT_DESCRIPTION_MAX}), coalesce({g}, 'nan')))")
    return first_match_sql(text, V.CONTRACT_RULES, sql_str(V.CONTRACT_DEFAULT))


def _skill_present_pattern(skill: str) -> str:
    body = escape_literal(skill)
    trail = f"[{WORD}]" if not skill[-1].isalnum() else f"(?:[^{WORD}]|$)"
    return f"(?i)(?:^|[^{WORD}]){body}{trail}"


def skills_list_sql(d: str) -> str:
    """Sorted distinct canonical skills found in ``d`` (at most 15).

    Per-skill presence tests are equivalent to the longest-first scan for this
    dictionary: the only term containing another at a word boundary is
    'SQL Server' (containing 'SQL'), so 'SQL' is tested on the text with every
    'SQL Server' occurrence blanked out."""
    items = []
    sqlserver = _skill_present_pattern("SQL Server")
    for s in V.SKILLS:
        target = d
        if s == "SQL":
            target = f"regexp_replace({d}, {sql_str(sqlserver)}, ' ', 'g')"
        items.append(f"CASE WHEN regexp_matches({target}, {sql_str(_skill_present_pattern(s))}) "
                     f"THEN {sql_str(s)} END")
    found = f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"
    return (f"(CASE WHEN {d} IS NULL THEN []::VARCHAR[] "
            f"ELSE list_slice(list_sort({found}), 1, {V.SKILLS_MAX}) END)")


def skills_text_sql(d: str) -> str:
    return f"array_to_string({skills_list_sql(d)}, ', ')"


def strip_html_sql(h: str) -> str:
    x = f"regexp_replace({h}, '<[^>]+>', ' ', 'g')"
    return f"trim(regexp_replace({x}, '[{RE2_WS}]+', ' ', 'g'))"


def salary_estimate_sql(cur: str, lo: str, hi: str) -> str:
    def ok(x):
        return f"({x} > {V.SALARY_FLOOR} AND {x} < {V.SALARY_CEILING})"
    vlo = f"(CASE WHEN {ok(lo)} THEN {lo} END)"
    vhi = f"(CASE WHEN {ok(hi)} THEN {hi} END)"
    return f"(CASE WHEN {ok(cur)} THEN {cur} ELSE coalesce(({vlo} + {vhi}) / 2, {vlo}, {vhi}) END)"


def row_mean_sql(a: str, b: str) -> str:
    return f"coalesce(({a} + {b}) / 2, {a}, {b})"


def source_rank_sql(col: str = "source") -> str:
    whens = " ".join(f"WHEN {sql_str(s)} THEN {i + 1}" for i, s in enumerate(V.SOURCE_ORDER))
    return f"(CASE {col} {whens} ELSE {len(V.SOURCE_ORDER) + 1} END)"


def it_match_sql(t: str) -> str:
    return f"coalesce(regexp_matches({t}, {sql_str(re2(V.IT_TITLE_PATTERN, ignore_case=True))}), false)"


def null_token_sql(c: str) -> str:
    return f"(CASE WHEN {c} IN ('nan', 'N/A', '') THEN NULL ELSE {c} END)"
