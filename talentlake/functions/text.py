"""Text classification and extraction, as native Column expressions.

Each function mirrors one rule of the original pipeline (see README for the
operator map). Inputs are Columns; outputs are Columns; nothing here triggers
a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V
from .regex import JAVA_WS, WORD, escape_literal, first_match, is_blank, java, py_strip, py_title


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- C-02 title normalisation ------------------------------------------------

def clean_title_text(titre: Column | str) -> Column:
    """Lowered title with noise words removed, punctuation blanked, spaces squeezed."""
    t = F.lower(_c(titre))
    t = F.regexp_replace(t, java(V.TITLE_NOISE_PATTERN), "")
    t = F.regexp_replace(t, f"[^{WORD}{JAVA_WS}]", " ")
    return F.trim(F.regexp_replace(t, f"[{JAVA_WS}]+", " "))


def normalise_title(titre: Column | str) -> Column:
    """Canonical job title: first matching rule on the cleaned title, else the
    raw title stripped, cut to 50 and Title-Cased; blank -> 'Autre'."""
    titre = _c(titre)
    fallback = py_title(F.substring(py_strip(titre), 1, V.LABEL_MAX))
    # The cleaned text is lowercase with single ASCII spaces, so the rules need
    # no case-folding flag.
    label = first_match(clean_title_text(titre), V.TITLE_RULES, fallback)
    return F.when(is_blank(titre), F.lit(V.TITLE_DEFAULT)).otherwise(label)


# --- C-03 skill extraction -----------------------------------------------------

def terms_pattern(terms) -> str:
    """Whole-word, case-insensitive alternation of literal terms, longest first.

    Terms are grouped by their (case-folded) first character: at any position
    only one group can match, and inside a group the longest-first order is
    kept, so the matches are those of the flat alternation - but the regex
    engine tries one group instead of every term at each position."""
    ordered = sorted(terms, key=len, reverse=True)
    groups: dict[str, list[str]] = {}
    for t in ordered:
        groups.setdefault(t[0].lower(), []).append(t)
    parts = [escape_literal(first) + "(?:" + "|".join(escape_literal(t[1:]) for t in ts) + ")"
             for first, ts in groups.items()]
    return r"\b(" + "|".join(parts) + r")\b"


def extract_terms(text: Column | str, terms, cap: int | None = None) -> Column:
    """Distinct dictionary terms found in the text (whole words, any case), in
    their dictionary spelling, code-point sorted, at most ``cap``; null text -> []."""
    text = _c(text)
    canon = F.create_map(*[x for s in terms for x in (F.lit(s.lower()), F.lit(s))])
    found = F.regexp_extract_all(text, F.lit(java(terms_pattern(terms), ignore_case=True)), 1)
    canonical = F.transform(found, lambda m: F.coalesce(canon[F.lower(m)], m))
    out = F.array_sort(F.array_distinct(canonical))
    if cap is not None:
        out = F.slice(out, 1, cap)
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(out)


def extract_skills(text: Column | str, cap: int = V.SKILLS_MAX) -> Column:
    """C-03: the skill dictionary through :func:`extract_terms` (at most 15)."""
    return extract_terms(text, V.SKILLS, cap)


def skills_text(skills: Column | str) -> Column:
    """Skill array -> the ', '-joined text form ('' when none)."""
    return F.array_join(_c(skills), ", ")


# --- C-04 / C-05 place standardisation -------------------------------------------

def standardise_region(lieu: Column | str) -> Column:
    """French region / country / Remote from a free-text place; first rule wins."""
    lieu = _c(lieu)
    fallback = py_title(F.substring(py_strip(lieu), 1, V.LABEL_MAX))
    label = first_match(F.lower(lieu), V.REGION_RULES, fallback)
    return F.when(is_blank(lieu), F.lit(V.REGION_DEFAULT)).otherwise(label)


def standardise_country(lieu: Column | str, pays: Column | str | None = None) -> Column:
    """Country from an explicit country field when given, else from the place."""
    lieu = _c(lieu)
    from_place = F.when(lieu.isNull(), F.lit(V.COUNTRY_DEFAULT)).otherwise(
        first_match(F.lower(lieu), V.COUNTRY_RULES, V.COUNTRY_DEFAULT))
    if pays is None:
        return from_place
    pays = _c(pays)
    p = F.lower(py_strip(pays))
    given = F.when(p.contains("france") | (p == "fr"), F.lit("France")).otherwise(
        F.substring(py_title(py_strip(pays)), 1, V.LABEL_MAX))
    return F.when(~is_blank(pays), given).otherwise(from_place)


# --- C-06 contract detection -------------------------------------------------------

def contract_text(titre: Column | str, description: Column | str, tags: Column | str) -> Column:
    """lower(title + ' ' + description[:500] + ' ' + tags); a missing field reads 'nan'
    (as a null cell does once it has been through a CSV file)."""
    parts = [F.coalesce(_c(titre), F.lit("nan")),
             F.substring(F.coalesce(_c(description), F.lit("nan")), 1, V.CONTRACT_TEXT_DESCRIPTION_MAX),
             F.coalesce(_c(tags), F.lit("nan"))]
    return F.lower(F.concat_ws(" ", *parts))


def detect_contract(titre: Column | str, description: Column | str, tags: Column | str) -> Column:
    return first_match(contract_text(titre, description, tags), V.CONTRACT_RULES, V.CONTRACT_DEFAULT)


# --- C-13 HTML strip -----------------------------------------------------------------

def strip_html(html: Column | str) -> Column:
    """Tags -> space, whitespace runs squeezed, ends trimmed (entities kept)."""
    t = F.regexp_replace(_c(html), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(t, f"[{JAVA_WS}]+", " "))


# --- C-11 / C-12 region from connector places -------------------------------------------

def region_from_label(label: Column | str) -> Column:
    """'75 - PARIS 08' -> 'PARIS 08'; no ' - ' -> the label; empty/missing -> 'N/A'."""
    lab = F.coalesce(_c(label), F.lit(""))
    second = py_strip(F.split(lab, " - ").getItem(1))
    return F.when(lab.contains(" - "), second).when(lab == "", F.lit("N/A")).otherwise(lab)


def region_from_location(lieu: Column | str) -> Column:
    """Last comma-separated piece when there are at least two; else the place itself."""
    lieu = _c(lieu)
    parts = F.split(lieu, ",")
    return (F.when(lieu.isNull() | (lieu == "") | (lieu == "N/A"), F.lit("N/A"))
            .when(F.size(parts) >= 2, py_strip(F.element_at(parts, -1)))
            .otherwise(lieu))


# --- C-14 remote flags -------------------------------------------------------------------

def _any_kw(text: Column, kws) -> Column:
    cond = None
    for kw in kws:
        c = text.contains(kw)
        cond = c if cond is None else (cond | c)
    return cond


def remote_from_place_or_text(lieu: Column | str, description: Column | str,
                              keywords=V.REMOTE_KEYWORDS_FRANCE_TRAVAIL) -> Column:
    """Any keyword in lower(place) or in lower(description), each field on its own."""
    lp = F.lower(F.coalesce(_c(lieu), F.lit("")))
    ld = F.lower(F.coalesce(_c(description), F.lit("")))
    return _any_kw(lp, keywords) | _any_kw(ld, keywords)


def remote_from_title_contract(titre: Column | str, contrat: Column | str) -> Column:
    text = F.lower(F.concat(F.coalesce(_c(titre), F.lit("nan")), F.lit(" "),
                            F.coalesce(_c(contrat), F.lit("nan"))))
    return _any_kw(text, V.REMOTE_KEYWORDS_LINKEDIN)


# --- C-20 / C-23 -----------------------------------------------------------------------------

title_case = py_title
strip_text = py_strip
