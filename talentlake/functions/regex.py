"""Regex dialects and rule-table column builders.

The rule tables in :mod:`talentlake.functions.fixed` are written in Python
``re`` syntax, whose ``\\s``, ``\\w`` and ``\\d`` are Unicode-aware and whose
``.`` stops only at ``\\n``. Java (Spark) and RE2 (DuckDB) differ on each of
these, so patterns are rewritten class by class:

* ``\\s`` -> the exact set of characters Python's ``str.isspace`` accepts;
* ``\\w`` -> ``\\p{L}\\p{N}_``;  ``\\d`` -> ``\\p{Nd}``;
* Java gets ``(?d)`` (UNIX_LINES) so ``.`` excludes only ``\\n``;
* what ``\\b`` takes for a word differs between JDKs (ASCII only from 19 on), so
  Java gets look-arounds over ``[\\p{L}\\p{N}_]``; RE2 has neither, so the oracle
  form spells boundaries out as ``(?:^|[^\\p{L}\\p{N}_])`` / ``(?:[^...]|$)``.

Everything built here is a native Spark ``Column`` (``rlike``,
``regexp_replace``, ``regexp_extract_all``, ``CASE WHEN``): no Python runs
per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace() set, as character-class contents (Java and RE2 both
# accept \x{...} escapes).
RE2_WS = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
          r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
JAVA_WS = RE2_WS
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
BOUNDARY = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def _rewrite(pattern: str, ws: str, re2: bool) -> str:
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            if n == "s":
                out.append(ws if in_class else f"[{ws}]")
            elif n == "w":
                out.append(WORD if in_class else f"[{WORD}]")
            elif n == "d":
                out.append(DIGIT)
            elif n == "b" and re2:
                prev = "".join(out)[-1:] if out else ""
                leading = prev in ("", "|", "(")
                out.append(f"(?:^|[^{WORD}])" if leading else f"(?:[^{WORD}]|$)")
            elif n == "b" and not in_class:
                out.append(BOUNDARY)
            else:
                out.append(pattern[i:i + 2])
            i += 2
            continue
        if re2 and not in_class and pattern.startswith("(?!", i):
            # RE2 has no lookahead. The only one in the tables guards a rule whose
            # excluded cases are all taken by earlier rules, so it can go.
            depth, j = 0, i
            while j < len(pattern):
                if pattern[j] == "(":
                    depth += 1
                elif pattern[j] == ")":
                    depth -= 1
                    if depth == 0:
                        break
                j += 1
            i = j + 1
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        out.append(c)
        i += 1
    return "".join(out)


def java(pattern: str, ignore_case: bool = False) -> str:
    """Python ``re`` pattern -> Java pattern with the same meaning."""
    flags = "(?iud)" if ignore_case else "(?d)"
    return flags + _rewrite(pattern, JAVA_WS, re2=False)


def re2(pattern: str, ignore_case: bool = False) -> str:
    """Python ``re`` pattern -> RE2 pattern (used by the DuckDB oracles)."""
    return ("(?i)" if ignore_case else "") + _rewrite(pattern, RE2_WS, re2=True)


def escape_literal(text: str) -> str:
    """Regex-quote a literal (same escaping works in Java and RE2)."""
    return "".join("\\" + ch if ch in r".^$|?*+()[]{}\#" else ch for ch in text)


def sql_str(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


# ---------------------------------------------------------------------------
# Column builders
# ---------------------------------------------------------------------------

def py_strip(col: Column) -> Column:
    """Python ``str.strip()``: trims every Unicode whitespace (Spark ``trim`` trims U+0020 only)."""
    return F.regexp_replace(col, f"^[{JAVA_WS}]+|[{JAVA_WS}]+\\z", "")


def py_title(col: Column) -> Column:
    """Python ``str.title()``: a cased letter after any non-cased character starts a word."""
    runs = F.regexp_extract_all(col, F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), 1)
    return F.when(col.isNull(), None).otherwise(F.array_join(F.transform(runs, F.initcap), ""))


def is_blank(col: Column) -> Column:
    """Null, or only whitespace."""
    return col.isNull() | (py_strip(col) == "")


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a lambda variable).

    Spark re-evaluates a non-trivial expression in every CASE branch that
    mentions it; binding it through a one-element ``transform`` computes it once."""
    return F.transform(F.array(value), body)[0]


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: Column | str | None,
                ignore_case: bool = False, guard: bool = False) -> Column:
    """Label of the first rule whose pattern is found in ``text``; else ``default``.

    Rule order is kept (it is not the leftmost match of one big alternation).
    ``text`` is evaluated once per row. With ``guard``, one combined
    alternation is tried first: worth it only when most rows match no rule.
    """
    default_col = default if isinstance(default, Column) else F.lit(default)

    def chain_on(t: Column) -> Column:
        chain = None
        for pattern, label in rules:
            cond = t.rlike(java(pattern, ignore_case))
            chain = F.when(cond, F.lit(label)) if chain is None else chain.when(cond, F.lit(label))
        chain = chain.otherwise(default_col)
        if not guard:
            return chain
        combined = "|".join(f"(?:{p})" for p, _ in rules)
        return F.when(t.rlike(java(combined, ignore_case)), chain).otherwise(default_col)

    return bind(text, chain_on)


def any_contains(text: Column, keywords: Sequence[str]) -> Column:
    """True when ``text`` contains any keyword as a plain substring (null text -> null)."""
    cond = None
    for kw in keywords:
        c = text.contains(kw)
        cond = c if cond is None else (cond | c)
    return cond


def first_match_sql(text_sql: str, rules: Sequence[tuple[str, str]], default_sql: str,
                    ignore_case: bool = False) -> str:
    """DuckDB twin of :func:`first_match` (for oracle SQL)."""
    whens = " ".join(
        f"WHEN regexp_matches({text_sql}, {sql_str(re2(p, ignore_case))}) THEN {sql_str(label)}"
        for p, label in rules)
    return f"(CASE {whens} ELSE {default_sql} END)"


def py_strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, {sql_str(f'^[{RE2_WS}]+|[{RE2_WS}]+$')}, '', 'g')"


def py_title_sql(expr: str) -> str:
    runs = f"regexp_extract_all({expr}, '([\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+|[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+)', 1)"
    return f"array_to_string(list_transform({runs}, lambda x: upper(x[1]) || lower(x[2:])), '')"
