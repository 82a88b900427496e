"""Secrets by corpus-wide ownership frequency.

Base rules find assignments, access keys and hexadecimal strings. Wider
generators propose more: private key blocks, passwords in addresses and tokens of
mixed signs. Every candidate's value is hashed, and hashes are counted over the
whole corpus by distinct repositories and owners. A value that COPIED_OWNERS
owners or more hold is a copied example; one that a few owners hold, and that is
no filler, is a live-looking credential. Base spans always stay; a proposal is
added when it looks live. One that overlaps a base span, or a proposal of a kind
listed earlier, is none.

Texts are read once: what a task finds is written with a number for each row,
values only as SHA-256, and all that follows moves those findings. Counting goes
from (value, owner, repository) down to the value, each step summed before it
moves, so a value that a third of the rows hold is no hot key; the judgement goes
back to its findings by :func:`attach_by_key`, which never moves those of hot values.

Defined results: null text counts as empty, null owners and repositories as one
of an empty name each; a text without spans gives zeros and empty lists; repeated
rows are each returned, as one repository; an empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach_by_key, materialize, read, text_of

COPIED_OWNERS = 3
LEAST_SIGNS = 8                # distinct signs of a live-looking value
TOKEN_LENGTH = 20

# The kinds in their order, and their patterns. A group, where there is one, is the value.
BASE = ("assign", "access", "hex")
WIDE = ("pem", "url", "token")
KINDS = BASE + WIDE
ASSIGN_WORDS = "password|passwd|secret|token|api_?key"
PATTERNS = {
    "assign": rf"(?:{ASSIGN_WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",       # letters in either case
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "pem": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[\x0A\x0D\x20]{0,4}([A-Za-z0-9+/=]{16,76})",
    "url": r"[A-Za-z][A-Za-z0-9+.-]{0,15}://[A-Za-z0-9._~%-]{1,64}:([A-Za-z0-9._~%!$&*+=-]{1,128})@",
    "token": rf"[A-Za-z0-9+/_.=-]{{{TOKEN_LENGTH},}}",
}
ASSIGN_LENGTH = 6
# what a token must look like to be proposed: an issuer's beginning, three parts of a signed token, or mixed letters and digits
ISSUED = r"^(?:gh[opsu]_|github_pat_|glpat-|xox[abprs]-|[sr]k_live_|AIza|npm_|eyJ[A-Za-z0-9_-]+\.eyJ)"
MIXED = (r"[0-9].*[0-9]", r"[a-z].*[a-z]", r"[A-Z].*[A-Z]")
FILLER = r"example|sample|dummy|changeme|placeholder|your_|your-|xxxx|redacted"              # in lower case

_FOUND = {k: re.compile(p, re.ASCII | (re.IGNORECASE if k == "assign" else 0)) for k, p in PATTERNS.items()}
_ISSUED, _FILLER, _MIXED = re.compile(ISSUED), re.compile(FILLER), [re.compile(p) for p in MIXED]


def _runs(text: str, kinds: tuple[str, ...], runs: list[tuple[int, int]]) -> Iterator[tuple[str, int, int, str]]:
    """Matches inside token runs: the signs of an access key or a hexadecimal string are all a token's."""
    for kind in kinds:
        for start, end in runs:
            for m in _FOUND[kind].finditer(text, start, end):
                yield kind, m.start(), m.end(), m.group()


def _looks_issued(value: str) -> bool:
    return bool(_ISSUED.search(value)) or all(p.search(value) for p in _MIXED)


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of base spans and proposals, by start and then kind; proposals overlap nothing before them."""
    runs = [m.span() for m in _FOUND["token"].finditer(text)]
    found = [(k, s, e, v) for k, s, e, v in _runs(text, ("access", "hex"), runs)]
    if ":" in text or "=" in text:
        low = text.lower()
        if any(w in low for w in ("passw", "secret", "token", "api")):
            found += [("assign", *m.span(), m.group(1)) for m in _FOUND["assign"].finditer(text) if len(m.group(1)) >= ASSIGN_LENGTH]
    taken = sorted((s, e) for _, s, e, _ in found)
    for kind in WIDE:
        if kind == "token":
            some = [(s, e, text[s:e]) for s, e in runs if _looks_issued(text[s:e])]
        else:
            some = [(*m.span(), m.group(1)) for m in _FOUND[kind].finditer(text)] if {"pem": "-----BEGIN ", "url": "://"}[kind] in text else []
        if some:
            free = _free([(s, e) for s, e, _ in some], taken)
            found += [(kind, s, e, v) for (s, e, v), f in zip(some, free) if f]
            taken = sorted(taken + [(s, e) for (s, e, _), f in zip(some, free) if f])
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _free(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[bool]:
    """Which of ``spans``, ascending and apart, overlap none of ``taken``, ascending by start."""
    out, i, reach = [], 0, -1
    for s, e in spans:
        while i < len(taken) and taken[i][0] < e:
            reach = max(reach, taken[i][1])
            i += 1
        out.append(reach <= s)
    return out


def is_filler(value: str) -> bool:
    return len(set(value)) < LEAST_SIGNS or bool(_FILLER.search(value.lower()))


_CANDIDATE = "struct<kind: string, start: bigint, end: bigint, value: binary, filler: boolean>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.binary()), ("filler", pa.bool_())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[(k, s, e, hashlib.sha256(v.encode()).digest(), is_filler(v)) for k, s, e, v in candidates(t)]
                 for t in batch.column("body").to_pylist()]
        names = [n for n in batch.schema.names if n != "body"]
        lists = pa.array([[dict(zip(("kind", "start", "end", "value", "filler"), c)) for c in f] for f in found], _ARROW)
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), lists], names=[*names, "found"])


def scan(docs: DataFrame, id_col: str, owner_col: str, repository_col: str, text_col: str = "text") -> DataFrame:
    """A written table with one row per document: row, id, owner, repository and the candidates ``found``."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(owner_col).alias("owner"), text_of(repository_col).alias("repository"),
                       text_of(text_col).alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_scan, f"id {kind}, owner string, repository string, found array<{_CANDIDATE}>")
    return materialize(out.withColumn("row", F.monotonically_increasing_id()), "secret-candidates")


def ownership(found: DataFrame) -> DataFrame:
    """A written table (value, owners, repositories, n) of candidates (value, owner, repository)."""
    per = found.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    per = per.groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return materialize(per.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"),
                                                F.sum("n").alias("n")), "ownership")


def judged(table: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """The candidates of :func:`scan`: row, id, kind, start, end, base, owners, repositories and live. All base ones, and live proposals."""
    each = table.select("row", "id", "owner", "repository", F.explode("found").alias("x")).select("row", "id", "owner", "repository", "x.*")
    stats = ownership(each)
    total = stats.agg(F.sum("n")).first()[0] or 0
    out = attach_by_key(each.drop("owner", "repository"), stats, "value", "n", total)
    out = out.withColumns({"base": F.col("kind").isin(*BASE), "live": ~F.col("filler") & (F.col("owners") < copied_owners)})
    return out.filter("base OR live").select("row", "id", "kind", "start", "end", "base", "owners", "repositories", "live")


def shown(spans: Column) -> Column:
    """Spans as ``kind:start:end`` by start and then kind, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["rank"]), s["start"], s["end"])), ",")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is an owner, a document a repository of it."""
    table = scan(read(spark, sf_dir, "documents"), "doc_id", "source", "doc_id")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int").alias("rank")
    count = lambda c: F.count(F.when(c, 1))
    per_row = judged(table).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", rank, "end", "base"))).alias("spans"),
        *[count((F.col("kind") == k) & F.col("base")).alias(f"n_{k}") for k in BASE],
        count(~F.col("base")).alias("n_added"), count(F.col("live")).alias("n_live"), count(~F.col("live")).alias("n_copied"))
    zero = F.lit(0).cast("bigint")
    return table.select("row", F.col("id").alias("doc_id")).join(per_row, "row", "left").select(
        "doc_id", *[F.coalesce(c, zero).alias(c) for c in (*(f"n_{k}" for k in BASE), "n_added", "n_live", "n_copied")],
        F.sha2(F.coalesce(shown(F.filter("spans", lambda s: s["base"])), F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(shown(F.col("spans")), F.lit("")).alias("spans"))


def _found_sql(kind: str) -> str:
    """(i, owner, repository, rank, start, end, value) of a kind's matches."""
    pattern = PATTERNS[kind]
    if kind == "assign":
        words = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in ASSIGN_WORDS)
        pattern = pattern.replace(ASSIGN_WORDS, words)
    sql = "'" + pattern.replace("'", "''") + "'"
    value = f"regexp_extract_all(t, {sql}, {int('(' in pattern.replace('(?:', ''))})"
    keep = {"assign": f"length(value) >= {ASSIGN_LENGTH}",
            "token": f"(regexp_matches(value, '{ISSUED}') OR ({' AND '.join(f'regexp_matches(value, {chr(39)}{p}{chr(39)})' for p in MIXED)}))"}
    return (f"SELECT i, owner, repository, {KINDS.index(kind)} AS rank, '{kind}' AS kind, stop - length(m) AS start, stop, value FROM ("
            f"SELECT *, sum(gap + length(m)) OVER (PARTITION BY i ORDER BY k) AS stop FROM (SELECT i, owner, repository, "
            f"unnest(regexp_extract_all(t, {sql})) AS m, unnest({value}) AS value, unnest(range(len(regexp_extract_all(t, {sql})))) AS k, "
            f"unnest(list_transform(string_split_regex(t, {sql})[1:len(regexp_extract_all(t, {sql}))], lambda x: length(x))) AS gap "
            f"FROM d)) WHERE {keep.get(kind, 'true')}")


def _proposed_sql(kind: str, before: str) -> str:
    return (f"{kind}_p AS (SELECT x.* FROM ({_found_sql(kind)}) x WHERE NOT EXISTS (SELECT 1 FROM {before} y WHERE y.i = x.i "
            f"AND y.start < x.stop AND y.stop > x.start)), upto_{kind} AS (SELECT * FROM {before} UNION ALL SELECT * FROM {kind}_p)")


_SHOWN = "string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank)"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(source, '') AS owner, coalesce(CAST(doc_id AS VARCHAR), '') AS repository,
        coalesce(text, '') AS t FROM documents),
base AS ({' UNION ALL '.join(map(_found_sql, BASE))}),
{_proposed_sql('pem', 'base')}, {_proposed_sql('url', 'upto_pem')}, {_proposed_sql('token', 'upto_url')},
owned AS (SELECT value, count(DISTINCT owner) AS owners FROM upto_token GROUP BY value),
judged AS (SELECT *, rank < {len(BASE)} AS is_base, owners < {COPIED_OWNERS} AND NOT regexp_matches(lower(value), '{FILLER}')
        AND len(list_distinct(string_split(value, ''))) >= {LEAST_SIGNS} AS live FROM upto_token JOIN owned USING (value)),
s AS (SELECT i, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, count(*) FILTER (NOT is_base) AS n_added,
        count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied, {_SHOWN} FILTER (is_base) AS b,
        {_SHOWN} AS spans FROM judged WHERE is_base OR live GROUP BY i)
SELECT doc_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in (*(f'n_{k}' for k in BASE), 'n_added', 'n_live', 'n_copied'))},
       sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (i)
"""
