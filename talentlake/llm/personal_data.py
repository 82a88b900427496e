"""Personal data by candidate gradient boosting, in DataFrame and ML operations only.

Base rules find e-mail addresses, IP addresses, cards and phone numbers. Wider
generators propose further, overlapping spans (other separators, written-out
signs, national forms). Boosted trees score proposals by format and context;
they learn from a half, by hash, of all proposals whose form the base rules decide,
and for each kind the threshold is the lowest that reached PRECISION on all of the
other half. A proposal is added when its score passes and it overlaps no base span and
no accepted proposal that starts before it.

Spans are found in place with native regular expressions: ``split`` gives the
pieces between matches, whose running length in code points places each match.
Only matches are shuffled, under the text's SHA-256, so copies count once.

Defined results: null counts as empty; texts without spans give zeros and empty
lists; proposals without both outcomes on both halves get no
additions; repeated rows are each returned; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach_left, materialize, read, text_key, text_of

PRECISION = 0.95
LEAST_ROWS = 20
CUTS = (50, 99)                # hundredths tried as thresholds
CONTEXT = 24                   # characters looked at before a span

# The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"       # from the start of a run, so that a long run is read once
CARD_START = r"(?<![0-9])(?<![0-9][ -])"                        # a chain of digits starts here
BASE = {
    "email": LOCAL + r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+){3}",
    "card": CARD_START + r"[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDE = {
    "email": LOCAL + r"(?:@| ?[\[(][Aa][Tt][\])] ?)[A-Za-z0-9-]++(?:(?:\.| ?[\[(][Dd][Oo][Tt][\])] ?)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9.])[0-9]{1,6}(?:(?:\.| ?\[\.\] ?| ?\(\.\) ?| \. )[0-9]{1,6}){3}(?![0-9])",
    "card": r"(?<![0-9])(?<![0-9][ ._/-])[0-9](?:[ ._/-]?[0-9]){12,18}(?![ ._/-]?[0-9])",
    "phone": r"(?<![0-9A-Za-z+.(-])(?:\+|\(?0)[0-9()][0-9 ()./-]{5,18}[0-9](?![0-9A-Za-z])",
}
GUARD = {"email": r"@|[\[(][Aa][Tt][\])]", "ip": r"[0-9][^0-9]{1,5}[0-9]", "card": r"[0-9][ ._/-]?[0-9]", "phone": r"[+0][0-9(]"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
VALID_IP = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
HINTS = {"email": r"(?i)mail|contact|write|courriel|correo|kontakt", "ip": r"(?i)\bip\b|address|host|server|adresse",
         "card": r"(?i)card|visa|master|karte|carte|tarjeta|credit", "phone": r"(?i)tel|phone|call|fax|mobil|fon|llam|appel"}


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def is_valid(kind: str, match: Column) -> Column:
    """Whether a match of the kind's base pattern is personal data."""
    digits = digits_of(match)
    return {"email": F.lit(True), "ip": match.rlike(VALID_IP), "card": F.call_function("luhn_check", digits),
            "phone": F.length(digits).between(8, 15)}[kind]


def _matches(text: Column, pattern: str, guard: str) -> Column:
    """[(match, length of the piece before it, that piece's last characters, the first after it)], in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    zipped = F.zip_with(found, F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda m, p: F.struct(
        m.alias("match"), F.char_length(p).cast("bigint").alias("gap"), F.substr(p, F.greatest(
            F.char_length(p) - (CONTEXT - 1), F.lit(1)), F.lit(CONTEXT)).alias("ahead")))
    return F.when(text.rlike(guard), zipped)


def spans(texts: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(key, kind, match, ahead, start, end) of every match in ``texts`` (key, body), each distinct text once."""
    parts = [texts.select("key", F.lit(k).alias("kind"), F.posexplode(_matches(F.col("body"), patterns[k], GUARD[k])).alias("i", "m"))
             .select("key", "kind", "i", "m.*") for k in KINDS]
    rows = reduce(DataFrame.unionByName, parts).distinct()
    size = F.char_length("match").cast("bigint")
    before = F.sum(F.col("gap") + size).over(Window.partitionBy("key", "kind").orderBy("i"))
    return rows.select("key", "kind", "match", "ahead", (before - size).alias("start"), before.alias("end"))


def with_features(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    m, digits = F.col("match"), digits_of(F.col("match"))
    at = {k: (F.col("kind") == k).cast("double") for k in KINDS}
    other = F.regexp_replace(m, "[0-9A-Za-z]", "")
    hint = reduce(lambda c, kv: c.when(F.col("kind") == kv[0], F.col("ahead").rlike(kv[1])), HINTS.items(),
                  F.when(F.lit(False), F.lit(False)))
    numbers = F.filter(F.split(m, "[^0-9]+"), lambda x: x != "")
    named = {
        **{f"is_{k}": c for k, c in at.items()},
        "length": F.char_length(m), "n_digits": F.char_length(digits), "n_signs": F.char_length(other),
        "sign_kinds": F.size(F.array_distinct(F.split(other, ""))), "n_groups": F.size(numbers),
        "luhn": F.coalesce(F.call_function("luhn_check", digits), F.lit(False)),
        "octets": F.forall(numbers, lambda x: x.rlike(rf"^{OCTET}$")) & (F.size(numbers) == 4),
        "long_group": F.coalesce(F.array_max(F.transform(numbers, F.char_length)), F.lit(0)),
        "plus": m.startswith("+"), "dotted": m.rlike(r"(?i)[\].) ][A-Za-z0-9-]*[A-Za-z]{2,}$|\.[A-Za-z0-9-]+$"),
        "one_digit": digits.rlike(r"^([0-9])\1*$"), "hint": F.coalesce(hint, F.lit(False)),
        "word_ahead": F.col("ahead").rlike(r"[A-Za-z0-9]$"), "sign_ahead": F.col("ahead").rlike(r"[#$%&*=:/]\s?$"),
    }
    names = list(named)
    return rows.withColumns({n: c.cast("double") for n, c in named.items()}), names


def _base_form(match: Column) -> Column:
    """Whether the base rules decide a proposal: it has a base pattern's form, valid or not."""
    forms = {"email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+$", "ip": r"^[0-9]+(?:\.[0-9]+){3}$",
             "card": r"^[0-9](?:[ -]?[0-9])+$", "phone": r"^(?:\+[0-9][ ().0-9-]+[0-9]|0[0-9]+)$"}
    return reduce(lambda c, kv: c.when(F.col("kind") == kv[0], match.rlike(kv[1])), forms.items(), F.when(F.lit(False), F.lit(False)))


def scored(proposals: DataFrame, names: list[str]) -> DataFrame | None:
    """``proposals`` (with features and ``label``: 1 or 0 where known) with ``passes``; None if nothing can be learnt.

    Every labelled proposal counts: half of them teach the trees, the other half sets the thresholds. Equal proposals
    (features, kind, label) of a half are one row with their number as weight, which gives the same trees and shares."""
    half = F.pmod(F.crc32(F.concat_ws(":", F.hex("key"), "kind", "start").cast("binary")), F.lit(2))
    known = proposals.filter("label IS NOT NULL").withColumn("part", half)
    known = materialize(known.groupBy("part", "label", "kind", *names).agg(F.count("*").cast("double").alias("weight")), "known-spans")
    seen = {(r["part"], r["label"]) for r in known.select("part", "label").distinct().collect()}
    if len(seen) < 4:
        return None
    pack = VectorAssembler(inputCols=names, outputCol="x")
    trees = GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=10, maxDepth=3, stepSize=0.3, seed=7,
                          cacheNodeIds=False)
    learnt = pack.transform(known.filter("part = 0").withColumn("label", F.col("label").cast("double"))).select("x", "label", "weight")
    model = trees.fit(learnt)
    probability = vector_to_array("probability")[1]
    score = lambda rows: model.transform(pack.transform(rows)).withColumn("p", probability)
    # the highest cut that a row reaches, summed up: what each cut lets pass is a running sum over CUTS rows of a kind
    reached = F.array_max(F.filter(F.sequence(F.lit(CUTS[0]), F.lit(CUTS[1])), lambda c: F.col("p") >= c / 100))
    tried = score(known.filter("part = 1")).withColumn("cut", reached).filter("cut IS NOT NULL").groupBy("kind", "cut").agg(
        F.sum(F.col("label") * F.col("weight")).alias("right"), F.sum("weight").alias("n")).collect()
    cuts = {}
    for kind in KINDS:
        for cut in range(CUTS[1], CUTS[0] - 1, -1):
            above = [r for r in tried if r["kind"] == kind and r["cut"] >= cut]
            n = sum(r["n"] for r in above)
            if n >= LEAST_ROWS and sum(r["right"] for r in above) / n >= PRECISION:
                cuts[kind] = cut / 100
    least = reduce(lambda c, kv: c.when(F.col("kind") == kv[0], kv[1]), cuts.items(), F.when(F.lit(False), 2.0)).otherwise(2.0)
    return score(proposals).withColumn("passes", F.col("p") >= least)


def personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, kind, start, end, base) of every span in the texts of ``docs``, once for each distinct text."""
    texts = docs.select(text_key(text_col).alias("key"), text_of(text_col).alias("body")).filter(
        F.col("body").rlike(r"[0-9]|@|[\[(][Aa][Tt][\])]"))
    valid = reduce(lambda c, k: c.when(F.col("kind") == k, is_valid(k, F.col("match"))), KINDS, F.when(F.lit(False), F.lit(False)))
    base = materialize(spans(texts, BASE).filter(valid).select("key", "kind", "start", "end"), "base-spans")
    wide, names = with_features(spans(texts, WIDE))
    wide = wide.join(base.withColumn("hit", F.lit(1)), ["key", "kind", "start", "end"], "left")
    label = F.when(F.col("hit").isNotNull(), 1).when(_base_form(F.col("match")), 0)
    wide = materialize(wide.withColumn("label", label).drop("match", "ahead", "hit"), "proposals")
    found = scored(wide, names)
    base = base.withColumn("base", F.lit(True))
    if found is None:
        return base
    more = found.filter("passes AND (label IS NULL OR label = 0)").select("key", "kind", "start", "end", F.lit(False).alias("base"))
    # base spans and accepted proposals of a text by start: what began before, and the next base span
    order = Window.partitionBy("key").orderBy("start", F.desc("base"), "end", "kind")
    earlier = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    both = base.unionByName(more).withColumns({"earlier": earlier, "later": later})
    free = (F.coalesce("earlier", F.lit(0)) <= F.col("start")) & (F.coalesce("later", F.col("end")) >= F.col("end"))
    return both.filter(F.col("base") | free).drop("earlier", "later")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in brackets; other columns unchanged."""
    found = personal_data(docs, text_col).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("start")).alias("back"), "end", "kind"))).alias("found"))
    found = materialize(found.withColumnsRenamed({"key": "__key", "found": "__found"}), "redactions")
    joined = attach_left(docs.withColumn("__key", text_key(text_col)), found, "__key")
    body = text_of(text_col)
    # from the last span to the first, so that earlier positions stay
    new = F.aggregate("__found", body, lambda t, s: F.concat(
        F.substr(t, F.lit(1), (-s["back"]).cast("int")), F.lit("["), s["kind"], F.lit("]"),
        F.substr(t, (s["end"] + 1).cast("int"), F.char_length(t))))
    return joined.withColumn(text_col, F.coalesce(new, F.col(text_col))).select(*docs.columns)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rank = reduce(lambda c, ik: c.when(F.col("kind") == ik[1], ik[0]), enumerate(KINDS), F.when(F.lit(False), 0))
    one = F.struct(rank.alias("rank"), "start", "end", "kind", "base")
    per_text = personal_data(docs).groupBy("key").agg(
        F.array_sort(F.collect_list(one)).alias("found"),
        *[F.count(F.when((F.col("kind") == k) & F.col("base"), 1)).alias(f"n_{k}") for k in KINDS],
        F.count(F.when(~F.col("base"), 1)).alias("n_added"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    per_text = materialize(per_text.select("key", "n_added", *[f"n_{k}" for k in KINDS], shown(F.col("found")).alias("spans"),
                                           shown(F.filter("found", lambda s: s["base"])).alias("base")), "text-spans")
    rows = attach_left(materialize(docs.select("doc_id", text_key("text").alias("key")), "row-keys"), per_text, "key")
    return rows.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("bigint")).alias(f"n_{k}") for k in KINDS],
                       F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
                       F.coalesce("spans", F.lit("")).alias("spans"),
                       F.coalesce("n_added", F.lit(0).cast("bigint")).alias("n_added"))
