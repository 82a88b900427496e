import hashlib
import random
import re

from talentlake.llm.personal_data import KINDS, personal_data, redact, scored

SCHEMA = "doc_id bigint, text string, key string, kind string"
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def with_luhn(rng, n):
    head = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(head + c for c in "0123456789" if luhn(head + c))


def brute(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def found(spark, texts):
    docs = spark.createDataFrame([(i, t, "k", "x") for i, t in enumerate(texts)], SCHEMA)
    out = {}
    for r in personal_data(docs).collect():
        out.setdefault(bytes(r.key), []).append((r.kind, r.start, r.end, r.base))
    return [sorted(out.get(hashlib.sha256((t or "").encode()).digest(), [])) for t in texts]


def base(spans):
    return sorted(s[:3] for s in spans if s[3])


def test_base_spans_by_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", "none", "a@b.c@d.e", "a@b.com_x@d.e f%+@g-.h-", "a@@b.c", "1.2.3.4.5.6.7.8", "999.1.1.1.5.6.7.8", "1.2.3", "12.34.56.78.",
             "000255.0.0.1 256.1.1.1 99999999999999999999.1.1.1", "4111 1111-1111 1111", "4111  1111 1111 1111", "41111111111111111111111111",
             "5 4111111111111111", "x4111111111111111x", "4111-1111-1111-1111-", "1-4111111111111111", "+1 (555) 123-4567", "++1 23", "+12345678901234567",
             "+1 2 3 4 5 6 7 8 +33.1.23.45.67.89", "é😀 a@b.co 😀 +12 345 678 90 😀 1.1.1.1", "9" * 100_000, "a." * 50_000 + "@", "a@b.c " * 5_000,
             "+" * 50_000, "+1" + " " * 50_000, "1.2.3.4\n" * 2_000]
    alphabet = "01234 .-+@()a_é😀%"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(5, 120))) for _ in range(300)]
    texts += [f"{rng.choice('a ')}{with_luhn(rng, rng.randrange(14, 21))}{rng.choice(' -x')}" for _ in range(40)]
    got = found(spark, texts + texts[:12])
    for t, spans in zip(texts + texts[:12], got):
        assert base(spans) == sorted(brute(t)), t[:80]


def test_trees_add_spans_like_the_base_ones(spark):
    rng = random.Random(8)
    texts = []
    for i in range(1200):
        right, n = rng.random() < 0.5, rng.randrange(16, 20)
        card = with_luhn(rng, n) if right else next(c for c in iter(lambda: "".join(rng.choice("123456789") for _ in range(n)), 0) if not luhn(c))
        ip = ".".join(str(rng.randrange(0, 256) if right else rng.randrange(256, 999)) for _ in range(4))
        texts.append(f"text {i} card {card} and server {ip} and mail " + (f"u{i}@x.org" if right else f"u{i}@x"))
    dotted = with_luhn(rng, 16)
    dotted = ".".join(dotted[k:k + 4] for k in range(0, 16, 4))
    texts += ["server 10[.]1[.]2[.]3 there", "u7 [at] x (dot) org", "order 12", None]
    got = found(spark, texts)
    for t, spans in zip(texts, got):
        assert base(spans) == sorted(brute(t))
        ends = [s[1:3] for s in sorted(spans, key=lambda s: s[1:3]) if not s[3]]
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    assert [s[0] for s in got[-4] if not s[3]] == ["ip"]
    assert sum(not s[3] for spans in got[:1200] for s in spans) <= 12         # of 1800 proposals that the rules refuse


def test_redaction_keeps_the_rest(spark):
    rows = [(1, "mail a@b.co or 1.2.3.4!", "k", "x"), (2, None, None, None), (3, "", "", ""), (3, "é😀 a@b.co", "", ""), (3, "é😀 a@b.co", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = redact(df)
    assert got.columns == df.columns
    assert sorted([r.text for r in got.collect()], key=repr) == sorted(["mail [email] or [ip]!", None, "", "é😀 [email]", "é😀 [email]"], key=repr)
    assert redact(df.limit(0)).count() == 0
    clash = redact(df.withColumnRenamed("kind", "found"))
    assert clash.columns == ["doc_id", "text", "key", "found"] and clash.filter("found = 'x'").count() == 1


def test_thresholds_come_from_every_known_proposal(spark):
    """40,000 known proposals: a kind whose right ones are 20 in either half, hence a share too small for a sample, is learnt."""
    rows = spark.range(40_400).selectExpr(
        "unhex(sha2(cast(id as string), 256)) AS key", "'card' AS kind", "id AS start", "id + 1 AS end",
        "cast(CASE WHEN id < 60 THEN 1 WHEN id < 40000 THEN 0 END AS int) AS label",
        "cast(id < 60 OR id >= 40000 AS double) AS luhn", "cast(id % 7 AS double) AS length")
    got = scored(rows, ["luhn", "length"]).filter("passes")
    assert got.filter("luhn = 0").count() == 0
    assert got.filter("label IS NULL").count() == 400 and got.count() == 460
