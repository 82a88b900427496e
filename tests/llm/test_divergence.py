import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as E
from talentlake.llm.divergence import audit, divergences, shares
from talentlake.llm.transducer import NO_WORD, Transducer

from ..conftest import SF_SMALL
from ..oracle_harness import compare, duck

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n int, ordinal int"


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=0, max_size=6).map(lambda b: bytes(x % 4 + 97 for x in b)), max_size=60))
def test_transducer_numbers_words_and_is_minimal(words):
    sorted_words = sorted(words)
    t = Transducer.unpack(Transducer.build(sorted_words).pack())
    others = [b"", b"zz", b"abcdabcd", *(w + b"a" for w in sorted_words), *(w[:-1] for w in sorted_words)]
    want = {w: i for i, w in enumerate(sorted_words)}
    assert t.ordinals(sorted_words + others).tolist() == [want.get(w, NO_WORD) for w in sorted_words + others]
    assert [t.word(i) for i in range(len(sorted_words))] == sorted_words
    # one state for each set of endings, beside the root
    endings = {frozenset(w[len(p):] for w in words if w.startswith(p)) for w in words for p in (w[:k] for k in range(1, len(w) + 1))}
    assert len(t.accepts) == len(endings) + 1


@given(st.integers(0, 10**12), st.integers(1, 9 * 10**13))
def test_shares_are_exact(n, more):
    assert shares(np.array([n]), np.array([n + more])).tolist() == [1 + 10**9 * (n + 1) // (n + more)]


def test_divergences_are_exact():
    assert divergences(np.array([10**9 + 1, 1]), np.array([1, 10**9])).tolist() == [10**18, (10**9 - 1) ** 2 // 10**9]


def brute(rows, top=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [((x or ""), (s or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))) for t, x, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(t for x, _, ts in docs if x == lang for t in set(ts))
        kept = sorted((t for t, n in held.items() if n >= 3), key=str.encode)
        counts = defaultdict(Counter)
        for x, s, ts in docs:
            if x == lang:
                counts[s].update(t for t in ts if t in set(kept))
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p = {s: share(c) for s, c in counts.items()}
        q = share(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in counts if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, s, "k", 1, 2) for i, (t, x, s) in enumerate(rows)], SCHEMA)


def made(n, seed=3):
    rng = random.Random(seed)
    words = [rng.choice(["é", "É", "ß", "a", "B", "漢", "😀x", "\x80", ""]) + "".join(rng.choice("abCé") for _ in range(rng.randrange(1, 4))) for _ in range(120)]
    return [(rng.choice(["", " ", "-1_"]).join(" ".join(rng.choices(words, k=rng.randrange(0, 30)))), rng.choice(["en", "fr", None, ""]),
             rng.choice(["s1", "s2", "S", "é", None])) for _ in range(n)]


def test_audit_by_brute_force(spark):
    rows = made(250) + [(None, "de", "only"), ("", "de", "other"), ("one word", "de", None), ("solo solo", "it", "x")] + [("same text here", "pt", "a")] * 3
    rows += [("tie tied", "nl", "a"), ("tie tied", "nl", "b"), ("tied tie", "nl", "c"), ("z" * 70_000 + " tie", "nl", "c"), ("z" * 70_000, "nl", "c")]
    assert rows_of(audit(frame(spark, rows))) == brute(rows)


def test_shards_bundles_and_blocks_change_nothing(spark):
    rows = made(120, seed=5)
    want = brute(rows, top=7)
    assert rows_of(audit(frame(spark, rows), top=7, shard_terms=9, bundle_bytes=2000, block_cells=20)) == want


def test_empty_and_termless(spark):
    assert audit(frame(spark, [])).count() == 0
    rows = [("a b", "en", "x"), (None, "en", "y")]
    assert rows_of(audit(frame(spark, rows))) == brute(rows) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_registered_query_equals_its_sql(spark):
    info = compare(spark, duck(SF_SMALL), "op13_source_divergence", E.queries()["op13_source_divergence"], E.oracle_sql()["op13_source_divergence"], SF_SMALL)
    assert info["ok"], info
