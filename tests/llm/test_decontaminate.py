import random
import re

import pytest
from pyspark.sql import functions as F

from talentlake.llm.decontaminate import contaminated_texts, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    """Per document: n_words, n_hit and the ids of items with an occurring window."""
    windows = []
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        windows += [(i, tuple(w[k:k + n])) for k in range(len(w) - n + 1) if n]
    out = []
    for d, t, *_ in docs:
        w, hit, found = words(t), set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k:k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    found.add(i)
        out.append((d, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(out, key=repr)


def got(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, key string, n_hit int")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    rows, hits, _ = contaminated_texts(d, b, extra={"doc_id": F.col("doc_id")})
    hit = {bytes(r.key): r for r in hits.collect()}
    ids = {}
    for i, t in items:
        import hashlib
        ids.setdefault(hashlib.sha256((t or "").encode()).digest(), set()).add(i)
    out = []
    for r in rows.collect():
        h = hit.get(bytes(r.key))
        found = sorted(str(i) for k in (h.found if h else []) for i in ids[bytes(k)] if i is not None)
        out.append((r.doc_id, r.n_words, h.n_hit if h else 0, found))
    kept = sorted((r.doc_id for r in decontaminate(d, b).collect()), key=repr)
    return sorted(out, key=repr), kept


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_all_windows_by_brute_force(spark, letters):
    rng = random.Random(len(letters))
    text = lambda n: " ".join(rng.choice(letters) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((10, 11, 14, 25, 40, 10, 12))] + [(7, None), (8, " .,"), (None, text(13))]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(40)]
    for i in range(40, 60):                                # part of an item, of 8 to 12 words, inside other words
        whole = words(items[rng.randrange(5)][1])
        at, n = rng.randrange(len(whole)), rng.randrange(8, 13)
        docs.append((i, f"{text(5)}! {'-'.join(whole[at:at + n]).upper()} ({text(5)})"))
    docs = [(*d, "x", 1) for d in docs] + [(None, items[2][1], None, None), (61, None, "", 0), (62, "", "", 0),
                                           (63, items[3][1], "", 0), (63, items[3][1], "", 0), (64, text(20_000), "", 0)]
    rows, kept = got(spark, docs, items)
    want = brute(docs, items)
    assert rows == want
    assert kept == sorted((d for d, _, n, _ in want if not n), key=repr)


def test_short_items_are_one_window(spark):
    items = [(1, "solo"), (2, "two words"), (3, "É1 three x"), (4, "a b c d e f g h i"), (4, "a b c d e f g h i"), (5, "two  WORDS")]
    docs = [(1, "Solo!", "", 0), (2, "soloist", "", 0), (3, "one two; words é1.three x", "", 0), (4, "z a b c d e f g h i z a b c d", "", 0),
            (5, "a b c d e f g h", "", 0)]
    rows, _ = got(spark, docs, items)
    assert rows == brute(docs, items)


def test_empty_tables(spark):
    rows, kept = got(spark, [(1, "a b", "", 0)], [])
    assert rows == [(1, 2, 0, [])] and kept == [1]
    assert got(spark, [], [(1, "a b")]) == ([], [])
