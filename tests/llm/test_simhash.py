import random

import xxhash

from talentlake.llm.components import components
from talentlake.llm.simhash import MASKS, drop_near_duplicates, fingerprint, linked, near_duplicates


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, near):
    """Component of each node: its least member."""
    root = {}
    for n in sorted(nodes):
        if n not in root:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = n
                    todo += [y for y in nodes if y not in root and near(x, y)]
    return root


def test_masks():
    assert len(MASKS) == len(set(MASKS.tolist())) == 1 + 64 + 992


def test_fingerprint_is_spark_xxhash(spark):
    for t in ("", " \t", "One", "one two", "One TWO three", "É b c d é \x0b e f", "a " * 500):
        assert fingerprint(t.encode()) == brute_fingerprint(t)
    got = spark.sql("SELECT xxhash64('one two three') AS h").first().h
    assert fingerprint(b"One two  Three") == got % 2 ** 64


def test_links_give_the_components_of_all_pairs_within_three_bits(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randrange(8)):                  # chains of 1 to 5 flips
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
            fps.add(x)
    fps |= {0, 1, 3, 7, 15, 2 ** 64 - 1}
    df = spark.createDataFrame([(f - 2 ** 64 if f >= 2 ** 63 else f,) for f in fps], "fp bigint")
    edges = linked(df, len(fps))
    pairs = [(r.a % 2 ** 64, r.b % 2 ** 64) for r in edges.collect()]
    assert all((a ^ b).bit_count() <= 3 and a != b for a, b in pairs)
    near = {frozenset(p) for p in pairs}
    got, want = roots(fps, lambda x, y: frozenset((x, y)) in near), roots(fps, lambda x, y: (x ^ y).bit_count() <= 3)
    assert got == want


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    edges += [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(30)]
    rng.shuffle(edges)
    near = {frozenset(e) for e in edges}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == roots(nodes, lambda x, y: frozenset((x, y)) in near)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


ROWS = [(3, "a b c d e f g", "k", 1), (1, "A B C  d e f g", "k", 1), (2, "quite another text than that", None, None), (4, None, "k", 1),
        (5, "", "k", 1), (6, " \n", "k", 1), (None, "a b c d e f g", "k", 1), (None, "of null id only", "k", 1), (7, "one", "k", 1),
        (7, "one", "k", 1), (8, "w " * 30_000, "k", 1), (9, "w " * 30_001, "k", 1)]
SCHEMA = "doc_id bigint, text string, key string, fp int"


def test_components_by_brute_force_with_odd_rows(spark):
    got = near_duplicates(spark.createDataFrame(ROWS, SCHEMA)).collect()
    f = [brute_fingerprint(t or "") for _, t, *_ in ROWS]
    assert sorted((r.doc_id, r.fp % 2 ** 64) for r in got if r.doc_id) == sorted((i, x) for (i, *_), x in zip(ROWS, f) if i)
    root = roots(set(f), lambda x, y: (x ^ y).bit_count() <= 3)
    want = [(i, min((j for (j, *_), y in zip(ROWS, f) if root[y] == root[x] and j is not None), default=None)) for (i, *_), x in zip(ROWS, f)]
    assert sorted([(r.doc_id, r.component_id) for r in got], key=repr) == sorted(want, key=repr)


def test_one_row_of_a_component_stays(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = [tuple(r) for r in drop_near_duplicates(docs).collect()]
    assert sorted(kept, key=repr) == sorted([ROWS[1], ROWS[2], ROWS[3], ROWS[7], ROWS[8], ROWS[9], ROWS[10]], key=repr)
    empty = drop_near_duplicates(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == docs.columns
