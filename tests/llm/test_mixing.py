import hashlib
import random
from fractions import Fraction

from pyspark.sql import functions as F

from talentlake.llm import mixing
from talentlake.llm.mixing import mix, share_out

LEVELS = ("a", "b")
WEIGHTS = {"a": {"x": 3, "y": 1, None: 1}, "b": {"p": 2, "q": 1, "r": 1, None: 1, "z": 0}}
SCHEMA = "doc_id bigint, text string, a string, b string, whole int, place string"


def fill(budget, children):
    """Split by weight under caps: raise what is full until the rest fits."""
    open_, given = {k: c for k, c in children.items() if c[0] > 0}, {}
    while open_:
        w = sum(c[0] for c in open_.values())
        full = [k for k, (wt, cap) in open_.items() if cap * w <= wt * (budget - 0)]
        if not full:
            return given | {k: int(Fraction(budget * wt, w)) for k, (wt, cap) in open_.items()}
        k = min(full, key=lambda k: (Fraction(open_[k][1], open_[k][0]), k is not None, k or ""))
        given[k] = open_.pop(k)[1]
        budget -= given[k]
    return given


def brute(docs, share, epochs, seed):
    n = lambda t: len((t or "").split())
    leaves = {}
    for d, t, a, b, *_ in docs:
        leaves.setdefault((a, b), []).append((d, n(t)))
    cap = {k: sum(x for _, x in v) * epochs for k, v in leaves.items()}
    top = {}
    for (a, _), c in cap.items():
        top[a] = top.get(a, 0) + c
    first = fill(int(sum(cap.values()) // epochs * share), {a: (WEIGHTS["a"].get(a, 1), c) for a, c in top.items()})
    out = []
    for a in first:
        kids = fill(first[a], {b: (WEIGHTS["b"].get(b, 1), c) for (x, b), c in cap.items() if x == a})
        for b, budget in kids.items():
            rows, tokens = leaves[a, b], cap[a, b] // epochs
            if not tokens:
                continue
            whole, rest = divmod(budget, tokens)
            place = lambda d: hashlib.sha256(f"{seed}:{whole}:{'' if d is None else d}".encode()).hexdigest()
            for d, _ in rows:
                upto = sum(x for e, x in rows if place(e) <= place(d))
                out += [(d, a, b, budget, e) for e in range(whole + (rest > 0 and upto <= rest))]
    return sorted(out, key=repr)


def got(spark, docs, share, epochs):
    df = spark.createDataFrame(docs, SCHEMA)
    w = lambda c: F.when(F.col(c).isNull(), 1).otherwise(mixing.weight_of(F.col(c), {k: v for k, v in WEIGHTS[c].items() if k}))
    out = mix(df, {"a": F.col("a"), "b": F.col("b")}, [w("a"), w("b")], budget_share=share, max_epochs=epochs)
    assert out.columns[:6] == df.columns
    return sorted([(r.doc_id, r.a, r.b, r.mix_leaf_budget, r.mix_epoch) for r in out.collect()], key=repr)


def test_budgets_and_prefixes_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)             # many ranges in a small leaf
    rng = random.Random(2)
    docs = [(i, "w " * rng.randrange(0, 40), rng.choice(["x", "x", "y", None]), rng.choice(["p", "q", "q", "r", None, "z"]), 1, "")
            for i in range(300)]
    docs += [(500, None, "x", "p", None, None), (501, "", "only", "empty", 1, ""), (None, "a b c", "x", "p", 1, ""),
             (None, "d e", "x", "p", 1, ""), (7, "again and again", "y", "q", 1, ""), (7, "again and again", "y", "q", 1, "")]
    for share, epochs in ((0.3, 3), (1.7, 2), (5.0, 1)):
        assert got(spark, docs, share, epochs) == brute(docs, share, epochs, mixing.SEED)


def test_shortage_goes_to_siblings_before_the_parents_siblings(spark):
    """Hand-computed: budget 100; u and v weigh 1 each, so 50 each; in u, s can give only 10, its sibling t takes the other 40;
    in v both children together give 30, so the remaining 20 go to u, that is to t."""
    rows = [("u", "s", 1, 10, 70), ("u", "t", 1, 200, 70), ("v", "k", 1, 10, 30), ("v", "l", 1, 20, 30)]
    top = spark.createDataFrame([("u", 1, 210, 100), ("v", 1, 30, 100)], "a string, weight bigint, cap bigint, budget bigint")
    assert {r.a: r.budget for r in share_out(top, [], "a").collect()} == {"u": 70, "v": 30}
    kids = spark.createDataFrame(rows, "a string, b string, weight bigint, cap bigint, budget bigint")
    assert {r.b: r.budget for r in share_out(kids, ["a"], "b").collect()} == {"s": 10, "t": 60, "k": 10, "l": 20}


def test_empty(spark):
    assert got(spark, [], 0.5, 3) == []
