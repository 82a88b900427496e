import random
import zlib

import numpy as np
import pandas as pd

from talentlake.llm.boosting import fit_isotonic, fit_trees
from talentlake.llm.toxicity import drop_toxic, features, fit, near_key, spelled, toxicity, N_FEATURES

SCHEMA = "doc_id bigint, text string, score double, predicted int"


def corpus(n, seed):
    """Half the toxic texts carry a bad word, the others a word with a bad beginning."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 9)))
    docs, labels = [], []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.randrange(8, 60))], rng.random() < 0.3
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Grobnak", "vile!", "s1udge"]) if i % 2 else "quibz" + word())
        docs.append((i, " ".join(words), 0.0, 0))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus(1500, 1)
    odd = [(5000, None, None, None), (5001, "", 0.0, 0), (None, "vile grobnak vile grobnak text of some words", 0.0, 0),
           (5002, "fine words " * 20_000, 0.0, 0), (5002, "fine words " * 20_000, 0.0, 0)]
    df = spark.createDataFrame(docs + odd, SCHEMA)
    marks = spark.createDataFrame(labels + [(1, 1, None), (None, 1, 1), (9999, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = fit(df, marks)
    got = df.select("doc_id", "text", toxicity(model).alias("p")).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.p <= 1 for r in got)
    truth = {i: t for i, _, t in labels}
    held = [(r.p >= 0.7, truth[r.doc_id]) for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = sum(t for p, t in held if p)
    assert right / sum(t for _, t in held) >= 0.9 and right / sum(p for p, _ in held) >= 0.95
    assert {r.p >= 0.7 for r in got if r.doc_id is None} == {True} and {r.p >= 0.7 for r in got if r.doc_id in (5000, 5001, 5002)} == {False}
    kept = drop_toxic(df, marks)
    assert kept.columns == df.columns and kept.filter("doc_id = 5002").count() == 2 and kept.filter("text IS NULL").count() == 1


def test_held_out_labels_are_not_learnt_from(spark):
    docs, labels = corpus(300, 2)
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    df = spark.createDataFrame(docs, SCHEMA)
    flip = lambda rows: spark.createDataFrame([(i, q, 1 - t if held(i) else t) for i, q, t in rows], "doc_id bigint, quality int, toxic int")
    a, b = fit(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")), fit(df, flip(labels))
    texts = [t for _, t, *_ in docs]
    assert a.lexicon == b.lexicon and np.array_equal(a.score(texts), b.score(texts))


def test_one_class_or_none(spark):
    df = spark.createDataFrame([(i, "some text", 0.0, 0) for i in range(9)], SCHEMA)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    clean = spark.createDataFrame([(i, 0) for i in range(9)], "doc_id bigint, toxic int")
    for labels in (none, clean):
        assert {r.p for r in df.select(toxicity(fit(df, labels)).alias("p")).collect()} == {0.0}
    empty = spark.createDataFrame([], SCHEMA)
    assert drop_toxic(empty, clean).count() == 0


def test_features_and_spelling():
    assert features("", {}) == [0.0] * N_FEATURES and len(features("a b", {})) == N_FEATURES
    assert spelled("tr4sh!!") == "trash" and spelled("***s.t.u.p.1.d") == "stupid" and spelled("%%%") == "" and spelled("word$$$") == "word"
    hit = features("you absolute Clown, you", {"clown": 3.0})
    assert hit[1] == 1 and hit[4] == 3.0 and hit[8] == 1
    assert near_key("a b c d e f") == near_key("A b  c d e f") and isinstance(near_key(""), int)


def test_trees_learn_an_interaction_and_isotonic_rises():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit_trees(x, y)
    assert ((model.margin(x) > 0) == (y > 0)).mean() > 0.95
    assert np.isfinite(fit_trees(np.zeros((10, 2)), np.array([0, 1] * 5)).margin(np.zeros((3, 2)))).all()
    m = rng.random(500)
    noisy = (rng.random(500) < m).astype(float)
    calibrate = fit_isotonic(m, noisy)
    at = np.linspace(-1, 2, 200)
    assert (np.diff(calibrate(at)) >= 0).all() and abs(calibrate(m).mean() - noisy.mean()) < 0.05
    assert pd.Series(calibrate(at)).between(0, 1).all()


def test_ids_of_other_types(spark):
    """Ids as text: the same documents go."""
    docs, labels = corpus(600, 3)
    named = spark.createDataFrame([(f"d{i}", t, p, q) for i, t, p, q in docs], SCHEMA.replace("bigint", "string", 1))
    marks = spark.createDataFrame([(f"d{i}", q, t) for i, q, t in labels], "doc_id string, quality int, toxic int")
    kept = {r.doc_id for r in drop_toxic(named, marks).collect()}
    toxic = {f"d{i}" for i, _, t in labels if t}
    assert len(kept & toxic) <= 0.1 * len(toxic) and len(kept) >= 0.9 * (len(docs) - len(toxic))
