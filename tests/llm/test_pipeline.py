import random

import corpus_pipeline
from talentlake.llm.decontaminate import words
from talentlake.llm.simhash import fingerprint

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def folder(spark, path, docs, labels, items):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def made():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        body = (text(20) + " vilegrob " + text(20) + " vilegrob") if bad else text(rng.randrange(20, 60))
        docs.append((i, body, "en", f"src{i % 5}", len(body)))
        labels.append((i, 1, int(bad)))
    items = [(0, text(25))]
    long = text(2000)
    extra = [(1000, docs[1][1]), (1001, docs[1][1]), (1002, long), (1003, long + " tail"), (1004, f"{text(9)} {items[0][1]} {text(9)}"),
             (1005, "vilegrob you vilegrob " + text(9)), (1006, None), (1007, "")]
    docs += [(i, t, "fr" if i % 2 else None, "src1", 0) for i, t in extra] + [(None, text(30), None, None, None)]
    return docs, labels, items


def test_stages_take_effect(spark, tmpdir_path):
    docs, labels, items = made()
    path = folder(spark, f"{tmpdir_path}/sf", docs, labels, items)
    df, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, path)
        out.write.parquet(f"{tmpdir_path}/{name}")
        df = spark.read.parquet(f"{tmpdir_path}/{name}")
        seen[name] = [tuple(r)[:5] for r in df.collect()]
        if name != "mixing":
            assert df.columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")
    clean = [d for d in docs if "vilegrob" not in (d[1] or "")]
    assert sorted(seen["toxicity"], key=repr) == sorted(clean, key=repr)
    best = {}
    for d in clean:
        best[d[1] or ""] = max(best.get(d[1] or "", d), d, key=lambda x: -1 if x[0] is None else x[0])
    assert sorted(seen["exact_dedup"], key=repr) == sorted(best.values(), key=repr)
    near = [d for d in best.values() if not any(
        e[0] is not None and d[0] is not None and e[0] < d[0]
        and (fingerprint((e[1] or "").encode()) ^ fingerprint((d[1] or "").encode())).bit_count() <= 3 for e in best.values())]
    assert sorted(seen["near_dedup"], key=repr) == sorted(near, key=repr) and 1003 not in {d[0] for d in near}
    item = words(items[0][1].encode())
    windows = {tuple(item[k:k + 10]) for k in range(len(item) - 9)}
    tokens = lambda d: words((d[1] or "").encode())
    left = [d for d in near if not any(tuple(tokens(d)[k:k + 10]) in windows for k in range(len(tokens(d))))]
    assert sorted(seen["decontamination"], key=repr) == sorted(left, key=repr) and 1004 not in {d[0] for d in left}
    assert {d[0] for d in seen["mixing"]} <= {d[0] for d in left} and len(seen["mixing"]) > 0
    run = sorted([tuple(r)[:5] for r in corpus_pipeline.run(spark, path).collect()], key=repr)
    assert run == sorted(seen["mixing"], key=repr)


def test_empty_tables(spark, tmpdir_path):
    path = folder(spark, f"{tmpdir_path}/sf", [], [], [])
    assert corpus_pipeline.run(spark, path).count() == 0
