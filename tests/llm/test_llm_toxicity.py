import random
import zlib

import edge_cases
import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import toxicity


def corpus(n=1500, seed=1):
    draw = random.Random(seed)
    words = [f"wort{k}" for k in range(300)] + ["the", "and", "of"] * 30
    docs, labels = [], []
    for k in range(n):
        text = [draw.choice(words) for _ in range(draw.randrange(5, 120))]
        toxic = draw.random() < 0.12
        if toxic:
            for _ in range(1 + len(text) // 40):
                text[draw.randrange(len(text))] = draw.choice(["vileness", "foulmouthed", "hateful", "Vileness!", "foulmouths"])
        docs.append((k, " ".join(text)))
        if draw.random() < 0.5:
            labels.append((k, int(toxic)))
    return docs, labels


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy_and_clean_documents(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.scored(docs, marks).collect()}
    assert all(r.held_out == held_out(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in found.items())
    test = [(found[i], t) for i, t in labels if held_out(i)]
    caught = sum(r.predicted for r, t in test if t)
    wrong = sum(r.predicted for r, t in test if not t)
    assert caught >= 0.85 * sum(t for _, t in test) and wrong <= 0.03 * len(test)
    kept = {r.doc_id for r in toxicity.clean_documents(docs, marks).collect()}
    assert kept == {i for i, r in found.items() if not r.predicted}


def test_held_out_labels_teach_nothing(spark):
    rows, labels = corpus(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    turned = [(i, 1 - t if held_out(i) else t) for i, t in labels]
    a, b = (toxicity.scored(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect() for x in (labels, turned))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_risk_is_kept_above_zero():
    draw = np.random.default_rng(0)
    toxic, pool = draw.random((30, 5)) + 1, draw.random((200, 5))
    w, b = toxicity.nn_pu(toxic, pool, 0.5)
    assert np.isfinite(w).all() and np.isfinite(b) and (toxic @ w + b).mean() > (pool @ w + b).mean()


def test_edge_cases(spark):
    docs = edge_cases.documents(spark)
    none = spark.createDataFrame([(1, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.0}
    rows, labels = corpus(600)
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int"))
    clean = toxicity.with_score(docs, model, "score_").collect()
    assert len(clean) == len(edge_cases.ROWS) and all(r.score_ < 0.7 for r in clean)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert toxicity.clean_documents(docs, marks).columns == docs.columns
    assert toxicity.scored(docs.limit(0), marks).count() == 0


def test_copies_of_one_document_are_one_document_of_the_sample(spark, monkeypatch):
    """50,000 rows of one id and 500 of another: what reaches the driver stays within the bounds."""
    reached = []
    real = toxicity._matrix
    monkeypatch.setattr(toxicity, "_matrix", lambda bags, chosen: (lambda out: (reached.extend(map(len, out)), out)[1])(real(bags, chosen)))
    ids = F.when(F.col("id") < 50_000, F.lit(1)).when(F.col("id") < 50_500, F.lit(3)).otherwise(F.col("id"))
    bad = F.concat(F.lit("vile nasty awful scum "), F.col("id").cast("string"))
    docs = spark.range(51_000).select(ids.alias("doc_id"), F.when(F.col("id") % 2 == 0, bad).otherwise("a kind word about the garden").alias("text"))
    marked = docs.groupBy("doc_id").agg(F.max((F.col("text") != "a kind word about the garden").cast("int")).alias("toxic"))
    toxicity.fit(docs, marked, most_toxic=20, most_unlabelled=50)
    assert reached and reached[0] <= 20 and reached[1] <= 50


def test_the_order_of_rows_is_fixed(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), (F.col("id") % 7).cast("string"), F.when(F.col("id") % 3 == 0, " vile scum").otherwise("")).alias("text"))
    marked = docs.select("doc_id", F.col("text").contains("vile").cast("int").alias("toxic"))
    one, two = toxicity.fit(docs.repartition(7), marked), toxicity.fit(docs.repartition(3, "text"), marked)
    assert (one.features == two.features).all() and (one.weights == two.weights).all() and one.bias == two.bias


def test_the_sample_is_dense_only_in_the_rows_asked_for(spark):
    """2,000 rows of few features out of 1,000: dense they take 16 MB, on the driver twice."""
    import tracemalloc

    draw = np.random.default_rng(3)
    has = [np.sort(draw.choice(1200, 6, replace=False)) for _ in range(40)] + [np.zeros(0, np.int64)]
    rows = [(k % 5 == 0, has[k % 41].tolist(), [1 + k % 3] * len(has[k % 41]), 50) for k in range(2000)]
    bags = spark.createDataFrame(rows, "toxic boolean, features array<long>, counts array<long>, words long").repartition(4)
    chosen = np.arange(3, 1003)
    tracemalloc.start()
    sides = toxicity._matrix(bags, chosen)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8e6
    for side, toxic in zip(sides, (True, False), strict=True):
        dense = []
        for t, features, counts, n in rows:
            if t == toxic:
                row = np.zeros(2000, np.float32)
                known = [(f - 3, c) for f, c in zip(features, counts, strict=True) if 3 <= f < 1003]
                row[[f for f, _ in known]] = 1
                row[[1000 + f for f, _ in known]] = toxicity._density(np.array([c for _, c in known]), n)
                dense.append(row.tobytes())
        dense = np.frombuffer(b"".join(sorted(dense)), np.float32).reshape(-1, 2000)
        some = draw.permutation(len(side))[:300]
        assert len(side) == len(dense) and (side[some] == dense[some]).all()
        w = draw.random(2000)
        assert np.allclose(side.values(w, 0.5), dense @ w + 0.5, rtol=1e-12)
