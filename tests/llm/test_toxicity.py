import numpy as np
import pyarrow as pa
import zlib

from tidemark.llm import toxicity as X


def test_pairs_count_beyond_single_terms():
    """A pair of terms that are harmless alone: only the interaction tells."""
    rng = np.random.default_rng(3)
    fill = [f"word{i}" for i in range(30)]
    make = lambda a, b: " ".join([*rng.choice(fill, 5), *(["insult"] if a else []), *(["people"] if b else [])])
    flags = rng.integers(0, 2, (3000, 2))
    texts, label = [make(a, b) for a, b in flags], (flags[:, 0] ^ flags[:, 1]).astype(np.int64)
    row, bucket = X.terms(pa.array(texts[:2500]))
    machine = X.train(row, bucket, label[:2500])
    assert ((machine.scores(pa.array(texts[2500:])) >= 0.5) == label[2500:]).mean() > 0.9


def test_held_out_accuracy_and_split(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = X.op5_toxicity(spark, sf).collect()
    assert len(got) == 1000
    right, held = 0, 0
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.held_out and r.doc_id in labels:
            held += 1
            right += r.predicted == labels[r.doc_id]
    assert held > 50 and right / held > 0.9


def test_nulls_and_missing_classes(spark):
    df = spark.createDataFrame([(1, None, 3), (None, "", 4), (2, "ok then", 5)], "doc_id long, text string, score int")
    none = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    machine = X.fit(df, none)
    out = X.toxicity(df, machine).collect()
    assert len(out) == 3 and all(r.score < 0.01 for r in out)
    assert X.toxicity(df.limit(0), machine).count() == 0


def test_scores_do_not_depend_on_labels_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql import functions as F

    other = labels.withColumn("toxic", F.when(X.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = X.fit(documents, labels), X.fit(documents, other)
    assert a.b == b.b and (a.w == b.w).all()


def test_scores_equal_brute_force():
    """Every pair of terms, summed one by one."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(25)]
    texts = pa.array([None, "", *[" ".join(rng.choice(words, 8)) for _ in range(300)]])
    label = np.array([int("w3" in str(t).split() and "w7" in str(t).split()) for t in texts.to_pylist()])
    row, bucket = X.terms(texts)
    machine = X.train(row, bucket, label)
    machine.v[:] = rng.normal(0, 0.3, machine.v.shape)
    got = machine.scores(texts)
    for i in range(0, len(texts), 7):
        at = [machine.place[b] for b in bucket[row == i] if machine.place[b] >= 0]
        z = machine.b + sum(machine.w[a] for a in at) + sum(machine.v[a] @ machine.v[b] for k, a in enumerate(at) for b in at[:k])
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9


def test_very_long_and_repeated_texts(spark):
    long = "fine words " * 300_000
    df = spark.createDataFrame([(1, long), (1, long), (2, "fine words")], "doc_id long, text string")
    machine = X.train(*X.terms(pa.array(["bad thing", "fine words"] * 40)), np.array([1, 0] * 40))
    scores = [r.score for r in X.toxicity(df, machine).collect()]
    assert len(set(scores)) == 1 and scores[0] < 0.3
