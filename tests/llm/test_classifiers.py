import random

import numpy as np
from pyspark.sql import functions as F

from stratalog.llm import quality, toxicity
from stratalog.llm.common import crc_mod

from .util import crc, documents, frame, prose


def labelled(spark, bad, good, column, seed=3, n=150):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        one = i % 3 == 0
        rows.append((i, (bad if one else good)(rng), "en", f"s{i % 3}", 0))
        labels.append((i, int(one)))
    rows += [(1000 + i, *r[1:]) for i, r in enumerate(documents(1, 12))]
    return frame(spark, rows), spark.createDataFrame(labels, f"doc_id long, {column} int"), {a: b for a, b in labels}, rows


def insult(rng):
    w = prose(rng, rng.randint(20, 80)).split()
    for _ in range(4):
        w.insert(rng.randrange(len(w)), rng.choice(["worthless", "disgusting", "pathetic"]))
    return " ".join(w)


def accuracy(out, truth, fold, held):
    rows = [r for r in out if r.doc_id in truth and crc(r.doc_id, fold) == held]
    return np.mean([(r.score >= 0.5) == bool(truth[r.doc_id]) for r in rows])


def test_toxicity_held_out(spark):
    docs, labels, truth, rows = labelled(spark, insult, lambda r: prose(r, r.randint(20, 80)), "toxic")
    out = toxicity.toxicity(docs, labels, crc_mod("doc_id", 5) != 0).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert accuracy(out, truth, 5, 0) >= 0.9


def test_quality_held_out(spark):
    docs, labels, truth, rows = labelled(spark, lambda r: " ".join(w + "***" for w in prose(r, r.randint(20, 80)).split()), lambda r: prose(r, r.randint(20, 80)), "quality")
    out = quality.quality(docs, labels, crc_mod("doc_id", 3) != 1).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert accuracy(out, truth, 3, 1) >= 0.95


def test_scores_do_not_depend_on_label_columns(spark):
    docs, labels, _, _ = labelled(spark, insult, lambda r: prose(r, 40), "toxic")
    a = toxicity.toxicity(docs, labels, F.lit(True)).collect()
    b = toxicity.toxicity(docs.withColumns({"lang": F.lit("zz"), "source": F.lit("q"), "score": F.lit(9)}), labels, F.lit(True)).collect()
    assert sorted((r.doc_id, r.score) for r in a if r.doc_id is not None) == sorted((r.doc_id, r.score) for r in b if r.doc_id is not None)


def test_no_labels_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(spark, documents(1, 6))
    assert {r.score for r in quality.quality(docs, none, F.lit(True)).collect()} == {0.5}
    assert {r.score for r in toxicity.toxicity(docs, none, F.lit(True)).collect()} == {0.0}
    assert quality.quality(frame(spark, []), none, F.lit(True)).count() == 0
    assert toxicity.toxicity(frame(spark, []), none, F.lit(True)).count() == 0


def test_moments_equal_numpy(spark):
    docs = frame(spark, documents(2)).where("doc_id is not null")
    rows = quality.statistics_table(docs).withColumn("label", F.lit(1))
    n, mean, cov = quality.moments(rows, "label")[1]
    x = np.array([[r[c] for c in quality.NAMES] for r in rows.collect()])
    assert n == len(x) and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))
