import zlib

import numpy as np
import pytest

from runmosaic.llm import logistic, queries, toxicity

SF = "/root/testdata/sf0.1"


def auc(score, label):
    pos, neg = score[label == 1], score[label == 0]
    return np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))


def test_held_out_rows(spark):
    """Whole documents, labels of every fifth id never seen."""
    got = {r.doc_id: r for r in queries.QUERIES["op5_counterfactual_toxicity"](spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in got.items())
    held = [(got[r.doc_id].score, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic is not None and got[r.doc_id].held_out]
    score, label = np.array([s for s, _ in held]), np.array([t for _, t in held])
    assert auc(score, label) > 0.97
    assert np.mean((score >= 0.5) == label) > 0.96 and np.mean(score[label == 0] >= 0.5) < 0.01


def sample(spark):
    """Insults make a text toxic; one group is named in most of the toxic texts."""
    g = np.random.default_rng(4)
    rows = []
    for i in range(1500):
        words = [f"w{g.integers(200)}".replace("0", "a").translate(str.maketrans("123456789", "bcdefghij")) for _ in range(12)]
        toxic = i % 5 == 0
        if toxic:
            words += ["scum"] * (i % 10 == 0) + ["muslims"] * (g.random() < 0.8)
        else:
            words += ["muslims"] * (g.random() < 0.02) + ["christians"] * (g.random() < 0.05)
        rows.append((" ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "text string, y int")


def test_penalty_closes_the_gap_between_groups(spark):
    df = sample(spark)
    gap = {}
    for penalty in (0.0, 50.0):
        m = toxicity.train(df, penalty=penalty)
        gap[penalty] = abs(m.score("the muslims of the town", {}) - m.score("the christians of the town", {}))
    assert gap[0.0] > 0.3 and gap[50.0] < 0.1


def test_neutral_mentions_stay_clean(spark):
    m = toxicity.train(sample(spark), penalty=50.0)
    assert m.score("scum scum", {}) > 0.5 > m.score("the christians of the town", {})


def test_gradient_matches_differences():
    rows, l, r = logistic.Rows([[0, 2], [1], []]), logistic.Rows([[0], [1, 2]]), logistic.Rows([[1], [2]])
    w = np.array([0.3, -0.2, 0.5])
    assert np.allclose(rows.times(w), [0.8, -0.2, 0]) and np.allclose(l.times(w) - r.times(w), [0.5, -0.2])
    assert np.allclose(rows.back(np.array([1.0, 2.0, 3.0]), 3), [1, 2, 1])


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(None, 1), (1, None)]])
def test_without_labels_of_both_classes(spark, labels):
    df = spark.createDataFrame([(1, "x", "a", 1.0), (2, None, "b", 2.0), (2, None, "b", 2.0), (None, "", None, None)], "doc_id bigint, text string, y string, score double")
    got = toxicity.toxicity_report(df, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert len(got) == 4 and all(r.score == 0 and r.predicted == 0 for r in got)


def test_odd_rows(spark):
    docs = [(i, ("good words here " if i % 2 else "scum words here ") * 3) for i in range(60)] + [(100, None), (101, ""), (102, "scum " * 100_000), (7, "good"), (None, "scum")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, y string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(5, 0)], "doc_id bigint, toxic int")
    got = toxicity.toxicity_report(df, labels).collect()
    assert len(got) == len(docs) and all(r.predicted == 1 for r in got if r.doc_id in (102, None))
    assert toxicity.toxicity_report(df.limit(0), labels).count() == 0
