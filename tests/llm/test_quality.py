import zlib

import numpy as np
import pandas as pd
import pytest

from runmosaic.llm import quality, queries

SF = "/root/testdata/sf0.1"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, row string"


def test_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op7_co_trained_quality"](spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in got.items())
    held = [(got[r.doc_id].score, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None and got[r.doc_id].held_out]
    s, y = np.array([a for a, _ in held]), np.array([b for _, b in held])
    assert np.mean((s >= 0.5) == y) > 0.98 and np.mean(s[y == 1] < 0.5) < 0.01 and np.mean(s[y == 0] < 0.5) > 0.95


def table(n, g, informative=True):
    """Good pages end their sentences; the source says so too when it is informative."""
    y = (g.random(n) < 0.7).astype(float)
    facts = np.column_stack([np.where(y == 1, 1.0, -1.0) + g.normal(0, 1.3, n), *g.normal(size=(13, n))])
    source = np.where(g.random(n) < (0.97 if informative else 0.5), y, 1 - y).astype(int).astype(str)
    return facts, pd.DataFrame({"lang": "en", "source": source, "n_chars": 100.0}), y


@pytest.mark.parametrize("informative", [True, False])
def test_views_teach_each_other_only_what_they_are_sure_of(informative):
    g = np.random.default_rng(3)
    facts, meta, truth = table(6000, g, informative)
    y = np.where(np.arange(6000) < 160, truth, np.nan)
    held = np.arange(6000) % 4 == 0
    model, given = quality.co_train(facts, meta, y, held)
    alone, _ = quality.co_train(facts, meta, y, held, rounds=0)
    test_facts, test_meta, test_y = table(4000, g, informative)
    right = lambda m: np.mean((m.score(test_facts, test_meta) >= 0.5) == test_y)
    assert right(model) >= right(alone) - 0.02
    if informative:
        assert given > 500 and right(model) > 0.9
    meta_given = quality.sigmoid(model.meta.logit(model.meta.view.active(meta)))
    assert informative or meta_given.max() < quality.CONFIDENT


def test_scores_are_calibrated():
    g = np.random.default_rng(8)
    facts, meta, truth = table(6000, g)
    model, _ = quality.co_train(facts, meta, np.where(np.arange(6000) < 3000, truth, np.nan), np.arange(6000) % 4 == 0)
    s = model.score(facts[3000:], meta[3000:])
    for lo, hi in ((0, 0.2), (0.8, 1.01)):
        part = (s >= lo) & (s < hi)
        assert abs(s[part].mean() - truth[3000:][part].mean()) < 0.05


def odd(spark):
    good = [(i, f"Line {i} ends well.\nAnother one follows here.", "en", "a", 40) for i in range(120)]
    bad = [(i, "junk### junk$$$ junk%%% junk&&& " * 3, "en", "b", 90) for i in range(200, 260)]
    rest = [(900, None, None, None, None), (901, "", "", "", 0), (902, "well said. " * 30_000, "xx", "new", -5), (902, "well said.", "xx", "new", 10), (None, "junk### " * 20, "en", None, 1)]
    return good + bad + rest, spark.createDataFrame([(*r, 1.0, "x") for r in good + bad + rest], DOCS)


def test_odd_rows(spark):
    rows, df = odd(spark)
    labels = spark.createDataFrame([(i, int(i < 200)) for i in (*range(120), *range(200, 260))] + [(None, 1), (3, None), (900, None)], "doc_id bigint, quality int")
    got = quality.quality_report(df, labels).collect()
    assert len(got) == len(rows) and all(r.predicted == (r.doc_id < 200) for r in got if r.doc_id is not None and r.doc_id < 300)
    kept = quality.kept_documents(df, labels)
    assert kept.schema.simpleString() == df.schema.simpleString()
    assert {r.doc_id for r in kept.collect()} >= set(range(120)) and not {r.doc_id for r in kept.collect()} & set(range(200, 260))
    assert quality.quality_report(df.limit(0), labels).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)]])
def test_without_labels_of_both_classes_all_stay(spark, labels):
    rows, df = odd(spark)
    assert quality.kept_documents(df, spark.createDataFrame(labels, "doc_id bigint, quality int")).count() == len(rows)
