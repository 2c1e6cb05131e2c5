import re

import pytest

import corpus_pipeline
from test_mixing import check as check_mix
from test_near_copies import brute_kept

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's result on disk, read again as the next one's documents."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"file://{folder}/{k}")
        before, docs = docs, spark.read.parquet(f"file://{folder}/{k}")
        out.append((name, before, docs))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_names_and_columns(stages):
    assert [n for n, _, _ in stages] == ["quality", "exact dedup", "near dedup", "mixing", "packing"]
    assert all(after.columns == COLUMNS for _, _, after in stages[:-1])


def test_quality_keeps_what_is_labelled_good(spark, stages):
    _, before, after = stages[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(ids(before)) - set(ids(after))
    assert gone and sum(labels.get(d) == 1 for d in gone) <= 0.05 * sum(q == 1 for q in labels.values())


def test_one_of_each_group_of_copies(stages):
    _, before, after = stages[1]
    first = {}
    for r in sorted(before.collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r)
    assert sorted(map(tuple, first.values())) == sorted(map(tuple, after.collect()))


def test_one_of_each_near_group(stages):
    _, before, after = stages[2]
    assert ids(after) == brute_kept({r.doc_id: r.text for r in before.collect()})


def test_mix_takes_whole_documents(stages):
    _, before, after = stages[3]
    rows = {r.doc_id: r for r in before.collect()}
    count = {d: 0 for d in rows}
    for r in after.collect():
        assert r == rows[r.doc_id]
        count[r.doc_id] += 1
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for d, r in rows.items()}
    total = {}
    for d, r in rows.items():
        total[r.source] = total.get(r.source, 0) + size[d]

    class Row(dict):
        __getattr__ = dict.get

    from test_mixing import brute_targets
    t = brute_targets(total)
    check_mix([Row(doc_id=d, size=size[d], source_size=total[r.source], target=t[r.source], taken=count[d] * size[d]) for d, r in rows.items()],
              [(d, r.text, r.source) for d, r in rows.items()], 0.05)


def test_packing_holds_every_copy(stages):
    _, before, after = stages[4]
    rows, copies = after.collect(), ids(before)
    seen, once = {}, []
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        seen[(r.doc_id, r.piece)] = seen.get((r.doc_id, r.piece), 0) + 1
        if seen[(r.doc_id, r.piece)] == 1:
            once.append(r)
    assert all(n == copies.count(d) for (d, _), n in seen.items())
    texts = {r.doc_id: r.text for r in before.collect()}
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        assert sum(n for _, n in parts) == max(o + n for o, n in parts) <= 1024 and len({o for o, _ in parts}) == len(parts)
    assert {r.doc_id for r in once} == set(texts)
    assert len(by_seq) <= 1.03 * -(-sum(r.length for r in rows) // 1024) + 1


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages[4][2].columns and got.count() == stages[4][2].count()


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def through(spark, docs, folder):
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, SF).write.parquet(f"file://{folder}/{k}")
        docs = spark.read.parquet(f"file://{folder}/{k}")
    return docs


def test_empty_table(spark, tmp_path):
    assert through(spark, spark.createDataFrame([], DOCS), tmp_path).count() == 0


def test_null_texts_and_repeated_ids(spark, tmp_path):
    """Rows whose id, text, language or source is null or repeats go through all stages."""
    some = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", None, None, 0), (7, None, "en", None, None), (7, "some words " * 30, None, "x", 330)], DOCS)
    out = through(spark, some.unionByName(odd).unionByName(some.limit(5)), tmp_path)
    assert out.count() > 0 and out.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 1024").isEmpty()


def test_tables_of_a_stage_go(spark, tmp_path):
    from runmosaic.llm import common
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    common.drop_tables(spark)
    corpus_pipeline.without_copies(spark, docs, SF).write.parquet(f"file://{tmp_path}/a")
    left = [p.removeprefix("file://") for p in common._tables]
    assert left and all(__import__("os").path.exists(p) for p in left)
    corpus_pipeline.without_near_copies(spark, spark.read.parquet(f"file://{tmp_path}/a"), SF)
    assert not any(__import__("os").path.exists(p) for p in left)
