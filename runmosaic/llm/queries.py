"""The corpus operators over whole tables, each as one registered query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runmosaic.llm import ann, exact_dedup, lattice, merkle, mixing, packing, pii, quality, sharding, simhash, token_files, toxicity, whitening
from runmosaic.llm.common import documents
from runmosaic.plans.registry import registry

QUERIES, ORACLE, query = registry()


@query("op1_virtual_slot_shards")
def _(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.shard_documents(documents(spark, sf), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").cast("bigint").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


@query("op2_best_fit_packing")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf))


@query("op3_exact_dedup", """
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
    WINDOW g AS (PARTITION BY t)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.dedup_report(documents(spark, sf))


@query("op4_simhash_pivots")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_report(documents(spark, sf))


@query("op5_counterfactual_toxicity")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity_report(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@query("op6_validated_pii")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return pii.pii_report(documents(spark, sf))


@query("op7_co_trained_quality")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_report(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@query("op8_flow_mixing")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf))


@query("op9_cross_polytope_search")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


@query("op10_lattice_likelihood")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return lattice.lm_report(documents(spark, sf))


# a checksum of the id, bit by bit, since the engine has none
CRC = """xor(4294967295, list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))))"""


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


_LINE = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
_BENT = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "(n_chars + 1)", "text"))


@query("op11_merkle_manifest", f"""
    WITH RECURSIVE leaves AS (
        SELECT doc_id, sha256({_LINE}) AS leaf, CASE WHEN {CRC} % 7 = 0 AND n_chars IS NOT NULL THEN sha256({_BENT}) END AS bent,
               coalesce('=' || lang, '') AS tree FROM documents),
    placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS r FROM leaves),
    nodes(tree, lv, i, d, n) AS (
        SELECT tree, 0, i, leaf, count(*) OVER (PARTITION BY tree) FROM placed
        UNION ALL
        SELECT tree, lv + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, lv, i // 2),
    subroots AS (SELECT tree, d, row_number() OVER (ORDER BY tree) - 1 AS i FROM nodes WHERE n = 1),
    tops(lv, i, d, n) AS (
        SELECT 0, i, d, count(*) OVER () FROM subroots
        UNION ALL
        SELECT lv + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM tops WHERE n > 1 GROUP BY lv, i // 2),
    steps AS (
        SELECT p.r, n.lv, s.d AS sibling, s.i < n.i AS before
        FROM placed p JOIN nodes n ON n.tree = p.tree AND n.i = p.i >> n.lv AND n.n > 1
        LEFT JOIN nodes s ON s.tree = n.tree AND s.lv = n.lv AND s.i = xor(n.i, 1)
        UNION ALL
        SELECT p.r, 1000 + n.lv, s.d, s.i < n.i
        FROM placed p JOIN subroots t ON t.tree = p.tree JOIN tops n ON n.i = t.i >> n.lv AND n.n > 1
        LEFT JOIN tops s ON s.lv = n.lv AND s.i = xor(n.i, 1)),
    paths AS (
        SELECT p.r, coalesce(string_agg(sibling, '' ORDER BY lv), '') AS proof, list({{'s': coalesce(sibling, ''), 'b': coalesce(before, false)}} ORDER BY lv) FILTER (lv IS NOT NULL) AS path
        FROM placed p LEFT JOIN steps USING (r) GROUP BY p.r),
    folds(r, k, acc) AS (
        SELECT r, 0, coalesce(bent, leaf) FROM placed
        UNION ALL
        SELECT r, k + 1, sha256(CASE WHEN path[k + 1].b THEN path[k + 1].s || acc ELSE acc || path[k + 1].s END)
        FROM folds JOIN paths USING (r) WHERE k < coalesce(len(path), 0)),
    ends AS (SELECT r, arg_max(acc, k) AS folded_root FROM folds GROUP BY r)
    SELECT p.doc_id, p.leaf, s.d AS subroot, t.d AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = t.d AS verified
    FROM placed p JOIN subroots s USING (tree) JOIN paths USING (r) JOIN ends USING (r), (SELECT d FROM tops WHERE n = 1) t""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.audit(documents(spark, sf))


@query("op12_bit_sliced_whitening")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf}/embeddings.parquet"))


@query("op13_token_files")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.token_report(documents(spark, sf))
