"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, crf, hosts, mih, mix, oracles, packing, pq, segments, shard, toxic
from .simhash import simhash_groups
from .suffix import repeats_removed


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(_table(spark, sf_dir, "documents"), radius=3, width=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_copies(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op2_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op3_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxic.score(docs, toxic.fit(docs, _table(spark, sf_dir, "labels")))


def op4_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.digest(_table(spark, sf_dir, "documents"), shards=24)


def op5_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return mih.search(rows, rows.filter(F.col("vec_id") % 20 == 0), k=20)


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_removed(_table(spark, sf_dir, "documents"), length=100)


def op7_pivotal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix.copies(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return crf.quality(docs, crf.fit(docs, _table(spark, sf_dir, "labels")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), columns=("n_tokens", "ids_sha256", "decoded_sha256"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.coded(_table(spark, sf_dir, "embeddings"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


QUERIES = {"op1_pq": op1_pq, "op2_hosts": op2_hosts, "op3_chain": op3_chain, "op4_histogram": op4_histogram, "op5_mih": op5_mih, "op6_suffix": op6_suffix, "op7_pivotal": op7_pivotal, "op8_crf": op8_crf, "op9_simhash": op9_simhash, "op10_bpe": op10_bpe, "op11_phrases": op11_phrases, "op12_segments": op12_segments, "op13_packing": op13_packing}
ORACLE = {
    "op2_hosts": hosts.ORACLE,
    "op6_suffix": oracles.REPEATS,
    "op9_simhash": oracles.SIMHASH,
    "op11_phrases": collocations.ORACLE,
    "op12_segments": segments.ORACLE,
    "op1_pq": """
        WITH RECURSIVE usable AS (
          SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
        reach(node, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a)
        SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
        FROM embeddings e JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) c ON e.vec_id = c.node
    """,
}
