"""The registered queries of this subpackage, each over its whole tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sessionloom.llm import decontaminate, minimax, mixing, pii, quality_knn, simhash, spelling, super_kmers, token_codes, toxic_crf, vptree, warc, whitening
from sessionloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


@query
def op1_toxic_crf(spark, d):
    return toxic_crf.toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op2_simhash_near_dedup(spark, d):
    rows = simhash.near_duplicates(table(spark, d, "documents"))
    return rows.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


@query
def op3_decontaminate(spark, d):
    return decontaminate.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def op4_pii_bootstrapped(spark, d):
    return pii.personal_data(table(spark, d, "documents"))


@query
def op5_minimax_sharding(spark, d):
    rows = minimax.sharded(table(spark, d, "documents"))
    return rows.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@query
def op6_vantage_point_trees(spark, d):
    return vptree.nearest_neighbours(table(spark, d, "embeddings"))


@query
def op7_warc(spark, d):
    return warc.archived_pages(table(spark, d, "pages"))


@query
def op8_quality_knn(spark, d):
    return quality_knn.quality(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op9_mixing(spark, d):
    return mixing.mix_plan(table(spark, d, "documents"))


@query
def op10_token_codes(spark, d):
    return token_codes.coded_documents(table(spark, d, "documents"))


@query
def op11_super_kmers(spark, d):
    rows = super_kmers.without_repeats(table(spark, d, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op12_spelling_variants(spark, d):
    return spelling.spelling_groups(table(spark, d, "documents"))


@query
def op13_whitening(spark, d):
    return whitening.whitened(table(spark, d, "embeddings"))
