"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontam, factormachine, filteraudit, langid, linededup, minhash, mixing, quality, rlz, runindex, sharding, tokencount, veccodes

#: The production vocabulary, a file of the machine; pass another path to use another.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.digest(_docs(spark, sf_dir))


def op2_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.digest(_docs(spark, sf_dir))


def op3_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir))


def op4_rlz_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.digest(_docs(spark, sf_dir))


def op5_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.cross_checked(_docs(spark, sf_dir))


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_docs(spark, sf_dir))


def op7_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.dedup_lines(_docs(spark, sf_dir)))


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(_docs(spark, sf_dir))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return tokencount.count_tokens(_docs(spark, sf_dir), tokencount.load(vocabulary))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccodes.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factormachine.cross_checked(_docs(spark, sf_dir), _labels(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash, op2_run_index, op3_cube_mix, op4_rlz_substrings, op5_nearest_centroid,
        op6_virtual_slots, op7_line_runs, op8_quality_cascade, op9_decontaminate, op10_token_counts,
        op11_filter_audit, op12_vector_codes, op13_factorisation_machine,
    )
}
