"""The registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrag.llm import audio, digest, htmltree, infill, langid, mixing, packing, partenum, quality, resample, secretscan, sharding, topk
from sparkrag.llm.common import documents
from sparkrag.shipping import ship


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(ship(spark), sf_dir)
    return quality.grade(docs, quality.fit(docs, documents(spark, sf_dir, "labels")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(documents(ship(spark), sf_dir), tokenizer_path()))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(ship(spark), sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(ship(spark), sf_dir), documents(spark, sf_dir, "labels"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.classes(documents(ship(spark), sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_query(documents(ship(spark), sf_dir))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.with_edits(documents(ship(spark), sf_dir))


def op8_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.text_media(documents(ship(spark), sf_dir))


def op9_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltree.extract_pages(documents(ship(spark), sf_dir, "pages"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.find_secrets(documents(ship(spark), sf_dir))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(documents(ship(spark), sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(infill.infill(documents(ship(spark), sf_dir)))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(ship(spark), sf_dir), documents(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_packing, op3_langid, op4_mixing, op5_jaccard_join, op6_sharding, op7_fingerprint, op8_audio, op9_extraction, op10_secrets, op11_topk, op12_infill, op13_resample)}

# The methods of the other operators (fits, hashes of other kinds, tokenizers) have no SQL form; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op5_jaccard_join": partenum.SQL, "op11_topk": topk.SQL, "op12_infill": infill.SQL, "op13_resample": resample.SQL}
