"""The registered queries of this package, each over its whole tables, and the same results in SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from datalathe.llm import (
    bitsliced, bpe, chat, codebooks, gam, lexical, licenses, packing, repetition, sharding, simhash, vptree, warc,
)
from datalathe.llm.common import table
from datalathe.llm.oracles import ORACLES
from datalathe.session import fresh_path

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("DATALATHE_TOKENIZERS", "/opt/tokenizers")


def byte_bpe() -> str:
    return os.path.join(TOKENIZERS, "byte_bpe_50k.json")


def op1_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.documents(table(spark, sf_dir, "documents"), shards=8)


def op2_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    archives = warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(archives, folder).drop("url")


def op3_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return bitsliced.top_k(rows, rows.where("vec_id % 100 = 0"))


def op4_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), byte_bpe())


def op7_chat_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(table(spark, sf_dir, "conversations").unionByName(chat.probe(spark)))


def op8_deficit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe())


def op9_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vptree.nearest(rows, rows.where("vec_id % 20 = 0"))


def op12_adaptive_bound_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.encode(table(spark, sf_dir, "embeddings"))


def op13_automaton_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


__all__ = ["ORACLES", "QUERIES", "byte_bpe"]

QUERIES = {
    "op1_bounded_ring": op1_bounded_ring,
    "op2_dictionary_warc": op2_dictionary_warc,
    "op3_bit_sliced_top_k": op3_bit_sliced_top_k,
    "op4_repetition_rules": op4_repetition_rules,
    "op5_license_scan": op5_license_scan,
    "op6_forced_boundary_bpe": op6_forced_boundary_bpe,
    "op7_chat_machine": op7_chat_machine,
    "op8_deficit_packing": op8_deficit_packing,
    "op9_golay_simhash": op9_golay_simhash,
    "op10_additive_quality": op10_additive_quality,
    "op11_vantage_point_trees": op11_vantage_point_trees,
    "op12_adaptive_bound_codes": op12_adaptive_bound_codes,
    "op13_automaton_search": op13_automaton_search,
}
