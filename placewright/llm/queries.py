"""Registered queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placewright.llm import sql
from placewright.llm.bpe import encode_decode
from placewright.llm.common import table
from placewright.llm.exact_dedup import exact_duplicates
from placewright.llm.hamming_index import nearest
from placewright.llm.html_text import extract
from placewright.llm.importance import resample
from placewright.llm.jaccard_join import linked_components
from placewright.llm.license_scan import scan
from placewright.llm.line_dedup import duplicate_lines
from placewright.llm.packing import pack
from placewright.llm.quality import score
from placewright.llm.ranked_search import search
from placewright.llm.repeats import repeated_passages
from placewright.llm.token_counts import count_tokens


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_lines(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), "word_bpe_49k.json", digests=True)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_packing, op3_quality, op4_nearest, op5_html_text, op6_bpe, op7_jaccard_join, op8_repeated_passages, op9_exact_dedup, op10_token_counts, op11_resampling, op12_ranked_search, op13_license_scan)}

SQL = {"op9_exact_dedup": sql.EXACT_DEDUP, "op11_resampling": sql.RESAMPLING, "op12_ranked_search": sql.RANKED_SEARCH, "op13_license_scan": sql.license_scan()}
