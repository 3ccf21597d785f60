"""Exact duplicates by skew-safe combining of digest groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import cut_lineage, plain_texts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after lower-casing A-Z. Each stage
    groups by digest *and* text, so equal digests alone never merge rows:

    1. within a map task (partial aggregation), then per (digest, salt), the salt
       being the task's number: a hot group reaches a reducer as one row per task;
    2. the salt winners per digest.

    Members then look their winner up by digest; texts are compared there only
    where one digest stands for several texts.

    Null text counts as empty. Of rows with equal texts the one with the largest
    id stays (nulls are smallest); of rows equal in id and text one stays, so each
    group keeps exactly one row. Empty input gives an empty result.
    """
    rows = plain_texts(docs, id_col, text_col).withColumn("text", F.translate("text", UPPER, LOWER))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    salted = rows.groupBy("digest", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"), "text").agg(F.max("doc_id").alias("top"), F.count("*").alias("n"))
    winners = salted.groupBy("digest", "text").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))
    # Without the text from here on: it is needed again only where one digest has several texts.
    variants = cut_lineage(winners.groupBy("digest").agg(F.count("*").alias("variants"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")))
    # Copies of a whole row differ by a running number only.
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    members = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("copies")).withColumn("copy", each)
    out = members.join(variants.filter("variants = 1"), "digest")
    shared = variants.filter("variants > 1").select("digest")
    if shared.limit(1).count():
        told = rows.join(shared, "digest", "left_semi").groupBy("digest", "text", "doc_id").agg(F.count("*").alias("copies"))
        told = told.withColumn("copy", each).join(winners.join(shared, "digest", "left_semi"), ["digest", "text"])
        out = out.unionByName(told, allowMissingColumns=True)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))
