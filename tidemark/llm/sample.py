"""The bounded sample of labelled documents that a model is fitted on: rows are left out, texts never cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

BYTES = 24_000_000


def labelled_texts(docs: DataFrame, named: DataFrame, per_class: int, most_bytes: int = BYTES) -> DataFrame:
    """(__text, __label) of documents of ``named`` (__id, __label): whole texts, in the order of a hash of the id, of each class
    at most ``per_class`` and as many as ``most_bytes`` of text hold (a text that is longer by itself is passed over).

    Of several texts of an id the smallest counts, a null one is empty.
    """
    scratch = Scratch(docs.sparkSession, "sample")
    order = F.xxhash64("__id")
    picked = [named.filter(F.col("__label") == k).orderBy(order, "__id").limit(per_class) for k in (0, 1)]
    sample = F.broadcast(picked[0].union(picked[1]))  # at most 2 x per_class rows
    found = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("__text")).join(sample, "__id")
    found = found.groupBy("__id").agg(F.min(F.coalesce("__text", F.lit(""))).alias("__text"), F.min("__label").alias("__label"))
    found = scratch.keep(found)
    size = found.select("__id", "__label", F.octet_length("__text").alias("n")).filter(F.col("n") <= most_bytes)
    upto = F.sum("n").over(Window.partitionBy("__label").orderBy(order, "__id").rowsBetween(Window.unboundedPreceding, 0))
    fits = size.withColumn("upto", upto).filter(F.col("upto") <= most_bytes).select("__id")
    return found.join(F.broadcast(fits), "__id", "left_semi").select("__text", F.col("__label").cast("int").alias("__label"))
