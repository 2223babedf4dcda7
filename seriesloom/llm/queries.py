"""Queries of the text and linkage problems over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import leakage, names, packing, spans, survivors
from seriesloom.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "drug_jobs")
    products = names.variant_pairs(names.product_classes(jobs, table(spark, d, "datapoints")), "product")
    return products.unionByName(names.variant_pairs(names.company_classes(jobs), "manufacturer"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every string with the class of strings it belongs to."""
    jobs = table(spark, d, "drug_jobs")
    products = names.product_classes(jobs, table(spark, d, "datapoints")).select(F.lit("product").alias("kind"), "name", "class")
    return products.unionByName(names.company_classes(jobs).select(F.lit("manufacturer").alias("kind"), "name", "class"))


def _survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(survivors.readings(table(spark, d, "datapoints"), table(spark, d, "source_documents"), table(spark, d, "drug_jobs")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d).filter("n_readings >= 2").select("datapoint_id")


def p6_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One record per figure, built field by field."""
    return _survivors(spark, d)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that have to be split: those whose pieces lie in more than one container."""
    packed = packing.pack_documents(table(spark, d, "documents"))
    return packed.groupBy("doc_id").agg(F.min("container").alias("a"), F.max("container").alias("b")).filter("a < b").select("doc_id")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every text or piece."""
    return packing.pack_documents(table(spark, d, "documents"))


def p8_totals(spark: SparkSession, d: str) -> DataFrame:
    """What the containers hold, how many are overfull, and whether they are within two percent (or three) of the least number that could do."""
    packed = packing.pack_documents(table(spark, d, "documents"))
    filled = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("items"), F.count_if(F.col("piece") == 1).alias("documents"))
    total = filled.agg(F.sum("documents").alias("documents"), F.sum("items").alias("pieces"), F.sum("n").alias("tokens"), F.count("*").alias("containers"), F.count_if(F.col("n") > packing.CAPACITY).alias("overfull"))
    least = F.ceil(F.col("tokens") / packing.CAPACITY)
    return total.select("documents", "pieces", "tokens", least.alias("least_containers"), F.col("overfull").cast("int").alias("overfull"), (F.col("containers") <= F.greatest(least * 1.02, least + 3)).alias("within_two_percent"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each contaminated document with the items it contains."""
    return p9_found(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.count("*").alias("n_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_pairs(spans.shared_windows(table(spark, d, "documents")))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """Which documents share some stretch with the same set of documents: one row per class and member."""
    return spans.sharing_classes(spans.shared_windows(table(spark, d, "documents"))).select(F.col("class").alias("class_id"), F.col("n").alias("n_members"), F.col("doc").alias("doc_id"))


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each document with shared stretches: how many, how much of it they cover, and the longest.

    The texts of one ``doc_id`` count together, repeated ones once.
    """
    shared = spans.shared_windows(table(spark, d, "documents"))
    runs = spans.stretches(shared).groupBy("doc")
    runs = runs.agg(F.count("*").alias("n_stretches"), F.sum(F.col("end") - F.col("begin")).alias("shared_chars"), F.max(F.col("end") - F.col("begin")).cast("long").alias("longest"))
    sized = spans.texts_of(table(spark, d, "documents"), 0).groupBy("doc", "ver").agg(F.max(F.length("text")).alias("n")).groupBy("doc").agg(F.sum("n").alias("n_chars"))
    return runs.join(sized, "doc").withColumn("share", F.col("shared_chars") / F.col("n_chars")).withColumnRenamed("doc", "doc_id")


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    """Each document with the longest doubling level at which it still shares a window."""
    return spans.levels(table(spark, d, "documents")).withColumnRenamed("doc", "doc_id")


QUERIES = {f.__name__: f for f in (p3_found, p3_classes, p6_found, p6_survivors, p8_found, p8_containers, p8_totals, p9_found, p9_documents, p10_found, p10_classes, p10_documents, p10_levels)}
