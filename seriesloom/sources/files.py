"""Flat-file sources and sinks with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.numeric import declared_decimals
from seriesloom.functions.text import fetchable, segments_map

ESTIMATE_COLUMNS = ["product", "estimate_type", "value", "currency", "geography", "revenue_scope", "as_of_date", "source_url"]
CITABLE = ["consensus", "modeled", "management"]


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated text with a header, every column a string; malformed lines keep what can be read."""
    raw = spark.read.csv(path, sep="\t", header=True, mode="PERMISSIVE", quote="")
    have = {c.lower(): c for c in raw.columns}
    return raw.select(*[F.col(f"`{have[c]}`").alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns])


def submissions(raw: DataFrame, ciks: list[int] | None = None, forms: list[str] | None = None) -> DataFrame:
    """Submissions of the wanted filers and forms; a filer number that is none drops the row."""
    s = raw.select("adsh", F.col("cik").try_cast("bigint").alias("cik"), F.trim("name").alias("name"), F.trim("form").alias("form"), "period", "filed").filter("cik is not null")
    if ciks is not None:
        s = s.filter(F.col("cik").isin(ciks))
    return s if forms is None else s.filter(F.col("form").isin(forms))


def period_bounds(ddate, quarters):
    """(start, end) of a fact from its end day and number of quarters; no start for an instant."""
    end = F.try_to_date(ddate, "yyyyMMdd")
    return F.when(quarters > 0, F.trunc(F.add_months(end, -(quarters * 3 - 1)), "month")), end


def bulk_facts(num: DataFrame, subs: DataFrame, dims: DataFrame) -> DataFrame:
    """Facts of the wanted submissions with their members: a semi-join, then a left look-up of the dimension.

    Submissions bound the facts, so they are filtered before anything else; a
    missing dimension is an empty map, a value or span that is no number drops the fact.
    """
    start, end = period_bounds(F.col("ddate"), F.col("n"))
    f = num.join(subs.select("adsh").distinct(), "adsh", "left_semi").join(dims.select(F.col("dimhash").alias("dimh"), "segments"), "dimh", "left")
    f = f.withColumn("v", F.col("value").try_cast("double")).withColumn("n", F.coalesce(F.col("qtrs").try_cast("int"), F.lit(0))).filter("v is not null")
    space = F.substring_index(F.col("version"), "/", 1)
    return f.select("adsh", F.concat_ws(":", F.nullif(space, F.lit("")), F.col("tag")).alias("element"), F.col("v").alias("value"), segments_map(F.col("segments")).alias("members"), start.alias("start"), end.alias("end"), F.nullif(F.trim("uom"), F.lit("")).alias("unit"), declared_decimals(F.col("dcml")).alias("decimals"))


def check_estimates(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with the problem) of a file of cited peak estimates; all columns are required."""
    missing = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"missing_{c}")) for c in ESTIMATE_COLUMNS]
    problem = F.coalesce(
        *missing, F.when(~F.col("estimate_type").isin(CITABLE), "estimate_type_not_citable"), F.when(F.col("value").try_cast("double").isNull(), "value_not_a_number"),
        F.when(F.try_to_date("as_of_date", "yyyy-MM-dd").isNull(), "date_not_iso"), F.when(~fetchable(F.col("source_url")), "source_url_not_fetchable"),
    )
    r = raw.select(*ESTIMATE_COLUMNS, problem.alias("problem"))
    ok = r.filter("problem is null").select(*[c for c in ESTIMATE_COLUMNS if c not in ("value", "as_of_date")], F.col("value").cast("double").alias("value"), F.to_date("as_of_date").alias("as_of_date"))
    return ok, r.filter("problem is not null")


def read_drugs(raw: DataFrame) -> DataFrame:
    """Requested products; the name may stand under any of its usual headers."""
    have = {c.lstrip("﻿").strip().lower(): c for c in raw.columns}
    col = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(f"`{have[n]}`")), F.lit("")) for n in names if n in have], F.lit(None).cast("string"))
    return raw.select(col("drug_name", "drug", "product", "name").alias("drug_name"), col("generic_name").alias("generic_name"), col("manufacturer").alias("manufacturer"), col("ticker").alias("ticker"), col("indication").alias("indication")).filter("drug_name is not null")


def read_register(raw: DataFrame, floor: float = 0.0) -> DataFrame:
    """Decisions by (issuer, member) or element, above a floor of confidence; the last line of a key counts."""
    return raw.filter(F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)) >= floor)


def product_list(raw: DataFrame, column: str) -> DataFrame:
    return raw.select(F.trim(column).alias("product")).filter("product != ''").distinct().orderBy("product")


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """All quarterly manifests of a folder under one schema, each row with its file's stem, joined to the stem's metadata where there is any."""
    rows = spark.read.csv(f"{folder}/*_quarterly.csv", header=True, enforceSchema=False)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)_quarterly\.csv$", 1)
    rows = rows.withColumn("stem", stem)
    meta = spark.read.json(f"{folder}/*.meta.json", multiLine=True).withColumn("meta_stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.meta\.json$", 1))
    return rows.join(meta.select(F.col("meta_stem").alias("stem"), F.struct(*[c for c in meta.columns if c != "meta_stem"]).alias("meta")), "stem", "left")


def write_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV parts; lists are joined, maps and structs written as JSON."""
    flat = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        flat.append(F.array_join(F.col(f.name).cast("array<string>"), ", ").alias(f.name) if kind == "array" else F.to_json(f.name).alias(f.name) if kind in ("map", "struct") else F.col(f.name))
    df.select(*flat).write.mode("overwrite").csv(path, header=True)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with the keys in order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)
