"""Scans with contracts: pruned, whitelisted, and of text formats with stated error behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pruned(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that the source has, in the order wanted."""
    have = set(df.columns)
    return df.select(*[c for c in wanted if c in have])


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` if it has every column; else ValueError naming those it lacks."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def whitelisted(df: DataFrame, allowed: list[str]) -> DataFrame:
    """Only the allowed columns, all of which must exist: what is not listed cannot reach a later step."""
    return required(df, allowed).select(*allowed)


def tsv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema, multiLine=True, escape='"')


def image_count(c: str):
    """Number of images in a stringified list, without decoding it."""
    return F.regexp_count(F.col(c), F.lit(r"',\s*'")) + 1


def contract_csv(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """A CSV of strings whose header must be ``header``; a byte-order mark and blank rows are skipped."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if df.columns != header:
        raise ValueError(f"header is {df.columns}, not {header}")
    blank = F.lit(True)
    for c in header:
        blank &= F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    return df.where(~blank)


def jsonl(spark: SparkSession, path: str, schema: T.StructType, corrupt: str = "skip") -> DataFrame:
    """JSON lines, blank ones skipped; corrupt ones are skipped or, with ``corrupt='fail'``, end the job."""
    if corrupt == "fail":
        return spark.read.json(path, schema=schema, mode="FAILFAST")
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", wide, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return rows.where("r._corrupt_record IS NULL").select("r.*").drop("_corrupt_record")


def json_documents(spark: SparkSession, path: str, schema: T.StructType, key: list[str]) -> DataFrame:
    """A folder of JSON documents, one per key; a key met twice is an error."""
    df = spark.read.json(path, schema=schema, multiLine=True)
    twice = df.groupBy(*key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate key: {twice[0].asDict()}")
    return df


def image_suffix(c: str):
    """``.png`` for data with the PNG signature, else ``.jpg``."""
    return F.when(F.substring(F.hex(F.col(c)), 1, 8) == "89504E47", ".png").otherwise(".jpg")


def cache_lookup(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """Entries of a content-addressed cache for ``keys``; with the prefix column, its folders are pruned."""
    return keys.withColumn("prefix", F.substring("key", 1, 2)).join(cache, ["prefix", "key"], "left")


def typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header and a stated schema; an empty field is null, and a cell of another type is an error."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)
