"""Scans: Parquet tables, JSON corpora and score traces, binary pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHAPE = "attention_type string, num_layers int, num_heads int, num_kv_heads int, head_dim int, hidden_size int"
TOKEN = "array<struct<id:string,vector:array<float>>>"
CORPUS = f"shape struct<{SHAPE.replace(' ', ':').replace(',:', ',')}>, tokens {TOKEN}, seed bigint"
MULTI_CORPUS = f"shape struct<{SHAPE.replace(' ', ':').replace(',:', ',')}>, shared_tokens {TOKEN}, agents array<struct<id:string,tokens:{TOKEN}>>, seed bigint"
TRACES = "trace_id string, layer int, head int, scores array<float>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, label): the embeddings in double precision."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label"
    )


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id, vector) of a JSON corpus; malformed input fails."""
    doc = spark.read.schema(CORPUS).option("mode", "FAILFAST").option("multiLine", True).json(path)
    return doc.select(F.posexplode("tokens").alias("pos", "t")).select("pos", "t.id", "t.vector")


def read_agents(spark: SparkSession, path: str) -> DataFrame:
    """(agent_id, pos, id, vector); the shared tier has no agent."""
    doc = spark.read.schema(MULTI_CORPUS).option("mode", "FAILFAST").option("multiLine", True).json(path)
    shared = doc.select(F.lit(None).cast("string").alias("agent_id"), F.posexplode("shared_tokens").alias("pos", "t"))
    agents = doc.select(F.explode("agents").alias("a")).select(F.col("a.id").alias("agent_id"), F.posexplode("a.tokens").alias("pos", "t"))
    return shared.unionByName(agents).select("agent_id", "pos", "t.id", "t.vector")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACES).option("mode", "FAILFAST").option("multiLine", True).json(path)


def token_range(tokens: DataFrame, start: int, end: int) -> DataFrame:
    return tokens.where((F.col("pos") >= start) & (F.col("pos") < end))


def write_pages(pages: DataFrame, path: str) -> None:
    """Append pages (digest, header, payload) that the store does not hold; names follow the digest."""
    spark = pages.sparkSession
    new = pages.where(F.sha2("payload", 256) == F.col("digest")).dropDuplicates(["digest"])
    try:
        new = new.join(spark.read.parquet(path).select("digest"), "digest", "left_anti")
    except Exception as error:  # no store yet
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    new.withColumn("prefix", F.substring("digest", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)


def read_page(spark: SparkSession, path: str, digest: str) -> DataFrame:
    found = spark.read.parquet(path).where((F.col("prefix") == digest[:2]) & (F.col("digest") == digest))
    return found.where(F.sha2("payload", 256) == F.col("digest"))


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, digest, status) of files named <digest>.page, temporary ones skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.page").load(path)
    named = files.select("path", F.regexp_extract("path", r"([^/]+)\.page$", 1).alias("digest"), "content")
    named = named.where(~F.col("digest").startswith(".tmp."))
    return named.select("path", "digest", F.when(F.sha2("content", 256) == F.col("digest"), "valid").otherwise("corrupted").alias("status"))
