"""Reading and writing shards, manifests, lookups, query files and run files, by Spark's readers and writers alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Fixed value: the bucket prefix that a manifest's urls carry.
URL_PREFIX = "s3://openalex/data/parquet/"
MANIFEST = (
    "files array<struct<url: string, key: string, meta: struct<content_length: bigint, record_count: bigint>>>, content_length bigint, record_count bigint"
)
#: For s3a:// inputs that are open to all.
ANONYMOUS_S3 = {"spark.hadoop.fs.s3a.aws.credentials.provider": "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"}


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every Parquet file below folder."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(folder)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """key, content_length, record_count of a manifest's files; a url without its prefix wins over a key."""
    files = spark.read.schema(MANIFEST).option("multiLine", True).json(path).select(F.inline("files"))
    key = F.coalesce(F.replace("url", F.lit(URL_PREFIX), F.lit("")), F.col("key"))
    return files.select(key.alias("key"), "meta.content_length", "meta.record_count")


def write_manifest(files: DataFrame, path: str) -> None:
    """A manifest of files(key, content_length, record_count) as one JSON object."""
    entry = F.struct("key", F.struct("content_length", "record_count").alias("meta"))
    whole = files.agg(F.sort_array(F.collect_list(entry)).alias("files"), F.sum("content_length").alias("content_length"), F.sum("record_count").alias("record_count"))
    whole.coalesce(1).write.mode("overwrite").json(path)


def list_files(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """key (relative to folder) and length of the files below folder, listed by Spark, contents unread."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    tail = folder.rstrip("/").rsplit("/", 1)[-1]
    return found.select(F.substring_index("path", f"/{tail}/", -1).alias("key"), F.col("length").alias("content_length"))


def missing_shards(manifest: DataFrame, there: DataFrame) -> DataFrame:
    """The manifest's files that are not there."""
    return manifest.join(there.select("key"), "key", "left_anti")


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated values without header and without quotes."""
    return spark.read.schema(schema).option("sep", "\t").option("header", False).option("quote", "").csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", False).option("quote", "").option("escapeQuotes", False).option("emptyValue", "").csv(path)


def read_queries(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """qid, text of a query file; most: the first so many by qid."""
    queries = read_tsv(spark, path, "qid long, text string")
    return queries if most is None else queries.orderBy("qid").limit(most)


def write_works(works: DataFrame, path: str, rows_per_file: int = 2_000_000, by: str | None = None) -> int:
    """zstd Parquet with at most rows_per_file rows a file and a quarter of that a row group; returns the rows written.

    by: a column whose values become folders; only the folders of values that occur are replaced.
    """
    seen = Observation()
    out = works.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("compression", "zstd")
    out = out.option("maxRecordsPerFile", rows_per_file).option("parquet.block.row.count.limit", max(1, rows_per_file // 4))
    if by is not None:
        out = out.option("partitionOverwriteMode", "dynamic").partitionBy(by)
    out.parquet(path)
    return seen.get["n"]


def show_shard(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    """The first n records of one shard."""
    return spark.read.parquet(path).limit(n)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
