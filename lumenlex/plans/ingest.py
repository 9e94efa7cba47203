"""The three jobs around the corpus: compacting shards, cutting subsets, building the index; and querying it.

Shards are partitions of one job, not steps of a loop: all are compacted by one projection and checked by one groupBy
over ``_metadata.file_path``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlex.functions import text
from lumenlex.functions.porter2 import stem as stem_word
from lumenlex.operators import compact, search, validate
from lumenlex.operators import index as ix
from lumenlex.shared import cut
from lumenlex.sources import works as io


class Entity:
    """A kind of record that can be ingested; subclasses register themselves by name."""

    registry: dict[str, type[Entity]] = {}
    name = ""

    def __init_subclass__(cls) -> None:
        Entity.registry[cls.name] = cls

    def compacted(self, raw: DataFrame, *extra: Column) -> DataFrame:
        """The compact records of raw, with extra columns after theirs."""
        raise NotImplementedError


class Works(Entity):
    name = "works"

    def compacted(self, raw: DataFrame, *extra: Column) -> DataFrame:
        return compact.compact_works(raw, *extra)


@dataclass(frozen=True)
class IngestReport:
    """What one run did, and what the whole corpus then holds; -1 where bad shards kept it from being examined."""

    shards: int
    records: int
    skipped_shards: int
    bad_shards: list[str]
    duplicate_ids: int
    dangling_references: int
    works_with_duplicate_links: int
    raw_bytes: int
    compact_bytes: int

    @property
    def size_reduction(self) -> float:
        """Compact bytes as percent of the raw ones."""
        return 100 * self.compact_bytes / self.raw_bytes if self.raw_bytes else 0.0


#: From this many bad shards on, ingestion raises.
MOST_BAD_SHARDS = 50
LOG = (
    "shard string, raw_bytes long, stated_records long, raw_records long, compact_bytes long, compact_records long, "
    "link_mismatches long, ok boolean, logged_at timestamp"
)


def _shard(path: Column, folder: str) -> Column:
    """The part of a file's path below folder."""
    return F.substring_index(path, f"/{folder.rstrip('/').rsplit('/', 1)[-1]}/", -1)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def shard_log(spark: SparkSession, raw: DataFrame, raw_path: str, compact_path: str, stated: DataFrame | None) -> DataFrame:
    """A row for each raw shard in raw: its bytes and records, those stated and those written, and whether all agree."""
    path, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    before = raw.groupBy(_shard(path, raw_path).alias("shard"), size.alias("raw_bytes")).agg(F.count(F.lit(1)).alias("raw_records"))
    done = validate.shard_counts(io.read_shards(spark, compact_path))
    name = F.decode(F.unhex(F.regexp_extract("path", "/shard=([^/]*)/", 1)), "UTF-8").alias("shard")
    sums = [F.sum(c).cast("long").alias(to) for c, to in (("bytes", "compact_bytes"), ("record_count", "compact_records"), ("link_mismatches", "link_mismatches"))]
    rows = before.join(done.groupBy(name).agg(*sums), "shard", "left")
    if stated is not None:
        rows = rows.join(stated.select(F.col("key").alias("shard"), F.col("record_count").alias("stated_records")), "shard", "left")
    else:
        rows = rows.withColumn("stated_records", F.col("raw_records"))
    agree = F.col("raw_records").eqNullSafe(F.col("compact_records")) & F.col("raw_records").eqNullSafe(F.col("stated_records"))
    ok = agree & (F.coalesce("link_mismatches", F.lit(0)) == 0)
    columns = [c.split()[0] for c in LOG.split(", ")]
    return rows.withColumns({"ok": ok, "logged_at": F.current_timestamp()}).select(*columns)


def ingest(
    spark: SparkSession,
    entity: str,
    raw_path: str,
    compact_path: str,
    manifest_path: str | None = None,
    report_path: str | None = None,
    forced: bool = False,
) -> IngestReport:
    """Compacts the shards under raw_path, each into a folder of its own, and checks shards and corpus.

    Shards that the extraction log calls good are skipped unless forced. Every shard that was worked on gets a row in
    the log; with MOST_BAD_SHARDS bad ones or more it raises, after logging. A shard is bad if its records differ from
    those written or from those the manifest states, or if stated and listed references differ. The report's tables
    lie under report_path (next to compact_path unless given): extraction_log, duplicate_ids, dangling_references,
    duplicate_links, integrity_report and compact_manifest.
    """
    if entity not in Entity.registry:
        raise ValueError(f"unknown entity {entity}; known: {', '.join(sorted(Entity.registry))}")
    report_path = report_path or f"{compact_path.rstrip('/')}_report"
    log_path = f"{report_path}/extraction_log"
    files = io.list_files(spark, raw_path)
    good: set[str] = set()
    if not forced and _exists(spark, log_path):
        last = spark.read.parquet(log_path).groupBy("shard").agg(F.max_by("ok", "logged_at").alias("ok"))
        good = {r["shard"] for r in last.where("ok").select("shard").collect()}  # one name for each file
    pending = sorted(r["key"] for r in files.select("key").collect() if r["key"] not in good)
    bad: list[str] = []
    if pending:
        raw = spark.read.parquet(*[f"{raw_path.rstrip('/')}/{key}" for key in pending])
        shard = F.hex(F.encode(_shard(F.col("_metadata.file_path"), raw_path), "UTF-8")).alias("shard")  # safe as a folder
        out = Entity.registry[entity]().compacted(raw, shard)
        io.write_works(out, compact_path, by="shard")
        stated = io.read_manifest(spark, manifest_path) if manifest_path else None
        rows = cut(shard_log(spark, raw, raw_path, compact_path, stated))
        io.append_log(rows, log_path)
        bad = [r["shard"] for r in rows.where("NOT ok").select("shard").orderBy("shard").collect()]
        if len(bad) >= MOST_BAD_SHARDS:
            raise RuntimeError(f"{len(bad)} bad shards (limit {MOST_BAD_SHARDS}); see {log_path}")
    done = io.read_shards(spark, compact_path)
    missing, redundant = validate.schema_errors(done.columns)
    if missing or redundant:
        raise ValueError(f"columns missing: {missing}; redundant: {redundant}")
    counts = cut(validate.shard_counts(done))
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("record_count", "bytes")]
    records, packed = counts.agg(*sums).first()
    size = files.agg(F.coalesce(F.sum("content_length"), F.lit(0))).first()[0]
    found = (-1, -1, -1) if bad else integrity(done, report_path)
    report = IngestReport(files.count(), records, len(good), bad, *found, size, packed)
    if not bad:
        entries = counts.select(_shard(F.col("path"), compact_path).alias("key"), F.col("bytes").alias("content_length"), "record_count")
        io.write_manifest(entries, f"{report_path}/compact_manifest")
        row = spark.createDataFrame([(*found, report.shards, records, size, packed, report.size_reduction)], INTEGRITY)
        row.coalesce(1).write.mode("overwrite").parquet(f"{report_path}/integrity_report")
    return report


INTEGRITY = (
    "duplicate_ids long, dangling_references long, works_with_duplicate_links long, shards long, records long, "
    "raw_bytes long, compact_bytes long, size_reduction double"
)


def integrity(works: DataFrame, report_path: str) -> tuple[int, int, int]:
    """Writes every repeated id, dangling reference and repeated link, and counts ids, references and works with such."""
    tables = {
        "duplicate_ids": validate.duplicate_ids(works),
        "dangling_references": validate.dangling_references(works),
        "duplicate_links": validate.duplicate_links(works),
    }
    written = []
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{report_path}/{name}")
        written.append(works.sparkSession.read.schema(table.schema).parquet(f"{report_path}/{name}"))
    return written[0].count(), written[1].count(), written[2].select("work_id").distinct().count()


def make_subset(spark: SparkSession, compact_path: str, subset_path: str, condition: str, rows_per_file: int = 2_000_000) -> validate.SubsetReport:
    io.write_works(compact.subset(io.read_shards(spark, compact_path), condition), subset_path, rows_per_file)
    return validate.validate_subset(io.read_shards(spark, compact_path), io.read_shards(spark, subset_path), condition)


def build_index(spark: SparkSession, works_path: str, index_path: str, k1: float = 1.2, b: float = 0.75, block_size: int = ix.BLOCK_SIZE, stem: bool = True) -> None:
    ix.build(compact.document_text(io.read_shards(spark, works_path)).where(F.col("raw_id").isNotNull()), k1, b, block_size, stem).save(index_path)


def query_terms(spark: SparkSession, query: str, stem: bool) -> list[str]:
    """The terms of a query, by the same expressions as documents'."""
    found = spark.createDataFrame([(query,)], "text string").select(text.terms(F.col("text")).alias("terms")).first()["terms"]
    return [stem_word(t) for t in found] if stem else found


def run_query(spark: SparkSession, index_path: str, query: str, k: int = 10, exhaustive: bool = False) -> DataFrame:
    """raw_id and score of the k best documents, best first."""
    index = ix.Index.load(spark, index_path)
    terms = query_terms(spark, query, index.stats.first()["stemmed"])
    return search.decoded(index, search.search(index, terms, k, exhaustive)).select("raw_id", "score").orderBy(F.desc("score"), "raw_id")
