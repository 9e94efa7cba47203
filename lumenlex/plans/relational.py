"""Registered queries over nested records, joins, aggregates, sources and sinks, and their SQL.

Works are stood in for by orders: the parts of an order's lines are its references, its lines are authors and topics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlex.operators import compact, evaluate, validate
from lumenlex.operators import index as ix
from lumenlex.shared import scratch
from lumenlex.sources import works as io

CONDITION = "topics[1].field_display_name = 'F' AND language = 'en'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines in the shape of raw works."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_discount")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    url = lambda kind, c: F.concat(F.lit(f"{compact.ID_PREFIX}{kind}"), c.cast("string"))

    def level(kind: str, c):
        return F.struct(url(f"{kind}/", c).alias("id"), c.cast("string").alias("display_name"))

    def topic(x):
        return F.struct(
            url("T", x["l_partkey"]).alias("id"), F.concat(F.lit("part "), x["l_partkey"].cast("string")).alias("display_name"), x["l_discount"].alias("score"),
            level("subfields", x["l_returnflag"]).alias("subfield"), level("fields", x["l_linestatus"]).alias("field"), level("domains", x["l_linenumber"]).alias("domain"),
        )

    def author(x):
        return F.struct(
            F.struct(url("A", x["l_suppkey"]).alias("id"), F.concat(F.lit("Supplier "), x["l_suppkey"].cast("string")).alias("display_name")).alias("author"),
            F.concat(F.lit("raw "), x["l_suppkey"].cast("string")).alias("raw_author_name"),
        )

    source = F.when(F.col("o_orderstatus") == "O", F.struct(url("S", F.col("o_custkey")).alias("id"), F.col("o_orderpriority").alias("display_name"), F.lit("journal").alias("type")))
    return orders.select(
        url("W", F.col("o_orderkey")).alias("id"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(f"{compact.DOI_PREFIX}10.1/"), F.col("o_orderkey").cast("string"))).alias("doi"),
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("title"),
        F.transform("lines", author).alias("authorships"),
        F.lit("article").alias("type"),
        F.when(F.col("o_orderstatus") != "P", F.when(F.col("o_orderkey") % 4 > 0, "en").otherwise("fr")).alias("language"),
        F.struct(source.alias("source"), (F.col("o_orderkey") % 5 == 0).alias("is_oa")).alias("primary_location"),
        F.year("o_orderdate").alias("publication_year"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"),
        F.transform("lines", lambda x: url("W", x["l_partkey"])).alias("referenced_works"),
        F.when(F.col("o_orderkey") % 7 > 0, F.size("lines")).otherwise(F.size("lines") + 1).alias("referenced_works_count"),
        F.lit(0).alias("cited_by_count"),
        F.transform("lines", topic).alias("topics"),
        F.transform(F.slice(F.col("lines"), 1, 2), lambda x: F.struct(url("K", x["l_suppkey"]).alias("id"), x["l_returnflag"].alias("display_name"), x["l_discount"].alias("score"))).alias("keywords"),
    )


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact.compact_works(raw_works(spark, sf_dir))


def joined(items: str, field: str | None = None):
    return F.array_join(F.transform(items, lambda x: (x[field] if field else x).cast("string")), ",")


def compact_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).select(
        "id", "doi", "title", joined("authorships", "id").alias("authors"), joined("authorships", "raw_author_name").alias("raw_names"), "authorships_truncated", "language",
        F.col("primary_location.id").alias("location"), F.col("primary_location.is_oa").alias("location_oa"), joined("referenced_works").alias("refs"),
        joined("topics", "id").alias("topic_ids"), joined("topics", "subfield_id").alias("subfields"), joined("topics", "field_id").alias("fields"), joined("topics", "domain_id").alias("domains"),
        joined("keywords", "id").alias("keyword_ids"), "publication_year", "publication_date",
    )


def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


def scan_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards written below several folders, read by one recursive scan."""
    path = scratch(spark, "shards")
    nation = table(spark, sf_dir, "nation")
    for part in range(3):
        nation.where(F.col("n_nationkey") % 3 == part).write.parquet(f"{path}/updated={part}")
    return io.read_shards(spark, path).select("n_nationkey", "n_name", "n_regionkey")


def scan_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "queries")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "\\s+", " ").alias("text"))
    io.write_tsv(items, path)
    return io.read_queries(spark, path)


def scan_tsv_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "queries")
    io.write_tsv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    return io.read_queries(spark, path, 10)


def _manifest(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """(folder of shards, manifest) with one shard listed that is not there."""
    path = scratch(spark, "corpus")
    table(spark, sf_dir, "nation").repartition(3, "n_nationkey").write.parquet(f"{path}/works")
    there = io.list_files(spark, f"{path}/works").withColumn("record_count", F.lit(1).cast("long"))
    gone = spark.createDataFrame([("gone.parquet", 1, 1)], "key string, content_length long, record_count long")
    io.write_manifest(there.unionByName(gone), f"{path}/manifest")
    return f"{path}/works", f"{path}/manifest"


def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of nations as files, written and read back."""
    path = scratch(spark, "manifest")
    numbers = [F.col(c).cast("long").alias(to) for c, to in (("n_nationkey", "content_length"), ("n_regionkey", "record_count"))]
    io.write_manifest(table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), *numbers), path)
    return io.read_manifest(spark, path)


def missing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = _manifest(spark, sf_dir)
    return io.missing_shards(io.read_manifest(spark, manifest), io.list_files(spark, folder)).select("key")


def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and mismatches of compact works by shard, one shard for each year of publication."""
    path = scratch(spark, "compact")
    years = works(spark, sf_dir).withColumn("year", F.col("publication_year").cast("string"))
    io.write_works(years, path, 5_000, by="year")
    counts = validate.shard_counts(io.read_shards(spark, path))
    year = F.regexp_extract("path", "year=([0-9]+)", 1).cast("int").alias("year")
    return counts.groupBy(year).agg(F.sum("record_count").alias("record_count"), F.sum("link_mismatches").alias("link_mismatches"))


def strip_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", compact.bare(F.col("url"), "https://").alias("bare_url"))


def last_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", compact.last_segment(F.col("url")).alias("segment"))


def truncate_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = F.sort_array(F.collect_list("l_partkey"))
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(refs.alias("refs"))
    # One list in eleven is NULL.
    some = lists.withColumn("refs", F.when(F.col("l_orderkey") % 11 > 0, F.col("refs")))
    return some.select("l_orderkey", F.array_join(compact.head_and_last(F.col("refs")), ",").alias("kept"), compact.is_truncated(F.col("refs")).alias("truncated"))


def reshape_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = works(spark, sf_dir).select(F.col("id").alias("work"), F.inline("topics"))
    return topics.select(F.col("work").alias("id"), F.col("display_name").alias("topic"), "score", "subfield_id", "field_id", "domain_id")


def nullable_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    location = F.col("primary_location")
    return works(spark, sf_dir).select("id", location.isNull().alias("is_null"), location["display_name"].alias("display_name"), location["is_oa"].alias("is_oa"))


def subset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact.subset(works(spark, sf_dir), CONDITION).select("id", "language", F.try_element_at("topics", F.lit(1))["field_display_name"].alias("field"))


def validate_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over a subset into which every work of a third kind slipped."""
    part = works(spark, sf_dir).where(F.expr(compact.profile(CONDITION)) | (F.substring("id", 2, 20).cast("long") % 3 == 0))
    return validate.subset_counts(part, CONDITION)


def link_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).where(validate.link_mismatch()).select("id", "referenced_works_count", F.size("referenced_works").alias("listed"))


def remap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works meet their dense ids over the number in their id."""
    records = works(spark, sf_dir).select("id", compact.raw_id("id").alias("number"), "publication_year")
    lookup = ix.map_ids(records.select("number"), "number")
    return records.join(lookup, F.col("number") == F.col("raw_id")).select("mapped_id", "id", "publication_year")


def doc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact.document_text(works(spark, sf_dir))


def missing_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = works(spark, sf_dir)
    part = compact.subset(full, CONDITION).where(compact.raw_id("id") % 10 > 0)
    return validate.missing_entries(full, part, CONDITION)


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_partkey").alias("referenced_works"))


def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("id"))
    return validate.dangling_references(_references(spark, sf_dir), known)


def dup_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.duplicate_links(_references(spark, sf_dir))


def dup_link_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.duplicate_links(_references(spark, sf_dir)).select("work_id").distinct().orderBy("work_id")


def dup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that several documents share, by digest; the shards are an explicit list of files."""
    shards = spark.read.parquet(*[f"{sf_dir}/documents.parquet"]).select(F.md5(F.encode("text", "UTF-8")).alias("id"))
    return validate.duplicate_ids(shards)


def count_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))


def lang_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang")


def null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.nullif(F.col("source"), F.lit("src0")).alias("source"))
    return validate.null_rates(docs).withColumn("rate", F.round("rate", 6))


def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = evaluate.latency(table(spark, sf_dir, "events"), F.col("value"))
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns])


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that grows by appended rows, read back."""
    path = scratch(spark, "log")
    for name in ("first", "second"):
        io.append_log(latency_stats(spark, sf_dir).select(F.lit(name).alias("run_name"), "mean", "max"), path)
    return spark.read.parquet(path)


QUERIES = {
    f.__name__: f
    for f in (
        scan_project, scan_glob, scan_tsv, scan_tsv_capped, manifest_entries, missing_shards, shard_counts, compact_works, strip_prefix, last_segment, truncate_list, reshape_structs,
        nullable_struct, subset_profile, validate_subset, link_mismatch, remap_join, doc_text, missing_entries, dangling_refs, dup_links, dup_link_works, dup_ids, count_all,
        lang_histogram, null_rates, latency_stats, query_log,
    )
}

_WORKS = """WITH l AS (SELECT l_orderkey, list({'n': l_linenumber, 'p': l_partkey, 's': l_suppkey, 'r': l_returnflag, 't': l_linestatus, 'd': l_discount}
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_discount) AS x FROM lineitem GROUP BY l_orderkey),
  w AS (SELECT o_orderkey AS k, 'W' || o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN '10.1/' || o_orderkey END AS doi,
    CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS title, CASE WHEN len(x) <= 3 THEN x ELSE x[1:2] || [x[-1]] END AS a, len(x) > 3 AS truncated,
    CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN o_orderkey % 4 > 0 THEN 'en' ELSE 'fr' END END AS language,
    CASE WHEN o_orderstatus = 'O' THEN 'S' || o_custkey END AS location, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS location_name,
    CASE WHEN o_orderstatus = 'O' THEN o_orderkey % 5 = 0 END AS location_oa, year(o_orderdate) AS publication_year, strftime(o_orderdate, '%Y-%m-%d') AS publication_date,
    x, len(x) + CASE WHEN o_orderkey % 7 > 0 THEN 0 ELSE 1 END AS stated FROM orders JOIN l ON o_orderkey = l_orderkey)"""
_MATCH = "x[1].t = 'F' AND language = 'en'"


def _list(items: str, value: str) -> str:
    return f"coalesce(array_to_string(list_transform({items}, lambda y: {value}), ','), '')"


ORACLES = {
    "scan_project": "SELECT doc_id, lang, source, n_chars FROM documents",
    "scan_glob": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "scan_tsv": "SELECT item_id AS qid, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM benchmark",
    "scan_tsv_capped": "SELECT n_nationkey::BIGINT AS qid, n_name AS text FROM nation ORDER BY 1 LIMIT 10",
    "missing_shards": "SELECT 'gone.parquet' AS key",
    "manifest_entries": "SELECT n_name AS key, n_nationkey::BIGINT AS content_length, n_regionkey::BIGINT AS record_count FROM nation",
    "shard_counts": f"""{_WORKS} SELECT publication_year::INTEGER AS year, count(*) AS record_count, count(*) FILTER (WHERE stated <> len(x)) AS link_mismatches
  FROM w GROUP BY publication_year""",
    "compact_works": f"""{_WORKS} SELECT id, doi, title, {_list('a', "'A' || y.s")} AS authors, {_list('a', "'raw ' || y.s")} AS raw_names, truncated AS authorships_truncated, language, location, location_oa,
  {_list('x', "'W' || y.p")} AS refs, {_list('x', "'T' || y.p")} AS topic_ids, {_list('x', 'y.r')} AS subfields, {_list('x', 'y.t')} AS fields, {_list('x', 'y.n::VARCHAR')} AS domains,
  {_list('x[1:2]', "'K' || y.s")} AS keyword_ids, publication_year::INTEGER AS publication_year, publication_date FROM w""",
    "strip_prefix": "SELECT page_id, replace(url, 'https://', '') AS bare_url FROM pages",
    "last_segment": "SELECT page_id, split_part(url, '/', -1) AS segment FROM pages",
    "truncate_list": """WITH l AS (SELECT l_orderkey, CASE WHEN l_orderkey % 11 > 0 THEN list(l_partkey ORDER BY l_partkey) END AS r FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(CASE WHEN len(r) <= 3 THEN r ELSE r[1:2] || [r[-1]] END, ',') AS kept, coalesce(len(r), 0) > 3 AS truncated FROM l""",
    "reshape_structs": f"{_WORKS} SELECT id, 'part ' || y.p AS topic, y.d AS score, y.r AS subfield_id, y.t AS field_id, y.n::VARCHAR AS domain_id FROM (SELECT id, unnest(x) AS y FROM w)",
    "nullable_struct": f"{_WORKS} SELECT id, location IS NULL AS is_null, location_name AS display_name, location_oa AS is_oa FROM w",
    "subset_profile": f"{_WORKS} SELECT id, language, x[1].t AS field FROM w WHERE {_MATCH}",
    "validate_subset": f"""{_WORKS} SELECT count(DISTINCT id) AS total_nodes, sum(stated)::BIGINT AS total_links, count(*) FILTER (WHERE NOT ({_MATCH})) AS filter_mismatches,
  count(*) FILTER (WHERE stated IS DISTINCT FROM len(x)) AS link_mismatches FROM w WHERE ({_MATCH}) OR k % 3 = 0""",
    "link_mismatch": f"{_WORKS} SELECT id, stated::INTEGER AS referenced_works_count, len(x)::INTEGER AS listed FROM w WHERE stated <> len(x)",
    "remap_join": f"{_WORKS} SELECT row_number() OVER (ORDER BY k) - 1 AS mapped_id, id, publication_year::INTEGER AS publication_year FROM w",
    "doc_text": f"""{_WORKS} SELECT k AS raw_id, concat_ws(' ', coalesce(title, ''), {_list('x', "'part ' || y.p").replace("','", "' '")}, {_list('x', 'y.r').replace("','", "' '")},
  {_list('x', 'y.t').replace("','", "' '")}, {_list('x', 'y.n::VARCHAR').replace("','", "' '")}, {_list('x[1:2]', 'y.r').replace("','", "' '")}) AS text FROM w""",
    "missing_entries": f"{_WORKS} SELECT id FROM w WHERE {_MATCH} AND k % 10 = 0",
    "dangling_refs": "SELECT l_orderkey AS work_id, l_partkey AS referenced_work_id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)",
    "dup_links": "SELECT l_orderkey AS work_id, l_partkey AS referenced_work_id, count(*) AS occurrences FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY work_id, occurrences DESC, referenced_work_id",
    "dup_link_works": "SELECT DISTINCT work_id FROM (SELECT l_orderkey AS work_id FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1) ORDER BY work_id",
    "dup_ids": "SELECT md5(text) AS id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1",
    "count_all": "SELECT count(*) AS n FROM documents",
    "lang_histogram": "SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang",
    "null_rates": """WITH d AS (SELECT doc_id, lang, nullif(source, 'src0') AS source FROM documents)
SELECT 'doc_id' AS "column", count(*) FILTER (WHERE doc_id IS NULL) AS nulls, count(*) AS total, round(count(*) FILTER (WHERE doc_id IS NULL) / count(*)::DOUBLE, 6) AS rate FROM d
UNION ALL SELECT 'lang', count(*) FILTER (WHERE lang IS NULL), count(*), round(count(*) FILTER (WHERE lang IS NULL) / count(*)::DOUBLE, 6) FROM d
UNION ALL SELECT 'source', count(*) FILTER (WHERE source IS NULL), count(*), round(count(*) FILTER (WHERE source IS NULL) / count(*)::DOUBLE, 6) FROM d""",
    "latency_stats": """SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99,
  round(max(value), 6) AS max, round(min(value), 6) AS min FROM events""",
    "query_log": "SELECT n AS run_name, round(avg(value), 6) AS mean, round(max(value), 6) AS max FROM events, (VALUES ('first'), ('second')) v(n) GROUP BY n",
}
