"""Line dedup: every line that many documents share stays in one of them only.

Keys of lines are hashed to 128 bits and written once. The hashes are range-partitioned and sorted by hash, then by
document from the largest id down, then by position; each range is streamed, the first document of a run keeps the
line. A range is an equal slice of the hash space. Hashes that fill half a range or more, found in a sample of the
hashes, stay out of the ranges: their documents are counted with pre-aggregation, and the few totals (at most two for
each range) are broadcast back. The sample only decides which way a hash goes; both ways give the same lines. What
comes back is a bitmap of the dropped lines of each document, as its non-zero 64-bit words only; texts are rebuilt
from it where they are wanted.

Defined results: a NULL or empty text is one empty line, and is kept. Rows that share a doc_id are one document when
documents are counted, and each row keeps its own lines. A NULL doc_id counts as one document below all others. Keys
shorter than ``min_chars`` never go. Other columns of the input are not looked at and may bear any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenlex.shared import Tables

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCS = 20, 3
#: Sampled hashes for each range, and how many of them make a hash hot.
SAMPLED, HOT, SEED = 64, 32, 5
RUN = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def text_hash(text: Column) -> Column:
    """Tells apart rows that share a doc_id but not a text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, t (the text's hash), pos, h1, h2 of every line that is long enough."""
    rows = docs.select("doc_id", text_hash(F.col("text")).alias("t"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = rows.select("doc_id", "t", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def lost_lines(hashed: DataFrame, tables: Tables, min_docs: int) -> DataFrame:
    """doc_id, t, pos of every line that goes."""
    n = int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, SAMPLED * n / max(1, hashed.count()))
    hot = tables.write(hashed.sample(share, SEED).groupBy(*RUN).count().where(F.col("count") >= HOT).select(*RUN), "hot")
    by_doc = hashed.join(F.broadcast(hot), RUN).groupBy(*RUN, "doc_id").agg(F.lit(1).alias("one"))
    totals = by_doc.groupBy(*RUN).agg(F.count("one").alias("n_docs"), F.max("doc_id").alias("keeper"))
    totals = tables.write(totals.where(F.col("n_docs") >= min_docs), "totals")
    split = hashed.join(F.broadcast(totals), RUN)
    # The slice of the hash space, by the top 31 bits.
    ranged = F.shiftright(F.shiftrightunsigned("h1", 33) * n, 31).cast("int").alias("range")
    rest = hashed.join(F.broadcast(hot), RUN, "left_anti").select("*", ranged)
    down = F.col("doc_id").desc_nulls_last()
    ranges = rest.repartitionById(n, F.col("range")).sortWithinPartitions("range", *RUN, down, "pos")
    run = Window.partitionBy("range", *RUN)
    at = run.orderBy(down, "pos")
    first = F.row_number().over(at) == 1
    new = (first | ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(at))).cast("int")
    streamed = ranges.select("*", F.first("doc_id").over(at).alias("keeper"), new.alias("new"))
    streamed = streamed.withColumn("n_docs", F.sum("new").over(run)).where(F.col("n_docs") >= min_docs)
    both = [x.where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "t", "pos") for x in (streamed, split)]
    return both[0].unionByName(both[1])


def drop_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row for each document that loses lines: doc_id, text_hash, n_dropped, words.

    words is the compressed bitmap: a map from the word number to a 64-bit word whose bit ``pos % 64`` is set for
    each dropped line ``pos``; all-zero words are left out.
    """
    tables = Tables(docs.sparkSession)
    lost = lost_lines(tables.write(hashed_lines(docs, min_chars), "lines"), tables, min_docs)
    # One shuffle: both groupings below are of whole documents.
    mine = lost.repartition("doc_id", "t")
    words = mine.groupBy("doc_id", "t", F.expr("pos div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("doc_id", F.col("t").alias("text_hash")).agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"),
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """row (a document's own columns), n_lines, n_dropped and kept, the text without its dropped lines (NULL: empty)."""
    marks = bitmaps.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.col("n_dropped").alias("dropped"), "words")
    rows = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & (text_hash(F.col("row.text")) == F.col("hash"))
    joined = rows.join(marks, same, "left").withColumn("lines", lines_of(F.col("row.text")))
    # The dense form for this one document: a word is then found by its index.
    numbers = F.sequence(F.lit(0), F.expr("(size(lines) - 1) div 64"))
    dense = F.transform(numbers, lambda w: F.coalesce(F.try_element_at(F.col("words"), w.cast("long")), F.lit(0).cast("long")))
    marked = joined.withColumn("dense", F.when(F.col("words").isNotNull(), dense))
    stays = "(shiftright(element_at(dense, cast(i div 64 as int) + 1), cast(i % 64 as int)) & 1L) = 0L"
    kept = F.expr(f"array_join(filter(lines, (x, i) -> {stays}), '\n')")
    return marked.select(
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce("dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("words").isNotNull(), kept).otherwise(F.coalesce("row.text", F.lit(""))).alias("kept"),
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs, with each text rebuilt from the lines it keeps and n_chars, if there, brought up to date."""
    out = apply_bitmaps(docs, drop_bitmaps(docs, min_chars, min_docs))
    text = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(text).cast("long"))
    return out.select(row.alias("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: doc_id, n_lines, n_dropped, kept_sha256 for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = apply_bitmaps(docs, drop_bitmaps(docs))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


#: DuckDB: lines of documents with key, dropped.
LINES_SQL = f"""
  raw AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS a FROM {{documents}}),
  lines AS (SELECT doc_id, r, unnest(range(len(a))) AS pos, unnest(a) AS line FROM raw),
  keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines),
  shared AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
  marked AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeper AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key)"""

ORACLE = f"""WITH {LINES_SQL.format(documents="documents")}
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id"""
