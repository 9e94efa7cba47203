import pytest
from pyspark.sql import functions as F

from lumenlex import cli
from lumenlex.operators import compact, validate
from lumenlex.plans import ingest
from lumenlex.plans.relational import raw_works
from lumenlex.sources import works as io
from lumenlex.streaming.shards import compact_stream, run_available

SF = "/root/testdata/sf0.001"


def test_schema_errors():
    assert validate.schema_errors(["a", "c"], ["a", "b"]) == (["b"], ["c"])


@pytest.mark.parametrize("n, want", [(None, None), (0, []), (3, [0, 1, 2]), (4, [0, 1, 3]), (9, [0, 1, 8])])
def test_head_and_last(spark, n, want):
    df = spark.createDataFrame([(None if n is None else list(range(n)),)], "x array<int>")
    row = df.select(compact.head_and_last(F.col("x")).alias("y"), compact.is_truncated(F.col("x")).alias("t")).first()
    assert (row["y"], row["t"]) == (want, (n or 0) > 3)


def test_profiles(spark):
    works = spark.createDataFrame([(1, [("Mathematics",)], "en"), (2, [], "en"), (3, None, "en"), (4, [("Mathematics",)], "fr")], "id int, topics array<struct<field_display_name: string>>, language string")
    condition = "topics[1].field_display_name = 'Mathematics' AND language = 'en'"
    assert [r["id"] for r in compact.subset(works, condition).collect()] == [1]
    assert compact.subset(works, "language = 'en'").count() == 3


def test_profile_text():
    element = "try_element_at({}, {})".format
    assert compact.profile("title = 'a[1]' AND x[2] > 1") == f"title = 'a[1]' AND {element('x', 2)} > 1"
    assert compact.profile("loc.tags[1] = 'it''s [0]'") == f"{element('loc.tags', 1)} = 'it''s [0]'"
    assert compact.profile("a[1].b[-1].c IS NULL") == f"{element(element('a', 1) + '.b', -1)}.c IS NULL"
    assert compact.profile('`odd name`[0] <> 1.5e3') == f"{element('`odd name`', 'CAST(NULL AS INT)')} <> 1.5e3"


def test_index_zero_is_null(spark):
    works = spark.createDataFrame([(1, ["a"], (["t"],)), (2, [], ([],))], "id int, topics array<string>, loc struct<tags: array<string>>")
    assert compact.subset(works, "topics[0] = 'a'").count() == 0 and compact.subset(works, "topics[0] IS NULL").count() == 2
    assert [r["id"] for r in compact.subset(works, "loc.tags[1] = 't'").collect()] == [1]


def test_raw_ids(spark):
    rows = spark.createDataFrame([("W12",), ("12",), ("x",), (None,)], "id string").select(compact.raw_id("id").alias("n")).collect()
    assert [r["n"] for r in rows] == [12, 12, None, None]


def test_duplicate_links_and_dangling(spark):
    works = spark.createDataFrame([("W1", ["W2", "W2", "W9"]), ("W2", []), ("W3", None), ("W4", [None])], "id string, referenced_works array<string>")
    assert [tuple(r) for r in validate.duplicate_links(works).collect()] == [("W1", "W2", 2)]
    assert sorted(map(tuple, validate.dangling_references(works).collect())) == [("W1", "W9"), ("W4", None)]


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"files": [{"url": "s3://openalex/data/parquet/works/a.parquet", "meta": {"content_length": 5, "record_count": 2}},\n {"key": "b.parquet", "meta": {"content_length": 6, "record_count": 3}}]}')
    found = io.read_manifest(spark, str(tmp_path / "m.json"))
    assert sorted(map(tuple, found.collect())) == [("b.parquet", 6, 3), ("works/a.parquet", 5, 2)]


def test_ingest_subset_index_query(spark, tmp_path):
    raw, packed, part, index = (str(tmp_path / n) for n in ("raw", "compact", "subset", "index"))
    records = raw_works(spark, SF).where("substring(id, 23) % 7 > 0")  # every seventh states a wrong count
    records.repartition(3).write.parquet(raw)
    report = ingest.ingest(spark, "works", raw, packed)
    assert report.records == records.count() > 0 and report.bad_shards == [] and report.duplicate_ids == 0
    assert io.read_shards(spark, packed).columns == compact.COMPACT_COLUMNS
    found = ingest.make_subset(spark, packed, part, "language = 'en'", 100)
    assert found.total_errors == 0 and 0 < found.total_nodes < report.records
    ingest.build_index(spark, part, index)
    rows = ingest.run_query(spark, index, "part urgent", 5).collect()
    assert len(rows) == 5 and [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    assert rows == ingest.run_query(spark, index, "part urgent", 5, exhaustive=True).collect()
    with pytest.raises(ValueError):
        ingest.ingest(spark, "people", raw, packed)


def test_bad_links_are_reported(spark, tmp_path):
    raw, packed = str(tmp_path / "raw"), str(tmp_path / "compact")
    raw_works(spark, SF).write.parquet(raw)
    assert ingest.ingest(spark, "works", raw, packed).bad_shards


def test_logs_resume_and_reports(spark, tmp_path):
    raw, packed, report = (str(tmp_path / n) for n in ("raw", "compact", "report"))
    good = raw_works(spark, SF).where("substring(id, 23) % 7 > 0").cache()
    good.where("id < 'https://openalex.org/W5'").coalesce(1).write.parquet(f"{raw}/updated=1")
    files = io.list_files(spark, raw).select("key", "content_length", F.lit(good.where("id < 'https://openalex.org/W5'").count()).alias("record_count"))
    io.write_manifest(files, str(tmp_path / "manifest"))
    first = ingest.ingest(spark, "works", raw, packed, str(tmp_path / "manifest"), report)
    assert (first.shards, first.skipped_shards, first.bad_shards) == (1, 0, []) and 0 < first.size_reduction < 1000
    # A second shard that the manifest does not state is bad, and is worked on again each time; the first is not.
    good.where("id >= 'https://openalex.org/W5'").coalesce(1).write.parquet(f"{raw}/updated=2")
    for _ in range(2):
        second = ingest.ingest(spark, "works", raw, packed, str(tmp_path / "manifest"), report)
        assert (second.shards, second.skipped_shards, len(second.bad_shards)) == (2, 1, 1) and second.duplicate_ids == -1
    assert second.records == good.count()
    third = ingest.ingest(spark, "works", raw, packed, None, report)
    assert third.bad_shards == [] and third.dangling_references == spark.read.parquet(f"{report}/dangling_references").count() > 0
    assert spark.read.parquet(f"{report}/extraction_log").count() == 4
    row = spark.read.parquet(f"{report}/integrity_report").first()
    assert (row["records"], row["dangling_references"]) == (third.records, third.dangling_references)
    assert io.read_manifest(spark, f"{report}/compact_manifest").agg(F.sum("record_count")).first()[0] == third.records
    assert ingest.ingest(spark, "works", raw, packed, None, report).skipped_shards == 2


def test_many_bad_shards_raise(spark, tmp_path, monkeypatch):
    raw, packed = str(tmp_path / "raw"), str(tmp_path / "compact")
    raw_works(spark, SF).repartition(3).write.parquet(raw)
    monkeypatch.setattr(ingest, "MOST_BAD_SHARDS", 2)
    with pytest.raises(RuntimeError):
        ingest.ingest(spark, "works", raw, packed)
    assert spark.read.parquet(f"{packed}_report/extraction_log").where("NOT ok").count() == 3


def test_row_groups_and_count(spark, tmp_path):
    import pyarrow.parquet as pq

    assert io.write_works(spark.range(1000).coalesce(1), str(tmp_path / "w"), 400) == 1000
    sizes = sorted(f.num_rows for f in map(pq.read_metadata, (tmp_path / "w").glob("*.parquet")))
    assert sizes == [200, 400, 400]
    assert max(pq.read_metadata(f).num_row_groups for f in (tmp_path / "w").glob("*.parquet")) == 4


def test_streaming_resumes(spark, tmp_path):
    raw, out, check = (str(tmp_path / n) for n in ("raw", "out", "check"))
    records = raw_works(spark, SF)
    records.limit(10).coalesce(1).write.parquet(f"{raw}/1")
    for n, folder in ((10, None), (25, "2")):
        if folder:
            records.limit(15).coalesce(1).write.parquet(f"{raw}/{folder}")
        run_available(compact_stream(spark, raw, records.schema), out, check).awaitTermination(120)
        assert spark.read.parquet(out).count() == n


def test_query_files(spark, tmp_path):
    io.write_tsv(spark.createDataFrame([(2, 'a "b" c'), (1, "d")], "q int, t string"), str(tmp_path / "q"))
    assert [tuple(r) for r in io.read_queries(spark, str(tmp_path / "q"), 5).collect()] == [(1, "d"), (2, 'a "b" c')]


def test_cli(tmp_path):
    args = cli.parser().parse_args(["query", "--index", "i", "--query", "q"])
    assert args.k == 10 and not args.exhaustive
    (tmp_path / "c.toml").write_text('[works-subset.subset-profiles]\n"full-en" = "language = \'en\'"\n')
    args = cli.parser().parse_args(["gen-works-subset", "--compact", "c", "--subset", "s", "--config", str(tmp_path / "c.toml")])
    assert cli.condition_of(args) == "language = 'en'"
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["nothing"])
