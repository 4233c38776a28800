import gzip
from pathlib import Path

import pytest

from catalog_fusion.operators import collapse, conform
from catalog_fusion.plans import fuse
from catalog_fusion.scratch import scratch_dir
from catalog_fusion.sources import scan, sink


def test_text_scans_agree_across_formats(spark, tmp_path):
    body = 'id{s}name\n1{s}"a{s} ""b"""\n2{s}NA\n3{s}\\N\n4{s}\n5{s}007\n'
    (tmp_path / "x.csv").write_text(body.format(s=","))
    (tmp_path / "x.tsv").write_text(body.format(s="\t"))
    (tmp_path / "x.alt").write_text(body.format(s="!"))
    with gzip.open(tmp_path / "x.csv.gz", "wt") as f:
        f.write(body.format(s=","))
    for name, sep, first in (("x.csv", None, 'a, "b"'), ("x.tsv", None, 'a\t "b"'), ("x.csv.gz", None, 'a, "b"'), ("x.alt", "!", 'a! "b"')):
        path = str(tmp_path / name)
        rows = scan.scan(spark, path, sep=sep).orderBy("id").collect()
        assert [tuple(r) for r in rows] == [("1", first), ("2", None), ("3", None), ("4", None), ("5", "007")], name


def test_bad_bytes_are_replaced_and_quoted_breaks_kept(spark, tmp_path):
    (tmp_path / "bad.csv").write_bytes(b"a,b\nx\xff,1\n")
    assert scan.scan(spark, str(tmp_path / "bad.csv")).first()["a"] == "x�"
    (tmp_path / "lines.csv").write_text('a,b\n"x\ny",1\n')
    assert scan.scan(spark, str(tmp_path / "lines.csv")).first()["a"] == "x\ny"


def test_repeated_headers_and_byte_order_mark(spark, tmp_path):
    (tmp_path / "twice.csv").write_bytes(b"\xef\xbb\xbffilm,year,Title,title,year\nx,2000,y,z,2001\n")
    raw = scan.scan(spark, str(tmp_path / "twice.csv"))
    assert raw.columns == ["film", "year", "Title", "title.1", "year.1"]
    row = conform.conform(raw, "s").first()
    assert (row["title"], row["year"]) == ("x", 2000)


def test_files_of_one_source_are_read_by_their_own_headers(spark, tmp_path):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    (folder / "part-0.csv").write_text("title,year\nAlpha,2001\n")
    (folder / "part-1.csv").write_text('year,title\n2002,"Be\nta"\n')
    (folder / "part-2.csv").write_text("year,title,votes\n2003\n2004,Gamma,7\n")
    (folder / "part-3.csv").write_text("")
    rows = scan.scan(spark, str(folder)).select("title", "year", "votes").collect()
    assert sorted(map(str, rows)) == sorted(
        str(r) for r in spark.createDataFrame(
            [("Alpha", "2001", None), ("Be\nta", "2002", None), (None, "2003", None), ("Gamma", "2004", "7")], "title string, year string, votes string"
        ).collect()
    )


def test_rows_longer_than_the_header_are_an_error(spark, tmp_path):
    (tmp_path / "long.csv").write_text("a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="more cells than the header"):
        scan.scan(spark, str(tmp_path / "long.csv"), columns=["a"]).collect()


def test_part_files_that_cannot_be_split_are_spread(spark, tmp_path):
    spark.range(10).selectExpr("id", "'x' AS v").write.csv(str(tmp_path / "g.csv"), header=True, compression="gzip")
    plan = scan.scan_text(spark, str(tmp_path / "g.csv"), line_breaks=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in plan


def test_many_sources_are_one_scan_and_nothing_stays(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for i in range(60):
        (raw / f"s{i:03d}.csv").write_text(f"film,release_year,votes\nTitle {i % 7},2000,{i + 1}\n")
    for i in range(3):
        (raw / f"z{i}.csv").write_text(f"year,title\n200{i},Other\n")
    sources = scan.discover(spark, str(raw))
    jobs = fuse.staged_groups(spark, sources, str(tmp_path / "groups"))
    assert len(jobs) == 2
    ranks = {(r["source"], r["source_rank"]) for job in jobs for r in job().collect()}
    assert ranks == {(s.label, i) for i, s in enumerate(sources)}
    scratch = Path(scratch_dir(spark).removeprefix("file:"))
    before = set(scratch.iterdir()) if scratch.exists() else set()
    report = fuse.merge_sources(spark, sources, str(tmp_path / "out"))
    assert (report.rows_ingested, report.rows_after_merge) == (63, 10)
    assert set(scratch.iterdir()) == before
    assert fuse.load_merged(spark, str(tmp_path / "out")).count() == 10


def test_staged_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("tt1", "x", 2000)], "tconst string, film string, year int").write.parquet(str(tmp_path / "s.parquet"))
    fuse.ingest_to_parquet(spark, scan.Source(str(tmp_path / "s.parquet")), str(tmp_path / "staged"))
    plan = collapse.resolve(spark.read.parquet(str(tmp_path / "staged")), stored=True)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(imdb_id)]" in plan
    assert sum("IsNull(imdb_id)" in part.split("]")[0] for part in plan.split("PushedFilters: [")[1:]) == 2, plan
    assert "Python" not in plan


def test_rows_are_counted_by_footers(spark, tmp_path):
    spark.range(1000).repartition(3).write.parquet(str(tmp_path / "t"))
    counted = scan.parquet_row_count(spark, str(tmp_path / "t"))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan and counted.first()["rows"] == 1000


def test_projection_reaches_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 2 AS twice").write.parquet(str(tmp_path / "t.parquet"))
    df = scan.scan(spark, str(tmp_path / "t.parquet"), columns=["twice"])
    assert "ReadSchema: struct<twice:bigint>" in df._jdf.queryExecution().executedPlan().toString()
    assert scan.parquet_row_count(spark, str(tmp_path / "t.parquet")).first()["rows"] == 10


def test_discovery(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "title.basics.tsv").write_text("a\n1\n")
    (tmp_path / "a.CSV").write_text("a\n1\n")
    (tmp_path / "notes.txt").write_text("a")
    spark.range(3).repartition(3).write.parquet(str(tmp_path / "c" / "many.parquet"))
    found = scan.discover(spark, str(tmp_path))
    assert [s.label for s in found] == ["a", "title.basics", "many"]
    assert scan.Source("/x/title.basics.tsv.gz").label == "title.basics.tsv"


def test_merge_job_over_mixed_files(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "basics.tsv").write_text(
        "tconst\ttitleType\tprimaryTitle\toriginalTitle\tstartYear\truntimeMinutes\tgenres\n"
        "tt1\tmovie\tThe Copper Lantern\tOther\t2010\t118\tdrama,crime\n"
        "tt2\tmovie\tUzun Gece Konya\tOther\t2011\t\\N\tDrama\n"
    )
    (raw / "ratings.tsv").write_text("tconst\taverageRating\tnumVotes\ntt1\t8.0\t100\ntt2\t6.5\t80\n")
    (raw / "budgets.csv").write_text(
        "movie,release_year,production_budget,director,stars,language,country,release_hour\n"
        'Copper Lantern!,2010,"$1,200,000",A|B;C,"X, Y, Z",tr,TR,19\nExtra,2012,500,D,E,en,US,25\n'
    )
    (raw / "published.csv").write_text("film,release_year,avg_rating,votes,premiere\ncopper lantern,2010,6.0,300,2010-05-07\n")
    out = str(tmp_path / "movies")
    report = fuse.merge_sources(spark, scan.discover(spark, str(raw)), out, staging=str(tmp_path / "staging"))
    assert (len(report.input_files), report.rows_ingested, report.rows_after_merge) == (4, 7, 3)
    rows = {r["title_norm"]: r for r in fuse.load_merged(spark, out).collect()}
    film = rows["copper lantern"]
    assert film["imdb_id"] == "tt1" and film["release_date"] == "2010-05-07" and film["release_hour"] == 19
    assert film["rating"] == pytest.approx((8 * 100 + 6 * 300) / 400) and film["vote_count"] == 300
    assert film["budget_usd"] == 1_200_000 and film["director"] == "A, B" and film["genres"] == "Drama,Crime"
    assert sorted(film["source"].replace("basics+ratings", "br").split("+")) == ["br", "budgets", "published"]
    assert [rows[k]["movie_id"] for k in sorted(rows)] == ["mv0000001", "mv0000002", "mv0000003"]
    assert rows["extra"]["release_hour"] is None


def test_merge_needs_a_source(spark, tmp_path):
    with pytest.raises(ValueError):
        fuse.merge_sources(spark, [], str(tmp_path / "x"))


def test_empty_source_is_fine(spark, tmp_path):
    (tmp_path / "a.csv").write_text("film,release_year\n")
    (tmp_path / "b.csv").write_text("film,release_year\nx,2000\n")
    report = fuse.merge_sources(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], str(tmp_path / "o"))
    assert (report.rows_ingested, report.rows_after_merge) == (1, 1)


def test_sinks(spark, tmp_path):
    assert sink.write_parquet(spark.range(12), str(tmp_path / "p")) == 12
    assert any(".zstd." in f.name for f in (tmp_path / "p").iterdir())
    sink.write_report(spark.createDataFrame([(1, "x")], ["a", "b"]), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["b"] == "x"
