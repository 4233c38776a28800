import random

import pytest
from pyspark.sql import functions as F

from catalog_fusion.operators import collapse, conform, number
from catalog_fusion.schema import UNIFIED_COLUMNS


def titles(spark, rows):
    """Conformed rows from dicts."""
    schema = ", ".join(f"`{c}` string" for c in UNIFIED_COLUMNS)
    data = [tuple(None if r.get(c) is None else str(r[c]) for c in UNIFIED_COLUMNS) for r in rows]
    raw = spark.createDataFrame(data, schema)
    clean = conform.conform_schema(conform.clean_fields(raw.drop("movie_id", "title_norm")), "s")
    return clean.withColumn(conform.SOURCE_RANK, F.lit(0))


def by_key(df, *columns):
    return {tuple(r[c] for c in columns): r.asDict() for r in df.collect()}


def test_fields_rating_votes_and_sources(spark):
    rows = titles(
        spark,
        [
            dict(imdb_id="tt1", rating=8.0, vote_count=100, source="b"),
            dict(imdb_id="tt1", title="X", rating=6.0, director="D", source="a"),
            dict(imdb_id="tt1", title="Y", year=2000, vote_count=5, source="b"),
            dict(imdb_id="tt2", title="Solo", rating=7.3, source="c"),
            dict(imdb_id="tt3", rating=5.0, source="a"),
            dict(imdb_id="tt3", rating=9.0, source="a"),
            dict(imdb_id="tt4", source="a"),
            dict(imdb_id="tt4", vote_count=9, source="a"),
        ],
    )
    out = by_key(collapse.collapse_by_id(rows), "imdb_id")
    one = out[("tt1",)]
    assert one["title"] == "Y" and one["title_norm"] == "y" and one["year"] == 2000 and one["director"] == "D"
    assert one["rating"] == pytest.approx(806 / 101)
    assert one["vote_count"] == 100 and one["source"] == "a+b"
    # A single row stays as it is: a rating without votes gets none.
    assert out[("tt2",)]["vote_count"] is None and out[("tt2",)]["rating"] == 7.3
    assert out[("tt3",)]["vote_count"] == 2 and out[("tt3",)]["rating"] == 7.0
    assert out[("tt4",)]["vote_count"] == 9 and out[("tt4",)]["rating"] is None


def test_second_stage_uses_the_highest_votes_and_new_key(spark):
    rows = titles(
        spark,
        [
            dict(imdb_id="tt1", title="The Film", year=2000, source="basics"),
            dict(imdb_id="tt1", rating=8.0, vote_count=100, source="ratings"),
            dict(imdb_id="tt1", rating=8.0, vote_count=50, source="ratings"),
            dict(title="film!", year=2000, rating=2.0, vote_count=100, source="pub"),
            dict(imdb_id="tt9", rating=3.0, vote_count=7, source="ratings"),
            dict(imdb_id="tt8", rating=4.0, vote_count=7, source="ratings"),
            dict(rating=1.0, source="pub"),
            dict(rating=1.0, source="pub"),
        ],
    )
    out = collapse.resolve(rows).collect()
    merged = [r for r in out if r["title_norm"] == "film"]
    assert len(merged) == 1
    assert merged[0]["rating"] == pytest.approx(5.0)  # weights 100 and 100, not 150 and 100
    assert merged[0]["source"] == "basics+ratings+pub"  # a composite name stays whole
    # Untitled titles stay apart, with and without an id.
    assert sorted(str(r["imdb_id"]) for r in out if r["title_norm"] == "") == ["None", "None", "tt8", "tt9"]


def expected_collapse(rows):
    """Brute force over one group, in the documented order."""
    ranked = sorted(rows, key=lambda r: (-(r["vote_count"] or -1), r["release_date"] or "9999", r["tie"]))
    out = {c: next((r[c] for r in ranked if r.get(c)), None) for c in ("title", "director", "release_date")}
    rated = [(r["rating"], r["vote_count"] or 1) for r in rows if r["rating"] is not None]
    out["rating"] = sum(x * w for x, w in rated) / sum(w for _, w in rated) if rated else None
    votes = [r["vote_count"] for r in rows if r["vote_count"]]
    out["vote_count"] = max(votes) if votes else (len(rated) if rated and len(rows) > 1 else None)
    return out


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_against_brute_force_with_a_hot_key(spark, parts):
    """One id holds a third of all rows; the split of the input does not matter."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        rows.append(
            dict(
                imdb_id="tt0" if i % 3 == 0 else f"tt{rng.randrange(1, 60)}",
                title=rng.choice([None, f"Film {i}"]),
                director=rng.choice([None, " ", f"Person {i}"]),
                release_date=rng.choice([None, f"20{i % 90 + 10}-0{i % 9 + 1}-01"]),
                rating=rng.choice([None, round(rng.uniform(0, 10), 2)]),
                vote_count=rng.choice([None, 1 + i]),  # distinct, so votes alone order the rows that have any
                tie=i,
            )
        )
    for r in rows:
        if r["vote_count"] is None:  # without votes the release date decides
            r["title"] = r["director"] = None
    groups = {}
    for r in rows:
        groups.setdefault(r["imdb_id"], []).append(dict(r, director=(r["director"] or "").strip() or None))
    out = by_key(collapse.collapse_by_id(titles(spark, rows).repartition(parts)), "imdb_id")
    assert len(out) == len(groups)
    for key, group in groups.items():
        want, got = expected_collapse(group), out[(key,)]
        assert (got["title"], got["director"], got["vote_count"]) == (want["title"], want["director"], want["vote_count"])
        assert str(got["release_date"]) == str(want["release_date"])
        assert got["rating"] == pytest.approx(want["rating"])


def test_hot_title_key_without_ids(spark):
    """A third of the rows share one title and year; another third has neither title nor id."""
    rows = []
    for i in range(600):
        if i % 3 == 0:
            rows.append(dict(title="The Hot!" if i % 2 else "hot", year=2000, rating=i % 10, vote_count=i + 1, source="a"))
        elif i % 3 == 1:
            rows.append(dict(rating=5.0, source="b"))
        else:
            rows.append(dict(title=f"Cold {i % 50}", year=2000, rating=3.0, vote_count=1, source="c"))
    merged = number.assign_movie_ids(collapse.resolve(titles(spark, rows).repartition(9))).collect()
    hot = [r for r in merged if r["title_norm"] == "hot"]
    weighted = [(r["rating"], r["vote_count"]) for r in rows if r.get("title") in ("hot", "The Hot!")]
    assert len(hot) == 1 and hot[0]["vote_count"] == 598
    assert hot[0]["rating"] == pytest.approx(sum(x * w for x, w in weighted) / sum(w for _, w in weighted))
    assert sum(r["title_norm"] == "" for r in merged) == 200  # untitled copies all stay
    assert sorted(r["movie_id"] for r in merged) == [f"mv{i:07d}" for i in range(1, len(merged) + 1)]


def test_copies_do_not_fill_one_range(spark):
    copies = titles(spark, [dict(source="a")]).crossJoin(spark.range(0, 8000, 1, 6)).drop("id")
    keyed = copies.withColumns({f"k{i}": c for i, c in enumerate(number.title_order())})
    sizes = keyed.repartitionByRange(8, "k0", "k1", "k2", "k3", "k4").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 2000


def test_equal_votes_never_mix_rows(spark):
    """Rows that tie in everything but content still win or lose as a whole."""
    rows = [dict(imdb_id="tt1", title=f"T{i}", director=f"D{i}", language=f"L{i}", vote_count=3) for i in range(40)]
    seen = set()
    for parts in (1, 3, 8):
        r = collapse.collapse_by_id(titles(spark, rows).repartition(parts)).first()
        seen.add((r["title"], r["director"], r["language"]))
    assert len(seen) == 1
    title, director, language = seen.pop()
    assert title[1:] == director[1:] == language[1:]


def test_collapse_is_idempotent(spark):
    rows = titles(
        spark, [dict(imdb_id=f"tt{i % 7}", title=f"F{i % 5}", year=2000, rating=i % 11, vote_count=i + 1, source="s") for i in range(50)]
    )
    once = collapse.resolve(rows)
    key = lambda df: sorted(str(sorted(r.asDict().items(), key=str)) for r in df.collect())
    assert key(collapse.resolve(once)) == key(once)


def test_row_numbers_are_dense_with_one_hot_sort_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id").repartition(7)
    out = number.number_rows(df, [F.col("k"), F.col("id")], "n").orderBy("n").collect()
    assert [r["n"] for r in out] == list(range(1, 5001))
    assert [(r["k"], r["id"]) for r in out] == sorted((r["k"], r["id"]) for r in out)


def test_resolution_shuffles_once_per_key(spark):
    rows = titles(spark, [dict(imdb_id="tt1", title="A", year=2000, source="s")])
    plan = collapse.resolve(rows, stored=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan
