import json

from catalog_fusion.checks.queries import _stored_sources
from catalog_fusion.plans import jobs


def test_merge_train_predict_recommend(spark, tmp_path, capsys):
    raw = _stored_sources(spark, "/root/testdata/sf0.01")
    titles, model = str(tmp_path / "titles"), str(tmp_path / "model")
    report = jobs.merge(spark, [raw], titles).first()
    assert len(report["input_files"]) == 5 and report["rows_after_merge"] > 350
    trained = jobs.train(spark, titles, model, rounds=3).first()
    assert trained["metrics"]["mae"] < 1.2 and trained["n_train"] > 50
    assert spark.read.json(f"{model}.metrics").first()["algorithm"] == trained["algorithm"]

    bodies = [
        {"title": "One", "release_date": "2026-11-20T21:30", "window_start": "2026-11-01", "window_end": "2026-11-02", "top_n": 3},
        {"title": "Two", "release_date": "2026-11-20", "release_hour": 14},
        {"release_date": "2026-11-20"},
        {"title": "One", "release_date": "2026-11-20T21:30", "window_start": "2026-11-01", "window_end": "2026-11-02", "top_n": 3},
        {"title": "Three", "release_date": "2026-11-20", "window_start": "2026-11-09", "window_end": "2026-9-20"},
        {"title": "Four", "release_date": "2026-11-20", "window_start": "soon", "window_end": "tomorrow"},
        {"title": "Five", "release_date": "2026-11-20", "release_hour": "late", "window_start": "2026-11-01", "window_end": "2026-11-02"},
    ]
    (tmp_path / "requests.json").write_text("\n".join(json.dumps(b) for b in bodies))
    requests = str(tmp_path / "requests.json")
    scored = {r["title"]: r for r in jobs.predict(spark, model, requests, str(tmp_path / "scored")).collect()}
    assert sorted(scored) == ["Four", "One", "Three", "Two"]
    assert scored["One"]["release_hour"] == 21 and scored["Two"]["release_hour"] == 14
    assert all(1 <= r["predicted_rating"] <= 10 for r in scored.values())
    rejected = {r["reject_reason"] for r in spark.read.json(f"{tmp_path}/scored.rejected").collect()}
    assert rejected == {"title is required", "release_hour must be a whole number"}

    jobs.main(["recommend", requests, "--model", model, "--output", str(tmp_path / "slots")])
    assert "slot_rank" in capsys.readouterr().out
    slots = spark.read.parquet(str(tmp_path / "slots")).collect()
    # Equal requests both get their slots.
    assert [r["title"] for r in slots] == ["One"] * 6 and sorted(r["slot_rank"] for r in slots) == [1, 1, 2, 2, 3, 3]
    reasons = {r["reject_reason"] for r in spark.read.json(f"{tmp_path}/slots.rejected").collect()}
    assert reasons == {
        "title is required", "a window is required", "the window ends before it starts", "the window is not two dates",
        "release_hour must be a whole number",
    }
