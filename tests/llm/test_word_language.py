import itertools
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog_fusion.llm import word_language
from catalog_fusion.llm.queries import op8_word_language
from catalog_fusion.llm.word_language import Training, fit_language_field, forward_backward, identify_languages, sample_labelled

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 0").select("lang", "text").collect()
    return fit_language_field([tuple(r) for r in rows], Training(steps=120))


def test_forward_backward_equals_the_sum_over_all_paths():
    rng = np.random.default_rng(1)
    k, lengths = 3, np.array([5, 3, 1])
    potentials = rng.uniform(0.1, 1, (5, 3, k))
    start, moves = rng.uniform(0.1, 1, k), rng.uniform(0.1, 1, (k, k))
    share, moved = forward_backward(potentials.copy(), lengths, start, moves)
    all_moves = np.zeros((k, k))
    for row, n in enumerate(lengths):
        want, pairs = np.zeros((n, k)), np.zeros((k, k))
        for path in itertools.product(range(k), repeat=int(n)):
            mass = start[path[0]] * np.prod([potentials[t, row, y] for t, y in enumerate(path)])
            mass *= np.prod([moves[a, b] for a, b in itertools.pairwise(path)])
            for t, y in enumerate(path):
                want[t, y] += mass
            for a, b in itertools.pairwise(path):
                pairs[a, b] += mass
        total = want[0].sum()
        assert np.allclose(share[:n, row], want / total)
        all_moves += pairs / total
    assert np.allclose(moved, all_moves)


def test_fit_raises_the_likelihood_of_held_out_words(model, spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 1").select("lang", "text").collect()
    names, scores = model.predict([r["text"] for r in rows])
    assert np.mean([n == r["lang"] for n, r in zip(names, rows, strict=True)]) > 0.98
    assert all(0 <= s <= 1 for s in scores)
    assert np.all(np.diag(model.moves) > model.moves.mean(1)), "staying is learned"


def test_words_of_switching_text(model, spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 1").select("lang", "text").collect()
    words = {}
    for r in rows:
        words.setdefault(r["lang"], []).extend(word_language.words_of(r["text"])[:50])
    mixed = words["de"][:30] + words["en"][:10]
    sums = model.posteriors([mixed])[0]
    share = dict(zip(model.languages, sums / sums.sum(), strict=True))
    assert 0.65 < share["de"] < 0.85 and 0.15 < share["en"] < 0.35


def test_features_of_many_words_are_those_of_each(model):
    words = ["", "a", "ab", "abc", "anna", "banana", "der", "straße", "été", "日本語", "und" * 13, "xyzzy", "the"][1:]
    want = [model.weights[[model.index[f] for f in sorted(word_language.features_of(w)) if f in model.index]].sum(0) for w in words]
    assert np.allclose(model.scores(words), want, atol=1e-5)


def test_the_middle_of_a_long_run_is_read(model):
    for lang, word in (("de", "zwischendurchgeschwindigkeitsbegrenzung"), ("en", "thewhichwouldthroughoughtthethingsshould")):
        run = "ж" * 80 + (word * 2)[:40] + "ж" * 80
        assert len(run) == 200 and [len(w) for w in word_language.words_of(run)] == [40] * 5
        sums = dict(zip(model.languages, model.posteriors([word_language.words_of(run)])[0], strict=True))
        assert max(sums, key=sums.get) == lang
    assert "".join(word_language.words_of("語" * 12_345)) == "語" * 12_345


def test_blocks_agree_with_one_chain(model, monkeypatch):
    text = "der die und the of les para " * 200
    cut = model.predict([text])[1]
    monkeypatch.setattr(word_language, "BLOCK", 10_000)
    assert np.allclose(cut, model.predict([text])[1], atol=1e-3)


def test_edge_rows(model, spark):
    texts = [None, "", " 12 !? _ ½", "x", "é" * 100_000, "the of and " * 20_000, "日本語", "THE AND OF"]
    df = spark.createDataFrame([(i % 3, t, 1.0, "x") for i, t in enumerate(texts)], "doc_id long, text string, score double, key string")
    out = identify_languages(df.repartition(3), model).collect()
    assert len(out) == len(texts)
    assert sum(r["lang_pred"] == "und" and r["score"] == 0 for r in out) == 3
    assert identify_languages(df.limit(0), model).collect() == []
    assert pickle.loads(pickle.dumps(model)).predict(texts[3:]) == model.predict(texts[3:])


def test_fit_without_labels_and_with_one(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert sample_labelled(empty, Training()) == []
    assert fit_language_field([]).predict(["abc", "1"])[0] == ["und", "und"]
    one = fit_language_field([("xx", "some words of text")] * 3, Training(steps=3))
    assert one.predict(["abc", ""]) == (["xx", "und"], [1.0, 0.0])


def test_sample_is_bounded_and_balanced(spark):
    df = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.when(F.col("id") % 50 == 0, "a").when(F.col("id") % 7 > 0, "b").alias("lang")
    )
    got = sample_labelled(df, Training(documents=100))
    assert {lang: sum(x == lang for x, _ in got) for lang in ("a", "b")} == {"a": 100, "b": 100}
    assert len(got) == 200


def test_query_never_reads_the_label_of_a_held_out_row(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r["doc_id"]: r for r in op8_word_language(spark, SF).collect()}
    langs = {r["doc_id"]: r["lang"] for r in df.select("doc_id", "lang").collect()}
    assert len(out) == len(langs)
    held = [r for r in out.values() if r["held_out"]]
    assert 0.25 < len(held) / len(out) < 0.42
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.98
    hidden = df.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.col("lang")))
    hidden.withColumn("source", F.lit("z")).write.parquet(str(tmp_path / "documents.parquet"))
    again = {r["doc_id"]: r["lang_pred"] for r in op8_word_language(spark, str(tmp_path)).collect()}
    assert again == {i: r["lang_pred"] for i, r in out.items()}
