import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece
from catalog_fusion.llm import word_language
from pyspark.sql import functions as F
from test_parity_join import brute_force
from test_secret_links import all_spans
from test_template_leaks import leaks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The small tables, with planted rows."""
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    clean = docs.where("doc_id = 1").first()["text"]
    planted = [
        (9001, None), (9002, ""), (9003, "12 !? 34"), (9004, clean), (9004, clean), (9005, clean + " of the"),
        (9006, f"and so on {item} the and of it"), (9007, "the secret of the house: password = hunter22xyz and of the rest"),
    ]
    extra = spark.createDataFrame([(i, t, None, "src1", None) for i, t in planted], docs.schema)
    docs.unionByName(extra).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def masked(text):
    out, at = [], 0
    for s, _, e in all_spans(text):
        if s >= at:
            out += [text[at:s], "[secret]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def test_run_equals_the_stages_by_hand(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = word_language.fit_language_field(word_language.sample_labelled(docs.where(~word_language.held_out()), word_language.Training()))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    names, scores = model.predict([t or "" for _, t, _ in rows])
    rows = [(i, t, lang, s) for (i, t, s), lang, score in zip(rows, names, scores, strict=True) if score >= corpus_pipeline.LANGUAGE_SHARE]
    kept, done = [], set()
    least = {i: c for i, _, c in brute_force([r[:2] for r in rows])}
    for row in sorted(rows, key=lambda r: (r[0], r[1])):
        if least[row[0]] == row[0] and row[0] not in done:
            done.add(row[0])
            kept.append(row)
    items = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    kept = [r for r in kept if not leaks(r[1], items)]
    tokens = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: (lang, s, tokens.encode(masked(t))) for i, t, lang, s in kept}
    out = corpus_pipeline.run(spark, tables).collect()
    assert len(out) == len(want)
    assert {r["doc_id"]: (r["lang"], r["source"], list(r["ids"])) for r in out} == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in out)
    planted = {r["doc_id"] for r in out if r["doc_id"] > 9000}
    assert planted == {9007}


def test_stages_keep_the_columns_of_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumn("key", F.lit("k")).withColumn("content", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


def test_stages_on_an_empty_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).collect() == []
