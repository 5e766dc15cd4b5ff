"""Empty tables, clashing extra columns, repeated rows and very long texts for every training-data operator."""

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat_format, embedding_dedup, exact_dedup, gru_lm, html_extract, language_id, ngram_join, packing, quality_cnn, sentencepiece_bpe

with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
    MODEL = f.read()
SAMPLES = {"de": "der hund und die katze gehen nach hause", "en": "the cat and the dog went home again"}
DOCS = "doc_id long, text string, lang string, source string"
CLASHES = ["row_id", "text_sha256", "keep_id", "class", "component", "score", "ids", "decoded", "held_out", "cluster", "length", "rep", "key", "word", "c", "t", "lang_pred", "host", "wrapper", "gone_id", "_sha", "_key"]
OPERATORS = {
    "op1": lambda d: sentencepiece_bpe.decode(sentencepiece_bpe.encode(d, MODEL), MODEL),
    "op2": lambda d: html_extract.extract(d.select("*", F.col("text").alias("html"), F.lit("http://h/a").alias("url")).drop("text")),
    "op3": ngram_join.classes_of,
    "op3 rows": ngram_join.keep_rows,
    "op4": packing.pack,
    "op5": exact_dedup.assign,
    "op5 rows": exact_dedup.keep_rows,
    "op6": lambda d: language_id.predict(d, SAMPLES),
    "op7": lambda d: chat_format.format_chats(d.select("*", F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"))),
    "op8": gru_lm.score_documents,
    "op9": lambda d: quality_cnn.score(d, None),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], DOCS)).count() == 0


def test_empty_embeddings_and_learning_from_nothing(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    none = spark.createDataFrame([], DOCS)
    assert language_id.learn(none) == {} and quality_cnn.learn(none, spark.createDataFrame([], "doc_id long, quality int")) is None


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_nulls_and_repeated_rows(spark, name):
    rows = [(1, "the dog and the cat went home", "en", "a"), (1, "the dog and the cat went home", "en", "a"), (None, None, None, None), (2, "", "de", None), (3, "der Hund geht nach Hause " * 400, "de", "b")]
    plain = spark.createDataFrame(rows, DOCS)
    extra = plain.select("*", *[F.lit("x").alias(c) for c in CLASHES])
    results = OPERATORS[name](plain).columns
    pick = lambda df: sorted(str([r[c] for c in results]) for r in df.select(*results).collect())
    assert pick(OPERATORS[name](extra)) == pick(OPERATORS[name](plain))


@pytest.mark.parametrize("name", ["op1", "op3", "op4", "op6", "op8", "op9"])
def test_a_very_long_text(spark, name):
    long = "word " * 600_000
    rows = spark.createDataFrame([(1, long, "en", "s"), (2, "word", "en", "s")], DOCS)
    got = OPERATORS[name](rows).collect()
    assert {r["doc_id"] for r in got} == {1, 2}
    if name == "op4":
        assert sum(r["length"] for r in got if r["doc_id"] == 1) == 600_000
    if name == "op8":
        assert max(r["n_tokens"] for r in got) == 600_001


def test_unwanted_elements_at_any_depth(spark):
    pages = [(k, f"http://h{k}/x", "<body>" + "<div>" * k + "<nav>menu <div>menu</div></nav>text" + "</div>" * k + "<p>more</p></body>") for k in (1, 5, 58, 59, 60, 70, 500)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert set(got.values()) == {"text\nmore"}


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    d = spark.createDataFrame([(i, f"the dog and the cat number {i} went home again today", "en", "s", i) for i in range(12)], DOCS + ", n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, d, str(tmp_path)).columns == d.columns, name
