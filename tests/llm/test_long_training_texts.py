"""Languages with long labelled texts only, and corpora without labels."""

import corpus_pipeline
from citeframe.llm import language
from llm_plain import KIND

EN = "the quick brown fox jumps over the lazy dog and the cat sat on the mat "
FR = "le renard brun saute par dessus le chien paresseux et le chat dort "


def test_long_texts_teach_a_language(spark):
    rows = [(i, "12 " * 3000 + EN * 200, "en", "s", 1) for i in range(6)] + [(i, FR * 200, "fr", "s", 1) for i in range(6, 12)] + [(i, "1 " * 50, "xx", "s", 1) for i in range(12, 18)]
    docs = spark.createDataFrame(rows, KIND)
    samples = dict(language.training_texts(docs))
    assert sorted(samples) == ["en", "fr"] and max(map(len, samples.values())) <= 40_000
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, tuple(samples.items())).collect()}
    assert all(got[i] == "en" for i in range(6)) and all(got[i] == "fr" for i in range(6, 12))


def test_no_labels_reject_no_letters_only(spark, sf):
    docs = spark.createDataFrame([(1, EN, None, "s", 1), (2, "123 !", None, "s", 1), (3, None, None, "s", 1), (4, FR * 200, None, "s", 1)], KIND)
    got = {(r.doc_id, r.lang) for r in corpus_pipeline.language_id(spark, docs, sf).collect()}
    assert got == {(1, "und"), (4, "und")}
