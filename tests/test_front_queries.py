"""The queries of the public functions use the sample word lists."""

import pytest

from lexweave.queries import registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("front"))
    docs = [(1, "The gir and it, but that was this. With kuing the people of Rome!"), (2, "Umuntu aragenda and it.")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_tags_come_from_the_lists(spark, folder):
    tags = {r["word"]: r for r in registry.QUERIES["tag_words"](spark, folder).collect()}
    assert tags["and"]["pos"] == "CONJUNCTION" and tags["with"]["pos"] == "PREPOSITION" and tags["was"]["pos"] == "VERB_CONJ"
    assert (tags["that"]["pron_type"], tags["that"]["noun_class"]) == ("DEMONSTRATIVE", 5)
    assert tags["the"]["noun_class"] == 9


def test_tokens_and_errors_are_whole(spark, folder):
    tokens = registry.QUERIES["analyze_tokens"](spark, folder).collect()
    assert [r["pos"] for r in tokens if r["lower"] == "and"] == ["CONJUNCTION", "CONJUNCTION"]
    assert {r["doc_id"] for r in tokens} == {1, 2} and sum(r["pos"] == "PUNCTUATION" for r in tokens) >= 4
    errors = registry.QUERIES["analyze_errors"](spark, folder)
    assert {"doc_id", "sent_no"} <= set(errors.columns)
    report = registry.QUERIES["validate_report"](spark, folder).collect()
    assert report and errors.count() > 0


def test_overall_consistency_counts_each_word_once(spark):
    from lexweave.operators.series import consistency_overall

    rows = spark.createDataFrame([("a", 1000, 0.5, 0.2), ("b", 10, 0.0, 0.7), ("c", 10, 0.1, 0.0)], "w string, n long, pitch_c double, length_c double")
    assert [tuple(r) for r in consistency_overall(rows).collect()] == [(3, 0.2, 0.3)]
    assert [tuple(r) for r in consistency_overall(rows.where("n < 0")).collect()] == [(0, None, None)]
