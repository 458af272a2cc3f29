"""The public functions as one plan: few scans and shuffles, tags looked up inside sentences, lines as files have them."""

import re

import pytest

from lexweave import api
from lexweave.operators import tokens as tk
from lexweave.queries import front

TEXT = "The gir and it, but that was this. With kuing the people of Rome! " * 3


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plan")) + "/documents.parquet"
    rows = [(1, TEXT), (2, "Umuntu aragenda and it."), (3, ""), (4, None), (None, "No id at all.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    return spark.read.parquet(path)


def test_two_scans_and_three_shuffles(spark, docs):
    tokens = api.analyze(docs, dims=front.dimensions(spark))["tokens"]
    tokens.collect()
    plan = tokens._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")]
    assert len(re.findall("FileScan", final)) == 2 and len(re.findall("ReusedExchange", final)) == 1
    assert len(re.findall("Exchange hashpartitioning", final)) <= 3
    assert "RoundRobin" not in final


@pytest.mark.parametrize("stretch", [1, 32])
def test_every_token_has_the_tags_of_its_form(spark, docs, monkeypatch, stretch):
    monkeypatch.setattr(api, "STRETCH", stretch)
    dims = front.dimensions(spark)
    got = api.analyze(docs, dims=dims)["tokens"].collect()
    tags = {r.word: r for r in api.tag_words(tk.vocabulary(tk.tokenize(tk.sentences(docs))), dims=dims).collect()}
    assert {r.doc_id for r in got} == {1, 2}
    words = [r for r in got if r.punct_type is None]
    assert words and all(r.verb_tense == tags[r.lower].verb_tense for r in words if r.pos == "VERB_CONJ")
    assert [r.pos for r in words if r.lower == "and"] == ["CONJUNCTION"] * 4
    assert all(r.pos == "PUNCTUATION" for r in got if r.punct_type)


def test_lines_of_a_document_are_texts_of_their_own(spark):
    text = "# The gir and it\n\n  Umuntu aragenda and it\r\nThe gir, that was"
    docs = spark.createDataFrame([(5, text)], "doc_id long, text string")
    report = api.validate(docs, dims=front.dimensions(spark)).collect()
    assert {r.line_no for r in report if r.line_no is not None} <= {3, 4} and {r.line_no for r in report if r.sent_no} == {3, 4}
    whole = api.validate(docs, lines=False, dims=front.dimensions(spark))
    assert "line_no" not in whole.columns and whole.where("sent_no IS NOT NULL").count() >= 1
