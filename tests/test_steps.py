"""Windows of the rules by level, sentences searched for subjects, and words that are read once."""

import re

import pytest

from lexweave.operators import report as rp, rules as ru
from lexweave.queries import front, rules as queries

TEXTS = [
    (1, "The gir and it, but that was this (as one). With kuing the people of Rome; is it - not - so? Umuntu aragenda and it."),
    (2, "There thing inning the these. He was running in the thing. Reading on these, stinging them. It is."),
    (3, ""), (4, None),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("steps"))
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def windows(df):
    return len(re.findall(r"\bWindow \[", df._jdf.queryExecution().optimizedPlan().toString()))


def test_all_rules_make_few_window_steps(spark, folder):
    t = queries.sample_tokens(spark, folder)
    assert windows(ru.violations(t, queries.TABLES)) <= 7  # 12 before
    assert windows(ru.retag(t, rules=queries.TABLES)) <= 8  # 11 before
    assert windows(ru.gram_roles(t, queries.TABLES)) == 1


def test_only_doubtful_sentences_are_searched(spark):
    columns = "doc_id long, sent_no int, tok_no int, lower string, punct_type string, pos string, noun_class int, verb_tense string, is_sent_boundary boolean, is_clause_boundary boolean"
    word = lambda s, n, pos, cls: (1, s, n, f"w{n}", None, pos, cls, None, False, False)
    rows = [word(1, 1, "NOUN", 5), word(1, 2, "VERB_CONJ", 5), word(2, 1, "NOUN", 2), word(2, 2, "NOUN", 5), word(2, 3, "VERB_CONJ", 2),
            word(3, 1, "NOUN", 5), word(3, 2, "ADJECTIVE", 5), word(3, 3, "VERB_CONJ", 7), word(4, 1, None, None), word(4, 2, "VERB_CONJ", 7)]
    t = spark.createDataFrame(rows, columns)
    assert {r.sent_no for r in ru._doubtful(ru.with_role(t), ("doc_id",)).collect()} == {2, 3}
    assert [(r.sent_no, r.tok_no) for r in ru.subject_verb(t).collect()] == [(3, 3)]


def test_words_of_the_corpus_are_read_once(spark, folder):
    plan = front.tag_words(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "doc_id" not in plan and "Relation [word" in plan  # before, every branch of the tags read the documents again


def test_corrections_are_compiled(spark, folder):
    plan = rp.correct(queries.sample_tokens(spark, folder), queries.TABLES)._jdf.queryExecution().optimizedPlan().toString()
    aggregate = plan[: plan.index("Window")]
    assert "lambda" not in aggregate  # what has a lambda is interpreted, with all the rules inside
