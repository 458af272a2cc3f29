"""Sentences, tokens and rules end to end."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexweave import api
from lexweave.operators import report as rp, rules as ru, tokens as tk
from lexweave.plans.scale import cluster
from lexweave.sources import corpus


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


SENTENCES = [
    ("Umuntu munini aragenda.", "ADJ_AGREEMENT", 0), ("Abantu banini baragenda.", "ADJ_AGREEMENT", 0),
    ("Ikigo kinini kirabaho.", "ADJ_AGREEMENT", 0), ("Ibigo binini birabaho.", "ADJ_AGREEMENT", 0),
    ("Abantu munini baragenda.", "ADJ_AGREEMENT", 1), ("Ikigo binini kirabaho.", "ADJ_AGREEMENT", 1),
    ("Ibigo munini birabaho.", "ADJ_AGREEMENT", 1), ("Urugo rwacu rugenda.", "POSS_AGREEMENT", 0),
    ("Umuntu wacu aragenda.", "POSS_AGREEMENT", 0), ("Ikigo cyacu kirabaho.", "POSS_AGREEMENT", 0),
    ("Urugo wacu rugenda.", "POSS_AGREEMENT", 1), ("Ikigo wacu kirabaho.", "POSS_AGREEMENT", 1),
    ("Umuntu mwiza.", "NO_VERB", 0), ("Umuntu ikigo.", "NO_VERB", 1), ("Aragenda neza", "MISSING_PERIOD", 1),
    ("Ni nde uragenda.", "MISSING_QMARK", 1), ("Aragenda ariko arakora.", "MISSING_COMMA", 1),
    ("Aragenda, ariko arakora.", "MISSING_COMMA", 0), ("Umuntu (munini aragenda.", "UNBALANCED_PAREN", 1),
    ("Umuntu na umugore.", "VOWEL_HIATUS", 1), ("Baragenda mu we.", "WRONG_LOCATIVE", 1),
]


@pytest.fixture(scope="module")
def analysed(spark, dims):
    out = api.analyze(docs(spark, [s for s, _, _ in SENTENCES]), dims=dims)
    return {k: v.cache() for k, v in out.items()}


def test_rules(analysed):
    found = {}
    for r in analysed["errors"].collect():
        found.setdefault((r["doc_id"], r["type"]), []).append(r["tok_no"])
    for i, (sentence, kind, least) in enumerate(SENTENCES):
        n = len(found.get((i, kind), []))
        assert (n == 0) if least == 0 else (n >= least), (sentence, kind, n)


def test_tags(analysed):
    tags = {(r["doc_id"], r["lower"]): r["pos"] for r in analysed["tokens"].collect()}
    assert tags[(0, "umuntu")] == "NOUN" and tags[(0, "munini")] == "ADJECTIVE" and tags[(0, "aragenda")] == "VERB_CONJ"


def test_tokens_are_conserved(spark, analysed):
    raw = tk.tokens(docs(spark, [s for s, _, _ in SENTENCES]))
    assert raw.count() == analysed["tokens"].count()
    assert analysed["sentence_facts"].count() == len(SENTENCES)


def test_rollup_total(analysed):
    report = rp.violation_report(analysed["errors"])
    total = report.where("level = 3").first()["total"]
    assert total == analysed["errors"].count()
    assert report.where("level = 0").agg(F.sum("total")).first()[0] == total


def test_correct(spark, dims):
    out = api.correct(docs(spark, ["Abantu munini baragenda."]), dims=dims).first()["corrected"]
    assert out == "Abantu banini baragenda."


def test_corpus_lines(spark):
    lines = corpus.corpus_lines(docs(spark, ["a\r\n\n# c\n  b  \n"])).collect()
    assert [(r["line_no"], r["text"]) for r in lines] == [(1, "a"), (4, "b")]


def test_sentences(spark):
    out = tk.sentences(docs(spark, ["Aba. Bari! He? a.b, c"])).orderBy("sent_no").collect()
    assert [r["text"] for r in out] == ["Aba.", "Bari!", "He?", "a.b, c"]


def tokens_of(spark, text):
    t = tk.tokens(docs(spark, [text]))
    return t.orderBy("sent_no", "tok_no").collect()


def test_apostrophe_and_quotes(spark):
    rows = tokens_of(spark, "n'abana \"Yego.\" k’ishuri «x» <<y>> a -- b")
    assert [r["surface"] for r in rows][:5] == ["n", "abana", '"', "Yego", "."]
    by = {r["surface"]: r for r in rows}
    assert by["abana"]["preceded_by_apostrophe"] and by["ishuri"]["preceded_by_apostrophe"]
    assert not by["n"]["preceded_by_apostrophe"]
    assert [r["punct_type"] for r in rows if r["surface"] == '"'] == ["QUOTE_OPEN", "QUOTE_CLOSE"]
    assert by["<<"]["punct_type"] == "QUOTE_OPEN" and by[">>"]["punct_type"] == "QUOTE_CLOSE"
    assert by["--"]["punct_type"] == "DASH" and by["Yego"]["is_initial"]


def test_straight_quotes_after_directed_ones(spark):
    rows = tokens_of(spark, '“a " b " c ” " d "')
    assert [r["punct_type"] for r in rows if r["punct_type"]] == [
        "QUOTE_OPEN", "QUOTE_CLOSE", "QUOTE_OPEN", "QUOTE_CLOSE", "QUOTE_OPEN", "QUOTE_CLOSE",
    ]


def test_names(spark):
    rows = {(r["sent_no"], r["lower"]): r["is_proper_noun"] for r in tokens_of(spark, "Kagabo araza. Umwana wa Kagabo. Lina araza.")}
    assert rows[(2, "kagabo")] and not rows[(1, "kagabo")] and rows[(3, "lina")]
    t = tk.propagate_proper(tk.tokens(docs(spark, ["Kagabo araza. Umwana wa Kagabo."])))
    assert t.where("lower = 'kagabo' and is_proper_noun").count() == 2


def test_fused(spark):
    t = tk.tokens(docs(spark, ["Umuntu bifiteubugingo."]), fused=["afite", "bifite"])
    assert [r["surface"] for r in t.orderBy("tok_no").collect()] == ["Umuntu", "bifite", "ubugingo", "."]


def tagged(spark, rows):
    """rows: (tok_no, lower, pos, class, pron_type, obj)"""
    schema = (
        "doc_id bigint, sent_no int, tok_no int, surface string, lower string, punct_type string, pos string, noun_class int, "
        "pron_type string, obj_class int, stem string, verb_tense string, is_proper_noun boolean, is_sent_boundary boolean, "
        "is_clause_boundary boolean"
    )
    data = [
        (1, 1, i, w, w, "COMMA" if p == "PUNCTUATION" else None, p, c, t, o, None, None, False, False, p == "PUNCTUATION")
        for i, (w, p, c, t, o) in enumerate(rows, 1)
    ]
    return spark.createDataFrame(data, schema)


def test_relative_noun_chain_alternates(spark):
    n = ("n", "NOUN", 7, None, None)
    c = ("cya", "PRONOUN", 7, "POSSESSIVE", None)
    out = ru.retag(tagged(spark, [n, c, n, c, n, c, n, c, n])).orderBy("tok_no").collect()
    assert [r["pos"] for r in out][::2] == ["NOUN", "RELATIVE_NOUN", "NOUN", "RELATIVE_NOUN", "NOUN"]


def test_verbal_noun_and_elided_noun(spark):
    rows = [("ibimera", "VERB_CONJ", 4, None, 8), ("byose", "PRONOUN", 8, "INDEFINITE", None), ("iryo", "PRONOUN", 5, "DEMONSTRATIVE", None), ("sanzure", "VERB_CONJ", 1, None, None)]
    out = ru.retag(tagged(spark, rows)).orderBy("tok_no").collect()
    assert out[0]["gram_role"] == "VERBAL_NOUN"
    assert (out[3]["pos"], out[3]["noun_class"]) == ("NOUN", 5)


def test_subject_verb(spark):
    noun = lambda c: (f"n{c}", "NOUN", c, None, None)
    verb = lambda c: (f"v{c}", "VERB_CONJ", c, None, None)
    adj, comma = ("a", "ADJECTIVE", 2, None, None), (",", "PUNCTUATION", None, None, None)
    assert ru.subject_verb(tagged(spark, [noun(2), adj, verb(2)])).count() == 0
    assert ru.subject_verb(tagged(spark, [noun(7), adj, verb(2)])).count() == 1
    assert ru.subject_verb(tagged(spark, [noun(7), comma, verb(2)])).count() == 0
    assert ru.subject_verb(tagged(spark, [noun(2), verb(2), noun(7), verb(2)])).count() == 0
    conj = ("kandi", "CONJUNCTION", None, None, None)
    assert ru.subject_verb(tagged(spark, [noun(1), conj, noun(3), verb(2)])).count() == 0
    assert ru.subject_verb(tagged(spark, [noun(3), verb(2)])).count() == 1


def test_resolve_subject(spark):
    t = tagged(spark, [("imana", "NOUN", 9, None, None), ("yaremye", "VERB_CONJ", 6, None, None), ("ita", "VERB_CONJ", 4, None, None)])
    t = t.withColumn("verb_tense", F.when(F.col("lower") == "yaremye", "PAST_PERF"))
    out = {r["lower"]: r["noun_class"] for r in ru.resolve_subject(t).collect()}
    assert out == {"imana": 9, "yaremye": 9, "ita": 9}


def test_vowel_harmony_is_among_the_errors(spark, dims):
    rows = spark.createDataFrame([(1, "Umuntu arakorisha."), (2, "Umuntu arakoresha.")], "doc_id bigint, text string")
    found = api.analyze(rows, dims=dims)["errors"].where("type = 'SPELLING'").collect()
    assert [(r.doc_id, r.corrected_word) for r in found] == [(1, "arakoresha")]


QUOTED = [
    '"A" b "c. "D" e', 'x “a" b "c" ” "d." E f.\' "G', 'He said "yes." "No!" Then “ok.” \' B', '"" "" . " " T "', None, "", "...",
    '« "a" » “"b" c” "', "a ’ b 'c' ‘D’ e.’ F", '" ” " “ " . ” ” X " Y. "Z',
]


def test_flags_in_the_sentence_are_those_of_the_windows(spark):
    rows = [*enumerate(QUOTED), (100, 'One "two. Three" four.'), (100, 'One "two. Three" four.'), (None, 'A. "b"')]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, want = tk.tokens(df), tk.flagged(tk.tokenize(tk.sentences(cluster(df, "doc_id"))))
    assert got.columns == want.columns and Counter(got.collect()) == Counter(want.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan.replace("SortAggregate", "")


def test_clauses_and_chains_need_no_sort_of_their_own(spark):
    rows = tagged(spark, [("n", "NOUN", 7, None, None), ("cya", "PRONOUN", 7, "POSSESSIVE", None), ("n", "NOUN", 7, None, None)])
    for out in (ru.clause_punct(rows), ru.retag(rows)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if re.match(r"\W*Window ", line)]
        assert windows and not any("_run#" in line or "_odd#" in line.rsplit("[doc_id", 1)[-1] or "_clause#" in line for line in windows)
