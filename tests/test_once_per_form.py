"""Work on words is done once per form, and work on a text once per text (findings of round 3)."""


import pytest
from pyspark.sql import functions as F

from lexweave.operators import corpus_stats as cs, lists as li, tokens as tk, vocab as vb
from lexweave.queries import registry

TEXTS = [
    "The reed' s end. 'tis the\tend’  of\r\nit! Re-enter  12 inns", "«in the» end ’’ now\x0b end.\x0b in\x01end! \f", "O' Neil said: ‘the end’! It's--no",
    "", None, "stone 's stone ’ stone' ", "a1 1a 12 _3 3_ é4 4! the1the", "...' the ... '' x",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t) for i, t in enumerate(TEXTS * 2)] + [(1, TEXTS[1]), (None, TEXTS[0])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "reeds in an inn")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["infinitives", "verb_parse", "minimal_pairs", "trigger_words"])
def test_texts_are_not_read_by_word_level_work(spark, folder, name):
    files = registry.QUERIES[name](spark, folder).inputFiles()
    assert files and not any("documents.parquet" in f for f in files)


def test_stored_vocabulary_is_that_of_the_tokens(spark, folder):
    s = tk.sentences(spark.read.parquet(f"{folder}/documents.parquet"))
    expected = sorted(map(tuple, tk.vocabulary(tk.tokenize(s)).collect()))
    assert sorted(map(tuple, tk.stored_vocabulary(s).select("word", "n").collect())) == expected and len(expected) > 10


def test_trigger_counts_are_those_of_the_words(spark, folder):
    s = tk.sentences_freq(spark.read.parquet(f"{folder}/documents.parquet"))
    words = tk.clean_tokens(s.where(F.col("text").endswith("!"))).groupBy("word").count()
    got = cs.trigger_scores(s, "!", 1)
    assert {r.word: r.tc for r in got.collect()} == {r.word: r["count"] for r in words.collect() if len(r.word) > 1}
    assert {r.targets for r in got.collect()} == {s.where(F.col("text").endswith("!")).count()}


def test_exemplars_cut_a_text_once(spark):
    clips = spark.createDataFrame(
        [(1, "s", "of inn inn end"), (2, "s", "inn"), (3, "s", ""), (4, None, "inn  inn x"), (5, "s", None), (6, "s", "inn x")], "clip_id long, speaker string, text string"
    )
    out = li.mine_exemplars(clips, spark.createDataFrame([("inn",), ("end",)], "word string"), 2, ["of"])
    assert sorted((r.clip_id, r.pos, r.word) for r in out.collect()) == [(1, 2, "inn"), (4, 0, "inn"), (4, 1, "inn"), (6, 0, "inn")]
    assert "split(" not in plan(out).split("Generate")[0]


def test_phonemes_are_read_from_the_whole_text(spark):
    texts = ["nshuti cwa cc", "éa\u0002b\u0003 |q x. a,\tnéshy  ", "", None, " q ", "km 12kg 0007 7 12345 Dr. n'ish NO no1 'x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = vb.normalize_corpus(df).select("doc_id", "text", vb.phoneme_string(F.col("text")).alias("p"))
    got = {r.doc_id: (r.text, r.p) for r in out.collect()}
    assert got[0][1] == "nsh u t i | chw a | ch ch" and got[1][1] == "a b | . | a | , | n sh y"
    assert got[2][1] == got[4][1] == "" and got[3] == (None, None)
    assert got[5][0] == "kilometero icumi na kabirikilogiramu karindwi karindwi 12345 dogiteri . na ish nomero nomerorimwe 'x"
    assert "lambda" not in plan(df.select(vb.phoneme_string(F.col("text"))))
