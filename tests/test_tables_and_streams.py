"""Sources, sinks and streams: a stream over the same files gives what the batch gives."""

import pytest
from pyspark.sql import functions as F

from lexweave.operators import lists as li, report as rp, rules as ru, tokens as tk
from lexweave.sources import corpus, tables as tb
from lexweave.streaming import jobs


def run(df, tmp_path, mode="append", name="out"):
    q = (
        df.writeStream.outputMode(mode).format("memory").queryName(name)
        .option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return df.sparkSession.table(name)


@pytest.fixture()
def lines(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("Umuntu na ariko. Nde araza.\n\n# left out\nnbaga (kueza\n", encoding="utf-8")
    (folder / "b.txt").write_text("Abana bari hano!\n", encoding="utf-8")
    return str(folder)


def test_stream_tokens_equal_batch(spark, lines, tmp_path):
    got = run(jobs.stream_tokens(jobs.read_lines(spark, lines, 1)), tmp_path, name="toks")
    batch = spark.read.text(lines).where("trim(value) <> '' and not startswith(value, '#')")
    batch = batch.select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))
    want = tk.tokenize(tk.sentences(batch))
    rows = lambda d: sorted((r["sent_no"], r["tok_no"], r["surface"], str(r["punct_type"])) for r in d.collect())
    assert rows(got) == rows(want)


def test_stream_analyze_and_checks(spark, lines, tmp_path, dims):
    s = jobs.stream_analyze(jobs.read_lines(spark, lines), dims["invariables"], dims["pronouns"], dims["known_words"])
    got = {r["word"]: r["pos"] for r in run(s, tmp_path, name="tagged").collect()}
    assert got["na"] == "CONJUNCTION" and got["nde"] == "PRONOUN" and got["hano"] == "LOCATIVE"
    o = run(jobs.stream_ortho(jobs.read_lines(spark, lines)), tmp_path, name="ortho")
    assert {(r["word"], r["type"]) for r in o.collect()} == {("nbaga", "NASAL_ASSIM"), ("kueza", "VV_HIATUS")}
    c = run(jobs.sentence_checks(jobs.read_lines(spark, lines), ["nde"]), tmp_path, name="checks")
    assert sorted(r["type"] for r in c.collect()) == ["MISSING_PERIOD", "MISSING_QMARK", "UNBALANCED_PAREN"]


LOG = [(1, "a", "normal", True), (2, "a", "normal", False), (3, "b", "", True), (4, "a", "melody", True), (5, "a", "normal", True)]
SCHEMA = "seq int, id string, kind string, correct boolean"


@pytest.fixture()
def log(spark, tmp_path):
    path = str(tmp_path / "log")
    for row in LOG:
        tb.append_log(spark.createDataFrame([row], SCHEMA).coalesce(1), path)
    return path


def test_log_streams(spark, log, tmp_path):
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(log)
    assert spark.read.parquet(log).count() == len(LOG)
    last = run(jobs.latest_take(stream(), ["id"], "seq", ["correct", "seq"]), tmp_path, "complete", "last")
    want = li.latest_take(spark.read.parquet(log), ["id"], "seq", ["correct", "seq"])
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect())) == [("a", True, 5), ("b", True, 3)]
    score = run(jobs.stream_score(stream()), tmp_path, "complete", "score")
    assert sorted(map(tuple, score.collect())) == [("melody", 1, 1, 100), ("normal", 3, 4, 75)]


def test_stream_cap(spark, log, tmp_path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(log)
    out = run(jobs.stream_cap(stream, ["id"], 2, ["seq"]), tmp_path, name="cap")
    counts = {r["id"]: r["count"] for r in out.groupBy("id").count().collect()}
    assert counts == {"a": 2, "b": 1}


def test_append_once(spark, log, tmp_path):
    target = str(tmp_path / "sink")
    for attempt in ("one", "two"):  # the second run replays every batch
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(log)
        q = jobs.append_once(stream, target, ["id", "kind"], str(tmp_path / f"ck-{attempt}")).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = spark.read.parquet(target)
        assert rows.count() == 3 and rows.dropDuplicates(["id", "kind"]).count() == 3


def test_windows(spark, tmp_path):
    path = str(tmp_path / "ev")
    rows = [("2024-01-01 00:00:00", "x"), ("2024-01-01 00:03:00", "x"), ("2024-01-01 00:07:00", "y"), ("2024-01-01 02:00:00", "x")]
    df = spark.createDataFrame(rows, "t string, kind string").select(F.col("t").cast("timestamp").alias("ts"), "kind")
    df.coalesce(1).write.parquet(path)
    stream = lambda: spark.readStream.schema(df.schema).parquet(path)
    out = run(jobs.violations_per_window(stream(), "ts", "5 minutes", ["kind"]), tmp_path, "complete", "win")
    want = li.per_window(df, "ts", "5 minutes", ["kind"])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    sess = run(jobs.takes_per_session(stream(), "ts", "10 minutes", ["kind"]), tmp_path, "complete", "sess")
    assert sorted((r["kind"], r["n"]) for r in sess.collect()) == [("x", 1), ("x", 2), ("y", 1)]


def test_read_table(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# note\nplain\tmarking\numwana\tumwáana\ninka\t\n", encoding="utf-8")
    df = tb.read_table(spark, str(tmp_path / "t.tsv"), ["plain", "marking", "group"])
    assert [tuple(r) for r in df.collect()] == [("umwana", "umwáana", ""), ("inka", "", "")]
    (tmp_path / "p.csv").write_text("x|y\nz\n", encoding="utf-8")
    df = tb.read_table(spark, str(tmp_path / "p.csv"), ["a", "b"], sep="|", header=False)
    assert [tuple(r) for r in df.collect()] == [("x", "y"), ("z", "")]


def test_replace_table_reads_itself(spark, tmp_path):
    path = str(tmp_path / "words")
    spark.range(5).write.parquet(path)
    tb.replace_table(spark.read.parquet(path).where("id > 2"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [3, 4]
    assert [p.name for p in tmp_path.iterdir()] == ["words"]


def test_aligned_roundtrip(spark, tmp_path):
    schema = "clip_id bigint, word bigint, w string, i bigint, ch string, start double, dur double, pitch double, pitch_1 double, pitch_2 double, context string, conf double"
    rows = [(c, i // 2, f"w{i // 2}", i, "a", i / 10, 0.1, None if i == 3 else float(i), None, 1.0, "contrastive", 1.0) for c in (1, 2) for i in range(10)]
    v = spark.createDataFrame(rows, schema)
    tb.write_aligned(v, str(tmp_path / "al"), part=4)
    back = tb.read_aligned(spark, str(tmp_path / "al"))
    assert sorted(map(str, back.select(*v.columns).collect())) == sorted(map(str, v.collect()))
    assert tb.nest_aligned(v, 4).count() == 6


def test_write_tags(spark, tmp_path):
    t = spark.createDataFrame([("Umuntu", "NOUN", 1, "ntu"), ("x", "FOREIGN", None, None)], "surface string, pos string, noun_class int, stem string")
    corpus.write_tags(t, str(tmp_path / "tags"))
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "tags")).collect())
    assert lines == ["Umuntu\tNOUN\t1\tntu", "x\tFOREIGN\t\t"]


def test_read_text_corpus(spark, lines):
    df = corpus.read_text_corpus(spark, lines)
    assert corpus.corpus_lines(df).count() == 3


def test_lexicon_folder_by_any_path(spark, lexicon_dir):
    from pyspark.errors import AnalysisException

    from lexweave.sources.dimensions import load_dimensions

    dims = load_dimensions(spark, f"file://{lexicon_dir}", optional=["documented"])
    assert dims["verb_stems"].count() == 11 and dims["documented"].count() == 0
    with pytest.raises(AnalysisException):
        load_dimensions(spark, lexicon_dir)


def test_the_first_error_of_a_token_is_corrected(spark):
    t = spark.createDataFrame([(1, 1, 1, "x")], "doc_id bigint, sent_no int, tok_no int, surface string")
    found = [F.struct(F.col("tok_no"), F.lit("SPELLING").alias("type"), F.lit(w).alias("corrected_word")) for w in ("zzz", "aaa")]
    assert rp.apply_corrections(t, ru.errors(t, found, numbered=True)).first().word == "zzz"
