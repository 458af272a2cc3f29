"""Trees, calibration, quality, toxicity, URL filter, chat, pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lexweave.llm import boosting, chat, quality, toxicity, urlfilter
from lexweave.llm.queries import QUERIES
from tests_odd import ODD


def test_trees_learn_what_one_split_cannot():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = boosting.fit(x[:2000], y[:2000])
    assert ((model.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95

    def slow(row):
        out = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            out += v[node - len(f)]
        return out

    assert np.allclose(model.raw(x[:50]), [slow(r) for r in x[:50]])


def test_trees_without_rows_or_with_one_class():
    assert boosting.fit(np.zeros((0, 3)), np.zeros(0)).probability(np.zeros((1, 3)))[0] == pytest.approx(0.5)
    assert boosting.fit(np.ones((5, 3)), np.ones(5)).probability(np.ones((1, 3)))[0] > 0.9


def test_isotonic_rises_and_fits():
    rnd = np.random.default_rng(1)
    raw = rnd.normal(size=500)
    y = (rnd.random(500) < 1 / (1 + np.exp(-2 * raw))).astype(float)
    curve = boosting.isotonic(raw, y)
    grid = curve(np.linspace(-4, 4, 100))
    assert (np.diff(grid) >= 0).all() and 0 < grid[0] < grid[-1] < 1
    assert abs(curve(raw).mean() - y.mean()) < 0.03


def held_out(doc, parts, rest):
    return doc is not None and zlib.crc32(str(doc).encode()) % parts == rest


@pytest.mark.parametrize(("name", "label", "parts", "rest", "threshold"), [("op2_toxicity", "toxic", 3, 1, 0.7), ("op10_quality", "quality", 5, 0, 0.3)])
def test_held_out_accuracy(spark, name, label, parts, rest, threshold):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES[name](spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == held_out(r.doc_id, parts, rest) and 0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in rows.values())
    marks = [(rows[r.doc_id].score, r[label]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    ones, zeros = ([s for s, y in marks if y == k] for k in (1, 0))
    assert np.mean([a > b for a in ones for b in zeros]) > 0.9


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_of_odd_rows(spark, odd, make_docs, module):
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, i % 2) for i in range(12)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = module.digests(odd, labels).collect()
    assert len(rows) == len(ODD)
    assert all(r.score is not None and 0 <= r.score <= 1 for r in rows)
    assert module.digests(odd.where("doc_id = 99"), labels).count() == 0
    assert module.digests(odd, labels.where("doc_id = 99")).count() == len(ODD)  # nothing to learn from
    kept = module.score(odd, module.fit(odd, labels))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "id", "score"]


def test_hidden_spellings_and_beginnings():
    lexicon = toxicity.Lexicon({"scum": (40, 0), "lowei-": (30, 1), "the": (50, 500)}, 50, 500)
    at = {n: i for i, n in enumerate(toxicity.NAMES)}
    found = lexicon.features("You scum! the loweizen s.c.u.m 5cum")
    assert found[at["hits"]] == 2 and found[at["hidden_hits"]] == 2 and found[at["near_second"]] == 2
    assert lexicon.features("")[1:] == [0.0] * (len(toxicity.NAMES) - 1)


def test_url_rules_against_plain_python(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.COM/en/x?y#z", "http://www.example.com/en/", "http://x.www.example.com/en/a", "ftp://net/es/", "http://a.net/fr/q", "http://a.net?/fr/", "http://badexample.com/en/", "http://com/", "http://com", "x://y://example.com/en/", "HTTP://ÄÖ.net/ES/", "http://e.com/\nb", "http://example.com/en"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)] + [(0, None, "old")], "page_id long, url string, host string")
    rows = urlfilter.judge(df, urlfilter.own_labels(spark)).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        _, mark, after = (r.url or "").partition("://")
        name = re.match(r"[^/?#]*", after).group() if mark else ""
        path = re.match(r"[^?#]*", after[len(name) :]).group() if mark else ""
        name = re.sub("[A-Z]", lambda m: m.group().lower(), name)
        fits = sorted((x for x in urlfilter.RULES if (name == x[0] or name.endswith("." + x[0])) and path.startswith(x[1])), key=lambda x: -len(x[0] + x[1]))
        assert (r.host, r.path, r.rule) == (name, path, fits[0][0] + fits[0][1] if fits else None)
        assert r.verdict == (fits[0][2] if fits else "block" if r.score >= 0.5 else "allow")
    assert urlfilter.judge(df.where("page_id = 99"), urlfilter.own_labels(spark)).count() == 0


def test_url_model_on_urls_it_has_not_seen(spark):
    def urls(seed, n):
        rnd = random.Random(seed)
        bad, good = "casino poker viagra porn warez jackpot".split(), "library recipes museum weather science garden".split()
        return [(f"http://{rnd.choice(w)}-{rnd.randint(0, 999)}.example/{rnd.choice(w)}/{rnd.randint(0, 999)}", y) for _ in range(n) for w, y in ((bad, 1), (good, 0))]

    train, test = (spark.createDataFrame(urls(s, n), "url string, label int") for s, n in ((1, 40), (2, 60)))
    rows = urlfilter.judge(test, train, rules=()).collect()
    assert np.mean([(r.verdict == "block") == (r.label == 1) for r in rows]) > 0.95
    weights, intercept = urlfilter.train(train)
    r = rows[0]
    both = [(0, "^" + r.host), (1, r.path + "$")]
    seen = [(k, t[i : i + n]) for k, t in both for n in urlfilter.SIZES for i in range(len(t) - n + 1)]
    hashed = spark.createDataFrame(seen, "k int, g string").selectExpr("cast(pmod(xxhash64(k, g), 4096) as int) AS b").collect()
    assert r.score == pytest.approx(1 / (1 + np.exp(-(intercept + sum(weights[x.b] for x in hashed) / len(seen)))), abs=1e-6)


def test_chat_round_trip_over_cut_conversations(spark, tmp_path):
    rnd = random.Random(6)
    template = chat.Template()
    bits = [*template.control, "\\", ".", "\\.", "a", "[", "<", "/", "\n", "中", ""]
    turns = {}
    for conv in (1, 2, 3):
        for turn in range({1: 400, 2: 3, 3: 1}[conv]):
            turns[conv, turn] = (rnd.choice(["system", "user", "assistant", "tool", "[END]", None]), rnd.choice([None, "".join(rnd.choices(bits, k=rnd.randint(0, 9)))]))
    df = spark.createDataFrame([(c, t, *x, 1) for (c, t), x in turns.items()] + [(None, 0, "user", "x", 1)], "conv_id long, turn long, role string, text string, part int").repartition(5)
    path = str(tmp_path / "chat")
    chat.write_chat(df, path, partitions=6)
    out = spark.read.parquet(path)
    assert out.select("part").distinct().count() > 3
    found = {r.conv_id: r for r in chat.digests(spark, path).collect()}
    for conv in (1, 2, 3):
        own = [(role or "", text or "") for (c, _), (role, text) in sorted(turns.items()) if c == conv]
        whole = "".join(r.content for r in out.where(f"conv_id = {conv}").orderBy("part", "place", "segment").collect())
        assert template.parse(whole) == own
        state, bad = template.start, 0
        for role, _ in own:
            state, ok = template.step(state, role)
            bad += not ok
        masked = "".join(t for r, t in own if r == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256, r.n_out_of_order) == (len(own), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest(), bad)
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(whole))
    ends = {(r.conv_id, r.complete) for r in out.where("complete IS NOT NULL").collect()}
    assert (1, template.complete >= {state}) or ends
    assert found[None].n_turns == 1
    none = str(tmp_path / "none")
    chat.write_chat(df.where("turn > 1000"), none)
    assert chat.digests(spark, none).count() == 0


def test_no_control_string_survives_escaping():
    rnd = random.Random(9)
    template = chat.Template()
    for _ in range(2000):
        text = "".join(rnd.choices([*template.control, "\\", ".", "[", "<", "/"], k=rnd.randint(0, 6)))
        escaped = template.escape(text)
        assert not any(c in escaped for c in template.control)
        assert template.unescape(escaped) == text


def near_duplicate_leaders(now, earlier):
    """Smallest ids of the groups that Jaccard similarity of 0.8 over five-word shingles links, now or in the earlier texts."""
    from lexweave.llm import similar

    root = {i: i for i in now}
    for texts in (now, {i: earlier[i] for i in now}):
        sets = {i: similar.shingle_set(t) for i, t in texts.items()}
        for i in sorted(sets):
            for j in sorted(sets):
                if i < j and root[i] != root[j] and similar.similarity(sets[i], sets[j]) >= 0.8:
                    low, high = sorted((root[i], root[j]))
                    root = {k: low if v == high else v for k, v in root.items()}
    return set(root.values())


def test_pipeline_by_plain_steps(spark, sf, tmp_path):
    """Each stage against what its operator says of the stage's own input."""
    import corpus_pipeline
    from lexweave.llm import decontam, linededup

    docs = corpus_pipeline.documents(spark, sf)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, sf), "stage")
        assert out.columns == columns
        before, after = docs.collect(), {r.doc_id: r for r in out.collect()}
        if name == "quality classifier":
            model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            want = {r.doc_id for r in before if model.probability(np.array([quality.statistics(r.text or "")]))[0] >= quality.THRESHOLD}
            assert set(after) == want
        elif name == "line dedup":
            gone = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
            assert {i: r.text for i, r in after.items()} == {i: r.text for i, r in gone.items() if not r._removed or r.text}
        elif name == "SimHash near-dedup":
            assert set(after) == near_duplicate_leaders({r.doc_id: r.text for r in before}, {r.doc_id: r.text for r in corpus_pipeline.documents(spark, sf).collect()})
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            patterns = decontam.Patterns(items)
            assert set(after) == {r.doc_id for r in before if not patterns.hits([r.text], [None])[0]["spans"]}
        assert 0 < len(after) <= len(before)
        docs = out
    packed = corpus_pipeline.packing_stage(spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_pipeline_of_odd_rows(spark, odd, sf):
    import corpus_pipeline

    docs = odd
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = corpus_pipeline.written(stage(spark, docs, sf), "odd")
    assert docs.count() > 0
    docs = odd.where("doc_id = 99")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf), "none")
    assert docs.count() == 0
