"""Word-level operators on the language's own examples."""

from pyspark.sql import functions as F

from lexweave.operators import lexicon as lx, marks as mk, paradigms as pg, vocab as vb


def words(spark, items):
    return spark.createDataFrame([(w,) for w in items], "word string")


def mapping(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_noun_class(spark):
    expected = dict(
        abantu=2, amazi=6, ikigo=7, ibigo=8, urugo=11, akana=12, utugabo=13, uburezi=14, ahantu=16, inka=9, imvura=9,
        ibuye=5, ishuri=5, umuntu=1, umuti=1, igihugu=7, ibintu=8, ubwenge=14, urwego=11, ahasigarana=16, nkabantu=2,
    )
    out = lx.noun_class(words(spark, expected))
    assert mapping(out, "word", "noun_class") == expected
    stems = mapping(out, "word", "stem")
    for w, s in dict(umuntu="ntu", abantu="ntu", ikigo="go", ibigo="go", urugo="go", uburezi="rezi").items():
        assert stems[w] == s


def test_infinitives(spark):
    out = lx.infinitives(words(spark, "gukora gutura kugenda kubara kwiga gukorwa gukorera gufungura umuntu aragenda neza guturaho kororoka".split()))
    stems = mapping(out, "word", "stem")
    expected = dict(gukora="kor", gutura="tur", kugenda="gend", kubara="bar", kwiga="ig", guturaho="tur", kororoka="ororok")
    assert {k: stems[k] for k in expected} == expected
    assert {"gukorwa", "gukorera", "gufungura"} <= set(stems)
    assert not {"umuntu", "aragenda", "neza"} & set(stems)


def test_vowel_join(spark):
    rows = [
        ("mu", "iga", "mwiga"), ("ku", "amara", "kwamara"), ("ku", "oma", "koma"), ("mu", "oma", "mwoma"),
        ("ki", "ama", "cyama"), ("ki", "iga", "kiga"), ("bi", "iza", "byiza"), ("ya", "iga", "yiga"),
        ("ka", "iza", "keza"), ("ba", "inja", "benja"), ("ba", "enda", "benda"), ("ba", "nini", "banini"),
    ]
    df = spark.createDataFrame(rows, "prefix string, stem string, expected string")
    for r in pg.join_pairs(df).collect():
        assert r["surface"] == r["expected"], r


def test_surface(spark):
    rows = [
        ("bakora", False, "bakora"), ("u|mu|ntu", False, "umuntu"), ("ba|nini", False, "banini"),
        ("ku|eza", False, "kweza"), ("ba|inja", False, "benja"), ("n|vura", False, "mvura"), ("n|fite", False, "mfite"),
        ("n|baga", False, "maga"), ("ki|haza", False, "gihaza"), ("n|yoga", True, "nzoga"), ("ya|rem|ye", False, "yaremye"),
        ("ya|kor|ye", False, "yakoze"), ("bi|a|tek|w|ye", False, "byatetswe"), ("i|n|banza", False, "imanza"),
        ("mu|tek|yi", False, "mutetsi"), ("u|mu|ana", False, "umwana"), ("i|n|yira", True, "inzira"),
    ]
    df = spark.createDataFrame(rows, "m string, nine boolean, expected string")
    for r in df.withColumn("surface", pg.surface(F.col("m"), F.col("nine"))).collect():
        assert r["surface"] == r["expected"], r
    plain = df.where("m = 'n|yoga'").withColumn("s", pg.surface(F.col("m"))).first()["s"]
    assert plain != "nzoga"


def test_ortho(spark):
    w = words(spark, ["kweza", "aragenda", "mbaga", "mwana", "kueza", "mueza", "nbaga", "npamba", "inka", "gukorisha"])
    hits = {}
    for r in vb.ortho_scan(w).orderBy("word", "pos").collect():
        hits.setdefault(r["word"], []).append(r["type"])
    assert not {"kweza", "aragenda", "mbaga", "mwana", "inka"} & set(hits)
    assert hits["kueza"] == ["VV_HIATUS"] and hits["mueza"] == ["VV_HIATUS"]
    assert hits["nbaga"] == ["NASAL_ASSIM"] and hits["npamba"] == ["NASAL_ASSIM"]
    assert hits["gukorisha"] == ["VOWEL_ASSIM"]
    fixed = mapping(vb.ortho_repair(words(spark, ["nbaga", "npamba", "aragenda", "mbere", "nhanba", "atye"])), "word", "fixed")
    assert fixed == dict(nbaga="mbaga", npamba="mpamba", aragenda="aragenda", mbere="mbere", nhanba="mpamba", atye="ashe")


def test_phonemes(spark):
    out = {}
    for r in vb.phonemes(words(spark, ["genda", "ishuri", "bwana", "nyuma"])).orderBy("word", "pos").collect():
        out.setdefault(r["word"], []).append(r["token"])
    assert out == {
        "genda": ["g", "e", "nd", "a"], "ishuri": ["i", "sh", "u", "r", "i"], "bwana": ["bw", "a", "n", "a"],
        "nyuma": ["ny", "u", "m", "a"],
    }
    said = spark.createDataFrame([("Imana iravuga",)], "t string").select(vb.phoneme_string(F.col("t")).alias("p")).first()["p"]
    assert said == "i m a n a | i r a v u g a"


def test_normalize(spark):
    rows = [
        ("n'amazi", "na amazi"), ("y'abana, k'ishuri!", "ya abana , ku ishuri !".replace(" !", " .")),
        ("abantu 25", "abantu makumyabiri na gatanu"), ("1994", "igihumbi na amagana icyenda na mirongo icyenda na kane"),
        ("5 km", "gatanu kilometero"), ("12345", "12345"), ("Dr Kayitesi", "dogiteri Kayitesi"), ("0", "zeru"),
    ]
    df = spark.createDataFrame(rows, "t string, expected string")
    for r in df.withColumn("out", vb.normalize(F.col("t"))).collect():
        assert r["out"] == r["expected"], r


def test_verbs(spark, dims):
    expected = dict(
        aragenda="PRESENT", yaremye="PAST_PERF", yagendaga="PAST_IMPF", azagenda="FUTURE", agende="SUBJUNCTIVE",
        akagenda="NARRATIVE", ntaragenda="PRESENT",
    )
    out = lx.verbs(words(spark, [*expected, "aramubona"]), dims["verb_stems"])
    rows = {r["word"]: r for r in out.collect()}
    for w, tense in expected.items():
        assert rows[w]["tense"] == tense, rows[w]
    assert rows["ntaragenda"]["is_negative"] and not rows["aragenda"]["is_negative"]
    assert rows["aramubona"]["stem"] == "bon" and rows["aramubona"]["obj_class"] == 1


def test_adjectives_and_plurals(spark, dims):
    out = lx.adjectives(words(spark, ["munini", "banini", "nini", "mwiza", "byiza", "benshi", "nde", "barebare", "umuntu"]))
    got = {r["word"]: (r["noun_class"], r["stem"]) for r in out.collect()}
    assert got == {
        "munini": (1, "nini"), "banini": (2, "nini"), "nini": (9, "nini"), "mwiza": (1, "iza"), "byiza": (8, "iza"),
        "benshi": (2, "inshi"), "nde": (9, "re"), "barebare": (2, "re"),
    }
    pl = {r["word"]: (r["stem"], r["noun_class"]) for r in lx.plural_lookup(words(spark, ["abantu", "umuntu", "inka", "x"]), dims["plural_pairs"]).collect()}
    assert pl == {"abantu": ("ntu", 2), "umuntu": ("ntu", 1), "inka": ("ka", 9)}


def test_first_match_wins(spark, dims):
    out = lx.lexicon_tag(words(spark, ["iki", "na", "isi", "umuntu"]), dims["invariables"], dims["pronouns"], dims["known_words"])
    got = {r["word"]: (r["pos"], r["pron_type"]) for r in out.collect()}
    assert got == {"iki": ("PRONOUN", "DEMONSTRATIVE"), "na": ("CONJUNCTION", None), "isi": ("NOUN", None), "umuntu": (None, None)}
    assert out.count() == 4


def test_tag_words(spark, dims):
    expected = dict(
        umuntu=("NOUN", 1), aragenda=("VERB_CONJ", 1), gusoma=("VERB_INF", 15), munini=("ADJECTIVE", 1),
        byiza=("ADJECTIVE", 8), neza=("ADVERB", None), ariko=("CONJUNCTION", None), hano=("LOCATIVE", None),
        yaremye=("VERB_CONJ", 6), wacu=("PRONOUN", 1), cyacu=("PRONOUN", 7), abantu=("NOUN", 2), urugo=("NOUN", 11),
        nyiricyubahiro=("NOUN", 1), xqz=("FOREIGN", None),
    )
    out = pg.tag_words(words(spark, expected), dims)
    assert {r["word"]: (r["pos"], r["noun_class"]) for r in out.collect()} == expected


def test_marks(spark):
    lengths = dict(inzara=[1, None, 1], umwana=[1, 2, 1], guhinga=[None, 2, 1], inyoni=[1, None, 1], ishyari=[1, None, 1])
    out = words(spark, lengths).select("word", mk.forced_length(F.col("word")).alias("f"))
    assert mapping(out, "word", "f") == lengths
    rows = [
        ("umwâana", "guhinga", "guhíinga"), ("umwâana", "abana", "abáana"), ("umwaâmi", "umwami", "umwaámi"),
        ("umwâana", "gu-hiingiisha", "guhíingiisha"), ("umw-âana", "gu-hiingiisha", "guhíingiisha"),
        ("nda-bôna", "gu-kina", "gukína"), ("ndabôna", "gu-kina", "gukiná"),
    ]
    df = spark.createDataFrame(rows, "reference string, target string, expected string")
    for r in mk.transfer(df).collect():
        assert r["marking"] == r["expected"], r
    fam = [
        ("umusôre", w) for w in ["umukôro", "uruhâre", "igikênya", "gasôre", "musôni", "matâma", "shyôgwe", "shâmi", "isâro", "kôra"]
    ] + [("umugorê", w) for w in ["umukirê", "ubugomê", "urukizâ", "umugerî", "ihenê", "ishyarî", "isî", "indâ"]]
    members = spark.createDataFrame(fam, "family string, marked string")
    refs = spark.createDataFrame([("umusôre", "umusôre"), ("umugorê", "umugorê")], "family string, reference string")
    for r in mk.family_accuracy(members, refs).collect():
        assert r["reproduced"] == r["n"], r


def test_deverbatives_and_splits(spark, dims):
    nouns = spark.createDataFrame([("kora",), ("gore",), ("tunzi",), ("remo",)], "stem string")
    stems = spark.createDataFrame([("kor",), ("tung",), ("rem",), ("gor",)], "stem string")
    assert mapping(lx.deverbatives(nouns, stems), "stem", "verb_root") == dict(kora="kor", tunzi="tung", remo="rem")
    rows = lx.prefix_splits(words(spark, ["abana", "gu-hinga", "inyoni", "xyz"])).collect()
    got = {(r["word"], r["rank"]): (r["prefix"], r["stem"]) for r in rows}
    assert got[("abana", 1)] == ("aba", "na") and got[("abana", 2)] == ("ab", "ana")
    assert got[("gu-hinga", 1)] == ("gu", "hinga") and got[("xyz", 1)] == ("", "xyz")
    assert got[("inyoni", 1)] == ("i", "nyoni")


def test_gloss(spark, dims):
    t = spark.createDataFrame(
        [("aragenda", "VERB_CONJ", "gend"), ("umuntu", "NOUN", "ntu"), ("na", "CONJUNCTION", None), ("x", "NOUN", "x")],
        "lower string, pos string, stem string",
    )
    out = lx.gloss(t, dims["gloss_verbs"], dims["gloss_nouns"], dims["gloss_words"])
    assert mapping(out, "lower", "gloss") == dict(aragenda="go", umuntu="person", na="and/with", x="[?]")
